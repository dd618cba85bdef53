"""SimHash near-duplicates with pigeonring candidate search.

The 64 bits of a fingerprint form a ring of ``distance + 1`` segments, three at least. If two fingerprints differ in at most
``distance`` bits, the strong form of the pigeonring principle gives a start on the ring from which every chain of
l consecutive segments differs in at most ``l * distance / segments`` bits. So some segment is equal and the next one
differs in one bit at most: that much is looked up, by a key of both segments, with the one-bit neighbours of the second.
Longer chains prune what a key brings together before all 64 bits are compared.

The members of one key are not paired with each other. A search from member to member emits only a spanning
forest of their links, which is all that the classes need; a dense group of n near copies costs about n comparisons
of shrinking arrays and n - 1 edges.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from courtflow.llm.batches import staged_texts
from courtflow.llm.components import components
from courtflow.llm.words import Text, pieces, tidy
from courtflow.session import staged

SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _fingerprint(words, shingle):
    """Fingerprint of one document's lower-case words."""
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n
    )
    votes = np.zeros(64, np.int64)
    for low in range(0, n, 1 << 16):
        votes += np.unpackbits(
            hashes[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        ).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_rows(shingle):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                text = Text(part.column("text"))
                found = np.fromiter(
                    (_fingerprint(text.row_bytes(r).translate(_LOWER).split(), shingle) for r in range(text.n)),
                    np.uint64,
                    text.n,
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(found.view(np.int64))], ["doc_id", "key", "fp"]
                )

    return run


def _key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def fingerprints(docs, shingle=4):
    """doc_id, key (hash of id and text) and 64-bit fingerprint ``fp`` of each row; texts without words have 0."""
    rows = docs.select(F.col("doc_id").cast("long"), _key().alias("key"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(_fingerprint_rows(shingle)), "doc_id long, key long, fp long")


def ring(distance):
    """(first bit, number of bits) of the segments."""
    m = max(3, distance + 1)
    bounds = [64 * i // m for i in range(m + 1)]
    return list(zip(bounds[:-1], np.diff(bounds).tolist(), strict=True))


def _mask(segments):
    return np.uint64(sum(((1 << bits) - 1) << first for first, bits in segments))


def _chains(distance):
    """For each start: masks of the chains of three segments and more, with their budgets."""
    segments = ring(distance)
    m = len(segments)
    return [
        [(_mask([segments[(i + j) % m] for j in range(n)]), n * distance // m) for n in range(min(3, m), m + 1)]
        for i in range(m)
    ]


def _key_rows(distance, width):
    """Keys of two consecutive segments, below the number of the first; a member also stands under the keys with one bit of the second cleared.

    Of two members whose second segments differ in one bit, the one that has the bit set finds the other.
    """
    segments = ring(distance)
    m = len(segments)

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            keys, members = [], []
            for i in range(m):
                first, bits = segments[i]
                then, more = segments[(i + 1) % m]
                own = np.uint64(i << width)
                own = own | (((fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)) << np.uint64(more))
                tail = (fp >> np.uint64(then)) & np.uint64((1 << more) - 1)
                keys.append(own | tail)
                members.append(fp)
                for bit in range(more):
                    one = np.uint64(1 << bit)
                    has = (tail & one) != 0
                    keys.append(own[has] | (tail[has] ^ one))
                    members.append(fp[has])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).view(np.int64)) for x in (keys, members)], ["key", "fp"]
            )

    return run


def _links(x, others, chains):
    """Which of ``others`` are within the distance of x, chain by chain."""
    at = np.arange(len(others))
    for mask, budget in chains:
        at = at[np.bitwise_count((others[at] ^ x) & mask) <= budget]
    return at


def _forest(members, chains):
    """Spanning forest of the links among the members, found from member to member."""
    a, b = [], []
    waiting = members
    while len(waiting) > 1:
        seeds, waiting = [waiting[0]], waiting[1:]
        while seeds and len(waiting):
            x = seeds.pop()
            near = _links(x, waiting, chains)
            if len(near):
                found = waiting[near]
                seeds.extend(found)
                a.append(np.full(len(found), x))
                b.append(found)
                waiting = np.delete(waiting, near)
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(a), np.concatenate(b)


def _edge_rows(distance, width):
    chains = _chains(distance)
    small = 8

    def run(batches):
        held_keys, held = np.empty(0, np.int64), np.empty(0, np.uint64)

        def edges(keys, fps):
            a, b = [], []
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(keys)))
            spread = np.repeat(size, size)
            at = np.flatnonzero((spread > 1) & (spread <= small))
            for lag in range(1, small):  # small keys side by side
                at = at[at + lag < len(keys)]
                at = at[keys[at] == keys[at + lag]]
                if not len(at):
                    break
                which = keys[at] >> width
                pair, ok = fps[at] ^ fps[at + lag], np.ones(len(at), bool)
                for step in range(len(chains[0])):
                    mask = np.array([c[step][0] for c in chains], np.uint64)[which]
                    ok &= np.bitwise_count(pair & mask) <= chains[0][step][1]
                a.append(fps[at[ok]])
                b.append(fps[at[ok] + lag])
            for run_at in np.flatnonzero(size > small):
                low = begin[run_at]
                x, y = _forest(fps[low : low + size[run_at]], chains[keys[low] >> width])
                a.append(x)
                b.append(y)
            a, b = (np.concatenate(z) if z else np.empty(0, np.uint64) for z in (a, b))
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]
            )

        for batch in batches:
            keys = np.concatenate([held_keys, batch.column("key").to_numpy()])
            fps = np.concatenate([held, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            held_keys, held = keys[cut:], fps[cut:]
            if cut:
                yield edges(keys[:cut], fps[:cut])
        if len(held_keys):
            yield edges(held_keys, held)

    return run


def classes(prints, distance=4):
    """Classes of fingerprints: fp, root (a fingerprint of the class) and component_id, the smallest doc_id reachable by links.

    ``prints`` has doc_id and fp. Links join fingerprints that differ in ``distance`` bits or fewer; none is lost.
    """
    if distance < 1:
        raise ValueError("distance is 1 or more")
    bits = [bits for _, bits in ring(distance)]
    width = max(x + y for x, y in zip(bits, bits[1:] + bits[:1], strict=True))
    each = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    keyed = each.select("fp").mapInArrow(tidy(_key_rows(distance, width)), "key long, fp long")
    edges = (
        keyed.repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(tidy(_edge_rows(distance, width)), "a long, b long")
    )
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    rooted = each.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs, shingle=4, distance=4):
    """SimHash classes of ``docs`` (doc_id, text): doc_id, fp and component_id, one row per input row.

    A-Z are lower-cased; words are runs other than ASCII white space; a text shorter than a shingle is one
    shingle, repeated shingles vote as often as they occur, ties clear the bit. Null and empty texts
    have fingerprint 0 and link like any other. Null ids join their class but never name it (a class of null ids
    only has a null component_id). Rows that repeat an id are classed each. Other columns are not read.
    """
    prints = staged_texts(fingerprints(docs, shingle), "fingerprints")
    return prints.join(classes(prints, distance), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs, shingle=4, distance=4):
    """One row of ``docs`` for each class: the one with the smallest doc_id (null last), all columns unchanged."""
    prints = staged_texts(fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first")
    chosen = prints.join(classes(prints, distance), "fp").groupBy("root").agg(first).select("first.key").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key().alias("key"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return rows.join(chosen, "key").withColumn("nth", nth).where("nth = 1").select("row.*")
