"""Prefix trie of conversations with totals of its subtrees, by time-forward processing.

A node is a sequence of first turns; its name is its depth and a 128-bit hash of the sequence. Totals travel from the
deepest nodes to the root. The trie is cut into fragments: a subtree of at most ``most`` turns hangs whole in one
fragment, and the few nodes above such subtrees are cut every ``band`` levels. Fragments are dealt over shards. Spark
sorts each shard by reverse level order, a spilling priority queue hands every node's totals on to its parent, and what the
roots of fragments hold is summed up and goes on to the nodes above; there the same walk runs over the fragments of the
upper nodes and, if there are several, over the tree that their roots make.
"""

import hashlib
import heapq
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import functions as F

from courtflow.functions.slices import running, slice_of
from courtflow.session import staged

SALTS = 64
_ID = ["depth", "h1", "h2"]
_UP = ["up_depth", "up1", "up2"]
_GIVEN = [*_ID, *_UP, "top", "conv_id", "n_convs", "own", "n_children", "n_leaves", "saved_tokens"]
_FOUND = [*_ID, *_UP, "top", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_FOUND_SCHEMA = ", ".join(f"{c} {'boolean' if c == 'top' else 'long'}" for c in _FOUND)


class SpillingQueue:
    """A priority queue of tuples that holds at most ``limit`` of them in memory.

    What is beyond goes to sorted runs in one unnamed scratch file per run, which ends with the task (a lost task begins anew);
    many runs are merged into one.
    """

    def __init__(self, limit=100_000, runs=32):
        self.limit, self.runs, self.near, self.heads, self.count = limit, runs, [], [], 0

    def push(self, item):
        heapq.heappush(self.near, item)
        if len(self.near) > self.limit:
            held, self.near = sorted(self.near), []
            if len(self.heads) >= self.runs:
                held = heapq.merge(held, *[self._rest(head, run) for head, _, run in self.heads])
                self.heads = []
            self._spill(held)

    @staticmethod
    def _rest(head, run):
        yield head
        yield from run

    def _spill(self, held):
        file, part = tempfile.TemporaryFile(), []
        for item in held:
            part.append(item)
            if len(part) == 1000:
                pickle.dump(part, file)
                part = []
        pickle.dump(part, file)
        file.seek(0)
        run = self._read(file)
        head = next(run, None)
        if head is not None:
            self.count += 1
            heapq.heappush(self.heads, (head, self.count, run))

    @staticmethod
    def _read(file):
        with file:
            while True:
                try:
                    part = pickle.load(file)
                except EOFError:
                    return
                yield from part

    def pop_below(self, key):
        """The least item if its first field is at most ``key``, else None."""
        far = self.heads and (not self.near or self.heads[0][0] < self.near[0])
        if far:
            if self.heads[0][0][0] > key:
                return None
            head, count, run = self.heads[0]
            after = next(run, None)
            if after is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (after, count, run))
            return head
        if self.near and self.near[0][0] <= key:
            return heapq.heappop(self.near)
        return None


def _forward(limit):
    """Walk a shard's nodes in reverse level order; a node comes out with its parent, or by itself if it is a top."""

    def run(batches):
        queue = SpillingQueue(limit)
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in _GIVEN), strict=True):
                depth, h1, h2, up_depth, up1, up2, top, conv, n_convs, own, kids, leaves, saved = row
                key = (-depth, h1, h2)
                while (child := queue.pop_below(key)) is not None:
                    node = child[1]
                    out.append((*node[:7], node[7], conv, *node[8:]))
                    kids, leaves, saved = kids + 1, leaves + node[10], saved + node[11]
                node = (depth, h1, h2, up_depth, up1, up2, top, conv, n_convs, kids, leaves if kids else 1, saved + own)
                if top:
                    out.append((*node[:8], None, *node[8:]))
                else:
                    queue.push(((-up_depth, up1, up2), node))
            columns = list(zip(*out, strict=True)) if out else [()] * len(_FOUND)
            kinds = [pa.bool_() if c == "top" else pa.int64() for c in _FOUND]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)], _FOUND
            )

    return run


def forward(nodes, shard, limit=100_000):
    """Totals of ``nodes``, whose fragments are named by the columns ``shard`` and sorted by Spark, within each fragment.

    ``n_children``, ``n_leaves`` and ``saved_tokens`` are what nodes outside have handed in. Tops come out without their parent's
    conv_id. Every parent of a node that is no top has to be in its fragment.
    """
    dealt = nodes.repartition(*shard).sortWithinPartitions(F.desc("depth"), "h1", "h2")
    return dealt.select(*_GIVEN).mapInArrow(_forward(limit), _FOUND_SCHEMA)


def rebuilt(turns, share=5, heads=9):
    """Turns of the rebuilt conversations: conv_id, depth (from 1), k1, k2, bytes, len; and (conv_id, len) of all.

    Conversation c takes the first h turns of conversation c - c % ``share`` and its own after its first h, where h is
    crc32(c) % ``heads``. Rows of one conversation are numbered slice by slice of its turns, so it may hold any share of all rows.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("k1"),
        F.xxhash64(F.lit("turn"), text, role).alias("k2"),
        F.octet_length(text).cast("long").alias("bytes"),
    ).where("conv_id is not null")
    rows = rows.withColumn("slice", F.coalesce(slice_of("turn"), F.lit(-(1 << 62))))
    rows = running(rows, ["conv_id"], ["turn", "k1", "k2"], {"pos": ("count", F.lit(1))})
    rows = staged(rows.drop("turn"), "turns")
    cells = rows.groupBy("conv_id", "slice").agg(F.max("pos").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % share
    convs = cells.groupBy("conv_id").agg(F.max("n").alias("n")).select(
        "conv_id", "n", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % heads).cast("long").alias("h")
    )
    held = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(held, "base", "left").select(
        "conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")
    )
    convs = staged(convs, "conversations")
    facts = cells.select("conv_id", "slice").join(convs, "conv_id")
    own = rows.join(facts, ["conv_id", "slice"]).where("pos > h or conv_id = base")
    depth = F.when(F.col("conv_id") == F.col("base"), F.col("pos")).otherwise(F.col("taken") + F.col("pos") - F.col("h"))
    own = own.select("conv_id", depth.alias("depth"), "k1", "k2", "bytes", "len")
    first = rows.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "k1", "k2", "bytes")
    given = convs.where("conv_id <> base").join(first, "base").where("pos <= h")
    given = given.select("conv_id", F.col("pos").alias("depth"), "k1", "k2", "bytes", "len")
    return own.unionByName(given), convs.select("conv_id", "len")


def _paths(turns, convs):
    """A row per conversation and node on its path, the root included."""
    rows = turns.select(
        "conv_id", "depth", "bytes", "len", slice_of("depth").alias("slice"),
        F.xxhash64("depth", "k1").alias("g1"), F.xxhash64("k2", "depth").alias("g2"),
    )
    rows = running(rows, ["conv_id"], ["depth"], {h: ("bit_xor", F.col(g)) for h, g in (("h1", "g1"), ("h2", "g2"))})
    rows = rows.select(
        "conv_id", *_ID, F.col("h1").bitwiseXOR(F.col("g1")).alias("up1"),
        F.col("h2").bitwiseXOR(F.col("g2")).alias("up2"), "bytes", "len",
    )
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", *[zero.alias(c) for c in (*_ID, "up1", "up2", "bytes")], "len")
    return rows.unionByName(root)


def _fragments(paths, nodes, most, band):
    """Nodes with the names of their fragments (f0, f1, f2), light ones and heavy ones apart.

    Names come from the paths of the conversations that name the nodes; heavy nodes meet many paths and are copied
    ``SALTS`` times for that.
    """
    heavy, light = nodes.where(F.col("weight") > most), nodes.where(F.col("weight") <= most)
    salted = heavy.select(*_ID, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    below = paths.select("conv_id", *_ID, F.pmod("conv_id", F.lit(SALTS)).cast("int").alias("salt"))
    below = below.join(salted, [*_ID, "salt"], "left_anti")
    name = F.min(F.struct("depth", "h1", "h2")).alias("f")
    names = below.groupBy("conv_id").agg(name).select(
        "conv_id", F.col("f.depth").alias("f0"), F.col("f.h1").alias("f1"), F.col("f.h2").alias("f2")
    )
    light = light.join(names, "conv_id")
    heads = paths.where(F.col("depth") % band == 0).select(
        "conv_id", F.col("depth").alias("f0"), F.col("h1").alias("f1"), F.col("h2").alias("f2")
    )
    heavy = heavy.withColumn("f0", F.col("depth") - F.col("depth") % band).join(heads, ["conv_id", "f0"])
    return light, heavy


_SUMS = ["n_children", "n_leaves", "saved_tokens"]


def _handed_in(*parts):
    """What tops hand in to their parents, one row per parent: each part has the tops with n_leaves and saved_tokens."""
    up = [F.col(u).alias(c) for u, c in zip(_UP, _ID, strict=True)]
    one = F.lit(1).cast("long").alias("n_children")
    rows = [part.where("depth > 0").select(*up, one, "n_leaves", "saved_tokens") for part in parts]
    for more in rows[1:]:
        rows[0] = rows[0].unionByName(more)
    return rows[0].groupBy(*_ID).agg(*[F.sum(c).alias(c) for c in _SUMS])


def _given(nodes, inbox=None):
    top = F.expr("depth = f0 and h1 = f1 and h2 = f2")
    if inbox is not None:
        nodes = nodes.join(inbox, _ID, "left")
        nodes = nodes.withColumns({c: F.coalesce(c, F.lit(0)) for c in _SUMS})
    else:
        nodes = nodes.withColumns({c: F.lit(0).cast("long") for c in _SUMS})
    own = (F.col("n_convs") - 1) * F.col("bytes")
    return nodes.withColumns({"top": top, "own": own})


def _across(found, heavy, limit):
    """Totals of the heavy fragments' roots, each with all fragments below it: rows that tops are made of."""
    tops = found.where("top")
    where = heavy.select(*[F.col(c).alias(u) for u, c in zip(_UP, _ID, strict=True)], "f0", "f1", "f2")
    tree = tops.join(where, _UP, "left").select(
        *_ID, F.col("f0").alias("up_depth"), F.col("f1").alias("up1"), F.col("f2").alias("up2"),
        (F.col("depth") == 0).alias("top"), "conv_id", "n_convs", F.lit(0).cast("long").alias("own"),
        F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
    )
    full = forward(tree, [F.lit(0)], limit).select(*_ID, "n_leaves", "saved_tokens")
    return tops.drop("n_leaves", "saved_tokens").join(full, _ID)


def subtree_totals(nodes, paths, fragment=1 << 10, shards=2048, band=4096, limit=100_000):
    """n_children, n_leaves, saved_tokens and the parent's conv_id of each of ``nodes``.

    A fragment below holds at most ``fragment`` turns or one of ``shards`` parts of all, whatever is more; so at most
    ``shards`` nodes of one level lie above, and a fragment of theirs has ``band`` levels. ``limit`` is what a queue keeps in memory.
    """
    most = nodes.where("depth = 0").agg(F.max("weight")).first()[0]
    most = max(fragment, (most or 0) // shards)
    light, heavy = _fragments(paths, nodes.withColumn("up_depth", F.col("depth") - 1), most, band)
    light = staged(forward(_given(light), ["f0", "f1", "f2"], limit), "subtrees")
    heavy = staged(heavy, "upper")
    roots = heavy.where("depth = f0 and depth > 0")
    empty = roots.select(*_ID, *_UP, *[F.lit(0).cast("long").alias(c) for c in ("n_leaves", "saved_tokens")])
    inbox = _handed_in(light.where("top"), empty)
    upper = staged(forward(_given(heavy, inbox), ["f0", "f1", "f2"], limit), "upper-totals")
    if not roots.isEmpty():
        across = staged(_across(upper, heavy, limit), "across")
        inbox = _handed_in(light.where("top"), across)
        upper = staged(forward(_given(heavy, inbox), ["f0", "f1", "f2"], limit), "upper-totals")
    tops = light.where("top").unionByName(upper.where("top")).drop("parent_conv_id")
    tops = tops.withColumn("salt", F.pmod("h1", F.lit(SALTS)).cast("int"))
    above = heavy.select(
        *[F.col(c).alias(u) for u, c in zip(_UP, _ID, strict=True)], F.col("conv_id").alias("parent_conv_id"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    tops = tops.join(above, [*_UP, "salt"], "left").drop("salt")
    inner = light.where("not top").unionByName(upper.where("not top"))
    return inner.unionByName(tops).drop("top", *_UP)


def _texts(chunk):
    """Decimal numbers of sorted rows joined by commas, a row per run of one node and ``chunk`` numbers."""

    def run(batches):
        kept, name, out = [], None, []

        def flush():
            if kept:
                out.append((*name, kept[0], ",".join(map(str, kept))))
                kept.clear()

        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in (*_ID, "conv_id")), strict=True)
            for *node, conv in rows:
                if node != name or len(kept) >= chunk:
                    flush()
                    name = node
                kept.append(conv)
            yield _chunk_batch(out)
        out = []
        flush()
        yield _chunk_batch(out)

    return run


def _chunk_batch(out):
    columns = list(zip(*out, strict=True)) if out else [()] * 5
    kinds = [pa.int64()] * 4 + [pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)], [*_ID, "first", "numbers"]
    )


def _digests(batches):
    """SHA-256 over the sorted runs of each node."""
    name, digest = None, None
    for batch in batches:
        out = []
        for *node, numbers in zip(*(batch.column(c).to_pylist() for c in (*_ID, "numbers")), strict=True):
            if node != name:
                if name is not None:
                    out.append((*name, digest.hexdigest()))
                name, digest = node, hashlib.sha256(numbers.encode())
            else:
                digest.update(b"," + numbers.encode())
        yield _digest_batch(out)
    yield _digest_batch([(*name, digest.hexdigest())] if name is not None else [])


def _digest_batch(out):
    columns = list(zip(*out, strict=True)) if out else [()] * 4
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)], [*_ID, "ends_sha256"]
    )


def end_digests(ends, chunk=50_000):
    """SHA-256 of the conv_ids that end at each node, ascending and joined by commas.

    Rows are dealt by ranges of (node, conv_id), so the members of one node spread over as many tasks as they need; the runs
    are then hashed one after the other, which is what SHA-256 asks for, a run in memory at a time.
    """
    dealt = ends.repartitionByRange(*_ID, "conv_id").sortWithinPartitions(*_ID, "conv_id")
    ids = ", ".join(f"{c} long" for c in _ID)
    runs = dealt.select(*_ID, "conv_id").mapInArrow(_texts(chunk), f"{ids}, first long, numbers string")
    runs = runs.repartition(*_ID).sortWithinPartitions(*_ID, "first")
    return runs.mapInArrow(_digests, f"{ids}, ends_sha256 string")


def conversation_trie(turns, share=5, heads=9, **cut):
    """Nodes of the prefix trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    Gives conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 per node. ``cut`` goes to ``subtree_totals``. Null role and text are empty; a null turn comes first;
    turns of one number come in the order of their hashes; repeated rows are turns of their own; rows without conv_id are no
    conversation's and left out; other columns are ignored. ``%`` keeps the sign of a negative conv_id. An empty table has no node.
    """
    rows, convs = rebuilt(turns, share, heads)
    paths = staged(_paths(rows, convs), "paths")
    nodes = paths.groupBy(*_ID).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"),
        F.min("up1").alias("up1"), F.min("up2").alias("up2"), F.sum(F.col("len") - F.col("depth") + 1).alias("weight"),
    )
    nodes = staged(nodes, "nodes")
    found = subtree_totals(nodes, paths, **cut)
    ends = end_digests(paths.where("depth = len").select(*_ID, "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return found.join(ends, _ID, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
