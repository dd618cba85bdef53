"""WARC archives with an index, and coalesced reads of selected records.

Writing: each task writes its records, in a fixed order, to gzip archives of one member per record and yields an
index row per record: archive, offset, length, URL and payload digest. Identical payloads are stored once; the
others are revisit records. A task that is run again writes the same bytes under the same names.

Reading: index rows are sorted by archive and offset, neighbours are merged into byte ranges, and each range is fetched by
one read, from which the selected records are cut. Ranges are dealt over as many tasks as their bytes ask for, however small the index.
"""

import base64
import gzip
import hashlib
import json
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from courtflow.session import work_folder

_DATE = "2000-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = (
    "archive string, offset long, length long, url string, payload_digest string, page_id long, record_type string"
)
_RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "payload binary"
)


def base32(digest_hex):
    """Bare upper-case base32 of a hexadecimal SHA-1."""
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def _line(value):
    """A header value: one line, whatever the source held."""
    return " ".join(value.split())


def _name(page_id, digest):
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url, payload, digest, refers_to):
    """Bytes of one record; ``refers_to`` is the page of the response that a revisit repeats, or None."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_name(page_id, digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_line(url) if url else f'urn:page:{page_id}'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is None:
        head.append("X-No-Url: 1")
    elif _line(url) != url or not url:  # a header cannot say it as it is
        head.append(f"X-Url: {json.dumps(url)}")
    if refers_to is not None:
        head += [
            f"WARC-Profile: {_REVISIT}",
            f"WARC-Refers-To: {_name(refers_to, digest)}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw):
    """Headers (lower-case names) and payload of one record; the payload of a revisit is None."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else None
    return fields, payload


def _open(folder):
    return pafs.FileSystem.from_uri(folder)


def _write_rows(folder, roll):
    def run(batches):
        context = TaskContext.get()
        store, base = _open(folder)
        number, at, out, part, rows = 0, 0, None, None, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                store.move(part, part.rsplit(".", 2)[0])  # whole archives only, under a name fixed by the task
                out = None

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    archive = f"part-{context.partitionId():06d}-{number:04d}.warc.gz"
                    part = f"{base}/{archive}.{context.taskAttemptId()}.part"
                    out, at, number = store.open_output_stream(part, compression=None), 0, number + 1
                digest = base32(digest)
                member = gzip.compress(record(page_id, url, (html or "").encode(), digest, refers_to), 3, mtime=0)
                out.write(member)
                kind = "response" if refers_to is None else "revisit"
                rows.append((archive, at, len(member), url, digest, page_id, kind))
                at += len(member)
                if at >= roll:
                    close()
            if len(rows) >= 10_000:
                yield _index_batch(rows)
                rows = []
        close()
        yield _index_batch(rows)

    return run


def _index_batch(rows):
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    names = [f.split()[0] for f in _INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def write(pages, folder, least_bytes=0, roll=256 << 20):
    """Write ``pages`` (page_id, url, html) as archives under ``folder``; returns the written index.

    One record per row; a null html is an empty payload, a null url is kept as such. Of records with equal payloads of at
    least ``least_bytes`` bytes, the one with the greatest page_id is the response; rows that repeat that id are responses
    too. Null ids are smaller than any; where a payload has no other, all its records are responses.
    Other columns are not read. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1("html"))
    groups = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"))
    marked = rows.join(groups, "digest", "left").select(
        "page_id",
        "url",
        "html",
        "digest",
        F.expr("if(first is null or page_id <=> first, null, first)").alias("refers_to"),
    )
    ordered = marked.sortWithinPartitions("page_id", "url", "digest")
    index = ordered.mapInArrow(_write_rows(folder, roll), _INDEX)
    path = f"{folder}/index"
    index.write.parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def _url(fields):
    if "x-no-url" in fields:
        return None
    return json.loads(fields["x-url"]) if "x-url" in fields else fields["warc-target-uri"]


def _read_rows(folder, payloads):
    def run(batches):
        store, base = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['archive']}") as source:
                    held = source.read_at(row["size"], row["start"])
                out = []
                for place in row["places"]:
                    low = place["offset"] - row["start"]
                    fields, payload = parse(gzip.decompress(held[low : low + place["length"]]))
                    digest = fields["warc-payload-digest"].partition(":")[2]
                    if payload is not None and base32(hashlib.sha1(payload).hexdigest()) != digest:
                        raise ValueError(f"payload of {row['archive']} at {place['offset']} has another digest")
                    page, refers_to = fields.get("x-page-id"), fields.get("x-refers-to-page")
                    out.append(
                        {
                            "page_id": None if page is None else int(page),
                            "url": _url(fields),
                            "payload_bytes": int(fields["x-payload-length"]),
                            "payload_digest": digest,
                            "record_type": fields["warc-type"],
                            "refers_to": None if refers_to is None else int(refers_to),
                            "payload": payload if payloads else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, _RECORD_ARROW)

    return run


_RECORD_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def ranges(index, gap=64 << 10, span=8 << 20):
    """Byte ranges that cover the index rows: at most ``gap`` unread bytes between records, about ``span`` bytes each."""
    order = Window.partitionBy("archive").orderBy("offset")
    end = F.lag(F.col("offset") + F.col("length")).over(order)
    block = (F.col("offset") / F.lit(span)).cast("long")
    fresh = F.coalesce(F.col("offset") - end > gap, F.lit(True)) | (block != F.lag(block).over(order))
    return (
        index.select("archive", "offset", "length", F.coalesce(fresh, F.lit(True)).cast("int").alias("fresh"))
        .withColumn("range", F.sum("fresh").over(order))
        .groupBy("archive", "range")
        .agg(
            F.min("offset").alias("start"),
            F.max(F.col("offset") + F.col("length")).alias("end"),
            F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"),
        )
        .select("archive", "start", (F.col("end") - F.col("start")).alias("size"), "places")
    )


def read(index, folder, payloads=True, task=16 << 20):
    """The records that the rows of ``index`` point to, payloads checked against their digests.

    Revisit records have no payload of their own; their length and digest are those of the full payload. Urls come back
    as they were given. A task reads about ``task`` bytes of archives.
    """
    held = index.agg(F.sum("length")).first()[0] or 0
    dealt = ranges(index).repartition(int(held // task) + 1, "archive", "start")
    return dealt.mapInArrow(_read_rows(folder, payloads), _RECORD)


def round_trip(pages, least_bytes=0, payloads=False):
    """Write all pages to a fresh shared folder and read every record back."""
    folder = work_folder(pages.sparkSession, "warc")
    return read(write(pages, folder, least_bytes), folder, payloads)
