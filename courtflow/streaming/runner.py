"""Feeding and draining streams: file source in, written table out.

A stream is drained with ``availableNow`` and picked up again from its checkpoint when
more files have arrived, so state, watermark and progress survive a restart.
"""

import os

from pyspark.sql import functions as F

from ..session import staged, work_folder

EPOCH = "2024-01-01 00:00:00"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_event_time(rows):
    """One frame is one second of event time."""
    start = F.unix_timestamp(F.lit(EPOCH).cast("timestamp"))
    return rows.withColumn("event_time", F.timestamp_seconds(start + F.col("frame")))


def frame_of(ts):
    start = F.unix_timestamp(F.lit(EPOCH).cast("timestamp"))
    return (F.unix_timestamp(ts) - start).cast("bigint")


_START = 1_704_067_200_000  # EPOCH in milliseconds


def time_of(frame, mark=None):
    """Event time of a frame in milliseconds; with ``mark``, the last frame at that time or before."""
    return _START + 1000 * frame if mark is None else (mark - _START) // 1000


def drain(rows, build, name, closing, parts=2, disorder=40, watch=None, most=None):
    """Stream ``rows`` in ``parts`` stretches of frames through ``build``; returns the output.

    With ``most`` there are as many more stretches as keep each at about that many rows: what a keyed step holds of
    one micro-batch does not grow with the table then.

    Rows arrive up to ``disorder`` frames late, out of order and across the stretches; the watermark waits
    for that long. ``closing`` rows, far behind all others, arrive last and let the watermark pass.
    ``build`` turns the streaming input into the streaming output; ``watch`` sees each finished query.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    base = work_folder(spark, name)
    into, out, state = (os.path.join(base, p) for p in ("in", "out", "state"))
    if most is not None:
        rows = staged(rows, f"{name}-rows")
        parts = max(parts, -(-rows.count() // most))
    top = rows.agg(F.max("frame")).first()[0]
    timed = with_event_time(rows)
    schema = timed.schema

    def run(new):
        new.write.mode("append").parquet(into)
        source = spark.readStream.schema(schema).parquet(into).withWatermark("event_time", f"{disorder} seconds")
        query = (
            build(source)
            .writeStream.outputMode("append")
            .format("parquet")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start(out)
        )
        query.awaitTermination()
        if watch is not None:
            watch(query)

    arrival = F.col("frame") + F.pmod(F.xxhash64(*rows.columns), F.lit(disorder))
    for k in range(parts):
        lo, hi = ((top + disorder) * n // parts for n in (k, k + 1))
        run(timed.where((arrival >= lo) & (arrival < hi)))
    run(with_event_time(closing).select(*schema.names))
    return spark.read.parquet(out)
