"""Writing what Python makes of whole texts, with few texts in an Arrow batch."""

from contextlib import contextmanager

from courtflow.session import staged

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def few_rows(spark, rows=1000):
    """Arrow batches of at most ``rows`` rows for what is run inside; the setting is put back afterwards."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def staged_texts(df, name):
    """``staged`` for a pass over texts: a batch holds megabytes in the JVM and in the worker, so it gets fewer rows."""
    with few_rows(df.sparkSession):
        return staged(df, name)
