"""Session settings the operators rely on, for applications that have no session of their own."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Page rows are large; keep Arrow batches to a few dozen megabytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts go to Python tasks in batches of at most `BATCH_ROWS` from now on, for the session that asks.

    Spark counts rows, not bytes, and its default of 10,000 holds several buffers of tens of megabytes for each core in
    the executor and in its Python workers. A smaller setting stays.
    """
    now = int(spark.conf.get(BATCH_SETTING))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder

