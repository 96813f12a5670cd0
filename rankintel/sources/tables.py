"""The analytics tables as parquet: scan by declared schema, rewrite keyed tables, append histories.

A keyed table is written to a new directory per run and never over the directory it is read from, so a lost
executor or a failed run leaves the previous version whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankintel import schemas


#: Partition column of growing tables: the run that wrote the rows.
RUN = "_run"


def moment(run_at: datetime) -> Column:
    """A run's time as a timestamp literal in the session's time zone."""
    return F.lit(run_at.isoformat(sep=" ")).cast("timestamp")


def folder_of(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def read_table(spark: SparkSession, folder: str | None, name: str) -> DataFrame:
    """One table by its declared schema; a table not written yet is empty."""
    schema = schemas.ddl(schemas.TABLES[name])
    if folder is not None:
        try:
            return spark.read.schema(schema).parquet(folder).select(*schemas.TABLES[name])
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema)


def load_tables(spark: SparkSession, root: str, views: bool = False) -> dict[str, DataFrame]:
    """All tables under a root, optionally registered as temporary views of the same names.

    Of growing tables that runs have published there (see `versions`), only what counts is read.
    """
    from rankintel.sources.versions import attempts, read_grown

    counted = attempts(spark, root)
    tables = {name: read_grown(spark, root, name, counted[name]) if name in counted else read_table(spark, folder_of(root, name), name) for name in schemas.TABLES}
    if views:
        for name, table in tables.items():
            table.createOrReplaceTempView(name)
    return tables


def _shaped(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(column).cast(kind).alias(column) for column, kind in schemas.TABLES[name].items()])


def write_keyed(df: DataFrame, root: str, name: str) -> DataFrame:
    """Write one version of a keyed table and return it read back, which also ends its lineage."""
    _shaped(df, name).write.mode("overwrite").parquet(folder_of(root, name))
    return read_table(df.sparkSession, folder_of(root, name), name)


def write_staged(df: DataFrame, root: str, name: str) -> DataFrame:
    """Keep an intermediate result of a run as parquet, so that a lost executor never repeats its work."""
    path = folder_of(root, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside are deleted after each write; else they stay until the driver's next clean-up."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def append_history(df: DataFrame, root: str, name: str, stamp: str = "scraped_at", run_at: datetime | None = None) -> DataFrame:
    """Append rows to a growing table, by run date and run, and publish them; returns what counts of the whole table.

    With `run_at` the rows are the run's, and a repeated run replaces them whole, also where it has no rows. Without,
    each call is a run of its own. The rows count once all are written (see `versions`): a call that breaks off changes
    nothing that readers see. `df` may read the table's earlier rows; a run that is to see what it saw at first leaves
    out its own (`before_run`).
    """
    from rankintel.sources.versions import append_attempt, attempts, new_attempt, publish, read_grown

    spark, run_at = df.sparkSession, run_at or datetime.now()
    attempt = new_attempt(run_at)
    append_attempt(df, root, name, attempt, stamp)
    publish(spark, root, run_at, attempt, {}, {name: read_grown(spark, root, name, {"": attempt}).count()})
    return read_grown(spark, root, name, attempts(spark, root)[name])


def before_run(history: DataFrame, run_at: datetime, stamp: str = "scraped_at") -> DataFrame:
    """The rows of a growing table that are not this run's, so that a repeated run sees what the first one saw."""
    return history.where(~F.col(stamp).eqNullSafe(moment(run_at)))
