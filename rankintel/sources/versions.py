"""Published runs: what a run has written counts only once its manifest is there.

Every attempt of a run writes into places of its own: new folders for keyed tables, partitions of its own in growing
ones. The manifest names them all and is written last, as one file. Readers start from the manifests, so a run that
broke off between any two writes leaves what was published before, and a repeated run replaces the earlier attempt
whole, also where it has no rows at all. Runs of one root are expected one after the other.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankintel import schemas
from rankintel.sources.tables import RUN, _shaped, folder_of, read_table

MANIFESTS = "published"
SHAPE = "number long, run string, attempt string, name string, folder string, n_rows long"


def run_name(run_at: datetime) -> str:
    return run_at.strftime("%Y%m%dT%H%M%S.%f")


def new_attempt(run_at: datetime) -> str:
    """The name of one more attempt of a run."""
    return f"{run_name(run_at)}-{uuid.uuid4().hex}"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """A row for each table that an attempt has published: keyed ones with their folder, growing ones without."""
    try:
        return spark.read.schema(SHAPE).parquet(folder_of(root, MANIFESTS))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SHAPE)


def attempts(spark: SparkSession, root: str) -> dict[str, dict[str, str]]:
    """For each growing table, the attempt that counts for each run: the last that was published with the table."""
    newest = manifests(spark, root).where("folder IS NULL").groupBy("name", "run").agg(F.max_by("attempt", "number").alias("attempt"))
    found: dict[str, dict[str, str]] = {}
    for row in newest.collect():  # a row for each table and run
        found.setdefault(row["name"], {})[row["run"]] = row["attempt"]
    return found


def published_folders(spark: SparkSession, root: str, before: datetime | None = None) -> dict[str, str]:
    """Where the keyed tables of the run published last are: what `run_batch` takes as `folders`.

    With `before`, of the runs before that time: a run that is repeated starts from what it started from at first.
    """
    rows = manifests(spark, root).where("folder IS NOT NULL")
    if before is not None:
        rows = rows.where(F.col("run") < run_name(before))
    newest = rows.groupBy("name").agg(F.max_by("folder", "number").alias("folder"))
    return {row["name"]: row["folder"] for row in newest.collect()}  # a row for each table


def read_grown(spark: SparkSession, root: str, name: str, counted: dict[str, str]) -> DataFrame:
    """The rows of a growing table that the given attempts (by run) wrote; others' partitions are not read."""
    schema = f"{schemas.ddl(schemas.TABLES[name])}, {RUN} string"
    if counted:
        try:
            whole = spark.read.schema(schema).parquet(folder_of(root, name))
            return whole.where(F.col(RUN).isin(sorted(counted.values()))).select(*schemas.TABLES[name])
        except AnalysisException as error:
            # No attempt has had a row yet.
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return read_table(spark, None, name)


def append_attempt(df: DataFrame, root: str, name: str, attempt: str, stamp: str = "scraped_at") -> None:
    """Write an attempt's rows of a growing table, by run date; they count once the attempt is published."""
    dated = df if "run_date" in df.columns else df.withColumn("run_date", F.to_date(stamp))
    _shaped(dated, name).withColumn(RUN, F.lit(attempt)).write.mode("append").partitionBy("run_date", RUN).parquet(folder_of(root, name))


def publish(spark: SparkSession, root: str, run_at: datetime, attempt: str, folders: dict[str, str], grown: dict[str, int]) -> None:
    """Make an attempt count: its keyed tables' folders and, by growing table, how many rows it wrote."""
    number = 1 + (manifests(spark, root).agg(F.max("number")).first()[0] or 0)
    rows = [(number, run_name(run_at), attempt, name, folder, None) for name, folder in folders.items()]
    rows += [(number, run_name(run_at), attempt, name, None, n) for name, n in grown.items()]
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(folder_of(root, MANIFESTS))
