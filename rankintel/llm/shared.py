"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from rankintel.session import BATCH_ROWS, BATCH_SETTING, bounded_batches

__all__ = ["BATCH_ROWS", "BATCH_SETTING", "bounded_batches", "shared_folder", "sliced", "stored"]

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a local session without one (tests) gets a temporary folder."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="rankintel-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as parquet in the shared folder and read back: its lineage ends here.

    A lost executor takes none of it along, and what is read several times is computed once. The files stay until
    the shared folder is emptied, since the result may be read at any later time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rankintel/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts in `column` have at most `most` bytes together (a longer text is alone)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end
