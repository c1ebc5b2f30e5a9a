"""What the operators share on the driver's side: reading tables, cutting lineage (``state.cut``), naming columns."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..state import cut, remove, shared_folder

__all__ = ["cut", "fresh", "read", "remove", "row_key", "shared_folder", "ship", "unship"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """16 bytes that stand for (doc_id, text), nulls told apart from empty; rows that agree in both are interchangeable."""
    mark = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.when(F.col(text).isNull(), F.lit("\u0001")).otherwise(F.lit("\u0002")), F.coalesce(F.col(text), F.lit("")))
    return F.unhex(F.md5(mark))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ship(spark: SparkSession, value) -> Broadcast:
    """Broadcasts an object with its classes, which the workers needn't be able to import; ``unship`` it there."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unship(shipped: Broadcast):
    return pickle.loads(shipped.value)
