"""Content that is stored in numbered blocks, compressed or not."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def looks_compressed(data: bytes) -> bool:
    """Whether the first two bytes are a zlib header: method 8, and a check value that fits."""
    return len(data) > 1 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0


def restore(data: bytes, declared: int, permutation: bytes | None = None) -> bytes | None:
    """The content if it has the declared length, inflated if it looks compressed, after undoing a byte permutation; None otherwise."""
    if permutation:
        data = data.translate(permutation)
    if looks_compressed(data):
        try:
            inflated = zlib.decompress(data)
        except zlib.error:
            inflated = None
        if inflated is not None and len(inflated) == declared:
            return inflated
    return data if len(data) == declared else None


def reassemble(blocks: DataFrame, declared: DataFrame, ident: str = "id", number: str = "block", data: str = "data", length: str = "length", permutation: bytes | None = None) -> DataFrame:
    """(id, content): each document's blocks in their order, joined and restored; null where the length doesn't fit."""
    joined = blocks.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col(data).alias("d")))).alias("b"))
    whole = joined.join(declared.select(ident, F.col(length).cast("bigint").alias("_length")), ident).select(ident, F.concat(F.array_join(F.transform("b", lambda x: F.hex(x["d"])), "")).alias("hex"), "_length")
    raw = whole.select(F.col(ident).cast("string").alias("id"), F.unhex("hex").alias("raw"), "_length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if r is None else restore(r, n, permutation) for r, n in zip(b.column("raw").to_pylist(), b.column("_length").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], names=["id", "content"])

    return raw.mapInArrow(run, "id string, content binary")
