"""Mixing sources to target weights by capped water-filling.

A source with ``size`` characters gives at most ``max_epochs * size``. Below that, all get in proportion to their target
weights; what a clamped source can't give goes to the others in proportion, until nothing changes. The end of that
process is a water level: sorted by cap over weight, the sources up to some place are clamped, and one running sum
finds the place. Each document is then repeated ``floor(rate)`` times, and once more with the rate's fraction as probability,
drawn from a seeded digest of its id.

Sizes and allocations are as many rows as there are sources; only they are sorted in one place. Documents are read, never shuffled,
while the rates are few enough to be broadcast (``BROADCAST_SOURCES``, counted); beyond that it is an ordinary join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, fresh

#: Target weight by source; any other source has ``OTHER_WEIGHT``.
TARGETS = {"src1": 6.0, "src2": 3.0, "src3": 0.5}
OTHER_WEIGHT, MAX_EPOCHS, SEED = 1.0, 3, 17
BROADCAST_SOURCES = 100_000


def allocate(sizes: DataFrame, targets: dict[str, float] | None = None, other_weight: float = OTHER_WEIGHT, max_epochs: float = MAX_EPOCHS, budget: float | None = None) -> DataFrame:
    """(source, size, rate) from (source, size): how many times a source's documents are used. Sources without size or weight have rate 0.

    The budget in characters is by default the size of all sources; if the sources can't give it, all with a weight are clamped.
    """
    weights = {k: v for k, v in (TARGETS if targets is None else targets).items()}
    if any(v < 0 for v in [*weights.values(), other_weight, max_epochs]):
        raise ValueError("weights and epochs can't be negative")
    weight = F.lit(float(other_weight))
    for name, value in weights.items():
        weight = F.when(F.col("source") == name, float(value)).otherwise(weight)
    total = F.coalesce(F.sum("size").over(Window.partitionBy(F.lit(1))), F.lit(0)) if budget is None else F.lit(float(budget))
    usable = sizes.withColumn("budget", total).withColumn("weight", weight).where("size > 0 and weight > 0").withColumn("cap_ratio", F.lit(float(max_epochs)) * F.col("size") / F.col("weight"))
    order = Window.orderBy("cap_ratio", F.col("source").asc_nulls_first())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        usable.withColumn("taken", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("left", F.sum("weight").over(after))
        .withColumn("level", (F.col("budget") - F.lit(float(max_epochs)) * F.col("taken")) / F.col("left"))
        .withColumn("clamped", F.col("level") >= F.col("cap_ratio"))
    )
    level = F.max(F.when(~F.col("clamped"), F.col("level"))).over(Window.partitionBy(F.lit(1)))
    rates = levels.withColumn("water", level).select("source", F.when(F.col("clamped"), F.lit(float(max_epochs))).otherwise(F.col("water") * F.col("weight") / F.col("size")).alias("rate"))
    named = rates.withColumnRenamed("source", "_source")
    return sizes.join(named, sizes.source.eqNullSafe(F.col("_source")), "left").select("source", "size", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def repeated(documents: DataFrame, copy: str, seed: int = SEED, **options) -> DataFrame:
    """``documents`` with the column ``copy``: a row for each repetition, numbered from 1."""
    source, rate = fresh(documents, "_mix_source"), fresh(documents, "_mix_rate")
    sizes = documents.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0))).cast("bigint").alias("size"))
    rates = cut(allocate(cut(sizes), **options).select(F.col("source").alias(source), F.col("rate").alias(rate)))
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = documents.join(F.broadcast(rates) if few else rates, documents["source"].cast("string").eqNullSafe(F.col(source)))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(documents["doc_id"].cast("string"), documents["text"].cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    whole = F.floor(rate)
    times = (whole + F.when(draw < F.col(rate) - whole, 1).otherwise(0)).cast("int")
    copies = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    return joined.select(*[documents[c] for c in documents.columns], F.explode(copies).alias(copy))


def mix(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, source, copy): a row for each time that a document is used.

    Sizes are characters of text; a null or empty text has none, but is drawn at its source's rate. A null source is a source of its own, with the weight of others.
    A source without any character has rate 0. The draw depends on seed and doc_id alone (on the text where doc_id is null), so repeated rows have equal numbers of copies.
    Empty documents give no rows. Other columns are ignored.
    """
    copy = fresh(documents, "_copy")
    return repeated(documents, copy, **options).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col(copy).cast("bigint").alias("copy"))


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with each row as often as ``mix`` uses it: not at all, once or several times.

    Nulls, empty texts and repeated rows are treated as by ``mix``; columns stay, whatever their names; empty documents give no rows.
    """
    return repeated(documents, fresh(documents, "_copy"), **options).select(*documents.columns)
