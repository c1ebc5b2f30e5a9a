"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of each text: ``h = (h << 1) + gear[byte]`` in 32 bits, so it depends on the last
32 bytes only. A chunk ends where the top bits of the hash are zero, at the border of a character, unless another such place lies
less than ``least`` bytes before it; a gap of more than ``most`` bytes is split at multiples of ``most``. Every one of these
rules looks at the bytes before a place and at nothing else, so an insertion moves chunks without changing
those that start more than a chunk away from it.

Chunks with equal 128-bit digests are copies. The first one, by (doc_id, row, place), stays; the others, joined where they
touch, are the repeats. A run of repeats counts from ``min_chars`` characters on.

Texts are read in slices of about 2 MB. A chunk that isn't the first of its digest in its slice is a repeat wherever the others are, so only
the slices' first ones meet by digest: one row of 40 bytes for each slice, not for each text, however often a chunk occurs. A running window over the sorted
partition finds the first of these; no group is held in memory. The others go through the same exchange under keys of their own, evenly spread, and get
their digest's first occurrence from their slice's first one, when the repeats of a slice come together to be joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import slices, table, utf8

BITS, LEAST, MOST, MIN_CHARS = 3, 10, 64, 100

_GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPAN = 32


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling: windows of 1, 2, 4, ... 32 bytes."""
    h = _GEAR[data]
    n = 1
    while n < _SPAN:
        longer = h.copy()
        longer[n:] += h[:-n] << np.uint32(n) if len(h) > n else 0
        h = longer
        n *= 2
    return h


def chunk_ends(data: np.ndarray, offs: np.ndarray, bits: int, least: int, most: int) -> np.ndarray:
    """End of each chunk; every text's end is one. The hash has bits of 32 bytes only in its top bits, so those are tested."""
    if not len(data):
        return np.zeros(0, np.int64)
    starts = offs[:-1][np.diff(offs) > 0]
    at = np.flatnonzero(gear(data) >> np.uint32(32 - bits) == 0) + 1
    at = at[at < len(data)]
    at = at[(data[at] & 0xC0) != 0x80]
    own = np.searchsorted(starts, at, "right") - 1
    ok = (at - starts[own] >= _SPAN) if len(at) else np.zeros(0, bool)
    at = at[ok]
    if len(at):
        at = at[np.concatenate(([True], np.diff(at) >= least))]
    ends = np.unique(np.concatenate((at, offs[1:][np.diff(offs) > 0])))
    begins = np.concatenate(([0], ends[:-1]))
    long = np.flatnonzero(ends - begins > most)
    if len(long):
        pieces = (ends[long] - begins[long] - 1) // most
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces) + 1
        cut = np.repeat(begins[long], pieces) + step * most
        for _ in range(3):
            cut = cut - ((data[cut] & 0xC0) == 0x80)
        ends = np.unique(np.concatenate((ends, cut)))
    return ends


def leaders(digests: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each chunk the number of the first one with its digest; ``rank`` orders the chunks."""
    order = np.lexsort((rank, digests[:, 1], digests[:, 0]))
    d = digests[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]).any(axis=1)))
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _chunks(bits: int, least: int, most: int):
    """(doc_id, slice, at, mark, d1, d2) of each chunk: ``slice`` is the number of its slice's first row; ``at`` has the text's number in the slice and the chunk's start,
    ``mark`` the leader's number and the chunk's length, in 32 bits each. Where the chunk isn't its own leader, -1 - number stands there, and (d1, d2) are the leader's doc_id, 0 for null, and whether it is null."""
    schema = pa.schema([("doc_id", pa.int64()), ("slice", pa.int64()), ("at", pa.int64()), ("mark", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offs = utf8(part.column("text"))
                ends = chunk_ends(data, offs, bits, least, most)
                if not len(ends):
                    continue
                begins = np.concatenate(([0], ends[:-1]))
                raw = memoryview(data.tobytes())
                digest = xxhash.xxh3_128_digest
                digests = np.frombuffer(b"".join([digest(raw[s:e]) for s, e in zip(begins.tolist(), ends.tolist())]), np.int64).reshape(-1, 2)
                owner = np.searchsorted(offs, begins, "right") - 1
                doc = part.column("doc_id")
                none = np.asarray(doc.is_null())
                ids = pc.fill_null(doc, 0).to_numpy(zero_copy_only=False)
                place = np.empty(part.num_rows, np.int64)
                place[np.lexsort((np.arange(part.num_rows), ids, none))] = np.arange(part.num_rows)
                lead = leaders(digests, place[owner] * (len(begins) + 1) + np.arange(len(begins)))
                own = lead == np.arange(len(lead))
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                at = (owner << 32) | (chars[begins] - chars[offs[owner]])
                mark = (np.where(own, lead, -1 - lead) << 32) | (chars[ends] - chars[begins])
                keys = [np.where(own, digests[:, 0], ids[owner[lead]]), np.where(own, digests[:, 1], none[owner[lead]])]
                yield table(schema, doc.take(pa.array(owner)), np.full(len(at), part.column("row")[0].as_py()), at, mark, *keys)

    return run


def repeats(documents: DataFrame, min_chars: int = MIN_CHARS, bits: int = BITS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(doc_id, start, end, first_doc_id): each passage of at least ``min_chars`` characters whose chunks all occur
    before, in a text with a lower doc_id or earlier in the same text. start and end count characters from 0, end
    excluded; first_doc_id is where the passage's first chunk occurs first.

    A shared passage is found but for what is lost at its two borders: at the left the 32 bytes of the hash, ``least`` and a chunk, at the right
    a chunk. Chunks have ``2 ** bits / (1 - 2 ** -bits) ** (least - 1)`` bytes on average (27; 26 as measured) and ``most`` at most.
    Null ids come last. Of repeated rows (or several texts with one id) the first has no repeat, the others are repeats of it.
    Null and empty texts have no chunk. Texts of any length are read whole. Empty tables give no rows. Other columns are ignored.
    """
    numbered = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    chunks = numbered.mapInArrow(_chunks(bits, least, most), "doc_id bigint, slice bigint, at bigint, mark bigint, d1 bigint, d2 bigint")
    led = F.col("mark") < 0
    order = Window.partitionBy("d1", "d2", led).orderBy(F.col("doc_id").asc_nulls_last(), "slice", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct("doc_id", "slice", "at")
    first = F.when(led, F.when(F.col("d2") == 0, F.col("d1"))).otherwise(F.col("first.doc_id"))
    later = chunks.withColumn("first", F.first(place).over(order)).where(led | ~F.col("first").eqNullSafe(place)).select("doc_id", "slice", "at", "mark", first.alias("first_doc_id"))
    high, low = lambda c: F.shiftright(c, 32), lambda c: F.col(c).bitwiseAND((1 << 32) - 1)
    marked = later.repartition("slice").select("doc_id", "slice", high("at").alias("text"), low("at").alias("start"), low("mark").alias("length"), (high("mark") < 0).alias("led"), F.when(high("mark") < 0, -1 - high("mark")).otherwise(high("mark")).alias("lead"), "first_doc_id")
    # a leader that is a repeat itself says where the digest's first chunk is
    its = F.max(F.when(~F.col("led"), F.struct(F.lit(1).alias("n"), F.col("first_doc_id").alias("doc")))).over(Window.partitionBy("slice", "lead"))
    known = marked.withColumn("its", its).withColumn("first_doc_id", F.when(F.col("its").isNull(), F.col("first_doc_id")).otherwise(F.col("its.doc")))
    in_text = Window.partitionBy("slice", "text").orderBy("start")
    run = F.sum(F.when(F.col("start") == F.lag(F.col("start") + F.col("length")).over(in_text), 0).otherwise(1)).over(in_text)
    return (
        known.withColumn("run", run)
        .groupBy("slice", "text", "run")
        .agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.min_by("first_doc_id", "start").alias("first_doc_id"))
        .where(F.col("end") - F.col("start") >= min_chars)
        .select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "first_doc_id")
    )
