"""Benchmark decontamination by winnowing.

A text's tokens are its words in lower case. Of every ``window`` successive ``k``-grams the one with the least hash
is kept as a fingerprint, on both sides, so two texts that share ``k + window - 1`` tokens in a row share
a fingerprint there. Shared fingerprints are extended over the tokens on either side; what is reported are all maximal
common spans of at least ``k + window - 1`` tokens, none missed.

The corpus is read once, and its texts aren't shuffled to find spans. A benchmark of up to ``LOCAL_TOKENS`` tokens (counted first) goes to all
tasks, which find, extend and decide where they read. Of a larger one they get a Bloom filter of its fingerprints, with ``FILTER_BITS`` bits for each of them up to
``MOST_FILTER_BITS`` in all. Up to 8 million fingerprints (some 29 million words) it lets through one in 200 000 of those that the benchmark doesn't have, beyond that more, but never drops
one that matters. The tokens of texts with a fingerprint that is left are carried on; their fingerprints are joined with the benchmark's, which is exact, and extended after that. Both ways give the same spans.
To drop documents takes no shuffle in the first way and an anti-join in the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import hash_ranges, list_array, lowered, mix64, ngrams, slices, table, words
from .shared import cut, fresh, row_key, ship, unship

K, WINDOW = 8, 6
LOCAL_TOKENS = 4_000_000
FILTER_BITS, MOST_FILTER_BITS, PROBES = 32, 1 << 28, 8

_SPANS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_tokens", pa.int64()), ("row_key", pa.binary())])


def winnow(hashes: np.ndarray, owner: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Token number and hash of each fingerprint. A text with fewer than ``window`` k-grams keeps them all."""
    grams = ngrams(hashes, k)
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64), grams
    whole = owner[:n] == owner[k - 1 : k - 1 + n]
    picked = np.zeros(n, bool)
    if n >= window:
        m = n - window + 1
        best, at = grams[:m].copy(), np.arange(m)
        for j in range(1, window):
            less = grams[j : j + m] <= best
            best[less] = grams[j : j + m][less]
            at[less] = np.flatnonzero(less) + j
        inside = owner[:m] == owner[window + k - 2 : window + k - 2 + m]
        picked[at[inside]] = True
    counts = np.bincount(owner[:n][whole], minlength=int(owner[-1]) + 1)
    few = (counts > 0) & (counts < window)
    picked |= whole & few[owner[:n]]
    at = np.flatnonzero(picked & whole)
    return at, grams[at]


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and owner of each token; number of the first token of each text."""
    data, offs = lowered(part.column("text"))
    begin, end, owner = words(data, offs)
    return hash_ranges(data, begin, end), owner, np.searchsorted(owner, np.arange(part.num_rows + 1))


def _benchmark(k: int, window: int):
    schema = pa.schema([("item_id", pa.int64()), ("tokens", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("fp", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, owner, first = _tokens(part)
                at, fp = winnow(hashes, owner, k, window)
                of = owner[at]
                counts = np.bincount(of, minlength=part.num_rows)
                yield table(schema, part.column("item_id"), list_array(hashes.view(np.int64), np.diff(first), pa.int64()), list_array((at - first[of]).astype(np.int32), counts, pa.int32()), list_array(fp.view(np.int64), counts, pa.int64()))

    return run


def _slots(fp: np.ndarray, mask: int) -> np.ndarray:
    """(fingerprints, probes): the bits of the filter that stand for each fingerprint."""
    fp = fp.view(np.uint64)
    return (fp[:, None] + np.arange(PROBES, dtype=np.uint64)[None] * (mix64(fp) | np.uint64(1))[:, None]) & np.uint64(mask)


def _words_of_filter(mask: int):
    """(word, bits) that the fingerprints set in the filter's 64-bit words."""
    schema = pa.schema([("word", pa.int64()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            if len(fp):
                slot = np.sort(_slots(fp, mask).ravel())
                word = (slot >> np.uint64(6)).astype(np.int64)
                first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                yield table(schema, word[first], np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), first).view(np.int64))

    return run


def known(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Which fingerprints the filter lets through."""
    slot = _slots(fp, len(bits) * 64 - 1)
    return ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1).all(axis=1)


def _filter(bench: DataFrame, filter_bits: int, most_bits: int) -> np.ndarray:
    """The Bloom filter of the benchmark's fingerprints as 64-bit words; at most ``most_bits``, which also bounds what the driver gets."""
    prints = bench.select(F.explode("fp").alias("fp"))
    wanted = max(64, prints.count() * filter_bits)
    size = min(most_bits, 1 << (wanted - 1).bit_length())
    bits = np.zeros(size // 64, np.uint64)
    got = prints.mapInArrow(_words_of_filter(size - 1), "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return bits


def _corpus(k: int, window: int, shared):
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.binary()), ("tokens", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("fp", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            for part in slices(batch):
                hashes, owner, first = _tokens(part)
                at, fp = winnow(hashes, owner, k, window)
                passed = known(bits, fp)
                at, fp = at[passed], fp[passed]
                of = owner[at]
                rows, counts = np.unique(of, return_counts=True)
                if not len(rows):
                    continue
                within = np.zeros(part.num_rows, bool)
                within[rows] = True
                kept = part.take(pa.array(rows))
                yield table(schema, kept.column("doc_id"), kept.column("row_key"), list_array(hashes[within[owner]].view(np.int64), np.diff(first)[rows], pa.int64()), list_array((at - first[of]).astype(np.int32), counts, pa.int32()), list_array(fp.view(np.int64), counts, pa.int64()))

    return run


class Matcher:
    """The benchmark as arrays: its tokens, and its fingerprints in order with their items and places."""

    def __init__(self, bench: pa.Table, k: int, window: int) -> None:
        self.k, self.window = k, window
        self.ids = bench.column("item_id").to_pylist()
        flat = lambda name, kind: np.concatenate([np.zeros(0, kind), *(x.values.to_numpy(zero_copy_only=False).astype(kind) for x in bench.column(name) if x.values is not None)])
        size = lambda name: np.array([len(x) for x in bench.column(name)], np.int64)
        self.tokens, counts = flat("tokens", np.int64), size("tokens")
        self.end = np.cumsum(counts)
        self.begin = self.end - counts
        fp, at, item = flat("fp", np.int64), flat("at", np.int64), np.repeat(np.arange(len(self.ids)), size("fp"))
        order = np.argsort(fp, kind="stable")
        self.fp, self.at, self.item = fp[order], at[order], item[order]

    def spans(self, part: pa.RecordBatch) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start in the row, start in the item, tokens), starts in tokens."""
        hashes, owner, first = _tokens(part)
        tokens = hashes.view(np.int64)
        at, fp = winnow(hashes, owner, self.k, self.window)
        fp = fp.view(np.int64)
        low, high = np.searchsorted(self.fp, fp, "left"), np.searchsorted(self.fp, fp, "right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return []
        times = (high - low)[hit]
        where = np.repeat(at[hit], times)
        index = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[hit], times)
        row = owner[where]
        lines = np.unique(np.stack((row, self.item[index], where - first[row] - self.at[index]), axis=1), axis=0)
        out = []
        for r, i, shift in lines.tolist():
            a, b = tokens[first[r] : first[r + 1]], self.tokens[self.begin[i] : self.end[i]]
            out += [(r, i, *x) for x in aligned(a, b, shift, self.k + self.window - 1)]
        return out


def aligned(a: np.ndarray, b: np.ndarray, shift: int, least: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the runs of at least ``least`` equal tokens with ``b`` moved by ``shift``."""
    low, high = max(0, -shift), min(len(b), len(a) - shift)
    same = np.concatenate(([0], (a[low + shift : high + shift] == b[low:high]).astype(np.int8), [0]))
    turn = np.flatnonzero(np.diff(same))
    return [(s + low + shift, s + low, e - s) for s, e in zip(turn[::2].tolist(), turn[1::2].tolist()) if e - s >= least]


def _extend(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            tokens, item_tokens = batch.column("tokens"), batch.column("item_tokens")
            columns = [batch.column(c).to_pylist() for c in ("row", "doc_id", "item_id", "shift", "row_key")]
            for i, (row, doc, item, shift, key) in enumerate(zip(*columns)):
                a, b = tokens[i].values.to_numpy(zero_copy_only=False), item_tokens[i].values.to_numpy(zero_copy_only=False)
                out += [(row, doc, item, *x, key) for x in aligned(a, b, shift, least)]
            if out:
                yield table(_SPANS, *zip(*out))

    return run


def _prepared(benchmark: DataFrame, k: int, window: int) -> DataFrame:
    """Tokens and fingerprints of each item."""
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    return cut(items.mapInArrow(_benchmark(k, window), "item_id bigint, tokens array<bigint>, at array<int>, fp array<bigint>").withColumn("item", F.monotonically_increasing_id()))


def _matcher(bench: DataFrame, k: int, window: int, most: int):
    """A broadcast ``Matcher``, or None if the benchmark has more than ``most`` tokens."""
    if (bench.agg(F.sum(F.size("tokens"))).first()[0] or 0) > most:
        return None
    return ship(bench.sparkSession, Matcher(bench.select("item_id", "tokens", "at", "fp").toArrow(), k, window))


def _joined(documents: DataFrame, bench: DataFrame, k: int, window: int, filter_bits: int, most_bits: int) -> DataFrame:
    """Spans by joining fingerprints, for a benchmark of any size."""
    bits = documents.sparkSession.sparkContext.broadcast(_filter(bench, filter_bits, most_bits).tobytes())
    hits = cut(
        documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"), row_key().alias("row_key"))
        .mapInArrow(_corpus(k, window, bits), "doc_id bigint, row_key binary, tokens array<bigint>, at array<int>, fp array<bigint>")
        .withColumn("row", F.monotonically_increasing_id())
    )
    prints = bench.select("item", F.explode(F.arrays_zip("at", "fp")).alias("x")).select("item", F.col("x.at").alias("item_at"), F.col("x.fp").alias("fp"))
    shifts = (
        hits.select("row", F.explode(F.arrays_zip("at", "fp")).alias("x"))
        .select("row", F.col("x.at").alias("at"), F.col("x.fp").alias("fp"))
        .join(prints, "fp")
        .select("row", "item", (F.col("at") - F.col("item_at")).alias("shift"))
        .distinct()
    )
    pairs = shifts.join(bench.select("item", "item_id", F.col("tokens").alias("item_tokens")), "item").join(hits.select("row", "doc_id", "row_key", "tokens"), "row")
    return pairs.select("row", "doc_id", "item_id", "shift", "row_key", "tokens", "item_tokens").mapInArrow(_extend(k + window - 1), "row bigint, doc_id bigint, item_id bigint, doc_start bigint, item_start bigint, n_tokens bigint, row_key binary")


def find_spans(documents: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, local_tokens: int = LOCAL_TOKENS, filter_bits: int = FILTER_BITS, most_bits: int = MOST_FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_tokens): every maximal run of at least ``k + window - 1`` tokens
    that a document shares with a benchmark item; starts count tokens from 0.

    Null and empty texts, and texts or items with fewer tokens than that, have no span. Null ids are carried as
    they are. Repeated rows on either side give repeated spans; a passage that occurs several times gives one
    span for each place. Empty tables give no rows. Other columns, whatever their names, are ignored.
    """
    bench = _prepared(benchmark, k, window)
    shared = _matcher(bench, k, window, local_tokens)
    if shared is None:
        return _joined(documents, bench, k, window, filter_bits, most_bits).select("doc_id", "item_id", "doc_start", "item_start", "n_tokens")
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "doc_start", "item_start", "n_tokens")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = unship(shared)
        for batch in batches:
            for part in slices(batch):
                found = matcher.spans(part)
                if found:
                    row, item, *numbers = zip(*found)
                    yield table(schema, part.column("doc_id").take(pa.array(row)), [matcher.ids[i] for i in item], *numbers)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, item_id bigint, doc_start bigint, item_start bigint, n_tokens bigint")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, local_tokens: int = LOCAL_TOKENS, filter_bits: int = FILTER_BITS, most_bits: int = MOST_FILTER_BITS) -> DataFrame:
    """``documents`` without those that have a span of ``find_spans``; columns, order of columns and repeated rows stay.

    Null and empty texts and texts shorter than a span stay, null ids are like any other. An empty benchmark takes nothing away, empty documents give no rows; other columns, whatever their names, are passed on.
    """
    bench = _prepared(benchmark, k, window)
    shared = _matcher(bench, k, window, local_tokens)
    if shared is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = unship(shared)
            for batch in batches:
                for part in slices(batch):
                    clean = np.ones(part.num_rows, bool)
                    clean[[row for row, *_ in matcher.spans(part)]] = False
                    yield part.filter(pa.array(clean))

        return documents.mapInArrow(run, documents.schema)
    key, bad_key = fresh(documents, "_row_key"), fresh(documents, "_bad_key")
    bad = cut(_joined(documents, bench, k, window, filter_bits, most_bits).select(F.col("row_key").alias(bad_key)).distinct())
    return documents.withColumn(key, row_key()).join(bad, F.col(key) == F.col(bad_key), "left_anti").select(*documents.columns)
