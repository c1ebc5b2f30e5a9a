"""Toxicity: a counterfactually regularised linear classifier.

A document's score is a sigmoid over the evidence of its distinct words (hashed features, each counted once a document). The weights minimise logistic loss plus an L1 term, so that neutral words have a weight
of exactly zero and long clean texts gather no score by length, plus ``counterfactual`` times the squared change of the
score when the identity terms of a labelled sentence are swapped for those of other groups. A mention of
a group then moves the score as little as the mention of another one.

The model is fitted on the driver, on at most ``max_labelled`` labelled rows, those with the least digests of their
ids: a bounded sample that is the same in every run. A task turns the sample into features; its texts don't get to the driver. Scoring reads every document once, whole, in Arrow batches, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import hash_ranges, list_array, lowered, slices, table, words

MAX_LABELLED, FEATURE_BITS, COUNTERFACTUAL, L1 = 10_000, 18, 1.0, 5e-4

#: Groups that differ in nothing but whom they name; each tuple is one kind, its members stand for each other.
IDENTITY_TERMS = (
    ("men", "women", "girls", "boys"), ("man", "woman", "girl", "boy"), ("male", "female"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees", "foreigners"), ("old", "young"), ("disabled", "blind", "deaf"),
    ("hommes", "femmes"), ("homme", "femme"), ("chrétiens", "musulmans", "juifs"), ("männer", "frauen"), ("mann", "frau"),
    ("christen", "muslime", "juden"), ("hombres", "mujeres"), ("hombre", "mujer"), ("cristianos", "musulmanes", "judíos"),
)


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and feature number of each distinct feature of each text."""
    data, offs = lowered(column)
    begin, end, owner = words(data, offs)
    key = (owner.astype(np.uint64) << np.uint64(32)) | (hash_ranges(data, begin, end) >> np.uint64(64 - bits))
    key = np.sort(key)
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def swapped(text: str, terms=IDENTITY_TERMS) -> list[str]:
    """The text with its identity terms moved on by one place in their kinds, by two, ...: a variant for each other member; none if it names no group."""
    place = {t: (kind, i) for kind in terms for i, t in enumerate(kind)}
    tokens = text.split()
    at = [(n, place[w.strip(".,;:!?\"'()").lower()]) for n, w in enumerate(tokens) if w.strip(".,;:!?\"'()").lower() in place]
    out = []
    for shift in range(1, max((len(kind) for _, (kind, _) in at), default=1)):
        new = list(tokens)
        for n, (kind, i) in at:
            core = new[n].strip(".,;:!?\"'()")
            new[n] = new[n].replace(core, kind[(i + shift) % len(kind)])
        out.append(" ".join(new))
    return out


def sentences(text: str, terms=IDENTITY_TERMS) -> list[str]:
    """Sentences of a text that name a group."""
    named = {t for kind in terms for t in kind}
    parts = text.replace("\n", ". ").split(". ")
    return [s for s in parts if any(w.strip(".,;:!?\"'()").lower() in named for w in s.split())]


_LAID = pa.schema([("toxic", pa.int8()), ("feat", pa.list_(pa.int32())), *((side, pa.list_(pa.list_(pa.int32()))) for side in ("left", "right"))])


def laid_out(texts: pa.Array, toxic: np.ndarray, bits: int = FEATURE_BITS, terms=IDENTITY_TERMS) -> pa.RecordBatch:
    """What the fit needs of each text: label, features, and for each variant of a sentence the features of the sentence and of the variant."""
    own, feat = features(texts, bits)
    left, right, pairs = [], [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts.to_pylist()):
        for s in sentences(t or "", terms):
            for v in swapped(s, terms):
                left.append(s)
                right.append(v)
                pairs[i] += 1
    offsets = pa.array(np.concatenate(([0], np.cumsum(pairs))), pa.int32())
    sides = []
    for side in (left, right):
        o, f = features(pa.array(side, pa.string()), bits)
        sides.append(pa.ListArray.from_arrays(offsets, list_array(f, np.bincount(o, minlength=len(side)), pa.int32())))
    return table(_LAID, toxic, list_array(feat, np.bincount(own, minlength=len(texts)), pa.int32()), *sides)


def _owned(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of its list, and value, of each value of a list column."""
    return np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)


def fit(texts: pa.Array | list[str], toxic: np.ndarray, bits: int = FEATURE_BITS, terms=IDENTITY_TERMS, **options) -> np.ndarray:
    """``fit_laid_out`` of texts and their labels."""
    column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
    rows = pa.Table.from_arrays([column, pa.array(toxic, pa.int8())], names=["text", "toxic"])
    parts = [laid_out(part.column("text"), part.column("toxic").to_numpy(), bits, terms) for chunk in rows.to_batches() for part in slices(chunk)]
    return fit_laid_out(pa.Table.from_batches(parts, _LAID), bits, **options)


def fit_laid_out(rows: pa.Table, bits: int = FEATURE_BITS, counterfactual: float = COUNTERFACTUAL, l1: float = L1, rounds: int = 200) -> np.ndarray:
    """Weights by accelerated proximal gradient; the last one is the bias.

    Without both classes, the bias alone decides: all documents are as the labels say, or clean where there are none.
    """
    size = 1 << bits
    weights = np.zeros(size + 1)
    n = rows.num_rows
    toxic = rows.column("toxic").to_numpy()
    if not n or toxic.min() == toxic.max():
        weights[-1] = 4.0 if n and toxic.max() else -4.0
        return weights
    y = toxic.astype(np.float64)
    own, feat = _owned(rows.column("feat").combine_chunks())
    counts, bad = np.bincount(feat, minlength=size).astype(np.float64), np.bincount(feat, y[own], minlength=size)
    odds = np.log((bad + 0.5) / (y.sum() + 1) / ((counts - bad + 0.5) / (n - y.sum() + 1)))
    used = np.flatnonzero((odds > 0) & (bad > 1))  # what two toxic texts share, and more so than clean ones; the others' weights are 0
    m = len(used)
    number = np.full(size, -1, np.int32)
    number[used] = np.arange(m)
    kept = number[feat] >= 0
    own, feat = own[kept].astype(np.intp), number[feat[kept]].astype(np.intp)
    pairs = None
    left, right = (rows.column(side).combine_chunks().flatten() for side in ("left", "right"))
    if len(left):
        (ol, fl), (orr, fr) = _owned(left), _owned(right)
        po, pf, sign = np.concatenate((ol, orr)), number[np.concatenate((fl, fr))], np.concatenate((np.ones(len(fl)), -np.ones(len(fr))))
        pairs = po[pf >= 0], pf[pf >= 0], sign[pf >= 0]
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    scale = 1 / np.sqrt(counts[used])  # rare features may move as far as common ones
    l1 = l1 / np.maximum(odds[used], 0.1)

    w, b = np.zeros(m), 0.0
    z, zb, t = w.copy(), b, 1.0

    def slope(v: np.ndarray, c: float) -> tuple[float, np.ndarray, float]:
        s = np.bincount(own, v[feat], minlength=n) + c
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        loss = float((balance * (np.logaddexp(0, s) - y * s)).mean())
        r = balance * (p - y) / n
        g = np.bincount(feat, r[own], minlength=m)
        if pairs is not None:
            po, pf, sign = pairs
            change = np.bincount(po, v[pf] * sign, minlength=len(left))
            loss += counterfactual * float((change**2).mean())
            g += counterfactual * 2 / len(left) * np.bincount(pf, sign * change[po], minlength=m)
        return loss, g, float(r.sum())

    step = 1.0
    for _ in range(rounds):
        loss, g, gb = slope(z, zb)
        while True:
            moved = z - step * scale * scale * 20 * g
            near = np.sign(moved) * np.maximum(np.abs(moved) - step * scale * scale * 20 * l1, 0)
            nb = zb - step * 20 / n**0.5 * gb
            d, db = near - z, nb - zb
            bound = loss + g @ d + gb * db + ((d / scale) ** 2).sum() / (40 * step) + db * db * n**0.5 / (40 * step)
            if slope(near, nb)[0] <= bound + 1e-9 or step < 1e-6:
                break
            step /= 2
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb = near + (t - 1) / t2 * (near - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = near, nb, t2
    weights[used] = w
    weights[-1] = b
    return weights


def score(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    bits = (len(weights) - 1).bit_length() - 1
    own, feat = features(column, bits)
    s = np.bincount(own, weights[feat], minlength=len(column)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _laid(bits: int, terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield laid_out(part.column("text"), (part.column("toxic").to_numpy() > 0).astype(np.int8), bits, terms)

    return run


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, bits: int = FEATURE_BITS, terms=IDENTITY_TERMS, **options) -> np.ndarray:
    """Weights from at most ``max_labelled`` labelled rows; the same ones every time. Rows with a null label or text are left out. The driver gets feature numbers, no text."""
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).where("_toxic is not null and _id is not null")
    sample = marked.orderBy(F.md5(F.col("_id").cast("string")), "_toxic").limit(max_labelled)
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("_toxic").cast("int").alias("toxic"))
    laid = rows.orderBy("doc_id", "toxic", "text").limit(max_labelled).select("text", "toxic").mapInArrow(_laid(bits, terms), "toxic tinyint, feat array<int>, left array<array<int>>, right array<array<int>>")
    return fit_laid_out(laid.toArrow(), bits, **options)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(shared.value, np.float64)
        for batch in batches:
            for part in slices(batch):
                p = np.round(score(part.column("text"), weights), 6)
                rest = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(p), pa.array(p >= 0.5)], names=[*part.schema.names[:-1], "score", "toxic"])

    return run


def classify(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, score, toxic) for every row of ``documents``: the probability, to 6 places, and whether it is at least one half.

    A null or empty text has the score of the bias alone. Repeated rows and null ids are scored like any other; so are texts of any length, whole.
    Labels of unknown documents are ignored; without labels of both kinds all documents get the class there is, clean if there is none.
    Empty documents give no rows. Other columns are ignored.
    """
    weights = train(documents, labels, **options)
    shared = documents.sparkSession.sparkContext.broadcast(weights.tobytes())
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(shared), "doc_id bigint, score double, toxic boolean")


def drop_toxic(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``documents`` without those that ``classify`` calls toxic; columns and repeated rows stay. One pass, no shuffle.

    A null or empty text goes or stays by the score of the bias alone, as in ``classify``; without toxic labels nothing goes. Empty documents give no rows; other columns are passed on.
    """
    weights = train(documents, labels, **options)
    shared = documents.sparkSession.sparkContext.broadcast(weights.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(shared.value, np.float64)
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(np.round(score(part.column("text"), w), 6) < 0.5))

    return documents.mapInArrow(run, documents.schema)
