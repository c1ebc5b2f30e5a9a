"""Document quality from a linear-chain conditional random field over lines.

Every line that is not blank is good or bad. What a line shows (its shares of letters, capitals, digits, punctuation and symbols,
length, word length, repeated words, whether the document has the same line elsewhere), and what the lines before and after it show,
score its label; a transition matrix scores each pair of labels in a row. Forward-backward
gives each line's probability of being good, exactly; a document's quality is their mean weighted by length in bytes.

Fitted on the driver on at most ``max_labelled`` labelled documents (the same in every run), a document's label standing for all of its lines.
Scoring reads each document once, whole, without a shuffle; the recursion runs over line numbers, for all documents of a slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import hash_ranges, slices, table, utf8, words

MAX_LABELLED = 3000

_CLASS = np.full(256, 7, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:'\"?-()"]] = 4
_CLASS[ord("!")], _CLASS[ord("|")] = 5, 6
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 1, 8


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of each line that holds more than white space."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    ink = _CLASS[data] != 0
    ink[data == 10] = False
    stop = np.unique(np.concatenate((np.flatnonzero(data == 10), offs[1:])))
    start = np.concatenate(([0], stop[:-1]))
    start = start + ((start < len(data)) & (data[np.minimum(start, len(data) - 1)] == 10))
    start = np.minimum(start, stop)
    count = np.concatenate(([0], np.cumsum(ink, dtype=np.int64)))
    full = count[stop] > count[start]
    start, stop = start[full], stop[full]
    return start, stop, np.searchsorted(offs, start, "right") - 1


def describe(data: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """What each line shows, a row a line."""
    n = len(begin)
    length = end - begin
    stop = np.cumsum(length)
    number = np.repeat(np.arange(n), length)
    at = np.arange(stop[-1] if n else 0) + np.repeat(begin - (stop - length), length)
    kind = _CLASS[data[at]].astype(np.int64)
    lead = np.flatnonzero(data[at[:-1]] == 0xC3) if n else np.zeros(0, np.int64)
    after = data[at[lead] + 1]
    kind[lead[(after >= 0x80) & (after <= 0x9E)]] = 2
    c = np.bincount(number * 9 + kind, minlength=9 * n).reshape(n, 9).astype(np.float64)
    wb, we, _ = words(data, offs)
    line = np.searchsorted(begin, wb, "right") - 1
    h = hash_ranges(data, wb, we)
    same = np.zeros(len(wb))
    if len(wb) > 1:
        same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    count = np.bincount(line, minlength=n).astype(np.float64)
    key = np.sort((line.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    distinct = np.bincount((key[np.concatenate(([True], key[1:] != key[:-1]))] >> np.uint64(40)).astype(np.int64), minlength=n) if len(key) else np.zeros(n)
    copies = np.zeros(n)
    if n:
        key = (owner.astype(np.uint64) << np.uint64(40)) | (hash_ranges(data, begin, end) >> np.uint64(24))
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        copies = (times[back] > 1).astype(np.float64)
    letters, some = np.maximum(c[:, 1] + c[:, 2], 1), np.maximum(count, 1)
    chars = np.maximum(length - c[:, 8], 1)
    return np.stack([c[:, 2] / letters, (c[:, 2] > 0.5 * letters), c[:, 3] / chars, np.minimum(c[:, 4] / some, 2), np.minimum(c[:, 5] / some, 2), np.minimum(c[:, 6] / some, 2), np.minimum(c[:, 7] / some, 3), c[:, 7] > 0.3 * some,
                     np.bincount(line, same, minlength=n) / some, distinct / some, np.log1p(count), np.minimum((c[:, 1] + c[:, 2]) / some, 20), count < 4, copies, (data[end - 1] == 46) if n else copies], axis=1)


def around(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each line's row, those of the lines before and after it (0 where there is none), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        inner = (owner[1:] == owner[:-1])[:, None]
        before[1:], after[:-1] = x[:-1] * inner, x[1:] * inner
    return np.concatenate((x, before, after, np.ones((len(x), 1))), axis=1)


def marginals(unary: np.ndarray, owner: np.ndarray, move: np.ndarray, pairs: bool = False):
    """P(good) of each line, and with ``pairs`` the expected number of each pair of labels and the log of the sum of all labellings' scores.

    ``unary`` is the score of good less that of bad; ``move[i, j]`` that of label i before j (0 bad, 1 good).
    """
    n = len(unary)
    if not n:
        return (np.zeros(0), np.zeros((2, 2)), 0.0) if pairs else np.zeros(0)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    active = np.searchsorted(-size, -np.arange(size[0]), "left")
    u = np.clip(unary, -30, 30)
    emit = np.stack((np.exp(-np.maximum(u, 0)), np.exp(np.minimum(u, 0))), axis=1)
    e = np.exp(move)
    f, b, norm = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
    for t, m in enumerate(active):
        at = first[:m] + t
        x = emit[at] * (f[at - 1] @ e if t else 1.0)
        s = x.sum(axis=1)
        f[at], norm[at] = x / s[:, None], s
    for t in range(len(active) - 1, 0, -1):
        at = first[: active[t]] + t
        b[at - 1] = (emit[at] * b[at]) @ e.T / norm[at][:, None]
    p = f * b
    p = p[:, 1] / p.sum(axis=1)
    if not pairs:
        return p
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    joint = f[inner][:, :, None] * e[None] * (emit[inner + 1] * b[inner + 1] / norm[inner + 1][:, None])[:, None, :]
    return p, joint.sum(axis=0), float((np.log(norm) + np.maximum(u, 0)).sum())


def fit(texts: list[str], good: np.ndarray, rounds: int = 150, ridge: float = 1e-2) -> np.ndarray:
    """Parameters: means and scales of what lines show, unary weights, transitions. Without both classes all lines get the class there is, good if there is none."""
    shown, owner, label, done = [], [], [], 0
    for part in slices(pa.record_batch([pa.array(texts, pa.string())], names=["text"])):
        data, offs = utf8(part.column("text"))
        begin, end, own = lines(data, offs)
        shown.append(describe(data, begin, end, own, offs))
        owner.append(own + done)
        label.append(good[own + done])
        done += part.num_rows
    width = 15
    mean, scale, w, move = np.zeros(width), np.ones(width), np.zeros(3 * width + 1), np.zeros((2, 2))
    if not done or good.min() == good.max() or not sum(map(len, owner)):
        w[-1] = 4.0 if not done or good.max() else -4.0
        return np.concatenate((mean, scale, w, move.ravel()))
    x, owner, y = np.concatenate(shown), np.concatenate(owner), np.concatenate(label).astype(np.float64)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    phi = around((x - mean) / scale, owner)
    docs = len(np.unique(owner))
    inner = owner[1:] == owner[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inner].astype(int), y[1:][inner].astype(int)), 1)
    theta, m, v = np.zeros(len(w) + 4), 0.0, 0.0
    for i in range(1, rounds + 1):
        w, move = theta[:-4], theta[-4:].reshape(2, 2)
        p, expected, _ = marginals(phi @ w, owner, move, True)
        g = np.concatenate((phi.T @ (y - p), (seen - expected).ravel())) / docs - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return np.concatenate((mean, scale, theta))


def judge(column: pa.Array, params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quality, number of lines and of good lines of each text; a text without lines has quality 0."""
    width = 15
    mean, scale, w, move = params[:width], params[width : 2 * width], params[2 * width : -4], params[-4:].reshape(2, 2)
    data, offs = utf8(column)
    begin, end, owner = lines(data, offs)
    n = len(column)
    if not len(begin):
        return np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    x = (describe(data, begin, end, owner, offs) - mean) / scale
    own, before, after = (x @ w[:-1].reshape(3, width).T).T  # ``around(x) @ w``, without the wide matrix
    unary = own + w[-1]
    inner = owner[1:] == owner[:-1]
    unary[1:] += before[:-1] * inner
    unary[:-1] += after[1:] * inner
    p = marginals(unary, owner, move)
    weight = (end - begin).astype(np.float64)
    quality = np.bincount(owner, weight * p, minlength=n) / np.maximum(np.bincount(owner, weight, minlength=n), 1)
    return quality, np.bincount(owner, minlength=n), np.bincount(owner, p >= 0.5, minlength=n).astype(np.int64)


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **options) -> np.ndarray:
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_good")).where("_good is not null and _id is not null")
    sample = marked.orderBy(F.md5(F.col("_id").cast("string")), "_good").limit(max_labelled)
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("_good").cast("int").alias("good"))
    got = rows.orderBy("doc_id", "good", "text").limit(max_labelled).toArrow()
    return fit(got.column("text").to_pylist(), (got.column("good").to_numpy() > 0).astype(np.int8), **options)


_OUT = pa.schema([("doc_id", pa.int64()), ("quality", pa.float64()), ("n_lines", pa.int64()), ("n_good", pa.int64()), ("keep", pa.bool_())])


def assess(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, quality, n_lines, n_good, keep) for every row: quality to 6 places, lines, lines more likely good than bad, and whether quality is at least one half.

    Null, empty and blank texts have no line and quality 0, so they aren't kept. Repeated rows and null ids are judged like any other, texts of any length as a whole.
    Labels of unknown documents are ignored; without labels of both kinds all lines get the class there is, good if there is none.
    Empty documents give no rows. Other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels, **options).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = np.frombuffer(shared.value, np.float64)
        for batch in batches:
            for part in slices(batch):
                quality, count, fine = judge(part.column("text"), params)
                quality = np.round(quality, 6)
                yield table(_OUT, part.column("doc_id"), quality, count, fine, quality >= 0.5)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, quality double, n_lines bigint, n_good bigint, keep boolean")
