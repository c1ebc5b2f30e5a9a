"""Near-duplicate documents by DartMinHash signatures.

A document is a weighted set: its word bigrams (words in lower case) with their counts as weights.
For each element, darts fall on the quarter-plane of weight x rank as a Poisson process that depends on nothing but the element:
weight is cut into the dyadic layers [0,1), [1,2), [2,4), ..., and in a layer the darts come one after another by rank.
A dart hits the document if its weight lies under the element's weight. All darts up to the rank at which about
``k (ln k + 2)`` hit are thrown; each belongs to one of the ``k`` coordinates, and the earliest of a coordinate is kept.
Where a coordinate stays empty, the rank is doubled for that document. Two documents agree in a coordinate with a
probability equal to their weighted Jaccard similarity. The cost is a hash per element and ``O(k log k)`` darts, not ``k`` hashes per element.

Documents with equal signatures are one node. Nodes that agree in all rows of a band meet in that band's bucket. Buckets of a single node are
dropped while rows are 24 bytes long; only to the others the sketches are brought, and there they are compared, at most ``BUCKET`` nodes in one place: larger
buckets are split, and what isn't linked within the parts is compared across them (``linked``). In a part the connected nodes are found by breadth-first search, each step comparing one node with all nodes
not yet reached, so no pair is dropped however large the bucket, while tight groups cost little more than their size.
Connected components over all buckets are the groups. One task finds them where edges are few, jobs over many tasks where they aren't.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import hash_ranges, list_array, lowered, mix64, ngrams, seed64, slices, table, words
from .shared import cut, fresh, row_key

COORDINATES, BAND_ROWS, THRESHOLD, SHINGLE = 96, 4, 0.5, 2
#: Nodes of a bucket that are compared in one place, and keys to remove that are broadcast (about 100 MB).
BUCKET, BROADCAST_KEYS = 16_384, 1_000_000
#: Edges, of 32 bytes, whose components one task finds.
LOCAL_EDGES = 500_000


def elements(hashes: np.ndarray, owner: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and weight of each element, sorted by owner. A text with fewer words than a shingle has its words as elements."""
    if not len(hashes):
        return owner, hashes, np.zeros(0)
    grams = ngrams(hashes, shingle)
    whole = owner[: len(grams)] == owner[shingle - 1 :]
    few = np.bincount(owner)[owner] < shingle
    who, what = np.concatenate((owner[: len(grams)][whole], owner[few])), np.concatenate((grams[whole], hashes[few]))
    key = np.sort((who.astype(np.uint64) << np.uint64(44)) | (what >> np.uint64(20)))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key, count = key[at], np.diff(np.append(at, len(key)))
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), count.astype(np.float64)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(owner: np.ndarray, what: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, k) signature of each owner, and which owners have elements at all."""
    total = np.bincount(owner, weight, minlength=n)
    some = total > 0
    rank, dart = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    limit = np.zeros(n)
    limit[some] = k * (math.log(k) + 2) / total[some]
    open_ = some.copy()
    while open_.any():
        use = open_[owner]
        own, item, w = owner[use], what[use], weight[use]
        layer, low, width = 0, 0.0, 1.0
        while len(own):
            state = seed64(item, 1 + layer)
            arrival, of = np.zeros(len(own)), np.arange(len(own))
            while len(of):
                arrival = arrival - np.log(_uniform(state)) / width
                near = arrival <= limit[own[of]]
                of, arrival, state = of[near], arrival[near], state[near]
                where = mix64(state ^ np.uint64(0xA0761D6478BD642F))
                hit = low + width * _uniform(where) < w[of]
                slot = own[of[hit]] * k + (mix64(where[hit]) % np.uint64(k)).astype(np.int64)
                at, ident = arrival[hit], where[hit]
                np.minimum.at(rank, slot, at)
                best = at == rank[slot]
                dart[slot[best]] = ident[best]
                state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
            low, width, layer = low + width, (1.0 if layer == 0 else 2 * width), layer + 1
            more = w > low
            own, item, w = own[more], item[more], w[more]
        open_ &= np.isinf(rank.reshape(n, k)).any(axis=1)
        limit[open_] *= 2
    return dart.reshape(n, k), some


def _fold(values: np.ndarray, salt: int) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for j in range(values.shape[1]):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + values[:, j] + np.uint64(salt + j))
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _sign(k: int, band_rows: int, shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.binary()), ("node", pa.binary()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offs = lowered(part.column("text"))
                begin, end, owner = words(data, offs)
                sig, some = signatures(*elements(hash_ranges(data, begin, end), owner, shingle), part.num_rows, k)
                rows = np.flatnonzero(some)
                if not len(rows):
                    continue
                sig, kept = sig[rows], part.take(pa.array(rows))
                node = np.stack((_fold(sig, 11), _fold(sig, 7919)), axis=1).view(np.uint8)
                bands = np.stack([_fold(sig[:, b : b + band_rows], 1_000_003 * (b + 1)) for b in range(0, k, band_rows)], axis=1)
                yield table(schema, kept.column("doc_id"), kept.column("row_key"), _binary(node), _binary((sig >> np.uint64(40)).astype(np.uint8)), list_array(bands.ravel().view(np.int64), np.full(len(rows), bands.shape[1]), pa.int64()))

    return run


def _parts(sketch: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(leader, members) of each connected part of more than one node."""
    rest = np.arange(len(sketch))
    need = math.ceil(threshold * sketch.shape[1])
    while len(rest) > 1:
        leader, rest = rest[0], rest[1:]
        reached, queue = [], [leader]
        while queue and len(rest):
            near = (sketch[rest] == sketch[queue.pop()]).sum(axis=1) >= need
            found, rest = rest[near], rest[~near]
            reached.append(found)
            queue.extend(found)
        members = np.concatenate(reached) if reached else rest[:0]
        if len(members):
            yield leader, members


def _blocks(columns: list[str], work):
    """Calls ``work`` with all rows of each block of a partition whose batches come sorted by ``columns``, or of several blocks at a time with where each begins; a block is at most about ``BUCKET`` rows of either kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None

        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts and sum(p.num_rows for p in parts) > 1:
                t = pa.Table.from_batches(parts).combine_chunks()
                yield from work(t, np.concatenate(([0], turns(t) + 1, [t.num_rows])))

        def turns(t) -> np.ndarray:
            """Rows after which another block begins."""
            key = np.stack([t.column(c).to_numpy() for c in columns])
            return np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))

        for batch in batches:
            if not batch.num_rows:
                continue
            first, final = (tuple(batch.column(c)[i].as_py() for c in columns) for i in (0, batch.num_rows - 1))
            if first != last:
                yield from done(held)
                held = []
            if first != final:
                begin = int(turns(batch)[-1]) + 1
                yield from done([*held, batch.slice(0, begin)])
                held = [batch.slice(begin)]
            else:
                held.append(batch)
            last = final
        yield from done(held)

    return run


_EDGES, _ROOTS = pa.schema([("a", pa.binary()), ("b", pa.binary())]), pa.schema([("node", pa.binary()), ("root", pa.binary())])


def _sketches(t: pa.Table) -> np.ndarray:
    return _bytes(t.column("sketch")).reshape(t.num_rows, -1)


def _link(threshold: float):
    """Edges within blocks."""

    def work(t: pa.Table, border: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, sketch = t.column("node").combine_chunks(), _sketches(t)
        size = np.diff(border)
        two = border[:-1][size == 2]
        two = two[(sketch[two] == sketch[two + 1]).sum(axis=1) >= math.ceil(threshold * sketch.shape[1])]
        left, right = [two], [two + 1]
        for s, n in zip(border[:-1][size > 2].tolist(), size[size > 2].tolist()):
            for leader, members in _parts(sketch[s : s + n], threshold):
                left.append(np.full(len(members), s + leader))
                right.append(s + members)
        left, right = np.concatenate(left), np.concatenate(right)
        if len(left):
            yield table(_EDGES, node.take(pa.array(left)), node.take(pa.array(right)))

    return _blocks(["band", "block", "tile"], work)


def _cross(threshold: float):
    """For each row with ``asks`` one edge to each other component that it meets in its block."""

    def work(t: pa.Table, border: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, sketch = t.column("node").combine_chunks(), _sketches(t)
        asks = t.column("asks").to_numpy()
        root = t.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        need = math.ceil(threshold * sketch.shape[1])
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(border[:-1], border[1:]):
            rest = np.arange(s, e)[~asks[s:e]]
            for i in np.arange(s, e)[asks[s:e]]:
                hit = rest[(root[rest] != root[i]) & ((sketch[rest] == sketch[i]).sum(axis=1) >= need)]
                if len(hit):
                    hit = hit[np.unique(root[hit], return_index=True)[1]]
                    left.append(np.full(len(hit), i))
                    right.append(hit)
        left, right = np.concatenate(left), np.concatenate(right)
        if len(left):
            yield table(_EDGES, node.take(pa.array(left)), node.take(pa.array(right)))

    return _blocks(["band", "block", "tile"], work)


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks().cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of a partition that holds all edges (u, v): roots are hooked to lesser roots that they have an edge to, until no edge is between two of them."""
    edges = pa.Table.from_batches(batches, pa.schema([("u", pa.binary()), ("v", pa.binary())]))
    if not edges.num_rows:
        return
    coded = pa.chunked_array([*edges.column("u").chunks, *edges.column("v").chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    u, v = rank[coded.indices.to_numpy()].reshape(2, -1)
    root = np.arange(len(order))
    while True:
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
        if not len(u):
            break
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    yield table(_ROOTS, coded.dictionary.take(pa.array(order)), coded.dictionary.take(pa.array(order[root])))


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Up to ``local_edges`` different edges (counted) are the work of one task; the result is the same beyond. More take many tasks, which alternate large-star and small-star steps; every step is written to the checkpoint folder, and it ends when a step leaves number and hash sum of the edges as they were.
    A node's least neighbour is joined to its edges, so that a node with very many of them is spread over tasks like any skewed key.
    """

    def star(e: DataFrame) -> DataFrame:
        """Edges (u, v) with the least v of each u."""
        return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = state(now)
    if before[0] <= local_edges:
        return now.coalesce(1).mapInArrow(_rooted, "node binary, root binary")
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        stars = star(large)
        small = stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(stars.where("v = m").select("u", "v")).distinct()
        now = cut(small)
        after = state(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after


def linked(nodes: DataFrame, threshold: float, bucket: int = BUCKET) -> DataFrame:
    """(node, root) of all nodes that have a link.

    A band's bucket of more than ``bucket`` nodes is dealt by hash into blocks of about that size, another way in each band; links within blocks come first. What such a bucket holds of other components than its
    largest is then compared with all of it, block by block, so that no link is lost. Copies of one another form one component after the first step, and nothing is left to compare.
    """
    met = nodes.select(F.explode("bands").alias("band"), "node")
    counts = cut(met.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    met = met.join(counts, "band").select("band", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node", "band"), blocks).cast("int").alias("block"))
    sketched = met.join(nodes.select("node", "sketch"), "node")

    def within(rows: DataFrame, work, columns: tuple[str, ...]) -> DataFrame:
        return rows.select("band", "block", "tile", "node", "sketch", *columns).repartition("band", "block", "tile").sortWithinPartitions("band", "block", "tile").mapInArrow(work, "a binary, b binary")

    edges = cut(within(sketched.withColumn("tile", F.lit(0)), _link(threshold), ()))
    roots = components(edges)
    if counts.where(F.col("n") > bucket).isEmpty():
        return roots
    large = cut(met.where("blocks > 1").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    sizes = large.groupBy("band", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    if main.isEmpty():
        return roots
    tiles = F.ceil(F.col("others") / bucket).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    seen = large.join(main.select("band", "main", tiles.alias("tiles")), "band").join(nodes.select("node", "sketch"), "node")
    held = seen.select("band", "node", "sketch", "root", F.lit(False).alias("asks"), "block", each("tiles").alias("tile"))
    asks = seen.where("root <> main").select("band", "node", "sketch", "root", F.lit(True).alias("asks"), F.pmod(F.xxhash64("band", "node"), F.col("tiles")).cast("int").alias("tile"), each("blocks").alias("block"))
    found = within(held.unionByName(asks), _cross(threshold), ("root", "asks"))
    return components(edges.unionAll(found))


def members(documents: DataFrame, threshold: float = THRESHOLD, k: int = COORDINATES, band_rows: int = BAND_ROWS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, row_key, row, kept) of every row in a group of more than one; ``row`` numbers the rows, ``kept`` is the (doc_id, row_key, row) that stays, the least of the group, null ids last."""
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"), row_key().alias("row_key"))
    signed = cut(texts.mapInArrow(_sign(k, band_rows, shingle), "doc_id bigint, row_key binary, node binary, sketch binary, bands array<bigint>").withColumn("row", F.monotonically_increasing_id()))
    nodes = cut(signed.groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    rooted = signed.select("doc_id", "row_key", "row", "node").join(linked(nodes, threshold, bucket), "node", "left").select("doc_id", "row_key", "row", F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key", "row")
    groups = rooted.groupBy("root").agg(F.min(order).alias("kept"), F.count("*").alias("n")).where("n > 1")
    return rooted.join(groups, "root").select("doc_id", "row_key", "row", "kept")


def near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, kept_doc_id): every document that a near or exact copy makes superfluous, with the one of its group that stays.

    The one that stays has the least doc_id (null ids come last; between equal ids, the least digest of id and text). Repeated rows are
    copies of each other: one stays, and each of the others gives a row (doc_id, doc_id).
    Null and empty texts and texts without a word have no signature and are in no group. Texts of any length are read whole.
    Empty tables give no rows. Other columns are ignored.
    """
    return members(documents, **options).where(F.col("row") != F.col("kept.row")).select("doc_id", F.col("kept.doc_id").alias("kept_doc_id"))


def drop_near_duplicates(documents: DataFrame, broadcast_keys: int = BROADCAST_KEYS, **options) -> DataFrame:
    """``documents`` with one row of each group of ``near_duplicates``. Columns stay as they are.

    Rows that agree in doc_id and text are one row, whatever else they hold. Rows with a null or empty text, or one without a word, all stay, however often they are repeated.
    What goes is found on ids and digests; texts are read where they lie and not shuffled, but for those of repeated rows of which one stays. Only beyond ``broadcast_keys``
    digests to remove (counted) is it an ordinary anti-join.
    """
    key, other = fresh(documents, "_row_key"), fresh(documents, "_other_key")
    found = cut(members(documents, **options).where(F.col("row") != F.col("kept.row")).groupBy(F.col("row_key").alias(other)).agg(F.bool_or(F.col("row_key") == F.col("kept.row_key")).alias("stays")))
    gone, repeated = found.where("not stays").select(other), found.where("stays").select(other)
    small = found.limit(broadcast_keys + 1).count() <= broadcast_keys
    hint = F.broadcast if small else lambda df: df
    same = F.col(key) == F.col(other)
    left = documents.withColumn(key, row_key()).join(hint(gone), same, "left_anti")
    if not repeated.isEmpty():
        left = left.join(hint(repeated), same, "left_anti").unionAll(left.join(hint(repeated), same, "left_semi").dropDuplicates([key]))
    return left.select(*documents.columns)
