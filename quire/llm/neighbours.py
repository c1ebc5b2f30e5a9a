"""Approximate nearest neighbours with vantage-point trees in shards.

A vantage-point tree over a bounded sample cuts space into cells. The vectors of a cell are a shard, or, where there are more than ``SHARD_ROWS``, several
shards, dealt by hash; so a third of all rows may be one and the same vector. In each shard a tree of its own is built. A node holds a vector, and
for either side the least and the greatest distance to it; the triangle inequality says how near anything on a side can be at least. For the cells
these intervals are those of all rows, not of the sample's. A side is left out when ``factor`` times that bound exceeds the
distance of the k-th neighbour found so far. With factor 1 the search is exact; a larger one prunes more and may miss some.

How many it misses depends on the vectors' intrinsic dimension and on their number, so the factor comes from the table itself: some of its rows, drawn by
hash, are searched over the whole table with each of ``FACTORS``. The largest factor whose recall against the exact search is high enough, with room for the error of the
sample, serves all queries; where none is, the search is exact.

Queries are the rows whose id is divisible by ``every``; they are searched among all rows, in rounds: the own cell, which gives a radius; the ``NEAR`` cells with
the least bounds, which makes it smaller; all others that may hold something nearer still. Queries run through a tree in sets, a matrix product per leaf.
Shards with many visitors are searched by several tasks (``VISITORS`` queries each), so that no task grows with the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import list_array
from .shared import cut, ship, unship

K, EVERY, SHARD_ROWS, LEAF, VISITORS, NEAR = 10, 100, 16384, 256, 65536, 4
#: Bounds of the sample that the cells come from: cells, rows for each, and floats in all.
MAX_CELLS, SAMPLE_PER_CELL, SAMPLE_VALUES = 4096, 16, 1 << 22
#: The factors to choose from; the last one is exact. Recall on ``PROBES`` rows, less two standard errors, must reach ``RECALL``.
FACTORS, PROBES, RECALL = (4.0, 3.0, 2.5, 2.0, 1.5, 1.0), 400, 0.93
#: Distances count to so many decimal places; pruning leaves as much room.
PLACES = 6
ROOM = 10.0**-PLACES


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def to_one(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - v) ** 2).sum(axis=1))


def bound(d: np.ndarray, low: float, high: float) -> np.ndarray:
    """How near a vector at distance ``d`` from the vantage point can be to one that is between ``low`` and ``high`` from it."""
    return np.maximum(np.maximum(d - high, low - d), 0)


class Tree:
    """A node is the rows of a leaf, or (vantage point, middle, (child, least, greatest distance) of the inside, and of the outside). Built from a fixed seed, so always the same for the same rows."""

    def __init__(self, x: np.ndarray, leaf: int) -> None:
        self.x, self.nodes = x, []
        self.root = self._build(np.arange(len(x)), leaf, np.random.Generator(np.random.PCG64(1)))

    def _build(self, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        me = len(self.nodes)
        self.nodes.append(rows)
        if len(rows) > leaf:
            # of some candidates, the one whose distances spread the most
            some = rows[rng.integers(0, len(rows), 8)]
            best = int(distances(self.x[some], self.x[rows]).std(axis=1).argmax())
            vantage = self.x[some[best]].copy()
            d = to_one(self.x[rows], vantage)
            middle = float(np.median(d))
            near = d <= middle
            if not near.all():
                sides = [(self._build(rows[s], leaf, rng), float(d[s].min()), float(d[s].max())) for s in (near, ~near)]
                self.nodes[me] = (vantage, middle, *sides)
        return me

    def leaves(self) -> dict[int, int]:
        """Number of each leaf by its node."""
        return {n: i for i, n in enumerate(n for n, node in enumerate(self.nodes) if isinstance(node, np.ndarray))}


class Search:
    """The k nearest of a tree's vectors for a set of queries, by (distance, place in the tree's vectors)."""

    def __init__(self, tree: Tree, rows: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, radius: np.ndarray, k: int, factor: np.ndarray) -> None:
        self.tree, self.rows, self.q, self.own, self.k, self.factor = tree, rows, queries, query_rows, k, factor
        self.limit = radius.copy()
        self.d = np.full((len(queries), k), np.inf)
        self.at = np.full((len(queries), k), -1)
        self.scanned = 0
        self._visit(tree.root, np.arange(len(queries)))

    def _visit(self, node: int, who: np.ndarray) -> None:
        if not len(who):
            return
        here = self.tree.nodes[node]
        if isinstance(here, np.ndarray):
            for s in range(0, len(who), 4096):
                self._leaf(here, who[s : s + 4096])
            return
        vantage, middle, *sides = here
        d = to_one(self.q[who], vantage)
        least = [self.factor[who] * bound(d, low, high) - ROOM for _, low, high in sides]
        inner = d <= middle
        for side, on in ((0, inner), (1, ~inner), (1, inner), (0, ~inner)):  # the side that a query lies on comes first
            self._visit(sides[side][0], who[on & (least[side] <= self.limit[who])])

    def _leaf(self, leaf: np.ndarray, who: np.ndarray) -> None:
        self.scanned += len(leaf) * len(who)
        d = distances(self.q[who], self.tree.x[leaf])
        d[self.own[who][:, None] == self.rows[leaf][None]] = np.inf
        np.round(d, PLACES, out=d)
        near, column = np.nonzero(d <= self.limit[who][:, None])
        if not len(near):
            return
        some, index = np.unique(near, return_inverse=True)
        who, n = who[some], len(some)
        q = np.concatenate((np.repeat(np.arange(n), self.k), index))
        dist = np.concatenate((self.d[who].ravel(), d[near, column]))
        at = np.concatenate((self.at[who].ravel(), leaf[column]))
        order = np.lexsort((at, dist, q))
        q, dist, at = q[order], dist[order], at[order]
        first = np.searchsorted(q, np.arange(n))
        best = first[:, None] + np.arange(self.k)
        self.d[who], self.at[who] = dist[best], at[best]
        self.limit[who] = np.minimum(self.limit[who], self.d[who, -1])


def settle(tree: Tree, x: np.ndarray, seen: dict[tuple[int, int], tuple[float, float]] | None = None) -> np.ndarray:
    """The leaf's node that each vector falls into. ``seen`` gets the least and greatest distance by (node, side)."""
    out = np.zeros(len(x), np.int64)

    def go(node: int, who: np.ndarray) -> None:
        here = tree.nodes[node]
        if isinstance(here, np.ndarray):
            out[who] = node
            return
        vantage, middle, *sides = here
        d = to_one(x[who], vantage)
        for side, on in enumerate((d <= middle, d > middle)):
            if on.any():
                if seen is not None:
                    low, high = seen.get((node, side), (np.inf, -np.inf))
                    seen[node, side] = min(low, float(d[on].min())), max(high, float(d[on].max()))
                go(sides[side][0], who[on])

    if len(x):
        go(tree.root, np.arange(len(x)))
    return out


def bounds(tree: Tree, number: dict[int, int], x: np.ndarray, radius: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """(queries, cells): how near a cell's vectors can be at least; infinite where ``factor`` times that exceeds the radius."""
    out = np.full((len(x), len(number)), np.inf)

    def go(node: int, who: np.ndarray, so_far: np.ndarray) -> None:
        here = tree.nodes[node]
        if isinstance(here, np.ndarray):
            out[who, number[node]] = so_far
            return
        vantage, _, *sides = here
        d = to_one(x[who], vantage)
        for child, low, high in sides:
            least = np.maximum(so_far, bound(d, low, high))
            on = np.isfinite(least) & (factor[who] * least <= radius[who] + ROOM)
            if on.any():
                go(child, who[on], least[on])

    if len(x):
        go(tree.root, np.arange(len(x)), np.zeros(len(x)))
    return out


def visits(tree: Tree, number: dict[int, int], x: np.ndarray, home: np.ndarray, first: np.ndarray, now: np.ndarray | None, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, cell) to visit. ``first`` is the radius after the own cell; with it alone, the ``NEAR`` nearest cells; with the radius ``now`` after these, all the others."""
    least = bounds(tree, number, x, first, factor)
    least[np.arange(len(x)), home] = np.inf
    near = np.argsort(least, axis=1, kind="stable")[:, :NEAR]
    q = np.repeat(np.arange(len(x)), near.shape[1])
    if now is None:
        some = np.isfinite(least[q, near.ravel()])
        return q[some], near.ravel()[some]
    least[q, near.ravel()] = np.inf
    return np.nonzero(np.isfinite(least) & (factor[:, None] * np.where(np.isfinite(least), least, 0) <= now[:, None] + ROOM))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def chosen(tried: list) -> float:
    """The largest of ``FACTORS`` with enough recall, from (row, factor, distances of its neighbours); a neighbour counts if it is no farther than the last exact one."""
    found = {(row, factor): ds for row, factor, ds in tried}
    exact = {row: ds for (row, factor), ds in found.items() if factor == FACTORS[-1]}
    for factor in FACTORS[:-1]:
        recall = np.array([sum(d <= ds[-1] for d in found.get((row, factor), ())) / len(ds) for row, ds in exact.items()])
        if len(recall) and recall.mean() - 2 * recall.std() / math.sqrt(len(recall)) >= RECALL:
            return factor
    return FACTORS[-1]


def nearest(embeddings: DataFrame, k: int = K, factor: float | None = None, every: int = EVERY, shard_rows: int = SHARD_ROWS, leaf: int = LEAF, visitors: int = VISITORS) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): the ``k`` nearest other rows, among all rows, of each row whose id is divisible by ``every``, by Euclidean distance to 6 places, rank from 1.

    Ties go to the lower id, then to the row read first. A repeated row is a neighbour of its copies, at distance 0; only the row itself is left out.
    Rows whose embedding or id is null, which hold a null, a NaN or an infinity, or whose length isn't the most common one (the shortest of those, where
    several are) neither have nor are neighbours. With fewer than ``k`` other rows all of them are given. Empty tables give no rows. Other columns are ignored.
    Without a ``factor`` it is chosen by the recall that it has on this table.
    """
    if k < 1 or every < 1 or factor is not None and factor < 1:
        raise ValueError("k, every and factor must be at least 1")
    spark = embeddings.sparkSession
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0").where(whole)
    sizes = valid.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, rows = (sizes[0][0], sizes[0][1]) if sizes else (1, 0)
    points = cut(valid.where(F.size("embedding") == dim).withColumn("row", F.monotonically_increasing_id()))
    cells = max(1, min(MAX_CELLS, SAMPLE_VALUES // (SAMPLE_PER_CELL * dim), math.ceil(rows / shard_rows)))
    sample = points.orderBy(F.xxhash64("vec_id", "row")).limit(cells * SAMPLE_PER_CELL).select("embedding").toArrow().column(0)
    top = Tree(_matrix(sample, dim) if rows else np.zeros((1, dim)), SAMPLE_PER_CELL)
    number = top.leaves()
    rough = ship(spark, (top, number))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number = unship(rough)
        index = np.zeros(len(tree.nodes), np.int32)
        for node, i in number.items():
            index[node] = i
        for batch in batches:
            cell = index[settle(tree, _matrix(batch.column("embedding"), dim))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, _ = unship(rough)
        seen: dict = {}
        for batch in batches:
            settle(tree, _matrix(batch.column("embedding"), dim), seen)
        if seen:
            yield pa.RecordBatch.from_pylist([{"node": n, "side": s, "low": low, "high": high} for (n, s), (low, high) in seen.items()], pa.schema([("node", pa.int32()), ("side", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))

    placed = cut(points.mapInArrow(place, "vec_id bigint, embedding array<float>, row bigint, cell int"))
    # two rows for each node of the sample's tree
    spans = {(r.node, r.side): (r.low, r.high) for r in placed.select("embedding").mapInArrow(measure, "node int, side int, low double, high double").groupBy("node", "side").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    for n, node in enumerate(top.nodes):
        if not isinstance(node, np.ndarray):
            top.nodes[n] = (node[0], node[1], *[(child, *spans.get((n, s), (np.inf, -np.inf))) for s, (child, _, _) in enumerate(node[2:])])
    top.x = None
    shared = ship(spark, (top, number))
    slices = placed.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("slices"))

    answer = "vec_id bigint, row bigint, factor double, ids array<bigint>, rows array<bigint>, ds array<double>"

    kinds = pa.schema([("vec_id", pa.int64()), ("row", pa.int64()), ("factor", pa.float64()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("ds", pa.list_(pa.float64()))])

    def search(queries: pa.Table, data: pa.Table) -> pa.Table:
        if not queries.num_rows or not data.num_rows:
            return kinds.empty_table()
        data = data.sort_by([("its_vec_id", "ascending"), ("its_row", "ascending")])
        x, q = _matrix(data.column("its_embedding"), dim), _matrix(queries.column("embedding"), dim)
        ids, numbers = data.column("its_vec_id").to_numpy(), data.column("its_row").to_numpy()
        s = Search(Tree(x, leaf), numbers, q, queries.column("row").to_numpy(), queries.column("radius").to_numpy(), k, queries.column("factor").to_numpy())
        found = s.at >= 0
        some = np.flatnonzero(found.any(axis=1))
        found, at, d = found[some], s.at[some], s.d[some]
        counts = found.sum(axis=1)
        own = [queries.column(c).combine_chunks().take(pa.array(some)) for c in ("vec_id", "row", "factor")]
        return pa.table([*own, list_array(ids[at[found]], counts, pa.int64()), list_array(numbers[at[found]], counts, pa.int64()), list_array(d[found], counts, pa.float64())], names=["vec_id", "row", "factor", "ids", "rows", "ds"])

    def ask(queries: DataFrame) -> DataFrame:
        """Answers of the shards of each query's ``cell``. What is broadcast is a row for each cell, ``MAX_CELLS`` at most."""
        load = F.broadcast(queries.groupBy("cell").agg(F.ceil(F.count("*") / visitors).cast("int").alias("parts")).join(F.broadcast(slices), "cell"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asked = queries.join(load, "cell").select("vec_id", "row", "factor", "embedding", "radius", "cell", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), each("slices").alias("slice"))
        held = placed.join(load, "cell").select(F.pmod(F.xxhash64("row"), F.col("slices")).cast("int").alias("its_slice"), each("parts").alias("its_part"), *[F.col(c).alias(f"its_{c}") for c in ("cell", "vec_id", "row", "embedding")])
        return asked.groupBy("cell", "slice", "part").cogroup(held.groupBy("its_cell", "its_slice", "its_part")).applyInArrow(search, answer)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number = unship(shared)
        for whole_batch in batches:
            for s in range(0, whole_batch.num_rows, 512):
                batch = whole_batch.slice(s, 512)
                home, first, now, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "first", "radius", "factor"))
                q, cell = visits(tree, number, _matrix(batch.column("embedding"), dim), home, first, None if np.isnan(now).any() else now, f)
                if len(q):
                    sent = batch.take(pa.array(q))
                    radius = np.where(np.isnan(now), first, now)[q]
                    yield pa.RecordBatch.from_arrays([*[sent.column(c) for c in ("vec_id", "row", "factor", "embedding")], pa.array(cell.astype(np.int32)), pa.array(radius)], names=["vec_id", "row", "factor", "embedding", "cell", "radius"])

    def merged(answers: DataFrame) -> DataFrame:
        flat = answers.select("vec_id", "row", "factor", F.explode(F.arrays_zip("ds", "ids", "rows")).alias("n"))
        best = flat.groupBy("vec_id", "row", "factor").agg(F.slice(F.array_sort(F.collect_list("n")), 1, k).alias("best"))
        return cut(best.select("vec_id", "row", "factor", *[F.col(f"best.{c}").alias(c) for c in ("ids", "rows", "ds")]))

    def best_of(asked: DataFrame) -> DataFrame:
        """The answers for ``asked``: rows of ``placed`` with the factor for each."""
        infinite = F.lit(float("inf"))
        best = merged(ask(asked.withColumn("radius", infinite)))
        if len(number) == 1:
            return best
        reach = lambda name: F.when(F.size("ds") < k, infinite).otherwise(F.element_at("ds", -1)).alias(name)
        kind = "vec_id bigint, row bigint, factor double, embedding array<float>, cell int, radius double"
        known = cut(asked.join(best.select("row", "factor", reach("first")), ["row", "factor"], "left").withColumn("first", F.coalesce("first", infinite)))
        columns = ("vec_id", "row", "factor", "embedding", "cell", "first")
        best = merged(best.unionAll(ask(cut(known.select(*columns, F.lit(float("nan")).alias("radius")).mapInArrow(spread, kind)))))
        later = known.join(best.select("row", "factor", reach("radius")), ["row", "factor"], "left").withColumn("radius", F.coalesce("radius", infinite))
        return merged(best.unionAll(ask(cut(later.select(*columns, "radius").mapInArrow(spread, kind)))))

    if factor is None:
        probes = placed.orderBy(F.xxhash64("row", "vec_id"), "row").limit(PROBES)
        factor = chosen(best_of(cut(probes.select("*", F.explode(F.array(*map(F.lit, FACTORS))).alias("factor")))).select("row", "factor", "ds").collect())
    best = best_of(placed.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("factor", F.lit(float(factor))))
    flat = best.select("vec_id", F.posexplode(F.arrays_zip("ids", "ds")).alias("rank", "n"))
    return flat.select("vec_id", F.col("n.ids").alias("neighbour_id"), (F.col("rank") + 1).cast("bigint").alias("rank"), F.round("n.ds", PLACES).alias("distance"))
