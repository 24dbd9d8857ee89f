"""Nearest vectors by cosine: vantage-point trees, one per shard, searched with relaxed triangle-inequality pruning.

The distance of two vectors is that of their directions on the unit sphere, sqrt(2 - 2 cos), a metric that orders
vectors as the cosine does.

1. A top tree fitted on a sample of at most ``SAMPLE`` rows (those of smallest hash) cuts space into cells; every row is routed
   to its cell. A cell of more rows than a shard holds is spread over several shards by vec_id, so no vector, however
   often repeated, makes a large shard. Each shard becomes one index row with its own vantage-point tree.
2. Each query searches the shards of its own cell; the distance of its k-th find bounds what can still improve.
3. It then visits the cells that the bound does not exclude, by the least and largest distance of their rows to
   each vantage point of the top tree, and in them the branches that it does not exclude.

A branch whose distance is at least ``gap`` is left out if factor * gap is above the bound: 1 is exact search, a larger factor visits less.

Defined cases: vectors that are null, all zero, or hold a null or a non-finite component take no part, nor do rows without a
vec_id. Shorter vectors count as padded by zeros. A row with the query's vec_id is never its candidate; rows repeated
with vec_id and vector count once, and of several vectors under one vec_id the first in array order is the query. Ties go
to the smaller vec_id. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.llm.shared import stored

SAMPLE = 4096
SHARD_VALUES = 1 << 19
SHARD_ROWS = 8192
QUERY_BLOCK = 1024
LEAF = 64
# Rounding of sqrt(2 - 2 cos) for directions that are almost equal.
SLACK = 1e-7
FACTOR = 1.5

FOUND = "query_id long, vec_id long, score double"
INDEX = "shard long, cell int, ids binary, vectors binary, nodes binary, low array<double>, high array<double>"
NODE = np.dtype([
    ("point", np.int64), ("start", np.int64), ("end", np.int64), ("left", np.int64), ("right", np.int64),
    ("near_low", float), ("near_high", float), ("far_low", float), ("far_high", float),
])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, in double precision."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    return rows.where(~bad).where(F.exists("vector", lambda x: x != 0.0))


def as_matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows padded to width by zeros and scaled by powers of two, which changes no cosine and avoids overflow."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        rows = flat.reshape(-1, width).copy()
    else:
        rows = np.zeros((len(sizes), width))
        starts = np.cumsum(sizes) - sizes
        rows[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    scale = np.frexp(np.abs(rows).max(axis=1, initial=0.0))[1]
    return np.ldexp(rows, -scale[:, None])


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(-1))


def cosines(a: np.ndarray, b: np.ndarray, b_lengths: np.ndarray | None = None) -> np.ndarray:
    """Of every row of a with every row of b. Each pair is summed alone, so equal rows give equal values wherever they stand."""
    step = max(1, (1 << 18) // max(1, b.size))
    dots = [(a[s : s + step, None, :] * b[None, :, :]).sum(-1) for s in range(0, len(a), step)]
    whole = np.concatenate(dots) if dots else np.zeros((0, len(b)))
    return whole / (lengths(a)[:, None] * (lengths(b) if b_lengths is None else b_lengths)[None, :])


def distances(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def grown(rows: np.ndarray, leaf: int, depth: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and nodes of a vantage-point tree; a node covers rows start to end of that order.

    The vantage point is the row farthest from the node's first one, the cut the median distance to it. A node
    of few rows, or whose rows are all equally far, is a leaf (left = -1).
    """
    order, nodes, todo = np.arange(len(rows)), [], [(0, len(rows), 0, -1, "")]
    while todo:
        start, end, level, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][side] = at
        node = {"point": -1, "start": start, "end": end, "left": -1, "right": -1, "near_low": 0.0, "near_high": 0.0, "far_low": 0.0, "far_high": 0.0}
        nodes.append(node)
        own = order[start:end]
        if len(own) <= leaf or level >= depth:
            continue
        point = own[distances(cosines(rows[own[:1]], rows[own]))[0].argmax()]
        away = distances(cosines(rows[point : point + 1], rows[own]))[0]
        sort = np.argsort(away, kind="stable")
        own, away = own[sort], away[sort]
        cut = int(np.searchsorted(away, away[len(away) // 2], "left")) or int(np.searchsorted(away, away[0], "right"))
        if cut >= len(away):
            continue
        order[start:end] = own
        node |= {"point": int(point), "near_low": away[0], "near_high": away[cut - 1], "far_low": away[cut], "far_high": away[-1]}
        todo += [(start + cut, end, level + 1, at, "right"), (start, start + cut, level + 1, at, "left")]
    table = np.zeros(len(nodes), NODE)
    for name in NODE.names:
        table[name] = [n[name] for n in nodes]
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows))
    inner = table["point"] >= 0
    table["point"][inner] = place[table["point"][inner]]
    return order, table


@dataclass(frozen=True)
class Cells:
    """The top tree: its vantage points, and for each the cut and what follows on either side."""

    width: int
    points: np.ndarray
    cuts: np.ndarray
    near: np.ndarray  # the next vantage point, or -1 - cell
    far: np.ndarray

    @property
    def count(self) -> int:
        return len(self.points) + 1

    def routed(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row, and its distances to all vantage points."""
        away = distances(cosines(rows, self.points)) if len(self.points) else np.zeros((len(rows), 0))
        at = np.zeros(len(rows), np.int64) if len(self.points) else np.full(len(rows), -1, np.int64)
        while (at >= 0).any():
            inner = np.flatnonzero(at >= 0)
            node = at[inner]
            at[inner] = np.where(away[inner, node] < self.cuts[node], self.near[node], self.far[node])
        return -1 - at, away


def fitted_cells(rows: DataFrame, least_width: int = 1, shard_rows: int | None = None) -> Cells:
    """The top tree for rows, with about one cell for each shard as far as the sample allows."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = max(size["width"] or 1, least_width)
    per_shard = shard_rows or shard_size(width)
    sample = max(64, min(SAMPLE, (1 << 22) // width))
    wanted = min(sample // 16, -(-size["n"] // per_shard))
    if wanted < 2:
        none = np.zeros(0, np.int64)
        return Cells(width, np.zeros((0, width)), np.zeros(0), none, none)
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample).select("vector").toArrow()  # at most 4 M values
    seen = as_matrix(taken.column("vector").combine_chunks(), width)
    order, nodes = grown(seen, leaf=1, depth=int(np.ceil(np.log2(wanted))))
    inner = np.flatnonzero(nodes["left"] >= 0)
    number = np.full(len(nodes), -1)
    number[inner] = np.arange(len(inner))
    leaves = np.flatnonzero(nodes["left"] < 0)
    number[leaves] = -1 - np.arange(len(leaves))
    held = nodes[inner]
    return Cells(width, seen[order][held["point"]], held["far_low"], number[held["left"]], number[held["right"]])


def shard_size(width: int) -> int:
    return max(64, min(SHARD_ROWS, SHARD_VALUES // width))


def placed(rows: DataFrame, cells: Cells) -> DataFrame:
    """(vec_id, vector, cell), vectors padded and scaled."""

    def route(batches):
        for batch in batches:
            found = as_matrix(batch.column("vector"), cells.width)
            cell = np.concatenate([cells.routed(found[a : a + 4096])[0] for a in range(0, len(found), 4096)]) if len(found) else np.zeros(0)
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), cells.width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vectors, pa.array(cell.astype(np.int32))], names=["vec_id", "vector", "cell"])

    return rows.mapInArrow(route, "vec_id long, vector array<double>, cell int")


def per_cell(counts: dict[int, int], cells: Cells, most: int) -> list[int]:
    """How many parts of at most ``most`` rows each cell needs."""
    return [max(1, -(-counts.get(c, 0) // most)) for c in range(cells.count)]


def of_cell(values: list[int]) -> Column:
    """The value of a row's cell; one number for each cell, of which the sample allows few."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cell") + 1)


def indexed(rows: DataFrame, cells: Cells, shard_rows: int | None = None) -> DataFrame:
    """One row for each shard: its vec_ids and vectors in tree order, the tree, and the reach of its rows from the top tree's points."""
    rows = stored(placed(rows, cells))
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # one row for each cell
    parts = per_cell(counts, cells, shard_rows or shard_size(cells.width))
    starts = [sum(parts[:c]) for c in range(len(parts))]
    shard = (of_cell(starts) + F.pmod(F.xxhash64("vec_id"), of_cell(parts))).cast("long")

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("vec_id").to_numpy()
        found = as_matrix(table.column("vector").combine_chunks(), cells.width)
        keyed = np.concatenate([ids[:, None], found.view(np.int64)], axis=1)
        keep = np.sort(np.unique(keyed, axis=0, return_index=True)[1])
        ids, found = ids[keep], found[keep]
        sort = np.argsort(ids, kind="stable")
        ids, found = ids[sort], found[sort]
        order, nodes = grown(found, LEAF)
        away = cells.routed(found)[1]
        row = {
            "shard": [table.column("shard")[0].as_py()], "cell": [table.column("cell")[0].as_py()], "ids": [ids[order].tobytes()],
            "vectors": [found[order].tobytes()], "nodes": [nodes.tobytes()], "low": [away.min(axis=0)], "high": [away.max(axis=0)],
        }
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3, *[pa.list_(pa.float64())] * 2]
        return pa.table({name: pa.array(value, kind) for (name, value), kind in zip(row.items(), kinds, strict=True)})

    return stored(rows.withColumn("shard", shard).groupBy("shard").applyInArrow(build, INDEX))


class Search:
    """Queries against one shard: the k best of each so far, and the distance that a better one must keep under."""

    def __init__(self, index: dict, width: int, k: int, factor: float):
        self.ids = np.frombuffer(index["ids"], np.int64)
        self.rows = np.frombuffer(index["vectors"], float).reshape(-1, width)
        self.nodes = np.frombuffer(index["nodes"], NODE)
        self.lengths = lengths(self.rows)
        self.units = self.rows / self.lengths[:, None]
        self.k, self.factor = k, factor

    def run(self, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query k vec_ids and scores, best first; what is missing has the score -inf."""
        self.own, self.queries, self.bound = ids, queries, bound.copy()
        self.query_lengths = lengths(queries)
        self.directions = queries / self.query_lengths[:, None]
        self.best = np.full((len(ids), self.k), np.iinfo(np.int64).max)
        self.score = np.full((len(ids), self.k), -np.inf)
        self.visit(0, np.arange(len(ids)))
        return self.best, self.score

    def visit(self, at: int, who: np.ndarray) -> None:
        if not len(who):
            return
        node = self.nodes[at]
        if node["left"] < 0:
            for a in range(int(node["start"]), int(node["end"]), 512):  # a leaf of equal rows may be long
                self.scan(a, min(a + 512, int(node["end"])), who)
            return
        away = distances(self.directions[who] @ self.units[node["point"]])
        near = np.maximum(node["near_low"] - away, away - node["near_high"])
        far = np.maximum(node["far_low"] - away, away - node["far_high"])
        first = near <= far
        for turn in (True, False):
            for child, gap, mine in (("left", near, first == turn), ("right", far, first != turn)):
                open_ = mine & (self.factor * gap <= self.bound[who] + SLACK)
                self.visit(int(node[child]), who[open_])

    def scan(self, start: int, end: int, who: np.ndarray) -> None:
        """Take the rows of a leaf into the best. One matrix product finds the few pairs that may improve; they are summed exactly."""
        about = self.directions[who] @ self.units[start:end].T
        q, x = np.nonzero(about >= self.score[who, -1][:, None] - SLACK)
        x += start
        other = self.ids[x] != self.own[who[q]]
        q, x = q[other], x[other]
        score = (self.queries[who[q]] * self.rows[x]).sum(-1) / (self.query_lengths[who[q]] * self.lengths[x])
        asked, counts = np.unique(q, return_counts=True)
        if not len(asked):
            return
        mine = who[asked]
        place = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
        row = np.repeat(np.arange(len(asked)), counts)
        ids = np.full((len(asked), self.k + counts.max()), np.iinfo(np.int64).max)
        both = np.full(ids.shape, -np.inf)
        ids[:, : self.k], both[:, : self.k] = self.best[mine], self.score[mine]
        ids[row, self.k + place], both[row, self.k + place] = self.ids[x], score
        keep = np.lexsort((ids, -both))[:, : self.k]
        self.best[mine], self.score[mine] = np.take_along_axis(ids, keep, 1), np.take_along_axis(both, keep, 1)
        worst = self.score[mine, -1]
        full = np.isfinite(worst)
        self.bound[mine[full]] = np.minimum(self.bound[mine[full]], distances(worst[full]))


def searched(visits: DataFrame, index: DataFrame, cells: Cells, k: int, factor: float) -> DataFrame:
    """(query_id, vec_id, score): the best k of each visited cell's shards for (query_id, vector, bound, cell)."""
    counts = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}  # one row for each cell
    blocks = per_cell(counts, cells, QUERY_BLOCK)
    asked = visits.withColumn("block", F.pmod(F.xxhash64("query_id"), of_cell(blocks)).cast("int"))
    wanted = index.where(F.col("cell").isin(sorted(counts)))
    shards = wanted.select("shard", "cell", "ids", "vectors", "nodes", F.explode(F.sequence(F.lit(0), of_cell(blocks) - 1)).alias("block"))
    # Queries go to every shard of their cell; shards are numbered cell by cell.
    span = index.groupBy("cell").agg(F.min("shard").alias("first"), F.max("shard").alias("last"))
    spans = {r["cell"]: (r["first"], r["last"]) for r in span.collect()}  # one row for each cell
    first = of_cell([spans.get(c, (1, 0))[0] for c in range(cells.count)])
    last = of_cell([spans.get(c, (1, 0))[1] for c in range(cells.count)])
    asked = asked.where(first <= last).withColumn("shard", F.explode(F.sequence(first.cast("long"), last.cast("long")))).drop("cell")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            tree = Search({n: right.column(n)[0].as_py() for n in ("ids", "vectors", "nodes")}, cells.width, k, factor)
            ids = left.column("query_id").to_numpy()
            queries = as_matrix(left.column("vector").combine_chunks(), cells.width)
            best, score = tree.run(ids, queries, left.column("bound").to_numpy())
            held = np.isfinite(score)
            found = [np.repeat(ids, held.sum(1)), best[held], score[held]]
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    return asked.groupBy("shard", "block").cogroup(shards.groupBy("shard", "block")).applyInArrow(search, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = FACTOR, shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found among vectors for each row of queries.

    Both tables have vec_id and embedding; a row of vectors with the query's vec_id is the query itself.
    """
    if factor < 1:
        raise ValueError("factor is 1 (exact) or more")
    rows = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    cells = fitted_cells(rows, asked.agg(F.max(F.size("vector"))).first()[0] or 1, shard_rows)
    index = indexed(rows, cells, shard_rows)
    home = stored(placed(asked, cells).withColumnRenamed("vec_id", "query_id"))
    near = stored(searched(home.withColumn("bound", F.lit(float("inf"))), index, cells, k, factor))
    # The k-th best so far; with fewer finds everything can still improve.
    bound = best(near, k).where(F.col("rank") == k).select("query_id", "score")
    reach = index.select("cell", F.posexplode(F.arrays_zip("low", "high"))).groupBy("cell", "pos").agg(
        F.min("col.low").alias("low"), F.max("col.high").alias("high")
    ).collect() if len(cells.points) else []  # cells x vantage points, both bounded by the sample
    low, high = (np.full((cells.count, len(cells.points)), v) for v in (np.inf, -np.inf))
    for r in reach:
        low[r["cell"], r["pos"]], high[r["cell"], r["pos"]] = r["low"], r["high"]

    def onward(batches):
        for batch in batches:
            found = as_matrix(batch.column("vector"), cells.width)
            score = batch.column("score").to_numpy(zero_copy_only=False).astype(float)
            limit = np.where(np.isnan(score), np.inf, distances(np.nan_to_num(score)))
            home_cell = batch.column("cell").to_numpy()
            rows, others = [], []
            for q in range(len(found)):
                away = cells.routed(found[q : q + 1])[1]
                gap = np.maximum(low - away, away - high).max(axis=1)
                open_ = np.flatnonzero((factor * gap <= limit[q] + SLACK) & (np.arange(cells.count) != home_cell[q]))
                rows.append(np.full(len(open_), q))
                others.append(open_)
            rows = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(rows), batch.column("vector").take(rows), pa.array(limit).take(rows),
                 pa.array(np.concatenate(others) if others else [], pa.int32())],
                names=["query_id", "vector", "bound", "cell"],
            )

    if len(cells.points):
        visits = home.join(bound, "query_id", "left").mapInArrow(onward, "query_id long, vector array<double>, bound double, cell int")
        near = near.union(searched(stored(visits), index, cells, k, factor))
    return best(near.distinct(), k)
