"""Exact top-k by inner product with M-trees and best-first search.

An inner product is no metric, so vectors are lifted: with M the largest norm
of all, an object x gets one more component sqrt(M^2 - |x|^2) and a query gets
0 there.  Then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, a true distance whose order is
the reversed order of the scores.

The index is one M-tree in two parts.  Its top level has up to ``PIVOTS``
routing objects, chosen by farthest-first traversal from a bounded sample (the
``PIVOTS * SAMPLE`` rows with the smallest hashes of the id); every vector
belongs to the nearest, and a routing object's vectors are dealt into trees of
about ``TREE``.  A tree is stored as one row: paged nodes of up to ``PAGE``
objects, each with a routing object, a covering radius and its distance to the
parent's routing object, and leaf pages with every object's distance to the
page's routing object.

A search goes down twice.  First each query searches one tree of the nearest
routing object, which gives it a k-th score.  Then it searches those trees whose
covering radius lets a vector reach that score, and starts there from it, so
what comes out is what beats it.  Inside a tree, a queue holds nodes by the
best score they could hold, for a block of queries at once, each with its own
bound; a child, or an object of a leaf, is skipped without computing a distance
if |d(q, parent) - d(x, parent)| - radius already shows that it cannot reach the
k-th score found so far.  Bounds carry a slack over rounding errors, and only a
bound strictly under the k-th score prunes, so ties are kept and the scores
themselves, whole numbers, are exact.

Queries and trees meet by the tree's key.  A tree that many queries ask is
copied once for each block of queries, so no key gathers more than a block.
Vectors spread evenly over many dimensions leave no bound to prune by; then
every query meets every tree, which is what an exact search costs there.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, cut

TREE = 1024
PAGE = 32
FANOUT = 8
PIVOTS = 256
SAMPLE = 16
QUERIES_A_BLOCK = 256
SCALE = 64
SLACK = 1e-2


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float = SCALE) -> DataFrame:
    """``id, v``: components floor(scale * x) as doubles; vectors that are null or hold null or non-finite components are left out."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    plain = df.select(F.col(id_col).cast("long").alias("id"), x.alias("v")).where("v is not null and id is not null").where(~F.coalesce(bad, F.lit(False)))
    return plain.select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("v"))


def lifts(vectors: np.ndarray, top: float) -> np.ndarray:
    """The component that brings every vector's norm to ``sqrt(top)``."""
    return np.sqrt(np.maximum(top - np.einsum("ij,ij->i", vectors, vectors), 0.0))


def farthest_first(vectors: np.ndarray, lift: np.ndarray, many: int) -> tuple[list[int], np.ndarray]:
    """Numbers of up to ``many`` objects, each the farthest from those before it, and the place among them of every object's nearest."""
    chosen, owner = [0], np.zeros(len(vectors), np.int64)
    nearest = ((vectors - vectors[0]) ** 2).sum(1) + (lift - lift[0]) ** 2
    while len(chosen) < many:
        far = int(nearest.argmax())
        if nearest[far] == 0:
            break
        d = ((vectors - vectors[far]) ** 2).sum(1) + (lift - lift[far]) ** 2
        closer = d < nearest
        nearest, owner = np.where(closer, d, nearest), np.where(closer, len(chosen), owner)
        chosen.append(far)
    return chosen, owner


class Tree:
    """A tree in arrays.  Node 0 is the root; a node's members are nodes or, in a leaf, objects.  ``computed`` counts the distances of its searches."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, route: np.ndarray | None = None, page: int = PAGE, fanout: int = FANOUT):
        self.ids, self.vectors, self.top, self.computed = ids, vectors, top, 0
        self.lift = lifts(vectors, top)
        self.routes: list[np.ndarray] = []
        self.members: list[np.ndarray] = []
        self.to_parent: list[np.ndarray] = []
        self.radius: list[np.ndarray | float] = []  # of a node itself, while building
        self.leaf: list[bool] = []
        if len(ids):
            self._build(np.arange(len(ids)), vectors[0] if route is None else route, page, fanout)
        self.child_radius = [None if leaf else np.array([self.radius[c] for c in m]) for leaf, m in zip(self.leaf, self.members, strict=True)]

    def _distances(self, route: np.ndarray, vectors: np.ndarray, lift: np.ndarray) -> np.ndarray:
        return np.sqrt(((vectors - route) ** 2).sum(1) + (lift - lifts(route[None, :], self.top)[0]) ** 2)

    def _build(self, objects: np.ndarray, route: np.ndarray, page: int, fanout: int) -> int:
        number = len(self.routes)
        distance = self._distances(route, self.vectors[objects], self.lift[objects])
        self.routes.append(route)
        self.radius.append(float(distance.max()))
        for column in (self.members, self.to_parent, self.leaf):
            column.append(None)
        if len(objects) <= page:
            order = np.argsort(distance, kind="stable")
            self.members[number], self.to_parent[number], self.leaf[number] = objects[order], distance[order], True
            return number
        chosen, owner = farthest_first(self.vectors[objects], self.lift[objects], min(fanout, -(-len(objects) // page) + 1))
        if len(chosen) == 1:  # all objects alike: cut evenly
            pieces = np.array_split(objects, min(fanout, -(-len(objects) // page)))
        else:
            pieces = [objects[owner == k] for k in range(len(chosen))]
        heads = [self.vectors[objects[c]] for c in chosen] if len(chosen) > 1 else [self.vectors[p[0]] for p in pieces]
        children = [self._build(p, h, page, fanout) for p, h in zip(pieces, heads, strict=True) if len(p)]
        self.members[number], self.leaf[number] = np.array(children), False
        heads = np.array([self.routes[c] for c in children])
        self.to_parent[number] = self._distances(route, heads, lifts(heads, self.top))
        return number

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids, ``k`` a query in order (score -inf where there are fewer), besides the query's own id; only scores of ``least`` or more are looked for."""
        many = len(queries)
        scores, names = np.full((many, k), -np.inf), np.full((many, k), np.iinfo(np.int64).max)
        least = np.full(many, -np.inf) if least is None else least
        if not len(self.ids) or not many or queries.shape[1] != self.vectors.shape[1] or k < 1:
            return scores, names
        square = np.einsum("ij,ij->i", queries, queries) + self.top

        def to_routes(which: np.ndarray, routes: np.ndarray) -> np.ndarray:
            self.computed += len(which) * len(routes)
            return np.sqrt(np.maximum(square[which, None] - 2 * (queries[which] @ routes.T), 0.0))

        def limit(which: np.ndarray) -> np.ndarray:
            """The largest distance at which the k-th score can still be met."""
            return np.sqrt(np.maximum(square[which] - 2 * (np.maximum(least[which], scores[which, -1]) - SLACK), 0.0))

        everyone = np.arange(many)
        d = to_routes(everyone, self.routes[0][None, :])[:, 0]
        reach = (square - np.maximum(d - self.radius[0], 0.0) ** 2) / 2 + SLACK
        queue = [(-float(reach.max()), 0, everyone, d, reach)]
        while queue:
            _, node, which, d, reach = heapq.heappop(queue)
            open_ = reach >= np.maximum(least[which], scores[which, -1])
            if not open_.any():
                continue
            which, d = which[open_], d[open_]
            members = self.members[node]
            gap = np.abs(d[:, None] - self.to_parent[node][None, :]) - (0 if self.leaf[node] else self.child_radius[node])
            near = gap <= limit(which)[:, None]
            rows, columns = near.any(1), near.any(0)
            which, members, near = which[rows], members[columns], near[rows][:, columns]
            if not len(members):
                continue
            if not self.leaf[node]:
                radius = self.child_radius[node][columns]
                far = to_routes(which, np.array([self.routes[c] for c in members]))
                reach = (square[which, None] - np.maximum(far - radius, 0.0) ** 2) / 2 + SLACK
                near &= reach >= np.maximum(least[which], scores[which, -1])[:, None]
                for c, child in enumerate(members.tolist()):
                    pick = near[:, c]
                    if pick.any():
                        heapq.heappush(queue, (-float(reach[pick, c].max()), child, which[pick], far[pick, c], reach[pick, c]))
                continue
            self.computed += len(which) * len(members)
            found = queries[which] @ self.vectors[members].T
            found[self.ids[members][None, :] == own[which, None]] = -np.inf
            found[found < np.maximum(least[which], scores[which, -1])[:, None]] = -np.inf
            better = (found > -np.inf).any(1)
            which, found = which[better], found[better]
            if len(which):
                both = np.concatenate((scores[which], found), 1)
                both_names = np.concatenate((names[which], np.broadcast_to(self.ids[members], found.shape)), 1)
                both_names[both == -np.inf] = np.iinfo(np.int64).max
                order = np.lexsort((both_names, -both), axis=1)[:, :k]
                scores[which], names[which] = np.take_along_axis(both, order, 1), np.take_along_axis(both_names, order, 1)
        return scores, names


def _rows(batch: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    column = batch.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of each batch by the length of their vectors."""
    for batch in batches:
        sizes = np.asarray(batch.column("v").value_lengths())
        for dim in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == dim))
            yield dim, part, _rows(part, dim)


def choose_pivots(vectors: DataFrame, top: float, pivots: int, sample: int) -> dict[int, np.ndarray]:
    """Routing objects of the top level by length of vector, ``pivots`` in all at most; lengths that the sample misses have none."""
    drawn = vectors.select("id", "v", F.xxhash64("id").alias("h")).orderBy("h", "id", "v").limit(pivots * sample).collect()
    lists: dict[int, list[list[float]]] = {}
    for r in drawn:
        lists.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for dim, rows in lists.items():
        grid = np.array(rows, dtype=np.float64)
        chosen, _ = farthest_first(grid, lifts(grid, top), max(1, pivots * len(rows) // len(drawn)))
        out[dim] = grid[chosen]
    return out


def _cells(vectors: DataFrame, pivots: dict[int, np.ndarray], top: float) -> DataFrame:
    """``id, v, dim, cell``: every vector with its nearest pivot, or -1 where its length has none."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, rows in _by_dim(batches):
            cell = np.full(len(rows), -1)
            if dim in shared.value:
                routes = shared.value[dim]
                square = np.einsum("ij,ij->i", routes, routes) / 2
                near = rows @ routes.T + lifts(rows, top)[:, None] * lifts(routes, top)[None, :] - (square + lifts(routes, top) ** 2 / 2)
                cell = near.argmax(1)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(np.full(len(rows), dim, np.int32)), pa.array(cell.astype(np.int32))], ["id", "v", "dim", "cell"])

    return arrow_map(vectors.select("id", "v"), "id bigint, v array<double>, dim int, cell int", step)


def build_trees(vectors: DataFrame, pivots: dict[int, np.ndarray], top: float, tree: int = TREE, page: int = PAGE) -> DataFrame:
    """``dim, cell, part, n, radius, tree``: pickled trees of about ``tree`` vectors, below the pivots; cut."""
    placed = cut(_cells(vectors, pivots, top))
    sizes = cut(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / tree).cast("int").alias("parts")))
    dealt = placed.join(sizes, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int").alias("part"), "id", "v")
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def step(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        dim, cell = key[0].as_py(), key[1].as_py()
        rows = _rows(group, dim)
        built = Tree(group.column("id").to_numpy(), rows, top, shared.value[dim][cell] if cell >= 0 else None, page)
        radius = built.radius[0] if cell >= 0 else float("inf")
        return pa.table({"dim": [dim], "cell": [cell], "part": [key[2].as_py()], "n": [len(rows)], "radius": [radius], "tree": [pickle.dumps(built)]}, schema=kind)

    kind = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("radius", pa.float64()), ("tree", pa.binary())])
    return cut(dealt.groupBy("dim", "cell", "part").applyInArrow(step, "dim int, cell int, part int, n bigint, radius double, tree binary"))


def _asked(queries: DataFrame, cells: DataFrame, pivots: dict[int, np.ndarray], top: float, k: int, first: bool) -> DataFrame:
    """``query_id, v, dim, cell, far, least``: the top level's answer, with each query's distance to the routing object.

    ``first`` asks for the nearest one that has more than ``k`` vectors, else for all that can reach ``least``.
    """
    spark = queries.sparkSession
    known = {}
    for r in cells.where("cell >= 0").collect():  # at most as many as there are pivots
        known.setdefault(r["dim"], []).append((r["cell"], r["n"], r["radius"]))
    shared = spark.sparkContext.broadcast((pivots, {dim: tuple(np.array(x) for x in zip(*sorted(rows), strict=True)) for dim, rows in known.items()}))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes, top_level = shared.value
        for dim, part, rows in _by_dim(batches):
            least = part.column("least").to_numpy()
            if dim in top_level:
                numbers, sizes, radius = top_level[dim]
                square = np.einsum("ij,ij->i", rows, rows)[:, None] + top
                far = np.sqrt(np.maximum(square - 2 * (rows @ routes[dim][numbers].T), 0.0))
                if first:
                    owner, at = np.arange(len(rows)), np.where(sizes > k, far, far + 1e9).argmin(1)
                else:
                    owner, at = np.nonzero((square - np.maximum(far - radius, 0.0) ** 2) / 2 + SLACK >= least[:, None])
                cell, distance = numbers[at], far[owner, at]
            else:
                owner, cell, distance = np.arange(len(rows)), np.full(len(rows), -1), np.zeros(len(rows))
            for a in range(0, len(owner), 4096):
                pick = pa.array(owner[a : a + 4096])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pick), part.column("v").take(pick), pa.array(np.full(len(pick), dim, np.int32)), pa.array(cell[a : a + 4096].astype(np.int32)), pa.array(distance[a : a + 4096]), part.column("least").take(pick)],
                    ["query_id", "v", "dim", "cell", "far", "least"],
                )

    return arrow_map(queries.select("id", "v", "least"), "query_id bigint, v array<double>, dim int, cell int, far double, least double", step)


def _met(asked: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score``: what each meeting of a query and a tree (``dim, cell, part``) gives, ``k`` rows at most."""
    keys = ["dim", "cell", "part"]
    salts = cut(asked.groupBy(*keys).agg(F.ceil(F.count("*") / QUERIES_A_BLOCK).cast("int").alias("salts")))
    left = asked.join(salts, keys).withColumn("salt", F.pmod(F.xxhash64("query_id"), F.col("salts")).cast("int")).select(*(F.col(c).alias(c) for c in keys), "salt", "query_id", "v", "least")
    copies = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    right = trees.join(salts, keys).select(*(F.col(c).alias(c) for c in keys), copies, "tree")  # new names: both sides may come from the directory
    kind = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def step(key: tuple[pa.Scalar, ...], some: pa.Table, blobs: pa.Table) -> pa.Table:
        if not some.num_rows or not blobs.num_rows:
            return kind.empty_table()
        own = some.column("query_id").to_numpy()
        scores, names = pickle.loads(blobs.column("tree")[0].as_py()).search(_rows(some, key[0].as_py()), own, k, some.column("least").to_numpy())
        owner, place = np.nonzero(scores > -np.inf)
        return pa.table([pa.array(own[owner]), pa.array(names[owner, place]), pa.array(scores[owner, place].astype(np.int64))], schema=kind)

    keys.append("salt")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(step, "query_id bigint, id bigint, score bigint")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, tree: int = TREE, page: int = PAGE, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, id, score``: exact k best inner products of each query among all vectors but its own id.

    Both inputs are ``id long, v array<double>`` with whole components (see
    ``whole_vectors``); scores are exact below 2**53.  Defined cases: vectors of
    another length than the query's, and empty vectors, are no candidates; rows
    that repeat an id are separate candidates; of queries that repeat an id the
    smallest vector asks; ties go to the smaller id; an empty table gives no
    rows.
    """
    vectors = vectors.where(F.size("v") > 0)
    ends = vectors.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)).alias("top")).first()
    top = float(ends["top"] or 0.0)
    routes = choose_pivots(vectors, top, max(1, min(pivots, -(-ends["n"] // tree))), SAMPLE) if ends["n"] else {}
    trees = build_trees(vectors, routes, top, tree, page)
    directory = trees.select("dim", "cell", "part", "n", "radius")
    cells = cut(directory.groupBy("dim", "cell").agg(F.max("n").alias("n"), F.max("radius").alias("radius"), F.count("*").cast("int").alias("parts")))
    single = cut(queries.groupBy("id").agg(F.min("v").alias("v")).where(F.size("v") > 0))
    nearest = _asked(single.withColumn("least", F.lit(float("-inf"))), cells, routes, top, k, first=True)
    parts = cells.select("dim", "cell", "parts")
    nearest = cut(nearest.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts"))
    found = cut(_met(nearest, trees, k))
    bound = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
    bounded = single.join(bound, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce(F.col("bound").cast("double"), F.lit(float("-inf"))).alias("least"))
    others = _asked(cut(bounded), cells, routes, top, k, first=False).join(directory.drop("n"), ["dim", "cell"])
    square = F.aggregate("v", F.lit(top), lambda acc, x: acc + x * x)
    others = others.where((square - F.pow(F.greatest(F.col("far") - F.col("radius"), F.lit(0.0)), F.lit(2.0))) / 2 + SLACK >= F.col("least"))
    others = cut(others.join(nearest.select("query_id", "dim", "cell", "part"), ["query_id", "dim", "cell", "part"], "left_anti"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    both = found.unionByName(_met(others, trees, k))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"))
    out = top_k(rows, rows.where(F.col("id") % 20 == 0), 20)
    return out.withColumnRenamed("id", "vec_id")


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
  where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
