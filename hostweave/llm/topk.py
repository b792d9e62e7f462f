"""Exact inner-product search with cover trees on both sides.

Rows are dealt to the nearest of a few centres and, cell by cell, into blocks of bounded size;
every block gets a cover tree, stored once. Queries are rows of the same table and get trees of
their own, stored in groups. A task walks each of its data trees together with the query trees
of one group after the other and leaves out a pair of nodes when their centres and covering
radii allow no score as high as the worst kth score of the queries below the query node.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostweave.llm.tables import file_system, only, written
from hostweave.workspace import fresh_dir

#: Rows of a block, of a group of queries, of a leaf.
BLOCK, GROUP, LEAF = 2048, 8192, 32
#: Blocks that a task holds while it searches, about.
HELD = 64
#: Most cells; sampled rows for each, from which their centres are chosen.
CELLS, SAMPLED = 512, 8


class Node(NamedTuple):
    """Rows low to high of a tree, within ``radius`` of ``centre``; a leaf has no children."""

    low: int
    high: int
    centre: np.ndarray
    norm: float
    radius: float
    children: tuple


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = points - centre
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


def net(points: np.ndarray, first: int, distance: np.ndarray, radius: float, most: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Farthest-first centres until all points lie within ``radius`` of one; whose each point is, how far."""
    centres, owner, distance = [first], np.zeros(len(points), np.int64), distance.copy()
    while len(centres) < most and distance.max(initial=0.0) > radius:
        centres.append(int(distance.argmax()))
        to_new = _distances(points, points[centres[-1]])
        owner[to_new < distance] = len(centres) - 1
        distance = np.minimum(distance, to_new)
    return centres, owner, distance


def cover_tree(ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, Node]:
    """Ids and points in tree order, and the root. Children halve the covering radius of their
    parent, and their centres lie farther apart than that; points alone in theirs share a leaf."""
    order: list[int] = []

    def leaf(rows: np.ndarray, centre: np.ndarray, radius: float) -> Node:
        low = len(order)
        order.extend(rows[np.argsort(ids[rows], kind="stable")].tolist())
        return Node(low, len(order), centre, float(np.linalg.norm(centre)), radius, ())

    def node(rows: np.ndarray, first: int, distance: np.ndarray) -> Node:
        centre, radius = points[rows[first]], float(distance.max())
        if len(rows) <= LEAF or radius == 0:
            return leaf(rows, centre, radius)
        low = len(order)
        centres, owner, distance = net(points[rows], first, distance, radius / 2, len(rows))
        size = np.bincount(owner, minlength=len(centres))
        alone = size[owner] == 1
        children = [leaf(rows[alone], centre, radius)] if alone.any() else []
        for k in np.flatnonzero(size > 1):
            own = np.flatnonzero(owner == k)
            children.append(node(rows[own], int(np.searchsorted(own, centres[k])), distance[own]))
        return Node(low, len(order), centre, float(np.linalg.norm(centre)), radius, tuple(children))

    root = node(np.arange(len(ids)), 0, _distances(points, points[0]))
    return ids[order], points[order], root


def stored(tree: tuple[np.ndarray, np.ndarray, Node]) -> bytes:
    def plain(n: Node) -> tuple:
        return (*n[:-1], tuple(plain(c) for c in n.children))

    return pickle.dumps((tree[0], tree[1], plain(tree[2])))


def loaded(data: bytes) -> tuple[np.ndarray, np.ndarray, Node]:
    def node(n: tuple) -> Node:
        return Node(*n[:-1], tuple(node(c) for c in n[-1]))

    ids, points, root = pickle.loads(data)
    return ids, points, node(root)


class Best:
    """The k best (score, id) of each query: highest score, then smallest id; rows that repeat count each."""

    def __init__(self, count: int, k: int):
        self.score = np.full((count, k), -np.inf)
        self.id = np.full((count, k), np.iinfo(np.int64).max)

    def offer(self, low: int, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Scores of queries from ``low`` on with rows of these ascending ids; own: the queries' ids."""
        k = self.score.shape[1]
        wanted = (score >= self.score[low : low + len(score), -1:]) & (own[:, None] != ids)
        for q in np.flatnonzero(wanted.any(axis=1)):
            hit = np.flatnonzero(wanted[q])
            if len(hit) > k:  # the first k of the best, in order of id
                best = np.partition(score[q, hit], len(hit) - k)[len(hit) - k]
                hit = hit[score[q, hit] >= best]
                hit = hit[np.argsort(-score[q, hit], kind="stable")[:k]]
            s, i = np.concatenate((self.score[low + q], score[q, hit])), np.concatenate((self.id[low + q], ids[hit]))
            first = np.lexsort((i, -s))[:k]
            self.score[low + q], self.id[low + q] = s[first], i[first]


def dual_search(queries: tuple[np.ndarray, np.ndarray, Node], rows: tuple[np.ndarray, np.ndarray, Node], best: Best, base: int) -> int:
    """Offers to ``best`` (its queries from ``base`` on) all rows that can matter; pairs looked at."""
    (q_ids, q_points, q_root), (ids, points, root) = queries, rows

    def bound(q: Node, p: Node) -> float:
        return float(q.centre @ p.centre) + q.radius * p.norm + p.radius * q.norm + q.radius * p.radius

    stack, looked = [(bound(q_root, root), q_root, root)], 0
    while stack:
        high, q, p = stack.pop()
        # Scores are whole numbers: half of one covers the rounding of the bound; equal scores stay.
        if high < best.score[base + q.low : base + q.high, -1].min() - 0.5 - 1e-9 * abs(high):
            continue
        if not q.children and not p.children:
            looked += (q.high - q.low) * (p.high - p.low)
            best.offer(base + q.low, q_points[q.low : q.high] @ points[p.low : p.high].T, ids[p.low : p.high], q_ids[q.low : q.high])
        elif q.children and (not p.children or q.radius > p.radius):
            stack += sorted(((bound(c, p), c, p) for c in q.children), key=lambda x: x[0])
        else:
            stack += sorted(((bound(q, c), q, c) for c in p.children), key=lambda x: x[0])
    return looked


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Vectors as rows, shorter ones with zeros at the end."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(size.max(initial=0))), kind)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _wide(points: np.ndarray, width: int) -> np.ndarray:
    return points if points.shape[1] == width else np.pad(points, ((0, 0), (0, width - points.shape[1])))


def prepared(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and point (floor of ``scale`` times each component) of the vectors that take part."""
    x = F.col(vector_col)
    plain = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    point = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("double"))
    rows = only(vectors, id_col, vector_col).where(F.col(id_col).isNotNull() & x.isNotNull() & plain)
    return rows.select(F.col(id_col).cast("long").alias("id"), point.alias("point"))


def _in_cells(rows: DataFrame, count: int) -> DataFrame:
    """Rows with the cell of their nearest centre; centres are far apart in a sample by hash."""
    cells = max(1, min(CELLS, count // BLOCK))
    sample = rows.orderBy(F.xxhash64("id"), "id", "point").limit(cells * SAMPLED).select("point").toArrow()
    points = _matrix(sample["point"].combine_chunks())
    centres = points[net(points, 0, _distances(points, points[0]), 0.0, cells)[0]]

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column("point"))
            width = max(own.shape[1], centres.shape[1])
            at = _wide(centres, width)
            nearest = (_wide(own, width) @ at.T - (at**2).sum(axis=1) / 2).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], ["id", "point", "cell"])

    return rows.mapInArrow(assign, "id long, point array<double>, cell int")


def _trees(rows: DataFrame, size: int) -> DataFrame:
    """A row per block of about ``size`` rows of one cell: cell, part, n, tree. Cells are at most CELLS."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("_parts"))
    blocks = rows.join(F.broadcast(counts), "cell").withColumn("part", F.pmod(F.xxhash64("id", "point"), F.col("_parts")))

    def grow(block: pa.Table) -> pa.Table:
        tree = cover_tree(block["id"].to_numpy(), _matrix(block["point"].combine_chunks()))
        own = block.select(["cell", "part"]).slice(0, 1)
        return own.append_column("n", pa.array([len(tree[0])], pa.int64())).append_column("tree", pa.array([stored(tree)], pa.binary()))

    return blocks.select("cell", "part", "id", "point").groupBy("cell", "part").applyInArrow(grow, "cell int, part long, n long, tree binary")


def top_k(vectors: DataFrame, k: int, every: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The k best other rows of each row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    A score is the inner product of the vectors with components floor(scale * x): a whole number,
    exact where it is below 2**53 (else an error is raised). Ties go to the smaller id; all rows
    are listed if there are fewer than k. A vector that is null or holds a null or a component
    that is not finite takes no part, nor does a row without an id. Shorter vectors count as
    zero beyond their end; an empty one scores 0. Rows that share an id are not each other's
    candidates, and each of them is one to others: a row that repeats is listed as often. Query rows equal
    in all ask once; different vectors of one query id share its list. An empty table gives no row.
    """
    spark = vectors.sparkSession
    rows = written(prepared(vectors, id_col, vector_col, scale), "points")
    top = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("point", F.abs))).alias("m"), F.max(F.size("point")).alias("d")).first()
    if (top["m"] or 0) ** 2 * (top["d"] or 0) >= 2**53:
        raise ValueError("components too large for exact scores")
    schema = "query_id long, rank int, vec_id long, score long"
    if not top["n"]:
        return spark.createDataFrame([], schema)
    placed = written(_in_cells(rows, top["n"]), "cells")
    index = written(_trees(placed, BLOCK), "cover-trees")
    folder = fresh_dir(spark, "query-trees")
    queries = placed.where(F.col("id") % every == 0).distinct()
    trees = written(_trees(queries, BLOCK), "query-trees")
    groups = max(1, -(-(trees.agg(F.sum("n")).first()[0] or 0) // GROUP))
    grouped = trees.select("tree", F.pmod(F.xxhash64("cell", "part"), F.lit(groups)).alias("part"))
    grouped.repartition("part").write.partitionBy("part").parquet(folder)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [loaded(tree) for batch in batches for tree in batch.column("tree").to_pylist()]
        if not blocks:
            return
        system, path = file_system(folder)
        for part in system.get_file_info(fs.FileSelector(path)):
            if "part=" not in part.path:
                continue
            files = [f.path for f in system.get_file_info(fs.FileSelector(part.path)) if f.path.endswith(".parquet")]
            group = [loaded(t) for f in files for t in pq.ParquetFile(system.open_input_file(f)).read(["tree"])["tree"].to_pylist()]
            size = [len(q[0]) for q in group]
            best = Best(sum(size), k)
            width = max(x[1].shape[1] for x in (*blocks, *group))
            for query, base in zip(group, np.cumsum([0, *size[:-1]]).tolist(), strict=True):
                query = _widened(query, width)
                for block in blocks:
                    dual_search(query, _widened(block, width), best, base)
            own = np.concatenate([q[0] for q in group])
            found = ~np.isinf(best.score)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(own, found.sum(axis=1))), pa.array(best.id[found]), pa.array(best.score[found].astype(np.int64))],
                ["query_id", "vec_id", "score"],
            )

    many = index.count()
    tasks = max(1, min(many, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-many // HELD))))
    found = index.select("tree").repartition(tasks).mapInArrow(search, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _widened(tree: tuple[np.ndarray, np.ndarray, Node], width: int) -> tuple[np.ndarray, np.ndarray, Node]:
    if tree[1].shape[1] == width:
        return tree

    def wider(n: Node) -> Node:
        return n._replace(centre=np.pad(n.centre, (0, width - len(n.centre))), children=tuple(wider(c) for c in n.children))

    return tree[0], _wide(tree[1], width), wider(tree[2])


#: All scores of all queries, ranked.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.p AS DOUBLE[]), CAST(c.p AS DOUBLE[])) AS BIGINT) AS score
      FROM (SELECT DISTINCT vec_id, p FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
