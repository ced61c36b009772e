"""Exact near-duplicate embeddings by dual traversal of cover trees.

Unit vectors at cosine c are sqrt(2 - 2c) apart, so cosine >= threshold is a distance bound. The rows of equal
vectors are one class. The top of the tree is a set of far-apart centres chosen from at most SAMPLE vectors; every
vector belongs to its nearest centre's cell, and cells of more than BLOCK vectors are dealt into blocks. Within a
block nested nets of radii 1, 1/2, 1/4 and 1/8 are built, each node knowing its covering radius. Two blocks, and in
them two nodes of a level, are passed over where their centres are farther apart than both covering radii and the
bound together; what is left goes down a level, to single vectors at last, which are compared in double precision.
A pair of blocks gives counts of links and a spanning forest of them, never the pairs, so a group of n near copies
gives about n rows.

Edge cases. A null, zero or empty vector, or one with a null or non-finite component, links with nothing, is its own
component and kept; vectors of different dimension do not link. Repeated rows, rows that share an id and equal vectors
are linked with each other as any rows are. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Vectors of a block; vectors that the centres are chosen from, by least hash.
BLOCK, SAMPLE = 8192, 4096
RADII = (1.0, 0.5, 0.25, 0.125)
_CHUNK = 512
_SLACK = 1e-9


def far_apart(x: np.ndarray, k: int) -> np.ndarray:
    """k rows, each farthest from those before it."""
    out = [0]
    nearest = x @ x[0]
    while len(out) < min(k, len(x)):
        out.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[out[-1]])
    return x[out]


class Tree:
    """Nested nets over unit vectors: levels[k] = (centre of each node, covering radius, first child, end of children).

    Rows are reordered so that the children of a node, and at last its vectors, stand together (`order`)."""

    def __init__(self, x: np.ndarray, radii: tuple[float, ...] = RADII):
        groups = [np.arange(len(x))]
        levels = []
        for radius in radii:
            after, bounds = [], [0]
            for members in groups:
                after += self._net(x, members, radius)
                bounds.append(len(after))
            levels.append(bounds)
            groups = after
        self.order = np.concatenate(groups) if groups else np.zeros(0, int)
        ends = np.concatenate(([0], np.cumsum([len(g) for g in groups]))).astype(int)
        starts = [ends]
        for bounds in reversed(levels[1:]):
            starts.insert(0, starts[0][np.array(bounds)])
        self._measure(x[self.order], starts)

    def _measure(self, x: np.ndarray, starts: list[np.ndarray]) -> None:
        """starts[k] says where the vectors of each node of level k begin, and the end."""
        self.x, self.starts = x, starts
        self.near = x.astype(np.float32)  # for what may be passed over; links are decided on x
        self.kids = [np.searchsorted(after, s) for s, after in zip(starts, starts[1:], strict=False)] + [starts[-1]]
        self.centres = [s[:-1] for s in starts]
        self.radius = []
        for s in starts:
            own = np.repeat(s[:-1], np.diff(s))
            far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, x[own])))
            self.radius.append(np.maximum.reduceat(far, s[:-1]) if len(far) else far)

    def paths(self) -> np.ndarray:
        """For each vector in order, its node of each level."""
        return np.stack([np.repeat(np.arange(len(s) - 1), np.diff(s)) for s in self.starts], axis=1)

    @classmethod
    def again(cls, x: np.ndarray, paths: np.ndarray) -> Tree:
        """The tree of vectors that stand in its order, from their paths."""
        out = cls.__new__(cls)
        out.order = np.arange(len(x))
        out._measure(x, [np.concatenate((np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1]))), [len(n)])) for n in paths.T])
        return out

    @staticmethod
    def _net(x: np.ndarray, members: np.ndarray, radius: float) -> list[np.ndarray]:
        """Members by centre: a centre is the first that no centre before it covers."""
        if len(members) == 1:
            return [members]
        out, left = [], members
        least = 1 - radius * radius / 2
        while len(left):
            near = x[left] @ x[left[0]] >= least
            near[0] = True
            out.append(left[near])
            left = left[~near]
        return out


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each start up to its end, one range after the other; no range is empty."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)


def dual(a: Tree, b: Tree, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i of a, j of b) with cosine >= threshold, in pieces; same: a is b, and only i < j count."""
    bound = math.sqrt(max(0.0, 2 - 2 * threshold))
    if not len(a.x) or not len(b.x):
        return
    slack = (a.x.shape[1] + 8) * 2.0**-23  # more than products of unit vectors in single precision are off by
    last = len(a.centres)
    stack = [(0, np.arange(len(a.centres[0])), np.arange(len(b.centres[0])))]
    while stack:
        level, p, q = stack.pop()
        vectors = level == last
        few = 0
        if not vectors:  # single vectors and narrow nodes first, so that either kind is a slice
            wide = b.radius[level][q] > 0.25
            q, few = np.concatenate((q[~wide], q[wide])), len(q) - int(wide.sum())
        ca, cb = (p, q) if vectors else (a.centres[level][p], b.centres[level][q])
        right = b.near[cb].T
        for s in range(0, len(p), _CHUNK):
            dots = a.near[ca[s : s + _CHUNK]] @ right
            if vectors:
                i, j = np.nonzero(dots >= threshold - slack)
                i, j = p[s + i], q[j]
                if same:
                    on = i < j
                    i, j = i[on], j[on]
                on = np.einsum("ij,ij->i", a.x[i], b.x[j]) >= threshold
                i, j = i[on], j[on]
                if len(i):
                    yield i, j
                continue
            # First one limit per row and kind of column (single vectors, and nodes of some extent), then the exact limit.
            mine, theirs = a.radius[level][p[s : s + _CHUNK]], b.radius[level][q]
            i, j = [], []
            for first, end in ((0, few), (few, len(q))):
                if first < end:
                    widest = mine + theirs[first:end].max() + bound + _SLACK
                    part = dots[:, first:end]
                    at, of = np.nonzero(part >= (1 - widest * widest / 2 - slack).astype(np.float32)[:, None])
                    reach = mine[at] + theirs[first + of] + bound + _SLACK
                    on = part[at, of] >= 1 - reach * reach / 2 - slack
                    i.append(at[on])
                    j.append(first + of[on])
            i, j = np.concatenate(i), np.concatenate(j)
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            if same:
                on = p[s + i] < q[j] + (a.starts[level][q[j] + 1] - a.starts[level][q[j]] > 1)  # a node of one vector has no pair in itself
                i, j = i[on], j[on]
            if not len(i):
                continue
            edge = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            for k, first in enumerate(edge):
                one, some = p[s + i[first]], q[j[first : edge[k + 1] if k + 1 < len(edge) else len(j)]]
                kids = np.arange(a.kids[level][one], a.kids[level][one + 1])
                stack.append((level + 1, kids, ranges(b.kids[level][some], b.kids[level][some + 1])))


def spanned(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node reachable by the pairs), one for each node but the smallest."""
    nodes, back = np.unique(np.concatenate((i, j)), return_inverse=True)
    u, v = back[: len(i)], back[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, u, low)
        np.minimum.at(after, v, low)
        np.minimum.at(after, label[u], low)
        np.minimum.at(after, label[v], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    on = label != np.arange(len(nodes))
    return nodes[on], nodes[label[on]]


def _links(classes: DataFrame, dim: int, threshold: float, own: common.Scratch) -> DataFrame:
    """Rows (id, n, other): n links more for a class, or a link with other (n = 0). classes: (rep, copies, vec) of one dimension, unit vectors."""
    spark = classes.sparkSession
    bound = math.sqrt(max(0.0, 2 - 2 * threshold))
    n = classes.count()
    few = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").toArrow().column("vec").combine_chunks()
    sample = few.values.to_numpy().reshape(-1, dim)
    centres = far_apart(sample, max(1, min(len(sample), math.ceil(n / BLOCK))))
    shared = spark.sparkContext.broadcast(centres)

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column(2)
            x = column.flatten().to_numpy().reshape(-1, dim)
            dots = x @ shared.value.T
            cell = dots.argmax(axis=1) if len(x) else np.zeros(0, int)
            far = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(x)), cell]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), column, pa.array(cell.astype(np.int32)), pa.array(far)], ["rep", "copies", "vec", "cell", "far"])

    dealt = own.written(common.mapped(classes.select("rep", "copies", "vec"), assign, "rep long, copies long, vec array<double>, cell int, far double"), "cells")
    cells = {r.cell: (r.n, r.far) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # one row per centre, SAMPLE at most
    blocks = {c: math.ceil(k / BLOCK) for c, (k, _) in cells.items()}
    plan = []
    for c in cells:
        for d in cells:
            apart = math.sqrt(max(0.0, 2 - 2 * float(centres[c] @ centres[d])))
            if apart <= cells[c][1] + cells[d][1] + bound + _SLACK:
                plan.append((c, d, blocks[d]))
    parts = F.broadcast(spark.createDataFrame(list(blocks.items()) or [(-1, 1)], "cell int, own int"))  # SAMPLE rows at most
    placed = dealt.join(parts, "cell").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("own")).cast("int"))

    def grown(group: pa.Table) -> pa.Table:
        tree = Tree(group.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim))
        paths = np.c_[np.arange(len(tree.order)), tree.paths()].astype(np.int32)
        out = group.select(["rep", "copies", "vec", "cell", "block"]).take(pa.array(tree.order))
        return out.append_column("path", pa.ListArray.from_arrays(pa.array(np.arange(len(paths) + 1) * paths.shape[1], pa.int32()), pa.array(paths.ravel())))

    # Each block's tree is grown once; a vector carries its place in the tree's order and its node of each level.
    trees = own.written(placed.select("rep", "copies", "vec", "cell", "block").groupBy("cell", "block").applyInArrow(grown, "rep long, copies long, vec array<double>, cell int, block int, path array<int>"), "trees")
    meets = F.broadcast(spark.createDataFrame(plan or [(-1, -1, 1)], "cell int, other int, others int"))  # SAMPLE * SAMPLE rows at most
    rows = trees.join(meets, "cell")
    rows = rows.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    me, you = F.struct(F.col("cell").alias("c"), F.col("block").alias("b")), F.struct(F.col("other").alias("c"), F.col("against").alias("b"))
    rows = rows.select(F.least(me, you).alias("x"), F.greatest(me, you).alias("y"), "rep", "copies", "vec", "path", (me <= you).alias("left"), (me == you).alias("both"))

    def of(group: pa.Table) -> pa.Table:
        rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        x = group.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        left, same = group.column("left").to_numpy(), bool(group.column("both")[0].as_py())
        paths = group.column("path").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)

        def side(on: np.ndarray) -> tuple[Tree, np.ndarray, np.ndarray]:
            on = np.flatnonzero(on)
            on = on[np.argsort(paths[on, 0])]
            return Tree.again(x[on], paths[on, 1:]), rep[on], copies[on]

        a, rep_a, copies_a = side(left)
        b, rep_b, copies_b = (a, rep_a, copies_a) if same else side(~left)
        more_a, more_b = np.zeros(len(rep_a), np.int64), np.zeros(len(rep_b), np.int64)
        nodes, roots = [], []
        for i, j in dual(a, b, threshold, same):
            i, j = a.order[i], b.order[j]
            more_a += np.bincount(i, copies_b[j], len(rep_a)).astype(np.int64)
            more_b += np.bincount(j, copies_a[i], len(rep_b)).astype(np.int64)
            u, v = spanned(rep_a[i], rep_b[j])
            nodes.append(u)
            roots.append(v)
        ids, counts = (rep_a, more_a + more_b) if same else (np.concatenate((rep_a, rep_b)), np.concatenate((more_a, more_b)))
        on = counts > 0
        u, v = (np.concatenate(nodes), np.concatenate(roots)) if nodes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table({"id": pa.array(np.concatenate((ids[on], u)), pa.int64()), "n": pa.array(np.concatenate((counts[on], np.zeros(len(u), np.int64))), pa.int64()), "other": pa.array(np.concatenate((ids[on], v)), pa.int64())})

    return rows.groupBy("x", "y").applyInArrow(of, "id long, n long, other long")


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (smallest id reachable), kept (id = component_id).

    A written table; what was written on the way is removed."""
    spark = table.sparkSession
    vec = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    fine = F.coalesce(~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    top = F.array_max(F.transform("vec", F.abs))  # scaled first, so that no square overflows or vanishes
    with common.scratch() as own:
        rows = table.select(F.col(key).cast("long").alias("id"), vec.alias("vec")).withColumn("vec", F.when(fine & (top > 0), F.transform("vec", lambda v: v / top)))
        rows = own.written(rows.withColumn("vec", F.transform("vec", lambda v: v / norm)).withColumn("hash", F.md5(F.col("vec").cast("string"))), "vectors")
        classes = rows.where("vec is not null").groupBy("hash", "vec").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        classes = own.written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # rows of different vectors may share an id
        found = spark.createDataFrame([], "id long, n long, other long")
        for (dim,) in classes.select(F.size("vec")).distinct().collect():  # a row per dimension
            found = found.unionAll(_links(classes.where(F.size("vec") == dim), dim, threshold, own))
        found = own.written(found, "links")
        more = found.where("n > 0").groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("more"))
        label = common.components(found.where("n = 0").select(F.col("id").alias("a"), F.col("other").alias("b")))
        own.tables.append(label)
        known = classes.select("hash", "rep", "first", "copies").join(more, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        least = known.groupBy("component").agg(F.min("first").alias("component_id"))
        known = own.written(known.join(least, "component").select("hash", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"), "component_id"), "known")
        # One row per vector on the right, so Spark may split the rows of a vector that very many share; rows without one are not joined.
        placed = rows.where("vec is not null").select("id", "hash").join(known, "hash").select("id", "n_links", "component_id")
        alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        return common.written(placed.unionAll(alone).select("id", "n_links", "component_id", (F.col("component_id") == F.col("id")).alias("kept")), "near_vectors")


def op6_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


#: All pairs of vectors.
SQL = f"""
WITH RECURSIVE rows AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
fine AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM rows
         WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
links(a, b) AS (SELECT x.vec_id, y.vec_id FROM fine x JOIN fine y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v)
         WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.95),
{common.COMPONENTS_SQL},
degree AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM links UNION ALL SELECT b FROM links) GROUP BY node)
SELECT r.vec_id, coalesce(d.n, 0) AS n_links, coalesce(f.component, r.vec_id) AS component_id, coalesce(f.component, r.vec_id) = r.vec_id AS kept
FROM rows r LEFT JOIN degree d ON r.vec_id = d.node LEFT JOIN found f ON r.vec_id = f.node
"""
