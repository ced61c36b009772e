"""The median distance of all pairs of rows, exact, without a row per pair: boxes of near rows decide most pairs.

Squared distances are compared as the integers that their bits form, which have the same order. Each pass counts all pairs
below a bracket and in its bins; it reads only pairs of tiles whose boxes do not lie in one bin as a whole."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import scratch

#: Rows of a cell inside a task, and pairs of cells whose rows are compared at a time.
CELL, BATCH = 64, 64
#: Boxes (about) that the driver looks at in pairs for the first bracket.
BOXES = 1024
#: Least number of tiles, and most rows of one up to MOST_TILES; a task takes one tile against another.
TILES, TILE_ROWS, MOST_TILES = 32, 32768, 1024
#: Bins of a pass, and most distances of a bracket that are listed one by one instead.
BINS, LISTED = 4096, 1 << 16


class Boxes(NamedTuple):
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray


class Bracket(NamedTuple):
    lo: int
    hi: int
    inside: int  # pairs in it at most

    @property
    def shift(self) -> int:
        return 0 if self.inside <= LISTED else max(0, (self.hi - self.lo).bit_length() - (BINS.bit_length() - 1))

    @property
    def last(self) -> int:
        return (self.hi - self.lo) >> self.shift

    def place(self, bits: np.ndarray) -> np.ndarray:
        """The bin of each, -1 below the bracket, last + 1 above it."""
        return np.clip((bits - self.lo) >> self.shift, -1, self.last + 1)


def _bits(squares: np.ndarray) -> np.ndarray:
    squares[np.isnan(squares)] = np.nan  # one NaN, the largest
    return squares.view(np.int64)


def bounds(a: Boxes, b: Boxes) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance (as bits) of each box of a to each of b.

    Rounding keeps order, so these hold for the rounded distances too. A box with NaN or infinity has no bounds."""
    low, high = np.zeros((len(a.n), len(b.n))), np.zeros((len(a.n), len(b.n)))
    for k in range(a.low.shape[1]):
        up, down = a.high[:, None, k] - b.low[None, :, k], b.high[None, :, k] - a.low[:, None, k]
        near, far = np.maximum(np.maximum(-up, -down), 0.0), np.maximum(up, down)
        low, high = low + near * near, high + far * far
    odd = ~np.isfinite(a.low + a.high).all(axis=1)[:, None] | ~np.isfinite(b.low + b.high).all(axis=1)[None, :]
    low[odd], high[odd] = 0.0, np.nan
    return _bits(low), _bits(high)


def _pairs(a: np.ndarray, b: np.ndarray, same: bool, at: int = 0) -> np.ndarray:
    """Numbers of pairs between parts of so many rows; of the same parts (a from part `at` on) each pair once."""
    out = a[:, None] * b[None, :]
    if same:
        out = np.triu(out, at + 1)
        out[np.arange(len(a)), at + np.arange(len(a))] = a * (a - 1) // 2
    return out


def tally(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, same: bool, bracket: Bracket) -> tuple[np.ndarray, np.ndarray]:
    """Places of the bracket, up to its last, and how many pairs of a row of x and one of y (of two of x, if same) have them.

    nx, ny: copies of each row. The rows' order should keep near rows together."""

    def cells(z: np.ndarray, n: np.ndarray) -> tuple[Boxes, np.ndarray, np.ndarray]:
        starts = np.arange(0, len(n), CELL)
        rows, copies = np.zeros((len(starts) * CELL, z.shape[1])), np.zeros(len(starts) * CELL, np.int64)
        rows[: len(n)], copies[: len(n)] = z, n
        return Boxes(np.minimum.reduceat(z, starts), np.maximum.reduceat(z, starts), np.add.reduceat(n, starts)), rows.reshape(-1, CELL, z.shape[1]), copies.reshape(-1, CELL)

    a, rows_a, copies_a = cells(x, nx)
    b, rows_b, copies_b = cells(y, ny)
    dense = bracket.last < BINS
    seen = np.zeros(bracket.last + 2 if dense else 1, np.int64)
    listed: list[tuple[np.ndarray, np.ndarray]] = []

    def add(place: np.ndarray, n: np.ndarray) -> None:
        seen[0] += n[place < 0].sum()
        on = (place >= 0) & (place <= bracket.last) & (n > 0)
        if dense:
            np.add.at(seen, place[on] + 1, n[on])
        else:
            listed.append((place[on], n[on]))

    step = max(1, (1 << 20) // len(b.n))
    for at in range(0, len(a.n), step):
        part = Boxes(*(v[at : at + step] for v in a))
        low, high = map(bracket.place, bounds(part, b))
        n = _pairs(part.n, b.n, same, at)
        add(low[low == high], n[low == high])
        left, right = np.nonzero((low != high) & (n > 0))
        for start in range(0, len(left), BATCH):
            i, j = at + left[start : start + BATCH], right[start : start + BATCH]
            u, v = rows_a[i], rows_b[j]
            squares = np.zeros((len(i), CELL, CELL))
            for k in range(u.shape[2]):
                gap = u[:, :, None, k] - v[:, None, :, k]
                squares += gap * gap
            n_of = copies_a[i][:, :, None] * copies_b[j][:, None, :]
            for own in np.flatnonzero(i == j) if same else ():
                n_of[own] = _pairs(copies_a[i[own]], copies_a[i[own]], True)
            add(bracket.place(_bits(squares)), n_of)
    places, counts = np.arange(-1, len(seen) - 1), seen
    if listed:
        places, counts = np.concatenate((places, *(p for p, _ in listed))), np.concatenate((counts, *(n for _, n in listed)))
    return summed(places, counts)


def summed(places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each, back = np.unique(places, return_inverse=True)
    out = np.zeros(len(each), np.int64)
    np.add.at(out, back, counts)
    return each[out != 0], out[out != 0]


def _first(boxes: Boxes, k: int, out: int) -> Bracket:
    """Bounds of the k-th smallest distance, where `out` of the pairs of rows do not count."""
    low, high = bounds(boxes, boxes)
    n = _pairs(boxes.n, boxes.n, True)
    low, high, n = low[n > 0], high[n > 0], n[n > 0]

    def at(bits: np.ndarray, rank: int) -> int:
        order = np.argsort(bits)
        return int(bits[order[np.searchsorted(np.cumsum(n[order]), rank)]])

    lo, hi = at(low, k), at(high, k + out)
    return Bracket(lo, hi, int(n[(low <= hi) & (high >= lo)].sum()))


def _finite(x: str) -> Column:
    return F.abs(F.col(x)) < float("inf")  # NaN is above infinity


def _curved(df: DataFrame, xs: Sequence[str], ends: dict[str, tuple[float, float]]) -> DataFrame:
    """df with z, a place on a curve that keeps near rows together: the bits of the widest columns, in one unit, by turns."""
    wide = sorted((x for x in xs if ends[x][0] is not None), key=lambda x: ends[x][0] / 2 - ends[x][1] / 2)[:4]
    top = max((ends[x][1] / 2 - ends[x][0] / 2 for x in wide), default=0.0)
    if not top:
        return df.withColumn("z", F.lit(0).cast("long"))
    bits = 62 // len(wide)
    steps = {f"__{x}": F.least(F.floor((F.col(x) / 2 - ends[x][0] / 2) / top * float(1 << bits)), F.lit((1 << bits) - 1)).cast("long") for x in wide}
    turns = [F.shiftleft(F.shiftright(c, bit).bitwiseAND(F.lit(1).cast("long")), bit * len(wide) + k) for bit in range(bits) for k, c in enumerate(steps)]
    z = F.when(reduce(Column.__and__, map(_finite, xs)), reduce(Column.__add__, turns)).otherwise(F.lit((1 << 63) - 1))
    return df.withColumns(steps).withColumn("z", z).drop(*steps)


def _whole(df: DataFrame, columns: Sequence[str], row_id: str) -> tuple[DataFrame, list[str]]:
    """Rows (id, x0, x1, ...) without nulls; integers and decimals count from their least, so doubles hold their differences."""
    exact = [c for c in columns if isinstance(df.schema[c].dataType, T.IntegralType | T.DecimalType)]
    least = dict(zip(exact, df.agg(*(F.min(c) for c in exact)).first(), strict=True)) if exact else {}
    xs = [f"x{k}" for k in range(len(columns))]
    value = {c: F.col(c) - F.lit(least[c]) if least.get(c) is not None else F.col(c) for c in columns}
    rows = df.select(F.col(row_id).alias("id"), *(value[c].cast("double").alias(x) for c, x in zip(columns, xs, strict=True)))
    return rows.where(" AND ".join(f"{x} IS NOT NULL" for x in ["id", *xs])), xs


def median_of_pairs(df: DataFrame, columns: Sequence[str], row_id: str) -> float | None:
    """The median Euclidean distance of all pairs of rows with different row ids (x.id < y.id); rows with nulls have none.

    Equal rows are one point with a number of copies. The driver holds a row per box, per tile and per bin, and the pairs
    of boxes and of tiles."""
    with scratch() as own, np.errstate(all="ignore"):
        rows, xs = _whole(df, columns, row_id)
        points = own.written(rows.groupBy(*xs).agg(F.count(F.lit(1)).alias("n")), "points")
        count, total, *ends = points.agg(F.count(F.lit(1)), F.sum("n"), *(f(F.when(_finite(x), F.col(x))) for x in xs for f in (F.min, F.max))).first()
        # Rows that share an id make no pair: their pairs are counted too, and taken off.
        shared = own.written(rows.groupBy("id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("twin", F.monotonically_increasing_id()), "shared")
        out = int(shared.agg(F.sum(F.expr("CAST(m AS DECIMAL(38, 0)) * (m - 1) / 2"))).first()[0] or 0)
        pairs = (total or 0) * ((total or 0) - 1) // 2 - out
        if not pairs:
            return None
        curved = lambda t: _curved(t, xs, dict(zip(xs, zip(ends[::2], ends[1::2], strict=True), strict=True)))
        number = min(max(TILES, math.ceil(count / TILE_ROWS)), MOST_TILES, math.ceil(count / CELL))
        tiles = own.written(curved(points).repartitionByRange(number, "z", *xs).withColumn("tile", F.spark_partition_id()), "tiles")
        twins = own.written(curved(rows.join(shared, "id").groupBy("twin", *xs).agg(F.count(F.lit(1)).alias("n"))), "twins") if out else None
        cell = F.floor((F.row_number().over(Window.partitionBy("tile").orderBy("z")) - 1) / max(CELL, math.ceil(count / BOXES)))
        _, boxes = _boxes(tiles.withColumn("cell", cell).groupBy("tile", "cell"), xs)
        names, edges = _boxes(tiles.groupBy("tile"), xs)
        found = {k: _first(boxes, k, out) for k in {(pairs + 1) // 2, pairs // 2 + 1}}
        low, high, number_of = *bounds(edges, edges), _pairs(edges.n, edges.n, True)
        while todo := sorted({b for b in found.values() if b.lo < b.hi}):
            counts, plan = [], []
            for q, b in enumerate(todo):
                least, most = b.place(low), b.place(high)
                done = (least == most) & (least <= b.last)
                counts.append((least[done], number_of[done]))
                plan += [(names[t], names[i], names[j], q) for i, j in np.argwhere((least != most) & (number_of > 0)).tolist() for t in {i, j}]
            got = _counted(tiles, twins, xs, plan, todo).toArrow()
            of, place, n = (got.column(c).to_numpy() for c in ("q", "place", "n"))
            for q, b in enumerate(todo):
                places, each = summed(np.concatenate((counts[q][0], place[of == q])), np.concatenate((counts[q][1], n[of == q])))
                upto = np.cumsum(each)
                for k in [k for k, v in found.items() if v == b]:
                    at = int(np.searchsorted(upto, k))
                    if at == len(places) or places[at] < 0:
                        raise RuntimeError("a distance lies outside its bracket")
                    lo = b.lo + (int(places[at]) << b.shift)
                    found[k] = Bracket(lo, min(lo + (1 << b.shift) - 1, b.hi), int(each[at]) + out)
        first, *second = (math.sqrt(np.int64(found[k].lo).view(np.float64)) for k in sorted(found))
        return first if second in ([], [first]) else 0.5 * first + 0.5 * second[0]


def _boxes(grouped: GroupedData, xs: Sequence[str]) -> tuple[list[int], Boxes]:
    """The tile and the box of each group."""
    got = grouped.agg(*(f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in xs), F.sum("n").alias("n")).toArrow()
    low, high = (np.column_stack([got.column(f"{f}_{x}").to_numpy() for x in xs]) for f in ("min", "max"))
    return got.column("tile").to_pylist(), Boxes(low, high, got.column("n").to_numpy().astype(np.int64))


def _counted(tiles: DataFrame, twins: DataFrame | None, xs: Sequence[str], plan: list[tuple[int, int, int, int]], todo: Sequence[Bracket]) -> DataFrame:
    """Rows (q, place, n): the pairs of each place in bracket q, between the tiles of the plan, less those of twins.

    plan: rows (tile, a, b, q), each tile that tile a against tile b needs; twins have keys below 0."""
    spark, todo = tiles.sparkSession, list(todo)
    dealt = tiles.join(F.broadcast(spark.createDataFrame(plan, "tile int, a long, b long, q int")), "tile").select(*xs, "n", "z", F.col("tile").cast("long").alias("tile"), "a", "b", "q")
    if twins is not None:
        key = -1 - F.col("twin")
        dealt = dealt.unionAll(twins.select(*xs, "n", "z", key.alias("tile"), key.alias("a"), key.alias("b"), F.explode(F.array(*map(F.lit, range(len(todo))))).alias("q")))

    def of(table: pa.Table) -> pa.Table:
        tile, z, n = (table.column(c).to_numpy() for c in ("tile", "z", "n"))
        a, b, q = (table.column(c)[0].as_py() for c in ("a", "b", "q"))
        x = np.column_stack([table.column(c).to_numpy() for c in xs])
        left, right = (np.flatnonzero(tile == t) for t in (a, b))
        left, right = left[np.argsort(z[left])], right[np.argsort(z[right])]
        with np.errstate(all="ignore"):
            places, counts = tally(x[left], n[left], x[right], n[right], a == b, todo[q])
        return pa.table({"q": pa.array(np.full(len(places), q), pa.int32()), "place": pa.array(places, pa.int64()), "n": pa.array(-counts if a < 0 else counts, pa.int64())})

    # A number of parts that is given is not merged by size: the rows are few, the work on them is not.
    parts = max(1, min(len(plan), 8 * spark.sparkContext.defaultParallelism))
    each = dealt.repartition(parts, "a", "b", "q").groupBy("a", "b", "q").applyInArrow(of, "q int, place long, n long")
    return each.groupBy("q", "place").agg(F.sum("n").alias("n"))
