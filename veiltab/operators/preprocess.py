"""Columns to codes and back under a budget: few values keep their own codes, many are binned or merged.

A numerical column of at least `bins` distinct values is binned (uniform, exponential, privtree, dawa, given edges, or
"none" for min-max), a categorical one of at least as many has its rare values merged into one label. Everything else is
coded by the order of its values. Tables of values are DataFrames and join by measured size; edges are short lists."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written
from . import encode
from .infer import infer

#: Fine cells of the histogram that private discretisers work on.
FINE = 1 << 10
METHODS = ("uniform_kbins", "exp_kbins", "privtree", "dawa", "none")


def privtree_edges(df: DataFrame, column: str, low: float, high: float, rho: float, noise: Callable[[float], float], columns: int = 1, fine: int = FINE) -> list[float]:
    """Edges by private recursive halving of public bounds."""
    found = encode.privtree(encode.histogram(df, column, low, high, fine), low, high, rho, noise, columns)
    return [low, *(b for _, b in found)]


def dawa_edges(df: DataFrame, column: str, low: float, high: float, epsilon: float, noise: Callable[[float], float], ratio: float = 0.5, fine: int = FINE) -> list[float]:
    """Edges of the buckets of a data-aware partition of public bounds."""
    buckets, _ = encode.dawa(encode.histogram(df, column, low, high, fine), epsilon, ratio, noise)
    return [low, *(low + (high - low) * b / fine for _, b in buckets)]


def partition_histogram(x: np.ndarray, buckets: Sequence[tuple[int, int]], epsilon: float, noise: Callable[[float], float]) -> np.ndarray:
    """Noisy means of buckets, spread over their cells."""
    out = np.zeros(len(x))
    for a, b in buckets:
        out[a:b] = (float(np.sum(x[a:b])) + noise(1 / epsilon)) / (b - a)
    return out


def merge_limit(rows: int, threshold: float, sigma: float) -> float:
    """The largest noisy count that is merged; below zero nothing is."""
    return rows * max(threshold, 3 * sigma / rows) if threshold >= 0 and rows else -math.inf


@dataclass
class Coded:
    """How one column is coded. values: rows (value, code, merged) where codes stand for values; edges where for bins."""

    name: str
    kind: str
    size: int
    edges: list[float] | None = None
    values: DataFrame | None = None
    merged: int = 0
    low: float = 0.0
    high: float = 0.0


@dataclass
class Preprocessor:
    """fit() learns the codes of df's columns, transform() applies them, inverse() turns codes into values again.

    numerical: columns with public bounds (low, high). rho: the budget of noise for bins and rare values, None for none;
    it is split between the kinds by their numbers of columns with many values, and evenly among those."""

    numerical: dict[str, tuple[float, float]]
    categorical: Sequence[str]
    rho: float | None = None
    method: str = "uniform_kbins"
    bins: int = encode.BINS
    threshold: float = 0.002
    edges: dict[str, Sequence[float]] = field(default_factory=dict)
    seed: int = 0
    coded: dict[str, Coded] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Preprocessor:
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {', '.join(METHODS)}")
        names = [*self.numerical, *self.categorical]
        found = {c.name: c for c in infer(df.select(*names))}
        rows = next(iter(found.values())).rows if found else 0
        wide = {kind: [c for c in cols if found[c].distinct >= self.bins and c not in self.edges] for kind, cols in (("num", list(self.numerical)), ("cat", list(self.categorical)))}
        shares = encode.budget_shares([found[c].distinct for c in self.numerical], [found[c].distinct for c in self.categorical], self.bins)
        rho_num, rho_cat = (None, None) if self.rho is None else (self.rho * s for s in shares)
        for c, (low, high) in self.numerical.items():
            self.coded[c] = self._numeric(df, c, float(low), float(high), c in wide["num"], rho_num, len(wide["num"]))
        for c in self.categorical:
            self.coded[c] = self._categories(df, c, rows, c in wide["cat"], rho_cat, len(wide["cat"]))
        return self

    def _numeric(self, df: DataFrame, c: str, low: float, high: float, many: bool, rho: float | None, columns: int) -> Coded:
        if c in self.edges:
            return Coded(c, "edges", len(self.edges[c]) - 1, list(map(float, self.edges[c])))
        if self.method == "none":
            return Coded(c, "minmax", 0, low=low, high=high)
        if not many:
            table = written(encode.ordinal(df, c).withColumn("merged", F.lit(False)), "values")
            return Coded(c, "values", table.count(), values=table)
        rng = np.random.default_rng(self.seed)
        noise = (lambda scale: float(rng.laplace(0, scale))) if rho else (lambda scale: 0.0)
        budget = (rho or 1e9) / columns
        if self.method == "privtree":
            edges = privtree_edges(df, c, low, high, budget, noise)
        elif self.method == "dawa":
            edges = dawa_edges(df, c, low, high, math.sqrt(8 * budget), noise)
        elif self.method == "exp_kbins":
            a, b = math.log2(0.01), math.log2(high - low + 0.01)
            edges = [low, *(2 ** (a + (b - a) * k / self.bins) - 0.01 + low for k in range(1, self.bins)), high]
        else:
            edges = [low + (high - low) * k / self.bins for k in range(self.bins)] + [high]
        return Coded(c, "edges", len(edges) - 1, edges)

    def _categories(self, df: DataFrame, c: str, rows: int, many: bool, rho: float | None, columns: int) -> Coded:
        label = F.col(c).cast("string")
        counts = df.groupBy(label.alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value is not null")
        sigma = math.sqrt(columns / (2 * rho)) if rho and columns else 0.0
        noisy = F.col("n") + (F.randn(self.seed) * sigma if sigma else F.lit(0.0))
        limit = merge_limit(rows, self.threshold, sigma) if many else -math.inf
        marked = written(counts.select("value", (noisy <= limit).alias("merged")), "categories")  # noise is drawn once
        merged = marked.where("merged").count()
        kept = encode.ordinal(marked.where("not merged"), "value").withColumn("merged", F.lit(False))
        size = marked.count() - merged
        gone = encode.ordinal(marked.where("merged"), "value").select("value", F.lit(size).cast("int").alias("code"), F.lit(True).alias("merged"))
        table = written(kept.unionAll(gone), "values")
        return Coded(c, "values", size + (merged > 0), values=table, merged=merged)

    def transform(self, df: DataFrame) -> DataFrame:
        """The coded columns, others as they are. A value that fit() did not see is the merged label's if there is one, else -1."""
        for c, how in self.coded.items():
            x = F.col(c).cast("double")
            if how.kind == "edges":
                df = df.withColumn(c, edge_code(x, how.edges))
            elif how.kind == "minmax":
                df = df.withColumn(c, encode.min_max(F.least(F.greatest(x, F.lit(how.low)), F.lit(how.high)), how.low, how.high))
            else:
                other = how.size - 1 if how.merged else -1
                text = how.values.select(F.col("value").cast("string").alias("__value"), F.col("code").alias("__code"))
                sent = encode.lookup_join(df.withColumn("__value", F.col(c).cast("string")), text, "__value", text.count())
                df = sent.withColumn(c, F.coalesce("__code", F.lit(other)).cast("int")).drop("__value", "__code")
        return df

    def inverse(self, df: DataFrame, row_id: str = "row_id") -> DataFrame:
        """Values for codes: uniform within a bin, one of the merged values for their label, by a stable hash of the row
        id; codes outside are clipped to the nearest."""
        for k, (c, how) in enumerate(self.coded.items()):
            u = F.pmod(F.xxhash64(row_id, F.lit(self.seed + k), F.lit(c)), F.lit(1 << 30)) / float(1 << 30)
            if how.kind == "edges":
                at = clipped(F.col(c), how.size)
                low, high = F.get(F.array(*map(F.lit, how.edges[:-1])), at), F.get(F.array(*map(F.lit, how.edges[1:])), at)
                df = df.withColumn(c, low + u * (high - low))
            elif how.kind == "minmax":
                df = df.withColumn(c, encode.min_max_inverse(F.col(c), how.low, how.high))
            else:
                kept = how.values.where("not merged").select(F.col("code").alias("__code"), F.lit(0).cast("long").alias("__pick"), F.col("value").alias("__value"))
                gone = encode.ordinal(how.values.where("merged"), "value").select(F.lit(how.size - 1).alias("__code"), F.col("code").cast("long").alias("__pick"), F.col("value").alias("__value"))
                code = clipped(F.col(c), how.size)
                pick = F.when(code == how.size - 1, F.floor(u * how.merged)).otherwise(0) if how.merged else F.lit(0)
                df = df.withColumn("__code", code).withColumn("__pick", pick.cast("long"))
                df = df.join(kept.unionAll(gone) if how.merged else kept, ["__code", "__pick"], "left").withColumn(c, F.col("__value")).drop("__code", "__pick", "__value")
        return df


def edge_code(x: Column, edges: Sequence[float]) -> Column:
    """As encode.edge_bin, for any number of edges."""
    inner = F.array(*(F.lit(float(e)) for e in edges[1:-1])) if len(edges) > 2 else F.array().cast("array<double>")
    return F.size(F.filter(inner, lambda e: e <= x)).cast("int")


def clipped(code: Column, size: int) -> Column:
    return F.least(F.greatest(code.cast("int"), F.lit(0)), F.lit(max(size - 1, 0)))


def to_angle(x: Column, low: float, high: float) -> Column:
    """Min-max to [0, pi]."""
    return encode.min_max(x, low, high) * math.pi


@dataclass
class Mixture:
    """A mixture of normals of one column, for values that are written as a component and a place in it."""

    weights: list[float]
    means: list[float]
    sigmas: list[float]

    @classmethod
    def fit(cls, df: DataFrame, column: str, components: int = 10, least: float = 0.005, fine: int = 1 << 12, rounds: int = 200) -> Mixture:
        """By expectation and maximisation over a histogram of all rows; components of less weight than `least` go.

        Components begin at the middles of runs of equal weight."""
        low, high = df.agg(F.min(F.col(column).cast("double")), F.max(F.col(column).cast("double"))).first()
        if low is None or low == high:
            return cls([1.0], [float(low or 0.0)], [1e-6])
        n = encode.histogram(df.select(F.col(column).cast("double").alias(column)), column, low, high, fine)
        x, width = low + (np.arange(fine) + 0.5) * (high - low) / fine, (high - low) / fine
        x, n = x[n > 0], n[n > 0]
        share = np.cumsum(n) / n.sum()
        means = np.array([x[np.searchsorted(share, (k + 0.5) / components)] for k in range(components)])
        sigmas, weights = np.full(components, (high - low) / (2 * components)), np.full(components, 1 / components)
        for _ in range(rounds):
            logs = np.log(weights) - np.log(sigmas) - ((x[:, None] - means) / sigmas) ** 2 / 2
            part = np.exp(logs - logs.max(axis=1, keepdims=True))
            part *= (n / part.sum(axis=1))[:, None]
            total = np.maximum(part.sum(axis=0), 1e-12)
            weights, before = total / total.sum(), means
            means = (part * x[:, None]).sum(axis=0) / total
            sigmas = np.sqrt((part * (x[:, None] - means) ** 2).sum(axis=0) / total + (width / 4) ** 2)
            if np.abs(means - before).max() < 1e-6 * (high - low):
                break
        found = sorted((m, s, w) for m, s, w in zip(means.tolist(), sigmas.tolist(), weights.tolist(), strict=True) if w >= least)
        return cls([w / sum(f[2] for f in found) for *_, w in found], [m for m, *_ in found], [s for _, s, _ in found])

    def normalized(self, column: Column) -> tuple[Column, Column]:
        """(likeliest component, place in it within .99 of four deviations)."""
        x = column.cast("double")
        logs = F.array(*(F.lit(math.log(w) - math.log(s)) - F.pow((x - m) / s, F.lit(2.0)) / 2 for w, m, s in zip(self.weights, self.means, self.sigmas, strict=True)))
        at = (F.array_position(logs, F.array_max(logs)) - 1).cast("int")
        mean, sigma = F.get(F.array(*map(F.lit, self.means)), at), F.get(F.array(*map(F.lit, self.sigmas)), at)
        return at, F.least(F.greatest((x - mean) / (4 * sigma), F.lit(-0.99)), F.lit(0.99))

    def restored(self, component: Column, place: Column) -> Column:
        mean, sigma = F.get(F.array(*map(F.lit, self.means)), component), F.get(F.array(*map(F.lit, self.sigmas)), component)
        return place * 4 * sigma + mean
