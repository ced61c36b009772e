"""Statistics over many marginals at once, their errors, and samples of public data."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domain import Domain
from ..functions.privacy import gaussian_sigma
from .distances import median_of_pairs
from .encode import uniform_bin
from .ranks import in_cells

# The resolutions of binned numerical attributes.
RESOLUTIONS = (2, 4, 8, 16, 32)
#: Rows of a sample that is compared pair by pair.
SAMPLE = 1000


def number_of_queries(domain: Domain, workloads: Sequence[Sequence[str]]) -> int:
    return sum(domain.size(w) for w in workloads)


def query_starts(domain: Domain, workloads: Sequence[Sequence[str]]) -> dict[tuple[str, ...], int]:
    """The number of each workload's first query, where a workload's cells are numbered row by row."""
    out, at = {}, 0
    for w in workloads:
        out[tuple(w)] = at
        at += domain.size(w)
    return out


def query_members(domain: Domain, workloads: Sequence[Sequence[str]], queries: Sequence[int] | None = None) -> np.ndarray:
    """A row per query: which of the one-hot columns of all attributes, in order, must be one."""
    first = dict(zip(domain.attrs, np.concatenate(([0], np.cumsum(domain.shape)[:-1])).tolist(), strict=True))
    rows = []
    for w in workloads:
        codes = np.indices([domain[a] for a in w]).reshape(len(w), -1)
        out = np.zeros((codes.shape[1], sum(domain.shape)), bool)
        for a, c in zip(w, codes, strict=True):
            out[np.arange(len(c)), first[a] + c] = True
        rows.append(out)
    whole = np.concatenate(rows) if rows else np.zeros((0, sum(domain.shape)), bool)
    return whole if queries is None else whole[list(queries)]


def query_answers(members: np.ndarray, records: np.ndarray, domain: Domain) -> np.ndarray:
    """The share of records that meet each query."""
    hot = np.concatenate([np.eye(n, dtype=np.int32)[records[:, k]] for k, n in enumerate(domain.shape)], axis=1)
    return (hot @ members.T.astype(np.int32) == members.sum(axis=1)).mean(axis=0)


def multiresolution(df: DataFrame, categorical: Sequence[str], numerical: dict[str, tuple[float, float]], resolutions: Sequence[int] = RESOLUTIONS) -> DataFrame:
    """Rows (first, second, bins, a, b, n): all pairs of attributes, a numerical one in each number of bins. One scan.

    The finest bins are counted, and coarser ones, that they nest in, are sums of these."""
    finest = max(resolutions)
    if any(finest % r for r in resolutions):
        raise ValueError("resolutions must divide the finest")
    coded = df.select(*(F.col(c).cast("string").alias(c) for c in categorical), *(uniform_bin(F.col(c).cast("double"), *map(float, b), finest).alias(c) for c, b in numerical.items()))
    names = [*categorical, *numerical]
    pairs = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for k, a in enumerate(names) for b in names[k + 1 :]]
    # Counts of whole records first: what is copied for each pair is a row per distinct record.
    cells = coded.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(F.array(*pairs)).alias("p")).groupBy("p").agg(F.sum("n").alias("n"))
    widths = F.explode(F.array(*map(F.lit, resolutions))).alias("bins")

    def at(name: str, value: str) -> Column:
        wide = F.col(name).isin(list(numerical))
        return F.when(wide, F.floor(F.col(value).try_cast("int") * F.col("bins") / finest).cast("string")).otherwise(F.col(value))

    spread = cells.select("p.*", "n", widths)
    plain = ~(F.col("first").isin(list(numerical)) | F.col("second").isin(list(numerical)))
    spread = spread.where(~plain | (F.col("bins") == finest))  # pairs of categories have one resolution
    return spread.select("first", "second", F.when(plain, 0).otherwise(F.col("bins")).alias("bins"), at("first", "a").alias("a"), at("second", "b").alias("b"), "n").groupBy("first", "second", "bins", "a", "b").agg(F.sum("n").alias("n"))


def workload_sensitivity(resolutions: int, rows: int) -> float:
    """Of the shares of one workload that is answered at so many resolutions."""
    return math.sqrt(2 * resolutions) / rows


@dataclass
class Chained:
    """Workloads of shares that are measured with equal parts of a budget; some of them are then selected.

    answers: by workload, the true shares (small tables of cells)."""

    answers: dict[str, np.ndarray]
    rows: int
    measured: dict[str, np.ndarray] = field(default_factory=dict)
    selected: list[str] = field(default_factory=list)

    def measure(self, rho: float, rng: np.random.Generator, names: Sequence[str] | None = None) -> dict[str, np.ndarray]:
        names = list(self.answers if names is None else names)
        for name in names:
            sigma = gaussian_sigma(math.sqrt(2) / self.rows, rho / len(names))
            self.measured[name] = np.clip(self.answers[name] + rng.normal(0, sigma, self.answers[name].shape), 0, 1)
        return self.measured

    def exact(self, names: Sequence[str] | None = None) -> dict[str, np.ndarray]:
        self.measured |= {n: self.answers[n] for n in (self.answers if names is None else names)}
        return self.measured

    def select(self, fake: dict[str, np.ndarray], rho: float, rng: np.random.Generator) -> str:
        """The workload, of those not selected before, whose largest error wins a noisy maximum."""
        left = [n for n in self.answers if n not in self.selected]
        score = {n: float(np.abs(self.answers[n] - fake[n]).max()) + rng.gumbel(0, math.sqrt(2) / self.rows / math.sqrt(2 * rho)) for n in left}
        self.selected.append(max(score, key=score.get))
        return self.selected[-1]


def workload_errors(real: DataFrame, fake: DataFrame, workload: str = "workload", query: str = "query") -> DataFrame:
    """Rows (workload, max_error, mean_squared): a missing answer counts as zero."""
    a, b = real.select(workload, query, F.col("answer").alias("real")), fake.select(workload, query, F.col("answer").alias("fake"))
    gap = F.abs(F.coalesce("real", F.lit(0.0)) - F.coalesce("fake", F.lit(0.0)))
    return a.join(b, [workload, query], "full").groupBy(workload).agg(F.max(gap).alias("max_error"), F.avg(gap * gap).alias("mean_squared"))


def two_level_error(errors: DataFrame) -> DataFrame:
    """The mean over workloads of their mean squared errors, and the largest error of all."""
    return errors.agg(F.avg("mean_squared").alias("mean_squared"), F.max("max_error").alias("max_error"))


def count_matrix(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """A row per value of `rows`, a count column c0, c1, ... per value of `columns`, in one aggregation."""
    return df.groupBy(rows).agg(*(F.count(F.when(F.col(columns) == v, 1)).alias(f"c{k}") for k, v in enumerate(values)))


def record_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("record_count"))


def smoothed(noisy: np.ndarray, width: float, least: float) -> np.ndarray:
    """Low noisy counts, below `least`, become the mean of those whose counts share a bucket of `width` with them."""
    flat = np.asarray(noisy, float).ravel().copy()
    low = np.flatnonzero(flat < least)
    bucket, back = np.unique(np.floor(flat[low] / width), return_inverse=True)
    if len(low):
        flat[low] = (np.bincount(back, flat[low], len(bucket)) / np.bincount(back, minlength=len(bucket)))[back]
    return flat.reshape(np.shape(noisy))


def few(df: DataFrame, row_id: str, seed: int, most: int = SAMPLE) -> DataFrame:
    """`most` rows of least hash: a sample of stated size for statistics of pairs."""
    return df.orderBy(F.xxhash64(F.col(row_id), F.lit(seed)), row_id).limit(most)


def _squared(columns: Sequence[str]) -> Column:
    out: Column = F.lit(0.0)
    for c in columns:
        out = out + F.pow(F.col(f"x.{c}") - F.col(f"y.{c}"), F.lit(2.0))
    return out


def median_distance(df: DataFrame, columns: Sequence[str], row_id: str, seed: int = 0, most: int | None = None) -> DataFrame:
    """The median distance of two rows with different ids, of all rows or, if `most` is given, of a sample of so many."""
    some = df if most is None else few(df, row_id, seed, most)
    return df.sparkSession.createDataFrame([(median_of_pairs(some, columns, row_id),)], "distance double")


def mmd_gaussian(x: DataFrame, y: DataFrame, columns: Sequence[str], row_id: str, sigma: float, seed: int = 0, most: int = SAMPLE) -> DataFrame:
    """The biased squared maximum mean discrepancy with a Gaussian kernel, of samples of `most` rows."""
    a, b = few(x, row_id, seed, most).select(*columns), few(y, row_id, seed, most).select(*columns)

    def mean(p: DataFrame, q: DataFrame, name: str) -> DataFrame:
        return p.alias("x").join(F.broadcast(q.alias("y"))).agg(F.avg(F.exp(-_squared(columns) / (2 * sigma * sigma))).alias(name))

    three = mean(a, a, "xx").join(mean(b, b, "yy")).join(mean(a, b, "xy"))
    return three.select((F.col("xx") + F.col("yy") - 2 * F.col("xy")).alias("mmd2"))


# Samples of public data, by stable hashes of the row id.


def _draw(row_id: str, seed: int, bits: int = 30) -> Column:
    return F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(1 << bits)) / float(1 << bits)


def public_sample(df: DataFrame, row_id: str, fraction: float, seed: int = 0) -> DataFrame:
    """A share of the rows, each at most once."""
    ranked = in_cells(df.withColumn("__cell", F.lit(0)), "__cell", row_id, seed)
    return ranked.where(F.col("__rank") <= F.rint(F.col("__size") * fraction)).drop("__cell", "__rank", "__size")


def biased_sample(df: DataFrame, row_id: str, fraction: float, attr: str, favoured: object, perturb: float, seed: int = 0) -> DataFrame:
    """About a share of the rows, with replacement: rows of the favoured class are 1 + perturb times as likely."""
    rate = F.when(F.col(attr) == favoured, fraction * (1 + perturb)).otherwise(fraction)
    times = F.floor(rate) + (_draw(row_id, seed) < rate - F.floor(rate)).cast("int")
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)).cast("int")))).where(times > 0).drop("__copy")


def corrupted_sample(df: DataFrame, row_id: str, domain: Domain, fraction: float, perturb: float, seed: int = 0) -> DataFrame:
    """Rows (attributes, n, weight): a sample in which each code moves, with probability perturb, to another one; equal records are grouped."""
    rows = public_sample(df, row_id, fraction, seed)
    for k, a in enumerate(domain.attrs):
        if domain[a] < 2:
            continue
        shift = 1 + F.pmod(F.xxhash64(F.col(row_id), F.lit(seed), F.lit(a)), F.lit(domain[a] - 1))
        rows = rows.withColumn(a, F.when(_draw(row_id, seed + 1 + k) < perturb, F.pmod(F.col(a) + shift, F.lit(domain[a]))).otherwise(F.col(a)).cast("int"))
    counts = rows.groupBy(*domain.attrs).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("__t")))).withColumn("weight", F.col("n") / F.col("__t")).drop("__t")
