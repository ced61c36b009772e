"""Small synthetic tables found by search: a genetic one, a relaxed one by gradients, and weights on given records.

All work on marginals that were counted by Spark and made noisy before; the tables found have at most MOST_ROWS rows
and are drawn from with replacement, by a stable hash, for any number of records."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.domain import Domain

MOST_ROWS = 10_000
Margins = dict[tuple[str, ...], np.ndarray]


class Cells:
    """The shares wanted of all marginals' cells in one vector, and each record's cells in it."""

    def __init__(self, domain: Domain, margins: Margins):
        self.domain, self.names, at = domain, list(margins), 0
        self.strides, self.starts, wanted = [], [], []
        for name in self.names:
            row = np.zeros(len(domain), np.int64)
            row[list(domain.places(name))] = domain.strides(name)
            self.strides.append(row)
            self.starts.append(at)
            v = np.maximum(np.asarray(margins[name], float).ravel(), 0)
            wanted.append(v / max(v.sum(), 1e-12))
            at += len(v)
        self.strides, self.starts = np.array(self.strides).T, np.array(self.starts)
        self.wanted = np.concatenate(wanted)

    def of(self, records: np.ndarray) -> np.ndarray:
        return records @ self.strides + self.starts

    def counts(self, records: np.ndarray) -> np.ndarray:
        return np.bincount(self.of(records).ravel(), minlength=len(self.wanted)).astype(float)

    def error(self, records: np.ndarray) -> float:
        return float(((self.counts(records) / len(records) - self.wanted) ** 2).sum())


def _start(domain: Domain, margins: Margins, rows: int, rng: np.random.Generator) -> np.ndarray:
    out = np.empty((rows, len(domain)), np.int64)
    for k, a in enumerate(domain.attrs):
        p = np.maximum(np.asarray(margins.get((a,), np.ones(domain[a])), float), 0)
        out[:, k] = rng.choice(domain[a], rows, p=p / p.sum() if p.sum() > 0 else None)
    return out


def genetic(domain: Domain, margins: Margins, rows: int = 1000, generations: int = 5000, mutants: int = 50, crosses: int = 50, seed: int = 0, patience: int = 500, start: np.ndarray | None = None) -> np.ndarray:
    """Rows of codes. Each generation offers mutants (one value of one row changed) and crosses (one row takes the
    place of another); the best child follows its parent if it fits better. A child differs in one row, so its
    error is updated in the few cells that the row leaves and enters. start: a table to go on from, of any number of rows."""
    if start is not None:
        rows = len(start)
    if not 0 < rows <= MOST_ROWS:
        raise ValueError(f"rows must lie between 1 and {MOST_ROWS}")
    rng, cells = np.random.default_rng(seed), Cells(domain, margins)
    table = _start(domain, margins, rows, rng) if start is None else np.array(start, np.int64)
    gap, idle = cells.counts(table) / rows - cells.wanted, 0
    for _ in range(generations):
        who = rng.integers(0, rows, mutants + crosses)
        old, new = table[who], table[who].copy()
        which = rng.integers(0, len(domain), mutants)
        new[np.arange(mutants), which] = rng.integers(0, np.array(domain.shape)[which])
        new[mutants:] = table[rng.integers(0, rows, crosses)]
        out, into = cells.of(old), cells.of(new)
        moved = out != into
        change = np.where(moved, 2 / rows * (gap[into] - gap[out]) + 2 / rows**2, 0).sum(axis=1)
        best = int(change.argmin())
        if change[best] < -1e-15:
            np.subtract.at(gap, out[best], 1 / rows)
            np.add.at(gap, into[best], 1 / rows)
            table[who[best]], idle = new[best], 0
        else:
            idle += 1
            if idle >= patience:
                break
    return table


def relaxed(domain: Domain, margins: Margins, rows: int = 200, steps: int = 500, rate: float = 0.05, seed: int = 0) -> np.ndarray:
    """Rows of codes from a relaxed table: each row holds a distribution per attribute (a softmax), a marginal is the
    mean over rows of their products, and the squared error is followed down by Adam. Codes are drawn at the end."""
    if not 0 < rows <= MOST_ROWS:
        raise ValueError(f"rows must lie between 1 and {MOST_ROWS}")
    rng = np.random.default_rng(seed)
    start = _start(domain, margins, rows, rng)
    logits = {a: rng.normal(0, 0.1, (rows, domain[a])) + 2 * (start[:, k : k + 1] == np.arange(domain[a])) for k, a in enumerate(domain.attrs)}
    wanted = {c: (v := np.maximum(np.asarray(m, float).reshape(domain.project(c).shape), 0)) / max(v.sum(), 1e-12) for c, m in margins.items()}
    first, second = ({a: np.zeros_like(x) for a, x in logits.items()} for _ in range(2))

    def soft() -> dict[str, np.ndarray]:
        out = {a: np.exp(x - x.max(axis=1, keepdims=True)) for a, x in logits.items()}
        return {a: x / x.sum(axis=1, keepdims=True) for a, x in out.items()}

    for i in range(1, steps + 1):
        p = soft()
        slope = {a: np.zeros_like(x) for a, x in p.items()}
        for c, w in wanted.items():
            if len(c) == 1:
                slope[c[0]] += p[c[0]].mean(axis=0) - w
                continue
            axes = range(1, len(c) + 1)  # axis 0 is the row
            each = [part for a, k in zip(c, axes, strict=True) for part in (p[a], [0, k])]
            gap = np.einsum(*each, list(axes), optimize=True) / rows - w
            for k, a in zip(axes, c, strict=True):
                slope[a] += np.einsum(gap, list(axes), *each[: 2 * k - 2], *each[2 * k :], [0, k], optimize=True)
        for a in logits:
            g = p[a] * (slope[a] - (slope[a] * p[a]).sum(axis=1, keepdims=True))
            first[a], second[a] = 0.9 * first[a] + 0.1 * g, 0.999 * second[a] + 0.001 * g * g
            logits[a] -= rate * (first[a] / (1 - 0.9**i)) / (np.sqrt(second[a] / (1 - 0.999**i)) + 1e-12)
    p = soft()
    return np.column_stack([(np.cumsum(p[a], axis=1) < rng.random((rows, 1))).sum(axis=1).clip(0, domain[a] - 1) for a in domain.attrs])


def best_mixture(domain: Domain, margins: Margins, records: np.ndarray, rounds: int = 2000, rate: float = 0.5) -> np.ndarray:
    """Weights (of sum one) on given records whose marginals are nearest those wanted, by multiplicative updates."""
    cells = Cells(domain, margins)
    at, w = cells.of(np.asarray(records)), np.full(len(records), 1 / len(records))
    best = (np.inf, w)
    for i in range(rounds):
        gap = np.bincount(at.ravel(), weights=np.repeat(w, at.shape[1]), minlength=len(cells.wanted)) - cells.wanted
        if (error := float(gap @ gap)) < best[0]:
            best = (error, w)
        slope = gap[at].sum(axis=1)
        w = w * np.exp(-rate / np.sqrt(1 + i / 100) * (slope - slope.min()))
        w /= w.sum()
    return best[1]


def drawn(spark: SparkSession, domain: Domain, table: np.ndarray, n: int, seed: int = 0, weights: Sequence[float] | None = None) -> DataFrame:
    """n records (row_id and a column per attribute), rows of the table with replacement, by share of weight."""
    if len(table) > MOST_ROWS:
        raise ValueError(f"a table to draw from has at most {MOST_ROWS} rows")
    upto = np.cumsum(np.ones(len(table)) if weights is None else np.asarray(weights, float))
    keys = np.floor(upto / upto[-1] * (1 << 14)).astype(int) if weights is not None else np.arange(1, len(table) + 1)
    owner = np.searchsorted(keys, np.arange(keys[-1]), side="right")  # a row of the table for each of 2^14 draws, or each row once
    frame = spark.createDataFrame([(i, *map(int, table[o])) for i, o in enumerate(owner)], "__draw long, " + ", ".join(f"`{a}` int" for a in domain.attrs))
    rows = spark.range(n).select(F.col("id").alias("row_id"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(owner))).alias("__draw"))
    return rows.join(F.broadcast(frame), "__draw").drop("__draw")
