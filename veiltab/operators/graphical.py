"""Graphical models of a table from measured marginals: factors, junction trees, belief propagation, estimation.

Counting rows is Spark's work and is done before; here are tables of cells, bounded by MOST_CELLS for each clique.
Records drawn from a model are a DataFrame again: a column at a time from conditional tables, without a shuffle."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.domain import Domain
from . import synth

Clique = tuple[str, ...]
#: Most cells of a clique of a junction tree: 32 MB of numbers, also the bound of what is sent to executors to draw a column.
MOST_CELLS = 1 << 22


@dataclass(frozen=True)
class Factor:
    """Numbers for each cell of a domain, most often logarithms."""

    domain: Domain
    values: np.ndarray

    @classmethod
    def zeros(cls, domain: Domain) -> Factor:
        return cls(domain, np.zeros(domain.shape))

    @classmethod
    def active(cls, domain: Domain, impossible: Sequence[Sequence[int]]) -> Factor:
        """0, but -inf in cells that cannot be."""
        out = np.zeros(domain.shape)
        for cell in impossible:
            out[tuple(cell)] = -np.inf
        return cls(domain, out)

    def to(self, domain: Domain) -> np.ndarray:
        """values shaped so that they broadcast over a domain that contains this one."""
        order = [a for a in domain.attrs if a in self.domain]
        out = self.values.transpose(self.domain.places(order)) if order else self.values
        return out.reshape([domain[a] if a in self.domain else 1 for a in domain.attrs])

    def _with(self, other: Factor | float, op: Callable) -> Factor:
        if not isinstance(other, Factor):
            return Factor(self.domain, op(self.values, other))
        whole = self.domain | other.domain
        return Factor(whole, op(self.to(whole), np.broadcast_to(other.to(whole), whole.shape)))

    def __add__(self, other):
        return self._with(other, np.add)

    def __sub__(self, other):
        # -inf less -inf is -inf: what cannot be stays so
        return self._with(other, lambda a, b: np.where(np.isneginf(b), -np.inf, a - np.where(np.isneginf(b), 0, b)))

    def __mul__(self, other):
        return self._with(other, np.multiply)

    def exp(self) -> Factor:
        return Factor(self.domain, np.exp(self.values))

    def _down(self, attrs: Sequence[str], reduce: Callable[[np.ndarray, tuple[int, ...]], np.ndarray]) -> Factor:
        gone = self.domain.without(attrs)
        kept = self.domain.without(gone.attrs)
        out = Factor(kept, np.asarray(reduce(self.values, self.domain.places(gone.attrs))))
        return Factor(self.domain.project(attrs), out.values.transpose(kept.places(attrs)) if attrs else out.values)

    def project(self, attrs: Sequence[str]) -> Factor:
        return self._down(tuple(attrs), lambda v, axes: v.sum(axis=axes))

    def log_project(self, attrs: Sequence[str]) -> Factor:
        def reduce(v: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
            if not axes:
                return v
            top = v.max(axis=axes, keepdims=True)
            top = np.where(np.isneginf(top), 0, top)
            with np.errstate(divide="ignore"):
                return np.log(np.exp(v - top).sum(axis=axes)) + np.squeeze(top, axis=axes)

        return self._down(tuple(attrs), reduce)

    def condition(self, evidence: dict[str, int]) -> Factor:
        place = tuple(evidence.get(a, slice(None)) for a in self.domain.attrs)
        return Factor(self.domain.without(evidence), np.asarray(self.values[place]))


def elimination(domain: Domain, cliques: Sequence[Clique]) -> tuple[list[str], list[Clique]]:
    """(order, cliques of the triangulated graph): each time the attribute goes whose neighbours make the fewest cells."""
    near: dict[str, set[str]] = {a: set() for a in domain.attrs}
    for c in cliques:
        for a, b in combinations(c, 2):
            near[a].add(b)
            near[b].add(a)
    order, made, left = [], [], set(domain.attrs)
    while left:
        a = min(left, key=lambda x: (domain.size(near[x]) * domain[x], domain.places((x,))))
        made.append(domain.ordered({a, *near[a]}))
        for b, c in combinations(near[a], 2):
            near[b].add(c)
            near[c].add(b)
        for b in near[a]:
            near[b].discard(a)
        near[a] = set()
        order.append(a)
        left.discard(a)
    return order, [c for i, c in enumerate(made) if not any(set(c) < set(d) or (c == d and j < i) for j, d in enumerate(made))]


class JunctionTree:
    """Maximal cliques of the triangulated graph, joined by a spanning tree of greatest separators."""

    def __init__(self, domain: Domain, cliques: Sequence[Clique], most_cells: int = MOST_CELLS):
        self.domain = domain
        self.order, self.cliques = elimination(domain, cliques)
        if (cells := max(domain.size(c) for c in self.cliques)) > most_cells:
            raise ValueError(f"a clique of the model has {cells} cells, more than {most_cells}")
        self.near: dict[Clique, list[Clique]] = {c: [] for c in self.cliques}
        group = {c: c for c in self.cliques}

        def root(c: Clique) -> Clique:
            while group[c] != c:
                c = group[c]
            return c

        for a, b in sorted(combinations(self.cliques, 2), key=lambda p: -len(set(p[0]) & set(p[1]))):
            if root(a) != root(b):
                group[root(a)] = root(b)
                self.near[a].append(b)
                self.near[b].append(a)

    @property
    def cells(self) -> int:
        return sum(self.domain.size(c) for c in self.cliques)

    def messages(self) -> list[tuple[Clique, Clique]]:
        """Each edge both ways: towards the first clique from the leaves, then back."""
        up, stack, seen = [], [self.cliques[0]], {self.cliques[0]}
        while stack:
            c = stack.pop()
            for d in self.near[c]:
                if d not in seen:
                    seen.add(d)
                    up.append((d, c))
                    stack.append(d)
        return up[::-1] + [(b, a) for a, b in up]

    def holder(self, clique: Clique) -> Clique:
        return min((c for c in self.cliques if set(clique) <= set(c)), key=self.domain.size)


def propagated(tree: JunctionTree, potentials: dict[Clique, Factor]) -> tuple[dict[Clique, Factor], float]:
    """(log marginals of each clique that sum to one, log of the partition function)."""
    sent: dict[tuple[Clique, Clique], Factor] = {}
    for a, b in tree.messages():
        belief = potentials[a]
        for c in tree.near[a]:
            if c != b:
                belief = belief + sent[(c, a)]
        sent[(a, b)] = belief.log_project(tree.domain.ordered(set(a) & set(b)))
    out = {}
    for c in tree.cliques:
        belief = potentials[c]
        for d in tree.near[c]:
            belief = belief + sent[(d, c)]
        out[c] = Factor(belief.domain.project(c), belief.values.transpose(belief.domain.places(c)))
    log_z = float(out[tree.cliques[0]].log_project(()).values)
    return {c: f - log_z for c, f in out.items()}, log_z


@dataclass(frozen=True)
class Measurement:
    """Noisy answers to queries on a clique's cells; queries: a matrix with a column per cell, None for the cells themselves."""

    clique: Clique
    answers: np.ndarray
    sigma: float = 1.0
    queries: np.ndarray | None = None


def estimated_total(measurements: Sequence[Measurement]) -> float:
    """Each measurement's own estimate of the number of rows, weighted by inverse variance."""
    found = []
    for m in measurements:
        if m.queries is None:
            found.append((float(np.sum(m.answers)), m.sigma**2 * np.size(m.answers)))
            continue
        v, gap = np.linalg.lstsq(m.queries.T, np.ones(m.queries.shape[1]), rcond=None)[:2]
        if np.allclose(m.queries.T @ v, 1):
            found.append((float(v @ np.ravel(m.answers)), m.sigma**2 * float(v @ v)))
    if not found:
        return 1.0
    weights = [1 / max(s, 1e-12) for _, s in found]
    return max(1.0, float(np.average([t for t, _ in found], weights=weights)))


@dataclass
class Model:
    tree: JunctionTree
    potentials: dict[Clique, Factor]
    total: float

    def __post_init__(self):
        self.logs, self.log_z = propagated(self.tree, self.potentials)

    def project(self, attrs: Sequence[str]) -> Factor:
        """Expected counts: from a clique that holds attrs, else by eliminating all other attributes of the tree."""
        attrs = tuple(attrs)
        if any(set(attrs) <= set(c) for c in self.tree.cliques):
            return self.logs[self.tree.holder(attrs)].log_project(attrs).exp() * self.total
        factors = list(self.potentials.values())
        for a in [x for x in self.tree.order if x not in attrs]:
            mine = [f for f in factors if a in f.domain]
            joint = mine[0]
            for f in mine[1:]:
                joint = joint + f
            if joint.domain.size() > MOST_CELLS:
                raise ValueError(f"the marginal of {attrs} needs a table of {joint.domain.size()} cells")
            factors = [f for f in factors if a not in f.domain] + [joint.log_project(joint.domain.without([a]).attrs)]
        out = Factor.zeros(self.tree.domain.project(attrs))
        for f in factors:
            out = out + f
        return Factor(out.domain, np.exp(out.values - self.log_z)) * self.total

    def sample(self, spark: SparkSession, n: int, seed: int = 0, how: str = "sample") -> DataFrame:
        """n records (row_id and a column per attribute), drawn against the order of elimination.

        how "sample": by inverse distribution at a stable hash of row_id, which needs no shuffle at any n;
        "round": exact counts within each cell of the attributes before, which ranks rows by a shuffle."""
        if how not in ("sample", "round"):
            raise ValueError("how must be sample or round")
        records, have = spark.range(n).withColumnRenamed("id", "row_id"), []
        held, left = {}, set(self.tree.domain.attrs)
        for a in self.tree.order:  # neighbours that are eliminated later
            held[a] = {b for c in self.tree.cliques if a in c for b in c} & left - {a}
            left.discard(a)
        for k, a in enumerate(reversed(self.tree.order)):
            anchors = tuple(b for b in have if b in held[a])
            clique = self.tree.holder((*anchors, a))  # neighbours that are eliminated later make a clique with it
            joint = self.logs[clique].log_project((*anchors, a)).exp().values
            sizes = [self.tree.domain[b] for b in anchors]
            if how == "round" and anchors:
                records = synth.append_attribute(records, anchors, a, joint, sizes, seed + k)
            elif how == "round":
                records = records.withColumn(a, synth.value_at(synth.place_of(n, seed + k), synth.whole_counts(joint, n)))
            else:
                records = _drawn(records, anchors, a, joint, sizes, seed)
            have.append(a)
        return records.select("row_id", *self.tree.domain.attrs)

    def save(self, path: str) -> None:
        """The tree and its potentials as JSON: small tables of cells."""
        body = {"sizes": dict(self.tree.domain.sizes), "cliques": [list(c) for c in self.tree.cliques], "total": self.total, "potentials": [[list(c), f.values.tolist()] for c, f in self.potentials.items()]}
        with open(path, "w", encoding="utf-8") as f:
            json.dump(body, f)

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, encoding="utf-8") as f:
            body = json.load(f)
        domain = Domain(body["sizes"])
        tree = JunctionTree(domain, [tuple(c) for c in body["cliques"]])
        return cls(tree, {tuple(c): Factor(domain.project(c), np.array(v, float)) for c, v in body["potentials"]}, body["total"])

    def error(self, measurements: Sequence[Measurement]) -> float:
        """Squared error against measurements, in their variances."""
        return sum(float((_answers(self.project(m.clique).values, m) ** 2).sum()) / 2 for m in measurements)


def _drawn(records: DataFrame, anchors: Clique, attr: str, joint: np.ndarray, sizes: Sequence[int], seed: int) -> DataFrame:
    u = F.pmod(F.xxhash64("row_id", F.lit(seed), F.lit(attr)), F.lit(1 << 40)) / float(1 << 40)
    rows = np.maximum(joint, 0).reshape(-1, joint.shape[-1])
    empty = rows.sum(axis=1) <= 0
    rows[empty] = rows.sum(axis=0) if rows.sum() > 0 else 1.0
    upto = np.cumsum(rows, axis=1)
    upto /= upto[:, -1:]
    below: Callable[[Column], Column] = lambda t: F.least(F.size(F.filter(t, lambda x: x <= u)), F.lit(rows.shape[1] - 1)).cast("int")
    if not anchors:
        return records.withColumn(attr, below(F.array(*(F.lit(float(v)) for v in upto[0]))))
    cell: Column = F.lit(0).cast("long")
    for a, s in zip(anchors, sizes, strict=True):
        cell = cell * s + F.col(a)
    table = records.sparkSession.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(upto)], "__cell long, __upto array<double>")
    joined = records.withColumn("__cell", cell).join(F.broadcast(table), "__cell")  # MOST_CELLS numbers at most
    return joined.withColumn(attr, below(F.col("__upto"))).drop("__cell", "__upto")


def _answers(values: np.ndarray, m: Measurement) -> np.ndarray:
    """The residual of a measurement in standard deviations."""
    got = values.ravel() if m.queries is None else m.queries @ values.ravel()
    return (got - np.ravel(m.answers)) / m.sigma


def _gradient(tree: JunctionTree, logs: dict[Clique, Factor], measurements: Sequence[Measurement], total: float, norm: str) -> tuple[float, dict[Clique, Factor]]:
    slope = {c: np.zeros(tree.domain.project(c).shape) for c in tree.cliques}
    loss, margins = 0.0, {c: f.exp() * total for c, f in logs.items()}
    for m in measurements:
        c = tree.holder(m.clique)
        at = margins[c].project(m.clique)
        gap = _answers(at.values, m)
        loss += float(np.abs(gap).sum()) if norm == "L1" else float(gap @ gap) / 2
        each = (np.sign(gap) if norm == "L1" else gap) / m.sigma
        each = each if m.queries is None else m.queries.T @ each
        slope[c] = slope[c] + Factor(at.domain, each.reshape(at.domain.shape)).to(margins[c].domain)
    return loss, {c: Factor(margins[c].domain, g) for c, g in slope.items()}


def _inner(a: dict[Clique, Factor], b: dict[Clique, Factor]) -> float:
    return sum(float((a[c].values * b[c].values).sum()) for c in a)


def estimate(domain: Domain, measurements: Sequence[Measurement], total: float | None = None, rounds: int = 500, warm: Model | None = None, impossible: dict[Clique, Sequence[Sequence[int]]] | None = None,
             norm: str = "L2", how: str = "mirror", report: Callable[[int, float], None] | None = None) -> Model:
    """The model of greatest entropy among those that fit the measurements best.

    how "mirror": mirror descent with a halving line search; "dual": averaged gradients (no line search, for L1).
    warm: a model whose potentials are begun with. impossible: cells by clique that hold no rows."""
    if how not in ("mirror", "dual") or norm not in ("L1", "L2"):
        raise ValueError("how is mirror or dual, norm is L1 or L2")
    total = estimated_total(measurements) if total is None else total
    impossible = impossible or {}
    tree = JunctionTree(domain, [*(m.clique for m in measurements), *impossible, *(warm.tree.cliques if warm else ())])
    theta = {c: Factor.zeros(domain.project(c)) for c in tree.cliques}
    for clique, f in [*(warm.potentials.items() if warm else ()), *((k, Factor.active(domain.project(k), v)) for k, v in impossible.items())]:
        c = tree.holder(clique)
        theta[c] = Factor(theta[c].domain, theta[c].values + f.to(theta[c].domain))
    logs, _ = propagated(tree, theta)
    loss, slope = _gradient(tree, logs, measurements, total, norm)
    if how == "dual":
        return _dual(tree, theta, measurements, total, rounds, norm, report)
    step = 1 / total**2
    for i in range(rounds):
        step *= 2
        now = {c: f.exp() * total for c, f in logs.items()}
        for _ in range(25):
            after = {c: theta[c] - slope[c] * step for c in theta}
            logs_after, _ = propagated(tree, after)
            loss_after, slope_after = _gradient(tree, logs_after, measurements, total, norm)
            moved = {c: Factor(f.domain, now[c].values - np.exp(f.values) * total) for c, f in logs_after.items()}
            if loss - loss_after >= 0.5 * _inner(slope, moved):
                break
            step /= 2
        else:
            break
        done = abs(loss - loss_after) <= 1e-9 * max(loss, 1e-9)
        theta, logs, loss, slope = after, logs_after, loss_after, slope_after
        if report:
            report(i + 1, loss)
        if done:
            break
    return Model(tree, theta, total)


def _dual(tree: JunctionTree, begin: dict[Clique, Factor], measurements: Sequence[Measurement], total: float, rounds: int, norm: str, report: Callable[[int, float], None] | None) -> Model:
    sums = {c: Factor.zeros(f.domain) for c, f in begin.items()}
    best: tuple[float, dict[Clique, Factor]] = (math.inf, begin)
    theta, scale = begin, 0.0
    for i in range(rounds):
        logs, _ = propagated(tree, theta)
        loss, slope = _gradient(tree, logs, measurements, total, norm)
        if loss < best[0]:
            best = (loss, theta)
        if report:
            report(i + 1, loss)
        scale += max(float(np.abs(f.values).max()) for f in slope.values()) ** 2
        sums = {c: sums[c] + slope[c] for c in sums}
        step = 1 / math.sqrt(max(scale, 1e-300))
        theta = {c: begin[c] - sums[c] * step for c in sums}
    return Model(tree, best[1], total)


def model_cells(domain: Domain, cliques: Sequence[Clique]) -> int:
    """Cells of the junction tree that these cliques would need; no tables are made."""
    return sum(domain.size(c) for c in elimination(domain, cliques)[1])


def feasibility(model: Model, measurements: Sequence[Measurement]) -> float:
    """Mean over measurements on cells of half the L1 distance of model and answers, as a share of the total."""
    gaps = [float(np.abs(model.project(m.clique).values.ravel() - np.ravel(m.answers)).sum()) / 2 / model.total for m in measurements if m.queries is None]
    return float(np.mean(gaps)) if gaps else 0.0
