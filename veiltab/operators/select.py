"""Choice of marginals: by dependency against noise, by error of a model, by private selection. Tables here have a row
per pair of attributes, so this is driver work."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from ..functions.domain import Domain


def greedy_pairs(scores: dict[tuple[str, str], float], cells: dict[tuple[str, str], int], rho: float, threshold: float = 0.0) -> list[tuple[str, str]]:
    """Pairs that lessen noise error of the chosen plus dependency error of the rest; budget is split by cells^(2/3)."""
    chosen: list[tuple[str, str]] = []
    size = {p: c ** (2 / 3) for p, c in cells.items()}
    lost, total, now = sum(scores.values()), 0.0, sum(scores.values())
    rest = sorted(scores)
    while rest:
        # The noise of all chosen is sqrt(S / (pi rho)) * S, with S the sum of their sizes.
        after = {p: (total + size[p]) ** 1.5 / math.sqrt(math.pi * rho) + lost - scores[p] for p in rest}
        best = min(rest, key=after.get)
        if now - after[best] <= threshold:
            break
        chosen.append(best)
        rest.remove(best)
        total, lost, now = total + size[best], lost - scores[best], after[best]
    return chosen


def two_way(df: DataFrame, domain: Domain, rho_score: float, rho_measure: float, rng: np.random.Generator) -> list[tuple[str, ...]]:
    """Pairs of a coded table that are worth measuring with rho_measure, chosen from dependency scores noised with rho_score."""
    from .marginals import indif_pairs

    pairs = [(a, b) for k, a in enumerate(domain.attrs) for b in domain.attrs[k + 1 :]]
    found = {domain.ordered((r["a"], r["b"])): float(r["indif"]) for r in indif_pairs(df, list(domain.attrs)).collect()}  # a row per pair
    scores = {p: found[p] + rng.normal(0, np.sqrt(8 * len(pairs) / rho_score)) for p in pairs}
    return greedy_pairs(scores, {p: domain.size(p) for p in pairs}, rho_measure)


def with_isolated(attrs: Sequence[str], pairs: list[tuple[str, ...]], scores: dict[tuple[str, str], float], connect: bool = True) -> list[tuple[str, ...]]:
    """Attributes in no pair get their strongest partner, or stand alone."""
    out = list(pairs)
    for a in attrs:
        if any(a in p for p in out):
            continue
        mine = [p for p in scores if a in p]
        out.append(max(mine, key=lambda p: (scores[p], p)) if connect and mine else (a,))
    return out


def cliques(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[tuple[str, ...]]:
    """Maximal cliques, by pivoting."""
    near: dict[str, set] = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out, stack = [], [(frozenset(), set(near), set())]
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            out.append(tuple(sorted(r)))
            continue
        pivot = max(p | x, key=lambda n: (len(near[n] & p), n))
        for v in sorted(p - near[pivot]):
            stack.append((r | {v}, p & near[v], x & near[v]))
            p, x = p - {v}, x | {v}
    return sorted(out)


def combined(domain: Domain, pairs: list[tuple[str, ...]], most_cells: int = 5000, most_used: int = 2) -> list[tuple[str, ...]]:
    """Cliques of three and more in place of their pairs, the largest first, where few of their attributes are used yet."""
    edges = [p for p in pairs if len(p) == 2]
    chosen, used, covered = [], set(), set()
    for c in sorted((c for c in cliques(domain.attrs, edges) if len(c) > 2), key=lambda c: (-len(c), c)):
        if len(used & set(c)) <= most_used and domain.size(c) < most_cells:
            chosen.append(domain.ordered(c))
            used |= set(c)
            covered |= {frozenset(p) for p in combinations(c, 2)}
    return chosen + [p for p in pairs if frozenset(p) not in covered]


def workload(domain: Domain, degree: int, most_cells: int = 250_000, most: int | None = None, seed: int = 0) -> list[tuple[str, ...]]:
    out = [c for c in combinations(domain.attrs, degree) if domain.size(c) <= most_cells]
    if most is not None and len(out) > most:
        out = [out[i] for i in sorted(np.random.default_rng(seed).choice(len(out), most, replace=False))]
    return out


def downward_closure(cliques_: Iterable[tuple[str, ...]]) -> list[tuple[str, ...]]:
    return sorted({s for c in cliques_ for k in range(1, len(c) + 1) for s in combinations(c, k)}, key=lambda s: (len(s), s))


def workload_weights(closure: Iterable[tuple[str, ...]], wanted: Iterable[tuple[str, ...]]) -> dict[tuple[str, ...], float]:
    wanted = [set(w) for w in wanted]
    return {c: float(sum(len(w & set(c)) for w in wanted)) for c in closure}


def exponential_mechanism(quality: Sequence[float], epsilon: float, sensitivity: float, rng: np.random.Generator) -> int:
    """Gumbel-max form of a choice with probability proportional to exp(epsilon * quality / (2 * sensitivity))."""
    q = np.asarray(quality, float)
    return int(np.argmax(0.5 * epsilon / sensitivity * (q - q.max()) + rng.gumbel(size=len(q))))


def permute_and_flip(quality: Sequence[float], epsilon: float, sensitivity: float, rng: np.random.Generator) -> int:
    q = np.asarray(quality, float)
    p = np.exp(0.5 * epsilon / sensitivity * (q - q.max()))
    return next(int(i) for i in rng.permutation(len(q)) if rng.random() <= p[i])


def pareto_efficient(costs: np.ndarray) -> np.ndarray:
    """Rows that no other row beats in every column and is less in one."""
    less = (costs[:, None, :] <= costs[None, :, :]).all(axis=2) & (costs[:, None, :] < costs[None, :, :]).any(axis=2)
    return ~less.any(axis=0)


def generalized_exponential(quality: Sequence[float], sensitivities: Sequence[float], epsilon: float, beta: float, rng: np.random.Generator) -> int:
    """A choice among qualities of different sensitivity: by the least margin over every other, of sensitivity one."""
    q, s = np.asarray(quality, float), np.asarray(sensitivities, float)
    t = 2 * math.log(len(q) / beta) / epsilon
    shifted = q - t * s
    score = ((shifted[:, None] - shifted[None, :]) / (s[:, None] + s[None, :])).min(axis=1)
    return exponential_mechanism(score, epsilon, 1.0, rng)


def worst_approximated(answers: dict[tuple[str, ...], np.ndarray], model: Callable[[tuple[str, ...]], np.ndarray], weights: dict[tuple[str, ...], float], epsilon: float, sigma: float, rng: np.random.Generator) -> tuple[str, ...]:
    """The candidate of largest error beyond what its noise would make, privately."""
    names = sorted(answers)
    errors = [weights[c] * (float(np.abs(answers[c] - model(c)).sum()) - math.sqrt(2 / math.pi) * sigma * answers[c].size) for c in names]
    return names[exponential_mechanism(errors, epsilon, max(weights[c] for c in names), rng)]
