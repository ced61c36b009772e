"""Noisy marginals made to agree: equal totals and equal projections on what they share, and no negative cells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from ..functions.domain import Domain

Margins = dict[tuple[str, ...], np.ndarray]


def project(attrs: Sequence[str], values: np.ndarray, onto: Sequence[str]) -> np.ndarray:
    """values of a marginal summed down to some of its attributes, in their order."""
    kept = [a for a in attrs if a in onto]
    out = values.sum(axis=tuple(k for k, a in enumerate(attrs) if a not in onto))
    return out.transpose([kept.index(a) for a in onto]) if len(onto) > 1 else out


def dependencies(keys: Sequence[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Intersections of marginals, closed under intersection, the smallest first; one agrees on subsets before supersets."""
    found = {frozenset()}
    sets = [frozenset(k) for k in keys]
    for i, a in enumerate(sets):
        for b in sets[i + 1 :]:
            found.add(a & b)
    grew = True
    while grew:
        grew = False
        for a in list(found):
            for b in list(found):
                if a & b not in found:
                    found.add(a & b)
                    grew = True
    return sorted((tuple(sorted(x)) for x in found), key=lambda x: (len(x), x))


def agree_on(domain: Domain, margins: Margins, shared: tuple[str, ...]) -> None:
    """The projections on shared become their average, weighted by inverse variance; each change is spread evenly."""
    mine = [k for k in margins if set(shared) <= set(k)]
    if len(mine) < 2:
        return
    parts = {k: project(k, margins[k], shared) for k in mine}
    weight = {k: domain.size(shared) / domain.size(k) for k in mine}  # a projected cell sums this many noisy cells
    mean = sum(parts[k] * weight[k] for k in mine) / sum(weight.values())
    for k in mine:
        spread = domain.size(k) // domain.size(shared)
        change = (mean - parts[k]) / spread
        order = [a for a in k if a in shared]
        if len(shared) > 1:
            change = change.transpose([shared.index(a) for a in order])
        margins[k] = margins[k] + np.asarray(change).reshape([domain[a] if a in shared else 1 for a in k])


def norm_sub(x: np.ndarray, total: float) -> np.ndarray:
    """The nearest array of a total without negative cells: one amount is taken off, what falls below zero is cut."""
    if total <= 0:
        return np.zeros_like(x)
    flat = np.sort(x.ravel())[::-1]
    sums = np.cumsum(flat) - total
    k = np.flatnonzero(flat - sums / np.arange(1, len(flat) + 1) > 0)[-1]
    return np.maximum(x - sums[k] / (k + 1), 0)


def norm_cut(x: np.ndarray, total: float) -> np.ndarray:
    """Negative cells become zero; the smallest positive ones follow until the total is kept."""
    out = np.maximum(x, 0).ravel()
    over = out.sum() - total
    for i in np.argsort(out, kind="stable"):
        if over <= 0:
            break
        cut = min(out[i], over)
        out[i] -= cut
        over -= cut
    return out.reshape(x.shape)


NONNEGATIVE = {"norm_sub": norm_sub, "norm_cut": norm_cut}


def consistent(domain: Domain, margins: Margins, rounds: int = 100, how: str = "norm_sub", total: float | None = None) -> Margins:
    """Alternates agreement and non-negativity; ends with non-negative marginals of one total."""
    out = {k: np.asarray(v, float).reshape(domain.project(k).shape) for k, v in margins.items()}
    if total is None:
        total = max(0.0, float(np.average([v.sum() for v in out.values()], weights=[1 / v.size for v in out.values()])))
    shared = dependencies(list(out))
    for _ in range(rounds):
        for s in shared:
            agree_on(domain, out, s)
        low = min(float(v.min()) for v in out.values())
        if low >= -1e-9 * max(total, 1):
            break
        out = {k: NONNEGATIVE[how](v, total) for k, v in out.items()}
    return {k: norm_sub(v, total) for k, v in out.items()}
