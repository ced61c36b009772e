"""Search of a model's structure: a graph of attributes, the sets that its cliques let be measured, and their choice.

All of it works on scores of pairs and on counts of small sets, which Spark has counted before. A graph has a node per
attribute, so this is driver work."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from itertools import combinations

import numpy as np

from ..functions.domain import Domain
from .graphical import elimination
from .select import downward_closure, exponential_mechanism

Clique = tuple[str, ...]
Scores = Mapping[tuple[str, str], float]


def maximal(sets: Iterable[Clique]) -> list[Clique]:
    """Those that no other holds."""
    out: list[Clique] = []
    for c in sorted(set(sets), key=lambda c: (-len(c), c)):
        if not any(set(c) <= set(o) for o in out):
            out.append(c)
    return sorted(out)


def triangulated(domain: Domain, edges: Iterable[tuple[str, str]]) -> tuple[set[Clique], list[Clique]]:
    """(the edges with those that a triangulation adds, its maximal cliques)."""
    cliques = maximal(elimination(domain, list(edges))[1])
    return {p for c in cliques for p in combinations(domain.ordered(c), 2)}, cliques


def search_graph(domain: Domain, scores: Scores, most_cells: int, price: float = 0.0) -> tuple[set[Clique], list[Clique]]:
    """The edges and cliques of a graph found by adding or removing one edge at a time while that helps.

    A graph is worth the scores of all pairs inside a clique of its triangulation, less `price` for each cell of its
    cliques; no clique has more than most_cells cells."""
    of = {domain.ordered(p): s for p, s in scores.items()}

    def worth(edges: frozenset[Clique]) -> float:
        filled, cliques = triangulated(domain, edges)
        cells = [domain.size(c) for c in cliques]
        if any(n > most_cells for n, c in zip(cells, cliques, strict=True) if len(c) > 1):
            return -math.inf
        return sum(of.get(p, 0.0) for p in filled) - price * sum(cells)

    edges: frozenset[Clique] = frozenset()
    now = worth(edges)
    while of:
        near = [(worth(edges ^ {p}), p) for p in sorted(of)]
        best, pair = max(near, key=lambda x: x[0])
        if best <= now + 1e-9 * max(1.0, abs(now)):
            break
        edges, now = edges ^ {pair}, best
    return triangulated(domain, edges)


def maximal_sets(domain: Domain, names: Sequence[str], room: float) -> list[Clique]:
    """Sets of names with at most `room` cells that no further name fits."""
    found: list[Clique] = []
    stack: list[tuple[int, Clique, int]] = [(0, (), 1)]
    while stack:
        k, chosen, cells = stack.pop()
        if k == len(names):
            found.append(chosen)
            continue
        more = cells * domain[names[k]]
        if more <= room:
            stack.append((k + 1, (*chosen, names[k]), more))
        stack.append((k + 1, chosen, cells))
    return maximal(found)


def network(domain: Domain, cliques: Sequence[Clique], scores: Scores, most_cells: int) -> list[tuple[str, Clique]]:
    """(attribute, its parents) in the order of a Bayesian network: parents come earlier, share a clique with the attribute,
    and have at most most_cells cells with it. The strongest tie to what is placed goes first."""
    of = {frozenset(p): s for p, s in scores.items()}

    def tie(a: str, others: Iterable[str]) -> float:
        return sum(of.get(frozenset((a, b)), 0.0) for b in others)

    out: list[tuple[str, Clique]] = []
    left = list(domain.attrs)
    while left:
        placed = {a for a, _ in out}
        best: tuple[float, int, str, Clique] | None = None
        for a in left:
            offers = {domain.ordered(s) for c in cliques if a in c for s in maximal_sets(domain, [b for b in domain.ordered(c) if b in placed], most_cells / domain[a])}
            for parents in sorted(offers | {()}):
                offer = (tie(a, parents) if out else tie(a, domain.attrs), -domain.places((a,))[0], a, parents)
                best = max(best, offer) if best else offer
        out.append((best[2], best[3]))
        left.remove(best[2])
    return out


def initial_sets(domain: Domain, cliques: Sequence[Clique], scores: Scores, most_cells: int, how: str = "parents") -> list[Clique]:
    """What is measured first: single attributes, and by `how` nothing more ("none"), the pairs inside cliques ("pairs"),
    cliques that are small enough ("cliques") or each attribute with its parents ("parents")."""
    if how == "none":
        more: list[Clique] = []
    elif how == "pairs":
        more = sorted({domain.ordered(p) for c in cliques for p in combinations(c, 2) if domain.size(p) <= most_cells})
    elif how == "cliques":
        more = [domain.ordered(c) for c in cliques if len(c) > 1 and domain.size(c) <= most_cells]
    elif how == "parents":
        more = maximal(domain.ordered((a, *parents)) for a, parents in network(domain, cliques, scores, most_cells) if parents)
    else:
        raise ValueError("how is none, pairs, cliques or parents")
    return [*((a,) for a in domain.attrs), *more]


def candidate_sets(domain: Domain, cliques: Sequence[Clique], most_cells: int) -> list[Clique]:
    """Sets of two attributes and more that lie in a clique and have at most most_cells cells: measuring them leaves the
    model's junction tree as it is."""
    small = {s for c in cliques for s in maximal_sets(domain, domain.ordered(c), most_cells)}
    return [domain.ordered(s) for s in downward_closure(small) if len(s) > 1]


def error_of(answers: np.ndarray, model: np.ndarray, sigma: float) -> float:
    """The L1 distance beyond what noise of that size would make."""
    return float(np.abs(answers - model).sum()) - math.sqrt(2 / math.pi) * sigma * answers.size


def chosen(errors: Mapping[Clique, float], k: int, epsilon: float, sensitivity: float, rng: np.random.Generator, how: str = "exponential") -> list[Clique]:
    """k sets of large error, each choice with epsilon: one exponential mechanism after the other ("exponential"), or the
    largest after Laplace noise that is drawn anew for each ("laplace")."""
    if how not in ("exponential", "laplace"):
        raise ValueError("how is exponential or laplace")
    left, out = sorted(errors), []
    while left and len(out) < k:
        quality = np.array([errors[c] for c in left])
        at = exponential_mechanism(quality, epsilon, sensitivity, rng) if how == "exponential" else int(np.argmax(quality + rng.laplace(0, 2 * sensitivity / epsilon, len(left))))
        out.append(left.pop(at))
    return out


def choice_rho(epsilon: float, how: str = "exponential") -> float:
    """What one choice costs in zCDP: an exponential mechanism has bounded range, a noisy maximum is only epsilon-private."""
    return epsilon**2 / (8 if how == "exponential" else 2)
