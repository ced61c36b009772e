"""What steers the gradual update of records: parts and layers of the graph of marginals, their order, errors and modes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Clique = tuple[str, ...]


def parts_of(cliques: Iterable[Clique], attrs: Sequence[str] = ()) -> list[tuple[tuple[str, ...], list[Clique]]]:
    """(attributes, marginals) of each connected part; marginals that share an attribute are in one part."""
    home = {a: {a} for a in attrs}
    cliques = list(cliques)
    for c in cliques:
        whole = set(c).union(*(home.get(a, {a}) for a in c))
        home.update(dict.fromkeys(whole, whole))
    parts = {id(p): p for p in home.values()}
    return sorted((tuple(sorted(p)), [c for c in cliques if c[0] in p]) for p in parts.values())


def layers(cliques: Iterable[Clique]) -> tuple[list[Clique], list[list[tuple[str, Clique]]]]:
    """(the marginals that stay, layers of (attribute, marginal) in the order they are peeled).

    An attribute that just one marginal holds needs no update: it can be appended to finished records by that marginal,
    if the rest of it is held by others. What is peeled in one layer makes room for the next."""
    left, out = list(cliques), []
    while True:
        uses = Counter(a for c in left for a in c)
        layer, taken = [], set()
        for c in sorted(left):
            alone = [a for a in c if uses[a] == 1]
            if len(c) == 2 and len(alone) == 1 and len(left) - len(taken) > 1:
                layer.append((alone[0], c))
                taken.add(c)
        if not layer:
            return left, out
        left = [c for c in left if c not in taken]
        out.append(layer)


def ratio(mode: str, iteration: int) -> float:
    """The share of moved records that are copies of others rather than new values."""
    # The modes by name. S4 to S6 alternate.
    table = {"S1": (0.0,), "S2": (1.0,), "S3": (0.5,), "S4": (1.0, 0.0), "S5": (0.5, 0.0), "S6": (0.5, 1.0)}
    return table[mode][iteration % len(table[mode])]


def error(records: DataFrame, attrs: Sequence[str], sizes: Sequence[int], target: np.ndarray) -> float:
    """The L1 distance of the records' marginal from its target."""
    return float(np.abs(cells(records, attrs, sizes) - np.asarray(target, float)).sum())


def cells(records: DataFrame, attrs: Sequence[str], sizes: Sequence[int]) -> np.ndarray:
    out = np.zeros(tuple(sizes))
    for r in records.groupBy(*attrs).agg(F.count(F.lit(1)).alias("n")).collect():  # a row per cell
        out[tuple(r[a] for a in attrs)] = r["n"]
    return out


def by_error(records: DataFrame, sizes: dict[str, int], margins: dict[Clique, np.ndarray]) -> list[tuple[Clique, float]]:
    """The marginals with their errors, the largest first, from one pass of grouping sets."""
    names = sorted({a for c in margins for a in c})
    view = records.groupingSets([[F.col(a) for a in c] for c in margins], *(F.col(a) for a in names)).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__set"))
    code = {sum(1 << (len(names) - 1 - k) for k, a in enumerate(names) if a not in c): c for c in margins}
    have = {c: np.zeros([sizes[a] for a in c]) for c in margins}
    for r in view.collect():  # a row per cell of the marginals
        c = code[r["__set"]]
        have[c][tuple(r[a] for a in c)] = r["n"]
    return sorted(((c, float(np.abs(have[c] - margins[c]).sum())) for c in margins), key=lambda x: (-x[1], x[0]))
