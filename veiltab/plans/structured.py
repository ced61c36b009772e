"""Synthesizers that spend part of their budget on structure: a searched graph of attributes, and rounds of search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import noise
from ..functions.domain import Domain
from ..functions.privacy import PrivacySpec, gaussian_sigma
from ..operators import consistency, graphical, search, select, structure
from . import api

Clique = tuple[str, ...]


def counted_sets(coded: DataFrame, domain: Domain, sets: Sequence[Clique]) -> dict[Clique, np.ndarray]:
    """Tables of counts of the marginals named, from one pass of grouping sets; the driver gets a row per cell."""
    out = {c: np.zeros(domain.project(c).shape) for c in sets}
    if not out:
        return out
    names = list(domain.attrs)
    at = {sum(1 << (len(names) - 1 - k) for k, a in enumerate(names) if a not in c): c for c in out}
    rows = coded.groupingSets([[F.col(a) for a in c] for c in out], *(F.col(a) for a in names)).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__set"))
    for r in rows.collect():
        c = at[r["__set"]]
        out[c][tuple(r[a] for a in c)] = r["n"]
    return out


def fit_structured(df: DataFrame, kinds: dict[str, dict], privacy: PrivacySpec, config: api.RunConfig) -> api.GraphicalFit:
    """A graph of attributes is searched by noisy scores of pairs (a tenth of the budget). Its cliques bound what may be
    measured: a first lot (three tenths), then in rounds the sets that the model fits worst (choices a tenth,
    measurements the rest). Two passes over the rows: all pairs, and all sets of the graph.

    extra: cells (of a clique, 2^16), set_cells (of a measured set, 2^14), first ("parents"), rounds (3), picks (of a
    round, 2), choice ("exponential"), steps (of a fit, 200)."""
    codes, ledger, rng, extra = api.Codes(kinds), privacy.ledger(), noise.generator(config.seed), config.extra
    domain, coded = codes.domain, codes.encoded(df)
    cells, set_cells = int(extra.get("cells", 1 << 16)), int(extra.get("set_cells", 1 << 14))
    rounds, picks, how, steps = int(extra.get("rounds", 3)), int(extra.get("picks", 2)), extra.get("choice", "exponential"), int(extra.get("steps", 200))
    scores: dict[Clique, float] = {}
    pairs = [p for p in select.workload(domain, 2) if domain.size(p) <= set_cells] if len(domain) > 1 else []
    rho = ledger.share("pair scores", 0.1)
    for p, joint in counted_sets(coded, domain, pairs).items():
        apart = float(np.abs(joint - np.outer(joint.sum(1), joint.sum(0)) / max(joint.sum(), 1)).sum())
        scores[p] = apart + rng.normal(0, np.sqrt(8 * len(pairs) / rho))
    rho = ledger.share("first sets", 0.3)
    price = np.sqrt(2 / np.pi) * gaussian_sigma(1, rho / max(len(domain), 1))  # the noise of a cell
    _, cliques = structure.search_graph(domain, scores, cells, price)
    first = structure.initial_sets(domain, cliques, scores, set_cells, extra.get("first", "parents"))
    offered = structure.candidate_sets(domain, cliques, set_cells)
    counts = counted_sets(coded, domain, sorted({*first, *offered}))
    measured: list[graphical.Measurement] = []

    def measure(clique: Clique, rho: float) -> float:
        sigma = gaussian_sigma(1, rho)
        measured.append(graphical.Measurement(clique, noise.added(counts[clique], sigma, rng, config.exact), sigma))
        return sigma

    for c in first:
        measure(c, rho / len(first))
    model, log = graphical.estimate(domain, measured, rounds=steps), []
    for k in range(rounds if offered else 0):
        n = min(picks, len(offered))
        epsilon = np.sqrt(ledger.share(f"choices of round {k + 1}", 0.1 / rounds) / n / structure.choice_rho(1.0, how))
        rho = ledger.share(f"sets of round {k + 1}", 0.5 / rounds) / n
        sigma = gaussian_sigma(1, rho)
        errors = {c: structure.error_of(counts[c], model.project(c).values, sigma) for c in offered}
        taken = structure.chosen(errors, n, float(epsilon), 1.0, rng, how)
        for c in taken:
            measure(c, rho)
        model = graphical.estimate(domain, measured, rounds=steps, warm=model)
        log.append({"chosen": taken, "sigma": float(sigma), "spent": ledger.spent})
    return api.GraphicalFit(codes, model, df.select(*kinds).schema, df.sparkSession, ledger, log)


def fit_genetic_rounds(df: DataFrame, kinds: dict[str, dict], privacy: PrivacySpec, config: api.RunConfig) -> api.TableFit:
    """Rounds of a genetic search: the pair that the table fits worst is chosen and measured, and the search goes on from
    the table of the round before. Single attributes take the share that is theirs among all sets measured.

    extra: picked (rounds, twice the attributes at most), patience_rounds (2: stops after so many rounds whose errors do
    not fall; what they would have spent stays unspent), and what search.genetic takes."""
    codes, ledger, rng, extra = api.Codes(kinds), privacy.ledger(), noise.generator(config.seed), dict(config.extra)
    domain = codes.domain
    pairs = [p for p in select.workload(domain, 2)] if len(domain) > 1 else []
    rounds, patience = min(int(extra.pop("picked", 2 * len(domain))), len(pairs)), int(extra.pop("patience_rounds", 2))
    counts = counted_sets(codes.encoded(df), domain, [*((a,) for a in domain.attrs), *pairs])
    single = len(domain) / (len(domain) + rounds)
    sigma = gaussian_sigma(1, ledger.share("single attributes", single) / len(domain))
    noisy = {(a,): noise.added(counts[(a,)], sigma, rng, config.exact) for a in domain.attrs}
    total = max(float(np.mean([v.sum() for v in noisy.values()])), 1.0)

    def found(start: np.ndarray | None, k: int) -> tuple[np.ndarray, search.Cells]:
        margins = consistency.consistent(domain, {c: v.copy() for c, v in noisy.items()}, rounds=20)
        return search.genetic(domain, margins, seed=(config.seed or 0) + k, start=start, **extra), search.Cells(domain, margins)

    table, _ = found(None, 0)
    best, idle = np.inf, 0
    for k in range(rounds):
        each = (1 - single) / rounds
        epsilon = np.sqrt(8 * ledger.share(f"choice {k + 1}", each / 10))
        left = [p for p in pairs if p not in noisy]
        errors = {}
        for p in left:
            i, j = domain.places(p)
            have = np.zeros(domain.project(p).shape)
            np.add.at(have, (table[:, i], table[:, j]), total / len(table))
            errors[p] = float(np.abs(counts[p] - have).sum())
        pair = structure.chosen(errors, 1, float(epsilon), 1.0, rng)[0]
        noisy[pair] = noise.added(counts[pair], gaussian_sigma(1, ledger.share(f"pair {k + 1}", each * 0.9)), rng, config.exact)
        table, cells = found(table, k + 1)
        error = cells.error(table) / len(noisy)  # of noisy counts, so it may steer when to stop
        best, idle = (error, 0) if error < best else (best, idle + 1)
        if idle >= patience:
            break
    return api.TableFit(codes, table, df.select(*kinds).schema, df.sparkSession, ledger)


api.register("structured", fit_structured)
api.register("genetic_rounds", fit_genetic_rounds)
