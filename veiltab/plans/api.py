"""Synthesizers by name: fit spends a budget once, sample is free; sessions with expiry."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations
from typing import Any, Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import noise
from ..functions.domain import Domain
from ..functions.privacy import Ledger, PrivacySpec, gaussian_sigma
from ..operators import consistency, encode, graphical, search, select, synth
from ..operators.infer import NULL_TOKEN, OTHER_TOKEN
from ..operators.marginals import all_marginals
from ..operators.overrides import enforce_schema


@dataclass(frozen=True)
class RunConfig:
    """exact: measurements carry discrete Gaussian noise of the system's entropy, which no seed repeats."""

    seed: int | None = None
    extra: dict[str, Any] = field(default_factory=dict)
    exact: bool = False


class Fitted(Protocol):
    def sample(self, n: int, seed: int = 0) -> DataFrame: ...


_METHODS: dict[str, Callable[..., Fitted]] = {}


def register(name: str, fit: Callable[..., Fitted]) -> None:
    _METHODS[name.casefold()] = fit


def methods() -> list[str]:
    return sorted(_METHODS)


def synthesize(method: str, df: DataFrame, kinds: dict[str, dict], privacy: PrivacySpec, n: int, config: RunConfig | None = None) -> DataFrame:
    """kinds: by column {"type": "categorical", "categories": [...]} or {"type": "numerical", "min": .., "max": .., "bins": ..}; both are taken as public."""
    if method.casefold() not in _METHODS:
        raise KeyError(f"no method {method!r}; there are {', '.join(methods())}")
    config = config or RunConfig()
    return _METHODS[method.casefold()](df, kinds, privacy, config).sample(n, config.seed or 0)


@dataclass
class Codes:
    """Codes of a table under public metadata, and back; expressions only. A value that is no category counts as the
    token for others if that is one, and is an error if not."""

    kinds: dict[str, dict]

    @property
    def domain(self) -> Domain:
        return Domain.of({c: len(k["categories"]) if k["type"] == "categorical" else k.get("bins", 32) for c, k in self.kinds.items()})

    def encoded(self, df: DataFrame) -> DataFrame:
        out: list[Column] = []
        for c, k in self.kinds.items():
            if k["type"] == "categorical":
                labels = [str(v) for v in k["categories"]]
                at = F.nullif(F.array_position(F.array(*map(F.lit, labels)), F.coalesce(F.col(c).cast("string"), F.lit(NULL_TOKEN))), F.lit(0)) - 1
                unknown = F.lit(labels.index(OTHER_TOKEN)) if OTHER_TOKEN in labels else F.raise_error(F.concat(F.lit(f"{c} has a value that is no category: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
                out.append(F.coalesce(at, unknown).cast("int").alias(c))
            else:
                x = F.coalesce(F.col(c).cast("double"), F.lit(float(k["min"])))
                out.append(encode.uniform_bin(x, float(k["min"]), float(k["max"]), k.get("bins", 32)).alias(c))
        return df.select(*out)

    def decoded(self, df: DataFrame, seed: int) -> DataFrame:
        out = []
        for c, k in self.kinds.items():
            if k["type"] == "categorical":
                out.append(F.get(F.array(*(F.lit(str(v)) for v in k["categories"])), F.col(c)).alias(c))
            else:
                bins, low, high = k.get("bins", 32), float(k["min"]), float(k["max"])
                u = F.pmod(F.xxhash64("row_id", F.lit(seed), F.lit(c)), F.lit(1 << 30)) / float(1 << 30)
                out.append((low + (F.col(c) + u) * (high - low) / bins).alias(c))
        return df.select(*out)


@dataclass
class MarginalModel:
    codes: Codes
    margins: dict[tuple[str, ...], np.ndarray]
    schema: Any
    spark: Any
    rounds: int
    ledger: Ledger

    def sample(self, n: int, seed: int = 0) -> DataFrame:
        domain = self.codes.domain
        one = {a: self.margins[(a,)] for a in domain.attrs}
        records = synth.initial_records(self.spark, n, one, seed)
        sizes = dict(zip(domain.attrs, domain.shape, strict=True))
        pairs = {k: v / max(v.sum(), 1e-12) * n for k, v in self.margins.items() if len(k) > 1}
        if pairs and self.rounds:
            records = synth.gradual_update(records, sizes, pairs, self.rounds, seed=seed)
        return enforce_schema(self.codes.decoded(records, seed), self.schema)


def counted(coded: DataFrame, domain: Domain, ways: tuple[int, ...]) -> dict[tuple[str, ...], np.ndarray]:
    """Tables of counts of all marginals of those sizes, from one pass; what comes to the driver has a row per cell."""
    counts = {key: np.zeros(domain.project(key).shape) for k in ways for key in combinations(domain.attrs, k)}
    for r in all_marginals(coded, list(domain.attrs), ways).collect():
        key = domain.ordered(r["marginal"].split(","))
        counts[key][tuple(int(r[a]) for a in key)] = r["n"]
    return counts


def fit_marginals(df: DataFrame, kinds: dict[str, dict], privacy: PrivacySpec, config: RunConfig) -> MarginalModel:
    """A tenth of the budget scores the pairs, a tenth measures single attributes, the rest the chosen sets. All counts
    come from one grouping-sets pass; after the noise nothing touches the data again."""
    codes, ledger, rng = Codes(kinds), privacy.ledger(), noise.generator(config.seed)
    domain = codes.domain
    counts = counted(codes.encoded(df), domain, (1, 2))
    pairs = list(combinations(domain.attrs, 2))
    rho = ledger.share("pair scores", 0.1)
    scores = {}
    for a, b in pairs:
        joint, n = counts[(a, b)], max(counts[(a, b)].sum(), 1)
        value = float(np.abs(joint - np.outer(joint.sum(1), joint.sum(0)) / n).sum())
        scores[(a, b)] = value + rng.normal(0, np.sqrt(8 * len(pairs) / rho))
    rho = ledger.share("single attributes", 0.1)
    margins = {(a,): noise.added(counts[(a,)], gaussian_sigma(1, rho / len(domain)), rng, config.exact) for a in domain.attrs}
    rho = ledger.share("chosen pairs", 0.8)
    chosen = select.greedy_pairs(scores, {p: domain.size(p) for p in pairs}, rho, config.extra.get("threshold", 0.0))
    parts = {p: domain.size(p) ** (2 / 3) for p in chosen}
    for p in chosen:
        margins[p] = noise.added(counts[p], gaussian_sigma(1, rho * parts[p] / sum(parts.values())), rng, config.exact)
    margins = consistency.consistent(domain, margins)
    return MarginalModel(codes, margins, df.select(*kinds).schema, df.sparkSession, config.extra.get("rounds", 3), ledger)


def fit_independent(df: DataFrame, kinds: dict[str, dict], privacy: PrivacySpec, config: RunConfig) -> MarginalModel:
    return fit_marginals(df, kinds, privacy, RunConfig(config.seed, {**config.extra, "threshold": float("inf"), "rounds": 0}, config.exact))


@dataclass
class GraphicalFit:
    codes: Codes
    model: graphical.Model
    schema: Any
    spark: Any
    ledger: Ledger
    log: list[dict]

    def sample(self, n: int, seed: int = 0) -> DataFrame:
        return enforce_schema(self.codes.decoded(self.model.sample(self.spark, n, seed), seed), self.schema)


def fit_adaptive(df: DataFrame, kinds: dict[str, dict], privacy: PrivacySpec, config: RunConfig) -> GraphicalFit:
    """Rounds that privately choose the marginal a graphical model fits worst, measure it and fit again.

    Nine tenths of the budget go to measurements, one to choices. A round that taught less than its noise halves the
    noise of those to come; the last takes what is left. The rows are counted once, for all marginals of the workload.
    extra: degree (2), rounds (16 per attribute), cells (of the model, 2^18), steps (of a fit, 200)."""
    codes, ledger, rng = Codes(kinds), privacy.ledger(), noise.generator(config.seed)
    domain, rho = codes.domain, ledger.total
    degree = min(int(config.extra.get("degree", 2)), len(domain))
    rounds = int(config.extra.get("rounds", 16 * len(domain)))
    most, steps = int(config.extra.get("cells", 1 << 18)), int(config.extra.get("steps", 200))
    closure = select.downward_closure(select.workload(domain, degree))
    weights = select.workload_weights(closure, [c for c in closure if len(c) == degree] or closure)
    counts = counted(codes.encoded(df), domain, tuple(range(1, degree + 1)))
    sigma, epsilon = np.sqrt(rounds / (1.8 * rho)), np.sqrt(0.8 * rho / rounds)
    if rounds < len(domain) + 1:
        raise ValueError("rounds must exceed the number of attributes")
    measured = []

    def measure(clique: tuple[str, ...]) -> None:
        ledger.charge(f"measure {','.join(clique)}", 0.5 / sigma**2)
        measured.append(graphical.Measurement(clique, noise.added(counts[clique], sigma, rng, config.exact), sigma))

    for a in domain.attrs:
        measure((a,))
    model, log, last = graphical.estimate(domain, measured, rounds=steps), [], False
    while not last:
        if ledger.left < 2 * (0.5 / sigma**2 + epsilon**2 / 8):
            if ledger.left <= 1e-9 * rho:
                break
            left, last = ledger.left * (1 - 1e-9), True
            sigma, epsilon = np.sqrt(1 / (1.8 * left)), np.sqrt(0.8 * left)
        taken = [m.clique for m in measured]
        room = most * (1 if last else max(ledger.spent / rho, 1 / rounds))
        fits = {c: counts[c] for c in closure if domain.size(c) <= room and graphical.model_cells(domain, [*taken, c]) <= room} or {(a,): counts[(a,)] for a in domain.attrs}
        ledger.charge("choice", epsilon**2 / 8)
        chosen = select.worst_approximated(fits, lambda c: model.project(c).values, weights, epsilon, sigma, rng)  # noqa: B023
        before = model.project(chosen).values
        measure(chosen)
        model = graphical.estimate(domain, measured, rounds=steps, warm=model)
        moved = float(np.abs(model.project(chosen).values - before).sum())
        log.append({"chosen": chosen, "sigma": float(sigma), "moved": moved, "spent": ledger.spent})
        if moved <= sigma * np.sqrt(2 / np.pi) * before.size:
            sigma, epsilon = sigma / 2, epsilon * 2
    return GraphicalFit(codes, model, df.select(*kinds).schema, df.sparkSession, ledger, log)


@dataclass
class TableFit:
    codes: Codes
    table: np.ndarray
    schema: Any
    spark: Any
    ledger: Ledger

    def sample(self, n: int, seed: int = 0) -> DataFrame:
        return enforce_schema(self.codes.decoded(search.drawn(self.spark, self.codes.domain, self.table, n, seed), seed), self.schema)


def _fit_search(find: Callable[..., np.ndarray]) -> Callable[..., TableFit]:
    """Single attributes and pairs share the budget evenly; the search sees nothing but these noisy counts."""

    def fit(df: DataFrame, kinds: dict[str, dict], privacy: PrivacySpec, config: RunConfig) -> TableFit:
        codes, ledger, rng = Codes(kinds), privacy.ledger(), noise.generator(config.seed)
        counts = counted(codes.encoded(df), codes.domain, (1, 2))
        sigma = gaussian_sigma(1, ledger.share("marginals", 1.0) / len(counts))
        noisy = {c: noise.added(v, sigma, rng, config.exact) for c, v in counts.items()}
        margins = consistency.consistent(codes.domain, noisy, rounds=20)
        return TableFit(codes, find(codes.domain, margins, seed=config.seed or 0, **config.extra), df.select(*kinds).schema, df.sparkSession, ledger)

    return fit


register("genetic", _fit_search(search.genetic))
register("relaxed", _fit_search(search.relaxed))
register("adaptive", fit_adaptive)
register("marginals", fit_marginals)
register("independent", fit_independent)


class Sessions:
    """Values by key that expire."""

    def __init__(self, ttl: float = 1800, evicted: Callable[[str, Any], None] | None = None, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.evicted, self.clock, self._held = ttl, evicted, clock, {}

    def _sweep(self) -> None:
        for k in [k for k, (_, end) in self._held.items() if end <= self.clock()]:
            value, _ = self._held.pop(k)
            if self.evicted:
                self.evicted(k, value)

    def set(self, key: str, value: Any, ttl: float | None = None) -> None:
        self._sweep()
        self._held[key] = (value, self.clock() + (self.ttl if ttl is None else ttl))

    def get(self, key: str, default: Any = None) -> Any:
        self._sweep()
        return self._held.get(key, (default, 0))[0]

    def pop(self, key: str, default: Any = None) -> Any:
        self._sweep()
        return self._held.pop(key, (default, 0))[0]

    def __contains__(self, key: str) -> bool:
        self._sweep()
        return key in self._held

    def keys(self) -> list[str]:
        self._sweep()
        return list(self._held)

    def clear(self) -> None:
        self._held.clear()
