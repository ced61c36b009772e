"""Linear query workloads over the cells of attributes, and strategies that answer them with less noise.

A product workload keeps one matrix per attribute and is never multiplied out. Answers are exact where cells are
counted by Spark; here are matrices of the size of single domains."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np


def identity(n: int) -> np.ndarray:
    return np.eye(n)


def total(n: int) -> np.ndarray:
    return np.ones((1, n))


def identity_total(n: int, weight: float = 1.0) -> np.ndarray:
    return np.vstack([np.eye(n), weight * np.ones((1, n))])


def prefix(n: int) -> np.ndarray:
    return np.tril(np.ones((n, n)))


def suffix(n: int) -> np.ndarray:
    return prefix(n)[::-1, ::-1]


def ranges(n: int, widths: Sequence[int] | None = None) -> np.ndarray:
    """All ranges, or those of the given widths."""
    rows = [[float(a <= x < a + w) for x in range(n)] for w in (widths or range(1, n + 1)) for a in range(n - w + 1)]
    return np.array(rows)


def random_ranges(n: int, how_many: int, seed: int = 0) -> np.ndarray:
    ends = np.sort(np.random.default_rng(seed).integers(0, n, (how_many, 2)), axis=1)
    x = np.arange(n)
    return ((ends[:, :1] <= x) & (x <= ends[:, 1:])).astype(float)


def moments(n: int, most: int) -> np.ndarray:
    return np.arange(n, dtype=float)[None, :] ** np.arange(most + 1)[:, None]


def haar(n: int) -> np.ndarray:
    """The wavelet basis of a domain whose size is a power of two."""
    if n & (n - 1) or n < 1:
        raise ValueError("n must be a power of two")
    if n == 1:
        return np.ones((1, 1))
    half = haar(n // 2)
    return np.vstack([np.kron(half, [1, 1]), np.kron(np.eye(n // 2), [1, -1])])


def permuted(w: np.ndarray, seed: int = 0) -> np.ndarray:
    return w[:, np.random.default_rng(seed).permutation(w.shape[1])]


@dataclass(frozen=True)
class Product:
    """The Kronecker product of a matrix per attribute, with a weight."""

    parts: tuple[np.ndarray, ...]
    weight: float = 1.0

    @property
    def shape(self) -> tuple[int, int]:
        return int(np.prod([p.shape[0] for p in self.parts])), int(np.prod([p.shape[1] for p in self.parts]))

    def answers(self, cells: np.ndarray) -> np.ndarray:
        """One small product per attribute on the table of cells."""
        out = np.asarray(cells, float).reshape([p.shape[1] for p in self.parts])
        for k, p in enumerate(self.parts):
            out = np.moveaxis(np.tensordot(p, out, axes=(1, k)), 0, k)
        return self.weight * out.ravel()

    def gram(self) -> Product:
        return Product(tuple(p.T @ p for p in self.parts), self.weight**2)

    def pinv(self) -> Product:
        return Product(tuple(np.linalg.pinv(p) for p in self.parts), 1 / self.weight)

    def sensitivity(self, norm: int = 1) -> float:
        return abs(self.weight) * float(np.prod([sensitivity(p, norm) for p in self.parts]))

    def trace(self) -> float:
        return self.weight * float(np.prod([np.trace(p) for p in self.parts]))

    def dense(self) -> np.ndarray:
        return self.weight * reduce(np.kron, self.parts)


def sensitivity(matrix: np.ndarray, norm: int = 1) -> float:
    """The largest change of the answers by one row of the table, in L1 or L2."""
    return float(np.linalg.norm(matrix, norm, axis=0).max()) if norm == 2 else float(np.abs(matrix).sum(axis=0).max())


def marginals(sizes: Sequence[int], ways: int) -> list[Product]:
    """All marginals of `ways` attributes, as a union of products."""
    return [Product(tuple(identity(s) if k in kept else total(s) for k, s in enumerate(sizes))) for kept in combinations(range(len(sizes)), ways)]


def grid_ranges(n: int, m: int, prefixes: bool = False) -> Product:
    return Product((prefix(n), prefix(m)) if prefixes else (ranges(n), ranges(m)))


def squared_error(workload_gram: np.ndarray, strategy: np.ndarray, epsilon: float = 1.0) -> float:
    """Expected total squared error of a workload answered through a strategy with Laplace noise."""
    inverse = np.linalg.pinv(strategy.T @ strategy)
    return 2 * (sensitivity(strategy) / epsilon) ** 2 * float(np.sum(inverse * workload_gram))


def root_mean_error(workload: np.ndarray, strategy: np.ndarray, epsilon: float = 1.0) -> float:
    return float(np.sqrt(squared_error(workload.T @ workload, strategy, epsilon) / len(workload)))


def query_errors(workload: np.ndarray, strategy: np.ndarray, epsilon: float = 1.0) -> np.ndarray:
    """Expected squared error of each query."""
    inverse = np.linalg.pinv(strategy.T @ strategy)
    return 2 * (sensitivity(strategy) / epsilon) ** 2 * np.einsum("ij,jk,ik->i", workload, inverse, workload)


def weighted_identity_strategy(gram: np.ndarray, extra: int | None = None, restarts: int = 5, rounds: int = 300, seed: int = 0) -> np.ndarray:
    """A strategy of the cells and `extra` weighted sums of them, columns scaled to L1 norm one, of least expected error.

    With t the sums' weights (none negative), s = 1 + their column sums and X = (I + t't)^-1, the error is the sum of
    X * gram * ss'; its slope is taken in closed form and followed by projected steps with a halving line search."""
    n = len(gram)
    extra = max(1, n // 16 + 1) if extra is None else extra
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros((extra, n)))

    def value(t: np.ndarray) -> tuple[float, np.ndarray]:
        s, x = 1 + t.sum(axis=0), np.linalg.inv(np.eye(n) + t.T @ t)
        h = gram * np.outer(s, s)
        return float(np.sum(x * h)), -2 * t @ x @ h @ x + 2 * ((x * gram) @ s)[None, :]

    for _ in range(restarts):
        t, step = rng.random((extra, n)), 1.0 / max(float(np.trace(gram)), 1e-12)
        f, slope = value(t)
        for _ in range(rounds):
            step *= 4
            for _ in range(40):
                moved = np.maximum(t - step * slope, 0)
                f2, slope2 = value(moved)
                if f2 <= f + 1e-4 * float(np.sum(slope * (moved - t))):
                    break
                step /= 2
            else:
                break
            gain, t, f, slope = f - f2, moved, f2, slope2
            if gain <= 1e-9 * f:
                break
        if f < best[0]:
            best = (f, t)
    t = best[1]
    return np.vstack([np.eye(n), t]) / (1 + t.sum(axis=0))


def best_strategy(workload: np.ndarray, candidates: Sequence[np.ndarray] = (), **options) -> np.ndarray:
    """The best of the optimised strategy, the cells, the workload itself and the candidates given."""
    gram = workload.T @ workload
    offered = [identity(workload.shape[1]), *candidates, weighted_identity_strategy(gram, **options)]
    if np.linalg.matrix_rank(workload) == workload.shape[1]:
        offered.append(workload)
    return min(offered, key=lambda a: squared_error(gram, a))


def product_strategy(workload: Product, **options) -> Product:
    """The error of a product is the product of its parts' errors, so each part is optimised by itself."""
    return Product(tuple(best_strategy(p, **options) for p in workload.parts))


def measured(cells: np.ndarray, strategy: np.ndarray | Product, epsilon: float, laplace: Callable[[float, int], np.ndarray]) -> np.ndarray:
    """Cells estimated from noisy strategy answers; laplace(scale, size) draws the noise."""
    a = strategy if isinstance(strategy, Product) else Product((strategy,))
    true = a.answers(cells)
    return a.pinv().answers(true + laplace(a.sensitivity() / epsilon, len(true)))


# Matrices put together, and strategies for unions of workloads.


def weighted(matrix: np.ndarray, weights: Sequence[float] | float) -> np.ndarray:
    """Each query times its weight."""
    return np.broadcast_to(np.asarray(weights, float), len(matrix))[:, None] * matrix


def side_by_side(*parts: np.ndarray) -> np.ndarray:
    """Queries over the cells of one part after the other's: the n-th query sums the n-th of each."""
    return np.hstack(parts)


def block_diagonal(*parts: np.ndarray) -> np.ndarray:
    """The queries of each part over cells of its own."""
    out = np.zeros((sum(len(p) for p in parts), sum(p.shape[1] for p in parts)))
    row = column = 0
    for p in parts:
        out[row : row + len(p), column : column + p.shape[1]] = p
        row, column = row + len(p), column + p.shape[1]
    return out


@dataclass(frozen=True)
class Union:
    """Products over the same cells, one after the other; never multiplied out."""

    parts: tuple[Product, ...]

    def __post_init__(self):
        if not self.parts or len({p.shape[1] for p in self.parts}) > 1:
            raise ValueError("a union has parts, all over the same cells")

    @property
    def shape(self) -> tuple[int, int]:
        return sum(p.shape[0] for p in self.parts), self.parts[0].shape[1]

    def answers(self, cells: np.ndarray) -> np.ndarray:
        return np.concatenate([p.answers(cells) for p in self.parts])

    def sensitivity(self, norm: int = 1) -> float:
        """The largest norm of a column; a product's column norms are products of its parts'."""

        def columns(p: Product) -> np.ndarray:
            return abs(p.weight) ** norm * reduce(np.kron, [(np.abs(m) ** norm).sum(axis=0) for m in p.parts])

        return float(sum(columns(p) for p in self.parts).max() ** (1 / norm))

    def dense(self) -> np.ndarray:
        return np.vstack([p.dense() for p in self.parts])


def product_error(workload: Product, strategy: Product, epsilon: float = 1.0) -> float:
    """Expected total squared error of a product through a product, with Laplace noise: a trace per attribute."""
    inverses = (np.linalg.pinv(s.T @ s) for s in strategy.parts)
    traces = [float(np.sum(i * (w.T @ w))) for i, w in zip(inverses, workload.parts, strict=True)]
    return 2 * (strategy.sensitivity() / epsilon) ** 2 * (workload.weight / strategy.weight) ** 2 * float(np.prod(traces))


@dataclass(frozen=True)
class UnionStrategy:
    """A strategy of sensitivity one for each part of a union, and its share of the budget."""

    parts: tuple[Product, ...]
    shares: tuple[float, ...]

    @property
    def shared(self) -> bool:
        """One strategy, measured once, serves all parts."""
        return all(p is self.parts[0] for p in self.parts) and all(s == 1 for s in self.shares)

    def error(self, workload: Union, epsilon: float = 1.0) -> float:
        return sum(product_error(w, s, epsilon * share) for w, s, share in zip(workload.parts, self.parts, self.shares, strict=True))

    def answered(self, workload: Union, cells: np.ndarray, epsilon: float, laplace: Callable[[float, int], np.ndarray]) -> np.ndarray:
        """The union's answers, each part's from its own measurements, or all from the one that serves them; together they spend epsilon."""
        if self.shared:
            return workload.answers(measured(cells, self.parts[0], epsilon, laplace))
        return np.concatenate([w.answers(measured(cells, s, epsilon * share, laplace)) for w, s, share in zip(workload.parts, self.parts, self.shares, strict=True)])


def union_strategy(workload: Union, **options) -> UnionStrategy:
    """Each part is optimised by itself. With Laplace noise a part's error falls with the square of its share, so the sum
    is least where shares are as the cube roots of the errors."""
    parts = tuple(product_strategy(p, **options) for p in workload.parts)
    roots = [product_error(w, s) ** (1 / 3) for w, s in zip(workload.parts, parts, strict=True)]
    return UnionStrategy(parts, tuple(r / sum(roots) for r in roots))


def best_template(workload: Union, **options) -> UnionStrategy:
    """The best of: a strategy for each part; the cells alone for all parts; one strategy, that of any part, for all.

    A strategy that serves all parts is measured once with the whole budget (its share is 1 in each part)."""
    offered = [union_strategy(workload, **options)]
    single = [Product(tuple(identity(m.shape[1]) for m in workload.parts[0].parts)), *offered[0].parts]
    n = len(workload.parts)
    for s in single:
        if all(np.linalg.matrix_rank(m) == m.shape[1] for m in s.parts):  # it answers any query
            offered.append(UnionStrategy((s,) * n, (1.0,) * n))
    return min(offered, key=lambda o: o.error(workload))
