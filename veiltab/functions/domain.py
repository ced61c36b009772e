"""The attributes of a coded table, in order, with the number of codes of each."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import accumulate
from math import prod
from operator import mul
from types import MappingProxyType


class Domain:
    """A fixed mapping of names to sizes. `attrs` and `shape` are its keys and values."""

    def __init__(self, sizes: Mapping[str, int] | Iterable[tuple[str, int]]):
        pairs = list(sizes.items() if isinstance(sizes, Mapping) else sizes)
        self.sizes: Mapping[str, int] = MappingProxyType({a: int(n) for a, n in pairs})
        if len(self.sizes) < len(pairs):
            raise ValueError("an attribute is named twice")
        self.attrs, self.shape = tuple(self.sizes), tuple(self.sizes.values())
        self._at = {a: k for k, a in enumerate(self.attrs)}

    of = classmethod(lambda cls, sizes: cls(sizes))

    def __reduce__(self):
        return Domain, (dict(self.sizes),)

    def __getitem__(self, attr: str) -> int:
        return self.sizes[attr]

    def __contains__(self, attr: object) -> bool:
        return attr in self.sizes

    def __iter__(self):
        return iter(self.attrs)

    def __len__(self) -> int:
        return len(self.sizes)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Domain) and (self.attrs, self.shape) == (other.attrs, other.shape)

    def __hash__(self) -> int:
        return hash((self.attrs, self.shape))

    def __repr__(self) -> str:
        return f"Domain({dict(self.sizes)})"

    def project(self, names: str | Iterable[str]) -> Domain:
        """Some attributes, in the order that is asked for."""
        return Domain((a, self.sizes[a]) for a in ([names] if isinstance(names, str) else names))

    def without(self, names: Iterable[str]) -> Domain:
        rest = dict(self.sizes)
        for a in names:
            rest.pop(a, None)
        return Domain(rest)

    def __or__(self, other: Domain) -> Domain:
        """Its own attributes, then those that only the other has."""
        return Domain({**other.sizes, **self.sizes}).project(dict.fromkeys((*self.attrs, *other.attrs)))

    def places(self, names: Iterable[str]) -> tuple[int, ...]:
        return tuple(map(self._at.__getitem__, names))

    def ordered(self, names: Iterable[str]) -> tuple[str, ...]:
        """Distinct names in the order of the domain; names it does not know are left out."""
        return tuple(sorted({a for a in names if a in self._at}, key=self._at.__getitem__))

    def size(self, names: Iterable[str] | None = None) -> int:
        """Cells of a table over the names, over all attributes if none are given."""
        return prod(self.shape if names is None else map(self.sizes.__getitem__, names))

    def by_size(self) -> Domain:
        return self.project(sorted(self.attrs, key=self.sizes.__getitem__))

    def strides(self, names: Iterable[str]) -> tuple[int, ...]:
        """Row-major strides: the key of a cell is the sum of code times stride."""
        sizes = [self.sizes[a] for a in names]
        return tuple(accumulate(sizes[:0:-1], mul, initial=1))[::-1] if sizes else ()
