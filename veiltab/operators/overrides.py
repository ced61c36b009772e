"""What a user confirms or changes about the metadata, as expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .infer import NULL_TOKEN, OTHER_TOKEN, canonical


class InvalidBinning(ValueError):
    """The `invalid_binning` error of the confirm step."""


def dedupe(labels: Sequence[str]) -> dict[str, str]:
    """Case-folded label to its first spelling."""
    out: dict[str, str] = {}
    for x in labels:
        out.setdefault(x.strip().casefold(), x.strip())
    return out


def map_categories(column: Column, keep: Sequence[str], token: str | None = OTHER_TOKEN) -> Column:
    """A kept label in its canonical spelling; anything else becomes token (None: stays)."""
    lookup = {x.strip().lower(): x for x in dedupe(keep).values()}  # as the column is folded: a map has no key twice
    value = canonical(column)
    folded = F.lower(F.trim(value))  # labels are folded by the same function, so that no letter parts ways
    if not lookup:
        return F.lit(token) if token is not None else value
    table = F.create_map(*(x for label in lookup.values() for x in (F.lower(F.trim(F.lit(label))), F.lit(label))))
    return F.coalesce(F.get(F.array(F.try_element_at(table, folded)), F.lit(0)), F.lit(token) if token is not None else value)


def final_categories(selected: Sequence[str], custom: Sequence[str], token: str | None = OTHER_TOKEN, has_null: bool = False) -> list[str]:
    out = list(dedupe([*selected, *custom]).values())
    if token is not None and token not in out:
        out.append(token)
    if has_null and NULL_TOKEN not in out:
        out.append(NULL_TOKEN)
    return out


def excluded(df: DataFrame, column: str, selected: Sequence[str]) -> DataFrame:
    """Categories of the data that were not selected."""
    return df.select(canonical(F.col(column)).alias("value")).distinct().where(~F.lower(F.trim("value")).isin([F.lower(F.trim(F.lit(x))) for x in selected]))


def clip(column: Column, low: float, high: float) -> Column:
    """Within bounds; a null becomes the lower one."""
    return F.greatest(F.least(F.coalesce(column.cast("double"), F.lit(float(low))), F.lit(float(high))), F.lit(float(low)))


def forced_numeric(column: Column, low: float, high: float, row_id: Column, seed: int) -> Column:
    """Numbers as they read; what does not is uniform within bounds, by a stable hash of the row id."""
    uniform = F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return F.coalesce(column.cast("string").try_cast("double"), uniform * (high - low) + low)


def bin_edges(low: float, high: float, how: str = "uniform", count: int = 10, width: float | None = None, growth: float = 1.5) -> list[float]:
    if high < low:
        raise InvalidBinning("the upper bound is below the lower one")
    if width is not None:
        if width <= 0:
            raise InvalidBinning("bin_width must be positive")
        count = max(1, math.ceil((high - low) / width))
    if count < 1 or int(count) != count:
        raise InvalidBinning("bin_count must be a positive whole number")
    if how == "exponential":
        if growth <= 1:
            raise InvalidBinning("growth must be above 1")
        parts = [growth**i for i in range(count)]
        edges, total = [low], sum(parts)
        for p in parts:
            edges.append(edges[-1] + (high - low) * p / total)
        edges[-1] = high
        return edges
    if how != "uniform":
        raise InvalidBinning(f"no binning {how!r}; there are uniform and exponential, and dp_privtree for a column's data (preprocess.privtree_edges)")
    return [low + (high - low) * i / count for i in range(count)] + [high]


def check_binning(edges: Sequence[float], count: int | None = None) -> None:
    if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:], strict=False)):
        raise InvalidBinning("edges must be two at least and strictly increasing")
    if count is not None and count != len(edges) - 1:
        raise InvalidBinning(f"bin_count {count} does not fit {len(edges)} edges")


def check_domain(spec: dict) -> None:
    if spec.get("type") == "categorical" and not spec.get("categories"):
        raise ValueError("a category at least is needed")
    if spec.get("type") == "numerical":
        if spec["max"] < spec["min"]:
            raise ValueError("max must not be below min")
        if "edges" in spec:
            check_binning(spec["edges"], spec.get("bin_count"))


def enforce_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Names, order and types of schema; whole numbers that do not read become 0, others null."""
    names = df.columns if set(schema.names) - set(df.columns) and len(df.columns) == len(schema) else schema.names
    out = []
    for have, f in zip(names, schema.fields, strict=True):
        raw, wholes = F.col(f"`{have}`"), (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        c, kind = raw.cast("string"), f.dataType.simpleString()
        if isinstance(f.dataType, wholes):  # whole numbers never go through a double, which holds 53 bits of them
            near = (raw if isinstance(df.schema[have].dataType, wholes) else F.coalesce(c.try_cast("bigint"), F.rint(c.try_cast("double")).try_cast("bigint"))).try_cast(kind)
            value = F.coalesce(near, F.lit(0).cast(f.dataType))
        else:
            value = c.try_cast(kind)
        out.append(value.alias(f.name))
    return df.select(*out)
