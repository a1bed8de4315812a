"""Joins with lookup tables whose keys are unique, or else an error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A lookup of up to so many rows and bytes is sent to all executors; a larger one is shuffled.
MOST_BROADCAST, MOST_BYTES = 200_000, 64 << 20


def unique_lookup(lookup: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """lookup, broadcast if it is small; an error if a key occurs twice, which would repeat rows of the other side."""
    if not check:
        return lookup
    size = F.sum(sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) if t in ("string", "binary") else F.lit(8) for c, t in lookup.dtypes if not t.startswith(("array", "map", "struct"))), F.lit(0)))
    nested = any(t.startswith(("array", "map", "struct")) for _, t in lookup.dtypes)  # of no known size
    found = lookup.groupBy(*keys).agg(F.count("*").alias("_rows"), size.alias("_bytes"))
    rows, many, held = found.agg(*[F.coalesce(f(c), F.lit(0)) for f, c in ((F.sum, "_rows"), (F.max, "_rows"), (F.sum, "_bytes"))]).first()
    if many > 1:
        raise ValueError(f"the lookup's keys {list(keys)} aren't unique")
    return F.broadcast(lookup) if rows <= MOST_BROADCAST and held <= MOST_BYTES and not nested else lookup


def look_up(rows: DataFrame, lookup: DataFrame, keys: Mapping[str, str], prefix: str = "", fill: object = None, check: bool = True) -> DataFrame:
    """rows left-joined with lookup; keys maps columns of rows to those of lookup; other columns get the prefix.

    One lookup serves several roles under several prefixes. fill replaces nulls of the new columns.
    """
    side = unique_lookup(lookup, list(keys.values()), check)
    new = [c for c in lookup.columns if c not in keys.values()]
    side = side.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys.values())], *[F.col(c).alias(prefix + c) for c in new])
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    out = rows.join(side, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return out if fill is None else out.na.fill(fill, [prefix + c for c in new])


def mapped(key: Column, names: Mapping[str, str], default: str | None = None) -> Column:
    """names[key], else default."""
    out = F.lit(default)
    for k, v in names.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def outer_chain(tables: Sequence[DataFrame], key: str, fill: object = 0) -> DataFrame:
    """Full outer joins on key; missing numbers become fill."""
    out = tables[0]
    for other in tables[1:]:
        out = out.join(other, key, "full_outer")
    return out.na.fill(fill)


def columns_by(rows: DataFrame, key: str, column: str, values: Sequence[str], value: str) -> DataFrame:
    """One column for each of values with the sum of value, by key: one shuffle in place of a chain of outer joins."""
    return rows.groupBy(key).pivot(column, list(values)).agg(F.sum(value))
