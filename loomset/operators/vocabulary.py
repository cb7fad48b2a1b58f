"""Sets of distinct values per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Codes that fit into the bits of one number, and how many of them are looked up at once.
MOST_CODES, AT_ONCE = 60, 6


def united(df: DataFrame, keys: list[Column | str], sets: dict[str, Column], others: list[Column] | None = None,
           codes: dict[str, list[str] | None] | None = None) -> DataFrame:
    """``df`` grouped by ``keys``: each entry of ``sets`` becomes a sorted array of its distinct values.

    One aggregate in one pass; sets are combined map-side, so a key with a third of the rows arrives as one small set per
    task. Meant for columns of few distinct values per key (sources, relations, evidence codes). Where ``codes`` names all values
    of an entry, they are bits of a number until they are grouped, which Spark's hash aggregate combines without sorting.
    """
    known = {name: (codes or {}).get(name) for name in sets}
    keyed = df.groupBy(*keys).agg(*[
        (F.array_sort(F.collect_set(c)) if known[name] is None else F.bit_or(coded(c, known[name]))).alias(name) for name, c in sets.items()], *(others or []))
    return keyed.withColumns({name: decoded(F.col(name), some) for name, some in known.items() if some is not None})


def known_codes(df: DataFrame, column: str) -> list[str] | None:
    """Sorted distinct values of a text column, or None where there are more than ``MOST_CODES`` (or it is not text)."""
    if df.schema[column].dataType != T.StringType():
        return None
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_CODES + 1).collect()  # bounded
    return sorted(r[0] for r in rows) if len(rows) <= MOST_CODES else None


def coded(column: Column, codes: list[str]) -> Column:
    """The bit of a code; none for NULL."""
    if not codes:
        return F.lit(0).cast("bigint")
    bits = F.create_map(*[x for i, code in enumerate(codes) for x in (F.lit(code), F.lit(1 << i).cast("bigint"))])
    return F.coalesce(F.try_element_at(bits, column), F.lit(0).cast("bigint"))


def decoded(bits: Column, codes: list[str]) -> Column:
    """The sorted codes whose bits are set: tables of all subsets of ``AT_ONCE`` codes, one after the other."""
    empty = F.array().cast("array<string>")
    parts = []
    for at in range(0, len(codes), AT_ONCE):
        some = codes[at:at + AT_ONCE]
        subsets = [[F.lit(c) for i, c in enumerate(some) if n >> i & 1] for n in range(1 << len(some))]
        place = F.shiftright(bits, at).bitwiseAND(F.lit((1 << len(some)) - 1).cast("bigint")).cast("int")
        parts.append(F.coalesce(F.get(F.array(*[F.array(*x) if x else empty for x in subsets]), place), empty))
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else empty
