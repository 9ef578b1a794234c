"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_literal(value) -> str:
    """A Python constant as SQL text. Long constant lists and maps are parsed from
    one text: building them value by value costs a call to the JVM each."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(sql_literal(v) for v in value) + ")"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def literal_map(mapping: Mapping) -> Column:
    """A constant map column; Catalyst folds it into one literal."""
    return F.expr("map(" + ", ".join(sql_literal(x) for pair in mapping.items() for x in pair) + ")")


def lookup(mapping: Mapping, key: str | Column, default=None) -> Column:
    found = F.try_element_at(literal_map(mapping), col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def list_lookup(mapping: Mapping[str, Sequence[str]], key: str | Column, default: Sequence[str]) -> Column:
    return F.coalesce(F.try_element_at(literal_map(mapping), col(key)), string_array(default))


def string_array(values: Sequence[str]) -> Column:
    return F.expr(sql_literal(list(values))) if values else F.array().cast("array<string>")


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns as generator output.

    The optimizer moves a filter on a projected column below the projection by
    repeating the column's expression, so a filter on a pattern match would run
    every pattern twice, and more often with each further step. It does not reach
    through a generator: filters on these columns stay above it, filters on the
    other columns still go down to the scan.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def numbered(values: Sequence[str], number: str | Column, default: str) -> Column:
    """The number-th value (from 1), ``default`` where the number is null.

    The index is never null: Catalyst takes element_at on a literal array for
    not-null and would drop a coalesce around it.
    """
    index = F.coalesce(col(number), F.lit(len(values) + 1))
    return F.element_at(string_array([*values, default]), index)


def bucket(value: str | Column, levels: Sequence[tuple[str, float]], otherwise: str | None = None) -> Column:
    """First level whose lower bound is reached; ``levels`` go from high to low."""
    name, bound = levels[0]
    out = F.when(col(value) >= F.lit(bound), F.lit(name))
    for name, bound in levels[1:]:
        out = out.when(col(value) >= F.lit(bound), F.lit(name))
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def fixed(value: str | Column, digits: int) -> Column:
    """A number as text with that many digits after the point, rounded by its exact
    binary value, ties to even."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", col(value), F.lit(pattern))


def rounded(value: str | Column, digits: int) -> Column:
    """A number rounded by its exact binary value, ties to even.

    Decimal rounding differs from that only close to a tie, so only there the
    slower exact way is taken.
    """
    part = F.pmod(F.abs(col(value)) * F.lit(float(10 ** digits)), F.lit(1.0))
    near_tie = F.abs(part - F.lit(0.5)) < F.lit(1e-6)
    return F.when(near_tie, fixed(value, digits).cast("double")).otherwise(F.round(col(value), digits))


def mean_of_thousandths(value: Column, count: Column) -> Column:
    """Mean of values with at most three decimals, free of summation order (an aggregate)."""
    whole = F.sum(F.round(value * 1000).cast("long") * count)
    return whole / F.sum(count) / F.lit(1000.0)


def surrogate_id(prefix: str, *key: str | Column) -> Column:
    """Stable id: prefix plus the md5 of the key, whole, as rows are joined by it."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in key])
    return F.concat(F.lit(prefix + "-"), F.upper(F.md5(text)))


def micros(ts: str | Column) -> Column:
    return F.unix_micros(col(ts))


def metric(name: str, metrics: str | Column = "metrics") -> Column:
    """A metric by name, null where the log does not carry it."""
    return F.try_element_at(col(metrics), F.lit(name))
