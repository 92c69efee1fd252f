"""Column helpers for plain values: lookups, decimal rounding, JSON."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_BUCKET = 16  # entries of a lookup that share a bucket, about


def lookup(mapping: Mapping, key: Column, default=None) -> Column:
    """Value of ``key`` in a constant mapping, as an expression (no join).

    Texts to texts are one folded literal, a map per bucket of the key's CRC, so neither building the plan nor finding a key
    depends on the number of entries.  A null key finds nothing.
    """
    if not mapping:
        return F.lit(default)
    if all(isinstance(x, str) for entry in mapping.items() for x in entry):
        buckets: list[dict[str, str]] = [{} for _ in range(1 + len(mapping) // PER_BUCKET)]
        for name, value in mapping.items():
            buckets[zlib.crc32(name.encode()) % len(buckets)][name] = value
        table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")
        at = (F.crc32(key.cast("binary")) % len(buckets) + 1).cast("int")
        found = F.try_element_at(F.try_element_at(table, at), key)
    else:
        found = F.try_element_at(F.create_map(*[F.lit(x) for entry in mapping.items() for x in entry]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def round_binary(x: Column, digits: int) -> Column:
    """Round a non-negative double by its exact binary value, ties to even.

    Spark's ``round`` works on the shortest decimal text, so 70.85 becomes 70.9 there though the
    double lies below 70.85.  The fraction of a double of at least 1 is a whole number of 2^-52, so
    integer arithmetic decides exactly.
    """
    scale, one, half = 10 ** digits, 1 << 52, 1 << 51
    whole = F.floor(x).cast("long")
    part = ((x - whole) * F.lit(float(one))).cast("long") * scale
    kept = F.shiftright(part, 52)
    rest = part.bitwiseAND(F.lit(one - 1))
    up = (rest > half) | ((rest == half) & (kept % 2 == 1))
    return ((whole * scale + kept + up.cast("long")) / F.lit(float(scale))).cast("double")


def round_binary_sql(x: str, digits: int) -> str:
    """The same rounding as SQL text, for the checking engine."""
    s, one, half = 10 ** digits, 1 << 52, 1 << 51
    part = f"(cast(trunc(({x} - floor({x})) * {float(one):.1f}) as bigint) * {s})"
    return (f"(cast(cast(floor({x}) as bigint) * {s} + ({part} >> 52) + case when ({part} & {one - 1}) > {half} "
            f"or (({part} & {one - 1}) = {half} and ({part} >> 52) % 2 = 1) then 1 else 0 end as double) / {s}.0)")


def strict_json(candidate: Column) -> Column:
    """The text as VARIANT when it is one whole JSON value, else NULL.

    ``try_parse_json`` stops reading after the first value; inside brackets it has to read to the end.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), candidate, F.lit("]")))
    single = F.try_variant_get(boxed, "$[1]", "variant").isNull()
    return F.when(single, F.try_variant_get(boxed, "$[0]", "variant"))


def variant_kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID (JSON null) or a number type; SQL NULL when absent."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where the body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fence(df: DataFrame, computed: list[str]) -> DataFrame:
    """Evaluate costly columns once per row.

    A filter on a computed column is normally pushed below its projection by copying the whole
    expression.  The columns pass through a one-element generator here, which no filter crosses.
    """
    kept = [c for c in df.columns if c not in computed]
    return (df.select(*kept, F.explode(F.array(F.struct(*computed))).alias("__fenced"))
            .select(*kept, *[F.col("__fenced")[c].alias(c) for c in computed]))
