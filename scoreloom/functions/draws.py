"""Seeded draws that depend on the row alone.

A draw is a hash of the seed, a name and the row's own key.  It does not depend on partitioning, on
row order or on other draws, and any engine with MD5 can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_text(seed: int, name: str, *keys: Column) -> Column:
    """Hexadecimal text with which rows can be shuffled."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), *[k.cast("string") for k in keys]))


def draw_number(seed: int, name: str, *keys: Column) -> Column:
    """Uniform whole number in [0, 2^60)."""
    return F.conv(F.substring(draw_text(seed, name, *keys), 1, 15), 16, 10).cast("long")


def pick(options: Column, seed: int, name: str, *keys: Column) -> Column:
    """One element of an array, uniformly, with replacement."""
    return F.element_at(options, (draw_number(seed, name, *keys) % F.size(options) + 1).cast("int"))


def draw_text_sql(seed: int, name: str, *keys: str) -> str:
    return "md5(concat_ws('|', " + ", ".join([f"'{seed}'", f"'{name}'", *[f"cast({k} as varchar)" for k in keys]]) + "))"


def draw_number_sql(seed: int, name: str, *keys: str) -> str:
    return f"cast(concat('0x', substr({draw_text_sql(seed, name, *keys)}, 1, 15)) as bigint)"
