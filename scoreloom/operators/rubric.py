"""Rubrics, and the arithmetic from item scores to a capped and graded total.

A rubric is a small Python declaration.  It enters plans as literals and ``CASE`` expressions, so
scoring needs one shuffle on the evaluation id and no dimension joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.values import lookup, round_binary


@dataclass(frozen=True)
class Item:
    id: str
    type: str                  # "O" objective, "S" subjective
    allow_na: bool = False
    per: str | None = None     # scored once per label of this label list


@dataclass(frozen=True)
class Section:
    id: str
    key: str
    weight: float
    items: tuple[Item, ...]


@dataclass(frozen=True)
class Flag:
    id: str
    severity: str
    cap: float


@dataclass(frozen=True)
class Grade:
    name: str
    at_least: float


@dataclass(frozen=True)
class Output:
    name: str
    kind: str                           # text | integer | enum | list
    bounds: tuple[int, int] | None = None
    choices: tuple[str, ...] = ()
    max_items: int | None = None
    fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rubric:
    name: str
    version: int
    scale: tuple[int, int]
    sections: tuple[Section, ...]
    flags: tuple[Flag, ...] = ()
    grades: tuple[Grade, ...] = ()
    outputs: tuple[Output, ...] = ()
    justify: tuple[int, ...] = field(default=())

    @property
    def id(self) -> str:
        return f"{self.name}_v{self.version}"

    @property
    def items(self) -> list[Item]:
        return [item for section in self.sections for item in section.items]

    def section_of_item(self, item_id: Column) -> Column:
        return lookup({i.id: s.key for s in self.sections for i in s.items}, item_id)

    def type_of_item(self, item_id: Column) -> Column:
        return lookup({i.id: i.type for i in self.items}, item_id)

    def cap_of_flag(self, flag_id: Column) -> Column:
        return lookup({f.id: f.cap for f in self.flags}, flag_id)

    def severity_of_flag(self, flag_id: Column) -> Column:
        return lookup({f.id: f.severity for f in self.flags}, flag_id)

    def grade_of(self, total: Column) -> Column:
        """Best band whose floor the total reaches."""
        chain: Column | None = None
        for g in sorted(self.grades, key=lambda g: -g.at_least):
            test = total >= F.lit(g.at_least)
            chain = F.when(test, g.name) if chain is None else chain.when(test, g.name)
        return chain if chain is not None else F.lit(None).cast("string")

    def item_reference(self, ref: Column) -> Column:
        """The item a score key or free reference names: '3.2', '2a.3', '2a (parts 1-2)'."""
        known = {i.id: i.id for i in self.items}
        ref = F.trim(ref)
        return F.coalesce(lookup(known, ref), lookup(known, F.regexp_extract(ref, r"^(.*)\.[^.]*$", 1)),
                          lookup(known, F.regexp_extract(ref, r"^([^\s:(]*)", 1)))


def section_means(items: DataFrame, rubric: Rubric, key: str = "evaluation_id") -> DataFrame:
    """One row per evaluation, one nullable column per section: the mean of its non-N/A scores.

    Scores are whole numbers, so sums are exact in any order and the division happens once.
    """
    section = F.col("section_key")
    means = []
    for s in rubric.sections:
        score = F.when(section == s.key, F.col("score"))
        means.append((F.sum(score) / F.count(score)).alias(s.key))
    return items.groupBy(key).agg(*means)


def weighted_total(rubric: Rubric, digits: int | None = None) -> Column:
    """Points of the live sections, rescaled to the full weight, out of 100.

    The sections are added in rubric order, so the last bit does not depend on partitioning.
    """
    whole = sum(s.weight for s in rubric.sections)
    live = sum((F.when(F.col(s.key).isNotNull(), F.lit(s.weight)).otherwise(0.0) for s in rubric.sections), F.lit(0.0))
    rescale = F.when(live > 0, F.lit(whole) / live).otherwise(0.0)
    points = sum((F.coalesce(F.lit(s.weight) * rescale * F.col(s.key) / F.lit(float(rubric.scale[1])), F.lit(0.0))
                  for s in rubric.sections), F.lit(0.0))
    raw = points * F.lit(100.0 / whole if whole else 0.0)
    return raw if digits is None else round_binary(raw, digits)


def lowest_caps(flags: DataFrame, rubric: Rubric, key: str = "evaluation_id") -> DataFrame:
    """The lowest cap among the flags of each evaluation, and how many different flags fired."""
    return (flags.withColumn("cap", rubric.cap_of_flag(F.col("flag_id"))).groupBy(key)
            .agg(F.min("cap").alias("cap"), F.count_distinct("flag_id").cast("int").alias("n_red_flags")))


def score_evaluations(evaluations: DataFrame, items: DataFrame, flags: DataFrame, rubric: Rubric,
                      key: str = "evaluation_id") -> DataFrame:
    """Every evaluation with section means, raw total, cap, rounded total and grade.

    An evaluation without any score gets a total of 0 and the lowest grade.
    """
    raw = F.col("__raw")
    capped = F.least(raw, F.coalesce(F.col("cap"), raw))
    return (evaluations.join(section_means(items, rubric, key), key, "left")
            .join(lowest_caps(flags, rubric, key), key, "left")
            .withColumn("__raw", weighted_total(rubric))
            .withColumn("score_before_caps", round_binary(raw, 2))
            .withColumn("cap_applied", F.when(raw > F.col("cap"), F.col("cap")))
            .withColumn("total_score", round_binary(capped, 1))
            .withColumn("grade", rubric.grade_of(F.col("total_score")))
            .withColumn("n_red_flags", F.coalesce("n_red_flags", F.lit(0)))
            .drop("__raw", "cap"))
