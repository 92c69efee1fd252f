"""Rounding, weights, caps and grades."""

import pytest
from pyspark.sql import functions as F

from scoreloom.functions.values import round_binary
from scoreloom.operators.analytics import sample_comments, select_evaluations
from scoreloom.operators.rubric import Flag, Grade, Item, Rubric, Section, score_evaluations

GRADES = tuple(Grade(g, m) for g, m in (("A", 90.0), ("B", 80.0), ("C", 70.0), ("D", 60.0), ("F", 0.0)))
RUBRIC = Rubric("r", 1, (1, 5), (Section("A", "a", 60.0, (Item("1", "O"), Item("2", "S", per="parts"))),
                                 Section("B", "b", 40.0, (Item("3", "S", allow_na=True),))),
                (Flag("RF1", "severe", 40.0), Flag("RF2", "moderate", 60.0)), GRADES)


def score(spark, scores, flags=()):
    """scores: [(section, value or None)]"""
    evaluations = spark.createDataFrame([("e",)], "evaluation_id string")
    items = spark.createDataFrame([("e", s, v) for s, v in scores], "evaluation_id string, section_key string, score int")
    raised = spark.createDataFrame([("e", f) for f in flags], "evaluation_id string, flag_id string")
    return score_evaluations(evaluations, items, raised, RUBRIC).collect()[0]


def test_rounding_is_that_of_the_exact_value(spark):
    values = [i * 0.05 for i in range(2001)] + [70.85, 0.25, 70.25, 70.75, 99.95, 2.675, 1.005]
    df = spark.createDataFrame([(v,) for v in values if v >= 1], "x double")
    for digits in (1, 2):
        for r in df.select("x", round_binary(F.col("x"), digits).alias("y")).collect():
            assert r.y == round(r.x, digits), r.x


def test_weighted_total_and_per_label_items(spark):
    r = score(spark, [("a", 5), ("a", 4), ("a", 3), ("b", 2)])
    assert r.a == 4.0 and r.b == 2.0
    assert r.total_score == 64.0 and r.grade == "D" and r.cap_applied is None


def test_section_without_scores_drops_out(spark):
    r = score(spark, [("a", 4), ("b", None)])
    assert r.b is None and r.total_score == 80.0 and r.grade == "B"


def test_nothing_scored_is_the_lowest_grade(spark):
    r = score(spark, [("b", None)])
    assert r.total_score == 0.0 and r.grade == "F"


@pytest.mark.parametrize("flags, total, cap, n", [(["RF2"], 60.0, 60.0, 1), (["RF1", "RF2"], 40.0, 40.0, 2)])
def test_lowest_cap_wins(spark, flags, total, cap, n):
    r = score(spark, [("a", 5), ("b", 5)], flags)
    assert (r.total_score, r.cap_applied, r.n_red_flags, r.score_before_caps) == (total, cap, n, 100.0)


def test_cap_that_does_not_bind(spark):
    r = score(spark, [("a", 1), ("b", 1)], ["RF1"])
    assert r.total_score == 20.0 and r.cap_applied is None and r.n_red_flags == 1


@pytest.mark.parametrize("total, grade", [(90.0, "A"), (89.9, "B"), (70.0, "C"), (69.9, "D"), (0.0, "F")])
def test_bands(spark, total, grade):
    assert spark.range(1).select(RUBRIC.grade_of(F.lit(total))).collect()[0][0] == grade


def test_unknown_dimension(spark):
    with pytest.raises(ValueError):
        select_evaluations(spark.range(1), {"colour": ["red"]})


def test_sampled_comments_deal_over_scores(spark):
    rows = [("q", s, f"{s}-{i}") for s, n in (("1", 5), ("3", 50), ("5", 5), (None, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "question string, score string, text string")
    picked = [r.score for r in sample_comments(df, 8, "text").orderBy("place").collect()]
    assert picked == ["1", "5", "3", None, "1", "5", "3", None]
    again = sample_comments(df.repartition(7), 8, "text").orderBy("place").collect()
    assert [r.text for r in again] == [r.text for r in sample_comments(df, 8, "text").orderBy("place").collect()]
    few = sample_comments(df, 100, "text")
    assert few.count() == len(rows)
