"""Lines, labels, values, and the order in which flaws are decided."""

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import matchers as m
from scoreloom.operators import checks as c
from scoreloom.operators import extraction as ex

COLOURS = m.Vocabulary({"Red": ["crimson"], "Blue": [], "Light Blue": ["sky blue"]})
LABELS = ex.Labels(["Wall", "Root Cause/Base", "Hopes and Fears"])


def one(spark, build, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(build).collect()[0][0]


@pytest.mark.parametrize("line, plain", [
    ("**Wall:** Red", "Wall: Red"), ("1. Wall: Red", "Wall: Red"), ("  - `Wall` Red", "Wall Red"), ("### Wall", "Wall"), ("> 2) Wall", "Wall"), ("•\tWall ", "Wall")])
def test_normalize_line(spark, line, plain):
    assert one(spark, ex.normalize_line(F.col("t")), t=line) == plain


@pytest.mark.parametrize("line", [
    "Wall: Red - it is", "1. **Wall — Crimson:** it is", "The wall (red) is", "Position 3: Wall = Red", "### Wall\n\nRed, clearly", "- Wall - Red. And so",
    "wall card: RED"])
def test_accepted_lines(spark, line):
    found = one(spark, ex.extract_lines(F.col("t"), LABELS, COLOURS), t="Intro\n" + line)
    assert [(e.label, e.value) for e in found] == [("Wall", "Red")]


@pytest.mark.parametrize("written, label", [("Root Cause", "Root Cause/Base"), ("base", "Root Cause/Base"), ("Root Cause / Base", "Root Cause/Base"),
                                            ("Hopes & Fears", "Hopes and Fears"), ("hopes/fears", "Hopes and Fears")])
def test_label_spellings(spark, written, label):
    found = one(spark, ex.extract_lines(F.col("t"), LABELS, COLOURS), t=f"{written}: Blue")
    assert [(e.label, e.value, e.line) for e in found] == [(label, "Blue", 0)]


def test_longest_alias_and_word_bounds(spark):
    assert one(spark, COLOURS.find(F.col("t")), t="a sky blue wall") == "Light Blue"
    assert one(spark, COLOURS.find(F.col("t")), t="bluest redder") is None
    assert one(spark, COLOURS.mentions(F.col("t")), t="red, light blue and Blue") == ["Red", "Light Blue", "Blue"]
    at = one(spark, COLOURS.find_all(F.col("t")), t="é red 😀 blue")
    assert [(f.value, f.position) for f in at] == [("Red", 2), ("Blue", 8)]


def test_lookahead_stops_at_the_next_label(spark):
    found = one(spark, ex.extract_lines(F.col("t"), LABELS, COLOURS), t="### Wall\n### Base\n\n\nRed here")
    assert [(e.label, e.value) for e in found] == [("Wall", None), ("Root Cause/Base", "Red")]


TOWN = m.QualifiedVocabulary({"Old Tower": [], "The Mill": ["Mill"], "River": []})


@pytest.mark.parametrize("text, named", [
    ("Old Tower reversed", ["Old Tower reversed"]), ("The Mill (reversed) turns", ["The Mill reversed"]), ("the reversed River runs", ["River reversed"]),
    ("Old Tower, not reversed. River", ["Old Tower", "River"]), ("down the river we go", []), ("River. It was reversed", ["River"]),
    ("River meets Old Tower reversed", ["River", "Old Tower reversed"])])
def test_qualified_mentions(spark, text, named):
    assert one(spark, TOWN.mentions(F.col("t")), t=text) == named


def test_qualified_find_reads_the_segment(spark):
    assert one(spark, TOWN.find(F.col("t")), t="the mill upside-down") == "The Mill reversed"


WALL = [("Wall", "Red"), ("Root Cause/Base", "Blue")]


def judged(spark, text, want=None, **options):
    expected = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("value")) for a, b in (want or WALL)])
    found = one(spark, ex.labeled_values(F.col("t"), expected, LABELS, options.pop("values", COLOURS), **options), t=text)
    return [(i.code, i.label) for i in found]


def test_flaws_in_order_of_precedence(spark):
    base = ("Root Cause/Base")
    assert judged(spark, "Wall: Red\nBase: Blue") == []
    assert judged(spark, "Wall: Blue\nBase: Blue") == [("value_mismatch", "Wall")]
    # a sentence that names both clears a line that differs
    assert judged(spark, "Wall: Blue\nBase: Blue\n\nBut the wall is really red.") == []
    assert judged(spark, "Wall: Red\nAll is blue today.") == [("missing_label", base)]
    assert judged(spark, "Wall: Red\nAll is blue today.", unlabeled="warning") == [("unlabeled_value", base)]
    assert judged(spark, "Wall: Red\nBase: who knows") == [("missing_value", base)]
    assert judged(spark, "Wall: Red\nAt the base we see red things.") == [("value_mismatch", base)]
    assert judged(spark, "Wall: Red\nWall: Blue\nBase: Blue") == [("conflicting_entries", "Wall")]
    assert judged(spark, "Base: Blue\nWall: Red", check_order=True) == [("out_of_order", None)]
    assert judged(spark, "Wall: Red\nBase: Blue", want=[*WALL, ("Roof", "Red")]) == [("unknown_label", "Roof")]


def test_wrong_qualifier_beside_the_label(spark):
    labels = [("Wall", "River reversed")]
    assert judged(spark, "At the Wall runs the River today.", want=labels, values=TOWN) == [("qualifier_mismatch", "Wall")]
    assert judged(spark, "At the Wall stands Old Tower.", want=labels, values=TOWN) == [("wrong_value", "Wall")]


def test_free_text_looks_behind_the_label(spark):
    free = m.FreeText()
    assert judged(spark, "The wall — bright red, I say", want=[("Wall", "bright red, i say")], values=free) == []
    assert judged(spark, "x\nI like the wall: green.", want=[("Wall", "green")], values=free) == []


def test_checks_keep_names_apart(spark):
    with pytest.raises(ValueError):
        c.run_checks(spark.range(1), [("a", c.no_issues()), ("a", c.no_issues())])
    with pytest.raises(KeyError):
        c.named_checks({"nonsense": {}})


def test_crashed_validator_leaves_the_verdict_open(spark):
    df = spark.createDataFrame([("x", None), ("y", "boom")], "text string, validator_error string")
    rows = c.verdict(c.run_checks(df, {"non_empty": c.non_empty(F.col("text"))})).orderBy("text").collect()
    assert [r.passed for r in rows] == [True, None]


def test_refusals(spark):
    for text, n in (("I'm sorry, but I can't help with that", 1), ("As an AI language model I", 1), ("I can help", 0)):
        assert len(one(spark, c.no_refusal(F.col("t")), t=text)) == n
