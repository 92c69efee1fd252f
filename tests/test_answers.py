"""JSON in replies, quotes, typed values."""

import pytest
from pyspark.sql import functions as F

from scoreloom.functions.text import common_prefix, normalize_prompt, quote_in_text, sentences
from scoreloom.operators import answers as an
from scoreloom.plans.queries_answers import ANSWER_RUBRIC


def one(spark, build, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(build).collect()[0][0]


@pytest.mark.parametrize("reply, found", [
    ('{"a": 1}', '{"a":1}'), ('```json\n{"a": 1}\n```', '{"a":1}'), ('```\n{"a": 1}```', '{"a":1}'), ('Sure: {"a": {"b": 2}} Bye.', '{"a":{"b":2}}'),
    ('  {"a": 1}\n', '{"a":1}'), ("nothing", None), ("", None), (None, None), ('{"a": 1', None), ('{"a":1} {"b":2}', None), ('{"a":1} tail', '{"a":1}')])
def test_extract_json(spark, reply, found):
    assert one(spark, F.to_json(an.extract_json(F.col("t"))), t=reply) == found


TEXT = "The road “bends” here. **You** may rest — but not\n for long, said Straße."


@pytest.mark.parametrize("quote, there", [
    ('the road "bends" here', True), ("you may rest - but not for long", True), ("The road ... for long", True), ("for long ... the road", False),
    ("“You may rest”", True), ("STRASSE", True), ("never said", False), ("...", False), ("", False), ("The road … rest", True)])
def test_quotes(spark, quote, there):
    assert one(spark, quote_in_text(F.col("q"), F.col("t")), q=quote, t=TEXT) is there


SCORES = '"item_scores":{"1":3,"2":3,"3":[3,3],"4":3}'
OUT = '"outputs":{"reaction":"x","felt":"7","verdict":"undecided"}'
DEFECTS = [("true", "not_a_whole_number"), ('"x"', "not_a_whole_number"), ("2.5", "not_a_whole_number"), ("6", "out_of_range"), ("0", "out_of_range"),
           ('"-3"', "out_of_range"), ("null", "na_not_allowed"), ('"n/a"', "na_not_allowed"), ('"N.A."', "na_not_allowed"), ('"2.0"', "not_a_whole_number"),
           ("[1]", "not_a_whole_number")]
REPLIES = {
    "mixed": '{"item_scores":{"1":" 3 ","2":2.0,"3":[4,true],"4":null},' + OUT + "}",
    **{raw: '{"item_scores":{"1":%s,"2":2,"3":[4,4],"4":2},%s}' % (raw, OUT) for raw, _ in DEFECTS},
    "list": "[1]", "scores list": '{"item_scores":[1]}', "prose": "no", "nothing": "null",
    "flags object": "{%s,%s,%s}" % (SCORES, OUT, '"red_flags":{"id":1}'),
    "flags": "{%s,%s,%s}" % (SCORES, OUT, '"red_flags":[{"id":"RF1","quote":"a"},{"id":"RF1","quote":"b"},{"id":null,"quote":"c"}]'),
    "no outputs": "{%s}" % SCORES,
}


@pytest.fixture(scope="module")
def answers(spark):
    df = spark.createDataFrame(list(REPLIES.items()), "name string, text string")
    return {r.name: r for r in an.read_answers(df, ANSWER_RUBRIC, "text", labels={"parts": F.lit(2)}).collect()}


def test_values_and_problem_order(answers):
    r = answers["mixed"]
    assert [(s.item_key, s.score, s.is_na) for s in r.scores] == [("1", 3, False), ("2", 2, False), ("3.1", 4, False), ("4", None, True)]
    assert [(p.code, p.item) for p in r.problems] == [("not_a_whole_number", "3.2")] and not r.usable
    assert r.outputs.felt == 7 and r.outputs.strengths == [] and r.outputs.topics == []


@pytest.mark.parametrize("raw, code", DEFECTS)
def test_score_defects(answers, raw, code):
    assert [(p.code, p.item) for p in answers[raw].problems if p.severity == "error"] == [(code, "1")]


@pytest.mark.parametrize("name, code", [("list", "bad_structure"), ("scores list", "bad_structure"), ("prose", "invalid_json"), ("nothing", "invalid_json")])
def test_unreadable(answers, name, code):
    r = answers[name]
    assert [p.code for p in r.problems] == [code] and not r.usable and not r.scores


def test_flags_and_outputs(answers):
    assert "bad_red_flags" in [p.code for p in answers["flags object"].problems]
    r = answers["flags"]
    assert [(f.flag_id, f.quote) for f in r.red_flags] == [("RF1", "a")] and [p.code for p in r.problems] == ["unknown_red_flag"]
    assert [p.code for p in answers["no outputs"].problems] == ["missing_outputs", "bad_output", "bad_output", "bad_output"]


def test_sentences_prefix_and_prompt(spark):
    assert one(spark, sentences(F.col("t")), t="One. Two!  Three?\n\nFour\nfive.") == ["One.", "Two!", "Three?", "Four", "five."]
    for a, b, n in (("abcd", "abxy", 2), ("", "x", 0), ("same", "same", 4), ("ab", "abc", 2)):
        assert one(spark, common_prefix(F.col("a"), F.col("b")), a=a, b=b) == n
    assert one(spark, normalize_prompt(F.col("t")), t="\n a  \n\n\n\nb\t\r\nc ") == "a\n\nb\nc"


def test_last_of_repeated_names_counts(spark):
    twice = '{"item_scores":{"1":5,"2":3,"1":2,"3":[4,4],"4":3},"item_scores":{"1":1,"2":3,"1":4,"3":[4,4],"4":3},%s}' % OUT
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    df = spark.createDataFrame([(1, twice), (2, '{"a":1,"a":2}')], "k int, t string")
    got = an.read_answers(df, ANSWER_RUBRIC, "t", labels={i.per: F.lit(2) for i in ANSWER_RUBRIC.items if i.per})
    assert spark.conf.get(name) == before
    assert {r.item_key: r.score for r in an.score_rows(got, "k").collect()}["1"] == 4
    values = an.with_json(df, "t", "v").select("k", F.to_json("v").alias("v"))
    assert {r.k: r.v for r in values.where("k = 2").collect()} == {2: '{"a":2}'}
    fields = an.read_fields(spark.createDataFrame([('{"a":"x","a":"y"}',)], "t string"), "t", {"a": "text"}).first()
    assert fields.usable and fields.a == "y"
