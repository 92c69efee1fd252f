"""Operators at sizes and shapes that plain forms of them do not stand: held against plain versions."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import matchers as m
from scoreloom.functions.running import cuttings
from scoreloom.functions.values import fence
from scoreloom.operators import answers, checks, hidden_states, runs, skew, vector_sets, windows
from scoreloom.operators.rubric import Item, Rubric, Section
from scoreloom.operators.vocabularies import table_mentions

ALIASES = ["red fox", "Red", "fox-hunt", "(r)", "it's", "it", "red fox den", "c++", "a b", "★ star", "fox", "foxes", "re"]


def texts():
    rng = random.Random(1)
    some = ["the Red fox den; red  fox, it's c++ (r) x(r) it ★ star fox-hunt fox-hunter A B a b a", "", None, "redfox red", "RED FOX DEN red", "foxes fox re red"]
    return some + [" ".join(rng.choice(ALIASES + ["x", "den", "'", " ", ".", "b", "a"]) for _ in range(30)) for _ in range(40)]


def wanted(rows):
    pattern = re.compile(r"(?<![\w'])(?:" + "|".join(re.escape(a) for a in sorted(ALIASES, key=len, reverse=True)) + r")(?![\w'])", re.I)
    return sorted((i, f.start(), f.group().upper()) for i, t in rows if t for f in pattern.finditer(t))


def test_mentions_of_a_pattern_and_of_a_table(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "id long, text string")
    table = spark.createDataFrame([(a, a.upper()) for a in ALIASES] + [(" ", "blank"), (None, "null")], "alias string, value string")
    got = sorted((r.id, r.position, r.alias.upper()) for r in table_mentions(df, "id", "text", table).collect())
    assert got == wanted(rows)
    vocabulary = m.Vocabulary({a.upper(): [a] for a in ALIASES})
    found = df.select("id", F.explode(vocabulary.find_all(F.col("text"))).alias("f")).select("id", "f.position", "f.value").collect()
    assert sorted(tuple(r) for r in found) == wanted(rows)
    every = table_mentions(df, "id", "text", table, overlaps=True).collect()
    assert len(every) > len(got) and {(r.id, r.position) for r in every} > {g[:2] for g in got}


@pytest.mark.parametrize("n", [10, 1_000, 20_000])
def test_vocabularies_of_any_size(spark, n):
    names = [f"name{i}" + (" zed" if i % 3 == 0 else "") for i in range(n)]
    df = spark.createDataFrame([(1, "a name3 zed, name3 and name9; Name7 zedd name1 zed")], "id long, text string")
    want = [("name3 zed", 2), ("name7", 30), ("name1", 41)]
    got = df.select(F.explode(m.Vocabulary(names).find_all(F.col("text"))).alias("f")).select("f.value", "f.position").collect()
    assert [tuple(r) for r in got] == want
    table = spark.createDataFrame([(x, x) for x in names], "alias string, value string")
    found = table_mentions(df, "id", "text", table).orderBy("position").select("value", "position").collect()
    assert [tuple(r) for r in found] == want


def test_long_texts_after_the_last_mention(spark):
    # behind its mention nothing is found in 240,000 characters: read once, and not again from each of them
    df = spark.createDataFrame([(1, "é red " + "blu " * 60_000), (2, " " * 120_000 + "."), (3, None)], "id long, text string")
    start = time.time()
    found = fence(df.select("id", "text", m.Vocabulary(["red"]).find_all(F.col("text")).alias("f")), ["f"])
    cut = found.select("id", "f", cuttings(F.col("text"), F.col("f.position"), F.lit(5)).alias("there")).orderBy("id").collect()
    assert [(r.id, None if r.f is None else [tuple(x) for x in r.f], r.there) for r in cut] == [(1, [("red", 2)], ["red b"]), (2, [], []), (3, None, None)]
    said = m.QualifiedVocabulary(["Red Fox"]).mentions(F.concat(F.lit("Red Fox reversed. "), F.col("text")))
    assert [r.said for r in df.where("id < 3").select(said.alias("said")).collect()] == [["Red Fox reversed"]] * 2
    table = spark.createDataFrame([("red", "red")], "alias string, value string")
    padded = df.withColumn("text", F.concat("text", F.lit(" " * 120_000)))
    assert [tuple(r) for r in table_mentions(padded, "id", "text", table).select("id", "position").collect()] == [(1, 2)]
    assert time.time() - start < 60


def test_a_table_vocabulary_travels_once_a_chunk(spark):
    # of each text the runs of tokens meet the aliases as hashes, once for each chunk; former plans shuffled every place with its text
    said = ["RED fox, den", "red  fox", "Straße STRASSE straẞe", "İx i̇x", "ΑΣ ας.α ΑΣ", "x red", "xred red'x (red)", None, "", "a 𝟙😀 red"]
    rows = [(i, t) for i, t in enumerate(said)] + [(20, "red fox"), (20, "RED foxes"), (None, "den"), (None, "den red")]
    df = spark.createDataFrame(rows, "id long, text string")
    names = [("red", 1), ("red fox", 2), ("red  fox", 3), ("strasse", 4), ("İX", 5), ("ΑΣ", 6), ("ΑΣ.Α", 7), ("(", 8), ("den", None), ("Red", 9), ("😀", 10)]
    found = table_mentions(df, "id", "text", spark.createDataFrame(names, "alias string, value long"))
    assert {f.name: f.dataType.simpleString() for f in found.schema} == {"id": "bigint", "value": "bigint", "alias": "string", "position": "int", "length": "int"}
    want = [(0, 2, "RED fox", 0), (0, None, "den", 9), (1, 3, "red  fox", 0), (2, 4, "Straße", 0), (2, 4, "STRASSE", 7), (2, 4, "straẞe", 15), (3, 5, "İx", 0), (3, 5, "i̇x", 3), (4, 6, "ΑΣ", 0),
            (4, 6, "ας", 3), (4, 6, "ΑΣ", 8), (5, 1, "red", 2), (6, 1, "red", 12), (9, 1, "red", 5), (20, 2, "red fox", 0), (None, None, "den", 0), (None, 1, "red", 4)]
    got = [(r.id, r.value, r.alias, r.position) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    many = spark.createDataFrame([(i, "red fox den " * 2_000) for i in range(40)], "id long, text string")
    plan = table_mentions(many, "id", "text", spark.createDataFrame(names, "alias string, value long"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan.split("InMemoryTableScan")[0] and plan.split("InMemoryTableScan")[0].count("Exchange hashpartitioning(__key") == 0


def test_tree_of_beginnings():
    rng = random.Random(3)
    for _ in range(60):
        words = {"".join(rng.choice("ab .") for _ in range(rng.randint(1, 6))) for _ in range(12)}
        tree, plain = re.compile(m.any_of(words)), re.compile("|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)))
        for _ in range(40):
            text = "".join(rng.choice("ab .") for _ in range(12))
            assert [f.span() for f in tree.finditer(text)] == [f.span() for f in plain.finditer(text)]


def test_a_million_tokens_in_linear_time(spark):
    def took(n: int) -> float:
        df = spark.createDataFrame([(1, "ab  cde " * (n // 2))], "id long, text string")
        start = time.time()
        spans = windows.tokenize(df, "id", "text").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("start")).alias("chars")).first()
        assert tuple(spans) == (n, 4 * n - 1, n * 5 // 2)
        cut = windows.multi_scale(df, "id", "text", char_limits=[17]).agg(F.max(F.length("text")).alias("longest"), F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()
        assert cut.longest <= 17 and cut.n == n
        return time.time() - start
    took(1000)
    small, large = took(100_000), took(1_000_000)
    assert large < 40 * max(small, 0.5)


def test_sums_of_long_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 9 == 0 else i % 3, i % 4, [float(x) for x in rng.normal(size=4096)]) for i in range(90)]
    df = spark.createDataFrame(rows, "a int, pos long, v array<double>").repartition(5)
    got = {r.a: r for r in vector_sets.vector_sums(df, ["a"], "v", squares=True).collect()}
    assert set(got) == {None, 0, 1, 2}
    for a, r in got.items():
        x = np.array([v for b, _, v in rows if b == a])
        assert r.n == len(x) and np.allclose(r["mean"], x.mean(axis=0)) and np.allclose(r.m2, ((x - x.mean(axis=0)) ** 2).sum(axis=0))
    whole = vector_sets.vector_sums(df, [], "v").collect()
    assert len(whole) == 1 and whole[0].n == 90 and np.allclose(whole[0]["mean"], np.mean([v for *_, v in rows], axis=0))
    pooled = {r.a: r.pooled for r in hidden_states.content_pool(df, ["a"], "v").collect()}
    assert np.allclose(pooled[1], np.mean([v for b, p, v in rows if b == 1 and p > 0], axis=0))
    plan = vector_sets.vector_sums(df, ["a"], "v")._jdf.queryExecution().toString()
    assert "posexplode" not in plan  # no row for each dimension


def test_volume_of_more_vectors_than_dimensions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5)) * np.array([1, 1, 1, 1, 1e-10])
    turn = np.linalg.qr(rng.normal(size=(5, 5)))[0]
    rows = [("flat", i, [float(c) for c in v]) for i, v in enumerate(x)] + [("turned", i, [float(c) for c in v]) for i, v in enumerate(x @ turn)] + [("two", 0, [0.0, 0.0]), ("two", 1, [3.0, 4.0]), ("one", 0, [1.0])]
    got = {r.g: r for r in vector_sets.semantic_volume(spark.createDataFrame(rows, "g string, k long, v array<double>").repartition(7), "g", "k", "v").collect()}
    values = np.linalg.svd((x - x[0]) / np.array([1, 1, 1, 1, 1e-10]), compute_uv=False)  # the scale of one axis is a factor of the volume
    want = float(np.log(values).sum() + math.log(1e-10) - math.lgamma(400))
    assert abs(got["flat"].log_volume - want) < 1e-6 and abs(got["turned"].log_volume - want) < 1e-4
    assert abs(got["two"].volume - 5.0) < 1e-12 and got["one"].volume == 0.0


def test_nearest_by_pivots(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 20
    x = np.vstack([c + rng.normal(size=(60, 8)) for c in centres] + [np.repeat(centres[:1], 30, axis=0)])
    rows = [(i % 2 if i < 700 else None, i, [float(v) for v in r]) for i, r in enumerate(x)] + [(7, 9000, [0.0] * 8), (0, 9001, None)]
    df = spark.createDataFrame(rows, "g int, k long, v array<double>")
    got = {r.k: r.least for r in vector_sets.nearest_distances(df, df, "g", "k", "v", pivots=16, block_rows=25, skip_self=True).collect()}
    known = {k: (g, np.array(v)) for g, k, v in rows if v is not None and g is not None}
    for k, (g, v) in known.items():
        others = [np.linalg.norm(v - w) for j, (h, w) in known.items() if h == g and j != k]
        assert (k in got) == bool(others) and (not others or abs(got[k] - min(others)) < 1e-9)


def test_many_ranks_at_once(spark):
    rng = np.random.default_rng(5)
    values = np.r_[rng.normal(size=5000) * 1e6, rng.normal(size=5000) * 1e-6, np.zeros(500), [1e300, -1e300]]
    rows = [("wide", float(v)) for v in values] + [("same", 2.5)] * 700 + [(None, 1.0), (None, 3.0), ("empty", None), ("wide", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    ranks = F.array(F.lit(0), F.floor((F.col("n") - 1) / 4), F.floor(F.col("n") / 2), F.col("n") - 1)
    got = {(r.g, r["rank"]): r.value for r in skew.order_statistics(df, ["g"], "v", ranks).collect()}
    ordered = np.sort(values)
    n = len(values)
    assert {k: v for k, v in got.items() if k[0] == "wide"} == {("wide", r): float(ordered[r]) for r in (0, (n - 1) // 4, n // 2, n - 1)}
    assert {v for k, v in got.items() if k[0] == "same"} == {2.5} and got[None, 0] == 1.0 and got[None, 1] == 3.0 and not [k for k in got if k[0] == "empty"]


def test_checks_that_raise_spoil_their_own_row_only(spark):
    df = spark.createDataFrame([(1, 2, "4"), (2, 0, "x"), (3, 5, None)], "id long, d int, t string")
    odd = {"divide": checks.issue_if(10 / F.col("d") > 3, checks.issue("large", "warning")), "read": checks.issue_if(F.col("t").cast("int") > 3, checks.issue("high", "error")),
           "own": checks.issue_if(F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).cast("boolean"), checks.issue("odd", "error"))}
    ran = checks.run_checks(df, odd)
    got = {r.id: [(i.check, i.code) for i in r.issues] for r in ran.collect()}
    assert got == {1: [("divide", "large"), ("read", "high")], 2: [("divide", "check_crashed"), ("read", "check_crashed")], 3: [("own", "check_crashed")]}
    assert checks.verdict(ran).where("passed").count() == 0


def test_validators_that_raise_leave_the_verdict_open(spark):
    responses = spark.createDataFrame([("a", "q1", None, "x"), ("b", "q2", None, ""), ("c", "q1", "down", None), ("d", "q9", None, "y")], "response_id string, request_id string, error string, text string")
    requests = spark.createDataFrame([("q1", 1), ("q2", 2)], "request_id string, want int")

    def validate(response, request):
        if not response["text"]:
            raise ValueError("empty")
        return {"passed": request is not None, "want": request and request["want"]}
    first = checks.validate_responses(responses, requests, validate, 1)
    got = {r.response_id: (r.passed, r.error, r.details) for r in first.collect()}
    assert got == {"a": (True, None, {"want": "1"}), "b": (None, "ValueError: empty", None), "d": (False, None, {"want": None})}
    again = checks.revalidate(first.where("response_id <> 'b'"), responses, requests, lambda r, q: {"note": 1}, 1)
    assert [(r.response_id, r.passed) for r in again.collect()] == [("b", None)]
    newest = checks.current_validations(first.unionByName(checks.revalidate(first, responses, requests, lambda r, q: {"passed": True}, 2)))
    assert {(r.response_id, r.version, r.passed) for r in newest.collect()} == {("a", 2, True), ("b", 2, True), ("d", 2, True)}


def test_gaps_in_attempts(spark):
    rows = [("q", 1, None), ("q", 4, "e"), ("q", 7, "e"), ("p", 3, "e"), ("p", 9, "e"), ("p", 20, "e")]
    got = runs.failed_attempt_history(spark.createDataFrame(rows, "request_id string, attempt int, error string")).collect()
    assert {(r.request_id, r.attempt): r.history_index for r in got} == {("q", 4): 0, ("q", 7): 1, ("p", 9): 0, ("p", 20): 1}


def test_outputs_are_asked_for_of_every_rubric(spark):
    rubric = Rubric("r", 1, (1, 5), (Section("A", "a", 1.0, (Item("1", "O"),)),))
    df = spark.createDataFrame([(1, '{"item_scores":{"1":3}}'), (2, '{"item_scores":{"1":3},"outputs":{}}'), (3, '{"item_scores":{"1":3},"outputs":[]}')], "id long, text string")
    got = {r.id: [p.code for p in r.problems] for r in answers.read_answers(df, rubric, "text").collect()}
    assert got == {1: ["missing_outputs"], 2: [], 3: ["missing_outputs"]}


def test_fenced_columns_are_computed_once(spark):
    df = fence(spark.range(10).select("id", F.rand().alias("x")), ["x"]).where("x < 2").select("id", "x", F.col("x").alias("y"))
    assert all(r.x == r.y for r in df.collect())


def test_texts_of_evaluations_travel_once(spark):
    n = 4000
    letters = "".join(random.Random(3).choice("abcdefghij ") for _ in range(6000))
    bodies = spark.createDataFrame([(i, letters[i * 9:] + letters[:i * 9]) for i in range(20)] + [(3, "again")], "text_id long, text string")
    names = spark.range(n).select(F.concat(F.lit("r"), "id").alias("response_id"), (F.col("id") % 25).alias("text_id"))
    nothing = lambda *columns: F.lit(None).cast("string")
    evaluations = spark.range(n + 2).select(
        F.concat(F.lit("e"), "id").alias("evaluation_id"), F.concat(F.lit("r"), "id").alias("subject_response_id"), F.lit("run").alias("subject_run_id"),
        *[nothing().alias(c) for c in ("subject_model", "subject_type", "subject_template", "subject_input", "request_id", "evaluation_response_id")])
    items = evaluations.select("evaluation_id", F.lit("1").alias("item_key"), F.lit(4).alias("score"), F.lit(False).alias("is_na"))
    flags = evaluations.limit(0).select("evaluation_id", F.lit("RF1").alias("flag_id"))
    requests = spark.createDataFrame([], "request_id string, run_id string")
    responses = names.select("response_id", F.lit("m").alias("model"))
    known = spark.createDataFrame([("run", "task", "set", "m", "p")], "run_id string, task string, dataset string, model string, provider string")
    whole = names.join(bodies, "text_id").select("response_id", "text")
    rows = lambda f: sorted((r.evaluation_id, r.subject_text or "", r.scores["1"], r.model) for r in f.select("evaluation_id", "subject_text", "scores", "model").collect())
    given = runs.evaluation_facts(evaluations, items, flags, requests, responses, known, whole, known)
    named = runs.evaluation_facts(evaluations, items, flags, requests, responses, known, names, known, bodies)
    assert rows(given) == rows(named) and len(rows(named)) == n + 2 + n // 25
    # each text is shuffled with its body alone
    plan = named._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in re.findall(r"Exchange hashpartitioning\((\w+)#", plan)]
    assert moved and plan.index("Exchange") > plan.index("SortMergeJoin [__text_id") and "text" not in moved


def test_tangent_bases_are_not_shuffled(spark):
    from scoreloom.plans.queries_vectors import vs
    df = spark.createDataFrame([(1, [3.0, 4.0, 0.0], 7), (1, [0.0, 1.0, 0.0], 8)], "id long, x array<double>, n long")
    rows = vs.tangent_bases(df, "id", "x", keep=["n"]).orderBy("n").collect()
    assert [r.n for r in rows] == [7, 8]
    assert all(abs(sum(a * b for a, b in zip(u, [3.0, 4.0, 0.0], strict=True))) < 1e-9 for u in rows[0].basis)


def test_red_flags_read_each_answer_once(spark):
    import __spark_entry__ as entry
    plan = entry.queries()["e6_red_flags"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan.lower() and "schema_of_variant" not in plan.lower()


def test_content_of_json_strings(spark):
    texts = ['"plain “x”"', '""', r'"a\"b\né\\"', "12", "null", "[1]", '"{$"', '"tab\\t"']
    got = spark.createDataFrame([(x,) for x in texts], "x string").select(answers.unquoted(F.col("x")).alias("u")).collect()
    assert [r.u for r in got] == ["plain “x”", "", 'a"b\né\\', "12", "null", "[1]", "{$", "tab\t"]


def test_patterns_look_at_one_character_first(spark):
    for case in (False, True):
        v = m.Vocabulary(["straße", "K", "^a", "-b]", "It", "★ x", "\\d"], case_sensitive=case)
        assert "(?=[" in v.pattern
        text = "STRASSE Straße straße K k K ^a ^A -b] IT It ı ★ X ★ x \\d xK"
        found = spark.createDataFrame([(text,)], "t string").select(
            F.regexp_extract_all("t", F.lit(v.pattern), F.lit(0)).alias("f"),
            F.regexp_extract_all("t", F.lit(re.sub(r"\(\?=\[.*?(?<!\\)\]\)", "", v.pattern, count=1)), F.lit(0)).alias("g")).first()
        assert found.f == found.g and len(found.f) >= 7


def test_spans_of_another_tokenizer(spark):
    from scoreloom.plans.queries_text import letter_spans
    df = spark.createDataFrame([(1, "Ab cd★ef"), (2, None), (3, ""), (4, "x")], "id long, t string")
    got = windows.tokenize(df, "id", "t", letter_spans()).orderBy("id", "pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, "b", 1, 2), (1, 1, "cd", 3, 5), (1, 2, "ef", 6, 8), (4, 0, "x", 0, 1)]


def test_totals_of_tokens_sort_no_tokens(spark):
    rows = [(1, "b a  c b"), (1, "zz A"), (2, ""), (3, None), (None, "é q"), (4, "x"), (5, "퟿ \U00010000 ￮")] + [(10 + i, f"t{i % 7} " * (i % 50) + "u") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string")
    plain = windows.tokenize(df, "id", "text").groupBy("id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.min("token").alias("first_token"), F.max("token").alias("last_token"))
    got = windows.token_totals(windows.tokenize(df, "id", "text", extremes=True), "id")
    assert got.schema == plain.schema
    assert sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)
    # below the counters, over the tokens themselves, nothing is sorted
    nodes = [line.strip(" +-:*") for line in got._jdf.queryExecution().sparkPlan().toString().splitlines()]
    kinds = [n for n in nodes if "Aggregate" in n.split("(")[0]]
    assert sum("SortAggregate" in k or "ObjectHash" in k for k in kinds) <= 2 and "HashAggregate" in kinds[-1] and not kinds[-1].startswith("Sort")


def test_mentions_travel_twice_without_their_spelling(spark):
    df = spark.createDataFrame([(1, "the fox DEN Fox, foxes"), (2, "den"), (2, "den fox"), (None, "Fox den"), (3, None)], "id long, text string")
    table = spark.createDataFrame([("fox", 1), ("fox den", 2), ("DEN", 3), ("fox", 7)], "alias string, value long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = table_mentions(df, "id", "text", table)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        got = sorted((r.id or 0, r.position, r.value, r.alias, r.length) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(0, 0, 2, "Fox den", 7), (1, 4, 2, "fox DEN", 7), (1, 12, 1, "Fox", 3), (2, 0, 3, "den", 3), (2, 4, 1, "fox", 3)]
    assert "max_by" not in plan and "__behind" not in plan
