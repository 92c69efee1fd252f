"""Queries that read evaluators' JSON answers.

Answers are written from the orders: the order key decides scores, wrapping and defects, so the
checking SQL can state what must be found without reading any JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.operators import answers as an
from scoreloom.operators.rubric import Flag, Grade, Item, Output, Rubric, Section
from scoreloom.plans.registry import query
from scoreloom.sources.folders import new_folder

ANSWER_RUBRIC = Rubric(
    name="answer_rubric", version=1, scale=(1, 5), justify=(1, 5),
    sections=(Section("A", "s1", 30.0, (Item("1", "O"), Item("2", "S"))),
              Section("B", "s2", 30.0, (Item("3", "O", per="parts"),)),
              Section("C", "s3", 40.0, (Item("4", "S", allow_na=True),))),
    flags=(Flag("RF1", "severe", 40.0), Flag("RF5", "moderate", 60.0)),
    grades=(Grade("A", 80.0), Grade("B", 65.0), Grade("C", 50.0), Grade("D", 35.0), Grade("F", 0.0)),
    outputs=(Output("reaction", "text"), Output("felt", "integer", bounds=(0, 10)),
             Output("verdict", "enum", choices=("would_return", "undecided")),
             Output("strengths", "list", fields=("item", "text"), max_items=2), Output("topics", "list")),
)


def answer_texts(t) -> DataFrame:
    """(answer_id, k, text, subject): one reply per order."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    one = (F.when(k % 10 == 2, '"N/A"').when(k % 10 == 3, "2.5").when(k % 10 == 4, "9")
           .when(k % 10 == 7, F.concat(F.lit('" '), s(1 + k % 5), F.lit(' "'))).otherwise(s(1 + k % 5)))
    two = F.when(k % 10 == 1, "").otherwise(F.concat(F.lit(',"2":'), s((1 + F.floor(k / 5) % 5).cast("long")), F.lit(".0")))
    three = F.concat(F.lit(',"3":['), s(1 + k % 5), F.lit(","), s(1 + (k + 1) % 5),
                     F.when(k % 10 == 5, "").otherwise(F.concat(F.lit(","), s(1 + (k + 2) % 5))), F.lit("]"))
    four = F.concat(F.lit(',"4":'), F.when(k % 3 == 0, '"n.a."').otherwise(s(1 + k % 4)))
    extra = F.when(k % 10 == 6, ',"9":3').otherwise("")
    scores = F.when(k % 10 == 9, "").otherwise(F.concat(F.lit('"item_scores":{"1":'), one, two, three, four, extra, F.lit("},")))
    real = F.concat(F.lit("“STATUS "), F.col("o_orderstatus"), F.lit(" … *was* noted”"))
    quote = lambda flag, q: F.concat(F.lit('{"id":"' + flag + '","quote":"'), q, F.lit('"}'))
    flags = (F.when(k % 12 == 0, quote("RF1", real)).when(k % 12 == 6, quote("RF1", F.lit("was noted ... status")))
             .when(k % 6 == 1, quote("XX", F.lit("q"))).when(k % 6 == 2, quote("RF5", F.lit(" ")))
             .when(k % 6 == 3, F.concat(quote("RF5", real), F.lit(","), quote("RF5", F.lit("nowhere")))).otherwise(""))
    outputs = F.concat(
        F.lit('"outputs":{"reaction":"'), F.when(k % 11 == 0, " ").otherwise("moved"), F.lit('","felt":'), s(k % 13),
        F.lit(',"verdict":"'), F.when(k % 17 == 0, "bogus").otherwise("Would Return"),
        F.lit('","strengths":[{"item":"1","text":"clear"},{"item":"'), F.when(k % 7 == 0, "31").otherwise("3.2"),
        F.lit('","text":"warm"}'), F.when(k % 5 == 0, ',{"item":"77","text":"late"}').otherwise(""),
        F.lit('],"topics":[" work ","","home"]}'))
    body = F.concat(F.lit("{"), scores, F.lit('"justifications":{"1":"because","4":" "},"red_flags":['), flags, F.lit("],"),
                    outputs, F.when(k % 10 == 8, "").otherwise("}"))
    text = (F.when(k % 4 == 0, body).when(k % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(k % 4 == 2, F.concat(F.lit("Here is my answer: "), body, F.lit(" I hope it helps.")))
            .otherwise(F.concat(F.lit("\n\t "), body, F.lit(" \n"))))
    subject = F.concat(F.lit("Order status "), F.col("o_orderstatus"), F.lit(" with priority "), F.col("o_orderpriority"),
                       F.lit(" was  noted."))
    return t.spread_orders.select(F.concat(F.lit("ans_"), s(k)).alias("answer_id"), k.alias("k"), text.alias("text"),
                           subject.alias("subject"), "o_custkey", "o_orderstatus", "o_orderdate")


def read(t) -> DataFrame:
    return an.read_answers(answer_texts(t), ANSWER_RUBRIC, "text", labels={"parts": F.lit(3)},
                           na_required={"4": F.col("k") % 3 == 0}, quoted_text=F.col("subject"))


def read_once(t, *columns: str) -> DataFrame:
    """These columns of the answers as a table, for what reads them more than once: reading an answer costs far more than keeping what was read."""
    answers = read(t).select(*columns)
    place = new_folder(t.spark, "answers")
    answers.write.parquet(place)
    return t.spark.read.schema(answers.schema).parquet(place)


# what the order key implies: raw scores with their keys, before defects take rows away
KEYS = """(select o_orderkey k, concat('ans_', o_orderkey) answer_id, o_custkey, o_orderstatus, o_orderdate from orders)"""
RAW = f"""(select k, answer_id, '1' item_id, '1' item_key, cast(null as int) label_index, 's1' section_key, 'O' item_type, cast(1 + k % 5 as int) score, false is_na,
      case when k % 10 = 2 then 'na_not_allowed' when k % 10 = 3 then 'not_a_whole_number' when k % 10 = 4 then 'out_of_range' end code from {KEYS}
    union all select k, answer_id, '2', '2', null, 's1', 'S', cast(1 + k // 5 % 5 as int), false, case when k % 10 = 1 then 'missing_item' end from {KEYS}
    union all select k, answer_id, '3', concat('3.', n), n, 's2', 'O', cast(1 + (k + n - 1) % 5 as int), false, case when k % 10 = 5 then 'wrong_length' end
      from {KEYS}, (select unnest([1, 2, 3]) n)
    union all select k, answer_id, '4', '4', null, 's3', 'S', case when k % 3 <> 0 then cast(1 + k % 4 as int) end, k % 3 = 0, null from {KEYS})"""
GOOD = f"(select * from {RAW} where code is null and k % 10 not in (8, 9))"
READABLE = "k % 10 not in (8, 9)"
USABLE = f"""(k % 10 not in (1, 2, 3, 4, 5, 8, 9) and k % 12 <> 6 and k % 6 not in (1, 2) and k % 11 <> 0 and k % 13 <= 10 and k % 17 <> 0)"""


@query("v17_extract_json", f"select k, k % 10 <> 8 is_json, case when k % 10 <> 8 then cast(k % 13 as int) end felt from {KEYS}")
def _(t):
    return (an.with_json(answer_texts(t), "text", "v")
            .select("k", F.col("v").isNotNull().alias("is_json"), F.try_variant_get("v", "$.outputs.felt", "int").alias("felt")))


@query("v19_quote_in_text", r"""select doc_id, kind, regexp_matches(quote, '[\p{L}\p{N}]') found from (
       select doc_id, 'words' kind, substr(text, length(text) // 3 + 1, length(text) // 3) quote from documents where text is not null union all
       select doc_id, 'elided', concat(substr(text, 1, length(text) // 4), substr(text, length(text) // 2 + 1)) from documents where text is not null)""")
def _(t):
    # passages taken from the whole text: its middle as it stands, and its two halves around an elision; one without a word is nowhere
    text, n = F.col("text"), F.length("text")
    middle = F.concat(F.lit("“"), F.substring(text, F.floor(n / 3).cast("int") + 1, F.floor(n / 3).cast("int")), F.lit("”"))
    elided = F.concat(F.substring(text, F.lit(1), F.floor(n / 4).cast("int")), F.lit(" … "),
                      F.substring(text, F.floor(n / 2).cast("int") + 1, n))
    quotes = F.explode(F.array(F.struct(F.lit("words").alias("kind"), middle.alias("quote")),
                               F.struct(F.lit("elided").alias("kind"), elided.alias("quote"))))
    return (t.texts.where(text.isNotNull()).select("doc_id", "text", quotes.alias("q"))
            .select("doc_id", "q.kind", an.quote_in_text(F.col("q.quote"), F.col("text")).alias("found")))


@query("e1_normalize_scores", f"""select answer_id, item_key, code, count(*) n from {RAW}
       where k % 10 not in (8, 9) and code in ('na_not_allowed', 'not_a_whole_number', 'out_of_range') group by all""")
def _(t):
    codes = ["na_not_allowed", "not_a_whole_number", "out_of_range"]
    return (an.problem_rows(read(t), "answer_id").where(F.col("code").isin(codes))
            .groupBy("answer_id", F.col("item").alias("item_key"), "code").agg(F.count(F.lit(1)).alias("n")))


@query("e2_explode_items", f"select answer_id, item_id, item_key, label_index, section_key, item_type, score, is_na from {GOOD}")
def _(t):
    return (read(t).select("answer_id", F.explode("scores").alias("s"))
            .select("answer_id", "s.item_id", "s.item_key", "s.label_index", "s.section_key", "s.item_type", "s.score", "s.is_na"))


@query("e3_answer_problems", f"""
       select answer_id, code, severity, item from (
         select answer_id, k, 'missing_item' code, 'error' severity, '2' item from {KEYS} where k % 10 = 1 union all
         select answer_id, k, 'wrong_length', 'error', '3' from {KEYS} where k % 10 = 5 union all
         select answer_id, k, 'unknown_item', 'warning', '9' from {KEYS} where k % 10 = 6 union all
         select answer_id, k, 'invalid_json', 'error', null from {KEYS} where k % 10 = 8 union all
         select answer_id, k, 'bad_structure', 'error', null from {KEYS} where k % 10 = 9)""")
def _(t):
    codes = ["missing_item", "wrong_length", "unknown_item", "invalid_json", "bad_structure", "missing_outputs"]
    return an.problem_rows(read(t), "answer_id").where(F.col("code").isin(codes)).select("answer_id", "code", "severity", "item")


@query("e4_na_rules", f"""select answer_id, code, severity from (
         select answer_id, 'na_expected' code, 'warning' severity from {KEYS} where {READABLE} and k % 3 <> 0 and k % 2 = 0 union all
         select answer_id, 'na_not_applicable', 'error' from {KEYS} where {READABLE} and k % 3 = 0 and k % 2 <> 0)""")
def _(t):
    marked = an.read_answers(answer_texts(t), ANSWER_RUBRIC, "text", labels={"parts": F.lit(3)}, na_required={"4": F.col("k") % 2 == 0})
    return (an.problem_rows(marked, "answer_id").where(F.col("code").isin("na_expected", "na_not_applicable"))
            .select("answer_id", "code", "severity"))


@query("e5_justifications", f"select answer_id, item_key item from {GOOD} where score in (1, 5) and item_id <> '1'")
def _(t):
    return an.problem_rows(read(t), "answer_id").where("code = 'missing_justification'").select("answer_id", "item")


@query("e6_red_flags", f"""
       select answer_id, flag_id, quote, flaw from (
         select answer_id, 'RF1' flag_id, concat('“STATUS ', o_orderstatus, ' … *was* noted”') quote, cast(null as varchar) flaw from {KEYS} where {READABLE} and k % 12 = 0 union all
         select answer_id, 'RF1', 'was noted ... status', 'quote_not_in_text' from {KEYS} where {READABLE} and k % 12 = 6 union all
         select answer_id, 'RF5', concat('“STATUS ', o_orderstatus, ' … *was* noted”'), null from {KEYS} where {READABLE} and k % 6 = 3 union all
         select answer_id, null, null, 'unknown_red_flag' from {KEYS} where {READABLE} and k % 6 = 1 union all
         select answer_id, 'RF5', null, 'red_flag_without_quote' from {KEYS} where {READABLE} and k % 6 = 2)""")
def _(t):
    answers = read_once(t, "answer_id", "red_flags", "problems")
    codes = ["unknown_red_flag", "red_flag_without_quote", "quote_not_in_text"]
    flawed = (an.problem_rows(answers, "answer_id").where(F.col("code").isin(codes))
              .select("answer_id", F.col("item").alias("flag_id"),
                      F.when(F.col("code") == "quote_not_in_text", F.col("message")).alias("quote"), F.col("code").alias("flaw")))
    misquoted = F.exists("problems", lambda p: p["code"] == "quote_not_in_text")
    sound = (answers.where(~misquoted).select("answer_id", F.explode("red_flags").alias("f"))
             .select("answer_id", "f.flag_id", "f.quote", F.lit(None).cast("string").alias("flaw")))
    return sound.unionByName(flawed)


@query("e7_outputs", f"""
       select answer_id, case when k % 11 <> 0 then 'moved' end reaction, case when k % 13 <= 10 then cast(k % 13 as int) end felt,
         case when k % 17 <> 0 then 'would_return' end verdict, cast(2 as int) n_strengths, 'work|home' topics,
         cast((case when k % 11 = 0 then 1 else 0 end) + (case when k % 13 > 10 then 1 else 0 end) + (case when k % 17 = 0 then 1 else 0 end) as int) n_bad,
         cast(case when k % 7 = 0 then 1 else 0 end as int) n_stray from {KEYS} where {READABLE}""")
def _(t):
    o, count = F.col("outputs"), lambda code: F.size(F.filter("problems", lambda p: p["code"] == code))
    return read(t).where("outputs is not null").select(
        "answer_id", o["reaction"].alias("reaction"), o["felt"].alias("felt"), o["verdict"].alias("verdict"),
        F.size(o["strengths"]).alias("n_strengths"), F.array_join(o["topics"], "|").alias("topics"),
        count("bad_output").alias("n_bad"), count("unknown_item_reference").alias("n_stray"))


@query("v20_rubric_answer", f"""
       select k, {USABLE} usable, cast(case when {READABLE} then (select count(*) from {GOOD} g where g.k = b.k and not g.is_na) else 0 end as int) n_scored,
         cast(case when {READABLE} then (select count(*) from {GOOD} g where g.k = b.k and g.is_na) else 0 end as int) n_na from {KEYS} b""")
def _(t):
    return read(t).select("k", "usable", F.size(F.filter("scores", lambda s: ~s["is_na"])).alias("n_scored"),
                          F.size(F.filter("scores", lambda s: s["is_na"])).alias("n_na"))


@query("e11_evaluation_rows", f"""
       select g.answer_id, cast(sum(score) filter (section_key = 's1') as bigint) s1_sum, cast(count(score) as int) n_scored,
         case when any_value(g.k) % 12 = 0 then 40e0 when any_value(g.k) % 6 = 3 then 60e0 end lowest_cap,
         cast(case when any_value(g.k) % 12 = 0 or any_value(g.k) % 6 = 3 then 1 else 0 end as int) n_red_flags,
         round(least(coalesce(case when any_value(g.k) % 12 = 0 then 40e0 when any_value(g.k) % 6 = 3 then 60e0 end, 1e9),
           100e0 * (30e0 * avg(score) filter (section_key = 's1') + 30e0 * avg(score) filter (section_key = 's2')
             + coalesce(40e0 * avg(score) filter (section_key = 's3'), 0)) / 5e0
             / (60e0 + case when count(score) filter (section_key = 's3') > 0 then 40e0 else 0e0 end)), 3) capped
       from {GOOD} g where {USABLE} group by 1""")
def _(t):
    from scoreloom.operators.rubric import weighted_total
    e = an.evaluation_columns(read(t), ANSWER_RUBRIC)
    cap = F.array_min(F.transform("red_flags", lambda f: ANSWER_RUBRIC.cap_of_flag(f["flag_id"])))
    return e.select("answer_id", (F.col("s1") * 2).cast("long").alias("s1_sum"),
                    F.size(F.filter("scores", lambda s: ~s["is_na"])).alias("n_scored"), cap.alias("lowest_cap"), "n_red_flags",
                    F.round(F.least(F.coalesce(cap, F.lit(1e9)), weighted_total(ANSWER_RUBRIC)), 3).alias("capped"))


@query("e11_item_and_flag_rows", f"""
       select answer_id, item_key key, score, case when item_id = '1' then 'because' end note from {GOOD} where {USABLE} union all
       select answer_id, case when k % 12 = 0 then 'RF1' else 'RF5' end, null, case when k % 12 = 0 then 'severe' else 'moderate' end
       from {KEYS} where {USABLE} and (k % 12 = 0 or k % 6 = 3)""")
def _(t):
    a = read_once(t, "answer_id", "usable", "scores", "justifications", "red_flags")
    items = an.score_rows(a, "answer_id").select("answer_id", F.col("item_key").alias("key"), "score", F.col("justification").alias("note"))
    flags = an.flag_rows(a, "answer_id", ANSWER_RUBRIC).select("answer_id", F.col("flag_id").alias("key"),
                                                               F.lit(None).cast("int").alias("score"), F.col("severity").alias("note"))
    return items.unionByName(flags)


EXPECTATION = {"situation": "text", "hoped_for": "text", "framing": ["predictive", "reflective", "creative", "no_preference"],
               "must_haves": "list", "sensitivities": "list"}


def expectation_texts(t) -> DataFrame:
    """One stage-one answer per order; its key decides which field is unusable."""
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit('{"situation":" waiting ","hoped_for":'), F.when(k % 7 == 0, "null").otherwise('"clarity"'),
        F.lit(',"framing":"'), F.when(k % 5 == 0, "vague").otherwise("No preference"), F.lit('","must_haves":["a"," ","b '),
        (k % 3).cast("string"), F.lit('"],"sensitivities":'), F.when(k % 11 == 0, '"none"').otherwise("null"), F.lit("}"))
    return t.spread_orders.select(k.alias("k"), F.when(k % 9 != 0, F.concat(F.lit("per_"), F.col("o_custkey").cast("string"))).alias("persona_id"),
                           F.concat(F.lit("req_"), F.floor(k / 3).cast("long").cast("string")).alias("request_id"),
                           (k % 3 + 1).cast("int").alias("attempt"), text.alias("text"))


OK_EXPECTATION = "o_orderkey % 7 <> 0 and o_orderkey % 5 <> 0 and o_orderkey % 11 <> 0"


@query("v18_json_fields", """
       select o_orderkey k, 'waiting' situation, case when o_orderkey % 7 <> 0 then 'clarity' end hoped_for,
         case when o_orderkey % 5 <> 0 then 'no_preference' end framing, concat('a|b ', o_orderkey % 3) must_haves,
         case when o_orderkey % 11 <> 0 then cast(0 as int) end n_sensitivities from orders""")
def _(t):
    f = an.read_fields(expectation_texts(t), "text", EXPECTATION)
    return f.select("k", "situation", "hoped_for", "framing", F.array_join("must_haves", "|").alias("must_haves"),
                    F.when(F.col("sensitivities").isNotNull(), F.size("sensitivities")).alias("n_sensitivities"))


def expectation_rows(t) -> DataFrame:
    f = an.read_fields(expectation_texts(t), "text", EXPECTATION)
    return f.where("usable and persona_id is not null")


@query("e12_expectation_rows", f"""select o_orderkey k, concat('per_', o_custkey) persona_id, 'clarity' hoped_for from orders
       where {OK_EXPECTATION} and o_orderkey % 9 <> 0""")
def _(t):
    return expectation_rows(t).select("k", "persona_id", "hoped_for")


FINAL_EXPECTATION = f"""select persona_id, max(k) k from (select o_orderkey k, concat('per_', o_custkey) persona_id,
       row_number() over (partition by o_orderkey // 3 order by o_orderkey % 3 desc) rn, {OK_EXPECTATION} and o_orderkey % 9 <> 0 ok from orders)
       where rn = 1 and ok group by 1"""


def final_expectations(t) -> DataFrame:
    """Usable expectations of final responses; the last one of each persona counts."""
    from scoreloom.operators.runs import final_responses, latest
    final = final_responses(expectation_texts(t).select("request_id", "attempt"))
    return latest(expectation_rows(t).join(final, ["request_id", "attempt"], "left_semi").select("persona_id", "k", "must_haves"),
                  ["persona_id"], "k")


@query("e13_final_expectations", FINAL_EXPECTATION)
def _(t):
    return final_expectations(t).select("persona_id", "k")


@query("e14_expectations_for", f"""
       select p.persona_id, e.k expectation, case when e.k is null then 'no expectations' end error from fx_personas p
       left join ({FINAL_EXPECTATION}) e on p.persona_id = e.persona_id""")
def _(t):
    return (t.personas.select("persona_id").join(final_expectations(t), "persona_id", "left")
            .select("persona_id", F.col("k").alias("expectation"), F.when(F.col("k").isNull(), "no expectations").alias("error")))
