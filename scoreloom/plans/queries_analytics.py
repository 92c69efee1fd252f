"""Queries over scored evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions.draws import draw_text_sql
from scoreloom.operators import analytics as an
from scoreloom.operators import rubric as ru
from scoreloom.operators import runs as runs_of
from scoreloom.operators.rubric import Output
from scoreloom.plans.fixtures import RUBRIC, SQL_VIEWS
from scoreloom.plans.queries_scores import TOTALS
from scoreloom.plans.registry import query
from scoreloom.sources import tables as tb
from scoreloom.sources.folders import new_folder

SQL_VIEWS["fx_totals"] = f"""
    select e.*, t.* exclude (evaluation_id), e.o_orderkey % 11 felt,
      case when e.o_orderkey % 4 = 0 then 'undecided' when e.o_orderkey % 4 < 3 then 'would_return' end verdict
    from fx_evaluations e join ({TOTALS}) t on e.evaluation_id = t.evaluation_id"""
OUTPUTS = (Output("felt", "integer", bounds=(0, 10)), Output("verdict", "enum", choices=("would_return", "undecided", "never")))
DIMS = ("template", "generating_model", "evaluating_model", "persona_id", "run_id", "readings_dataset")


def facts(t):
    k = F.col("o_orderkey")
    e = t.evaluations.withColumns({
        "felt": k % 11, "verdict": F.when(k % 4 == 0, "undecided").when(k % 4 < 3, "would_return")})
    return ru.score_evaluations(e, t.item_scores, t.flags, RUBRIC)


def rounded(df, **digits):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def union_dims(dims, columns="*"):
    return " union all ".join(f"select '{d}' dimension, cast({d} as varchar) as value, {columns} from fx_totals" for d in dims)


def whole_facts(t):
    """Evaluations as records: they score the attempts of the requests, some of which are of runs that are not at hand."""
    k = F.col("o_orderkey")
    scored = facts(t)
    subject = F.concat(F.lit("req_"), F.floor(k / 3).cast("string"), F.lit("-a"), (k % 3 + 1).cast("string"))
    asked = F.concat(F.lit("req_"), k.cast("string"))
    evaluations = scored.select(
        "evaluation_id", "persona_id", "total_score", "score_before_caps", "cap_applied", "grade", "n_red_flags", F.struct("s1", "s2", "s3").alias("section_scores"),
        F.struct("felt", "verdict").alias("outputs"), subject.alias("subject_response_id"), F.concat(F.lit("run_"), (F.floor(k / 3) % 8).cast("string")).alias("subject_run_id"),
        F.when(k % 7 == 0, "told").alias("subject_model"), F.lit("document").alias("subject_type"), F.col("template").alias("subject_template"), F.lit(None).cast("string").alias("subject_input"),
        asked.alias("request_id"), F.when(k % 2 == 0, F.concat(asked, F.lit("-a1"))).alias("evaluation_response_id"))
    items = t.item_scores.withColumns({"justification": F.when(F.col("score").isin(1, 5), F.concat(F.lit("since "), F.col("item_key"))), "label": F.when(F.col("item_id") == "3", "part")})
    flags = t.flags.withColumns({"severity": RUBRIC.severity_of_flag(F.col("flag_id")), "quote": F.concat(F.lit("said "), F.col("flag_id"))})
    known = t.runs.where("run_id <> 'run_5'")
    own = t.runs.select("run_id", F.when(F.col("seed") != 2, F.col("model")).alias("model"), F.lit("driver").alias("provider"))
    return runs_of.evaluation_facts(evaluations, items, flags, t.requests, t.responses, known, t.text_names.withColumnRenamed("doc_id", "text_id"), own,
                                    t.documents.select(F.col("doc_id").alias("text_id"), "text"))


SQL_VIEWS["fx_facts"] = """
    select e.evaluation_id, e.persona_id, e.total_score, e.score_before_caps, e.cap_applied, e.grade, e.n_red_flags, e.felt, e.verdict, e.s1, e.s2, e.s3, e.template, u.dataset subject_dataset, coalesce(u.task, 'document') task,
      coalesce(case when e.o_orderkey % 7 = 0 then 'told' end, g.model, u.model) as model,
      coalesce(case when e.o_orderkey % 2 = 0 then a.model end, case when v.seed <> 2 then v.model end, case when v.run_id is null then 'unknown (default model)' else 'driver (default model)' end) evaluator, x.text subject_text
    from fx_totals e left join (select * from fx_runs where run_id <> 'run_5') u on u.run_id = concat('run_', e.o_orderkey // 3 % 8)
    left join fx_responses g on g.response_id = concat('req_', e.o_orderkey // 3, '-a', e.o_orderkey % 3 + 1) left join fx_response_texts x on x.response_id = g.response_id
    left join fx_requests q on q.request_id = concat('req_', e.o_orderkey) left join fx_runs v on v.run_id = q.run_id
    left join fx_responses a on a.response_id = concat('req_', e.o_orderkey, '-a1')"""
SQL_VIEWS["fx_fact_items"] = """
    select evaluation_id, count(*) n, string_agg(item_key || '=' || coalesce(cast(score as varchar), 'N/A'), ',' order by item_key) scores,
      string_agg(case when score in (1, 5) then item_key || '=since ' || item_key end, ',' order by item_key) why, string_agg(case when item_id = '3' then item_key end, ',' order by item_key) labelled
    from fx_item_scores group by 1"""
SQL_VIEWS["fx_fact_flags"] = """
    select evaluation_id, string_agg(flag_id || '/' || case flag_id when 'RF1' then 'severe' else 'moderate' end || '/said ' || flag_id, ',' order by flag_id) flags from fx_flags group by 1"""
FACT_COLUMNS = """f.evaluation_id, f.persona_id, f.total_score, f.score_before_caps, f.cap_applied, f.grade, f.n_red_flags, f.felt, f.verdict, round(f.s1, 6) s1, round(f.s2, 6) s2, round(f.s3, 6) s3, f.template, f.subject_dataset, f.task, f.model, f.evaluator,
       md5(f.subject_text) text_md5, coalesce(i.scores, '') scores, coalesce(i.why, '') why, coalesce(i.labelled, '') labelled, coalesce(r.flags, '') flags"""


def told(facts):
    """Every field of the records, nested ones as text."""
    listed = lambda column, entry: F.array_join(F.transform(F.array_sort(F.map_entries(column)), entry), ",")
    return facts.select(
        "evaluation_id", "persona_id", "total_score", "score_before_caps", "cap_applied", "grade", "n_red_flags", F.col("outputs.felt").alias("felt"), F.col("outputs.verdict").alias("verdict"),
        *[F.round(f"section_scores.{s}", 6).alias(s) for s in ("s1", "s2", "s3")], F.col("subject_template").alias("template"), "subject_dataset", "task", "model", "evaluator",
        F.md5(F.col("subject_text").cast("binary")).alias("text_md5"), listed("scores", lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("N/A")))).alias("scores"),
        listed("justifications", lambda e: F.concat(e["key"], F.lit("="), e["value"])).alias("why"), listed("labels", lambda e: e["key"]).alias("labelled"),
        F.array_join(F.transform("flags", lambda f: F.concat_ws("/", f["id"], f["severity"], f["quote"])), ",").alias("flags"))


@query("r9_evaluation_facts", f"select {FACT_COLUMNS} from fx_facts f left join fx_fact_items i on f.evaluation_id = i.evaluation_id left join fx_fact_flags r on f.evaluation_id = r.evaluation_id")
def _(t):
    return told(whole_facts(t))


@query("a1_select_evaluations", """
       select evaluation_id, total_score from fx_totals where template in ('tpl_v1', 'tpl_v2') and evaluating_model in ('1-URGENT', '5-LOW')
         and (persona_id in ('per_7', 'per_11', 'per_23') or persona_id in (select persona_id from fx_personas where segment = 'none'))""")
def _(t):
    wanted = {"template": ["tpl_v1", "tpl_v2"], "evaluating_model": ["1-URGENT", "5-LOW"], "run_id": [],
              "persona_id": ["per_7", "11", "CUSTOMER#000000023"]}
    return an.select_evaluations(facts(t), wanted, t.personas).select("evaluation_id", "total_score")


@query("a2_scope", f"""
       select dimension, value, n, n_values, cast(rank as int) rank from (
         select dimension, value, n, row_number() over (partition by dimension order by n desc, value) rank, count(*) over (partition by dimension) n_values
         from (select dimension, value, count(*) n from ({union_dims(DIMS, '1 one')}) group by 1, 2)) where rank <= 8""")
def _(t):
    return an.scope(t.evaluations)


OVERALL = """count(*) n, round(avg(total_score), 6) mean, round(quantile_cont(total_score, 0.5), 6) median, round(stddev_samp(total_score), 6) sd,
    min(total_score) low, max(total_score) high, count(*) filter (grade = 'A') "grade_A", count(*) filter (grade = 'B') "grade_B",
    count(*) filter (grade = 'C') "grade_C", count(*) filter (grade = 'D') "grade_D", count(*) filter (grade = 'F') "grade_F",
    count(*) filter (n_red_flags > 0) n_flagged, round(count(*) filter (n_red_flags > 0) * 100.0 / count(*), 6) flagged_percent, count(cap_applied) n_capped"""
SIX = {"mean": 6, "median": 6, "sd": 6, "flagged_percent": 6}


@query("a3_overall", f"select {OVERALL} from fx_totals")
def _(t):
    return rounded(an.overall(facts(t), RUBRIC), **SIX)


@query("a4_section_stats", """select section_key, weight, count(average) n, round(avg(average), 6) mean, round(stddev_samp(average), 6) sd from (
       select 's1' section_key, 30e0 weight, s1 average from fx_totals union all select 's2', 30e0, s2 from fx_totals union all
       select 's3', 40e0, s3 from fx_totals) group by 1, 2""")
def _(t):
    return rounded(an.section_stats(facts(t), RUBRIC), mean=6, sd=6)


@query("a5_question_stats", """select item_id, item_type, count(score) n, round(avg(score), 6) mean, round(stddev_samp(score), 6) sd,
       count(*) filter (score = 1) scored_1, count(*) filter (score = 2) scored_2, count(*) filter (score = 3) scored_3,
       count(*) filter (score = 4) scored_4, count(*) filter (score = 5) scored_5, count(*) filter (is_na) n_na from fx_item_scores group by 1, 2""")
def _(t):
    return rounded(an.question_stats(t.item_scores, RUBRIC), mean=6, sd=6)


@query("a6_per_label_means", """select item_id, cast(label_index as int) label_index, count(score) n, round(avg(score), 6) mean from fx_item_scores
       where score is not null group by 1, 2""")
def _(t):
    return rounded(an.per_label_means(t.item_scores), mean=6)


@query("a7_ratings", """select 'felt' output, '' choice, count(felt) n, round(avg(felt), 6) mean, round(stddev_samp(felt), 6) sd from fx_totals union all
       select 'verdict', c.choice, (select count(*) from fx_totals where verdict = c.choice), null, null
       from (select unnest(['would_return', 'undecided', 'never']) choice) c""")
def _(t):
    return rounded(an.ratings(facts(t), OUTPUTS), mean=6, sd=6)


@query("a8_flags_fired", """select flag_id, count(*) n, case flag_id when 'RF1' then 'severe' else 'moderate' end severity, any_value(cap) cap
       from fx_flags group by 1""")
def _(t):
    return an.flags_fired(t.flags.select("evaluation_id", "flag_id"), RUBRIC)


@query("a9_breakdown", f"""
       select dimension, value, n, n_texts, mean, sd, s1, s2, s3, cast(rank as int) rank from (
         select *, row_number() over (partition by dimension order by n desc, value) rank from (
           select dimension, value, count(*) n, count(distinct subject_response_id) n_texts, round(avg(total_score), 6) mean,
             round(stddev_samp(total_score), 6) sd, round(avg(s1), 6) s1, round(avg(s2), 6) s2, round(avg(s3), 6) s3
           from ({union_dims(DIMS)}) group by 1, 2)) where rank <= 15""")
def _(t):
    return rounded(an.breakdown(facts(t), RUBRIC, DIMS), mean=6, sd=6, s1=6, s2=6, s3=6)


@query("a10_score_report", f"""select {OVERALL}, round(avg(s1), 6) avg_s1, round(avg(s2), 6) avg_s2, round(avg(s3), 6) avg_s3,
       round(avg(felt), 6) avg_felt from fx_totals""")
def _(t):
    return rounded(an.score_report(facts(t), RUBRIC, OUTPUTS), **SIX, avg_s1=6, avg_s2=6, avg_s3=6, avg_felt=6)


SQL_VIEWS["fx_comments"] = """
    select evaluation_id, item_id question, cast(score as varchar) score, concat('note ', item_key, ' of ', evaluation_id) as text, 'justification' source
      from fx_item_scores where score in (1, 5) union all
    select evaluation_id, 'reaction', grade, concat('felt ', felt), 'output' from fx_totals union all
    select evaluation_id, case when o_orderkey % 3 = 0 then 'strengths' else cast(o_orderkey % 7 + 1 as varchar) end, null, concat('entry ', o_orderkey % 20), 'list'
      from fx_evaluations union all
    select evaluation_id, flag_id, null, concat('quote of ', evaluation_id), 'red_flag' from fx_flags"""


def comment_table(t):
    key, k = F.col("evaluation_id"), F.col("o_orderkey")
    items = t.item_scores.withColumn("justification", F.when(
        F.col("score").isin(1, 5), F.concat(F.lit("note \n "), F.col("item_key"), F.lit("  of "), key)))
    scored = facts(t).withColumn("reaction", F.concat(F.lit("felt "), F.col("felt").cast("string")))
    entries = t.evaluations.select("evaluation_id", F.lit("strengths").alias("output"), F.when(k % 3 == 0, "general").when(
        k % 3 == 1, F.concat((k % 7 + 1).cast("string"), F.lit(".2"))).otherwise(F.concat((k % 7 + 1).cast("string"), F.lit(" (parts 1-2)"))).alias("item"),
        F.concat(F.lit("entry "), (k % 20).cast("string")).alias("text"))
    flags = t.flags.select("evaluation_id", "flag_id", F.concat(F.lit("quote of "), key).alias("quote"))
    return an.comments(items, scored, entries, flags, RUBRIC, ["reaction"])


@query("a11_comments", "select * from fx_comments")
def _(t):
    return comment_table(t)


@query("a12_sample_comments", f"""
       with dealt as (select *, {draw_text_sql(7, 'comment', 'question', 'text')} draw,
           row_number() over (partition by question, score order by {draw_text_sql(7, 'comment', 'question', 'text')}, text) round_no from fx_comments),
         turns as (select question, score, case when score is null then 1000000 else least(2 * i, 2 * (n - 1 - i) + 1) end turn from (
           select question, score, row_number() over (partition by question order by score is null, try_cast(score as double) asc nulls last, score asc nulls last) - 1 i, count(score) over (partition by question) n
           from (select distinct question, score from fx_comments)))
       select question, score, text, cast(place as int) place from (
         select d.*, row_number() over (partition by d.question order by round_no, turn, draw) place
         from dealt d join turns u on d.question = u.question and d.score is not distinct from u.score) where place <= 6""")
def _(t):
    distinct_texts = comment_table(t)
    return an.sample_comments(distinct_texts, 6, "text", seed=7).select("question", "score", "text", "place")


@query("a13_counted_entries", """select output, text, n, cast(rank as int) rank from (select *, row_number() over (order by n desc, text) rank from (
       select 'topics' output, concat('entry ', o_orderkey % 20) as text, count(*) n from fx_evaluations group by 2)) where rank <= 12""")
def _(t):
    entries = t.evaluations.select(F.lit("topics").alias("output"), F.concat(F.lit("entry "), (F.col("o_orderkey") % 20).cast("string")).alias("text"))
    return an.counted_entries(entries, 12)


@query("a14_item_reference", """select item_key, item_id, case when label_index % 2 = 0 then null else item_id end named from fx_item_scores""")
def _(t):
    i, key = F.col("item_id"), F.col("item_key")
    ref = F.when(F.col("label_index") % 2 == 0, F.concat(F.lit("q"), key)).when(F.col("label_index") % 3 == 0, F.concat(i, F.lit(" (parts 1-2)"))).otherwise(key)
    return t.item_scores.select("item_key", "item_id", RUBRIC.item_reference(ref).alias("named"))


@query("a15_disagreement", """select subject_response_id, item_key, round(stddev_samp(score), 6) sd, count(*) n from fx_item_scores i
       join fx_evaluations e on i.evaluation_id = e.evaluation_id where item_type = 'O' and score is not null group by 1, 2 having count(*) > 1""")
def _(t):
    return rounded(an.disagreement(t.item_scores, t.evaluations), sd=6)


@query("a16_box_plot", """select template, evaluating_model, count(total_score) n, round(quantile_cont(total_score, 0.0), 6) low, round(quantile_cont(total_score, 0.25), 6) q1,
       round(quantile_cont(total_score, 0.5), 6) median, round(quantile_cont(total_score, 0.75), 6) q3, round(quantile_cont(total_score, 1.0), 6) high
       from fx_totals group by 1, 2""")
def _(t):
    return rounded(an.box_plot(facts(t), "total_score", ["template", "evaluating_model"]), low=6, q1=6, median=6, q3=6, high=6)


@query("a17_section_profile", """select generating_model, section_key, weight, count(average) n, round(avg(average), 6) mean, round(stddev_samp(average), 6) sd from (
       select generating_model, 's1' section_key, 30e0 weight, s1 average from fx_totals union all select generating_model, 's2', 30e0, s2 from fx_totals union all
       select generating_model, 's3', 40e0, s3 from fx_totals) group by 1, 2, 3""")
def _(t):
    return rounded(an.section_stats(facts(t), RUBRIC, ["generating_model"]), mean=6, sd=6)


@query("a18_text_distribution", """select subject_response_id, item_id, score, count(*) n from fx_item_scores i join fx_evaluations e on i.evaluation_id = e.evaluation_id
       where score is not null group by 1, 2, 3""")
def _(t):
    return an.text_distribution(t.item_scores, t.evaluations)


@query("a19_evaluator_effect", """
       with m as (select subject_response_id, evaluating_model, avg(total_score) mean from fx_totals group by 1, 2)
       select a.evaluating_model, count(*) n_shared, round(avg(a.mean - b.mean), 6) difference from m a join m b on a.subject_response_id = b.subject_response_id
       where a.evaluating_model <> '1-URGENT' and b.evaluating_model = '1-URGENT' group by 1""")
def _(t):
    return rounded(an.evaluator_effect(facts(t), "1-URGENT", ["subject_response_id"]), difference=6)


@query("a20_template_pairs", """
       with f as (select p.input_id, p.template, case when v.passed then 1e0 when not v.passed then 0e0 end ok
         from fx_validations v join fx_responses r on v.response_id = r.response_id join fx_requests q on r.request_id = q.request_id
         join fx_prompts p on q.prompt_id = p.prompt_id)
       select input_id, round(a, 6) a, round(b, 6) b, round(b - a, 6) difference from (
         select input_id, avg(ok) filter (template = 'tpl_v1') a, avg(ok) filter (template = 'tpl_v2') b from f group by 1) where a is not null and b is not null""")
def _(t):
    judged = (t.validations.select("response_id", F.col("passed").cast("double").alias("ok")).join(t.responses.select("response_id", "request_id"), "response_id")
              .join(t.requests.select("request_id", "prompt_id"), "request_id").join(t.prompts.select("prompt_id", "template", "input_id"), "prompt_id"))
    return rounded(an.template_pairs(judged, "tpl_v1", "tpl_v2", "ok"), a=6, b=6, difference=6)


@query("a21_each_split", f"select evaluating_model, {OVERALL} from fx_totals group by 1")
def _(t):
    return rounded(an.overall(facts(t), RUBRIC, ["evaluating_model"]).orderBy(F.desc("n"), "evaluating_model"), **SIX)


@query("s17_export_evaluations", f"select {FACT_COLUMNS} from fx_facts f left join fx_fact_items i on f.evaluation_id = i.evaluation_id left join fx_fact_flags r on f.evaluation_id = r.evaluation_id")
def _(t):
    # the whole records, written as a table and read again
    facts = whole_facts(t)
    place = new_folder(t.spark, "evaluations")
    tb.export_evaluations(facts, place)
    return told(t.spark.read.schema(facts.schema).parquet(place))
