"""Queries over requests, attempts, texts and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import runs
from scoreloom.plans.registry import query

FINAL = """select * from (select *, row_number() over (partition by request_id order by attempt desc) rn from fx_responses) where rn = 1"""


@query("r1_final_responses", "select request_id, response_id, attempt, run_id, error, finish_reason, completion_tokens "
       f"from ({FINAL})")
def _(t):
    return runs.final_responses(t.responses.select("request_id", "response_id", "attempt", "run_id", "error", "finish_reason",
                                                   "completion_tokens"))


@query("r2_finished_requests", f"select request_id from ({FINAL}) where error is null")
def _(t):
    return runs.finished_requests(t.responses.select("request_id", "attempt", "error"))


@query("r3_pending_requests", f"""select request_id, run_id from fx_requests where request_id not in
       (select request_id from ({FINAL}) where error is null)""")
def _(t):
    return runs.pending_requests(t.requests, t.responses.select("request_id", "attempt", "error")).select("request_id", "run_id")


@query("r4_attempt_offsets", """
       select d.request_id, cast(coalesce(m.last, 0) + d.k + 1 as int) attempt,
         concat(d.request_id, '-a', cast(coalesce(m.last, 0) + d.k + 1 as int)) response_id
       from (select r.request_id, k.k from fx_requests r, (select unnest([0, 1]) k) k) d
       left join (select request_id, max(attempt) last from fx_responses where error is null group by 1) m on d.request_id = m.request_id""")
def _(t):
    resumed = t.requests.select("request_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return runs.attempt_offsets(resumed, t.responses.where("error is null").select("request_id", "attempt"), "k").drop("k")


@query("r5_needs_retry", """select r.response_id, r.request_id from fx_responses r join fx_validations v on r.response_id = v.response_id
       where r.error is null and v.passed = false""")
def _(t):
    return runs.needs_retry(t.responses.select("response_id", "request_id", "error"), t.validations).select("response_id", "request_id")


@query("r6_merge_retry", """
       select p.request_id, p.attempt, p.attempts, cast(p.attempts - 1 as int) n_failed_attempts, p.n_api_errors, r.response_id, r.error,
         r.model, v.passed
       from (select request_id, coalesce(max(case when error is null then attempt end), min(attempt)) attempt,
               cast(count(*) as int) attempts, cast(count(*) filter (error is not null) as int) n_api_errors from fx_responses group by 1) p
       join fx_responses r on p.request_id = r.request_id and p.attempt = r.attempt
       left join fx_validations v on r.response_id = v.response_id""")
def _(t):
    return runs.merge_retries(t.responses, t.validations)


@query("r6_failed_attempt_history", """
       select request_id, response_id, attempt, error,
         cast(row_number() over (partition by request_id order by attempt) - 1 as int) history_index
       from (select r.*, coalesce(max(case when error is null then attempt end) over (partition by request_id),
               min(attempt) over (partition by request_id)) kept from fx_responses r) where attempt <> kept""")
def _(t):
    return runs.failed_attempt_history(t.responses.select("request_id", "response_id", "attempt", "error"))


@query("r6_history_with_gaps", """
       select request_id, response_id, attempt, cast(row_number() over (partition by request_id order by attempt) - 1 as int) history_index
       from (select r.*, coalesce(max(case when error is null then attempt end) over (partition by request_id), min(attempt) over (partition by request_id)) kept
             from (select request_id, response_id, attempt * attempt + n % 5 attempt, error from fx_responses where (n + attempt) % 4 <> 0) r) where attempt <> kept""")
def _(t):
    # some attempts are not at hand, and the others' numbers lie apart
    n, k = F.col("n"), F.col("attempt")
    some = t.responses.where((n + k) % 4 != 0).select("request_id", "response_id", (k * k + n % 5).alias("attempt"), "error")
    return runs.failed_attempt_history(some).select("request_id", "response_id", "attempt", "history_index")


@query("r7_load_subjects", f"""
       select r.request_id, r.response_id, q.run_id, coalesce(r.model, q.model) as model, p.template, p.input_id, x.n_chars, v.passed
       from ({FINAL}) r join fx_requests q on r.request_id = q.request_id join fx_prompts p on q.prompt_id = p.prompt_id
       join fx_response_texts x on r.response_id = x.response_id left join fx_validations v on r.response_id = v.response_id
       where r.error is null and x.text <> '' and p.template = 'tpl_v1' and lower(coalesce(r.model, q.model)) in ('model_0', 'model_2')
         and coalesce(v.passed, true)""")
def _(t):
    s = runs.load_subjects(t.requests, t.prompts, t.responses, t.response_texts, t.validations,
                           templates=["tpl_v1"], models=["MODEL_0", "model_2"], valid_only=True)
    return s.select("request_id", "response_id", "run_id", "model", "template", "input_id",
                    F.length("text").cast("long").alias("n_chars"), "passed")


@query("r8_rebuild_requests", """select q.request_id, q.model, q.run_id, p.template, p.input_id, i.m from fx_requests q
       join fx_prompts p on q.prompt_id = p.prompt_id join fx_inputs i on p.input_id = i.input_id""")
def _(t):
    return runs.rebuild_requests(t.requests, t.prompts, t.inputs).select("request_id", "model", "run_id", "template", "input_id", "m")


SUMMARY = f"""
    select q.run_id, count(*) n_requests, count(*) filter (f.response_id is not null and f.error is null) n_finished,
      count(*) filter (f.error is not null) n_api_errors, count(*) filter (f.response_id is null) n_not_attempted,
      count(*) filter (f.error is null and v.passed) n_valid, count(*) filter (f.error is null and not v.passed) n_invalid,
      count(*) filter (f.response_id is not null and f.error is null and v.passed is null) n_unvalidated,
      count(*) filter (f.error is null and f.attempt > 1) n_regenerated, cast(sum(a.n) as bigint) n_attempts,
      cast(sum(a.pt) as bigint) prompt_tokens, cast(sum(a.ct) as bigint) completion_tokens
    from fx_requests q left join ({FINAL}) f on q.request_id = f.request_id
    left join fx_validations v on f.response_id = v.response_id
    left join (select request_id, count(*) n, sum(prompt_tokens) pt, sum(completion_tokens) ct from fx_responses group by 1) a
      on q.request_id = a.request_id group by q.run_id"""


@query("r10_run_summary", SUMMARY)
def _(t):
    return runs.run_summary(t.requests.select("request_id", "run_id"), t.responses, t.validations)


@query("r11_template_summary", f"""
       select p.template, count(*) n_requests, count(*) filter (f.response_id is not null and f.error is null) n_finished,
         count(*) filter (f.error is null and v.passed) n_valid, count(*) filter (f.error is null and not v.passed) n_invalid,
         count(*) filter (w.passed) n_valid_first_try
       from fx_requests q join fx_prompts p on q.prompt_id = p.prompt_id left join ({FINAL}) f on q.request_id = f.request_id
       left join fx_validations v on f.response_id = v.response_id
       left join fx_validations w on w.response_id = concat(q.request_id, '-a1') group by 1""")
def _(t):
    return runs.template_summary(t.requests, t.prompts, t.responses, t.validations)


@query("r12_run_status", f"select run_id, n_requests, n_finished, case when n_finished = n_requests then 'completed' else 'partial' end status from ({SUMMARY})")
def _(t):
    return (runs.run_status(runs.run_summary(t.requests.select("request_id", "run_id"), t.responses, t.validations))
            .select("run_id", "n_requests", "n_finished", "status"))


@query("r13_attempt_rows", """
       with a as (select doc_id, string_split(text, chr(10)) l from documents)
       select concat('doc_', doc_id, '-a', k) response_id, concat('doc_', doc_id) request_id, cast(k as int) attempt, length(l[k]) n_chars,
         case when k = len(l) then 'stop' else 'rejected' end finish_reason from (select doc_id, l, unnest(range(1, len(l) + 1)) k from a)""")
def _(t):
    # the lines of a document as the attempts of one request: all but the last were rejected
    lines = t.documents.select("doc_id", F.split("text", "\n").alias("l"))
    attempt = lambda text, reason: F.struct(text.alias("text"), F.lit("m").alias("model"), F.lit(reason).alias("finish_reason"),
                                            F.lit(None).cast("string").alias("error"))
    record = lines.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("request_id"), F.element_at("l", -1).alias("text"), F.lit("m").alias("model"),
        F.lit("stop").alias("finish_reason"), F.lit(None).cast("string").alias("error"),
        F.transform(F.slice("l", 1, F.size("l") - 1), lambda x: attempt(x, "rejected")).alias("failed_attempts"))
    return runs.attempt_rows(record).select("response_id", "request_id", "attempt", F.col("n_chars").cast("long"), "finish_reason")


@query("r14_reject_reasons", """
       select code, count(distinct r.response_id) n_attempts from fx_responses r join fx_validations v on r.response_id = v.response_id
       join (select response_id, 'truncated' code from fx_responses where finish_reason = 'length' union all
             select response_id, 'low_quality' code from fx_validations where n_errors > 0) i on r.response_id = i.response_id
       where v.passed = false and r.error is null group by code""")
def _(t):
    r = t.responses.select("response_id", "request_id", "error", "finish_reason")
    issues = (r.where("finish_reason = 'length'").select("response_id", F.lit("truncated").alias("code"))
              .unionByName(t.validations.where("n_errors > 0").select("response_id", F.lit("low_quality").alias("code")))
              .withColumn("severity", F.lit("error")))
    return runs.reject_reasons(issues, runs.needs_retry(r, t.validations))


@query("r14_first_try_rate", """select r.run_id, round(avg(case when v.passed then 1.0::double else 0.0 end), 6) first_try_valid, count(*) n from fx_responses r
       join fx_validations v on r.response_id = v.response_id where r.attempt = 1 and v.passed is not null group by 1""")
def _(t):
    judged = t.validations.where("passed is not null").select("response_id", "passed")
    return (t.responses.where("attempt = 1").select("response_id", "run_id").join(judged, "response_id").groupBy("run_id")
            .agg(F.round(F.avg(F.col("passed").cast("double")), 6).alias("first_try_valid"), F.count(F.lit(1)).alias("n")))


@query("r15_usage_totals", """select model, cast(sum(prompt_tokens) as bigint) prompt_tokens, cast(sum(completion_tokens) as bigint) completion_tokens,
       cast(0 as bigint) total_tokens, cast(0 as bigint) cached_tokens from fx_responses group by 1""")
def _(t):
    return runs.usage_totals(t.responses, ["model"])


@query("r15_usage_from_api", """select event_type, cast(sum(cast(json_extract(props, '$.k') as int)) as bigint) prompt_tokens,
       cast(sum(cast(json_extract(props, '$.k') as int) // 2) as bigint) cached_tokens from events group by 1""")
def _(t):
    # the provider's nested usage record, built from the recorded properties
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"prompt_tokens":'), k, F.lit(',"prompt_tokens_details":{"cached_tokens":'),
                    F.floor(k.cast("int") / 2).cast("string"), F.lit("}}"))
    usage = runs.usage_from_api(F.try_parse_json(body))
    return (t.events.select("event_type", usage.alias("u")).groupBy("event_type")
            .agg(F.sum("u.prompt_tokens").alias("prompt_tokens"), F.sum("u.cached_tokens").alias("cached_tokens")))


@query("r16_batch_status", """
       select batch_id, raw_status, status, status in ('completed', 'failed') done from (
         select concat('bat_', user_id) batch_id, event_type raw_status, case event_type when 'view' then 'pending' when 'click' then 'running'
           when 'purchase' then 'completed' when 'error' then 'failed' else event_type end status,
           row_number() over (partition by user_id order by event_id desc) rn from events) where rn = 1""")
def _(t):
    names = {"view": "validating", "click": "in_progress", "purchase": "completed", "error": "failed"}
    from scoreloom.functions.values import lookup
    history = t.events.select(F.concat(F.lit("bat_"), F.col("user_id").cast("string")).alias("batch_id"), "event_id", "event_type",
                              F.coalesce(lookup(names, F.col("event_type")), F.col("event_type")).alias("raw_status"))
    return (runs.batch_status(history, "event_id")
            .select("batch_id", F.col("event_type").alias("raw_status"), "status", "done"))


@query("r17_dataset_totals", f"""select u.dataset, count(*) n_runs, cast(sum(s.n_requests) as bigint) n_requests, cast(sum(s.n_finished) as bigint) n_finished,
       cast(sum(s.n_valid) as bigint) n_valid from fx_runs u join ({SUMMARY}) s on u.run_id = s.run_id group by 1""")
def _(t):
    s = runs.run_summary(t.requests.select("request_id", "run_id"), t.responses, t.validations)
    return (t.runs.join(s, "run_id").groupBy("dataset")
            .agg(F.count(F.lit(1)).alias("n_runs"), *[F.sum(c).alias(c) for c in ("n_requests", "n_finished", "n_valid")]))


@query("r18_valid_rate_by_item", """
       select i.value, round(count(*) filter (v.passed) / nullif(count(v.passed), 0), 6) valid_rate, count(*) n
       from fx_validations v join fx_responses r on v.response_id = r.response_id join fx_requests q on r.request_id = q.request_id
       join fx_prompts p on q.prompt_id = p.prompt_id join fx_input_items i on p.input_id = i.input_id
       where i.label = 'Outcome' group by 1""")
def _(t):
    df = runs.valid_rate_by_value(t.validations, t.responses, t.requests, t.prompts, t.input_items, "Outcome")
    return df.withColumn("valid_rate", F.round("valid_rate", 6))


@query("r19_dataset_filter_count", """select u.dataset, count(*) n from fx_responses r join fx_runs u on r.run_id = u.run_id
       where u.dataset = 'set_1' group by 1""")
def _(t):
    wanted = t.runs.where("dataset = 'set_1'").select("run_id", "dataset")
    return t.responses.select("run_id").join(wanted, "run_id").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
