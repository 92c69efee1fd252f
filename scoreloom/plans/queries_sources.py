"""Queries over sources, table maintenance, batch files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import checks as c
from scoreloom.operators import sampling as sa
from scoreloom.plans.fixtures import SQL_VIEWS
from scoreloom.plans.registry import query
from scoreloom.sources import batches as ba
from scoreloom.sources import tables as tb
from scoreloom.sources.folders import new_folder
from scoreloom.streaming import live


@query("s1_read_table", "select response_id, request_id, run_id, attempt, error, completion_tokens from fx_responses")
def _(t):
    # responses as the JSON lines they are stored in, with blank lines between
    rows = t.responses.select("response_id", "request_id", "run_id", "attempt", "error", "completion_tokens", "received_at")
    lines = rows.select(F.explode(F.array(F.to_json(F.struct(*rows.columns)), F.lit("  "))).alias("value"))
    return tb.parse_lines(lines, "responses").select("response_id", "request_id", "run_id", "attempt", "error", "completion_tokens")


@query("s2_append_checked", "select response_id, run_id, passed, n_errors, cast(null as varchar) validator from fx_validations")
def _(t):
    return tb.conform(t.validations, "validations").select("response_id", "run_id", "passed", "n_errors", "validator")


@query("s2_required_nulls", """select 'response_id' "column", count(*) filter (response_id is null) n_missing from fx_responses union all
       select 'error', count(*) filter (error is null) from fx_responses union all select 'finish_reason', count(*) filter (finish_reason is null) from fx_responses""")
def _(t):
    return tb.required_nulls(t.responses, ["response_id", "error", "finish_reason"])


@query("s3_upsert", """select batch_id, status from (select user_id batch_id, event_type status, row_number() over (partition by user_id order by event_id desc) rn from events) where rn = 1""")
def _(t):
    # the latest of two thirds of the log, replaced by the latest of the rest
    from scoreloom.operators.runs import latest
    rows = t.events.select(F.col("user_id").alias("batch_id"), F.col("event_type").alias("status"), "event_id")
    cut = t.events.agg(F.floor(F.max("event_id") * 2 / 3)).scalar()
    old, new = rows.where(F.col("event_id") < cut), rows.where(F.col("event_id") >= cut)
    return tb.upsert(latest(old, ["batch_id"], "event_id"), latest(new, ["batch_id"], "event_id"), ["batch_id"]).select("batch_id", "status")


@query("s4_dedupe_reference", "select p_brand template_id, min(p_type) kind from part group by 1")
def _(t):
    return tb.dedupe_reference(t.part.select(F.col("p_brand").alias("template_id"), F.col("p_type").alias("kind")), ["template_id"])


@query("s5_upgrade_runs", """select o_orderkey run_id, o_orderpriority task, case when o_orderkey % 2 = 0 then concat('{"seed":', o_orderkey, ',"task_options":{"n":4}}')
       else concat('{"seed":', o_orderkey, '}') end config, case when o_orderkey % 2 = 1 then cast(6 as int) end schema_version from orders""")
def _(t):
    k = F.col("o_orderkey")
    old = t.orders.where(k % 2 == 0).select(k.alias("run_id"), F.col("o_orderpriority").alias("application"),
                                            F.concat(F.lit('{"application_options":{"n":4},"seed":'), k.cast("string"), F.lit("}")).alias("config"))
    new = t.orders.where(k % 2 == 1).select(k.alias("run_id"), F.col("o_orderpriority").alias("task"),
                                            F.concat(F.lit('{"seed":'), k.cast("string"), F.lit("}")).alias("config"), F.lit(6).alias("schema_version"))
    upgraded = tb.upgrade_runs([old, new])
    # members of a JSON object have no order: show them sorted
    members = F.from_json("config", "map<string,variant>")
    shown = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(members)), lambda m: F.concat(
        F.lit('"'), m, F.lit('":'), F.to_json(F.try_element_at(members, m)))), ","), F.lit("}"))
    return upgraded.select("run_id", "task", shown.alias("config"), "schema_version")


@query("s6_key_audit", """
       select * from (select 'responses' "table", 'duplicate response_id' problem, cast(count(*) - count(distinct response_id) as bigint) n from fx_responses union all
         select 'responses', 'request_id not in requests', count(*) from fx_responses where request_id not in (select request_id from fx_requests) union all
         select 'validations', 'duplicate response_id', cast(count(*) - count(distinct response_id) as bigint) from fx_validations union all
         select 'validations', 'response_id not in responses', count(*) from fx_validations where response_id not in (select response_id from fx_responses where attempt < 3) union all
         select 'requests', 'duplicate request_id', cast(count(*) - count(distinct request_id) as bigint) from fx_requests)""".replace(
         "select 'responses' \"table\", 'duplicate response_id' problem, cast(count(*) - count(distinct response_id) as bigint) n from fx_responses",
         "select 'responses' \"table\", 'duplicate response_id' problem, cast(count(*) - count(distinct response_id) as bigint) n from fx_responses where attempt < 3").replace(
         "count(*) from fx_responses where request_id", "count(*) from fx_responses where attempt < 3 and request_id"))
def _(t):
    # the third attempts went missing: their verdicts have lost their response
    kept = t.responses.where("attempt < 3").select("response_id", "request_id")
    return tb.key_audit({"responses": kept, "validations": t.validations.select("response_id"), "requests": t.requests.select("request_id")})


@query("s7_list_runs", "select run_id, dataset, created_at from fx_runs where dataset = 'set_0'")
def _(t):
    return tb.list_runs(t.runs, "set_0").select("run_id", "dataset", "created_at")


SQL_VIEWS["fx_lines"] = r"""select doc_id, lang, string_split(text, chr(10)) l from documents"""


def questions(t):
    """Documents as questions: the even lines play right answers, the odd ones wrong ones."""
    lines = F.split("text", "\n")
    return t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("question"),
                              F.filter(lines, lambda _, i: i % 2 == 0).alias("correct_answers"), F.filter(lines, lambda _, i: i % 2 == 1).alias("incorrect_answers"))


@query("s8_read_qa_jsonl", """select cast(doc_id as varchar) id, lang question, cast((len(l) + 1) // 2 as int) n_correct, cast(len(l) // 2 as int) n_incorrect from fx_lines""")
def _(t):
    lines = questions(t).select(F.to_json(F.struct("id", "question", "correct_answers", "incorrect_answers")).alias("value"))
    q = lines.select(F.from_json("value", tb.QA_SCHEMA).alias("q")).select("q.*")
    return q.select("id", "question", F.size("correct_answers").alias("n_correct"), F.size("incorrect_answers").alias("n_incorrect"))


@query("s9_explode_answers", """select cast(doc_id as varchar) id, lang question, a answer, (i - 1) % 2 = 0 correct from (select doc_id, lang, unnest(l) a, generate_subscripts(l, 1) i from fx_lines)""")
def _(t):
    return tb.explode_answers(questions(t), "id")


def nested_personas(t):
    k = F.col("persona_number")
    name = F.struct(F.when(k % 2 == 0, F.col("name")).alias("full"), F.col("segment").alias("first"), F.when(k % 3 != 0, F.col("nation")).alias("last"))
    return t.personas.select(F.col("persona_id").alias("id"), "persona_number", name.alias("name"),
                             F.struct("segment", F.struct("nation", "region").alias("location")).alias("demographics"))


@query("s10_flatten_personas", """select persona_id id, persona_number, segment "demographics.segment", nation "demographics.location.nation", region "demographics.location.region",
       case when persona_number % 2 = 0 then name end "name.full", segment "name.first", case when persona_number % 3 <> 0 then nation end "name.last" from fx_personas""")
def _(t):
    return tb.flatten(nested_personas(t))


@query("s11_persona_rows", """select persona_id, persona_number, case when persona_number % 2 = 0 then name when persona_number % 3 <> 0 then concat(segment, ' ', nation) else segment end as name,
       sha256(concat('{"demographics":{"segment":"', segment, '","location":{"nation":"', nation, '","region":"', region, '"}},"id":"', persona_id, '","name":{',
         case when persona_number % 2 = 0 then concat('"full":"', name, '",') else '' end, '"first":"', segment, '"',
         case when persona_number % 3 <> 0 then concat(',"last":"', nation, '"') else '' end, '},"persona_number":', persona_number, '}')) content_sha256 from fx_personas""")
def _(t):
    return tb.persona_rows(nested_personas(t), "driver").select("persona_id", "persona_number", "name", "content_sha256")


@query("s12_persona_audit", """select 'repeated id' problem, concat('per_', c_nationkey) as value from customer where c_custkey % 2 = 0 group by c_nationkey having count(*) > 1 union all
       select 'repeated number', cast(c_nationkey as varchar) from customer group by c_nationkey having count(*) > 1 union all
       select 'empty id', '' from customer where c_custkey % 2 = 1""")
def _(t):
    k = F.col("c_custkey")
    broken = t.customer.select(F.when(k % 2 == 0, F.concat(F.lit("per_"), F.col("c_nationkey").cast("string"))).otherwise("").alias("id"), F.col("c_nationkey").alias("persona_number"))
    return tb.persona_audit(broken)


@query("s13_batch_lines", """select model, (row_number() over (partition by model order by n) - 1) // 100 file_no,
       concat('{"custom_id":"', request_id, '","method":"POST","url":"/v1/chat/completions","body":{"model":"', model, '","messages":[{"role":"user","content":"', prompt_id, '"}]}}') as value from fx_requests""")
def _(t):
    return ba.batch_lines(t.requests, "n", sa.messages(F.col("prompt_id")), max_lines=100)


_FULL = """select model, row_number() over (partition by model order by n) - 1 as line, concat('{"custom_id":"', request_id, '","method":"POST","url":"/v1/chat/completions","body":{"model":"', model,
         '","messages":[{"role":"user","content":"', repeat('x', cast(300 - length(request_id) as int)), '"}]}}') as value from fx_requests"""


@query("s13_batch_bytes", f"""select model, (line // 100) * ((99 + fit) // fit) + (line % 100) // fit as file_no, value
       from (select *, least(100, 20000 // (length(value) + 1)) as fit from ({_FULL}))""")
def _(t):
    # lines of equal size in each model, so a file of 20,000 bytes holds the same number of them
    content = F.repeat(F.lit("x"), (300 - F.length("request_id")).cast("int"))
    return ba.batch_lines(t.requests, "n", sa.messages(content), max_lines=100, max_bytes=20_000)


def result_lines(t):
    """(output, errors): what a provider sends back for the requests; every sixth gets nothing."""
    n, rid = F.col("n"), F.col("request_id")
    body = F.concat(F.lit('{"choices":[{"message":{"content":"reply '), n.cast("string"), F.lit('"},"finish_reason":"stop"}],"data":[{"embedding":['),
                    n.cast("string"), F.lit(',0.5]}]}'))
    line = lambda status, b: F.concat(F.lit('{"custom_id":"'), rid, F.lit(f'","response":{{"status_code":{status},"body":'), b, F.lit('},"error":null}'))
    out = t.requests.where("n % 6 in (0, 1, 2)").select(F.when(n % 6 == 2, line(429, F.lit('{"error":{"message":"slow down"}}'))).otherwise(line(200, body)).alias("value"))
    err = t.requests.where("n % 6 in (3, 4)").select(F.when(n % 6 == 3, F.concat(F.lit('{"custom_id":"'), rid, F.lit('","response":null,"error":{"code":"expired","message":"too late"}}')))
                                                      .otherwise(line(500, F.lit('{"why":1}'))).alias("value"))
    return out, err


@query("s14_batch_results", """select request_id, case when n % 6 in (0, 1) then concat('reply ', n) end as text, case when n % 6 in (0, 1) then 'stop' end finish_reason,
       case n % 6 when 2 then 'HTTP 429: slow down' when 3 then 'expired: too late' when 4 then 'HTTP 500: {"why":1}' when 5 then 'no result returned for this request' end error from fx_requests""")
def _(t):
    out, err = result_lines(t)
    return ba.batch_results(t.requests.select("request_id"), out, err)


@query("s15_embedding_batch_results", """select request_id custom_id, case when n % 6 in (0, 1) then cast(n as double) end first, case n % 6 when 2 then 'HTTP 429: slow down'
       when 3 then 'expired: too late' when 4 then 'HTTP 500: {"why":1}' end error from fx_requests where n % 6 <> 5""")
def _(t):
    vectors, errors = ba.embedding_results(*result_lines(t))
    return (vectors.select("custom_id", F.col("embedding")[0].cast("double").alias("first"), F.lit(None).cast("string").alias("error"))
            .unionByName(errors.select("custom_id", F.lit(None).cast("double").alias("first"), "error")))


@query("s16_write_requests", "select conv_id || '-' || turn request_id, role as model, text, length(text) len from conversations union all select conv_id || '-' || turn || '+', role, text, length(text) from conversations where turn = 0")
def _(t):
    # requests as JSON lines, more of them appended, and all read back
    record = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.col("role").alias("model"), sa.messages(F.col("text")).alias("messages"), "turn")
    place = new_folder(t.spark, "requests")
    tb.write_records(record.drop("turn"), place)
    tb.write_records(record.where("turn = 0").withColumn("request_id", F.concat("request_id", F.lit("+"))).drop("turn"), place, append_mode=True)
    back = tb.read_records(t.spark, place, record.drop("turn").schema)
    text = F.col("messages")[0]["content"]
    return back.select("request_id", "model", text.alias("text"), F.length(text).cast("long").alias("len"))


@query("s16_write_responses", "select response_id, request_id, attempt, model, error, completion_tokens, received_at from fx_responses")
def _(t):
    rows = t.responses.select("response_id", "request_id", "attempt", "model", "error", "completion_tokens", "received_at")
    place = new_folder(t.spark, "responses")
    tb.write_records(rows, place)
    return tb.read_records(t.spark, place, rows.schema)


@query("s18_long_input_items", """select m, 'Outcome' as label, concat('value_', m % 6) as value from fx_inputs union all select m, 'Origin', '{"n":' || m || '}' from fx_inputs union all
       select m, 'question', 'why' from fx_inputs union all select m, 'weights', '[1,2]' from fx_inputs""")
def _(t):
    m = F.col("m").cast("string")
    payload = F.concat(F.lit('{"draw":{"Outcome":"value_'), (F.col("m") % 6).cast("string"), F.lit('","Origin":{"n":'), m, F.lit('}},"question":"why","weights":[1,2],"hidden":1}'))
    return tb.input_items(t.inputs.select("m", payload.alias("payload")), "m", "payload", ["draw", "question", "weights"])


# ---- streams: the same functions on the whole tables -------------------------------------------------


@query("st1_stream_validate", r"""select response_id, len(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 100 passed from fx_response_texts""")
def _(t):
    checks = {"non_empty": c.non_empty(F.col("text"), 100), "no_refusal": c.no_refusal(F.col("text"))}
    return live.validate(t.response_texts, checks).select("response_id", "passed")


@query("st2_stream_latest", "select request_id, max(attempt) attempt from fx_responses group by 1")
def _(t):
    return live.highest_attempts(t.responses.select("request_id", "attempt", "response_id")).select("request_id", "attempt")


@query("st3_stream_tokens", """select model, date_trunc('hour', received_at) window_start, count(*) n, cast(sum(prompt_tokens) as bigint) prompt_tokens, cast(sum(completion_tokens) as bigint) completion_tokens
       from fx_responses group by 1, 2""")
def _(t):
    return live.tokens_per_window(t.responses, "1 hour", keys=["model"]).drop("window_end")


@query("st3_sliding_tokens", """select window_start, count(*) n, cast(sum(prompt_tokens) as bigint) prompt_tokens, cast(sum(completion_tokens) as bigint) completion_tokens from (
       select *, date_trunc('hour', received_at) - to_hours(k) window_start from fx_responses, (select unnest([0, 1]) k)) group by 1""")
def _(t):
    return live.tokens_per_window(t.responses, "2 hours", "1 hour").drop("window_end")


@query("st4_stream_sessions", """select user_id, min(ts) session_start, max(ts) + interval 2 hours session_end, count(*) n from (
       select *, sum(fresh) over (partition by user_id order by ts, event_id) s from (
         select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 2 hours then 1 else 0 end fresh from events)) group by user_id, s""")
def _(t):
    return live.activity_sessions(t.events.select(F.col("ts").alias("received_at"), "user_id"), "user_id", "2 hours")
