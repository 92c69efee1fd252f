"""Relations between requests, attempts, texts and verdicts.

The final response of a request is its highest attempt.  All "latest" questions are aggregates
(combined before the shuffle), not windows over all attempts of a request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.values import lookup
from scoreloom.operators.skew import dense_index, top_per_group

TOKEN_COLUMNS = ("prompt_tokens", "completion_tokens", "total_tokens", "cached_tokens")


def latest(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """The row with the highest ``by`` for each key, NULLs of the other columns kept as they are."""
    return top_per_group(df, keys, [F.col(by).desc()], 1, "__rank").drop("__rank")


def final_responses(responses: DataFrame) -> DataFrame:
    return latest(responses, ["request_id"], "attempt")


def finished_requests(responses: DataFrame) -> DataFrame:
    return final_responses(responses).where("error is null").select("request_id")


def pending_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    return requests.join(finished_requests(responses), "request_id", "left_anti")


def attempt_offsets(new: DataFrame, recorded: DataFrame, order: str) -> DataFrame:
    """Number new responses of each request after the attempts already recorded.

    ``order`` (an integer, the position of a new attempt within its delivery of the request, from 0) is
    added to the recorded maximum: no sort over the attempts of a request is needed.
    """
    known = recorded.groupBy("request_id").agg(F.max("attempt").alias("__last"))
    attempt = (F.coalesce("__last", F.lit(0)) + F.col(order) + 1).cast("int")
    return (new.join(known, "request_id", "left").withColumn("attempt", attempt)
            .withColumn("response_id", F.concat("request_id", F.lit("-a"), F.col("attempt").cast("string"))).drop("__last"))


def needs_retry(responses: DataFrame, validations: DataFrame) -> DataFrame:
    """Answered and judged invalid: neither API errors nor verdicts that are missing."""
    failed = validations.where("passed = false").select("response_id")
    return responses.where("error is null").join(failed, "response_id", "left_semi")


def merge_retries(responses: DataFrame, validations: DataFrame) -> DataFrame:
    """Fold the attempts of each request: the last successful one is returned, the rest is history.

    When every attempt failed, the first stays the returned one.  ``n_failed_attempts`` and the error
    codes of the others are counters and sets, so a request with very many attempts stays cheap.
    """
    ok = F.col("error").isNull()
    returned = F.coalesce(F.max(F.when(ok, F.col("attempt"))), F.min("attempt"))
    per = responses.groupBy("request_id").agg(
        returned.alias("attempt"), F.count(F.lit(1)).cast("int").alias("attempts"),
        (F.count(F.lit(1)) - 1).cast("int").alias("n_failed_attempts"),
        F.count_if(~ok).cast("int").alias("n_api_errors"))
    kept = responses.select("request_id", "attempt", "response_id", "error", "model")
    return (per.join(kept, ["request_id", "attempt"])
            .join(validations.select("response_id", "passed"), "response_id", "left"))


def failed_attempt_history(responses: DataFrame) -> DataFrame:
    """The attempts that were not returned, one row each, oldest first by ``history_index``."""
    ok = F.col("error").isNull()
    kept = responses.groupBy("request_id").agg(
        F.coalesce(F.max(F.when(ok, F.col("attempt"))), F.min("attempt")).alias("__kept"))
    history = responses.join(kept, "request_id").where(F.col("attempt") != F.col("__kept")).drop("__kept")
    # numbers of attempts may have gaps
    return dense_index(history, ["request_id"], "attempt", "history_index").withColumn("history_index", F.col("history_index").cast("int"))


def usage_totals(responses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Token sums over every attempt; a column that older runs lack counts as 0."""
    sums = [(F.sum(F.coalesce(F.col(c), F.lit(0))) if c in responses.columns else F.sum(F.lit(0)))
            .cast("long").alias(c) for c in TOKEN_COLUMNS]
    return responses.groupBy(*keys).agg(*sums)


def usage_from_api(usage: Column) -> Column:
    """Usage struct of a provider answer (VARIANT), with the nested count of cached tokens."""
    def whole(path: str) -> Column:
        return F.coalesce(F.try_variant_get(usage, path, "int"), F.lit(0))
    return F.struct(whole("$.prompt_tokens").alias("prompt_tokens"), whole("$.completion_tokens").alias("completion_tokens"),
                    whole("$.total_tokens").alias("total_tokens"),
                    whole("$.prompt_tokens_details.cached_tokens").alias("cached_tokens"))


# How a final response ended, as the last two bits of a number whose rest is its attempt.
API_ERROR, VALID, INVALID, UNVALIDATED = range(4)


def _outcomes(requests: DataFrame, responses: DataFrame, validations: DataFrame) -> DataFrame:
    """One row per request with what became of it; ``outcome`` is NULL where nothing was attempted.

    The final attempt and its outcome are one whole number, so a plain maximum finds both: a hash
    aggregate, combined before the shuffle, instead of a window and a join back.
    """
    passed = F.col("passed")
    outcome = (F.when(F.col("error").isNotNull(), API_ERROR).when(passed, VALID).when(~passed, INVALID).otherwise(UNVALIDATED))
    judged = responses.join(validations.select("response_id", "passed"), "response_id", "left")
    per = judged.groupBy("request_id").agg(
        F.max(F.col("attempt").cast("long") * 4 + outcome).alias("__top"), F.count(F.lit(1)).alias("n_attempts"),
        F.max(F.when((F.col("attempt") == 1) & passed, 1)).alias("first_valid"),
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("prompt_tokens", "completion_tokens")])
    return (requests.join(per, "request_id", "left")
            .withColumns({"attempt": F.floor(F.col("__top") / 4), "outcome": F.col("__top") % 4}).drop("__top"))


def run_summary(requests: DataFrame, responses: DataFrame, validations: DataFrame,
                keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Counts over the final response of each request, tokens over every attempt (their cost)."""
    outcome = F.col("outcome")
    count = lambda test: F.count_if(test).cast("long")
    o = _outcomes(requests, responses, validations)
    return o.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_requests"), count(outcome != API_ERROR).alias("n_finished"),
        count(outcome == API_ERROR).alias("n_api_errors"), count(outcome.isNull()).alias("n_not_attempted"),
        count(outcome == VALID).alias("n_valid"), count(outcome == INVALID).alias("n_invalid"),
        count(outcome == UNVALIDATED).alias("n_unvalidated"),
        count((outcome != API_ERROR) & (F.col("attempt") > 1)).alias("n_regenerated"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_attempts", "prompt_tokens", "completion_tokens")])


def template_summary(requests: DataFrame, prompts: DataFrame, responses: DataFrame, validations: DataFrame) -> DataFrame:
    outcome = F.col("outcome")
    count = lambda test: F.count_if(test).cast("long")
    o = _outcomes(requests.select("request_id", "prompt_id"), responses, validations)
    return (o.join(prompts.select("prompt_id", "template"), "prompt_id").groupBy("template").agg(
        F.count(F.lit(1)).alias("n_requests"), count(outcome != API_ERROR).alias("n_finished"),
        count(outcome == VALID).alias("n_valid"), count(outcome == INVALID).alias("n_invalid"),
        F.count("first_valid").alias("n_valid_first_try")))


def run_status(summary: DataFrame) -> DataFrame:
    return summary.withColumn("status", F.when(F.col("n_finished") == F.col("n_requests"), "completed").otherwise("partial"))


def load_subjects(requests: DataFrame, prompts: DataFrame, responses: DataFrame, texts: DataFrame,
                  validations: DataFrame, templates: Sequence[str] = (), models: Sequence[str] = (),
                  valid_only: bool = False) -> DataFrame:
    """Final, error-free, non-empty outputs with what they were made from.

    ``valid_only`` drops outputs judged invalid and keeps those without a verdict.  The model is the
    one the response reports, else the one that was asked for.
    """
    if templates:
        prompts = prompts.where(F.col("template").isin(list(templates)))
    final = (final_responses(responses.select("request_id", "response_id", "attempt", "error", "model"))
             .where("error is null").withColumnRenamed("model", "__reported"))
    df = (final.join(requests.select("request_id", "run_id", "model", "prompt_id"), "request_id")
          .withColumn("model", F.coalesce("__reported", "model")).drop("__reported", "error"))
    if models:
        df = df.where(F.lower("model").isin([m.lower() for m in models]))
    df = (df.join(prompts.select("prompt_id", "template", "input_id"), "prompt_id")
          .join(texts.select("response_id", "text").where("text is not null and text <> ''"), "response_id")
          .join(validations.select("response_id", "passed"), "response_id", "left"))
    return df.where("coalesce(passed, true)") if valid_only else df


def rebuild_requests(requests: DataFrame, prompts: DataFrame, inputs: DataFrame) -> DataFrame:
    return (requests.join(prompts.select("prompt_id", "template", "input_id"), "prompt_id")
            .join(inputs.drop("run_id"), "input_id"))


def attempt_rows(responses: DataFrame, prior: Column | int = 0) -> DataFrame:
    """Response records with a ``failed_attempts`` array, one row per attempt with its id.

    Failed attempts come first, the returned one last; numbering continues after ``prior``.
    """
    start = F.lit(prior) if isinstance(prior, int) else prior
    fields = ["text", "model", "finish_reason", "error"]
    returned = F.struct(*[F.col(c) for c in fields])
    history = F.transform("failed_attempts", lambda a: F.struct(*[a[c].alias(c) for c in fields]))
    every = F.concat(F.coalesce(history, F.array().cast("array<struct<text:string,model:string,finish_reason:string,error:string>>")),
                     F.array(returned))
    return (responses.withColumn("__prior", start)
            .select("request_id", "__prior", F.posexplode(every).alias("__k", "__a"))
            .withColumn("attempt", (F.col("__prior") + F.col("__k") + 1).cast("int"))
            .select(F.concat("request_id", F.lit("-a"), F.col("attempt").cast("string")).alias("response_id"),
                    "request_id", "attempt", *[F.col(f"__a.{c}").alias(c) for c in fields],
                    F.length("__a.text").alias("n_chars")))


def reject_reasons(issues: DataFrame, rejected: DataFrame) -> DataFrame:
    """How often each error code led to a rejected attempt."""
    codes = issues.where("severity = 'error'").select("response_id", "code").distinct()
    return (codes.join(rejected.select("response_id"), "response_id", "left_semi").groupBy("code")
            .agg(F.count(F.lit(1)).alias("n_attempts")))


# What the statuses of a provider's batch jobs mean.
BATCH_STATUS = {
    "validating": "pending", "in_progress": "running", "finalizing": "running", "cancelling": "running",
    "completed": "completed", "failed": "failed", "expired": "expired", "cancelled": "cancelled",
}


def batch_status(history: DataFrame, order: str) -> DataFrame:
    """Latest record of each batch with its normalised status; one unknown to us is passed through."""
    return (latest(history, ["batch_id"], order)
            .withColumn("status", F.coalesce(lookup(BATCH_STATUS, F.col("raw_status")), F.col("raw_status")))
            .withColumn("done", F.col("status").isin("completed", "failed", "expired", "cancelled")))


def valid_rate_by_value(validations: DataFrame, responses: DataFrame, requests: DataFrame, prompts: DataFrame,
                        items: DataFrame, label: str) -> DataFrame:
    """Share of valid attempts per value of one label of the input."""
    judged = (validations.select("response_id", "passed")
              .join(responses.select("response_id", "request_id"), "response_id"))
    # attempts are reduced per request before the joins up to the inputs
    per = judged.groupBy("request_id").agg(F.count_if("passed").alias("ok"), F.count("passed").alias("judged"),
                                           F.count(F.lit(1)).alias("n"))
    return (per.join(requests.select("request_id", "prompt_id"), "request_id")
            .join(prompts.select("prompt_id", "input_id"), "prompt_id")
            .join(items.where(F.col("label") == label).select("input_id", "value"), "input_id")
            .groupBy("value").agg((F.sum("ok") / F.nullif(F.sum("judged"), F.lit(0))).alias("valid_rate"),
                                  F.sum("n").alias("n")))

def evaluation_facts(evaluations: DataFrame, item_scores: DataFrame, flags: DataFrame, requests: DataFrame, responses: DataFrame, runs: DataFrame,
                     texts: DataFrame, evaluation_runs: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """Every evaluation as one record, joined to the text it scored: what reports, dashboards and exports read.

    ``evaluations`` name the text they score (``subject_response_id``), the run that generated it (``subject_run_id``), what their own request told of it
    (``subject_model``, ``subject_type``, ``subject_template``, ``subject_input``; NULL where it told nothing), and their own response and run.  A text whose run or
    response is not at hand stays in, without text.  Values come from the first that has one: the task from the generating run, else the type of the subject;
    the model from the request, the generated response, the generating run; the evaluator from the evaluating response, the evaluation's run,
    else the provider's default.

    ``texts`` give ``response_id, text``; texts that many responses share may instead be ``bodies`` (``text_id, text``), which ``texts`` name as ``response_id, text_id``.

    Scores, justifications, labels and flags of an evaluation are collected together, in one shuffle on the evaluation: they are as many as its rubric has items.
    All that is looked up by another key is narrow and joined before them; texts come last, so that no copy of a text is shuffled.
    """
    key = "evaluation_id"
    said = lambda c, kind: F.col(c) if c in item_scores.columns else F.lit(None).cast(kind)
    item = F.struct("item_key", F.when(~F.col("is_na"), F.col("score")).alias("score"), said("justification", "string").alias("justification"), said("label", "string").alias("label"))
    quote = F.col("quote") if "quote" in flags.columns else F.lit(None).cast("string")
    severity = F.col("severity") if "severity" in flags.columns else F.lit(None).cast("string")
    flag = F.struct(F.col("flag_id").alias("id"), severity.alias("severity"), quote.alias("quote"))
    rows = (item_scores.select(key, item.alias("item")).unionByName(flags.select(key, flag.alias("flag")), allowMissingColumns=True)
            .groupBy(key).agg(F.array_sort(F.collect_list("item")).alias("__items"), F.array_sort(F.collect_list("flag")).alias("flags")))
    by_key = lambda field: F.map_from_entries(F.transform("__items", lambda i: F.struct(i["item_key"], i[field])))
    given = lambda field: F.map_filter(by_key(field), lambda k, v: v.isNotNull() & (v != ""))
    generated = responses.select(F.col("response_id").alias("subject_response_id"), F.col("model").alias("__reported"))
    source = runs.select(F.col("run_id").alias("subject_run_id"), F.col("task").alias("__task"), F.col("dataset").alias("subject_dataset"), F.col("model").alias("__run_model"))
    if bodies is None:
        body, by = texts.select(F.col("response_id").alias("subject_response_id"), F.col("text").alias("subject_text")), "subject_response_id"
    else:
        body, by = bodies.select(F.col("text_id").alias("__text_id"), F.col("text").alias("subject_text")), "__text_id"
        # a response whose body is not at hand is one without text, however often it is named
        named = texts.select(F.col("response_id").alias("subject_response_id"), F.col("text_id").alias("__text_id")).join(body.select("__text_id"), "__text_id", "left_semi")
    asked = requests.select(F.col("request_id"), F.col("run_id").alias("__asked_run")).join(
        evaluation_runs.select(F.col("run_id").alias("__asked_run"), F.col("model").alias("__asked_model"), "provider"), "__asked_run", "left").drop("__asked_run")
    answered = responses.select(F.col("response_id").alias("evaluation_response_id"), F.col("model").alias("__evaluator"))
    joined = (evaluations.join(source, "subject_run_id", "left").join(asked, "request_id", "left").join(answered, "evaluation_response_id", "left")
              .join(generated, "subject_response_id", "left"))
    if bodies is not None:
        joined = joined.join(named, "subject_response_id", "left")
    # merged in the order of the texts: records of one text lie together, and files that are written of them hold it about once
    joined = joined.join(rows, key, "left").join(body.hint("merge"), by, "left")
    empty = F.array().cast("array<struct<item_key:string,score:int,justification:string,label:string>>")
    joined = joined.withColumns({"__items": F.coalesce("__items", empty), "flags": F.coalesce("flags", F.array().cast("array<struct<id:string,severity:string,quote:string>>"))})
    own = [c for c in evaluations.columns if c not in ("subject_model", "subject_type")]
    return joined.select(
        *own, "subject_dataset", F.coalesce("__task", "subject_type").alias("task"), F.coalesce("subject_model", "__reported", "__run_model").alias("model"),
        F.coalesce("__evaluator", "__asked_model", F.concat(F.coalesce("provider", F.lit("unknown")), F.lit(" (default model)"))).alias("evaluator"),
        "subject_text", by_key("score").alias("scores"), given("justification").alias("justifications"), given("label").alias("labels"), "flags")
