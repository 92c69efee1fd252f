"""Batch files for providers, and what comes back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.skew import dense_index
from scoreloom.sources.tables import duplicate_keys

# The providers' rules.
MAX_LINES = 50_000
MAX_BYTES = 200 * 1024 * 1024
CHAT_PATH, EMBEDDING_PATH = "/v1/chat/completions", "/v1/embeddings"

RESULT = ("struct<custom_id:string,response:struct<status_code:int,body:string>,"
          "error:struct<code:string,message:string>>")


def file_starts(chunk: pd.DataFrame, max_bytes: int) -> list[int]:
    """Line numbers at which the files of some lines in order begin: as many lines in each as fit."""
    through = chunk["__size"].cumsum().to_numpy()
    starts, row, spent = [], 0, 0
    while row < len(chunk):
        starts.append(int(chunk["__line"].iloc[row]))
        row = int(np.searchsorted(through, spent + max_bytes, side="right"))
        spent = int(through[row - 1])
    return starts


def number_files(lines: DataFrame, order: str, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds ``file_no`` to lines of text in ``value``: one model per file, in integer ``order``.

    A file ends after ``max_lines`` lines, and before the line that would take it over ``max_bytes`` (UTF-8, with line ends).  Only
    sizes of at most ``max_lines`` lines meet in a task.  A line that is over ``max_bytes`` by itself ends the job.
    """
    size = F.octet_length("value") + 1
    allowed = F.when(size <= max_bytes, size).otherwise(F.raise_error(F.lit(f"a line of a batch file is over {max_bytes} bytes")).cast("int"))
    at = (dense_index(lines.withColumn("__size", allowed.cast("long")), ["model"], order, "__line", block=max_lines)
          .withColumn("__chunk", F.floor(F.col("__line") / max_lines).cast("long")))
    kind = dict(lines.dtypes)["model"]
    starts = at.select("model", "__chunk", "__line", "__size").groupBy("model", "__chunk").applyInPandas(
        lambda chunk: pd.DataFrame({"model": [chunk["model"].iloc[0]], "__chunk": [chunk["__chunk"].iloc[0]],
                                    "__starts": [file_starts(chunk.sort_values("__line"), max_bytes)]}),
        f"model {kind}, __chunk long, __starts array<long>")
    # one row per max_lines lines from here on
    earlier = Window.partitionBy("model").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("__first", F.coalesce(F.sum(F.size("__starts")).over(earlier), F.lit(0)))
    inside = F.size(F.filter("__starts", lambda start: start <= F.col("__line"))) - 1
    return (at.join(starts, ["model", "__chunk"]).withColumn("file_no", (F.col("__first") + inside).cast("long"))
            .drop("__chunk", "__line", "__size", "__starts", "__first"))


def _lines(df: DataFrame, order: str, custom_id: Column, path: str, body: Column, max_lines: int, max_bytes: int) -> DataFrame:
    line = F.to_json(F.struct(custom_id.cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit(path).alias("url"), body.alias("body")))
    lines = df.select("model", F.col(order).alias("__order"), line.alias("value"))
    return number_files(lines, "__order", max_lines, max_bytes).select("model", "file_no", "value")


def batch_lines(requests: DataFrame, order: str, messages: Column, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(model, file_no, value): the lines of chat batch files."""
    body = F.struct(F.col("model").alias("model"), messages.alias("messages"))
    return _lines(requests, order, F.col("request_id"), CHAT_PATH, body, max_lines, max_bytes)


def embedding_lines(texts: DataFrame, order: str, key: str, text: str, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(model, file_no, value): the lines of embedding batch files."""
    body = F.struct(F.col("model").alias("model"), F.col(text).alias("input"))
    return _lines(texts, order, F.col(key), EMBEDDING_PATH, body, max_lines, max_bytes)


def repeated_ids(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """Ids that would collide; a batch with any is refused."""
    return duplicate_keys(requests.select(key), [key])


def write_batches(lines: DataFrame, path: str) -> None:
    """One folder per model and file number; a file's lines are written by one task.

    Ids repeated anywhere in the lines are refused before anything is written: results come back by id alone.
    """
    wrong = repeated_ids(lines.select(F.get_json_object("value", "$.custom_id").alias("request_id")).where("request_id is not null"))
    shown = [r[0] for r in wrong.orderBy("request_id").limit(3).collect()]
    if shown:
        raise ValueError(f"ids of a batch must differ; repeated: {shown}")
    (lines.repartition("model", "file_no").write.partitionBy("model", "file_no").mode("error").text(path))


def read_results(lines: DataFrame) -> DataFrame:
    """(custom_id, body, error) from output and error lines, given as text in ``value``."""
    r = F.col("r")
    failed = F.coalesce(F.get_json_object(r["response"]["body"], "$.error.message"), r["response"]["body"], F.lit("{}"))
    status = F.coalesce(r["response"]["status_code"].cast("string"), F.lit("None"))
    part = lambda c: F.coalesce(c, F.lit("None"))
    error = (F.when(r["error"].isNotNull(), F.concat(part(r["error"]["code"]), F.lit(": "), part(r["error"]["message"])))
             .when(F.coalesce(r["response"]["status_code"] == 200, F.lit(False)), F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("HTTP "), status, F.lit(": "), failed)))
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", RESULT).alias("r"))
    return parsed.select(r["custom_id"].alias("custom_id"), error.alias("error"), F.when(error.isNull(), r["response"]["body"]).alias("body"))


def batch_results(requests: DataFrame, output: DataFrame, errors: DataFrame) -> DataFrame:
    """Every request with its reply or with what went wrong."""
    results = read_results(output.select("value").unionByName(errors.select("value")))
    message = "$.choices[0].message.content"
    joined = requests.join(results, requests["request_id"] == results["custom_id"], "left")
    return joined.select("request_id", F.get_json_object("body", message).alias("text"),
                         F.get_json_object("body", "$.choices[0].finish_reason").alias("finish_reason"),
                         F.when(F.col("custom_id").isNull(), "no result returned for this request").otherwise(F.col("error")).alias("error"))


def embedding_results(output: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, errors) of an embedding batch."""
    results = read_results(output.select("value").unionByName(errors.select("value")))
    vector = F.from_json("body", "struct<data:array<struct<embedding:array<float>>>>")["data"][0]["embedding"]
    return (results.where("error is null").select("custom_id", vector.alias("embedding")), results.where("error is not null").select("custom_id", "error"))
