"""Reading, checking and writing run tables.

A run is a folder ``run_*`` with one JSON-lines file per table; the columnar form is Parquet
partitioned by ``run_id``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.operators.runs import latest
from scoreloom.sources.schema import TABLES, Table


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema])


def _exists(spark: SparkSession, pattern: str) -> bool:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of all runs under ``root``; a table that no run has is empty.  Blank lines are skipped."""
    schema, pattern = nullable(TABLES[name].schema), f"{root}/run_*/{name}.jsonl"
    if not _exists(spark, pattern):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(pattern)


def parse_lines(lines: DataFrame, name: str, column: str = "value") -> DataFrame:
    """Rows of a table from JSON text, for sources that are not files."""
    schema = nullable(TABLES[name].schema)
    kept = lines.where(F.trim(F.col(column)) != "")
    return kept.select(F.from_json(F.col(column), schema).alias("__r")).select("__r.*")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Exactly the table's columns: unknown ones are an error, missing optional ones become NULL.

    A NULL in a required column fails when the row is written, inside the same pass.
    """
    table = TABLES[name]
    known = table.schema.fieldNames()
    unknown = [c for c in df.columns if c not in known]
    absent = [c for c in table.required if c not in df.columns]
    if unknown or absent:
        raise ValueError(f"{name}: unknown columns {unknown}, missing required columns {absent}")
    columns = []
    for f in table.schema:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if not f.nullable:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"{name}.{f.name} is required")).cast(f.dataType)).otherwise(c)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def required_nulls(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """How many rows lack each required column, in one pass."""
    counts = F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_missing")) for c in required])
    return df.agg(counts.alias("c")).select(F.inline("c"))


def append(df: DataFrame, path: str, name: str) -> None:
    if TABLES[name].kind == "mutable":
        raise ValueError(f"{name} is mutable: use upsert")
    rows = conform(df, name)
    writer = rows.write.mode("append")
    (writer.partitionBy("run_id") if "run_id" in rows.columns else writer).parquet(path)


def upsert(current: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert or replace by key: the new rows win."""
    both = current.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, "__new").drop("__new")


def write_version(df: DataFrame, root: str, version: int) -> None:
    """A new complete copy of a small mutable table beside the old ones; readers never see a half of it."""
    df.write.mode("error").parquet(f"{root}/version={version:08d}")


def upsert_table(spark: SparkSession, new: DataFrame, root: str, name: str) -> int:
    """Replace rows of a mutable table by key, as a new version; returns its number."""
    table = TABLES[name]
    if table.kind != "mutable":
        raise ValueError(f"{name} is {table.kind}: rows are appended, not replaced")
    version = last_version(spark, root)
    rows = conform(new, name)
    if version is not None:
        rows = upsert(read_version(spark, root, name, version), rows, table.key)
    write_version(rows, root, (version or 0) + 1)
    return (version or 0) + 1


def last_version(spark: SparkSession, root: str) -> int | None:
    """The highest version whose write was committed."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    numbers = [int(s.getPath().getParent().getName().split("=")[1]) for s in (found or [])]
    return max(numbers) if numbers else None


def read_version(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    version = last_version(spark, root) if version is None else version
    if version is None:
        return spark.createDataFrame([], nullable(TABLES[name].schema))
    return spark.read.parquet(f"{root}/version={version:08d}")


def dedupe_reference(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key of a table that repeats in every run: the least by content, so always the same."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*others)).alias("__r")).select(*keys, "__r.*")


def upgrade_runs(frames: Iterable[DataFrame]) -> DataFrame:
    """Runs written by any version in today's shape: ``application`` is ``task``, and its options too.

    ``config`` is JSON text here.
    """
    table = None
    for df in frames:
        table = df if table is None else table.unionByName(df, allowMissingColumns=True)
    if "application" in table.columns:
        task = F.coalesce("task", "application") if "task" in table.columns else F.col("application")
        table = table.withColumn("task", task).drop("application")
    if "config" in table.columns:
        members = F.from_json("config", "map<string,variant>")
        renamed = F.transform_keys(members, lambda k, _: F.when(k == "application_options", "task_options").otherwise(k))
        table = table.withColumn("config", F.when(F.map_contains_key(members, "application_options"), F.to_json(renamed)).otherwise(F.col("config")))
    return table


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Values of a reference that no parent row has.  Equal values collapse before the join."""
    return (child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            .join(parent.select(F.col(parent_key).alias(column)), column, "left_anti"))


def key_audit(frames: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows that repeat a key, and rows whose reference leads nowhere."""
    result = None
    for name, df in frames.items():
        table: Table = TABLES[name]
        rows = [duplicate_keys(df, table.key).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(
            F.lit(name).alias("table"), F.lit("duplicate " + ",".join(table.key)).alias("problem"), "n")]
        for column, parent in table.references:
            if parent in frames and column in df.columns:
                lost = orphans(df, column, frames[parent], TABLES[parent].key[0])
                rows.append(lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
                    F.lit(name).alias("table"), F.lit(f"{column} not in {parent}").alias("problem"), "n"))
        for r in rows:
            result = r if result is None else result.unionByName(r)
    return result


def list_runs(runs: DataFrame, dataset: str | None = None) -> DataFrame:
    kept = runs if dataset is None else runs.where(F.col("dataset") == dataset)
    return kept.orderBy("created_at", "run_id")


QA_SCHEMA = "id string, question string, best_answer string, correct_answers array<string>, incorrect_answers array<string>"
SPLITS = ("validation", "test", "train")


def read_qa(spark: SparkSession, root: str, schema: str = QA_SCHEMA) -> DataFrame:
    """A question set from JSON lines, preferring the validation, then the test, then the train split."""
    for split in SPLITS:
        if _exists(spark, f"{root}/{split}*.jsonl"):
            return spark.read.schema(schema).json(f"{root}/{split}*.jsonl")
    return spark.read.schema(schema).json(root)


def explode_answers(questions: DataFrame, key: str) -> DataFrame:
    """One row per question and answer, right ones and wrong ones; a question without any keeps one row."""
    tagged = lambda name, right: F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")),
                                             lambda a: F.struct(a.alias("answer"), F.lit(right).alias("correct")))
    every = F.concat(tagged("correct_answers", True), tagged("incorrect_answers", False))
    return questions.select(key, "question", F.explode_outer(every).alias("a")).select(key, "question", "a.answer", "a.correct")


def flatten(df: DataFrame) -> DataFrame:
    """Nested records as dotted columns; lists stay lists."""
    columns: list[Column] = []

    def walk(schema: T.StructType, path: str, quoted: str) -> None:
        for f in schema:
            here, ref = f"{path}{f.name}", f"{quoted}`{f.name}`"
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, here + ".", ref + ".")
            else:
                columns.append(F.col(ref).alias(here))
    walk(df.schema, "", "")
    return df.select(*columns)


def display_name(full: Column, first: Column, last: Column) -> Column:
    part = lambda c: F.when(c != "", c)
    return F.coalesce(part(full), part(F.concat_ws(" ", part(first), part(last))))


def persona_rows(personas: DataFrame, persona_set: str) -> DataFrame:
    """Rows of the personas table from nested records (id, persona_number, name{full,first,last}, ...)."""
    payload = F.to_json(F.struct(*[F.col(c) for c in sorted(personas.columns)]))
    return personas.select(F.col("id").alias("persona_id"), F.lit(persona_set).alias("persona_set"), "persona_number",
                           display_name(F.col("name.full"), F.col("name.first"), F.col("name.last")).alias("name"),
                           payload.alias("payload"), F.sha2(payload, 256).alias("content_sha256"))


def persona_audit(personas: DataFrame) -> DataFrame:
    """Ids must be present and different, numbers different where there are any."""
    empty = personas.where("id is null or id = ''").select(F.lit("empty id").alias("problem"), F.col("id").cast("string").alias("value"))
    ids = duplicate_keys(personas.where("id is not null and id <> ''").select("id"), ["id"]).select(F.lit("repeated id").alias("problem"), F.col("id").alias("value"))
    numbers = duplicate_keys(personas.where("persona_number is not null").select("persona_number"), ["persona_number"]).select(
        F.lit("repeated number").alias("problem"), F.col("persona_number").cast("string").alias("value"))
    return empty.unionByName(ids).unionByName(numbers)


def input_items(inputs: DataFrame, key: str, payload: str, entries: Sequence[str] | None = None) -> DataFrame:
    """Long rows of JSON payloads: a map entry gives a row per key, another entry one row.

    Values that are not text are written as JSON.
    """
    members = F.from_json(F.col(payload), "map<string,variant>")
    as_text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    outer = inputs.select(key, F.explode(F.map_entries(members)).alias("e")).select(key, "e.key", "e.value")
    if entries is not None:
        outer = outer.where(F.col("key").isin(list(entries)))
    inner = F.try_variant_get("value", "$", "map<string,variant>")
    single = F.create_map(F.col("key"), F.col("value"))
    return (outer.select(key, F.explode(F.coalesce(inner, single)).alias("label", "v")).select(key, "label", as_text(F.col("v")).alias("value")))


TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_records(df: DataFrame, path: str, append_mode: bool = False) -> None:
    """Requests or responses as JSON lines, times to the microsecond."""
    df.write.mode("append" if append_mode else "error").options(**TIMES).json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).options(**TIMES).json(path)


def export_evaluations(facts: DataFrame, path: str, kind: str = "parquet") -> None:
    """The joined evaluation table for reports."""
    facts.write.mode("error").format(kind).save(path)

