"""Run tables derived from the given tables.

Each table is written twice, on purpose and independently: as a DataFrame for the queries, and as SQL
for the engine that checks them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators.rubric import Item, Rubric, Section, Flag, Grade
from scoreloom.operators.skew import balanced, dense_index

RUBRIC = Rubric(
    name="table_rubric", version=1, scale=(1, 5), justify=(1, 5),
    sections=(
        Section("A", "s1", 30.0, (Item("1", "O"), Item("2", "S"))),
        Section("B", "s2", 30.0, (Item("3", "O"), Item("4", "S"))),
        Section("C", "s3", 40.0, (Item("5", "O"), Item("6", "S"), Item("7", "S", allow_na=True))),
    ),
    flags=(Flag("RF1", "severe", 40.0), Flag("RF5", "moderate", 60.0)),
    grades=(Grade("A", 80.0), Grade("B", 65.0), Grade("C", 50.0), Grade("D", 35.0), Grade("F", 0.0)),
)

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations")


def label_of(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


class Tables:
    """The given tables as attributes, and the run tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BASE:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def texts(self) -> DataFrame:
        """The documents, spread over the cores."""
        return balanced(self.documents)

    @cached_property
    def spread_orders(self) -> DataFrame:
        """The orders, for work that takes long for each: a task has 8 MB of them, about."""
        return balanced(self.orders, finer=16)

    @cached_property
    def personas(self) -> DataFrame:
        return (self.customer
                .join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
                .join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
                .select(label_of("per_", F.col("c_custkey")).alias("persona_id"), F.lit("driver").alias("persona_set"),
                        F.col("c_custkey").cast("int").alias("persona_number"), F.col("c_name").alias("name"),
                        F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"),
                        F.col("r_name").alias("region"), "c_acctbal"))

    @cached_property
    def responses(self) -> DataFrame:
        q = F.floor(F.col("event_id") / 3).cast("long")
        k = (F.col("event_id") % 3 + 1).cast("int")
        n_docs = self.documents.agg(F.max("doc_id") + 1)
        kind = F.col("event_type")
        return self.events.select(
            F.concat(label_of("req_", q), F.lit("-a"), k.cast("string")).alias("response_id"),
            label_of("req_", q).alias("request_id"), label_of("run_", q % 8).alias("run_id"), k.alias("attempt"),
            label_of("model_", q % 4).alias("model"), F.when(kind == "error", "provider down").alias("error"),
            F.when(kind == "error", F.lit(None).cast("string")).when(kind == "signup", "length").otherwise("stop")
             .alias("finish_reason"),
            F.floor("value").cast("int").alias("completion_tokens"), F.lit(10).alias("prompt_tokens"),
            F.col("ts").alias("received_at"), (F.col("event_id") % n_docs.scalar()).alias("doc_id"), q.alias("n"))

    @cached_property
    def requests(self) -> DataFrame:
        r = self.responses
        return (r.groupBy("n").agg(F.min("request_id").alias("request_id"), F.min("run_id").alias("run_id"),
                                   F.min("model").alias("model"))
                .select("request_id", "run_id", "model", label_of("prm_", F.col("n")).alias("prompt_id"), "n"))

    @cached_property
    def prompts(self) -> DataFrame:
        return self.requests.select(
            "prompt_id", "run_id", label_of("tpl_v", F.col("n") % 2 + 1).alias("template"),
            label_of("inp_", F.floor(F.col("n") / 2).cast("long")).alias("input_id"), "n")

    @cached_property
    def inputs(self) -> DataFrame:
        m = F.floor(F.col("n") / 2).cast("long")
        return (self.prompts.groupBy(m.alias("m")).agg(F.min("run_id").alias("run_id"))
                .select(label_of("inp_", F.col("m")).alias("input_id"), "run_id", "m"))

    @cached_property
    def input_items(self) -> DataFrame:
        return self.inputs.select("input_id", "run_id", F.lit("Outcome").alias("label"),
                                  label_of("value_", F.col("m") % 6).alias("value"))

    @cached_property
    def text_names(self) -> DataFrame:
        """The document that is the text of a response; several responses have the same one."""
        return self.responses.where("error is null").select("response_id", "run_id", "doc_id")

    @cached_property
    def response_texts(self) -> DataFrame:
        return (self.text_names
                .join(self.documents.select("doc_id", "text", "n_chars"), "doc_id")
                .select("response_id", "run_id", "text", "n_chars"))

    @cached_property
    def validations(self) -> DataFrame:
        return (self.responses.where("error is null").select("response_id", "run_id", "doc_id")
                .join(self.labels, "doc_id", "left")
                .select("response_id", "run_id", (F.col("quality") == 1).alias("passed"),
                        F.coalesce((F.col("quality") == 0).cast("int"), F.lit(0)).alias("n_errors"),
                        F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0)).alias("n_warnings")))

    @cached_property
    def runs(self) -> DataFrame:
        """One row per run: dataset by parity, task by thirds, seed shared by pairs of runs."""
        r = F.substring("run_id", 5, 20).cast("int")
        return (self.requests.groupBy("run_id").agg(F.min("n").alias("first"))
                .select("run_id", label_of("set_", r % 2).alias("dataset"), label_of("task_", r % 3).alias("task"),
                        label_of("model_", r % 4).alias("model"), (r % 4).alias("seed"),
                        F.when(r < 6, label_of("sha_", r % 4)).alias("instantiation_sha256"),
                        F.lit("live").alias("mode"), label_of("2024-01-0", r + 1).alias("created_at")))

    @cached_property
    def evaluations(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.orders.select(
            label_of("evl_", key).alias("evaluation_id"), key.alias("o_orderkey"),
            label_of("sub_", key % 2000).alias("subject_response_id"), label_of("per_", F.col("o_custkey")).alias("persona_id"),
            F.col("o_orderpriority").alias("evaluating_model"), F.col("o_orderstatus").alias("run_id"),
            label_of("tpl_v", key % 2000 % 2 + 1).alias("template"), label_of("model_", key % 2000 % 4).alias("generating_model"),
            label_of("set_", key % 2000 % 3).alias("readings_dataset"), F.col("o_orderdate").alias("evaluated_at"))

    @cached_property
    def item_scores(self) -> DataFrame:
        from pyspark.sql import Window
        line = ["l_orderkey", "l_linenumber"]
        # one line of one order: a handful of copies, never a hot group
        n = F.row_number().over(Window.partitionBy(*line).orderBy(
            "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_linestatus"))
        item = F.col("l_linenumber").cast("string")
        na = (item == "7") & (F.col("l_linestatus") == "F")
        return (self.lineitem.select(*line, "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_linestatus")
                .withColumn("n", n)
                .select(label_of("evl_", F.col("l_orderkey")).alias("evaluation_id"),
                        F.concat(item, F.lit("."), F.col("n").cast("string")).alias("item_key"), item.alias("item_id"),
                        RUBRIC.section_of_item(item).alias("section_key"), RUBRIC.type_of_item(item).alias("item_type"),
                        F.col("n").alias("label_index"),
                        F.when(~na, (1 + F.col("l_quantity").cast("int") % 5).cast("int")).alias("score"),
                        na.alias("is_na")))

    @cached_property
    def flags(self) -> DataFrame:
        flag = F.when(F.col("l_returnflag") == "R", "RF1").otherwise("RF5")
        return (self.lineitem.where("l_discount >= 0.095 and l_returnflag <> 'N'")
                .select(label_of("evl_", F.col("l_orderkey")).alias("evaluation_id"), flag.alias("flag_id"),
                        RUBRIC.cap_of_flag(flag).alias("cap"))
                .distinct())

    @cached_property
    def steps(self) -> DataFrame:
        """Vectors as sequences: one sequence per label, in vec_id order."""
        return (dense_index(self.embeddings, ["label"], "vec_id")
                .select(F.col("label").alias("seq_id"), "vec_id", "idx", "embedding"))

    @cached_property
    def states(self) -> DataFrame:
        v = F.col("vec_id")
        return self.embeddings.select(
            F.floor(v / 20).cast("long").alias("text_id"), (F.floor(v / 5) % 4).cast("long").alias("layer"),
            (v % 5).alias("pos"), F.col("embedding").alias("state"))


SQL_VIEWS = {
    "fx_personas": """
        select concat('per_', cast(c_custkey as string)) persona_id, 'driver' persona_set, cast(c_custkey as int) persona_number,
          c_name as name, c_mktsegment segment, n_name nation, r_name region, c_acctbal
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "fx_responses": """
        select concat('req_', cast(q as string), '-a', cast(k as string)) response_id, concat('req_', cast(q as string)) request_id,
          concat('run_', cast(q % 8 as string)) run_id, k attempt, concat('model_', cast(q % 4 as string)) model,
          case when event_type = 'error' then 'provider down' end error,
          case when event_type = 'error' then null when event_type = 'signup' then 'length' else 'stop' end finish_reason,
          cast(floor(value) as int) completion_tokens, cast(10 as int) prompt_tokens, ts received_at, doc_id, q n
        from (select *, cast(floor(event_id / 3.0) as bigint) q, cast(event_id % 3 + 1 as int) k,
                event_id % (select max(doc_id) + 1 from documents) doc_id from events) e""",
    "fx_requests": """
        select distinct request_id, run_id, model, concat('prm_', cast(n as string)) prompt_id, n from fx_responses""",
    "fx_prompts": """
        select prompt_id, run_id, concat('tpl_v', cast(n % 2 + 1 as string)) as template,
          concat('inp_', cast(n // 2 as string)) input_id, n from fx_requests""",
    "fx_inputs": """
        select concat('inp_', cast(n // 2 as string)) input_id, min(run_id) run_id, n // 2 m from fx_prompts group by n // 2""",
    "fx_input_items": """
        select input_id, run_id, 'Outcome' as label, concat('value_', cast(m % 6 as string)) as value from fx_inputs""",
    "fx_response_texts": """
        select response_id, run_id, text, n_chars from fx_responses r join documents d on r.doc_id = d.doc_id where error is null""",
    "fx_validations": """
        select response_id, run_id, case when quality is null then null else quality = 1 end passed,
          case when quality = 0 then 1 else 0 end n_errors, case when toxic = 1 then 1 else 0 end n_warnings
        from fx_responses r left join labels l on r.doc_id = l.doc_id where error is null""",
    "fx_runs": """
        select run_id, concat('set_', r % 2) dataset, concat('task_', r % 3) task, concat('model_', r % 4) model, r % 4 seed,
          case when r < 6 then concat('sha_', r % 4) end instantiation_sha256, 'live' as mode, concat('2024-01-0', r + 1) created_at
        from (select distinct run_id, cast(substr(run_id, 5) as int) r from fx_requests) x""",
    "fx_evaluations": """
        select concat('evl_', cast(o_orderkey as string)) evaluation_id, o_orderkey, concat('sub_', o_orderkey % 2000) subject_response_id,
          concat('per_', o_custkey) persona_id, o_orderpriority evaluating_model, o_orderstatus run_id,
          concat('tpl_v', o_orderkey % 2000 % 2 + 1) as template, concat('model_', o_orderkey % 2000 % 4) generating_model,
          concat('set_', o_orderkey % 2000 % 3) readings_dataset, o_orderdate evaluated_at from orders""",
    "fx_items": """
        select * from (values ('1','s1','O',cast(30 as double),false),('2','s1','S',cast(30 as double),false),
          ('3','s2','O',cast(30 as double),false),('4','s2','S',cast(30 as double),false),('5','s3','O',cast(40 as double),false),
          ('6','s3','S',cast(40 as double),false),('7','s3','S',cast(40 as double),true)) t(item_id, section_key, item_type, weight, allow_na)""",
    "fx_item_scores": """
        select concat('evl_', l_orderkey) evaluation_id, concat(i.item_id, '.', n) item_key, i.item_id, i.section_key, i.item_type,
          n label_index, case when allow_na and l_linestatus = 'F' then null else cast(1 + cast(l_quantity as int) % 5 as int) end score,
          (allow_na and l_linestatus = 'F') is_na
        from (select *, row_number() over (partition by l_orderkey, l_linenumber
                order by l_partkey, l_suppkey, l_extendedprice, l_quantity, l_linestatus) n from lineitem) l
        join fx_items i on i.item_id = cast(l_linenumber as string)""",
    "fx_flags": """
        select distinct concat('evl_', l_orderkey) evaluation_id, case when l_returnflag = 'R' then 'RF1' else 'RF5' end flag_id,
          case when l_returnflag = 'R' then cast(40 as double) else cast(60 as double) end cap
        from lineitem where l_discount >= 0.095 and l_returnflag <> 'N'""",
    "fx_steps": """
        select label seq_id, vec_id, row_number() over (partition by label order by vec_id) - 1 idx, embedding from embeddings""",
    "fx_states": """
        select cast(floor(vec_id / 20.0) as bigint) text_id, cast(floor(vec_id / 5.0) as bigint) % 4 layer, vec_id % 5 pos,
          embedding state from embeddings""",
    "fx_grades": """
        select * from (values ('A', cast(80 as double)), ('B', cast(65 as double)), ('C', cast(50 as double)),
          ('D', cast(35 as double)), ('F', cast(0 as double))) g(grade, lo)""",
}
