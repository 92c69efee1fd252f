"""Reading evaluators' JSON answers against a rubric.

All work happens inside the row of the answer: the rubric's items become a literal array, the answer
is a VARIANT, and defects collect in an array of problems.  No joins, no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.text import quote_in_text, strip
from scoreloom.functions.values import fence, strict_json, variant_kind
from scoreloom.operators.rubric import Output, Rubric

PROBLEM = "array<struct<code:string,severity:string,item:string,message:string>>"


def problem(code: Column | str, severity: str, item: Column | str | None, message: Column | str) -> Column:
    as_col = lambda v: F.lit(v) if v is None or isinstance(v, str) else v
    return F.struct(as_col(code).cast("string").alias("code"), F.lit(severity).alias("severity"),
                    as_col(item).cast("string").alias("item"), as_col(message).cast("string").alias("message"))


def no_problems() -> Column:
    return F.array().cast(PROBLEM)


def problem_if(test: Column, p: Column) -> Column:
    return F.when(test, F.array(p)).otherwise(no_problems())


def last_name_wins(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Reads JSON objects that repeat a name by the last of its values in the frame that ``build`` makes of another.

    Spark fixes how it reads such objects when it analyses a frame, so the session is as before afterwards.  A join of the result
    with itself analyses one side anew; for that, set ``spark.sql.variant.allowDuplicateKeys`` for the session.
    """
    @wraps(build)
    def inside(df: DataFrame, *args, **options) -> DataFrame:
        conf, name = df.sparkSession.conf, "spark.sql.variant.allowDuplicateKeys"
        before = conf.get(name)
        conf.set(name, "true")
        try:
            return build(df, *args, **options)
        finally:
            conf.set(name, before)
    return inside


@last_name_wins
def with_json(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the JSON value of a reply; of values of one name in an object the last counts."""
    return df.withColumn(name, extract_json(F.col(text)))


def extract_json(text: Column) -> Column:
    """The JSON value of a reply: the whole text, a fenced block, or the outermost braces; else NULL."""
    text = strip(text)
    fenced = strip(F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1))
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    # a failed parse is costly, so texts that cannot begin a JSON value are not tried
    may_start = r'^(?:[\[{"]|-?\d|true$|false$|null$)'
    return F.coalesce(*[F.when(c.rlike(may_start), strict_json(c)) for c in (text, fenced, braces)])


def json_texts(v: Column) -> Column:
    """The members of a VARIANT object as JSON text: strings keep their quotes, so kinds stay apart."""
    members = F.try_variant_get(v, "$", "map<string,variant>")
    return F.coalesce(F.transform_values(members, lambda k, x: F.coalesce(F.to_json(x), F.lit("null"))),
                      F.create_map().cast("map<string,string>"))


def unquoted(json_text: Column) -> Column:
    """Content of a JSON scalar: a string without its quotes, anything else as it stands."""
    # without a backslash a string's content is what stands between its quotes
    plain = F.substring(json_text, F.lit(2), F.length(json_text) - 2)
    content = F.when(json_text.contains("\\"), F.get_json_object(F.concat(F.lit('{"v":'), json_text, F.lit("}")), "$.v")).otherwise(plain)
    return F.when(json_text.startswith('"'), content).otherwise(json_text)


def elements(json_text: Column) -> Column:
    """The elements of a JSON array as JSON texts; NULL for anything else."""
    listed = F.try_variant_get(F.try_parse_json(F.when(json_text.startswith("["), json_text)), "$", "array<variant>")
    return F.transform(listed, lambda x: F.coalesce(F.to_json(x), F.lit("null")))


def _item_specs(rubric: Rubric, labels: Mapping[str, Column]) -> Column:
    return F.array(*[F.struct(
        F.lit(i.id).alias("item_id"), F.lit(bool(i.per)).alias("per"), F.lit(i.allow_na).alias("allow_na"),
        (labels[i.per] if i.per else F.lit(None)).cast("int").alias("n_labels")) for i in rubric.items])


def _keyed(e: Column) -> Column:
    """One raw value per score key: the item itself, or '<item>.<n>' per label."""
    def one(raw, key, n):
        return F.struct(e["item_id"].alias("item_id"), key.alias("item_key"), n.cast("int").alias("label_index"),
                        e["allow_na"].alias("allow_na"),
                        # a whole number in a string counts as that number
                        F.regexp_replace(raw, r'^"\s*(-?\d+)\s*"$', "$1").alias("raw"))
    listed = F.transform(e["listed"], lambda v, i: one(v, F.concat(e["item_id"], F.lit("."), (i + 1).cast("string")), i + 1))
    return F.when(e["per"], listed).otherwise(F.array(one(e["raw"], e["item_id"], F.lit(None))))


def _scored(s: Column, rubric: Rubric) -> Column:
    """The whole-number score, the N/A mark and the defect of one raw value."""
    lo, hi = rubric.scale
    is_na = s["raw"].rlike(r'(?i)^(?:null|"\s*\.*n\.*/?\.*a\.*\s*")$')
    number = s["raw"].try_cast("double")
    return F.struct(s["item_id"].alias("item_id"), s["item_key"].alias("item_key"), s["label_index"].alias("label_index"),
                    s["allow_na"].alias("allow_na"), is_na.alias("is_na"),
                    F.when(number == F.floor(number), number).alias("whole"))


def _judged(s: Column, rubric: Rubric) -> Column:
    lo, hi = rubric.scale
    code = (F.when(s["is_na"], F.when(~s["allow_na"], "na_not_allowed")).when(s["whole"].isNull(), "not_a_whole_number")
            .when(~s["whole"].between(lo, hi), "out_of_range"))
    return F.struct(s["item_id"].alias("item_id"), s["item_key"].alias("item_key"), s["label_index"].alias("label_index"),
                    rubric.section_of_item(s["item_id"]).alias("section_key"), rubric.type_of_item(s["item_id"]).alias("item_type"),
                    F.when(s["whole"].between(lo, hi), s["whole"].cast("int")).alias("score"), s["is_na"].alias("is_na"),
                    code.alias("code"))


def _output(spec: Output, raw: Column) -> Column:
    """struct<value, wrong> of one typed output; ``wrong`` is NULL when the value is usable."""
    absent = raw.isNull() | (raw == "null")
    text = strip(unquoted(raw))
    if spec.kind == "text":
        value = F.when(raw.startswith('"') & (text != ""), text)
        wrong = "must be non-empty text"
    elif spec.kind == "integer":
        lo, hi = spec.bounds
        number = F.regexp_replace(raw, r'^"\s*(\d+)\s*"$', "$1").try_cast("double")
        value = F.when((number == F.floor(number)) & number.between(lo, hi), number.cast("int"))
        wrong = f"must be a whole number {lo}-{hi}"
    elif spec.kind == "enum":
        value = F.replace(F.lower(text), F.lit(" "), F.lit("_"))
        value = F.when(value.isin(list(spec.choices)), value)
        wrong = "must be one of the choices"
    else:
        items = elements(raw)
        if spec.fields:
            shape = "struct<" + ",".join(f"`{f}`:string" for f in spec.fields) + ">"
            read = F.transform(F.from_json(F.when(raw.startswith("["), raw), f"array<{shape}>"), lambda x: F.struct(*[
                F.coalesce(strip(x[f]), F.lit("")).alias(f) for f in spec.fields]))
            read = F.when(F.forall(read, lambda x: F.array_min(F.array(*[F.length(x[f]) for f in spec.fields])) > 0), read)
            none = F.array().cast(f"array<{shape}>")
        else:
            read = F.filter(F.transform(items, lambda x: strip(unquoted(x))), lambda x: x != "")
            none = F.array().cast("array<string>")
        value = F.when(absent, none).otherwise(F.slice(read, 1, spec.max_items) if spec.max_items else read)
        return F.struct(value.alias("value"), F.lit("must be a list with its fields").alias("wrong"))
    return F.struct(value.alias("value"), F.when(absent, "missing").otherwise(wrong).alias("wrong"))


def is_item_reference(text: Column, rubric: Rubric) -> Column:
    """Starts with an item id that is not part of a longer word."""
    ids = sorted((i.id for i in rubric.items), key=len, reverse=True)
    pattern = "^(?:" + "|".join(r"\Q" + i + r"\E" for i in ids) + r")(?![\p{L}\p{N}])"
    return F.trim(text).rlike(pattern)


@last_name_wins
def read_answers(df: DataFrame, rubric: Rubric, text: str, labels: Mapping[str, Column] | None = None,
                 na_required: Mapping[str, Column] | None = None, quoted_text: Column | None = None) -> DataFrame:
    """Adds ``scores``, ``justifications``, ``red_flags``, ``outputs``, ``problems`` and ``usable``.

    ``labels`` gives the number of labels per label list; ``na_required`` maps an item to a boolean
    column saying whether the facts demand N/A (NULL: undecided); ``quoted_text`` is what red-flag
    quotes must come from.  An answer is usable when it has no problem of severity 'error'.
    """
    labels, na_required = labels or {}, na_required or {}
    a = F.col("__answer")
    df = df.withColumn("__answer", extract_json(F.col(text)))
    # members are taken from the parsed value, so the answer is not written as text again to look at its members
    part = lambda name: F.try_variant_get(a, f"$.{name}", "variant")
    is_object = lambda name: F.try_variant_get(a, f"$.{name}", "map<string,variant>").isNotNull()
    df = df.withColumn("__shape", F.when(a.isNull() | F.is_variant_null(a), "invalid_json").when(~is_object("item_scores"), "bad_structure"))
    read = F.col("__shape").isNull()
    inside = lambda name: json_texts(part(name))

    # every raw value once, as JSON text
    df = df.withColumns({"__items": F.when(read, inside("item_scores")), "__why": F.when(read, inside("justifications")),
                         "__out": F.when(read, inside("outputs")), "__red": F.when(read, F.to_json(part("red_flags"))), "__told": is_object("outputs")})
    df = df.withColumn("__entries", F.transform(_item_specs(rubric, labels), lambda e: F.struct(
        e["item_id"].alias("item_id"), e["per"].alias("per"), e["allow_na"].alias("allow_na"), e["n_labels"].alias("n_labels"),
        F.try_element_at("__items", e["item_id"]).alias("raw"),
        F.when(e["per"], elements(F.try_element_at("__items", e["item_id"]))).alias("listed"))))
    fits = lambda e: e["raw"].isNotNull() & (~e["per"] | F.coalesce(F.size(e["listed"]) == e["n_labels"], F.lit(False)))
    keyed = F.flatten(F.transform(F.filter("__entries", fits), _keyed))
    judged = F.transform(F.transform(keyed, lambda s: _scored(s, rubric)), lambda s: _judged(s, rubric))
    known = [f.id for f in rubric.flags]
    # each entry by itself: one that is no object is an unknown flag, and takes no other with it
    flags = F.transform(elements(F.col("__red")), lambda x: F.coalesce(
        F.from_json(F.when(x.startswith("{"), x), "struct<id:string,quote:string>"),
        F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("quote"))))
    df = df.withColumns({
        "__read": judged,
        "justifications": F.transform_values(F.map_filter("__why", lambda k, v: v.rlike(r'(?U)^(?:-?\d|"\s*[^\s"])')),
                                             lambda k, v: strip(unquoted(v))),
        "__flags": F.coalesce(F.transform(flags, lambda f: F.struct(
            f["id"].alias("flag_id"), F.coalesce(f["id"].isin(known), F.lit(False)).alias("known"),
            F.coalesce(strip(f["quote"]), F.lit("")).alias("quote"))),
            F.array().cast("array<struct<flag_id:string,known:boolean,quote:string>>")),
        **{f"__o_{spec.name}": _output(spec, F.try_element_at("__out", F.lit(spec.name))) for spec in rubric.outputs}})
    df = df.withColumn("__good", F.filter("__flags", lambda f: f["known"] & (f["quote"] != "")))
    if rubric.outputs:
        df = df.withColumn("outputs", F.when(read, F.struct(*[F.col(f"__o_{o.name}.value").alias(o.name) for o in rubric.outputs])))
    df = df.withColumns({
        "scores": F.transform(F.filter("__read", lambda s: s["code"].isNull()), lambda s: F.struct(*[
            s[c].alias(c) for c in ("item_id", "item_key", "label_index", "section_key", "item_type", "score", "is_na")])),
        # the first mention of each flag counts
        "red_flags": F.transform(F.filter("__good", lambda f, i: ~F.exists(
            F.slice(F.col("__good"), F.lit(1), i), lambda earlier: earlier["flag_id"] == f["flag_id"])),
            lambda f: F.struct(f["flag_id"].alias("flag_id"), f["quote"].alias("quote")))})

    # problems, in the order a reader meets them
    missing = F.transform(F.filter("__entries", lambda e: e["raw"].isNull()),
                          lambda e: problem("missing_item", "error", e["item_id"], "was not scored"))
    lengths = F.transform(F.filter("__entries", lambda e: e["raw"].isNotNull() & ~fits(e)),
                          lambda e: problem("wrong_length", "error", e["item_id"], "needs one score per label"))
    values = F.transform(F.filter("__read", lambda s: s["code"].isNotNull()),
                         lambda s: problem(s["code"], "error", s["item_key"], "unusable score"))
    na = []
    for item_id, fact in na_required.items():
        # N/A only where the facts say so, for items scored once
        na.append(F.transform(F.filter("scores", lambda s: (s["item_key"] == item_id) & (fact != s["is_na"])), lambda s: F.when(
            s["is_na"], problem("na_not_applicable", "error", item_id, "must be scored")).otherwise(
            problem("na_expected", "warning", item_id, "should be N/A"))))
    unknown = F.transform(F.array_sort(F.array_except(F.map_keys("__items"), F.array(*[F.lit(i.id) for i in rubric.items]))),
                          lambda k: problem("unknown_item", "warning", k, "unknown item"))
    why = F.map_keys("justifications")
    unjustified = F.transform(
        F.filter("scores", lambda s: s["score"].isin(list(rubric.justify)) & ~F.array_contains(why, s["item_key"])
                 & ~F.array_contains(why, s["item_id"])),
        lambda s: problem("missing_justification", "warning", s["item_key"], "score without a justification"))
    bad_list = problem_if(F.coalesce(~F.col("__red").rlike(r'^(?:\[|null$|false$|0(?:\.0+)?$|""$|\{\}$)'), F.lit(False)),
                          problem("bad_red_flags", "error", None, "must be a list"))
    bad_flags = F.transform(F.filter("__flags", lambda f: ~f["known"] | (f["quote"] == "")), lambda f: F.when(
        f["known"], problem("red_flag_without_quote", "error", f["flag_id"], "has no quoted passage")).otherwise(
        problem("unknown_red_flag", "error", None, f["flag_id"])))
    parts = [missing, lengths, values, *na, unknown, unjustified, bad_list, bad_flags]
    parts.append(problem_if(~F.col("__told"), problem("missing_outputs", "error", None, "outputs are missing")))
    for spec in rubric.outputs:
        o = F.col(f"__o_{spec.name}")
        parts.append(problem_if(o["value"].isNull(), problem("bad_output", "error", spec.name, o["wrong"])))
        if spec.kind == "list" and "item" in spec.fields:
            parts.append(F.transform(F.filter(o["value"], lambda x: ~is_item_reference(x["item"], rubric)), lambda x: problem(
                "unknown_item_reference", "warning", spec.name, F.concat(F.lit("refers to "), x["item"]))))
    if quoted_text is not None:
        parts.append(F.transform(F.filter("red_flags", lambda f: quoted_text.isNotNull() & ~quote_in_text(f["quote"], quoted_text)),
                                 lambda f: problem("quote_not_in_text", "error", f["flag_id"], f["quote"])))
    every = F.concat(*[F.coalesce(p, no_problems()) for p in parts])
    df = df.withColumn("problems", F.when(read, every).otherwise(
        F.array(problem(F.col("__shape"), "error", None, "the reply is not a usable JSON object"))))
    df = df.withColumn("usable", ~F.exists("problems", lambda p: p["severity"] == "error"))
    made = ["scores", "justifications", "red_flags", "problems", "usable"] + (["outputs"] if rubric.outputs else [])
    kept = [c for c in df.columns if not c.startswith("__")]
    return fence(df.select(*kept), made)


def score_rows(answers: DataFrame, key: str) -> DataFrame:
    """Long item rows of the usable answers."""
    return (answers.where("usable").select(key, "justifications", F.explode("scores").alias("s"))
            .select(key, "s.item_key", "s.item_id", "s.section_key", "s.item_type", "s.label_index", "s.score", "s.is_na",
                    F.coalesce(F.try_element_at("justifications", F.col("s.item_key")),
                               F.try_element_at("justifications", F.col("s.item_id"))).alias("justification")))


def flag_rows(answers: DataFrame, key: str, rubric: Rubric) -> DataFrame:
    return (answers.where("usable").select(key, F.explode("red_flags").alias("f"))
            .select(key, "f.flag_id", "f.quote", rubric.severity_of_flag(F.col("f.flag_id")).alias("severity"),
                    rubric.cap_of_flag(F.col("f.flag_id")).alias("cap")))


def problem_rows(answers: DataFrame, key: str) -> DataFrame:
    return answers.select(key, F.posexplode("problems").alias("issue_index", "p")).select(key, "issue_index", "p.*")


def evaluation_columns(answers: DataFrame, rubric: Rubric) -> DataFrame:
    """Totals computed inside the answer's own row: the usable answers with scores, cap and grade."""
    from scoreloom.functions.values import round_binary
    from scoreloom.operators.rubric import weighted_total
    df = answers.where("usable")
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("n"))
    add = lambda acc, x: F.struct((acc["total"] + x["score"]).alias("total"), (acc["n"] + 1).alias("n"))
    mine = lambda key: F.filter("scores", lambda x: (x["section_key"] == key) & x["score"].isNotNull())
    df = df.withColumns({s.key: F.aggregate(mine(s.key), start, add, lambda acc: F.when(acc["n"] > 0, acc["total"] / acc["n"])) for s in rubric.sections})
    cap = F.array_min(F.transform("red_flags", lambda f: rubric.cap_of_flag(f["flag_id"])))
    df = df.withColumn("__raw", weighted_total(rubric)).withColumn("__cap", cap)
    raw = F.col("__raw")
    return (df.withColumn("score_before_caps", round_binary(raw, 2))
            .withColumn("cap_applied", F.when(raw > F.col("__cap"), F.col("__cap")))
            .withColumn("total_score", round_binary(F.least(raw, F.coalesce("__cap", raw)), 1))
            .withColumn("grade", rubric.grade_of(F.col("total_score")))
            .withColumn("n_red_flags", F.size("red_flags")).drop("__raw", "__cap"))


FIELD_KINDS = ("text", "list")


@last_name_wins
def read_fields(df: DataFrame, text: str, spec: Mapping[str, str | list[str]]) -> DataFrame:
    """Adds one column per field of a JSON answer and ``problems``.

    A field is 'text' (non-empty), 'list' (of strings, NULL counts as empty), or a list of allowed
    values, compared in lower case with underscores.
    """
    a = F.col("__answer")
    df = df.withColumn("__answer", extract_json(F.col(text))).withColumn("__members", json_texts(a))
    is_object = F.coalesce(variant_kind(a) == "OBJECT", F.lit(False))
    columns = {}
    for name, kind in spec.items():
        raw = F.try_element_at("__members", F.lit(name))
        if isinstance(kind, list):
            value = F.replace(F.lower(strip(unquoted(raw))), F.lit(" "), F.lit("_"))
            value = F.when(value.isin(kind), value)
        elif kind == "list":
            items = F.filter(F.transform(elements(raw), lambda x: strip(unquoted(x))), lambda x: x != "")
            value = F.when(raw.isNull() | (raw == "null"), F.array().cast("array<string>")).otherwise(items)
        else:
            value = strip(unquoted(raw))
            value = F.when(raw.startswith('"') & (value != ""), value)
        columns[name] = F.when(is_object, value)
    df = df.withColumns(columns)
    problems = [problem_if(F.col(name).isNull(), problem("bad_field", "error", name, "not usable")) for name in spec]
    df = df.withColumn("problems", F.when(is_object, F.concat(*problems)).otherwise(
        F.array(problem("invalid_json", "error", None, "the reply is not a JSON object"))))
    return fence(df.withColumn("usable", F.size("problems") == 0).drop("__answer", "__members"), [*spec, "problems", "usable"])
