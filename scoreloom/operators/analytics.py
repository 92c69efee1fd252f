"""Tables about scored evaluations.

Input is one row per evaluation: its dimensions, one column per section, total, cap and grade.
Questions about items use the long item table.  Everything is an aggregate; groups are ranked with
a group limit, never collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.draws import draw_text
from scoreloom.functions.text import fold
from scoreloom.operators.rubric import Output, Rubric
from scoreloom.operators.skew import top_per_group

DIMENSIONS = ("template", "generating_model", "evaluating_model", "persona_id", "run_id", "readings_dataset")


def select_evaluations(facts: DataFrame, filters: Mapping[str, Sequence[str]], personas: DataFrame | None = None,
                       task: str | None = None) -> DataFrame:
    """Evaluations that match every filter; several values of one filter are alternatives.

    A persona may be named by id, number or name, in any case.
    """
    unknown = sorted(set(filters) - set(DIMENSIONS))
    if unknown:
        raise ValueError(f"unknown dimensions {unknown}; choose from {list(DIMENSIONS)}")
    if task is not None:
        facts = facts.where(F.col("task") == task)
    for dimension, wanted in filters.items():
        if not wanted:
            continue
        if dimension == "persona_id" and personas is not None:
            exact, folded = [str(w) for w in wanted], [str(w).lower().replace("ß", "ss") for w in wanted]
            named = F.col("persona_id").isin(exact) | F.col("persona_number").cast("string").isin(exact) | fold(F.col("name")).isin(folded)
            facts = facts.join(personas.where(named).select("persona_id"), "persona_id", "left_semi")
        else:
            facts = facts.where(F.col(dimension).cast("string").isin([str(w) for w in wanted]))
    return facts


def _by_dimension(facts: DataFrame, dimensions: Sequence[str], keep: Sequence[str]) -> DataFrame:
    values = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return facts.select(*keep, F.explode(values).alias("d")).select(*keep, "d.dimension", "d.value")


def scope(facts: DataFrame, dimensions: Sequence[str] = DIMENSIONS, k: int = 8) -> DataFrame:
    """The most frequent values of every dimension, and how many different values it has."""
    counts = _by_dimension(facts, dimensions, []).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    distinct = counts.groupBy("dimension").agg(F.count(F.lit(1)).alias("n_values"))
    return top_per_group(counts, ["dimension"], [F.desc("n"), F.asc("value")], k).join(distinct, "dimension")


def total_aggregates(rubric: Rubric) -> list[Column]:
    """Mean, median, spread and grade counts of the totals in a group."""
    total = F.col("total_score")
    return [F.count(F.lit(1)).alias("n"), F.avg(total).alias("mean"),
            # totals have one decimal, so a group has at most 1001 distinct values to hold
            F.percentile(total, F.lit(0.5)).alias("median"), F.stddev_samp(total).alias("sd"),
            F.min(total).alias("low"), F.max(total).alias("high"),
            *[F.count_if(F.col("grade") == g.name).alias(f"grade_{g.name}") for g in rubric.grades],
            F.count_if(F.col("n_red_flags") > 0).alias("n_flagged"),
            (F.count_if(F.col("n_red_flags") > 0) * 100.0 / F.count(F.lit(1))).alias("flagged_percent"),
            F.count("cap_applied").alias("n_capped")]


def overall(facts: DataFrame, rubric: Rubric, by: Sequence[str] = ()) -> DataFrame:
    """Totals over everything, or one row per value of the given dimensions."""
    return facts.groupBy(*by).agg(*total_aggregates(rubric))


def section_stats(facts: DataFrame, rubric: Rubric, by: Sequence[str] = ()) -> DataFrame:
    """Mean and spread per section, over the evaluations that have it."""
    sections = F.array(*[F.struct(F.lit(s.key).alias("section_key"), F.lit(s.weight).alias("weight"),
                                  F.col(s.key).alias("average")) for s in rubric.sections])
    return (facts.select(*by, F.explode(sections).alias("s")).groupBy(*by, "s.section_key", "s.weight")
            .agg(F.count("s.average").alias("n"), F.avg("s.average").alias("mean"), F.stddev_samp("s.average").alias("sd")))


def question_stats(items: DataFrame, rubric: Rubric) -> DataFrame:
    """Per item: mean, spread, how often each point of the scale was given, and N/A."""
    lo, hi = rubric.scale
    return items.groupBy("item_id", "item_type").agg(
        F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"),
        *[F.count_if(F.col("score") == p).alias(f"scored_{p}") for p in range(lo, hi + 1)],
        F.count_if("is_na").alias("n_na"))


def per_label_means(items: DataFrame) -> DataFrame:
    return (items.where("label_index is not null and score is not null").groupBy("item_id", "label_index")
            .agg(F.count("score").alias("n"), F.avg("score").alias("mean")))


def ratings(facts: DataFrame, outputs: Sequence[Output]) -> DataFrame:
    """Long table of the evaluators' own ratings: statistics of integers, counts of choices (also zero)."""
    rows = []
    for o in outputs:
        v = F.col(o.name)
        if o.kind == "integer":
            rows.append((o.name, "", F.count(v), F.avg(v), F.stddev_samp(v)))
        elif o.kind == "enum":
            rows += [(o.name, c, F.count_if(v == c), F.lit(None).cast("double"), F.lit(None).cast("double")) for c in o.choices]
    table = F.array(*[F.struct(F.lit(name).alias("output"), F.lit(choice).alias("choice"), n.alias("n"), mean.alias("mean"),
                               sd.alias("sd")) for name, choice, n, mean, sd in rows])
    return facts.agg(table.alias("t")).select(F.inline("t"))


def flags_fired(flags: DataFrame, rubric: Rubric) -> DataFrame:
    return (flags.groupBy("flag_id").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("severity", rubric.severity_of_flag(F.col("flag_id"))).withColumn("cap", rubric.cap_of_flag(F.col("flag_id")))
            .orderBy(F.desc("n"), "flag_id"))


def breakdown(facts: DataFrame, rubric: Rubric, dimensions: Sequence[str], k: int = 15) -> DataFrame:
    """The largest groups of every dimension: evaluations, texts, totals and section means."""
    keep = ["subject_response_id", "total_score", *[s.key for s in rubric.sections]]
    groups = _by_dimension(facts, dimensions, keep).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("subject_response_id").alias("n_texts"),
        F.avg("total_score").alias("mean"), F.stddev_samp("total_score").alias("sd"),
        *[F.avg(s.key).alias(s.key) for s in rubric.sections])
    return top_per_group(groups, ["dimension"], [F.desc("n"), F.asc("value")], k)


def score_report(facts: DataFrame, rubric: Rubric, outputs: Sequence[Output] = ()) -> DataFrame:
    """One row: totals, grade counts, section averages, flags and integer ratings."""
    return facts.agg(*total_aggregates(rubric), *[F.avg(s.key).alias(f"avg_{s.key}") for s in rubric.sections],
                     *[F.avg(o.name).alias(f"avg_{o.name}") for o in outputs if o.kind == "integer"])


COMMENT = ("evaluation_id", "question", "score", "text", "source")


def comments(items: DataFrame, facts: DataFrame, list_entries: DataFrame, flags: DataFrame, rubric: Rubric,
             text_outputs: Sequence[str] = ()) -> DataFrame:
    """All comments in one long table: on scores, on items, on the whole, and quotes behind flags.

    ``list_entries`` holds (evaluation_id, output, item, text); an entry that names an item belongs to
    that question, one that does not to the output it came from.
    """
    one_line = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    rows = [items.where("justification is not null").select(
        "evaluation_id", F.col("item_id").alias("question"), F.col("score").cast("string").alias("score"),
        one_line(F.col("justification")).alias("text"), F.lit("justification").alias("source"))]
    rows += [facts.where(F.col(o).isNotNull()).select("evaluation_id", F.lit(o).alias("question"), F.col("grade").alias("score"),
                                                      one_line(F.col(o)).alias("text"), F.lit("output").alias("source"))
             for o in text_outputs]
    rows.append(list_entries.select("evaluation_id", F.coalesce(rubric.item_reference(F.col("item")), F.col("output")).alias("question"),
                                    F.lit(None).cast("string").alias("score"), one_line(F.col("text")).alias("text"),
                                    F.lit("list").alias("source")))
    rows.append(flags.where("quote is not null").select("evaluation_id", F.col("flag_id").alias("question"), F.lit(None).cast("string").alias("score"),
                                                        one_line(F.col("quote")).alias("text"), F.lit("red_flag").alias("source")))
    table = rows[0]
    for other in rows[1:]:
        table = table.unionByName(other)
    return table


def sample_comments(table: DataFrame, k: int, key: str, seed: int = 0, group: str = "question") -> DataFrame:
    """Up to ``k`` comments per question, dealt over the scores: lowest, highest, next lowest, ...

    Scores that are numbers are ordered as numbers, before those that are not.  Comments without a score come last.  Each (question, score) is cut to its first ``k`` before
    questions are ranked, so a question with millions of comments never meets in one task.
    """
    shuffled = draw_text(seed, "comment", F.col(group), F.col(key))
    dealt = top_per_group(table.withColumn("__draw", shuffled), [group, "score"], [F.asc("__draw"), F.asc(key)], k, "round")
    # a score is at place i from below or n-1-i from above; its turn is the smaller of 2i and 2(n-1-i)+1
    # (at most k rows of each score are left, so these windows are small)
    number = F.expr("try_cast(score as double)")
    place = F.dense_rank().over(Window.partitionBy(group).orderBy(F.col("score").isNull(), number.asc_nulls_last(), F.col("score").asc_nulls_last())) - 1
    n = F.max(F.when(F.col("score").isNotNull(), F.col("__i") + 1)).over(Window.partitionBy(group))
    turn = F.when(F.col("score").isNull(), F.lit(1 << 30)).otherwise(F.least(2 * F.col("__i"), 2 * (F.col("__n") - 1 - F.col("__i")) + 1))
    turned = dealt.withColumn("__i", place).withColumn("__n", n).withColumn("turn", turn)
    return (top_per_group(turned, [group], [F.asc("round"), F.asc("turn"), F.asc("__draw")], k, "place")
            .drop("__draw", "__i", "__n", "turn", "round"))


def counted_entries(entries: DataFrame, k: int) -> DataFrame:
    """How many evaluations named each entry of a plain list, most frequent first."""
    counts = entries.groupBy("output", "text").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counts, ["output"], [F.desc("n"), F.asc("text")], k)


def disagreement(items: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Spread of each objective item of a text over its evaluators, where more than one scored it."""
    scored = items.where("item_type = 'O' and score is not null").select("evaluation_id", "item_key", "score")
    return (scored.join(evaluations.select("evaluation_id", "subject_response_id"), "evaluation_id")
            .groupBy("subject_response_id", "item_key").agg(F.stddev_samp("score").alias("sd"), F.count(F.lit(1)).alias("n"))
            .where("n > 1"))


def box_plot(facts: DataFrame, measure: str, by: Sequence[str]) -> DataFrame:
    """Five-number summary per combination of dimensions.

    For groups of very many different values there is ``skew.order_statistics``, on a stored table.
    """
    marks = F.percentile(F.col(measure), F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    names = ("low", "q1", "median", "q3", "high")
    return (facts.groupBy(*by).agg(F.count(measure).alias("n"), marks.alias("m"))
            .select(*by, "n", *[F.col("m")[i].alias(name) for i, name in enumerate(names)]))


def text_distribution(items: DataFrame, evaluations: DataFrame) -> DataFrame:
    """How often each score was given to each question of each text."""
    return (items.where("score is not null").select("evaluation_id", "item_id", "score")
            .join(evaluations.select("evaluation_id", "subject_response_id"), "evaluation_id")
            .groupBy("subject_response_id", "item_id", "score").agg(F.count(F.lit(1)).alias("n")))


def evaluator_effect(facts: DataFrame, baseline: str, on: Sequence[str]) -> DataFrame:
    """Mean difference of every evaluator to a baseline evaluator on what both of them scored."""
    means = facts.groupBy(*on, "evaluating_model").agg(F.avg("total_score").alias("mean"))
    base = means.where(F.col("evaluating_model") == baseline).select(*on, F.col("mean").alias("base"))
    return (means.where(F.col("evaluating_model") != baseline).join(base, list(on)).groupBy("evaluating_model")
            .agg(F.count(F.lit(1)).alias("n_shared"), F.avg(F.col("mean") - F.col("base")).alias("difference")))


def template_pairs(facts: DataFrame, a: str, b: str, measure: str, on: str = "input_id") -> DataFrame:
    """The same input under two templates: one conditional aggregate instead of a self-join."""
    pick = lambda name: F.avg(F.when(F.col("template") == name, F.col(measure)))
    return (facts.where(F.col("template").isin(a, b)).groupBy(on).agg(pick(a).alias("a"), pick(b).alias("b"))
            .where("a is not null and b is not null").withColumn("difference", F.col("b") - F.col("a")))
