"""Seeded sampling of inputs and pairing of texts with evaluators.

Draws are hashes of (seed, entry, row), so entries do not influence each other and a run gives the
same inputs however it is partitioned.  Pools that are part of a specification are literals; pools
that are tables are numbered along a position and joined by that number.  Nothing is crossed.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.draws import draw_number, draw_text, pick
from scoreloom.functions.text import fold, normalize_prompt
from scoreloom.functions.values import let, lookup, variant_kind
from scoreloom.operators.skew import dense_index, with_neighbours
from scoreloom.functions.text import common_prefix

STEP = "array<struct<step_index:int,step:string,state:string>>"
PROBLEM = "array<struct<place:string,problem:string>>"


def _literals(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


# ---- single entries ---------------------------------------------------------------------------------


def literal(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def one_of(df: DataFrame, name: str, candidates: Sequence, seed: int, index: str = "i") -> DataFrame:
    """A uniform pick, with replacement."""
    return df.withColumn(name, pick(_literals(candidates), seed, name, F.col(index)))


def cycle(df: DataFrame, name: str, candidates: Sequence, index: str = "i") -> DataFrame:
    """Candidates in turn: each is used equally often, give or take one."""
    return df.withColumn(name, F.element_at(_literals(candidates), (F.col(index) % len(candidates) + 1).cast("int")))


def _meet(rows: DataFrame, at: Column, pool: DataFrame, position: str) -> DataFrame:
    """Each row with the pool's row of number ``at``.  Positions only order the pool, gaps do not count; a number that the pool
    does not have is an error, so no row is lost."""
    have = _size(pool)
    checked = F.when(at < have, at.cast("long")).otherwise(F.raise_error(F.concat(F.lit("the pool has no row of number "), at.cast("string"))).cast("long"))
    numbered = dense_index(pool, [], position, "__at").drop(position)
    return rows.withColumn("__at", checked).join(numbered, "__at").drop("__at")


def _size(pool: DataFrame) -> Column:
    return pool.agg(F.count(F.lit(1))).scalar()


def from_table(df: DataFrame, pool: DataFrame, size: Column | None = None, seed: int | None = None, name: str = "pool", index: str = "i",
               position: str = "position") -> DataFrame:
    """One row of a table per row: in turn, or drawn uniformly when there is a seed.  ``size``: take the first of the pool only."""
    size = _size(pool) if size is None else size
    at = F.col(index) % size if seed is None else draw_number(seed, name, F.col(index)) % size
    return _meet(df, at, pool, position)


def exhaustive(first: DataFrame, entries: Mapping[str, Sequence], index: str = "i", expected: int | None = None,
               first_size: int | None = None) -> DataFrame:
    """All combinations once, the last entry changing fastest.

    ``first`` is the slowest entry, a table with dense positions in ``index``; the other entries are
    listed.  With ``expected`` the number of rows asked for must be the number of combinations.
    """
    others = math.prod(len(v) for v in entries.values())
    if expected is not None and first_size is not None and expected != first_size * others:
        raise ValueError(f"exhaustive sampling gives {first_size * others} combinations, not {expected}")
    out = first.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    stride = others
    for name, values in entries.items():
        stride //= len(values)
        out = out.withColumn(name, F.element_at(_literals(values), (F.floor(F.col("__k") / stride) % len(values) + 1).cast("int")))
    return out.withColumn(index, (F.col(index) * others + F.col("__k")).cast("long")).drop("__k")


def generate(df: DataFrame, name: str, function: Callable, kind: str, seed: int, index: str = "i", **options) -> DataFrame:
    """Values from a Python function ``function(rng, **options)``; each row has its own generator."""
    @F.pandas_udf(kind)
    def run(seeds: pd.Series) -> pd.Series:
        return pd.Series([function(random.Random(int(s)), **options) for s in seeds])
    return df.withColumn(name, run(draw_number(seed, name, F.col(index))))


# ---- steps --------------------------------------------------------------------------------------------


def base_state(state: Column, suffix: str | None) -> Column:
    if not suffix:
        return state
    return F.when(state.endswith(suffix), F.substring(state, F.lit(1), F.length(state) - len(suffix))).otherwise(state)


def steps_with_replacement(names: Sequence[str], states: Sequence[str], seed: int, entry: str, index: Column,
                           fixed: Mapping[str, str] | None = None, suffix: str | None = None) -> Column:
    """One state per step; a state may repeat, and may be negative when there is a suffix."""
    fixed = fixed or {}
    plain = _literals(states)
    pool = F.flatten(F.transform(plain, lambda s: F.array(s, F.concat(s, F.lit(suffix))))) if suffix else plain

    def one(n, i):
        drawn = pick(pool, seed, entry, index, n)
        return F.struct(i.cast("int").alias("step_index"), n.alias("step"), F.coalesce(lookup(fixed, n), drawn).alias("state"))
    return F.transform(_literals(names), one)


def steps_without_replacement(names: Sequence[str], states: Sequence[str], seed: int, entry: str, index: Column,
                              fixed: Mapping[str, str] | None = None, suffix: str | None = None) -> Column:
    """Each state at most once, also counting fixed ones; each drawn state is negative half of the time."""
    fixed = fixed or {}
    taken = [state.removesuffix(suffix or "") for state in fixed.values()]
    free = [state for state in states if state not in taken]
    if len(free) < len(names) - len(fixed):
        raise ValueError("more steps than states")
    open_at = {n: k for k, n in enumerate(n for n in names if n not in fixed)}
    # a shuffle of the free states inside the row: the specification bounds its size
    shuffled = F.array_sort(F.transform(_literals(free), lambda s: F.struct(draw_text(seed, entry, index, s).alias("d"), s.alias("s"))))

    def deal(order):
        def one(n, i):
            state = F.try_element_at(order, (lookup(open_at, n) + 1).cast("int"))["s"]
            if suffix:
                negative = draw_number(seed, entry + "/sign", index, n) % 2 == 1
                state = F.when(negative, F.concat(state, F.lit(suffix))).otherwise(state)
            return F.struct(i.cast("int").alias("step_index"), n.alias("step"), F.coalesce(lookup(fixed, n), state).alias("state"))
        return F.transform(_literals(names), one)
    return let(shuffled, deal)


def check_steps(given: Column, names: Sequence[str], states: Sequence[str], fixed: Mapping[str, str] | None = None,
                replacement: bool = True, suffix: str | None = None, place: str = "steps") -> Column:
    """Every problem of given steps, an array<struct<step,state>>: missing, stray, no state, not the fixed one, repeated."""
    fixed = fixed or {}
    note = lambda where, what: F.struct(F.coalesce(where, F.lit(place)).alias("place"), F.lit(what).alias("problem"))
    steps = F.transform(given, lambda g: g["step"])
    missing = F.transform(F.array_except(_literals(names), steps), lambda s: note(s, "no state"))
    stray = F.transform(F.array_except(steps, _literals(names)), lambda s: note(s, "not a step"))
    mine = F.filter(given, lambda g: g["step"].isin(list(names)))
    known = lambda g: F.coalesce(base_state(g["state"], suffix).isin(list(states)), F.lit(False))
    off = lambda g: F.coalesce(lookup(fixed, g["step"]) != g["state"], F.lit(False)) if fixed else F.lit(False)
    alien = F.transform(F.filter(mine, lambda g: ~known(g)), lambda g: note(g["step"], "unknown state"))
    moved = F.transform(F.filter(mine, lambda g: known(g) & off(g)), lambda g: note(g["step"], "not the fixed state"))
    parts = [missing, stray, alien, moved]
    if not replacement:
        good = F.transform(F.filter(mine, lambda g: known(g) & ~off(g)), lambda g: base_state(g["state"], suffix))
        parts.append(let(good, lambda b: F.transform(
            F.array_sort(F.array_distinct(F.filter(b, lambda s: F.size(F.filter(b, lambda o: o == s)) > 1))), lambda s: note(s, "used again"))))
    return F.concat(*parts).cast(PROBLEM)


def check_entries(given: Column, literals: Mapping[str, str], choices: Mapping[str, Sequence[str]], others: Sequence[str] = ()) -> Column:
    """Every problem of a given instant, a map from entry to value: strays, missing ones, values that cannot be."""
    note = lambda where, what: F.struct(where.alias("place"), F.lit(what).alias("problem"))
    names = [*literals, *choices, *others]
    stray = F.transform(F.array_sort(F.array_except(F.map_keys(given), _literals(names))), lambda k: note(k, "not an entry"))
    required = [n for n in names if n not in literals]
    missing = F.transform(F.array_except(_literals(required), F.map_keys(given)), lambda k: note(k, "missing"))
    wrong = [F.when(F.try_element_at(given, F.lit(n)) != v, F.array(note(F.lit(n), "differs from the fixed value"))) for n, v in literals.items()]
    wrong += [F.when(~F.try_element_at(given, F.lit(n)).isin(list(v)), F.array(note(F.lit(n), "cannot be drawn"))) for n, v in choices.items()]
    return F.concat(stray, missing, *[F.coalesce(w, F.array().cast(PROBLEM)) for w in wrong]).cast(PROBLEM)


def check_given_personas(given: DataFrame, personas: DataFrame, key: str, value: str, selected: Column) -> DataFrame:
    """``key, persona_id, problem`` for personas given as VARIANT: the person meant, and what is wrong, NULL where nothing is.

    A persona is given by id, number or full name, or as its whole record, which must equal the stored one (``personas.record``, VARIANT);
    the order of names in a record does not count.  ``selected`` says on a persona's columns who may be given.
    """
    v = F.col(value)
    kind = variant_kind(v)
    number = F.try_variant_get(v, "$", "decimal(38,9)")
    whole = (number == F.floor(number)) & kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
    ref = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(whole, number.cast("decimal(38,0)").cast("string"))
    asked = given.select(key, kind.alias("__kind"), F.when(kind == "OBJECT", F.try_variant_get(v, "$.id", "string")).alias("__own"), ref.alias("__ref"), F.to_json(v).alias("__said"))
    by_ref = lookup_personas(asked, personas, "__ref").withColumn("__who", F.when(F.col("__kind") == "OBJECT", F.col("__own")).otherwise(F.col("persona_id"))).drop("persona_id")
    # a VARIANT keeps the names of an object in order, so equal records are equal texts
    known = personas.select(F.col("persona_id").alias("__id"), F.to_json("record").alias("__record"), selected.alias("__may"))
    met = by_ref.join(known, F.col("__who") == F.col("__id"), "left")
    problem = (F.when(~F.coalesce(F.col("__kind") == "OBJECT", F.lit(False)) & F.col("__ref").isNull(), "not an id, number, name or record")
               .when(F.col("__id").isNull(), "no such persona").when((F.col("__kind") == "OBJECT") & (F.col("__said") != F.col("__record")), "not the stored record")
               .when(~F.coalesce("__may", F.lit(False)), "not one of the selected personas"))
    return met.select(key, F.col("__id").alias("persona_id"), problem.alias("problem"))


# ---- subjects and evaluators ----------------------------------------------------------------------------

PREFIXES = (3, 6)  # hexadecimal digits of a draw: 4,096 buckets, and the bucket in question cut into 4,096 again


def sample_rows(df: DataFrame, key: str, n: int, seed: int, name: str = "sample") -> DataFrame:
    """Exactly n rows, or all when there are no more, the same for the same seed.

    Draws fall into buckets; whole buckets are kept up to the one in which the n-th row lies.  That one is cut into buckets again,
    and only the last one in question, about one row in 17 million, is ranked.  So n may be large without meeting in one task.
    """
    rest, whole = df.withColumns({"__draw": draw_text(seed, name, F.col(key)), "__base": F.lit(0).cast("long")}), []
    for digits in PREFIXES:
        cut = rest.withColumn("__bucket", F.substring("__draw", 1, digits))
        counts = cut.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"), F.max("__base").alias("__base"))  # at most 4096 rows
        before = F.col("__base") + F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.select("__bucket", "__n", before.alias("__before")).where(F.col("__before") < n)
        near = cut.drop("__base").join(placed, "__bucket")
        whole.append(near.where(F.col("__before") + F.col("__n") <= n).select(*df.columns))
        rest = near.where(F.col("__before") + F.col("__n") > n).select(*df.columns, "__draw", F.col("__before").alias("__base"), "__bucket")
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy("__draw", key))
    edge = rest.withColumn("__rank", rank).where(F.col("__base") + F.col("__rank") <= n).select(*df.columns)
    return whole[0].unionByName(whole[1]).unionByName(edge)


def repeat_rows(df: DataFrame, times: int, name: str = "copy") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def pair_cycle(subjects: DataFrame, people: DataFrame, n_people: Column | None, k: int, index: str = "g", position: str = "position") -> DataFrame:
    """Subject g takes the people at g k, g k + 1, ... around the set: everyone is used equally often."""
    n_people = _size(people) if n_people is None else n_people
    return _meet(repeat_rows(subjects, k, "j"), (F.col(index) * k + F.col("j")) % n_people, people, position)


def pair_sample(subjects: DataFrame, people: DataFrame, n_people: Column | None, k: int, seed: int, key: str, position: str = "position") -> DataFrame:
    """k different people per subject, uniformly; with repeats only where k exceeds their number.

    The k positions are drawn inside the subject's row: position j takes a draw from 0..j, or j itself
    when that one is taken already.
    """
    def step(acc, j):
        t = draw_number(seed, "pair", acc["key"], j) % (acc["first"] + j + 1)
        taken = F.array_contains(acc["out"], t)
        return F.struct(acc["key"].alias("key"), acc["first"].alias("first"),
                        F.array_append(acc["out"], F.when(taken, acc["first"] + j).otherwise(t)).alias("out"))

    steps = F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))
    start = F.struct(F.col(key).alias("key"), (F.col("__people") - k).alias("first"), F.array().cast("array<bigint>").alias("out"))
    different = F.aggregate(steps, start, step)["out"]
    repeats = F.transform(steps, lambda j: draw_number(seed, "pair", F.col(key), j) % F.col("__people"))
    chosen = F.when(F.col("__people") >= k, different).otherwise(repeats)
    n_people = _size(people) if n_people is None else n_people
    held = subjects.withColumn("__people", n_people.cast("long")).withColumn("__chosen", F.explode(chosen)).drop("__people")
    return _meet(held, F.col("__chosen"), people, position).drop("__chosen")


def pair_subject(subjects: DataFrame, people: DataFrame, persona: str = "persona_id") -> DataFrame:
    """The person each text was written for; a text without one is an error."""
    checked = F.when(F.col(persona).isNull(), F.raise_error(F.lit("a subject was generated without a persona")).cast("string")).otherwise(F.col(persona))
    return subjects.withColumn(persona, checked).join(people, persona)


def lookup_personas(refs: DataFrame, personas: DataFrame, ref: str = "ref") -> DataFrame:
    """Personas by id, number, or full name in any case, in this order; NULL where nobody matches."""
    by_number = personas.where("persona_number is not null").groupBy(F.col("persona_number").cast("string").alias("__k")).agg(F.min("persona_id").alias("__by_number"))
    by_name = personas.groupBy(fold(F.col("name")).alias("__k")).agg(F.min("persona_id").alias("__by_name"))
    by_id = personas.select(F.col("persona_id").alias("__k"), F.col("persona_id").alias("__by_id"))
    digits = F.when(F.col(ref).rlike(r"^\d+$"), F.regexp_replace(F.col(ref), r"^0+(?=\d)", ""))
    out = refs.withColumns({"__digits": digits, "__fold": fold(F.col(ref))})
    out = out.join(by_id, F.col(ref) == F.col("__k"), "left").drop("__k")
    out = out.join(by_number, F.col("__digits") == F.col("__k"), "left").drop("__k")
    out = out.join(by_name, F.col("__fold") == F.col("__k"), "left").drop("__k")
    return (out.withColumn("persona_id", F.coalesce("__by_id", "__by_number", "__by_name"))
            .drop("__digits", "__fold", "__by_id", "__by_number", "__by_name"))


def filter_personas(personas: DataFrame, predicate: Column | None = None, **equals) -> DataFrame:
    """Personas for which dotted paths have the given values and the predicate holds."""
    for path, value in equals.items():
        personas = personas.where(F.col(path) == F.lit(value))
    return personas if predicate is None else personas.where(predicate)


# ---- prompts ----------------------------------------------------------------------------------------------


def assign_templates(inputs: DataFrame, templates: Sequence[str], method: str = "crossed", seed: int = 0, index: str = "i") -> DataFrame:
    """Every input with all templates, with them in turn, or with a drawn one."""
    if method == "crossed":
        return inputs.withColumn("template", F.explode(_literals(templates)))
    if method == "cycle":
        return cycle(inputs, "template", templates, index)
    if method == "random":
        return one_of(inputs, "template", templates, seed, index)
    raise ValueError(f"method must be crossed, cycle or random, not {method!r}")


def render(template: str, values: Mapping[str, Column], required: Sequence[str], optional: Sequence[str] = ()) -> Column:
    """A text with ``{{name}}`` replaced by declared values.

    Unknown and undeclared names fail when the plan is made, a required NULL when the row is read; an
    optional NULL becomes empty.
    """
    declared = [*required, *optional]
    unknown = sorted(set(values) - set(declared))
    missing = [v for v in required if v not in values]
    if unknown or missing:
        raise ValueError(f"unknown variables {unknown}, missing variables {missing}; the template takes {declared}")
    parts: list[Column] = []
    for k, piece in enumerate(_split_template(template)):
        if k % 2 == 0:
            parts.append(F.lit(piece))
        elif piece not in declared:
            raise ValueError(f"the template uses {piece!r}, which it does not declare")
        elif piece in required:
            parts.append(F.coalesce(values[piece], F.raise_error(F.lit(f"required variable {piece} is missing")).cast("string")))
        else:
            parts.append(F.coalesce(values[piece], F.lit("")) if piece in values else F.lit(""))
    return normalize_prompt(F.concat(*parts))


def _split_template(template: str) -> list[str]:
    import re
    return re.split(r"\{\{\s*(\w+)\s*\}\}", template)


def messages(user: Column, system: Column | None = None) -> Column:
    """The message list of a prompt."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("user", user)) if system is None else F.array(message("system", system), message("user", user))


def prompt_hash(message_list: Column) -> Column:
    return F.sha2(F.to_json(message_list), 256)


def prompt_groups(df: DataFrame, message_list: Column) -> DataFrame:
    """Identical prompts: how many requests share each."""
    return df.groupBy(prompt_hash(message_list).alias("prompt_sha256")).agg(F.count(F.lit(1)).alias("n"))


def shared_prefixes(df: DataFrame, group: str, idx: str, text: str) -> DataFrame:
    """What each prompt has in common with the one sent before it: the part a provider can cache."""
    near = with_neighbours(df, [group], idx, before={"__before": text})
    return near.withColumn("shared", F.when(F.col("__before").isNotNull(), common_prefix(F.col("__before"), F.col(text)))).drop("__before")


def resolve_templates(refs: DataFrame, templates: DataFrame, ref: str = "ref") -> DataFrame:
    """'name_v2' is that version, 'name' its latest; NULL where there is none."""
    exact = templates.select(F.col("template_id").alias("__k"), F.col("template_id").alias("__exact"))
    newest = templates.groupBy(F.col("name").alias("__k")).agg(F.max_by("template_id", "version").alias("__latest"))
    out = refs.join(exact, F.col(ref) == F.col("__k"), "left").drop("__k").join(newest, F.col(ref) == F.col("__k"), "left").drop("__k")
    return out.withColumn("template_id", F.coalesce("__exact", "__latest")).drop("__exact", "__latest")


def template_status(templates: DataFrame, lock: DataFrame) -> DataFrame:
    """draft (not locked), locked, modified (content differs), or missing (locked, but gone)."""
    held = lock.select("template_id", F.col("template_sha256").alias("__locked"))
    status = (F.when(F.col("template_sha256").isNull(), "missing").when(F.col("__locked").isNull(), "draft")
              .when(F.col("__locked") == F.col("template_sha256"), "locked").otherwise("modified"))
    return templates.join(held, "template_id", "full_outer").withColumn("status", status).drop("__locked")


def seed_clashes(runs: DataFrame) -> DataFrame:
    """Runs whose inputs another run of the dataset repeats: same task and seed, and the same
    instantiation, or one that was not recorded."""
    keys = ["dataset", "task", "seed"]
    hidden = runs.groupBy(*keys).agg(F.count_if(F.col("instantiation_sha256").isNull()).alias("__hidden"))
    same = runs.where("instantiation_sha256 is not null").groupBy(*keys, "instantiation_sha256").agg(F.count(F.lit(1)).alias("__same"))
    own = F.when(F.col("instantiation_sha256").isNull(), F.col("__hidden") - 1).otherwise(F.col("__hidden") + F.col("__same") - 1)
    return (runs.where("dataset is not null and seed is not null").join(hidden, keys).join(same, [*keys, "instantiation_sha256"], "left")
            .withColumn("n_clashes", own).where("n_clashes > 0").drop("__hidden", "__same"))
