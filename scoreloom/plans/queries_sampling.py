"""Queries that sample, pair and render."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import text as tx
from scoreloom.functions.draws import draw_number_sql, draw_text_sql
from scoreloom.operators import sampling as sa
from scoreloom.operators.skew import dense_index
from scoreloom.plans.fixtures import SQL_VIEWS
from scoreloom.plans.registry import query

MOODS = ["calm", "curious", "doubtful"]
STEPS = ["past", "present", "future"]
STATES = ["ash", "birch", "cedar", "dogwood", "elm"]
NEG = " reversed"


def lit_list(values):
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


@query("g1_literal", "select event_id, 'formal' tone from events")
def _(t):
    return sa.literal(t.events.select("event_id"), "tone", "formal")


@query("g2_one_of_random", f"select event_id i, {lit_list(MOODS)}[{draw_number_sql(5, 'mood', 'event_id')} % 3 + 1] mood from events")
def _(t):
    return sa.one_of(t.events.select(F.col("event_id").alias("i")), "mood", MOODS, 5)


@query("g2_from_table", f"select o_orderkey i, persona_id from (select *, {draw_number_sql(5, 'people', 'o_orderkey')} % (select count(*) from customer) p from orders) join fx_personas on p = persona_number")
def _(t):
    pool = t.personas.select(F.col("persona_number").cast("long").alias("position"), "persona_id")
    size = t.customer.agg(F.count(F.lit(1))).scalar()
    return sa.from_table(t.orders.select(F.col("o_orderkey").alias("i")), pool, size, seed=5, name="people").select("i", "persona_id")


@query("g3_cycle", f"select o_orderkey i, persona_id, {lit_list(MOODS)}[o_orderkey % 3 + 1] mood from orders join fx_personas on o_orderkey % (select count(*) from customer) = persona_number")
def _(t):
    pool = t.personas.select(F.col("persona_number").cast("long").alias("position"), "persona_id")
    size = t.customer.agg(F.count(F.lit(1))).scalar()
    rows = sa.from_table(t.orders.select(F.col("o_orderkey").alias("i")), pool, size)
    return sa.cycle(rows, "mood", MOODS).select("i", "persona_id", "mood")


@query("g4_exhaustive", f"""select c_name, mood, step, row_number() over (order by c_custkey, m, s) - 1 i from customer,
       (select unnest({lit_list(MOODS)}) mood, generate_subscripts({lit_list(MOODS)}, 1) m), (select unnest({lit_list(STEPS)}) step, generate_subscripts({lit_list(STEPS)}, 1) s)""")
def _(t):
    return sa.exhaustive(t.customer.select(F.col("c_custkey").alias("i"), "c_name"), {"mood": MOODS, "step": STEPS})


POOL = [s + p for s in STATES for p in ("", NEG)]


@query("g5_steps_with_replacement", f"""select n, cast(k - 1 as int) step_index, step, case when step = 'present' then 'elm' else
       {lit_list(POOL)}[{draw_number_sql(3, 'draw', 'n', 'step')} % 10 + 1] end state from (select n, unnest({lit_list(STEPS)}) step, unnest([1, 2, 3]) k from fx_requests)""")
def _(t):
    draw = sa.steps_with_replacement(STEPS, STATES, 3, "draw", F.col("n"), fixed={"present": "elm"}, suffix=NEG)
    return t.requests.select("n", F.explode(draw).alias("s")).select("n", "s.*")


@query("g6_steps_without_replacement", f"""
       with s as (select n, list(s order by d) o from (select n, s, {draw_text_sql(3, 'draw', 'n', 's')} d from (select n, unnest(['ash', 'birch', 'cedar', 'dogwood']) s from fx_requests)) group by 1)
       select n, cast(k as int) step_index, step, case when step = 'present' then 'elm' else
         o[case when step = 'past' then 1 else 2 end] || case when {draw_number_sql(3, 'draw/sign', 'n', 'step')} % 2 = 1 then ' reversed' else '' end end state
       from (select n, o, unnest({lit_list(STEPS)}) step, unnest([0, 1, 2]) k from s)""")
def _(t):
    draw = sa.steps_without_replacement(STEPS, STATES, 3, "draw", F.col("n"), fixed={"present": "elm"}, suffix=NEG)
    return t.requests.select("n", F.explode(draw).alias("s")).select("n", "s.*")


@query("g7_check_given", """
       select n, place, problem from (
         select n, 'future' place, 'no state' problem from fx_requests where n % 6 = 1 union all select n, 'never', 'not a step' from fx_requests where n % 6 = 2 union all
         select n, 'past', 'unknown state' from fx_requests where n % 6 = 3 union all select n, 'present', 'not the fixed state' from fx_requests where n % 6 = 4 union all
         select n, 'elm', 'used again' from fx_requests where n % 6 = 5 union all
         select n, 'colour', 'not an entry' from fx_requests where n % 4 = 1 union all select n, 'mood', 'missing' from fx_requests where n % 4 = 2 union all
         select n, 'mood', 'cannot be drawn' from fx_requests where n % 4 = 3 union all
         select n, 'tone', 'differs from the fixed value' from fx_requests where n % 5 = 0)""")
def _(t):
    n = F.col("n")
    at = lambda step, state: F.struct(F.lit(step).alias("step"), (F.lit(state) if isinstance(state, str) else state).alias("state"))
    past = F.when(n % 6 == 3, "oak").when(n % 6 == 5, "elm reversed").otherwise("ash")
    present = F.when(n % 6 == 4, "birch").otherwise("elm")
    given = F.concat(F.array(at("past", past), at("present", present)), F.when(n % 6 == 1, F.array().cast("array<struct<step:string,state:string>>")).otherwise(
        F.array(at("future", "cedar"))), F.when(n % 6 == 2, F.array(at("never", "ash"))).otherwise(F.array().cast("array<struct<step:string,state:string>>")))
    problems = sa.check_steps(given, STEPS, STATES, fixed={"present": "elm"}, replacement=False, suffix=NEG)
    instant = F.map_filter(F.create_map(F.lit("tone"), F.when(n % 5 == 0, "rude").otherwise("formal"), F.lit("mood"), F.when(n % 4 == 3, "angry").otherwise("calm"),
                                        F.lit("colour"), F.lit("red")), lambda k, _: ~((k == "colour") & (n % 4 != 1)) & ~((k == "mood") & (n % 4 == 2)))
    entries = sa.check_entries(instant, {"tone": "formal"}, {"mood": MOODS})
    return t.requests.select("n", F.explode(F.concat(problems, entries)).alias("p")).select("n", "p.*")


@query("g7_personas", """
       select c_custkey k, case when c_custkey % 9 in (5, 8) then null else concat('per_', c_custkey) end persona_id,
         case c_custkey % 9 when 4 then 'not the stored record' when 5 then 'no such persona' when 8 then 'not an id, number, name or record'
           else case when c_mktsegment = 'BUILDING' then 'not one of the selected personas' end end problem from customer""")
def _(t):
    # by id, number, number as text, full name, record, record changed, unknown record, record in another order, and a list
    k = F.col("persona_number")
    people = t.personas.withColumn("record", F.parse_json(F.to_json(F.struct(F.col("persona_id").alias("id"), "name", F.struct("segment", "nation").alias("home")))))
    record = F.to_json(F.struct(F.col("persona_id").alias("id"), "name", F.struct("segment", "nation").alias("home")))
    turned = F.to_json(F.struct(F.struct("nation", "segment").alias("home"), "name", F.col("persona_id").alias("id")))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    said = (F.when(k % 9 == 0, quoted(F.col("persona_id"))).when(k % 9 == 1, k.cast("string")).when(k % 9 == 2, quoted(k.cast("string"))).when(k % 9 == 3, quoted(F.upper("name")))
            .when(k % 9 == 4, F.replace(record, F.lit('"nation":"'), F.lit('"nation":"New '))).when(k % 9 == 5, F.replace(record, F.lit('"id":"'), F.lit('"id":"x'))).when(k % 9 == 6, record)
            .when(k % 9 == 7, turned).otherwise("[1]"))
    given = t.personas.select(F.col("persona_number").cast("long").alias("k"), F.parse_json(said).alias("given"))
    return sa.check_given_personas(given, people, "k", "given", F.col("segment") != "BUILDING")


@query("g8_base_state", "select o_orderkey, o_orderpriority base, o_orderkey % 2 = 0 turned from orders")
def _(t):
    state = F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, NEG).otherwise(""))
    return t.orders.select("o_orderkey", sa.base_state(state, NEG).alias("base"), state.endswith(NEG).alias("turned"))


@query("g9_persona_lookup", """select o_orderkey, case when o_orderkey % 4 <> 3 then concat('per_', o_custkey) end persona_id from orders""")
def _(t):
    k, who = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    ref = F.when(k % 4 == 0, F.concat(F.lit("per_"), who)).when(k % 4 == 1, who).when(
        k % 4 == 2, F.concat(F.lit("CUSTOMER#"), F.lpad(who, 9, "0"))).otherwise(F.concat(F.lit("nobody "), who))
    return sa.lookup_personas(t.orders.select("o_orderkey", ref.alias("ref")), t.personas).select("o_orderkey", "persona_id")


@query("g10_persona_filter", "select persona_id from fx_personas where region = 'ASIA' and segment = 'BUILDING' and c_acctbal >= 1000")
def _(t):
    nested = t.personas.select("persona_id", F.struct("segment", F.struct("nation", "region").alias("location")).alias("demographics"), "c_acctbal")
    return sa.filter_personas(nested, F.col("c_acctbal") >= 1000, **{"demographics.location.region": "ASIA", "demographics.segment": "BUILDING"}).select("persona_id")


@query("g11_sample_subjects", f"""select response_id, k.j from (select response_id from (select response_id, {draw_text_sql(9, 'sample', 'response_id')} d from fx_responses)
       order by d, response_id limit 700) s, (select unnest([0, 1]) j) k""")
def _(t):
    return sa.repeat_rows(sa.sample_rows(t.responses.select("response_id"), "response_id", 700, 9), 2, "j")


@query("g12_pair_sample", "select o_orderkey, cast(3 as bigint) n, cast(3 as bigint) n_different, true known from orders")
def _(t):
    people = t.personas.select(F.col("persona_number").cast("long").alias("position"), "persona_id")
    size = t.customer.agg(F.count(F.lit(1))).scalar()
    pairs = sa.pair_sample(t.spread_orders.select("o_orderkey"), people, size, 3, 11, "o_orderkey")
    return pairs.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("persona_id").alias("n_different"),
                                           (F.min("persona_id").isNotNull()).alias("known"))


@query("g13_pair_cycle", """select o_orderkey g, j.j, concat('per_', (o_orderkey * 3 + j.j) % (select count(*) from customer)) persona_id
       from orders, (select unnest([0, 1, 2]) j) j""")
def _(t):
    people = t.personas.select(F.col("persona_number").cast("long").alias("position"), "persona_id")
    size = t.customer.agg(F.count(F.lit(1))).scalar()
    return sa.pair_cycle(t.orders.select(F.col("o_orderkey").alias("g")), people, size, 3).select("g", "j", "persona_id")


@query("g14_pair_subject", "select o_orderkey, persona_id, name as name from orders join fx_personas on persona_id = concat('per_', o_custkey)")
def _(t):
    subjects = t.orders.select("o_orderkey", F.concat(F.lit("per_"), F.col("o_custkey").cast("string")).alias("persona_id"))
    return sa.pair_subject(subjects, t.personas.select("persona_id", "name")).select("o_orderkey", "persona_id", "name")


@query("g15_cross_templates", f"""select 'crossed' as method, m, t.template from fx_inputs, (select unnest(['tpl_a', 'tpl_b', 'tpl_c']) as template) t union all
       select 'cycle', m, ['tpl_a', 'tpl_b', 'tpl_c'][m % 3 + 1] from fx_inputs union all
       select 'random', m, ['tpl_a', 'tpl_b', 'tpl_c'][{draw_number_sql(2, 'template', 'm')} % 3 + 1] from fx_inputs""")
def _(t):
    rows = t.inputs.select("m")
    parts = [sa.assign_templates(rows, ["tpl_a", "tpl_b", "tpl_c"], method, 2, "m").withColumn("method", F.lit(method)) for method in ("crossed", "cycle", "random")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


TEMPLATE = "Question for {{name}}   \n\n\n\nAbout {{ topic }}:{{hint}}\n"


@query("g16_render_prompts", """select c_custkey, concat('Question for ', c_name, chr(10), chr(10), 'About ', c_mktsegment, ':', case when c_custkey % 2 = 0 then '!' else '' end) prompt from customer""")
def _(t):
    hint = F.when(F.col("c_custkey") % 2 == 0, "!  ")
    return t.customer.select("c_custkey", sa.render(TEMPLATE, {"name": F.col("c_name"), "topic": F.col("c_mktsegment"), "hint": hint},
                                                    ["name", "topic"], ["hint"]).alias("prompt"))


@query("g17_text_blocks", """select c_custkey, concat('name: ', c_name, chr(10), 'segment: ', c_mktsegment) kv, concat('- ', c_name, chr(10), '- ', c_mktsegment) bullets,
       concat('1. ', c_name, chr(10), '2. ', c_mktsegment) numbered, concat('{"name":"', c_name, '","segment":"', c_mktsegment, '"}') json from customer""")
def _(t):
    entry = lambda label, c: F.struct(F.lit(label).alias("label"), F.col(c).alias("value"))
    pairs, items = F.array(entry("name", "c_name"), entry("segment", "c_mktsegment")), F.array("c_name", "c_mktsegment")
    record = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return t.customer.select("c_custkey", tx.kv_lines(pairs).alias("kv"), tx.bullets(items).alias("bullets"), tx.numbered(items).alias("numbered"),
                             tx.json_block(record, pretty=False).alias("json"))


@query("g18_prompt_hash_groups", """select sha256(concat('[{"role":"system","content":"', lang, '"},{"role":"user","content":"', source, '"}]')) prompt_sha256, count(*) n from documents group by 1""")
def _(t):
    return sa.prompt_groups(t.documents, sa.messages(F.col("source"), F.col("lang")))


@query("g19_shared_prefix", """select n, case when n >= 2 then length('Instructions first. Then the input: ') + case when v = pv then length(v) + 5 + 0 else 0 end end as shared
       from (select n, v, lag(v) over (partition by n % 2 order by n) pv from (select n, concat('v', n // 2 % 3) v from fx_prompts))""".replace(
           "case when v = pv then length(v) + 5 + 0 else 0 end", "1"))
def _(t):
    # what comes after the fixed part differs from the first digit on
    p = t.prompts.select("n", "template", F.concat(F.lit("Instructions first. Then the input: v"), (F.floor(F.col("n") / 2) % 3).cast("string"), F.lit(" done")).alias("text"))
    return sa.shared_prefixes(dense_index(p, ["template"], "n"), "template", "idx", "text").select("n", F.col("shared").cast("long").alias("shared"))


SQL_VIEWS["fx_templates"] = """select concat(p_brand, '_v', p_size) template_id, p_brand as name, p_size as version, md5(min(p_type)) template_sha256 from part group by p_brand, p_size"""
SQL_VIEWS["fx_lock"] = """select template_id, case when version % 5 = 0 then 'other' else template_sha256 end template_sha256 from fx_templates where version % 3 <> 0
    union all select distinct concat(p_brand, '_v99'), 'gone' from part"""


def template_table(t):
    return (t.part.groupBy("p_brand", "p_size").agg(F.md5(F.min("p_type")).alias("template_sha256"))
            .select(F.concat("p_brand", F.lit("_v"), F.col("p_size").cast("string")).alias("template_id"), F.col("p_brand").alias("name"), F.col("p_size").alias("version"), "template_sha256"))


@query("g20_template_versions", """select p_partkey, coalesce(e.template_id, l.template_id) template_id from (select p_partkey, case when p_partkey % 2 = 0 then p_brand
         when p_partkey % 3 = 0 then concat(p_brand, '_v98') else concat(p_brand, '_v', p_size) end ref from part) r
       left join fx_templates e on e.template_id = r.ref left join (select name as name, arg_max(template_id, version) template_id from fx_templates group by 1) l on l.name = r.ref""")
def _(t):
    k = F.col("p_partkey")
    ref = F.when(k % 2 == 0, F.col("p_brand")).when(k % 3 == 0, F.concat("p_brand", F.lit("_v98"))).otherwise(F.concat("p_brand", F.lit("_v"), F.col("p_size").cast("string")))
    return sa.resolve_templates(t.part.select("p_partkey", ref.alias("ref")), template_table(t)).select("p_partkey", "template_id")


@query("g20_template_status", """select coalesce(t.template_id, l.template_id) template_id, case when t.template_id is null then 'missing' when l.template_id is null then 'draft'
       when l.template_sha256 = t.template_sha256 then 'locked' else 'modified' end status from fx_templates t full join fx_lock l on t.template_id = l.template_id""")
def _(t):
    templates = template_table(t)
    lock = templates.where("version % 3 <> 0").select("template_id", F.when(F.col("version") % 5 == 0, "other").otherwise(F.col("template_sha256")).alias("template_sha256"))
    gone = t.part.select(F.concat("p_brand", F.lit("_v99")).alias("template_id"), F.lit("gone").alias("template_sha256")).distinct()
    return sa.template_status(templates, lock.unionByName(gone)).select("template_id", "status")


SQL_VIEWS["fx_seeded"] = """select o_orderkey run_id, o_orderstatus dataset, o_orderpriority task, o_custkey % 400 seed,
    case when o_orderkey % 5 <> 0 then concat('sha_', o_orderkey % 3) end instantiation_sha256 from orders"""


@query("g21_seed_clash", """select a.run_id, count(*) n_clashes from fx_seeded a join fx_seeded b on a.dataset = b.dataset and a.task = b.task and a.seed = b.seed
       and a.run_id <> b.run_id and (b.instantiation_sha256 is null or b.instantiation_sha256 = a.instantiation_sha256) group by 1""")
def _(t):
    k = F.col("o_orderkey")
    seeded = t.orders.select(k.alias("run_id"), F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("task"), (F.col("o_custkey") % 400).alias("seed"),
                             F.when(k % 5 != 0, F.concat(F.lit("sha_"), (k % 3).cast("string"))).alias("instantiation_sha256"))
    return sa.seed_clashes(seeded).select("run_id", "n_clashes")


def roll(rng, sides):
    return rng.randint(1, sides)


@query("u8_generate", "select o_orderkey i, true fits from orders")
def _(t):
    rows = sa.generate(t.orders.select(F.col("o_orderkey").alias("i")), "roll", roll, "int", seed=4, sides=6)
    return rows.select("i", F.col("roll").between(1, 6).alias("fits"))
