"""Registered queries of this package and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.draws import draw_number, draw_number_sql
from scoreloom.llm import (byte_bpe, context_trees, conversation_repair, hard_negatives, language_id, line_rules, minhash, mixing, neighbours, passages, sharding, url_lists,
                           wrappers)
from scoreloom.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build
    return register


def list_events(pages: DataFrame, changes: int = 6) -> DataFrame:
    """A dated list over every domain, host and directory of the pages: ``changes`` drawn changes a key."""
    host, first = url_lists.url_host(F.col("url")), url_lists.url_directory(F.col("url"))
    domain = F.regexp_extract(host, r"[^.]+\.[^.]+$", 0)
    keys = (pages.select(F.explode(F.array(domain, host, F.concat_ws("/", host, first))).alias("key")).where("key is not null and key <> ''").distinct())
    drawn = keys.select("key", F.explode(F.sequence(F.lit(1), F.lit(changes))).alias("n"))
    draw = lambda what: draw_number(2, what, F.col("key"), F.col("n"))
    return drawn.select("key", F.date_add(F.lit("2024-01-01").cast("date"), (draw("day") % 366).cast("int")).alias("day"),
                        F.when(draw("action") % 3 == 0, "remove").otherwise("add").alias("action"),
                        F.element_at(F.array(*map(F.lit, ("adult", "allow", "malware", "spam"))), (draw("category") % 4 + 1).cast("int")).alias("category"))


_HOST = r"lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)', 1))"
_DIR = r"regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?[^/?#:@]+(?::[0-9]*)?/+([^/?#]+)', 1)"


@query("op2_temporal_url_lists", rf"""
with p as (select page_id, url, {_HOST} as host, {_DIR} as dir,
             cast(date '2024-01-01' + cast({draw_number_sql(2, 'fetch', 'page_id')} % 366 as integer) as date) as fetched_on from pages),
keys as (select distinct unnest([regexp_extract(host, '[^.]+\.[^.]+$'), host, case when dir = '' then host else host || '/' || dir end]) as key from p),
events as (select key, cast(date '2024-01-01' + cast({draw_number_sql(2, 'day', 'key', 'n')} % 366 as integer) as date) as day,
             {draw_number_sql(2, 'action', 'key', 'n')} % 3 <> 0 as added,
             ['adult', 'allow', 'malware', 'spam'][{draw_number_sql(2, 'category', 'key', 'n')} % 4 + 1] as category
           from keys, range(1, 7) t(n) where key <> ''),
daily as (select key, category, day, bool_and(added) as added from events group by all),
valid as (select *, lead(day, 1, date '9999-12-31') over (partition by key, category order by day) as until from daily),
asked as (select page_id, fetched_on, unnest(list_distinct([case when dir = '' then host else host || '/' || dir end, host]
             || [array_to_string(list_slice(string_split(host, '.'), i, 99), '.') for i in range(1, greatest(len(string_split(host, '.')), 2))])) as key, host, dir from p),
met as (select a.page_id, v.key, v.category, case when a.dir <> '' and v.key = a.host || '/' || a.dir then 1000 else length(v.key) end as narrow
        from asked a join valid v on a.key = v.key and v.added and v.day <= a.fetched_on and a.fetched_on < v.until),
best as (select page_id, count(*) as n_active, max_by(struct_pack(key := key, category := category), struct_pack(n := narrow, r := -ascii(category) * 1000 - ascii(substr(category, 2)))) as b
         from met group by page_id)
select p.page_id, p.fetched_on, coalesce(best.n_active, 0) as n_active, best.b.key as entry, best.b.category as category,
       coalesce(best.b.category <> 'allow', false) as blocked
from p left join best using (page_id)""")
def _(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), (draw_number(2, "fetch", F.col("page_id")) % 366).cast("int")))
    return url_lists.active_entries(captures, list_events(pages)).drop("url")


@query("op3_mix_sources", rf"""
with d as (select doc_id, source, len({WORDS_SQL}) as size,
             greatest(0.05::double, coalesce(length(translate(text, '#*$%&|<>', ''))::double / nullif(length(text), 0)::double, 0.05::double)) as q from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from s),
l as (select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over o, 0))::double / (sum(w) over () - coalesce(sum(w) over o, 0))::double as lvl,
        row_number() over (order by 3 * source_size / w, source nulls last) as nr
      from w window o as (order by 3 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least(3.0::double * source_size, (select min_by(lvl, nr) from l where 3 * source_size >= lvl * w) * w) as target from l),
e as (select *, coalesce(floor(target / nullif(source_size, 0)), 0) as ep from t),
k as (select d.doc_id, d.size, e.source_size, e.target, e.ep, e.target - e.ep * e.source_size as rest,
        coalesce(sum(d.size) over (partition by d.source order by -ln(({draw_number_sql(mixing.SEED, 'mix', 'd.doc_id', 'd.size')}::double + 0.5) / 1152921504606846976.0::double) / d.q,
          d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
      from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, cast(ep + (case when size > 0 and before + size / 2.0 <= rest then 1 else 0 end) as integer) as copies,
       cast(size * (ep + (case when size > 0 and before + size / 2.0 <= rest then 1 else 0 end)) as bigint) as taken from k""")
def _(spark, sf_dir):
    return mixing.mix_documents(documents(spark, sf_dir)).drop("source")


@query("op6_sampled_splitters")
def _(spark, sf_dir):
    return sharding.shard_documents(documents(spark, sf_dir))


@query("op10_line_rules", r"""
with d as (select doc_id, coalesce(text, '') as t, """ + WORDS_SQL + r""" as w from documents),
l as (select doc_id, x.line, x.nr, regexp_extract_all(x.line, '[^\x20\x09-\x0D]+') as w
      from (select doc_id, unnest(list_transform(string_split(t, chr(10)), lambda e, i: struct_pack(line := e, nr := i))) as x from d)),
v as (select *, len(w) as n, case when len(w) = 0 then false
        when len(list_filter(w, lambda e: e in ('|', '>', '»', '•', '·'))) >= 0.1 * len(w) then true
        when len(list_filter(w, lambda e: regexp_matches(e, '[#*$%&|<>]'))) >= 0.2 * len(w) then true
        when len(list_filter(w, lambda e: regexp_matches(e, '[!?]{2}$'))) >= 0.3 * len(w) then true
        when len(w) <= 30 and regexp_matches(line, '""" + line_rules.BOILERPLATE + r"""') then true
        else len(w) < 4 and not regexp_matches(line, '[.!?…。！？:;,"''”’»)\]][\x20\x09-\x0D]*$') end as bad from l),
lines as (select doc_id, sum(n)::bigint as n_words, sum(case when bad then n else 0 end)::bigint as removed_words,
            (count(*) filter (n > 0) - count(distinct line) filter (n > 0))::bigint as n_dup_lines from v group by doc_id),
g as (select doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
r as (select doc_id, count(distinct i + k)::bigint as n_repeat_words from (select *, count(*) over (partition by doc_id, g) as c from g), range(3) t(k) where c > 1 group by doc_id),
a as (select doc_id, n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, removed_words
      from d join lines using (doc_id) left join r using (doc_id))
select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and removed_words <= 0.3 * n_words as kept from a""")
def _(spark, sf_dir):
    return line_rules.judge_lines(documents(spark, sf_dir).select("doc_id", "text")).drop("text", "clean_text")


@query("op5_byte_bpe")
def _(spark, sf_dir):
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return byte_bpe.with_ids(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests_only=True)


@query("op7_language_id")
def _(spark, sf_dir):
    return language_id.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))


@query("op9_multiprobe_neighbours")
def _(spark, sf_dir):
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op4_minhash", r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i:i + 3], ' ') end as g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as u, b.doc_id as v, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as materialized (select u, v from c join n x on x.doc_id = u join n y on y.doc_id = v where 100 * k >= 80 * (x.n + y.n - k)),
e as materialized (select u, v from l union select v, u from l),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.v from r join e on r.b = e.u)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.c as component_id, m.c = d.doc_id as kept
from d left join n using (doc_id) join (select a as doc_id, min(b) as c from r group by a) m using (doc_id)""")
def _(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return minhash.near_duplicates(docs, minhash.Plan(shingle=4)).withColumnRenamed("id", "doc_id")


@query("op8_shared_passages")
def _(spark, sf_dir):
    return passages.shared_passages(documents(spark, sf_dir))


@query("op1_context_trees")
def _(spark, sf_dir):
    return context_trees.score_texts(documents(spark, sf_dir))


@query("op11_wrapper_induction")
def _(spark, sf_dir):
    return wrappers.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


@query("op12_angular_negatives", """
with b as (select vec_id, min(struct_pack(label := label, v := list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)))) as s from embeddings
           where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id),
e as (select vec_id, case when vec_id % 7 = 0 then (s.label + 1) % 10 else s.label end as label, list_transform(s.v, lambda x: x::double) as v from b),
m as materialized (select a.vec_id as anchor_id, e.vec_id as other, a.label = e.label as same, cast(list_inner_product(a.v, e.v) as bigint) as score
      from e a join e on a.vec_id <> e.vec_id and len(a.v) = len(e.v) where a.vec_id % 100 = 0),
p as (select anchor_id, other as positive_id, score as positive_score from m where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by m.score desc, m.other) as rank, m.other as negative_id, p.positive_score, m.score as negative_score
from p join m on m.anchor_id = p.anchor_id and not m.same and 80 * p.positive_score <= 100 * m.score and 100 * m.score <= 100 * p.positive_score qualify rank <= 5""")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    damaged = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(damaged, F.col("id") % 100 == 0)


def _repairs_sql() -> str:
    """One step of the recursion: for each state the least of all ways into it, as cost, audit and lines written (each after a newline)."""
    into: dict[int, list[str]] = {s: [] for s in range(4)}
    forced, cut_off, first = "r.fault in (1, 2)", "(case when r.fault = 3 then 1 else 0 end)", "left(r.role, 1)"
    way = lambda s, cost, letters, lines: f"struct_pack(c := p.v[{s + 1}].c + {cost}, a := p.v[{s + 1}].a || '{letters}', z := p.v[{s + 1}].z || {lines})"
    for state in range(4):
        at, before, lines = state, "", "''"
        for inserts in range(3):
            goes, role = (3, "assistant") if at == 2 else (2, "user")
            into[at].append(f"case when p.v[{state + 1}] is not null then {way(state, 2 * inserts + 3, before + 'D', lines)} end")
            free = f"p.v[{state + 1}] is not null and not {forced}"
            into[goes].append(f"case when {free} then {way(state, f'{2 * inserts + 2} + {cut_off}', before + 'R', f'{lines} || chr(10) || {chr(39)}{role}:{chr(39)} || r.text')} end")
            into[goes].append(f"case when {free} and {first} = '{role[0]}' then {way(state, f'{2 * inserts} + {cut_off}', before + 'K', f'{lines} || chr(10) || r.role || {chr(39)}:{chr(39)} || r.text')} end")
            if at == 0:
                into[1].append(f"case when {free} and {first} = 's' then {way(state, f'{2 * inserts} + {cut_off}', before + 'K', f'{lines} || chr(10) || r.role || {chr(39)}:{chr(39)} || r.text')} end")
            at, before, lines = goes, before + "I", f"{lines} || chr(10) || '{role}:'"
    return "[" + ", ".join(f"list_sort([{', '.join(into[s])}], 'ASC', 'NULLS LAST')[1]" for s in range(4)) + "]"


@query("op13_hirschberg_repair", rf"""
with recursive bits as (select n::bigint as n, list_reduce(list_prepend(n::bigint, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) x(n)),
crc as (select list(c order by n) as t from bits),
d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(list_reduce(list_prepend(4294967295::bigint,
        list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 as act
      from conversations, crc),
r as (select conv_id, turn, case act when 4 then 'user' else role end as role, case act when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
      from (select *, unnest(range(case act when 0 then 0 when 3 then 2 else 1 end)) from d)),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from r),
o as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as seen,
        coalesce(left(lag(role) over w, 1) || left(role, 1) not in ('su', 'ua', 'au'), false) as wrong from n window w as (partition by conv_id order by i)),
f as materialized (select *, case when not regexp_matches(text, '[^ 	-
]') then 1 when seen then 2 when not regexp_matches(text, '[.!?][ 	-
]*$') then 3 else 0 end as fault from o),
p as (select conv_id, 0::bigint as i, [struct_pack(c := 0, a := '', z := ''), null, null, null] as v from (select distinct conv_id from conversations)
      union all select p.conv_id, r.i, {_repairs_sql()} from p join f r on p.conv_id is not distinct from r.conv_id and r.i = p.i + 1),
z as (select conv_id, max_by(v, i) as v from p group by conv_id),
b as (select conv_id, list_sort([case when v[1] is not null then v[1] end, case when v[2] is not null then struct_pack(c := v[2].c + 4, a := v[2].a || 'II', z := v[2].z || chr(10) || 'user:' || chr(10) || 'assistant:') end,
        case when v[3] is not null then struct_pack(c := v[3].c + 2, a := v[3].a || 'I', z := v[3].z || chr(10) || 'assistant:') end, v[4]], 'ASC', 'NULLS LAST')[1] as s from z),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
        count(*) filter (fault = 3) as truncated, count(*) filter (wrong) as illegal from f group by conv_id)
select b.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  s.c::bigint as cost, s.a as audit, sha256(substr(s.z, 2)) as repaired_sha256 from b left join g on b.conv_id is not distinct from g.conv_id""")
def _(spark, sf_dir):
    return conversation_repair.repaired_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
