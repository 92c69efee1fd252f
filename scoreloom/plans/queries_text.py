"""Queries that split and window whole texts."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.text import sentences, word_count
from scoreloom.operators import windows as w
from scoreloom.plans.fixtures import SQL_VIEWS
from scoreloom.plans.registry import query

SQL_VIEWS["fx_pieces"] = r"""
    select doc_id, pos, piece, regexp_extract(piece, '\S+') token,
      coalesce(sum(length(piece)) over (partition by doc_id order by pos), 0) end_at
    from (select doc_id, unnest(regexp_extract_all(text, '\s*\S+')) piece, generate_subscripts(regexp_extract_all(text, '\s*\S+'), 1) pos from documents)"""
SQL_VIEWS["fx_pieces_of"] = r"""select doc_id, regexp_extract_all(text, '\s*\S+') p, len(regexp_extract_all(text, '\s*\S+')) n from documents"""
SQL_VIEWS["fx_sentences"] = r"""
    select doc_id, sentence from (select doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))) raw from documents),
      lateral (select regexp_replace(raw, '^\s+|\s+$', '', 'g') sentence) where sentence <> ''"""
SQL_VIEWS["fx_char_windows"] = """
    with recursive tok as (select doc_id, pos, cast(end_at - length(token) as bigint) s, cast(end_at as bigint) e,
        lag(cast(end_at as bigint)) over (partition by doc_id order by pos) prev_e, max(cast(end_at as bigint)) over (partition by doc_id) last_e from fx_pieces),
      g as (select size, doc_id, pos, s, cast(null as bigint) prev_e, last_e from tok, (values (80), (100), (400)) v(size) where pos = 1
        union all select g.size, t.doc_id, t.pos, t.s, t.prev_e, t.last_e from g join tok t on t.doc_id = g.doc_id and t.pos > g.pos and t.e > g.s + g.size
          and (t.pos = g.pos + 1 or t.prev_e <= g.s + g.size))
    select size, doc_id, coalesce(lead(prev_e) over (partition by size, doc_id order by pos), last_e) - s chars from g"""


@query("x1_tokenize_ws", """select doc_id, count(*) n_tokens, cast(sum(end_at - length(token)) as bigint) starts, cast(sum(end_at) as bigint) ends,
       min(token) first_token, max(token) last_token from fx_pieces group by 1""")
def _(t):
    return w.token_totals(w.tokenize(t.texts, "doc_id", "text", extremes=True), "doc_id")


def letter_spans():
    """A tokenizer of another kind: runs of letters."""
    kind = T.StructType.fromDDL("token array<string>, start array<int>, end array<int>")

    @F.arrow_udf(kind)
    def spans(texts: pa.Array) -> pa.Array:
        # numbers and characters lie in flat arrays, with no Python object per token beyond one text
        places, tokens, edges = [np.zeros((0, 2), np.int32)], [pa.array([], pa.string())], [0]
        for i in range(len(texts)):
            text = texts[i].as_py()
            found = [m.span() for m in re.finditer("[a-z]+", text or "")]
            edges.append(edges[-1] + len(found))
            if found:
                places.append(np.array(found, np.int32))
                tokens.append(pa.array([text[lo:hi] for lo, hi in found], pa.string()))
        at, ends = np.concatenate(places), pa.array(edges, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.concat_arrays(tokens), pa.array(np.ascontiguousarray(at[:, 0])), pa.array(np.ascontiguousarray(at[:, 1])))]
        return pa.StructArray.from_arrays(lists, ["token", "start", "end"])
    return spans


@query("u7_tokenizer", """select doc_id, count(*) n_tokens, cast(sum(length(token)) as bigint) chars from (select doc_id, unnest(regexp_extract_all(text, '[a-z]+')) token from documents) group by 1""")
def _(t):
    return (w.tokenize(t.texts, "doc_id", "text", letter_spans()).groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(F.col("end") - F.col("start")).alias("chars")))


@query("x2_build_vocab", """select token, row_number() over (order by at_doc, at_pos) - 1 token_id, n from (
       select token, min(doc_id) at_doc, arg_min(pos, doc_id * 16777216 + pos) at_pos, count(*) n from fx_pieces group by 1)""")
def _(t):
    return w.build_vocab(t.texts, "doc_id", "text")


@query("x3_window_tokens", """select doc_id, count(*) n_windows, cast(sum(length(t)) as bigint) chars, min(t) first_window, max(t) last_window from (
       select doc_id, concat_ws('_', regexp_extract(p[s + 1], '\\S+'), regexp_extract(p[s + 3], '\\S+'), regexp_extract(p[s + 5], '\\S+')) t
       from (select *, unnest(range(0, n - 5 + 1, 4)) s from fx_pieces_of where n >= 5)) group by 1""")
def _(t):
    from scoreloom.functions.text import words
    windows = F.explode(w.token_windows(F.col("w"), 3, stride=4, dilation=2))
    text = F.array_join("window", "_")
    return (t.texts.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", windows.alias("window")).groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("n_windows"), F.sum(F.length(text)).alias("chars"), F.min(text).alias("first_window"), F.max(text).alias("last_window")))


@query("x5_reconstruct", """select doc_id, count(*) n_windows, cast(sum(length(t)) as bigint) chars, md5(string_agg(t, '|' order by s)) digest from (
       select doc_id, s, regexp_replace(array_to_string(p[s + 1: s + 10], ''), '^\\s+|\\s+$', '', 'g') t
       from (select *, unnest(range(0, n, 10)) s from fx_pieces_of where n > 0)) group by 1""")
def _(t):
    texts = F.col("windows")
    return (t.texts.select("doc_id", w.pieces(F.col("text")).alias("p")).where(F.size("p") > 0)
            .select("doc_id", w.window_texts(F.col("p"), 10, drop_last=False).alias("windows"))
            .select("doc_id", F.size(texts).cast("long").alias("n_windows"),
                    F.aggregate(texts, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"), F.md5(F.array_join(texts, "|")).alias("digest")))


@query("x4_window_chars", "select doc_id, cast(count(*) as int) n_windows, cast(max(chars) as int) longest from fx_char_windows where size = 80 group by 1")
def _(t):
    windows = w.multi_scale(t.texts, "doc_id", "text", char_limits=[80])
    return windows.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_windows"), F.max(F.length("text")).alias("longest"))


@query("x6_multi_scale", """select doc_id, scale, count(*) n_windows, cast(sum(length(t)) as bigint) chars from (
       select doc_id, scale, regexp_replace(array_to_string(p[s + 1: s + k], ''), '^\\s+|\\s+$', '', 'g') t
       from (select *, unnest(range(0, n, k)) s from fx_pieces_of, (values (5, 'tok_len_5'), (20, 'tok_len_20')) v(k, scale) where n > 0)) group by 1, 2""")
def _(t):
    return (w.multi_scale(t.texts, "doc_id", "text", token_sizes=[5, 20]).groupBy("doc_id", "scale")
            .agg(F.count(F.lit(1)).alias("n_windows"), F.sum(F.length("text")).alias("chars")))


@query("x6_multi_scale_chars", """select doc_id, concat('char_len_', size) scale, count(*) n_windows, cast(sum(chars) as bigint) chars from fx_char_windows where size <> 80 group by 1, 2""")
def _(t):
    return (w.multi_scale(t.texts, "doc_id", "text", char_limits=[100, 400]).groupBy("doc_id", "scale")
            .agg(F.count(F.lit(1)).alias("n_windows"), F.sum(F.length("text")).alias("chars")))


@query("x7_sentences", "select doc_id, sentence, count(*) n from fx_sentences group by 1, 2")
def _(t):
    return w.sentence_rows(t.texts, "doc_id", "text").groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n"))


@query("x8_word_windows", """select doc_id, count(*) n_windows, cast(sum(length(t)) as bigint) chars, min(t) first_window from (
       select doc_id, array_to_string(q[s + 1: s + 25], ' ') t from (select doc_id, list_transform(p, lambda x: regexp_extract(x, '\\S+')) q,
         unnest(range(0, greatest(n - 25, 0) + 1, 15)) s from fx_pieces_of)) group by 1""")
def _(t):
    window = F.col("window")
    return (t.texts.select("doc_id", F.explode(w.word_windows(F.col("text"))).alias("window")).groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("n_windows"), F.sum(F.length(window)).alias("chars"), F.min(window).alias("first_window")))


@query("x9_prefixes", """select conv_id, turn, s n_tokens, array_to_string(q[1: s], ' ') prefix from (
       select conv_id, turn, regexp_extract_all(text, '\\S+') q, unnest(range(1, len(regexp_extract_all(text, '\\S+')) + 1)) s from conversations)""")
def _(t):
    return (t.conversations.select("conv_id", "turn", F.posexplode(w.prefixes(F.col("text"))).alias("i", "prefix"))
            .select("conv_id", "turn", (F.col("i") + 1).cast("long").alias("n_tokens"), "prefix"))


@query("x10_item_sentences", r"""select doc_id, count(*) n, cast(sum(length(s)) as bigint) chars from (
       select doc_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') s from (select doc_id, unnest(string_split(regexp_replace(concat_ws(chr(10),
         nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), ''), lang, source), '([.!?])\s+', '\1' || chr(0), 'g'), chr(0))) raw from documents)) where s <> '' group by 1""")
def _(t):
    return (t.texts.select("doc_id", F.explode(w.item_sentences(F.array("text"), F.array("lang", "source"))).alias("s"))
            .groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).alias("chars")))


@query("x11_text_stats", r"select doc_id, length(text) n_characters, len(regexp_extract_all(text, '\S+')) n_words from documents")
def _(t):
    return t.texts.select("doc_id", F.length("text").cast("long").alias("n_characters"), word_count(F.col("text")).cast("long").alias("n_words"))


def count_model():
    return lambda texts: [[len(x), len(x.split())] for x in texts]


@query("x12_pooled_chunks", r"""select doc_id, count(*) n_chunks, cast(sum(length(sentence)) as double) chars,
       cast(sum(len(regexp_extract_all(sentence, '\S+'))) as double) n_words from fx_sentences group by 1""")
def _(t):
    chunks = t.texts.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("chunk_index", "chunk"))
    return (w.embed_chunks(chunks, ["doc_id", "chunk_index"], "chunk", count_model).groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.col("embedding")[0]).alias("chars"), F.sum(F.col("embedding")[1]).alias("n_words")))


@query("u4_splitter", r"""select doc_id, len(ls) n_chunks, cast(coalesce(list_sum(list_transform(ls, lambda l: length(l))), 0) as double) chars, ls[1] as first_chunk, length(ls[1])::double as first_chars
       from (select doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ ]')) ls from documents)""")
def _(t):
    # lines instead of sentences
    by_line = lambda text: F.filter(F.split(text, "\n"), lambda l: l.rlike("[^ ]"))
    d = w.embed_documents(t.texts, "doc_id", "text", count_model, by_line)
    return d.select("doc_id", F.size("chunks").cast("long").alias("n_chunks"), F.aggregate("embeddings", F.lit(0.0), lambda a, v: a + v[0]).alias("chars"),
                    F.try_element_at("chunks", F.lit(1)).alias("first_chunk"), F.try_element_at("embeddings", F.lit(1))[0].alias("first_chars"))


@query("x13_clusters_to_mentions", """select doc_id, cluster, cast(i as int) mention_index, substr(text, a + 1, 4) mention, cast(a + shift as int) start,
       cast(a + shift + length(substr(text, a + 1, 4)) as int) "end", substr(text, a + shift + 1, length(substr(text, a + 1, 4))) = substr(text, a + 1, 4) in_place from (
       select doc_id, text, 'c1' cluster, 0 i, 0 a, 0 shift from documents union all
       select doc_id, text, 'c1', 1, length(text) // 2, case when doc_id % 5 = 0 then 3 else 0 end from documents union all
       select doc_id, text, 'c2', 0, greatest(length(text) - 4, 0), 0 from documents) where text is not null""")
def _(t):
    # mentions at the start, in the middle and at the end of every text; the middle one of every fifth text points elsewhere
    text = F.col("text")

    def mention(at, shift):
        word = F.substring(text, at + 1, F.lit(4))
        return F.struct(word.alias("text"), (at + shift).cast("int").alias("start"), (at + shift + F.length(word)).cast("int").alias("end"))
    wrong = F.when(F.col("doc_id") % 5 == 0, 3).otherwise(0)
    middle, last = F.floor(F.length(text) / 2).cast("int"), F.greatest(F.length(text) - 4, F.lit(0))
    answer = F.to_json(F.struct(F.array(
        F.struct(F.lit("c1").alias("id"), F.array(mention(F.lit(0), F.lit(0)), mention(middle, wrong)).alias("mentions")),
        F.struct(F.lit("c2").alias("id"), F.array(mention(last, F.lit(0))).alias("mentions"))).alias("clusters")))
    return w.cluster_mentions(t.texts.where(text.isNotNull()).select("doc_id", "text", answer.alias("answer")), "doc_id", "text", "answer")
