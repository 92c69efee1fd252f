"""Queries that validate texts.

Texts that restate labelled values are written from the prompts: the prompt number decides the
format, the values, and one flaw, so the checking SQL can state which issue must be found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import matchers as m
from scoreloom.functions.running import cuttings
from scoreloom.functions.text import fold, strip, word_count
from scoreloom.functions.values import fence
from scoreloom.operators import checks as c
from scoreloom.operators import extraction as ex
from scoreloom.operators import vocabularies as voc
from scoreloom.plans.fixtures import SQL_VIEWS
from scoreloom.plans.registry import query

NAMES = ["Red Fox", "Blue Moon", "Green Tower", "Golden Sun", "Black Stone", "White River"]
VALUES = m.QualifiedVocabulary({"Red Fox": ["Crimson Fox"], **{n: [] for n in NAMES[1:]}})
LABELS = ex.Labels(["Topic", "Main Cause/Origin", "Outcome"])
ALL_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"


def value_of(n, j: int, turned=None):
    base = F.element_at(F.array(*[F.lit(x) for x in NAMES]), ((n + j) % 6 + 1).cast("int"))
    return F.when((n + j) % 2 == 1 if turned is None else turned, F.concat(base, F.lit(" reversed"))).otherwise(base)


SQL_VIEWS["fx_restated"] = f"""
    select n, n % 4 fmt, n // 4 % 8 flaw, v[1] v1, v[2] v2, v[3] v3, v[4] other, case when (n + 1) % 2 = 1 then b[2] else concat(b[2], ' reversed') end flipped, b
    from (select n, list_transform([0, 1, 2, 3], lambda j: {ALL_SQL}[(n + j) % 6 + 1]) b,
      list_transform([0, 1, 2, 3], lambda j: concat({ALL_SQL}[(n + j) % 6 + 1], case when (n + j) % 2 = 1 then ' reversed' else '' end)) v from fx_prompts)"""


def restated(t) -> DataFrame:
    """(n, text, expected): three labelled values per prompt, one of them flawed in one of eight ways."""
    n = F.col("n")
    fmt, flaw = n % 4, F.floor(n / 4) % 8
    # what a one-word crimson is written as: an alias now and then
    said = lambda v: F.when(n % 5 == 0, F.replace(v, F.lit("Red Fox"), F.lit("crimson fox"))).otherwise(v)

    def line(number: int, label: str, value):
        value = said(value)
        return (F.when(fmt == 0, F.concat(F.lit(f"{number}. {label}: "), value, F.lit(" - details here\n")))
                .when(fmt == 1, F.concat(F.lit(f"**{label} — "), value, F.lit(":** details here\n")))
                .when(fmt == 2, F.concat(F.lit(f"### {label}\n\n"), value, F.lit(" stands here\n")))
                .otherwise(F.concat(F.lit(f"- the {label.lower()} ("), value, F.lit(") details here\n"))))

    v1, v2, v3, other = value_of(n, 0), value_of(n, 1), value_of(n, 2), value_of(n, 3)
    name = "Main Cause/Origin"
    second = (F.when(flaw.isin(1, 4, 5), "").when(flaw == 2, line(2, name, other)).when(flaw == 3, line(2, name, value_of(n, 1, (n + 1) % 2 == 0)))
              .when(flaw == 6, F.when(fmt == 2, f"### {name}\n\nsomething vague\n").otherwise(f"{name}: something vague\n"))
              .when(flaw == 7, F.concat(line(2, name, v2), F.lit("Origin: "), other, F.lit("\n"))).otherwise(line(2, name, v2)))
    first, third = line(1, "Topic", v1), line(3, "Outcome", v3)
    lines = F.when(n % 3 == 2, F.concat(third, second, first)).otherwise(F.concat(first, second, third))
    prose = (F.when(flaw == 4, F.concat(F.lit("It is the main cause that brings "), v2, F.lit(". And so on.")))
             .when(flaw == 5, F.concat(F.lit("Think of "), v2, F.lit(" again."))).otherwise("All in all a fine day."))
    expected = F.array(*[F.struct(F.lit(label).alias("label"), v.alias("value")) for label, v in (("Topic", v1), (name, v2), ("Outcome", v3))])
    # only numbers travel; the texts are written and checked where they arrive
    numbers = t.prompts.select("n").repartition(t.spark.sparkContext.defaultParallelism)
    made = numbers.select("n", F.concat(F.lit("Here is what I see.\n\n"), lines, F.lit("\n"), prose).alias("text"), expected.alias("expected"),
                            F.when(n % 7 == 0, "length").otherwise("stop").alias("finish_reason"))
    return fence(made, ["text", "expected", "finish_reason"])


@query("v1_non_empty", r"""select doc_id, len(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 60 too_short from documents""")
def _(t):
    return t.texts.select("doc_id", (F.size(c.non_empty(F.col("text"), 60)) > 0).alias("too_short"))


@query("v2_not_truncated", "select response_id, coalesce(finish_reason = 'length', false) truncated from fx_responses")
def _(t):
    return t.responses.select("response_id", (F.size(c.not_truncated(F.col("finish_reason"))) > 0).alias("truncated"))


@query("v3_regex_required", r"""
       select page_id, 'missing_pattern' code, 'heading' as label, 'not found' message from pages where not regexp_matches(html, '(?i)<h[1-3]>') union all
       select page_id, 'forbidden_pattern', 'script', regexp_extract(html, '(?i)<script[^>]*>') from pages where regexp_matches(html, '(?i)<script[^>]*>')""")
def _(t):
    found = c.regex_check(F.col("html"), required={"heading": "<h[1-3]>"}, forbidden={"script": "<script[^>]*>"})
    return t.pages.select("page_id", F.explode(found).alias("i")).select("page_id", "i.code", "i.label", "i.message")


@query("v4_no_refusal", """select doc_id, 'cannot_help' as label from documents where doc_id % 7 = 0 union all
       select doc_id, 'as_an_ai' from documents where doc_id % 7 = 1""")
def _(t):
    text = F.concat("text", F.when(F.col("doc_id") % 7 == 0, " I'm sorry, but I can't help with that.").when(
        F.col("doc_id") % 7 == 1, " As an AI language model I pass.").otherwise(""))
    return t.texts.select("doc_id", F.explode(c.no_refusal(text)).alias("i")).select("doc_id", "i.label")


@query("v5_normalize_line", r"""
       select doc_id, line, count(*) n from (select doc_id, regexp_replace(regexp_replace(regexp_replace(raw, '\*\*|__|[*`]|^\s*#{1,6}\s*|^\s*>\s*', '', 'g'),
         '^\s*(?:[-•+]|\(?\d{1,2}[.):])\s+', ''), '^\s+|\s+$', '', 'g') line from (select doc_id, unnest(string_split(text, chr(10))) raw from documents)) group by 1, 2""")
def _(t):
    lines = F.explode(F.split("text", ex.LINE_BREAK))
    return (t.texts.select("doc_id", lines.alias("raw")).groupBy("doc_id", ex.normalize_line(F.col("raw")).alias("line"))
            .agg(F.count(F.lit(1)).alias("n")))


WORDS = m.Vocabulary({"the": ["le", "der", "die"], "and": ["et", "und"], "of": ["de", "des", "von"]})
SQL_VIEWS["fx_words"] = r"""
    select doc_id, pos, case when w in ('the', 'le', 'der', 'die') then 'the' when w in ('and', 'et', 'und') then 'and' else 'of' end named from (
      select doc_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}'']+'))) w,
        generate_subscripts(regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}'']+'), 1) pos from documents)
    where w in ('the', 'le', 'der', 'die', 'and', 'et', 'und', 'of', 'de', 'des', 'von')"""


@query("v6_vocab_find", "select d.doc_id, w.named from documents d left join (select doc_id, arg_min(named, pos) named from fx_words group by 1) w on d.doc_id = w.doc_id")
def _(t):
    return t.texts.select("doc_id", WORDS.find(F.col("text")).alias("named"))


@query("v7_vocab_find_all", """select doc_id, named, count(*) n, cast(sum(place) as bigint) place from (
       select doc_id, named, pos, row_number() over (partition by doc_id order by pos) place from fx_words) group by 1, 2""")
def _(t):
    # positions ascend, so the order of the mentions is the order of their positions
    placed = F.transform(WORDS.find_all(F.col("text")), lambda f: F.struct(f["position"].alias("position"), f["value"].alias("value")))
    found = t.texts.select("doc_id", F.posexplode(F.array_sort(placed)).alias("i", "f"))
    return found.groupBy("doc_id", F.col("f.value").alias("named")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("i") + 1).alias("place"))


@query("v7_positions", r"""select doc_id, case when lower(w) in ('the', 'le', 'der', 'die') then 'the' when lower(w) in ('and', 'et', 'und') then 'and' else 'of' end as value,
       cast(e - length(w) as int) as position, substr(text, cast(e - length(w) + 1 as bigint), 3) there from (
         select doc_id, text, regexp_extract(piece, '[\p{L}\p{M}\p{N}\p{Pc}'']+$') w, sum(length(piece)) over (partition by doc_id order by pos) e from (
           select doc_id, text, unnest(regexp_extract_all(text, '[^\p{L}\p{M}\p{N}\p{Pc}'']*[\p{L}\p{M}\p{N}\p{Pc}'']+')) piece,
             generate_subscripts(regexp_extract_all(text, '[^\p{L}\p{M}\p{N}\p{Pc}'']*[\p{L}\p{M}\p{N}\p{Pc}'']+'), 1) pos from documents))
       where lower(w) in ('the', 'le', 'der', 'die', 'and', 'et', 'und', 'of', 'de', 'des', 'von')""")
def _(t):
    text = F.col("text")
    # what stands there is cut out beside the text: a substring of a mention's row reads the text up to it
    found = fence(t.texts.select("doc_id", "text", WORDS.find_all(text).alias("f")), ["f"]).withColumn("there", cuttings(text, F.col("f.position"), F.lit(3)))
    return found.select("doc_id", F.explode(F.arrays_zip("f", "there")).alias("m")).select("doc_id", "m.f.value", "m.f.position", "m.there")


@query("v7_vocabulary_table", r"""with recursive v as (select distinct replace(lower(array_to_string(string_split(trim(regexp_replace(text, '[ 	

]+', ' ', 'g')), ' ')[1:k], ' ')), 'ß', 'ss') as alias
         from documents, range(1, 4) r(k) where len(string_split(trim(regexp_replace(text, '[ 	

]+', ' ', 'g')), ' ')) >= k),
       p as (select doc_id, piece, regexp_extract(piece, '([\p{L}\p{M}\p{N}\p{Pc}'']+|[^\p{L}\p{M}\p{N}\p{Pc}'' 	

])$') tok, pos, cast(sum(length(piece)) over (partition by doc_id order by pos) as bigint) e, lead(piece) over (partition by doc_id order by pos) behind from (
         select doc_id, unnest(ps) piece, generate_subscripts(ps, 1) pos from (select doc_id, regexp_extract_all(text, '[ 	

]*([\p{L}\p{M}\p{N}\p{Pc}'']+|[^\p{L}\p{M}\p{N}\p{Pc}'' 	

])') ps from documents))),
       s as (select doc_id, pos, e - length(tok) as start, piece = tok and coalesce(regexp_matches(lag(tok) over (partition by doc_id order by pos), '[\p{L}\p{M}\p{N}\p{Pc}'']'), false) glued, tok, piece, e from p),
       longest as (select max(length(alias)) m from v),
       c as (select s.doc_id, s.start, s.pos, q.e as upto, q.pos as last from s join s q on s.doc_id = q.doc_id and q.pos between s.pos and s.pos + 24 where not s.glued and q.e - s.start <= (select m from longest)),
       g as (select c.doc_id, c.start, c.upto, replace(lower(substr(d.text, c.start + 1, c.upto - c.start)), 'ß', 'ss') said, substr(d.text, c.upto + 1, 1) behind from c join documents d on c.doc_id = d.doc_id),
       m as (select doc_id, start, max(upto) upto from g join v on said = alias where not regexp_matches(behind, '[\p{L}\p{M}\p{N}\p{Pc}'']') group by 1, 2),
       walk as (select doc_id, min(start) start from m group by 1 union all
                select w.doc_id, (select min(n.start) from m n where n.doc_id = w.doc_id and n.start >= x.upto) from walk w join m x on x.doc_id = w.doc_id and x.start = w.start where w.start is not null)
       select m.doc_id, replace(lower(substr(d.text, m.start + 1, m.upto - m.start)), 'ß', 'ss') as value, cast(m.start as int) as position, cast(m.upto - m.start as int) as length
       from walk w join m on m.doc_id = w.doc_id and m.start = w.start join documents d on d.doc_id = m.doc_id""")
def _(t):
    # the vocabulary: how the documents themselves begin, one to three words
    words = F.split(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")), " ")
    begun = t.documents.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size(words))), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))).alias("alias"))
    vocabulary = begun.select("alias", fold(F.col("alias")).alias("value"))
    return voc.table_mentions(t.documents, "doc_id", "text", vocabulary).select("doc_id", "value", "position", "length")


@query("v8_state_mentions", """select n, v1 || '|' || b[2] || ' reversed|' || b[3] mentions from fx_restated""")
def _(t):
    n, base = F.col("n"), lambda j: value_of(F.col("n"), j, F.lit(False))
    text = F.concat(value_of(n, 0), F.lit(". The reversed "), base(1), F.lit(" rests; "), base(2), F.lit(" is not reversed."))
    return t.prompts.select("n", F.array_join(VALUES.mentions(text), "|").alias("mentions"))


@query("v9_loose_aliases", """select p_partkey, case when p_partkey % 2 = 0 then p_name end bare,
       case when p_partkey % 2 = 1 then concat('2 of ', p_name) end digits from part""")
def _(t):
    value = F.concat(F.when(F.col("p_partkey") % 2 == 0, "The ").otherwise("Two of "), F.col("p_name"))
    aliases = m.loose_aliases(value)
    return t.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.try_element_at(aliases, F.lit(1))).alias("bare"),
                         F.when(F.col("p_partkey") % 2 == 1, F.try_element_at(aliases, F.lit(1))).alias("digits"))


@query("v10_label_aliases", """select c_custkey, concat(c_mktsegment, ' / ', c_name, '|', c_mktsegment, '|', c_name) aliases,
       lower(regexp_replace(concat(c_mktsegment, c_name), '[^A-Za-z0-9]', '', 'g')) key from customer""")
def _(t):
    label = F.concat_ws(" / ", "c_mktsegment", "c_name")
    return t.customer.select("c_custkey", F.array_join(m.label_aliases(label), "|").alias("aliases"),
                             m.label_key(F.concat_ws(" and ", "c_mktsegment", "c_name")).alias("key"))


@query("v11_extract_lines", """
       select n, 'Topic' as label, v1 as value from fx_restated union all select n, 'Outcome', v3 from fx_restated union all
       select n, 'Main Cause/Origin', case flaw when 2 then other when 3 then flipped when 6 then null else v2 end from fx_restated where flaw not in (1, 4, 5) union all
       select n, 'Main Cause/Origin', other from fx_restated where flaw = 7""")
def _(t):
    return (restated(t).select("n", F.explode(ex.extract_lines(F.col("text"), LABELS, VALUES)).alias("e")).select("n", "e.label", "e.value"))


@query("v12_extract_inline", """select n, 'Topic' as label, v1 as value, cast(1 as int) line from fx_restated where n % 3 = 0""")
def _(t):
    n = F.col("n")
    gap = F.when(n % 3 == 0, " now shows ").when(n % 3 == 1, " which we have been looking at for a very long time shows ").otherwise(" is here. Now ")
    text = F.concat(F.lit("Some words first.\nIn the topic"), gap, value_of(n, 0), F.lit(" and nothing else."))
    return (t.prompts.select("n", F.explode(ex.extract_inline(text, LABELS, VALUES)).alias("e")).select("n", "e.label", "e.value", "e.line"))


@query("v13_co_mentions", """
       select n, 'Topic' as label, v1 as value from fx_restated where fmt <> 2 union all select n, 'Outcome', v3 from fx_restated where fmt <> 2 union all
       select n, 'Main Cause/Origin', case flaw when 2 then other when 3 then flipped else v2 end from fx_restated where flaw not in (1, 4, 5, 6) and fmt <> 2 union all
       select n, 'Main Cause/Origin', other from fx_restated where flaw = 7 union all select n, 'Main Cause/Origin', v2 from fx_restated where flaw = 4""")
def _(t):
    return (restated(t).select("n", F.explode(ex.co_mentions(F.col("text"), LABELS, VALUES)).alias("s"))
            .select("n", F.explode("s.labels").alias("label"), "s.values").select("n", "label", F.explode("values").alias("value")))


ISSUES = """
    select n, case flaw when 1 then 'missing_label' when 2 then 'wrong_value' when 3 then 'qualifier_mismatch' when 5 then 'unlabeled_value'
      when 6 then 'missing_value' else 'conflicting_entries' end code, case when flaw in (5, 7) then 'warning' else 'error' end severity,
      'Main Cause/Origin' as label from fx_restated where flaw not in (0, 4) union all
    select n, 'out_of_order', 'warning', null from fx_restated where n % 3 = 2"""


def positions_check():
    return ex.labeled_values(F.col("text"), F.col("expected"), LABELS, VALUES, check_order=True, unlabeled="warning")


@query("v14_labeled_values", ISSUES)
def _(t):
    return (restated(t).select("n", F.explode(positions_check()).alias("i")).select("n", "i.code", "i.severity", "i.label"))


@query("v15_comparators", """select n, case when n % 3 = 0 then null else 'value_mismatch' end exact,
       case n % 3 when 0 then null when 1 then 'wrong_value' else 'qualifier_mismatch' end qualified from fx_restated""")
def _(t):
    n = F.col("n")
    want = value_of(n, 0)
    got = F.when(n % 3 == 0, F.upper(F.substring(want, 1, 4))).otherwise(F.substring(want, 1, 4))
    got = F.concat(got, F.substring(want, F.lit(5), F.length(want)))
    got = F.when(n % 3 == 1, value_of(n, 1)).when(n % 3 == 2, value_of(n, 0, n % 2 == 0)).otherwise(got)
    return t.prompts.select("n", m.Vocabulary(NAMES).compare(want, got).alias("exact"), VALUES.compare(want, got).alias("qualified"))


@query("v16_foreign_values", "select n, b[4] message from fx_restated where flaw in (2, 7)")
def _(t):
    wanted = F.transform("expected", lambda e: e["value"])
    return (restated(t).select("n", F.explode(c.foreign_values(F.col("text"), VALUES, wanted)).alias("i")).select("n", "i.message"))


SPREAD = f"""
    select n, 'positions' as "check", code, severity, label from ({ISSUES}) union all
    select n, 'not_truncated', 'truncated', 'error', null from fx_restated where n % 7 = 0 union all
    select n, 'foreign_values', 'foreign_value', 'warning', null from fx_restated where flaw in (2, 7)"""


def spread_checks() -> dict:
    """The composite check of a text with labelled values."""
    return {**c.named_checks({"non_empty": {"min_chars": 40}, "not_truncated": {}, "no_refusal": {}}), "positions": positions_check(),
            "foreign_values": c.foreign_values(F.col("text"), VALUES, F.transform("expected", lambda e: e["value"]))}


def checked(t) -> DataFrame:
    return c.verdict(c.run_checks(restated(t), spread_checks(), trusted=list(spread_checks())))


@query("v21_run_checks", """select doc_id, 'error' severity, 'check_crashed' code from documents where doc_id % 10 = 3 union all
       select doc_id, 'warning', 'word_count' from documents where len(regexp_extract_all(text, '\\S+')) not between 50 and 400""")
def _(t):
    # a check in Python that fails on some rows must not stop the others
    def fragile(doc_id, lang):
        if doc_id % 10 == 3:
            raise ValueError(lang)
        return []
    ran = c.run_checks(t.texts, {"words": c.word_count_between(F.col("text"), 50, 400), "fragile": c.python_check(fragile)(F.col("doc_id"), F.col("lang"))})
    return c.issue_rows(ran, "doc_id").select("doc_id", "severity", "code")


@query("v21_columns", r"""with w as (select doc_id, len(regexp_extract_all(text, '\S+')) n, doc_id % 5 d from documents)
       select doc_id, 'error' severity, 'check_crashed' code from w where d in (0, 3) union all select doc_id, 'warning', 'many' from w where d <> 0 and n / d > 40""")
def _(t):
    # expressions that raise for some rows: a division by zero, a text that is no number, and one that never does
    n, d = word_count(F.col("text")), F.col("doc_id") % 5
    many = c.issue_if(n / d > 40, c.issue("many", "warning"))
    number = c.issue_if(F.when(d == 3, F.lit("three")).otherwise("3").cast("int") > 5, c.issue("large", "error"))
    own = c.issue_if(F.when(d < 0, F.raise_error(F.lit("never"))).cast("boolean"), c.issue("odd", "error"))
    ran = c.run_checks(t.texts, {"many": many, "number": number, "own": own})
    return c.issue_rows(ran, "doc_id").select("doc_id", "severity", "code")


JUDGED = """select response_id, n, case when n % 6 = 5 then 'ValueError: odd request' end error, case when n % 6 in (4, 5) then null else completion_tokens % 3 <> 0 end passed,
         cast(completion_tokens as varchar) tokens from fx_responses where error is null"""


def fussy(limit: int):
    """A validator that has no verdict on some requests and fails on others."""
    def validate(response: dict, request: dict) -> dict:
        if request["n"] % 6 == 5:
            raise ValueError("odd request")
        said = {"tokens": response["completion_tokens"], "note": None}
        return said if request["n"] % 6 == 4 else said | {"passed": response["completion_tokens"] % limit != 0}
    return validate


@query("u6_validate", f"select response_id, cast(1 as int) as version, passed, error, case when error is null then tokens end tokens from ({JUDGED})")
def _(t):
    judged = c.validate_responses(t.responses.select("response_id", "request_id", "error", "completion_tokens"), t.requests, fussy(3), 1)
    return judged.select("response_id", "version", "passed", "error", F.try_element_at("details", F.lit("tokens")).alias("tokens"))


@query("u6_revalidate", f"select response_id, cast(case when n % 4 = 0 then 2 else 3 end as int) as version, case when n % 4 = 0 then true else passed end passed from ({JUDGED})")
def _(t):
    # old verdicts of two versions; the third validator judges what the second has not
    responses = t.responses.select("response_id", "request_id", "error", "completion_tokens")
    good = responses.where("error is null").join(t.requests.select("request_id", "n"), "request_id")
    old = lambda rows, version: rows.select("response_id", F.lit(version).alias("version"), F.lit(True).alias("passed"), F.lit(None).cast("string").alias("error"),
                                            F.create_map().cast("map<string,string>").alias("details"))
    stored = old(good, 1).unionByName(old(good.where("n % 4 = 0"), 2))
    new = c.revalidate(stored, responses, t.requests, fussy(3), 2).withColumn("version", F.lit(3))
    return c.current_validations(stored.unionByName(new)).select("response_id", "version", "passed")


@query("v22_verdict", f"""select r.n, count(*) filter (severity = 'error') = 0 passed, cast(count(*) filter (severity = 'error') as int) n_errors,
       cast(count(*) filter (severity = 'warning') as int) n_warnings from fx_restated r left join ({SPREAD}) s on r.n = s.n group by 1""")
def _(t):
    return checked(t).select("n", "passed", "n_errors", "n_warnings")


@query("v22_check_details", r"""with d as (select doc_id, len(regexp_extract_all(text, '\S+')) words, len(regexp_replace(text, '^\s+|\s+$', '', 'g')) size from documents)
       select doc_id, 'words' as "check", true passed, cast(words as varchar) fact from d union all
       select doc_id, 'long', coalesce(size, 0) >= 300, cast(size as varchar) from d union all select doc_id, 'not_truncated', true, null from d""")
def _(t):
    # a word count out of range is a warning only, so that check passes all the same
    text = F.col("text")
    ran = c.run_checks(t.texts, {"words": c.word_count_between(text, 50, 400), "long": c.non_empty(text, 300), "not_truncated": c.not_truncated(F.lit("stop"))})
    facts = {"words": {"fact": word_count(text)}, "long": {"fact": F.length(strip(text))}, "not_truncated": {}}
    return (c.check_results(ran, facts).select("doc_id", F.explode("checks").alias("r"))
            .select("doc_id", "r.check", "r.passed", F.try_element_at("r.details", F.lit("fact")).alias("fact")))


@query("v22_labelled", """
       select n, 'Topic' as label, v1 as expected, v1 as found, 'line' as mode from fx_restated union all select n, 'Outcome', v3, v3, 'line' from fx_restated union all
       select n, 'Main Cause/Origin', v2, case flaw when 1 then null when 2 then other when 3 then flipped when 5 then null when 6 then null else v2 end,
         case when flaw in (1, 5) then null when flaw = 4 then 'inline' else 'line' end from fx_restated""")
def _(t):
    # what the labelled-value check expected and read, and how
    report = ex.labeled_report(F.col("text"), F.col("expected"), LABELS, VALUES, check_order=True, unlabeled="warning")
    facts = fence(restated(t).select("n", report["facts"].alias("facts")), ["facts"])
    return facts.select("n", F.explode("facts").alias("f")).select("n", "f.label", "f.expected", "f.found", "f.mode")


@query("v23_issue_rows", f"select n, \"check\", code, severity, label from ({SPREAD})")
def _(t):
    return c.issue_rows(checked(t), "n").select("n", "check", "code", "severity", "label")


@query("v23_summary_rows", """select response_id, error is null ok, case when error is null then coalesce(finish_reason <> 'length', true) end as valid,
       cast(case when finish_reason = 'length' then 1 else 0 end as int) n_errors, cast(0 as int) n_warnings, error from fx_responses""")
def _(t):
    judged = c.verdict(c.run_checks(t.responses, {"not_truncated": c.not_truncated(F.col("finish_reason"))}))
    return c.summary_rows(judged, "response_id")


@query("v24_issue_counts", f"""select severity, code, label, count(*) n from ({SPREAD}) group by 1, 2, 3""")
def _(t):
    return c.issue_counts(c.issue_rows(checked(t), "n"), ["severity", "code", "label"])


@query("v25_named_checks", r"""select doc_id, len(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 300 flagged from documents""")
def _(t):
    # the configured check takes the place of the custom one of its name
    checks = c.named_checks({"non_empty": {"min_chars": 300}}, {"non_empty": c.non_empty(F.col("text"), 1)})
    return c.run_checks(t.texts, checks).select("doc_id", (F.size("issues") > 0).alias("flagged"))


@query("v26_word_count_check", r"""select doc_id, cast(len(regexp_extract_all(text, '\S+')) as varchar) message from documents
       where len(regexp_extract_all(text, '\S+')) not between 40 and 120""")
def _(t):
    return t.texts.select("doc_id", F.explode(c.word_count_between(F.col("text"), 40, 120)).alias("i")).select("doc_id", "i.message")


@query("v27_spread_validator", f"""select passed, n_errors, n_warnings, count(*) n from (select r.n, count(*) filter (severity = 'error') = 0 passed,
       cast(count(*) filter (severity = 'error') as int) n_errors, cast(count(*) filter (severity = 'warning') as int) n_warnings
       from fx_restated r left join ({SPREAD}) s on r.n = s.n group by 1) group by 1, 2, 3""")
def _(t):
    return checked(t).groupBy("passed", "n_errors", "n_warnings").agg(F.count(F.lit(1)).alias("n"))


@query("v28_expected_path", """select event_id, case when event_id % 3 = 0 then cast(json_extract(props, '$.k') as int) when event_id % 3 = 1 then 7 end expected,
       event_id % 3 = 2 missing from events""")
def _(t):
    # the response carries its own metadata on every third row, else the request has it, or nobody
    i = F.col("event_id")
    own = F.try_parse_json(F.when(i % 3 == 0, F.concat(F.lit('{"input":'), F.col("props"), F.lit("}"))).otherwise("{}"))
    asked = F.try_parse_json(F.when(i % 3 == 1, '{"input":{"k":7}}').otherwise("{}"))
    value = c.expected_path(own, asked, "$.input.k", "int")
    return t.events.select("event_id", value.alias("expected"), value.isNull().alias("missing"))


@query("u2_free_text", r"""select doc_id, nullif(substr(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^["'']+|["'']+$', '', 'g'), 1, 200), '') as value from documents""")
def _(t):
    return t.texts.select("doc_id", m.FreeText().find(F.col("text")).alias("value"))
