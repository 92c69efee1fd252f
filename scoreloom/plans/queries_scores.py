"""Queries from item scores to totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions.values import round_binary_sql
from scoreloom.operators import rubric as ru
from scoreloom.plans.fixtures import RUBRIC
from scoreloom.plans.registry import query

SECTIONS = """select e.evaluation_id, s.s1, s.s2, s.s3 from fx_evaluations e left join (
    select evaluation_id, sum(score) filter (section_key = 's1') / count(score) filter (section_key = 's1') s1,
      sum(score) filter (section_key = 's2') / count(score) filter (section_key = 's2') s2,
      sum(score) filter (section_key = 's3') / count(score) filter (section_key = 's3') s3 from fx_item_scores group by 1) s
    on e.evaluation_id = s.evaluation_id"""
LIVE = "(case when s1 is null then 0e0 else 30e0 end + case when s2 is null then 0e0 else 30e0 end + case when s3 is null then 0e0 else 40e0 end)"
SCALE = f"(case when {LIVE} > 0 then 100e0 / {LIVE} else 0e0 end)"
RAW = f"""select *, (0e0 + coalesce(30e0 * {SCALE} * s1 / 5e0, 0e0) + coalesce(30e0 * {SCALE} * s2 / 5e0, 0e0)
    + coalesce(40e0 * {SCALE} * s3 / 5e0, 0e0)) * 1e0 raw from ({SECTIONS})"""
TOTALS = f"""select evaluation_id, s1, s2, s3, score_before_caps, cap_applied, total_score,
      case when total_score >= 80 then 'A' when total_score >= 65 then 'B' when total_score >= 50 then 'C' when total_score >= 35 then 'D' else 'F' end grade,
      n_red_flags from (
    select r.*, {round_binary_sql('raw', 2)} score_before_caps, case when raw > cap then cap end cap_applied,
      {round_binary_sql('least(raw, coalesce(cap, raw))', 1)} total_score, coalesce(n_red_flags, 0) n_red_flags
    from ({RAW}) r left join (select evaluation_id, min(cap) cap, cast(count(*) as int) n_red_flags from fx_flags group by 1) f
      on r.evaluation_id = f.evaluation_id)"""


def rounded(keys):
    return ", ".join(f"round({k}, 9) {k}" for k in keys)


@query("e8_section_scores", f"select evaluation_id, {rounded(['s1', 's2', 's3'])} from ({SECTIONS})")
def _(t):
    means = t.evaluations.select("evaluation_id").join(ru.section_means(t.item_scores, RUBRIC), "evaluation_id", "left")
    return means.select("evaluation_id", *[F.round(k, 9).alias(k) for k in ("s1", "s2", "s3")])


@query("e9_weighted_total", f"select evaluation_id, round(raw, 9) raw_total from ({RAW})")
def _(t):
    means = t.evaluations.select("evaluation_id").join(ru.section_means(t.item_scores, RUBRIC), "evaluation_id", "left")
    return means.select("evaluation_id", F.round(ru.weighted_total(RUBRIC), 9).alias("raw_total"))


@query("e10_caps_grade", f"select evaluation_id, {rounded(['s1', 's2', 's3'])}, score_before_caps, cap_applied, total_score, grade, n_red_flags from ({TOTALS})")
def _(t):
    s = ru.score_evaluations(t.evaluations.select("evaluation_id"), t.item_scores, t.flags, RUBRIC)
    return s.select("evaluation_id", *[F.round(k, 9).alias(k) for k in ("s1", "s2", "s3")], "score_before_caps", "cap_applied",
                    "total_score", "grade", "n_red_flags")
