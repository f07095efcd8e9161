"""Queries for judge-output parsing, filtering and summaries (pipeline B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judge as J
from ..session import fresh_path
from ..sources.fixtures import fixture
from ..sources.tables import read_table
from .oracle_values import DIMENSIONS, SCORE_KEYS
from .q_pages import _strip
from .registry import oracle, register

_KEY_CASE = "CASE " + " ".join(f"WHEN contains(l, '{k}:') THEN '{k}'" for k in SCORE_KEYS) + " END"
_NUM = r"\d+\.?\d*"

_SCORES_SQL = f"""
WITH l0 AS (SELECT entry_id, string_split(upper(evaluation_text), chr(10)) AS ls FROM fx_evaluations),
l1 AS (SELECT entry_id, {_strip('unnest(ls)')} AS l, generate_subscripts(ls, 1) AS i FROM l0),
l2 AS (SELECT *, {_KEY_CASE} AS k FROM l1),
l3 AS (SELECT entry_id, k, max_by(l, i) AS l FROM l2 WHERE k IS NOT NULL GROUP BY entry_id, k),
sc AS (SELECT entry_id, k,
         CASE WHEN regexp_extract(l, '{_NUM}') = '' OR TRY_CAST(regexp_extract(l, '{_NUM}') AS DOUBLE) IS NULL THEN 0.0
              ELSE least(10.0, greatest(1.0, TRY_CAST(regexp_extract(l, '{_NUM}') AS DOUBLE))) END AS v,
         {_strip("replace(l, 'REASON:', '')")} AS reason FROM l3),
pv AS (SELECT e.entry_id, """ + ", ".join(
    f"coalesce(max(v) FILTER (WHERE k = '{k}'), 0.0) AS {k.lower()}" for k in SCORE_KEYS[:-1]) + """,
         coalesce(max(reason) FILTER (WHERE k = 'REASON'), '') AS reason
       FROM fx_evaluations e LEFT JOIN sc ON sc.entry_id = e.entry_id GROUP BY e.entry_id),
pz AS (SELECT *, """ + " + ".join(f"CASE WHEN {d} > 0 THEN {d} ELSE 0.0 END" for d in DIMENSIONS) + """ AS tot,
              """ + " + ".join(f"CASE WHEN {d} > 0 THEN 1 ELSE 0 END" for d in DIMENSIONS) + """ AS n FROM pv),
js AS (SELECT entry_id, """ + ", ".join(DIMENSIONS) + """,
         CASE WHEN overall = 0 THEN CASE WHEN n > 0 THEN round_even(tot / n, 1) ELSE 0.0 END ELSE overall END AS overall, reason FROM pz)
"""

_ENTRIES_SQL = """
ent AS (SELECT doc_id AS entry_id, doc_id % 29 <> 0 AS well_formed FROM documents),
ev AS (SELECT ent.entry_id, ent.well_formed, js.overall, """ + ", ".join(f"js.{d}" for d in DIMENSIONS) + """
       FROM ent LEFT JOIN js ON js.entry_id = ent.entry_id)
"""


def entries(spark, sf_dir):
    """Nested chat entries derived from documents; every 29th is malformed
    (a single message)."""
    d = read_table(spark, sf_dir, "documents")
    user = F.struct(F.split_part("text", F.lit("\n"), F.lit(1)).alias("content"), F.lit("user").alias("role"))
    asst = F.struct(F.col("text").alias("content"), F.lit("assistant").alias("role"))
    msgs = F.when(F.col("doc_id") % 29 == 0, F.array(user)).otherwise(F.array(user, asst))
    return d.select(F.col("doc_id").alias("entry_id"), msgs.alias("messages"))


def evals(spark, sf_dir):
    return J.evaluations(entries(spark, sf_dir), fixture(spark, sf_dir, "fx_evaluations"))


@register("judge_scores", oracle(["fx_evaluations"], _SCORES_SQL + """
SELECT entry_id, """ + ", ".join(DIMENSIONS) + """, overall, reason FROM js"""))
def judge_scores(spark, sf_dir):
    """P-29 + P-30: judge text parsed into five scores, overall and reason."""
    from ..functions.judge import fill_overall, keyed_lines, parse_scores
    from ..functions.text import fence
    ev = fixture(spark, sf_dir, "fx_evaluations")
    s = fence(ev.select("entry_id", parse_scores(keyed_lines("evaluation_text")).alias("s")))
    return s.select("entry_id", *[F.col("s")[d].alias(d) for d in DIMENSIONS],
                    fill_overall(F.col("s")).alias("overall"), F.col("s")["reason"].alias("reason"))


@register("judge_filter", oracle(["fx_evaluations"], _SCORES_SQL + "," + _ENTRIES_SQL + """
SELECT entry_id, overall FROM ev WHERE well_formed AND overall >= 6.0"""))
def judge_filter(spark, sf_dir):
    """F-11 + J-3 + F-9: well-formed entries whose overall score is at least 6."""
    kept = J.keep_high_quality(evals(spark, sf_dir))
    return kept.select("entry_id", F.col("scores.overall").alias("overall"))


@register("judge_summary", oracle(["fx_evaluations"], _SCORES_SQL + "," + _ENTRIES_SQL + """
SELECT count(*) AS original_count, count(*) FILTER (WHERE well_formed) AS evaluated_count,
       count(*) FILTER (WHERE well_formed AND overall >= 6.0) AS high_quality_count,
       count(*) - count(*) FILTER (WHERE well_formed AND overall >= 6.0) AS filtered_count,
       6.0 ::DOUBLE AS filter_threshold,
       round(CASE WHEN count(*) = 0 THEN NULL ELSE count(*) FILTER (WHERE well_formed AND overall >= 6.0) * 100.0 / count(*) END, 6) AS quality_rate,
       """ + ", ".join(f"round(avg({d}) FILTER (WHERE well_formed AND {d} > 0), 6) AS avg_{d}" for d in DIMENSIONS + ["overall"]) + """
FROM ev"""))
def judge_summary(spark, sf_dir):
    """A-10 + A-11: evaluation counts, kept rate and mean scores."""
    s = J.evaluation_summary(evals(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) if c.startswith("avg_") or c == "quality_rate" else F.col(c)
                      for c in s.columns])


@register("sink_evaluation", oracle(["fx_evaluations"], _SCORES_SQL + "," + _ENTRIES_SQL + """,
k AS (SELECT entry_id FROM ev WHERE well_formed AND overall >= 6.0)
SELECT 'dataset' AS part, entry_id FROM k
UNION ALL SELECT 'evaluations', entry_id FROM ev WHERE well_formed
UNION ALL SELECT 'summary', count(*) FROM k"""))
def sink_evaluation(spark, sf_dir):
    """K-6: the filtered dataset and the evaluation report, read back."""
    path = fresh_path(spark, "evaluation")
    J.write_evaluation(entries(spark, sf_dir), evals(spark, sf_dir), path)
    kept = spark.read.schema("entry_id long").json(f"{path}/dataset")
    every = spark.read.schema("entry_id long").json(f"{path}/evaluation_report/evaluations")
    summary = spark.read.schema("high_quality_count long").json(f"{path}/evaluation_report/summary")
    return (kept.select(F.lit("dataset").alias("part"), "entry_id")
            .unionByName(every.select(F.lit("evaluations").alias("part"), "entry_id"))
            .unionByName(summary.select(F.lit("summary").alias("part"), F.col("high_quality_count").alias("entry_id"))))
