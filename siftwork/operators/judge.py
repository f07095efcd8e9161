"""Judge-and-filter operators (pipeline B).

Entries and judge outputs meet in one equi-join on the entry key; everything
else is per-row parsing plus single-pass aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.judge import DIMENSIONS, fill_overall, keyed_lines, parse_scores
from ..functions.text import fence
from ..sources.io import write_observed

MIN_SCORE = 6.0
INVALID_ENTRY = "Invalid entry format"
NOT_JUDGED = "No evaluation"


def evaluations(entries: DataFrame, judged: DataFrame, key: str = "entry_id",
                text: str = "evaluation_text") -> DataFrame:
    """F-11 + J-3 + P-29/30: one row per entry with ``scores`` or ``error``.

    ``entries`` carry ``messages``; ``judged`` carries the judge text per key
    and, optionally, an ``error`` from the judge call (a failed call is an
    error row, as is a malformed entry, which is never sent to the judge).
    """
    ok = F.coalesce(F.size("messages"), F.lit(0)) == 2
    base = entries.select(
        key,
        F.when(ok, F.col("messages")[0]["content"]).alias("user_message"),
        F.when(ok, F.col("messages")[1]["content"]).alias("assistant_message"),
        F.when(~ok, F.lit(INVALID_ENTRY)).alias("error"),
    )
    call_error = [F.col("error").alias("_call_error")] if "error" in judged.columns else []
    j = base.join(judged.select(key, text, F.lit(True).alias("_judged"), *call_error), key, "left")
    if call_error:
        j = j.withColumn("error", F.coalesce(F.col("error"), F.col("_call_error"))).drop("_call_error")
    # an entry that the judge never answered counts as failed, not as scored 0
    j = j.withColumn("error", F.coalesce(F.col("error"), F.when(F.col("_judged").isNull(), F.lit(NOT_JUDGED)))).drop("_judged")
    parsed = fence(j.withColumn("_kl", keyed_lines(F.col(text))).withColumn("_s", parse_scores(F.col("_kl"))).drop("_kl"))
    scores = F.struct(*[F.col("_s")[d].alias(d) for d in DIMENSIONS],
                      fill_overall(F.col("_s")).alias("overall"), F.col("_s")["reason"].alias("reason"))
    return parsed.withColumn("scores", F.when(F.col("error").isNull(), scores)).drop("_s").withColumnRenamed(
        text, "evaluation_text")


def keep_high_quality(evals: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """F-9: successfully judged entries with overall >= min_score."""
    return evals.where(F.col("error").isNull() & (F.col("scores.overall") >= min_score))


def summary_columns(min_score: float = MIN_SCORE) -> list:
    """A-10 + A-11: the counts and the mean of each score over values > 0."""
    ok = F.col("error").isNull()
    kept = ok & (F.col("scores.overall") >= min_score)
    avgs = [F.avg(F.when(ok & (F.col(f"scores.{d}") > 0), F.col(f"scores.{d}"))).alias(f"avg_{d}")
            for d in DIMENSIONS + ["overall"]]
    return [F.count(F.lit(1)).alias("original_count"), F.count_if(ok).alias("evaluated_count"),
            F.count_if(kept).alias("high_quality_count"), *avgs]


def evaluation_summary(evals: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """A-10 + A-11: counts, kept rate (%), and mean scores of stored evaluations."""
    return finished_summary(evals.agg(*summary_columns(min_score)), min_score)


def finished_summary(counted: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    return counted.select(
        "original_count", "evaluated_count", "high_quality_count",
        (F.col("original_count") - F.col("high_quality_count")).alias("filtered_count"),
        F.lit(min_score).alias("filter_threshold"),
        F.try_divide(F.col("high_quality_count") * F.lit(100.0), F.col("original_count")).alias("quality_rate"),
        *[f"avg_{d}" for d in DIMENSIONS + ["overall"]],
    )


def write_evaluation(entries: DataFrame, evals: DataFrame, out_dir: str, min_score: float = MIN_SCORE,
                     key: str = "entry_id") -> None:
    """K-6: the filtered dataset and the evaluation report from one evaluation.

    The evaluation is checkpointed once (reliable, in the shared checkpoint
    folder) so both outputs read the same judged rows without recomputation; the summary
    is kept by the tasks that write the evaluations.
    """
    ev = evals.checkpoint(eager=True)
    kept = entries.join(keep_high_quality(ev, min_score).select(key), key, "left_semi")
    kept.write.mode("overwrite").json(f"{out_dir}/dataset")
    counted = write_observed(ev, f"{out_dir}/evaluation_report/evaluations", summary_columns(min_score),
                             keep=F.col("error").isNull(), mode="overwrite")
    finished_summary(counted, min_score).write.mode("overwrite").json(f"{out_dir}/evaluation_report/summary")
