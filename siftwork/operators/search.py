"""Search-result selections over result tables (S-7/W-9, S-8/F-10).

Both are per-group top-k: ``row_number() <= k`` lets Spark insert a
WindowGroupLimit before the shuffle, so each task forwards at most k rows per
group no matter how large a group is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values (search parameters of the reference).
MIN_STARS = 500
MAX_RESULTS_PER_TOPIC = 25
QA_MIN_SCORE = 5


def top_per_topic(repos: DataFrame, topic: str, stars: str, key: str,
                  min_stars: float = MIN_STARS, k: int = MAX_RESULTS_PER_TOPIC) -> DataFrame:
    """S-7 + W-9: repositories above ``min_stars``, best ``k`` per topic by stars."""
    w = Window.partitionBy(topic).orderBy(F.col(stars).desc(), F.col(key).asc())
    return (repos.where(F.col(stars) > min_stars)
            .withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k))


def qa_items(items: DataFrame, query: str, score: str, key: str,
             page_size: int | None = None, min_score: float = QA_MIN_SCORE) -> DataFrame:
    """S-8 + F-10: items scoring at least ``min_score`` (missing score = 0); with
    ``page_size`` the first so many per query by score."""
    good = items.where(F.coalesce(F.col(score), F.lit(0)) >= min_score)
    if page_size is None:
        return good
    w = Window.partitionBy(query).orderBy(F.col(score).desc_nulls_last(), F.col(key).asc())
    return good.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= page_size)
