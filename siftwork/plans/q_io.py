"""Dataset I/O queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..operators import chat as C
from ..session import fresh_path
from ..sources.fixtures import fixture
from ..sources.history import add_keys, unseen
from ..sources.json_arrays import read_json_arrays
from ..sources.io import append_increment, read_dataset, read_json_documents, write_dataset
from ..sources.replace import read_current, replace_dataset
from ..sources.tables import read_table
from .q_chat import _NESTED_SQL
from .registry import ORACLES, oracle, register

CONVERSATION_SCHEMA = StructType([
    StructField("conv_id", LongType()), StructField("turn", LongType()),
    StructField("role", StringType()), StructField("text", StringType()),
])


@register("json_roundtrip", oracle([], "SELECT conv_id, turn, role, text FROM conversations"))
def json_roundtrip(spark, sf_dir):
    """K-1 then S-1: the conversations written as UTF-8 JSON lines and read
    back with an explicit schema: the same rows come back."""
    path = fresh_path(spark, "json-roundtrip")
    write_dataset(read_table(spark, sf_dir, "conversations"), path, mode="overwrite")
    back = read_dataset(spark, path, CONVERSATION_SCHEMA)
    return back.select("conv_id", "turn", "role", "text")


def _turns(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def _back(spark, path):
    return read_dataset(spark, path, CONVERSATION_SCHEMA).select("conv_id", "turn", "role", "text")


@register("sink_overwrite", oracle([], "SELECT conv_id, turn, role, text FROM conversations WHERE role = 'assistant'"))
def sink_overwrite(spark, sf_dir):
    """K-2: a dataset written again holds the second contents only."""
    path = fresh_path(spark, "overwrite")
    write_dataset(_turns(spark, sf_dir), path)
    write_dataset(_turns(spark, sf_dir).where("role = 'assistant'"), path)
    return _back(spark, path)


@register("sink_rewrite", oracle([], """
SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'
UNION ALL SELECT conv_id, turn + 1000, role, concat(text, '!') FROM conversations WHERE role = 'assistant' AND text IS NOT NULL"""))
def sink_rewrite(spark, sf_dir):
    """K-2 onto the path being read: a dataset replaced by rows that are read from it."""
    path = fresh_path(spark, "rewrite")
    replace_dataset(_turns(spark, sf_dir), path)
    stored = read_current(spark, path, CONVERSATION_SCHEMA).select("conv_id", "turn", "role", "text")
    louder = stored.where("role = 'assistant' AND text IS NOT NULL").withColumns(
        {"turn": F.col("turn") + 1000, "text": F.concat("text", F.lit("!"))})
    replace_dataset(stored.where("role <> 'system'").unionByName(louder), path)
    return read_current(spark, path, CONVERSATION_SCHEMA).select("conv_id", "turn", "role", "text")


@register("sink_append", oracle([], "SELECT conv_id, turn, role, text FROM conversations"))
def sink_append(spark, sf_dir):
    """S-2 + K-3: no dataset is an empty one; increments are added to it."""
    path = fresh_path(spark, "append")
    before = _back(spark, path)
    turns = _turns(spark, sf_dir)
    append_increment(before.unionByName(turns.where("turn < 2")), path)
    append_increment(turns.where("turn >= 2"), path)
    return _back(spark, path)


@register("sink_ignore", oracle([], """
SELECT 'kept' AS output, conv_id, turn FROM conversations WHERE role = 'user'
UNION ALL SELECT 'was empty', conv_id, turn FROM conversations"""))
def sink_ignore(spark, sf_dir):
    """K-7: an output with records is kept, one without is written."""
    turns = _turns(spark, sf_dir)
    kept, empty = fresh_path(spark, "ignore"), fresh_path(spark, "ignore-empty")
    write_dataset(turns.where("role = 'user'"), kept)
    write_dataset(turns.where("false"), empty)
    out = []
    for name, path in (("kept", kept), ("was empty", empty)):
        write_dataset(turns, path, mode="ignore")
        out.append(_back(spark, path).select(F.lit(name).alias("output"), "conv_id", "turn"))
    return out[0].unionByName(out[1])


def _documents(spark, sf_dir, path):
    """One JSON document per 4 conversations: an array of their entries, but some are broken
    off, objects, or empty."""
    e = fixture(spark, sf_dir, "fx_entry_json").where(F.try_parse_json("entry").isNotNull())
    bucket = F.floor(F.col("entry_idx") / 4000000).cast("long")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entry_idx", "entry"))), lambda x: x["entry"]), ",")
    docs = e.groupBy(bucket.alias("bucket")).agg(joined.alias("all"))
    kind = F.col("bucket") % 5
    text = (F.when(kind == 1, F.concat(F.lit("["), "all")).when(kind == 2, F.lit('{"messages":[]}'))
            .when(kind == 3, F.lit("[]")).otherwise(F.concat(F.lit("["), "all", F.lit("]"))))
    docs.select("bucket", text.alias("value")).write.partitionBy("bucket").text(path)


_BUCKETS_SQL = _NESTED_SQL + """,
e AS (SELECT v.*, v.entry_idx // 4000000 AS bucket, row_number() OVER (PARTITION BY v.entry_idx // 4000000 ORDER BY v.entry_idx) - 1 AS place
      FROM v WHERE coalesce(rule, -1) <> 0),
f AS (SELECT bucket, bucket % 5 AS kind, count(*) AS n, min(place) FILTER (WHERE rule IS NOT NULL) AS first_at FROM e GROUP BY bucket)
"""


@register("validate_files", oracle(["fx_entry_json"], _BUCKETS_SQL + """
SELECT f.bucket, CASE WHEN kind IN (0, 4) THEN n ELSE 0 END AS entries,
       kind IN (0, 4) AND first_at IS NULL AS is_valid,
       CASE kind WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE e.rule END AS first_violation_rule,
       CASE WHEN kind IN (0, 4) THEN first_at END AS first_violation_entry
FROM f LEFT JOIN e ON e.bucket = f.bucket AND e.place = f.first_at"""))
def validate_files(spark, sf_dir):
    """V-2 on whole dataset files: malformed, not an array, empty, or the first bad entry."""
    path = fresh_path(spark, "documents")
    _documents(spark, sf_dir, path)
    out = C.validate_dataset_files(spark, path)
    bucket = F.regexp_extract("file", r"bucket=(\d+)", 1).cast("long")
    return out.select(bucket.alias("bucket"), "entries", "is_valid", "first_violation_rule", "first_violation_entry")


@register("read_rejects", oracle(["fx_entry_json"], _BUCKETS_SQL + """,
bad AS (SELECT entry_idx // 4000000 AS bucket, bool_or(json_type(entry) <> 'OBJECT') AS odd FROM j WHERE ok GROUP BY 1)
SELECT f.bucket, CASE WHEN kind = 1 THEN 'not JSON' WHEN kind = 2 THEN 'not an array' ELSE 'an entry is not an object' END AS reason
FROM f JOIN bad ON bad.bucket = f.bucket WHERE kind IN (1, 2) OR (kind IN (0, 4) AND odd)"""))
def read_rejects(spark, sf_dir):
    """S-1: dataset files that the reader refuses, each with the reason."""
    path = fresh_path(spark, "documents")
    _documents(spark, sf_dir, path)
    schema = StructType([StructField("foo", LongType())])
    _, rejects = read_json_documents(spark, path, schema)
    return rejects.select(F.regexp_extract("file", r"bucket=(\d+)", 1).cast("long").alias("bucket"), "reason")


_ENTRY_SCHEMA = StructType([StructField("messages", StringType()), StructField("conversation", StringType()),
                            StructField("meta", StructType([StructField("conv", LongType()), StructField("turns", ArrayType(LongType()))]))])
#: Documents of some entries are read in pieces of this many bytes, so that every one has several.
_SMALL_PIECE = 4096

_ENTRIES_SQL = _BUCKETS_SQL + """,
bad AS (SELECT entry_idx // 4000000 AS bucket, bool_or(json_type(entry) <> 'OBJECT') AS odd FROM j WHERE ok GROUP BY 1)
SELECT e.bucket, CAST(e.place AS BIGINT) AS entry_idx, CAST(json_extract(j.entry, '$.meta.conv') AS BIGINT) AS conv,
       json_array_length(j.entry, '$.meta.turns') AS n_turns, json_extract_string(j.entry, '$.conversation') AS conversation
FROM e JOIN j ON j.entry_idx = e.entry_idx JOIN bad ON bad.bucket = e.bucket
WHERE e.bucket % 5 IN (0, 4) AND NOT odd"""

#: What the queries show of an entry.
_ENTRY_COLUMNS = ("meta.conv AS conv", "CASE WHEN meta.turns IS NOT NULL THEN CAST(size(meta.turns) AS BIGINT) END AS n_turns",
                  "conversation")


@register("read_documents", oracle(["fx_entry_json"], _ENTRIES_SQL.replace(
    "SELECT e.bucket, CAST(e.place AS BIGINT) AS entry_idx, CAST", "SELECT CAST")))
def read_documents(spark, sf_dir):
    """S-1: the entries of all dataset files that are arrays of objects."""
    path = fresh_path(spark, "documents")
    _documents(spark, sf_dir, path)
    entries, _ = read_json_documents(spark, path, _ENTRY_SCHEMA)
    return entries.selectExpr(*_ENTRY_COLUMNS)


@register("read_arrays", oracle(["fx_entry_json"], _ENTRIES_SQL))
def read_arrays(spark, sf_dir):
    """S-1 by byte ranges: the same entries with their places, each file read in many pieces."""
    path = fresh_path(spark, "documents")
    _documents(spark, sf_dir, path)
    entries, _ = read_json_arrays(spark, path, _ENTRY_SCHEMA, piece=_SMALL_PIECE)
    bucket = F.regexp_extract("file", r"bucket=(\d+)", 1).cast("long")
    return entries.withColumn("bucket", bucket).selectExpr("bucket", "entry_idx", *_ENTRY_COLUMNS)


@register("validate_arrays", ORACLES["validate_files"])
def validate_arrays(spark, sf_dir):
    """V-2 by byte ranges: the verdicts of validate_files, each file read in many pieces."""
    path = fresh_path(spark, "documents")
    _documents(spark, sf_dir, path)
    out = C.validate_json_arrays(spark, path, piece=_SMALL_PIECE)
    bucket = F.regexp_extract("file", r"bucket=(\d+)", 1).cast("long")
    return out.select(bucket.alias("bucket"), "entries", "is_valid", "first_violation_rule", "first_violation_entry")


@register("url_history", oracle(["fx_page_urls"], """
SELECT page_id, url FROM fx_page_urls WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 < 2)"""))
def url_history(spark, sf_dir):
    """J-4 against an index kept over two runs: the URLs that neither has scraped."""
    path = fresh_path(spark, "url-history")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    for run in (0, 1):
        add_keys(pages.where(F.col("page_id") % 3 == run), "url", path)
    return unseen(fixture(spark, sf_dir, "fx_page_urls"), "url", path).select("page_id", "url")
