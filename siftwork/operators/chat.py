"""Chat-pair operators (pipeline A): extraction, uniqueness, dataset layouts,
validation and generation bookkeeping.

Per-row text work (segmenting a completion into role turns) stays inside the
row as array expressions; cross-row work is keyed:
* existing pairs are rebuilt from the flat layout by ``floor(idx / 2)``
  (groups of two rows) - no global window;
* first-occurrence-per-hash is ``row_number() = 1`` per hash, planned as a
  WindowGroupLimit, so a hash repeated millions of times forwards one row per
  map task;
* flat positions are prefix sums over ranges of (conversation, turn).
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chat import (
    ASSISTANT_MARKERS, USER_MARKERS, clean_content, generation_prompt, pair_hash, template_variables,
)
from ..functions.text import fence, py_strip
from ..session import staged as stage
from ..sources.json_arrays import PIECE, scan_json_arrays
from .retry import kept_attempts
from .running import ranked, running_sum

MIN_PAIR_CHARS = 5
MIN_CONTENT_LENGTH = 10
MAX_CONTENT_LENGTH = 2000

_MARKER_WORDS = "|".join(m[:-1] for m in USER_MARKERS + ASSISTANT_MARKERS)


def _role_of(line):
    lower = F.lower(line)
    is_user = F.lit(False)
    for m in USER_MARKERS:
        is_user = is_user | lower.startswith(m)
    is_asst = F.lit(False)
    for m in ASSISTANT_MARKERS:
        is_asst = is_asst | lower.startswith(m)
    return F.when(is_user, F.lit("user")).when(is_asst, F.lit("assistant"))


def extract_pairs(df: DataFrame, text: str = "generated_text") -> DataFrame:
    """P-10 + P-9: adds ``user`` and ``assistant`` (cleaned) to each row.

    W-14 as arrays: role-marked lines start segments; a segment commits when it has content and
    is the last one or the next segment has the other role; the last commit
    per role wins.  If a role is missing, the text is split on a blank line,
    else on lines.
    """
    t = py_strip(F.coalesce(F.col(text), F.lit("")))
    staged = df.withColumns({
        "_t": t,
        "_lines": F.filter(F.transform(F.split(t, "\n"), lambda l: py_strip(l)), lambda l: l != ""),
    })
    segs = F.split(F.array_join(F.col("_lines"), "\n"), rf"\n(?=(?i:{_MARKER_WORDS}):)")

    def seg_struct(s):
        first = F.substring_index(s, "\n", 1)
        after = py_strip(F.regexp_extract(first, r"(?s)\A[^:]*:(.*)\z", 1))
        nl = F.instr(s, "\n")
        rest = F.when(nl > 0, F.substring(s, nl + 1, 1 << 30))
        content = py_strip(F.concat_ws("\n", F.when(after != "", after), rest))
        return F.struct(_role_of(first).alias("role"), content.alias("content"))

    staged = staged.withColumn("_segs", F.filter(F.transform(segs, seg_struct), lambda x: x["role"].isNotNull()))
    roles = F.transform(F.col("_segs"), lambda x: x["role"])
    nxt = F.concat(F.slice(roles, 2, 1 << 30), F.array(F.lit(None).cast("string")))
    commits = F.filter(
        F.zip_with(F.col("_segs"), nxt, lambda s, n: F.struct(
            s["role"].alias("role"), s["content"].alias("content"),
            ((s["content"] != "") & (n.isNull() | (n != s["role"]))).alias("commit"))),
        lambda x: x["commit"])

    def last_of(role):
        return F.coalesce(F.try_element_at(F.filter(commits, lambda x: x["role"] == role), F.lit(-1))["content"], F.lit(""))

    staged = staged.withColumns({"_u": last_of("user"), "_a": last_of("assistant")})
    blocks = F.split(F.col("_t"), "\n\n")
    lines = F.col("_lines")
    missing = (F.col("_u") == "") | (F.col("_a") == "")
    user = (F.when(~missing, F.col("_u"))
            .when(F.size(blocks) >= 2, py_strip(F.get(blocks, 0)))
            .when(F.size(lines) >= 2, F.get(lines, 0))
            .otherwise(F.col("_u")))
    assistant = (F.when(~missing, F.col("_a"))
                 .when(F.size(blocks) >= 2, py_strip(F.array_join(F.slice(blocks, 2, 1 << 30), "\n\n")))
                 .when(F.size(lines) >= 2, F.array_join(F.slice(lines, 2, 1 << 30), "\n"))
                 .otherwise(F.col("_a")))
    out = staged.withColumns({"user": clean_content(user), "assistant": clean_content(assistant)})
    # fenced: filters on user / assistant must not re-expand the extraction
    return fence(out.drop("_t", "_lines", "_segs", "_u", "_a"))


def valid_pairs(pairs: DataFrame) -> DataFrame:
    """F-8: both sides non-empty and longer than 5 characters."""
    return pairs.where((F.length("user") > MIN_PAIR_CHARS) & (F.length("assistant") > MIN_PAIR_CHARS))


# ------------------------------------------------------------- layouts

def flat_positions(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Global 0-based position ``idx`` of each row in (group, order) order, from ranges of
    that order: a conversation that holds a third of all rows is spread over many."""
    placed = ranked(rows, [F.col(group), F.col(order)], {"_one": F.lit(1)})
    return placed.withColumn("idx", F.col("_one_cum") - 1).drop("_one", "_one_cum")


def flat_to_pairs(flat: DataFrame, idx: str = "idx") -> DataFrame:
    """W-7: consecutive flat rows (0,1), (2,3), ... as one row per pair."""
    pid = F.floor(F.col(idx) / 2).cast("long")
    even = F.col(idx) % 2 == 0
    return flat.groupBy(pid.alias("pair_idx")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(even, F.col("role"))).alias("user_role"),
        F.max(F.when(~even, F.col("role"))).alias("assistant_role"),
        F.max(F.when(even, F.col("content"))).alias("user"),
        F.max(F.when(~even, F.col("content"))).alias("assistant"),
        F.max(F.when(even, F.col("has_content"))).alias("user_has_content"),
        F.max(F.when(~even, F.col("has_content"))).alias("assistant_has_content"),
    )


def nested_entries(pairs: DataFrame) -> DataFrame:
    """P-31: ``messages`` = [user message, assistant message]."""
    return pairs.withColumn("messages", F.array(
        F.struct(F.col("user").alias("content"), F.lit("user").alias("role")),
        F.struct(F.col("assistant").alias("content"), F.lit("assistant").alias("role"))))


def nested_to_flat(entries: DataFrame, entry_idx: str = "entry_idx") -> DataFrame:
    """Adapter nested -> flat: two rows per entry at positions 2i, 2i+1."""
    ex = entries.select(entry_idx, F.posexplode("messages").alias("j", "m"))
    return ex.select((F.col(entry_idx) * 2 + F.col("j")).alias("idx"), F.col("m.role").alias("role"),
                     F.col("m.content").alias("content"))


def existing_hashes(flat: DataFrame) -> DataFrame:
    """J-1 build side: hash of each complete flat pair (missing content = '')."""
    pairs = flat_to_pairs(flat.withColumn("has_content", F.col("content").isNotNull())).where(F.col("n") == 2)
    return pairs.select(pair_hash(F.coalesce("user", F.lit("")), F.coalesce("assistant", F.lit(""))).alias("pair_hash")).distinct()


# ------------------------------------------------------------- uniqueness

def unique_pairs(pairs: DataFrame, existing: DataFrame, max_attempts: int | None = None) -> DataFrame:
    """P-7 + J-1 (the SET-4 except) + W-5 + W-6.

    Valid pairs not in ``existing``; per batch the first attempt (of ``max_attempts``,
    if given) with a pair that neither ``existing`` nor an earlier batch has
    (:func:`operators.retry.kept_attempts`); then the first occurrence of each hash in
    (batch, attempt, position, prompt) order: the rows that a sequential generator keeps.
    """
    cand = valid_pairs(pairs).withColumn("pair_hash", pair_hash("user", "assistant"))
    if max_attempts is not None:
        cand = cand.where(F.col("attempt") <= max_attempts)
    # written once: the extraction behind it is used for the keys and for the rows
    fresh = stage(cand.join(existing, "pair_hash", "left_anti"), "fresh-pairs")
    chosen = fresh.join(kept_attempts(fresh), ["batch_id", "attempt"], "left_semi")
    w = Window.partitionBy("pair_hash").orderBy("batch_id", "attempt", "pos", "prompt_id")
    return chosen.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def batch_shortfall(prompts: DataFrame, produced: DataFrame, batch_size: int) -> DataFrame:
    """A-14: per batch, requested = min(batch size, entries still missing),
    produced, shortfall flag and running total."""
    n = prompts.agg(F.count_distinct("prompt_id").alias("num_entries"))
    batches = prompts.select("batch_id").distinct()
    got = produced.groupBy("batch_id").agg(F.count(F.lit(1)).alias("produced"))
    per = batches.join(got, "batch_id", "left").fillna(0, ["produced"])
    cum = running_sum(stage(per, "batches"), "batch_id", ["produced"])
    out = cum.crossJoin(F.broadcast(n))  # one-row side
    requested = F.least(F.lit(batch_size), F.col("num_entries") - (F.col("produced_cum") - F.col("produced")))
    return out.select("batch_id", requested.cast("long").alias("requested"), F.col("produced").cast("long").alias("produced"),
                      (F.col("produced") < requested).alias("shortfall"),
                      F.col("produced_cum").cast("long").alias("running_total"))


# ------------------------------------------------------------- validation

def validate_flat(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V-1 + A-12: (per-pair validity, one-row summary) of a flat dataset whose
    rows carry idx, role, content and has_content."""
    pairs = flat_to_pairs(flat)
    ok = ((F.col("n") == 2) & (F.col("user_role") == "user") & (F.col("assistant_role") == "assistant")
          & F.coalesce(F.col("user_has_content"), F.lit(False)) & F.coalesce(F.col("assistant_has_content"), F.lit(False)))
    per_pair = pairs.select((F.col("pair_idx") * 2).alias("index"), ok.alias("valid"), F.col("n"))
    total = flat.agg(F.count(F.lit(1)).alias("total_messages"))
    counts = per_pair.where(F.col("n") == 2).agg(F.count_if(F.col("valid")).alias("_v"), F.count_if(~F.col("valid")).alias("_i"))
    summary = total.crossJoin(counts).select(
        "total_messages", (F.col("total_messages") % 2 == 0).alias("even_length"),
        F.when(F.col("total_messages") % 2 == 0, F.col("_v")).alias("valid_pairs"),
        F.when(F.col("total_messages") % 2 == 0, F.col("_i")).alias("invalid_pairs"))
    return per_pair.where(F.col("n") == 2).drop("n"), summary


def _kind(v):
    s = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit(None)).when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array")
            .otherwise("scalar"))


def validate_nested(entries: DataFrame, entry: str = "entry", entry_idx: str = "entry_idx",
                    keys: tuple[str, ...] = (), parsed: bool = False) -> DataFrame:
    """V-2 per entry: the first failing rule (3 object, 4 has messages, 5 two
    messages, then per message 6 object, 7 content+role present, 8 role is
    user/assistant); 0 = not parseable JSON; null = valid.  ``parsed``: the
    entry column already holds VARIANT values (no text round trip, so JSON
    nulls stay present)."""
    v = F.col(entry) if parsed else F.try_parse_json(F.col(entry))
    staged = entries.select(*keys, entry_idx, v.alias("_v"))
    msgs = F.try_variant_get(F.col("_v"), "$.messages", "variant")
    staged = staged.withColumns({"_m": msgs, "_ml": F.try_variant_get(F.col("_v"), "$.messages", "array<variant>")})

    def msg_rule(j):
        m = F.try_variant_get(F.col("_v"), f"$.messages[{j}]", "variant")
        has = (F.try_variant_get(m, "$.content", "variant").isNotNull()
               & F.try_variant_get(m, "$.role", "variant").isNotNull())
        role = F.try_variant_get(m, "$.role", "string")
        return (F.when(_kind(m) != "object", 6).when(~has, 7)
                .when(~F.coalesce(role.isin("user", "assistant"), F.lit(False)), 8))

    rule = (F.when(F.col("_v").isNull(), F.lit(0))
            .when(_kind(F.col("_v")) != "object", 3)
            .when(F.col("_m").isNull(), 4)
            .when((_kind(F.col("_m")) != "array") | (F.size(F.col("_ml")) != 2), 5))
    m0, m1 = msg_rule(0), msg_rule(1)
    out = staged.select(*keys, entry_idx, rule.alias("_r"), m0.alias("_r0"), m1.alias("_r1"))
    return out.select(
        *keys, entry_idx,
        F.coalesce("_r", "_r0", "_r1").alias("rule"),
        F.when(F.col("_r").isNull() & F.col("_r0").isNotNull(), F.lit(0))
        .when(F.col("_r").isNull() & F.col("_r1").isNotNull(), F.lit(1)).alias("message_idx"),
    )


def entry_violations(entries: DataFrame, entry: str = "entry", entry_idx: str = "entry_idx",
                     keys: tuple[str, ...] = (), parsed: bool = False) -> DataFrame:
    """V-2, every violation: one row per rule that an entry breaks, with the message
    (null: the entry itself) and the field at fault.

    Rules as in :func:`validate_nested`.  Those of messages are held against all messages
    of a list, whatever their number; a message that is no object breaks rule 6 only, one
    without content and role breaks rule 7 twice, and a role that is there and neither user
    nor assistant breaks rule 8.  Texts without a violation have no row.
    """
    v = F.col(entry) if parsed else F.try_parse_json(F.col(entry))
    cut = entries.select(*keys, entry_idx, v.alias("_v")).withColumns({
        "_m": F.try_variant_get("_v", "$.messages", "variant"),
        "_ml": F.try_variant_get("_v", "$.messages", "array<variant>")})

    def broken(holds, rule: int, message=None, field: str | None = None):
        return F.when(F.coalesce(holds, F.lit(False)), F.struct(
            (F.lit(None) if message is None else message).cast("int").alias("message_idx"), F.lit(rule).alias("rule"),
            F.lit(field).cast("string").alias("field")))

    def of_message(m, i):
        is_object = _kind(m) == "object"
        has = {f: F.try_variant_get(m, f"$.{f}", "variant").isNotNull() for f in ("content", "role")}
        role = F.try_variant_get(m, "$.role", "string")
        return F.array(broken(~F.coalesce(is_object, F.lit(False)), 6, i),
                       *[broken(is_object & ~has[f], 7, i, f) for f in has],
                       broken(is_object & has["role"] & ~F.coalesce(role.isin("user", "assistant"), F.lit(False)), 8, i, "role"))

    is_object = _kind(F.col("_v")) == "object"
    whole = F.array(
        broken(F.col("_v").isNull(), 0), broken(~is_object, 3), broken(is_object & F.col("_m").isNull(), 4, None, "messages"),
        broken(is_object & F.col("_m").isNotNull() & F.coalesce((_kind(F.col("_m")) != "array") | (F.size("_ml") != 2), F.lit(True)),
               5, None, "messages"))
    inside = F.flatten(F.transform(F.when(is_object, F.col("_ml")), of_message))
    every = F.filter(F.concat(whole, F.coalesce(inside, F.array().cast(
        "array<struct<message_idx:int,rule:int,field:string>>"))), lambda x: x.isNotNull())
    return cut.select(*keys, entry_idx, F.inline(every))


def dataset_verdict(entries: DataFrame, violations: DataFrame, entry_idx: str = "entry_idx") -> DataFrame:
    """One row: entries, invalid entries, violations in all and by rule, whether the
    dataset is valid, and the first violation in (entry, message, rule) order."""
    n = entries.agg(F.count(F.lit(1)).alias("entries"))
    rules = (3, 4, 5, 6, 7, 8, 0)
    per_entry = violations.groupBy(entry_idx).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.coalesce("message_idx", F.lit(-1)).alias("m"), "rule")).alias("_f"),
        *[F.count_if(F.col("rule") == r).alias(f"_{r}") for r in rules])
    summed = per_entry.agg(
        F.count(F.lit(1)).alias("invalid_entries"), F.coalesce(F.sum("_n"), F.lit(0)).alias("violations"),
        *[F.coalesce(F.sum(f"_{r}"), F.lit(0)).alias(f"rule_{r}") for r in rules], F.min(F.struct(entry_idx, "_f")).alias("_f"))
    return n.crossJoin(F.broadcast(summed)).select(  # one row each
        "entries", "invalid_entries", "violations", *[f"rule_{r}" for r in rules],
        ((F.col("entries") > 0) & (F.col("violations") == 0)).alias("is_valid"),
        F.col(f"_f.{entry_idx}").alias("first_entry"),
        F.when(F.col("_f._f.m") >= 0, F.col("_f._f.m")).alias("first_message"), F.col("_f._f.rule").alias("first_rule"))


def validate_dataset_files(spark, path: str) -> DataFrame:
    """V-2 on the reference layout: one JSON document per file.

    Per file: rule 0 (not JSON), 1 (not an array), 2 (empty), else the first
    violating entry rule in (entry, message, rule) order; ``is_valid`` when
    none.  A document is read whole (one task per file); :func:`validate_json_arrays`
    reads large ones in parallel.
    """
    docs = (spark.read.text(path, wholetext=True)
            .select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("_v")))
    arr = F.try_variant_get(F.col("_v"), "$", "array<variant>")
    files = docs.select("file", F.coalesce(F.size(arr), F.lit(0)).alias("entries"),
                        F.when(F.col("_v").isNull(), F.lit(0)).when(arr.isNull(), 1).when(F.size(arr) == 0, 2).alias("file_rule"),
                        arr.alias("_arr"))
    entries = (files.where(F.col("_arr").isNotNull())
               .select("file", F.posexplode("_arr").alias("entry_idx", "entry")))
    return _file_verdicts(files, validate_nested(entries, keys=("file",), parsed=True))


def validate_json_arrays(spark, path: str, piece: int | None = None) -> DataFrame:
    """V-2 on files of any size, read by byte ranges: as :func:`validate_dataset_files`, but a
    file that does not begin with ``[`` breaks rule 1 whether or not it is JSON."""
    entries, files = scan_json_arrays(spark, path, piece or PIECE)
    ruled = files.select("file", F.when(F.col("reason").isNull(), F.col("entries")).otherwise(0).alias("entries"),
                         F.when(F.col("reason") == "not JSON", 0).when(F.col("reason").isNotNull(), 1)
                         .when(F.col("entries") == 0, 2).alias("file_rule"))
    return _file_verdicts(ruled, validate_nested(entries, keys=("file",)))


def _file_verdicts(files: DataFrame, ruled: DataFrame) -> DataFrame:
    first = ruled.where(F.col("rule").isNotNull()).groupBy("file").agg(
        F.min(F.struct("entry_idx", F.coalesce("message_idx", F.lit(-1)).alias("m"), "rule")).alias("f"),
        F.count(F.lit(1)).alias("violations"))
    return files.join(first, "file", "left").select(
        "file", "entries", (F.col("file_rule").isNull() & F.col("f").isNull()).alias("is_valid"),
        F.coalesce(F.col("file_rule"), F.col("f.rule")).alias("first_violation_rule"),
        F.when(F.col("file_rule").isNull(), F.col("f.entry_idx")).alias("first_violation_entry"),
        F.when(F.col("file_rule").isNull() & (F.col("f.m") >= 0), F.col("f.m")).alias("first_violation_message"),
        F.coalesce(F.col("violations"), F.lit(0)).alias("violations"))


def nested_summary(violations: DataFrame, entry_idx: str = "entry_idx") -> DataFrame:
    """Dataset verdict: non-empty and no violation; first violation by
    (entry, message, rule)."""
    bad = violations.where(F.col("rule").isNotNull())
    first = bad.agg(F.min(F.struct(entry_idx, F.coalesce("message_idx", F.lit(-1)), "rule")).alias("f"))
    n = violations.agg(F.count(F.lit(1)).alias("entries"))
    return n.crossJoin(first).select(
        "entries", ((F.col("entries") > 0) & F.col("f").isNull()).alias("is_valid"),
        F.col(f"f.{entry_idx}").alias("first_violation_entry"), F.col("f.rule").alias("first_violation_rule"))


def entry_shapes(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """A-18: entries per shape (kind, sorted keys, messages kind and length)."""
    v = F.try_parse_json(F.col(entry))
    m = F.try_variant_get(v, "$.messages", "variant")
    keys = F.when(_kind(v) == "object", F.array_join(F.array_sort(F.json_object_keys(F.col(entry))), ","))
    shape = entries.select(
        F.coalesce(_kind(v), F.lit("malformed")).alias("kind"), keys.alias("keys"),
        _kind(m).alias("messages_kind"),
        F.when(_kind(m) == "array", F.size(F.try_variant_get(v, "$.messages", "array<variant>"))).alias("messages_len"))
    return shape.groupBy("kind", "keys", "messages_kind", "messages_len").agg(F.count(F.lit(1)).alias("entries"))


def key_profile(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """A-18 per key: how often each key of an object entry holds each kind of value,
    and, for lists, of how many items."""
    v = F.try_parse_json(F.col(entry))
    pairs = entries.select(v.alias("_v")).where(_kind(F.col("_v")) == "object").select(
        F.explode(F.try_variant_get("_v", "$", "map<string,variant>")).alias("key", "value"))
    kind = F.coalesce(_kind(F.col("value")), F.lit("null"))
    items = F.when(kind == "array", F.size(F.try_variant_get("value", "$", "array<variant>")))
    return pairs.select("key", kind.alias("value_kind"), items.alias("items")).groupBy(
        "key", "value_kind", "items").agg(F.count(F.lit(1)).alias("entries"))


def path_profile(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """A-18 at any depth: how many values (and entries with one) stand at each path, by kind
    and, for lists, by number of items.

    ``$`` is the entry, ``.name`` a key and ``[]`` any item.  A task counts the paths of
    its rows in one parse of each and passes sums on, so what is shuffled grows with the
    shapes, not with the entries.  Text that is no JSON is kind ``malformed``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[int]] = {}

        def rows() -> pa.RecordBatch:
            cols = list(zip(*((*k, *n) for k, n in found.items()))) or [()] * 5
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                cols, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                ["path", "kind", "items", "n", "entries"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for key, n in Counter(json_paths(text)).items():
                    both = found.setdefault(key, [0, 0])
                    both[0] += n
                    both[1] += 1
                if len(found) > 50_000:
                    yield rows()
        yield rows()

    sums = entries.select(entry).mapInArrow(run, "path string, kind string, items int, n long, entries long")
    return sums.groupBy("path", "kind", "items").agg(F.sum("n").alias("n"), F.sum("entries").alias("entries"))


def json_paths(text: str | None) -> Iterator[tuple[str, str, int | None]]:
    """path, kind and number of items of every value of one JSON text."""
    try:
        open_values = [("$", json.loads(text))]
    except (TypeError, ValueError):
        yield "$", "malformed", None
        return
    while open_values:
        path, value = open_values.pop()
        if isinstance(value, dict):
            yield path, "object", None
            open_values += [(f"{path}.{k}", v) for k, v in value.items()]
        elif isinstance(value, list):
            yield path, "array", len(value)
            open_values += [(f"{path}[]", v) for v in value]
        else:
            yield path, ("null" if value is None else "boolean" if isinstance(value, bool) else
                         "string" if isinstance(value, str) else "number"), None


def length_limits(rows: DataFrame, content: str, order: list[str], lo: int = MIN_CONTENT_LENGTH,
                  hi: int = MAX_CONTENT_LENGTH, unique: bool = True) -> DataFrame:
    """F-12: content length within [lo, hi]; optionally first copy of each text."""
    kept = rows.where(F.length(content).between(lo, hi))
    if not unique:
        return kept
    w = Window.partitionBy(F.md5(F.col(content))).orderBy(*order)
    return kept.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


# ------------------------------------------------------------- templates

def expand_specs(specs: DataFrame) -> DataFrame:
    """J-6 + P-27: one prompt row per requested entry of each template spec."""
    withvars = specs.withColumn("variables", template_variables(F.col("input_template"), F.col("output_template")))
    prompt = generation_prompt(F.col("topic"), F.col("input_template"), F.col("output_template"),
                               F.col("variables"), F.col("variable_descriptions"))
    rendered = fence(withvars.withColumn("prompt", prompt))
    ex = rendered.withColumn("entry_no", F.explode(F.sequence(F.lit(1), F.col("num_entries"))))
    return ex.withColumn("batch_id", F.floor((F.col("entry_no") - 1) / F.col("batch_size")).cast("long"))
