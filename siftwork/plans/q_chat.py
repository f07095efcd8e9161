"""Queries for chat-pair extraction, uniqueness, dataset layouts, validation
and template rendering (pipeline A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chat import CLEAN_PREFIXES, VARIABLE_GROUPS, judge_prompt, pair_hash, remove_prompt_echo
from ..operators import chat as C
from ..session import fresh_path, staged as stage
from ..sources.fixtures import fixture
from ..sources.history import add_keys, unseen
from ..sources.tables import read_table
from .q_pages import _strip
from .registry import DWS, oracle, register

BATCH_SIZE = 8   # fx_completions batches are floor(conv_id / 8)

# ---------------------------------------------------------------- oracle side

_PROMPT_SQL = "concat('Generate exactly one realistic conversation about topic ', CAST(prompt_id % 3 AS VARCHAR), '.')"
_ECHO_SQL = f"CASE WHEN prompt_id % 2 = 0 THEN concat({_PROMPT_SQL}, chr(10), generated_text) ELSE generated_text END"


def _clean_steps(src: str, cols: list[str], keys: list[str], out: str) -> str:
    """CTE chain ending in ``out`` that applies the content cleaner to ``cols``."""
    k = ", ".join(keys)
    steps = [f"{out}_0 AS (SELECT {k}, " + ", ".join(f"{_strip(f'coalesce({c}, {chr(39)}{chr(39)})')} AS {c}" for c in cols)
             + f" FROM {src})"]
    prev = f"{out}_0"
    for n, p in enumerate(CLEAN_PREFIXES, 1):
        exprs = ", ".join(
            f"CASE WHEN starts_with(lower({c}), '{p}') THEN {_strip(f'substr({c}, {len(p) + 1})')} ELSE {c} END AS {c}"
            for c in cols)
        steps.append(f"{out}_{n} AS (SELECT {k}, {exprs} FROM {prev})")
        prev = f"{out}_{n}"
    q = ", ".join(
        f"""CASE WHEN (starts_with({c}, '"') AND ends_with({c}, '"')) OR (starts_with({c}, '''') AND ends_with({c}, ''''))
                 THEN CASE WHEN length({c}) >= 2 THEN {_strip(f'substr({c}, 2, length({c}) - 2)')} ELSE '' END ELSE {c} END AS {c}"""
        for c in cols)
    steps.append(f"{out}_q AS (SELECT {k}, {q} FROM {prev})")
    fin = ", ".join(
        _strip(f"regexp_replace(regexp_replace({_strip(f'regexp_replace({c}, {chr(39)}{DWS}+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}, '\\{{[^}}]*\\}}', '', 'g'), '{DWS}+', ' ', 'g')")
        + f" AS {c}" for c in cols)
    steps.append(f"{out} AS (SELECT {k}, {fin} FROM {out}_q)")
    return ",\n".join(steps)


def extraction_ctes(view: str = "fx_completions") -> str:
    """CTEs ending in ``px(prompt_id, attempt, batch_id, pos, user, assistant)`` (all rows of ``view``)."""
    strip_l = _strip("l")
    return f"""
e0 AS (SELECT prompt_id, attempt, batch_id, pos, {_PROMPT_SQL} AS pr, {_ECHO_SQL} AS g FROM {view}),
e1 AS (SELECT prompt_id, attempt, batch_id, pos,
         {_strip(f"CASE WHEN length(pr) > 0 AND contains(g, pr) THEN {_strip('replace(g, pr, {q}{q})'.format(q=chr(39)))} ELSE g END")} AS t FROM e0),
e2 AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda l: {strip_l}), lambda l: l <> '') AS ls FROM e1),
l1 AS (SELECT prompt_id, pos, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM e2),
l2 AS (SELECT *, CASE WHEN regexp_matches(lower(line), '^(user|human|question|q):') THEN 'user'
                      WHEN regexp_matches(lower(line), '^(assistant|ai|answer|response|a):') THEN 'assistant' END AS mrole FROM l1),
l3 AS (SELECT *, sum(CASE WHEN mrole IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY prompt_id, pos ORDER BY i) AS seg FROM l2),
s0 AS (SELECT prompt_id, pos, seg, max(mrole) AS role,
         coalesce({_strip(f"string_agg(CASE WHEN mrole IS NULL THEN line ELSE nullif({_strip('substr(line, strpos(line, chr(58)) + 1)')}, '') END, chr(10) ORDER BY i)")}, '') AS content
       FROM l3 WHERE seg > 0 GROUP BY prompt_id, pos, seg),
s1 AS (SELECT *, lead(role) OVER (PARTITION BY prompt_id, pos ORDER BY seg) AS nrole FROM s0),
s2 AS (SELECT prompt_id, pos,
         max_by(content, seg) FILTER (WHERE role = 'user' AND content <> '' AND (nrole IS NULL OR nrole <> role)) AS u,
         max_by(content, seg) FILTER (WHERE role = 'assistant' AND content <> '' AND (nrole IS NULL OR nrole <> role)) AS a
       FROM s1 GROUP BY prompt_id, pos),
f0 AS (SELECT e2.prompt_id, e2.attempt, e2.batch_id, e2.pos, e2.ls, coalesce(s2.u, '') AS u, coalesce(s2.a, '') AS a,
              string_split(e2.t, chr(10) || chr(10)) AS bl
       FROM e2 LEFT JOIN s2 ON s2.prompt_id = e2.prompt_id AND s2.pos = e2.pos),
f1 AS (SELECT prompt_id, attempt, batch_id, pos,
         CASE WHEN u <> '' AND a <> '' THEN u WHEN len(bl) >= 2 THEN {_strip('bl[1]')} WHEN len(ls) >= 2 THEN ls[1] ELSE u END AS usr,
         CASE WHEN u <> '' AND a <> '' THEN a WHEN len(bl) >= 2 THEN {_strip("array_to_string(bl[2:], chr(10) || chr(10))")}
              WHEN len(ls) >= 2 THEN array_to_string(ls[2:], chr(10)) ELSE a END AS ast
       FROM f0),
{_clean_steps('f1', ['usr', 'ast'], ['prompt_id', 'attempt', 'batch_id', 'pos'], 'px0')},
px AS (SELECT prompt_id, attempt, batch_id, pos, usr AS "user", ast AS assistant FROM px0)
"""


def _existing_ctes() -> str:
    """``ex_hash``: hashes of complete flat pairs of the conversations table."""
    return f"""
xf AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx, role, text FROM conversations),
xp AS (SELECT idx // 2 AS pid, count(*) AS n, max(text) FILTER (WHERE idx % 2 = 0) AS u,
              max(text) FILTER (WHERE idx % 2 = 1) AS a FROM xf GROUP BY idx // 2),
ex_hash AS (SELECT DISTINCT md5({_strip("coalesce(u, '')")} || {_strip("coalesce(a, '')")}) AS pair_hash FROM xp WHERE n = 2)
"""


def unique_ctes(view: str = "fx_completions") -> str:
    """CTEs ending in ``uq``: a loop over the batches in order (``lp``) that carries the
    hashes taken so far and keeps each batch's first attempt with another one."""
    return "WITH RECURSIVE " + extraction_ctes(view) + "," + _existing_ctes() + f""",
vp AS (SELECT *, md5({_strip('"user"')} || {_strip('assistant')}) AS pair_hash FROM px
       WHERE length("user") > 5 AND length(assistant) > 5),
fresh AS (SELECT * FROM vp WHERE pair_hash NOT IN (SELECT pair_hash FROM ex_hash)),
ba AS (SELECT batch_id, attempt, list(DISTINCT pair_hash) AS hs FROM fresh GROUP BY batch_id, attempt),
bl AS (SELECT batch_id, list({{'a': attempt, 'hs': hs}} ORDER BY attempt) AS tries, row_number() OVER (ORDER BY batch_id) AS k
       FROM ba GROUP BY batch_id),
lp AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS owned, CAST(NULL AS BIGINT) AS batch_id, CAST(NULL AS BIGINT) AS attempt
  UNION ALL
  SELECT k, list_concat(owned, coalesce(pick.hs, [])), batch_id, CAST(pick.a AS BIGINT) FROM (
    SELECT bl.k, lp.owned, bl.batch_id,
           list_filter(bl.tries, lambda t: len(list_filter(t.hs, lambda h: NOT list_contains(lp.owned, h))) > 0)[1] AS pick
    FROM lp JOIN bl ON bl.k = lp.k + 1)),
ch AS (SELECT fresh.* FROM fresh JOIN lp ON lp.batch_id = fresh.batch_id AND lp.attempt = fresh.attempt),
uq AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY pair_hash ORDER BY batch_id, attempt, pos, prompt_id) AS rn FROM ch)
       WHERE rn = 1)
"""


_UNIQUE_SQL = unique_ctes()


# ----------------------------------------------------------------- spark side

def completions(spark, sf_dir, view="fx_completions"):
    fx = fixture(spark, sf_dir, view)
    prompt = F.concat(F.lit("Generate exactly one realistic conversation about topic "),
                      (F.col("prompt_id") % 3).cast("string"), F.lit("."))
    echoed = F.when(F.col("prompt_id") % 2 == 0, F.concat(prompt, F.lit("\n"), F.col("generated_text"))).otherwise(
        F.col("generated_text"))
    return fx.select("prompt_id", "attempt", "batch_id", "pos",
                     remove_prompt_echo(echoed, prompt).alias("generated_text"))


def pairs(spark, sf_dir, view="fx_completions"):
    return C.extract_pairs(completions(spark, sf_dir, view))


def flat_conversations(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    flat = C.flat_positions(conv, "conv_id", "turn")
    return flat.select("idx", "role", F.col("text").alias("content"), F.col("text").isNotNull().alias("has_content"))


def unique(spark, sf_dir, view="fx_completions"):
    return C.unique_pairs(pairs(spark, sf_dir, view), C.existing_hashes(flat_conversations(spark, sf_dir)))


@register("pair_extract", oracle(["fx_completions"], "WITH " + extraction_ctes() + """
SELECT prompt_id, attempt, batch_id, pos, "user", assistant FROM px WHERE length("user") > 5 AND length(assistant) > 5"""))
def pair_extract(spark, sf_dir):
    """P-34 + P-10 + P-9 + F-8: valid (user, assistant) pairs from model completions."""
    return C.valid_pairs(pairs(spark, sf_dir)).select("prompt_id", "attempt", "batch_id", "pos", "user", "assistant")


@register("pair_unique", oracle(["fx_completions"], _UNIQUE_SQL + """
SELECT batch_id, attempt, pos, prompt_id, pair_hash, "user", assistant FROM uq"""))
def pair_unique(spark, sf_dir):
    """P-7 + J-1 + W-5 + W-6: new, unique pairs in generation order."""
    return unique(spark, sf_dir).select("batch_id", "attempt", "pos", "prompt_id", "pair_hash", "user", "assistant")


@register("pair_retries", oracle(["fx_retries"], unique_ctes("fx_retries") + """
SELECT batch_id, attempt, pos, prompt_id, pair_hash, "user", assistant FROM uq"""))
def pair_retries(spark, sf_dir):
    """W-5 where attempts repeat earlier batches: each batch keeps its first attempt
    with a pair that is new when its turn comes."""
    return unique(spark, sf_dir, "fx_retries").select("batch_id", "attempt", "pos", "prompt_id", "pair_hash", "user", "assistant")


@register("pair_history", oracle(["fx_completions"], _UNIQUE_SQL + """
SELECT prompt_id, pos, pair_hash FROM fresh"""))
def pair_history(spark, sf_dir):
    """J-1 + SET-4 against an index kept over three runs: valid pairs that no run has stored."""
    path = fresh_path(spark, "pair-history")
    stored = stage(C.existing_hashes(flat_conversations(spark, sf_dir)), "stored-hashes")
    third = F.pmod(F.xxhash64("pair_hash"), F.lit(3))
    for run in range(3):
        add_keys(stored.where(third == run), "pair_hash", path)
    cand = C.valid_pairs(pairs(spark, sf_dir)).withColumn("pair_hash", pair_hash("user", "assistant"))
    return unseen(stage(cand, "candidates"), "pair_hash", path).select("prompt_id", "pos", "pair_hash")


@register("pair_union", oracle(["fx_completions"], _UNIQUE_SQL + """,
xe AS (SELECT pid, u, a FROM xp WHERE n = 2)
SELECT 'existing' AS origin, pid AS entry_idx, 0 AS entry_pos, u AS user_content, 'user' AS user_role, a AS assistant_content, 'assistant' AS assistant_role FROM xe
UNION ALL
SELECT 'generated', batch_id, pos, "user", 'user', assistant, 'assistant' FROM uq"""))
def pair_union(spark, sf_dir):
    """SET-1 + P-31: existing entries then generated entries as nested
    messages (flattened for comparison)."""
    flat = flat_conversations(spark, sf_dir)
    ex = C.flat_to_pairs(flat).where(F.col("n") == 2).select(
        F.lit("existing").alias("origin"), F.col("pair_idx").alias("entry_idx"), F.lit(0).cast("long").alias("entry_pos"),
        "user", "assistant")
    gen = C.unique_pairs(pairs(spark, sf_dir), C.existing_hashes(flat)).select(F.lit("generated").alias("origin"), F.col("batch_id").cast("long").alias("entry_idx"),
                                       F.col("pos").cast("long").alias("entry_pos"), "user", "assistant")
    entries = C.nested_entries(ex.unionByName(gen))
    m = F.col("messages")
    return entries.select("origin", "entry_idx", "entry_pos", m[0]["content"].alias("user_content"), m[0]["role"].alias("user_role"),
                          m[1]["content"].alias("assistant_content"), m[1]["role"].alias("assistant_role"))


@register("batch_shortfall", oracle(["fx_completions"], _UNIQUE_SQL + f""",
bt AS (SELECT DISTINCT batch_id FROM fx_completions),
ne AS (SELECT count(DISTINCT prompt_id) AS n FROM fx_completions),
pr AS (SELECT bt.batch_id, coalesce(count(uq.pair_hash), 0) AS produced FROM bt LEFT JOIN uq ON uq.batch_id = bt.batch_id GROUP BY bt.batch_id),
cu AS (SELECT batch_id, produced, sum(produced) OVER (ORDER BY batch_id) AS running_total FROM pr)
SELECT batch_id, CAST(least({BATCH_SIZE}, ne.n - (running_total - produced)) AS BIGINT) AS requested,
       CAST(produced AS BIGINT) AS produced, produced < least({BATCH_SIZE}, ne.n - (running_total - produced)) AS shortfall,
       CAST(running_total AS BIGINT) AS running_total
FROM cu, ne"""))
def batch_shortfall(spark, sf_dir):
    """A-14: requested vs produced per batch, shortfall and running total."""
    prompts = fixture(spark, sf_dir, "fx_completions").select("prompt_id", "batch_id")
    return C.batch_shortfall(prompts, unique(spark, sf_dir), BATCH_SIZE)


_FLAT_SQL = """
WITH xf AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx, role, text FROM conversations),
xp AS (SELECT idx // 2 AS pid, count(*) AS n,
              max(role) FILTER (WHERE idx % 2 = 0) AS ur, max(role) FILTER (WHERE idx % 2 = 1) AS ar,
              bool_or(text IS NOT NULL AND idx % 2 = 0) AS uc, bool_or(text IS NOT NULL AND idx % 2 = 1) AS ac
       FROM xf GROUP BY idx // 2),
pv AS (SELECT pid * 2 AS "index", (ur = 'user' AND ar = 'assistant' AND uc AND ac) AS valid FROM xp WHERE n = 2)
"""


@register("flat_validate", oracle([], _FLAT_SQL + """
SELECT t.total_messages, t.total_messages % 2 = 0 AS even_length,
       CASE WHEN t.total_messages % 2 = 0 THEN v.vp END AS valid_pairs,
       CASE WHEN t.total_messages % 2 = 0 THEN v.ip END AS invalid_pairs
FROM (SELECT count(*) AS total_messages FROM conversations) t,
     (SELECT count(*) FILTER (WHERE valid) AS vp, count(*) FILTER (WHERE NOT valid) AS ip FROM pv) v"""))
def flat_validate(spark, sf_dir):
    """W-7 + V-1 + A-12: validation summary of the flat layout."""
    _, summary = C.validate_flat(flat_conversations(spark, sf_dir))
    return summary


@register("flat_invalid_pairs", oracle([], _FLAT_SQL + """
SELECT "index" FROM pv WHERE NOT valid"""))
def flat_invalid_pairs(spark, sf_dir):
    """V-1: indices of invalid flat pairs."""
    per_pair, _ = C.validate_flat(flat_conversations(spark, sf_dir))
    return per_pair.where(~F.col("valid")).select("index")


_NESTED_SQL = """
WITH j AS (SELECT entry_idx, CASE WHEN json_valid(entry) THEN entry END AS entry, json_valid(entry) AS ok FROM fx_entry_json),
r AS (SELECT entry_idx,
  CASE WHEN NOT ok THEN 0
       WHEN json_type(entry) <> 'OBJECT' THEN 3
       WHEN json_extract(entry, '$.messages') IS NULL THEN 4
       WHEN json_type(entry, '$.messages') <> 'ARRAY' OR json_array_length(entry, '$.messages') <> 2 THEN 5 END AS r,
  CASE WHEN json_type(entry, '$.messages[0]') <> 'OBJECT' THEN 6
       WHEN json_extract(entry, '$.messages[0].content') IS NULL OR json_extract(entry, '$.messages[0].role') IS NULL THEN 7
       WHEN coalesce(json_extract_string(entry, '$.messages[0].role') NOT IN ('user', 'assistant')
                     OR json_type(entry, '$.messages[0].role') <> 'VARCHAR', true) THEN 8 END AS r0,
  CASE WHEN json_type(entry, '$.messages[1]') <> 'OBJECT' THEN 6
       WHEN json_extract(entry, '$.messages[1].content') IS NULL OR json_extract(entry, '$.messages[1].role') IS NULL THEN 7
       WHEN coalesce(json_extract_string(entry, '$.messages[1].role') NOT IN ('user', 'assistant')
                     OR json_type(entry, '$.messages[1].role') <> 'VARCHAR', true) THEN 8 END AS r1
  FROM j),
v AS (SELECT entry_idx, coalesce(r, r0, r1) AS rule,
        CASE WHEN r IS NULL AND r0 IS NOT NULL THEN 0 WHEN r IS NULL AND r1 IS NOT NULL THEN 1 END AS message_idx FROM r)
"""


@register("nested_validate", oracle(["fx_entry_json"], _NESTED_SQL + """
SELECT entry_idx, rule, message_idx FROM v"""))
def nested_validate(spark, sf_dir):
    """V-2: first failing rule per nested entry."""
    return C.validate_nested(fixture(spark, sf_dir, "fx_entry_json"))


@register("nested_validate_summary", oracle(["fx_entry_json"], _NESTED_SQL + """
SELECT (SELECT count(*) FROM v) AS entries,
       (SELECT count(*) FROM v) > 0 AND (SELECT count(*) FROM v WHERE rule IS NOT NULL) = 0 AS is_valid,
       f.entry_idx AS first_violation_entry, f.rule AS first_violation_rule
FROM (SELECT 1) d LEFT JOIN (SELECT entry_idx, rule FROM v WHERE rule IS NOT NULL
                             ORDER BY entry_idx, coalesce(message_idx, -1), rule LIMIT 1) f ON true"""))
def nested_validate_summary(spark, sf_dir):
    """V-2: dataset verdict and first violation."""
    return C.nested_summary(C.validate_nested(fixture(spark, sf_dir, "fx_entry_json")))


_VIOLATIONS_SQL = """
WITH j AS (SELECT entry_idx, CASE WHEN json_valid(entry) THEN entry END AS entry FROM fx_entry_json),
t AS (SELECT entry_idx, entry, json_type(entry) AS kind, json_type(entry, '$.messages') AS list FROM j),
m AS (SELECT entry_idx, i AS message_idx, json_extract(entry, '$.messages[' || i || ']') AS m FROM (
  SELECT entry_idx, entry, unnest(range(CAST(json_array_length(entry, '$.messages') AS BIGINT))) AS i FROM t WHERE kind = 'OBJECT' AND list = 'ARRAY')),
x AS (
  SELECT entry_idx, NULL AS message_idx, 0 AS rule, NULL AS field FROM t WHERE entry IS NULL
  UNION ALL SELECT entry_idx, NULL, 3, NULL FROM t WHERE kind <> 'OBJECT'
  UNION ALL SELECT entry_idx, NULL, 4, 'messages' FROM t WHERE kind = 'OBJECT' AND list IS NULL
  UNION ALL SELECT entry_idx, NULL, 5, 'messages' FROM t WHERE kind = 'OBJECT' AND (list <> 'ARRAY' OR json_array_length(entry, '$.messages') <> 2)
  UNION ALL SELECT entry_idx, message_idx, 6, NULL FROM m WHERE json_type(m) <> 'OBJECT'
  UNION ALL SELECT entry_idx, message_idx, 7, 'content' FROM m WHERE json_type(m) = 'OBJECT' AND json_extract(m, '$.content') IS NULL
  UNION ALL SELECT entry_idx, message_idx, 7, 'role' FROM m WHERE json_type(m) = 'OBJECT' AND json_extract(m, '$.role') IS NULL
  UNION ALL SELECT entry_idx, message_idx, 8, 'role' FROM m WHERE json_type(m) = 'OBJECT' AND json_extract(m, '$.role') IS NOT NULL
    AND (json_type(m, '$.role') <> 'VARCHAR' OR json_extract_string(m, '$.role') NOT IN ('user', 'assistant')))
"""


@register("nested_violations", oracle(["fx_entry_json"], _VIOLATIONS_SQL + """
SELECT entry_idx, CAST(message_idx AS INTEGER) AS message_idx, CAST(rule AS INTEGER) AS rule, field FROM x"""))
def nested_violations(spark, sf_dir):
    """V-2: every rule that an entry or one of its messages breaks."""
    return C.entry_violations(fixture(spark, sf_dir, "fx_entry_json"))


@register("nested_verdict", oracle(["fx_entry_json"], _VIOLATIONS_SQL + """,
o AS (SELECT *, (entry_idx, coalesce(message_idx, -1), rule) AS place FROM x)
SELECT (SELECT count(*) FROM t) AS entries, count(DISTINCT entry_idx) AS invalid_entries, count(*) AS violations,
       """ + ", ".join(f"count(*) FILTER (WHERE rule = {r}) AS rule_{r}" for r in (0, 3, 4, 5, 6, 7, 8)) + """,
       (SELECT count(*) FROM t) > 0 AND count(*) = 0 AS is_valid, arg_min(entry_idx, place) AS first_entry,
       CAST(nullif(arg_min(coalesce(message_idx, -1), place), -1) AS INTEGER) AS first_message,
       CAST(arg_min(rule, place) AS INTEGER) AS first_rule
FROM o"""))
def nested_verdict(spark, sf_dir):
    """V-2: counts by rule, the verdict and the first violation of the dataset."""
    entries = fixture(spark, sf_dir, "fx_entry_json")
    return C.dataset_verdict(entries, C.entry_violations(entries))


@register("entry_paths", oracle(["fx_entry_json"], """
WITH j AS (SELECT entry_idx, CASE WHEN json_valid(entry) THEN entry END AS entry FROM fx_entry_json),
v AS (SELECT entry_idx, regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path, t.type AS type,
             CASE WHEN t.type = 'ARRAY' THEN CAST(json_array_length(t.value) AS INTEGER) END AS items
      FROM j, json_tree(j.entry) t WHERE entry IS NOT NULL),
k AS (SELECT entry_idx, path, items, CASE WHEN type IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL') THEN lower(type)
        WHEN type = 'VARCHAR' THEN 'string' ELSE 'number' END AS kind FROM v
      UNION ALL SELECT entry_idx, '$', NULL, 'malformed' FROM j WHERE entry IS NULL)
SELECT path, kind, items, count(*) AS n, count(DISTINCT entry_idx) AS entries FROM k GROUP BY path, kind, items"""))
def entry_paths(spark, sf_dir):
    """A-18: kinds and list sizes at every path of the entries, however deep."""
    return C.path_profile(fixture(spark, sf_dir, "fx_entry_json"))


@register("entry_profile", oracle(["fx_entry_json"], """
WITH j AS (SELECT CASE WHEN json_valid(entry) THEN entry END AS entry FROM fx_entry_json),
k AS (SELECT entry,
  CASE WHEN entry IS NULL THEN 'malformed' WHEN json_type(entry) = 'OBJECT' THEN 'object'
       WHEN json_type(entry) = 'ARRAY' THEN 'array' ELSE 'scalar' END AS kind FROM j),
s AS (SELECT kind,
  CASE WHEN kind = 'object' THEN array_to_string(list_sort(json_keys(entry)), ',') END AS keys,
  CASE WHEN kind = 'object' AND json_extract(entry, '$.messages') IS NOT NULL THEN
       CASE json_type(entry, '$.messages') WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'scalar' END END AS messages_kind,
  CASE WHEN kind = 'object' AND json_type(entry, '$.messages') = 'ARRAY' THEN CAST(json_array_length(entry, '$.messages') AS INTEGER) END AS messages_len
  FROM k)
SELECT kind, keys, messages_kind, messages_len, count(*) AS entries FROM s GROUP BY ALL"""))
def entry_profile(spark, sf_dir):
    """A-18: entries per JSON shape."""
    return C.entry_shapes(fixture(spark, sf_dir, "fx_entry_json"))


@register("entry_key_profile", oracle(["fx_entry_json"], """
WITH j AS (SELECT CASE WHEN json_valid(entry) THEN entry END AS entry FROM fx_entry_json),
o AS (SELECT entry, unnest(json_keys(entry)) AS key FROM j WHERE json_type(entry) = 'OBJECT'),
t AS (SELECT key, json_extract(entry, '$.' || key) AS value FROM o),
k AS (SELECT key, CASE json_type(value) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'scalar' END AS value_kind,
             CASE WHEN json_type(value) = 'ARRAY' THEN CAST(json_array_length(value) AS INTEGER) END AS items FROM t)
SELECT key, value_kind, items, count(*) AS entries FROM k GROUP BY ALL"""))
def entry_key_profile(spark, sf_dir):
    """A-18: kinds of value and list sizes per key."""
    return C.key_profile(fixture(spark, sf_dir, "fx_entry_json"))


@register("entry_preview", oracle(["fx_entry_json"], """
SELECT entry_idx, substr(entry, 1, 200) AS preview FROM fx_entry_json ORDER BY entry_idx LIMIT 3"""))
def entry_preview(spark, sf_dir):
    """W-12: the first three entries, first 200 characters each."""
    e = fixture(spark, sf_dir, "fx_entry_json")
    return e.orderBy("entry_idx").limit(3).select("entry_idx", F.substring("entry", 1, 200).alias("preview"))


@register("length_limits", oracle([], """
SELECT conv_id, turn FROM (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY md5(text) ORDER BY conv_id, turn) AS rn
  FROM conversations WHERE length(text) BETWEEN 10 AND 2000) WHERE rn = 1"""))
def length_limits(spark, sf_dir):
    """F-12: content length 10..2000 and first copy of each text."""
    conv = read_table(spark, sf_dir, "conversations")
    return C.length_limits(conv, "text", ["conv_id", "turn"]).select("conv_id", "turn")


# -- template specs derived from the region / nation tables

_SPEC_REGION = """
SELECT r_regionkey AS spec_id, r_name AS topic,
  concat('How do I {task} with {', lower(r_name), '} in ', r_name, '?') AS input_template,
  concat('Here is how to {task}: {explanation} ({Issue}) {fix}') AS output_template,
  CASE WHEN r_regionkey % 2 = 0 THEN MAPFN(['task'], ['a task described by the caller']) ELSE MAPFN(['zzz'], ['unused']) END AS variable_descriptions
FROM region
"""

_SPEC_NATION = """
SELECT n_nationkey AS spec_id, n_name AS topic,
  CASE WHEN n_nationkey % 3 = 0 THEN concat('Tell me about ', n_name) ELSE concat('How do I {task} in ', n_name, '?') END AS input_template,
  CASE WHEN n_nationkey % 3 = 0 THEN 'Plain answer.' ELSE 'Here is how to {task}: {explanation} {thing}' END AS output_template,
  CASE WHEN n_nationkey % 2 = 0 THEN MAPFN(['thing'], ['a concrete thing']) ELSE MAPFN(['other'], ['x']) END AS variable_descriptions,
  n_nationkey % 4 + 1 AS num_entries, 2 AS batch_size
FROM nation
"""


def _specs(spark, sf_dir, sql, table):
    from ..sources.tables import private_sql, private_view

    read_table(spark, sf_dir, table).createOrReplaceTempView(private_view(table))
    spark_sql = sql.replace("MAPFN([", "map_from_arrays(array(").replace("], [", "), array(").replace("])", "))")
    return spark.sql(private_sql(spark_sql))


def _desc_sql(var: str, topic: str, descs: str) -> str:
    cases = " ".join(f"WHEN lower({var}) IN ({', '.join(repr(n) for n in names)}) THEN '{text}'"
                     for names, text in VARIABLE_GROUPS)
    return (f"CASE WHEN list_contains(map_keys({descs}), {var}) THEN map_extract_value({descs}, {var}) "
            f"{cases} ELSE 'specific ' || {var} || ' related to ' || {topic} END")


@register("template_vars", oracle([], "WITH sp AS (" + _SPEC_REGION.replace("MAPFN", "MAP") + """),
v AS (SELECT spec_id, topic, variable_descriptions AS d,
             unnest(list_sort(list_distinct(list_concat(regexp_extract_all(input_template, '\\{([^}]+)\\}', 1),
                                                        regexp_extract_all(output_template, '\\{([^}]+)\\}', 1))))) AS var FROM sp)
SELECT spec_id, var, """ + _desc_sql("var", "topic", "d") + """ AS description FROM v"""))
def template_vars(spark, sf_dir):
    """P-25 + P-26 + A-17 + SET-3 + J-7: template variables and their descriptions."""
    from ..functions.chat import template_variables, variable_description
    sp = _specs(spark, sf_dir, _SPEC_REGION, "region")
    v = sp.select("spec_id", "topic", "variable_descriptions",
                  F.explode(template_variables(F.col("input_template"), F.col("output_template"))).alias("var"))
    return v.select("spec_id", "var", variable_description(F.col("var"), F.col("variable_descriptions"),
                                                           F.col("topic")).alias("description"))


def _prompt_ctes(spec_sql: str) -> str:
    """CTEs ``sp, v, r, p, e`` ending in ``e(spec_id, prompt, batch_size, entry_no)``:
    the DuckDB rendering of P-27 and the J-6 expansion for the given specs."""
    from ..functions.chat import (PROMPT_FORMAT, PROMPT_FORMAT_2, PROMPT_HEAD, PROMPT_RULES, PROMPT_VARS_HEAD,
                                  PROMPT_VARS_MEANINGS, PROMPT_VARS_TAIL)

    def lit(t):
        parts = t.split("\n")
        return "concat(" + ", chr(10), ".join("'" + x.replace("'", "''") + "'" for x in parts) + ")"

    rules_head, rules_tail = PROMPT_RULES.split("{vars}")
    rules_tail = rules_tail.replace("{{", "{").replace("}}", "}")
    desc = _desc_sql("x", "topic", "variable_descriptions")
    return "sp AS (" + spec_sql.replace("MAPFN", "MAP") + f"""),
v AS (SELECT *, list_sort(list_distinct(list_concat(regexp_extract_all(input_template, '\\{{([^}}]+)\\}}', 1),
                                                    regexp_extract_all(output_template, '\\{{([^}}]+)\\}}', 1)))) AS vars FROM sp),
r AS (SELECT *, CASE WHEN len(vars) > 0 THEN concat({lit(PROMPT_VARS_HEAD)}, array_to_string(vars, ', '), chr(10), 'Topic: ', topic,
          {lit(PROMPT_VARS_MEANINGS)}, array_to_string(list_transform(vars, lambda x: concat(chr(10), '- {{', x, '}}: ', {desc})), ''),
          {lit(PROMPT_VARS_TAIL)}) ELSE '' END AS vb FROM v),
p AS (SELECT spec_id, num_entries, batch_size,
        {_strip(f"concat({lit(PROMPT_HEAD)}, topic, {lit(PROMPT_FORMAT)}, input_template, {lit(PROMPT_FORMAT_2)}, output_template, {lit(rules_head)}, vb, {lit(rules_tail)})")} AS prompt
      FROM r),
e AS (SELECT spec_id, prompt, batch_size, unnest(range(1, num_entries + 1)) AS entry_no FROM p)"""


def _prompt_oracle() -> str:
    return "WITH " + _prompt_ctes(_SPEC_NATION) + """
SELECT spec_id, entry_no, CAST((entry_no - 1) // batch_size AS BIGINT) AS batch_id, prompt FROM e"""


@register("prompt_render", _prompt_oracle())
def prompt_render(spark, sf_dir):
    """J-6 + P-27: one rendered generation prompt per requested entry."""
    sp = _specs(spark, sf_dir, _SPEC_NATION, "nation")
    ex = C.expand_specs(sp)
    return ex.select("spec_id", "entry_no", "batch_id", "prompt")


@register("judge_prompt", oracle([], _FLAT_SQL.replace(
    "max(role) FILTER (WHERE idx % 2 = 0) AS ur", "max(text) FILTER (WHERE idx % 2 = 0) AS ut, max(role) FILTER (WHERE idx % 2 = 0) AS ur").replace(
    "max(role) FILTER (WHERE idx % 2 = 1) AS ar", "max(text) FILTER (WHERE idx % 2 = 1) AS atx, max(role) FILTER (WHERE idx % 2 = 1) AS ar") + """
SELECT pid AS entry_idx, md5(concat(chr(10), 'Evaluate this conversation about React JS on a scale of 1-10:', chr(10), chr(10), 'User: ', ut,
  chr(10), 'Assistant: ', atx, chr(10), chr(10), 'Rate each aspect (1-10):', chr(10),
  '1. RELEVANCE: Does the assistant directly address the user''s question?', chr(10),
  '2. ACCURACY: Is the technical information correct and reliable?', chr(10),
  '3. COMPLETENESS: Does it provide a complete solution/answer?', chr(10),
  '4. CLARITY: Is the response clear and easy to understand?', chr(10),
  '5. SPECIFICITY: Are examples concrete and specific (not generic)?', chr(10), chr(10),
  'Format your response as:', chr(10), 'RELEVANCE: [score]', chr(10), 'ACCURACY: [score] ', chr(10),
  'COMPLETENESS: [score]', chr(10), 'CLARITY: [score]', chr(10), 'SPECIFICITY: [score]', chr(10),
  'OVERALL: [average score]', chr(10), 'REASON: [brief explanation]')) AS prompt_md5
FROM xp WHERE n = 2"""))
def judge_prompt_q(spark, sf_dir):
    """P-35 + P-28: entries -> (user, assistant) -> evaluation prompt."""
    flat = flat_conversations(spark, sf_dir)
    entries = C.nested_entries(C.flat_to_pairs(flat).where(F.col("n") == 2))
    m = F.col("messages")
    return entries.select(F.col("pair_idx").alias("entry_idx"),
                          F.md5(judge_prompt(m[0]["content"], m[1]["content"])).alias("prompt_md5"))


_SPEC_WORDS = """
SELECT conv_id, turn, concat('Say {', split_part(text, ' ', 1), '} or {', split_part(text, ' ', 2), ' x} to {user_', role, '}') AS template
FROM conversations
"""


@register("template_vars_words", oracle([], "WITH sp AS (" + _SPEC_WORDS + """)
SELECT conv_id, turn, unnest(list_sort(list_distinct(regexp_extract_all(template, '\\{([\\pL\\pN_]+)\\}', 1)))) AS var FROM sp"""))
def template_vars_words(spark, sf_dir):
    """P-25, interactive form: only names of word characters are variables."""
    from ..functions.chat import WORD_NAME, template_variables
    sp = _specs(spark, sf_dir, _SPEC_WORDS, "conversations")
    return sp.select("conv_id", "turn", F.explode(template_variables(F.col("template"), name=WORD_NAME)).alias("var"))
