"""Derived input views.

The driver tables hold pages, documents and conversations but no repository
trees, judge outputs or model completions.  The views below derive those
shapes from the driver tables with SQL that yields identical rows in Spark and
DuckDB, so one text serves both the Spark query and the DuckDB oracle.  Their
size grows with the driver tables (one row per document / conversation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import fence
from .tables import private_sql, private_view, register_tables

# name -> (sql, [views/tables it reads])
FIXTURE_SQL: dict[str, tuple[str, list[str]]] = {}


def _fx(name: str, deps: list[str], sql: str) -> None:
    FIXTURE_SQL[name] = (sql.strip(), deps)


_fx("fx_paths", ["documents"], """
SELECT concat('org', CAST(doc_id % 5 AS STRING)) AS owner,
  concat(source, '-', CAST(CAST(floor(doc_id / 400) AS BIGINT) AS STRING)) AS repo, doc_id AS pos,
  CASE doc_id % 17
    WHEN 0 THEN concat('src/components/Widget', CAST(doc_id AS STRING), '.tsx')
    WHEN 1 THEN concat('src/utils/helper', CAST(doc_id AS STRING), '.ts')
    WHEN 2 THEN concat('src/hooks/use', CAST(doc_id AS STRING), '.js')
    WHEN 3 THEN concat('tests/unit/a', CAST(doc_id AS STRING), '.spec.ts')
    WHEN 4 THEN concat('docs/guide', CAST(doc_id AS STRING), '.md')
    WHEN 5 THEN concat('pages/p', CAST(doc_id AS STRING), '.jsx')
    WHEN 6 THEN concat('services/api/v1/a/b/c/d/e/f/deep', CAST(doc_id AS STRING), '.py')
    WHEN 7 THEN concat('pkg', CAST(doc_id AS STRING), '/package.json')
    WHEN 8 THEN concat('node_modules/m/i', CAST(doc_id AS STRING), '.js')
    WHEN 9 THEN concat('layout/out', CAST(doc_id AS STRING), '.css')
    WHEN 10 THEN concat('root', CAST(doc_id AS STRING), '.rs')
    WHEN 11 THEN concat('app/settings', CAST(doc_id AS STRING), '.yaml')
    WHEN 12 THEN concat('LICENSE-', CAST(doc_id AS STRING))
    WHEN 13 THEN concat('public/app', CAST(doc_id AS STRING), '.min.js')
    WHEN 14 THEN concat('ops', CAST(doc_id AS STRING), '/Dockerfile')
    WHEN 15 THEN concat('src/dir', CAST(doc_id AS STRING))
    ELSE concat('notebooks/n.v', CAST(doc_id AS STRING), '.ipynb') END AS path,
  CASE WHEN doc_id % 17 = 15 THEN 'tree' ELSE 'blob' END AS type,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars END AS size
FROM documents
""")

_fx("fx_code_files", ["documents", "fx_paths"], """
SELECT p.owner, p.repo, p.path, CASE WHEN d.doc_id % 3 = 0 THEN 'master' ELSE 'main' END AS branch,
  concat(CASE WHEN d.doc_id % 2 = 0 THEN concat('// Copyright (c) x. Licensed under y', chr(10)) ELSE '' END,
         CASE WHEN d.doc_id % 5 = 0 THEN concat('/*', repeat('-', 93), chr(10), ' * header', chr(10), ' *', repeat('-', 92), '*/', chr(10)) ELSE '' END,
         CASE WHEN d.doc_id % 4 <> 0 THEN concat('import React from "react";', chr(10)) ELSE '' END,
         CASE WHEN d.doc_id % 7 < 4 THEN concat('/** @param props */', chr(10), 'export default function Widget(props) {', chr(10), '  const f = () => useState(0);', chr(10), '  if (props.x) { for (;;) {} }', chr(10)) ELSE concat('class Api:', chr(10), '    def method(self):', chr(10)) END,
         '  ', replace(d.text, '. ', concat('.', chr(10), '  ')), chr(10),
         CASE WHEN d.doc_id % 13 = 0 THEN repeat('TODO ', 60) ELSE '' END) AS content
FROM documents d JOIN fx_paths p ON p.pos = d.doc_id WHERE p.type = 'blob' AND d.doc_id % 19 <> 0
""")

_fx("fx_domains", ["documents"], """
SELECT doc_id AS row_id,
  CASE doc_id % 9
    WHEN 0 THEN concat('https://www.math', CAST(CAST(floor(doc_id / 27) AS BIGINT) AS STRING), '.edu/a/b?x=1')
    WHEN 1 THEN concat('http://Physics', CAST(CAST(floor(doc_id / 36) AS BIGINT) AS STRING), '.org#top')
    WHEN 2 THEN concat('summit', CAST(CAST(floor(doc_id / 45) AS BIGINT) AS STRING), '.com:8080')
    WHEN 3 THEN concat('HTTPS://upper', CAST(doc_id AS STRING), '.com')
    WHEN 4 THEN 'bad_domain'
    WHEN 5 THEN ''
    WHEN 6 THEN NULL
    WHEN 7 THEN concat('www.shop', CAST(CAST(floor(doc_id / 18) AS BIGINT) AS STRING), '.co.uk?x')
    ELSE concat('  news', CAST(CAST(floor(doc_id / 63) AS BIGINT) AS STRING), '.net  ') END AS domain
FROM documents
""")

_fx("fx_completions", ["conversations"], """
SELECT u.conv_id AS prompt_id, u.conv_id % 3 + 1 AS attempt, CAST(floor(u.conv_id / 8) AS BIGINT) AS batch_id, u.turn AS pos,
  CASE WHEN u.conv_id % 10 = 9 THEN concat('User: same question', chr(10), 'Assistant: same answer')
    ELSE CASE u.conv_id % 7
      WHEN 0 THEN concat('User: ', u.text, chr(10), 'Assistant: ', a.text)
      WHEN 1 THEN concat('Q: ', u.text, chr(10), 'A: "', a.text, '"')
      WHEN 2 THEN concat(u.text, chr(10), chr(10), a.text)
      WHEN 3 THEN concat('Human:', chr(10), u.text, chr(10), 'AI:', chr(10), a.text, chr(10), 'User: more {slot} here')
      WHEN 4 THEN concat('Assistant: ', a.text, chr(10), 'Question: ', u.text)
      WHEN 5 THEN 'User: hi'
      ELSE concat('user: user: {task} ', u.text, chr(10), 'Response:   ', a.text) END END AS generated_text
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
""")

# Attempts that repeat one another: within 16 batches, attempt a of batch b asks about topic
# (b + a) / 2, so earlier batches take topics and later ones must try again or keep nothing;
# every fifth conversation repeats a stored pair and every twentieth is told whole, with a lead.
_fx("fx_retries", ["conversations"], """
SELECT u.conv_id AS prompt_id, CAST(floor(u.turn / 2) AS BIGINT) % 3 + 1 AS attempt, CAST(floor(u.conv_id / 4) AS BIGINT) AS batch_id, u.turn AS pos,
  CASE WHEN u.conv_id % 5 = 0 THEN concat('User: ', u.text, chr(10), 'Assistant: ', a.text)
    WHEN u.conv_id % 20 = 1 THEN concat('User: In short, ', u.text, chr(10), 'Assistant: Well, ', a.text)
    ELSE concat('User: What about topic ', CAST(CAST(floor(u.conv_id / 64) AS BIGINT) AS STRING), '.',
      CAST(CAST(floor((CAST(floor(u.conv_id / 4) AS BIGINT) % 16 + CAST(floor(u.turn / 2) AS BIGINT) % 3 + 1) / 2) AS BIGINT) AS STRING), '?', chr(10),
      'Assistant: The same as ever.') END AS generated_text
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
""")

_fx("fx_evaluations", ["documents"], """
SELECT doc_id AS entry_id,
  CASE WHEN doc_id % 23 = 0 THEN 'no scores here' ELSE
  concat('Relevance: [', CAST(n_chars % 12 AS STRING), ']', chr(10), '2. ACCURACY: ', CAST((n_chars % 90) / 10.0 AS DECIMAL(4,1)), '/10', chr(10),
         CASE WHEN doc_id % 4 = 0 THEN 'completeness: n/a' ELSE concat('COMPLETENESS: ', CAST(doc_id % 10 + 1 AS STRING)) END, chr(10),
         ' CLARITY: 7', chr(10), 'SPECIFICITY: 25', chr(10),
         CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('OVERALL: ', CAST(doc_id % 11 AS STRING), chr(10)) END, 'REASON: ok because ', lang) END AS evaluation_text
FROM documents
""")

def _json_text(col: str) -> str:
    """SQL of a JSON string literal that holds ``col`` (null: empty)."""
    out = f"coalesce({col}, '')"
    for found, put in (("chr(92)", "concat(chr(92), chr(92))"), ("chr(34)", "concat(chr(92), chr(34))"),
                       ("chr(10)", "concat(chr(92), 'n')"), ("chr(13)", "concat(chr(92), 'r')"),
                       ("chr(9)", "concat(chr(92), 't')")):
        out = f"replace({out}, {found}, {put})"
    return f"concat(chr(34), {out}, chr(34))"


_FIRST, _SECOND = (f"concat('{{\"content\":', {_json_text(f'{t}.text')}, ',\"role\":', {_json_text(f'{t}.role')}, '}}')" for t in "ua")
_META = """concat('"meta":{"conv":', CAST(u.conv_id AS STRING), ',"turns":[', CAST(u.turn AS STRING),
      CASE WHEN a.turn IS NULL THEN '' ELSE concat(',', CAST(a.turn AS STRING)) END, '],"tags":[{"name":"first","value":',
      CASE WHEN u.turn = 0 THEN 'true' ELSE 'null' END, '}', CASE WHEN u.turn = 2 THEN ',7.5,["x"]' ELSE '' END, ']}')"""

# One entry per two turns of a conversation, with the whole texts of both; its last turn
# may stand alone.  Six in thirteen entries have a defect, some of them two.
_fx("fx_entry_json", ["conversations"], f"""
SELECT u.conv_id * 1000000 + CAST(floor(u.turn / 2) AS BIGINT) AS entry_idx,
  CASE WHEN (u.conv_id + u.turn) % 13 = 5 THEN concat('{{"messages":[{{"role":', {_json_text('u.role')}, '}},{{"content":', {_json_text('a.text')}, ',"role":"bot"}}]}}')
    WHEN (u.conv_id + u.turn) % 13 = 6 THEN concat('{{"messages":[', {_json_text('u.text')}, ',{{"said":', {_json_text('a.text')}, '}}]}}')
    WHEN (u.conv_id + u.turn) % 13 = 7 THEN concat('{{"messages":{{"content":', {_json_text('u.text')}, '}},', {_META}, '}}')
    WHEN (u.conv_id + u.turn) % 13 = 8 THEN concat('[', {_json_text('u.text')}, ',', {_json_text('a.text')}, ']')
    WHEN (u.conv_id + u.turn) % 13 = 9 THEN concat('{{"messages":[', {_FIRST}, ',{{"content":"', substr(u.text, 1, 40))
    WHEN (u.conv_id + u.turn) % 13 = 10 THEN concat('{{"messages":[', {_FIRST}, ',', {_FIRST}, ',{{"content":null,"role":7}}],', {_META}, '}}')
    WHEN (u.conv_id + u.turn) % 13 = 11 THEN concat('{{"conversation":', {_json_text('u.text')}, '}}')
    ELSE concat('{{"messages":[', {_FIRST}, CASE WHEN a.turn IS NULL THEN '' ELSE concat(',', {_SECOND}) END, '],', {_META}, '}}') END AS entry
FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.turn % 2 = 0
""")

# Page texts for the web scorers: the driver documents carry no technical
# keywords, code fences or exclamation runs, so every sixth document gets one
# deterministic variant to reach each branch of the scorers.
_fx("fx_web_docs", ["documents"], """
SELECT doc_id, source, split_part(text, chr(10), 1) AS title,
  CASE doc_id % 6
    WHEN 0 THEN concat(text, ' React component API')
    WHEN 1 THEN concat('```js', chr(10), 'function f() {}', chr(10), '```', chr(10), chr(10), text)
    WHEN 2 THEN concat(text, ' python method javascript react api function component!!!')
    WHEN 3 THEN replace(text, '. ', '! ')
    WHEN 4 THEN concat(text, chr(10), chr(10), text)
    ELSE text END AS content
FROM documents
""")

# Pages with a code block injected into the article (P-13 input).
_fx("fx_pages_code", ["pages"], """
SELECT page_id, url,
  CASE WHEN page_id % 2 = 0
    THEN replace(html, '</article>', concat('<pre>a', chr(10), chr(10), 'b</pre></article>'))
    ELSE replace(html, '</article>', concat('<p>see <code>x = 1;', chr(10), '  ', chr(10), 'y = 2;</code> here</p></article>')) END AS html
FROM pages
""")

# URL variants covering every source-type and repository-URL branch.
_fx("fx_page_urls", ["pages"], """
SELECT page_id, CASE page_id % 9
    WHEN 0 THEN url
    WHEN 1 THEN replace(url, '.example.', '.stackoverflow.com.')
    WHEN 2 THEN concat('https://github.com/org', CAST(page_id % 7 AS STRING), '/repo', CAST(page_id AS STRING), '/')
    WHEN 3 THEN concat('https://user:pw@medium.com:443/p/', CAST(page_id AS STRING))
    WHEN 4 THEN concat('http://dev.to/x/', CAST(page_id AS STRING), '?q=github.com')
    WHEN 5 THEN concat('https://docs.', substr(url, position('//' IN url) + 2))
    WHEN 6 THEN concat(url, '/Documentation/intro')
    WHEN 7 THEN concat(url, '/TUTORIAL-guide')
    ELSE concat('https://github.com/solo', CAST(page_id AS STRING)) END AS url
FROM pages
""")

# Repository URLs requested for analysis: every repository of the tree table,
# plus repository-style page URLs that have no tree (failed runs).
_fx("fx_repo_urls", ["fx_paths", "fx_page_urls"], """
SELECT concat('https://github.com/', owner, '/', repo) AS url, 2 * min(pos) AS pos FROM fx_paths GROUP BY owner, repo
UNION ALL
SELECT url, 2 * page_id + 1 AS pos FROM fx_page_urls WHERE url LIKE 'https://github.com/%'
""")

# Raw files on several branches: fx_code_files plus alternative copies so the
# main -> master fallback has something to choose from.
_fx("fx_branch_files", ["fx_code_files"], """
SELECT owner, repo, path, branch, content FROM fx_code_files
UNION ALL
SELECT owner, repo, path, 'master' AS branch, concat('// older copy', chr(10), content) AS content
FROM fx_code_files WHERE branch = 'main' AND length(path) % 3 = 0
UNION ALL
SELECT owner, repo, path, 'develop' AS branch, 'develop copy' AS content
FROM fx_code_files WHERE length(path) % 2 = 0
""")


def _closure(names) -> list[str]:
    """Fixture names plus their fixture dependencies, dependencies first."""
    out: list[str] = []

    def visit(n):
        if n in out or n not in FIXTURE_SQL:
            return
        for d in FIXTURE_SQL[n][1]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived view ``name`` over the tables now in ``sf_dir``: files are listed anew
    on each call, so rows added since are seen."""
    order = _closure([name])
    base = sorted({d for n in order for d in FIXTURE_SQL[n][1] if d not in FIXTURE_SQL})
    register_tables(spark, sf_dir, base)
    df = None
    for n in order:
        # fenced: a derived view behaves like a stored table, so predicates on
        # its computed columns are not re-expanded into every downstream filter
        df = fence(spark.sql(private_sql(FIXTURE_SQL[n][0])))
        df.createOrReplaceTempView(private_view(n))
    return df


def with_fixtures(*names: str) -> str:
    """A ``WITH`` prefix defining the given views for an oracle query."""
    order = _closure(names)
    parts = [f"{n} AS (\n{FIXTURE_SQL[n][0]}\n)" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
