"""Source-file cleaning and scores (P-2, P-15, P-20..P-24) as expressions.

Line-oriented rules are written as anchored regexes over the whole file, so a
file stays one row and no line ever becomes a shuffled record.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, count_contains, count_substr
from .webscore import web_coherence_score, web_quality_from, web_quality_inputs

# Fixed values that must equal the reference rules.
BANNER_START = "/*" + "-" * 93
CODE_EXTENSIONS_BONUS = ["ts", "tsx", "js", "jsx", "py", "rs", "go"]
CODE_STRUCTURE_WORDS = ["function", "class", "interface", "import", "export"]
CODE_TECH_KEYWORDS = ["react", "typescript", "javascript", "python", "component", "function", "method", "api"]
CODE_LINE_WORDS = ["function", "class", "interface", "def"]
IMPORT_PREFIXES = ["import", "from", "#include", "use "]
REACT_PATTERNS = ["import react", "usestate", "useeffect", "component", "props"]
REACT_EXTENSIONS = [".js", ".jsx", ".ts", ".tsx"]
COMPLEXITY_EXTENSIONS = [".js", ".jsx", ".ts", ".tsx", ".py"]
MIN_CODE_WORDS = 90
MAX_CODE_WORDS = 5000

_BOL = r"(?:^|(?<=\n))"          # start of a '\n'-separated line
_EOL = r"(?=\n|\z)"
_SKIP = "\u0000\u0001skip\u0001\u0000"
_NONWS = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
LINE_WS = r"[\t\x0b\x0c\r\x1c-\x1f\x20\x85\p{Z}]"  # Python blanks except '\n'


def code_word_count(c: Column | str) -> Column:
    """P-2: whitespace tokens longer than two characters."""
    return F.regexp_count(F.coalesce(col_(c), F.lit("")), F.lit(_NONWS + "{3,}")).cast("int")


def clean_code(c: Column | str) -> Column:
    """P-15 (with the W-15 skip state): drop banner blocks and single-line licence comments.

    A banner starts on a line containing ``/*`` + 93 dashes and ends with the
    next later line that contains ``*/`` without starting another banner (or
    runs to the end).  Whole lines are replaced by a marker line, then marker
    lines are removed with one split / filter / join.
    """
    c = col_(c)
    start = BANNER_START.replace("*", r"\*")
    line_with_start = rf"[^\n]*{start}[^\n]*"
    line_without_end = r"(?:(?!\*/)[^\n])*+"
    banner = (rf"{_BOL}{line_with_start}(?:\n(?:{line_with_start}|{line_without_end}){_EOL})*+"
              rf"(?:\n[^\n]*\*/[^\n]*)?")
    marked = F.regexp_replace(c, banner, _SKIP)
    licence = rf"(?iu){_BOL}{LINE_WS}*(?://|#)[^\n]*(?:copyright|license)[^\n]*{_EOL}"
    marked = F.regexp_replace(marked, licence, _SKIP)
    kept = F.array_join(F.filter(F.split(marked, "\n"), lambda x: x != _SKIP), "\n")
    return F.when(c.isNull() | (c == ""), c).otherwise(kept)


def code_quality_score(content: Column | str, path: Column | str, words: Column | str | None = None) -> Column:
    """P-20 on cleaned content; ``words`` = its code word count if already staged."""
    content = F.coalesce(col_(content), F.lit(""))
    lower = F.lower(content)
    wc = col_(words) if words is not None else code_word_count(content)
    p = col_(path)
    ext = F.when(p.contains("."), F.lower(F.substring_index(p, ".", -1))).otherwise(F.lit(""))
    score = F.lit(5.0)
    score = score + F.when(wc.between(MIN_CODE_WORDS, MAX_CODE_WORDS), F.lit(1.0)).when(wc < MIN_CODE_WORDS, F.lit(-2.0)).otherwise(F.lit(0.0))
    score = score + F.when(ext.isin(CODE_EXTENSIONS_BONUS), F.lit(1.0)).otherwise(F.lit(0.0))
    structure = F.lit(False)
    for w in CODE_STRUCTURE_WORDS:
        structure = structure | lower.contains(w)
    score = score + F.when(structure, F.lit(1.0)).otherwise(F.lit(0.0))
    score = score + F.least(count_contains(lower, CODE_TECH_KEYWORDS) * F.lit(0.3), F.lit(1.5))
    score = score + F.when(count_substr(content, "TODO") > wc * F.lit(0.1), F.lit(-0.5)).otherwise(F.lit(0.0))
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), score))


def code_coherence_score(content: Column | str) -> Column:
    """P-21 on cleaned content; lines are '\\n'-separated, empties included."""
    content = F.coalesce(col_(content), F.lit(""))
    n_lines = count_substr(content, "\n") + 1
    structured = F.regexp_count(content, F.lit(rf"{_BOL}[^\n]*?(?:{'|'.join(CODE_LINE_WORDS)})[^\n]*"))
    indented = F.regexp_count(content, F.lit(rf"{_BOL}(?:  |\t)"))
    imports = content.rlike(rf"{_BOL}{LINE_WS}*(?:import|from|#include|use [^\n]*?{_NONWS})")
    score = F.lit(5.0)
    score = score + F.when(structured >= 2, F.lit(1.0)).otherwise(F.lit(0.0))
    score = score + F.when(indented > n_lines * F.lit(0.3), F.lit(0.5)).otherwise(F.lit(0.0))
    score = score + F.when(imports, F.lit(0.5)).otherwise(F.lit(0.0))
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), score))


def complexity_inputs(content: Column | str, ext: Column | str, prefix: str = "_x") -> dict[str, Column]:
    """P-23 counters: non-blank lines, functions, classes, control keywords; null, and no scan of
    the text, where the extension has no complexity."""
    scored = F.lower(F.coalesce(col_(ext), F.lit(""))).isin(COMPLEXITY_EXTENSIONS)
    content = F.when(scored, F.coalesce(col_(content), F.lit("")))
    return {
        f"{prefix}lines": F.regexp_count(content, F.lit(rf"{_BOL}[^\n]*?{_NONWS}[^\n]*")),
        f"{prefix}funcs": F.regexp_count(content, F.lit(r"(?dU)function[\s\x1c-\x1f]+\w+|const[\s\x1c-\x1f]+\w+[\s\x1c-\x1f]*=.*=>")),
        f"{prefix}classes": F.regexp_count(content, F.lit(r"(?dU)class[\s\x1c-\x1f]+\w+")),
        f"{prefix}controls": F.regexp_count(content, F.lit(r"(?U)\b(?:if|for|while|switch|try)\b")),
    }


def complexity_from(ext: Column | str, prefix: str = "_x") -> Column:
    """P-23: weighted structure counts per non-blank line, capped at 10."""
    c = lambda n: F.col(f"{prefix}{n}")
    cx = (c("funcs") * F.lit(0.5) + c("classes") * F.lit(1.0) + c("controls") * F.lit(0.3)) / c("lines") * F.lit(100.0)
    return (F.when(~F.coalesce(col_(ext), F.lit("")).isin(COMPLEXITY_EXTENSIONS), F.lit(0.0))
            .when(c("lines") == 0, F.lit(0.0))
            .otherwise(F.least(F.lit(10.0), cx)))


def file_quality_inputs(content: Column | str, path: Column | str, ext: Column | str) -> dict[str, Column]:
    """Staged per-row counters for P-22/23/24 (one regex scan each)."""
    content = col_(content)
    lower = F.lower(F.coalesce(content, F.lit("")))
    return {
        **web_quality_inputs(content, col_(path)),
        **complexity_inputs(content, ext),
        "_freact": count_contains(lower, REACT_PATTERNS),
        "_fexport": F.coalesce(content, F.lit("")).contains("export default"),
        "_fprops": F.coalesce(content, F.lit("")).contains("PropTypes") | F.coalesce(content, F.lit("")).contains("interface"),
        "_fcomments": content.contains("//") | content.contains("/*"),
        "_fdocs": content.contains("/**") | content.contains("@param"),
    }


def file_quality_from(content: Column | str, ext: Column | str, source: Column | str) -> dict:
    """P-22 + P-23 + P-24 from :func:`file_quality_inputs` columns."""
    content = col_(content)
    empty = content.isNull() | (content == "")
    e = F.lower(F.coalesce(col_(ext), F.lit("")))
    q = web_quality_from()
    q = q + F.when(F.coalesce(col_(source), F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))
    react = e.isin(REACT_EXTENSIONS)
    q = q + F.when(react, F.col("_freact") * F.lit(0.2)).otherwise(F.lit(0.0))
    q = q + F.when(react & F.col("_fexport"), F.lit(0.3)).otherwise(F.lit(0.0))
    q = q + F.when(react & F.col("_fprops"), F.lit(0.5)).otherwise(F.lit(0.0))
    return {
        "quality_score": F.when(empty, F.lit(0.0)).otherwise(F.least(F.lit(10.0), q)),
        "word_count": F.when(empty, F.lit(0)).otherwise(F.col("_qwc")),
        "has_comments": F.when(empty, F.lit(None).cast("boolean")).otherwise(F.col("_fcomments")),
        "has_documentation": F.when(empty, F.lit(None).cast("boolean")).otherwise(F.col("_fdocs")),
        "complexity_score": F.when(empty, F.lit(None).cast("double")).otherwise(complexity_from(e)),
    }


def file_coherence(content: Column | str, repeated_terms: Column | str) -> Column:
    c = col_(content)
    return F.when(c.isNull() | (c == ""), F.lit(0.0)).otherwise(web_coherence_score(c, repeated_terms))
