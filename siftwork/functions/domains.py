"""Domain-name normalisation and topical test (P-3, F-6, F-14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, py_strip

# Fixed values that must equal the reference rules.
TOPICAL_KEYWORDS = [
    "edu", "university", "college", "academic", "research",
    "math", "mathematics", "science", "physics", "chemistry",
    "biology", "engineering", "mit", "stanford", "harvard",
    "arxiv", "scholar", "journal", "publication", "institute",
    "lab", "department", "faculty", "course", "lecture",
]
DOMAIN_PATTERN = r"^[a-z0-9.-]+\.[a-z]{2,}\z"


def usable_domain(c: Column | str) -> Column:
    """F-14: a non-null, non-empty string value."""
    c = col_(c)
    return c.isNotNull() & (c != "")


def clean_domain(c: Column | str) -> Column:
    """P-3: strip scheme and www (case-sensitive), cut at / ? # :, lower,
    strip; '' unless the result looks like a host name."""
    d = F.regexp_replace(col_(c), r"^https?://", "")
    d = F.regexp_replace(d, r"^www\.", "")
    for sep in ("/", "?", "#", ":"):
        d = F.substring_index(d, sep, 1)
    d = py_strip(F.lower(d))
    return F.when(d.rlike(DOMAIN_PATTERN), d).otherwise(F.lit(""))


def is_topical(c: Column | str) -> Column:
    """F-6: any keyword as a substring (a '.edu' suffix contains 'edu')."""
    c = col_(c)
    # keywords are plain letters, so one alternation is a literal substring test
    return c.rlike("|".join(TOPICAL_KEYWORDS))
