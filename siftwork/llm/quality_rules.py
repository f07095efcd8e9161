"""Quality rules: text statistics and a learned decision list, as Spark expressions.

Statistics of whole texts are column expressions.  The list is learned by sequential
covering from labelled statistics: a rule grows one threshold condition at a time
by information gain on two thirds of the examples, is pruned on the other third,
and is kept if it is precise; the examples it covers go, and the next rule is grown.
The list becomes one ``CASE WHEN`` chain, whose first rule that holds rejects.

The examples are at most ``LABELLED`` labelled rows (those first in order of a hash of
the id), of which only the statistics are collected; all else covers all rows.

Defined cases: a null or empty text has no words and zero statistics; windows and
lines are compared by content (windows by a 64-bit hash of their words); repeated
rows get a row each; labels that are null or without a document are ignored; with
too few examples of either kind the list is empty and only the base decides.  An empty
table gives an empty result.  Other columns are carried by ``statistics``, so none may have the
name of a statistic; the query passes ids and texts only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_or_empty

LABELLED = 20_000
WINDOW = 5
MOST_RULES, MOST_CONDITIONS, STEPS = 16, 3, 64
#: A rule stays if it is right this often and covers this share of the bad examples.
PRECISION, LEAST_SHARE = 0.97, 0.005
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "unique_ratio", "upper_ratio",
            "digit_ratio", "bang_ratio", "words_per_line")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of ``size`` words that occur twice or more."""
    def covered(prints: Column) -> Column:
        pairs = F.array_sort(F.transform(prints, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def from_sorted(s: Column) -> Column:
            def twin(k: Column) -> Column:
                here = F.get(s, k)["h"]
                return F.coalesce(here == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(
                    here == F.get(s, k + 1)["h"], F.lit(False))

            places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), twin),
                                              lambda k: F.get(s, k)["i"]))
            # each window adds the words up to the next one, at most its own
            return bound(places, lambda p: F.aggregate(
                F.transform(p, lambda at, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - at, F.lit(size)))),
                F.lit(0), lambda total, x: total + x))

        return bound(pairs, from_sorted)

    prints = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)),
                         lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(F.size(words) <= size, F.lit(0)).otherwise(
        bound(prints, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by the statistics."""
    kept = [c for c in docs.columns if c != text]
    raw = docs.select(*kept, text_or_empty(text).alias("_t"))
    cut = raw.withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))).withColumn(
        "_l", F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("long")
    counted = cut.select(
        *kept, F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        count(r"\p{Lu}").alias("n_upper"), count(r"[0-9]").alias("n_digits"), count(r"[!?]").alias("n_bangs"))

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return counted.withColumns({
        "mean_word": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "unique_ratio": ratio("n_distinct", "n_words"), "upper_ratio": ratio("n_upper", "word_chars"),
        "digit_ratio": ratio("n_digits", "word_chars"), "bang_ratio": ratio("n_bangs", "n_words"),
        "words_per_line": ratio("n_words", "n_lines")})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


Rule = tuple[Condition, ...]


def holds(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(values) for c in rule])


def candidates(values: dict[str, np.ndarray]) -> list[Condition]:
    out = []
    for name, x in values.items():
        for q in np.unique(np.quantile(x, np.linspace(0, 1, STEPS + 1))).tolist():
            out += [Condition(name, True, q), Condition(name, False, q)]
    return out


def grown(values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Conditions by FOIL gain until no good example is covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    tests = [(c, c.holds(values)) for c in candidates(values)]
    while len(rule) < MOST_CONDITIONS and (inside & ~bad).any():
        p0 = (inside & bad).sum()
        before = np.log2(p0 / inside.sum())
        best, best_gain, best_inside = None, 1e-9, inside
        for condition, test in tests:
            both = inside & test
            p = int((both & bad).sum())
            if p:
                gain = p * (np.log2(p / int(both.sum())) - before)
                if gain > best_gain:
                    best, best_gain, best_inside = condition, gain, both
        if best is None:
            break
        rule, inside = (*rule, best), best_inside
    return rule


def worth(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> float:
    inside = holds(rule, values)
    n = int(inside.sum())
    return (2 * int((inside & bad).sum()) - n) / n if n else -1.0


def centred(rule: Rule, values: dict[str, np.ndarray]) -> Rule:
    """The rule with each threshold halfway between the covered examples and the nearest
    others beyond it: the same examples are covered, and new ones get the benefit."""
    out = list(rule)
    for i, c in enumerate(rule):
        rest = [*out[:i], *out[i + 1:]]
        x = values[c.feature][holds(tuple(rest), values)] if rest else values[c.feature]
        inside = x > c.threshold if c.above else x <= c.threshold
        if inside.any() and not inside.all():
            near = x[inside].min() if c.above else x[inside].max()
            far = x[~inside].max() if c.above else x[~inside].min()
            out[i] = Condition(c.feature, c.above, float((near + far) / 2))
    return tuple(out)


def learn(values: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Ordered rules that reject; every third example prunes, the others grow."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    prunes = np.arange(len(bad)) % 3 == 2
    least = max(5, LEAST_SHARE * bad.sum())
    while len(rules) < MOST_RULES:
        grow, prune = left & ~prunes, left & prunes
        if (grow & bad).sum() < least or not (grow & ~bad).any():
            break
        rule = grown({k: v[grow] for k, v in values.items()}, bad[grow])
        if not rule:
            break
        part = {k: v[prune] for k, v in values.items()}
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (worth(r, part, bad[prune]), len(r)))
        covers = holds(rule, values) & left
        if (covers & bad).sum() < least or (covers & bad).sum() < PRECISION * covers.sum():
            break
        rules.append(centred(rule, {k: v[left] for k, v in values.items()}))
        left &= ~covers
    return rules


def labelled_statistics(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                        label: str = "quality", most: int = LABELLED) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and bad marks of at most ``most`` labelled rows."""
    sample = (labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
              .select(F.col(doc_id).alias("_id"), F.col(label).alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id", "_label").limit(most))
    # at most ``most`` short rows
    joined = docs.select(F.col(doc_id).alias("_doc"), text).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    rows = statistics(joined, text).select("_id", "_label", *[F.col(f).cast("double") for f in FEATURES]).collect()
    rows.sort(key=lambda r: tuple(r))
    return ({f: np.array([r[f] for r in rows], float) for f in FEATURES},
            np.array([r["_label"] == 0 for r in rows], bool))


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    chain = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for condition in rule[1:]:
            test = test & condition.column()
        chain = F.when(test, F.lit(k)) if chain is None else chain.when(test, F.lit(k))
    return F.lit(None).cast("int") if chain is None else chain


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Statistics, base_failed, rule and kept of every row."""
    return statistics(docs, text).withColumn("base_failed", base_failed()).withColumn(
        "rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rules = learn(*labelled_statistics(docs, labels, doc_id, text))
    return judged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), rules)
