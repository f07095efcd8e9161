"""Source divergence audit with a translate-table tokenizer.

One ``bytes.translate`` lowers A-Z and turns every other ASCII byte that is no letter
into a space, ``bytes.split`` cuts the terms, and a Counter per document gives its
frequencies.  A task sums the Counters of a (language, source) group, so a hot source
leaves it as one row per term; Spark sums these rows by term.

Each language keeps the terms of at least ``LEAST_DOCS`` of its documents.  With V kept
terms, a group (or the whole language) of N occurrences gives a term with ``count`` of
them p = 1 + floor(10^9 (count + 2) / (N + 2V)), and two such values differ by
floor((p - q)^2 / (p + q)).  All of it is integer arithmetic: the quotient is taken in
three long divisions by thousands, exact below 9 * 10^15 occurrences.

Sums over all kept terms for every two sources of a language are a blocked product:
terms are dealt to blocks of about ``TERMS`` and sources to tiles of ``TILE``; a task
lays out one block for two tiles as a dense matrix, zero counts included, and gives one
partial sum per two sources.  No task holds more than a block, however many terms or
sources a language has, and the distance is symmetric, so each two are met once.

Defined cases: null text, language and source are ''; a group without a term keeps its
row of every pair (and no term rows); without kept terms all pairs have value 0; a
language of one source has no pairs; repeated rows and ids count as often as they
stand; ids play no part; an empty table gives an empty result.  Other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged as stage

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
TERMS, TILE = 4096, 64
#: Entries and bytes of terms that a task holds before it passes them on.
ENTRIES, BYTES = 300_000, 32 << 20
TABLE = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(TABLE).split()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), d (documents); and a row without
    occurrences for the term '' of every group."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[dict[bytes, int], dict[bytes, int]]] = {}
        entries = size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (of_lang, of_source), (n, d) in groups.items():
                many = len(n) + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([of_lang] * many, pa.string()), pa.array([of_source] * many, pa.string()),
                    pa.array([b"", *n], pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *map(d.__getitem__, n)], pa.int64())], ["lang", "source", "term", "n", "d"])
            groups.clear()

        for batch in batches:
            for of_lang, of_source, value in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(),
                                                 batch.column("text")):
                n, d = groups.setdefault((of_lang, of_source), ({}, {}))
                had = len(n)
                for term, k in Counter(terms_of(value.as_py())).items():
                    if term in n:
                        n[term] += k
                        d[term] += 1
                    else:
                        n[term], d[term] = k, 1
                        size += len(term)
                entries += len(n) - had
                if entries > ENTRIES or size > BYTES:
                    yield from flushed()
                    entries = size = 0
        yield from flushed()

    return rows.mapInArrow(run, "lang string, source string, term string, n long, d long")


def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 v)), exactly."""
    below = total + 2 * v
    whole, rest = quotient(count + 2, below), F.pmod(count + 2, below)
    for _ in range(3):
        whole, rest = whole * 1000 + quotient(rest * 1000, below), F.pmod(rest * 1000, below)
    return whole + 1


def quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def differ(p: Column, q: Column) -> Column:
    return quotient((p - q) * (p - q), p + q)


def vocabulary(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term, ln (occurrences in the language) of the kept terms."""
    return counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("ln"), F.sum("d").alias("d")).filter(
        F.col("d") >= least).drop("d")


def pair_sums(entries: DataFrame, groups: DataFrame, terms: int = TERMS, tile: int = TILE) -> DataFrame:
    """lang, source, item, value of every two sources of a language, both ways.
    ``entries``: lang, g, v, many, term, p; ``groups``: lang, source, g, v, many, p0, where
    g counts the ``many`` sources of a language from 0 and v is its number of terms."""
    blocks = F.greatest(F.ceil(F.col("v") / terms), F.lit(1)).cast("int")
    mine = F.floor(F.col("g") / tile).cast("int")
    partners = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("many") - 1) / tile).cast("int")), lambda t: F.struct(
        F.least(t, mine).alias("a"), F.greatest(t, mine).alias("b")))).alias("tiles")
    of_entries = entries.select("lang", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), partners, "g", "term", "p")
    of_groups = groups.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "lang", "block", partners, "g", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))

    def partial(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        blank = table.column("term").is_null().to_numpy()
        g, p = table.column("g").to_numpy(), table.column("p").to_numpy()
        a_tile, b_tile = (table.column("tiles").combine_chunks().field(x)[0].as_py() for x in "ab")
        order = np.argsort(g[blank])
        ids, zero = g[blank][order], p[blank][order]
        term = table.column("term").filter(pa.array(~blank)).combine_chunks().dictionary_encode()
        dense = np.repeat(zero[:, None], len(term.dictionary), axis=1)
        dense[np.searchsorted(ids, g[~blank]), term.indices.to_numpy()] = p[~blank]
        first, second, value = [], [], []
        in_b = ids // tile == b_tile
        for i in np.flatnonzero(ids // tile == a_tile):
            with_ = np.flatnonzero(in_b & (ids > ids[i]))
            off = dense[with_] - dense[i]
            sums = (off * off // np.maximum(dense[with_] + dense[i], 1)).sum(axis=1)
            first.append(np.full(len(with_), ids[i]))
            second.append(ids[with_])
            value.append(sums)
        flat = lambda x: pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64))
        out = [flat(first), flat(second), flat(value)]
        return pa.table([pa.array([lang] * len(out[0]), pa.string()), *out], names=["lang", "a", "b", "value"])

    sums = of_entries.unionByName(of_groups).groupBy("lang", "block", "tiles").applyInArrow(
        partial, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("o")), F.struct(
        F.col("b").alias("g"), F.col("a").alias("o")))).alias("two"), "value").select("lang", "two.*", "value")
    name = groups.select("lang", "g", "source")
    return both.join(name, ["lang", "g"]).join(name.select("lang", F.col("g").alias("o"), F.col("source").alias("item")),
                                               ["lang", "o"]).select("lang", "source", "item", "value")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS,
               top: int = TOP, terms: int = TERMS, tile: int = TILE) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    counts = stage(term_counts(docs, text, lang, source).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("d").alias("d")), "divergence-counts")
    kept = stage(vocabulary(counts, least), "divergence-terms")
    entries = stage(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "divergence-entries")
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("ln").alias("total"))
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    same = Window.partitionBy("lang")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    # one row per group: the window numbers the sources of a language
    groups = stage(counts.filter("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left")
                   .join(whole, "lang", "left").select("lang", "source", *map(none, ("n_group", "v", "total")))
                   .withColumn("g", (F.row_number().over(same.orderBy("source")) - 1).cast("long"))
                   .withColumn("many", F.count(F.lit(1)).over(same))
                   .withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("n_group"), F.col("v"))).otherwise(
                       F.lit(0).cast("long"))), "divergence-groups")
    valued = stage(entries.join(groups.drop("p0"), ["lang", "source"]).select(
        "lang", "source", "g", "v", "many", "term", share(F.col("n"), F.col("n_group"), F.col("v")).alias("p"),
        share(F.col("ln"), F.col("total"), F.col("v")).alias("q")), "divergence-shares")
    pairs = pair_sums(valued, groups, terms, tile)
    over = valued.filter("p > q").select("lang", "source", F.col("term").alias("item"),
                                         differ(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(best)).select(*columns).unionByName(
        over.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        .select(*columns))
