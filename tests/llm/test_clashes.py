"""Stages on documents whose other columns have the names that operators use inside."""

import pytest

import corpus_pipeline

NAMES = ["_l", "_n", "_k", "_mark", "_pieces", "_kept_id", "_sha", "_sha_of", "_gone", "_id", "_source", "_key", "_copies", "_rows",
         "_key_of", "_nth", "row", "id", "sha", "kept_id", "kept_sha", "n", "name", "mark", "pieces", "learn", "k", "s", "i", "of", "key",
         "text_key", "times", "n_rows", "taken", "copies", "size", "target", "rate", "rank", "number", "node", "rep", "set_key", "component",
         "component_id", "n_shingles", "rid", "recipe", "rkey", "prints", "keep_id", "group_size", "held_out", "lang_pred", "score",
         "sequence_id", "offset", "piece", "members", "filled", "ready"]


@pytest.mark.parametrize("repeated", [False, True])
def test_stages_carry_columns_of_any_name(spark, tmp_path, repeated):
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(40 + i % 2)), ("en", "fr")[i % 2], f"s{i % 3}", 7) for i in range(24)]
    rows += [(50, "W1X1 a b", "en", "s1", 1), (51, "w1x1 A b", "en", "s2", 1), (None, "no id", None, None, None)]
    if repeated:
        rows += rows[:3] + [(0, "another text", "fr", "s0", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", *[f"doc_id * 3 AS {n}" for n in NAMES])
    docs.write.parquet(f"{tmp_path}/start")
    docs = spark.read.parquet(f"{tmp_path}/start")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        kept = docs.collect()
        assert kept and all(r.number == r.doc_id * 3 and r._gone == r.rid for r in kept if r.doc_id is not None)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len(kept)
