"""JSON arrays read by byte ranges against json.loads on the whole file."""

import json
import random

import pytest
from pyspark.sql import types as T

from siftwork.operators import chat as C
from siftwork.sources.json_arrays import read_json_arrays, scan_json_arrays, segments, summary

ODD = ["", "}", "{", "}{", "]", "[", ",", '"', "\\", '\\"', '"}', "\\\\", "a\\\\\"}", "é東京", "x\ny\t}", "{\"a\":[1,2]}"]


def entry(rng):
    text = "".join(rng.choice([*ODD, "word ", "} "]) for _ in range(rng.randrange(8)))
    return rng.choice([{"messages": [{"content": text, "role": "user"}, {"content": rng.choice(ODD), "role": "assistant"}]},
                       {"a": {"b": [[], {}, [text, {"c": None}]]}}, {text: text}, {}, {"n": -1.5e3, "t": True}])


def files(tmp_path):
    rng = random.Random(7)
    arrays = [[entry(rng) for _ in range(n)] for n in (0, 1, 2, 7, 60)]
    texts = {}
    for i, a in enumerate(arrays):
        texts[f"plain{i}"] = json.dumps(a, ensure_ascii=False)
        texts[f"dense{i}"] = json.dumps(a, separators=(",", ":"))
        texts[f"pretty{i}"] = "\n " + json.dumps(a, indent=2, ensure_ascii=False) + " \n"
    texts |= {"mixed": '[1, "a,}]", [2,[3]], null, {"x": "}"}, true]', "none": "", "blank": "  \n", "scalar": "12", "word": "hello",
              "object": '{"messages": [], "a": {"b": 1}, "c": 2}', "open": '[{"a": 1}, {"b"', "cut": '[{"a": 1}', "comma": '[{"a": 1},]',
              "double": '[{"a": 1},,{"b": 2}]', "after": '[{"a": 1}] x', "two": "[1] [2]", "wrong": '[{"a": 1}}', "bad": '[{"a": }, {}]',
              "quote": '[{"a": "x}]', "huge": json.dumps([{"a": "}," * 3000}, {"b": 1}])}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8", newline="")
    return texts


def whole(text):
    try:
        value = json.loads(text)
    except ValueError:
        return "not an array" if text.strip() and not text.strip().startswith("[") else "not JSON"
    return value if isinstance(value, list) else "not an array"


@pytest.mark.parametrize("split, piece", [(128 << 20, 4 << 20), (3000, 40)])
def test_same_as_the_whole_file(spark, tmp_path, split, piece):
    texts = files(tmp_path)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        entries, found = scan_json_arrays(spark, str(tmp_path), piece)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep[0])
        spark.conf.set("spark.sql.files.openCostInBytes", keep[1])
    name = lambda path: path.rsplit("/", 1)[1][:-5]
    got = {}
    for r in entries.collect():
        got.setdefault(name(r.file), {})[r.entry_idx] = json.loads(r.entry)
    reasons = {name(r.file): (r.reason, r.entries) for r in found.collect()}
    assert set(reasons) == set(texts)
    for k, text in texts.items():
        want = whole(text)
        if isinstance(want, list):
            assert reasons[k] == (None, len(want)), k
            assert [got.get(k, {})[i] for i in range(len(want))] == want and len(got.get(k, {})) == len(want), k
        else:
            assert reasons[k][0] == want and k not in got, k


def test_typed_read_and_rejects(spark, tmp_path):
    texts = files(tmp_path)
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("t", T.BooleanType())])
    entries, rejects = read_json_arrays(spark, str(tmp_path), schema, piece=100)
    reasons = {r.file.rsplit("/", 1)[1][:-5]: r.reason for r in rejects.collect()}
    lists = {k: whole(t) for k, t in texts.items()}
    assert reasons == {k: "an entry is not an object" if isinstance(v, list) else v for k, v in lists.items()
                       if not isinstance(v, list) or not all(isinstance(e, dict) for e in v)}
    assert entries.columns == ["file", "entry_idx", "a", "t"]
    assert entries.count() == sum(len(lists[k]) for k in lists if k not in reasons)


def test_verdicts_equal_those_of_the_whole_file(spark, tmp_path):
    for i in range(6):
        good = {"messages": [{"content": f"q}}{i}", "role": "user"}, {"content": "a", "role": "assistant"}]}
        bad = {"messages": [{"content": "q", "role": "system"}, {"role": "assistant"}]}
        (tmp_path / f"f{i}.json").write_text(json.dumps([good] * 5 + [bad] * (i % 3) + [good], indent=i % 2 or None))
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "broken.json").write_text("[{}")
    (tmp_path / "object.json").write_text("{}")
    key = lambda r: (r.file.rsplit("/", 1)[1], *tuple(r)[1:])
    assert sorted(map(key, C.validate_json_arrays(spark, str(tmp_path), 40).collect()), key=str) == sorted(
        map(key, C.validate_dataset_files(spark, str(tmp_path)).collect()), key=str)


def test_sums_hold_under_both_assumptions():
    body = b'a "x,[" , [1,{"b":2}] , "\\"" ]'
    parity, change, separators = summary(body)
    assert parity == 0 and change[0] == -1 and dict(separators[0]) == {0: 2, 1: 2}
    assert [s for s in segments(b'{"a":1},2', 0, 1, 4)] == [(3, b'{"a":1}', False), (4, b"2", False)]
