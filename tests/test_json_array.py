"""Arrays in files cut into ranges of a few bytes, beside json.loads."""

import json
import random

import pytest
from pyspark.sql import functions as F

from claimloom.sources import json_array as J
from claimloom.sources import tables as A
from claimloom.sources.json_array import read_json_array


@pytest.fixture
def small_ranges(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def value(r, depth=0):
    text = "".join(r.choice([",", "[", "]", "{", "}", '"', "\\", "\n", "a", "é", "碳", "\U0001f600", ":", " ", "\t"]) for _ in range(r.randrange(12)))
    kinds = [lambda: text, lambda: r.randrange(100), lambda: None, lambda: True, lambda: -1.5e3]
    if depth < 3:
        kinds += [lambda: [value(r, depth + 1) for _ in range(r.randrange(4))], lambda: {f"k{i},{text}": value(r, depth + 1) for i in range(r.randrange(4))}] * 2
    return r.choice(kinds)()


@pytest.mark.parametrize("indent", [None, 2])
def test_elements_beside_a_parser(spark, tmp_path, small_ranges, indent):
    r = random.Random(indent or 0)
    want = {}
    for name in ("one.json", "two.json"):
        items = [value(r) for _ in range(60)]
        (tmp_path / name).write_text((" \n" if indent else "﻿") + json.dumps(items, indent=indent, ensure_ascii=bool(indent)) + "\n ")
        want |= {(name, i): x for i, x in enumerate(items)}
    raw = spark.read.option("lineSep", ",").text(str(tmp_path))
    assert raw.rdd.getNumPartitions() > 8
    got = {(x.path.rsplit("/", 1)[1], x.element): json.loads(x.json) for x in read_json_array(spark, str(tmp_path)).collect()}
    assert got == want


def test_files_without_elements(spark, tmp_path):
    for name, text in {"a": "[]", "b": " [ ] \n", "c": '{"a": 1, "b": [2, 3]}', "d": "", "e": "[7]", "f": '[[1, 2], "x"]'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert {(x.path[-6], x.element, x.json) for x in read_json_array(spark, str(tmp_path)).collect()} == {("e", 0, "7"), ("f", 0, "[1, 2]"), ("f", 1, '"x"')}


def test_elements_leave_their_ranges_whole(spark, tmp_path, small_ranges, monkeypatch):
    """Pieces between commas are never written or dealt out: a row for each element, and two more for each range. A mark
    of byte order counts as such at the start of a file only; a file of an object has no elements in any range."""
    tables, items = [], [{"a": [i, "x,\ufeffy", [1, 2, 3, 4, 5, 6, 7, 8, 9]], "b": "\\\\"} for i in range(300)]
    keep = J.written
    monkeypatch.setattr(J, "written", lambda df, name: tables.append(keep(df, name)) or tables[-1])
    (tmp_path / "one.json").write_text(json.dumps(items, ensure_ascii=False))
    (tmp_path / "two.json").write_text(json.dumps({"a": items}))
    got = {x.element: json.loads(x.json) for x in J.read_json_array(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(items))
    ranges = spark.read.option("lineSep", ",").text(str(tmp_path / "one.json")).rdd.getNumPartitions()
    assert sum(t.count() for t in tables) <= len(items) + 2 * ranges < 3000


def test_old_histories(spark, tmp_path, small_ranges):
    items = [{"id": "x", "createdAt": "2024-01-02T03:04:05Z", "request": {"text": "a, b", "contextType": "report"}, "result": {"risk": 3}, "llm": {"m": [1]}}, {"classification": {"context": {"selected": "ad"}, "sector": {"selected": "energy"}}}, 5, {"text": "t", "sector": "s", "verification": None}]
    (tmp_path / "old.json").write_text(json.dumps(items))
    rows = A.read_legacy_history(spark, str(tmp_path)).orderBy(F.desc("created_at"), "sector").collect()
    assert [(r.request_text, r.context_type, r.sector, r.result_json, r.llm_json, r.verification_json) for r in rows] == [("a, b", "report", "auto", '{"risk":3}', '{"m":[1]}', None), ("", "ad", "energy", "{}", None, None), ("t", "auto", "s", "{}", None, None)]
    again = A.read_legacy_history(spark, str(tmp_path)).collect()
    assert {r.id for r in rows} == {r.id for r in again} and len({r.id for r in rows}) == 3
