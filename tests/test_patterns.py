"""The literals that rare patterns need, over texts in which every pattern and near misses occur."""

import pytest
from pyspark.sql import functions as F

from claimloom.functions.fixed import CERTIFICATE_SOURCES, CERTIFICATES, FALSE_LABELS
from claimloom.functions.semantics import matches, matches_rare, needed
from claimloom.operators import certificates as H
from claimloom.sources import corpus as C

PATTERNS = {**{c[0]: c[7] for c in CERTIFICATES}, **{name: p for name, _, p in FALSE_LABELS}}


def test_no_match_is_lost_for_want_of_a_literal(spark):
    texts = [y for x in C._every() for y in (x, x.upper(), x.lower(), x.replace(" ", "  "), x.replace("-", " "))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("low", F.lower("text"))
    plain = [matches(F.col("text"), p).alias(f"a_{name}") for name, p in PATTERNS.items()]
    rare = [matches_rare(F.col("text"), F.col("low"), p).alias(f"b_{name}") for name, p in PATTERNS.items()]
    rows = df.select("text", *plain, *rare).collect()
    for name in PATTERNS:
        assert [r[f"a_{name}"] for r in rows] == [r[f"b_{name}"] for r in rows], name
        assert any(r[f"a_{name}"] for r in rows), f"{name} occurs nowhere"
        assert not all(r[f"a_{name}"] for r in rows)


@pytest.mark.parametrize(("pattern", "literals"), [(r"ISO\s*14001", ["14001"]), (r"foo|xyz?", ["foo", "xy"]), (r"(?:x|y)+", []), (r"\bFoo\b", ["foo"])])
def test_needed_literals(pattern, literals):
    assert needed(pattern) == literals


def test_the_registry_tells_who_issues(spark, tmp_path):
    reg = {r.id: r for r in H.read_registry(spark).collect()}
    assert len(reg) == 42 and all(r.authority and r.verification_url.startswith("https://") and r.official for r in reg.values())
    assert [c[0] for c in CERTIFICATES] == [s[0] for s in CERTIFICATE_SOURCES]
    (tmp_path / "r.json").write_text('{"id": "own", "identifier_pattern": "Own Seal", "official": false}\n{"id": "two", "identifier_pattern": "Two"}')
    own = {r.id: r for r in H.read_registry(spark, str(tmp_path)).collect()}
    assert (own["own"].official, own["own"].authority, own["own"].verification_url, own["two"].official) == (False, "", None, True)
    mentions = spark.createDataFrame([(1, 1, "C1", "gri", 0), (1, 1, "C1", None, None)], "doc_id long, ord int, claim_id string, cert_id string, cert_ord int")
    got = H.certification_details(mentions, H.read_registry(spark)).collect()
    assert len(got) == 2 and {bool(r.authority) for r in got} == {True, False}


@pytest.mark.parametrize("line", ['{"id": "x", "identifier_pattern": "("}', '{"identifier_pattern": "x"}', '{"id": "x"}'])
def test_bad_registries_are_errors(spark, tmp_path, line):
    (tmp_path / "r.json").write_text(line)
    with pytest.raises(Exception):  # noqa: B017  whatever Spark raises
        H.read_registry(spark, str(tmp_path)).collect()
