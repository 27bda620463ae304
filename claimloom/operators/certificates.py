"""Certificates and signals of false labels in claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import CERTIFICATE_SOURCES, CERTIFICATES, FALSE_LABELS, SEVERITY_RISK
from ..functions.semantics import each, matches_rare

REGISTRY = "id string, name_en string, name_zh string, type string, region string, domain array<string>, founded_year int, identifier_pattern string, authority string, verification_url string, official boolean"


def read_registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The registry of certificates: from a JSON table at path with defaults for missing fields, else the
    fixed one. An entry without id or pattern, or with a pattern that Java can't read, is an error."""
    if path is None:
        return spark.createDataFrame([(*c, *more[1:], True) for c, more in zip(CERTIFICATES, CERTIFICATE_SOURCES, strict=True)], REGISTRY)
    rows = spark.read.schema(REGISTRY).json(path)
    bad = F.col("id").isNull() | F.col("identifier_pattern").isNull()
    rows = rows.withColumn("identifier_pattern", F.when(bad, F.raise_error(F.lit("a certificate lacks id or identifier_pattern"))).otherwise(F.col("identifier_pattern")))
    filled = {"name_en": F.coalesce("name_en", "id"), "name_zh": F.coalesce("name_zh", "id"), "type": F.coalesce("type", F.lit("unknown")), "region": F.coalesce("region", F.lit("global")), "domain": F.coalesce("domain", F.array().cast("array<string>")), "authority": F.coalesce("authority", F.lit("")), "official": F.coalesce("official", F.lit(True))}
    # true for every pattern, but Java has to read it first
    return rows.withColumns(filled).filter(F.rlike(F.lit(""), F.col("identifier_pattern")) | (F.length("identifier_pattern") >= 0))


def with_certificates(claims: DataFrame) -> DataFrame:
    """certs: ids of certificates in declared order. A projection of literal patterns, compiled once."""
    hits = F.array(*[F.when(matches_rare(F.col("text"), F.col("__low"), c[7]), c[0]) for c in CERTIFICATES])
    return claims.withColumn("__low", F.lower("text")).withColumn("certs", F.array_compact(hits)).drop("__low")


def match_certifications(claims: DataFrame) -> DataFrame:
    """Long form: a row per claim and certificate, with the certificate's place in the registry."""
    return mentions(with_certificates(claims))


def mentions(claims: DataFrame) -> DataFrame:
    """The same from claims that have certs."""
    place = F.map_from_arrays(F.array(*[F.lit(c[0]) for c in CERTIFICATES]), F.array(*[F.lit(i) for i in range(len(CERTIFICATES))]))
    rows = each(claims, ["doc_id", "ord", "claim_id"], "certs", "cert_id")
    return rows.withColumn("cert_ord", place[F.col("cert_id")])


def certification_details(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """mentions with the certificate's English name, type, authority, place of verification and whether it is official.
    The registry is small; Spark sends it or deals it by its size."""
    more = registry.select(F.col("id").alias("cert_id"), "name_en", "type", "authority", "verification_url", "official")
    return mentions.join(more, "cert_id", "left")


def fold_cited_evidence(mentions: DataFrame, cited: DataFrame, registry: DataFrame) -> DataFrame:
    """mentions with rows of null cert_id for cited names (doc_id, claim_id, name) that no matched
    certificate of the claim contains in its names or id. A semi-structured anti-join within the claim."""
    known = mentions.join(F.broadcast(registry.select(F.col("id").alias("cert_id"), "name_en", "name_zh")), "cert_id")
    known = known.select("doc_id", "claim_id", F.lower("name_en").alias("en"), F.lower("name_zh").alias("zh"), "cert_id")
    low = F.lower("name")
    cited = cited.filter(F.coalesce(F.col("name"), F.lit("")) != "")
    same = F.contains("en", low) | F.contains("zh", low) | F.contains("cert_id", F.regexp_replace(low, r"\s", "_"))
    k, c = known.alias("k"), cited.alias("c")
    new = c.join(k, (F.col("c.doc_id") == F.col("k.doc_id")) & (F.col("c.claim_id") == F.col("k.claim_id")) & same, "left_anti")
    new = new.select("doc_id", "claim_id", F.lit(None).cast("string").alias("cert_id"), F.col("name").alias("cited_name"))
    return mentions.select("doc_id", "claim_id", "cert_id", F.lit(None).cast("string").alias("cited_name")).unionByName(new)


def with_signals(claims: DataFrame) -> DataFrame:
    """signals: names and severities of false-label signals in declared order."""
    hits = F.array(*[F.when(matches_rare(F.col("text"), F.col("__low"), p), F.struct(F.lit(s).alias("signal"), F.lit(v).alias("severity"))) for s, v, p in FALSE_LABELS])
    return claims.withColumn("__low", F.lower("text")).withColumn("signals", F.array_compact(hits)).drop("__low")


def false_label_signals(claims: DataFrame) -> DataFrame:
    return signal_rows(with_signals(claims))


def signal_rows(claims: DataFrame) -> DataFrame:
    """The same from claims that have signals."""
    return each(claims, ["doc_id", "ord", "claim_id"], "signals", "s").select("doc_id", "ord", "claim_id", "s.signal", "s.severity")


def cert_summary(claims: DataFrame) -> DataFrame:
    out = with_signals(with_certificates(claims))
    return out.select("doc_id", "claim_id", F.size("certs").alias("recognized"), F.size("signals").alias("suspicious"))


def cert_rollup(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """Mentions by type, region and domain with all totals: the cube of certificates, counted first so
    that the shuffle holds a row per certificate and task."""
    counts = mentions.groupBy("cert_id").agg(F.count("*").alias("n"))
    rows = counts.join(F.broadcast(registry), F.col("cert_id") == F.col("id")).withColumn("domain", F.explode("domain"))
    out = rows.cube("type", "region", "domain").agg(F.sum("n").alias("mentions"), F.grouping_id().alias("grouping"))
    return out


def severity_risk(severity: Column) -> Column:
    """Points of a severity."""
    out = F.lit(0)
    for s, n in SEVERITY_RISK.items():
        out = F.when(severity == s, n).otherwise(out)
    return out
