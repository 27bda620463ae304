"""A corpus of claims and documents, derived by Spark from the given tables.

A line item is a claim: its part number picks a sentence, its quantity, discount and ship year fill
the numbers in. An order is a document, its customer the company. Expressions that both Spark and
DuckDB read are kept once, as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import CERTIFICATES, LEXICON
from ..functions.semantics import sql_text

SENTENCES = [
    "We reduced Scope 1 and Scope 2 emissions by {q}% vs {y} baseline, verified to ISO 14064-1 and ISAE 3000.",
    "Our green products help build a greener, sustainable future for our children.",
    "We will reach net zero by 2050 and aim to cut carbon emissions {q}% by 2030.",
    "Our packaging is certified sustainable and 100% recyclable.",
    "In {y} we installed {q} MWh of renewable capacity, audited by a third-party under the GHG Protocol.",
    "我们承诺到2030年实现碳中和，打造更绿色的未来。",
    "与{y}年相比，范围一排放减少{q}%，已通过SBTi核证。",
    "As the industry leader, our own green standard is self-certified and best in class.",
    "Scope 3 emissions fell {d} percent since {y}, reported under GRI and CDP.",
    "The quarterly meeting covered staffing, travel and {q} other items.",
    "We strive to minimize impact and stay committed to a conscious, responsible choice.",
    "Scope 1 and Scope 2 emissions were reduced {d}% compared to {y}.",
    "Certified by FSC under the FSC Chain of Custody standard, all paper is CFC-free.",
    "Our factory plans to purchase {q} tons of low-carbon steel by 2030.",
    "Zero emissions and carbon neutral today, with no independent verification of the claim.",
    "最环保的绿色包装，零排放，守护地球，你的选择。",
    "The airline fleet will use sustainable fuel; target {q}% by 2040.",
    "Annual report: LEED Gold buildings cut energy use {q} kWh per unit, measured with assurance.",
    "Climate emergency: act for future generations and save the planet, last chance!",
    "范围三 已核算 {q} 吨，数据来源为第三方认证，基准年{y}。",
]
NUMBERS = {"q": "CAST(CAST(l_quantity AS INT) AS STRING)", "d": "CAST(CAST(round(l_discount * 100) AS INT) AS STRING)", "y": "CAST(year(l_shipdate) AS STRING)"}


def _sentence(s: str) -> str:
    import re

    parts = [NUMBERS[x[1]] if x[:1] == "{" else sql_text(x) for x in re.split(r"(\{.\})", s) if x]
    return f"concat({', '.join(parts)})"


TEXT = f"CASE CAST(l_partkey % {len(SENTENCES)} AS INT) " + " ".join(f"WHEN {i} THEN {_sentence(s)}" for i, s in enumerate(SENTENCES)) + " END"
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def _every() -> list[str]:
    """Sentences with every certificate and every term, and with what is nearly one: the first half of a name,
    a name in capitals and without blanks, terms less their last letter. Then forms of quantities, years and scopes."""
    out = [f"Checked against {c[1]} and {c[2]} in 2021." for c in CERTIFICATES]
    out += [f"Not quite {c[1][: len(c[1]) // 2]}, nor {c[2][: len(c[2]) // 2]}; rather {c[1].upper()}, {c[1].replace(' ', '')} or {c[1].lower()}." for c in CERTIFICATES]
    for name, terms in LEXICON.items():
        for i in range(0, len(terms), 5):
            own = terms[i : i + 5]
            out += [f"On {name}: {', '.join(own)}.", f"Nearly {name}: {', '.join(t[:-1] for t in own)}. {own[0].upper()}{own[-1].capitalize()}!"]
    out += ["Cut by 12.5 MWh vs 2015 baseline by 2040.", "3 tons of CO2, 45 percent of 7 kg, by 2031 against 1998", "Scope 1, scope 2 and Scope 3 emissions; scope3.", "范围一、范围二和范围三，与2012年相比减少 30 吨，到2035年。", "Reduced 5% from 19 and 8 % since 2016", "10 m³ of water, 4 hectare, 2 acre of land in 2022"]
    out += ["Self certified by our own green seal, an in-house standard.", "An unverified claim with no independent verification; 未经验证。", "Certified by TÜV; certified, they say. 行业第一家与行业第一。", "CFC-free and no CFCs at all, freon free", "Net zero, net-zero and NET ZERO by 2050 for Scope 1."]
    return out


def _every_text() -> str:
    sentences = _every()
    return f"CASE CAST(p_partkey % {len(sentences)} AS INT) " + " ".join(f"WHEN {i} THEN {sql_text(x)}" for i, x in enumerate(sentences)) + " END"


def every_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with every term and certificate: a part is a claim, seven parts are a document."""
    rows = table(spark, sf_dir, "part").select(F.expr("p_partkey div 7").alias("doc_id"), F.expr("CAST(p_partkey % 7 + 1 AS INT)").alias("ord"), F.expr(_every_text()).alias("text"))
    return rows.select("doc_id", "ord", F.format_string("L0-%03d", "ord").alias("claim_id"), "text")


def every_claim_sql() -> str:
    return f"claims AS (SELECT p_partkey // 7 AS doc_id, (p_partkey % 7 + 1)::INT AS ord, 'L0-00' || (p_partkey % 7 + 1) AS claim_id, {_every_text()} AS text FROM part)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, claim_id, text. One shuffle, by doc_id, which later groupings reuse; texts are made after it."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), *ORDER)
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(*ORDER)))
    return rows.select("doc_id", "ord", F.format_string("L0-%03d", "ord").alias("claim_id"), F.expr(TEXT).alias("text"))


CLAIMS_SQL = f"""claims AS (SELECT doc_id, ord, 'L0-' || lpad(ord::VARCHAR, greatest(3, length(ord::VARCHAR))::INT, '0') AS claim_id, text FROM (
  SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)})::INT AS ord, {TEXT} AS text FROM lineitem))"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the claims of an order, three to a paragraph."""
    c = claims(spark, sf_dir)
    lead = F.when(F.col("ord") == 1, "").when(F.col("ord") % 3 == 1, "\n\n").otherwise(" ")
    parts = c.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.concat(lead, "text").alias("p")))).alias("ps"))
    return parts.select("doc_id", F.array_join(F.col("ps.p"), "").alias("text"))


DOCUMENTS_SQL = CLAIMS_SQL + r""",
docs AS (SELECT doc_id, string_agg(CASE WHEN ord = 1 THEN '' WHEN ord % 3 = 1 THEN chr(10) || chr(10) ELSE ' ' END || text, '' ORDER BY ord) AS text FROM claims GROUP BY doc_id)"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, company, year, sector, nation of each order."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    out = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 nations by definition
    return out.select(F.col("o_orderkey").alias("doc_id"), F.col("c_name").alias("company"), F.year("o_orderdate").alias("year"), F.lower("c_mktsegment").alias("sector"), F.col("n_name").alias("nation"))


COMPANIES_SQL = """companies AS (SELECT o_orderkey AS doc_id, c_name AS company, year(o_orderdate)::INT AS year, lower(c_mktsegment) AS sector, n_name AS nation
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
