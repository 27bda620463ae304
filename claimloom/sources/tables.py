"""Documents, files, registries and old histories as tables, and results as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import CONTEXTS, LEXICON, SECTORS
from ..functions.semantics import or_null
from .json_array import read_json_array

MAX_CHARS = 10_000
MAX_FILE = 50 * 1024 * 1024
REPORT_TYPES = ["esg_report", "annual_report", "sustainability_report", "csr_report", "tcfd_report", "other"]


def reject_reason(limit: int = MAX_CHARS) -> Column:
    """Why a row of documents can't be analysed, or null."""
    c = F.col
    blank = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+\z", "") == ""
    known = lambda name, labels: c(name).isNull() | c(name).isin("", "auto", *labels)
    return F.when(blank, "empty").when(F.length("text") > limit, "too_long").when(~known("context_type", CONTEXTS), "bad_context_type").when(~known("sector", [*SECTORS, "general"]), "bad_sector")


def read_documents(rows: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """Analysable rows; blank kinds are `auto`."""
    auto = lambda name: F.when(F.coalesce(name, F.lit("")) == "", "auto").otherwise(F.col(name))
    return rows.filter(reject_reason(limit).isNull()).withColumns({"context_type": auto("context_type"), "sector": auto("sector")})


def reject_documents(rows: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    return rows.withColumn("reason", reject_reason(limit)).filter("reason IS NOT NULL").select("doc_id", "reason")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def inventory_pdfs(files: DataFrame, limit: int = MAX_FILE) -> DataFrame:
    """files: path, length, content. The mark may stand anywhere in the first 1,024 bytes."""
    marked = F.instr(F.decode(F.substring("content", 1, 1024), "ISO-8859-1"), "%PDF-") > 0
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > limit, "too_large").when(~marked, "not_pdf")
    return files.select("path", F.col("length").alias("size"), F.coalesce(marked, F.lit(False)).alias("is_pdf"), reason.alias("reason"))


def read_page_text(spark: SparkSession, path: str) -> DataFrame:
    """Text dumps, one document per file: NUL removed, page ends kept."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.input_file_name().alias("doc_id"), without_nul(F.col("value")).alias("raw_text"))


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def read_lexicon(spark: SparkSession, path: str | None = None) -> dict[str, list[str]]:
    """Terms by category: from a JSON table (category, ord, term) at path, else the fixed ones. No terms is an error."""
    if path is None:
        return LEXICON
    rows = spark.read.schema("category string, ord int, term string").json(path).filter("category IS NOT NULL AND term IS NOT NULL").orderBy("category", "ord").limit(100_001).collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.category, []).append(r.term)
    if not out:
        raise ValueError(f"{path} has no terms")
    if len(rows) > 100_000:
        raise ValueError(f"{path} has over 100,000 terms, which is no lexicon to match every text with")
    return out


def read_legacy_history(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of old analyses as history rows, read by as many tasks as the file has ranges.

    Texts and kinds stand in `request` or beside it; kinds may also be those that a classification chose,
    and are `auto` otherwise. A missing id is made from the element itself, so reading twice gives it twice
    alike; a missing time is the first of 1970. Elements that are no objects are left out."""
    rows = read_json_array(spark, path).filter(F.json_object_keys("json").isNotNull())
    told = lambda *paths: F.coalesce(*[or_null(F.get_json_object("json", f"$.{p}")) for p in paths])
    part = lambda p: or_null(F.get_json_object("json", f"$.{p}"))
    kind = lambda name, chosen: F.coalesce(told(f"request.{name}", name, f"classification.{chosen}.selected"), F.lit("auto"))
    return rows.select(
        F.coalesce(told("id"), F.concat(F.lit("old-"), F.substring(F.sha2(F.concat_ws("/", F.col("element").cast("string"), "json"), 256), 1, 32))).alias("id"), F.coalesce(F.to_timestamp(told("createdAt")), F.lit("1970-01-01").cast("timestamp")).alias("created_at"),
        F.coalesce(told("request.text", "text"), F.lit("")).alias("request_text"), kind("contextType", "context").alias("context_type"), kind("sector", "sector").alias("sector"), F.coalesce(part("result"), F.lit("{}")).alias("result_json"),
        *[part(p).alias(f"{p}_json") for p in ("llm", "verification", "classification", "meta")],
    )


def export_reports(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """One nested report per document as JSON text; write it with .write.text or keep the struct."""
    own = claims.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("claim_id", "claim_risk", "risk_level"))).alias("own"))
    rows = docs.join(own, "doc_id", "left")
    return rows.select("doc_id", F.to_json(F.struct("doc_id", "gri", F.col("risk_level").alias("level"), F.coalesce("own", F.expr("array()").cast("array<struct<claim_id: string, claim_risk: double, risk_level: string>>")).alias("claims"))).alias("report"))


def write_feedback(rows: DataFrame, path: str, per_file: int = 10_000) -> None:
    """Exported feedback as JSON lines in files of per_file rows, in the order of rows. Spark's writer moves
    files into place when the job has ended, so one that fails leaves none, and no mark of success."""
    rows.write.option("maxRecordsPerFile", per_file).options(ignoreNullFields=False, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def write_reports(reports: DataFrame, path: str, per_file: int = 1000, compression: str = "none") -> None:
    """Reports (a column of JSON text), one a line; with per_file = 1 each report is a file of its own. Reports repeat
    their names and terms, so gzip makes them some sixteen times smaller; read_reports reads either."""
    reports.select("report").write.option("maxRecordsPerFile", per_file).option("compression", compression).text(path)


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def filename_metadata(paths: DataFrame) -> DataFrame:
    """company, year, report_type, confidence from names of files."""
    base = F.regexp_replace(F.coalesce("path", F.lit("")), r"(?i)\.pdf$", "")
    rows = paths.withColumn("__b", base).withColumn("__y", F.regexp_extract("__b", r"(?:^|[^0-9])(199\d|20\d{2})(?:[^0-9]|$)", 1))
    head = F.when(F.col("__y") == "", F.col("__b")).otherwise(F.expr("substring(__b, 1, locate(__y, __b) - 1)"))
    name = F.substring(F.trim(F.regexp_replace(F.regexp_replace(head, "[-_]+", " "), r"\s+", " ")), 1, 120)
    return rows.select(*paths.columns, F.when(name != "", name).alias("company"), F.when(F.col("__y") != "", F.col("__y").cast("int")).alias("year"), F.lit("esg_report").alias("report_type"), F.when(F.coalesce("path", F.lit("")) == "", 0.0).otherwise(0.4).cast("double").alias("confidence"))


def metadata_merge(own: DataFrame, model: DataFrame, key: str = "path") -> DataFrame:
    """The model's values where they are valid, else those of the file name. model: key, m_company, m_year,
    m_report_type, m_confidence."""
    rows = own.join(model, key, "left")
    company = F.when(F.trim("m_company") != "", F.substring(F.trim("m_company"), 1, 120))
    year = F.when(F.col("m_year").between(1900, 2100), F.col("m_year"))
    there = F.col("m_present")
    d = lambda x: F.lit(x).cast("double")
    return rows.select(
        key,
        F.coalesce(company, "company").alias("company"),
        F.coalesce(year, "year").alias("year"),
        F.when(F.col("m_report_type").isin(REPORT_TYPES), F.col("m_report_type")).otherwise("esg_report").alias("report_type"),
        F.when(there, F.coalesce(F.greatest(d(0), F.least(d(1), "m_confidence")), d(0.7))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(~F.coalesce(there, F.lit(False)), "filename").when(company.isNotNull() & year.isNotNull(), "llm").otherwise("llm-partial").alias("source"),
    )
