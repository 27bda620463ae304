"""Claims from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import each

CJK = "[\\u4e00-\\u9fff]"
KINDS = ["achievement", "commitment", "vision", "disclosure", "process"]


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def split_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (0-based), text; empty ones are dropped and not counted."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n", -1), trimmed), lambda p: p != "")
    return each(docs, ["doc_id"], parts, "text", "paragraph")


def split_sentences(paragraphs: DataFrame) -> DataFrame:
    """After . ! ? and their full-width forms where blanks follow, and directly after the full-width forms."""
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?。！？])\s+|(?<=[。！？])", -1), trimmed), lambda s: s != "")
    return each(paragraphs, ["doc_id", "paragraph"], parts, "text", "sentence")


def extract_claims(docs: DataFrame) -> DataFrame:
    """Sentences of five characters or more, numbered in order."""
    rows = split_sentences(split_paragraphs(docs)).filter(F.length("text") >= 5)
    w = Window.partitionBy("doc_id").orderBy("paragraph", "sentence")
    rows = rows.withColumn("ord", F.row_number().over(w))
    return rows.select("doc_id", "ord", F.format_string("L0-%03d", "ord").alias("claim_id"), "text", "paragraph", F.lit("disclosure").alias("claim_type"), F.col("text").rlike("[0-9]").alias("has_data"), claim_language(F.col("text")).alias("language"))


def claim_language(text: Column) -> Column:
    han, latin = F.regexp_count(text, F.lit(CJK)), F.regexp_count(text, F.lit("[a-zA-Z]"))
    share = F.try_divide(han, han + latin)
    return F.when((han == 0) & (latin == 0), "unknown").when(share > 0.7, "zh").when(share < 0.3, "en").otherwise("mixed")


def locate_claims(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """start and end of the first verbatim occurrence, null if there is none."""
    rows = claims.join(docs.select("doc_id", F.col("text").alias("__t")), "doc_id", "left")
    at = F.expr("nullif(locate(text, __t), 0) - 1")
    return rows.withColumn("start", F.when(F.length("text") > 0, at)).withColumn("end", F.col("start") + F.length("text")).drop("__t")


def paragraph_ranges(docs: DataFrame) -> DataFrame:
    """Where each paragraph lies in its document: a fold that looks for each after the one before."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n", -1), trimmed), lambda p: p != "")
    start = F.struct(F.lit(1).alias("from"), F.array().cast("array<int>").alias("at"))

    def step(a: Column, p: Column) -> Column:
        at = F.call_function("locate", p, F.col("text"), a["from"])
        return F.struct((at + F.length(p)).alias("from"), F.concat(a["at"], F.array(at - 1)).alias("at"))

    rows = docs.withColumn("p", parts).withColumn("at", F.aggregate("p", start, step)["at"])
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip("p", "at")).alias("paragraph", "z"))
    return rows.select("doc_id", "paragraph", F.col("z.at").alias("from"), (F.col("z.at") + F.length("z.p")).alias("to"))


def locate_paragraph(located: DataFrame, ranges: DataFrame) -> DataFrame:
    """paragraph_idx: the paragraph that holds a claim's start. An equi-join on the document with a range."""
    c, r = located.alias("c"), ranges.alias("r")
    on = (F.col("c.doc_id") == F.col("r.doc_id")) & (F.col("c.start") >= F.col("r.from")) & (F.col("c.start") < F.col("r.to"))
    return c.join(r, on, "left").select("c.*", F.col("r.paragraph").alias("paragraph_idx"))


def dedupe_claims(claims: DataFrame) -> DataFrame:
    """Texts of five characters or more, the first of equal ones, numbered anew."""
    rows = claims.withColumn("text", trimmed(F.col("text"))).filter(F.length("text") >= 5)
    first = rows.groupBy("doc_id", "text").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    return first.withColumn("ord", F.row_number().over(w)).select("doc_id", "ord", F.format_string("L0-%03d", "ord").alias("claim_id"), "text")


def cap_claims(claims: DataFrame, n: int = 30) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ord")
    return claims.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def validate_claims(parsed: DataFrame) -> DataFrame:
    """Model claims: no empty text, page 1 at least, 300 characters at most, types P, D, C (else D), ids by place."""
    text = trimmed(F.coalesce("claim_text", F.lit("")))
    rows = parsed.withColumn("claim_text", text).filter("claim_text <> ''")
    return rows.withColumns({
        "claim_id": F.coalesce("claim_id", F.format_string("C%03d", F.col("ord"))),
        "claim_text": F.when(F.length("claim_text") > 300, F.concat(F.substring("claim_text", 1, 297), F.lit("..."))).otherwise(F.col("claim_text")),
        "page_number": F.greatest(F.lit(1), F.coalesce("page_number", F.lit(1))),
        "claim_type": F.when(F.col("claim_type").isin("P", "D", "C"), F.col("claim_type")).otherwise("D"),
    })


def split_midpoint(docs: DataFrame) -> DataFrame:
    """Two halves: whole below 200 characters; at an empty line after the middle and before 80 %; else after
    a sentence mark within 300; else at a blank; else in the middle."""
    rows = docs.withColumn("n", F.length("text")).withColumn("mid", F.floor(F.col("n") / 2).cast("int"))
    near = F.expr("substring(text, mid + 1, 300)")
    rows = rows.withColumns({"para": F.expr("locate('\n\n', text, mid + 1)"), "mark": F.length(F.regexp_extract(near, "^[^。.！!？?]*[。.！!？?]", 0)), "blank": F.expr("locate(' ', text, mid + 1)")})
    at = F.when(F.col("n") < 200, F.col("n")).when((F.col("para") > 0) & (F.col("para") - 1 < 0.8 * F.col("n")), F.col("para") - 1).when(F.col("mark") > 0, F.col("mid") + F.col("mark")).when(F.col("blank") > 0, F.col("blank") - 1).otherwise(F.col("mid"))
    rows = rows.withColumn("at", at)
    return rows.select("doc_id", trimmed(F.expr("substring(text, 1, at)")).alias("first_half"), trimmed(F.expr("substring(text, at + 1, n)")).alias("second_half"))


def document_profile(docs: DataFrame) -> DataFrame:
    """Length, language, paragraphs and claims of each document, those without any included."""
    paragraphs = F.size(F.filter(F.split("text", r"\n\s*\n", -1), lambda p: trimmed(p) != ""))
    claims = extract_claims(docs).groupBy("doc_id").agg(F.count("*").alias("claims"))
    own = docs.select("doc_id", F.length("text").alias("length"), claim_language(F.col("text")).alias("language"), paragraphs.alias("paragraphs"))
    return own.join(claims, "doc_id", "left").fillna(0, ["claims"])
