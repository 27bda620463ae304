"""Terms, flags and lengths of texts. All of it is one projection; nothing is joined or shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import LEXICON, QUANTITY_V1, QUANTITY_V2, TIMELINE_V1, TIMELINE_V2
from ..functions.semantics import each, list_name, lists_in, matches, spans_in

CJK = "[\\u4e00-\\u9fff]"


THERE = "__there"


def with_terms(rows: DataFrame, *lexicons: dict[str, list[str]]) -> DataFrame:
    """rows with the terms of all lexicons that the text contains, by their lists (own_terms)."""
    return rows.withColumn(THERE, lists_in(F.lower("text"), [terms for lexicon in lexicons for terms in lexicon.values()]))


def own_terms(terms: list[str]) -> Column:
    """Those of terms that the text contains, in declared order, from with_terms."""
    return F.col(THERE)[list_name(terms)]


def match_lexicon(claims: DataFrame, lexicon: dict[str, list[str]] = LEXICON, mode: str = "substring") -> DataFrame:
    """Long form: one row per hit, with the category and the term's place in it. mode `word` asks for
    ASCII word boundaries around the term."""
    import re

    def hits(text: Column, terms: list[str]) -> Column:
        if mode == "substring":
            return own_terms(terms)
        return F.filter(F.array(*[F.when(matches(text, rf"(?<![A-Za-z0-9_]){re.escape(t)}(?![A-Za-z0-9_])"), t) for t in terms]), lambda t: t.isNotNull())

    per = F.array(*[F.struct(F.lit(c).alias("category"), hits(F.col("text"), terms).alias("terms")) for c, terms in lexicon.items()])
    rows = with_terms(claims, lexicon) if mode == "substring" else claims
    rows = each(rows, claims.columns, per, "h")
    rows = each(rows, [*claims.columns, "h.category"], "h.terms", "term", "hit")
    return rows.withColumn("hit", F.col("hit") + 1)


def lexicon_counts(claims: DataFrame, lexicon: dict[str, list[str]] = LEXICON) -> DataFrame:
    """Wide form: m_<category> (terms in order) and n_<category>. The text is searched once for all terms."""
    rows = claims if THERE in claims.columns else with_terms(claims, lexicon)
    wide = rows.withColumns({f"m_{c}": own_terms(terms) for c, terms in lexicon.items()}).drop(THERE)
    return wide.withColumns({f"n_{c}": F.size(f"m_{c}") for c in lexicon})


def flags_v2(claims: DataFrame) -> DataFrame:
    return claims.withColumns({"quantified": matches(F.col("text"), QUANTITY_V2), "timeline": matches(F.col("text"), TIMELINE_V2)})


def flags_v1(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"quantified": F.lower("text").rlike(QUANTITY_V1), "timeline": matches(F.col("text"), TIMELINE_V1)})


def approx_tokens(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return (words + F.ceil(F.regexp_count(text, F.lit(CJK)) * F.lit(0.6).cast("double"))).cast("int")


def text_metrics(docs: DataFrame) -> DataFrame:
    """latin_words, cjk, density (characters but blanks), tokens."""
    t = F.col("text")
    out = docs.withColumns({"latin_words": F.regexp_count(t, F.lit("[a-zA-Z]+(?:[-'][a-zA-Z]+)?")), "cjk": F.regexp_count(t, F.lit(CJK)), "density": F.length(F.regexp_replace(t, r"\s+", ""))})
    return out.withColumn("tokens", F.col("latin_words") + F.col("cjk"))


def term_coverage(claims: DataFrame, lexicon: dict[str, list[str]] = LEXICON) -> DataFrame:
    """Documents with each term, and their share of all documents. Distinct terms per document come
    first, so a term in every claim is one row per document in the shuffle."""
    per_doc = match_lexicon(claims, lexicon).select("doc_id", "category", "term").distinct()
    total = claims.agg(F.countDistinct("doc_id").alias("all"))
    counts = per_doc.groupBy("category", "term").agg(F.count("*").alias("docs"))
    return counts.crossJoin(F.broadcast(total)).select("category", "term", "docs", (F.col("docs") / F.col("all")).alias("share"))  # one row


def breakdown_v2(features: DataFrame) -> DataFrame:
    """Shares of vague, unproven, absolute and future claims of a document, times 25."""
    part = lambda c: F.avg(c.cast("int").cast("double")) * 25
    n = F.col
    return features.groupBy("doc_id").agg(part(n("n_vague") > 0).alias("vague"), part(n("n_proof") == 0).alias("no_proof"), part(n("n_absolute") > 0).alias("absolute"), part(n("n_future") > 0).alias("future"))


def highlight_spans(docs: DataFrame, lexicon: dict[str, list[str]] = LEXICON) -> DataFrame:
    """Every occurrence of every term: category, term, start, end. Occurrences of one term don't overlap."""
    rows = docs.select("doc_id", spans_in(F.lower("text"), [(c, t) for c, terms in lexicon.items() for t in terms]).alias("spans"))
    return each(rows, ["doc_id"], "spans", "s").select("doc_id", "s.*")
