"""From raw page text to paragraph and table blocks, and from documents to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import REFERENCE_INDEX
from ..functions.semantics import matches

HAN = "\\u4e00-\\u9fff\\u3400-\\u4dbf"
DASHES = ["-", "—", "–"]
SENTENCE_ENDS = [".", "。", "！", "？", "!", "?", "…", "」", "）", ")", '"', "'", "”", "’"]
STARTS_LOWER = f"^[\\p{{Ll}}{HAN}0-9\\-—–]"
LIMIT = 10_000
PROFILES = {"data_heavy": (500, 80), "narrative": (350, 50), "standard": (512, 100)}


def normalize(text: Column) -> Column:
    """One blank for blanks and tabs, no blanks before line ends, at most one empty line, trimmed."""
    for p, r in (("\r\n", "\n"), (" ", " "), ("[\t ]+", " "), (" +\n", "\n"), ("\n{3,}", "\n\n"), (r"^\s+|\s+\z", "")):
        text = F.regexp_replace(text, p, r)
    return text


def split_pages(raw: DataFrame) -> DataFrame:
    pages = raw.select("doc_id", F.posexplode(F.split("raw_text", "\f", -1)).alias("page", "text"))
    return pages.withColumn("page", F.col("page") + 1)


def repair_letter_spacing(text: Column) -> Column:
    """Runs of three or more single Latin letters lose their blanks, and so do neighbours of Han characters."""
    # mark blanks between lone letters; a mark without another one beside its letters is a blank again
    text = F.regexp_replace(text, r"(?<=(?:^|\s)[A-Za-z]) (?=[A-Za-z](?![A-Za-z]))", "\x00")
    text = F.regexp_replace(text, r"(?<!\x00[A-Za-z])\x00(?![A-Za-z]\x00)", " ")
    text = F.regexp_replace(text, r"\x00", "")
    return F.regexp_replace(text, f"(?<=[{HAN}]) (?=[{HAN}])", "")


def split_lines(pages: DataFrame) -> DataFrame:
    """Trimmed lines with their place; lines of one or two characters without a letter are dropped (so are
    lone Han characters); empty lines stay, they end paragraphs."""
    text = F.regexp_replace("text", "\r\n?", "\n")
    rows = pages.select("doc_id", "page", F.posexplode(F.split(text, "\n", -1)).alias("line", "text"))
    rows = rows.withColumn("text", F.regexp_replace("text", r"^\s+|\s+\z", ""))
    return rows.filter(~((F.length("text") <= 2) & F.col("text").rlike(r"^[^A-Za-z_]+$")))


def tag_table_rows(lines: DataFrame) -> DataFrame:
    gaps, n = F.regexp_count("text", F.lit("[ \t]{2,}")), F.greatest(F.lit(1), F.length("text"))
    blanks, digits = F.regexp_count("text", F.lit("[ \t]")) / n, F.regexp_count("text", F.lit("[0-9]")) / n
    return lines.withColumn("is_table", (gaps >= 3) | ((gaps >= 1) & ((blanks > 0.35) | (digits > 0.4))))


def _block_marks(lines: DataFrame) -> DataFrame:
    """Rows with the number of their block in the page: a change of kind starts one, and an empty line
    before a text row does; between table rows empty lines don't count."""
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    rows = lines.withColumn("blank", F.col("text") == "")
    rows = rows.withColumn("gap", F.coalesce(F.lag("blank").over(w), F.lit(False)))
    rows = rows.withColumn("since", F.sum(F.col("gap").cast("int")).over(w)).filter(~F.col("blank"))
    before, was = F.lag("is_table").over(w), F.lag("since").over(w)
    new = before.isNull() | (before != F.col("is_table")) | (~F.col("is_table") & (F.col("since") > was))
    return rows.withColumn("block", F.sum(new.cast("int")).over(w))


def _joined_lines(lines: Column) -> Column:
    """Lines of a paragraph as text: a line joins the one before if that ends in a dash, or doesn't end a
    sentence and this starts in lower case, Han, digit or dash. The dash goes; Han needs no blank."""

    def step(acc: Column, line: Column) -> Column:
        last = F.substring(acc, -1, 1)
        head = F.substring(line, 1, 1)
        han = last.rlike(f"[{HAN}]") | head.rlike(f"[{HAN}]")
        words = last.rlike(f"[\\p{{Ll}}{HAN}0-9]") & head.rlike(f"[\\p{{Ll}}{HAN}0-9]")
        glue = F.when(words & han, F.concat(acc, line)).otherwise(F.concat(acc, F.lit(" "), line))
        dash = F.concat(F.substring(acc, F.lit(1), F.length(acc) - 1), line)
        return F.when(acc == "", line).when(last.isin(DASHES), dash).when(~last.isin(SENTENCE_ENDS) & line.rlike(STARTS_LOWER), glue).otherwise(F.concat(acc, F.lit("\n"), line))

    return F.aggregate(lines, F.lit(""), step)


def build_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of a page: type, text (merged lines of a paragraph) or rows (of a table), in page order. A
    page is the unit of order; documents of any number of pages spread over tasks."""
    rows = _block_marks(lines).groupBy("doc_id", "page", "block").agg(F.first("is_table").alias("is_table"), F.sort_array(F.collect_list(F.struct("line", "text"))).alias("l"))
    texts = F.col("l.text")
    return rows.select("doc_id", "page", "block", F.when(F.col("is_table"), "table").otherwise("paragraph").alias("type"), F.when(~F.col("is_table"), _joined_lines(texts)).alias("text"), F.when(F.col("is_table"), texts).alias("rows"), texts.alias("lines"))


def flag_reference_index(blocks: DataFrame) -> DataFrame:
    hidden = (F.col("type") == "paragraph") & matches(F.col("text"), REFERENCE_INDEX)
    return blocks.withColumns({"hidden": F.coalesce(hidden, F.lit(False)), "hidden_reason": F.when(hidden, "reference_index")})


def last_position(text: Column, mark: str) -> Column:
    """1-based place of the last occurrence, 0 if none."""
    at = F.locate(mark, F.reverse(text))
    return F.when(at > 0, F.length(text) - at + 1).otherwise(0)


def assemble_documents(blocks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Paragraphs joined by an empty line, blanks tidied, cut at limit characters, back to the last break
    if that lies beyond 70 %."""
    parts = blocks.filter("type = 'paragraph'").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "block", "text"))).alias("b"))
    text = F.array_join(F.col("b.text"), "\n\n")
    for p, r in (("[ \t]{2,}", " "), ("\n{3,}", "\n\n"), ("(?m)^[ \t]+", ""), ("(?m)[ \t]+$", "")):
        text = F.regexp_replace(text, p, r)
    docs = parts.select("doc_id", text.alias("full")).withColumn("cut", F.substring("full", 1, limit))
    at = F.greatest(*[last_position(F.col("cut"), m) for m in ("\n", "。", ".", " ")])
    short = F.when((F.length("full") > limit) & (at - 1 > 0.7 * limit), F.substring("cut", F.lit(1), at)).otherwise(F.col("cut"))
    return docs.select("doc_id", F.regexp_replace(short, r"^\s+|\s+\z", "").alias("text"), (F.length("full") > limit).alias("truncated"))


def cleaning_stats(raw: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Lengths, lines removed, table blocks, warnings per raw document (zeros where nothing is left)."""
    lines = F.size(F.split(F.regexp_replace("raw_text", "\r\n?", "\n"), "[\n\f]", -1))
    kept = F.sum(F.when(F.col("type") == "table", F.size("rows")).otherwise(F.size(F.split("text", "\n", -1))))
    per = blocks.groupBy("doc_id").agg(kept.alias("kept"), F.count_if(F.col("type") == "table").alias("table_blocks"))
    out = raw.select("doc_id", F.length("raw_text").alias("original_length"), lines.alias("lines")).join(per, "doc_id", "left").join(documents, "doc_id", "left")
    out = out.select("doc_id", "original_length", F.coalesce(F.length("text"), F.lit(0)).alias("cleaned_length"), (F.col("lines") - F.coalesce("kept", F.lit(0))).alias("lines_removed"), F.coalesce("table_blocks", F.lit(0)).alias("table_blocks"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
    warnings = F.array(F.when(F.col("truncated"), "truncated"), F.when(F.col("table_blocks") > 0, "tables"), F.when(F.col("lines_removed") > 0, "lines removed"))
    return out.withColumn("warnings", F.array_compact(warnings))


def segment_blocks(blocks: DataFrame, size: int = 2200) -> DataFrame:
    """The segment of each shown block: blocks fill a segment greedily up to size characters. The running
    sum starts anew in each segment, so it is a fold over the document's block lengths."""
    n = F.length(F.coalesce("text", F.array_join("rows", "\n")))
    shown = blocks.filter(~F.col("hidden")).withColumn("n", n)
    docs = shown.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "block", "n"))).alias("b"))
    start = F.struct(F.lit(1).alias("seg"), F.lit(0).alias("sum"), F.array().cast("array<int>").alias("segs"))

    def step(a: Column, b: Column) -> Column:
        fits = (a["sum"] == 0) | (a["sum"] + b["n"] <= size)
        seg = F.when(fits, a["seg"]).otherwise(a["seg"] + 1)
        return F.struct(seg.alias("seg"), F.when(fits, a["sum"] + b["n"]).otherwise(b["n"]).alias("sum"), F.concat(a["segs"], F.array(seg)).alias("segs"))

    folded = docs.withColumn("s", F.aggregate("b", start, step)["segs"])
    return folded.select("doc_id", F.explode(F.arrays_zip("b", "s")).alias("z")).select("doc_id", "z.b.page", "z.b.block", F.col("z.s").alias("segment"))


def sentence_bounds(docs: DataFrame) -> DataFrame:
    """Sentences as [start, end): they end after runs of sentence marks or at a line end."""
    parts = F.regexp_extract_all("text", F.lit("[^.!?。！？…\n]*(?:[.!?。！？…]+|\n|\\z)"), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(F.filter(parts, lambda p: p != "")).alias("i", "p"))
    w = Window.partitionBy("doc_id").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.length("p")).over(w)).withColumn("start", F.col("end") - F.length("p"))
    return rows.filter(F.trim(F.regexp_replace("p", "\n", "")) != "").select("doc_id", F.row_number().over(w).alias("sentence"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def chunk_documents(docs: DataFrame, size: int = 512, overlap: int = 100) -> DataFrame:
    """Chunks of size blank-separated tokens, each overlap tokens into the one before."""
    tokens = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    step = size - overlap
    rows = docs.select("doc_id", tokens.alias("t")).filter(F.size("t") > 0)
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.size("t") - 1 - overlap) / step).cast("int"))
    rows = rows.select("doc_id", "t", F.posexplode(starts).alias("chunk", "i"))
    part = F.slice("t", F.col("i") * step + 1, F.lit(size))
    return rows.select("doc_id", F.col("chunk"), (F.col("i") * step).alias("first_token"), F.size(part).alias("tokens"), F.array_join(part, " ").alias("text"))


def choose_chunk_profile(files: DataFrame) -> DataFrame:
    """By KB per page: over 15 data_heavy, under 6 narrative, else standard."""
    kb = F.col("bytes") / 1024 / F.greatest(F.col("pages"), F.lit(1))
    name = F.when(kb > 15, "data_heavy").when(kb < 6, "narrative").otherwise("standard")
    at = lambda i: F.create_map(*[x for k, v in PROFILES.items() for x in (F.lit(k), F.lit(v[i]))])[F.col("profile")]
    return files.withColumn("profile", name).withColumns({"chunk_tokens": at(0), "overlap_tokens": at(1)})
