"""Structured text into corpus chunks: headings, lessons carried forward, verse entries, and rendered prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import lesson_id
from ..functions.text import strip


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def clean_body(text: Column) -> Column:
    """Stripped, with at most one blank line in a row."""
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def heading_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``block`` from 0 on, ``level``, ``heading`` and ``body`` of every heading of one to four marks. Text before
    the first heading is left out, as are texts without one."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=#{1,4}[ \t]+\S)")
    found = F.filter(parts, lambda p: p.rlike(r"^#{1,4}[ \t]+\S"))
    out = df.select(key, F.posexplode(found).alias("block", "p"))
    line = F.substring_index("p", "\n", 1)
    body = F.when(F.instr("p", "\n") > 0, F.substring("p", F.instr("p", "\n") + 1, F.length("p"))).otherwise("")
    return out.select(key, "block", F.length(F.regexp_extract(line, "^(#+)", 1)).alias("level"), strip(F.regexp_replace(line, "^#+", "")).alias("heading"), clean_body(body).alias("body"))


def carry_lessons(blocks: DataFrame, source: str, order: str, heading: str, section: str) -> DataFrame:
    """Blocks with the lesson that the last heading with one named (``preamble`` before any), and a chunk id that counts
    the blocks of each lesson and section."""
    upto = Window.partitionBy(source).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    b = blocks.withColumn("lesson", F.coalesce(F.last(lesson_id(F.col(heading)), ignorenulls=True).over(upto), F.lit("preamble")))
    n = F.row_number().over(Window.partitionBy(source, "lesson", section).orderBy(order))
    return b.withColumn("chunk_id", F.format_string("%s:%s:%s:%03d", F.col(source), F.col("lesson"), F.col(section), n))


def verse_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """Entries of bold lines followed by their explanation: ``key``, ``entry`` from 1 on, ``verse``, ``explanation``. A bold
    line behind explanation text opens the next entry; blank lines don't count."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).withColumn("line", strip(F.col("line"))).filter("line != ''")
    w = Window.partitionBy(key).orderBy("pos")
    bold = F.col("line").rlike(r"^\*\*.+\*\*$")
    lines = lines.withColumn("bold", bold).withColumn("opens", (F.col("bold") & ~F.coalesce(F.lag("bold").over(w), F.lit(False))).cast("int"))
    lines = lines.withColumn("entry", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("entry > 0")
    joined = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return lines.groupBy(key, "entry").agg(joined(F.col("bold")).alias("verse"), joined(~F.col("bold")).alias("explanation"))


def _numbered(rows: DataFrame, source: str, *order: str) -> DataFrame:
    """Corpus chunks (chunk_id, source, lesson_id, section_type, text) of rows with ``lesson``, ``section`` and ``text``;
    blank texts are left out and take no number."""
    kept = rows.filter(F.col("text") != "")
    n = F.row_number().over(Window.partitionBy("doc", "lesson", "section").orderBy(*order))
    return kept.select("doc", F.format_string("%s:%s:%s:%03d", F.lit(source), "lesson", "section", n).alias("chunk_id"), F.lit(source).alias("source"), F.col("lesson").alias("lesson_id"), F.col("section").alias("section_type"), "text")


def _lessons(df: DataFrame, key: str, text: str, level: int) -> DataFrame:
    """Heading blocks, each with the lesson that the last heading of ``level`` with one names, ``preamble`` before any, and
    ``own``, the lesson that the block itself names."""
    blocks = heading_blocks(df, key, text).withColumnRenamed(key, "doc")
    own = F.when(F.col("level") == level, lesson_id(F.col("heading")))
    upto = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("own", own).withColumn("lesson", F.coalesce(F.last("own", ignorenulls=True).over(upto), F.lit("preamble"))).withColumn("text", clean_body(strip_tags(F.col("body"))))


def textbook_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """A textbook's poems, below third-level headings that name a lesson, and its literary notes, below fourth-level
    headings of that name. Other blocks are left out."""
    b = _lessons(df, key, text, 3)
    section = F.when((F.col("level") == 3) & F.col("own").isNotNull(), "poem").when((F.col("level") == 4) & F.col("heading").startswith("دانش ادبی"), "literary-notes")
    return _numbered(b.withColumn("section", section).filter("section is not null"), "textbook", "block")


def study_guide_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """A study guide's vocabularies and verse explanations, by the title of third-level headings; second-level ones name the
    lesson. Each verse entry is a chunk of its own."""
    b = _lessons(df, key, text, 2).filter("level = 3")
    words = b.filter(F.col("heading").startswith("معنی لغت")).select("doc", "block", "lesson", F.lit(0).alias("entry"), F.lit("vocabulary").alias("section"), "text")
    verses = b.filter(F.col("heading").startswith("معنی ابیات")).withColumn("_k", F.struct("doc", "block", "lesson"))
    entries = verse_entries(verses, "_k", "body")
    parts = F.concat_ws("\n", "verse", F.nullif(F.col("explanation"), F.lit("")))
    entries = entries.select("_k.doc", "_k.block", "_k.lesson", "entry", F.lit("verse-explanation").alias("section"), strip(strip_tags(parts)).alias("text"))
    return _numbered(words.unionByName(entries), "study-guide", "block", "entry")


def gifted_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every third-level block of an analysis, below the lesson that it or an earlier one names."""
    return _numbered(_lessons(df, key, text, 3).filter("level = 3").withColumn("section", F.lit("deep-analysis")), "gifted", "block")


def instructed_query(persona: Column, query: Column) -> Column:
    """The query behind its persona as an instruction; alone without a persona."""
    return F.when(F.coalesce(persona, F.lit("")) == "", query).otherwise(F.concat(F.lit("Instruct: "), persona, F.lit("\nQuery: "), query))


def context_prompt(hits: DataFrame, query: str, query_text: str, rank: str, source: str, text: str) -> DataFrame:
    """One prompt per query with its numbered hits in order of rank. The hits of a query are the few that were retrieved."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(source).alias("s"), F.col(text).alias("t"))))
    lines = F.transform(parts, lambda x: F.concat(F.lit("["), x.r.cast("string"), F.lit("] (source: "), x.s, F.lit(") "), x.t))
    return hits.groupBy(query, query_text).agg(F.concat(F.array_join(lines, "\n"), F.lit("\n\nQuestion: "), F.first(query_text)).alias("prompt"))
