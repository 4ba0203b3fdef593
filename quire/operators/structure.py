"""Structure of documents: font statistics, heading, outline and contents-page candidates, sections, validators, types."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.runtime import prepare

CANDIDATE = ["doc_id", "source", "seq", "start", "title", "level", "confidence", "page_index"]
ISSUE = ["doc_id", "type", "severity", "seq", "title"]
OUTLINE, HEADING, CONTENTS = "outline", "headings", "contents"
Z_LEAST, CONTENTS_SCAN = 1.5, 20


# -- fonts


def font_statistics(blocks: DataFrame) -> DataFrame:
    """doc_id and min, max, mean, and the elements at 1/4, 1/2 and 3/4 of the sorted sizes, without interpolation."""
    some = blocks.where(F.trim("text") != "").groupBy("doc_id").agg(F.sort_array(F.collect_list("font_size")).alias("s"))
    at = lambda k: F.get("s", F.floor(F.size("s") * k / 4).cast("int"))
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s")
    return some.select("doc_id", F.array_min("s").alias("min"), F.array_max("s").alias("max"), F.round(mean, 6).alias("mean"), at(2).alias("median"), at(1).alias("p25"), at(3).alias("p75"))


def body_font(blocks: DataFrame) -> DataFrame:
    """doc_id, size: the most frequent size in steps of a half, the first seen of equally frequent ones."""
    size = (F.bround(F.col("font_size") * 2) / 2).alias("size")
    counts = blocks.where(F.trim("text") != "").groupBy("doc_id", size).agg(F.count("*").alias("n"), F.min(F.struct("page_index", "block_no")).alias("first"))
    return counts.groupBy("doc_id").agg(F.min_by("size", F.struct(-F.col("n"), "first")).alias("size"))


def weighted_body_font(blocks: DataFrame) -> DataFrame:
    """doc_id, size: the size, in tenths, that most characters have; the smaller of equal ones."""
    counts = blocks.where(F.trim("text") != "").groupBy("doc_id", F.round("font_size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"))
    return counts.groupBy("doc_id").agg(F.min_by("size", F.struct(-F.col("n"), "size")).alias("size"))


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of one line and style that stand side by side become one: a fold over each page's blocks in order."""
    fields = ["text", "x0", "y0", "x1", "y1", "font_name", "font_size", "flags"]
    page = blocks.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("block_no", *fields))).alias("all"))
    kind = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double,font_name:string,font_size:double,flags:int>>"

    def add(out: Column, b: Column) -> Column:
        cur = F.element_at(out, -1)
        near = (
            (F.abs(cur["y0"] - b["y0"]) < 2) & (cur["font_name"] == b["font_name"]) & (F.abs(cur["font_size"] - b["font_size"]) < 0.5)
            & (cur["flags"].bitwiseAND(16) == b["flags"].bitwiseAND(16)) & (b["x0"] - cur["x1"] < 20)
        )
        one = F.struct(
            F.concat(cur["text"], F.lit(" "), b["text"]).alias("text"), cur["x0"].alias("x0"), F.least(cur["y0"], b["y0"]).alias("y0"), b["x1"].alias("x1"),
            F.greatest(cur["y1"], b["y1"]).alias("y1"), cur["font_name"].alias("font_name"), cur["font_size"].alias("font_size"), cur["flags"].alias("flags"),
        )
        alone = F.struct(*[b[f].alias(f) for f in fields])
        return F.when(F.size(out) == 0, F.array(alone)).when(near, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(one))).otherwise(F.concat(out, F.array(alone)))

    merged = F.aggregate("all", F.array().cast(kind), add)
    return page.select("doc_id", "page_index", F.posexplode(merged).alias("block_no", "b")).select("doc_id", "page_index", "block_no", "b.*")


# -- candidates


def outline_candidates(outline: DataFrame, pages: DataFrame) -> DataFrame:
    placed = outline.join(pages.select("doc_id", "page_index", "start"), ["doc_id", "page_index"])
    return placed.select("doc_id", F.lit(OUTLINE).alias("source"), "seq", "start", F.trim("title").alias("title"), F.col("level").cast("int").alias("level"), F.lit(0.95).alias("confidence"), "page_index")


def _median(s: Column) -> Column:
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def is_upper(text: Column) -> Column:
    return F.regexp_like(text, F.lit("\\p{Lu}")) & ~F.regexp_like(text, F.lit("\\p{Ll}"))


def is_title(text: Column) -> Column:
    """Capitals start words, and only they do."""
    return F.regexp_like(text, F.lit("\\p{Lu}")) & ~F.regexp_like(text, F.lit("(^|[^\\p{Lu}\\p{Ll}])\\p{Ll}")) & ~F.regexp_like(text, F.lit("[\\p{Lu}\\p{Ll}]\\p{Lu}"))


def heading_score(text: Column, size: Column, bold: Column, median: Column, mad: Column) -> Column:
    z = (size - median) / mad
    words = F.size(F.filter(F.split(text, "[ \\t\\n\\r\\f]+"), lambda w: w != ""))
    parts = (
        F.when(z > Z_LEAST, F.least(F.lit(0.4), z / 5)),
        F.when(bold, F.lit(0.3)),
        F.when(F.length(text) < 100, F.lit(0.15)),
        F.when(is_upper(text) & (F.length(text) > 3), F.lit(0.2)),
        F.when(is_title(text) & (words >= 2), F.lit(0.1)),
    )
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0.0))
    return F.round(F.least(F.lit(1.0), total), 6)


def heading_candidates(blocks: DataFrame, pages: DataFrame, least: float = 0.5, most: float = 0.8) -> DataFrame:
    """Blocks whose size, weight and form make a heading. Each document is grouped once; statistics and scores are taken in place."""
    block = F.struct("page_index", "block_no", F.trim("text").alias("text"), "font_size", (F.col("flags").bitwiseAND(16) != 0).alias("bold"))
    docs = blocks.where(F.trim("text") != "").groupBy("doc_id").agg(F.array_sort(F.collect_list(block)).alias("all"))
    docs = docs.withColumn("sizes", F.sort_array(F.col("all.font_size"))).withColumn("median", _median(F.col("sizes")))
    apart = F.sort_array(F.transform("sizes", lambda x: F.abs(x - F.col("median"))))
    docs = docs.withColumn("mad", F.when(F.size("sizes") < 2, 1.0).otherwise(F.coalesce(F.nullif(_median(apart), F.lit(0.0)), F.lit(1.0))))
    docs = docs.withColumn("large", F.sort_array(F.array_distinct(F.filter("sizes", lambda x: x > F.col("median"))), asc=False)).drop("sizes")
    each = docs.select("doc_id", "median", "mad", "large", F.posexplode("all").alias("seq", "b"))
    score = heading_score(F.col("b.text"), F.col("b.font_size"), F.col("b.bold"), F.col("median"), F.col("mad"))
    rank = F.array_position("large", F.col("b.font_size")).cast("int")
    level = F.when(F.size("large") == 0, 2).when(rank > 0, F.least(rank, F.lit(4))).otherwise(3)
    found = each.select("doc_id", "seq", F.col("b.text").alias("title"), F.col("b.page_index").alias("page_index"), score.alias("score"), level.alias("level")).where(F.col("score") >= least)
    confidence = F.round(F.least(F.lit(most), F.lit(least) + (F.col("score") - least) * 0.8), 6)
    placed = found.join(pages.select("doc_id", "page_index", "start"), ["doc_id", "page_index"])
    return placed.select("doc_id", F.lit(HEADING).alias("source"), "seq", "start", "title", "level", confidence.alias("confidence"), "page_index")


def contents_likelihood(text: Column) -> Column:
    lower = F.lower(text)
    lines = F.split(F.trim(text), "\n", -1)
    with_number = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit("[0-9]+[ \\t]*$"))))
    total = (
        F.when(F.contains(lower, F.lit("table of contents")), 0.5).when(F.contains(lower, F.lit("contents")), 0.3).otherwise(0.0)
        + F.when(F.regexp_like(text, F.lit("\\.{3,}")), 0.3).otherwise(0.0)
        + F.when(with_number / F.size(lines) > 0.3, 0.3).otherwise(0.0)
    )
    return F.when(text == "", 0.0).otherwise(F.round(F.least(F.lit(1.0), total), 6))


def contents_pages(pages: DataFrame, scan: int = CONTENTS_SCAN) -> DataFrame:
    """Pages among the first ones that look like a table of contents, with their likelihood."""
    return pages.where(F.col("page_index") < scan).withColumn("likelihood", contents_likelihood(F.col("text"))).where(F.col("likelihood") > 0.5)


def contents_entries(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, line_no, title, page_ref, level of the lines of contents pages: dots or wide space before a number."""
    lines = pages.select("doc_id", "page_index", F.posexplode(F.split(F.trim("text"), "\n", -1)).alias("line_no", "raw")).withColumn("line", F.trim("raw")).where(F.length("line") >= 5)
    dots, wide = "^(.+?)[ \\t]*\\.{3,}[ \\t]*([0-9]+)[ \\t]*$", "^(.+?)[ \\t]{2,}([0-9]+)[ \\t]*$"
    has_dots = F.regexp_like("line", F.lit(dots))
    pattern = lambda k: F.when(has_dots, F.regexp_extract("line", dots, k)).otherwise(F.regexp_extract("line", wide, k))
    found = lines.select("doc_id", "page_index", "line_no", has_dots.alias("dots"), F.trim(pattern(1)).alias("title"), pattern(2).alias("page_ref")).where("page_ref <> '' AND (dots OR length(title) > 3)")
    level = F.when(F.regexp_like(F.lower("title"), F.lit("^(chapter|part)[ \\t]+")), 1).when(F.regexp_like("title", F.lit("^[0-9]+\\.[0-9]+")), 2).otherwise(1)
    return found.select("doc_id", "page_index", "line_no", "title", "page_ref", level.alias("level"))


def resolve_page(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """entries with `page`: a number from 1 to the number of pages counts pages, anything else is looked up among the labels."""
    counted = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    label = pages.groupBy("doc_id", F.col("label").alias("page_ref")).agg(F.min("page_index").alias("by_label"))
    number = F.expr("try_cast(page_ref AS bigint)")
    both = entries.join(counted, "doc_id").join(label, ["doc_id", "page_ref"], "left")
    return both.withColumn("page", F.coalesce(F.when(number.between(1, F.col("n_pages")), number - 1), F.col("by_label"))).drop("n_pages", "by_label")


def contents_candidates(contents: DataFrame, pages: DataFrame) -> DataFrame:
    found = resolve_page(contents_entries(contents_pages(contents)), pages).where("page IS NOT NULL").drop("page_index").withColumnRenamed("page", "page_index")
    placed = found.join(pages.select("doc_id", "page_index", "start"), ["doc_id", "page_index"])
    return placed.select("doc_id", F.lit(CONTENTS).alias("source"), F.col("line_no").alias("seq"), "start", "title", "level", F.lit(0.7).alias("confidence"), "page_index")


# -- sections


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two titles."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def enrich_titles(candidates: DataFrame, contents: DataFrame, least: float = 0.8) -> DataFrame:
    """Titles take the spelling of the likest contents entry within a page, if it is like enough; the first of equals."""
    prepare(candidates.sparkSession)
    e = contents.select(F.col("doc_id").alias("_d"), F.col("page_index").alias("_p"), F.col("seq").alias("_s"), F.col("title").alias("_title"))
    near = candidates.join(e, (F.col("doc_id") == F.col("_d")) & (F.abs(F.col("page_index") - F.col("_p")) <= 1))
    near = near.select("doc_id", "seq", "_s", "_title", likeness(F.lower("title"), F.lower("_title")).alias("r")).where(F.col("r") >= least)
    best = near.groupBy("doc_id", "seq").agg(F.min_by("_title", F.struct(-F.col("r"), F.col("_s"))).alias("better"))
    return candidates.join(best, ["doc_id", "seq"], "left").withColumn("title", F.coalesce("better", "title")).select(*candidates.columns)


def cascade(outline: DataFrame, headings: DataFrame) -> DataFrame:
    """Candidates of the outline where a document has one, else its headings."""
    return outline.unionByName(headings.join(outline.select("doc_id").distinct(), "doc_id", "left_anti").select(CANDIDATE))


def sections(candidates: DataFrame, texts: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, seq, start, end, title, level, confidence, source: candidates that are sure enough, each until the next one starts."""
    kept = candidates.where(F.col("confidence") >= least)
    order = Window.partitionBy("doc_id").orderBy("start", "seq")
    out = kept.withColumn("next", F.lead("start").over(order)).withColumn("n", F.row_number().over(order) - 1)
    out = out.join(texts.select("doc_id", F.length("text").cast("long").alias("size")), "doc_id")
    return out.select("doc_id", F.col("n").alias("seq"), "start", F.coalesce("next", "size").alias("end"), "title", "level", "confidence", "source")


# -- validators: sections in, issues out


def _issues(found: DataFrame, kind: str | Column, severity: str | Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return found.select("doc_id", lit(kind).alias("type"), lit(severity).alias("severity"), "seq", "title")


def overlap_issues(s: DataFrame) -> DataFrame:
    """Sections of one level that run past the start of the next."""
    following = F.lead("start").over(Window.partitionBy("doc_id", "level").orderBy("start", "seq"))
    return _issues(s.withColumn("_n", following).where("end > _n"), "overlap", "warning")


def hierarchy_issues(s: DataFrame) -> DataFrame:
    """Sections more than one level below the one before."""
    before = F.lag("level", 1, 0).over(Window.partitionBy("doc_id").orderBy("start", "seq"))
    return _issues(s.withColumn("_b", before).where("level > _b + 1"), "hierarchy_skip", "info")


def content_issues(s: DataFrame, least: int = 100) -> DataFrame:
    return _issues(s.where(F.col("end") - F.col("start") < least), "short_section", "info")


def title_issues(s: DataFrame) -> DataFrame:
    t = F.trim("title")
    kind = F.when(F.length(t) < 3, "short_title").when(F.length(t) > 200, "long_title").when(F.regexp_like(t, F.lit("^[0-9]+$")), "numeric_title")
    severity = F.when((F.length(t) > 200), "warning").otherwise("info")
    found = s.withColumn("_k", kind).withColumn("_s", severity).where("_k IS NOT NULL")
    return _issues(found.withColumn("title", F.when(F.col("_k") == "long_title", F.concat(F.substring(t, 1, 50), F.lit("..."))).otherwise(t)), F.col("_k"), F.col("_s"))


Validator = Callable[[DataFrame], DataFrame]
VALIDATORS: dict[str, Validator] = {"overlap": overlap_issues, "hierarchy": hierarchy_issues, "min_content": content_issues, "title_quality": title_issues}


def validate(s: DataFrame, rules: Iterable[Validator] = tuple(VALIDATORS.values())) -> DataFrame:
    """The issues of all validators; any function from sections to issues can be one."""
    tables = [r(s).select(ISSUE) for r in rules]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def structure_confidence(s: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, confidence: mean of the sections, more with an outline, less for every issue."""
    base = s.groupBy("doc_id").agg((F.sum(F.round(F.col("confidence") * 1e6).cast("long")) / F.count("*") / 1e6).alias("base"), F.max((F.col("source") == OUTLINE).cast("int")).alias("outlined"))
    fine = issues.groupBy("doc_id").agg((F.sum(F.when(F.col("severity") == "warning", 5).otherwise(2)) / 100).alias("fine"))
    value = F.when(F.col("outlined") == 1, F.least(F.lit(1.0), F.col("base") + 0.05)).otherwise(F.col("base")) - F.coalesce("fine", F.lit(0.0))
    return base.join(fine, "doc_id", "left").select("doc_id", F.round(F.greatest(F.lit(0.0), value), 6).alias("confidence"))


# -- document types and profiles

#: name, uses a contents page, least confidence, validators
PROFILES = (
    ("book", True, 0.5, "overlap,hierarchy,title_quality"),
    ("article", False, 0.4, "overlap"),
    ("essay", False, 0.4, "overlap,min_content"),
    ("report", True, 0.5, "overlap,hierarchy"),
    ("generic", False, 0.5, "overlap"),
)


def indicators(pages: DataFrame, outline: DataFrame, scan: int = 20) -> DataFrame:
    """doc_id, n_pages, has_contents, has_abstract, has_numbers, has_outline."""
    first = F.col("page_index") < scan
    low = F.lower("text")
    any_of = lambda c: F.max(F.when(first & c, 1).otherwise(0)) == 1
    listed = F.lit(False)
    for w in ("table of contents", "contents", "inhalt", "sommaire"):
        listed = listed | F.contains(low, F.lit(w))
    out = pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), any_of(listed).alias("has_contents"), any_of(F.contains(low, F.lit("abstract"))).alias("has_abstract"), any_of(F.regexp_like("text", F.lit("[0-9]+\\.[0-9]+"))).alias("has_numbers")
    )
    has = outline.select("doc_id").distinct().withColumn("o", F.lit(True))
    return out.join(has, "doc_id", "left").withColumn("has_outline", F.coalesce("o", F.lit(False))).drop("o")


def type_scores(ind: DataFrame) -> DataFrame:
    """ind with the additive scores of each type, and the type with the greatest, generic below 0.3; ties go by this order."""
    n = F.col("n_pages")
    yes = lambda c, x: F.when(c, x).otherwise(0.0)
    c, o, a, d = (F.col(f"has_{x}") for x in ("contents", "outline", "abstract", "numbers"))
    scores = {
        "book": yes(n > 100, 0.4) + yes(c, 0.3) + yes(o, 0.2),
        "article": yes(n < 30, 0.3) + yes(a, 0.4),
        "essay": F.when(n < 60, 0.2).otherwise(0.0),
        "report": F.when((n >= 30) & (n < 60), 0.2).otherwise(0.0) + yes(c, 0.2) + yes(o, 0.1) + yes(d, 0.3),
    }
    out = ind.select("*", *[F.round(s, 6).alias(k) for k, s in scores.items()])
    best = F.greatest(*scores)
    kind = F.when(best < 0.3, "generic")
    for k in scores:
        kind = kind.when(F.col(k) == best, k)
    return out.withColumn("type", kind)


def builder_type(ind: DataFrame) -> DataFrame:
    """The plain rule: an outline makes a book, few pages an article, anything else is generic."""
    return ind.select("doc_id", F.when(F.col("has_outline"), "book").when(F.col("n_pages") < 30, "article").otherwise("generic").alias("type"))


def profiles(spark) -> DataFrame:
    return spark.createDataFrame(PROFILES, "type string, use_contents boolean, least double, validators string")


def with_profile(types: DataFrame) -> DataFrame:
    return types.join(F.broadcast(profiles(types.sparkSession)), "type", "left")  # five rows
