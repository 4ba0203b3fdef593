"""Positions and spans of a text: running page offsets, paragraphs, and the joins that look spans up.

Spans are half-open and always joined on doc_id first, so that each lookup is an equi-join with a residual range, never a
nested loop over all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = 2  # characters between two pages of the whole text


def contains(start: Column, end: Column, position: Column) -> Column:
    return (start <= position) & (position < end)


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start < other_end) & (other_start < end)


def text_range(text: Column, start: Column, end: Column) -> Column:
    """text[start:end]."""
    return F.substring(text, start.cast("int") + 1, (end - start).cast("int"))


def page_spans(pages: DataFrame, skip_empty: bool = False) -> DataFrame:
    """doc_id, page_index, label, start, end in the whole text. An empty page still takes GAP characters; it can be left out."""
    before = Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    n = F.length("text").cast("long")
    start = F.coalesce(F.sum(n + GAP).over(before), F.lit(0).cast("long"))
    placed = pages.select("doc_id", "page_index", F.coalesce(F.nullif(F.col("label"), F.lit("")), (F.col("page_index") + 1).cast("string")).alias("label"), start.alias("start"), (start + n).alias("end"))
    return placed.where(F.col("start") < F.col("end")) if skip_empty else placed


def whole_text(pages: DataFrame, first: int | None = None) -> DataFrame:
    """doc_id, text: the pages that have text, or those of the first ones, with a blank line between."""
    some = pages if first is None else pages.where(F.col("page_index") < first)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_index", "text"))), lambda p: p.text)
    return some.groupBy("doc_id").agg(F.array_join(F.filter(ordered, lambda t: t != ""), "\n\n").alias("text"))


def paragraph_array(text: Column) -> Column:
    """start, end and text of what blank lines part, as an array: a fold over the parts and the gaps between them."""
    parts = F.split(text, "\\n\\n+", -1)
    gaps = F.transform(F.regexp_extract_all(text, F.lit("\\n\\n+"), F.lit(0)), F.length)
    sizes = F.zip_with(F.transform(parts, F.length), gaps, lambda a, b: a + F.coalesce(b, F.lit(0)))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,text:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        here = F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x["part"])).alias("end"), x["part"].alias("text")))
        return F.struct((acc["at"] + x["step"]).alias("at"), F.when(x["part"] == "", acc["out"]).otherwise(F.concat(acc["out"], here)).alias("out"))

    return F.aggregate(F.arrays_zip(parts.alias("part"), sizes.alias("step")), zero, add, lambda acc: acc["out"])


def paragraph_spans(texts: DataFrame) -> DataFrame:
    """doc_id, seq, start, end, text of what blank lines part; a row's text is cut in place, without a shuffle."""
    cut = texts.select("doc_id", F.posexplode(paragraph_array(F.col("text"))).alias("seq", "p"))
    return cut.select("doc_id", F.col("seq").cast("long").alias("seq"), "p.start", "p.end", "p.text")


def section_spans(outline: DataFrame, pages: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, seq, level, title, start, end: a section ends where the next one starts, the last one with the text."""
    end = F.lead("start").over(Window.partitionBy("doc_id").orderBy("start", "seq"))
    placed = outline.join(pages.select("doc_id", "page_index", "start"), ["doc_id", "page_index"])
    placed = placed.select("doc_id", "seq", "level", "title", "start", end.alias("next"))
    return placed.join(texts.select("doc_id", F.length("text").cast("long").alias("n")), "doc_id").select("doc_id", "seq", "level", "title", "start", F.coalesce("next", "n").alias("end"))


def _first(joined: DataFrame, key: list[str], *order: Column) -> DataFrame:
    return joined.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def _at(points: DataFrame, spans: DataFrame) -> DataFrame:
    s = spans.withColumnRenamed("doc_id", "_doc")
    return points.join(s, (points.doc_id == s._doc) & contains(s.start, s.end, points.position)).drop("_doc")


def page_for_position(points: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """The first page that holds each point (doc_id, position); points on no page have no row."""
    return _first(_at(points, pages.select("doc_id", "page_index", "label", "start", "end")), key, F.col("page_index"))


def position_to_page(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """wanted (doc_id, page_index) with the start of that page, 0 if there is none."""
    return wanted.join(pages.select("doc_id", "page_index", "start"), ["doc_id", "page_index"], "left").withColumn("start", F.coalesce("start", F.lit(0).cast("long")))


def section_for_position(points: DataFrame, sections: DataFrame, key: list[str]) -> DataFrame:
    """The deepest section that holds each point, the first of equally deep ones."""
    return _first(_at(points, sections), key, F.desc("level"), F.col("seq"))


def in_range(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """All spans that overlap each range (doc_id, from_pos, to_pos, ...)."""
    s = spans.withColumnRenamed("doc_id", "_doc")
    return ranges.join(s, (ranges.doc_id == s._doc) & overlaps(s.start, s.end, ranges.from_pos, ranges.to_pos)).drop("_doc")


def section_for_range(ranges: DataFrame, sections: DataFrame, key: list[str]) -> DataFrame:
    """The shallowest section that overlaps each range."""
    return _first(in_range(ranges, sections), key, F.col("level"), F.col("seq"))


def refs_in_range(ranges: DataFrame, refs: DataFrame) -> DataFrame:
    r = refs.withColumnRenamed("doc_id", "_doc")
    return ranges.join(r, (ranges.doc_id == r._doc) & contains(ranges.from_pos, ranges.to_pos, r.position)).drop("_doc")


def footnotes_in_range(ranges: DataFrame, refs: DataFrame, notes: DataFrame) -> DataFrame:
    """References in each range with their notes; those without a note are left out."""
    n = notes.select(F.col("doc_id").alias("_doc"), "note_id", F.col("text").alias("note"))
    found = refs_in_range(ranges, refs)
    return found.join(n, (found.doc_id == n._doc) & (found.target_id == n.note_id)).drop("_doc")


def annotations_in_range(ranges: DataFrame, points: dict[str, DataFrame], spans: dict[str, DataFrame]) -> DataFrame:
    """kind, start, end of point and span annotations in each range, in one table."""
    out = [refs_in_range(ranges, p).select(*ranges.columns, F.lit(kind).alias("kind"), F.col("position").alias("start"), F.col("position").alias("end")) for kind, p in points.items()]
    out += [in_range(ranges, s).select(*ranges.columns, F.lit(kind).alias("kind"), "start", "end") for kind, s in spans.items()]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def ordered(spans: DataFrame, value: str, order: str = "start", sep: str = " | ") -> DataFrame:
    """doc_id, items: a column of the spans in order, as one string."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x.v)
    return spans.groupBy("doc_id").agg(F.array_join(items, sep).alias("items"))
