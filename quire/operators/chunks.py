"""Chunks for retrieval: by page, section, fixed size or packed paragraphs, with what each chunk cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import spans

CHARS_PER_TOKEN, MAX_TOKENS, OVERLAP = 4, 512, 50


def fixed_size(texts: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_index, chunk_id, start, end, text. The number of chunks has a closed form, so each row is cut in place."""
    size = max_tokens * CHARS_PER_TOKEN
    if not 0 <= overlap < size:
        raise ValueError("overlap has to be less than the chunk's characters")
    n, step = F.length("text"), size - overlap
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    cut = texts.where(n > 0).select("doc_id", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    end = F.least(start + size, F.col("n"))
    return cut.select(
        "doc_id", "chunk_index", F.concat(F.lit("chunk_"), F.col("chunk_index")).alias("chunk_id"), start.cast("long").alias("start"), end.cast("long").alias("end"), spans.text_range(F.col("text"), start, end).alias("text")
    )


def by_page(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, chunk_index, chunk_id, start, end, text of each page's span."""
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index")) - 1
    placed = pages.select("doc_id", index.alias("chunk_index"), F.concat(F.lit("page_"), "label").alias("chunk_id"), "start", "end")
    return placed.join(texts.select("doc_id", F.col("text").alias("_t")), "doc_id").withColumn("text", spans.text_range(F.col("_t"), F.col("start"), F.col("end"))).drop("_t")


def by_section(sections: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, chunk_index, chunk_id, start, end, text of each section."""
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "seq")) - 1
    name = F.replace(F.substring("title", 1, 20), F.lit(" "), F.lit("_"))
    placed = sections.select("doc_id", index.alias("chunk_index"), F.concat(F.lit("section_"), index, F.lit("_"), name).alias("chunk_id"), "start", "end")
    return placed.join(texts.select("doc_id", F.col("text").alias("_t")), "doc_id").withColumn("text", spans.text_range(F.col("_t"), F.col("start"), F.col("end"))).drop("_t")


def semantic(texts: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_index, chunk_id, start, end, text: paragraphs are packed until the next one would pass the limit.

    A chunk after the first starts with the last `overlap` characters before its paragraph. A fold over each text's own
    paragraphs, so there is no shuffle; texts without paragraphs are cut in fixed sizes.
    """
    limit = max_tokens * CHARS_PER_TOKEN
    zero = F.struct(F.array().cast("array<struct<start:bigint,end:bigint,text:string>>").alias("out"), F.lit("").alias("text"), F.lit(0).cast("long").alias("start"))

    def add(acc: Column, p: Column) -> Column:
        full = (F.length(acc["text"]) + F.length(p["text"]) > limit) & (acc["text"] != "")
        back = F.greatest(p["start"] - overlap, F.lit(0).cast("long"))
        done = F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), p["start"].alias("end"), acc["text"].alias("text"))))
        before = F.when(full, spans.text_range(F.col("text"), back, p["start"])).otherwise(acc["text"])
        return F.struct(F.when(full, done).otherwise(acc["out"]).alias("out"), F.concat(before, p["text"]).alias("text"), F.when(full, back).otherwise(acc["start"]).alias("start"))

    def close(acc: Column) -> Column:
        return F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), F.length("text").cast("long").alias("end"), acc["text"].alias("text"))))

    has = F.regexp_like("text", F.lit("[^\\n]"))
    packed = texts.where(has).select("doc_id", F.posexplode(F.aggregate(spans.paragraph_array(F.col("text")), zero, add, close)).alias("chunk_index", "c"))
    packed = packed.select("doc_id", "chunk_index", F.concat(F.lit("chunk_"), F.col("chunk_index")).alias("chunk_id"), "c.start", "c.end", "c.text")
    return packed.unionByName(fixed_size(texts.where(~has), max_tokens, overlap))


def enriched(chunks: DataFrame, pages: DataFrame, sections: DataFrame, refs: DataFrame, cites: DataFrame) -> DataFrame:
    """Chunks with their page labels, primary section, references, citations and neighbours."""
    ranges = chunks.select("doc_id", "chunk_index", F.col("start").alias("from_pos"), F.col("end").alias("to_pos"))
    key = ["doc_id", "chunk_index"]

    def listed(found: DataFrame, order: str, value: str, name: str) -> DataFrame:
        items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x.v)
        return found.groupBy(*key).agg(F.array_join(items, ",").alias(name))

    on = listed(spans.in_range(ranges, pages.select("doc_id", "page_index", "label", "start", "end")), "page_index", "label", "page_labels")
    section = spans.section_for_range(ranges, sections, key).select(*key, F.col("title").alias("section"))
    note = listed(spans.refs_in_range(ranges, refs), "position", "target_id", "footnote_refs")
    cite = listed(spans.in_range(ranges, cites.select("doc_id", "start", "end", F.col("text").alias("cited"))), "start", "cited", "citations")
    by = Window.partitionBy("doc_id").orderBy("chunk_index")
    out = chunks.withColumn("prev_chunk_id", F.lag("chunk_id").over(by)).withColumn("next_chunk_id", F.lead("chunk_id").over(by))
    for more in (on, section, note, cite):
        out = out.join(more, key, "left")
    return out


def citation(author: Column, title: Column, labels: Column) -> Column:
    """'author, title, p. a-b'; the author only with a title, '?' without pages; labels is one string divided by commas."""
    where = F.coalesce(F.nullif(F.replace(labels, F.lit(","), F.lit("-")), F.lit("")), F.lit("?"))
    named = title.isNotNull() & (title != "")
    return F.concat_ws(", ", F.when(named, F.nullif(author, F.lit(""))), F.when(named, title), F.concat(F.lit("p. "), where))


def to_chunks(strategy: str, texts: DataFrame, pages: DataFrame, sections: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks by one of the strategies page, section, semantic and fixed."""
    if strategy == "page":
        return by_page(pages, texts)
    if strategy == "section":
        return by_section(sections, texts)
    if strategy == "semantic":
        return semantic(texts, max_tokens, overlap)
    if strategy == "fixed":
        return fixed_size(texts, max_tokens, overlap)
    raise ValueError(f"no strategy {strategy!r}")
