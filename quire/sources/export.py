"""Documents out: Markdown, plain text, the tree of contents, and where a scan came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTES = "\n".join(["", "", "---", "", "## Notes", ""])
MARKERS = {"comment": ("\n<!-- p. ", " -->\n"), "heading": ("\n## [p. ", "]\n"), "inline": (" [p. ", "] ")}


def markdown(texts: DataFrame, pages: DataFrame, notes: DataFrame, page_markers: str | None = None, footnotes: bool = True, compat: bool = False) -> DataFrame:
    """doc_id, markdown. texts has title and author; frontmatter's lines run together in the `compat` form."""
    out = texts
    body = F.col("text")
    if page_markers is not None:
        before, after = MARKERS[page_markers]
        p = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "label"))).alias("_p"))
        out = out.join(p, "doc_id", "left")
        until = lambda i: F.coalesce(F.get("_p", i + 1)["start"], F.length("text").cast("long"))
        piece = lambda x, i: F.concat(F.lit(before), x["label"], F.lit(after), F.substring(F.col("text"), x["start"].cast("int") + 1, (until(i) - x["start"]).cast("int")))
        lead = F.substring(F.col("text"), F.lit(1), F.get("_p", F.lit(0))["start"].cast("int"))
        body = F.when(F.col("_p").isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(F.transform("_p", piece), "")))
    end = F.lit("" if compat else "\n")
    author = F.when(F.coalesce("author", F.lit("")) != "", F.concat(F.lit("author: "), "author", end)).otherwise("")
    head = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("---"), end, F.lit("title: "), "title", end, author, F.lit("---"), end, end)).otherwise("")
    tail = F.lit("")
    if footnotes:
        n = notes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("note_id", F.col("text").alias("note")))).alias("_n"))
        out = out.join(n, "doc_id", "left")
        line = lambda x: F.concat(F.lit("\n[^"), F.regexp_replace(x["note_id"], "fn|en" if compat else "^(fn|en)", ""), F.lit("]: "), x["note"], F.lit("\n"))
        tail = F.when(F.col("_n").isNull(), "").otherwise(F.concat(F.lit(NOTES), F.array_join(F.transform("_n", line), "")))
    return out.select("doc_id", F.concat(head, body, tail).alias("markdown"))


def contents_tree(outline: DataFrame) -> DataFrame:
    """doc_id, seq, level, title, parent: the nearest entry before that is higher up, found in each document's own array."""
    all_ = outline.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "level", "title"))).alias("e"))
    parent = lambda x: F.array_max(F.transform(F.filter("e", lambda y: (y["seq"] < x["seq"]) & (y["level"] < x["level"])), lambda y: y["seq"]))
    with_parent = F.transform("e", lambda x: F.struct(x["seq"].alias("seq"), x["level"].alias("level"), x["title"].alias("title"), parent(x).alias("parent")))
    return all_.select("doc_id", F.explode(with_parent).alias("x")).select("doc_id", "x.*")


def contents_paths(tree: DataFrame) -> DataFrame:
    """doc_id, seq, depth, path of every entry, from the top down."""
    return tree.sparkSession.sql(
        """WITH RECURSIVE p AS (
             SELECT doc_id, seq, 0 AS depth, CAST(seq AS STRING) AS path FROM {tree} WHERE parent IS NULL
             UNION ALL SELECT t.doc_id, t.seq, p.depth + 1, concat(p.path, '/', t.seq) FROM p JOIN {tree} t ON t.doc_id = p.doc_id AND t.parent = p.seq)
           SELECT * FROM p""",
        tree=tree,
    )


def scan_source(producer: Column, creator: Column) -> tuple[Column, Column, Column]:
    """Engine, version and confidence by what a file's metadata say of its maker."""
    p, c = F.coalesce(producer, F.lit("")), F.coalesce(creator, F.lit(""))
    either = lambda word: F.contains(p, F.lit(word)) | F.contains(c, F.lit(word))
    low = F.lower(p)
    capture, abbyy, tesseract = F.contains(p, F.lit("Paper Capture")), either("ABBYY"), either("Tesseract")
    other = F.contains(low, F.lit("scan")) | F.contains(low, F.lit("ocr")) | F.contains(low, F.lit("capture"))
    engine = F.when(capture, "adobe_paper_capture").when(abbyy, "abbyy_finereader").when(tesseract, "tesseract").when(other, "unknown_ocr").otherwise("unknown")

    def after(word: str) -> Column:
        of = lambda x: F.regexp_extract(x, f"{word}[ \\t]+([^ \\t]+)", 1)
        return F.when(F.contains(c, F.lit(word)), of(c)).otherwise(of(p))

    adobe = F.when(F.contains(p, F.lit("Acrobat")), F.trim(F.replace(F.regexp_extract(p, "^(.*?)Paper Capture", 1), F.lit("Adobe "), F.lit("")))).otherwise("")
    version = F.when(capture, adobe).when(abbyy, after("FineReader")).when(tesseract, after("Tesseract")).otherwise("")
    sure = F.when(capture | abbyy, 0.95).when(tesseract, 0.9).when(other, 0.5).otherwise(0.0)
    return engine, version, sure
