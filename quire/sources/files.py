"""Files in, tables out: formats, parsers that are plugged in, and the tables of a converted corpus as Parquet or JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.errors import ExtractionFailed, UnsupportedFormat
from quire.runtime import prepare

EXTENSIONS = {"pdf": "pdf", "epub": "epub", "md": "markdown", "markdown": "markdown", "mobi": "mobi", "azw": "mobi", "azw3": "mobi"}
#: From the bytes of a file to its pages, each with label, text and a map of metadata. None is built in for pdf.
Parser = Callable[[bytes], list[dict]]
PARSERS: dict[str, Parser] = {"markdown": lambda b: [{"label": "1", "text": b.decode("utf-8", "replace"), "metadata": {}}]}
PAGE = "path string, format string, page_index long, label string, text string, metadata map<string,string>, status string, error string"


def format_of(path: Column, head: Column) -> Column:
    """The format by the ending of a path, else by the first bytes, else null."""
    ending = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    out = None
    for e, f in EXTENSIONS.items():
        out = F.when(ending == e, f) if out is None else out.when(ending == e, f)
    return out.when(F.startswith(head, F.lit("%PDF")), "pdf")


def supported() -> list[str]:
    return sorted(PARSERS)


def register(name: str, parser: Parser) -> None:
    """Plug in a parser of one format."""
    PARSERS[name] = parser


def read(spark: SparkSession, path: str, on_error: str = "warn") -> DataFrame:
    """Pages of all files under path. A file that fails has one row with status and error; with `skip` it has none.

    With `raise` the job fails at the first one. A folder without files gives no rows.
    """
    prepare(spark)
    parsers = dict(PARSERS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", "content", format_of(F.col("path"), F.substring("content", 1, 4).cast("string")).alias("format"))

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in PAGE.split(", ")]
        for part in parts:
            rows = []
            for path, content, kind in zip(part["path"], part["content"], part["format"]):
                try:
                    if kind not in parsers:
                        raise UnsupportedFormat(f"no parser for {kind or 'this file'}")
                    rows += [(path, kind, k, p.get("label") or str(k + 1), (p.get("text") or "").strip(), p.get("metadata") or {}, "ok", None) for k, p in enumerate(parsers[kind](bytes(content)))]
                except Exception as error:
                    if on_error == "raise":
                        raise ExtractionFailed(f"{path}: {error}") from error
                    if on_error == "warn":
                        rows.append((path, kind, 0, "1", "", {}, "failed", str(error)))
            yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(run, PAGE)


#: Tables of a converted corpus; all are keyed by doc_id, and sorted by position within their files.
TABLES = ("documents", "pages", "sections", "paragraphs", "refs", "citations", "notes", "quality", "issues")


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet, sorted so that readers of one document or range skip the rest."""
    for name, df in tables.items():
        keys = [c for c in ("doc_id", "start", "position", "page_index") if c in df.columns]
        (df.sortWithinPartitions(*keys) if keys else df).write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, names: Iterable[str] = TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


JSON = (
    "doc_id bigint, version string, text string, pages array<struct<start:bigint,end:bigint,label:string,index:bigint>>, "
    "sections array<struct<start:bigint,end:bigint,title:string,level:int,confidence:double>>, paragraphs array<struct<start:bigint,end:bigint>>"
)


def to_json(texts: DataFrame, pages: DataFrame, sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """doc_id, json: one object for each document with its spans in order."""
    p = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", F.col("page_index").alias("index")))).alias("pages"))
    s = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "title", "level", F.lit(0.95).alias("confidence")))).alias("sections"))
    g = paragraphs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("paragraphs"))
    whole = texts.join(p, "doc_id", "left").join(s, "doc_id", "left").join(g, "doc_id", "left")
    return whole.select("doc_id", F.to_json(F.struct("doc_id", F.lit("1.0").alias("version"), "text", "pages", "sections", "paragraphs")).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """The objects as columns again; missing lists are empty, a broken object is a row of nulls."""
    of = rows.select(F.from_json("json", JSON).alias("o")).select("o.*")
    fill = lambda c, k: F.coalesce(c, F.array().cast(k)).alias(c)
    kinds = dict(of.dtypes)
    return of.select("doc_id", F.coalesce("version", F.lit("1.0")).alias("version"), F.coalesce("text", F.lit("")).alias("text"), *[fill(c, kinds[c]) for c in ("pages", "sections", "paragraphs")])


def save_learned(learned: DataFrame, folder: str) -> None:
    learned.write.mode("overwrite").parquet(folder)


def load_learned(spark: SparkSession, folder: str) -> DataFrame:
    """The learned words, none if there is no such table yet."""
    schema = "word string, occurrences long, confidence double, contexts string"
    try:
        return spark.read.schema(schema).parquet(folder)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def classifications(rows: DataFrame) -> DataFrame:
    """page_number, classification, confidence of review batches (json): a list, or an object that names it in one of several ways."""
    kind = "array<struct<page_number:bigint,page_num:bigint,page:bigint,classification:string,verdict:string,confidence:double>>"
    found = [F.from_json(F.col("json"), kind)] + [F.from_json(F.get_json_object("json", f"$.{k}"), kind) for k in ("pages", "classifications", "classified_pages", "reviewed_pages")]
    some = F.when(F.startswith(F.trim("json"), F.lit("[")), found[0]).otherwise(F.coalesce(*found[1:]))
    each = rows.select(*[c for c in rows.columns if c != "json"], F.explode(some).alias("p"))
    return each.select(*[c for c in rows.columns if c != "json"], F.coalesce("p.page_number", "p.page_num", "p.page").alias("page_number"), F.upper(F.coalesce("p.classification", "p.verdict")).alias("classification"), "p.confidence")
