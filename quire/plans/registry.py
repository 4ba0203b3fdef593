"""The registered queries: each has a name, a function of the tables, and the SQL that DuckDB checks it with."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from quire.operators import spans, words
from quire.runtime import written
from quire.sources import layout

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, and the layout that is derived from its documents."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        """The documents; those of a few files, which may be of one row group each, are spread over the cores."""
        docs, cores = self.table("documents"), self.spark.sparkContext.defaultParallelism
        return docs if len(docs.inputFiles()) >= cores else docs.repartition(cores)

    @cached_property
    def lexicon(self) -> DataFrame:
        """The corpus' lexicon as a table: it is made once, however often a plan reads it."""
        return written(words.lexicon(self.docs), "lexicon")

    @cached_property
    def lines(self) -> DataFrame:
        return layout.lines(self.docs)

    @cached_property
    def pages(self) -> DataFrame:
        return layout.pages(self.docs)

    @cached_property
    def blocks(self) -> DataFrame:
        return layout.blocks(self.docs)

    @cached_property
    def outline(self) -> DataFrame:
        return layout.outline(self.docs)

    @cached_property
    def contents(self) -> DataFrame:
        return layout.contents_pages(self.docs)

    @cached_property
    def page_spans(self) -> DataFrame:
        return spans.page_spans(self.pages)

    @cached_property
    def texts(self) -> DataFrame:
        return spans.whole_text(self.pages)

    @cached_property
    def sections(self) -> DataFrame:
        return spans.section_spans(self.outline, self.page_spans, self.texts)

    @cached_property
    def refs(self) -> DataFrame:
        return layout.references(self.docs)

    @cached_property
    def notes(self) -> DataFrame:
        return layout.notes(self.docs)

    @cached_property
    def cites(self) -> DataFrame:
        return layout.citations(self.docs)

    @cached_property
    def degraded(self) -> DataFrame:
        return layout.degraded(self.docs)


def query(name: str, sql: str | None = None):
    """Register a function of Tables; sql may use the tables of the layout by name."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = layout.sql(sql)
        return function

    return register
