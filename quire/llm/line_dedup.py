"""Line dedup: lines that many documents share are dropped wherever they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import prepare, written

#: A line is dropped if more documents than this hold it.
MAX_DOCS = 10
_BLANK = "[ \\t\\r\\f]+"


def _hashes(text: Column) -> Column:
    """Hash of every normalised line, in order: lower case, white space squeezed and stripped; a blank line has null."""
    lines = F.split(F.regexp_replace(F.lower(text), _BLANK, " "), "\n", -1)
    return F.transform(lines, lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def _cut(docs: DataFrame, max_docs: int) -> DataFrame:
    """row (all columns of docs), was (the number of its text's lines) and kept (those of them that stay)."""
    prepare(docs.sparkSession)
    # rows without doc_id are told apart by their text, so that they don't all meet at one key
    key = [F.col("doc_id").alias("id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("other")]
    held = docs.select(*key, F.explode(F.array_distinct(F.array_compact(_hashes(F.col("text"))))).alias("line"))
    held = written(held, "lines")
    common = held.groupBy("line").agg(F.count_distinct("id").alias("n")).where(F.col("n") > max_docs).select("line")
    drops = held.join(common, "line", "left_semi").groupBy("id", "other").agg(F.collect_set("line").alias("drop"))
    # one small row for each document: the text crosses the network once and isn't sorted
    own = docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    both = own.join(drops.hint("shuffle_hash"), own.id.eqNullSafe(drops.id) & own.other.eqNullSafe(drops.other), "left")
    text = F.col("row.text")
    hashes = F.when(F.col("drop").isNotNull(), _hashes(text))
    both = both.select("row", "drop", F.split(text, "\n", -1).alias("lines"), hashes.alias("hashes"))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x, i: ~F.coalesce(F.array_contains("drop", F.get("hashes", i)), F.lit(False)))
    )
    return both.select("row", F.coalesce(F.size("lines"), F.lit(0)).alias("was"), kept.alias("kept"))


def cut_common_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Every row of docs with its columns, text without the common lines; all rules are those of `drop_common_lines`."""
    return _cut(docs, max_docs).select(*[F.array_join("kept", "\n").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_common_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Every row of docs with its columns, text without the lines that more than `max_docs` documents hold, n_lines and n_dropped.

    Documents are counted by distinct doc_id, so a line that is repeated in one document or in repeated rows counts once;
    rows without doc_id aren't counted, but lose common lines as well. Blank lines are never dropped. A null text stays
    null with 0 lines; an empty one has one blank line. Very long texts are cut like others. Lines are compared by hashes of 64 bits, which
    aren't verified: two given lines have one hash with a probability of 2**-64, so among 10**12 different lines some 30,000 pairs do.
    A column of docs that is named n_lines or n_dropped is replaced. An empty table gives no rows.
    """
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.col("was"))
    n_dropped = F.when(F.col("row.text").isNull(), 0).otherwise(F.col("was") - F.size("kept"))
    rest = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return _cut(docs, max_docs).select(*rest, F.array_join("kept", "\n").alias("text"), n_lines.cast("int").alias("n_lines"), n_dropped.cast("int").alias("n_dropped"))
