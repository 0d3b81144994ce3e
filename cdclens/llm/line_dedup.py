"""Operator 1, line dedup: windows of three consecutive lines are hashed, windows seen before anywhere are found,
and the lines they cover are removed after merging overlaps.

Lines are what stands between ``\\n``.  A window is three consecutive lines that are not all blank (spaces and tabs
alone).  Its first occurrence, by doc_id (null last), then text hash, then position, stays; the lines of every later
occurrence go, each once however many windows cover it.  All decisions are made on the texts as they came in.

Plan: window rows (128-bit hash, row hash, position) -> per hash the first and the count, by partial aggregation, so a window
that a third of the documents hold is a row for each task -> hashes that occur once drop out -> join back, which
splits a hot hash's rows (nothing above the join needs them together) -> removed positions by row -> join to texts.

Defined cases: a null text stays null with 0 lines; texts of one or two lines, and empty ones, stay; equal rows (same
doc_id and text) are one document and each get its result; other columns pass through ``line_dedup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cdclens.llm import _store as S

WINDOW = 3
#: Positions (4 bytes each, and 32 a row) that may be broadcast: 8 MB.
MAX_BROADCAST = 2_000_000


def _row_keys() -> list[Column]:
    none = F.struct(F.col("doc_id").isNull(), F.col("text").isNull())
    return [F.xxhash64("doc_id", "text", none).alias("key1"), F.xxhash64(F.lit(1), "text", "doc_id", none).alias("key2")]


def removals(docs: DataFrame) -> DataFrame:
    """(key1, key2, gone): the positions, from 0, of the lines to remove, of the rows that lose any."""
    lines = docs.where(F.col("text").contains("\n")).select("doc_id", F.xxhash64("text").alias("at"), *_row_keys(), F.split("text", "\n", -1).alias("l"))
    at = lambda i, k: F.get("l", i + k)
    filled = lambda i: F.concat(*(F.trim(F.translate(at(i, k), "\t\r", "  ")) for k in range(WINDOW))) != ""
    windows = lines.where(F.size("l") >= WINDOW).select(
        "doc_id", "at", "key1", "key2",
        F.explode(F.transform(F.sequence(F.lit(0), F.size("l") - WINDOW), lambda i: F.when(filled(i), F.struct(i.alias("i"), F.xxhash64(*(at(i, k) for k in range(WINDOW))).alias("h1"), F.xxhash64(F.lit(7), *(at(i, WINDOW - 1 - k) for k in range(WINDOW))).alias("h2"))))).alias("w"),
    ).where(F.col("w").isNotNull()).select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", F.col("w.i").alias("i")).alias("place"), "key1", "key2", "w.h1", "w.h2")
    seen = windows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last")).where(F.col("first") != F.col("last")).drop("last")
    later = windows.join(seen, ["h1", "h2"]).where(F.col("place") != F.col("first"))
    covered = later.select("key1", "key2", F.explode(F.sequence(F.col("place.i"), F.col("place.i") + WINDOW - 1)).alias("line")).distinct()
    return covered.groupBy("key1", "key2").agg(F.sort_array(F.collect_list("line")).alias("gone"))


def line_dedup(docs: DataFrame, removed: str | None = None) -> DataFrame:
    """The documents with the repeated lines taken out of ``text``; ``removed`` names a column for their number."""
    *own, gone_ = S.names([*docs.columns, *([removed] if removed else [])], "key1", "key2", "gone")
    gone = S.table(removals(docs), "line-removals").select(F.col("key1").alias(own[0]), F.col("key2").alias(own[1]), F.col("gone").alias(gone_))
    # few removals go to the texts; with more, both sides are shuffled
    gone = F.broadcast(gone) if (gone.agg(F.sum(F.size(gone_) + 8)).first()[0] or 0) <= MAX_BROADCAST else gone
    keyed = docs.select("*", *(k.alias(o) for k, o in zip(_row_keys(), own))).join(gone, own, "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(gone_, i)), "\n")
    out = keyed.withColumn("text", F.when(F.col(gone_).isNull(), F.col("text")).otherwise(kept))
    if removed:
        out = out.withColumn(removed, F.coalesce(F.size(gone_), F.lit(0)).cast("long"))
    return out.select(*docs.columns, *([removed] if removed else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (kept), n_removed and the kept text of every document."""
    docs = S.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs, "n_removed")
    n = F.when(F.col("text").isNull() | ((F.col("text") == "") & (F.col("n_removed") > 0)), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1)))
    return out.select("doc_id", n.cast("long").alias("n_lines"), "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "text")


SQL = r"""
WITH d AS (SELECT doc_id, text, md5(coalesce(text, '')) AS t FROM documents),
l AS (SELECT DISTINCT doc_id, t, string_split(text, chr(10)) AS l FROM d WHERE text IS NOT NULL),
w AS (SELECT doc_id, t, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS w FROM (SELECT doc_id, t, l, unnest(range(1, len(l) - 1)) AS i FROM l WHERE len(l) >= 3)),
f AS (SELECT doc_id, t, i, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS LAST, t, i) AS nth FROM w WHERE trim(replace(replace(replace(w, chr(10), ''), chr(9), ''), chr(13), '')) <> ''),
gone AS (SELECT DISTINCT doc_id, t, unnest([i, i + 1, i + 2]) AS i FROM f WHERE nth > 1),
e AS (SELECT doc_id, t, unnest(range(1, len(l) + 1)) AS i, l FROM l),
k AS (SELECT e.doc_id, e.t, string_agg(CASE WHEN gone.i IS NULL THEN e.l[e.i] END, chr(10) ORDER BY e.i) AS text, count(*) FILTER (WHERE gone.i IS NULL) AS n_lines, count(gone.i) AS n_removed
  FROM e LEFT JOIN gone ON e.doc_id IS NOT DISTINCT FROM gone.doc_id AND e.t = gone.t AND e.i = gone.i GROUP BY e.doc_id, e.t)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS text_sha256, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM d LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.t = k.t
"""
