"""Operator 4, benchmark decontamination, with DataFrame functions only.

Texts have A-Z lower-cased; words are runs of digits, letters and bytes above 7F.  A benchmark item's windows are
its runs of 10 consecutive words; an item of fewer, but not none, is one window.  A document word inside any
occurrence of a window is hit.

A document is not asked for every 10-gram.  Any window of ``n`` words that occurs in it covers one of the document's
``g``-grams at a position divisible by ``n - g + 1`` (``g = min(n, 5)``), so only those are hashed and looked up
in the broadcast hash set of *all* the benchmark's ``g``-grams; each goes along with the words around it, and a hit is
verified by comparing those words with the item's, which gives every window that covers it.  Windows of fewer words
(short items) have a set of their own for each length, at most nine.

The benchmark's grams are broadcast only if their count is at most ``MAX_BROADCAST``; with more, Spark joins by
shuffling both sides.  Hits are counted as (document, position) rows, so nothing gathers more than one
document's hits, and a passage that a third of the documents hold adds rows to each of them only.

Defined cases: null and empty texts have no words; repeated rows (same doc_id and text) each get the same result; null doc_ids
are kept; benchmark items without words never occur; other columns pass through ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cdclens.llm import _store as S

N = 10
GRAM = 5
#: Rows of the benchmark's grams that may be broadcast (about 250 bytes each, so 100 MB).
MAX_BROADCAST = 400_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    """The array of a text's words."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # lower() is several times as fast as translate() and the same for ASCII texts; it would change letters beyond A-Z in others
    c = F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))
    return F.array_remove(F.split(c, NOT_WORD), "")


def _padded(w: Column, pad: str, n: int) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), n), w, F.array_repeat(F.lit(pad), n))


def _grams(n: int, g: int, step: int) -> Column:
    """(at, key, around) from ``w`` and ``p``, the words and the padded words: the g-grams at each step-th position,
    with the n - g words before and after.  Elements are taken one by one: slice() would copy the whole array each time."""
    reach = n - g
    return F.when(
        F.size("w") >= g,
        F.transform(
            F.sequence(F.lit(0), F.size("w") - g, F.lit(step)),
            lambda i: F.struct(
                i.alias("at"),
                F.xxhash64(*(F.get("w", i + k) for k in range(g))).alias("key"),
                F.array(*(F.get("p", i + k) for k in range(g + 2 * reach))).alias("around"),
            ),
        ),
    )


def _hits(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(key1, key2, start, item_id): occurrences of the items' windows of n words."""
    g = min(n, GRAM)
    reach = n - g
    grams = items.withColumn("p", _padded(F.col("w"), "\x01", reach)).select("item_id", F.explode(_grams(n, g, 1)).alias("t")).select("item_id", "t.key", F.col("t.around").alias("theirs"))
    grams = S.hint(grams, MAX_BROADCAST)
    ours = docs.withColumn("p", _padded(F.col("w"), "\x02", reach)).select("key1", "key2", F.explode(_grams(n, g, reach + 1)).alias("t"))
    found = ours.select("key1", "key2", "t.at", "t.key", F.col("t.around").alias("ours")).join(grams, "key").where(F.slice("ours", reach + 1, g) == F.slice("theirs", reach + 1, g))
    starts = F.filter(F.sequence(F.lit(0), F.lit(reach)), lambda s: F.slice("ours", s + 1, F.lit(n)) == F.slice("theirs", s + 1, F.lit(n)))
    return found.select("key1", "key2", "item_id", F.explode(F.transform(starts, lambda s: F.col("at") - reach + s)).alias("start")).withColumn("n", F.lit(n))


def occurrences(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(key1, key2, item_id, start, n) of every window that occurs in a document; the keys are ``_keys`` of its row."""
    items = S.table(benchmark.select("item_id", words("text").alias("w")).where(F.size("w") > 0), "benchmark-words")
    lengths = sorted(r[0] for r in items.select(F.least(F.size("w"), F.lit(n)).alias("n")).distinct().collect())
    texts = docs.select(*_keys(docs), words("text").alias("w"))
    out = None
    for k in lengths:
        part = _hits(texts, items.where(F.size("w") >= n if k == n else F.size("w") == k), k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "key1 long, key2 long, item_id long, start int, n int")
    return out


def _keys(docs: DataFrame) -> list[Column]:
    """A row's two hashes of doc_id and text: 128 bits that name it, nulls included."""
    none = F.struct(F.col("doc_id").isNull(), F.col("text").isNull())
    return [F.xxhash64("doc_id", "text", none).alias("key1"), F.xxhash64(F.lit(1), "text", "doc_id", none).alias("key2")]


def report(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(key1, key2, n_hit, n_items, items_sha256) of the documents with a hit."""
    hits = S.cut(occurrences(docs, benchmark, n))  # few rows, read twice
    positions = (
        hits.select("key1", "key2", "start", "n").distinct()
        .select("key1", "key2", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at")).distinct()
        .groupBy("key1", "key2").agg(F.count("*").alias("n_hit"))
    )
    items = (
        hits.select("key1", "key2", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("key1", "key2").agg(F.sort_array(F.collect_list("item")).alias("items"))
        .select("key1", "key2", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    )
    return positions.join(items, ["key1", "key2"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", n: int = N) -> DataFrame:
    """The documents without those that hold a window (``document``), or with hit words taken out of ``text`` (``span``): of each
    run of hit words, the words and what stands between them go; what stands before the first and after the last stays.
    Columns, whatever their names, and other rows stay as they are.  Keys of what is hit go to the texts while they are few."""
    *own, at_ = S.names(docs, "key1", "key2", "at")
    keyed = docs.select("*", *(k.alias(o) for k, o in zip(_keys(docs), own)))
    hits = occurrences(docs, benchmark, n)
    named = [F.col(k).alias(o) for k, o in zip(("key1", "key2"), own)]
    if mode == "document":
        bad = S.table(hits.select(*named).distinct(), "benchmark-hits")
        return keyed.join(S.hint(bad), own, "left_anti").drop(*own)
    at = hits.select(*named, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias(at_)).distinct().groupBy(*own).agg(F.collect_set(at_).alias(at_))
    at = S.table(at, "benchmark-hits")
    few = (at.agg(F.sum(F.size(at_) + 4)).first()[0] or 0) <= S.MAX_BROADCAST
    text = F.col("text")
    letters = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # a word before A-Z are lower-cased
    kept, between = F.regexp_extract_all(text, F.lit(f"({letters})"), F.lit(1)), F.split(text, letters)
    hit = lambda i: F.array_contains(at_, i)
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(kept) - 1),
        lambda i: F.concat(F.when(hit(i) & hit(i - 1), F.lit("")).otherwise(F.get(between, i)), F.when(hit(i), F.lit("")).otherwise(F.get(kept, i))),
    )
    cleaned = F.concat(F.array_join(pieces, ""), F.get(between, F.size(kept)))
    return keyed.join(F.broadcast(at) if few else at, own, "left").withColumn("text", F.when(F.col(at_).isNull(), text).otherwise(cleaned)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    docs, benchmark = (S.read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    docs = docs.select("doc_id", "text")
    found = report(docs, benchmark)
    return (
        docs.select("doc_id", *_keys(docs), F.size(words("text")).cast("long").alias("n_words"))
        .join(found, ["key1", "key2"], "left")
        .select(
            "doc_id", "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


SQL = r"""
WITH w AS (
  SELECT doc_id, md5(coalesce(text, '')) AS t, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, t, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, t, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT DISTINCT doc_id, t, w FROM w) CROSS JOIN lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, t, i, dw.n, item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
pos AS (SELECT doc_id, t, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, t, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id, t),
its AS (SELECT doc_id, t, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256 FROM (SELECT DISTINCT doc_id, t, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id, t)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos ON w.doc_id IS NOT DISTINCT FROM pos.doc_id AND w.t = pos.t LEFT JOIN its ON w.doc_id IS NOT DISTINCT FROM its.doc_id AND w.t = its.t
"""
