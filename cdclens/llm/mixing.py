"""Operator 5, mixing sources to target weights, with DataFrame functions only: pivotal dependent rounding.

A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``.  Sources, by code point and null last, weigh
1, 2, 3, repeating; they share the total size by weight, no more than ``MOST`` times their own size each, and the excess is
shared again by weight among the others.  A document of source ``s`` is due ``target(s) / size(s)`` copies: the
whole part is certain, the fraction is rounded.

Rounding pairs fractions: words (mass) move from one to the other at random, with probabilities that keep each
fraction's expectation, until one is 0 or 1; the other goes on to the next pair.  So a source's words stay what they
were but for its last document's fraction, which goes to the nearer integer.  Within a block of about ``BLOCK`` documents
this is one fold over an array, largest first: all fractions are equal there, so a document is paired with all the smaller
ones at once, whose common fraction moves, and what is left over is a small document.  Each block's one unfinished
document goes to a block of the next level, where documents pair with each other: a reduction tree whose levels shrink by ``BLOCK``.  Blocks are dealt by hash within a source, so a source with a third of
all rows is many blocks.  The draws hash the documents, so reruns agree.

Defined cases: null text and texts of white space have size 0 and are taken 0 words; repeated rows are rounded one by one;
null sources are one source; a source without words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cdclens.llm import _store as S

MOST = 3
WEIGHTS = (1, 2, 3)
BLOCK = 96
EPS = 1e-9


def size(text: str | Column) -> Column:
    """The number of runs of anything but ASCII white space."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    parts = F.split(c, r"[\x20\x09-\x0D]+")
    return F.size(F.array_remove(parts, "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size -> and target.  One row a source; the caps bind in order of ``most * size / weight``,
    so the level at which the rest share by weight is read off running sums."""
    one = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))).withColumn(
        "weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") - 1) % len(weights) + 1)
    )
    order = one.orderBy(most * F.col("source_size") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(one) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))) / (
        F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # the first in that order whose cap is not below the level sets it for all after it
    free = ranked.withColumn("level", level).withColumn("free", most * F.col("source_size") >= F.col("level") * F.col("weight"))
    free = free.withColumn("level", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return free.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("weight"), most * F.col("source_size").cast("double")), most * F.col("source_size").cast("double")).alias("target"))


def _fold(items: Column, seed: int) -> Column:
    """One pass of pivotal rounding over (id, size, p): {done: [...], left: one or null}."""
    entry = "struct<id:bigint,size:bigint,p:double>"
    state = F.struct(F.array().cast(f"array<{entry}>").alias("done"), F.lit(None).cast(entry).alias("left"))

    def put(id_: Column, size_: Column, p: Column) -> Column:
        p = _snap(p)
        return F.struct(id_.alias("id"), size_.alias("size"), p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["left"]
        up = F.least((1 - a["p"]) * a["size"], x["p"] * x["size"])  # words that may move to a
        down = F.least(a["p"] * a["size"], (1 - x["p"]) * x["size"])  # and from a
        u = F.pmod(F.xxhash64(a["id"], x["id"], F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        moved = F.when(u < down / (up + down), up).otherwise(-down)
        a2, x2 = put(a["id"], a["size"], a["p"] + moved / a["size"]), put(x["id"], x["size"], x["p"] - moved / x["size"])
        return F.when(a.isNull(), F.struct(acc["done"].alias("done"), x.alias("left"))).otherwise(_settle(acc["done"], a2, x2, entry))

    return F.aggregate(items, state, step)


def _fold_equal(items: Column, seed: int) -> Column:
    """The same result for items of equal p, by decreasing size: each is paired with all that follow it."""
    entry = "struct<id:bigint,size:bigint,p:double>"
    state = F.struct(
        F.array().cast(f"array<{entry}>").alias("done"), F.lit(None).cast(entry).alias("left"),
        F.get(items, F.lit(0))["p"].alias("p"), F.aggregate(items, F.lit(0).cast("bigint"), lambda n, e: n + e["size"]).alias("rest"),
    )

    def step(acc: Column, x: Column) -> Column:
        p, rest = acc["p"], acc["rest"] - x["size"]
        up = F.least((1 - p) * x["size"], p * rest)  # words that may move from the rest to x
        down = F.least(p * x["size"], (1 - p) * rest)
        u = F.pmod(F.xxhash64(x["id"], F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        moved = F.when(u < down / (up + down), up).otherwise(-down)
        own, theirs = _snap(p + moved / x["size"]), _snap(p - moved / F.greatest(rest, F.lit(1)))
        alone = (rest == 0) & (p > 0) & (p < 1)
        settled = (p == 0) | (p == 1)
        own = F.when(settled | alone, p).otherwise(own)
        theirs = F.when(settled | alone, p).otherwise(theirs)
        e = F.struct(x["id"].alias("id"), x["size"].alias("size"), own.alias("p"))
        whole = (own == 0) | (own == 1)
        return F.struct(
            F.when(whole, F.concat(acc["done"], F.array(e))).otherwise(acc["done"]).cast(f"array<{entry}>").alias("done"),
            F.when(whole, acc["left"]).otherwise(e).cast(entry).alias("left"), theirs.alias("p"), rest.cast("bigint").alias("rest"),
        )

    return F.aggregate(items, state, step)


def _snap(p: Column) -> Column:
    return F.when(p <= EPS, F.lit(0.0)).when(p >= 1 - EPS, F.lit(1.0)).otherwise(p)


def _settle(done: Column, a: Column, x: Column, entry: str) -> Column:
    """Of a pair after a move, what is integral joins ``done``; what is not is left."""
    pair = F.array(a, x)
    whole = F.filter(pair, lambda e: (e["p"] == 0) | (e["p"] == 1))
    rest = F.filter(pair, lambda e: (e["p"] != 0) & (e["p"] != 1))
    return F.struct(F.concat(done, whole).cast(f"array<{entry}>").alias("done"), F.get(rest, F.lit(0)).cast(entry).alias("left"))


def rounded(due: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, id, size, p in (0, 1)), sizes above 0, p equal in a source -> (source, id, up): whether each fraction became 1."""
    spark = due.sparkSession
    parts = []
    level = 0
    while True:
        counts = due.groupBy("source").count()
        widest = counts.agg(F.max("count")).first()[0]
        if not widest:
            break
        # null sources pair up too, hence <=>
        counts = counts.select(F.col("source").alias("of"), F.ceil(F.col("count") / block).alias("blocks"))
        dealt = due.join(counts, due["source"].eqNullSafe(counts["of"])).withColumn("block", F.pmod(F.xxhash64("id", F.lit(level)), F.col("blocks")))
        items = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "id", "size", "p")))
        folded = dealt.groupBy("source", "block").agg(items.alias("items"))
        folded = folded.select("source", "block", (_fold if level else _fold_equal)(F.transform("items", lambda e: F.struct(e["id"].alias("id"), e["size"].alias("size"), e["p"].alias("p"))), level).alias("f"))
        folded = S.cut(folded.select("source", "f.done", "f.left"))
        parts.append(folded.select("source", F.explode("done").alias("e")).select("source", "e.id", (F.col("e.p") == 1).alias("up")))
        due = folded.where(F.col("left").isNotNull()).select("source", "left.id", "left.size", "left.p")
        level += 1
        if widest <= block:
            parts.append(due.select("source", "id", (F.col("p") >= 0.5).alias("up")))
            break
    out = spark.createDataFrame([], T.StructType([due.schema["source"], T.StructField("id", T.LongType()), T.StructField("up", T.BooleanType())]))
    for p in parts:
        out = out.unionByName(p)
    return out


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(doc_id, id, size, source, source_size, target, copies) for each row; ``id`` hashes the row and its place among equals."""
    none = F.struct(F.col("doc_id").isNull(), F.col("text").isNull(), F.col("source").isNull())
    slim = docs.select("doc_id", "source", size("text").alias("size"), F.xxhash64("doc_id", "source", "text", none).alias("key"))
    equal = slim.groupBy("key", "doc_id", "source", "size").count()
    slim = S.cut(equal.select("doc_id", "source", "size", "key", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("nth")).withColumn("id", F.when(F.col("nth") == 1, F.col("key")).otherwise(F.xxhash64("key", "nth"))))
    shares = S.cut(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)).withColumnRenamed("source", "of")
    due = slim.join(shares, slim["source"].eqNullSafe(shares["of"])).drop("of")
    due = due.withColumn("due", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    near = F.abs(F.col("due") - F.round("due")) <= EPS
    due = due.withColumn("whole", F.when(near, F.round("due")).otherwise(F.floor("due")).cast("long")).withColumn("p", F.when(near, F.lit(0.0)).otherwise(F.col("due") - F.floor("due")))
    sized = F.col("size") > 0
    up = rounded(due.where(sized & (F.col("p") > 0)).select("source", "id", "size", "p")).where("up").select("id", F.lit(1).alias("more"))
    out = due.join(up, "id", "left")
    return out.select("doc_id", "key", "id", "size", "source", "source_size", "target", F.when(sized, F.col("whole") + F.coalesce("more", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The mixed corpus: each row as often as it is taken, with the columns of the documents, whatever their names.  Rows of equal doc_id, text and source
    stand for each other: one is taken as often as all of them together.

    Texts are not shuffled while the keys of those that are taken another number of times than most of their source are few: a source's usual number goes
    to its rows by source, and the others' by key."""
    key, of, times, n, many = S.names(docs, "key", "of", "times", "n", "many")
    none = F.struct(F.col("doc_id").isNull(), F.col("text").isNull(), F.col("source").isNull())
    taken = S.table(copies(docs, weights, most).groupBy("key", "source").agg(F.sum("copies").cast("int").alias("times"), F.count("*").alias("rows")), "mix-copies")
    usual = taken.groupBy("source", "times").agg(F.count("*").alias("k")).groupBy("source").agg(F.max_by("times", F.struct("k", "times")).alias(n))  # a row a source
    usual = S.table(usual.withColumnRenamed("source", of), "step")
    other = taken.join(S.hint(usual), F.col("source").eqNullSafe(F.col(of))).where((F.col("times") != F.col(n)) | (F.col("rows") > 1))
    other = S.table(other.select(F.col("key").alias(key), F.col("times").alias(times), (F.col("rows") > 1).alias(many)), "step")
    own, mine = S.names([*docs.columns, key, of, times, n, many], "own", "mine")
    keyed = docs.withColumn(own, F.xxhash64("doc_id", "source", "text", none)).join(S.hint(usual), F.col("source").eqNullSafe(F.col(of)), "left")
    keyed = keyed.join(S.hint(other, 2 * S.MAX_BROADCAST), F.col(own) == F.col(key), "left").withColumn(mine, F.coalesce(times, n))
    if not other.where(many).isEmpty():
        equal = F.coalesce(F.col(many), F.lit(False))
        keyed = keyed.where(~equal).unionByName(keyed.where(equal).dropDuplicates([own]))
    return keyed.where(F.col(mine) > 0).withColumn(own, F.explode(F.sequence(F.lit(1), F.col(mine)))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    docs = S.read_table(spark, sf_dir, "documents")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
