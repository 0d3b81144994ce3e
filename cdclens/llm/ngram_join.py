"""Operator 9, n-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document's set is its distinct 4-word shingles (as 64-bit hashes); two documents link when 100 * intersection
>= 85 * union.  Equal sets are one class; classes are joined, and the result is each document's class, set size and
component.  No link between classes is lost:

1.  *Keys.*  With J >= t, sets of size n differ in at most d(n) = n (1 - t) / t shingles.  Shingles are hashed to
    ``m`` segments, ``m`` fixed for a band of sizes; a difference spoils one segment, so of a set's first
    ``d(n) + 1`` non-empty segments at least one is the same in its partner, which sends that one too (it sends the same
    indices at least as far, or the argument holds the other way round).  A key is a whole segment's content, about five
    shingles, so a passage or phrase that many documents share makes hardly any keys.  Sets near a band's upper edge
    also send the next band's keys.
2.  *Clusters.*  Classes with a key in common form clusters: each links to the smallest class on the key, then components.
    No pairs are formed here, whatever the number of classes on a key; a key that
    very many classes have is a row for each batch of documents, and those rows go to one task, which streams them.
3.  *Tiles.*  A small cluster is one tile.  A large one's classes are dealt to blocks of about ``BLOCK`` by size.  First each
    block is a tile by itself, to which ``ANCHORS`` classes of its own and of the next sizes are added: where a cluster is one group of near copies, that
    links nearly all of it, at a cost in proportion to its classes.  Then blocks are dealt anew, those of one label (what is
    linked so far) apart from the rest, and a tile is a pair of blocks whose sizes are within the band and that aren't of the same label: so nothing that is
    joined is compared again, and no pair that is not is left out.  In a tile, bit counts of hashed bitmaps bound each pair's
    intersection from above; pairs that may pass are counted exactly by intersecting sorted arrays.  A tile
    gives a spanning forest of its exact links, so a group of k copies gives k - 1 of them rather than k (k - 1) / 2.
4.  *Components* of those links, over classes, carried to the documents.

Texts are read twice: for keys, and again for the classes in clusters alone (one document a class).

Defined cases: null and empty texts and such without words have an empty set, link with nothing and are their
own component; fewer than 4 words are one shingle; equal rows are one document; a doc_id with several texts is
as many documents whose component ids may be equal; a null doc_id sorts last, as its component's id only if all are null.
"""

from __future__ import annotations

from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cdclens.llm import _store as S
from cdclens.llm import _vec as V
from cdclens.llm.components import components

SHINGLE = 4
PERCENT = 85
#: A block holds about so many classes, and shingles, at most.
BLOCK = 512
BLOCK_SHINGLES = 1_000_000
#: Other hashings for small sets that lie in too few segments.
TRIES = 8
#: Bits of a signature.
BITS = 1024
#: Classes of each size step of a large cluster that its blocks are held against first.
ANCHORS = 8
_U = np.uint64


def _sets(batch: pa.Array, n: int):
    """(document's place, sorted distinct shingle hashes) for each document."""
    for a, b, h, off in V.documents(batch):
        for k in range(b - a):
            yield a + k, np.unique(V.shingles(h[off[k] : off[k + 1]], n))


def band(n: int) -> int:
    """Sizes from 2**i up to below 2**(i+1) are band i."""
    return n.bit_length() - 1


def segments(i: int, percent: int) -> int:
    """Segments of band i: two fifths more than its largest sets can differ in."""
    return max(1, floor(1.4 * ((1 << (i + 1)) - 1) * (100 - percent) / percent) + 1)


def keys(s: np.ndarray, percent: int) -> np.ndarray:
    """A set's keys: hashes of (band, segment, content).

    A set with fewer than ``d + 1`` non-empty segments sends all it has.  That misses only partners with which it shares empty
    ones alone, so of which the same holds; both then also send the keys of another hashing, and so on.  Sets short of segments in ``TRIES`` hashings
    (never seen: one in a hundred of seven shingles is short in one) send all segments of a last one, the empty too, of which any two have an equal one.
    """
    n = len(s)
    d = n * (100 - percent) // percent
    if d == 0:  # no other set is near enough
        return np.zeros(0, dtype=_U)
    i = band(n)
    out = []
    for j in [i] + ([i + 1] if n * 100 >= percent * (1 << (i + 1)) else []):
        m = segments(j, percent)
        for turn in range(TRIES + 1):
            r = np.sort(V.mix(s ^ _U(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))) if turn else s
            at = ((r >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)  # ascending, as r is
            cut = np.flatnonzero(np.diff(at)) + 1
            total = np.append(_U(0), np.cumsum(V.mix(r)))
            starts, ends = np.append(0, cut), np.append(cut, n)
            place, content = at[starts], total[ends] - total[starts]
            short = len(place) <= d
            if short and turn == TRIES:
                every = np.zeros(m, dtype=_U)
                every[place] = content
                place, content = np.arange(m), every
            elif not short:  # the segments of most shingles
                most = np.lexsort((place, starts - ends))[: d + 1]
                place, content = place[most], content[most]
            out.append(V.mix(content + place.astype(_U) * _U(0x9E3779B97F4A7C15) + _U((j * 64 + turn) * 2654435761)))
            if not short:
                break
    return np.concatenate(out)


def _signature(s: np.ndarray) -> int:
    return int(V.mix(s).sum(dtype=_U) ^ _U(len(s))) if len(s) else 0


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values.view(np.int64)))


def _first_pass(n: int, percent: int):
    """A batch's rows with size, class, keys and links.  A key that several rows of the batch have stays with the first,
    to which the others link, so a key that very many documents have leaves a batch once."""

    def of(batches):
        for batch in batches:
            size, sig, key = [], [], []
            for _, s in _sets(batch.column("text"), n):
                size.append(len(s))
                sig.append(_signature(s))
                key.append(keys(s, percent) if len(s) else s)
            sig = np.array(sig, dtype=_U)
            counts = np.array([len(k) for k in key], dtype=np.int64)
            flat = np.concatenate(key) if key else np.zeros(0, dtype=_U)
            doc = np.repeat(np.arange(len(key)), counts)
            order = np.argsort(flat, kind="stable")
            head = np.ones(len(flat), dtype=bool)
            head[1:] = flat[order][1:] != flat[order][:-1]
            first = doc[order][np.maximum.accumulate(np.where(head, np.arange(len(flat)), 0))]
            linked = np.unique(np.stack([doc[order], first])[:, sig[doc[order]] != sig[first]], axis=1)
            keep = np.zeros(len(flat), dtype=bool)
            keep[order[head]] = True
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("doc_id"), pa.array(size, pa.int32()), pa.array(sig.view(np.int64)),
                    _lists(flat[keep], np.bincount(doc[keep], minlength=len(key))), _lists(sig[linked[1]], np.bincount(linked[0], minlength=len(key))),
                ],
                names=["id", "doc_id", "n", "class", "keys", "links"],
            )

    return of


def _second_pass(n: int):
    def of(batches):
        for batch in batches:
            sets = [s for _, s in _sets(batch.column("text"), n)]
            sig = np.array([_signature(s) for s in sets], dtype=_U)
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "n", "set"])

    return of


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), BITS), dtype=np.uint8)
    for k, s in enumerate(sets):
        out[k, (V.mix(s ^ _U(0x5DEECE66D)) % _U(BITS)).astype(np.int64)] = 1
    return np.packbits(out, axis=1).view(_U)


def tile_links(left: list[np.ndarray], right: list[np.ndarray], percent: int, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the exact links among ``left`` (``right`` empty) or between the two sides, of what has not the
    same label yet; places count on from left to right."""
    sets = left + right
    n = np.array([len(s) for s in sets], dtype=np.int64)
    bits = bitmaps(sets)
    label = np.arange(len(sets)) if labels is None else np.unique(np.array(labels, dtype=np.int64), return_inverse=True)[1]
    forest: list[tuple[int, int]] = []
    for a in range(len(left)):
        other = np.arange(len(left), len(sets)) if right else np.arange(a + 1, len(sets))
        other = other[label[other] != label[a]]  # what is joined already needs no test
        other = other[100 * np.minimum(n[a], n[other]) >= percent * np.maximum(n[a], n[other])]
        # a bit that one side alone has is a shingle outside the intersection
        most = np.minimum(n[a] - np.bitwise_count(bits[a] & ~bits[other]).sum(axis=1), n[other] - np.bitwise_count(bits[other] & ~bits[a]).sum(axis=1))
        other = other[100 * most >= percent * (n[a] + n[other] - most)]
        for at in range(0, len(other), 64):
            some = other[at : at + 64]
            some = some[label[some] != label[a]]
            if not len(some):
                continue
            joined = np.concatenate([sets[o] for o in some])
            hit = sets[a][np.minimum(np.searchsorted(sets[a], joined), n[a] - 1)] == joined
            common = np.add.reduceat(hit.astype(np.int64), np.append(0, np.cumsum(n[some])[:-1]))
            for o in some[100 * common >= percent * (n[a] + n[some] - common)]:
                if label[o] != label[a]:
                    label[label == label[o]] = label[a]
                    forest.append((a, int(o)))
    return forest


def _tiles(percent: int):
    """Rows come tile by tile and block by block; a tile is held at a time."""

    def links(rows: list) -> pa.RecordBatch:
        diagonal = rows[0][1] == rows[0][2]
        left = [r for r in rows if r[3] == rows[0][1]] if not diagonal else rows
        right = [] if diagonal else [r for r in rows if r[3] != rows[0][1]]
        both = left + right
        sets = [np.frombuffer(r[5], dtype=_U) for r in both]
        forest = tile_links(sets[: len(left)], sets[len(left) :], percent, [r[6] for r in both]) if diagonal or (left and right) else []
        return pa.RecordBatch.from_arrays([pa.array([both[x][4] for x, _ in forest], pa.int64()), pa.array([both[y][4] for _, y in forest], pa.int64())], names=["a", "b"])

    def of(batches):
        rows: list = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("component", "left", "right", "block", "class", "set", "label"))):
                if rows and rows[0][:3] != row[:3]:
                    yield links(rows)
                    rows = []
                if not rows or rows[-1][4] != row[4]:  # equal rows have equal sets
                    rows.append(row)
        if rows:
            yield links(rows)

    return of


def row_key() -> Column:
    """A hash of doc_id and text that names a row, nulls included."""
    return F.xxhash64("doc_id", "text", F.col("doc_id").isNull(), F.col("text").isNull()).alias("id")


_TILE = ["component", "left", "right"]


def _compared(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of the tiles.  ``dealt``: component, left, right, block, label, class, a row for each tile a class is in."""
    rows = sets.select(F.col("class").alias("of"), "set").join(S.hint(dealt), F.col("of") == F.col("class")).select(*_TILE, "block", "label", "class", "set")
    rows = rows.repartition(*_TILE).sortWithinPartitions(*_TILE, "block", "class")
    return S.table(rows.mapInArrow(_tiles(percent), "a long, b long"), "step")


def _blocks(chosen: DataFrame, by: list[str]) -> DataFrame:
    """by, k, total, least, most, blocks: into how many blocks the classes of a component's part go."""
    parts = chosen.groupBy(*by).agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.min("n").cast("long").alias("least"), F.max("n").cast("long").alias("most"))
    return parts.withColumn("blocks", F.ceil(F.greatest(F.col("k") / BLOCK, F.col("total") / BLOCK_SHINGLES)))


def linked(chosen: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): enough exact links among classes (``chosen``: class, n, component) that share a component to keep all of what they connect."""
    zero = F.lit(0).cast("long")
    step = F.floor(F.log("n") * (4 / log(100 / percent))).cast("long")  # a quarter of the band within which sets may link
    chosen = chosen.withColumn("step", step)
    whole = chosen.groupBy("component").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where((F.col("k") > BLOCK) | (F.col("total") > BLOCK_SHINGLES)).select("component")
    whole = S.table(whole, "step")
    small = chosen.join(S.hint(whole), "component", "left_anti").select("component", zero.alias("left"), zero.alias("right"), zero.alias("block"), F.col("class").alias("label"), "class")
    small = S.table(small, "step")
    out = _compared(small, sets, percent)
    S.discard(small)
    if not whole.isEmpty():
        large = S.table(chosen.join(S.hint(whole), "component"), "step")
        first = S.table(_anchored(large, percent), "step")
        near = _compared(first, sets, percent)
        S.discard(first)
        label = S.table(components(near), "step")
        large = large.join(label.select("node", F.col("component").alias("label")), F.col("class") == F.col("node"), "left").select("component", "class", "n", "step", F.coalesce("label", "class").alias("label"))
        large = S.table(large, "step")
        second = S.table(_across(large, percent), "step")
        out = out.union(near).union(_compared(second, sets, percent))
        S.discard(label, large, second)
    S.discard(whole)
    return out


def _anchored(large: DataFrame, percent: int) -> DataFrame:
    """Each block with itself and with the anchors of its size step and the four next, which is how far links reach."""
    steps = _blocks(large, ["component", "step"])
    turn = Window.partitionBy("component", "step").orderBy("class")
    least = large.groupBy("component", "step", F.pmod(F.xxhash64("class"), F.lit(64)).alias("p")).agg(F.min("class").alias("class"))  # at most 64 a step
    anchors = least.withColumn("r", F.row_number().over(turn)).where(F.col("r") <= ANCHORS).select("component", F.col("step").alias("own"), "class")
    steps = S.table(steps.select("component", "step", "blocks"), "step")
    at = F.col("step") * (1 << 40)
    dealt = large.join(S.hint(steps), ["component", "step"]).select("component", (at + F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks"))).alias("block"), "class")
    spread = anchors.select("component", "class", F.explode(F.sequence(F.col("own") - 4, F.col("own"))).alias("step")).join(steps, ["component", "step"])
    spread = spread.select("component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("r"), "step", "class").select("component", (at + F.col("r")).alias("block"), "class")
    both = dealt.union(spread).distinct()
    return both.select("component", F.col("block").alias("left"), F.col("block").alias("right"), "block", F.col("class").alias("label"), "class")


def _across(large: DataFrame, percent: int) -> DataFrame:
    """Pairs of blocks of different labels.  Labels of many classes have blocks of their own, the others share some (``lab`` null)."""
    many = large.groupBy("component", "step", "label").agg(F.count("*").alias("k")).where(F.col("k") >= BLOCK // 8).select("component", "step", F.col("label").alias("lab"))
    many = S.table(many, "step")
    rows = large.alias("l").join(S.hint(many).alias("m"), (F.col("l.component") == F.col("m.component")) & (F.col("l.step") == F.col("m.step")) & (F.col("l.label") == F.col("m.lab")), "left").select("l.*", "m.lab")
    part = ["component", "step", "lab"]
    parts = S.table(_blocks(rows, part), "step")
    name = lambda r: F.xxhash64("step", "lab", F.col("lab").isNull(), r)
    blocks = parts.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("component", "lab", "step", name(F.col("r")).alias("block"), "least", "most")
    # a link's sizes are at most four steps apart (one more for rounding), so that is an equi-join on the step
    near = blocks.withColumn("step", F.explode(F.sequence(F.col("step"), F.col("step") + 5)))
    a, b = near.alias("a"), blocks.alias("b")
    apart = F.col("a.lab").isNull() | F.col("b.lab").isNull() | (F.col("a.lab") != F.col("b.lab"))
    within = (100 * F.col("a.most") >= percent * F.col("b.least")) & (100 * F.col("b.most") >= percent * F.col("a.least"))
    on = (F.col("a.component") == F.col("b.component")) & (F.col("a.step") == F.col("b.step")) & apart & within
    tiles = a.join(b, on).select(F.col("a.component").alias("component"), F.least("a.block", "b.block").alias("left"), F.greatest("a.block", "b.block").alias("right")).distinct()
    tiles = S.table(tiles, "step")
    sides = tiles.select(*_TILE, F.col("left").alias("block")).union(tiles.where("left <> right").select(*_TILE, F.col("right").alias("block")))
    rows = rows.alias("l").join(S.hint(parts).alias("p"), (F.col("l.component") == F.col("p.component")) & (F.col("l.step") == F.col("p.step")) & F.col("l.lab").eqNullSafe(F.col("p.lab"))).select("l.*", "p.blocks")
    dealt = rows.withColumn("block", name(F.pmod(F.xxhash64("class", F.lit(2)), F.col("blocks")))).join(S.hint(S.table(sides, "step")), ["component", "block"])
    return dealt.select(*_TILE, "block", "label", "class")


def candidates(first: DataFrame, folded: bool = False) -> DataFrame:
    """(a, b): each class on a key and the smallest on it, from rows of (class, keys, links).

    ``folded``: a key is there once a batch of documents, however many have it, so rows are dealt by key once, for the aggregation and the join alike.
    Otherwise a key may have very many rows, which partial aggregation folds and a join may split."""
    keyed = first.select(F.explode("keys").alias("key"), "class").where("key is not null and class is not null")
    if folded:
        keyed = keyed.repartition("key")
    shared = keyed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key", "low")
    shared = shared.hint("merge") if folded else S.hint(S.table(shared, "step"))
    near = keyed.join(shared, "key").where("class <> low").select(F.col("class").alias("a"), F.col("low").alias("b"))
    return near.union(first.select(F.col("class").alias("a"), F.explode("links").alias("b")))


def class_links(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(id, doc_id, n, class) of each row, and (a, b), classes that link: enough of them to keep all components."""
    S.arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key())
    first = S.table(docs.mapInArrow(_first_pass(shingle, percent), "id long, doc_id long, n int, class long, keys array<long>, links array<long>"), "ngram-keys", "uncompressed")
    cluster = S.table(components(candidates(first, folded=True)), "step")
    # one document of each class in a cluster, whatever its number of copies
    one = first.groupBy("class").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    chosen = S.table(one.join(S.hint(cluster), one["class"] == cluster["node"]).select("id", "class", "n", "component"), "step")
    sets = S.table(docs.join(S.hint(chosen.select("id")), "id").select("text").mapInArrow(_second_pass(shingle), "class long, n int, set binary"), "step", "uncompressed")
    links = linked(chosen.drop("id"), sets, percent)
    S.discard(cluster, chosen, sets)
    return first.select("id", "doc_id", "n", "class"), links


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, doc_id, n_shingles, class, component, component_id) of each row; rows of one class have equal sets."""
    members, links = class_links(docs, shingle, percent)
    comp = components(links)
    # the smallest doc_id of each component, by way of its classes' smallest
    lowest = members.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("low"))
    comp = S.table(comp, "step")
    lowest = S.table(lowest.join(S.hint(comp), lowest["class"] == comp["node"], "left").select("class", "low", F.coalesce("component", "class").alias("component")), "step")
    named = lowest.join(lowest.groupBy("component").agg(F.min("low").alias("component_id")), "component")
    named = S.table(named.select(F.col("class").alias("class_"), "component", "component_id"), "step")
    S.discard(comp, lowest)
    # a class with very many copies is a hot key of this join, whose rows the join may split
    out = members.join(named, (members["class"] == F.col("class_")) & (members["n"] > 0), "left")
    return out.select("id", "doc_id", F.col("n").cast("long").alias("n_shingles"), "class", "component", F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that with the smallest doc_id, and all rows without words; columns stay as they are.
    Of equal rows (same doc_id and text) one stays."""
    found = S.table(classes(docs, shingle, percent).select("id", "doc_id", "component", "n_shingles"), "ngram-classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")
    first = S.table(found.where("component is not null").groupBy("component").agg(F.min(order)["id"].alias("first")), "step")
    own, id_ = S.names(docs, "row", "id")
    gone = S.table(found.join(S.hint(first), "component").where("id <> first").select(F.col("id").alias(id_)).distinct(), "step")
    keyed = docs.withColumn(own, row_key())
    kept = keyed.join(S.hint(gone), F.col(own) == F.col(id_), "left_anti")
    again = S.table(found.groupBy("id").count().where("count > 1").select(F.col("id").alias(id_)), "step")
    if not again.isEmpty():
        twice = kept.join(again, F.col(own) == F.col(id_), "left_semi").dropDuplicates([own])
        kept = kept.join(again, F.col(own) == F.col(id_), "left_anti").unionByName(twice)
    return kept.drop(own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return classes(S.read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT r.node, links.b FROM r JOIN links ON r.other = links.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(other) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""
