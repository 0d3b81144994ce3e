"""Operator 2, substring dedup: paragraph MinHash banding, exact verification, removals by components.

*Paragraphs* are lines of ``SHINGLE`` words or more, as they have a shingle, and hard-wrapped lines joined.  A line goes on in the next if both
aren't blank, and the next one's first word would have made it longer than the longest line of all between two blank ones, and
that one has ``MAX_WIDTH`` characters at most; of such lines there must be two, as the longest is always one.  Lines that are joined are paragraphs by themselves too.
Their 5-word shingles get 64 MinHashes in 16 bands of 4: at Jaccard 0.8 a pair collides in some band with probability 1 - (1 - 0.8**4)**16 = 0.9998, at
0.5 with 0.64.  Equal paragraphs (by a 64-bit hash of their words) are one class; classes that collide are clustered, and within a cluster the exact Jaccard of the
sorted shingle arrays decides (>= 0.8), in tiles, with bitmap bounds before.  Linked classes form components; of each that two
documents have, the first place stays and the others are marked as removed.

*Passages* that two documents share in the middle of different paragraphs leave those paragraphs' Jaccard low, so
MinHash over paragraphs can't find them.  They are found by ``WINDOW``-word windows, of which winnowing keeps the least hash among any
``KEEP_ONE_OF`` consecutive ones: a run of 29 words that occurs in two documents has a kept window in both, and so has a passage of 60 words of which one was edited.
Equal windows verify themselves (Jaccard 1).  Passages are decided window by window: the first place of each stays, and only what the
others cover is marked, so that a passage that follows another in one document and stands alone in the next is not lost with it.  Windows that overlap or touch in a
document, and of which all stay or go for the same passage, merge to one.  Words of a unit that stays are never taken out, whatever else covers them.

Plan: one Arrow pass over the texts gives hashes of windows, classes and bands, written once.  Their rows are dealt by key once, for the aggregation that finds the
keys of two documents and for the join back alike, whatever their number.  Bands that several classes of a slice have leave it once; windows that ``HOT`` documents of a slice
have are found apart, by partial aggregation and a join that may be split.  Only texts with a paragraph in a cluster are read again, for the exact sets.

Places are ordered by doc_id (null last), a hash of the row, and position.  Defined cases: null, empty and short texts have no units; repeats within one
document alone are left, but of what another document has too every place in a document counts; equal rows (same doc_id and text) are one
document; a doc_id with several texts is as many documents; a null doc_id takes part like any other; other columns pass through ``substring_dedup`` whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cdclens.llm import _store as S
from cdclens.llm import _vec as V
from cdclens.llm import ngram_join as J
from cdclens.llm.components import components

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 16, 4
WINDOW, KEEP_ONE_OF = 20, 10
#: Longer lines are not hard-wrapped ones.
MAX_WIDTH = 200
#: Words from which a unit is called long; a passage's found part may lack up to nine words at either end.
LONG = 40
#: Documents of one slice of a batch from which a window they share counts as very common.
HOT = 32
#: Words whose units are hashed at once.
CHUNK = 1 << 18
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_U = np.uint64
_ODD = (V._spread(BANDS * ROWS, 11) >> _U(32)).astype(np.uint32) | np.uint32(1)
_ADD = (V._spread(BANDS * ROWS, 12) >> _U(32)).astype(np.uint32)
_PLACE = _U(0x9E3779B97F4A7C15)
_BAND = np.arange(BANDS, dtype=_U) * _PLACE


class Texts:
    """Words of the documents a to b of a batch: ``h`` hashes, ``off`` each document's first word and the end, ``line`` a word's
    line in its document, ``begin`` and ``end`` its characters there."""

    def __init__(self, a: int, b: int, h: np.ndarray, off: np.ndarray, line: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.a, self.b, self.h, self.off, self.line, self.begin, self.end = a, b, h, off, line, begin, end


def texts(column: pa.Array) -> Iterator[Texts]:
    data, off = V.buffers(column)
    held: list[tuple[np.ndarray, ...]] = []
    lines = chars = 0
    for a, b, at, to, whole in V.slices(data, off, V.NOT_SPACE):
        sub = data[at:to]
        single = b - a == 1 and not (whole and not held)
        starts = np.zeros(1, dtype=np.int64) if single else off[a:b] - at
        s, e = V.spans(sub, starts, V.NOT_SPACE) if len(sub) else (np.zeros(0, dtype=np.int64),) * 2
        h = V.span_hashes(sub, s, e, lower=True) if len(sub) else np.zeros(0, dtype=_U)
        breaks = np.append(0, np.cumsum(sub == 10))
        before = np.append(0, np.cumsum((sub & 0xC0) != 0x80))  # characters that begin before a byte
        of = np.append(np.searchsorted(s, starts), len(s))
        k = np.repeat(np.arange(len(starts)), np.diff(of))
        part = (h, breaks[s] - breaks[starts][k], before[s] - before[starts][k], before[e] - before[starts][k])
        if not single:
            yield Texts(a, b, h, of, *part[1:])
            continue
        held.append((part[0], part[1] + lines, part[2] + chars, part[3] + chars))
        lines, chars = lines + int(breaks[-1]), chars + int(before[-1])
        if whole:
            h, *rest = (np.concatenate(x) for x in zip(*held))
            yield Texts(a, b, h, np.array([0, len(h)]), *rest)
            held, lines, chars = [], 0, 0


def units(t: Texts) -> tuple[np.ndarray, ...]:
    """(document, line, lines, first word, words) of the paragraphs, by document and line; document and first word count within t."""
    if not len(t.h):
        return (np.zeros(0, dtype=np.int64),) * 5
    doc = np.repeat(np.arange(t.b - t.a), np.diff(t.off))
    new = np.ones(len(t.h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (t.line[1:] != t.line[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(t.h))
    of, line = doc[first], t.line[first]
    # hard-wrapped lines: blocks of lines without a blank one between, and whether a line is as long as it could be
    width, head = t.end[last - 1] - t.begin[first], t.end[first] - t.begin[first]
    near = np.append((of[1:] == of[:-1]) & (line[1:] == line[:-1] + 1), False)
    top = np.flatnonzero(np.append(True, ~near[:-1]))
    block = np.cumsum(np.append(True, ~near[:-1])) - 1
    widest = np.maximum.reduceat(width, top)
    on = near & (width + 1 + np.append(head[1:], 0) > widest[block])
    on &= ((np.add.reduceat(on.astype(np.int64), top) > 1) & (widest <= MAX_WIDTH))[block]
    a = np.flatnonzero(on & ~np.append(False, on[:-1]))
    z = np.flatnonzero(~on & np.append(False, on[:-1]))
    parts = (np.append(of, of[a]), np.append(line, line[a]), np.append(np.ones(len(of), dtype=np.int64), z - a + 1), np.append(first, first[a]), np.append(last - first, last[z] - first[a]))
    order = np.lexsort((parts[2], parts[1], parts[0]))
    order = order[parts[4][order] >= SHINGLE]
    return tuple(p[order] for p in parts)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] of them, then those of the next."""
    total = np.append(0, np.cumsum(n))
    return np.repeat(first - total[:-1], n) + np.arange(total[-1])


def signatures(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, its band keys): hashes of all words in order, and of four MinHashes each."""
    classes, bands = np.zeros(len(first), dtype=_U), np.zeros((len(first), BANDS), dtype=_U)
    sh = V.shingles(h, SHINGLE)
    total = np.cumsum(n)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(total, total[at] - n[at] + CHUNK, "right")))
        f, k = first[at:to], n[at:to]
        begins = np.append(0, np.cumsum(k)[:-1])
        place = np.arange(int(k.sum()), dtype=_U) - np.repeat(begins, k).astype(_U)
        classes[at:to] = V.mix(np.add.reduceat(V.mix(h[_ranges(f, k)] + place * _PLACE), begins) + k.astype(_U))
        k = k - SHINGLE + 1
        begins = np.append(0, np.cumsum(k)[:-1])
        v = (sh[_ranges(f, k)] >> _U(32)).astype(np.uint32)
        low = [np.minimum.reduceat(v * _ODD[r] + _ADD[r], begins).astype(_U) for r in range(BANDS * ROWS)]
        for b in range(BANDS):
            w = low[4 * b : 4 * b + 4]
            bands[at:to, b] = V.mix(V.mix(w[0] << _U(32) | w[1]) ^ (w[2] << _U(32) | w[3])) + _BAND[b]
        at = to
    return classes, bands


def windows(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word in it, hash) of the kept windows."""
    n = np.diff(t.off)
    if not len(n) or n.max(initial=0) < WINDOW:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
    five = V.shingles(t.h, 5)
    m = len(t.h) - WINDOW + 1
    g = V.mix(sum(five[k * 5 : k * 5 + m] * V._ROLL[k] for k in range(WINDOW // 5)))
    doc = np.repeat(np.arange(len(n)), n)[:m]
    own = np.arange(m) + WINDOW <= t.off[1:][doc]  # windows that don't reach into the next document
    low, have = g, 1
    for step in (1, 2, 4, KEEP_ONE_OF - 8):  # of 2, 4, 8 and then KEEP_ONE_OF consecutive ones
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        have += step
    runs = len(low)
    inside = own[have - 1 :] & (doc[:runs] == doc[have - 1 :]) if runs else own[:0]
    keep = np.zeros(m, dtype=bool)
    for d in range(have):
        if runs:
            keep[d : d + runs] |= inside & (g[d : d + runs] == low)
    few = np.flatnonzero((n >= WINDOW) & (n < WINDOW + have - 1))  # fewer windows than a run has: the least of all
    if len(few):
        w = n[few] - WINDOW + 1
        at = _ranges(t.off[few], w)
        begins = np.append(0, np.cumsum(w)[:-1])
        keep[at[g[at] == np.repeat(np.minimum.reduceat(g[at], begins), w)]] = True
    at = np.flatnonzero(keep)
    return doc[at], at - t.off[doc[at]], g[at]


_UNIT = "struct<line:int,n_lines:int,first:int,n_words:int,class:bigint,bands:array<bigint>,links:array<bigint>>"
_SCHEMA = f"id long, doc_id long, at array<int>, key array<long>, hot array<long>, units array<{_UNIT}>"


def _list(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)


def folded(classes: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, keys of each unit, links, links of each unit): the bands of a slice's units, each once.  A key stays with the first class that has it, to which the
    others link; a class's further units have neither."""
    some = np.sort(np.unique(classes, return_index=True)[1])
    flat, owner = bands[some].ravel(), np.repeat(np.arange(len(some)), BANDS)
    order = np.argsort(flat, kind="stable")
    head = np.ones(len(flat), dtype=bool)
    head[1:] = flat[order][1:] != flat[order][:-1]
    first = owner[order][np.maximum.accumulate(np.where(head, np.arange(len(flat)), 0))]
    apart = owner[order] != first
    a, b = np.divmod(np.unique(owner[order][apart] * len(some) + first[apart]), max(1, len(some)))
    keep = np.zeros(len(flat), dtype=bool)
    keep[order[head]] = True
    n_keys, n_links = np.zeros(len(classes), dtype=np.int64), np.zeros(len(classes), dtype=np.int64)
    n_keys[some], n_links[some] = np.bincount(owner[keep], minlength=len(some)), np.bincount(a, minlength=len(some))
    return flat[keep], n_keys, classes[some][b], n_links


def common(doc: np.ndarray, key: np.ndarray, documents: int) -> np.ndarray:
    """The keys that so many documents of a slice have."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    values, n = np.unique(k[new], return_counts=True)
    return values[n >= documents]


def _pass(hot: int):
    def of_batches(batches):
        for batch in batches:
            for t in texts(batch.column("text")):
                n = t.b - t.a
                doc, at, key = windows(t)
                often = common(doc, key, hot)
                of, line, n_lines, first, n_words = units(t)
                classes, bands = signatures(t.h, first, n_words)
                keys, n_keys, links, n_links = folded(classes, bands)
                fields = [pa.array(x.astype(np.int32)) for x in (line, n_lines, first - t.off[:-1][of], n_words)]
                fields += [pa.array(classes.view(np.int64)), _list(pa.array(keys.view(np.int64)), n_keys), _list(pa.array(links.view(np.int64)), n_links)]
                unit = pa.StructArray.from_arrays(fields, names=["line", "n_lines", "first", "n_words", "class", "bands", "links"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(t.a, n), batch.column("doc_id").slice(t.a, n), _list(pa.array(at.astype(np.int32)), np.bincount(doc, minlength=n)),
                        _list(pa.array(key.view(np.int64)), np.bincount(doc, minlength=n)), _list(pa.array(often.view(np.int64)), len(often) * (np.arange(n) == 0)), _list(unit, np.bincount(of, minlength=n)),
                    ],
                    names=["id", "doc_id", "at", "key", "hot", "units"],
                )

    return of_batches


def _sets(batches):
    """The shingle sets of the units that a row's ``picked`` names by their places among its units."""
    for batch in batches:
        picked = batch.column("picked").to_pylist()
        for t in texts(batch.column("text")):
            of, _, _, first, n_words = units(t)
            begin = np.searchsorted(of, np.arange(t.b - t.a))
            sh = V.shingles(t.h, SHINGLE)
            out, classes = [], []
            for k in range(t.b - t.a):
                for p in picked[t.a + k]:
                    u = begin[k] + p["place"]
                    out.append(np.unique(sh[first[u] : first[u] + n_words[u] - SHINGLE + 1]))
                    classes.append(p["class"])
                    if len(out) >= 4096:
                        yield _set_rows(classes, out)
                        out, classes = [], []
            if out:
                yield _set_rows(classes, out)


def _set_rows(classes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "n", "set"])


def _place(*position: str | Column) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", *position)


def _runs(rows: DataFrame, *same: str) -> DataFrame:
    """``from``, the start of the run a window is in: windows of a document that overlap or touch, and are equal in ``same``."""
    order = Window.partitionBy("id").orderBy("start")
    on = F.col("start") <= F.lag("start").over(order) + WINDOW
    for c in same:
        on = on & (F.col(c) == F.lag(c).over(order))
    return rows.withColumn("from", F.last(F.when(~F.coalesce(on, F.lit(False)), F.col("start")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _first_places(rows: DataFrame, hot: bool = False) -> DataFrame:
    """The rows (id, doc_id, start, key) of keys that two documents have, with first_doc_id and whether the row ``stays``, as it is the key's first place.
    Rows are dealt by key once; those of ``hot`` keys are not, as a key's would be in one task."""
    rows = rows if hot else rows.repartition("key")
    first = rows.groupBy("key").agg(F.min(_place("start")).alias("p"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "p")
    out = rows.join(S.hint(S.table(first, "step")) if hot else first.hint("merge"), "key")
    return out.select("key", "id", "doc_id", "start", F.col("p.doc_id").alias("first_doc_id"), ((F.col("id") == F.col("p.id")) & (F.col("start") == F.col("p.start"))).alias("stays"))


def passages(first: DataFrame) -> DataFrame:
    """(id, doc_id, start, n_words, passage_id, first_doc_id, removed) of runs of windows that two documents have: of each window
    the first place stays, and a run of other places has the passage_id of the run that stays for it.  ``start``: a word's place, from 0."""
    rows = first.select("id", "doc_id", F.explode(F.arrays_zip("at", "key")).alias("w")).select("id", "doc_id", F.col("w.at").alias("start"), F.col("w.key").alias("key"))
    hot = S.table(first.select(F.explode("hot").alias("key")).distinct(), "step")
    if hot.isEmpty():
        hits = _first_places(rows)
    else:
        hits = _first_places(rows.join(S.hint(hot), "key", "left_anti")).unionByName(_first_places(rows.join(S.hint(hot), "key", "left_semi"), True))
    hits = S.table(hits, "step")
    S.discard(hot)
    S.release(hits.sparkSession)
    stays = S.table(_runs(hits.where("stays").select("key", "id", "doc_id", "start")).withColumn("passage_id", F.xxhash64("id", "from")), "step")
    gone = hits.where("not stays").join(S.hint(stays.select("key", "passage_id")), "key")
    gone = _runs(gone.select("id", "doc_id", "start", "passage_id", "first_doc_id"), "passage_id")
    n_words = (F.max(F.col("start")) + WINDOW - F.col("from")).alias("n_words")
    kept = stays.groupBy("id", "doc_id", "from", "passage_id").agg(n_words).withColumns({"first_doc_id": F.col("doc_id"), "removed": F.lit(False)})
    gone = gone.groupBy("id", "doc_id", "from", "passage_id", "first_doc_id").agg(n_words).withColumn("removed", F.lit(True))
    return kept.unionByName(gone).withColumnRenamed("from", "start")


def paragraphs(first: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, doc_id, start, n_lines, n_words, passage_id, first_doc_id, removed) of near-equal paragraphs; ``start``: the first line's place, from 0."""
    own = first.select("id", "doc_id", F.posexplode("units").alias("place", "u"))
    cluster = S.table(components(J.candidates(own.select(F.col("u.class").alias("class"), F.col("u.bands").alias("keys"), F.col("u.links").alias("links")), folded=True)), "step")
    S.release(docs.sparkSession)
    members = own.select("id", "doc_id", "place", "u.line", "u.n_lines", "u.n_words", "u.class")
    # of each class its first place, and the first and last document that has it
    one = members.groupBy("class").agg(F.min(_place("line", (-F.col("n_lines")).alias("less"), "place")).alias("low"), F.max(_place()).alias("high"))
    one = S.table(one, "step")
    picked = one.join(S.hint(cluster), one["class"] == cluster["node"]).select("class", "component", F.col("low.id").alias("of"), F.col("low.place").alias("place"))
    picked = S.table(picked, "step")
    lists = S.table(picked.groupBy("of").agg(F.collect_list(F.struct("place", "class")).alias("picked")), "step")
    sets = S.table(docs.select("id", "text").join(S.hint(lists, 100_000), F.col("id") == F.col("of")).select("text", "picked").mapInArrow(_sets, "class long, n int, set binary"), "step", "uncompressed")
    S.discard(lists)
    chosen = S.table(sets.select("class", "n").join(S.hint(picked.select("class", "component")), "class"), "step")
    links = J.linked(chosen, sets, PERCENT)
    comp = S.table(components(links), "step")
    S.discard(cluster, picked, sets, chosen, links)
    S.release(docs.sparkSession)
    group = one.join(S.hint(comp), one["class"] == comp["node"], "left").select("class", "low", "high", F.coalesce("component", "class").alias("passage_id"))
    group = S.table(group, "step")
    S.discard(comp, one)
    both = group.groupBy("passage_id").agg(F.min("low").alias("first"), F.min(F.struct("low.none", "low.doc_id", "low.id")).alias("a"), F.max("high").alias("z")).where("a <> z").drop("a", "z")
    both = S.table(both, "step")
    named = S.table(group.select("class", "passage_id").join(S.hint(both), "passage_id"), "step")
    rows = members.join(S.hint(named), "class")
    # a line of a wrapped paragraph that stays stays with it
    inside = (F.col("id") == F.col("first.id")) & (F.col("line") >= F.col("first.line")) & (F.col("line") + F.col("n_lines") <= F.col("first.line") - F.col("first.less"))
    return rows.select("id", "doc_id", F.col("line").alias("start"), "n_lines", "n_words", "passage_id", F.col("first.doc_id").alias("first_doc_id"), (~inside).alias("removed"))


def row_key() -> Column:
    """A hash of doc_id and text that names a row, nulls included."""
    return F.xxhash64("doc_id", "text", F.col("doc_id").isNull())


def repeats(docs: DataFrame) -> DataFrame:
    """(id, doc_id, kind, start, n_lines, n_words, passage_id, first_doc_id, removed) of each passage and paragraph that more than one
    document has; ``id`` is the row's key, ``start`` a word's place in a passage and a line's in a paragraph."""
    S.arrow_batches(docs.sparkSession)
    docs = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("id", row_key())
    first = S.table(docs.mapInArrow(_pass(HOT), _SCHEMA), "substring-hashes")
    equal = S.table(first.groupBy("id").count().where("count > 1").select("id"), "step")
    if not equal.isEmpty():  # of equal rows one counts
        docs = docs.join(S.hint(equal), "id", "left_anti").unionByName(docs.join(S.hint(equal), "id").dropDuplicates(["id"]).select(*docs.columns))
        S.discard(first)
        first = S.table(docs.mapInArrow(_pass(HOT), _SCHEMA), "substring-hashes")
    S.discard(equal)
    cols = ["id", "doc_id", "kind", F.col("start").cast("long").alias("start"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_words").cast("long").alias("n_words"), "passage_id", "first_doc_id", "removed"]
    found = passages(first).withColumns({"kind": F.lit("passage"), "n_lines": F.lit(None)}).select(*cols)
    return found.unionByName(paragraphs(first, docs).withColumn("kind", F.lit("paragraph")).select(*cols))


def substring_dedup(docs: DataFrame, min_words: int = SHINGLE) -> DataFrame:
    """The documents with the removed units' words (passages) and lines (paragraphs) taken out of ``text``, but for words of units that stay.
    ``min_words``: units of fewer words are left."""
    own, id_, units_ = S.names(docs, "row", "id", "units")
    unit = F.struct("kind", "start", "n_lines", "n_words", "removed")
    gone = repeats(docs).where(F.col("n_words") >= min_words).groupBy(F.col("id").alias(id_)).agg(F.collect_list(unit).alias(units_), F.max("removed").alias("any")).where("any").drop("any")
    gone = S.table(gone, "substring-removals")
    few = (gone.agg(F.sum(F.size(units_) + 1)).first()[0] or 0) <= S.MAX_BROADCAST
    out = docs.withColumn(own, F.when(F.col("text").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), "text", F.col("doc_id").isNull())))
    out = out.join(F.broadcast(gone) if few else gone, F.col(own) == F.col(id_), "left")

    @F.arrow_udf("string")
    def cut(text: pa.Array, units: pa.Array) -> pa.Array:
        return pa.array([_without(t, u) for t, u in zip(text.to_pylist(), units.to_pylist())], pa.string())

    out = out.withColumn("text", F.when(F.col(id_).isNull(), F.col("text")).otherwise(cut("text", units_)))
    return out.select(*docs.columns)


def _without(text: str | None, units: list[dict] | None) -> str | None:
    if text is None or not units:
        return text
    begin, end = (np.array(x, dtype=np.int64) for x in zip(*(m.span() for m in _WORD.finditer(text))))
    lines = np.append(0, np.cumsum([len(line) + 1 for line in text.split("\n")]))
    first = np.searchsorted(begin, lines)  # each line's first word
    words, whole = np.zeros(len(begin), dtype=bool), np.zeros(len(lines) - 1, dtype=bool)
    for u in sorted(units, key=lambda u: not u["removed"]):  # those that stay come last
        k, passage = u["start"], u["kind"] == "passage"
        n = 1 if passage else u.get("n_lines") or 1
        words[slice(k, k + u["n_words"]) if passage else slice(first[k], first[k + n])] = u["removed"]
        if not passage and u["removed"]:
            whole[k : k + n] = True
    gone = np.zeros(len(text) + 2, dtype=np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], words, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2], edge[1::2]):  # white space beside a word that stays stays
        gone[begin[a] : end[b - 1]] = 1
    for k in np.flatnonzero(whole):
        if words[first[k] : first[k + 1]].all():
            gone[lines[k] : lines[k + 1]] = 1
    edge = np.flatnonzero(np.diff(np.concatenate([[1], gone[: len(text)], [1]])))
    return "".join(text[a:b] for a, b in zip(edge[::2], edge[1::2]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repeated passage and paragraph with its document, component, the component's first document, whether it goes, and
    ``long``, 1 if it has at least LONG words."""
    found = repeats(S.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("id").withColumn("long", (F.col("n_words") >= LONG).cast("int"))
