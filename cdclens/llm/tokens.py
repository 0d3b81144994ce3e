"""Operator 8, token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file holds a run of documents in ascending doc_id order.  Its ids are ranked by their frequency over all documents of the
file, so the commonest 256 take one byte; the table of ranks is in the file, which therefore needs no other one and can be
rewritten alone if its writer is lost.  Layout, little-endian:

    magic "TOKR0001" | n_docs u64 | n_tokens u64 | n_ranks u64 | n_data u64
    id of each rank u32 | doc_id of each document i64 | null flag of each u8 | tokens of each u64
    control bytes (2 bits a token: its bytes less one, four tokens a byte) | data bytes | crc32 of all before u32

Decoding looks each control byte up in a 256 x 4 table of lengths.

Encoding is the tokenizers library's, once for each distinct piece of text: pieces are cut at ASCII white space and between ASCII
letters and ASCII signs other than the apostrophe, where the tokenizer always cuts, and a worker keeps the ids of pieces it has seen, by two
64-bit hashes with tables of their own; where the first is equal and the second is not, the texts at hand are encoded whole.

Defined cases: a null text is the empty one, whose only id is the end's; equal doc_ids follow each other by text hash; a null
doc_id comes last; texts with a special token's string are encoded whole; an empty table makes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cdclens.llm import _store as S
from cdclens.llm import _vec as V

END = 2
MAGIC = b"TOKR0001"
#: Tokens of a file, at which it closes; files of tens of MB for a cluster's stores.
FILE_TOKENS = 4_000_000
_CACHE = 1_000_000
_U = np.uint64

_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.int64)

_LETTER = V.byte_set((0x41, 0x5A), (0x61, 0x7A))
_SIGN = V.byte_set((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_HIGH = V.byte_set((0x80, 0xFF))
_OTHER = V._spread(256, 8)
_OTHER_LOWER = _OTHER[V._LOWER]


class Encoder:
    """Ids of whole columns of text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.specials = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        # a sign whose encoding is one id, and only it has that id, tells pieces apart when many are encoded at once
        self.mark = next(c for c in "☃★☀♥♫" if len(self._ids(c)) == 1)
        self.mark_id = self._ids(self.mark)[0]
        self._clear()

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.second = np.zeros(1 << 14, dtype=_U)
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 14, dtype=np.int64)

    def _learn(self, hashes: list[int], second: np.ndarray, pieces: list[bytes]) -> None:
        for at in range(0, len(pieces), 4000):
            some = [p.decode() for p in pieces[at : at + 4000]]
            if any(self.mark in p for p in some):
                parts = [np.array(self._ids(p), dtype=np.uint32) for p in some]
            else:
                ids = np.array(self._ids(f" {self.mark} ".join(some)), dtype=np.uint32)
                marks = np.flatnonzero(ids == self.mark_id)
                parts = [p if not k else p[1:] for k, p in enumerate(np.split(ids, marks))]
                if len(parts) != len(some):
                    parts = [np.array(self._ids(p), dtype=np.uint32) for p in some]
            for h, other, p in zip(hashes[at : at + 4000], second[at : at + 4000], parts):
                k = len(self.place)
                begin = self.ends[k - 1] if k else 0
                if begin + len(p) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(p), dtype=np.uint32)])
                if k >= len(self.ends):
                    self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), dtype=np.int64)])
                    self.second = np.concatenate([self.second, np.zeros(len(self.second), dtype=_U)])
                self.flat[begin : begin + len(p)] = p
                self.ends[k] = begin + len(p)
                self.place[h] = k
                self.second[k] = other

    def _pieces(self, sub: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w = V.NOT_SPACE[sub]
        letter, sign = _LETTER[sub], _SIGN[sub]
        edge = np.ones(len(sub) + 1, dtype=bool)
        edge[1:-1] = (w[1:] != w[:-1]) | (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
        edge[starts[starts < len(sub)]] = True
        at = np.flatnonzero(edge)
        s, e = at[:-1], at[1:]
        s, e = s[w[s]], e[w[s]]
        high = np.append(0, np.cumsum(_HIGH[sub]))
        plain = high[e] == high[s]
        h = V.span_hashes(sub, s, e, lower=True)
        if not plain.all():  # letters beyond ASCII may compose with a capital in another way than with a small letter
            h[~plain] = V.span_hashes(sub, s[~plain], e[~plain], lower=False) ^ _U(0x5555)
        power, inverse = V._tables(len(sub) + 1)
        total = np.zeros(len(sub) + 1, dtype=_U)
        np.cumsum(_OTHER_LOWER[sub] * power[: len(sub)], out=total[1:])
        second = (total[e] - total[s]) * inverse[s]
        if not plain.all():
            np.cumsum(_OTHER[sub] * power[: len(sub)], out=total[1:])
            second[~plain] = ((total[e] - total[s]) * inverse[s])[~plain] ^ _U(0x5555)
        return s, e, h, second

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end's id; number of ids of each)."""
        data, off = V.buffers(column)
        n_docs = len(off) - 1
        special = np.zeros(n_docs, dtype=bool)
        raw = data.tobytes()
        for t in self.specials:
            at = raw.find(t)
            while at >= 0:
                special[np.searchsorted(off, at, "right") - 1] = True
                at = raw.find(t, at + 1)
        out: list[np.ndarray] = []
        counts = np.zeros(n_docs, dtype=np.int64)
        for a, b, at, to, whole in V.slices(data, off, V.NOT_SPACE):
            sub = data[at:to]
            part = b - a == 1 and not (off[a] == at and whole)
            if part and at == off[a]:
                begun = len(out)
            if special[a:b].any():
                if part and at != off[a]:
                    continue  # the first part has stood for the whole
                ids = [np.append(np.array(self._ids(bytes(data[off[k] : off[k + 1]]).decode()), dtype=np.uint32), np.uint32(END)) for k in range(a, b)]
                out += ids
                counts[a:b] = [len(i) for i in ids]
                continue
            starts = np.zeros(1, dtype=np.int64) if part else off[a:b] - at
            s, e, h, second = self._pieces(sub, starts) if len(sub) else (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=_U),) * 2
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            if len(self.place) > _CACHE:
                self._clear()
            keys = u.tolist()
            k = np.fromiter((self.place.get(x, -1) for x in keys), dtype=np.int64, count=len(keys))
            new = np.flatnonzero(k < 0)
            if (second != second[first][inverse]).any() or (self.second[k[k >= 0]] != second[first][k >= 0]).any():
                if part:  # whatever the parts before have given
                    del out[begun:]
                    special[a] = True
                ids = [np.append(np.array(self._ids(bytes(data[off[d] : off[d + 1]]).decode()), dtype=np.uint32), np.uint32(END)) for d in range(a, b)]
                out += ids
                counts[a:b] = [len(i) for i in ids]
                continue
            if len(new):
                self._learn([keys[i] for i in new], second[first[new]], [sub[s[first[i]] : e[first[i]]].tobytes() for i in new])
                k[new] = [self.place[keys[i]] for i in new]
            begin = np.where(k > 0, self.ends[k - 1], 0)
            size = self.ends[k] - begin
            begin, size = begin[inverse], size[inverse]
            total = np.append(0, np.cumsum(size))
            ids = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
            bounds = total[np.append(np.searchsorted(s, starts), len(s))]
            if whole:
                ids = np.insert(ids, bounds[1:], END)
                counts[a:b] += np.diff(bounds) + 1
            else:
                counts[a:b] += np.diff(bounds)
            out.append(ids.astype(np.uint32))
        return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)), counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own; its pieces serve later tasks too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes."""
    seen = np.bincount(ids, minlength=1)
    order = np.argsort(-seen, kind="stable")[: int((seen > 0).sum())]
    rank = np.zeros(len(seen), dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    r = rank[ids]
    more = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros(-(-len(r) // 4) * 4, dtype=np.uint8)
    padded[: len(r)] = more
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = r.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    body = b"".join([
        MAGIC, struct.pack("<4Q", len(counts), len(ids), len(order), len(data)), order.astype("<u4").tobytes(),
        np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes(),
        counts.astype("<u8").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(b: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of a file's bytes."""
    if b[:8] != MAGIC or zlib.crc32(memoryview(b)[:-4]) != struct.unpack("<I", b[-4:])[0]:
        raise ValueError("not a whole token file")
    n_docs, n, n_ranks, n_data = struct.unpack_from("<4Q", b, 8)
    at = 40

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(b, dtype=kind, count=k, offset=at)
        at += out.nbytes
        return out

    table, docs, none, counts = take("<u4", n_ranks), take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    length = _LENGTHS[take("u1", -(-n // 4))].ravel()[:n]
    data = np.append(take("u1", n_data), np.zeros(3, dtype=np.uint8)).astype(np.uint32)
    start = np.cumsum(length) - length
    r = data[start]
    for k in range(1, 4):
        r = r | np.where(length > k, data[start + k] << np.uint32(8 * k), np.uint32(0))
    return [None if z else int(d) for d, z in zip(docs, none)], counts.astype(np.int64), table[r] if n else np.zeros(0, dtype=np.uint32)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, folder: str, name: str = "word_bpe_49k.json", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes files to the folder; a row for each: part, seq, path, n_docs, n_tokens.  File names are unique to an attempt
    and only the rows of successful attempts are returned, so a retried task leaves no double."""
    spark = docs.sparkSession
    S.arrow_batches(spark)

    def of(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, base = S.filesystem(folder)
        enc = encoder(tokenizer_path(name))
        seq, held, doc_ids = 0, [], []

        def close():
            nonlocal seq, held, doc_ids
            ids, counts = np.concatenate([i for i, _ in held]), np.concatenate([c for _, c in held])
            path = f"{folder}/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.tok"
            files.create_dir(base, recursive=True)
            with files.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}", compression=None) as f:
                f.write(pack(doc_ids, counts, ids))
            row = {"part": [part], "seq": [seq], "path": [path], "n_docs": [len(doc_ids)], "n_tokens": [len(ids)]}
            seq, held, doc_ids = seq + 1, [], []
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids, counts = enc.encode(some.column("text"))
                held.append((ids, counts))
                doc_ids += some.column("doc_id").to_pylist()
                if sum(len(i) for i, _ in held) >= file_tokens:
                    yield close()
        if doc_ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    by = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("tie")
    return S.table(ordered.mapInArrow(of, "part int, seq int, path string, n_docs long, n_tokens long"), "token-files")


def with_starts(files: DataFrame) -> DataFrame:
    """Adds ``base``, the tokens of all files before: sums within a part, and over the parts' totals (a row a task)."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    parts = parts.select(F.col("part").alias("p"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return files.withColumn("inner", inner).join(parts, F.col("part") == F.col("p")).withColumn("base", F.col("inner") + F.col("before")).drop("inner", "p", "before")


def read_tokens(files: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents of the files, or with ``ids_crc32`` in the place of ids."""

    def of(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, p = S.filesystem(path)
                with fs.open_input_file(p) as f:
                    docs, counts, ids = unpack(f.read())
                off = np.append(0, np.cumsum(counts))
                if digest:
                    raw = ids.astype("<u4")
                    last, kind = pa.array([zlib.crc32(raw[off[k] : off[k + 1]].tobytes()) for k in range(len(counts))], pa.int64()), "ids_crc32"
                else:
                    last, kind = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32))), "ids"
                out = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base + off[:-1], pa.int64()), pa.array(counts, pa.int64()), last], names=["doc_id", "start", "n_tokens", kind])
                for at in range(0, out.num_rows, 1024):
                    yield out.slice(at, 1024)

    spread = with_starts(files).select("path", "base").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(of, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<int>'}")


def encode_and_read(docs: DataFrame) -> DataFrame:
    """Through files in the shared folder: doc_id, start, n_tokens, ids_crc32."""
    return read_tokens(write_tokens(docs, S.shared(docs.sparkSession, "tokens")), digest=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document."""
    return encode_and_read(S.read_table(spark, sf_dir, "documents"))
