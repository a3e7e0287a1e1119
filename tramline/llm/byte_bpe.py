"""Byte-level BPE encoding and decoding as Spark higher-order functions.

A first pass cuts the texts into pre-tokens and packs each bounded chunk of documents into one row: the
chunk's distinct words as arrays of byte ids, and the documents as positions in that word list. The
merges are then one SQL expression: `transform` over the distinct words of the chunk, `aggregate` over
the byte array of a word, each step merging the leftmost pair of the smallest rank. The ranks are a
literal: MapType looks keys up one by one, so the map is laid out as two literal arrays, a row per left
id displaced into one table, and a pair is two array reads. No word is shuffled for the merges and a word
costs one merge a chunk at most. A chunk ends at CHUNK_BYTES of text or CHUNK_WORDS distinct words, so what
a task holds doesn't depend on its share of the input.

Words that come again in a sample of about SAMPLE_BYTES of the input are folded first, once for all chunks:
their ids lie in the shared folder, each Python worker reads them, and in a chunk these words are
positions behind its own. What the sample holds changes the cost, not the ids.

A word's ids are decoded by `array_join` of the tokens' bytes in hexadecimal, turned to binary at the end.
A last pass takes each document's words by position from those ids and bytes: an Arrow take a chunk.

Words of more than LONG_WORD bytes (rare runs without a boundary) enter the fold already merged by the
same rule with a heap, since the fold is quadratic in a word's length; the fold finds nothing left.

Null text: no ids, empty bytes. Repeated rows and null ids are rows like others; other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, release, stage
from .pretokens import splitter

CHUNK_BYTES, CHUNK_WORDS, CHUNK_DOCS = 8 << 20, 200_000, 20_000
SAMPLE_BYTES, COMMON_WORDS, COMMON_PARTS, COMMON_ROW, OUT_DOCS = 64 << 20, 300_000, 16, 5_000, 1_000
LONG_WORD = 96
MAX_ID, NO_PAIR = 1 << 16, 1 << 24
PLAN_TEXT = 1 << 16  # characters of a plan's text; it would hold the literal tables several times


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def pair_table(path: str) -> tuple[list[int], list[int | None]]:
    """The rank map by row displacement: the pair (a, b) is at shift[a] + b, as a << 16 | rank; other cells are null."""
    ranks = read_ranks(path)
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                rows.setdefault(a, []).append((b, rank))
    size = 1 << (sum(map(len, rows.values())).bit_length() + 2)
    shift, cells = [0] * (max(ranks.values()) + 1), np.full(size + MAX_ID, -1, np.int64)
    free, rng = np.ones(len(cells), bool), np.random.default_rng(0)
    for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):
        right, rank = np.array(rows[a], np.int64).T
        at = right + rng.integers(size)
        while not free[at].all():
            at = right + rng.integers(size)
        shift[a] = int(at[0] - right[0])
        free[at] = False
        cells[at] = a << 16 | rank
    return shift, [None if c < 0 else c for c in cells.tolist()]


def literal_array(values: list, kind: str) -> Column:
    """A literal of many elements: parsed from JSON and folded to one constant by the optimizer."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), f"array<{kind}>")


def let(value: Column, body) -> Column:
    """Evaluate value once and use it in body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, tables: Column) -> Column:
    """Token ids of a word given as byte ids: ranked merges, smallest rank first, leftmost first.

    best is the least rank << 8 | position of a pair; a pair without a rank has a null cell, or more than 16
    bits of rank, those in which its left id and its cell's differ.
    """

    def best(ids: Column) -> Column:
        # the last id has no right neighbour: null, which array_min passes over
        rank = lambda x, y: F.get(tables["cells"], F.get(tables["shift"], x) + y).bitwiseXOR(F.shiftleft(x, 16))
        return F.array_min(F.transform(ids, lambda x, i: F.shiftleft(rank(x, F.get(ids, i + 1)), 8).bitwiseOR(i.cast("long"))))

    def step(state: Column, _: Column) -> Column:
        ids, m = state["ids"], state["m"]
        put = lambda p: F.filter(F.transform(ids, lambda x, i: F.when(i == p, F.shiftright(m, 8)).otherwise(x)), lambda x, i: i != p + 1)
        merged = let(m.bitwiseAND(0xFF).cast("int"), put)
        return F.when(m < NO_PAIR, let(merged, lambda x: F.struct(x.alias("ids"), best(x).alias("m")))).otherwise(state)

    return F.aggregate(word, F.struct(word.alias("ids"), best(word).alias("m")), step, lambda s: s["ids"])


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word in n log n: a heap of (rank, start) over a linked list of pieces."""
    n = len(word)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))  # a piece is word[i : nxt[i]]

    def rank(i: int) -> int | None:
        return ranks.get(word[i : nxt[nxt[i]]]) if nxt[i] < n else None

    heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or rank(i) != r:
            continue
        j = nxt[i]
        alive[j], nxt[i] = 0, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        for k in (i, prv[i]):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k))
    return [ranks[word[i : nxt[i]]] for i in range(n) if alive[i]]


def _lists(values: np.ndarray, lengths, kind) -> pa.Array:
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(np.asarray(lengths, np.int64), out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


def as_words(ids: pa.Array, *pieces: pa.Array) -> tuple[pa.Array, ...]:
    """Each word's ids (lists of long) as little-endian unsigned 32-bit integers, and its bytes if given, all binary."""
    ends = np.zeros(len(ids) + 1, np.int32)
    np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False) * 4, out=ends[1:])
    data = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(data)]), *pieces


def _read(common: str, *columns: str) -> list[pa.Array]:
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(common)
    table = pq.read_table(at, columns=list(columns), filesystem=fs)
    return [pa.concat_arrays([x.flatten() for x in table.column(c).chunks] or [pa.array([], table.schema.field(c).type.value_type)]) for c in columns]


@lru_cache(1)
def known_texts(common: str) -> pa.Array:
    """The words that common_words staged."""
    return _read(common, "texts")[0]


@lru_cache(1)
def known_words(common: str) -> tuple[pa.Array, pa.Array]:
    """Ids and bytes of these words, in the same order."""
    return as_words(*_read(common, "ids", "pieces"))


def as_ids(words: list[str], byte_ids: np.ndarray, ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Byte ids of all words in one array, and each word's number of them; long words are merged already."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    width = np.fromiter(map(len, raw), np.int64, len(raw))
    values = byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    if width.max(initial=0) > LONG_WORD:
        ends, parts, done = np.cumsum(width), [], 0
        for i in np.flatnonzero(width > LONG_WORD):
            merged = np.array(merge_long(raw[i], ranks), np.int64)
            parts += [values[done : ends[i] - width[i]], merged]
            done, width[i] = ends[i], len(merged)
        values = np.concatenate([*parts, values[done:]])
    return values, width


def common_words(docs: DataFrame, path: str, sample_bytes: int = SAMPLE_BYTES) -> str | None:
    """Folds the words that a sample of docs holds at least twice, the most frequent first; where their ids are staged.

    The sample is a share of the rows, by the planner's size of docs; rows made in memory have no size and no sample.
    Without sample_bytes there is none either: the driver then plans the literal tables once, not twice.
    """
    planned = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if planned >= 1 << 50 or not sample_bytes:
        return None

    def count(batches):
        find, seen = splitter(), Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(1):
                seen.update(find(text.as_py()))
                if len(seen) >= CHUNK_WORDS:
                    yield rows()
                    seen.clear()
        yield rows()
        seen.clear()
        release()

    def pack(batches):
        ranks = read_ranks(path)
        byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, COMMON_ROW):
                words = batch.column(0).slice(at, COMMON_ROW)
                values, width = as_ids(words.to_pylist(), byte_ids, ranks)
                yield pa.RecordBatch.from_arrays([_lists(words, [len(words)], None), _lists(_lists(values, width, pa.int64()), [len(words)], None)], ["texts", "words"])

    sample = documents(docs).sample(min(1.0, sample_bytes / max(planned, 1)), seed=0)
    counts = sample.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 2")
    common = counts.orderBy(F.desc("n"), "word").limit(COMMON_WORDS).select("word").repartition(COMMON_PARTS)
    folded = _folded(common.mapInArrow(pack, "texts array<string>, words array<array<long>>"), path)
    return f"{stage(folded, 'common-words')._staged_path}/rows"


def pack_chunks(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, common: str | None = None) -> DataFrame:
    """Rows (doc_ids, sizes, index, words: array<array<long>>) of bounded chunks.

    sizes are the documents' numbers of words, index their positions (32 bits each) in words; positions from the
    end of words on are rows of what common_words staged in common.
    """

    def flush(ids, index, words, byte_ids, ranks):
        at = np.full(len(words), -1, np.int32)
        if common:  # Arrow's table of the words is made for each chunk: kept as a dict they would be the worker's largest object
            at = pc.index_in(pa.array(words, pa.string()), value_set=known_texts(common)).fill_null(-1).to_numpy()
        new = at < 0
        fresh = [w for w, n in zip(words, new.tolist(), strict=True) if n]
        at = np.where(new, np.cumsum(new) - 1, at + len(fresh)).astype(np.int32)
        values, width = as_ids(fresh, byte_ids, ranks)
        sizes = pa.array([len(x) for x in index], pa.int32())
        columns = [_lists(pa.array(ids, pa.int64()), [len(ids)], None), _lists(sizes, [len(ids)], None), pa.array([at[np.concatenate(index)].tobytes()]), _lists(_lists(values, width, pa.int64()), [len(fresh)], None)]
        return pa.RecordBatch.from_arrays(columns, ["doc_ids", "sizes", "index", "words"])

    def run(batches):
        find, ranks = splitter(), read_ranks(path)
        byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

        class Words(dict):
            def __missing__(self, w):
                self[w] = n = len(self)
                return n

        ids, index, words, held = [], [], Words(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                found = find(text)
                ids.append(doc_id.as_py())
                index.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                held += len(text)
                if held >= chunk_bytes or len(words) >= CHUNK_WORDS or len(ids) >= CHUNK_DOCS:
                    yield flush(ids, index, words, byte_ids, ranks)
                    ids, index, words, held, found = [], [], Words(), 0, None
                    release()
        if ids:
            yield flush(ids, index, words, byte_ids, ranks)
        ids = index = words = None
        release()

    return documents(docs).mapInArrow(run, "doc_ids array<long>, sizes array<int>, index binary, words array<array<long>>")


def _merged(path: str) -> Column:
    """The ids of the chunk's distinct words."""
    shift, cells = pair_table(path)
    SparkSession.active().conf.set("spark.sql.maxPlanStringLength", PLAN_TEXT)
    tables = F.struct(literal_array(shift, "long").alias("shift"), literal_array(cells, "long").alias("cells"))
    return let(tables, lambda t: F.transform("words", lambda w: fold_merges(w, t)))


def _folded(chunks: DataFrame, path: str, decoded: bool = True) -> DataFrame:
    """chunks with the ids of each of words in its place; decoded adds pieces, their bytes."""
    piece = lambda p, ids: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(p, i)), ""))
    out = chunks.select(*(c for c in chunks.columns if c != "words"), _merged(path).alias("ids"))
    if not decoded:
        return out
    return out.withColumn("pieces", let(literal_array(_pieces(path), "string"), lambda p: F.transform("ids", lambda ids: piece(p, ids))))


def _documents(docs: DataFrame, path: str, chunk_bytes: int, sample_bytes: int, schema: str, row, decoded: bool) -> DataFrame:
    """row(doc_ids, ids, bytes if decoded) -> the columns of schema, of slices of documents; ids and bytes are binary."""
    common = common_words(docs, path, sample_bytes)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                doc_ids, sizes, *folded = (batch.column(c).slice(at, 1).flatten() for c in ("doc_ids", "sizes", "ids", "pieces")[: 4 if decoded else 3])
                index, ends = np.frombuffer(batch.column("index")[at].as_buffer(), np.int32), np.concatenate([[0], np.cumsum(sizes.to_numpy(), dtype=np.int64)])
                words = as_words(*folded)
                if common:
                    words = [pa.concat_arrays(x) for x in zip(words, known_words(common), strict=False)]
                for i in range(0, len(sizes), OUT_DOCS):
                    own = ends[i : i + OUT_DOCS + 1]
                    yield pa.RecordBatch.from_arrays(row(doc_ids.slice(i, OUT_DOCS), *(_joined(w, index[own[0] : own[-1]], own - own[0]) for w in words)), [c.split()[0] for c in schema.split(", ")])
            release()

    return _folded(pack_chunks(docs, path, chunk_bytes, common), path, decoded).mapInArrow(run, schema)


def _joined(words: pa.Array, index: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words at index, one after the other, as one binary a document; a document's positions end at ends."""
    taken = words.take(pa.array(index))
    at = np.frombuffer(taken.buffers()[1], np.int32)[ends] if len(index) else np.zeros(len(ends), np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at), taken.buffers()[2]])


def encode(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, ids (array<long>) of every row of docs."""

    def row(doc_ids, ids):
        ends = np.frombuffer(ids.buffers()[1], np.int32)
        data = np.frombuffer(ids.buffers()[2] or b"", "<u4", ends[-1] // 4)
        return [doc_ids, _lists(data.astype(np.int64), np.diff(ends) // 4, pa.int64())]

    return _documents(docs, path, chunk_bytes, sample_bytes, "doc_id long, ids array<long>", row, False)


def round_trip(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, ids_le (the ids as little-endian unsigned 32-bit integers) and decoded (their bytes), both binary.

    Each distinct word's ids are decoded once; a document concatenates its words' pieces.
    """
    return _documents(docs, path, chunk_bytes, SAMPLE_BYTES, "doc_id long, ids_le binary, decoded binary", lambda *columns: list(columns), True)


def _pieces(path: str) -> list[str]:
    """Bytes of each id, in hexadecimal."""
    ranks = read_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    return pieces


def decode(ids: Column, path: str) -> Column:
    """The bytes of an array of ids; a null array gives null, an empty one no bytes."""
    return F.unhex(F.array_join(let(literal_array(_pieces(path), "string"), lambda p: F.transform(ids, lambda i: F.get(p, i))), ""))
