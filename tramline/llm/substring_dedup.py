"""Substring deduplication by seed and extend.

1. Seeds. Of every SPAN - SEED + 1 consecutive runs of SEED words the one of least hash is an anchor
   (winnowing). A passage of SPAN words selects its anchor from its own words alone, so a passage that
   stands in two documents has its anchor in both: documents are joined on anchors in one packed exchange,
   which marks the anchors that another document has too.
2. Extend. From a shared anchor, a match is extended left and right, over the windows of SPAN words that
   selected it; a second exchange asks only for those whether the window starts in a document of a smaller
   id. Extents of neighbouring anchors that meet are one match.
3. Maximal repeats. What can't be extended further is a maximal repeat; those of at least SPAN words go.

A window is known by 128 bits, two hashes of the hashes of its words: one is exchanged as the key, the other
goes with it and decides. Windows
are judged on the input. Words: [^\\x20\\x09-\\x0D]+, unchanged. Null text: no words. A null id counts as the
largest: its document never takes words from another. Rows of one id don't take from each other. Hashes,
not pairs, are exchanged, so a passage in every document costs each document its own words once. Other
columns, whatever their names, are carried by without_repeats and ignored by dedup. An empty table gives an
empty one. The words of a chunk are numbered once and kept beside its texts for the later passes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import chunks
from .common import documents, drop_stage, mix64, split_words, stage, whole_rows, window_hashes

SPAN, SEED = 13, 7
OTHER = 0xD6E8FEB86659FD93  # factor of the second hash of a window
NO_ID = 2**63 - 1
KEEP = np.uint64(0xFFFFFFFFFFFF0000)  # anchors only select what is asked exactly later: 48 bits are enough


def anchors(word_hashes: np.ndarray, span: int = SPAN, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of seed words, position of the anchor of each window of span words)."""
    runs, width = window_hashes(word_hashes, seed), span - seed + 1
    n = len(runs) - width + 1
    if n <= 0:
        return runs, np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(runs, width)
    return runs, np.arange(n) + width - 1 - np.argmin(view[:, ::-1], axis=1)


class _Chunk:
    """A chunk's words as numbers, and what follows from them."""

    def __init__(self, ids: list, counts: np.ndarray, codes: np.ndarray, hashes: np.ndarray, span: int, seed: int):
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.counts, self.codes, self.hashes = counts, codes, hashes
        self.ends = np.cumsum(counts)
        self.selected, self.anchor_count = [], []
        keys, owner = [], []
        for local in range(len(ids)):
            runs, at = anchors(self.words(local), span, seed)
            used, back = np.unique(runs[at], return_inverse=True)
            self.selected.append(back)
            self.anchor_count.append(len(used))
            keys.append(used)
            owner.append(np.full(len(used), local, np.uint16))
        keys = mix64(np.concatenate(keys)) & KEEP
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[self.order], np.concatenate(owner)[self.order]

    def words(self, local: int) -> np.ndarray:
        return self.hashes[self.codes[self.ends[local] - self.counts[local] : self.ends[local]]]

    def windows(self, asides: pd.DataFrame, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, further hash, document, start) of the windows that extend a shared anchor."""
        shared = np.empty(len(self.keys), bool)
        shared[self.order] = _bits(asides, len(self.keys))
        out, more, docs, starts, at = [], [], [], [], 0
        for local, (back, n) in enumerate(zip(self.selected, self.anchor_count, strict=True)):
            if n:
                alive = np.flatnonzero(shared[at : at + n][back])
                if len(alive):
                    words = self.words(local)
                    out.append(window_hashes(words, span)[alive])
                    more.append(window_hashes(words, span, OTHER)[alive])
                    docs.append(np.full(len(alive), local, np.int64))
                    starts.append(alive)
            at += n
        if not out:
            return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(out), np.concatenate(more), np.concatenate(docs), np.concatenate(starts)


def number_words(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, their numbers end to end, each number's hash)."""
    import xxhash

    class Numbers(dict):
        def __missing__(self, word):
            self[word] = n = len(self)
            return n

    numbers, counts, codes = Numbers(), [], []
    for text in texts:
        words = split_words(text)
        counts.append(len(words))
        codes.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
    return np.array(counts, np.int64), np.concatenate(codes), np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))


def _numbers_path(path: str) -> str:
    return path + ".numbers"


def _write_numbers(path: str, counts, codes, hashes) -> None:
    rows = pa.table({k: pa.array([v.tobytes()], pa.large_binary()) for k, v in zip(("counts", "codes", "hashes"), (counts, codes, hashes), strict=True)})
    chunks.write_table(_numbers_path(path), rows)


def _load(path: str, span: int, seed: int) -> tuple[_Chunk, pa.Table]:
    table, kept = chunks.read_chunk(path), chunks.read_chunk(_numbers_path(path))
    counts, codes, hashes = (np.frombuffer(kept.column(k)[0].as_py(), t) for k, t in (("counts", np.int64), ("codes", np.uint32), ("hashes", np.uint64)))
    return _Chunk(table.column("doc_id").to_pylist(), counts, codes, hashes, span, seed), table


def _bits(asides: pd.DataFrame, n: int) -> np.ndarray:
    """The answers of a chunk's buckets, in key order, as one array of booleans."""
    rows = asides.sort_values("bucket")["answer"]
    parts = [np.unpackbits(np.frombuffer(x, np.uint8, offset=4), count=int.from_bytes(x[:4], "little")) for x in rows]
    got = np.concatenate(parts).astype(bool) if parts else np.empty(0, bool)
    if len(got) != n:
        raise ValueError(f"{len(got)} answers to {n} keys")
    return got


def _pack_bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(4, "little") + np.packbits(flags).tobytes()


def _shared(parts) -> list[bytes]:
    keys = np.concatenate([k for k, _, _ in parts])
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    flags = np.zeros(len(keys), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    ends = np.cumsum([len(k) for k, _, _ in parts])
    return [_pack_bits(x) for x in np.split(flags, ends[:-1])]


def _least_of(keys: np.ndarray, more: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each (key, more) the least id that has it."""
    order = np.lexsort((ids, keys))
    k, m = keys[order], more[order]
    same = k[1:] == k[:-1]
    if (same & (m[1:] != m[:-1])).any():  # keys that only the further bits tell apart
        order = np.lexsort((ids, more, keys))
        k, m = keys[order], more[order]
        same = (k[1:] == k[:-1]) & (m[1:] == m[:-1])
    first = np.concatenate([[True], ~same])
    least = np.empty(len(keys), np.int64)
    least[order] = ids[order][first][np.cumsum(first) - 1]
    return least


def _earlier(parts) -> list[bytes]:
    """For each chunk's distinct windows: does a document with a smaller id than the chunk's least have it?"""
    keys, ids, more = [], [], []
    for k, v, extra in parts:
        n = int.from_bytes(extra[:8], "little")
        keys.append(k)
        ids.append(np.frombuffer(extra, np.int64, n, 8)[v])
        more.append(np.frombuffer(extra, np.uint64, offset=8 + 8 * n))
    keys, ids, more = np.concatenate(keys), np.concatenate(ids), np.concatenate(more)
    flags = _least_of(keys, more, ids) < ids
    ends = np.cumsum([len(k) for k, _, _ in parts])
    return [_pack_bits(x) for x in np.split(flags, ends[:-1])]


def _distinct(chunk: _Chunk, keys: np.ndarray, more: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct windows by key and further hash, local document of least id of each, each occurrence's place among them)."""
    rank = np.empty(len(chunk.ids), np.int64)
    by_id = np.argsort(chunk.ids, kind="stable")
    rank[by_id] = np.arange(len(by_id))
    order = np.lexsort((more, keys))
    k, m = keys[order], more[order]
    first = np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])]) if len(k) else np.empty(0, bool)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(first) - 1
    least = np.full(int(first.sum()), len(by_id), np.int64)
    np.minimum.at(least, back, rank[docs])
    return k[first], m[first], by_id[least] if len(least) else least, back


def spans(flags: np.ndarray) -> list[dict]:
    """Maximal runs of set words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _repeats(docs: DataFrame, span: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(chunk pointers, answers): all that _cut needs. docs: doc_id, text and what is carried."""
    buckets = chunks.bucket_count(docs)

    def summarize(ids, texts, path):
        numbers = number_words(texts)
        _write_numbers(path, *numbers)
        c = _Chunk(ids, *numbers, span, seed)
        return c.keys, c.owner, b""

    store = chunks.build(docs, summarize, "substring")
    points = chunks.pointers(store)
    seeds = stage(chunks.ask(chunks.packed(store), _shared), "substring-seeds")
    drop_stage(store)

    def extend(chunk, path, summary, asides):
        c, _ = _load(path, span, seed)
        keys, more, where, _ = c.windows(asides, span)
        keys, more, least, _ = _distinct(c, keys, more, where)
        at, rows = chunks.cuts(keys, buckets), []
        for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if j > i:  # ids are sent once a bucket, for the documents that its windows name
                named, owner = np.unique(least[i:j], return_inverse=True)
                ids = c.ids[named]
                extra = len(ids).to_bytes(8, "little") + ids.tobytes() + more[i:j].tobytes()
                rows.append((chunk, b, chunks.encode_keys(keys[i:j]), len(extra).to_bytes(4, "little") + extra + owner.astype(np.uint16).tobytes()))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "keys", "vals"])

    windows = chunks.ask(chunks.visit(points, seeds, extend, chunks.PACKED), _earlier)
    return points, seeds.withColumn("kind", F.lit("seed")).unionByName(windows.withColumn("kind", F.lit("window")))


def _cut(path: str, answers: pa.Table, span: int, seed: int) -> tuple[pa.Table, list[tuple[int, int, list[dict], str | None]]]:
    """The chunk's rows, and for each its words, removed words, maximal repeats and what is left of the text."""
    asides = answers.to_pandas()
    c, table = _load(path, span, seed)
    keys, more, where, starts = c.windows(asides[asides["kind"] == "seed"], span)
    keys, more, least, back = _distinct(c, keys, more, where)
    earlier = _bits(asides[asides["kind"] == "window"], len(keys))
    gone = earlier[back] | (c.ids[least][back] < c.ids[where]) if len(back) else np.empty(0, bool)
    where, starts = where[gone], starts[gone]
    ends = np.searchsorted(where, np.arange(len(c.ids) + 1))
    column, out = table.column("text"), []
    for local, n in enumerate(c.counts.tolist()):
        a, b = ends[local], ends[local + 1]
        text = column[local].as_py()
        if a == b:
            out.append((n, 0, [], text))
            continue
        words, step = split_words(text), np.zeros(n + 1, np.int32)
        np.add.at(step, starts[a:b], 1)
        np.add.at(step, starts[a:b] + span, -1)
        removed = np.cumsum(step[:-1]) > 0
        kept = b" ".join([w for w, r in zip(words, removed.tolist(), strict=True) if not r]).decode("utf-8", "surrogatepass")
        out.append((n, int(removed.sum()), spans(removed), kept))
    return table, out


def dedup(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, removed (the maximal repeats, as word spans), kept_text of each row of docs.

    kept_text: the text itself if nothing goes, else the kept words joined by one space.
    """
    points, answers = _repeats(documents(docs), span, seed)
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string")
    arrow = to_arrow_schema(schema)

    def rows(chunk, path, summary, asides):
        table, out = _cut(path, asides, span, seed)
        columns = list(zip(*out, strict=True))
        return pa.table([table.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, arrow.types[1:], strict=True))], names=arrow.names)

    return chunks.visit_rows(points, answers, rows, schema)


@whole_rows
def without_repeats(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns, texts without their repeats; rows of which nothing is left go. n_chars follows the text."""
    points, answers = _repeats(docs, span, seed)

    def rows(chunk, path, summary, asides):
        table, out = _cut(path, asides, span, seed)
        cut = np.array([r > 0 for _, r, _, _ in out])
        texts = [t for *_, t in out]
        at = table.schema.get_field_index("text")
        table = table.set_column(at, table.schema.field(at), pa.array(texts, table.schema.field(at).type))
        if (at := table.schema.get_field_index("n_chars")) >= 0 and cut.any():
            old, field = table.column(at).to_pylist(), table.schema.field(at)
            table = table.set_column(at, field, pa.array([len(t) if c else n for t, c, n in zip(texts, cut, old, strict=True)], field.type))
        return table.filter(pa.array([not r or r < n for n, r, _, _ in out]))

    return chunks.visit_rows(points, answers, rows, docs.schema)


def kept_digest(text: str) -> str:
    """SHA-256 of the words of a text joined by one space."""
    return hashlib.sha256(b" ".join(split_words(text))).hexdigest()
