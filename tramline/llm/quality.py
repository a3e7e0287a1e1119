"""Quality rules by distribution divergence.

Two histograms of a document are held against a reference of its language: character classes, and the
language's common words (anything else is one more bin). The reference is the same histogram over all
documents of that language. Classes follow Unicode: "lower" are all letters that aren't upper case, with
marks; "sentence" punctuation, "other" controls and what isn't assigned. The divergence is the Jensen-Shannon distance (square root of the
divergence in bits, 0 to 1). A histogram of little text says nothing: below `min_chars` characters or
`min_words` words the distance isn't judged.

Common words are the TOP_WORDS most frequent of all words; at equal counts, the lesser in byte order. A task
holds at most about FLUSH counts and sends them on as partial rows; Spark sums those. Every language has its
own reference, however few or many its documents: one alone in its language is at distance 0. References are
a table that joins the documents; none comes to the driver. A language without one isn't judged by distance.
Null text: no words. Null language: a language of its own. Repeated rows count and are judged as often as they
stand there; other columns, whatever their names, are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import split_words, stage, window_hashes

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
CLASSES = ("lower", "upper", "digit", "space", "sentence", "symbol", "other")
TOP_WORDS, FLUSH, FLUSH_CHARS, MEMO = 40, 200_000, 1 << 26, 1000
WINDOW = 8
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double, base_failed boolean, kept boolean"


@lru_cache(1)
def class_table() -> np.ndarray:
    """The number in CLASSES of every code point."""
    import sys
    import unicodedata

    of = {"Lu": "upper", "Lt": "upper", "L": "lower", "M": "lower", "N": "digit", "Z": "space", "P": "sentence", "S": "symbol"}
    numbers = {c: i for i, c in enumerate(CLASSES)}
    kind = [unicodedata.category(chr(i)) for i in range(sys.maxunicode + 1)]
    table = np.array([numbers[of.get(k, of.get(k[0], "other"))] for k in kind], np.uint8)
    for c in map(chr, range(33, 127)):  # of ASCII punctuation, only what prose is written with counts as such
        if not c.isalnum():
            table[ord(c)] = numbers["sentence" if c in ".,;:'\"?-()" else "symbol"]
    table[[ord(c) for c in SPACES]] = numbers["space"]
    return table


def char_classes(text: str) -> np.ndarray:
    """Counts of CLASSES over the code points of text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(class_table()[code], minlength=len(CLASSES)).astype(float)


def word_bins(words: list[bytes], common: dict[bytes, int]) -> np.ndarray:
    """Counts of the common words, then of all others."""
    size = len(common)
    return np.bincount(np.fromiter((common.get(w, size) for w in words), np.int64, len(words)), minlength=size + 1).astype(float)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda a: float((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum())
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def repeated_words(words: list[bytes]) -> int:
    """Words in WINDOW-word windows found twice or more in the text, the first included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n)
    hashes = window_hashes(ids + np.uint64(1), WINDOW)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(hashes), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """\\n-split lines with a word, equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))


def language_references(docs: DataFrame) -> DataFrame:
    """reference_lang, reference of each language; see parse_reference. All words of all documents count."""

    def tally(batches):
        chars, words, total = {}, {}, Counter()
        held = read = 0

        def flush():
            rows = [(lang, "t", b"", n) for lang, n in total.items()]
            rows += [(lang, "c", b"%d" % i, int(n)) for lang, c in chars.items() for i, n in enumerate(c)]
            rows += [(lang, "w", w, n) for lang, c in words.items() for w, n in c.items()]
            for x in (chars, words, total):
                x.clear()
            for at in range(0, len(rows), 50_000):
                part = list(zip(*rows[at : at + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.string()), pa.array(part[2], pa.binary()), pa.array(part[3], pa.int64())], ["lang", "kind", "item", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = split_words(text)
                total[lang] += len(found)
                chars[lang] = chars.get(lang, 0) + char_classes(text)
                if lang not in words:
                    words[lang] = Counter()
                    held += len(CLASSES) + 1
                held -= len(words[lang])
                words[lang].update(found)
                held += len(words[lang])
                read += len(text)
                if held > FLUSH or read > FLUSH_CHARS:
                    yield from flush()
                    held = read = 0
        yield from flush()

    from pyspark.sql import Window as W

    counts = _rows(docs).mapInArrow(tally, "lang string, kind string, item binary, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))
    line = F.concat("kind", F.col("item").cast("string"), F.lit(" "), F.col("n").cast("string"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= TOP_WORDS).select(F.col("lang").alias("reference_lang"), F.struct("kind", "rank", line.alias("line")).alias("x"))
    lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])
    # its size is known before the join is planned
    return stage(top.groupBy("reference_lang").agg(F.array_join(lines, "\n").alias("reference")), "references")


def parse_reference(packed: str | None) -> tuple[np.ndarray, dict[bytes, int], np.ndarray]:
    """(character-class counts, common words -> bin, their counts and that of all others); all 0 without a reference.

    A line is c, t or w for a class, the number of words or a common word, then its name, a space and a count.
    """
    chars, common, freq, total = np.zeros(len(CLASSES)), {}, [], 0
    for line in packed.split("\n") if packed else ():
        item, n = line[1:].rsplit(" ", 1)
        if line[0] == "c":
            chars[int(item)] = int(n)
        elif line[0] == "t":
            total = int(n)
        else:
            common[item.encode("utf-8", "surrogatepass")] = len(common)
            freq.append(int(n))
    return chars, common, np.array([*freq, total - sum(freq)], float)


def judge(docs: DataFrame, references: DataFrame | None = None, max_char_distance: float = 0.25, max_word_distance: float = 0.4, min_chars: int = 200, min_words: int = 40) -> DataFrame:
    """Statistics, distances and verdict of each row."""
    references = language_references(docs) if references is None else references

    def run(batches):
        memo: dict = {}
        for batch in batches:
            out = []
            for doc_id, text, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = split_words(text)
                n = len(words)
                if packed not in memo:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[packed] = parse_reference(packed)
                chars, common, freq = memo[packed]
                repeat = repeated_words(words)
                dc = js_distance(char_classes(text), chars) if packed and len(text) >= min_chars else None
                dw = js_distance(word_bins(words, common), freq) if packed and n >= min_words else None
                failed = n < 20 or 100 * repeat > 30 * n
                kept = not failed and not (dc is not None and dc > max_char_distance) and not (dw is not None and dw > max_word_distance)
                out.append((doc_id, n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeat, dc, dw, failed, kept))
            columns = list(zip(*out, strict=True)) or [()] * 10
            kinds = [pa.int64()] * 6 + [pa.float64()] * 2 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    joined = _rows(docs).join(references, F.col("lang").eqNullSafe(F.col("reference_lang")), "left")
    return joined.select("doc_id", "text", "reference").mapInArrow(run, SCHEMA)
