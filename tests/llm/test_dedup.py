"""Jaccard join and substring dedup against brute force, with every path of the join taken."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import ngram_join, queries_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_corpus(seed=3, base=14, copies=8):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    rows = []
    for b in range(base):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([5, 9, 60, 120]))]
        if b % 3 == 0:
            text[len(text) // 2 : len(text) // 2] = passage
        for c in range(rng.randrange(1, copies)):
            t = list(text)
            for _ in range(c % 4):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append(" ".join(t).title() if c % 5 == 4 else " ".join(t))
    rows += ["one two three", "One TWO three", "", None, "  \n", "one two three four", rows[0], "ab\x85cd ef gh ij kl", "x " * 5000]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)] + [(None, rows[0]), (1, rows[0]), (None, "alone with no id at all here")]


def words(text):
    return WORD.findall(text or "")


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("block,small", [(1 << 20, 1 << 29), (1 << 20, 0), (150, 0)])
def test_jaccard_join(spark, block, small):
    rows = make_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("chunk", F.lit(0)).repartition(5)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(df, block, 4000, small).collect())
    assert got == brute_components(rows)


def test_keep_first_keeps_one_of_each(spark):
    rows = [(5, "a b c d e f g h"), (2, "a b c d e f g h"), (9, "q w e r t y u i"), (7, ""), (8, None), (2, "a b c d e f g h")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    out = ngram_join.keep_first(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["text"]) == [(2, "a b c d e f g h"), (9, "q w e r t y u i")]
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 7, 8, 9]


def drifting(n, seed=1):
    """Chains of texts that drift away from their start: links across regions, boundary sets, several rounds."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        t = [f"c{c}w{rng.randrange(50)}" if rng.random() < 0.7 else f"w{rng.randrange(30)}" for _ in range(60)]
        for _ in range(14):
            t = list(t)
            for _ in range(rng.choice([0, 1, 1, 2])):
                t[rng.randrange(len(t))] = f"c{c}x{rng.randrange(9)}"
            rows.append(" ".join(t))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block,small", [(1 << 20, 1 << 29), (1 << 20, 0), (300, 0)])
def test_jaccard_join_of_chains(spark, block, small):
    rows = drifting(9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(df, block, 1 << 20, small).collect())
    assert got == brute_components(rows)


def test_join_region_links_across_balls():
    rng = np.random.default_rng(0)
    for _ in range(20):
        base = rng.choice(10_000, 40, replace=False)
        sets = []
        for _ in range(25):  # a chain that drifts away from its start
            base = base.copy()
            base[rng.integers(0, 40, 3)] = rng.choice(10_000, 3) + 10_000
            sets.append(np.unique(base))
        up = ngram_join.Union()
        for i, j in ngram_join.join_region(sets):
            up.join(i, j)
        want = ngram_join.Union()
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if ngram_join.linked(both, len(sets[i]), len(sets[j])):
                    want.join(i, j)
        assert [up.find(i) for i in range(25)] == [want.find(i) for i in range(25)]


def brute_removed(rows):
    first = {}
    key = lambda d: 2**63 - 1 if d is None else d
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, key(d)), key(d))
    out = Counter()
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < key(d):
                gone[i : i + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("chunk", [1 << 24, 2000])
def test_substring_dedup(spark, chunk, monkeypatch):
    rows = make_corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).repartition(3)
    df.createOrReplaceTempView("unused")
    build = substring_dedup.chunks.build
    monkeypatch.setattr(substring_dedup.chunks, "build", lambda d, f, n, b=chunk: build(d, f, n, chunk))
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p, **k: df if p[0].endswith("documents.parquet") else self.format("parquet").load(list(p)))
    got = Counter(tuple(r) for r in queries_dedup.op5_substring_dedup(spark, "").collect())
    assert got == brute_removed(rows)


def test_winnowed_anchor_depends_on_the_window_alone():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 2**63, 13).astype(np.uint64)
    picks = set()
    for _ in range(30):
        before, after = (rng.integers(0, 2**63, rng.integers(0, 20)).astype(np.uint64) for _ in range(2))
        runs, at = substring_dedup.anchors(np.concatenate([before, passage, after]))
        picks.add(int(runs[at[len(before)]]))
    assert len(picks) == 1


def test_dedup_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.dedup(none).count() == 0
    assert ngram_join.jaccard_join(none).count() == 0
    assert ngram_join.keep_first(none).count() == 0


def test_columns_of_any_name_are_carried(spark):
    said = " ".join(f"p{i}" for i in range(30))
    rows = [(5, f"{said} five", 1), (2, f"two {said}", 2), (9, "q w e r t y u i", 3), (2, f"two {said}", 4), (None, said, 5), (7, None, 6), (8, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    for i, name in enumerate(("my col", "n_words", "removed", "kept_text", "chunk", "a-b.c", "n", "cls", "Ünï`code", "local", "answer")):
        df = df.withColumn(name, F.lit(i) if i % 2 else F.array(F.struct(F.lit(i).alias("x y"))))
    first = ngram_join.keep_first(df)
    assert first.schema == df.schema and sorted((r["doc_id"] or -1) for r in first.collect()) == [2, 7, 8, 9]
    cut = substring_dedup.without_repeats(df)
    assert cut.schema == df.schema
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_chars"], r["n_words"]) for r in cut.collect()), key=repr)
    want = [(2, f"two {said}", 2, 1), (2, f"two {said}", 4, 1), (5, "five", 4, 1), (9, "q w e r t y u i", 3, 1), (7, None, 6, 1), (8, "", 7, 1)]
    assert got == sorted(want, key=repr)  # all words of the row without an id stand in a smaller one
    assert substring_dedup.without_repeats(df.limit(0)).count() == ngram_join.keep_first(df.limit(0)).count() == 0


def test_windows_of_one_key_are_told_apart():
    key = np.array([7, 7, 7, 3], np.uint64)
    more = np.array([1, 2, 1, 1], np.uint64)
    assert substring_dedup._least_of(key, more, np.array([5, 2, 4, 9])).tolist() == [4, 2, 4, 9]


def test_repeats_are_maximal(spark):
    rng = random.Random(5)
    say = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    a, b = say(40), say(12)
    rows = [(1, " ".join(say(9) + a + say(9) + b)), (2, " ".join(say(20) + a[3:] + say(5) + b)), (3, " ".join(a[:13] + say(1) + a[14:30]))]
    out = {r["doc_id"]: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = {i: [(s["start"], s["end"]) for s in r["removed"]] for i, r in out.items()}
    assert spans == {1: [], 2: [(20, 57)], 3: [(0, 13), (14, 30)]}  # 12 words are too few
