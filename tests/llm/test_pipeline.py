"""The pipeline's stages, each against brute force over its own input."""

import random
import re
from collections import Counter

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tramline.llm import byte_bpe


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(500)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = say(60)
    texts = [say(rng.randrange(20, 120)) for _ in range(150)]
    texts += [texts[0], texts[1], texts[2] + " tail", None, "", "short one"]
    texts += [f"{say(30)} {passage} {say(30)}" for _ in range(6)]
    toxic = [f"{say(12)}. you {rng.choice(['blorgface', 'snarkwit'])} {say(3)}. {say(9)}" for _ in range(40)]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", "c"]), len(t or "")) for i, t in enumerate(texts + toxic)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bad = set(range(len(texts), len(rows)))
    spark.createDataFrame([(i, 1, int(i in bad)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "mixing", "byte_bpe"]
    at, outs = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        outs.append({**{"name": name}, "rows": at.collect(), "columns": at.columns})
        if i < 4:
            assert set(at.columns) == set(docs.columns)
    clean = {r["doc_id"] for r in outs[0]["rows"]}
    assert len(bad & clean) <= 2 and len(set(range(len(texts))) - clean) <= 2
    kept = {r["doc_id"] for r in outs[1]["rows"]}
    assert kept <= clean and {150, 151, 152} & kept == set()
    dedup = {r["doc_id"]: r for r in outs[2]["rows"]}
    holders = sorted(i for i in kept if passage in (rows[i][1] or ""))
    assert [passage in dedup[i]["text"] for i in holders] == [True] + [False] * (len(holders) - 1)
    for i in kept - set(holders):
        assert dedup[i]["text"] == rows[i][1] and dedup[i]["source"] == rows[i][3]
    mixed = Counter()
    for r in outs[3]["rows"]:
        mixed[r["doc_id"]] += len(words(r["text"]))
    assert abs(sum(mixed.values()) - 1.5 * sum(len(words(r["text"])) for r in outs[2]["rows"])) <= 3
    assert all(n <= 2 * len(words(dedup[i]["text"])) for i, n in mixed.items())
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in outs[4]["rows"]) == Counter((r["doc_id"], tuple(enc.encode_ordinary(r["text"])), r["text"]) for r in outs[3]["rows"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(outs[4]["rows"])


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated ids, a very long text, columns that clash, and no rows at all."""
    rng = random.Random(2)
    say = lambda n: " ".join(f"o{rng.randrange(10**6)}" for _ in range(n))
    long = say(120_000)
    rows = [(1, say(30), "en", "a", 7), (1, say(30), None, None, None), (None, say(30), "en", "a", 1), (2, None, None, "b", None), (3, "", "de", "b", 0), (4, long, "de", "a", len(long)), (5, say(5), "en", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = ("my col", "a.b", "n_words", "removed", "kept_text", "size", "row", "score", "chunk", "cls", "ids", "docs")
    for i, name in enumerate(odd):
        docs = docs.withColumn(name, F.lit(i))
    spark.createDataFrame([(1, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table, n in ((docs, len(rows)), (docs.limit(0), 0)):
        for name, step in corpus_pipeline.STAGES[1:4]:
            out = step(spark, table, str(tmp_path))
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            got = out.collect()
            if name != "mixing":  # nothing here is a copy, all rows stay as they are
                assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in table.collect())
            assert all(r["n_words"] == 2 and r["a.b"] == 1 for r in got) and bool(got) == bool(n)
        assert corpus_pipeline.remove_toxic(spark, table, str(tmp_path)).columns == docs.columns
        assert corpus_pipeline.to_tokens(spark, table, str(tmp_path)).count() == n
    # the results of one stage don't depend on what is run beside it
    a = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path))
    corpus_pipeline.cut_repeats(spark, docs, str(tmp_path))
    assert a.count() == len(rows)
