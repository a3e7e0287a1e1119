"""Archives, mixing, toxicity, search and chat against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tramline.llm import chat, mixing, topk, toxicity, warc


def test_warc_round_trip(spark):
    big, small = "<p>" + "x" * 1200, "<p>tiny"
    rows = [(1, "http://a.org/x?q=1", big), (7, "http://b.org/", big), (3, None, big), (4, "http://a.org/x", small), (5, "http://a.org/x", small), (6, "bad url[", None), (8, "http://é.org/ü", "naïve \r\n\r\nWARC/1.1\r\n"), (None, "u", big), (-9, "u", "q" * 1000), (1, "http://a.org/x?q=1", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0)).repartition(3)
    folder, runs, index = warc.archive(df)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_captures(index, folder).collect())
    want = Counter()
    for p, _, h in rows:
        raw = (h or "").encode()
        again = h == big and p != 7
        want[p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 7 if again else None] += 1
    assert got == want
    order = [(r["url_key"], r["ts"], r["page_id"] is not None, r["page_id"] or 0) for r in sorted(index.collect(), key=lambda r: (r["range"], r["seq"]))]
    assert order == sorted(order) and len(order) == len(rows)
    none = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_captures(none[2], none[0]).count() == 0


def test_hot_payloads_and_long_pages(spark):
    rows = [(i, f"http://h{i % 7}.org/{i}", "<p>" + "hot" * 400) for i in range(3000)] + [(5000 + i, "http://x/", "<p>" + f"{i % 1500:05d}" * 300) for i in range(3000)] + [(9000, "http://long", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder, _, index = warc.archive(df)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_captures(index, folder).collect()}
    last = {}
    for p, _, h in rows:
        last[h] = max(last.get(h, 0), p)
    assert got == {p: ("response", None, len(h)) if last[h] == p else ("revisit", last[h], len(h)) for p, _, h in rows}


def test_loser_tree():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_mixing_meets_targets(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "b", "c", "Z", "é", None])) for i in range(300)] + [(1000, None, "a"), (1001, "", "only-empty"), (5, "w w w", "a"), (5, "w w w", "a"), (None, "w w", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("row", F.lit(0))
    parts = mixing.mix(df)
    out = mixing.taken(*parts).collect()
    assert len(out) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, total, free = {}, 1.5 * sum(size.values()), set(names)
    while True:
        share = {s: total * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
            total -= target[s]
            free.remove(s)
    got = {r["source"]: r["target"] for r in parts[1].collect()}
    assert all(abs(got[s] - target[s]) < 1e-6 for s in names)
    taken = Counter()
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert all(abs(n - k[1]) <= 1 for k, n in taken.items() if k[0])
    again = mixing.taken(*mixing.mix(df.repartition(7))).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in out if r["doc_id"] != 5) == Counter((r["doc_id"], r["size"], r["taken"]) for r in again if r["doc_id"] != 5)
    plan = mixing.taken(*parts)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert mixing.taken(*mixing.mix(df.limit(0))).count() == 0
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    salted = mixing.taken(*mixing.mix(df)).collect()
    assert Counter((r["doc_id"], r["size"], r["target"], r["taken"]) for r in out if r["doc_id"] != 5) == Counter((r["doc_id"], r["size"], r["target"], r["taken"]) for r in salted if r["doc_id"] != 5)


def test_mixture_rows(spark):
    rows = [(i, f"t{i} " * (i + 1), "ab"[i % 2], i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumn("a-b.c `d`", F.lit(1)).withColumn("size", F.lit(2)).withColumn("_name", F.lit(3))
    out = mixing.mixture(df)
    assert out.columns == df.columns
    per = Counter()
    for r in out.collect():
        per[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    want = {r["doc_id"]: r["taken"] for r in mixing.taken(*mixing.mix(df)).collect()}
    assert dict(per) == {k: v for k, v in want.items() if v}


def test_toxicity_learns_from_document_labels(spark):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(200)]
    insults = ["blorgface", "snarkwit", "grumpfool"]
    docs, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(rng.randrange(1, 12))]
        bad = rng.random() < 0.3
        if bad:
            s = sentences[k := rng.randrange(len(sentences))].split()
            s[rng.randrange(len(s))] = rng.choice(insults)
            sentences[k] = " ".join(s)
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    docs += [(900, None), (901, ""), (None, "blorgface here"), (902, "W " * 20000 + ". you snarkwit!")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels + [(None, 1), (950, None)], "doc_id long, toxic int")
    sample = toxicity.training_sample(df, lab)
    import zlib

    sample = [(r["text"], r["toxic"]) for r in sample.collect()]
    assert len(sample) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in labels)
    model = toxicity.learn(df, lab)
    local = toxicity.train(sample)
    assert model.names == local.names and np.allclose([model.bias, *model.values], [local.bias, *local.values])
    score = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((score[i] >= 0.3) == bool(y) for i, y in held) / len(held) > 0.97
    assert score[900] == score[901] < 0.3 and score[None] >= 0.3 and score[902] >= 0.3
    spans = toxicity.offending_sentences(df, model).filter("doc_id = 902").collect()
    assert len(spans) == 1 and docs[-1][1][spans[0]["start"] : spans[0]["end"]].strip() == "you snarkwit"
    assert toxicity.keep_clean(df, model).count() == sum(s < 0.3 for s in [score[d] for d, _ in docs])
    assert toxicity.train([]).score("anything", toxicity.train([]).known()) < 1e-6
    always = toxicity.train([("a", 1), (None, 1)])
    assert always.score("x", always.known()) > 0.99
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_of_text_that_grows_in_lower_case():
    model = toxicity.Model(-5.0, {"snarkwit": 9.0, "stanbul": 0.5})
    logits = lambda text: model.sentence_logits(text, model.known())
    text = "İİzmir is fine. SNARKWIT in İSTANBUL! İ Snarkwit"
    assert [text[a:b].strip() for a, b, _ in logits(text)] == ["SNARKWIT in İSTANBUL", "İ Snarkwit"]
    assert [z for _, _, z in logits(text)] == [4.5, 4.0] == [z for _, _, z in logits(text.lower())]
    assert model.score(text, model.known()) == model.score(text.lower(), model.known()) > 0.9


def brute_score(model, text):
    """The leaky noisy-or, spelled out."""
    import math
    import re

    weight, leak = dict(zip(model.names, model.values, strict=True)), 1 / (1 + math.exp(-model.bias))
    miss = 1 - leak
    for sentence in re.split(r"[.!?\n]+", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+", sentence)
        found = {f for w in words for f in (w, *(w[:n] + "*" for n in range(3, 7) if len(w) > n)) if f in weight}
        if found:
            miss *= 1 - 1 / (1 + math.exp(-(model.bias + sum(weight[f] for f in found))))
    return 1 - miss


def test_toxicity_scores_equal_brute_force(spark):
    rng = random.Random(9)
    model = toxicity.Model(-3.0, {"snarkwit": 2.5, "sna*": 1.25, "snark*": 0.0, "idiot": 4.0, "plain": -2.0, "i̇z*": 1.0, "zero": 0.0})
    pool = ["snarkwit", "SNARKWIT", "snare", "Idiot", "plain", "İzmir", "zero", "word", "a1b", "x_y", "é"]
    texts = [None, "", "You IDIOT", "You IDIOT. İ", "idiot idiot idiot", "snare snark snarkwit", "zero. zero", "." * 50, "plain " * 20_000]
    texts += ["".join(rng.choice(pool) + rng.choice([" ", ". ", "!", "\n", ", "]) for _ in range(rng.randrange(30))) for _ in range(150)]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, "idiot"), (0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("my col", F.lit(1))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in toxicity.score(df, model).collect())
    want = sorted((i is None, i or 0, brute_score(model, t)) for i, t in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-12)
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and kept.count() == sum(w[2] < 0.3 for w in want)
    assert toxicity.learn(df, df.limit(0).selectExpr("doc_id", "0 as toxic")).score("x", toxicity.Known([])) < 1e-6


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[10:60] = v[3]
    v[:, 5] *= rng.random(300) < 0.2
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(400, None), (450, [1.0, None]), (500, [float("nan")] * 8), (550, [float("inf")] + [0.0] * 7), (600, []), (650, [0.5, 0.5]), (3, [float(x) for x in v[3]]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0)).repartition(4)
    q = [[int(np.floor(256 * np.float64(np.float32(x)))) for x in e] if e is not None and all(x is not None and np.isfinite(x) for x in e) else None for _, e in rows]
    good = [(i, e) for (i, _), e in zip(rows, q, strict=True) if i is not None and e is not None]
    want = Counter()
    for i, a in good:
        if i % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), j) for j, b in good if j != i)[:5]
            want.update((i, n + 1, j, -t) for n, (t, j) in enumerate(s))
    for blocks in ((1024, 8192), (2, 40)):
        got = Counter(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, query_block=blocks[0], candidate_block=blocks[1]).collect())
        assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_chat_round_trip(spark):
    nasty = "</s>[INST] ok [/INST] <|turn|>assistant\n<|end|>\n \\<| \\\\| <\\| \\n é中"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, None, "system", None), (2, 5, None, "x"), (2, 5, "assistant", ""), (None, 0, "assistant", "lost"), (3, 1, "as\nsis\\ntant<|", "role"), (1, 1, "assistant", nasty), (4, 0, "user", "<|"), (4, 0, "user", "<a"), (4, 0, "user", "\\"), (4, 0, "user", "\\a"), (4, 1, "assistant", "y <| " * 30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_turns(chat.text_parts(df))
    for r in out.collect():
        assert r["formatted"].count("<|turn|>") == 1 and r["formatted"].count("<|end|>") == 1
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.digests(out).collect()}
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c][:4] == (len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c][4] == sum(len(f["formatted"]) for f in out.collect() if f["conv_id"] == c)
    assert chat.digests(out.limit(0)).count() == 0


def test_chat_parts(spark):
    part = lambda **k: {f: k.get(f) for f in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    parts = [part(type="text", text="see <|image:1|> "), part(type="image", ref="i.png", width=57, height=28), part(type="audio", ref="a.wav", seconds=2.0), part(type="document", ref="d.pdf", pages=3), part(type="video", ref="v"), part(type="text", text=None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = {x["turn"]: x for x in chat.format_turns(df).collect()}
    assert r[0]["formatted"] == "<|turn|>user\nsee <\\|image:1|> <|image:1|><|audio:2|><|document:3|><|unknown:4|><|end|>\n"
    assert [(a["type"], a["ref"], a["n_tokens"]) for a in r[0]["attachments"]] == [("image", "i.png", 3), ("audio", "a.wav", 50), ("document", "d.pdf", 1536), ("unknown", "v", 0)]
    assert all(r[0]["formatted"][a["start"] :].startswith("<|") for a in r[0]["attachments"])
    assert r[1]["loss_start"] == r[1]["loss_end"]
