"""Quality: held-out labels, a plain scorer of one text, attention, cases."""

import math

import numpy as np
import pyarrow as pa

from shotspark.llm import op13_quality as Q
from tests.conftest import SF_SMALL


def corpus(n=240, seed=2):
    """Good texts; bad ones have one bad passage (marks behind words) among good ones."""
    rng = np.random.default_rng(seed)
    words = ["stone", "river", "Walk", "of", "the", "and", "meadow.", "light,", "under", "seven"]
    texts, labels = [], []
    for k in range(n):
        parts = [list(rng.choice(words, 64)) for _ in range(int(rng.integers(1, 6)))]
        if k % 3 == 0:
            parts[int(rng.integers(len(parts)))] = [w + "$#" for w in rng.choice(words, 64)]
        texts.append(" ".join(w for p in parts for w in p)), labels.append(int(k % 3 != 0))
    return texts, labels


def plain_score(text: str, m: Q.Model) -> float:
    """The method in plain Python, a byte and a word at a time."""
    words, now = [], []
    for b in (text or "").encode() + b" ":
        if b in b" \t\n\x0b\x0c\r":
            words += [bytes(now)] if now else []
            now = []
        else:
            now.append(b)
    raw, at, bags = (text or "").encode(), 0, []
    for a in range(0, len(words), Q.PASSAGE):
        some = words[a:a + Q.PASSAGE]
        start = None
        for w in some:
            at = raw.index(w, at)
            start = at if start is None else start
            at += len(w)
        span = raw[start:at]
        x = [0.0] * Q.FEATURES
        for b in span:
            x[Q._FINE[b]] += 1 / len(span)
        for b, c in zip(span, span[1:]):
            x[Q.N_FINE + Q._COARSE[b] * 7 + Q._COARSE[c]] += 1 / max(len(span) - 1, 1)
        x = [math.sqrt(v) for v in x]
        low = [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in some]
        mean = sum(map(len, some)) / len(some)
        x[-4:] = [len(set(low)) / len(some), sum(a == b for a, b in zip(low, low[1:])) / len(some), math.log1p(mean),
                  math.log1p(math.sqrt(max(sum(len(w) ** 2 for w in some) / len(some) - mean ** 2, 0)))]
        bags.append(x)
    bags = bags or [[0.0] * Q.FEATURES]
    p, logits, hidden = m.p, [], []
    for x in bags:
        h = np.tanh((np.array(x) - m.mean) / m.scale @ p["W"] + p["b"])
        gate = np.tanh(h @ p["V"] + p["bV"]) / (1 + np.exp(-(h @ p["U"] + p["bU"])))
        logits.append(gate @ p["w"]), hidden.append(h)
    a = np.exp(np.array(logits) - max(logits))
    z = (a[:, None] * np.array(hidden)).sum(axis=0) / a.sum()
    return 1 / (1 + math.exp(-(z @ p["c"] + m.bias)))


def test_scores_against_a_plain_scorer():
    texts, labels = corpus()
    model = Q.fit(texts, labels, steps=80)
    probe = texts[:12] + ["", None, " \n ", "one", "Ünï cödé wörds " * 90, "A a A a\n" * 70, texts[0] * 40]
    got = Q.scores(pa.array(probe, pa.large_string()), model)
    assert np.allclose(got, [plain_score(t, model) for t in probe], atol=1e-7)
    alone = [Q.scores(pa.array([t], pa.large_string()), model)[0] for t in probe]
    assert (got == alone).all()


def test_attention_finds_the_bad_passage():
    """One bad passage decides: attention finds it, and held-out bags are told apart."""
    texts, labels = corpus(360)
    model = Q.fit(texts[:240], labels[:240])
    got = Q.scores(pa.array(texts[240:], pa.large_string()), model) >= 0.5
    assert np.mean(got == np.array(labels[240:], bool)) > 0.95
    bad = next(t for t, y in zip(texts, labels) if y == 0 and len(t.split()) > 200)
    x, doc = next(Q.passages(pa.array([bad], pa.large_string())))
    weight = Q._softmax(model.encode(x)[3], doc, 1)
    marked = ["$#" in " ".join(bad.split()[k:k + 64]) for k in range(0, len(bad.split()), 64)]
    assert weight[marked.index(True)] > 1 / len(marked)


def test_held_out_recall_and_precision(spark):
    sf = SF_SMALL.replace("sf0.001", "sf0.1")
    out = Q.op13_quality(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = (out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and quality in (0, 1)").collect())
    low, found = sum(r.quality == 0 for r in rows), sum(r.predicted == 0 for r in rows)
    right = sum(r.quality == r.predicted == 0 for r in rows)
    print(f"held out {len(rows)}: low quality found {right}/{low}, rightly {right}/{found}")
    assert low > 100 and right / low > 0.95 and right / found > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_cases(spark):
    texts, labels = corpus(90)
    model = Q.fit(texts, labels, steps=60)
    df = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (3, texts[0], "p"), (3, texts[0], "p"),
                                (None, "stone river " * 200_000, "p")], "doc_id long, text string, score string")
    out = Q.score_texts(df, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    rows = out.collect()
    assert rows[0].score == rows[1].score and rows[2] == rows[3] and len(rows) == 5
    assert Q.score_texts(df.limit(0), model).count() == 0


def test_one_class_or_no_label(spark):
    docs = spark.createDataFrame([(1, "a"), (7, "b"), (7, None)], "doc_id long, text string")
    for labels, want in (([(1, None)], 0.5), ([], 0.5), ([(7, 1), (3, 1)], 1.0), ([(7, 0)], 0.0)):
        m = Q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert [r.score for r in Q.score_texts(docs, m).collect()] == [want] * 3
