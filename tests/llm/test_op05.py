"""Toxicity: held-out accuracy, the effect of counterfactuals, cases."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from shotspark.llm import op05_toxicity as X
from shotspark.llm import wordsets as W
from tests.conftest import SF_SMALL


def corpus(n=600, seed=4):
    """Insults are toxic; in the sample toxic texts also name a group often."""
    rng = np.random.default_rng(seed)
    words = [f"word{k}" for k in range(300)]
    texts, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        t = list(rng.choice(words, 40))
        if toxic:
            t[3:3] = list(rng.choice(["vilename", "slurword", "badword"], 2))
        if rng.random() < (0.7 if toxic else 0.05):
            t[10] = "muslims"
        texts.append(" ".join(t)), labels.append(int(toxic))
    return texts, labels


def test_counterfactuals_lower_the_weight_of_a_mention():
    texts, labels = corpus()
    plain, fair = X.fit(texts, labels, strength=0.0), X.fit(texts, labels, strength=5.0)
    probe = pa.array(["word1 word2 muslims word3", "word1 word2 hindus word3", "word1 vilename slurword word2"], pa.large_string())
    gap = lambda m: abs(np.diff([X.scores(probe, m)[1], X.scores(probe, m)[0]])[0])
    assert gap(fair) < 0.5 * gap(plain) and X.scores(probe, fair)[0] < 0.5 < X.scores(probe, fair)[2]


def test_swaps():
    pairs = X.counterfactuals(["The women, they sang", "nothing here"])
    assert ("The women, they sang", "The men, they sang") in pairs
    assert not any(a == "nothing here" for a, _ in pairs)


def test_held_out_accuracy_and_query(spark):
    out = X.op5_toxicity(spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    known = out.join(spark.read.parquet(f"{SF_SMALL}/labels.parquet"), "doc_id").where("not held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in known]) > 0.95


def test_cases(spark):
    texts, labels = corpus(200)
    model = X.fit(texts, labels)
    df = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (3, "vilename slurword", "p"), (3, "vilename slurword", "p"),
                                (None, "word1 " * 200_000, "p")], "doc_id long, text string, score string")
    out = X.score_texts(df, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    rows = out.collect()
    assert rows[0].score == rows[1].score < 0.5 and rows[2] == rows[3] and rows[2].predicted == 1
    assert X.score_texts(df.limit(0), model).count() == 0


def test_one_class_or_no_label(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for labels, want in (([(1, None)], 0.0), ([(1, 1), (3, 1)], 1.0)):
        m = X.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert abs(X.score_texts(docs, m).first().score - want) < 1e-6


def test_held_out_recall_and_precision(spark):
    sf = SF_SMALL.replace("sf0.001", "sf0.1")
    rows = (X.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
            .where("held_out and toxic in (0, 1)").select("toxic", "predicted").collect())
    right = sum(r.toxic == r.predicted == 1 for r in rows)
    toxic, found = sum(r.toxic == 1 for r in rows), sum(r.predicted == 1 for r in rows)
    print(f"held out {len(rows)}: recall {right}/{toxic}, precision {right}/{found}")
    assert toxic > 50 and right / toxic > 0.9 and right / found > 0.9


def plain_score(text, model):
    """One text, word by word in Python integers: every known word counts once,
    a known beginning as often as it occurs over the root of the words."""
    top = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & top
        return x ^ (x >> 31)

    def poly(word):
        return sum(int(W._CODE[b]) * pow(W._BASE, k, 1 << 64) for k, b in enumerate(word)) & top

    place = {int(h): k for k, h in enumerate(model.hashes)}
    words = re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())
    found = Counter()
    for w in words:
        own = [mixed(poly(w))] + [mixed((poly(w[:p]) + p) & top) for p in X.PREFIXES if len(w) > p]
        found.update(place[h] for h in own if h in place)
    z = model.bias + sum(model.weights[k] * (n / math.sqrt(len(words)) if model.by_count[k] else 1.0) for k, n in found.items())
    return 1 / (1 + math.exp(-min(max(z, -40), 40)))


def test_scores_against_a_plain_scorer(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    model = X.train(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "Straße, ÉTÉ vile's women-men\n\n"), (-4, "vile " * 5000)], docs.schema)
    rows = X.score_texts(docs.unionByName(odd), model).collect()
    assert len(model.hashes) > 50 and len(rows) == docs.count() + 4
    for r in rows:
        assert abs(r.score - plain_score(r.text, model)) < 1e-9
