"""Toxicity: a classifier regularised by counterfactuals.

* *Features.* Words of letters (A-Z lowered): whether a word occurs, and how
  often words begin with a given run of 4 to 8 bytes, divided by the square
  root of the number of words.  Features are 64-bit hashes; the model keeps
  the ``features`` that tell the labels apart best, by chi-square, so that an
  unknown word counts nothing.
* *Counterfactuals.* In labelled texts that name a group, the identity term is
  swapped for another one; template sentences do the same for every pair of
  neighbouring terms.  Training adds ``strength`` times the squared change of
  the score to the logistic loss, so a mere mention of a group moves the score
  as little as possible, and much the same for every group.
* *Training* runs in numpy on the driver, on a bounded sample: up to
  ``per_class`` labelled rows of each class (smallest hashes of the id), texts
  of up to ``longest`` characters.  Classes are weighted to their shares.
* *Scoring* reads whole texts in Arrow batches; the model (at most
  ``features`` rows) is broadcast.

Defined cases: a null or empty text gets the score of a text without known
features; rows without label teach nothing; without both classes every score
is the share of label 1 (0 if there is no label); repeated rows each get a
result; input columns named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.llm.common import documents, held_out, pick, position, positional, restore
from shotspark.llm.wordsets import letter_hashes, text_buffer

OWN = ["score", "predicted"]
PREFIXES = (4, 5, 6, 7, 8)
#: Identity terms, in sets whose members may stand for one another.
IDENTITY = [
    ["women", "men"], ["woman", "man"], ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["black", "white", "asian", "latino", "arab"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["immigrants", "natives", "refugees"],
    ["old", "young"], ["disabled", "blind", "deaf"], ["frauen", "männer"], ["muslime", "christen", "juden"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"], ["mujeres", "hombres"],
    ["musulmanes", "cristianos", "judíos"],
]
TEMPLATES = ["my neighbours are {}", "a group of {} people met in the town", "{}"]
_SWAP = {t: (s, k) for s in IDENTITY for k, t in enumerate(s)}


@dataclass
class Model:
    hashes: np.ndarray       # sorted feature hashes
    weights: np.ndarray
    by_count: np.ndarray     # whether the feature counts beginnings of words
    bias: float

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, bool)  # a quick no for most words
        self.seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True


def _feature_hits(column: pa.Array, known: Model | None):
    """(text, feature hash, is beginning) of all words in pieces, only known
    features if a model is given; and the number of words of each text."""
    data, offsets = text_buffer(column)
    words = np.zeros(len(offsets) - 1, np.int64)
    out = []
    for text, hashes in letter_hashes(data, offsets, PREFIXES):
        words += np.bincount(text, minlength=len(words))
        for k, h in enumerate(hashes):
            good = (h != 0) if known is None else known.seen[(h >> np.uint64(44)).astype(np.int64)] & (h != 0)
            out.append((text[good], h[good], k > 0))
    return out, words


def _matrix(column: pa.Array, model: Model):
    """Sparse rows over the model's features: (text, feature, value)."""
    hits, words = _feature_hits(column, model)
    texts, feats = [], []
    for text, h, _ in hits:
        at = np.searchsorted(model.hashes, h)
        at = np.minimum(at, max(len(model.hashes) - 1, 0))
        good = model.hashes[at] == h if len(model.hashes) else np.zeros(len(h), bool)
        texts.append(text[good]), feats.append(at[good])
    text = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    feat = np.concatenate(feats) if feats else np.zeros(0, np.int64)
    pair, count = np.unique(text * np.int64(max(len(model.hashes), 1)) + feat, return_counts=True)
    text, feat = np.divmod(pair, max(len(model.hashes), 1))
    value = np.where(model.by_count[feat], count / np.sqrt(np.maximum(words[text], 1)), 1.0) if len(feat) else np.zeros(0)
    return text, feat, value


def _select(texts: pa.Array, y: np.ndarray, features: int) -> Model:
    """The features with the largest chi-square between presence and label."""
    hits, _ = _feature_hits(texts, None)
    n, n1 = len(y), y.sum()
    hashes, scores, kinds = [], [], []
    for kind in (False, True):
        text = np.concatenate([t for t, _, k in hits if k == kind] or [np.zeros(0, np.int64)])
        h = np.concatenate([x for _, x, k in hits if k == kind] or [np.zeros(0, np.uint64)])
        order = np.lexsort((text, h))
        text, h = text[order], h[order]
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, bool)
        text, h = text[keep], h[keep]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        if not len(first):
            continue
        df = np.diff(np.append(first, len(h)))
        pos = np.add.reduceat(y[text].astype(float), first)
        want = df * n1 / n
        chi = (pos - want) ** 2 / np.maximum(want, 1e-9) + (pos - want) ** 2 / np.maximum(df - want, 1e-9)
        chi[df < 3] = 0
        hashes.append(h[first]), scores.append(chi), kinds.append(np.full(len(first), kind))
    # Identity words always have a weight of their own, for the counterfactuals.
    terms = pa.array([t for s in IDENTITY for t in s], pa.large_string())
    must = [h for _, h, k in _feature_hits(terms, None)[0] if not k]
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s, k = (np.concatenate(scores), np.concatenate(kinds)) if hashes else (np.zeros(0), np.zeros(0, bool))
    best = np.lexsort((h, -s))[:features]
    best = best[s[best] > 0]
    every = np.concatenate([h[best], *must])
    kind = np.concatenate([k[best], np.zeros(sum(map(len, must)), bool)])
    every, at = np.unique(every, return_index=True)
    return Model(every, np.zeros(len(every)), kind[at], 0.0)


def counterfactuals(texts: list[str]) -> list[tuple[str, str]]:
    """Pairs of a text and the same text with its identity terms swapped."""
    out = []
    for t in texts:
        words = t.split(" ")
        swapped = list(words)
        for k, w in enumerate(words):
            core = w.strip(".,;:!?\n\"'()").lower()
            if core in _SWAP:
                group, at = _SWAP[core]
                swapped[k] = w.lower().replace(core, group[(at + 1) % len(group)])
        if swapped != words:
            out.append((t, " ".join(swapped)))
    for template in TEMPLATES:
        for group in IDENTITY:
            out += [(template.format(a), template.format(b)) for a, b in zip(group, group[1:] + group[:1])]
            out += [(template.format(a), template.format("")) for a in group]  # a mention against none
    return out


def fit(texts: list[str], labels: list[int], share: float | None = None, features: int = 1 << 9, strength: float = 1.0,
        decay: float = 1e-4, steps: int = 300, rate: float = 0.1) -> Model:
    """Logistic loss + strength * mean squared change under swaps + decay."""
    y = np.array(labels, float)
    share = float(y.mean()) if share is None and len(y) else share or 0.0
    if not len(y) or y.min() == y.max():
        odds = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool), float(odds))
    column = pa.array(texts, pa.large_string())
    model = _select(column, y, features)
    row, feat, value = _matrix(column, model)
    pairs = counterfactuals(texts)
    left = _matrix(pa.array([a for a, _ in pairs], pa.large_string()), model)
    right = _matrix(pa.array([b for _, b in pairs], pa.large_string()), model)
    d_row = np.concatenate([left[0], right[0]])
    d_feat = np.concatenate([left[1], right[1]])
    d_value = np.concatenate([left[2], -right[2]])
    # The sample's classes count as often as in the labelled rows.
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    # The square root keeps the rarer class from being drowned.
    weight = np.sqrt(weight * np.where(y == 1, (1 - share) / max(share, 1e-9), 1.0))
    weight /= weight.sum()
    k = len(model.hashes)
    w, b = np.zeros(k), 0.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):  # Adam on the whole sample
        z = np.bincount(row, weights=w[feat] * value, minlength=len(y)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g = np.bincount(feat, weights=e[row] * value, minlength=k) + decay * w
        change = np.bincount(d_row, weights=w[d_feat] * d_value, minlength=len(pairs)) * (2 * strength / len(pairs))
        g += np.bincount(d_feat, weights=change[d_row] * d_value, minlength=k)
        g = np.append(g, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    model.weights, model.bias = w, float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic",
          per_class: int = 3000, longest: int = 50_000, **how) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    known = pick(labels, id=id, label=label).where(F.col("label").isin(0, 1) & F.col("id").isNotNull()
                                                   & ~held_out(F.col("id")))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    rows = []
    for c in (0, 1):
        # A top-k by hash: at most per_class rows, broadcast to the documents.
        some = known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class)
        got = (pick(docs, id=id, text=text).where(F.col("text").isNotNull() & (F.char_length("text") <= longest))
               .join(F.broadcast(some.dropDuplicates(["id"])), "id").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
               .limit(per_class).select("text").collect())
        rows += [(r.text, c) for r in got]
    return fit([r[0] for r in rows], [r[1] for r in rows], share=share, **how)


def scores(column: pa.Array, model: Model) -> np.ndarray:
    z = np.full(len(column), model.bias)
    if len(column) and len(model.hashes):
        text, feat, value = _matrix(column, model)
        z += np.bincount(text, weights=model.weights[feat] * value, minlength=len(column))
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _score(model, text: str):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(batch.column(text), model.value), pa.float64())],
                                             names=[*batch.schema.names, "score"])

    return run


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every input row with score and predicted."""
    p, names = positional(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = p.mapInArrow(_score(held, position(names, text)),
                       T.StructType([*p.schema.fields, T.StructField("score", T.DoubleType())]))
    return restore(out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), names, OWN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_texts(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
