"""Quality: a classifier by attention-based multiple-instance learning.

A document is a bag of passages; only the bag has a label.

* *Passages.* Runs of 64 words (a piece of a megabyte of a longer text starts a new
  passage).  A passage's raw features are shares of its bytes in each class (every
  ASCII punctuation mark its own class), of neighbouring bytes in each pair of coarse
  classes, of distinct words and of words equal to the one before, and the mean and
  deviation of word lengths; none depends on the vocabulary of a language.
* *Encoder.* h = tanh(W x + b) of the standardised features x.
* *Gated attention.* A passage's weight is the softmax, within its document, of
  w . (tanh(V h) * sigmoid(U h)); the document is the weighted sum of its passages'
  h, scored by a logistic layer.  Encoder, gate and scorer are learned together,
  from document labels alone, by Adam in numpy on the driver.
* *Training sample.* Up to ``per_class`` labelled rows of each class (smallest hashes
  of the id) with texts of up to ``longest`` characters.
* *Scoring* reads whole texts in Arrow batches; a batch keeps two numbers a passage
  until its documents' softmax is taken.  The model has a few thousand numbers.

Defined cases: a text without words (null included) is one passage whose features are
all 0; rows without label teach nothing; without both classes every score is the
share of label 1 (0.5 if there is no label); repeated rows each get a result;
input columns named like a result column are replaced.  Scores are rounded to nine
decimals, so that batches of another size give the same ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.llm.common import documents, pick, position, positional, restore
from shotspark.llm.wordsets import _CODE, _SPACE, _WINDOW, mix64, text_buffer, windows

OWN = ["score", "predicted"]
PASSAGE = 64
HIDDEN, GATE = 16, 8


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Fine and coarse class of each byte.  Fine: other, lower, upper, digit, beyond
    ASCII, blank, line break, then one for each punctuation mark.  Coarse: the
    first five, white space, punctuation."""
    fine, coarse = np.zeros(256, np.int32), np.zeros(256, np.int32)
    marks = 0
    for b in range(256):
        c = chr(b)
        if b > 127:
            fine[b] = 4
        elif c.islower():
            fine[b] = 1
        elif c.isupper():
            fine[b] = 2
        elif c.isdigit():
            fine[b] = 3
        elif c == "\n":
            fine[b] = 6
        elif c.isspace():
            fine[b] = 5
        elif c.isprintable():
            fine[b] = 7 + marks
            marks += 1
        coarse[b] = min(fine[b], 6) if fine[b] < 5 else 5 if fine[b] < 7 else 6
    return fine, coarse


_FINE, _COARSE = _classes()
N_FINE, N_COARSE = int(_FINE.max()) + 1, 7
FEATURES = N_FINE + N_COARSE ** 2 + 4


def _piece(part: np.ndarray, start: np.ndarray, stop: np.ndarray, hashes: np.ndarray, text: np.ndarray):
    """Features of the passages of one piece, and the text that each belongs to."""
    words = len(start)
    fresh = np.ones(words, bool)
    fresh[1:] = text[1:] != text[:-1]
    first = np.maximum.accumulate(np.where(fresh, np.arange(words), 0))
    head = np.flatnonzero((np.arange(words) - first) % PASSAGE == 0)
    own = np.cumsum((np.arange(words) - first) % PASSAGE == 0) - 1
    n = np.diff(np.append(head, words))
    count = len(head)
    begin, end = start[head], stop[head + n - 1]
    size = end - begin
    # The bytes of passages only, each with the passage it is in.
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    who = np.repeat(np.arange(count, dtype=np.int32), size)
    data = part[at]
    fine = np.bincount(who * N_FINE + _FINE[data], minlength=count * N_FINE).reshape(count, N_FINE)
    c = _COARSE[data]
    same = who[1:] == who[:-1]
    pair = np.bincount((who[1:] * N_COARSE ** 2 + c[:-1] * N_COARSE + c[1:])[same],
                       minlength=count * N_COARSE ** 2).reshape(count, N_COARSE ** 2)
    distinct = np.unique(hashes ^ mix64(own.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    again = np.zeros(words, bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
    length = (stop - start).astype(float)
    mean = np.bincount(own, weights=length, minlength=count) / n
    var = np.maximum(np.bincount(own, weights=length ** 2, minlength=count) / n - mean ** 2, 0)
    x = np.column_stack([np.sqrt(fine / size[:, None]), np.sqrt(pair / np.maximum(size - 1, 1)[:, None]),
                         np.bincount(own[distinct], minlength=count) / n, np.bincount(own[again], minlength=count) / n,
                         np.log1p(mean), np.log1p(np.sqrt(var))])
    return x, text[head]


def passages(column: pa.Array):
    """(features, text number) of all passages, a bounded piece at a time.  Short
    texts share a piece; a long one is cut by itself, so that its passages do not
    depend on its neighbours.  Texts without words give no passage here."""
    data, offsets = text_buffer(column)
    a, rows = 0, len(offsets) - 1
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _WINDOW, "right")) - 1)
        cut = offsets[a:b + 1] - offsets[a]
        for at, start, stop, total, down in windows(data[offsets[a]:offsets[b]], cut, _SPACE):
            if len(start):
                sums = total(_CODE)
                part = data[offsets[a] + at:offsets[a] + at + len(sums) - 1]
                text = np.searchsorted(cut, start + at, "right") - 1
                x, own = _piece(part, start, stop, mix64((sums[stop] - sums[start]) * down[start]), text)
                yield x, own + a
        a = b


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict = field(default_factory=dict)  # W b V bV U bU w c; empty: a fixed score
    bias: float = 0.0

    def encode(self, x: np.ndarray):
        """h, the two halves of the gate, and the attention logit."""
        p = self.p
        h = np.tanh((x - self.mean) / self.scale @ p["W"] + p["b"])
        t, q = np.tanh(h @ p["V"] + p["bV"]), 1 / (1 + np.exp(-(h @ p["U"] + p["bU"])))
        return h, t, q, (t * q) @ p["w"]


def _softmax(logit: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    top = np.full(docs, -np.inf)
    np.maximum.at(top, doc, logit)
    e = np.exp(logit - top[doc])
    return e / np.bincount(doc, weights=e, minlength=docs)[doc]


def _bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All passages of a bounded sample, with the empty passage of texts without words."""
    found = list(passages(column))
    x = np.concatenate([f[0] for f in found]) if found else np.zeros((0, FEATURES))
    doc = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    bare = np.setdiff1d(np.arange(len(column)), doc)
    return np.concatenate([x, np.zeros((len(bare), FEATURES))]), np.concatenate([doc, bare])


def fit(texts: list[str], labels: list[int], share: float | None = None, steps: int = 300, rate: float = 0.02,
        decay: float = 1e-3, seed: int = 13) -> Model:
    """Learn encoder, gate and scorer; the classes weigh as in ``share``, softened by
    a square root so that the rarer one is not drowned."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        rest = 0.5 if share is None else share
        return Model(np.zeros(FEATURES), np.ones(FEATURES), bias=float(y.mean() if len(y) else rest))
    share = float(y.mean()) if share is None else share
    x, doc = _bags(pa.array(texts, pa.large_string()))
    rng = np.random.default_rng(seed)
    model = Model(x.mean(axis=0), np.maximum(x.std(axis=0), 0.02))
    model.p = {"W": rng.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
               "V": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "bV": np.zeros(GATE),
               "U": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "bU": np.zeros(GATE),
               "w": rng.normal(0, GATE ** -0.5, GATE), "c": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "b0": np.zeros(1)}
    p, docs = model.p, len(y)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    weight = np.sqrt(weight * np.where(y == 1, (1 - share) / max(share, 1e-9), 1.0))
    weight /= weight.sum()
    std = (x - model.mean) / model.scale
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        h, t, q, logit = model.encode(x)
        a = _softmax(logit, doc, docs)
        z = np.column_stack([np.bincount(doc, weights=a * h[:, k], minlength=docs) for k in range(HIDDEN)])
        e = (1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b0"], -40, 40))) - y) * weight
        dz = e[:, None] * p["c"]
        da = (dz[doc] * h).sum(axis=1)
        ds = a * (da - np.bincount(doc, weights=a * da, minlength=docs)[doc])
        dg = ds[:, None] * p["w"]
        dt, dq = dg * q * (1 - t * t), dg * t * q * (1 - q)
        dh = a[:, None] * dz[doc] + dt @ p["V"].T + dq @ p["U"].T
        dpre = dh * (1 - h * h)
        g = {"W": std.T @ dpre + decay * p["W"], "b": dpre.sum(axis=0), "V": h.T @ dt + decay * p["V"], "bV": dt.sum(axis=0),
             "U": h.T @ dq + decay * p["U"], "bU": dq.sum(axis=0), "w": (t * q).T @ ds + decay * p["w"],
             "c": z.T @ e + decay * p["c"], "b0": np.array([e.sum()])}
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v2[k] = 0.999 * v2[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-10)
    model.bias = float(p["b0"][0])
    return model


def scores(column: pa.Array, model: Model) -> np.ndarray:
    if not model.p:
        return np.full(len(column), model.bias)
    logit, part, doc = [np.zeros(0)], [np.zeros(0)], [np.zeros(0, np.int64)]

    def take(x, own):
        h, _, _, s = model.encode(x)
        logit.append(s), part.append(h @ model.p["c"]), doc.append(own)

    for x, own in passages(column):
        take(x, own)
    bare = np.setdiff1d(np.arange(len(column)), np.concatenate(doc))
    take(np.zeros((len(bare), FEATURES)), bare)
    doc = np.concatenate(doc)
    a = _softmax(np.concatenate(logit), doc, len(column))
    z = np.bincount(doc, weights=a * np.concatenate(part), minlength=len(column)) + model.bias
    return np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 9)


def held_out(id_col: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 3 is 1; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality",
          per_class: int = 3000, longest: int = 50_000, **how) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    known = pick(labels, id=id, label=label).where(F.col("label").isin(0, 1) & F.col("id").isNotNull()
                                                   & ~held_out(F.col("id")))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else None
    some = None
    for c in (0, 1):
        # A top-k by hash: at most per_class ids of each class, broadcast to the documents.
        top = known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class).dropDuplicates(["id"])
        some = top if some is None else some.unionAll(top)
    got = (pick(docs, id=id, text=text).where(F.col("text").isNull() | (F.char_length("text") <= longest))
           .join(F.broadcast(some), "id").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"), "label")
           .limit(2 * per_class).select("text", "label").collect())
    return fit([r.text or "" for r in got], [r.label for r in got], share=share, **how)


def _score(model, text: str):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(batch.column(text), model.value), pa.float64())],
                                             names=[*batch.schema.names, "score"])

    return run


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every input row with score (of label 1) and predicted."""
    p, names = positional(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = p.mapInArrow(_score(held, position(names, text)),
                       T.StructType([*p.schema.fields, T.StructField("score", T.DoubleType())]))
    return restore(out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), names, OWN)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_texts(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
