"""Language identification: averaged hashed subword embeddings, a linear
softmax and calibrated rejection.

* *Subwords.* A text is read as bytes with A-Z lowered and everything in ASCII
  that is no letter as one boundary mark.  Subwords are the runs of 2 to 4
  bytes inside a word with its boundary marks; each is hashed to a bucket.
* *Model.* The mean of the subwords' embeddings goes through a linear layer
  and a softmax.  Both are trained together by stochastic gradient descent in
  numpy on the driver, on a bounded sample (``per_language`` texts of each
  language, of each a snippet of ``snippet`` characters).  As the mean is
  linear, embedding and layer are multiplied out into one table of buckets by
  languages, in fixed-point integers: a score is a sum of integers and does
  not depend on how texts are batched.
* *Familiarity.* A further column of the table holds the log frequency of each
  subword in the language that uses it most.  By a logistic curve its mean over
  a text becomes the probability that the text is of any learned language, and
  ``score`` is that times the softmax's probability.
* *Calibration.* Sample texts kept out of training set the softmax temperature,
  the curve and the rejection.  Whole and cut to 80 and 20 characters, they are
  held against unlike texts of the same lengths: themselves without what was
  learned of their own language, and themselves with shuffled characters.  The
  curve's middle, by length, is halfway between the familiarity that 99 % of the
  learned texts reach and the one that 95 % of the unlike stay under, or the
  former where the two overlap; the score ``least``, below which a text is
  rejected, is set alike.  A text without a letter is rejected too.
* *Prediction* reads whole texts in Arrow batches; the table (buckets times
  languages) is broadcast, its size is fixed by parameters.

Defined cases: a text that is null or has no letter is ``und`` with score 0
and is rejected; with nothing to learn from every text is; rows with null
language teach nothing; repeated rows each get a result; input columns named
like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.llm.common import documents, held_out, pick, position, positional, restore
from shotspark.llm.wordsets import NO_LETTER, text_buffer

OWN = ["lang_pred", "score", "accepted"]
BUCKETS, SIZES, SCALE = 1 << 16, (2, 3, 4), 1 << 16
_BYTE = np.arange(256, dtype=np.uint8)
_BYTE[65:91] += 32
_BYTE[NO_LETTER] = 0x20
_PIECE = 1 << 19
#: Calibration: characters of the texts' cuts, count of an unseen subword, least width of the curve.
CUTS, UNSEEN, LEAST_WIDTH = (20, 80, 1 << 20), 0.05, 0.05


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray        # int32, buckets by languages and familiarity; row 0 is the empty subword
    bias: np.ndarray
    temperature: float
    least: float             # probabilities below are rejected
    curve: tuple = ((0.0,), (-1e9,), (1.0,))  # at log numbers of subwords: middle and width in familiarity

    def learned(self, familiarity: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability that a text is of any learned language."""
        n = np.log(np.maximum(counts, 1))
        middle, width = (np.interp(n, self.curve[0], c) for c in self.curve[1:])
        return 1 / (1 + np.exp(-np.clip((familiarity - middle) / width, -40, 40)))

    def softmax(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = sums[:, :-1] / SCALE / np.maximum(counts, 1)[:, None] + self.bias
        z = (z - z.max(axis=1, keepdims=True)) / self.temperature
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each language; what is left to 1 is for unlearned ones."""
        familiarity = sums[:, -1] / SCALE / np.maximum(counts, 1)
        return self.softmax(sums, counts) * self.learned(familiarity, counts)[:, None]


def _pieces(column: pa.Array):
    """Buckets of all subwords, in pieces of bounded size: (text number of each
    subword, bucket).  Texts are taken about _PIECE bytes at a time, longer
    ones alone."""
    data, offsets = text_buffer(column)
    rows, at = len(offsets) - 1, 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, "right")) - 1)
        for text, bucket in _subwords(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]):
            yield text + at, bucket
        at = to


def _subwords(data: np.ndarray, offsets: np.ndarray):
    rows = len(offsets) - 1
    # One boundary before each text and one behind the last.
    whole = np.full(len(data) + rows + 1, 0x20, np.uint8)
    if rows == 1:
        whole[1:-1] = _BYTE[data]
    else:
        whole[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(offsets))] = _BYTE[data]
    first = offsets + np.arange(rows + 1)
    last = len(whole)
    for a in range(0, last - 1, _PIECE):
        b = min(a + _PIECE, last - 1)
        c = np.zeros(b - a + max(SIZES), np.uint64)
        c[:min(last - a, len(c))] = whole[a:a + len(c)]
        blank = c == 0x20
        inner = np.zeros(b - a, bool)     # a boundary inside: not one word
        h = c[:b - a].copy()
        text = np.searchsorted(first, np.arange(a, b), "right") - 1
        for n in range(2, max(SIZES) + 1):
            if n > 2:
                inner |= blank[n - 2:n - 2 + b - a]
            h = h * np.uint64(0x100000001B3) + c[n - 1:n - 1 + b - a] + np.uint64(n)
            if n in SIZES:
                good = ~inner & (np.arange(a, b) + n <= last) & ~(blank[:b - a] & blank[n - 1:n - 1 + b - a])
                bucket = (h[good] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(BUCKETS - 1) + np.uint64(1)
                yield text[good], bucket.astype(np.int64)


def _sums(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: summed table rows and number of subwords."""
    rows = len(column)
    sums, counts = np.zeros((rows, table.shape[1]), np.int64), np.zeros(rows, np.int64)
    for text, bucket in _pieces(column):
        if not len(text):
            continue
        cut = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        sums[text[cut]] += np.add.reduceat(table[bucket], cut, axis=0, dtype=np.int64)
        counts[text[cut]] += np.diff(np.append(cut, len(text)))
    return sums, counts


def _split(texts: list[str]) -> list[np.ndarray]:
    """Buckets of the subwords of each text."""
    per = [[] for _ in texts]
    for text, bucket in _pieces(pa.array(texts, pa.large_string())):
        cut = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else []
        for k, part in zip(text[cut] if len(text) else [], np.split(bucket, cut[1:] if len(text) else [])):
            per[k].append(part)
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in per]


class _Familiar:
    """Log frequency of each bucket in the language that uses it most."""

    def __init__(self, subwords: list[np.ndarray], y: np.ndarray, languages: int):
        self.top, self.next = np.full(BUCKETS, -np.inf), np.full(BUCKETS, -np.inf)
        self.who = np.zeros(BUCKETS, np.int64)
        for k in range(languages):
            n = sum((np.bincount(subwords[i], minlength=BUCKETS) for i in np.flatnonzero(y == k)), np.zeros(BUCKETS))
            own = np.log((n + UNSEEN) / (n.sum() + UNSEEN * BUCKETS))
            more = own > self.top
            self.next = np.where(more, self.top, np.maximum(self.next, own))
            self.top, self.who = np.where(more, own, self.top), np.where(more, k, self.who)

    def without(self, k: int) -> np.ndarray:
        return np.where(self.who == k, self.next, self.top)


def _bounds(like: np.ndarray, unlike: np.ndarray) -> tuple[float, float]:
    """What 99 % of the like reach, and what 95 % of the unlike stay under, no
    more than the first."""
    reach = float(np.quantile(like, 0.01))
    return reach, min(reach, float(np.quantile(unlike, 0.95))) if len(unlike) else reach


def _calibrate(model: Model, texts: list[str], y: np.ndarray, known: list[_Familiar], rng) -> None:
    """Set curve and least.  known[k]: what was learned without text k."""
    points = []
    for shorter, cut in zip((-1, *CUTS), CUTS):
        rows = []  # like or not, familiarity, number of subwords, softmax probability
        for k, text in enumerate(texts):
            if len(text) <= shorter:
                continue
            at = int(rng.integers(0, max(1, len(text) - cut + 1)))
            piece = text[at:at + cut]
            straight, mixed = _split([piece, "".join(rng.permutation(list(piece)))])
            for like, buckets, left in ((True, straight, None), (False, mixed, None), (False, straight, y[k])):
                if not len(buckets) or left is not None and len(model.languages) < 2:
                    continue
                table = known[k].top if left is None else known[k].without(left)
                p = model.softmax(model.table[buckets].sum(axis=0, dtype=np.int64)[None], np.array([len(buckets)]))[0]
                if left is not None:
                    p = np.delete(p, left) / max(np.delete(p, left).sum(), 1e-300)
                rows.append((like, table[buckets].mean(), len(buckets), p.max()))
        if any(r[0] for r in rows):
            points.append(np.array(rows, float).T)
    if not points:
        return
    curve = []
    for like, familiarity, n, _ in points:
        reach, under = _bounds(familiarity[like == 1], familiarity[like == 0])
        curve.append((float(np.log(np.median(n[like == 1]))), (reach + under) / 2, max((reach - under) / 6, LEAST_WIDTH)))
    model.curve = tuple(zip(*sorted(curve)))
    least = []
    for like, familiarity, n, p in points:
        score = p * model.learned(familiarity, n)
        least.append(sum(_bounds(score[like == 1], score[like == 0])) / 2)
    model.least = min(least)


def fit(texts: list[str], langs: list[str], dim: int = 16, epochs: int = 4, rate: float = 0.4, batch: int = 32,
        seed: int = 7, least_steps: int = 200) -> Model:
    """Train and calibrate on labelled texts; every fifth is for calibration.  A
    small sample is gone through more often, until ``least_steps`` are taken."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.int32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    subwords = _split(texts)
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(texts))
    order = order[[len(subwords[k]) > 0 for k in order]]
    calibration, training = order[::5] if len(order) >= 10 else order, order
    if len(order) >= 10:
        training = np.delete(order, np.arange(0, len(order), 5))
    emb = rng.uniform(-1, 1, (BUCKETS, dim)).astype(np.float32) / dim
    layer, bias = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    # Each language weighs the same, however many texts the sample has of it.
    weight = len(training) / (len(names) * np.maximum(np.bincount(y[training], minlength=len(names)), 1))
    round_ = max(1, -(-len(training) // batch))
    epochs = max(epochs, -(-least_steps // round_))
    steps = epochs * round_
    step = 0
    for _ in range(epochs):
        rng.shuffle(training)
        for a in range(0, len(training), batch):
            own = training[a:a + batch]
            size = np.array([len(subwords[k]) for k in own])
            flat = np.concatenate([subwords[k] for k in own])
            cut = np.cumsum(size) - size
            hidden = np.add.reduceat(emb[flat], cut, axis=0) / size[:, None]
            z = hidden @ layer + bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = e / e.sum(axis=1, keepdims=True)
            g[np.arange(len(own)), y[own]] -= 1
            g *= weight[y[own]][:, None] / len(own)
            speed = rate * (1 - step / steps) * 10
            down = (g @ layer.T) / size[:, None]
            layer -= speed * hidden.T @ g
            bias -= 0.1 * speed * g.sum(axis=0)
            # Sum the gradient of equal buckets first, then update each once.
            used, at = np.unique(flat, return_inverse=True)
            who = np.repeat(np.arange(len(own)), size)
            mass = np.zeros((len(used), dim), np.float32)
            for d in range(dim):
                mass[:, d] = np.bincount(at, weights=down[who, d], minlength=len(used))
            emb[used] -= speed * dim * mass
            step += 1
    table = np.rint((emb @ layer).astype(np.float64) * SCALE).astype(np.int32)
    familiar = _Familiar([subwords[k] for k in training], y[training], len(names))
    table = np.column_stack([table, np.rint(familiar.top * SCALE).astype(np.int32)])
    table[0] = 0
    model = Model(names, table, bias.astype(np.float64), 1.0, 0.0)
    sums, counts = _sums(pa.array([texts[k] for k in calibration], pa.large_string()), table)
    truth = y[calibration]

    def loss(t):
        model.temperature = t
        return -np.log(np.maximum(model.softmax(sums, counts)[np.arange(len(truth)), truth], 1e-12)).mean()

    if len(truth):
        model.temperature = min(np.geomspace(0.05, 5, 41), key=loss)
        known = [familiar] * len(calibration)
        if len(order) < 10:  # nothing was kept out: each text is held against the others
            known = [_Familiar([subwords[j] for j in order if j != k], y[order[order != k]], len(names)) for k in calibration]
        _calibrate(model, [texts[k] for k in calibration], truth, known, rng)
    return model


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", per_language: int = 500,
          snippet: int = 500, max_languages: int = 256) -> Model:
    """Fit on a bounded sample of the rows that are not held out: of each of
    the (most frequent ``max_languages``) languages the ``per_language`` rows
    with the smallest hashes of their texts."""
    src = pick(docs, id=id, text=text, lang=lang).where(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    counts = (src.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "lang").limit(max_languages).collect())
    if not counts:
        return fit([], [])
    # Rows of each language are thinned by hash before the exact choice.
    share = F.create_map(*[F.lit(v) for r in counts for v in (r.lang, min(1.0, 4.0 * per_language / r.n))])
    h = F.xxhash64("text")
    thin = src.withColumn("h", h).where(
        F.col("text").rlike(r"\p{L}") & (F.pmod(F.col("h"), F.lit(1_000_003)) < F.coalesce(share[F.col("lang")], F.lit(0.0)) * 1_000_003))
    room = F.greatest(F.char_length("text") - snippet, F.lit(0)) + 1
    cut = thin.select("lang", "h", F.substr("text", F.pmod(F.xxhash64("h"), room.cast("long")).cast("int") + 1,
                                            F.lit(snippet)).alias("cut")).distinct()
    ranked = cut.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "cut")))
    rows = sorted((r.lang, r.h, r.cut) for r in ranked.where(F.col("r") <= per_language).select("lang", "h", "cut").collect())
    return fit([r[2] for r in rows], [r[0] for r in rows])


def _predict(model, text: str):
    def run(batches):
        m = model.value
        for batch in batches:
            names, scores = [], []
            column = batch.column(text)
            if m.languages and len(column):
                sums, counts = _sums(column, m.table)
                p = m.probabilities(sums, counts)
                best = p.argmax(axis=1)
                names = [m.languages[k] for k in best]
                scores = p[np.arange(len(best)), best]
            else:
                names, scores = ["und"] * len(column), np.zeros(len(column))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, "_lang", "_p"])

    return run


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every input row with lang_pred, score and accepted."""
    p, names = positional(docs)
    t = position(names, text)
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = p.mapInArrow(_predict(held, t), T.StructType([*p.schema.fields, T.StructField("_lang", T.StringType()),
                                                        T.StructField("_p", T.DoubleType())]))
    letter = F.coalesce(F.col(t).rlike(r"\p{L}"), F.lit(False)) & (F.col("_lang") != "und")
    out = (out.withColumn("lang_pred", F.when(letter, F.col("_lang")).otherwise("und"))
           .withColumn("score", F.when(letter, F.col("_p")).otherwise(0.0))
           .withColumn("accepted", letter & (F.col("_p") >= model.least)))
    return restore(out, names, OWN)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
