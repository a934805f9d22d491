"""N-gram Jaccard join by parity sketches, and the components of its links.

Two documents link when 100 * |A and B| >= 80 * |A or B| for their sets of
distinct 5-word shingles.  Then the symmetric difference is at most
(|A| + |B|) / 9, and the sizes differ by a factor of at most 5 / 4.

* *Sketch.* A shingle flips one bit of its document's sketch.  Each differing
  shingle changes at most one bit, so the Hamming distance of two sketches is
  at most the symmetric difference of the sets.
* *Size bands.* Bands of sizes grow by 8 / 5; a document takes part in its own
  band and, where a larger partner is possible, in the next one.
* *Pigeonhole.* In a band whose largest pair may differ in d bits, the sketch
  has k > d blocks (of 2^64 bits each, named by the XOR of the positions of
  the set bits): at least k - d blocks of two linked documents are equal.  k
  is large enough that they cannot all be empty, but for documents with k - d
  or more empty blocks, which also offer those.  Only non-empty blocks are
  joined; no linked pair is lost.
* *Stars.* A block's documents are paired with its smallest document, never
  all with all.  Each document is verified against its best partner first;
  links give components.  Blocks that still hold documents of several
  components go on: first with their smallest document, then each document
  with those of other components, inside a task, by size and by the Hamming
  distance of a compact sketch.  Such blocks are dealt to parts, to which a
  document sends its sketch once, with the names of its blocks there.  Only pairs
  near enough to link become rows, once a part; a
  block of more than ``GROUP`` documents is dealt to tasks by pairs of groups.
* *Verify.* Exact intersection of the shingle sets of the whole texts.

Nodes are set fingerprints (64 bits; a second one guards against collisions),
so copies of one set are one node however many rows they have.  The blocks of
a chunk of documents travel as one packed row per partition; a block that is
frequent within a chunk sends only its smallest document to the block's
partition and leaves the others in partitions of their own, so that no task
gets all rows of a hot block.

Defined cases: null and empty texts, and texts of white space, have the empty
set, link with nothing and are their own component; texts of fewer than five
words have one shingle, the whole sequence; repeated rows are linked; a null
id counts in a component only if it has no other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.llm.common import documents, position, positional, restore, write_table
from shotspark.llm.components import components
from shotspark.llm.wordsets import mix64, shingle_sets

OWN = ["n_shingles", "component_id"]
#: Block names of one packed row; rows of a partition; a block is frequent in a chunk from this many documents on.
CHUNK, PART_ROWS, FREQUENT = 1 << 20, 1_500_000, 32
#: Documents of a block that are compared in one task; larger blocks go by pairs of such groups.
GROUP = 4096
#: Rows (block, document) of a part in which blocks are compared.
PART_BLOCKS = 100_000
_U = np.uint64


def _bands(top: int) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, blocks) of each band up to size ``top``."""
    out, lo, hi = [], 1, 4
    while True:
        out.append((lo, hi, _blocks(lo, hi)))
        if hi >= top:
            return out
        lo, hi = hi + 1, hi * 8 // 5


def _largest_difference(n: int, hi: int) -> int:
    """Of a document of size n with a partner of at most hi."""
    return (n + min(hi, n * 5 // 4)) // 9


def _blocks(lo: int, hi: int) -> int:
    """Fewest blocks for which an ordinary document has fewer empty ones than
    must match; a bound of 1e-7 on the chance, by counting."""
    most = _largest_difference(hi, hi)
    if most == 0:
        return 1
    low = max(1, lo * 4 // 5)
    sizes = sorted({low, lo, (lo + hi) // 2, hi} | set(range(low, hi + 1) if hi < 64 else ()))

    def risky(k: int) -> bool:
        for n in sizes:
            d = _largest_difference(n, hi)
            if d and math.lgamma(k + 1) - math.lgamma(d + 1) - math.lgamma(k - d + 1) + n * math.log(d / k) > -16:
                return True
        return False

    k = most + 1
    while risky(k):
        k += 1
    return k


class _Scheme:
    """Bands, made as far as sizes need them."""

    def __init__(self):
        self.bands = _bands(64)

    def of(self, n: int) -> list[int]:
        while self.bands[-1][1] < n * 5 // 4:
            self.bands = _bands(self.bands[-1][1] * 2)
        b = next(i for i, (_, hi, _) in enumerate(self.bands) if n <= hi)
        return [b, b + 1] if n * 5 // 4 > self.bands[b][1] else [b]


def fingerprints(h: np.ndarray) -> tuple[int, int]:
    """Two set fingerprints, as signed longs."""
    x = mix64(h)
    one = mix64(np.array([np.bitwise_xor.reduce(mix64(x ^ _U(0xA5A5A5A5A5A5A5A5))) ^ _U(len(h))], np.uint64))
    two = mix64(np.array([np.bitwise_xor.reduce(mix64(x ^ _U(0x3C3C3C3C3C3C3C3C)))], np.uint64))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def block_names(h: np.ndarray, scheme: _Scheme) -> np.ndarray:
    """Names of the document's non-empty sketch blocks in each of its bands."""
    out, n, bits = [], len(h), mix64(h ^ _U(0x5851F42D4C957F2D))
    for b in scheme.of(n):
        _, hi, k = scheme.bands[b]
        block = (h >> _U(32)) * _U(k) >> _U(32)  # rises with h
        cut = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1])
        content, which = np.bitwise_xor.reduceat(bits, cut), block[cut]
        out.append(mix64(content ^ mix64(which + _U(b << 40))))
        if k - len(cut) >= k - _largest_difference(n, hi):  # too many empty blocks: offer them too
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), which)
            out.append(mix64(mix64(empty + _U(b << 40)) ^ _U(0x0F0F0F0F0F0F0F0F)))
    return np.concatenate(out)


def sketch(h: np.ndarray) -> bytes:
    """Parity sketch of 2 to 4 bits a shingle, 64 at least; halves fold by XOR."""
    m = max(64, 1 << (4 * len(h)).bit_length() - 1)
    bits = np.bincount((mix64(h ^ _U(0x2545F4914F6CDD1D)) & _U(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance after folding the longer sketch to the shorter's length."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


# -- tasks ---------------------------------------------------------------------

def _tag(text: str, with_sketch: bool):
    """Appends _n, _fp (and _fp2, _sketch) to each row."""

    def run(batches):
        for batch in batches:
            n, fp, fp2, sk = [], [], [], []
            for h in shingle_sets(batch.column(text)):
                n.append(len(h))
                one, two = fingerprints(h) if len(h) else (0, 0)
                fp.append(one), fp2.append(two)
                if with_sketch:
                    sk.append(sketch(h) if len(h) else b"")
            keep = [c for c in batch.schema.names if not (with_sketch and c == text)]
            cols = [batch.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(fp, pa.int64())]
            names = keep + ["_n", "_fp"]
            if with_sketch:
                cols += [pa.array(fp2, pa.int64()), pa.array(sk, pa.binary())]
                names += ["_fp2", "_sketch"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _tagged(df: DataFrame, text: str) -> DataFrame:
    return df.mapInArrow(_tag(text, False), T.StructType([*df.schema.fields, T.StructField("_n", T.LongType()),
                                                          T.StructField("_fp", T.LongType())]))


def _pack(keys: np.ndarray, fps: np.ndarray) -> bytes:
    """Sorted block names as differences in byte planes, documents by place in
    a list; compressed."""
    table, place = np.unique(fps, return_inverse=True)
    step = np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T
    raw = b"".join([np.array([len(keys), len(table)], np.int64).tobytes(), table.tobytes(), step.tobytes(),
                    place.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n, t = np.frombuffer(raw, np.int64, 2)
    table = np.frombuffer(raw, np.int64, t, 16)
    step = np.frombuffer(raw, np.uint8, 8 * n, 16 + 8 * t).reshape(8, n).T.copy().view(np.uint64).ravel()
    place = np.frombuffer(raw, np.uint8, 4 * n, 16 + 8 * t + 8 * n).reshape(4, n).T.copy().view(np.uint32).ravel()
    return np.cumsum(step, dtype=np.uint64), table[place]


def _offer(text: str, parts: int):
    """Packed block names of chunks of documents: (part, kind, blob).  Kind 0
    goes to the partition of the names; kind 1 holds the other documents of
    names that are frequent in this chunk, with the smallest one sent along."""

    def flush(keys, fps, serial):
        keys, fps = np.concatenate(keys), np.concatenate(fps)
        order = np.lexsort((fps, keys))
        keys, fps = keys[order], fps[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(keys)))
        often = np.repeat(size >= FREQUENT, size)
        rest = often & ~new
        send = ~rest
        k0, f0 = keys[send], fps[send]
        part = ((k0 >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
        for a, b in zip(cut[:-1], cut[1:]):
            if b > a:
                yield int(part[a]), 0, _pack(k0[a:b], f0[a:b])
        if rest.any():
            hub = np.repeat(fps[first], size)[rest]
            k1, f1 = keys[rest], fps[rest]
            for a in range(0, len(k1), CHUNK // 8):
                serial += 1
                s = slice(a, a + CHUNK // 8)
                yield serial * 7919 % parts, 1, _pack3(k1[s], f1[s], hub[s])

    def run(batches):
        from pyspark import TaskContext
        scheme, serial = _Scheme(), 1 + (TaskContext.get().partitionId() if TaskContext.get() else 0)
        keys, fps, held, known = [], [], 0, set()

        def emit():
            out = list(flush(keys, fps, serial))
            return pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()),
                 pa.array([o[2] for o in out], pa.binary())], names=["part", "kind", "blob"])

        for batch in batches:
            for h in shingle_sets(batch.column(text)):
                if not len(h):
                    continue
                fp = fingerprints(h)[0]
                if fp in known:
                    continue
                known.add(fp)
                names = block_names(h, scheme)
                keys.append(names), fps.append(np.full(len(names), fp, np.int64))
                held += len(names)
                if held >= CHUNK:
                    yield emit()
                    keys, fps, held, known = [], [], 0, set()
                    serial += 31
        if held:
            yield emit()

    return run


def _pack3(keys, fps, hubs) -> bytes:
    one, two = _pack(keys, fps), _pack(keys, hubs)
    return len(one).to_bytes(8, "little") + one + two


def _unpack3(blob: bytes):
    n = int.from_bytes(blob[:8], "little")
    keys, fps = _unpack(blob[8:8 + n])
    return keys, fps, _unpack(blob[8 + n:])[1]


_SHARED = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "fp", "hub")])


def _meet(table: pa.Table) -> pa.Table:
    """Block names with two or more documents: (name, document, smallest document)."""
    keys, fps, done = [], [], []
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
        if kind == 0:
            k, f = _unpack(blob)
            keys.append(k), fps.append(f)
        else:
            done.append(_unpack3(blob))
    if keys:
        k, f = np.concatenate(keys), np.concatenate(fps)
        order = np.lexsort((f, k))
        k, f = k[order], f[order]
        keep = np.concatenate([[True], (k[1:] != k[:-1]) | (f[1:] != f[:-1])])  # the same set in two chunks
        k, f = k[keep], f[keep]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(first, len(k)))
        many = np.repeat(size > 1, size)
        done.append((k[many], f[many], np.repeat(f[first], size)[many]))
    cols = [np.concatenate([d[c] for d in done]) if done else np.zeros(0, np.int64) for c in range(3)]
    return pa.table([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cols], names=["key", "fp", "hub"])


def _verify(batches):
    for batch in batches:
        inter, union = [], []
        for a, b in zip(shingle_sets(batch.column("ta")), shingle_sets(batch.column("tb"))):
            i = len(np.intersect1d(a, b, assume_unique=True))
            inter.append(i), union.append(len(a) + len(b) - i)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(inter, pa.int64()),
                                          pa.array(union, pa.int64())], names=["a", "b", "shared", "together"])


def _near(batches):
    for batch in batches:
        d = [sketch_distance(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())]
        most = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) // 9
        yield batch.filter(pa.array(np.array(d, np.int64) <= most)).select(["a", "b"])


def _close_pairs(own, fp, root, n, sk, across: bool):
    """Pairs of one block in different components whose sizes and sketches are
    near enough; ``sk`` is a matrix of sketch words."""
    left, right = [], []
    for x in range(len(fp)):
        y = np.flatnonzero((root[x + 1:] != root[x]) & ((own[x + 1:] != own[x]) if across else True)) + x + 1
        y = y[(5 * n[y] >= 4 * n[x]) & (5 * n[x] >= 4 * n[y])]
        if len(y):
            d = np.bitwise_count(sk[y] ^ sk[x]).sum(axis=1, dtype=np.int64)
            y = y[d <= (n[y] + n[x]) // 9]
            left.append(np.full(len(y), fp[x])), right.append(fp[y])
    if not left:
        return np.zeros((2, 0), np.int64)
    pair = np.stack([np.concatenate(left), np.concatenate(right)])
    return np.stack([pair.min(axis=0), pair.max(axis=0)])


class _Pairs:
    """Distinct pairs of several blocks: a pair that shares many blocks is held once
    beyond a few million."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, pair: np.ndarray):
        self.parts.append(pair)
        self.held += pair.shape[1]
        if self.held > 1 << 22 and len(self.parts) > 1:
            self.parts, self.held = [self.distinct()], 0

    def distinct(self) -> np.ndarray:
        return np.unique(np.concatenate(self.parts, axis=1), axis=1) if self.parts else np.zeros((2, 0), np.int64)

    def columns(self) -> list[pa.Array]:
        pair = self.distinct()
        return [pa.array(pair[0], pa.int64()), pa.array(pair[1], pa.int64())]


def _fold(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one block's documents, folded to the shortest length."""
    words = min(len(s) for s in sketches) // 8
    out = np.empty((len(sketches), words), np.uint64)
    for k, s in enumerate(sketches):
        x = np.frombuffer(s, np.uint64)
        while len(x) > words:
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        out[k] = x
    return out


def _near_in_part(table: pa.Table) -> pa.Table:
    """One part: a row per document with its sketch once and the names of its blocks
    there; the close pairs of all of the part's blocks, each once."""
    table = table.combine_chunks()
    fp, root, n = (table.column(c).to_numpy() for c in ("fp", "r", "n"))
    sks, lists = table.column("sk").to_pylist(), table.column("keys").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    keys, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(fp)), size)
    order = np.lexsort((doc, keys))
    keys, doc, found, seen = keys[order], doc[order], _Pairs(), set()
    cut = np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys))
    width = np.array([len(x) for x in sks])
    of_width = {w: np.flatnonzero(width == w) for w in set(width.tolist())}
    rows = {w: np.frombuffer(b"".join(sks[k] for k in at), np.uint64).reshape(len(at), -1) for w, at in of_width.items()}
    place = np.zeros(len(sks), np.int64)
    for at in of_width.values():
        place[at] = np.arange(len(at))
    for a, b in zip(cut[:-1], cut[1:]):
        some = doc[a:b]
        if b - a == 1 or (root[some] == root[some[0]]).all() or some.tobytes() in seen:
            continue  # a block of the same documents gives the same pairs
        seen.add(some.tobytes())
        w = width[some[0]]
        sk = rows[w][place[some]] if (width[some] == w).all() else _fold([sks[k] for k in some])
        found.add(_close_pairs(some, fp[some], root[some], n[some], sk, False))
    return pa.table(found.columns(), names=["a", "b"])


def _near_across(batches):
    """Rows of large blocks sorted by (key, i, j): the close pairs of two groups i < j,
    or inside one.  Pairs that are not close are never rows."""
    names = ("key", "i", "j", "own", "fp", "r", "n")
    held = None

    def close(cols, sks):
        own, fp, root, n = cols[3:]
        return _close_pairs(own, fp, root, n, _fold(sks), cols[1][0] != cols[2][0])

    def rows(pairs):
        found = _Pairs()
        for pair in pairs:
            found.add(pair)
        return pa.RecordBatch.from_arrays(found.columns(), names=["a", "b"])

    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        sks = batch.column("sk").to_pylist()
        if held is not None:
            cols, sks = [np.concatenate([x, y]) for x, y in zip(held[0], cols)], held[1] + sks
        cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
        cut = np.concatenate([[0], cut])
        found = [close([c[x:y] for c in cols], sks[x:y]) for x, y in zip(cut[:-1], cut[1:]) if y - x > 1]
        last = cut[-1]
        held = [c[last:] for c in cols], sks[last:]
        if found:
            yield rows(found)
    if held is not None and len(held[1]) > 1:
        yield rows([close(*held)])


# -- the join --------------------------------------------------------------------

def _links(pairs: DataFrame, tagged: DataFrame, sets: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) of nodes that link, verified on whole texts."""
    pairs = write_table(pairs.select("a", "b"), "jaccard-pairs")
    if pairs.isEmpty():
        return pairs
    nodes = pairs.select(F.col("a").alias("_fp")).unionAll(pairs.select(F.col("b").alias("_fp"))).distinct()
    # Written, so that the planner knows its size and spares the texts a shuffle where it is small.
    chosen = write_table(sets.join(nodes, "_fp").select("_fp", "_id"), "jaccard-chosen")
    texts = write_table(
        tagged.select(F.col("_fp"), F.col("_id").alias("_i"), F.col(text).alias("_t"))
        .join(chosen.withColumnRenamed("_fp", "_f"),
              (F.col("_fp") == F.col("_f")) & F.col("_i").eqNullSafe(F.col("_id")), "left_semi")
        .dropDuplicates(["_fp"]).select("_fp", "_t"), "jaccard-texts")
    left = texts.select(F.col("_fp").alias("a"), F.col("_t").alias("ta"))
    right = texts.select(F.col("_fp").alias("b"), F.col("_t").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    found = both.mapInArrow(_verify, "a long, b long, shared long, together long")
    return write_table(found.where("100 * shared >= 80 * together").select("a", "b"), "jaccard-links")


def _sketched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sketches are near enough for a link."""
    s = sets.select("_fp", "_n", "_sketch")
    a, b = s.toDF("a", "na", "sa"), s.toDF("b", "nb", "sb")
    both = (pairs.join(a, "a").join(b, "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")
            .select("a", "b", "na", "nb", "sa", "sb"))
    return both.mapInArrow(_near, "a long, b long")


def _parts(open_: DataFrame) -> DataFrame:
    """Open blocks (key, c rows, least document, groups) with the part that compares
    each.  Blocks with one smallest document mostly hold the same documents, so
    they share a part; a part has about ``PART_BLOCKS`` rows, and the blocks of a
    document with more are dealt to several parts by their names."""
    rows = open_.where("groups = 1").agg(F.sum("c")).first()[0] or 0
    parts = max(8, math.ceil(rows / PART_BLOCKS))
    size = open_.where("groups = 1").groupBy("least").agg(F.ceil(F.sum("c") / PART_BLOCKS).alias("w"))
    apart = F.xxhash64("least", F.pmod(F.xxhash64("key"), F.col("w")))
    part = F.when(F.col("w") > 1, apart).otherwise(F.pmod(F.xxhash64("least"), F.lit(parts)))
    return open_.join(size, "least", "left").select("key", "groups", part.alias("part"))


def _join(p: DataFrame, text: str, id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Row table (_id, _n, _fp), root of every linked node, and the tagged rows."""
    src = p.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    feats = T.StructType([T.StructField("_id", src.schema["_id"].dataType), T.StructField("_n", T.LongType()),
                          T.StructField("_fp", T.LongType()), T.StructField("_fp2", T.LongType()),
                          T.StructField("_sketch", T.BinaryType())])
    rows = write_table(src.mapInArrow(_tag("_text", True), feats), "jaccard-rows")
    sets = write_table(rows.where("_n > 0").groupBy("_fp").agg(
        F.min("_id").alias("_id"), F.max("_n").alias("_n"), F.first("_sketch").alias("_sketch"),
        (F.count_distinct("_fp2") > 1).alias("_clash")), "jaccard-sets")
    total = sets.agg(F.sum("_n"), F.max("_clash")).first()
    if total[1]:
        raise ValueError("two different shingle sets share a 64-bit fingerprint")
    parts = max(8, math.ceil((total[0] or 0) * 0.5 / PART_ROWS))
    shared = write_table(src.select("_text").mapInArrow(_offer("_text", parts), "part int, kind int, blob binary")
                         .groupBy("part").applyInArrow(_meet, _SHARED), "jaccard-blocks")

    tagged = _tagged(src, "_text")
    stars = write_table(shared.where("fp <> hub").groupBy("fp", "hub").agg(F.count(F.lit(1)).alias("c")), "jaccard-stars")
    best = stars.groupBy("fp").agg(F.max_by("hub", F.struct("c", -F.col("hub"))).alias("hub"))
    links = _links(_sketched(best.select(F.col("fp").alias("a"), F.col("hub").alias("b")), sets), tagged, sets, "_text")
    root = components(links)

    def rooted(df: DataFrame, node: str, out: str) -> DataFrame:
        r = root.select(F.col("node").alias(node), F.col("root").alias(out))
        return df.join(r, node, "left").withColumn(out, F.coalesce(out, F.col(node)))

    # Further partners of a block's smallest document, where the components still differ.
    more = rooted(rooted(stars.select("fp", "hub"), "fp", "ra"), "hub", "rb").where("ra <> rb")
    more = _sketched(more.select(F.col("fp").alias("a"), F.col("hub").alias("b")), sets)
    new = _links(more, tagged, sets, "_text")
    if not new.isEmpty():
        links = links.unionAll(new)
        root = components(links)

    # What is left: blocks whose documents are still in several components.
    held = rooted(shared.select("key", "fp"), "fp", "r").unionAll(
        rooted(shared.select("key", F.col("hub").alias("fp")).distinct(), "fp", "r").select("fp", "key", "r")).distinct()
    open_ = write_table(held.groupBy("key").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("c"),
                                                F.min("fp").alias("least"))
                        .where("lo <> hi").select("key", "c", "least", F.ceil(F.col("c") / GROUP).alias("groups")), "jaccard-open")
    held = write_table(held.join(_parts(open_), "key"), "jaccard-held")
    sized = sets.select(F.col("_fp").alias("fp"), F.col("_n").alias("n"), F.col("_sketch").alias("sk"))
    # A document's sketch goes once to a part, however many of its blocks are there.
    packed = held.where("groups = 1").groupBy("part", "fp", "r").agg(F.collect_list("key").alias("keys")).join(sized, "fp")
    cross = packed.groupBy("part").applyInArrow(_near_in_part, "a long, b long")
    large = held.where("groups > 1").join(sized, "fp").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("groups")))
    large = large.select("key", "own", "fp", "r", "n", "sk", F.explode(F.expr(
        "transform(sequence(0L, groups - 1), g -> struct(least(own, g) as i, greatest(own, g) as j))")).alias("at"))
    large = (large.select("key", "at.i", "at.j", "own", "fp", "r", "n", "sk")
             .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_near_across, "a long, b long"))
    cross = cross.unionAll(large).distinct()
    new = _links(cross, tagged, sets, "_text")
    if not new.isEmpty():
        root = components(links.unionAll(new))
    return rows, root, tagged


def _with_component(rows: DataFrame, root: DataFrame) -> DataFrame:
    rooted = (rows.join(root.withColumnRenamed("node", "_fp"), "_fp", "left")
              .withColumn("_root", F.coalesce("root", "_fp")).drop("root"))
    least = rooted.where("_n > 0").groupBy("_root").agg(F.min("_id").alias("_least"))
    return rooted.join(least, "_root", "left").withColumn(
        "component_id", F.when(F.col("_n") > 0, F.col("_least")).otherwise(F.col("_id")))


def jaccard_components(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n_shingles, component_id of every row."""
    p, names = positional(docs)
    rows, root, _ = _join(p, position(names, text), position(names, id))
    return _with_component(rows, root).select(F.col("_id").alias(id), F.col("_n").alias("n_shingles"), "component_id")


def one_per_component(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows that stay, all columns: of each component the one with the
    smallest id (repeated rows once), and every row with an empty set."""
    p, names = positional(docs)
    t, i = position(names, text), position(names, id)
    rows, root, _ = _join(p, t, i)
    found = _with_component(rows, root).where("_n > 0")
    each = found.groupBy("_root", "_id", "_fp").agg(F.count(F.lit(1)).alias("_c"))
    stay = write_table(each.groupBy("_root").agg(F.min(F.struct("_id", "_fp", "_c")).alias("s")).select("s.*"), "jaccard-stay")
    full = _tagged(p, t)
    linked = full.where("_n > 0").join(stay.withColumnRenamed("_fp", "_f"),
                                       (F.col("_fp") == F.col("_f")) & F.col(i).eqNullSafe(F.col("_id")), "left_semi")
    if not stay.where("_c > 1").isEmpty():  # repeated rows of one id and set: one of them
        linked = linked.dropDuplicates(["_fp"])
    out = linked.unionByName(full.where("_n = 0")).select(*p.columns)
    return restore(out, names, [])


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir).select("doc_id", "text"))
