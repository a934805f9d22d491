"""Token ids in length-delimited binary records, with an offset index.

File format (``data/``, shards in ascending order of id):

    record  := length u64 | masked(length) u32 | payload | masked(payload) u32 | 0x0A
    payload := flags u8 | id i64 | token ids, u16 or u32 each

All numbers are little-endian; ``length`` is the payload's; ``masked`` is the
CRC-32 rotated right by 15 bits plus 0xA282EAD8, so that checksums of data that
hold checksums stay useful; bit 0 of the flags marks a null id, bit 1 says u32.
The last byte lets Spark's text writer, with its commit protocol, write the
files on any file system: a lost executor or a repeated task leaves no part of
a record behind.

The index (``index/``, Parquet) is made by reading the shards back: shard,
record, byte offset, length, id, number of ids, their CRC-32, and the number
of ids before the record in its shard.  ``read_at`` fetches single records by
it, for shuffled reads; ``read_all`` passes over whole shards.

Texts are dealt by range of (id, hash) into shards of about ``shard_bytes`` of
text, the number following the table's size.  The tokenizer library encodes
each distinct word of a batch once, and the worker keeps the ids of a bounded number
of words for its next batches (see ``encode_texts``).

Defined cases: a special token's string in a text is ordinary text, or with
``specials`` that token, as is the library's default and what the query takes; a
null or empty text has the end id alone; null ids come first; rows with one id are in the order of their texts' hashes and their texts;
repeated rows are repeated records; an empty table writes no record.
"""

from __future__ import annotations

import json
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotspark.llm.common import documents, pick, scratch_path
from shotspark.llm.ragged import gather

END_ID = 1
_HEAD = struct.Struct("<QI")
_INDEX = ("shard string, record long, offset long, length long, id long, n_tokens long, ids_crc32 long, "
          "before long")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join([size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload)), b"\n"])


def payload_of(row_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids) and ids.max() > 0xFFFF)
    flags = (row_id is None) | wide << 1
    return struct.pack("<Bq", flags, row_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def parse_payload(payload) -> tuple[int | None, np.ndarray]:
    flags, row_id = struct.unpack_from("<Bq", payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9)
    return (None if flags & 1 else row_id), ids.astype("<u4")


def record_at(data, offset: int):
    """Payload of the record at a byte offset, and where the next one begins."""
    size, check = _HEAD.unpack_from(data, offset)
    if masked(bytes(data[offset:offset + 8])) != check:
        raise ValueError(f"damaged record length at byte {offset}")
    payload = data[offset + 12:offset + 12 + size]
    end = offset + 12 + size
    if struct.unpack_from("<I", data, end)[0] != masked(bytes(payload)) or data[end + 4] != 10:
        raise ValueError(f"damaged record at byte {offset}")
    return payload, end + 5


# -- encoding ----------------------------------------------------------------------

_tokenizers: dict[tuple[int, bool], object] = {}


def _tokenizer(spec: str, specials: bool):
    """The tokenizers library's object for a JSON description, one a worker."""
    key = zlib.crc32(spec.encode()), specials
    if key not in _tokenizers:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        t = Tokenizer.from_str(spec)
        t.encode_special_tokens = not specials
        _tokenizers.clear()
        _tokenizers[key] = t, _Known(t) if _word_by_word(spec) else None
    return _tokenizers[key]


def _word_by_word(spec: str) -> bool:
    """Whether white space always parts words and leaves no trace: then words
    may be encoded apart.  Known of a pre-tokenizer that drops white space
    between its matches, behind a normalizer that works character by character,
    with added tokens that neither hold white space nor take any in."""
    s = json.loads(spec)
    if any(a.get("lstrip") or a.get("rstrip") or a["content"].split() != [a["content"]]
           for a in s.get("added_tokens") or []):
        return False
    norms = s.get("normalizer") or {}
    norms = norms.get("normalizers", [norms])
    pres = s.get("pre_tokenizer") or {}
    pres = pres.get("pretokenizers", [pres])
    return (all(n.get("type") in ("NFC", "Lowercase", "Replace", None) for n in norms)
            and pres[0].get("type") == "Split" and pres[0].get("behavior") == "Removed" and pres[0].get("invert")
            and r"\s\p{L}\p{N}" in pres[0]["pattern"].get("Regex", "") and not s.get("post_processor"))


def _encode_words(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and how many each word has.  A thousand
    words go into one call, parted by blanks; a token belongs to the word in which
    its characters begin."""
    flat, length = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for a in range(0, len(words), 1000):
        some = words[a:a + 1000]
        found = tokenizer.encode(" ".join(some), add_special_tokens=False)
        begin = np.cumsum([0, *(len(w) + 1 for w in some[:-1])])
        at = np.searchsorted(begin, np.array([o[0] for o in found.offsets], np.int64), "right") - 1
        flat.append(np.array(found.ids, np.uint32))
        length.append(np.bincount(at, minlength=len(some)))
    return np.concatenate(flat), np.concatenate(length)


class _Known:
    """The ids of words that a worker met before, for its later batches: the first
    ``most`` of them, among which are the frequent ones, so memory is bounded.  The
    words are one Arrow array, a tenth of a dictionary's size, hashed once a batch."""

    def __init__(self, tokenizer, most: int = 300_000):
        self.tokenizer, self.most, self.words = tokenizer, most, pa.array([], pa.large_string())
        self.flat, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in one array, and start and length of those of each of the (distinct) words."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = words.filter(pa.array(at < 0))
        at[at < 0] = len(self.words) + np.arange(len(new))
        flat, length = _encode_words(self.tokenizer, new.to_pylist())
        flat, length = np.concatenate([self.flat, flat]), np.concatenate([self.length, length.astype(np.int32)])
        if len(new) and len(self.words) < self.most:
            self.words = pa.concat_arrays([self.words, new.slice(0, self.most - len(self.words))])
            self.length = length[:len(self.words)].copy()
            self.flat = flat[:int(self.length.sum())].copy()
        start = np.cumsum(length, dtype=np.int64) - length
        return flat, start[at], length[at].astype(np.int64)


def encode_texts(spec: str, texts: pa.Array, specials: bool = False) -> list[np.ndarray]:
    """Ids of each text, equal to the library's for the whole text.

    The vocabulary's words end at white space and white space leaves no token,
    so a text's ids are its words' ids in order.  Each distinct word of the
    array is encoded once, and not again in the worker's next arrays.  Tokenizers of
    another kind get whole texts.
    """
    tokenizer, known = _tokenizer(spec, specials)
    texts = texts.fill_null("")
    if known is None:
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
    pieces = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    coded = pieces.flatten().dictionary_encode()
    flat, start, length = known(coded.dictionary)
    index = coded.indices.to_numpy()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy(), dtype=np.int64)])
    return [gather(flat, start, length, index[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def _to_records(spec, end_id: int, specials: bool, batch_bytes: int = 1 << 21):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
            at = 0
            while at < len(texts):  # texts of bounded total length at a time
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + batch_bytes, "right")))
                ids = batch.column("id").slice(at, to - at).to_pylist()
                rows = [frame(payload_of(i, np.append(t, np.uint32(end_id))))[:-1]
                        for i, t in zip(ids, encode_texts(spec.value, texts.slice(at, to - at), specials))]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["record"])
                at = to

    return run


def write_records(docs: DataFrame, spec: str, path: str, text: str = "text", id: str = "doc_id", end_id: int = END_ID,
                  shard_bytes: int = 32 << 20, specials: bool = False) -> str:
    """Encode every text with the tokenizer described by ``spec`` (the JSON
    text of the tokenizers library) and write shards and index below ``path``."""
    spark = docs.sparkSession
    src = pick(docs, id=id, text=text).withColumn("id", F.col("id").cast("long"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    dealt = src.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text")
    described = spark.sparkContext.broadcast(spec)
    (dealt.mapInArrow(_to_records(described, end_id, specials), "record binary")
     .select(F.col("record").cast("string").alias("value")).write.text(f"{path}/data"))
    (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select("path", "content")
     .mapInArrow(_index, _INDEX).write.parquet(f"{path}/index"))
    return path


# -- reading -----------------------------------------------------------------------

def _shard(path: str) -> str:
    return path.rsplit("/", 1)[1].split("-")[1]


def _records(data):
    at = 0
    while at < len(data):
        payload, end = record_at(data, at)
        yield at, end - at, payload
        at = end


def _index(batches):
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows, before = [], 0
            for k, (at, size, payload) in enumerate(_records(memoryview(data.as_buffer()))):
                row_id, ids = parse_payload(payload)
                rows.append((_shard(path), k, at, size, row_id, len(ids), zlib.crc32(ids.tobytes()), before))
                before += len(ids)
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(cols)],
                names=[c.split()[0] for c in _INDEX.split(", ")])


def index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index, with ``start``: the number of ids of all records before.

    Shards are few (one per ``shard_bytes`` of text); only their sums are
    ordered in one task."""
    rows = spark.read.parquet(f"{path}/index")
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("base"))
    return rows.join(sums, "shard").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def _contents(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return files.select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).alias("shard"), "content")


_SEQUENCES = "shard string, record long, id long, ids array<long>"


def _sequence_rows(rows):
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
         pa.array(cols[3], pa.list_(pa.int64()))], names=["shard", "record", "id", "ids"])


def _all_sequences(batches):
    for batch in batches:
        for shard, data in zip(batch.column("shard").to_pylist(), batch.column("content")):
            rows = []
            for k, (_, _, payload) in enumerate(_records(memoryview(data.as_buffer()))):
                row_id, ids = parse_payload(payload)
                rows.append((shard, k, row_id, ids.astype(np.int64)))
                if len(rows) == 1000:
                    yield _sequence_rows(rows)
                    rows = []
            yield _sequence_rows(rows)


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """Every sequence: shard, record, id, ids."""
    return _contents(spark, path).mapInArrow(_all_sequences, _SEQUENCES)


def _wanted(batches):
    for batch in batches:
        for shard, data, at in zip(batch.column("shard").to_pylist(), batch.column("content"), batch.column("at").to_pylist()):
            view, rows = memoryview(data.as_buffer()), []
            for x in sorted(at, key=lambda x: x["offset"]):
                row_id, ids = parse_payload(record_at(view, x["offset"])[0])
                rows.append((shard, x["record"], row_id, ids.astype(np.int64)))
            yield _sequence_rows(rows)


def read_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The sequences at the (shard, record) rows of ``wanted``: the index gives
    their offsets, so no other record is parsed."""
    rows = spark.read.parquet(f"{path}/index").join(wanted.select("shard", "record").distinct(), ["shard", "record"])
    # At most a shard's records meet in one row.
    at = rows.groupBy("shard").agg(F.collect_list(F.struct("record", "offset")).alias("at"))
    return _contents(spark, path).join(at, "shard").mapInArrow(_wanted, _SEQUENCES)


def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, write and read back; one row per document from the files."""
    import public_tokenizers
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    path = write_records(documents(spark, sf_dir), spec, scratch_path(spark, "records"), specials=True)
    return index(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "shard", "record", "offset")
