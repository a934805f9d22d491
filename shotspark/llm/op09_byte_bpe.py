"""Byte-level BPE with a global shuffle of distinct words.

* *Blocks.* Whole texts are cut into words at spaces, where no match of the
  tokenizer's pattern can cross: a word is a space and what follows it up to
  the next one, and longer runs of white space stay in one piece.  A block of
  texts (``block_chars`` characters) is stored as the list of its distinct
  words and, for each text, the words' places in that list.
* *Encode once.* The distinct words of all blocks are dealt by a hash of the
  word; each is encoded once, however many blocks it occurs in, and its ids go
  back to every block that has it.
* *Reassemble.* A block joins its words' ids and strings them together by
  position.
* *Decode.* Ids join the token-byte table, whose size is the vocabulary's.

The shuffles move compressed blocks, not one row a word: a frequent word is
one entry per block.  The ranks (about 50,000 rows) are read on the driver and
broadcast, so that executors need no tokenizer file.

Defined cases: a null or empty text has no ids and decodes to no bytes; ids of
rows may repeat or be null, each row gets its own result; an empty table gives
an empty result; other columns are not carried.
"""

from __future__ import annotations

import base64
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.llm.common import documents, pick
from shotspark.llm.ragged import expand, from_planes, gather, planes, squeeze
from shotspark.llm.wordsets import string_hashes

#: White space as the pattern's \\s has it; the rarer ones apart.
_RARE = "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WHITE = "\t\n\x0b\x0c\r " + _RARE
#: Texts in which some space may not be a place to cut: rare white space, a
#: space before white space, or a space at the end.
_CAREFUL = f" [{WHITE}]| $|[{_RARE}]"
BLOCK_CHARS = 16_000_000
PART_BYTES = 256 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def public_tokenizer(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of a public vocabulary."""
    import public_tokenizers
    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def cut_words(text: str) -> list[str]:
    """Pieces of a text that the pattern treats alike alone and in the text:
    cut before each space, but for one between white space and white space
    (or the end), which belongs to the run before it."""
    out, now = [], None
    for piece in text.split(" "):
        if now is None:
            now = piece
        elif now and now[-1] in WHITE and (not piece or piece[0] in WHITE):
            now += " " + piece
        else:
            if now:
                out.append(now)
            now = " " + piece
    if now:
        out.append(now)
    return out


def _words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of an array of texts, each text's words by place, and
    the number of words before each text (one more than texts)."""
    texts = texts.fill_null("").cast(pa.large_string())
    careful = pc.match_substring_regex(texts, _CAREFUL).to_numpy(zero_copy_only=False)
    plain = np.flatnonzero(~careful)
    pieces = pc.split_pattern(texts.take(pa.array(plain)), " ")
    flat, ends = pieces.flatten(), pc.list_value_length(pieces).to_numpy().cumsum()
    coded = flat.dictionary_encode()
    led = coded.indices.to_numpy().astype(np.int64)          # words behind a space
    empty = pa.scalar("", pa.large_string())
    spaced = pc.binary_join_element_wise(empty, coded.dictionary, pa.scalar(" ", pa.large_string()))
    firsts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(plain) else np.zeros(0, np.int64)
    head = flat.take(pa.array(firsts)).dictionary_encode()   # a text's first word has no space
    led[firsts] = head.indices.to_numpy() + len(spaced)
    special = [cut_words(texts[int(k)].as_py()) for k in np.flatnonzero(careful)]
    rest = pa.array([w for ws in special for w in ws], pa.large_string()).dictionary_encode()
    odd = rest.indices.to_numpy().astype(np.int64) + len(spaced) + len(head.dictionary)
    vocabulary = pa.concat_arrays([spaced.cast(pa.large_string()), head.dictionary.cast(pa.large_string()),
                                   rest.dictionary.cast(pa.large_string())])
    count = np.zeros(len(texts), np.int64)
    count[plain] = np.diff(ends, prepend=0)
    count[careful] = [len(ws) for ws in special]
    first = np.concatenate([[0], np.cumsum(count)])
    places = np.empty(int(first[-1]), np.int64)
    is_odd = np.repeat(careful, count)
    places[~is_odd], places[is_odd] = led, odd
    return vocabulary, places, first


def _string_blob(words: pa.Array) -> tuple[bytes, bytes]:
    """Byte lengths by planes, and the bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = words.buffers()[2]
    return planes(np.diff(offsets).astype(np.uint32)), data.to_pybytes()[offsets[0]:offsets[-1]] if data else b""


_BLOCK = T.StructType([T.StructField("block", T.LongType()), T.StructField("part", T.IntegerType()),
                       T.StructField("mark", T.LongType()), T.StructField("data", T.BinaryType())])


def _to_blocks(parts: int, chars: int, id_type: pa.DataType):
    """Texts to blocks: one row of positions (part -1) and one row of words for
    each partition that has some."""

    def block(number: int, ids: pa.Array, texts: pa.Array):
        vocabulary, places, first = _words_of(texts)
        # Frequent words get small numbers, which compress well.
        count = np.bincount(places, minlength=len(vocabulary))
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        vocabulary = vocabulary.take(pa.array(order))
        part = (string_hashes(vocabulary) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        mark = len(vocabulary) << 32 | zlib.crc32(_string_blob(vocabulary)[1])
        rows = []
        by = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[by], np.arange(parts + 1, dtype=np.uint64))
        for q in range(parts):
            own = by[cut[q]:cut[q + 1]]  # ascending numbers
            if len(own):
                rows.append((q, squeeze(planes(np.diff(own, prepend=0).astype(np.uint32)),
                                        *_string_blob(vocabulary.take(pa.array(own))))))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("id", id_type)])) as w:
            w.write_batch(pa.record_batch([ids.cast(id_type)], names=["id"]))
        rows.append((-1, squeeze(sink.getvalue().to_pybytes(), planes(first.astype(np.uint64)),
                                 planes(rank[places].astype(np.uint32)))))
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
             pa.array([mark] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
            names=["block", "part", "mark", "data"])

    def run(batches):
        from pyspark import TaskContext
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            t = batch.column("text").cast(pa.large_string())
            size = np.cumsum(pc.fill_null(pc.utf8_length(t), 0).to_numpy())
            at = 0
            while at < len(t):
                base = size[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(size, base + chars - held, "right")))
                ids.append(batch.column("id").slice(at, to - at)), texts.append(t.slice(at, to - at))
                held += int(size[to - 1] - base)
                at = to
                if held >= chars:
                    yield block(number, pa.concat_arrays(ids), pa.concat_arrays(texts))
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield block(number, pa.concat_arrays(ids), pa.concat_arrays(texts))

    return run


def _only_words(batches):
    for batch in batches:
        yield batch.filter(pc.greater_equal(batch.column("part"), 0))


class _Encoder:
    """tiktoken over broadcast ranks, one a worker."""

    kept: dict[int, object] = {}

    @classmethod
    def of(cls, ranks):
        if ranks.id not in cls.kept:
            import tiktoken
            table, pattern = ranks.value
            cls.kept = {ranks.id: tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})}
        return cls.kept[ranks.id]


class _Broadcast:
    """A broadcast value with a name that workers can keep things by."""

    def __init__(self, spark: SparkSession, value):
        self.held = spark.sparkContext.broadcast(value)
        self.id = hash(str(sorted((k, len(v)) for k, v in [("pattern", value[1]), ("ranks", value[0])])) +
                       str(zlib.crc32(b"".join(sorted(value[0])))))

    @property
    def value(self):
        return self.held.value


def _encode_words(ranks):
    """All words of one partition, from all blocks: each distinct one once."""

    def run(table: pa.Table) -> pa.Table:
        encoder = _Encoder.of(ranks)
        own, words = [], []
        for data in table.column("data"):
            place, lengths, raw = expand(data.as_py())
            n = len(place) // 4
            offsets = np.concatenate([[0], np.cumsum(from_planes(lengths, np.uint32, n), dtype=np.int64)])
            own.append(bytes(place))
            words.append(pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)]))
        coded = pa.concat_arrays(words).dictionary_encode()
        ids = [encoder.encode_ordinary(w) for w in coded.dictionary.to_pylist()]
        length = np.array([len(x) for x in ids], np.int64)
        flat = np.array([x for y in ids for x in y], np.uint32)
        start, index, at, out = np.cumsum(length) - length, coded.indices.to_numpy(), 0, []
        for place, w in zip(own, words):
            mine = index[at:at + len(w)]
            at += len(w)
            out.append(squeeze(place, planes(length[mine].astype(np.uint32)), planes(gather(flat, start, length, mine))))
        return pa.table([table.column("block"), table.column("part"), table.column("mark"), pa.array(out, pa.binary())],
                        names=["block", "part", "mark", "data"])

    return run


def _assemble(ranks, id_type: pa.DataType):
    """A block's positions and its words' ids to (id, ids, decoded) rows."""

    def run(blocks: pa.Table, encoded: pa.Table) -> pa.Table:
        mine = [(m.as_py(), d.as_py()) for p, m, d in zip(blocks.column("part"), blocks.column("mark"), blocks.column("data"))
                if p.as_py() == -1]
        out = []
        for mark, data in mine:
            ipc, first, places = expand(data)
            ids = pa.ipc.open_stream(pa.py_buffer(ipc)).read_all().column("id").combine_chunks()
            first = from_planes(first, np.uint64, len(first) // 8).astype(np.int64)
            places = from_planes(places, np.uint32, len(places) // 4)
            size = mark >> 32
            length, start, flat, at = np.full(size, -1, np.int64), np.zeros(size, np.int64), [], 0
            for other, blob in zip(encoded.column("mark"), encoded.column("data")):
                if other.as_py() != mark:
                    raise ValueError("a block was cut anew while its words were encoded; run the job again")
                own, sizes, tokens = expand(blob.as_py())
                n = len(own) // 4
                own = np.cumsum(from_planes(own, np.uint32, n), dtype=np.int64)
                length[own] = from_planes(sizes, np.uint32, n)
                start[own] = at + np.cumsum(length[own]) - length[own]
                flat.append(from_planes(tokens, np.uint32, len(tokens) // 4))
                at += len(flat[-1])
            if size and length.min() < 0:
                raise ValueError("some words of a block came back without ids")
            flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
            table = _token_bytes(ranks)
            tokens, decoded = [], []
            for k in range(len(ids)):
                row, text = [], []
                for a in range(first[k], first[k + 1], 1 << 20):  # long texts in slices
                    t = gather(flat, start, length, places[a:min(a + (1 << 20), first[k + 1])])
                    row.append(t.astype("<u4").tobytes())
                    text.append(gather(*table, t).tobytes())
                tokens.append(b"".join(row)), decoded.append(b"".join(text))
            out.append(pa.table([ids, pa.array(tokens, pa.binary()), pa.array(decoded, pa.binary())],
                                names=["id", "ids", "decoded"]))
        if not out:
            return pa.table([pa.array([], id_type), pa.array([], pa.binary()), pa.array([], pa.binary())],
                            names=["id", "ids", "decoded"])
        return pa.concat_tables(out)

    return run


_tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _token_bytes(ranks):
    """The token-byte table: bytes, starts and lengths by id."""
    if ranks.id not in _tables:
        by_id = {v: k for k, v in ranks.value[0].items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        length = np.array([len(t) for t in tokens], np.int64)
        _tables.clear()
        _tables[ranks.id] = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length
    return _tables[ranks.id]


def encode_decode(docs: DataFrame, tokenizer: tuple[dict[bytes, int], str], text: str = "text", id: str = "doc_id",
                  block_chars: int = BLOCK_CHARS, parts: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row: id, ids (binary, little-endian unsigned 32-bit) and decoded
    (binary, the bytes that the ids stand for).  The words are dealt to ``parts``
    partitions, by default one for ``part_bytes`` of text and at least Spark's
    number of shuffle partitions, so that a task's words do not grow with the
    table."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark = docs.sparkSession
    src = pick(docs, id=id, text=text)
    id_type = to_arrow_type(src.schema["id"].dataType)
    if not parts:
        total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / part_bytes))
    ranks = _Broadcast(spark, tokenizer)
    # One exchange feeds both the words that go out and the positions that stay.
    blocks = src.mapInArrow(_to_blocks(parts, block_chars, id_type), _BLOCK).repartition("block")
    encoded = blocks.mapInArrow(_only_words, _BLOCK).groupBy("part").applyInArrow(_encode_words(ranks), _BLOCK)
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("ids", T.BinaryType()),
                           T.StructField("decoded", T.BinaryType())])
    return (blocks.groupBy("block").cogroup(encoded.groupBy("block"))
            .applyInArrow(_assemble(ranks, id_type), schema).withColumnRenamed("id", id))


def digests(out: DataFrame, id: str = "doc_id") -> DataFrame:
    return out.select(F.col(id), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(documents(spark, sf_dir), public_tokenizer()))
