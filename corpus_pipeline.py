"""The corpus pipeline: stages over documents, each calling one llm operator.

1. language ID: documents whose language is not known for sure go;
2. exact dedup: of equal texts one row stays;
3. n-gram Jaccard join: of each group of near copies one document stays;
4. mixing: each document is repeated as often as the mix of sources takes it;
5. byte-level BPE: ids and decoded bytes of every row, as digests.

Each stage is given the rows that the one before it kept, as a Parquet table,
and all but the last return the columns of documents.  Rows with null text go
in the first stage; null ids, repeated rows, empty tables and further columns
are carried as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.llm.common import documents, position, positional, write_table
from shotspark.llm.op01_language_id import identify, train
from shotspark.llm.op02_mixing import mix
from shotspark.llm.op03_jaccard_join import one_per_component
from shotspark.llm.op08_exact_dedup import exact_dedup
from shotspark.llm.op09_byte_bpe import digests, encode_decode, public_tokenizer

#: Characters of a block of stage 5: fewer than op9's own, as the stages before leave a
#: worker less memory; more blocks repeat more words in the shuffle, which has room here.
BLOCK_CHARS = 4_000_000


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (1): rejected documents go."""
    p, names = positional(docs)
    out = identify(p, train(docs), position(names, "text")).where("accepted")
    return out.select(*p.columns).toDF(*names)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (8): one row of each group of equal texts stays."""
    p, names = positional(docs)
    out = exact_dedup(p, position(names, "text"), position(names, "doc_id")).where("kept")
    return out.select(*p.columns).toDF(*names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (3): one document of each component stays."""
    return one_per_component(docs)


def take_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (2): every row as many times as the mix takes it."""
    p, names = positional(docs)
    out = mix(p, position(names, "text"), position(names, "doc_id"), position(names, "source")).where("copies > 0")
    out = out.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return out.select(*p.columns).toDF(*names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE (9): doc_id, n_tokens and digests of ids and decoded bytes."""
    return digests(encode_decode(docs, public_tokenizer(), block_chars=BLOCK_CHARS))


STAGES = [
    ("language ID", keep_known_languages),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", take_mix),
    ("byte-level BPE", encode),
]

# Training, random rounding and BPE are beyond SQL; tests/llm compares the
# rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written as Parquet and reread."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, f"pipeline-{k}")
    return docs
