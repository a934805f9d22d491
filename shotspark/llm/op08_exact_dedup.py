"""Exact duplicates by distributed MSD radix partitioning.

A text is read as the string (byte length, byte 1, byte 2, ...).  Rows are
split by successive digits of that string, each digit a run of bytes, until a
group is a singleton or its text has ended.  Equality is decided by the bytes
themselves; no digest takes part.

* The first digit (length and the first ``first`` bytes) is counted over the
  whole table with map-side partial counts.  Only rows of groups of two or
  more go on; all others are singletons and pass through unchanged.
* Each later round counts (group, next digit).  A group of copies, however
  large, is one row per map task before the shuffle.  Rows find their new
  group by a join that AQE splits when one group is hot.
* Digits grow by the factor ``growth``, so a text of n bytes needs about
  log(n) rounds and every byte is compared once.
* Each round's state is written to the shared checkpoint folder, so a lost
  executor costs task retries and the lineage stays one round long.

Defined cases: null text counts as empty, and all empty texts are equal.  Of
equal texts the largest id stays, a null id is smaller than any other, and of
repeated rows with the same id exactly one stays.  An empty table gives an
empty result.  Input columns named like a result column are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.llm.common import (LOWER, UPPER, documents, lower_ascii, position, positional, restore,
                                  write_table)

OWN = ["keep_id", "group_size", "kept"]


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", first: int = 64,
                growth: int = 16, longest: int = 1 << 24) -> DataFrame:
    """Every input row with keep_id, group_size and kept."""
    p, names = positional(docs)
    t, i = position(names, text), position(names, id)
    txt = F.coalesce(F.col(t), F.lit(""))
    # Lowering A-Z keeps byte lengths, and `first` characters hold `first` bytes.
    head = F.substring(lower_ascii(F.substring(txt, 1, first)).cast("binary"), 1, first)
    base = p.withColumn("_n", F.octet_length(txt).cast("long")).withColumn("_head", head)
    live = (base.groupBy("_n", "_head").agg(F.count(F.lit(1)).alias("_c"))
            .where("_c > 1").select("_n", "_head"))
    # Groups of copies grow with the data: no join here may turn into a broadcast
    # of them, so each one asks for a merge join, which AQE splits at a hot group.
    live = write_table(live, "radix-live").hint("merge")
    singles = base.join(live, ["_n", "_head"], "left_anti").select(
        *p.columns, F.col(i).alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"))

    pool = write_table(base.join(live, ["_n", "_head"], "left_semi")
                       .withColumn("_rid", F.monotonically_increasing_id()).drop("_head"), "radix-pool")
    state = pool.select("_rid", F.col("_n").alias("_gid"), "_n",
                        lower_ascii(F.coalesce(F.col(t), F.lit(""))).cast("binary").alias("_rest"))
    ended, offset, width = [], 0, first
    while True:
        digit = F.substring(F.col("_rest"), 1, width)
        cut = state.withColumn("_digit", digit).withColumn("_rest", F.expr(f"substring(_rest, {width + 1})"))
        # Written, so that both sides of the join are shuffled anew and AQE can
        # split a hot group; below an aggregate it could not.
        groups = write_table(cut.groupBy("_gid", "_digit")
                             .agg(F.count(F.lit(1)).alias("_c"), F.max("_rid").alias("_new"))
                             .where("_c > 1").drop("_c"), "radix-groups")
        state = write_table(cut.join(groups.hint("merge"), ["_gid", "_digit"])
                            .select("_rid", F.col("_new").alias("_gid"), "_n", "_rest"), "radix-round")
        offset += width
        ended.append(state.where(F.col("_n") <= offset).select("_rid", "_gid"))
        state = state.where(F.col("_n") > offset)
        if state.isEmpty():
            break
        width = min(width * growth, longest)

    same = reduce(DataFrame.unionAll, ended)
    member = same.join(pool.select("_rid", F.col(i).alias("_id")).hint("merge"), "_rid")
    best = write_table(member.groupBy("_gid").agg(F.max(F.struct("_id", "_rid")).alias("_top"),
                                                  F.count(F.lit(1)).alias("_size")), "radix-best")
    decided = same.join(best.hint("merge"), "_gid").select("_rid", "_top", "_size")
    copies = pool.join(decided.hint("merge"), "_rid", "left").select(
        *p.columns,
        F.when(F.col("_size").isNull(), F.col(i)).otherwise(F.col("_top._id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_top._rid") == F.col("_rid"), F.lit(True)).alias("kept"))
    return restore(singles.unionByName(copies), names, OWN)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the row that stays, the group's size and the
    SHA-256 of the normalised text (a report column, not used to compare)."""
    out = exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept",
                      F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256).alias("text_sha256"))


SQL = f"""
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
