"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words; target / size gives each of its
documents the same fractional number of copies.  The whole part is taken at
once, the fractional part is rounded so that the source's words are kept:

* *Pair.* Two documents with fractional parts p, q and sizes a, b exchange
  mass along a*p + b*q = constant until one part is 0 or 1; which way is drawn
  at random with the odds that keep both expectations.
* *Leaves.* Documents are dealt to leaves by a hash of their key, so the draw
  depends on neither file layout nor task order, and a hot source is spread
  over all leaves.  A leaf passes over its rows once and holds one open
  document per source.
* *Tree.* Open documents of ``fan`` neighbouring nodes meet in the node above,
  level by level, until one per source is left; that one is drawn by its
  part.  A source's words therefore miss its target by less than one copy of
  one document.

Random numbers are hashes of the keys and ``seed``: reruns agree.  Each level
is written to the shared checkpoint folder before the next one reads it.

Defined cases: null text has size 0; a null source is a source of its own and
comes last; documents of size 0 take part with no mass; rows that agree in id,
source, size and text are one unit whose copies are dealt evenly over its rows;
a source without words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotspark.llm.common import WORD_PATTERN, documents, position, positional, restore, write_table

OWN = ["size", "source_size", "target", "copies", "taken"]
_KEY = ["_id", "_src", "_size", "_hash"]
_M64 = (1 << 64) - 1


def targets(sizes: DataFrame, weights=(1.0, 2.0, 3.0), cap: float = 3.0) -> DataFrame:
    """Per source (columns _src, _total): its target words.

    Weights repeat over the sources by code point, null last.  Shares stop at
    ``cap`` times the source's size and the excess goes to the others by
    weight: target = min(cap * size, level * weight), where the level makes
    the targets add up to all words.  One row per source, never per document.
    """
    by_name = Window.orderBy(F.col("_src").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Sources ordered by the level at which they reach their cap.
    before = Window.orderBy("_full_at", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("_full_at", "_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = (sizes.withColumn("_rank", F.row_number().over(by_name))
         .withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                        ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
         .withColumn("_cap", F.lit(float(cap)) * F.col("_total"))
         .withColumn("_full_at", F.col("_cap") / F.col("_w"))
         .withColumn("_level", (F.sum("_total").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                     / F.sum("_w").over(onward))
         # Past the first source that its level does not fill, levels only fall.
         .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_full_at"), F.col("_level"))).over(every)))
    return s.select("_src", "_total", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
                    .alias("_target"))


def _mix64(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M64
    return x ^ (x >> 31)


def _uniform(*parts: int) -> float:
    h = 0x9E3779B97F4A7C15
    for p in parts:
        h = _mix64((h + (p & _M64)) & _M64)
    return (h >> 11) / float(1 << 53)


def _pivot(seed: int, level: int, last: bool):
    """mapInArrow function: one pass over rows sorted by (_node, _src, _draw)."""

    def run(batches):
        held = None  # the open unit of the present (node, source)
        for batch in batches:
            cols = batch.to_pydict()
            n = batch.num_rows
            node, src, draw = cols["_node"], cols["_sk"], cols["_draw"]
            p, mass, uid = cols["_p"], cols["_mass"], cols["_uid"]
            out_uid, out_p, out_src, out_node, out_mass, out_draw = [], [], [], [], [], []

            def put(u):
                out_uid.append(u[3]), out_p.append(u[2]), out_src.append(u[1])
                out_node.append(u[0]), out_mass.append(u[4]), out_draw.append(u[5])

            def close(u):
                if last and 0.0 < u[2] < 1.0:
                    u[2] = 1.0 if _uniform(seed, 7, u[5]) < u[2] else 0.0
                put(u)

            for k in range(n):
                new = [node[k], src[k], p[k], uid[k], mass[k], draw[k]]
                if held is not None and (held[0] != new[0] or held[1] != new[1]):
                    close(held)
                    held = None
                if not 0.0 < new[2] < 1.0:
                    put(new)
                    continue
                if new[4] == 0:  # no mass to exchange
                    new[2] = 1.0 if _uniform(seed, 3, new[5]) < new[2] else 0.0
                    put(new)
                    continue
                if held is None:
                    held = new
                    continue
                a, b, u, v = held[4], new[4], held[2], new[2]
                up = min(a * (1.0 - u), b * v)      # held gains, new loses
                down = min(a * u, b * (1.0 - v))    # held loses, new gains
                if _uniform(seed, level, held[5], new[5]) * (up + down) < down:
                    full = up == a * (1.0 - u)
                    held[2], new[2] = (1.0, v - up / b) if full else (u + up / a, 0.0)
                else:
                    gone = down == a * u
                    held[2], new[2] = (0.0, v + down / b) if gone else (u - down / a, 1.0)
                for x in (held, new):
                    x[2] = min(max(x[2], 0.0), 1.0)
                if 0.0 < held[2] < 1.0:
                    put(new)
                else:
                    put(held)
                    held = new if 0.0 < new[2] < 1.0 else None
                    if held is None:
                        put(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_uid, pa.int64()), pa.array(out_p, pa.float64()), pa.array(out_src, pa.int64()),
                 pa.array(out_node, pa.int64()), pa.array(out_mass, pa.int64()), pa.array(out_draw, pa.int64())],
                names=["_uid", "_p", "_sk", "_node", "_mass", "_draw"])
        if held is not None:
            u = held
            if last and 0.0 < u[2] < 1.0:
                u[2] = 1.0 if _uniform(seed, 7, u[5]) < u[2] else 0.0
            yield pa.RecordBatch.from_arrays(
                [pa.array([u[3]], pa.int64()), pa.array([u[2]], pa.float64()), pa.array([u[1]], pa.int64()),
                 pa.array([u[0]], pa.int64()), pa.array([u[4]], pa.int64()), pa.array([u[5]], pa.int64())],
                names=["_uid", "_p", "_sk", "_node", "_mass", "_draw"])

    return run


_NODE_SCHEMA = "_uid long, _p double, _sk long, _node long, _mass long, _draw long"


def _round_units(units: DataFrame, seed: int, leaf_rows: int, fan: int) -> DataFrame:
    """Units (columns _uid, _p, _sk, _mass, _draw) to _uid, _x with _x 0 or 1."""
    leaves = max(1, math.ceil(units.count() / leaf_rows))
    level, nodes = 0, leaves
    todo = units.withColumn("_node", F.pmod(F.col("_draw"), F.lit(leaves)))
    done = None
    while True:
        last = nodes == 1
        out = write_table(todo.repartition("_node", "_sk").sortWithinPartitions("_node", "_sk", "_draw", "_uid")
                          .mapInArrow(_pivot(seed, level + 11, last), _NODE_SCHEMA), f"pivot-{level}")
        whole = out.where("_p = 0 or _p = 1").select("_uid", F.col("_p").cast("int").alias("_x"))
        done = whole if done is None else done.unionAll(whole)
        if last:
            return done
        todo = out.where("_p > 0 and _p < 1").withColumn("_node", F.floor(F.col("_node") / fan))
        nodes = math.ceil(nodes / fan)
        level += 1


def _keyed(docs: DataFrame, text: str, id: str, source: str) -> tuple[DataFrame, list[str]]:
    p, names = positional(docs)
    t, i, s = (position(names, c) for c in (text, id, source))
    return p.withColumns({
        "_id": F.col(i), "_src": F.col(s).cast("string"),
        "_size": F.coalesce(F.regexp_count(F.col(t), F.lit(WORD_PATTERN)), F.lit(0)).cast("long"),
        "_hash": F.xxhash64(F.col(t))}), names


def plan(keyed: DataFrame, weights=(1.0, 2.0, 3.0), cap: float = 3.0, seed: int = 20240501,
         leaf_rows: int = 4096, fan: int = 32) -> DataFrame:
    """Units of equal (_id, _src, _size, _hash): their number of rows _m, the
    copies _take of all of them together, and their source's figures."""
    units = keyed.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_m"))
    units = write_table(units, "mix-units").withColumn(
        "_draw", F.xxhash64(F.lit(seed), *[F.col(c) for c in _KEY]))
    sums = units.groupBy("_src").agg(F.sum(F.col("_size") * F.col("_m")).alias("_total"))
    goal = write_table(targets(sums, weights, cap).withColumn("_sk", F.monotonically_increasing_id()), "mix-targets")
    units = units.join(goal.withColumnRenamed("_src", "_s2"), F.col("_src").eqNullSafe(F.col("_s2"))).drop("_s2")
    units = units.withColumn("_want", F.when(F.col("_total") > 0, F.col("_m") * (F.col("_target") / F.col("_total")))
                             .otherwise(F.lit(0.0)))
    units = units.withColumn("_base", F.floor("_want").cast("long")) \
                 .withColumn("_uid", F.monotonically_increasing_id())
    units = write_table(units, "mix-keyed")
    x = _round_units(units.select("_uid", (F.col("_want") - F.col("_base")).alias("_p"), "_sk",
                                  F.col("_size").alias("_mass"), "_draw"), seed, leaf_rows, fan)
    return units.join(x, "_uid").select(*_KEY, "_uid", "_m", "_total", "_target",
                                        (F.col("_base") + F.col("_x")).alias("_take"))


def _row_copies(seq) -> F.Column:
    """Copies of the seq-th of the _m equal rows of a unit."""
    return F.expr("_take div _m") + (seq <= F.expr("_take % _m")).cast("long")


def _number(rows: DataFrame, units: DataFrame) -> DataFrame:
    """``rows`` with ``_seq``, from 1 within each unit.

    Where no unit has several rows, nothing moves.  Else the rows are written
    once, so that their order is fixed; each part of the written table numbers
    its own rows of a unit, and a table of one row per unit and part has the
    numbers taken before.  So a unit of many rows is spread over the parts.
    """
    if units.where("_m > 1").isEmpty():
        return rows.withColumn("_seq", F.lit(1).cast("long"))
    kept = write_table(rows.withColumn("_row", F.monotonically_increasing_id()), "mix-rows") \
        .withColumn("_part", F.shiftright("_row", 33))
    several = kept.where("_m > 1")
    earlier = Window.partitionBy("_uid").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = several.groupBy("_uid", "_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_uid", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begun"))
    inside = several.select("_uid", "_part", "_row").withColumn(
        "_seq", F.row_number().over(Window.partitionBy("_uid", "_part").orderBy("_row")))
    seq = inside.join(begun, ["_uid", "_part"]).select("_row", (F.col("_begun") + F.col("_seq")).alias("_seq"))
    return (kept.where("_m = 1").withColumn("_seq", F.lit(1).cast("long"))
            .unionByName(several.join(seq, "_row")))


def mix(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """Every input row with size, source_size, target, copies and taken
    (= copies * size).  A mix repeats each row ``copies`` times."""
    keyed, names = _keyed(docs, text, id, source)
    units = write_table(plan(keyed, **how), "mix-plan")
    u = units.toDF(*[f"{c}_u" if c in _KEY else c for c in units.columns])
    out = _number(keyed.join(u, [F.col(c).eqNullSafe(F.col(f"{c}_u")) for c in _KEY]), units)
    out = out.withColumn("copies", _row_copies(F.col("_seq")))
    out = out.withColumnsRenamed({"_size": "size", "_total": "source_size", "_target": "target"})
    return restore(out.withColumn("taken", F.col("copies") * F.col("size")), names, OWN)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; its text never leaves the scan."""
    keyed, _ = _keyed(documents(spark, sf_dir).select("doc_id", "source", "text"), "text", "doc_id", "source")
    units = plan(keyed)
    rows = units.withColumn("_seq", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))))
    rows = rows.withColumn("copies", _row_copies(F.col("_seq")))
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"),
                       F.col("_total").alias("source_size"), F.col("_target").alias("target"),
                       (F.col("copies") * F.col("_size")).alias("taken"), "copies", F.col("_src").alias("source"))
