"""Merkle dataset manifest with proofs made by pointer jumping.

* *Leaves.* A leaf is the SHA-256 of a row's fields, each written as ``-`` (null)
  or as its UTF-8 byte count, ``:`` and its value.  Texts are read once; all
  later steps move ids and 32-byte digests.
* *Positions.* Rows get their place in their group (ascending by id, then by
  digest) without a task that holds a group: the light rows are dealt by range of
  (group, id), written sorted, and a small table of (partition, group) counts gives
  each partition its offset.
* *Levels.* ``fanout`` consecutive nodes become the hash of their digests, one
  shuffle on (group, position // fanout) a level, until one node is left: the
  group's subroot.  The subroots, in order of their groups, form a tree of the
  same kind up to the root.
* *Proofs.* A node above the leaves starts with a pointer to its parent and a
  segment, the siblings of its run.  Each round joins the nodes with the ones they
  point to: the pointer's distance doubles and the two segments are put together.
  After round r only nodes on levels divisible by 2^r can be asked again; the
  others drop out, so the tables shrink by a power of the fanout a round.  A leaf
  then hops 1, 2, 4, ... levels, until it is at the root.

A proof is an array of (l, r), one entry a level: the digests left and right of the
path's node, put together.  ``fold`` hashes a leaf up along it.

Defined cases: a null group is a group of its own and comes first; null ids come
first; rows of equal id and digest are separate leaves; a lone leaf is its group's
subroot and a lone subroot the root (no hash above it), with an empty proof; empty
tables give no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotspark.llm.common import documents, pick, write_table

FANOUT = 3
_HOP = "struct<l: binary, r: binary>"


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*fields: Column) -> Column:
    """The 32 bytes of a leaf's hash."""
    return F.unhex(F.sha2(F.concat(*[_field(c) for c in fields]), 256))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def fold(leaf: Column, proof: Column) -> Column:
    """The root (hex) that a leaf's digest gives along a proof."""
    return F.aggregate(proof, _text(leaf), lambda h, s: F.sha2(F.concat(_text(s["l"]), h, _text(s["r"])), 256))


def siblings_digest(proof: Column) -> Column:
    """Hash (hex) of a proof's digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(_text(s["l"]), _text(s["r"]))), ""), 256)


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``pos``, the row's place from 0 among the rows of its ``key`` by
    ``order`` (nulls first), and ``n``, their number."""
    by = [F.col(c).asc_nulls_first() for c in ["key", *order]]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = write_table(dealt.withColumn("_at", F.monotonically_increasing_id()), "merkle-rank")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    spans = dealt.groupBy("key", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # A row per partition and key that meet: as many as partitions plus keys.
    ahead = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("key", "_part", (F.coalesce(F.sum("_rows").over(ahead), F.lit(0)) - F.col("_first")).alias("_shift"),
                         F.sum("_rows").over(Window.partitionBy("key")).alias("n"))
    return (dealt.join(spans, ["key", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift"))
            .drop("_at", "_part", "_shift"))


def _runs(nodes: DataFrame, fanout: int, carried: list[str]) -> DataFrame:
    """Runs of ``fanout`` consecutive nodes (key, pos, n, digest): the parent's
    place, number and digest, and the run's nodes in order as ``kids``."""
    up = nodes.where("n > 1").groupBy("key", F.expr(f"pos div {fanout}").alias("up"), "n").agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", *carried))).alias("kids"))
    joined = F.array_join(F.transform("kids", lambda k: _text(k["digest"])), "")
    return up.select("key", F.col("up").alias("pos"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"),
                     F.unhex(F.sha2(joined, 256)).alias("digest"), "kids")


def _hops(runs: DataFrame, carried: list[str]) -> DataFrame:
    """The nodes of the runs: a segment of one level, and the parent's place ``up``."""
    nothing = F.unhex(F.lit(""))

    def side(keep):
        return F.aggregate(F.filter("kids", keep), nothing, lambda all, k: F.concat(all, k["digest"]))

    one = runs.select("key", F.col("pos").alias("up"), "kids", F.explode("kids").alias("kid"))
    left = side(lambda k: k["pos"] < F.col("kid.pos"))
    right = side(lambda k: k["pos"] > F.col("kid.pos"))
    return one.select("key", "kid.pos", "kid.digest", *[F.col(f"kid.{c}") for c in carried],
                      F.array(F.struct(left.alias("l"), right.alias("r"))).alias("segment"), "up")


def _double(nodes: DataFrame, step: int) -> DataFrame:
    """One round: nodes on levels divisible by 2 * step, whose segments span
    ``step`` levels, take in the segments of the nodes they point to."""
    left = nodes.where(F.col("level") % (2 * step) == 0).withColumn("at", F.col("level") + step)
    right = nodes.where(F.col("level") % (2 * step) == step).select(
        "key", F.col("level").alias("at"), F.col("pos").alias("up"), F.col("segment").alias("more"), F.col("up").alias("far"))
    return left.join(right, ["key", "at", "up"], "left").select(
        "key", "level", "pos", F.concat("segment", F.coalesce("more", F.array().cast(f"array<{_HOP}>"))).alias("segment"),
        F.coalesce("far", "up").alias("up"))


class Tree:
    """The trees of all keys over ``nodes`` (key, pos, n, digest, carried columns).

    ``tops`` has each key's top digest; ``proofs()`` the carried columns with
    leaf and proof (to the key's top) of every node."""

    def __init__(self, nodes: DataFrame, carried: list[str], fanout: int = FANOUT):
        self.nodes, self.carried = nodes, carried
        most = nodes.agg(F.max("n")).first()[0] or 0
        self.levels, now = [], nodes  # the runs below level 1, 2, ...
        while most > 1:
            kept = self.carried if not self.levels else []
            now = write_table(_runs(now, fanout, kept), "merkle-level")
            self.levels.append(now)
            most = math.ceil(most / fanout)
        self.tops = nodes.where("n = 1").select("key", F.col("digest").alias("top"))
        for runs in self.levels:
            self.tops = self.tops.unionAll(runs.where("n = 1").select("key", F.col("digest").alias("top")))

    def _jumps(self) -> list[DataFrame]:
        """For r = 0, 1, ...: the nodes of level 2^r with segments over 2^r levels."""
        inner = None
        for level, runs in enumerate(self.levels[1:], 1):
            hops = _hops(runs, []).select("key", F.lit(level).alias("level"), "pos", "segment", "up")
            inner = hops if inner is None else inner.unionAll(hops)
        out, step = [], 1
        while step < len(self.levels):
            inner = write_table(inner, "merkle-jump")
            out.append(inner.where(F.col("level") == step))
            inner, step = _double(inner, step), 2 * step
        return out

    def proofs(self) -> DataFrame:
        none = F.array().cast(f"array<{_HOP}>")
        alone = self.nodes.where("n = 1").select("key", "digest", *self.carried, none.alias("segment"))
        if not self.levels:
            rows = alone
        else:
            rows = _hops(self.levels[0], self.carried).drop("pos").withColumn("segment", F.col("segment").cast(f"array<{_HOP}>"))
            for jump in self._jumps():
                jump = jump.select("key", F.col("pos").alias("up"), F.col("segment").alias("more"), F.col("up").alias("far"))
                rows = rows.join(jump, ["key", "up"], "left").select(
                    "key", F.coalesce("far", "up").alias("up"), "digest", *self.carried,
                    F.concat("segment", F.coalesce("more", none)).alias("segment"))
            rows = rows.select(*alone.columns).unionAll(alone)
        return rows.select("key", *self.carried, F.col("digest").alias("leaf"), F.col("segment").alias("proof"))


def manifest(leaves: DataFrame, carried: list[str], fanout: int = FANOUT) -> DataFrame:
    """Proofs for ``leaves`` (group, id, digest and ``carried`` columns): the carried
    columns, id, leaf, subroot, root (digests) and proof, from the leaf to the root."""
    light = leaves.withColumn("key", F.when(F.col("group").isNull(), F.lit("a")).otherwise(
        F.concat(F.lit("b"), F.col("group").cast("string")))).drop("group")
    names = ["id", *carried]
    groups = Tree(ranked(write_table(light, "merkle-leaves"), ["id", "digest"]), names, fanout)
    tops = groups.tops.select(F.lit("").alias("key"), F.col("key").alias("group_key"), F.col("top").alias("digest"))
    over = Tree(ranked(tops, ["group_key"]), ["group_key"], fanout)
    root = over.tops.first()  # one row
    # A written row a group: Spark sends it to all tasks while its measured size is
    # small, and beyond that AQE splits a group of many leaves.
    rest = write_table(over.proofs().select(F.col("group_key").alias("key"), F.col("leaf").alias("subroot"),
                                            F.col("proof").alias("rest")), "merkle-groups")
    return groups.proofs().join(rest, "key").select(
        *names, "leaf", "subroot", F.lit(bytes(root.top) if root else None).cast("binary").alias("root"),
        F.concat("proof", "rest").alias("proof"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents, and the digests of rows whose text lost its line
    breaks (``changed``, where crc32 of the id is even)."""
    d = pick(docs, id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")
    own = [F.col(c) for c in ("id", "source", "lang", "n_chars")]
    even = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(2)) == 0
    cut = F.when(even, leaf_digest(*own, F.translate("text", "\n", "")))
    return d.select(F.col("source").alias("group"), "id", leaf_digest(*own, F.col("text")).alias("digest"),
                    cut.alias("changed"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = manifest(document_leaves(documents(spark, sf_dir)), ["changed"])
    folded = fold(F.coalesce("changed", "leaf"), F.col("proof"))
    out = out.select(F.col("id").alias("doc_id"), _text(F.col("leaf")).alias("leaf"), _text(F.col("subroot")).alias("subroot"),
                     _text(F.col("root")).alias("root"), siblings_digest(F.col("proof")).alias("proof_sha256"),
                     folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# crc32 has no DuckDB function: each byte is taken in, then eight bits are shifted out.
_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length({s}) + 1),
    lambda i: list_concat([CAST(ascii(substr({s}, i, 1)) AS BIGINT)], list_transform(range(8), lambda z: CAST(-1 AS BIGINT)))))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""
_ID = "CAST(doc_id AS VARCHAR)"


def _sql_field(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


_FIELDS = " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, sha256({_FIELDS} || {_sql_field("text")}) AS leaf,
      CASE WHEN {_CRC.format(s=_ID)} % 2 = 0
        THEN sha256({_FIELDS} || {_sql_field("replace(text, chr(10), '')")}) END AS changed FROM documents)),
up(source, level, pos, n, digest) AS (
  SELECT source, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM up WHERE n > 1 GROUP BY source, level, pos // 3, n),
tops AS (SELECT source, digest AS subroot, level AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos,
    count(*) OVER () AS n FROM up WHERE n = 1),
up2(level, pos, n, digest) AS (
  SELECT 0, pos, n, subroot FROM tops
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM up2 WHERE n > 1 GROUP BY level, pos // 3, n),
kin AS (SELECT source, level, pos // 3 AS run, n, list(digest ORDER BY pos) AS kids FROM up WHERE n > 1 GROUP BY ALL),
kin2 AS (SELECT level, pos // 3 AS run, list(digest ORDER BY pos) AS kids FROM up2 WHERE n > 1 GROUP BY ALL),
rows AS (SELECT l.*, t.subroot, t.depth, t.pos AS top_pos, row_number() OVER () AS id
  FROM leaves l JOIN tops t ON l.source IS NOT DISTINCT FROM t.source),
steps AS (
  SELECT r.id, k.level, kids, CAST((r.pos // CAST(power(3, k.level) AS BIGINT)) % 3 AS BIGINT) AS i
  FROM rows r JOIN kin k ON r.source IS NOT DISTINCT FROM k.source
    AND k.run = r.pos // CAST(power(3, k.level + 1) AS BIGINT)
  UNION ALL
  SELECT r.id, r.depth + k.level, kids, CAST((r.top_pos // CAST(power(3, k.level) AS BIGINT)) % 3 AS BIGINT)
  FROM rows r JOIN kin2 k ON k.run = r.top_pos // CAST(power(3, k.level + 1) AS BIGINT)),
sides AS (SELECT id, level, array_to_string(kids[1:i], '') AS l, array_to_string(kids[i + 2:], '') AS r FROM steps),
proof AS (SELECT id, sha256(string_agg(l || r, '' ORDER BY level)) AS p FROM sides GROUP BY id),
folded(id, level, h) AS (
  SELECT id, 0, coalesce(changed, leaf) FROM rows
  UNION ALL
  SELECT f.id, f.level + 1, sha256(s.l || f.h || s.r) FROM folded f JOIN sides s ON f.id = s.id AND f.level = s.level)
SELECT r.doc_id, r.leaf, r.subroot, u.digest AS root, coalesce(p.p, sha256('')) AS proof_sha256, f.h AS folded_root,
  f.h = u.digest AS verified
FROM rows r CROSS JOIN (SELECT digest FROM up2 WHERE n = 1) u LEFT JOIN proof p ON p.id = r.id
JOIN (SELECT id, arg_max(h, level) AS h FROM folded GROUP BY id) f ON f.id = r.id
"""
