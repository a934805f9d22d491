"""Merkle manifest: a plain-Python tree, all proofs, cases."""

import hashlib
import zlib

import pytest

from shotspark.llm import op11_merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string"


def h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], text)]
    return h("".join(parts))


def tree(leaves):
    """The top, and for each leaf its siblings (left, right) a level."""
    paths, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for k, i in enumerate(at):
            run = leaves[i // 3 * 3:i // 3 * 3 + 3]
            paths[k].append((run[:i % 3], run[i % 3 + 1:]))
        at = [i // 3 for i in at]
        leaves = [h("".join(leaves[a:a + 3])) for a in range(0, len(leaves), 3)]
    return leaves[0], paths


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    if not rows:
        return []
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        made.append((own, [leaf(r, r[4]) for r in own]))
    tops = [tree(leaves) for _, leaves in made]
    root, over = tree([t for t, _ in tops])
    out = []
    for (own, leaves), (top, paths), rest in zip(made, tops, over):
        for r, digest, path in zip(own, leaves, paths):
            path = path + rest
            cut = r[4].replace("\n", "") if r[4] is not None else None
            now = leaf(r, cut) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else digest
            for left, right in path:
                now = h("".join(left) + now + "".join(right))
            proof = h("".join("".join(left) + "".join(right) for left, right in path))
            out.append((r[0], digest, top, root, proof, now, now == root))
    return sorted(out, key=repr)


def made(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in M.op11_merkle(spark, str(tmp_path)).collect()), key=repr)


def rows_of(n, source, first=0):
    return [(first + k, source, ["en", None][k % 2], k, f"line {k}\nü {k}" if k % 5 else f"no break {k}", "clash") for k in range(n)]


def test_trees_of_many_sizes(spark, tmp_path):
    rows = rows_of(1, "lone") + rows_of(2, "two", 100) + rows_of(9, "nine", 200) + rows_of(10, "ten", 300)
    rows += rows_of(250, "hot", 1000) + rows_of(7, None, 5000) + rows_of(3, "Ä", 6000) + rows_of(28, "", 7000)
    got = made(spark, tmp_path, rows)
    assert got == expected(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [
    [],
    [(1, "a", None, None, None, None)],
    [(4, "a", "en", 3, "a\nb", "x")] * 5 + [(None, "a", "en", 3, "a\nb", "x"), (None, None, None, None, "", "y")],
    [(k, f"s{k}", None, 1, "x\n" * (k + 1), None) for k in range(11)],
    [(1, "a", "en", 1, "long line\n" * 200_000, None), (2, "a", "en", 1, "", None)],
])
def test_cases(spark, tmp_path, rows):
    assert made(spark, tmp_path, rows) == expected(rows)


def test_a_changed_field_or_sibling_is_seen(spark, tmp_path):
    rows = rows_of(30, "a") + rows_of(4, "b", 50)
    root = expected(rows)[0][3]
    for k in (0, 17, 31):
        other = list(rows)
        other[k] = other[k][:2] + ("fr",) + other[k][3:]
        assert expected(other)[0][3] != root
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, SCHEMA)
    out = M.manifest(M.document_leaves(df), ["changed"])
    swapped = F.transform("proof", lambda s: F.struct(s["r"].alias("l"), s["l"].alias("r")))
    first = out.where("id = 0").select(M.fold(F.col("leaf"), F.col("proof")).alias("good"),
                                       M.fold(F.col("leaf"), swapped).alias("bad")).first()
    assert first.good == root and first.bad != root
    assert out.columns == ["id", "changed", "leaf", "subroot", "root", "proof"]


def test_another_fanout(spark):
    rows = [("g", k, bytes([k]) * 32) for k in range(5)]
    df = spark.createDataFrame(rows, "`group` string, id long, digest binary")
    out = M.manifest(df, [], fanout=2).collect()
    level = [r[2].hex() for r in rows]
    while len(level) > 1:
        level = [h("".join(level[a:a + 2])) for a in range(0, len(level), 2)]
    assert {r.root.hex() for r in out} == {level[0]} and {len(r.proof) for r in out} == {3}
