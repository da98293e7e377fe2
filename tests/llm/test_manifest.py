"""The Merkle manifest against a plain tree, and its SQL."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tillroll.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([plain_hash(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def plain_leaf(row, more=0):
    doc, text, lang, source, n = row
    n = n if n is None else n + more
    return plain_hash(
        *("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc, source, lang, n, text))
    )


def plain_manifest(rows):
    """Rows of the query, from whole lists."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {}
    for tree in order:
        own = sorted(trees[tree], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        built[tree] = own, plain_levels([plain_leaf(r) for r in own])
    top = plain_levels([built[t][1][-1][0] for t in order])
    root = top[-1][0] if order else None
    out = []
    for place, tree in enumerate(order):
        own, levels = built[tree]
        for at, row in enumerate(own):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            digest, proof = plain_leaf(row, int(tampered)), []
            for nodes, i in ((levels, at), (top, place)):
                for level in nodes[:-1]:
                    pair = level[i // 2 * 2 : i // 2 * 2 + 2]
                    proof += [d for j, d in enumerate(pair) if j != i % 2]
                    pair[i % 2] = digest
                    digest, i = plain_hash(*pair), i // 2
            out.append(
                (row[0], plain_leaf(row), levels[-1][0], root, plain_hash(*proof), digest, digest == root)
            )
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [1, 2, 12])
def test_query_on_odd_rows(spark, tmp_path, monkeypatch, height):
    rows = [(i, f"text {i}", "en", "web", 6 + i) for i in range(37)]
    rows += [(i, "x" * i, f"l{i % 5}", None, None) for i in range(100, 123)]
    rows += [(200 + i, "é", None, "ü", 2**63 - 1) for i in range(9)]
    rows += [(7, None, "one", "s", 0), (7, "", "", "s", 0), (None, "a", "en", "s", 1)]
    rows += [(300, "same", "en", "s", 4)] * 5 + [(None, None, None, None, None)] * 2
    rows += [(11, "long " * 50_000, "é", "s", 1), (12, "other", "z", "s", 1), (11, "b", "é", "s", 1)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit("x"))
    table.withColumn("position", F.lit(1)).withColumn("leaf", F.lit(1)).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    monkeypatch.setattr(merkle.build, "__defaults__", (height,))
    got = [tuple(r) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == plain_manifest(rows)
    assert len({r[3] for r in got}) == 1 and not all(r[-1] for r in got)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_merkle_manifest(spark, str(tmp_path)).collect() == []


def test_versions_copy_ancestors_only(spark):
    rows = [(i, "ab"[i % 2], plain_hash(str(i)), plain_hash("new", str(i))) for i in range(21)]
    table = spark.createDataFrame(rows, "key long, group string, leaf string, changed string")
    manifest = merkle.build(table, "key", "group", "leaf", "changed", height=2)
    found = {r.key: r for r in merkle.versions(manifest).collect()}
    for key, group, leaf, changed in rows:
        version = found[key]
        own = [plain_hash(str(i)) for i in range(21) if i % 2 == (group == "b")]
        own[version.position] = changed
        levels = plain_levels(own)
        copies = {(c["level"], c["index"]): c["digest"] for c in version.copies}
        assert len(copies) == len(version.copies) == len(levels) + 1
        for level, nodes in enumerate(levels):  # what the version changed and nothing else
            assert copies[level, version.position >> level] == nodes[version.position >> level]
        other = plain_levels([plain_hash(str(i)) for i in range(21) if i % 2 != (group == "b")])
        pair = [levels[-1][0], other[-1][0]]
        assert copies[len(levels), 0] == plain_hash(*(pair if group == "a" else pair[::-1]))
        assert [s.side for s in version.proof][-1] == (1 if group == "a" else -1)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cursor = con.execute(queries.ORACLES["op13_merkle_manifest"])
    names = [d[0] for d in cursor.description]
    wanted = sorted(cursor.fetchall())
    got = queries.op13_merkle_manifest(spark, sf).select(*names).collect()
    assert sorted(map(tuple, got)) == wanted
