"""The exact top-k search against all pairs, and its SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import queries, topk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, asked, k, scale=64):
    """query_id, rank, vec_id, score over distinct (id, vector) rows."""

    def whole(row):
        i, v = row
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        limit = math.floor(math.sqrt(2.0**62 / len(v)))
        return i, tuple(max(-limit, min(limit, math.floor(scale * x))) for x in v)

    known = {whole(r) for r in rows} - {None}
    out = []
    for q, v in {whole(r) for r in asked} - {None}:
        found = [
            (-sum(a * b for a, b in zip(v, w)), i, w)
            for i, w in known
            if len(w) == len(v) and (i, w) != (q, v)
        ]
        out += [(q, r + 1, i, -s) for r, (s, i, _) in enumerate(sorted(found)[:k])]
    return sorted(out)


def found(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("fragments", [1, 2, 3])
def test_all_pairs(spark, fragments):
    draw = np.random.default_rng(fragments)
    centre = draw.standard_normal((6, 10))
    rows = [(i, (centre[i % 6] + draw.standard_normal(10)).round(2).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 60, 2)]  # copies
    rows += [(2000 + i, rows[3][1]) for i in range(80)]  # one vector that many rows hold
    asked = [r for r in rows if r[0] % 5 == 0]
    table, of = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, SCHEMA)
    got = topk.search(table, of, 7, fragments=fragments, depth=5, block=(30, 50))
    assert found(got) == brute(rows, asked, 7)


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "FOLD", 2)
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]),
        (2, [0.5, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]),
        (7, [nan, 1.0, 0.0]), (8, [1.0, None, 0.0]), (9, [inf, 0.0, 0.0]), (10, [1.0, 2.0]),
        (11, [2.0, 2.0]), (None, [1.0, 1.0, 1.0]), (12, [-1e300, 1e300, 0.01]),
        (13, [1e300, 1e300, -0.01]), (14, [3.0]), (15, [1e7, 1.0, 1.0]),
        *[(i, [-0.5, -0.5, 0.25]) for i in range(20, 60)],
    ]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("number", F.lit("x"))
    table = table.withColumn("score", F.lit(1)).withColumn("same", F.lit(1)).withColumn("id", F.lit(0))
    for block in ((100, 100), (2, 3)):
        assert found(topk.search(table, table, 4, block=block)) == brute(rows, rows, 4)
    assert found(topk.search(table, table, 500)) == brute(rows, rows, 500)
    none = table.limit(0)
    assert found(topk.search(none, none, 3)) == found(topk.search(table, none, 3)) == []
    assert found(topk.search(none, table, 3)) == []


def test_query_equals_sql_and_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    got = found(queries.op11_exact_topk(spark, sf))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(queries.ORACLES["op11_exact_topk"]).fetchall())
    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    assert got == brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
