"""Spelling variants against plain Python, and their SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import queries, spelling

SCHEMA = "doc_id long, text string"


def plain_vocabulary(rows):
    counts = Counter()
    for doc, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = 1 if doc is None else zlib.crc32(f"{doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_group(words):
    form, near = {}, {}
    for w, n in words.items():
        near[w] = [o for o in words if plain_near(w, o)]
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def make_rows():
    draw = random.Random(4)
    letters = "abeÀéÿ÷×"
    base = ["".join(draw.choices(letters, k=draw.randint(5, 9))) for _ in range(60)]
    words = []
    for word in base:
        words += [word] * draw.choice([1, 3, 30, 160])
        for _ in range(4):
            at = draw.randrange(len(word))
            other = word[:at] + draw.choice(letters + " ") + word[at + draw.randint(0, 1) :]
            words += [other] * draw.choice([2, 5, 6, 26, 40])
    words += ["aaaaaaaa"] * 700 + ["aaaaaaa"] * 140 + ["aaaaaab"] * 28 + ["aaaaabb"] * 5
    draw.shuffle(words)
    rows = [(i, " ".join(words[i::300])) for i in range(300)]
    rows += [(None, "ABCDEF,abcdef Abcdef-abcdefg ABCDEF abcdef")] * 2 + [(1, None), (2, ""), (3, "x1")]
    rows += [(4, "b" * 30_000 + "\U0001f600" + "b" * 29_999)] * 5 + [(5, "日本語abcdefẞabcdefg")] * 5
    return rows


@pytest.mark.parametrize("filter_bytes", [32 << 20, 256])
def test_query_on_odd_rows(spark, tmp_path, monkeypatch, filter_bytes):
    monkeypatch.setattr(spelling, "FILTER_BYTES", filter_bytes)  # several passes
    rows = make_rows()
    table = spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    wanted = plain_group(plain_vocabulary(rows))
    assert sorted(map(tuple, got.collect())) == wanted
    assert any(w[1] not in (None, w[2]) for w in wanted)  # a chain of forms


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_spelling_variants(spark, str(tmp_path)).collect() == []


def test_edits_are_found_in_slices(spark, monkeypatch):
    words = {w.encode("latin-1") for w in plain_vocabulary(make_rows()) if len(w) < 100}
    table = spark.createDataFrame([(w.decode("latin-1"), 1) for w in words], "word string, n long")
    filters = spelling._layout(table)[0]
    spelling._fill(table, filters)
    whole = set(spelling.edits(sorted(words), filters))
    monkeypatch.setattr(spelling, "PROBES", 50)
    assert set(spelling.edits(sorted(words), filters)) == whole
    pairs = {(a, b) for a, b in whole if b in words}
    text = {w: w.decode("latin-1") for w in words}
    near = {(a, b) for a in words for b in words if plain_near(text[a], text[b])}
    assert pairs | {(b, a) for a, b in pairs} == near and len(pairs) * 2 == len(near)
    assert np.mean([b in words for _, b in whole]) > 0.5  # the filter turns nearly all others away


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cursor = con.execute(queries.ORACLES["op12_spelling_variants"])
    names = [d[0] for d in cursor.description]
    got = queries.op12_spelling_variants(spark, sf).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(cursor.fetchall(), key=repr)
