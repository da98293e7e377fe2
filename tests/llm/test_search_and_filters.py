"""Neighbours, page text, personal data, benchmark passages, the n-gram join and the pipeline."""

import hashlib
import html as entities
import random
import re
import time

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tillroll.llm import ann, decontaminate, html, ngram_join, pii, queries
from tillroll.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- neighbours ------------------------------------------------------------------------------


def brute_neighbours(ids, vectors, query, k):
    distance = np.sqrt(((vectors - vectors[ids == query][0]) ** 2).sum(axis=1))
    distance[ids == query] = np.inf
    order = np.lexsort((ids, distance))[:k]
    return [(int(ids[i]), float(distance[i])) for i in order]


def test_neighbour_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, vectors = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), float)
    got = queries.op5_nearest(spark, SF).toPandas().sort_values(["query_id", "rank"])
    found = 0
    for query, own in got.groupby("query_id"):
        wanted = brute_neighbours(ids, vectors, query, 10)
        assert own["rank"].tolist() == list(range(1, 11)) and query % 100 == 0
        found += len(set(own["vec_id"]) & {i for i, _ in wanted})
        for i, score in zip(own["vec_id"], own["score"]):
            gap = vectors[ids == i][0] - vectors[ids == query][0]
            assert score == pytest.approx(np.sqrt((gap**2).sum()), rel=1e-12)
    assert found >= 0.9 * len(got) and got["query_id"].nunique() == (ids % 100 == 0).sum()


def test_neighbours_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 2)
    odd = [
        (0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]),
        (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [float("nan"), 1.0, 0.0]),
        (8, [1.0, None, 0.0]), (9, [float("inf"), 0.0, 0.0]), (10, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]),
    ]
    table = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    table = table.withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))
    got = ann.search(table, table, 10).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by_query) == {0, 1, 2, 3}
    assert sorted(by_query[0]) == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, pytest.approx(2**0.5))]
    assert ann.search(table.limit(0), table, 3).count() == 0
    assert ann.search(table, table.limit(0), 3).count() == 0


def test_bounds_hold_for_nearly_all_rows():
    rng = np.random.default_rng(0)
    rows, wanted = rng.normal(size=(2000, 48)), rng.normal(size=(50, 48))
    q, _ = np.linalg.qr(rng.normal(size=(48, 48)))
    rotation = ann.Rotation(rows.mean(axis=0), q)
    low, high = ann.Codes.of(rotation, rows).bounds(*rotation.directions(wanted))
    exact = ((wanted[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2)
    assert ((low <= exact) & (exact <= high)).mean() > 0.999


# ---- pages -----------------------------------------------------------------------------------


def test_article_of_every_page(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op2_html_text(spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id] or "", re.S)
        parts = re.split(r"</?(?:p|h1|br|div)[^>]*>", inner.group(1) if inner else "")
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in parts]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


HARD = """<html><head><title>T</title><script>var a="</p><p>no";</script></head><body>
<header><a href="/">Home</a> <h2>Site</h2></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<aside class="sidebar">Side <p>bar</p></aside>
<article><h1>Head &amp; tail</h1><p>First   <b>para<i>graph</i></b>.<p>Second&nbsp;one &lt;x&gt;
<div class="ad banner">Buy!</div><form><input value="q"><button>Send</button></form>
<ul><li>item one<li>item two</ul><style>p{}</style>
<section class="comments"><p>Nice post!</p></section></article>
<div class="cookie-notice">We use cookies</div><footer>&copy; us</footer></body></html>"""


def test_parts_that_no_page_of_the_corpus_has(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("html")
    model = html.fit(pages)
    page = html.parse(HARD)
    got = [b for b, _ in html.blocks(page, model.marginals(page))]
    assert got == ["Head & tail", "First paragraph.", "Second one <x>", "item one", "item two"]


def test_marginals_equal_enumeration():
    rng = random.Random(4)
    page = html.parse("<div class=x><p>one<b>two</b></p><nav>three</nav></div>")
    n = len(page.tags)
    tags = {html._place(f"tag {t}") for t in page.tags}
    links = {t: tuple(rng.uniform(-1, 1) for _ in range(4)) for t in tags}
    odds = {html._place(f): rng.uniform(-2, 2) for names in html.features(page) for f in names}
    model = html.TreeModel(odds, links, (0.0,) * 4, 0.3)
    total, sums = 0.0, [0.0] * n
    for code in range(2**n):
        state = [code >> i & 1 for i in range(n)]
        score = 0.3 * state[0]
        for i, names in enumerate(html.features(page)):
            score += state[i] * sum(odds[html._place(f)] for f in names)
            if i:
                pair = 2 * state[page.parents[i]] + state[i]
                score += links[html._place(f"tag {page.tags[i]}")][pair]
        weight = np.exp(score)
        total += weight
        for i in range(n):
            sums[i] += weight * state[i]
    assert np.allclose(model.marginals(page), np.array(sums) / total)


def test_declarations_and_embedded_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html.fit(pages)

    def text(markup):
        page = html.parse(f"<html><body><article>{markup}</article></body></html>")
        return [b for b, _ in html.blocks(page, model.marginals(page))]

    assert text("<p>a<![foo]>b</p>") == ["ab"]
    assert text("<p>a<![CDATA[x]]>b</p><![ foo") in (["a]]>b"], ["ab"], ["a", "b"])
    assert text("<p>sum <math><mi>x</mi></math> of <svg><text>y</text></svg></p>") == ["sum x of y"]
    assert text("<p>a<script>b</script><style>c</style><template>d</template></p>") == ["a"]
    page = html.parse("<!DOCTYPE html [<!ENTITY x 'y'>]><article><p>t</p></article>")
    assert "".join(p[1] for p in page.pieces if p) == "t"
    odd = ["<![ foo", "<!", "<![", "<!DOCTYPE", "<!DOCTYPE [", "<?", "</", "<!-", "<!--", "<![if]><!"]
    table = spark.createDataFrame([(i, "u", x) for i, x in enumerate(odd)], "page_id long, url string, html string")
    assert html.extract(table, html.fit(table)).count() == len(odd)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "!", "[", "]", "-", "/", "?", "a", " ", "DOCTYPE", "CDATA", "&", "#", "'", '"', "p", "if", "endif"]), max_size=25))
def test_no_markup_stops_the_reader(parts):
    html.parse("".join(parts))


def test_pages_that_break_off(spark):
    odd = [(1, None), (2, ""), (3, "no markup"), (4, "<article><p>cut &am"), (5, "<" * 500),
           (6, "</p></div><article>x</b>y</article>"), (6, "</p></div><article>x</b>y</article>"),
           (7, "<div>" * 3000 + "deep")]
    table = spark.createDataFrame(odd, "page_id int, html string").withColumn("text", F.lit(9))
    rows = {r.page_id: r.text for r in html.extract(table, html.fit(table)).collect()}
    assert len(rows) == 7 and rows[1] == rows[2] == "" and rows[4] == "cut &am" and rows[6] == "xy"
    none = html.fit(table.limit(0))
    assert html.extract(table.limit(0), none).count() == 0
    assert html.extract(table, none).count() == len(odd)


# ---- personal data ---------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


PERSONAL = [
    "a.b@c.d e@f a@b.c%x@d.e @x.y a@b@c.d 😀 z@q.w", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.0004",
    "4150799303021955 4150 7993 0302 1955 4150-7993-0302-1955 1 2  3 4", None, "", "é" * 50,
    "+1 (552) 555-3899 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "x" * 100_000, "1 " * 20_000,
    "a@b" + ".c" * 20_000, "1" * 30_000, "9" * 40 + ".1.2.3", "write to john (at) gmail (dot) com",
    "call me: (212) 555-1234", "no card 4150799303021954", "version 2020-01-05 12:30",
]


def test_base_spans_of_odd_texts(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*PERSONAL, PERSONAL[0]])]
    table = spark.createDataFrame(rows, "doc_id int, text string, spans string")
    found = pii.find(table).collect()
    assert len(found) == len(rows)
    for r in found:
        base = [(s.kind, s.start, s.end) for s in r.base]
        spans = [(s.kind, s.start, s.end) for s in r.spans]
        assert base == plain_spans(r.text or "") and set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
    by_id = {r.doc_id: r for r in found}
    assert [s.kind for s in by_id[12].spans] == ["email"]
    assert [s.kind for s in by_id[13].spans] == ["phone"]
    assert not by_id[14].spans and not by_id[15].spans
    assert pii.find(table.limit(0)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab1.@+- ()24", max_size=30), min_size=40, max_size=40))
def test_base_spans_of_any_text(spark, texts):
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    found = table.select("text", *[pii.base_spans(F.col("text"), k).alias(k) for k in pii.KINDS])
    for r in found.collect():
        got = [(k, s.start, s.end) for k in pii.KINDS for s in r[k]]
        assert got == plain_spans(r.text)


def test_personal_data_query(spark, documents):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    for r in queries.op4_personal_data(spark, SF).collect():
        spans = plain_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        counts = [sum(k == kind for k, _, _ in spans) for kind in pii.KINDS]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts


def test_labelers_learn_who_is_right():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        votes = tuple(
            -1 if rng.random() < 0.3 else int(truth if rng.random() < right else not truth)
            for right in (0.95, 0.9, 0.6)
        )
        counts[votes] = counts.get(votes, 0) + 1.0
    model = pii.fit_labelers(counts)
    assert abs(model.prior - 0.4) < 0.05
    right = [rate[1][2] / (rate[1][1] + rate[1][2]) for rate in model.rates]
    assert right[0] > 0.87 and right[1] > 0.8 and abs(right[2] - 0.6) < 0.08
    assert model.chance((1, 1, 0)) > 0.9 > 0.1 > model.chance((0, 0, 1))


def test_mask(spark):
    table = spark.createDataFrame([("mail a@b.c or +1 (552) 555-3899.",), ("none",)], "text string")
    rows = pii.find(table).select(pii.mask(F.col("text"), F.col("spans")).alias("m")).collect()
    assert [r.m for r in rows] == ["mail [EMAIL] or [PHONE].", "none"]


def test_mask_of_overlapping_spans(spark):
    texts = ["Call +49 30 1234567 12john.doe@example.com now", "ab 4111 cd@e.fg, x"]
    spans = [[("phone", 5, 22), ("email", 20, 42)], [("email", 8, 15), ("card", 3, 10), ("ip", 17, 18)]]
    table = spark.createDataFrame(
        list(zip(texts, spans)), "text string, spans array<struct<kind string, start int, end int>>"
    )
    rows = table.select(pii.mask(F.col("text"), F.col("spans")).alias("m")).collect()
    assert [r.m for r in rows] == ["Call [PHONE] now", "ab [CARD], [IP]"]
    found = pii.find(spark.createDataFrame([(texts[0],)], "text string"))
    row = found.select(pii.mask(F.col("text"), F.col("spans")).alias("m")).first()
    assert row.m == "Call [PHONE] now"


# ---- benchmark passages ----------------------------------------------------------------------


def edit_distance_in(window, text):
    """Fewest edits of ``window`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(window, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_every_planted_passage_is_found(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wanted = {
        (d.doc_id, i) for d in documents.collect() for i, t in items if t in (d.text or "")
    }
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, SF).collect()}
    assert wanted and got == wanted


def test_edited_passages_against_plain_alignment():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    item = " ".join(rng.choice(words) for _ in range(18))[:110].strip()
    windows = decontaminate.Windows.of_items([(5, item)], decontaminate.EDIT_RATE)
    folded, limit = windows.codes[0], int(windows.edits[0])
    assert len(windows.codes) == 1 and limit >= 5
    for edits in [*range(0, 13)] * 3:
        copy = list(item)
        for _ in range(edits):
            at = rng.randrange(len(copy))
            change = rng.random()
            copy[at : at + 1] = [rng.choice("klm")] if change < 0.4 else [] if change < 0.7 else [copy[at], "m"]
        before = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        text = f"{before} {''.join(copy)} " + " ".join(rng.choice(words) for _ in range(20))
        whole, _ = decontaminate.fold(text)
        best = edit_distance_in(folded.tolist(), whole.tolist())
        (found,) = decontaminate.leaks_in([text], windows)
        assert bool(found) == (best <= limit), (edits, best, found)
        if found:
            assert found[0][0] == 5 and found[0][3] == best


def test_excerpts_from_any_place_of_an_item():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    items = [(i, prose(70)) for i in range(12)]
    windows = decontaminate.Windows.of_items(items, decontaminate.EDIT_RATE)
    places = [(i, start, size) for i, _ in items for start, size in ((15, 150), (20, 140))]
    places += [(i, rng.randrange(0, 150), rng.randint(127, 170)) for i, _ in items for _ in range(4)]
    for i, start, size in places:
        part = items[i][1][start : start + size].strip()
        text = f"{prose(30)} {part} {prose(30)}"
        (found,) = decontaminate.leaks_in([text], windows)
        whole = len(part) >= decontaminate.WINDOW + decontaminate.stride(decontaminate.EDIT_RATE) - 1
        assert [x[0] for x in found] == [i]
        assert not whole or (found[0][3] == 0 and text[found[0][1] : found[0][2]] in items[i][1])


def test_short_regions_of_a_long_item():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    item = " ".join(rng.choice(words) for _ in range(80))
    windows = decontaminate.Windows.of_items([(1, item)], decontaminate.EDIT_RATE)
    for size in (60, 75, 90, 100, 110, 119):
        for _ in range(12):
            start = rng.randrange(len(item) - size)
            part = item[start : start + size]
            before, after = (" ".join(rng.choice(words) for _ in range(9)) for _ in range(2))
            (found,) = decontaminate.leaks_in([f"{before}{part}{after}"], windows)
            assert [x[0] for x in found] == [1], (size, start)
        other = " ".join(rng.choice(words) for _ in range(100))
        assert decontaminate.leaks_in([other], windows) == [[]]


def test_short_items_are_found_unchanged():
    question, chinese, tiny = "What is the capital of Peru?", "\u4e2d\u56fd\u7684\u9996\u90fd\u662f\u54ea\u91cc\u5462\u8bf7\u95ee", "Yes."
    items = [(1, question), (2, chinese), (3, tiny), (4, " ..."), (5, question.lower())]
    windows = decontaminate.Windows.of_items(items, decontaminate.EDIT_RATE)
    texts = [
        f"quiz:  what is -- THE capital of peru", f"x{question}", "what is the capital of perus",
        f"\u5176\u4ed6{chinese}\u5176\u4ed6", "yes", "oh yes", " YES! ", "", None, "...",
    ]
    found = decontaminate.leaks_in(texts, windows)
    assert [[x[0] for x in own] for own in found] == [[1, 5], [], [], [2], [3], [], [3], [], [], []]
    assert texts[0][found[0][0][1] : found[0][0][2]] == "what is -- THE capital of peru"
    assert found[3][0][1:] == (2, 2 + len(chinese), 0)


def test_runs_cost_no_more_than_other_text():
    rng = random.Random(2)
    items = [(i, "b" * i + "a" * 52 + "".join(rng.choice("cdefgh ") for _ in range(60))) for i in range(5)]
    windows = decontaminate.Windows.of_items(items, decontaminate.EDIT_RATE)

    def seconds(text):
        start = time.perf_counter()
        found = decontaminate.leaks_in([text], windows)
        return time.perf_counter() - start, found

    seconds("warm up")
    mixed, _ = seconds("".join(rng.choice("abcdefgh ") for _ in range(20_000)))
    runs, found = seconds("a" * 20_000)
    assert found == [[]] and runs < 3 * mixed + 0.3
    inside = "x " + "a" * 9000 + items[2][1][54:] + " y"
    _, found = seconds(inside)
    assert 2 in [x[0] for x in found[0]]


def test_long_items_travel_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 4_000_000)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(30_000))
    bench = spark.createDataFrame([(1, text), (1, text), (2, "x" + text[5:700])], "item_id long, text string")
    sizes = [sum(len(t) for _, t in b) for b in decontaminate._item_blocks(
        decontaminate._pieces(bench.selectExpr("item_id AS i", "text AS t")), 0.06)]
    assert len(text) > 2 * decontaminate.PIECE and sum(sizes) < 1.02 * len(text) + 700
    limit = decontaminate.PIECE + decontaminate.BLOCK_CHARS // (decontaminate.WINDOW // 3 + 2)
    assert max(sizes) <= limit
    at = [0, decontaminate.PIECE - 40, len(text) - 70]
    docs = spark.createDataFrame([(i, f"zzz {text[i : i + 70]} zzz") for i in at], "doc_id long, text string")
    found = decontaminate.find_leaks(docs, bench).collect()
    assert [1 in [x.item_id for x in r.leaks] for r in found] == [True] * 3


def test_passages_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 150)
    passage = "It was the best of times, it was the worst of times; it was the age of wisdom"
    items = [(1, passage), (2, passage), (3, None), (4, "short"), (None, passage), (5, ""), (6, passage[::-1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "xx " + passage.upper().replace(" ", "\n--")), (3, passage),
            (None, passage), (4, "z" * 50_000 + " " + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("leaks", F.lit(1))
    found = decontaminate.find_leaks(docs, bench).collect()
    assert [sorted(x.item_id for x in r.leaks) for r in found] == [[], [], [1, 2], [1, 2], [1, 2], [1, 2]]
    assert found[3].leaks[0].start == 0 and found[3].leaks[0].end == len(passage)
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert all(not r.leaks for r in decontaminate.find_leaks(docs, bench.limit(0)).collect())


# ---- n-gram join -----------------------------------------------------------------------------


def plain_components(rows):
    """(set size, smallest reachable id) per row by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        n = max(1, len(words) - 4) if words else 0
        sets.append({tuple(words[i : i + 5]) for i in range(n)})
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                group[top(i)] = top(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[top(i)] = min(doc, smallest.get(top(i), doc))
    return sorted(
        ((-1 if d is None else d), len(sets[i]), -1 if d is None else smallest[top(i)])
        for i, (d, _) in enumerate(rows)
    )


def joined(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.join(table.withColumn("id", F.lit("clash"))).collect()
    return sorted(
        tuple(-1 if x is None else x for x in (r.doc_id, r.n_shingles, r.component_id)) for r in got
    )


def test_join_query(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = queries.op7_ngram_join(spark, SF).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in got)
    assert got == plain_components(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.execute(queries.ORACLES["op7_ngram_join"]).fetchall())


@pytest.mark.parametrize("small", [2, 24])
def test_large_groups_of_near_copies(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rng = random.Random(small)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(words) for _ in range(60)]
    for i in range(90):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(copy))
            change = rng.random()
            copy[at : at + 1] = [rng.choice(words)] if change < 0.6 else [] if change < 0.8 else [copy[at], "new"]
        rows.append((i, " ".join(copy)))
    passage = " ".join(rng.choice(words) for _ in range(20))
    for i in range(90, 140):
        own = " ".join(rng.choice(words) for _ in range(rng.randint(5, 40)))
        rows.append((i, f"{own} {passage}"))
    chain = [rng.choice(words) for _ in range(80)]
    for i in range(140, 170):
        rows.append((i, " ".join(chain[i - 140 : i - 100])))
    assert joined(spark, rows) == plain_components(rows)


def test_join_of_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [
        (5, "a b c d e f g"), (3, "A B\tC d\ne f g"), (9, "a b c"), (8, "a  b c"), (7, None), (6, ""),
        (4, " \n"), (None, "a b c d e f g"), (2, "x y z"), (2, "q r s t u v"), (11, "q r s t u v"),
        (12, long), (12, long), (13, long + " end"), (14, "é b c d e"), (None, "only me here"),
        (15, "only me here"),
    ]
    assert joined(spark, rows) == plain_components(rows)
    assert joined(spark, rows[:1]) == [(5, 3, 5)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(empty).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95)]
    rows = ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r.node: r.component for r in rows}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == 90


# ---- pipeline --------------------------------------------------------------------------------


def test_every_stage_decides_on_its_own_input(spark, documents):
    docs = documents
    columns = documents.columns
    before = {r.doc_id: r for r in documents.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "token_ids":
            assert docs.columns == columns
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    bad = {r.doc_id for r in labels if r.toxic == 1 or r.quality == 0}
    good = {r.doc_id for r in labels} - bad
    assert len(bad & set(kept["quality"])) <= 0.05 * len(bad)
    assert len(good & set(kept["quality"])) >= 0.95 * len(good)
    rows = [(i, r.text) for i, r in kept["quality"].items()]
    wanted = {d for d, n, c in plain_components(rows) if n == 0 or d == c}
    assert set(kept["near_duplicates"]) == wanted
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, r in kept["near_duplicates"].items() if not any(t in r.text for t in items)}
    assert set(kept["decontamination"]) == clean
    assert set(kept["personal_data"]) == clean
    for i, r in kept["personal_data"].items():
        assert not plain_spans(r.text) or not plain_spans(before[i].text)
        assert r.n_chars == len(r.text)
    assert set(kept["token_ids"]) == clean
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == clean


def test_near_copies_of_repeated_and_missing_ids(spark):
    """The smallest id of each group stays, and rows of one id with different texts are two documents."""
    words = [f"w{i}" for i in range(200)]
    one, near, two, three = (" ".join(w) for w in (words[:100], words[:99], words[100:150], words[150:]))
    rows = [
        (5, one, "a"), (3, near, "b"), (5, two, "c"), (5, two, "c"), (None, near, "d"),
        (None, three, "e"), (None, three, "f"), (9, three, "g"), (7, "", "h"), (7, "", "h"),
        (None, None, "i"), (1, "alone", "j"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    got = corpus_pipeline.distinct_documents(spark, docs, SF)
    assert got.columns == docs.columns
    wanted = [rows[i] for i in (1, 2, 7, 8, 9, 10, 11)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)


def test_pipeline_on_odd_documents(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (1, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stored(stage(spark, docs, str(tmp_path)), "odd")
    assert docs.count() == 3 and {r.n_tokens for r in docs.collect()} == {0}
    rated = corpus_pipeline.good_documents(spark, spark.createDataFrame(rows, schema), str(tmp_path))
    assert rated.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), "none")
    assert docs.count() == 0


