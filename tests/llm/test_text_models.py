"""Sharding, token ids, languages, quality and language-model scores."""

import base64
import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillroll.llm import bpe, language, lm, quality, queries, sharding
from tillroll.llm.common import most_frequent

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
ODD = [
    (1, "the cat sat on the mat", "en"),
    (1, "the cat sat on the mat", "en"),
    (2, None, "en"),
    (3, "", None),
    (None, "le chat est sur la table", "fr"),
    (4, "12 34 !? \n\t", "en"),
    (5, "Ünï çødé 😀 　 x y 's 're  two  spaces \n\n end ", None),
    (6, "a" * 20_000 + " " + "b c " * 5_000, "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- sharding --------------------------------------------------------------------------------


def test_shards_are_stable_and_gapless(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k").withColumn("slot", F.lit(7))
    now = sharding.assign(keys, "k", [1.0] * 10)
    grown = sharding.assign(now, "k", [1.0] * 11, "grown")
    rows = sharding.number_slots(grown, "shard", "k").toPandas()
    moved = rows[rows["shard"] != rows["grown"]]
    assert set(moved["grown"]) == {10} and 0.07 < len(moved) / 20_000 < 0.11
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_shares_follow_the_weights(spark):
    keys = spark.range(30_000).withColumnRenamed("id", "k")
    got = sharding.assign(keys, "k", [1.0, 2.0, 3.0]).groupBy("shard").count().toPandas()
    share = got.set_index("shard")["count"] / 30_000
    assert np.allclose(share.sort_index(), [1 / 6, 2 / 6, 3 / 6], atol=0.02)
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("k"), [1.0, 0.0])


def test_shards_of_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(sharding, "UNFOLD", 2)
    many = odd.union(odd).union(odd)
    rows = sharding.number_slots(sharding.assign(many, "doc_id", [1.0] * 3), "shard", "doc_id")
    rows = rows.toPandas()
    assert len(rows) == 3 * len(ODD)
    assert rows.groupby(rows["doc_id"].fillna(-1))["shard"].nunique().max() == 1
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    empty = sharding.number_slots(
        sharding.assign(odd.limit(0), "doc_id", [1.0]), "shard", "doc_id"
    )
    assert empty.count() == 0


def test_sharding_query(spark, documents):
    rows = queries.op8_sharding(spark, SF).toPandas().set_index("doc_id")
    for d in documents.collect():
        raw = (d.text or "").encode()
        assert rows.loc[d.doc_id, "size"] == len(raw) + 8
        assert rows.loc[d.doc_id, "text_crc32"] == zlib.crc32(raw)


# ---- token ids -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.Vocabulary.read(path, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference_coder(vocabulary):
    return tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=vocabulary.ranks,
        special_tokens={},
    )


def test_hash_is_perfect_and_minimal(vocabulary):
    keys = list(vocabulary.ranks)
    assert sorted(vocabulary.hash.slots(keys)) == list(range(len(keys)))


def test_rank_file_is_read_whole(vocabulary):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    assert vocabulary.ranks == ranks


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(vocabulary, reference_coder, text):
    got = [i for row in vocabulary.ids(vocabulary.pre_tokens(text)) for i in row]
    assert got == reference_coder.encode_ordinary(text)


def test_round_trip_of_odd_rows(spark, odd, vocabulary, reference_coder, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    clash = odd.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    rows = bpe.decode(bpe.encode(clash, vocabulary), vocabulary).collect()
    at_once = bpe.round_trip(clash, vocabulary)
    apart = bpe.decode(bpe.encode(clash, vocabulary), vocabulary).drop("text")
    assert sorted(map(str, at_once.collect())) == sorted(map(str, apart.collect()))
    assert at_once.dtypes == apart.dtypes
    assert len(rows) == len(ODD)
    for r in rows:
        assert list(r.ids) == reference_coder.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    none = spark.createDataFrame([(None,)], "ids array<int>")
    assert bytes(bpe.decode(none, vocabulary).first().decoded) == b""
    assert bpe.encode(odd.limit(0), vocabulary).count() == 0


def test_token_query(spark, documents, reference_coder):
    rows = queries.op6_byte_bpe(spark, SF).toPandas().set_index("doc_id")
    for d in documents.collect():
        ids = reference_coder.encode_ordinary(d.text or "")
        own = rows.loc[d.doc_id]
        assert own.n_tokens == len(ids)
        assert own.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


# ---- languages -------------------------------------------------------------------------------


def test_held_out_languages_are_found(spark, documents):
    rows = queries.op3_language_id(spark, SF).join(documents.select("doc_id", "lang"), "doc_id")
    rows = rows.toPandas()
    assert len(rows) == documents.count() and rows["score"].between(0, 1).all()
    unseen = rows[rows["held_out"]]
    assert len(unseen) > 20 and (unseen["lang"] == unseen["lang_pred"]).mean() > 0.95
    marks = rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    assert (marks == rows["held_out"]).all()


def test_shares_of_a_mixture(spark, documents):
    model = language.fit(documents)
    en, fr = (
        max((d.text for d in documents.where(F.col("lang") == x).collect()), key=len)[:1500]
        for x in ("en", "fr")
    )
    both = spark.createDataFrame([(en + " " + fr,), (en,)], "text string")
    mixed, pure = language.predict(both, model).collect()
    assert set(mixed.lang_shares) >= {"en", "fr"}
    assert abs(mixed.lang_shares["en"] - 0.5) < 0.15
    assert pure.lang_pred == "en" and pure.score > 0.95


def test_mixture_equals_plain_em():
    rng = np.random.default_rng(0)
    names = ["x", "y", "z"]
    p = rng.dirichlet(np.ones(language.BUCKETS), 3)
    model = language.LanguageModel(names, np.log(p.T), 3.0)
    texts = [rng.choice(language.BUCKETS, 400, p=p[0]),
             np.concatenate([rng.choice(language.BUCKETS, 300, p=p[i]) for i in (0, 2)])]
    got = language.shares(texts, model)
    for row, text in zip(got, texts):
        on = np.flatnonzero(row)
        share = np.full(len(on), 1 / len(on))
        for _ in range(200):
            joint = p[on][:, text].T * share
            share = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        assert np.allclose(row[on], share, atol=0.02)
    assert got[0].argmax() == 0 and set(np.flatnonzero(got[1])) == {0, 2}


def test_languages_of_odd_rows(spark, odd):
    model = language.fit(odd)
    clash = odd.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(3))
    rows = language.predict(clash, model).toPandas()
    unknown = rows["text"].isna() | rows["text"].isin(["", "12 34 !? \n\t"])
    assert ((rows["lang_pred"] == "und") == unknown).all() and len(rows) == len(ODD)
    nothing = language.fit(odd.limit(0))
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}
    assert language.predict(odd.limit(0), model).count() == 0


# ---- quality ---------------------------------------------------------------------------------


def test_quality_query_separates_the_labels(spark):
    rows = queries.op9_quality(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = rows.merge(labels, on="doc_id")
    good = (both["quality"] == 1) & (both["toxic"] == 0)
    assert (both["keep"] == good).mean() > 0.95
    assert rows["tail_probability"].between(0, 1).all()
    assert rows["expected_grade"].between(0, 2).all()


def graded(spark, rows):
    """Documents and ratings of (id, grade, text)."""
    table = spark.createDataFrame(rows, "doc_id long, grade int, text string")
    return table.select("doc_id", "text"), table.select("doc_id", "grade")


def test_ordinal_grades(spark):
    rows = [(i, int(i % 3), f"w{i % 3} common {i}") for i in range(60)]
    model = quality.fit(*graded(spark, rows), 3)
    assert (np.diff(model.thresholds) > 0).all()
    texts = spark.createDataFrame([("w0 common",), ("w1 common",), ("w2 common",)], "text string")
    grades = [r.expected_grade for r in quality.score(texts, model, tail=2).collect()]
    assert grades[0] < 0.5 < grades[1] < 1.5 < grades[2]


def plain_fit(lists, grade, grades, ridge=1.0):
    """Weights of distinct features and thresholds by plain gradient steps on whole lists."""
    features = sorted({f for own in lists for f in own if sum(f in x for x in lists) >= 5})
    x = np.array([[f in own for f in features] for own in lists], float)
    w, cuts = np.zeros(len(features)), np.linspace(-1, 1, grades - 1)
    for _ in range(30_000):
        below = 1 / (1 + np.exp(-(cuts[None, :] - (x @ w)[:, None])))
        edges = np.hstack([np.zeros((len(x), 1)), below, np.ones((len(x), 1))])
        slopes = edges * (1 - edges)
        at = np.arange(len(x))
        p = edges[at, grade + 1] - edges[at, grade]
        d = (slopes[at, grade + 1] - slopes[at, grade]) / p
        by_cut = [
            -(slopes[grade == k, k + 1] / p[grade == k]).sum()
            + (slopes[grade == k + 1, k + 1] / p[grade == k + 1]).sum()
            for k in range(grades - 1)
        ]
        w -= 0.001 * (x.T @ d + ridge * w)
        cuts -= 0.001 * np.array(by_cut)
    return dict(zip(features, w)), cuts


def test_fit_equals_plain_gradient_descent(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(150):
        words = rng.choice(["a", "b", "c", "d", "e"], 4).tolist() + [f"only{i}"]
        grade = int(np.clip(("a" in words) + ("b" in words) + rng.integers(-1, 2), 0, 2))
        rows.append((i, grade, " ".join(words)))
    model = quality.fit(*graded(spark, rows), 3, rounds=200)
    hasher = quality.FeatureHasher()
    lists = [set(hasher(t).tolist()) for _, _, t in rows]
    weights, cuts = plain_fit(lists, np.array([g for _, g, _ in rows]), 3)
    found = dict(zip(model.places.tolist(), model.weights.tolist()))
    assert set(found) == set(weights)
    scores = [sum(found.get(f, 0) for f in own) for own in lists]
    wanted = [sum(weights.get(f, 0) for f in own) for own in lists]
    shift = np.subtract(model.thresholds, cuts).mean()
    assert np.subtract(scores, wanted) == pytest.approx(shift, abs=0.05)
    assert np.subtract(model.thresholds, cuts) == pytest.approx(shift, abs=0.05)


def test_fitted_rows_are_bounded_whatever_the_copies(spark):
    rows = [(i, i % 2, f"text {i}") for i in range(300)]
    rows += [(1000 + i, 1, "hot copy") for i in range(200)] + [(2000 + i, 0, None) for i in range(50)]
    rows += [(5, 0, "other text of the id"), (3000, 0, "hot copy"), (3001, None, "x"), (None, 1, "y")]
    documents, ratings = graded(spark, rows)

    def chosen(n):
        found = quality.fitted_rows(
            documents.withColumnRenamed("doc_id", "key"), ratings.withColumnRenamed("doc_id", "key"), n
        )
        return sorted(map(tuple, found.collect()))

    whole = chosen(10_000)
    lowest = {i: min(g for j, g, _ in rows if j == i and g is not None) for i, g, _ in rows if i and g is not None}
    lowest[0] = 0
    wanted = {(lowest[i], t or "") for i, g, t in rows if i is not None and i in lowest}
    assert whole == sorted(wanted)
    some = chosen(100)
    assert len(some) == 100 and set(some) <= set(whole) and some == chosen(100)


def test_shape_of_a_long_word_is_that_of_the_whole_word():
    hasher = quality.FeatureHasher()
    assert set(hasher("a1" * 40)) != set(hasher("a1" * 40 + "X")) - {hasher._word(b"a1" * 40 + b"X")[0]}
    assert hasher._word(b"-." * 40 + b"a")[1] != hasher._word(b"-." * 40 + b"1")[1]


def test_loss_slope_matches_differences():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    lists = [[0, 1], [2], [1, 2], [0], []]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0, 1, 2, 1, 2], pa.int32()), pa.array(lists, pa.list_(pa.int32()))],
        names=["grade", "at"],
    )

    class Shared:
        def __init__(self, *value):
            self.value = value

    def loss(weights, cuts):
        out = next(iter(quality._loss_rows(Shared(weights, cuts))([batch])))
        return np.concatenate([np.frombuffer(b) for b in out.column(1).to_pylist()])

    weights, cuts = rng.normal(size=3), np.array([-0.4, 0.9])
    slope = loss(weights, cuts)
    for i in range(3):
        step = np.eye(3)[i] * 1e-5
        rise = loss(weights + step, cuts)[-1] - loss(weights - step, cuts)[-1]
        assert slope[i] == pytest.approx(rise / 2e-5, abs=1e-4)
    for k in range(2):
        step = np.eye(2)[k] * 1e-5
        rise = loss(weights, cuts + step)[-1] - loss(weights, cuts - step)[-1]
        assert slope[3 + k] == pytest.approx(rise / 2e-5, abs=1e-4)


def test_quality_of_odd_rows(spark, odd):
    rated = odd.withColumn("grade", F.when(F.col("doc_id") == 1, 1).when(F.col("doc_id") == 6, 0))
    model = quality.fit(odd, rated, 2)
    clash = odd.withColumn("expected_grade", F.lit("x"))
    assert quality.score(clash, model).count() == len(ODD)
    flat = quality.fit(odd, rated.where("grade is null"), 3)
    rows = quality.score(odd, flat).collect()
    assert len({r.expected_grade for r in rows}) == 1
    assert quality.score(odd.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        quality.fit(odd, rated.withColumn("grade", F.lit(5)), 2)


def test_most_frequent_rows(spark):
    rows = [(i, 1 + (i * 7919) % 97 // 9) for i in range(3000)]
    table = spark.createDataFrame(rows, "key long, n long").repartition(5)
    few = [(r.key, r.n) for r in most_frequent(table, "n", "key", 40).collect()]
    all_rows = [(r.key, r.n) for r in most_frequent(table, "n", "key", 2900).collect()]
    assert len(few) == 40 and few == all_rows[:40] and len(set(all_rows)) == 2900
    counts = [n for _, n in all_rows]
    assert counts == sorted(counts, reverse=True) and counts[0] == max(n for _, n in rows)
    assert most_frequent(table.limit(0), "n", "key", 3).count() == 0


# ---- language-model scores -------------------------------------------------------------------


SMALL = lm.Settings(listed=7, classes=4, tail_classes=3, known=12, hidden=4, rounds=2,
                    train_lanes=4, train_steps=20, lanes=3, window=5)


def test_base_score_and_counts(spark, documents):
    rows = queries.op10_gated_lm(spark, SF).toPandas().set_index("doc_id")
    docs = documents.toPandas().set_index("doc_id")["text"].fillna("")
    held = docs.index.map(lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    words = docs.map(lambda t: [*t.encode().lower().split(), None])
    counts = collections.Counter(w for own in words[~held] for w in own)
    total, types = sum(counts.values()), len(counts)
    for i, own in words.items():
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in own)
        assert rows.loc[i, "base_score"] == pytest.approx(base)
        assert rows.loc[i, "n_tokens"] == len(own)
        assert rows.loc[i, "n_known"] == sum(w in counts for w in own)
    assert set(rows["train_tokens"]) == {total}
    assert (rows.loc[docs.index, "held_out"].to_numpy() == held).all()
    unseen = rows[rows["held_out"]]
    assert unseen["score"].sum() > unseen["base_score"].sum()


def lexicon_of(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = lm.count_words(df, SMALL)
    return counts, lm.read_lexicon(counts, SMALL)


def test_probabilities_sum_to_one(spark):
    texts = ["a b c d e f g h i j k l m n", "a b a c q r s t", ""]
    counts, lexicon = lexicon_of(spark, texts)
    network = lm.Network(lexicon)
    network.flat[:] += np.random.default_rng(0).normal(size=len(network.flat)) * 0.3
    every = np.arange(len(lexicon.place) + SMALL.tail_classes, dtype=np.int32)
    state = np.random.default_rng(1).normal(size=(1, 4)).astype(np.float32)
    found, _ = network.log_probability(np.repeat(state, len(every), axis=0), every)
    assert network.words[-1] == len(lexicon.place) and np.exp(found).sum() == pytest.approx(1, abs=1e-4)
    sums = collections.Counter()
    for row in counts.collect():
        if row.word not in lexicon.place:
            sums[row.tail] += row.n + 1
    assert all(lexicon.tail_sums[t] == sums[t] + 1 for t in range(SMALL.tail_classes))


def test_every_known_word_is_in_the_softmax(spark):
    texts = [" ".join(f"w{i}" for i in range(start, 3000)) for start in (0, 500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    chosen = lm.Settings()
    lexicon = lm.read_lexicon(lm.count_words(df, chosen), chosen)
    assert chosen.listed == chosen.known - 1
    network = lm.Network(lexicon)
    assert network.words[-1] == 3001 and network.classes[-1] == len(network.words) - 1
    assert (np.diff(network.words) > 0).all() and (np.diff(network.classes) > 0).all()
    assert set(lexicon.place) == set(lexicon.counts) and len(lexicon.place) == 3001
    reader = lm.Reader(lexicon)
    assert len(set(reader.tokens(reader.codes(lm.words_of(texts[0]))).tolist())) == 3001


def test_network_slope_matches_differences(spark):
    texts = ["a b c d e f g h i j k l m n", "a b a c q r s t", "z y x"]
    _, lexicon = lexicon_of(spark, texts)
    reader = lm.Reader(lexicon)
    tokens = [reader.tokens(reader.codes(lm.words_of(t))) for t in texts]
    flat = np.random.default_rng(0).normal(size=len(lm.Network(lexicon).flat)) * 0.3
    lanes = lm.Lanes(tokens, 2, reader.end)
    fresh, valid = lanes.fresh, np.arange(len(lanes.tokens))[:, None] < lanes.lengths[None, :]

    def passed(values, grad=None):
        own = lm.Network(lexicon, values.astype(np.float32))
        start = np.zeros((lanes.tokens.shape[1], 4), np.float32)
        states, _, kept = own.steps(own.read[lanes.before], fresh, start)
        found, back = own.log_probability(states[valid], lanes.tokens[valid], grad)
        if grad is None:
            return -float(found.astype(float).sum())
        whole = np.zeros_like(states)
        whole[valid] = back
        read = own.backward(kept, whole, fresh, grad)
        np.add.at(grad.read, lanes.before.ravel(), read.reshape(-1, read.shape[-1]))
        return None

    slope = np.zeros(len(flat), np.float32)
    passed(flat, lm._view(lm.Network(lexicon), slope))
    for at in np.random.default_rng(2).choice(len(flat), 60, replace=False):
        step = np.zeros(len(flat))
        step[at] = 1e-2
        rise = (passed(flat + step) - passed(flat - step)) / 2e-2
        assert slope[at] == pytest.approx(rise, abs=0.02)


@pytest.mark.parametrize("held", [1, 40, 1 << 24])
def test_words_are_read_by_the_column(monkeypatch, held):
    texts = ["A b\x1cc\tb  ", None, "", " \x0b\x0c ", "\u00c4rger \u00a0x b\r\nB", "lone", "b " * 30]
    monkeypatch.setattr(lm, "READ_BYTES", held)
    found, parts = [], 0
    for words in lm.read_words(pa.array(["cut off", *texts]).slice(1)):
        assert [lm.digest(w) for w in words.distinct] == words.digests.tolist()
        own = np.split(words.distinct[words.at], np.cumsum(words.sizes)[:-1])
        found, parts = found + [x.tolist() for x in own], parts + 1
    assert found == [lm.words_of(t) for t in texts]
    assert parts == 1 if held > 1000 else parts > 1


@pytest.mark.parametrize("scale", [0.3, 40])
def test_outputs_with_small_and_large_weights(spark, monkeypatch, scale):
    """In blocks of any size, and where logits have to be bounded, as in plain double arithmetic."""
    _, lexicon = lexicon_of(spark, ["a b c d e f g h i j k l m n", "a b a c q r s t"])
    network, rng = lm.Network(lexicon), np.random.default_rng(3)
    network.flat[:] = rng.normal(size=len(network.flat)) * scale
    tokens = rng.integers(0, network.listed + SMALL.tail_classes, 200).astype(np.int32)
    states = np.tanh(rng.normal(size=(200, 4))).astype(np.float32)

    def plain(state, outputs, at):
        logits = np.clip(outputs[:, :-1].astype(float) @ state + outputs[:, -1], -60, 60)
        return logits[at] - np.log(np.exp(logits).sum())

    wanted, groups = [], len(network.classes) - 1
    for state, token in zip(states, tokens):
        if token >= network.listed:
            wanted.append(plain(state, network.group, token - network.listed + groups))
            continue
        own = network.class_of[token]
        group = network.group_of[own]
        low, high = network.classes[group : group + 2]
        first, last = network.words[own : own + 2]
        wanted.append(
            plain(state, network.group, group)
            + plain(state, getattr(network, "class")[low:high], own - low)
            + plain(state, network.word[first:last], token - first)
        )
    for size in (1, 64, 1 << 16):
        monkeypatch.setattr(lm, "CACHED_OUTPUTS", size)
        found, _ = network.log_probability(states, tokens)
        assert np.allclose(found, wanted, rtol=1e-4, atol=1e-3)


def test_state_goes_over_windows(spark):
    texts = ["a b c d e f g h i j k l m n o p q r s t u v", "a b a c q r s t", ""]
    _, lexicon = lexicon_of(spark, texts)
    reader, network = lm.Reader(lexicon), lm.Network(lexicon)
    tokens = [reader.tokens(reader.codes(lm.words_of(t))) for t in texts]
    short = lm.score_texts(network, tokens, SMALL, reader.end)
    from dataclasses import replace

    whole = lm.score_texts(network, tokens, replace(SMALL, window=500, lanes=1), reader.end)
    assert np.allclose(short, whole, rtol=1e-4)


def test_scores_of_odd_rows(spark, odd):
    counts = lm.count_words(odd, SMALL)
    lexicon = lm.read_lexicon(counts, SMALL)
    flat = lm.train(odd, lexicon, "doc_id")
    clash = odd.withColumn("score", F.lit("x")).withColumn("n_tokens", F.lit("y"))
    rows = lm.score(clash, counts, lexicon, flat).toPandas()
    assert len(rows) == len(ODD) and rows["score"].map(np.isfinite).all()
    assert rows[rows["doc_id"].isin([2, 3])]["n_tokens"].tolist() == [1, 1]
    none = lm.count_words(odd.limit(0), SMALL)
    blank = lm.read_lexicon(none, SMALL)
    flat = lm.train(odd.limit(0), blank, "doc_id")
    rows = lm.score(odd, none, blank, flat).toPandas()
    assert (rows["base_score"] == 0).all() and (rows["n_known"] == 0).all()
    assert rows["score"].map(np.isfinite).all()
