"""The text operators as queries over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (
    ann,
    bpe,
    decontaminate,
    html,
    language,
    lm,
    merkle,
    ngram_join,
    pii,
    quality,
    sharding,
    spelling,
    topk,
)
from tillroll.llm.common import held_out, stored, table, whole_text

SHARDS = 24
#: Ratings: 0 toxic, 1 low quality, 2 good.
GRADES = 3
GOOD = 2
KEEP_PROBABILITY = 0.5


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item that a document holds: place in its text and edits."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(documents, table(spark, sf, "benchmark"))
    leak = F.explode("leaks").alias("leak")
    return found.select("doc_id", leak).select("doc_id", "leak.*")


def op2_html_text(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    found = html.extract(pages, html.fit(pages))
    return found.select(
        "page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars")
    )


def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """The main language of every document, learned from three quarters of them."""
    documents = table(spark, sf, "documents").withColumn("held_out", held_out("doc_id", 4, 2))
    model = language.fit(documents.where(~F.col("held_out")))
    return language.predict(documents.select("doc_id", "held_out", "text"), model).drop("text")


def rating(quality_label: str = "quality", toxic: str = "toxic"):
    """Grade of a labelled document; null where the labels do not give one."""
    return (
        F.when(F.col(toxic) == 1, 0).when(F.col(quality_label) == 0, 1).when(
            (F.col(quality_label) == 1) & (F.col(toxic) == 0), GOOD
        )
    )


def fit_quality(documents: DataFrame, labels: DataFrame) -> quality.QualityModel:
    """The ordinal model on the labelled documents; one rating per document, the lowest."""
    return quality.fit(documents, labels.select("doc_id", rating().alias("grade")), GRADES)


def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Expected grade of every document, the probability of a good one, and the decision."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    model = fit_quality(documents, table(spark, sf, "labels"))
    return (
        quality.score(documents, model, tail=GOOD)
        .drop("text")
        .withColumn("keep", F.col("tail_probability") >= KEEP_PROBABILITY)
    )


def op4_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of pattern spans per kind, their digest, and all spans of every document."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    found = pii.find(documents, keep_text=False)

    def joined(spans: str):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(parts, ",")

    def counted(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [counted(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op5_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    rows = table(spark, sf, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 100 == 0), 10)


def op6_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document, and the bytes they decode to, as digests."""
    vocabulary = bpe.Vocabulary.read(
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    documents = table(spark, sf, "documents").select("doc_id", "text")
    coded = bpe.encode(documents, vocabulary).drop("text")
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return bpe.decode(coded, vocabulary).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op7_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    """Set size and component of every document under a shingle similarity of 0.8."""
    return ngram_join.join(table(spark, sf, "documents").select("doc_id", "text"))


def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Documents over 24 equal shards by rendezvous hashing of ``doc_id``."""
    text = whole_text()
    documents = table(spark, sf, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    now = sharding.assign(documents, "doc_id", [1.0] * SHARDS)
    grown = sharding.assign(now, "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    return sharding.number_slots(grown, "shard", "doc_id").withColumn("law", F.lit("key"))


def op10_gated_lm(spark: SparkSession, sf: str) -> DataFrame:
    """Log10 probability of every document, learned from six sevenths of them."""
    settings = lm.Settings()
    documents = table(spark, sf, "documents").select(
        "doc_id", "text", held_out("doc_id", 7, 2).alias("held_out")
    )
    learned = documents.where(~F.col("held_out"))
    counts = stored(lm.count_words(learned, settings), "lm-counts")
    lexicon = lm.read_lexicon(counts, settings)
    weights = lm.train(learned, lexicon, "doc_id")
    return lm.score(documents, counts, lexicon, weights)


def op11_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty largest inner products of every twentieth vector."""
    rows = table(spark, sf, "embeddings")
    return topk.search(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Words of all documents with their commonest neighbour by one edit, and the ends of chains."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return spelling.group(spelling.count_words(documents))


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf, proof and root of every document, and the root that its tampered version has."""
    documents = table(spark, sf, "documents")
    longer = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    tampered = held_out("doc_id", 7, 0)
    rows = documents.select(
        "doc_id",
        "lang",
        merkle.digest_of(["doc_id", "source", "lang", "n_chars", "text"]).alias("leaf"),
        F.when(tampered, merkle.digest_of(["doc_id", "source", "lang", longer, "text"])).alias(
            "changed"
        ),
    )
    manifest = merkle.build(rows, "doc_id", "lang", "leaf", "changed")
    siblings = F.array_join(F.transform("proof", lambda step: step["digest"]), "")
    folded = F.element_at("copies", -1)["digest"]
    return merkle.versions(manifest).select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        F.lit(manifest.root).cast("string").alias("root"),
        F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == manifest.root).alias("verified"),
    )


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_html_text": op2_html_text,
    "op3_language_id": op3_language_id,
    "op4_personal_data": op4_personal_data,
    "op5_nearest": op5_nearest,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_ngram_join": op7_ngram_join,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_gated_lm": op10_gated_lm,
    "op11_exact_topk": op11_exact_topk,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: The 256 values of the reflected CRC-32, from its polynomial.
CRC32 = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries
)"""

#: DuckDB SQL; the other operators hold what SQL cannot express.
ORACLES = {
    "op7_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 80 * (p.n + q.n - c)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x AS a, x AS b FROM edges UNION SELECT a, y FROM reach JOIN edges ON b = x
), smallest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(b, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN smallest ON a = d.doc_id""",
    "op11_exact_topk": """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scores
)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 20""",
    "op12_spelling_variants": CRC32
    + r"""
, runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      string_split(doc_id || ':' || run, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
        ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
      lambda h, b: xor(h >> 8, entries[(xor(h, b) & 255) + 1]))) AS h
  FROM runs, crc_table
), words AS (
  SELECT CASE WHEN h % 199 = 0
    THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c
  FROM hashed
), vocabulary AS (
  SELECT word, sum(c)::BIGINT AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), without AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM without a JOIN without b USING (i, rest)
  WHERE a.word <> b.word
  UNION SELECT v.word, v.n, w.word, w.n FROM vocabulary v JOIN without w ON v.word = w.rest
  UNION SELECT w.word, w.n, v.word, v.n FROM vocabulary v JOIN without w ON v.word = w.rest
), best AS (
  SELECT word, n, count(*) OVER (PARTITION BY word) AS n_near, other, m,
    row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM near
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form,
    CASE WHEN m >= 5 * v.n THEN m END AS form_n
  FROM vocabulary v LEFT JOIN best b ON b.word = v.word AND place = 1
), chain AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms l ON l.word = c.at AND l.form IS NULL""",
    "op13_merkle_manifest": CRC32 + r"""
, changes AS (
  SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id) AS pos,
    coalesce(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda h, b: xor(h >> 8, entries[(xor(h, b) & 255) + 1])), -1) AS h
  FROM documents, crc_table
), fields AS (
  SELECT *, xor(h, 4294967295) % 7 = 0 AND doc_id IS NOT NULL AS tampered,
    concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'),
      coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM changes
), leaves AS (
  SELECT pos, doc_id, lang,
    sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN tampered THEN sha256(
      head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS changed
  FROM fields
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pos) - 1 AS i FROM leaves
), nodes AS (
  SELECT lang, 0 AS lvl, i, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM numbered
  UNION ALL
  SELECT lang, lvl + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY lang, lvl, i // 2
), subroots AS (
  SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i,
    count(*) OVER () AS n, max(lvl) OVER () AS deep FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS lvl, i, d, n FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 1) // 2
  FROM upper WHERE n > 1 GROUP BY lvl, i // 2
), climb AS (
  SELECT pos, lang, 0 AS lvl, i, coalesce(changed, leaf) AS folded, '' AS proof FROM numbered
  UNION ALL
  SELECT pos, c.lang, c.lvl + 1, c.i // 2,
    CASE WHEN s.d IS NULL THEN sha256(folded)
      WHEN s.i > c.i THEN sha256(folded || s.d) ELSE sha256(s.d || folded) END,
    proof || coalesce(s.d, '')
  FROM climb c
  JOIN nodes o ON o.lang IS NOT DISTINCT FROM c.lang AND o.lvl = c.lvl AND o.i = c.i AND o.n > 1
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM c.lang AND s.lvl = c.lvl AND s.i = xor(c.i, 1)
), inside AS (
  SELECT c.pos, b.d AS subroot, b.i, folded, proof FROM climb c
  JOIN nodes o ON o.lang IS NOT DISTINCT FROM c.lang AND o.lvl = c.lvl AND o.n = 1
  JOIN subroots b ON b.lang IS NOT DISTINCT FROM c.lang
), outside AS (
  SELECT pos, 0 AS lvl, i, folded, proof FROM inside
  UNION ALL
  SELECT pos, c.lvl + 1, c.i // 2,
    CASE WHEN s.d IS NULL THEN sha256(folded)
      WHEN s.i > c.i THEN sha256(folded || s.d) ELSE sha256(s.d || folded) END,
    proof || coalesce(s.d, '')
  FROM outside c
  JOIN upper o ON o.lvl = c.lvl AND o.i = c.i AND o.n > 1
  LEFT JOIN upper s ON s.lvl = c.lvl AND s.i = xor(c.i, 1)
)
SELECT l.doc_id, l.leaf, f.subroot, r.d AS root, sha256(o.proof) AS proof_sha256,
  o.folded AS folded_root, o.folded = r.d AS verified
FROM numbered l JOIN inside f USING (pos)
JOIN outside o ON o.pos = l.pos AND o.lvl = (SELECT max(lvl) FROM upper)
CROSS JOIN (SELECT d FROM upper WHERE n = 1) r""",
}
