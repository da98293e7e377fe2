"""Exact top-k inner products by a three-phase uniform threshold.

Components are whole numbers, floor(scale * x), so scores are exact. The dimensions are cut into
``fragments``; the score of a query and a row is the sum of one part per fragment. A node is a
task that holds a block of queries and a block of rows in one fragment, and knows only its own
parts of the scores.

1. Every node sends its largest parts per query, about ``depth`` per query and fragment over all
   blocks of rows. The pairs so gathered are scored whole; the k-th best of a query is a safe
   cutoff: its k best rows all reach it.
2. The cutoff goes back to the nodes with the queries. A row that reaches the cutoff has a part of
   at least its share (cutoff / fragments) in some fragment, so the nodes send all such parts and
   nothing else. Parts that came from all fragments sum to the score, and may raise the cutoff.
   A part that did not come is below the share, which bounds the score of the other pairs.
3. Pairs that can still reach the cutoff are scored whole by the tasks that hold both vectors.

Rows with equal vectors are one row of this search, with their smallest ids: a list can hold no
more of them than it has places. Equal query vectors are one query. Blocks are of bounded size, and
the shuffles carry each vector once per block of the other side; nothing is broadcast.

Edge cases: vectors that are null, empty, or hold a null or non-finite component take no part;
vectors are compared with those of their own length only; rows equal in id and vector count once,
rows with one id and different vectors count each; equal scores go to the smaller id; a null id
takes no part; fewer candidates give fewer rows. A component is held to a size at which the score
of two vectors of that length still is a long (2^22 and more in size for 64 components).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import stored

#: Vectors of a block. A node may have to send all its pairs (32 bytes each) if all of them tie.
QUERIES = 2048
ROWS = 8192
#: Queries of a block that are worked on at once.
_STEP = 128
#: Ids of one query vector that share a copy of its list.
FOLD = 1024
_LOW = -(1 << 62)


def whole_numbers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, null where the vector takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    limit = F.floor(F.sqrt(float(2**62) / F.size(vector))).cast("double")
    held = F.transform(
        vector,
        lambda x: F.floor(F.greatest(-limit, F.least(limit, x.cast("double") * scale))),
    )
    return F.when(finite & (F.size(vector) > 0), held.cast("array<bigint>"))


def _classes(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """id, vector, same: distinct rows that take part; ``same`` is equal for equal vectors."""
    numbers = whole_numbers(F.col(vector), scale)
    rows = df.select(F.col(key).cast("bigint").alias("id"), numbers.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    same = F.sha2(F.array_join("v", ",").cast("binary"), 256)
    return rows.withColumn("same", same).groupBy("id", "same").agg(F.first("v").alias("v"))


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(table), dim)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, as whole numbers: in doubles where those are exact."""
    largest = [float(np.abs(m).max(initial=0)) for m in (a, b)]
    if largest[0] * largest[1] * a.shape[1] < 2.0**53:
        return a.astype(float) @ b.T.astype(float)
    return a @ b.T


def _blocks(df: DataFrame, size: int) -> int:
    return max(1, -(-df.count() // size))


class _Grid:
    """Query and row vectors, dealt to the cells of query block x row block x ``of``."""

    def __init__(self, queries: DataFrame, rows: DataFrame, blocks: tuple[int, int]):
        self.blocks = blocks

        def dealt(df: DataFrame, count: int, name: str) -> DataFrame:
            return df.select(
                F.col("number"), F.col("v"), F.size("v").alias("dim"),
                F.pmod(F.xxhash64("number"), F.lit(count)).cast("int").alias(name),
            )

        self.queries = dealt(queries, blocks[0], "qb")
        self.rows = dealt(rows, blocks[1], "rb")

    def cells(self, fragments: int, more: DataFrame | None = None) -> tuple:
        """Both sides grouped by cell; each carries its own fragment of the vectors only."""

        def spread(df: DataFrame, other: str, count: int) -> DataFrame:
            df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
            df = df.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))))
            start = F.floor(F.col("dim") * F.col("f") / fragments).cast("int")
            end = F.floor(F.col("dim") * (F.col("f") + 1) / fragments).cast("int")
            return df.withColumn("v", F.slice("v", start + 1, end - start))

        queries = self.queries if more is None else self.queries.join(more, "number")
        queries = spread(queries, "rb", self.blocks[1])
        rows = spread(self.rows, "qb", self.blocks[0])
        by = ["dim", "f", "qb", "rb"]
        return queries.groupBy(*by), rows.groupBy(*by)

    def scored(self, pairs: DataFrame) -> DataFrame:
        """query, row, score of the given pairs, from the whole vectors."""

        def run(wanted: pa.Table, vectors: pa.Table) -> pa.Table:
            dim = vectors["dim"][0].as_py()
            numbers, is_query = (vectors[c].to_numpy() for c in ("number", "is_query"))
            matrix = _matrix(vectors, dim)
            query, row = wanted["query"].to_numpy(), wanted["row"].to_numpy()
            found = []
            for flag, side in ((True, query), (False, row)):
                own = np.nonzero(is_query == flag)[0]
                own = own[np.argsort(numbers[own])]
                found.append(own[np.searchsorted(numbers[own], side)])
            score = np.empty(len(query), np.int64)
            for start in range(0, len(query), 1 << 16):
                a, b = (matrix[at[start : start + (1 << 16)]] for at in found)
                score[start : start + (1 << 16)] = (a * b).sum(axis=1)
            return pa.table({"query": query, "row": row, "score": score})

        dims = pairs.select("query", "row", "dim", *(
            F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(b)
            for c, n, b in zip(("query", "row"), self.blocks, ("qb", "rb"))
        ))
        other = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        held = self.queries.select("number", "v", "dim", "qb", F.lit(True).alias("is_query"),
                                   other("rb", self.blocks[1]))
        held = held.unionByName(
            self.rows.select("number", "v", "dim", "rb", F.lit(False).alias("is_query"),
                             other("qb", self.blocks[0]))
        )
        by = ["dim", "qb", "rb"]
        cells = dims.groupBy(*by).cogroup(held.groupBy(*by))
        return cells.applyInArrow(
            lambda a, b: run(a, b) if len(a) else _no_scores(),
            "query bigint, row bigint, score bigint",
        )


def _no_scores() -> pa.Table:
    return pa.table({c: pa.array([], pa.int64()) for c in ("query", "row", "score")})


def _parts(query, row, part, fragment: int, dim: int) -> pa.Table:
    """Parts of a node, as they travel."""
    return pa.table(
        {
            "query": pa.array(query, pa.int64()),
            "row": pa.array(row, pa.int64()),
            "dim": pa.array(np.full(len(query), dim, np.int32)),
            "f": pa.array(np.full(len(query), fragment, np.int32)),
            "part": pa.array(part, pa.int64()),
        }
    )


_PARTS = "query bigint, row bigint, dim int, f int, part bigint"


def _each_step(key, queries: pa.Table, rows: pa.Table, choose) -> pa.Table:
    """The chosen parts of a node: ``choose(parts, at)`` gives indices for a slice of its queries."""
    dim, fragment = key[0].as_py(), key[1].as_py()
    out = [_parts([], [], [], fragment, dim)]
    if len(queries) and len(rows):
        width = len(queries["v"][0])
        a, b = _matrix(queries, width), _matrix(rows, width)
        query, row = queries["number"].to_numpy(), rows["number"].to_numpy()
        for start in range(0, len(a), _STEP):
            parts = _scores(a[start : start + _STEP], b)
            i, j = choose(parts, slice(start, start + _STEP))
            out.append(_parts(query[start + i], row[j], parts[i, j].astype(np.int64), fragment, dim))
    return pa.concat_tables(out)


def _largest(parts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    k = min(k, parts.shape[1])
    j = np.argpartition(parts, parts.shape[1] - k, axis=1)[:, -k:]
    return np.repeat(np.arange(len(parts)), k), j.ravel()


def _kth(scores: DataFrame, k: int, name: str) -> DataFrame:
    """The k-th largest score of each query that has so many (number, ``name``)."""
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    best = scores.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    full = best.groupBy("query").agg(F.count("*").alias("_n"), F.min("score").alias(name))
    return full.where(F.col("_n") == k).select(F.col("query").alias("number"), name)


def search(
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = 64.0,
    fragments: int = 2,
    depth: int | None = None,
    block: tuple[int, int] = (QUERIES, ROWS),
) -> DataFrame:
    """The ``k`` rows with the largest inner product with each query: query_id, rank, vec_id, score.

    A row is no candidate of the query with its own id and vector.
    """
    places = k + 1  # the query's own row may take one
    depth = depth or 4 * places
    # ---- distinct vectors, with the ids that a list can hold of them
    members = _classes(rows, key, vector, scale)
    first = Window.partitionBy("same").orderBy("id")
    members = members.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= places)
    classes = members.groupBy("same").agg(
        F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")
    )
    classes = stored(classes.withColumn("number", F.monotonically_increasing_id()), "topk-rows")
    asked = stored(_classes(queries, key, vector, scale), "topk-queries")
    wanted = asked.groupBy("same").agg(F.first("v").alias("v"), F.count("*").alias("n"))
    wanted = wanted.withColumn("number", F.monotonically_increasing_id())
    wanted = stored(wanted, "topk-vectors")
    blocks = (_blocks(wanted, block[0]), _blocks(classes, block[1]))
    grid = _Grid(wanted, classes, blocks)

    # ---- phase 1: local lists, and a cutoff that all k best rows reach
    share = max(1, -(-depth // blocks[1]))

    def lists(key, own: pa.Table, other: pa.Table) -> pa.Table:
        return _each_step(key, own, other, lambda parts, _: _largest(parts, share))

    left, right = grid.cells(fragments)
    gathered = left.cogroup(right).applyInArrow(lists, _PARTS)
    seen = grid.scored(gathered.select("query", "row", "dim").distinct())
    cutoff = stored(_kth(seen, places, "cutoff"), "topk-cutoffs")

    # ---- phase 2: all parts that reach their share of the cutoff
    low = F.lit(_LOW).cast("bigint")
    least = F.ceil(F.col("cutoff") / F.lit(fragments).cast("decimal(10,0)")).cast("bigint")
    shares = wanted.select("number").join(cutoff, "number", "left").select(
        "number",
        F.coalesce("cutoff", low).alias("cutoff"),
        F.coalesce(least, low).alias("share"),
    )

    def reaching(key, own: pa.Table, other: pa.Table) -> pa.Table:
        limit = own["share"].to_numpy()
        return _each_step(key, own, other, lambda parts, at: np.nonzero(parts >= limit[at, None]))

    left, right = grid.cells(fragments, shares)
    parts = left.cogroup(right).applyInArrow(reaching, _PARTS)
    sums = parts.groupBy("query", "row", "dim").agg(
        F.sum("part").alias("score"), F.count("*").alias("seen")
    )
    sums = stored(sums, "topk-sums")
    complete = sums.where(F.col("seen") == fragments).select("query", "row", "score")
    raised = shares.join(_kth(complete, places, "higher"), "number", "left").select(
        F.col("number").alias("query"),
        "share",
        F.greatest("cutoff", F.coalesce("higher", low)).alias("cutoff"),
    )

    # ---- phase 3: score what can still reach the cutoff
    missing = F.lit(fragments) - F.col("seen")
    bound = F.col("score").cast("decimal(38,0)") + missing * (F.col("share") - 1).cast("decimal(20,0)")
    open_ = sums.join(raised, "query").where((F.col("seen") < fragments) & (bound >= F.col("cutoff")))
    found = complete.unionByName(grid.scored(open_.select("query", "row", "dim")))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"))
    found = found.withColumn("_r", F.rank().over(by_score)).where(F.col("_r") <= places)

    # ---- back to ids
    entries = found.join(classes.select(F.col("number").alias("row"), "ids", "same"), "row")
    entries = entries.select("query", "score", "same", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "same")
    entries = entries.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= places)
    answers = entries.groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score", "same"))).alias("answer")
    )
    return _handed_out(asked, wanted, answers, k)


def _handed_out(asked: DataFrame, wanted: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """Each query id's list: that of its vector without its own row.

    The list of a vector with many ids is copied once per FOLD of them, so that they are not all
    joined in one task.
    """
    copies = F.ceil(F.col("n") / FOLD).cast("int")
    common = wanted.where(F.col("n") > FOLD).select("same", copies.alias("copies"))
    ids = asked.select("id", "same").join(common, "same", "left").select(
        "id", "same",
        F.pmod(F.xxhash64("id"), F.coalesce("copies", F.lit(1))).cast("int").alias("copy"),
    )
    lists = wanted.select("same", F.col("number").alias("query"), copies.alias("copies")).join(
        answers, "query"
    )
    lists = lists.select(
        "same", "answer", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    )
    mine = ids.join(lists, ["same", "copy"])
    others = F.filter(
        "answer", lambda e: (e["vec_id"] != F.col("id")) | (e["same"] != F.col("same"))
    )
    rows = mine.select(
        F.col("id").alias("query_id"), "same", F.posexplode(F.slice(others, 1, k)).alias("at", "e")
    )
    return rows.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.vec_id", "e.score"
    )
