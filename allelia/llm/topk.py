"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length into buckets of bounded size. Each query gets a floor for its k-th score from the
longest vectors of all; buckets are then asked in rounds, the longest first, and each round's results raise the floors for
the next. A bucket is skipped for a query when the floor divided by both lengths, the local cosine threshold, exceeds
one. Otherwise the threshold chooses how the bucket is pruned for it: by coordinates, which keeps the candidates whose
share of the query's largest coordinates lets them reach the cosine at all, or by length, which keeps those long enough.
What each would keep is told by the bucket's lengths and a few of its candidates, and the cheaper way is taken. What is
left is verified by exact integer products.

Queries and buckets meet in blocks: a group is one query block and one bucket, both bounded, so no task grows with the
data. Candidates are copied once per query block, so blocks of queries are as large as a task can hold. Ties in a
bucket's length are split by a hash. Products are exact while both lengths' product is under 2^53, and beyond it are
taken in wrapping 64-bit integers.

Defined results: a null vec_id, or a vector that is null or holds a null or non-finite component, takes no part; rows that
share a vec_id are vectors of their own, each a candidate and (if its id is asked for) a query, whose ranks are its own;
vectors of unequal dimension are compared as if padded by zeros; equal scores go to the smaller vec_id; with fewer
candidates than k all are returned; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, share, small

K = 5
#: Rows of a bucket and of a query block.
BUCKET, QUERIES = 8192, 32_768
#: Longest vectors that give each query its floor; bounded, so that they may be broadcast.
SEEDS = 1024
#: The largest coordinates of a query that prune; candidates of a bucket that tell how well; and what a candidate costs
#: that is looked at by itself, against one in a block of products.
FOCUS, PROBED, ALONE = 8, 64, 4.0
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (array of long), norm (length) of every row that takes part: floor(scale * x) of every component."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")
    ).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    rows = rows.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))))
    rows = rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def matrix(column, width: int | None = None) -> np.ndarray:
    """An int64 matrix of lists, padded by zeros."""
    lists = [np.asarray(x, np.int64) for x in column]
    width = max([width or 0, *map(len, lists)])
    out = np.zeros((len(lists), width), np.int64)
    for row, x in zip(out, lists, strict=True):
        row[: len(x)] = x
    return out


def products(a: np.ndarray, b: np.ndarray, longest: float) -> np.ndarray:
    """Exact integer products of all rows of a with all rows of b; longest: a bound of the product of their lengths."""
    if longest < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


@dataclass
class Found:
    """Places of queries, places of items and scores; and how many candidates each way of pruning kept, of how many."""

    query: np.ndarray
    item: np.ndarray
    score: np.ndarray
    kept: dict[str, int]
    asked: dict[str, int]


def search(
    queries: np.ndarray, query_rows: np.ndarray, floors: np.ndarray, items: np.ndarray, item_ids: np.ndarray, item_rows: np.ndarray,
    k: int
) -> Found:
    """Each query's k best items of one bucket whose score reaches its floor, its own row left out."""
    width = max(queries.shape[1], items.shape[1])
    queries, items = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, items))
    order = np.lexsort((item_rows, item_ids, -np.linalg.norm(items.astype(float), axis=1)))
    items, ids, rows = items[order], item_ids[order], item_rows[order]
    lengths, sizes = np.linalg.norm(items.astype(float), axis=1), np.linalg.norm(queries.astype(float), axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        needed = np.where(
            sizes > 0, floors / sizes, np.where(floors <= 0, -np.inf, np.inf)
        )  # length that a candidate must have along the query
        cosine = np.where(lengths[0] > 0, needed / lengths[0], np.where(needed <= 0, -np.inf, np.inf))
    directions = items / np.maximum(lengths, 1e-300)[:, None]
    slack, m = 1e-9, len(items)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    kept, asked = {"coordinates": 0, "length": 0, "skipped": 0}, {"coordinates": 0, "length": 0, "skipped": 0}

    def best(q: np.ndarray, places: np.ndarray) -> None:
        scores = products(queries[q], items[places], float(sizes[q].max() * lengths[0]))
        for i, s in zip(q, scores, strict=True):
            ok = np.flatnonzero((s >= floors[i]) & (rows[places] != query_rows[i]))
            if len(ok) > k:
                cut = np.partition(s[ok], len(ok) - k)[len(ok) - k]
                ok = ok[s[ok] >= cut]
                ok = ok[np.lexsort((ids[places[ok]], -s[ok]))[:k]]
            out.append((np.full(len(ok), i), places[ok], s[ok]))

    def reach(units: np.ndarray, focus: np.ndarray, near: np.ndarray) -> np.ndarray:
        """By Cauchy-Schwarz: the most that candidates' cosine can be, from the focus coordinates of both (queries x candidates)."""
        own = np.take_along_axis(units, focus, 1)
        rest = np.sqrt(np.maximum(0, 1 - (own**2).sum(1)))
        seen = near[:, focus].transpose(1, 0, 2)  # queries x candidates x focus
        return np.einsum("qcf,qf->qc", seen, own) + rest[:, None] * np.sqrt(np.maximum(0, 1 - (seen**2).sum(2)))

    long_enough = np.where(needed > 0, np.searchsorted(-lengths, -np.where(needed > 0, needed, 0) * (1 - slack), side="right"), m)
    open_ = np.flatnonzero((cosine <= 1 + slack) & (long_enough > 0))
    asked["skipped"] = (len(queries) - len(open_)) * m
    units = queries / np.maximum(sizes, 1e-300)[:, None]
    focus = np.argsort(-np.abs(units), axis=1, kind="stable")[:, : min(FOCUS, width)]
    probe = directions[np.linspace(0, m - 1, min(PROBED, m)).astype(int)]
    steep = np.zeros(len(queries), bool)
    for part in np.array_split(open_, max(1, -(-len(open_) // 4096))):
        if len(part) and width > FOCUS:
            share = (reach(units[part], focus[part], probe) >= cosine[part, None] - slack).mean(1)
            steep[part] = (cosine[part] > 0) & (FOCUS / width + ALONE * share < 1)
    for i in open_[steep[open_]]:  # coordinate pruning, of the candidates that are long enough
        places = np.arange(long_enough[i])
        places = places[
            reach(units[i : i + 1], focus[i : i + 1], directions[places])[0] * lengths[places] >= needed[i] * (1 - slack) - slack
        ]
        asked["coordinates"] += m
        kept["coordinates"] += len(places)
        if len(places):
            best(np.array([i]), places)
    flat = open_[~steep[open_]]
    flat = flat[np.argsort(-long_enough[flat], kind="stable")]
    for part in np.array_split(flat, max(1, -(-len(flat) // 256))):  # length pruning: a prefix of the bucket
        if len(part):
            places = np.arange(long_enough[part].max())
            asked["length"] += m * len(part)
            kept["length"] += len(places) * len(part)
            best(part, places)
    q, p, s = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*out, strict=True) if out else [[], [], []]))
    return Found(q, order[p], s, kept, asked)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, bucket: int = BUCKET, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for every vector that is_query holds for, the k candidates of the highest inner product."""
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = rows.where(is_query)
    total, n_queries = rows.count(), queries.count()
    blocks = max(1, -(-n_queries // block))
    schema = "query_row long, query_id long, row long, vec_id long, score long"
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # floors: the k-th score among the longest vectors
    seeds = rows.orderBy(F.desc("norm"), "row").limit(SEEDS).select("row", "v").collect()
    held = share(spark, (matrix([r["v"] for r in seeds]), np.array([r["row"] for r in seeds])))

    def floor(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, own = held.value
        longest = float(np.linalg.norm(items.astype(float), axis=1).max(initial=0))
        for frame in frames:
            q = matrix(frame["v"], items.shape[1])
            scores = products(
                q, np.pad(items, ((0, 0), (0, q.shape[1] - items.shape[1]))),
                longest * float(np.linalg.norm(q.astype(float), axis=1).max(initial=0))
            ).astype(np.float64)
            scores[frame["row"].to_numpy()[:, None] == own] = -np.inf
            low = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(frame), -np.inf)
            yield frame.assign(least=low)

    # length ranges of about equal numbers, each dealt to buckets of bounded size by a hash
    ranges = min(64, max(1, -(-total // bucket)))
    cuts = sorted(
        set(rows.agg(F.percentile_approx("norm", [i / ranges for i in range(1, ranges)], 10_000).alias("c")).first()["c"])
    ) if ranges > 1 else []
    placed = rows.withColumn(
        "range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("norm"))) if cuts else F.lit(0)
    )
    facts = sorted(
        (
            (r["range"], -(-r["n"] // bucket), r["longest"])
            for r in placed.groupBy("range").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()
        ),
        reverse=True
    )
    salts = F.create_map(*(F.lit(x) for r, n, _ in facts for x in (r, n)))
    items = placed.withColumn("salt", F.pmod(F.xxhash64("row"), salts[F.col("range")]).cast("int"))
    asked = queries.mapInPandas(
        floor, "vec_id long, v array<long>, norm double, row long, least double"
    ).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    keys = ["block", "range", "salt"]

    def verify(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({x.split()[0]: [] for x in schema.split(", ")}, dtype="int64")
        own, own_ids, there, ids = (f[x].to_numpy() for f, x in ((q, "row"), (q, "vec_id"), (c, "row"), (c, "vec_id")))
        f = search(matrix(q["v"]), own, q["least"].to_numpy(), matrix(c["v"]), ids, there, k)
        return pd.DataFrame(
            {"query_row": own[f.query], "query_id": own_ids[f.query], "row": there[f.item], "vec_id": ids[f.item], "score": f.score}
        )

    def best(hits: DataFrame) -> DataFrame:
        ranked = hits.withColumn(
            "rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
        )
        return ranked.where(F.col("rank") <= k)

    hits, done, step = None, 0, 1
    while done < len(facts):  # rounds of 1, 2, 4, ... ranges
        mine, done, step = facts[done : done + step], done + step, 2 * step
        told = F.array(*(F.struct(F.lit(r).alias("range"), F.lit(n).alias("salts"), F.lit(x).alias("longest")) for r, n, x in mine))
        # a range whose longest vector can't reach the floor is not asked
        some = asked.withColumn(
            "r", F.explode(F.filter(told, lambda r: r["longest"] * F.col("norm") * (1 + 1e-9) >= F.col("least")))
        )
        some = some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("r.salts") - 1))).select(
            "vec_id", "row", "v", "least", "block", F.col("r.range").alias("range"), "salt"
        )
        theirs = items.where(F.col("range").isin([r for r, _, _ in mine])).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        )
        new = some.groupBy(keys).cogroup(theirs.select("vec_id", "row", "v", *keys).groupBy(keys)).applyInPandas(verify, schema)
        hits = best(new if hits is None else hits.drop("rank").unionByName(new))
        if done < len(facts):
            hits = materialize(hits, "hits")
            raised = hits.where(F.col("rank") == k).select(
                F.col("query_row").alias("row"), F.col("score").cast("double").alias("raised")
            )
            asked = materialize(
                asked.join(small(raised), "row", "left").withColumn(
                    "least", F.greatest("least", F.coalesce("raised", F.col("least")))
                ).drop("raised"),
                "asked"
            )
    return hits.select("query_id", "rank", "vec_id", "score")
