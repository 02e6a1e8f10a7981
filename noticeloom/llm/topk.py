"""Exact top-k inner products by norm-bucketed retrieval (after LEMP, Teflioudi and Gemulla, 2015).

Vectors are grouped by length into buckets, an eighth of a power of two each; a bucket is dealt into cells of a bounded
size.  Every query first meets one cell of the longest vectors, which gives a lower bound ``theta`` of its k-th score.  A bucket
whose longest vector cannot reach it (``|q| * longest < theta``, a local cosine threshold above 1) never sees the query.
In the cells that are left the local threshold ``theta / (|q| * length)`` chooses: a high one prunes by coordinates (in the
query's focus coordinates, a unit vector with that cosine must lie in a small interval), a low one by length only.
Products of what remains are verified in integers, so results are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.durable import durable

#: Vectors of a cell and queries of a block at most, in the mean of their hashes.
CELL, QUERY_BLOCK = 8192, 2048
COSINE_FOR_COORDINATES, FOCUS = 0.9, 3
_LONG = (1 - 2**63, 2**63 - 1)


def integer_vectors(df: DataFrame, ask: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, asks, v array<double>, dim, norm)``: ``floor(scale * x)``, which doubles hold exactly.

    Vectors that are null or hold null or non-finite components go, and so do rows with a null id.
    """
    x = F.col(vector_col).cast("array<double>")
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def whole(c: Column) -> Column:  # from 2**53 on a double is whole
        big = F.greatest(F.least(c * scale, F.lit(1.7e308)), F.lit(-1.7e308))
        return F.when(F.abs(big) < 2.0**53, F.floor(F.when(F.abs(big) < 2.0**53, big).otherwise(0.0)).cast("double")).otherwise(big)

    vectors = df.where(fine).select(F.col(id_col).alias("id"), F.coalesce(ask, F.lit(False)).alias("asks"), F.transform(x, whole).alias("v"))
    norm = F.least(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)), F.lit(1e308))
    return vectors.withColumn("dim", F.size("v")).withColumn("norm", norm)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held at the ends of the range of 64 bits."""
    bound = np.abs(q).max(axis=1, initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1])
    if (bound < 2**52).all():
        return np.rint(q @ c.T).astype(np.int64)
    out = np.empty((len(q), len(c)), np.int64)
    small, long = bound < 2**52, (bound >= 2**52) & (bound < 2**62)
    out[small] = np.rint(q[small] @ c.T)
    out[long] = q[long].astype(np.int64) @ c.astype(np.int64).T if long.any() else 0
    for i in np.flatnonzero(bound >= 2**62):
        own = [int(x) for x in q[i]]
        out[i] = [min(max(sum(x * int(y) for x, y in zip(own, row, strict=True)), _LONG[0]), _LONG[1]) for row in c.tolist()]
    return out


def _best(row: np.ndarray, at: np.ndarray, score: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of each row; ties to the smaller id."""
    order = np.lexsort((c_ids[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
    nth = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return row[nth < k], at[nth < k], score[nth < k]


def search_bucket(q_rows: np.ndarray, q: np.ndarray, theta: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` candidates of each query in one cell that may reach its ``theta``: query, candidate, score.

    ``q_rows`` and ``c_rows`` number the rows of the table: a row is no candidate of its own.
    """
    with np.errstate(over="ignore"):
        length, q_length = np.sqrt((c**2).sum(1)), np.sqrt((q**2).sum(1))
    order = np.lexsort((c_ids, -length))
    c, c_ids, c_rows, length = c[order], c_ids[order], c_rows[order], length[order]
    prunes = bool(len(c)) and np.isfinite(length[0]) and bool(np.isfinite(q_length).all())
    unit = c / np.maximum(length, 1e-12)[:, None] if prunes else c
    theta = theta.astype(float)
    row, at, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    for first in range(0, len(c), 1024):
        part = np.arange(first, min(first + 1024, len(c)))
        cosine = np.full(len(q), -1.0)
        if prunes:
            some = (theta > 0) & (q_length > 0)
            cosine[some] = theta[some] / (q_length[some] * max(length[first], 1e-12)) - 1e-9
        floor = theta - 1e-6 * np.abs(np.where(np.isfinite(theta), theta, 0))
        rows, cols, scores = [row], [at], [score]
        by_length = np.flatnonzero(cosine <= COSINE_FOR_COORDINATES)
        for some in np.array_split(by_length, max(1, -(-len(by_length) // 256))):
            s = _products(q[some], c[part])
            own = q_rows[some][:, None] == c_rows[part][None, :]
            keep = s >= floor[some][:, None]
            keep &= ~own
            if len(part) > 4 * k:  # what is below the part's own k-th score cannot count
                cut = np.partition(np.where(own, _LONG[0], s), len(part) - k, axis=1)[:, len(part) - k]
                keep &= s >= cut[:, None]
            i, j = np.nonzero(keep)
            rows.append(some[i])
            cols.append(part[j])
            scores.append(s[i, j])
        for i in np.flatnonzero((cosine > COSINE_FOR_COORDINATES) & (cosine <= 1)):
            u, left = q[i] / q_length[i], part
            for f in np.argsort(-np.abs(u))[:FOCUS]:
                slack = np.sqrt(max(0.0, (1 - cosine[i] ** 2) * (1 - u[f] ** 2))) + 1e-9
                low = -1.0 if -u[f] >= cosine[i] else u[f] * cosine[i] - slack
                high = 1.0 if u[f] >= cosine[i] else u[f] * cosine[i] + slack
                w = unit[left, f]
                left = left[(w >= low - 1e-9) & (w <= high + 1e-9)]
            left = left[c_rows[left] != q_rows[i]]
            rows.append(np.full(len(left), i))
            cols.append(left)
            scores.append(_products(q[i : i + 1], c[left])[0])
        row, at, score = _best(np.concatenate(rows), np.concatenate(cols), np.concatenate(scores), c_ids, k)
        n = np.bincount(row, minlength=len(q))
        last = np.cumsum(n) - 1
        full = n >= k
        theta[full] = np.maximum(theta[full], score[last[full]].astype(float))
    return row, order[at], score


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), dim)


def _blocked(queries: DataFrame, needs: Column) -> DataFrame:
    """Adds ``block``: queries that need candidates of about the same length, up to QUERY_BLOCK of them in the mean."""
    leveled = durable(queries.withColumn("needs", needs))
    counts = leveled.groupBy("dim", "needs").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    block = F.concat_ws("/", "needs", F.pmod(F.xxhash64("row"), "blocks"))
    return leveled.join(counts, ["dim", "needs"]).withColumn("block", block).drop("needs", "blocks")


def wanted_cells(dealt: DataFrame, asked: DataFrame) -> DataFrame:
    """A copy of each candidate for every block of queries that its cell is asked by; a cell that none asks for is not copied or shuffled."""
    wanted = durable(asked.groupBy("dim", "bucket", "part").agg(F.collect_set("block").alias("blocks")))
    return dealt.join(wanted, ["dim", "bucket", "part"]).select("dim", "bucket", "part", F.explode("blocks").alias("block"), "row", "id", "v")


def _search(dealt: DataFrame, asked: DataFrame, k: int, id_type: str) -> DataFrame:
    """``(q_row, query_id, vec_id, score)`` of every cell and the queries dealt to it."""
    keys = ["dim", "bucket", "part", "block"]
    cells = wanted_cells(dealt, asked)

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        names = ["q_row", "query_id", "vec_id", "score"]
        if not len(c) or not len(q):
            return pa.table([pa.array([], pa.int64()), q.column("id").slice(0, 0), q.column("id").slice(0, 0), pa.array([], pa.int64())], names)
        dim = c.column("dim")[0].as_py()
        c_ids = c.column("id").to_numpy()
        row, at, score = search_bucket(q.column("row").to_numpy(), _matrix(q, dim), q.column("theta").to_numpy(), c.column("row").to_numpy(), c_ids, _matrix(c, dim), k)
        return pa.table([q.column("row").take(pa.array(row)), q.column("id").take(pa.array(row)), c.column("id").take(pa.array(at)), pa.array(score)], names)

    asked = asked.select(*(F.col(c).alias(c) for c in asked.columns))  # both sides come from one table
    return cells.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, f"q_row long, query_id {id_type}, vec_id {id_type}, score long")


def top_products(df: DataFrame, ask: Column, k: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for the rows where ``ask`` holds, the ``k`` greatest integer products with other rows.

    All candidates if there are fewer.  Only vectors of equal size meet.  Every row counts: rows that repeat, or repeat an id, are
    queries each and candidates each, but a row is no candidate of its own.  Ties go to the smaller id.  Scores beyond 64 bits
    are held at the ends of that range.  Other columns are ignored; an empty table gives no rows.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    level = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * 8)).otherwise(-100_000).cast("int")
    vectors = integer_vectors(df, ask, id_col, vector_col, scale).withColumn("bucket", level)
    vectors = durable(vectors.withColumn("row", F.monotonically_increasing_id()))  # fixes the numbers of the rows
    sizes = durable(vectors.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).withColumn("parts", F.ceil(F.col("n") / CELL).cast("int")))
    dealt = vectors.join(sizes.select("dim", "bucket", "parts"), ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int")).select("dim", "bucket", "part", "row", "id", "v")
    queries = vectors.where("asks").select("dim", "row", "id", "v", "norm")

    seed = sizes.groupBy("dim").agg(F.max(F.struct((F.col("n") > 4 * k).alias("enough"), "bucket")).alias("s")).select("dim", F.col("s.bucket").alias("bucket"))
    asked = _blocked(queries.withColumn("theta", F.lit(float("-inf"))), F.lit(0)).join(seed, "dim").withColumn("part", F.lit(0))
    found = _search(dealt, asked, k, id_type)
    theta = durable(found.groupBy("q_row").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("theta")))

    asked = queries.join(theta.withColumnRenamed("q_row", "row"), "row", "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))))
    needs = F.when((F.col("theta") > 0) & (F.col("norm") > 0), F.floor(F.log2(F.col("theta") / F.col("norm")) * 8)).otherwise(-100_000)
    asked = _blocked(asked, needs.cast("int")).join(sizes, "dim")
    reaches = (F.col("theta") <= 0) | (F.col("norm") * F.col("longest") * (1 + 1e-9) >= F.col("theta"))
    asked = asked.where(reaches).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    got = _search(dealt, asked, k, id_type)
    rank = F.row_number().over(W.partitionBy("q_row").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
