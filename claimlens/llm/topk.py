"""Exact top-k inner products from an impact-ordered index, one score level at a time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 32_768
QUERY_ROWS = 256
# Shares of the postings, by descending impact, after which the levels but the last end.
LEVELS = (0.25, 0.55)


class Index:
    """Posting segments of one shard by descending quantised impact.

    A posting is a component of a row, its impact the absolute value.  A level holds the segments
    of a range of impacts, for all components, and knows for each row the length of what no
    level up to it has held.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        # equal scores go to the smaller id, so rows stand in id order
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        impact = np.abs(self.vectors)
        ranked = np.sort(impact, axis=None)[::-1]
        edges = [int(ranked[int(len(ranked) * share)]) for share in LEVELS] if len(ranked) else []
        self.size = float(np.sqrt((impact.astype(float) ** 2).sum(axis=1)).max(initial=0))
        self.levels = []
        high = None
        for low in [*dict.fromkeys(edges), -1]:
            inside = impact > low if high is None else (impact > low) & (impact <= high)
            rest = np.where(impact > low, 0, impact).astype(float)
            self.levels.append((np.where(inside, self.vectors, 0), np.sqrt((rest ** 2).sum(axis=1))))
            high = low
        self.typed: dict = {}

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and scores of the k best rows of each query other than its own id.

        After a level a row's score is what was added, give or take the length of the query times
        the length of what the row has left.  A query is done when few rows can still reach the
        k-th sure score; those are scored exactly.  The last level leaves nothing open.
        """
        n = len(self.ids)
        lengths = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        most = self.size * lengths.max(initial=0)
        kind = np.float32 if most < 1 << 23 else np.float64
        if most >= 1 << 52:
            raise OverflowError("scores of 2 ** 52 and more are not exact")
        if kind not in self.typed:
            self.typed[kind] = [(x.T.astype(kind), rest.astype(kind)) for x, rest in self.levels]
        out: list = [None] * len(queries)
        wide, lengths = queries.astype(kind), lengths.astype(kind)
        open_ = np.arange(len(queries))
        sums = np.zeros((len(queries), n), kind)
        for at, (level, rest) in enumerate(self.typed[kind]):
            sums += wide[open_] @ level
            left = []
            for row, i in enumerate(open_.tolist()):
                slack = rest * (lengths[i] * kind(1.00001)) + kind(at < len(self.levels) - 1)
                good = self.ids != own[i]
                count = min(k, int(good.sum()))
                if not count:
                    out[i] = np.zeros(0, np.int64), np.zeros(0, np.int64)
                    continue
                sure = np.where(good, sums[row] - slack, -np.inf)
                bound = np.partition(sure, -count)[-count]
                may = np.flatnonzero(good & (sums[row] + slack >= bound))
                if len(may) <= max(8 * k, n // 64) or at == len(self.levels) - 1:
                    out[i] = self.best(may, queries[i], count)
                else:
                    left.append(row)
            open_, sums = open_[left], sums[left]
            if not left:
                break
        return out

    def best(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self.vectors[rows] @ query
        if len(rows) > k:
            bound = np.partition(scores, -k)[-k]
            sure = np.flatnonzero(scores > bound)
            chosen = np.concatenate((sure, np.flatnonzero(scores == bound)[:k - len(sure)]))
            rows, scores = rows[chosen], scores[chosen]
        return rows, scores


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) per component; null if the vector or a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(wide, lambda x: F.floor(scale * x)))


def top_k(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id",
          vector: str = "embedding", scale: int = 64, shard_rows: int = SHARD_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k rows of highest integer inner product for each row that ``queries`` selects.

    Columns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the smaller id, all
    rows if there are fewer than k.  Rows without id, or whose vector is null or holds null
    or non-finite components, take no part.  Shorter vectors count as padded with zeros; an empty
    one scores 0 everywhere.  Repeated rows of one id are candidates and queries each, but
    never for their own id.  Components are taken to fit 31 bits after scaling.

    The set of queries meets all rows in blocks: a group is one shard of the index and one
    block of queries, both of bounded expected size by a hash of the id, so no group grows with
    the data.  A shard gives k rows a query; these are merged by a window of shards x k rows.
    """
    rows = vectors.select(F.col(vec_id).alias("id"), quantised(F.col(vector), scale).alias("v"),
                          F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    total = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    shards, blocks = math.ceil(total.n / shard_rows) or 1, math.ceil(total.q / query_rows) or 1
    indexed = rows.select(F.lit(False).alias("asks"), "id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("shard"),
                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = rows.where("asks").select("asks", "id", "v", F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, group["v"]))
        table = np.zeros((len(group), width), np.int64)
        for i, v in enumerate(group["v"]):
            table[i, :len(v)] = v
        ask = group["asks"].to_numpy(bool)
        ids = group["id"].to_numpy()
        out = {"query_id": [], "vec_id": [], "score": [], "copy": []}
        if ask.any() and not ask.all():
            index = Index(ids[~ask], table[~ask])
            seen: dict = {}
            found = index.search(table[ask], ids[ask], k)
            for own, (at, scores) in zip(ids[ask], found, strict=True):
                seen[own] = copy = seen.get(own, -1) + 1
                out["query_id"].append(np.full(len(at), own))
                out["vec_id"].append(index.ids[at])
                out["score"].append(scores)
                out["copy"].append(np.full(len(at), copy))
        return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in out.items()})

    kind = rows.schema["id"].dataType.simpleString()
    found = asked.unionByName(indexed).groupBy("shard", "block").applyInPandas(
        search, f"query_id {kind}, vec_id {kind}, score long, copy long")
    order = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("vec_id").alias("vec_id"), "score")
