"""Exact top-k inner products with an impact-ordered index, score at a time.

Vectors are integers. A block of candidates is indexed by dimension: a dimension's postings lie in order of value, cut into
segments where the value's level, one of LEVELS, changes. For a query a posting's impact is what it adds beyond the least that
its dimension can add, so impacts are never negative. Segments are processed by descending impact, and only their postings
are touched. Whatever is left can add no more than the highest impact of the next segment of each dimension. A query stops
when, by that bound, only few candidates can reach the k-th best score so far; these, and all that tie with it, are then
scored exactly. Without such a proof all segments are processed, and scores are exact.

Queries are a stated set. Blocks of queries meet blocks of candidates, and only k results of each query leave a block. Blocks
are bounded in numbers, not only in rows.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, neither as query nor as
candidate. Missing trailing components count as 0. Rows with the query's own id are no candidates. Ties go to the smaller id;
rows that repeat id and vector are ranked as rows of their own, and each row that asks gets k results of its own. Scores are
exact integers of any size in the ranking; one beyond a long is given as the nearest long. An empty table gives an empty
result. Columns other than id and vector are not read.
"""

from __future__ import annotations

from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.storage import stored

LEVELS = 8
#: Shares of a query's postings after which its bound is compared.
ROUNDS = (0.1, 0.35, 0.5, 0.65, 0.8, 0.9)
#: A query stops when at most this share of a block may still be among its best.
FEW = 0.02
#: Rows of a block at most, and numbers that its candidates and its queries hold, about.
CANDIDATES, QUERIES, NUMBERS = 8_192, 16_384, 1 << 22
#: Integers up to which 64 bits are exact.
EXACT = 1 << 62


def sound(vector: str) -> Column:
    """Whether an array column has components, none of them null, NaN or infinite."""
    whole = F.transform(vector, lambda x: x.cast("double"))
    return F.coalesce((F.size(vector) > 0) & F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value), as 64-bit integers where sums of products of two rows fit, else as Python's integers."""
    most = float(np.abs(values).max(initial=0)) * scale + 1
    if most * most * 2 * values.shape[1] < EXACT:
        return np.floor(values * scale).astype(np.int64)
    out = np.empty(values.shape, object)
    out.flat = [floor(x * scale) if abs(x) < 1 << 52 else int(x) * scale for x in values.flat]
    return out


class Index:
    """Posting segments of one block of candidates, whose vectors are the rows of an array of integers."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, dims = vectors.shape
        self.docs = np.ascontiguousarray(np.argsort(vectors, 0, kind="stable").T)
        self.values = np.take_along_axis(vectors.T, self.docs, 1)
        self.low, self.high = self.values[:, 0], self.values[:, -1]
        width = np.maximum(1, -((self.low - self.high - 1) // LEVELS))
        # a segment is what lies between two cuts; empty ones stay, with no impact
        self.cuts = np.empty((dims, LEVELS + 1), np.int64)
        for d in range(dims):
            self.cuts[d] = [*(np.searchsorted(self.values[d], self.low[d] + level * width[d]) for level in range(LEVELS)), n]
        self.size = np.diff(self.cuts)
        last = np.maximum(self.cuts[:, 1:] - 1, 0)
        self.top = np.take_along_axis(self.values, last, 1)
        self.bottom = np.take_along_axis(self.values, np.minimum(self.cuts[:, :-1], n - 1), 1)

    def search(self, queries: np.ndarray, allowed: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query, every allowed candidate that may be among its k best, ties included."""
        return [self._hopeful(q, np.flatnonzero(a), k) for q, a in zip(queries, allowed, strict=True)]

    def _hopeful(self, query: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
        if len(allowed) <= k:
            return allowed
        up = query > 0
        # impacts by dimension, highest segment first: from the top where the query is positive, else from the bottom
        gains = np.where(up[:, None], (self.top - self.low[:, None])[:, ::-1], self.high[:, None] - self.bottom) * abs(query)[:, None]
        sizes = np.where(up[:, None], self.size[:, ::-1], self.size)
        gains = np.maximum.accumulate(np.where(sizes > 0, gains, 0)[:, ::-1], 1)[:, ::-1]
        order = np.argsort(-gains, None, kind="stable")
        following = np.concatenate((gains[:, 1:], np.zeros((len(query), 1), gains.dtype)), 1)
        rest = gains[:, 0].sum() - np.cumsum((gains - following).ravel()[order])
        share = np.cumsum(sizes.ravel()[order]) / sizes.sum()
        score = np.zeros(len(self.vectors), self.vectors.dtype)
        done = np.zeros(len(query), np.int64)
        stops = [*np.searchsorted(share, ROUNDS, "right").tolist(), len(order)]
        for stop in sorted(set(stops) - {0}):
            now = np.bincount(order[:stop] // LEVELS, minlength=len(query))
            for d in np.flatnonzero((now > done) & (query != 0)):
                first, last = (LEVELS - now[d], LEVELS - done[d]) if up[d] else (done[d], now[d])
                part = slice(self.cuts[d, first], self.cuts[d, last])
                score[self.docs[d, part]] += query[d] * (self.values[d, part] - (self.low[d] if up[d] else self.high[d]))
            done = now
            own = score[allowed]
            kth = np.sort(own)[-k] if own.dtype == object else np.partition(own, -k)[-k]
            found = allowed[own + rest[stop - 1] >= kth]
            if len(found) <= max(k, FEW * len(self.vectors)):
                break
        return found


def _block(k: int, scale: int):
    """The k best of one block of candidates for each query of one block of queries."""

    def of(table: pa.Table) -> pa.Table:
        ids, rows = table.column("id").to_numpy(), table.column("row").to_numpy()
        asks = np.asarray(table.column("asks").to_pylist(), bool)
        lists = table.column("vector").combine_chunks()
        lengths = lists.value_lengths().to_numpy()
        vectors = np.zeros((len(ids), int(lengths.max())), np.float64)
        vectors[np.arange(vectors.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
        vectors = quantised(vectors, scale)
        order = np.argsort(ids, kind="stable")
        order = order[~asks[order]]
        out: list[tuple] = []
        if len(order):
            index, own = Index(vectors[order]), ids[order]
            for q in np.flatnonzero(asks).tolist():
                hopeful = index.search(vectors[q : q + 1], (own != ids[q])[None, :], k)[0]
                exact = (index.vectors[hopeful] * vectors[q]).sum(1)
                best = np.argsort(-exact, kind="stable")[:k]
                out += [(int(rows[q]), int(ids[q]), int(own[hopeful[b]]), str(exact[b])) for b in best]
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["row", "query_id", "vec_id", "exact"])

    return of


def top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows for each row where `queries` holds."""
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.transform(vector_col, lambda x: x.cast("double")).alias("vector"), sound(vector_col).alias("sound"))
    whole = stored(whole.where("sound and id is not null").withColumn("row", F.monotonically_increasing_id()).drop("sound"))
    known = whole.agg(F.count("*").alias("rows"), F.count_if("asks").alias("asks"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("dims")).first()
    blocks = lambda rows, most: max(1, -(-rows // max(1, min(most, NUMBERS // known["dims"]))))
    parts, asked = blocks(known["rows"], CANDIDATES), blocks(known["asks"], QUERIES)
    part, ask = F.pmod(F.xxhash64("row"), F.lit(parts)), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(asked))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    rows = whole.select("row", "id", F.lit(False).alias("asks"), "vector", part.alias("part"), spread(asked).alias("ask"))
    rows = rows.unionByName(whole.where("asks").select("row", "id", F.lit(True).alias("asks"), "vector", spread(parts).alias("part"), ask.alias("ask")))
    found = rows.groupBy("part", "ask").applyInArrow(_block(k, scale), "row long, query_id long, vec_id long, exact string")
    # sign, digits, then the digits themselves: an order of integers of any size
    size = F.length("exact")
    down = F.col("exact").startswith("-")
    order = Window.partitionBy("row").orderBy(down, F.when(down, size).otherwise(-size), F.when(down, F.col("exact")), F.desc("exact"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    nearest = F.coalesce(F.expr("try_cast(exact as bigint)"), F.when(down, F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1)))
    return best.select("query_id", "rank", "vec_id", nearest.alias("score"))
