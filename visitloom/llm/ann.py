"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the ordered list of its nearest pivots, a short prefix of all pivots.
The index is written once: blocks of vectors, each with its pivot inverted files, one list for each
pivot, holding the vectors that have it in their prefix and its place there. A query walks the lists
of its own prefix alone and sums up Spearman's footrule with the vectors met; the block's best by
footrule are reranked by the exact distance, and the best of all blocks are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitloom.llm.common import materialize, only

#: A vector stands in PREFIX of PIVOTS lists, an eighth; FRACTION of a block's distinct vectors, LEAST at least, are reranked.
PIVOTS, PREFIX, FRACTION, LEAST = 512, 64, 0.2, 200
#: Vectors of an index block, and queries broadcast at once: with 64 components and their pivot lists about 25 MB.
BLOCK, QUERY_BLOCK = 4096, 32_768


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) for the vectors that take part: not null, not zero, every component a finite number."""
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter("vec_id IS NOT NULL AND vec IS NOT NULL")
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.filter(sound & F.exists("vec", lambda x: x != 0))


def pivot_lists(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of the ``prefix`` nearest pivots of each row, nearest first, ties to the smaller number."""
    d = (pivots**2).sum(1)[None, :] - 2.0 * (x @ pivots.T)
    if prefix >= len(pivots):
        return np.argsort(d, axis=1, kind="stable")
    near = np.sort(np.argpartition(d, prefix, axis=1)[:, :prefix], axis=1)
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)


def inverted_files(lists: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that have each pivot in their list, what its place is worth (the list's length minus the place), and where each pivot's rows begin."""
    k = lists.shape[1]
    flat = lists.ravel()
    order = np.argsort(flat, kind="stable")
    return (order // k).astype(np.int32), (k - order % k).astype(np.int32), np.searchsorted(flat[order], np.arange(pivots + 1)).astype(np.int32)


def footrule_scores(files: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, queries: np.ndarray) -> np.ndarray:
    """Footrule closeness (queries, vectors) through inverted files.

    With lists of k places and absent pivots at place k, the footrule is k(k+1) minus twice the sum
    over common pivots of min(k - a, k - b); the sum is what is returned, so larger is nearer.
    """
    member, weight, bounds = files
    q_member, q_weight, q_bounds = inverted_files(queries, len(bounds) - 1)
    score = np.zeros((len(queries), n), np.int32)
    for p in range(len(bounds) - 1):
        a, b = slice(q_bounds[p], q_bounds[p + 1]), slice(bounds[p], bounds[p + 1])
        if a.start < a.stop and b.start < b.stop:
            score[np.ix_(q_member[a], member[b])] += np.minimum(q_weight[a][:, None], weight[b][None, :])
    return score


INDEX = "ids binary, vectors binary, heads binary, members binary, begins binary, posted binary, worth binary, bounds binary"


def _post(pivots: np.ndarray, prefix: int, block: int):
    """Vectors -> index blocks. Equal vectors of a block are posted once, at their smallest id."""

    def coded(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        _, first, inverse = np.unique(x, axis=0, return_index=True, return_inverse=True)
        heads = np.sort(first)  # distinct vectors by their smallest id
        number = np.empty(len(first), np.int64)
        number[np.argsort(first, kind="stable")] = np.arange(len(first))
        group = number[inverse.reshape(-1)]
        members = np.argsort(group, kind="stable")
        begins = np.searchsorted(group[members], np.arange(len(heads) + 1))
        files = inverted_files(pivot_lists(x[heads], pivots, prefix), len(pivots))
        cells = [ids.astype(np.int64), x, *(v.astype(np.int32) for v in (heads, members, begins, *files))]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], names=[c.split()[0] for c in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([b.column(0).to_numpy() for b in held])
            x = np.concatenate([b.column(1).flatten().to_numpy().reshape(b.num_rows, -1) for b in held])
            held.clear()
            return coded(ids, x)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, block - rows))
                at += held[-1].num_rows
                rows += held[-1].num_rows
                if rows == block:
                    yield flush()
                    rows = 0
        if held:
            yield flush()

    return run


def _search(pivots: np.ndarray, prefix: int, q_ids: np.ndarray, q_vecs: np.ndarray, k: int, fraction: float, least: int):
    q_lists = pivot_lists(q_vecs, pivots, prefix)

    def others(units: np.ndarray, ids: np.ndarray, members: np.ndarray, begins: np.ndarray, own: int) -> np.ndarray:
        """Of each distinct vector the k rows with the smallest ids, without the query's."""
        out = []
        for u in units:
            rows = members[begins[u] : begins[u + 1]]
            some = rows[: k + 1]
            if (ids[some] == own).any():
                some = rows[ids[rows] != own]
            out.append(some[:k])
        return np.concatenate(out)

    def answer(cells: list[bytes], best: list[tuple[np.ndarray, np.ndarray]]) -> None:
        ids, x = np.frombuffer(cells[0], np.int64), np.frombuffer(cells[1], np.float64).reshape(-1, q_vecs.shape[1])
        heads, members, begins, *files = (np.frombuffer(c, np.int32) for c in cells[2:])
        same, n = x[heads], len(heads)
        c = min(n, max(least, int(np.ceil(fraction * n))))
        for lo in range(0, len(q_ids), 256):
            score = footrule_scores(tuple(files), n, q_lists[lo : lo + 256])
            key = score.astype(np.int64) * n + (n - 1 - np.arange(n))  # ties to the smaller id
            top = np.argpartition(-key, c - 1, axis=1)[:, :c] if c < n else np.broadcast_to(np.arange(n), score.shape)
            for i in range(len(score)):
                cand = top[i]
                d = np.sqrt(((same[cand] - q_vecs[lo + i]) ** 2).sum(1))
                near = cand[d <= np.partition(d, k)[k]] if len(cand) > k else cand
                got = others(near, ids, members, begins, q_ids[lo + i])
                if len(got) < k and len(near) < len(cand):  # the query's id has several vectors
                    got = others(cand, ids, members, begins, q_ids[lo + i])
                dist = np.sqrt(((x[got] - q_vecs[lo + i]) ** 2).sum(1))
                all_d, all_i = np.append(best[lo + i][0], dist), np.append(best[lo + i][1], ids[got])
                pick = np.lexsort((all_i, all_d))[:k]
                best[lo + i] = (all_d[pick], all_i[pick])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0), np.empty(0, np.int64))] * len(q_ids)
        for batch in batches:
            for i in range(batch.num_rows):
                answer([column[i].as_buffer() for column in batch.columns], best)
        n = np.array([len(b[0]) for b in best])
        if n.sum():
            yield pa.RecordBatch.from_pydict({"query_id": np.repeat(q_ids, n), "vec_id": np.concatenate([b[1] for b in best]), "score": np.concatenate([b[0] for b in best])})

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
    pivots: int = PIVOTS, prefix: int = PREFIX, fraction: float = FRACTION, least: int = LEAST, query_block: int = QUERY_BLOCK, block: int = BLOCK,
) -> DataFrame:
    """The ``k`` nearest vectors found for each query: query_id, rank (from 1), vec_id, score (Euclidean distance in double precision).

    Pivots are ``pivots`` distinct vectors with the smallest hash of their id: a bounded sample, and
    all that is fitted. Every vector is posted. In each block ``fraction`` of the distinct vectors,
    at least ``least``, are reranked exactly; equal vectors count once there, so copies do not crowd
    out others. A query's own row is no candidate; ties go to the smaller id. Vectors that are null,
    zero or hold null or non-finite components take no part; those of different lengths are searched
    length by length, as no distance is defined between them. Every row is a candidate, also where rows share an id; a repeated
    query id asks with the smallest of its vectors, and none of its rows is a candidate for it. Queries
    beyond ``query_block`` are searched in further passes over the written index, each broadcasting
    one block of known size.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vec_col).repartition(max(1, spark.sparkContext.defaultParallelism)), "vectors")
    asked = materialize(usable(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("vec").alias("vec")), "queries")
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for dim in sorted(r[0] for r in asked.select(F.size("vec")).distinct().collect()):  # one, as a rule
        own = rows.filter(F.size("vec") == dim)
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * pivots).select("vec").collect()
        table = np.array(list(dict.fromkeys(tuple(r["vec"]) for r in sample))[:pivots], np.float64)
        if not len(table):
            continue
        short = min(prefix, len(table))
        index = materialize(own.mapInArrow(_post(table, short, block), INDEX), "permutation-index")
        same = asked.filter(F.size("vec") == dim)
        passes = max(1, -(-same.count() // query_block))
        for b in range(passes):
            part = same.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == b).orderBy("vec_id").toPandas()
            if len(part):
                ids, vecs = part["vec_id"].to_numpy(np.int64), np.stack(part["vec"].to_list()).astype(np.float64)
                found = found.union(index.mapInArrow(_search(table, short, ids, vecs, k, fraction, least), "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    rows = only(embeddings, "vec_id", "embedding")
    return nearest(rows, rows.filter("vec_id % 100 = 0"))
