"""Runs of periodic text: stretches of words that repeat with one period, found by a dictionary of basic factors.

For every power of two m = 2**k the dictionary names all factors of m words of a document, so that two
factors are equal exactly when their names are: names of m words come from sorting the pairs of names
of m / 2 words. Positions whose factor stands once in its document drop out, as no longer factor can
repeat there. A factor's successor is its next occurrence. Successors within 2 * m words that follow one
another at one distance d form arithmetic progressions, and each proposes the period d where it stands.
In a run of smallest period q and at least three periods, a factor of m >= q words recurs after exactly
q words, so every such run is proposed at the first m >= q, and no period of three or more repeats that
is proposed is a multiple of a smaller one. Proposals are extended to both sides by the names, from long factors to
short, and those that meet in one run become one.

Texts are read whole, each in one task, and no row moves: the job is one scan. Documents are taken
together in blocks of about ``BLOCK`` bytes; a longer document is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm.common import as_text, only

#: Bytes of text whose factors are named together.
BLOCK = 2_000_000
#: What separates words.
BLANKS = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _named(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose key is not the only one of its kind, by name and position; their names; words to the next position of that name (0: none)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    name = np.cumsum(np.append(False, key[1:] != key[:-1])) if len(key) else key
    again = np.bincount(name)[name] > 1 if len(key) else np.empty(0, bool)
    at, name = at[order[again]], name[again]
    gap = np.zeros(len(at), np.int64)
    if len(at):
        gap[:-1] = np.where(name[1:] == name[:-1], at[1:] - at[:-1], 0)
    return at, name, gap


def _proposals(at: np.ndarray, gap: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first position, last position, distance) of the progressions: neighbouring positions whose successors are equally far away."""
    near = (gap > 0) & (gap <= within)
    at, gap = at[near], gap[near]
    order = np.argsort(at)
    at, gap = at[order], gap[order]
    first = np.append(True, (at[1:] != at[:-1] + 1) | (gap[1:] != gap[:-1])) if len(at) else np.empty(0, bool)
    begins = np.flatnonzero(first)
    return at[begins], at[np.append(begins[1:], len(at)) - 1] if len(at) else at, gap[begins]


def periodic_runs(codes: np.ndarray, ends: np.ndarray, least: int = 24, repeats: int = 3) -> np.ndarray:
    """All runs as rows (start, length, period) by start, then period.

    ``codes`` are the words of several documents one after the other, ``ends`` each document's end
    there. A run has the smallest period q, at least max(least, repeats * q) words, and no neighbour
    that extends it; it lies in one document. ``repeats`` is three or more.
    """
    if repeats < 3:
        raise ValueError("below three repeats the factors of a run need not follow one another at its period")
    n = len(codes)
    if not n:
        return np.empty((0, 3), np.int64)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    end = ends[owner]
    names, found, m = [], [], 1
    at, name, gap = _named(np.arange(n), owner * (int(codes.max()) + 1) + codes)
    while len(at):
        table = -1 - np.arange(n, dtype=np.int64)  # a factor that stands once is like no other
        table[at] = name
        names.append(table.astype(np.int32))
        if 6 * m > least:  # a run of ``least`` words shows its shorter periods at these factors too
            found.append((_proposals(at, gap, 2 * m), m))
        at = np.sort(at)
        at = at[at + 2 * m <= end[at]]
        at = at[table[at + m] >= 0]
        at, name, gap = _named(at, table[at] * (int(name.max()) + 1) + table[at + m])
        m *= 2
    if not found:
        return np.empty((0, 3), np.int64)
    left = np.concatenate([p[0] for p, _ in found]) - 1
    right = np.concatenate([p[1] + m for p, m in found])
    period = np.concatenate([p[2] for p, _ in found])
    for k in range(len(names) - 1, -1, -1):
        table, m = names[k], 1 << k
        more = np.flatnonzero(right + period + m <= n)
        more = more[table[right[more]] == table[right[more] + period[more]]]
        right[more] += m
        more = np.flatnonzero(left - m + 1 >= 0)
        more = more[table[left[more] - m + 1] == table[left[more] - m + 1 + period[more]]]
        left[more] -= m
    length = right + period - left - 1
    keep = length >= np.maximum(least, repeats * period)
    return np.unique(np.stack([left[keep] + 1, length[keep], period[keep]], 1), axis=0)  # of one start the longer run has the longer period


def _blocks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about BLOCK bytes."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, s in enumerate(size.tolist()):
        if total and total + s > BLOCK:
            yield begin, i
            begin, total = i, 0
        total += s
    if begin < len(size):
        yield begin, len(size)


def _find(least: int, repeats: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _blocks(batch.column(1)):
                yield collapsed(batch.slice(a, b - a), least, repeats)

    return run


def collapsed(batch: pa.RecordBatch, least: int, repeats: int) -> pa.RecordBatch:
    """(doc_id, n_words, runs, collapsed) of a batch of (doc_id, text)."""
    split = pc.ascii_split_whitespace(pc.fill_null(batch.column(1), ""))
    words, owner = split.flatten(), pc.list_parent_indices(split).to_numpy()
    real = pc.greater(pc.binary_length(words), 0)  # blanks at the ends leave an empty word
    words, owner = words.filter(real), owner[real.to_numpy(zero_copy_only=False)]
    counts = np.bincount(owner, minlength=batch.num_rows)
    ends = np.cumsum(counts)
    coded = words.dictionary_encode()
    runs = periodic_runs(coded.indices.to_numpy().astype(np.int64), ends, least, repeats)
    cover = np.zeros(len(owner) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    stay = np.cumsum(cover[:-1]) == 0
    text = pa.ListArray.from_arrays(_offsets(owner[stay], batch.num_rows), words.filter(pa.array(stay)))
    of = owner[runs[:, 0]] if len(runs) else np.empty(0, np.int64)
    fields = [runs[:, 0] - (ends - counts)[of] if len(runs) else runs[:, 0], runs[:, 1], runs[:, 2]]
    spans = pa.StructArray.from_arrays([pa.array(x) for x in fields], names=["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(counts), pa.ListArray.from_arrays(_offsets(of, batch.num_rows), spans), pc.binary_join(text, " ")],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def _offsets(owner: np.ndarray, rows: int) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=rows))).astype(np.int32))


def find_runs(docs: DataFrame, least: int = 24, repeats: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start and length in words, period; by start, then period), collapsed.

    ``collapsed`` are the words that stay, joined by one space: of every run its first period stays and
    the rest goes, unless it is the first period of no run that covers it. Null and empty texts have no words, no runs and the
    empty text; repeated rows and rows without doc_id are treated each for itself; other columns are not read.
    """
    return only(docs, "doc_id", "text").mapInArrow(_find(least, repeats), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def plant(docs: DataFrame) -> DataFrame:
    """Documents of the contract's test: where crc32(doc_id) ends in 0, the words from one place on repeat with one period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    planted = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), (h % 10 == 0).alias("chosen"))
    words = F.filter(F.split(as_text("text"), BLANKS), lambda w: w != "")
    word = planted.select("doc_id", "text", "g", F.when(F.col("chosen"), words).alias("w")).withColumn("n", F.size("w").cast("long"))
    at = word.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))

    def source(i: Column) -> Column:
        return F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")

    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", source(i))), " ")
    return at.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document of ``plant(docs)`` the number of runs, the run of the greatest exponent, and digests of all runs and of the collapsed text."""
    found = find_runs(plant(docs))
    before = "a.length * b.period > b.length * a.period OR (a.length * b.period = b.length * a.period AND (a.start, a.period) < (b.start, b.period))"
    best = F.expr(f"get(array_sort(runs, (a, b) -> CASE WHEN a = b THEN 0 WHEN {before} THEN -1 ELSE 1 END), 0)")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
