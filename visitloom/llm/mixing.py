"""Mixing sources to target weights by Pfair scheduling.

A source of weight w gets, for its block number i (from 0), the release time floor(i / w) and the
deadline ceil((i + 1) / w). In every slot the released block with the earliest deadline is taken,
so that after any number t of slots each source has had t * w blocks to within less than one.

A stream that ends before a source runs out has constant weights. They are whole shares of a period, so
the schedule repeats: only one period is computed, without looking at a row, and the slot of every block follows by arithmetic.

A stream that gives every block has weights that change: a source leaves with its last block. In the
fluid stream source s has had min(n_s, w_s * v) blocks at virtual time v, where all together have had t at
slot t. Releases and deadlines are the slots in which the fluid stream begins and ends a block. They can all
be met, as the fluid stream meets them in fractions, so earliest deadline first keeps every source within less than
one block of the fluid stream at every slot, across all departures. The whole schedule is computed in whole
numbers on the driver, one slot for each block; so it grows with the number of blocks. Blocks have the same size in a corpus of any
size, unless ``MAX_SLOTS`` is set.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Mapping
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm.common import materialize, number_gapless, only

#: Sources above this number would make the one-period schedule too large for the driver.
MAX_SOURCES = 100_000
#: If set, blocks of a stream that gives every document, besides one for each source: beyond, a block holds more documents.
MAX_SLOTS: int | None = None
#: Slots of a schedule that is broadcast; a longer one is joined by shuffle, with the same result.
BROADCAST_SLOTS = 400_000
#: Weights are whole multiples of so much of the largest.
FINENESS = 1 << 44


def whole_shares(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Weights as whole shares of ``period`` by largest remainders; every positive weight gets at least one."""
    live = {k: float(w) for k, w in sorted(weights.items()) if w and w > 0}
    if not live:
        return {}
    total = sum(live.values())
    exact = {k: w / total * period for k, w in live.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    rest = sorted(live, key=lambda k: (int(exact[k]) - exact[k], k))
    i = 0
    while (short := period - sum(out.values())) != 0:
        k = rest[i % len(rest)] if short > 0 else max(out, key=lambda s: (out[s], s))
        out[k] += 1 if short > 0 else -1
        i += 1
    return out


def one_period(shares: Mapping[str, int], period: int) -> list[tuple[str, int, int, int, int]]:
    """Earliest deadline first over one period: (source, number, release, deadline, slot) for each block."""
    future = [(0, -(-period // q), s, 0) for s, q in sorted(shares.items())]
    heapq.heapify(future)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for slot in range(period):
        while future and future[0][0] <= slot:
            release, deadline, s, i = heapq.heappop(future)
            heapq.heappush(ready, (deadline, release, s, i))
        deadline, release, s, i = heapq.heappop(ready)
        out.append((s, i, release, deadline, slot))
        q = shares[s]
        if i + 1 < q:
            heapq.heappush(future, ((i + 1) * period // q, -(-(i + 2) * period // q), s, i + 1))
    return out


def whole_stream(blocks: Mapping[str, int], weights: Mapping[str, float]) -> list[tuple[str, int, int, int, int]]:
    """Earliest deadline first over every block of every source of positive weight: (source, number, release, deadline, slot).

    ``fluid(s, i)`` is where the fluid stream begins block i of s: at virtual time i / w_s the sources that have
    left by then have given all, the others w_j * i / w_s each.
    """
    live = {s: n for s, n in sorted(blocks.items()) if n and weights.get(s, 0) > 0}
    if not live:
        return []
    top = max(weights[s] for s in live)
    w = {s: max(1, round(weights[s] / top * FINENESS)) for s in live}
    leaving = sorted(live, key=lambda s: (Fraction(live[s], w[s]), s))
    n, share = [live[s] for s in leaving], [w[s] for s in leaving]
    gone, flow = [0], [sum(share)]
    for k in range(len(leaving)):
        gone.append(gone[-1] + n[k])
        flow.append(flow[-1] - share[k])

    def fluid(s: str, i: int, since: int) -> tuple[int, int, int]:
        """Whole slot before, whole slot after, and how many sources have left."""
        left = bisect_left(range(len(n)), True, lo=since, key=lambda j: n[j] * w[s] >= i * share[j])
        whole, rest = divmod(i * flow[left], w[s])
        return gone[left] + whole, gone[left] + whole + (rest > 0), left

    def window(s: str, i: int, since: int) -> tuple[int, int, str, int, int]:
        begin, _, at = fluid(s, i, since)
        _, end, at = fluid(s, i + 1, at)
        return begin, end, s, i, at

    future = [window(s, 0, 0) for s in live]
    heapq.heapify(future)
    ready: list[tuple[int, int, str, int, int]] = []
    out = []
    for slot in range(sum(live.values())):
        while future and future[0][0] <= slot:
            release, deadline, s, i, at = heapq.heappop(future)
            heapq.heappush(ready, (deadline, release, s, i, at))
        deadline, release, s, i, at = heapq.heappop(ready)
        out.append((s, i, release, deadline, slot))
        if i + 1 < live[s]:
            heapq.heappush(future, window(s, i + 1, at))
    return out


def tempered_weights(counts: Mapping[str, int], alpha: float = 0.7) -> dict[str, float]:
    """Target weights proportional to count ** alpha: less of a dominant source than its share, more of the small ones."""
    total = sum(n**alpha for n in counts.values()) or 1.0
    return {s: n**alpha / total for s, n in counts.items()}


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = 16, period: int = 10_000, stop: bool | None = None) -> DataFrame:
    """The place of every document in the mixed stream.

    Columns: doc_id, source, position (in its source, from 0), block, release, deadline, slot (all
    from 0, in slots of one block), in_mix. Without ``weights`` they are ``tempered_weights`` of the
    sources' counts, and a source leaves the stream with its last, perhaps partly filled block while
    the others go on, so that every document has its slot; blocks then hold ``block`` documents
    at every size (more only if ``MAX_SLOTS`` is set and there would be over so many). With ``stop`` (the default when weights
    are given) the stream ends when the next slot would need a block that its source cannot fill, so
    that the weights hold throughout: ``in_mix`` is false after that. It is also false for sources
    without a positive weight, whose slot is null.

    A null source is a source of its own, named '' here. Rows repeated whole are rows like others.
    Sources of any size are numbered without sorting one of them in a single task.
    """
    rows = only(docs, "doc_id", "source").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return place_rows(materialize(rows, "mix-rows"), weights, block, period, stop)


def place_rows(rows: DataFrame, weights: Mapping[str, float] | None = None, block: int = 16, period: int = 10_000, stop: bool | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``mix_sources`` for rows (doc_id, source, not null, and the columns named in ``carry``, which are returned too)."""
    spark = rows.sparkSession
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; mix groups of sources instead")
    stop = weights is not None if stop is None else stop
    weights = tempered_weights(counts) if weights is None else {s: w for s, w in weights.items() if s in counts}
    numbered = number_gapless(rows, ["source"], ["doc_id"], "position", sum(counts.values()))
    if not stop:
        block = block if MAX_SLOTS is None else max(block, -(-sum(counts.values()) // MAX_SLOTS))
        plan = whole_stream({s: -(-n // block) for s, n in counts.items()}, weights)
        schedule = spark.createDataFrame(pd.DataFrame(plan, columns=["s", "i", "release", "deadline", "slot"]), "s string, i long, release long, deadline long, slot long")
        blocks = numbered.withColumn("block", F.floor(F.col("position") / block).cast("long"))
        schedule = F.broadcast(schedule) if len(plan) <= BROADCAST_SLOTS else schedule
        joined = blocks.join(schedule, (F.col("source") == F.col("s")) & (F.col("block") == F.col("i")), "left")
        return joined.select("doc_id", "source", "position", "block", "release", "deadline", "slot", F.col("slot").isNotNull().alias("in_mix"), *carry)
    period = max(period, 4 * len(weights))
    shares = whole_shares(weights, period)
    plan = one_period(shares, period) if shares else []
    # The first slot that its source cannot fill with a whole block ends the mix.
    end = min((((counts[s] // block) - i + q - 1) // q * period + slot for s, i, _, _, slot in plan if (q := shares[s])), default=0) if plan else 0
    if end <= 0:  # some source has less than one block: its last, partly filled block counts as one
        end = min(((-(-counts[s] // block) - i + shares[s] - 1) // shares[s] * period + slot for s, i, _, _, slot in plan), default=0)
    schedule = spark.createDataFrame([(s, shares[s], i, slot) for s, i, _, _, slot in plan], "s string, q long, i long, at long")
    of = spark.createDataFrame(list(shares.items()), "of string, share long")  # a row for each source
    blocks = numbered.withColumn("block", F.floor(F.col("position") / block).cast("long")).join(F.broadcast(of), F.col("source") == F.col("of"), "left")
    joined = blocks.join(F.broadcast(schedule), (F.col("source") == F.col("s")) & (F.col("block") % F.col("share") == F.col("i")), "left")  # a row for each slot of a period
    p = F.lit(period)
    slot = F.floor(F.col("block") / F.col("q")).cast("long") * p + F.col("at")
    return joined.select(
        "doc_id", "source", "position", "block", F.floor(F.col("block") * p / F.col("q")).cast("long").alias("release"), F.ceil((F.col("block") + 1) * p / F.col("q")).cast("long").alias("deadline"),
        slot.alias("slot"), F.coalesce(slot < F.lit(end), F.lit(False)).alias("in_mix"), *carry,
    )


def op10_mix_sources(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix_sources(docs)


def mixed(spark: SparkSession, docs: DataFrame, slots: int = 256) -> DataFrame:
    """The documents of the mix with all their columns, in the order of their slots: partitions of runs of ``slots`` blocks, each sorted.

    Rows carry their columns through the numbering, so rows of one id, or without one, stay apart.
    The run of a slot follows by arithmetic, so no pass over the rows is spent on finding ranges.
    """
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.struct(*docs.columns).alias("__whole"))
    placed = place_rows(rows, carry=("__whole",)).filter("in_mix")
    parts = max(1, -(-docs.count() // (16 * slots)))
    return placed.repartition(parts, F.floor(F.col("slot") / slots)).sortWithinPartitions("slot", "position").select("__whole.*")
