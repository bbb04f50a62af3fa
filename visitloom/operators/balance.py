"""Balance of a split: distances between category and number distributions, scores, and the split search."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitloom.session import staged

# Shares of the splits, tolerance of the visit share, seed of candidate 0.
SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}
VISIT_TOLERANCE, MASTER_SEED, CANDIDATES, REQUIRED_COUNT = 0.03, 42_000_000, 100_000, 10
CATEGORICAL = ("diagnosis_first", "sex", "apoe_availability", "modality_pattern_first", "longitudinal_class")
NUMERIC = ("n_visits", "followup_months", "modality_count_mean")
#: Participants of a profile that may be broadcast to the search tasks, coded as words of 8 bytes; a task holds some 40 bytes for each.
MAX_PARTICIPANTS = 20_000_000
#: Draws that are judged at once, numbers from which their replay is faster than NumPy's own permutation, and bits of criteria that are counted together.
DRAWS, REPLAYED, JOINT = 32_768, 250_000, 16
#: Counts (candidates times codes) that a search task holds at once.
CELLS = 300_000


def split_sizes(n: int, shares: Mapping[str, float] = SHARES) -> dict[str, int]:
    """Sizes by half-even rounding; the last split takes the rest."""
    names = list(shares)
    out = {k: int(round(n * shares[k])) for k in names[:-1]}
    out[names[-1]] = n - sum(out.values())
    if min(out.values()) <= 0:
        raise ValueError("a split would be empty")
    return out


def _entropy_term(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)


def js_distance(df: DataFrame, category: str, split: str) -> DataFrame:
    """Jensen-Shannon distance (base 2) between each split's categories and all rows'.

    Counts by (split, category) are the only pass over the data; the rest is on counts.
    """
    counts = df.groupBy(split, category).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(category).agg(F.sum("n").alias("g"))
    grand = counts.agg(F.sum("n").alias("__all"))
    sizes = counts.groupBy(split).agg(F.sum("n").alias("__size"))
    grid = sizes.crossJoin(totals).crossJoin(grand)  # splits x categories, both few
    right = counts.select(F.col(split).alias("__s"), F.col(category).alias("__c"), "n")
    j = grid.join(right, F.col(split).eqNullSafe(F.col("__s")) & F.col(category).eqNullSafe(F.col("__c")), "left")
    p, q = F.coalesce(F.col("n"), F.lit(0)) / F.col("__size"), F.col("g") / F.col("__all")
    m = (p + q) / 2
    return j.groupBy(split).agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(_entropy_term(p, m) + _entropy_term(q, m)) / 2)).alias("distance"))


def wasserstein(df: DataFrame, value: str, split: str) -> DataFrame:
    """1-D Wasserstein distance between each split's values and all rows', after a z-score with the population deviation.

    Works on counts of different values. These are dealt out by ranges of value; cumulative counts
    run inside a range, and the ranges' totals, one row each, give what lies before it. NULL where
    the criterion is inactive (fewer than two values or no spread).
    """
    stats = df.agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd"), F.count(value).alias("__n"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(split, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(split).agg(F.sum("n").alias("__size"))
    totals = counts.groupBy("v").agg(F.sum("n").alias("g")).repartitionByRange("v").withColumn("__range", F.spark_partition_id())
    totals = staged(totals, "values")  # the ranges stay what they are
    grid = totals.crossJoin(F.broadcast(sizes))  # a few splits
    j = grid.join(counts, [split, "v"], "left").select(split, "v", "__size", "__range", F.coalesce("n", F.lit(0)).alias("n"), "g")
    before, all_ = Window.partitionBy(split).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(split).orderBy("__range")
    ranges = j.groupBy(split, "__range").agg(F.sum("n").alias("tn"), F.sum("g").alias("tg"), F.min("v").alias("lo"))
    ranges = ranges.select(split, "__range", F.coalesce(F.sum("tn").over(before), F.lit(0)).alias("bn"), F.coalesce(F.sum("tg").over(before), F.lit(0)).alias("bg"), F.lead("lo").over(all_).alias("next"))
    w = Window.partitionBy(split, "__range").orderBy("v")
    steps = j.select(split, "v", "__size", "__range", F.sum("n").over(w).alias("cn"), F.sum("g").over(w).alias("cg"), F.lead("v").over(w).alias("then"))
    joined = steps.join(F.broadcast(ranges), [split, "__range"]).crossJoin(stats)  # a row for each range and split; one row
    gap = F.coalesce("then", "next") - F.col("v")
    area = F.sum(F.abs((F.col("cn") + F.col("bn")) / F.col("__size") - (F.col("cg") + F.col("bg")) / F.col("__n")) * gap)
    return joined.groupBy(split).agg(F.when((F.first("__n") >= 2) & (F.first("__sd") > 0), F.coalesce(area, F.lit(0.0)) / F.first("__sd")).alias("distance"))


def score_criteria(distances: DataFrame, candidate: Sequence[str] = (), weight: Mapping[str, float] | None = None) -> DataFrame:
    """(candidate, criterion, split, distance) -> the weighted mean over criteria of half mean plus half maximum over splits."""
    per = distances.groupBy(*candidate, "criterion").agg(F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"))
    per = per.withColumn("score", (F.col("mean_distance") + F.col("max_distance")) / 2)
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weight.items() for x in kv])[F.col("criterion")], F.lit(0.0)) if weight else F.lit(1.0)
    live = per.filter(F.col("score").isNotNull()).withColumn("w", w).filter("w > 0")
    keys = list(candidate)
    return live.groupBy(*keys).agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("score_final"), F.max("score").alias("score_max_component"), F.max_by("criterion", "score").alias("worst"))


def permuted_tail(n: int, m: int, seed: int) -> np.ndarray:
    """``default_rng(seed).permutation(n)[m:]`` without what lies before.

    NumPy swaps each place, from the last down, with a place drawn at or before it, so places from ``m`` on are settled by their own draws.
    ``last`` has for each place the last draw (by the place it was for) that hit it. A draw takes the number of the place that it hits, or,
    where an earlier draw hit it, what that one put there: the number found by following hits back to a place without any.
    """
    if n < REPLAYED or not replays():
        return np.random.default_rng(seed).permutation(n)[m:]
    return _tail(n, m, seed)


def _tail(n: int, m: int, seed: int) -> np.ndarray:
    raw, held, i, last = np.random.default_rng(seed).bit_generator, np.empty(0, np.int32), n - 1, _scratch(n)
    last.fill(0)
    out, least = np.empty(n - m, np.int64), max(m, 1)  # the first place is not drawn for
    while i >= least:
        if not len(held):
            held = raw.random_raw(4 * DRAWS).astype("<u8", copy=False).view("<i4")  # the lower half first
        # The lowest bits of 32, as many as the place has; those beyond the place are drawn again.
        bits = i.bit_length()
        drawn = held[:DRAWS] & np.int32((1 << bits) - 1)
        ok = drawn <= i
        while True:  # whether a draw holds hangs on how many before it do: the front is right, and grows
            place = np.cumsum(ok, dtype=np.int32)
            np.subtract(np.int32(i) + ok, place, out=place)
            again = drawn <= place
            if np.array_equal(again, ok):
                break
            ok = again
        at = np.flatnonzero(ok)[: i - max(least, 1 << (bits - 1)) + 1]
        held = held[at[-1] + 1 if at.size == i - max(least, 1 << (bits - 1)) + 1 else len(drawn) :]
        hit, place = drawn[at].astype(np.int64), np.arange(i, i - len(at), -1, dtype=np.int32)
        before = last[hit]
        last[hit] = place  # of places that are hit twice here the last draw stays
        twice = np.flatnonzero(last[hit] != place)
        if len(twice):
            some = np.unique(np.concatenate([twice, i - last[hit[twice]]]))
            some = some[np.argsort(hit[some], kind="stable")]
            same = np.flatnonzero(hit[some[1:]] == hit[some[:-1]])
            before[some[same + 1]] = place[some[same]]
        moved = np.flatnonzero(before != 0)
        hit[moved] = -before[moved]  # found below, when all hits on these places are known
        out[i - m + 1 - len(at) : i - m + 1] = hit[::-1]
        i -= len(at)
    if m == 0:
        out[0] = -last[0] if last[0] else 0
    who = np.flatnonzero(out < 0)
    v = -out[who]
    while len(who):
        then = last[v]
        out[who] = v
        more = np.flatnonzero(then)
        who, v = who[more], then[more]
    return out


@lru_cache(maxsize=1)
def _scratch(n: int) -> np.ndarray:
    """Room that every candidate of a task writes anew: fresh pages from the system cost as much as the draws."""
    return np.empty(n, np.int32)


@lru_cache(maxsize=1)
def replays() -> bool:
    """Whether this version of NumPy permutes as ``permuted_tail`` has it."""
    return all(np.array_equal(np.random.default_rng(n).permutation(n)[m:], _tail(n, m, n)) for n in (1, 2, 100, 3000, 70_000) for m in (0, n // 2))


@dataclass
class SearchContext:
    """A profile as whole numbers, one entry for each participant in their order.

    Every criterion is a code (a category, or the rank of a different value), and the codes of a participant are packed
    side by side into as few 63-bit words as they need: ``place`` has for each criterion its word, shift and bits.
    ``totals`` counts the codes of all participants, ``categories`` has the shares of each category criterion,
    ``gaps`` the gaps between different values of each number criterion in standard deviations; participants without a value have the last code.
    """

    sizes: dict[str, int]
    words: list[np.ndarray]
    place: dict[str, tuple[int, int, int]]
    totals: dict[str, np.ndarray]
    visits: np.ndarray
    categories: dict[str, np.ndarray]
    required: np.ndarray
    gaps: dict[str, np.ndarray]
    levels: dict[str, np.ndarray]

    @classmethod
    def of(cls, profile: pd.DataFrame) -> SearchContext:
        facts = {}
        for c, x in _columns(profile).items():
            facts[c] = np.unique(x[np.isfinite(x)] if c not in CATEGORICAL else x, return_counts=True)
        context = cls.of_counts(facts, len(profile))
        context.words = context.encode(profile)
        return context

    @classmethod
    def of_counts(cls, facts: Mapping[str, tuple[np.ndarray, np.ndarray]], n: int) -> SearchContext:
        """From the different values of each criterion, in order, and their counts; the words are still to come."""
        categories, gaps, required, totals, levels = {}, {}, np.empty(0, np.int64), {}, {}
        for c, (values, count) in facts.items():
            if c in NUMERIC:
                known = int(count.sum())
                sd = ((values - (mean := values @ count / known)) ** 2 @ count / known) ** 0.5 if known >= 2 and len(values) > 1 else 0.0
                if not sd > 0:
                    continue
                gaps[c], count = np.diff(values) / sd, np.append(count, n - known)
            elif c in CATEGORICAL:
                categories[c] = count / count.sum()
                if c == "diagnosis_first":
                    required = np.array([k for k, v in enumerate(values) if count[k] >= REQUIRED_COUNT and v not in ("__MISSING__", "__RARE__")], np.int64)
            levels[c], totals[c] = values, count.astype(np.int64)
        word, place, used = -1, {}, 63
        for c, count in sorted(totals.items(), key=lambda t: len(t[1])):  # few codes side by side
            most = len(count) - 1 if c not in gaps or count[-1] else len(count) - 2
            bits = max(1, most.bit_length())
            if used + bits > 63:
                word, used = word + 1, 0
            place[c], used = (word, used, bits), used + bits
        return cls(split_sizes(n), [], place, totals, levels["__visits"].astype(np.float64), categories, required, gaps, levels)

    def encode(self, profile: pd.DataFrame) -> list[np.ndarray]:
        """The words of some participants."""
        columns, words = _columns(profile), [np.zeros(len(profile), np.int64) for _ in range(1 + max(w for w, _, _ in self.place.values()))]
        for c, (word, shift, _) in self.place.items():
            x, values = columns[c], self.levels[c]
            if c in CATEGORICAL:
                code = pd.Index(values).get_indexer(x)
            else:
                code = np.where(np.isfinite(x), np.searchsorted(values, x), len(values))
            words[word] |= code.astype(np.int64) << shift
        return words

    @cached_property
    def joint(self) -> list[tuple[list[str], int, int, int]]:
        """Criteria that lie side by side in a word and have up to ``JOINT`` bits together, counted at once: names, word, shift and bits."""
        out: list[tuple[list[str], int, int, int]] = []
        most = min(JOINT, (len(self.words[0]) >> 8).bit_length())  # fewer cells than participants
        for c, (word, shift, bits) in self.place.items():
            if c == "n_visits" and not self.totals[c][-1]:
                continue  # the same codes as the visits'
            if out and out[-1][1] == word and out[-1][2] + out[-1][3] == shift and out[-1][3] + bits <= most:
                names, _, start, used = out.pop()
                out.append(([*names, c], word, start, used + bits))
            else:
                out.append(([c], word, shift, bits))
        return out

    def counts(self, seeds: Sequence[int]) -> dict[str, np.ndarray]:
        """By criterion: split x candidate x code. The participants of the first split are all others than those of the rest, so only the rest is permuted and counted."""
        sizes = list(self.sizes.values())
        out = {c: np.zeros((len(sizes), len(seeds), len(t)), np.int64) for c, t in self.totals.items()}
        ends = np.cumsum(sizes) - sizes[0]
        for i, seed in enumerate(seeds):
            order = permuted_tail(sum(sizes), sizes[0], seed)
            for s in range(1, len(sizes)):
                words = [w[order[ends[s - 1] : ends[s]]] for w in self.words]
                for names, word, shift, bits in self.joint:
                    found = np.bincount((words[word] >> shift) & ((1 << bits) - 1), minlength=1 << bits)
                    found = found.reshape([1 << self.place[c][2] for c in reversed(names)])  # the first criterion has the lowest bits
                    for k, c in enumerate(reversed(names)):
                        mine = found.sum(tuple(d for d in range(len(names)) if d != k))[: len(self.totals[c])]
                        out[c][s, i, : len(mine)] = mine  # no room for a missing value that nobody has
        if "n_visits" in out and not self.totals["n_visits"][-1]:
            out["n_visits"][:, :, :-1] = out["__visits"]
        for c, n in out.items():
            n[0] = self.totals[c] - n[1:].sum(0)
        return out

    def score(self, seeds: Sequence[int]) -> dict[str, list]:
        """The scores of the splits of many seeds, from their counts by code alone."""
        counts, names = self.counts(seeds), list(self.sizes)
        size = np.array(list(self.sizes.values()), np.float64)[:, None, None]
        share = np.array([SHARES[s] for s in names])[:, None]
        by = {"visit_proportion": np.abs(counts["__visits"] @ self.visits / (self.totals["__visits"] @ self.visits) - share)}
        for c, q in self.categories.items():
            p = counts[c] / size
            m = (p + q) / 2
            with np.errstate(divide="ignore", invalid="ignore"):
                terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
            by[c] = np.sqrt(np.maximum(terms.sum(2) / 2, 0))
        for c, gaps in self.gaps.items():
            all_ = np.cumsum(self.totals[c][:-1])
            run = np.cumsum(counts[c][:, :, :-1], axis=2)
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.abs(run[:, :, :-1] / run[:, :, -1:] - all_[:-1] / all_[-1]) @ gaps
            by[c] = np.where(np.isfinite(out), out, np.inf)
        score = {c: (d.mean(0) + d.max(0)) / 2 for c, d in by.items()}
        criteria, table = list(score), np.stack(list(score.values()))
        live = np.isfinite(table)
        worst = np.where(live, table, -np.inf).argmax(0)
        reasons = [[] for _ in seeds]
        found = counts["diagnosis_first"][:, :, self.required]
        faults = {
            "missing_required_diagnosis_category": (found == 0).any(2),
            **{f"insufficient_{k}plus": counts["__visits"][:, :, self.visits >= k].sum(2) < 1 for k in (2, 3)},
            "visit_proportion_outside_tolerance": by["visit_proportion"] > VISIT_TOLERANCE,
        }
        for reason, at in faults.items():
            for s, i in zip(*np.nonzero(at), strict=True):
                reasons[i].append(f"{reason}:{names[s]}")
        return {
            "score_final": (np.where(live, table, 0).sum(0) / live.sum(0)).tolist(), "score_max_component": table[worst, np.arange(len(seeds))].tolist(),
            "score_max_component_name": [criteria[k] for k in worst], "is_valid": [not r for r in reasons], "rejection_reasons": ["|".join(sorted(r)) for r in reasons],
        }


def _columns(profile: pd.DataFrame) -> dict[str, np.ndarray]:
    """The criteria of the participants: numbers, not finite where there is no value, and names."""
    out = {"__visits": profile["n_visits"].to_numpy(np.float64)}
    out |= {c: profile[c].fillna("__MISSING__").astype(str).to_numpy(object) for c in CATEGORICAL}
    return out | {c: pd.to_numeric(profile[c], errors="coerce").to_numpy(float) for c in NUMERIC}


def search_context(profile: DataFrame) -> SearchContext:
    """The context of a profile: different values are counted and participants coded in tasks; counts and words, 8 bytes or few more a participant, reach the driver."""
    kept = staged(profile.select("participant", "n_visits", *CATEGORICAL, *[c for c in NUMERIC if c != "n_visits"]), "profile")
    if (n := kept.count()) > MAX_PARTICIPANTS:
        raise ValueError(f"{n} participants; search over groups of participants instead")

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c, x in _columns(pdf).items():
                name = c in CATEGORICAL
                found, count = np.unique(x if name else x[np.isfinite(x)] + 0.0, return_counts=True)  # one zero
                yield pd.DataFrame({"c": c, "name": found if name else None, "number": np.nan if name else found, "n": count}).astype({"name": object, "number": float})

    found = kept.mapInPandas(values, "c string, name string, number double, n long").groupBy("c", "name", "number").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    facts = {}
    for c in ("__visits", *CATEGORICAL, *NUMERIC):
        mine = found[found["c"] == c].sort_values("name" if c in CATEGORICAL else "number")
        facts[c] = (mine["name"].to_numpy(object) if c in CATEGORICAL else mine["number"].to_numpy(np.float64), mine["n"].to_numpy(np.int64))
    context = SearchContext.of_counts(facts, n)
    shared = profile.sparkSession.sparkContext.broadcast(context)  # different values

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({f"w{k}": w for k, w in enumerate(shared.value.encode(pdf))})

    number = 1 + max(w for w, _, _ in context.place.values())
    words = kept.orderBy("participant").mapInPandas(encode, ", ".join(f"w{k} long" for k in range(number))).toArrow()
    context.words = [words.column(f"w{k}").to_numpy() for k in range(number)]
    return context


def search_splits(profile: DataFrame, candidates: int = CANDIDATES, first: int = 1, master_seed: int = MASTER_SEED, tasks: int = 240) -> DataFrame:
    """Scores of seeded permutations, one row each. ``first`` resumes after candidates that are done.

    Candidates are the rows that are distributed; a task finds for each who lies in the two smaller splits of the permuted participants,
    counts their codes and scores candidates of ``CELLS`` counts at once;
    the coded profile (a word or few for each participant, their number checked) is broadcast. Permutations are NumPy's,
    which Spark's generator cannot replay.
    """
    spark: SparkSession = profile.sparkSession
    context = search_context(profile)
    step = max(1, CELLS // sum(map(len, context.totals.values())))
    shared = spark.sparkContext.broadcast(context)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            for k in range(0, len(ids), step):
                some = ids[k : k + step]
                yield pd.DataFrame({"candidate_id": some, "seed": master_seed + some, **shared.value.score((master_seed + some).tolist())})

    schema = "candidate_id long, seed long, score_final double, score_max_component double, score_max_component_name string, is_valid boolean, rejection_reasons string"
    return spark.range(first, candidates + 1, 1, tasks).mapInPandas(run, schema)


def split_mapping(profile: DataFrame, seed: int) -> DataFrame:
    """The split of every participant under one seed. The driver permutes numbers; participants are numbered by their order where they are."""
    spark = profile.sparkSession
    kept = staged(profile.select("participant").orderBy("participant").withColumn("__at", F.monotonically_increasing_id()), "participants")
    stretch = F.shiftright("__at", 33)  # the partition that numbered the row
    sizes_of = sorted(map(tuple, kept.groupBy(stretch.alias("p")).count().collect()))
    n = sum(c for _, c in sizes_of)
    if n > MAX_PARTICIPANTS:
        raise ValueError(f"{n} participants; a permutation of so many is not laid out on the driver")
    starts = dict(zip((p for p, _ in sizes_of), np.cumsum([0, *[c for _, c in sizes_of]]).tolist(), strict=False))
    sizes = split_sizes(n)
    split = np.empty(n, np.int8)
    split[np.random.default_rng(seed).permutation(n)] = np.repeat(np.arange(len(sizes)), list(sizes.values()))
    shared = spark.sparkContext.broadcast((starts, split, np.array(list(sizes), object)))  # a byte for each participant

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, split, names = shared.value
        for pdf in batches:
            if len(pdf):
                at = pdf["__at"].to_numpy()
                first = pd.Series(at >> 33).map(starts).to_numpy()
                yield pd.DataFrame({"participant": pdf["participant"], "split": names[split[first + (at & ((1 << 33) - 1))]]})

    return kept.mapInPandas(run, f"participant {dict(kept.dtypes)['participant']}, split string")
