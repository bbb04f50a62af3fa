"""Extremely randomized trees for several targets; the trees of all seeds and configurations grow together, level by level.

A node tries the first features of its own random order that are not constant in it, each at one cut
drawn evenly between its least and greatest value there, and takes the cut that leaves the least
squared error. Rows are not resampled. Order and cuts are hashed from (seed, tree, node, feature), so
every task and every attempt of a task draws the same ones.

A level is two aggregates over the training rows: the ranges of all features in every open node, from
which cuts are drawn, then counts and target sums left of every cut. What returns to the driver is as
large as the trees, and is worked through in chunks of bounded size. A node of at most
``local_rows`` rows is finished by the same steps in one task, where its rows meet the queries that
reach it; so no task ever holds more training rows than that. The trees are the same wherever that bound lies.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.session import staged

#: Values of a node that is finished in one task, and queries that meet it there at once.
LOCAL_VALUES, QUERY_ROWS = 10_000_000, 20_000
#: Rows of nodes that are copied side by side, and of nodes that are cut together.
GROW_ROWS, NODE_ROWS = 32_768, 64
#: Values of a training table that a task may hold whole, whole trees that meet the same copy of it there, and queries that do so at once.
WHOLE_VALUES, BATCH_TREES, BATCH_QUERIES = 40_000_000, 16, 500_000
#: Statistics (doubles) that a chunk of open nodes may have.
CHUNK_VALUES = 8_000_000
#: Values of training rows copied for the trees that grow at once, and the largest number of such trees.
BLOCK_VALUES, MOST_TREES = 250_000_000, 2048
NODE_BITS = 40


@dataclass(frozen=True)
class Tree:
    """One tree: what its draws are hashed from, its limits, and the ensemble that it belongs to."""

    seed: int
    number: int
    depth: int
    tries: int
    leaf: int
    ensemble: int


@dataclass
class Top:
    """The part of a tree that is known to all: splits and leaves by node (root 1, children 2n and 2n + 1)."""

    nodes: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    leaves: np.ndarray
    means: np.ndarray

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The node at which each row stops."""
        at, live = np.ones(len(x), np.int64), np.arange(len(x))
        while len(live) and len(self.nodes):
            p = np.minimum(np.searchsorted(self.nodes, at[live]), len(self.nodes) - 1)
            hit = self.nodes[p] == at[live]
            live, p = live[hit], p[hit]
            at[live] = 2 * at[live] + ~(x[live, self.feature[p]] <= self.cut[p])
        return at

    def leaf_of(self, at: np.ndarray) -> np.ndarray:
        """Position of each node among the leaves, -1 where it is finished elsewhere."""
        if not len(self.leaves):
            return np.full(len(at), -1)
        p = np.minimum(np.searchsorted(self.leaves, at), len(self.leaves) - 1)
        return np.where(self.leaves[p] == at, p, -1)


def uniform(tree: Tree, node: np.ndarray, feature: np.ndarray, use: int) -> np.ndarray:
    """Numbers in [0, 1) that hang on tree, node, feature and use alone."""
    h = np.uint64(0x51ED270B7F4A7C15)
    with np.errstate(over="ignore"):
        for part in (tree.seed, tree.number, use, node, feature):
            h = (h ^ np.asarray(part).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h = h ^ (h >> np.uint64(29))
    return (h >> np.uint64(11)) * 2.0**-53


def draw(tree: Tree, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that each node tries, and their cuts (not a number for a constant feature)."""
    order = np.where(high > low, uniform(tree, nodes[:, None], np.arange(low.shape[1]), 1), 2.0)
    pick = np.argsort(order, axis=1, kind="stable")[:, : tree.tries]
    a, b = np.take_along_axis(low, pick, 1), np.take_along_axis(high, pick, 1)
    cut = a + uniform(tree, nodes[:, None], pick, 2) * (b - a)
    return pick, np.where(b > a, np.where(cut >= b, a, cut), np.nan)


def left_sums(x: np.ndarray, y: np.ndarray, at: np.ndarray, starts: np.ndarray, pick: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Counts and target sums left of each cut, of rows in the order of their node: nodes x tries x (1 + targets)."""
    inside = np.take_along_axis(x, pick[at], 1) <= cut[at]
    out = np.empty((len(starts), pick.shape[1], 1 + y.shape[1]))
    out[:, :, 0] = np.add.reduceat(inside, starts, axis=0, dtype=np.float64)
    for k in range(y.shape[1]):
        out[:, :, 1 + k] = np.add.reduceat(np.where(inside, y[:, k : k + 1], 0.0), starts, axis=0)
    return out


def node_sums(y: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts and target sums of each node."""
    return np.add.reduceat(np.hstack([np.ones((len(y), 1)), y]), starts, axis=0)


def choose(tree: Tree, left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The best cut of each node, -1 where none leaves enough rows on both sides; the first of equals."""
    right = total[:, None, :] - left
    ok = (left[:, :, 0] >= tree.leaf) & (right[:, :, 0] >= tree.leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[:, :, 1:] ** 2).sum(2) / left[:, :, 0] + (right[:, :, 1:] ** 2).sum(2) / right[:, :, 0]
    best = np.where(ok, gain, -np.inf).argmax(1)
    return np.where(ok.any(1), best, -1)


def below(cut: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The largest values of a narrower kind that are not above the cuts: the same rows lie left of them."""
    near = cut.astype(kind)
    return np.where(near > cut, np.nextafter(near, kind.type(-np.inf)), near)


def finish(tree: Tree, node: int, x: np.ndarray, y: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Means of the leaves below ``node`` that the asked rows reach."""
    return finish_columns(tree, node, np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), asked)


def finish_columns(tree: Tree, node: int, columns: np.ndarray, ys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """``finish`` of rows that lie column by column. Parts that no asked row reaches are not grown.

    Large nodes are cut one by one where their rows are; nodes of at most ``GROW_ROWS`` are copied side by side, as many as have so many rows
    together, and those of at most ``NODE_ROWS`` are cut together, level by level. A node reads only the features that it tries.
    """
    out = np.empty((len(asked), len(ys)))
    y1 = np.vstack([np.ones(ys.shape[1]), ys])
    todo = cut_nodes(tree, [(node, np.arange(columns.shape[1]), np.arange(len(asked)))], GROW_ROWS, columns, y1, asked, out)
    while todo:
        some, room = [], GROW_ROWS
        while todo and (not some or len(todo[-1][1]) <= room):
            some.append(todo.pop())
            room -= len(some[-1][1])
        rows = np.concatenate([r for _, r, _ in some])
        ends = np.cumsum([len(r) for _, r, _ in some])
        held, y2 = columns.take(rows, axis=1), y1.take(rows, axis=1)
        some = [(n, np.arange(end - len(r), end), who) for (n, r, who), end in zip(some, ends, strict=True)]
        some = cut_nodes(tree, some, NODE_ROWS, held, y2, asked, out)
        if some:
            cut_levels(tree, some, held, y2, asked, out)
    return out


def cut_nodes(tree: Tree, todo: list[tuple], most: int, columns: np.ndarray, y1: np.ndarray, asked: np.ndarray, out: np.ndarray) -> list[tuple]:
    """Cuts each (node, rows, asked rows) until no more than ``most`` rows are left; these are returned."""
    rest, n, flat = [], columns.shape[1], columns.ravel()
    tries = min(tree.tries, len(columns))
    while todo:
        node, rows, who = todo.pop()
        if len(rows) <= most:
            rest.append((node, rows, who))
            continue
        yr = y1.take(rows, axis=1)
        total = yr.sum(1)
        best, step = -1, max(1, 65_536 // len(rows))
        if node.bit_length() - 1 < tree.depth and len(rows) >= 2 * tree.leaf:
            nodes = np.array([node], np.int64)

            def ranges(features: np.ndarray) -> np.ndarray:
                v = [(u.min(1), u.max(1)) for i in range(0, len(features), step) for u in [flat.take(features[i : i + step, None] * n + rows)]]  # noqa: B023
                return np.concatenate(v, axis=1).astype(np.float64)

            def sums(pick: np.ndarray, low: np.ndarray | None, cut: np.ndarray, use: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, bool]:
                left, varies = np.empty((len(pick), len(y1))), True  # noqa: B023
                for i in range(0, len(pick), step):  # noqa: B023
                    v = flat.take(pick[i : i + step, None] * n + rows)  # noqa: B023
                    if use is not None:
                        a, b = v.min(1).astype(np.float64), v.max(1).astype(np.float64)
                        c = a + use[i : i + step] * (b - a)  # noqa: B023
                        cut[i : i + step], varies = np.where(c >= b, a, c), varies and bool((b > a).all())  # noqa: B023
                    left[i : i + step] = (v <= below(cut[i : i + step, None], v.dtype)).astype(np.float64) @ yr.T  # noqa: B023
                return left, cut, varies

            pick = np.argsort(uniform(tree, nodes[0], np.arange(len(columns)), 1), kind="stable")[:tries]
            left, cut, varies = sums(pick, None, np.empty(tries), uniform(tree, nodes[0], pick, 2))
            if not varies:  # a constant feature does not count as tried
                low, high = ranges(np.arange(len(columns)))
                pick, cut = (a[0] for a in draw(tree, nodes, low[None], high[None]))
                left, cut, _ = sums(pick, None, cut, None)
            best = int(choose(tree, left[None], total[None])[0])
        if best < 0:
            out[who] = total[1:] / total[0]
            continue
        goes = flat.take(pick[best] * n + rows) <= below(cut[best : best + 1], columns.dtype)
        asks = asked[who, pick[best]] <= cut[best]
        for child, r, w in ((2 * node, rows[goes], who[asks]), (2 * node + 1, rows[~goes], who[~asks])):
            if len(w):
                todo.append((child, r, w))
    return rest


def cut_levels(tree: Tree, some: list[tuple], columns: np.ndarray, y1: np.ndarray, asked: np.ndarray, out: np.ndarray) -> None:
    """Cuts nodes together, level by level; a level only orders the numbers of their rows by node."""
    n, flat, tries = columns.shape[1], columns.ravel(), min(tree.tries, len(columns))
    at, rows = (np.concatenate(c) for c in zip(*[(np.full(len(r), node, np.int64), r) for node, r, _ in some], strict=True))
    where, who = (np.concatenate(c) for c in zip(*[(np.full(len(w), node, np.int64), w) for node, _, w in some], strict=True))
    while len(who):
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        nodes = at[starts]
        total = np.add.reduceat(y1.take(rows, axis=1), starts, axis=1).T
        feature, cut = np.full(len(nodes), -1), np.zeros(len(nodes))
        wide = (total[:, 0] >= 2 * tree.leaf) & (np.frexp(nodes.astype(np.float64))[1] - 1 < tree.depth)  # the others are leaves
        sizes = total[:, 0].astype(np.int64)
        live = np.repeat(wide, sizes)
        rows, at, sizes = rows[live], at[live], sizes[wide]
        if len(rows):
            pick = np.argsort(uniform(tree, nodes[wide][:, None], np.arange(len(columns)), 1), axis=1, kind="stable")[:, :tries]
            use, left, cuts = uniform(tree, nodes[wide][:, None], pick, 2), np.empty((*pick.shape, len(y1))), np.empty(pick.shape)
            varies = level_sums(flat, n, rows, sizes, pick, use, cuts, left, y1)
            if not varies.all():  # a constant feature does not count as tried
                again = np.flatnonzero(~varies)
                mine = np.repeat(~varies, sizes)
                low, high = level_ranges(columns, rows[mine], sizes[again])
                pick[again], cuts[again] = draw(tree, nodes[wide][again], low, high)
                part, fixed = np.empty((len(again), *left.shape[1:])), cuts[again]
                level_sums(flat, n, rows[mine], sizes[again], pick[again], None, fixed, part, y1)
                left[again] = part
            best = choose(tree, left, total[wide])
            row = np.arange(len(sizes))
            feature[wide], cut[wide] = np.where(best >= 0, pick[row, best], -1), cuts[row, best]
        p = np.searchsorted(nodes, where)
        ends = feature[p] < 0
        out[who[ends]] = total[p[ends], 1:] / total[p[ends], :1]
        who, where, p = who[~ends], where[~ends], p[~ends]
        where = 2 * where + ~(asked[who, feature[p]] <= cut[p])
        place = np.repeat(np.flatnonzero(wide), sizes)
        live = feature[place] >= 0
        rows, at, place = rows[live], at[live], place[live]
        at = 2 * at + ~(flat.take(feature[place] * n + rows) <= below(cut, columns.dtype)[place])
        reached = np.unique(where)
        if len(reached):
            live = reached[np.minimum(np.searchsorted(reached, at), len(reached) - 1)] == at
            rows, at = rows[live], at[live]


def level_ranges(columns: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum(sizes) - sizes
    low, high = np.empty((len(sizes), len(columns))), np.empty((len(sizes), len(columns)))
    for f, c in enumerate(columns):
        v = c[rows]
        low[:, f], high[:, f] = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
    return low, high


def level_sums(flat: np.ndarray, n: int, rows: np.ndarray, sizes: np.ndarray, pick: np.ndarray, use: np.ndarray | None, cuts: np.ndarray, left: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Counts and target sums left of the cuts, into ``left``; with ``use`` cuts are drawn first, into ``cuts``. Whether each node's features all vary."""
    starts, varies = np.cumsum(sizes) - sizes, np.ones(len(sizes), bool)
    ys = list(y1.take(rows, axis=1)[1:])
    for j in range(pick.shape[1]):
        v = flat.take(np.repeat(pick[:, j] * n, sizes) + rows)
        if use is not None:
            a, b = np.minimum.reduceat(v, starts).astype(np.float64), np.maximum.reduceat(v, starts).astype(np.float64)
            c = a + use[:, j] * (b - a)
            cuts[:, j] = np.where(c >= b, a, c)
            varies &= b > a
        inside = (v <= np.repeat(below(cuts[:, j], flat.dtype), sizes)).astype(np.float64)
        left[:, j, 0] = np.add.reduceat(inside, starts)
        for k, y in enumerate(ys):
            left[:, j, 1 + k] = np.add.reduceat(inside * y, starts)
    return varies


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_list()).astype(np.float64)


def _by_node(df: DataFrame, inner: str) -> pd.DataFrame:
    """The arrays of each (tree, node) put together element by element, in Spark; one row for each node of a chunk comes back."""
    put = f"aggregate(collect_list(v), cast(null as array<double>), (a, b) -> coalesce(zip_with(a, b, (p, q) -> {inner}), b))"  # a row from each task
    return df.groupBy("tree", "node").agg(F.expr(put).alias("v")).toPandas().sort_values(["tree", "node"], ignore_index=True)


def _scan(table: DataFrame, x: str, y: str, tops: list[Top], chunk: list[tuple], what: str) -> DataFrame:
    """One row (tree, node, v) for each node of the chunk from each task: ``ranges`` or ``sums``."""
    shared = table.sparkSession.sparkContext.broadcast((tops, chunk))  # as large as the trees

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops, chunk = shared.value
        held: dict[int, list] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            xs, ys = _matrix(pdf[x]), _matrix(pdf[y])
            for c, (t, nodes, *drawn) in enumerate(chunk):
                at = tops[t].descend(xs)
                p = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
                mine = np.flatnonzero(nodes[p] == at)
                if not len(mine):
                    continue
                mine = mine[np.argsort(p[mine], kind="stable")]
                here, starts, place = np.unique(p[mine], return_index=True, return_inverse=True)
                if what == "ranges":
                    v = np.hstack([np.minimum.reduceat(xs[mine], starts, axis=0), -np.maximum.reduceat(xs[mine], starts, axis=0)])
                else:
                    pick, cut = drawn
                    v = np.hstack([left_sums(xs[mine], ys[mine], place, starts, pick[here], cut[here]).reshape(len(here), -1), node_sums(ys[mine], starts)])
                if c not in held:
                    held[c] = [np.zeros(len(nodes), bool), np.full((len(nodes), v.shape[1]), np.inf if what == "ranges" else 0.0)]
                seen, total = held[c]
                seen[here] = True
                total[here] = np.minimum(total[here], v) if what == "ranges" else total[here] + v
        for c, (seen, total) in held.items():
            yield pd.DataFrame({"tree": chunk[c][0], "node": chunk[c][1][seen], "v": list(total[seen])})

    return table.select(x, y).mapInPandas(run, "tree int, node long, v array<double>")


def _chunks(open_: dict[int, np.ndarray], width) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Open nodes in chunks whose statistics stay within the bound."""
    some, room = [], CHUNK_VALUES
    for t, nodes in open_.items():
        step = max(1, CHUNK_VALUES // width(t))
        for i in range(0, len(nodes), step):
            part = nodes[i : i + step]
            if some and len(part) * width(t) > room:
                yield some
                some, room = [], CHUNK_VALUES
            some.append((t, part))
            room -= len(part) * width(t)
    if some:
        yield some


def grow_tops(table: DataFrame, x: str, y: str, rows: int, columns: int, targets: int, trees: Sequence[Tree], local_rows: int) -> list[Top]:
    """The trees down to the leaves and to the nodes of at most ``local_rows`` rows."""
    splits: list[list] = [[] for _ in trees]
    leaves: list[list] = [[] for _ in trees]
    none = lambda: Top(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty((0, targets)))
    tops = [none() for _ in trees]
    open_ = {t: np.array([1], np.int64) for t in range(len(trees)) if rows > local_rows}
    level = 0
    while open_:
        following: dict[int, list] = {}
        width = lambda t: max(2 * columns, (min(trees[t].tries, columns) + 1) * (1 + targets))
        for chunk in _chunks(open_, width):
            ranges = {t: g for t, g in _by_node(_scan(table, x, y, tops, chunk, "ranges"), "least(p, q)").groupby("tree")}
            drawn = []
            for t, nodes in chunk:
                v = _matrix(ranges[t].set_index("node").loc[nodes, "v"])
                drawn.append((t, nodes, *draw(trees[t], nodes, v[:, :columns], -v[:, columns:])))
            sums = {t: g for t, g in _by_node(_scan(table, x, y, tops, drawn, "sums"), "p + q").groupby("tree")}
            for t, nodes, pick, cut in drawn:
                v = _matrix(sums[t].set_index("node").loc[nodes, "v"])
                left, total = v[:, : -1 - targets].reshape(len(nodes), -1, 1 + targets), v[:, -1 - targets :]
                best = choose(trees[t], left, total) if level < trees[t].depth else np.full(len(nodes), -1)
                stop = best < 0
                leaves[t].append((nodes[stop], total[stop, 1:] / total[stop, :1]))
                row, best, nodes = np.flatnonzero(~stop), best[~stop], nodes[~stop]
                splits[t].append((nodes, pick[row, best], cut[row, best]))
                a = left[row, best]
                children, sizes = np.concatenate([2 * nodes, 2 * nodes + 1]), np.vstack([a, total[row] - a])
                ends = (sizes[:, 0] < 2 * trees[t].leaf) | (level + 1 >= trees[t].depth)
                leaves[t].append((children[ends], sizes[ends, 1:] / sizes[ends, :1]))
                following.setdefault(t, []).append(children[~ends & (sizes[:, 0] > local_rows)])
        for t in open_:
            nodes, feature, cut = (np.concatenate(c) for c in zip(*splits[t], strict=True))
            order = np.argsort(nodes)
            ended, means = (np.concatenate(c) for c in zip(*leaves[t], strict=True))
            by = np.argsort(ended)
            tops[t] = Top(nodes[order], feature[order], cut[order], ended[by], means[by])
        open_ = {t: np.sort(np.concatenate(c)) for t, c in following.items() if sum(map(len, c))}
        level += 1
    return tops


def _code(t: int, nodes: np.ndarray) -> np.ndarray:
    return (np.int64(t) << NODE_BITS) | nodes


def _block_sums(table: DataFrame, queries: DataFrame, key: str, x: str, y: str, rows: int, columns: int, targets: int, trees: Sequence[Tree], local_rows: int) -> DataFrame:
    """(key, ensemble, s0, s1, ...): sums over the trees of the leaf means of each query."""
    kind = dict(queries.dtypes)[key]
    tops = grow_tops(table, x, y, rows, columns, targets, trees, local_rows)
    shared = table.sparkSession.sparkContext.broadcast((list(trees), tops))  # as large as the trees
    result = f"`{key}` {kind}, ensemble int, p array<double>"

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                xs, codes, lives = _matrix(pdf[x]), [], []
                for t, top in enumerate(shared.value[1]):
                    at = top.descend(xs)
                    codes.append(_code(t, at))
                    lives.append(top.leaf_of(at) < 0)
                codes, lives = np.stack(codes, 1), np.stack(lives, 1)
                yield pdf.assign(code=[c[live] for c, live in zip(codes, lives, strict=True)])

    def at_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, tops = shared.value
        for pdf in batches:
            if len(pdf):
                xs = _matrix(pdf[x])
                for t, top in enumerate(tops):
                    p = top.leaf_of(top.descend(xs))
                    if (p >= 0).any():
                        yield pd.DataFrame({key: pdf[key][p >= 0], "ensemble": trees[t].ensemble, "p": list(top.means[p[p >= 0]])})

    def meet(t: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(t) or not len(q):
            return pd.DataFrame({key: q[key].iloc[:0], "ensemble": np.empty(0, np.int32), "p": np.empty(0, object)})
        code = int(q["code"].iloc[0])
        tree = shared.value[0][code >> NODE_BITS]
        p = finish(tree, code & ((1 << NODE_BITS) - 1), _matrix(t[x]), _matrix(t[y]), _matrix(q[x]))
        return pd.DataFrame({key: q[key].to_numpy(), "ensemble": tree.ensemble, "p": list(p)})

    held = table.select(x, y).mapInPandas(places, f"`{x}` array<double>, `{y}` array<double>, code array<long>").withColumn("code", F.explode("code"))
    asked = queries.select(key, x).mapInPandas(places, f"`{key}` {kind}, `{x}` array<double>, code array<long>").withColumn("code", F.explode("code"))
    crowded = asked.groupBy(F.col("code").alias("c")).count().filter(F.col("count") > QUERY_ROWS).select("c", F.ceil(F.col("count") / QUERY_ROWS).cast("int").alias("turns"))
    turns = F.coalesce("turns", F.lit(1))
    held = held.join(crowded, F.col("code") == F.col("c"), "left").select(x, y, "code", F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"))
    asked = asked.join(crowded, F.col("code") == F.col("c"), "left").select(key, x, "code", F.pmod(F.xxhash64(key), turns).cast("int").alias("turn"))
    met = held.groupBy("code", "turn").cogroup(asked.groupBy("code", "turn")).applyInPandas(meet, result)
    ended = queries.select(key, x).mapInPandas(at_leaves, result)
    sums = met.union(ended).groupBy(key, "ensemble").agg(*[F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(targets)])
    return staged(sums, "forest")


def _pack(df: DataFrame, x: str, rest: str, schema: str) -> DataFrame:
    """Rows as blocks: the values of ``x`` as bytes, in single precision where that changes none, other columns as arrays; ``part`` and ``at`` order the blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at = TaskContext.get().partitionId(), 0
        for pdf in batches:
            for turn, g in pdf.groupby("turn"):
                v = _matrix(g[x])
                narrow = v.astype(np.float32)
                exact = np.array_equal(narrow, v)
                yield pd.DataFrame({"part": [part], "at": [at], "turn": [turn], "narrow": [exact], "x": [(narrow if exact else v).tobytes()], "rest": [g[rest].to_list()]})
                at += 1

    return df.mapInPandas(run, f"part int, at int, turn int, narrow boolean, x binary, rest {schema}")


def _unpack(t: pa.Table, columns: int) -> tuple[np.ndarray, pa.Array]:
    """The values column by column, and the other column, of all blocks in their order."""
    t = t.sort_by([("part", "ascending"), ("at", "ascending")])
    kinds = [np.float32 if n else np.float64 for n in t["narrow"].to_pylist()]
    blocks = [np.frombuffer(v.as_buffer(), k).reshape(-1, columns) for v, k in zip(t["x"], kinds, strict=True)]
    out, n = np.empty((columns, sum(map(len, blocks))), np.result_type(*kinds)), 0
    for block in blocks:
        out[:, n : n + len(block)] = block.T
        n += len(block)
    return out, t["rest"].combine_chunks().flatten()


def _spread_codes(spark: SparkSession, n: int) -> list[int]:
    """Numbers of which each is hashed to a partition of its own among ``n``."""
    found: list[int] = []
    tried = 32 * n
    while len(found) < n:
        some = spark.range(tried).select(F.col("id").cast("int").alias("code")).groupBy(F.pmod(F.hash("code"), F.lit(n)).alias("p")).agg(F.min("code").alias("code"))
        found, tried = [r["code"] for r in some.orderBy("p").collect()], 4 * tried
    return found


def _batch_sums(table: DataFrame, queries: DataFrame, key: str, x: str, y: str, columns: int, targets: int, trees: Sequence[Tree]) -> DataFrame:
    """``_block_sums`` where every tree is finished in one task: rows and queries meet once for each batch of trees (queries also in turns of bounded size), both as blocks of bytes."""
    spark, kind = table.sparkSession, dict(queries.dtypes)[key]
    shared = spark.sparkContext.broadcast(list(trees))
    batches, turns = -(-len(trees) // BATCH_TREES), max(1, -(-queries.count() // BATCH_QUERIES))
    codes = _spread_codes(spark, batches * turns)
    place = {c: i for i, c in enumerate(codes)}
    every = F.explode(F.array(*[F.lit(c) for c in codes])).alias("code")
    held = _pack(table.select(x, y, F.lit(0).alias("turn")), x, y, "array<array<double>>").select("*", every)
    asked = _pack(queries.select(key, x, F.pmod(F.xxhash64(key), F.lit(turns)).cast("int").alias("turn")), x, key, f"array<{kind}>")
    mine = F.array(*[F.array(*[F.lit(c) for c in codes[t::turns]]) for t in range(turns)])
    asked = asked.select("*", F.explode(F.element_at(mine, F.col("turn") + 1)).alias("code"))

    def meet(t: pa.Table, q: pa.Table) -> pa.Table:
        keys, ensembles, means = [q["rest"].combine_chunks().flatten()[:0]], [np.empty(0, np.int32)], [np.empty((0, targets))]
        if len(t) and len(q):
            xs, ys = _unpack(t, columns)
            qs, asks = _unpack(q, columns)
            ys, qs = np.ascontiguousarray(ys.flatten().to_numpy().reshape(-1, targets).T), np.ascontiguousarray(qs.T)
            first = place[q["code"][0].as_py()] // turns * BATCH_TREES
            sums: dict[int, np.ndarray] = {}
            for tree in shared.value[first : first + BATCH_TREES]:
                found = finish_columns(tree, 1, xs, ys, qs)
                sums[tree.ensemble] = sums[tree.ensemble] + found if tree.ensemble in sums else found
            for e, p in sums.items():
                keys.append(asks)
                ensembles.append(np.full(len(p), e, np.int32))
                means.append(p)
        p = np.concatenate(means)
        p = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * targets), pa.array(p.ravel()))
        return pa.table({key: pa.concat_arrays(keys), "ensemble": np.concatenate(ensembles), "p": p})

    sides = [d.repartition(len(codes), "code").groupBy("code") for d in (held, asked)]
    met = sides[0].cogroup(sides[1]).applyInArrow(meet, f"`{key}` {kind}, ensemble int, p array<double>")
    return staged(met.groupBy(key, "ensemble").agg(*[F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(targets)]), "forest")


def extra_trees(train: DataFrame, queries: DataFrame, key: str, x: str, y: str, forests: Sequence[dict], seeds: Sequence[int], local_rows: int | None = None) -> DataFrame:
    """(key, forest, prediction, spread) of every query for each forest: the mean over seeds of the ensembles' predictions, and the
    population deviation over seeds averaged over targets.

    A forest is ``trees``, ``depth``, ``leaf`` (least rows of a leaf) and ``features``, the share of columns that a
    node tries or "sqrt". ``x`` and ``y`` are arrays of one length each, complete and finite (M01 before), keys of queries
    unique. Without training rows there is no prediction and the result is empty. Repeated rows count each.
    Equal gains go to the first feature of the node's order; gains that differ by rounding alone may fall either way.
    """
    table = staged(train.select(F.col(x).cast("array<double>").alias(x), F.col(y).cast("array<double>").alias(y)).repartition(train.sparkSession.sparkContext.defaultParallelism), "forest-rows")
    queries = queries.select(key, F.col(x).cast("array<double>").alias(x))
    size = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(x)).alias("columns"), F.max(F.size(y)).alias("targets")).first()
    kind = dict(queries.dtypes)[key]
    if not size["n"]:
        return train.sparkSession.createDataFrame([], f"`{key}` {kind}, forest int, prediction array<double>, spread double")
    n, columns, targets = size["n"], size["columns"], size["targets"]
    tries = lambda f: max(1, int(columns**0.5 if f == "sqrt" else f * columns))
    trees = [
        Tree(s, number, int(f["depth"]), tries(f["features"]), int(f["leaf"]), i * len(seeds) + j)
        for i, f in enumerate(forests)
        for j, s in enumerate(seeds)
        for number in range(int(f["trees"]))
    ]
    whole_rows, local_rows = (max(1, v // (columns + targets)) if local_rows is None else local_rows for v in (WHOLE_VALUES, LOCAL_VALUES))
    step = int(min(MOST_TREES, max(8, BLOCK_VALUES // (n * (columns + targets)))))
    blocks = [_batch_sums(table, queries, key, x, y, columns, targets, trees)] if n <= whole_rows else [_block_sums(table, queries, key, x, y, n, columns, targets, trees[i : i + step], local_rows) for i in range(0, len(trees), step)]
    sums = reduce(DataFrame.union, blocks).groupBy(key, "ensemble").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(targets)])
    forest = F.floor(F.col("ensemble") / len(seeds)).cast("int")
    many = F.element_at(F.array(*[F.lit(float(f["trees"])) for f in forests]), forest + 1)
    means = sums.select(key, forest.alias("forest"), *[(F.col(f"s{k}") / many).alias(f"s{k}") for k in range(targets)])
    spread = reduce(lambda a, b: a + b, [F.stddev_pop(f"s{k}") for k in range(targets)]) / targets
    return means.groupBy(key, "forest").agg(F.array(*[F.avg(f"s{k}") for k in range(targets)]).alias("prediction"), spread.alias("spread"))
