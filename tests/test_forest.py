"""The level-wise forest against trees grown one node at a time."""

import numpy as np
import pytest

from visitloom.operators import forest as W
from visitloom.operators import models as L


def one_tree(tree, x, y, asked, node=1, level=0):
    """Plain recursion with the same drawing rule; the first of equally good cuts, looked for by squared errors."""
    out = np.empty((len(asked), y.shape[1]))
    out[:] = y.mean(0)
    if level >= tree.depth:
        return out
    columns = sorted(range(x.shape[1]), key=lambda j: float(W.uniform(tree, np.int64(node), np.int64(j), 1)))
    best = None
    for j in [j for j in columns if x[:, j].max() > x[:, j].min()][: tree.tries]:
        lo, hi = x[:, j].min(), x[:, j].max()
        cut = lo + float(W.uniform(tree, np.int64(node), np.int64(j), 2)) * (hi - lo)
        left = x[:, j] <= (lo if cut >= hi else cut)
        if min(left.sum(), (~left).sum()) < tree.leaf:
            continue
        error = sum(((part - part.mean(0)) ** 2).sum() for part in (y[left], y[~left]))
        if best is None or error < best[0] - 1e-9:
            best = (error, j, left, lo if cut >= hi else cut)
    if best is None:
        return out
    _, j, left, cut = best
    go = asked[:, j] <= cut
    out[go] = one_tree(tree, x[left], y[left], asked[go], 2 * node, level + 1)
    out[~go] = one_tree(tree, x[~left], y[~left], asked[~go], 2 * node + 1, level + 1)
    return out


FORESTS = [{"trees": 3, "depth": 6, "features": 0.5, "leaf": 3}, {"trees": 2, "depth": 4, "features": "sqrt", "leaf": 2}]
SEEDS = (11, 12)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(260, 5)), 3)
    x[:, 3] = 1.0  # constant
    x[150:190] = x[150]  # repeated rows
    y = np.round(np.c_[8 * x[:, 0] + 4 * x[:, 1], rng.normal(size=260) * 5])
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist(), str(i % 7), "z") for i in range(260)], "i long, x array<double>, y array<double>, p string, code string").repartition(3)
    return x, y, df


@pytest.mark.parametrize("local_rows", [1, 60, 10_000])
def test_trees_one_node_at_a_time(spark, data, local_rows, monkeypatch):
    x, y, df = data
    monkeypatch.setattr(W, "CHUNK_VALUES", 50)  # several chunks a level
    monkeypatch.setattr(W, "QUERY_ROWS", 25)  # queries of a node in several turns
    monkeypatch.setattr(W, "BLOCK_VALUES", 8 * 200 * 7)  # blocks of eight trees
    got = {(r["i"], r["forest"]): r for r in W.extra_trees(df.filter("i < 200"), df.filter("i >= 180"), "i", "x", "y", FORESTS, SEEDS, local_rows).collect()}
    assert len(got) == 80 * 2
    for f, spec in enumerate(FORESTS):
        tries = 2
        per = [np.mean([one_tree(W.Tree(s, t, spec["depth"], tries, spec["leaf"], 0), x[:200], y[:200], x[180:]) for t in range(spec["trees"])], axis=0) for s in SEEDS]
        for i in range(80):
            r = got[180 + i, f]
            assert np.allclose(r["prediction"], np.mean(per, axis=0)[i])
            assert r["spread"] == pytest.approx(np.std(per, axis=0)[i].mean(), abs=1e-9)


def test_no_task_holds_more_than_the_bound(spark, data, monkeypatch):
    x, y, df = data
    tree = W.Tree(5, 0, 12, 2, 2, 0)
    tops = W.grow_tops(df.select("x", "y"), "x", "y", 260, 5, 2, [tree], 30)
    at = tops[0].descend(x)
    nodes, sizes = np.unique(at[tops[0].leaf_of(at) < 0], return_counts=True)
    assert len(nodes) > 3 and sizes.max() <= 30
    for leaf, mean in zip(tops[0].leaves, tops[0].means, strict=True):
        assert (at == leaf).sum() >= 2 and np.allclose(y[at == leaf].mean(0), mean)


def test_empty_and_tiny_tables(spark, data):
    _, y, df = data
    one = [{"trees": 2, "depth": 3, "features": 1.0, "leaf": 1}]
    assert W.extra_trees(df.filter("i < 0"), df, "i", "x", "y", one, SEEDS).count() == 0
    assert W.extra_trees(df, df.filter("i < 0"), "i", "x", "y", one, SEEDS).count() == 0
    for local_rows in (0, 5):
        rows = W.extra_trees(df.filter("i = 7"), df.filter("i < 3"), "i", "x", "y", one, SEEDS, local_rows).collect()
        assert len(rows) == 3 and all(np.allclose(r["prediction"], y[7]) and r["spread"] == 0 for r in rows)
    same = W.extra_trees(df.filter("i between 150 and 189"), df.filter("i < 3"), "i", "x", "y", one, SEEDS, 5).collect()
    assert all(np.allclose(r["prediction"], y[150:190].mean(0)) for r in same)  # nothing to cut


def test_forest_learns_and_joins_the_grid(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 6))
    y = np.c_[np.sin(2 * x[:, 0]) + x[:, 1], x[:, 2] * 2]
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist(), str(i % 9)) for i in range(600)], "i long, x array<double>, y array<double>, p string")
    small = {"model": "extra_trees", "trees": 8, "depth": 14, "features": 0.6, "leaf": 2, "configuration_order": 100, "configuration_id": "f"}
    want = [L.grid()[0], small]
    train, rest = df.filter("i < 450"), df.filter("i >= 450")
    got = {r["model"]: r for r in L.run_grid(train, rest, "x", "y", "p", want, key="i", local_rows=100).collect()}
    assert got["extra_trees"]["participant_macro_rmse"] < 0.6 * got["mean"]["participant_macro_rmse"]
    p = {r["i"]: r["prediction"] for r in W.extra_trees(train, rest, "i", "x", "y", [small], L.FOREST_SEEDS).collect()}
    e = [(((np.array(p[i]) - y[i]) ** 2).mean(), i % 9) for i in range(450, 600)]
    rmse = np.mean([np.sqrt(np.mean([s for s, w in e if w == v])) for v in range(9)])
    assert got["extra_trees"]["participant_macro_rmse"] == pytest.approx(rmse)
    pca = L.PCA.fit(train, "y", 0.999)
    assert L.run_grid(train, rest, "x", "y", "p", [small], pca=pca, key="i").first()["participant_macro_rmse"] == pytest.approx(rmse, rel=0.3)


def test_whole_trees_share_rows_by_batches(spark, monkeypatch):
    """Trees that are finished whole meet one copy of the rows for each batch; batches, turns of queries and the level by level way give the same."""
    r = np.random.default_rng(7)
    x = r.normal(size=(120, 5))
    df = spark.createDataFrame([(i, x[i].tolist(), [float(x[i, 0] + x[i, 1] ** 2), float(i % 3)]) for i in range(120)], "i int, x array<double>, y array<double>")
    train, rest = df.filter("i < 90"), df.filter("i >= 80")
    forests = [{"trees": 5, "depth": 6, "features": 0.6, "leaf": 2}, {"trees": 4, "depth": 8, "features": "sqrt", "leaf": 1}]
    monkeypatch.setattr(W, "BATCH_TREES", 4)
    monkeypatch.setattr(W, "BATCH_QUERIES", 15)
    met = []
    monkeypatch.setattr(W, "_batch_sums", lambda *a, of=W._batch_sums: met.append(len(a[-1])) or of(*a))
    got = [{(g["i"], g["forest"]): [*g["prediction"], g["spread"]] for g in W.extra_trees(train, rest, "i", "x", "y", forests, [1, 2], n).collect()} for n in (None, 20)]
    assert met == [18] and set(got[0]) == set(got[1]) and len(got[0]) == 80
    assert all(np.allclose(got[0][k], got[1][k], rtol=1e-9, atol=1e-12) for k in got[0])


def test_trees_of_blocks_side_by_side(monkeypatch):
    """Nodes cut one by one, copied side by side and cut level by level give one tree; single precision cuts the same rows as double."""
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 6)).astype(np.float32)
    x[:, 2], x[::2, 4], x[100:140] = 1, 0, x[100]  # constant, often constant, repeated rows
    y = np.c_[np.round(4 * x[:, 0].astype(float)), np.arange(400) % 3]
    columns, ys, asked = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), x[::3]
    for tree in (W.Tree(1, 0, 9, 3, 2, 0), W.Tree(1, 1, 4, 6, 1, 0), W.Tree(2, 0, 12, 1, 5, 0)):
        want = one_tree(tree, x.astype(float), y, asked.astype(float))
        for grow, node in ((32_768, 64), (32_768, 0), (150, 20), (30, 30), (0, 0), (32_768, 32_768)):
            monkeypatch.setattr(W, "GROW_ROWS", max(1, grow))
            monkeypatch.setattr(W, "NODE_ROWS", node)
            for kind in (np.float32, np.float64):
                assert np.allclose(W.finish_columns(tree, 1, columns.astype(kind), ys, asked), want)
    cut = r.normal(size=1000)
    for v in (W.below(cut, np.dtype(np.float32)),):
        assert (v <= cut).all() and (np.nextafter(v, np.float32(np.inf)) > cut).all()


def test_batches_of_trees_have_tasks_of_their_own(spark):
    codes = W._spread_codes(spark, 122)
    parts = spark.createDataFrame([(c,) for c in codes], "code int").repartition(122, "code").selectExpr("spark_partition_id() AS p").distinct().count()
    assert len(set(codes)) == 122 == parts


def test_whole_trees_are_not_copied_for_each_tree(spark, data, monkeypatch):
    """A table beyond ``LOCAL_VALUES`` still meets its trees in batches, as blocks of bytes."""
    x, y, df = data
    monkeypatch.setattr(W, "LOCAL_VALUES", 7 * 50)
    monkeypatch.setattr(W, "_block_sums", None)
    got = {(r["i"], r["forest"]): r["prediction"] for r in W.extra_trees(df.filter("i < 200"), df.filter("i >= 180"), "i", "x", "y", FORESTS, SEEDS).collect()}
    want = np.mean([one_tree(W.Tree(s, t, 4, 2, 2, 0), x[:200], y[:200], x[180:]) for s in SEEDS for t in range(2)], axis=0)
    assert len(got) == 160 and all(np.allclose(got[180 + i, 1], want[i]) for i in range(80))
