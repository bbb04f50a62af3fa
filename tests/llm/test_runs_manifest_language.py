"""Periodic runs, the Merkle manifest and language ID against brute force, SQL and held-out labels, and on awkward rows."""

import hashlib
import itertools
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus_operators import awkward, empty
from visitloom.llm import language, merkle, periods, queries
from visitloom.llm.common import table


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# --- 13: periodic runs ---


def runs_by_comparison(w, least=24, repeats=3):
    """Every period is tried at every place."""
    w, out = np.unique(np.array(w, object), return_inverse=True)[1], []
    for q in range(1, len(w) // repeats + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], w[q:] == w[:-q], [False]]).astype(int)))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if j + q - i >= max(least, repeats * q) and not any((w[i : j + q - p] == w[i + p : j + q]).all() for p in range(1, q)):
                out.append((i, j + q - i, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of_document(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_comparison(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *head, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept))


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_all_documents(spark, small):
    want = sorted(runs_of_document(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect())
    got = sorted(tuple(r) for r in queries.op13_basic_factors(spark, small).select(RUN_COLUMNS).collect())
    assert got == want
    assert sum(r[1] > 0 for r in got) > 10


@pytest.mark.parametrize("least", [6, 9, 24])
def test_runs_of_random_words(least):
    rng = np.random.default_rng(least)
    for _ in range(150):
        docs = []
        for _ in range(4):
            n = int(rng.integers(0, 130))
            w = rng.integers(0, int(rng.integers(1, 4)), n)
            if rng.random() < 0.7 and n:
                a = int(rng.integers(0, n))
                w[a:] = w[a + np.arange(n - a) % (1 + int(rng.integers(0, max(1, (n - a) // 3))))]
            docs.append(w.tolist())
        ends = np.cumsum([len(d) for d in docs])
        want = [(int(e) - len(d) + s, length, q) for d, e in zip(docs, ends, strict=True) for s, length, q in runs_by_comparison(d, least)]
        assert [tuple(r) for r in periods.periodic_runs(np.array(sum(docs, []), np.int64), ends, least).tolist()] == want
    with pytest.raises(ValueError):
        periods.periodic_runs(np.zeros(3, np.int64), np.array([3]), 24, 2)


def test_runs_awkward(spark):
    rows = [(r["doc_id"], r["text"]) for r in awkward(spark).collect()]
    more = [(11, "a b " * 12), (12, "a b " * 11 + "a"), (13, " \t" + "x\x0b" * 24), (14, "a b " * 30), (15, "x" * 100_000), (16, "a " * 23), (None, "c " * 40)]
    docs = spark.createDataFrame(more, "doc_id long, text string").unionByName(awkward(spark), allowMissingColumns=True).withColumnRenamed("spans", "runs")
    key = lambda r: repr(r)
    got = sorted((tuple(r) for r in periods.op13_runs(spark, docs).select(RUN_COLUMNS).collect()), key=key)
    assert got == sorted((runs_of_document(*r) for r in rows + more), key=key)
    assert periods.op13_runs(spark, empty(spark)).count() == 0


# --- 12: Merkle manifest ---


def manifest_by_levels(rows):
    """Tree by tree and level by level; rows of (doc_id, source, lang, n_chars, text)."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

    def tree(digests):
        """Root and the siblings of every leaf, level by level."""
        levels = [digests]
        while len(levels[-1]) > 1:
            x = levels[-1]
            levels.append([sha("".join(x[i : i + 16])) for i in range(0, len(x), 16)])
        proofs = []
        for i in range(len(digests)):
            proof = []
            for level in levels[:-1]:
                first = i // 16 * 16
                proof.append((level[first:i], level[i + 1 : first + 16]))
                i //= 16
            proofs.append(proof)
        return levels[-1][0], proofs

    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((r[0], sha("".join(map(enc, r))), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in sources[s]])
    root, above = tree([trees[s][0] for s in names]) if names else (None, [])
    out = []
    for s, top in zip(names, above, strict=True):
        for (doc_id, leaf, r), own in zip(sources[s], trees[s][1], strict=True):
            proof = own + top
            at = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and r[4] is not None:
                at = sha("".join(map(enc, (*r[:4], r[4].translate(lower)))))
            for a, b in proof:
                at = sha("".join(a) + at + "".join(b))
            out.append((doc_id, leaf, trees[s][0], root, sha("".join("".join(a + b) for a, b in proof)), at, at == root))
    return sorted(out, key=repr)


MANIFEST_COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_of(spark, docs):
    return sorted((tuple(r) for r in merkle.op12_manifest(spark, docs).select(MANIFEST_COLUMNS).collect()), key=repr)


def test_manifest_equals_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, small).select(MANIFEST_COLUMNS).collect()), key=repr)
    rel = con.sql(queries.SQL["op12_merkle_manifest"])
    at = [rel.columns.index(c) for c in MANIFEST_COLUMNS]
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    rows = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got == manifest_by_levels(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [1, 1, 1], [16, 17, 1], [256, 257], [5000, 300, *[1] * 40]])
def test_manifest_of_sizes(spark, sizes):
    """Trees of one leaf, whole runs, last runs of one node, several rounds."""
    rows = [(1000 * s + i, None if s == 1 else f"s{s}", "en", i, f"Text {i}") for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest_of(spark, docs) == manifest_by_levels(rows)


def test_manifest_awkward(spark):
    docs = awkward(spark).unionByName(awkward(spark)).withColumnRenamed("kept", "place").withColumnRenamed("spans", "digest")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert manifest_of(spark, docs) == manifest_by_levels(rows)
    assert merkle.op12_manifest(spark, empty(spark)).count() == 0


def test_manifest_sweeps_keep_label_order():
    digests = [sha(str(i)) for i in range(37)]
    levels = merkle.sweep_up(digests, 2)
    assert [len(x) for x in levels] == [37, 3, 1]
    for d, proof in zip(digests, merkle.sweep_down(levels, [("a", "b")]), strict=True):
        assert len(proof) == 3 and proof[-1] == ("a", "b")
        for before, after in proof[:-1]:
            d = sha(before + d + after)
        assert d == levels[2][0]


# --- 11: language of words and documents ---


@pytest.mark.parametrize("k", [1, 2, 3])
def test_marginals_against_all_labellings(k):
    rng = np.random.default_rng(k)
    sizes = [1, 2, 5, 7]
    score, trans, start = rng.normal(0, 2, (sum(sizes), k)), rng.normal(0, 2, (k, k)), rng.normal(0, 2, k)
    ends = np.cumsum(sizes)
    got, pairs = language.marginals(score, ends, trans, start, pairs=True)
    want_pairs = np.zeros((k, k))
    for n, end in zip(sizes, ends.tolist(), strict=True):
        e, gamma, xi, total = score[end - n : end], np.zeros((n, k)), np.zeros((k, k)), 0.0
        for y in itertools.product(range(k), repeat=n):
            p = np.exp(start[y[0]] + sum(e[i][y[i]] for i in range(n)) + sum(trans[a][b] for a, b in itertools.pairwise(y)))
            total += p
            for i, a in enumerate(y):
                gamma[i][a] += p
            for a, b in itertools.pairwise(y):
                xi[a][b] += p
        assert np.allclose(got[end - n : end], gamma / total)
        want_pairs += xi / total
    assert np.allclose(pairs, want_pairs)


def test_marginals_of_long_chains():
    """Chains of many pieces give what one pass over all their words gives."""
    rng = np.random.default_rng(5)
    sizes, k = [1000, 32, 33, 1, 64, 700], 4
    score, trans, start = rng.normal(0, 3, (sum(sizes), k)), rng.normal(0, 2, (k, k)), rng.normal(0, 2, k)
    got = language.marginals(score, np.cumsum(sizes), trans, start)[0]
    t, at = np.exp(trans), 0
    for n in sizes:
        e = np.exp(score[at : at + n] - score[at : at + n].max(1, keepdims=True))
        a, b = np.empty((n, k)), np.ones((n, k))
        a[0] = np.exp(start) * e[0]
        for i in range(1, n):
            a[i] = a[i - 1] @ t * e[i]
            a[i] /= a[i].sum()
        for i in range(n - 2, -1, -1):
            b[i] = t @ (e[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        g = a * b
        assert np.allclose(got[at : at + n], g / g.sum(1, keepdims=True))
        at += n


def test_language_of_held_out_documents(spark, medium):
    docs = table(spark, medium, "documents")
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    rows = queries.op11_crf_language(spark, medium).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    hits = {}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if r["held_out"]:
            hits.setdefault(truth[r["doc_id"]][0], []).append(r["lang_pred"] == truth[r["doc_id"]][0])
    assert len(hits) == 4 and all(np.mean(h) >= 0.97 for h in hits.values())


def test_language_of_switching_text(spark, medium):
    """Two halves of different languages: nearly all words get the language of their half."""
    docs = table(spark, medium, "documents").filter(~language.held_out(F.col("doc_id")))
    model = language.learn(docs)
    assert (np.diag(model.trans) > model.trans - np.eye(4) * 99).all()  # to stay is likelier than to switch
    held = table(spark, medium, "documents").filter(language.held_out(F.col("doc_id"))).filter("n_chars BETWEEN 300 AND 3000")
    by = {}
    for r in held.orderBy("doc_id").collect():
        by.setdefault(r["lang"], []).append(" ".join(language.words_of(pa.array([r["text"]]))[0].to_pylist()[:40]))
    right = []
    for a, b in itertools.permutations(sorted(by), 2):
        for x, y in zip(by[a][:8], by[b][8:16], strict=False):
            got = [label for _, label, _ in language.label_words(model, f"{x} {y}")]
            right += [g == w for g, w in zip(got, [a] * len(x.split()) + [b] * len(y.split()), strict=True)]
    assert np.mean(right) >= 0.9


def test_language_awkward(spark):
    docs = awkward(spark).withColumnRenamed("kept", "score").withColumnRenamed("spans", "held_out")
    rows = language.op11_language(spark, docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert by[3] == by[4] == by[6] == ("und", 0.0) and by[1][0] in ("en", "fr")
    one = [(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] == 2]
    assert one[0] == one[1]
    assert language.op11_language(spark, empty(spark)).count() == 0
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.op11_language(spark, unknown).collect()} == {"und"}
