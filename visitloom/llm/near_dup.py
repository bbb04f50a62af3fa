"""N-gram Jaccard self-join by MinHash banding, every link verified on full n-gram sets.

1. One scan gives each document the digest of its words and one hash per band of its MinHash
   signature; rows and bands are chosen for a target recall. Equal word sequences become one class.
2. Band hashes are shuffled. Buckets of several classes are the candidates; buckets of equal
   membership in several bands are kept once.
3. Buckets that share classes are joined into candidate clusters (connected components). A cluster
   of up to ``unit`` classes and ``unit_bytes`` is verified in one task: every n-gram set is shipped once and all pairs
   are compared by a product of incidence matrices. A larger cluster is verified bucket by bucket,
   a larger bucket by pairs of tiles; a pair that meets in several buckets counts in its first band.
   Pairs never become rows: tasks return link counts and spanning links.
4. Classes joined by links form groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm.common import as_text, connected_components, materialize, only, slices, text_key

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
SEED = 20_240_229


def choose_bands(threshold: float, recall: float, most_hashes: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows per band with which a pair at the threshold is found with the target recall."""
    best = None
    for rows in range(1, 33):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("the recall cannot be reached with so few hashes")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and start bytes of the space-separated words of a byte array."""
    letter = data != 32
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.empty(0, np.uint64), begin
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(_STEP, len(data)), out=total[1:])
    back = _powers(_INVERSE, len(data))
    return _mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64)), begin


def shingle_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams of normalised texts (with repeats), and each text's first index; a shorter text is one n-gram."""
    joined = b"\n".join(texts).replace(b"\n", b" \n ") if texts else b""
    data = np.frombuffer(joined, np.uint8)
    hashes, begin = word_hashes(data)
    mark = data[begin] == 10 if len(begin) else np.empty(0, bool)
    doc = np.cumsum(mark)[~mark]
    hashes = hashes[~mark]
    counts = np.bincount(doc, minlength=len(texts))
    first_word = np.cumsum(counts) - counts
    grams = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    first = np.cumsum(grams) - grams
    out = np.empty(int(grams.sum()), np.uint64)
    if len(hashes) >= words:
        n = len(hashes) - words + 1
        acc = np.zeros(n, np.uint64)
        for j in range(words):
            acc = acc * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + n]
        acc = _mix(acc)
    else:
        acc = np.empty(0, np.uint64)
    full = counts >= words
    if full.any():
        at = np.repeat(first_word[full] - (np.cumsum(grams[full]) - grams[full]), grams[full]) + np.arange(int(grams[full].sum()))
        to = np.repeat(first[full] - (np.cumsum(grams[full]) - grams[full]), grams[full]) + np.arange(int(grams[full].sum()))
        out[to] = acc[at]
    for d in np.flatnonzero((counts > 0) & ~full):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in hashes[first_word[d] : first_word[d] + counts[d]]:
                h = h * np.uint64(0x9FB21C651E98DF25) + x + np.uint64(1)
        out[first[d]] = _mix(np.array([h], np.uint64))[0]
    return out, first


def _blocks(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def normalised(col: str = "text"):
    """Lower case words of letters, marks and digits, one space between them."""
    return F.trim(F.regexp_replace(F.lower(as_text(col)), r"[^\p{L}\p{M}\p{N}]+", " "))


def _signatures(words: int, bands: int, rows: int):
    coeff = np.random.default_rng(SEED).integers(1, 1 << 63, (bands * rows, 2), dtype=np.uint64)
    coeff[:, 0] = coeff[:, 0] * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.encode() for t in batch.column(3).to_pylist()]
            parts = []
            for lo, hi in _blocks(texts):
                grams, first = shingle_hashes(texts[lo:hi], words)
                out = np.zeros((hi - lo, bands), np.uint64)
                live = np.flatnonzero(np.diff(np.append(first, len(grams))) > 0)
                if len(live):
                    at = first[live]
                    for b in range(bands):
                        acc = np.full(len(live), b + 1, np.uint64)
                        for r in range(rows):
                            a, c = coeff[b * rows + r]
                            v = grams * a + c
                            v ^= v >> np.uint64(32)
                            acc = _mix(acc * _STEP + np.minimum.reduceat(v * a, at))
                        out[live, b] = acc
                parts.append(out)
            sig = np.concatenate(parts) if parts else np.zeros((0, bands), np.uint64)
            flat = pa.array(sig.reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, bands, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([bool(t) for t in texts]), lists], names=["doc_id", "key", "digest", "worded", "bands"])

    return run


def jaccard_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, threshold: float) -> np.ndarray:
    """Boolean matrix: set i of ``left`` and set j of ``right`` (or of ``left``) have at least the threshold.

    Only n-grams that several sets hold matter; they are counted in blocks of columns.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    del order
    new = np.append(True, flat[1:] != flat[:-1]) if len(flat) else np.empty(0, bool)
    shared = ~(new & np.append(new[1:], True)) if len(flat) else new
    del flat
    owner, col = owner[shared], np.cumsum(new[shared]) - 1
    other = left if right is None else right
    inter = np.zeros((len(left), len(other)), np.float32)
    row_l = np.full(n, -1)
    row_l[left] = np.arange(len(left))
    row_r = np.full(n, -1)
    row_r[other] = np.arange(len(other))
    width = max(64, (4 << 20) // max(1, len(left) + len(other)))
    bounds = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + width, width))
    for k in range(len(bounds) - 1):
        o, c = owner[bounds[k] : bounds[k + 1]], col[bounds[k] : bounds[k + 1]] - k * width
        if not len(o):
            continue
        a = np.zeros((len(left), width), np.float32)
        m = row_l[o] >= 0
        a[row_l[o[m]], c[m]] = 1
        if right is None:
            b = a
        else:
            b = np.zeros((len(other), width), np.float32)
            m = row_r[o] >= 0
            b[row_r[o[m]], c[m]] = 1
        inter += a @ b.T
    out = np.empty(inter.shape, bool)
    for lo in range(0, len(left), 256):
        both = inter[lo : lo + 256].astype(np.float64)
        union = size[left[lo : lo + 256]][:, None] + size[other][None, :] - both
        out[lo : lo + 256] = (both > 0) & (both >= threshold * union - 1e-9)
    return out


def component_lows(links: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of the component of each row and of each column, a true cell joining its row and its column; own id without links."""
    low_r, low_c = rows.copy(), cols.copy()
    todo_r, todo_c = links.any(1), np.ones(len(cols), bool)
    while todo_r.any():
        front = np.array([np.argmax(todo_r)])
        todo_r[front] = False
        in_r, in_c = [front], []
        while len(front):
            reached = np.flatnonzero(links[front].any(0) & todo_c)
            todo_c[reached] = False
            front = np.flatnonzero(links[:, reached].any(1) & todo_r)
            todo_r[front] = False
            in_r.append(front)
            in_c.append(reached)
        at_r, at_c = np.concatenate(in_r), np.concatenate(in_c)
        low_r[at_r] = low_c[at_c] = min(rows[at_r].min(), cols[at_c].min())
    return low_r, low_c


def _verify(threshold: float, by_bucket: bool):
    """A unit's classes -> (rep, links, low): links counts documents, copies of the linked class included; low is the smallest rep of the unit's component of links.

    The edges (rep, low) span the unit's links, so no link is lost to the groups.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable").reset_index(drop=True)
        sets = [np.frombuffer(b, np.uint64) for b in pdf["grams"]]
        reps, copies, side = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["side"].to_numpy()
        tiled = by_bucket and pdf["i"].iloc[0] != pdf["j"].iloc[0]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if tiled else None
        if tiled and not (len(left) and len(right)):  # one tile of the pair is empty
            return pd.DataFrame({"rep": reps[:0], "links": reps[:0], "low": reps[:0]})
        links = jaccard_links(sets, left, right, threshold)
        if by_bucket:
            bands = np.stack(pdf["bands"].to_list())
            band = int(pdf["band"].iloc[0])
            other = left if right is None else right
            for b in range(band):
                links &= bands[left, b][:, None] != bands[other, b][None, :]
        out = []
        if right is None:
            np.fill_diagonal(links, True)  # a class is its own row and column
            low, _ = component_lows(links, reps[left], reps[left])
            np.fill_diagonal(links, False)
            rows = [(left, links, left, low)]
        else:
            low_l, low_r = component_lows(links, reps[left], reps[right])
            rows = [(left, links, right, low_l), (right, links.T, left, low_r)]
        for own, m, other, low in rows:
            live = m.any(1)
            weight = copies[other].astype(np.float64)
            n = np.concatenate([m[lo : lo + 256] @ weight for lo in range(0, max(1, len(m)), 256)])
            out.append(pd.DataFrame({"rep": reps[own][live], "links": n[live].astype(np.int64), "low": low[live]}))
        return pd.concat(out)

    return run


def _gram_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            sets = []
            for lo, hi in _blocks(texts):
                grams, first = shingle_hashes(texts[lo:hi], words)
                ends = np.append(first, len(grams))
                sets += [np.unique(grams[ends[i] : ends[i + 1]]).tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "grams"])

    return run


def near_duplicate_rows(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, unit: int = 2000, unit_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``near_duplicates`` with two more columns: key (``text_key`` of the text) and kept (the row stays for its group).

    Rows are told by (doc_id, key), classes by a number of their own, so that several texts under
    one id, or without an id, are rows like others.
    """
    bands, rows = choose_bands(threshold, recall)
    base = only(docs, "doc_id", "text").select("doc_id", text_key().alias("key"), normalised().alias("norm"))
    base = base.select("doc_id", "key", F.sha2(F.col("norm").cast("binary"), 256).alias("digest"), "norm")
    sig = materialize(base.mapInArrow(_signatures(words, bands, rows), "doc_id long, key binary, digest string, worded boolean, bands array<long>"), "signatures")
    worded = sig.filter("worded")
    top = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("top")
    classes = worded.groupBy("digest").agg(top, F.count(F.lit(1)).alias("copies"))
    # The number is written with the class, so it stays what it is when executors are lost.
    classes = materialize(classes.select("digest", F.monotonically_increasing_id().alias("rep"), F.col("top.doc_id").alias("first"), F.col("top.key").alias("first_key"), "copies"), "classes")
    members = sig.select("doc_id", "key", "digest", "worded").join(classes, "digest", "left")
    members = materialize(members.select("doc_id", "key", "worded", "rep", "first", "first_key", "copies"), "members")

    repeated = not sig.groupBy("doc_id", "key").count().filter("count > 1").isEmpty()

    def first_rows(df: DataFrame, of: DataFrame) -> DataFrame:
        """The first row of each class of ``of``; rows repeated whole, where there are such, give one."""
        c = of.select("rep", "first", "first_key", "copies")
        out = df.join(c, (df["key"] == c["first_key"]) & df["doc_id"].eqNullSafe(c["first"]))
        return out.dropDuplicates(["rep"]) if repeated else out

    reps = materialize(first_rows(worded, classes).select("rep", "copies", "bands"), "reps")
    posts = reps.select("rep", F.posexplode("bands").alias("band", "h")).select("rep", "band", F.xxhash64("band", "h").alias("bucket"))
    buckets = posts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("rep").alias("low"), F.min("band").alias("band"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("print")
    ).filter("n > 1")
    kept = buckets.groupBy("n", "low", "print").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.bucket", "b.band", "low")
    kept = materialize(kept, "buckets")
    seats = materialize(posts.drop("band").join(kept, "bucket").select("rep", "bucket", "band", "low"), "seats")
    cluster = connected_components(seats.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    placed = materialize(cluster.select(F.col("node").alias("rep"), "component"), "clusters")
    texts = first_rows(base, classes.join(placed.select("rep"), "rep", "left_semi"))
    grams = texts.select("rep", "norm").mapInArrow(_gram_sets(words), "rep long, grams binary")
    data = materialize(grams.join(placed, "rep").join(reps, "rep"), "grams")
    weight = data.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum(F.octet_length("grams")).alias("bytes"))
    above = materialize(weight.filter((F.col("members") > unit) | (F.col("bytes") > unit_bytes)).select("component"), "large-clusters")
    out_schema = "rep long, links long, low long"
    small = data.join(above, "component", "left_anti").select("component", "rep", "copies", "grams", F.lit(0).alias("side"))
    links = small.groupBy("component").applyInPandas(_verify(threshold, False), out_schema)
    if not above.isEmpty():
        links = links.union(_verify_buckets(data.join(above, "component", "left_semi"), seats, threshold, unit, unit_bytes, out_schema))
    links = materialize(links, "links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(links.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    placed = groups.select(F.col("node").alias("rep"), "component")
    heads = placed.join(classes.select("rep", "first", "first_key"), "rep").groupBy("component").agg(F.min(F.struct(F.col("first").isNull(), "first", "first_key")).alias("head"))
    per_rep = counts.join(placed, "rep").join(heads, "component").select(F.col("rep").alias("r"), "links", F.struct("head.first", "head.first_key").alias("head"))
    head = F.coalesce("head", F.when(F.col("worded"), F.struct("first", "first_key")), F.struct(F.col("doc_id").alias("first"), F.col("key").alias("first_key")))
    joined = members.join(per_rep, members["rep"] == per_rep["r"], "left").withColumn("head", head)
    return joined.select(
        "doc_id",
        F.col("head.first").alias("class_id"),
        F.when(F.col("worded"), F.col("first")).otherwise(F.col("doc_id")).alias("rep_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        "key",
        (F.col("doc_id").eqNullSafe(F.col("head.first")) & (F.col("key") == F.col("head.first_key"))).alias("kept"),
    )


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, unit: int = 2000, unit_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its group), rep_id (smallest doc_id of its equal word sequences), n_links.

    ``n_links`` counts the other documents whose n-gram sets have a Jaccard similarity of at least
    ``threshold``, copies included. A document with fewer than ``words`` words has its whole word
    sequence as its only n-gram; one without words (null, empty or punctuation alone) has no links
    and is a group of its own. Rows without an id take part: a group without any id has the class_id
    null. Rows repeated whole count as copies. Extra columns are ignored.
    """
    return near_duplicate_rows(docs, words, threshold, recall, unit, unit_bytes).drop("key", "kept")


def _verify_buckets(large: DataFrame, seats: DataFrame, threshold: float, unit: int, unit_bytes: int, schema: str) -> DataFrame:
    """Clusters above ``unit`` classes: bucket by bucket, in tiles of at most ``unit`` classes and pairs of tiles."""
    rows = large.select("rep", "copies", "grams", "bands").join(seats.select("rep", "bucket", "band"), "rep")
    size = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("grams")).alias("bytes"))
    tiles = size.select("bucket", F.greatest(F.ceil(F.col("n") / unit), F.ceil(F.col("bytes") / unit_bytes)).cast("int").alias("tiles"))
    rows = rows.join(tiles, "bucket").withColumn("tile", F.pmod(F.xxhash64("rep", "bucket"), F.col("tiles")).cast("int"))
    paired = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
    paired = paired.select(
        "bucket", "band", "rep", "copies", "grams", "bands", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"),
        F.when(F.col("tile") > F.col("o"), 1).otherwise(0).alias("side"),
    )
    return paired.groupBy("bucket", "i", "j").applyInPandas(_verify(threshold, True), schema)


def op7_near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the row with the smallest doc_id (of equal ids, the smallest text key).

    Rows are told by id and text together, so other groups' rows under the same id stay; rows of
    equal id and text stay once. Documents without words stay, once for each id and text.
    """
    kept = materialize(near_duplicate_rows(docs).filter("kept").select(F.col("doc_id").alias("__vl_id"), F.col("key").alias("__vl_kept")), "near-kept")
    keyed = docs.withColumn("__vl_key", text_key())
    out = keyed.join(kept, (keyed["__vl_key"] == kept["__vl_kept"]) & keyed["doc_id"].eqNullSafe(kept["__vl_id"]), "left_semi")
    repeated = not kept.groupBy("__vl_id", "__vl_kept").count().filter("count > 1").isEmpty()
    return (out.dropDuplicates(["doc_id", "__vl_key"]) if repeated else out).drop("__vl_key")
