"""Removal of repeated substrings by a distributed merge sort of suffixes.

A byte goes when it lies in a string of ``length`` bytes that starts more than once in the corpus.

*Which suffixes.* Of the ``length - GRAM + 1`` GRAM-byte grams of a window of ``length`` bytes the one
with the smallest hash (the first of equals) is its anchor. The choice depends on the window's
bytes alone, so equal windows have equal anchors in the same place, and comparing the text around
anchors (about one in a hundred bytes) compares all windows. One scan writes the anchors; those
whose gram occurs once in the corpus are dropped, and all others go through the merge.

*The merge sort.* Tasks sort the suffixes that start at the anchors, keep one of each group of equal
neighbourhoods (the sort has compared their bytes) with the group's count, code each run against
its predecessors (length of the common prefix and the remaining bytes) and exchange the coded runs
by anchor gram. The receiving task merges its runs by a loser tree that carries common prefix
lengths and never compares the bytes of a known prefix again. From the merged order and its common
prefixes follow, for each distance of the window's start from its anchor, the classes of equal
windows. Group members, however many, wait in a table and are joined with the spans found.

*Identity.* Rows are told by a digest of their text: rows of equal text, whatever their ids, lose the
same bytes, and one of them is sorted with the number of all.

Grams that stand in more than ``crowd`` different texts would make one task's share unbounded; their
windows are counted by 128-bit hash in a distributed aggregate instead. Results are the same.

*Passages.* Beside the byte rule a row tells whether its text shares a passage of more than 50 words
with another row: such a passage can be shorter than ``length`` bytes. See ``shared_passages``.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm.common import as_text, materialize, only, slices, text_key
from visitloom.llm.near_dup import _INVERSE, _STEP, _TABLE, _blocks, _mix, _powers, shingle_hashes

LENGTH, GRAM = 400, 200
#: A passage is noticed for sure from so many words on, and never below so many.
PASSAGE_WORDS, PASSAGE_GRAM = 51, 36
#: Longer texts are scanned in overlapping segments of so many bytes.
SEGMENT = 8 << 20
#: Up to so many crowded grams (9 bytes each) are broadcast.
MOST_CROWDED = 500_000
_STEP2 = np.uint64(0xA24BAED4963EE407)
_INVERSE2 = np.uint64(pow(int(_STEP2), -1, 1 << 64))
_TABLE2 = _mix(_TABLE + np.uint64(0x632BE59BD9B4E019))
_PLACE_BITS = 31  # more than a column value can have bytes


class Prints:
    """Hashes of any substrings of a byte array, by prefix sums."""

    def __init__(self, data: np.ndarray, table=_TABLE, step=_STEP, inverse=_INVERSE):
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * _powers(step, max(1, len(data)))[: len(data)], out=self.total[1:])
        self.back = _powers(inverse, len(data) + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.total[end] - self.total[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def _window_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys, by doubling."""
    m, w = key, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    rest = width - w
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Anchors of all windows of the texts: text number, anchor, first and last window start (all from the text's begin), gram hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    none = np.empty(0, np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.any():
        return none, none, none, none, none.astype(np.uint64)
    prints = Prints(data)
    at = np.arange(len(data) - gram + 1)
    hashes = prints.of(at, at + gram)
    key = ((hashes >> np.uint64(_PLACE_BITS)) << np.uint64(_PLACE_BITS)) | at.astype(np.uint64)
    low = _window_min(key, length - gram + 1) & np.uint64((1 << _PLACE_BITS) - 1)
    doc = np.repeat(np.arange(len(texts)), windows)
    start = np.repeat(base - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    anchor = low[start].astype(np.int64)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))
    i = np.flatnonzero(new)
    last = start[np.append(i[1:], len(start)) - 1]
    doc, anchor, first = doc[i], anchor[i], start[i]
    return doc, anchor - base[doc], first - base[doc], last - base[doc], hashes[anchor]


def segments(texts: list[bytes], overlap: int = LENGTH - 1, most: int = SEGMENT) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The texts with the longer ones cut into segments that overlap, each segment's text number and its place in it."""
    out, owner, place = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - overlap), most):
            out.append(t if len(t) <= most else t[at : at + most + overlap])
            owner.append(i)
            place.append(at)
            if len(t) <= most:
                break
    return out, np.array(owner, np.int64), np.array(place, np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts, owner, place = segments([t.encode() for t in batch.column(2).to_pylist()])
        for lo, hi in _blocks(texts):
            doc, a, first, last, c = anchors(texts[lo:hi])
            if len(c):
                row, at = owner[lo:hi][doc], place[lo:hi][doc]
                rows = pa.array(row)
                yield pa.RecordBatch.from_pydict({
                    "c": c.view(np.int64), "key": batch.column(0).take(rows), "doc_id": batch.column(1).take(rows),
                    "a": (a + at).astype(np.int32), "lo": (first + at).astype(np.int32), "hi": (last + at).astype(np.int32),
                })


ANCHOR = "c long, key binary, doc_id long, a int, lo int, hi int"


# --- runs, front coding, loser tree ---------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that ``known`` bytes agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, step = known, 16
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    hi = min(lo + step, n)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def front_code(strings: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Common prefix lengths with the predecessor, and the bytes after them, of sorted strings."""
    lcp, tails, prev = np.zeros(len(strings), np.int32), [], b""
    for i, s in enumerate(strings):
        lcp[i] = k = common_prefix(prev, s)
        tails.append(s[k:])
        prev = s
    return lcp, tails


def decode(lcp: np.ndarray, tails: list[bytes]) -> Iterator[tuple[bytes, int]]:
    prev = b""
    for k, tail in zip(lcp.tolist(), tails, strict=True):
        prev = prev[:k] + tail
        yield prev, k


def merge_runs(runs: list[tuple[np.ndarray, list[bytes]]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Merges front-coded sorted runs: (run, index) in order, and each string's common prefix with its predecessor.

    Every node of the loser tree keeps the string that lost there and its common prefix with the
    string that won there. On the winner's path to the root both lengths refer to the string put
    out last; the longer one wins without a look at any byte, and only on equal lengths are bytes
    compared, from the common length on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    feeds = [decode(*r) for r in runs]
    current: list[bytes | None] = [None] * k
    index = [-1] * k

    def pull(r: int) -> int:
        if r < len(feeds):
            got = next(feeds[r], None)
            if got is not None:
                current[r] = got[0]
                index[r] += 1
                return got[1]
        current[r] = None
        return -1

    def play(x: int, lx: int, y: int, ly: int) -> tuple[int, int, int, int]:
        """Winner, its prefix with the last output, loser, its prefix with the winner."""
        a, b = current[x], current[y]
        if a is None:
            return y, ly, x, -1
        if b is None:
            return x, lx, y, -1
        if lx != ly:
            return (x, lx, y, ly) if lx > ly else (y, ly, x, lx)
        h = common_prefix(a, b, lx)
        if a[h : h + 1] < b[h : h + 1] or (a == b and x < y):
            return x, lx, y, h
        return y, ly, x, h

    loser, prefix = [0] * k, [0] * k
    level = []
    for r in range(k):
        pull(r)
        level.append((r, 0))
    node = k
    while len(level) > 1:
        node //= 2
        up = []
        for i in range(0, len(level), 2):
            w, lw, lo, ll = play(*level[i], *level[i + 1])
            loser[node + i // 2], prefix[node + i // 2] = lo, ll
            up.append((w, lw))
        level = up
    out, lcp = [], []
    w, lw = level[0] if level else (0, 0)
    while runs and current[w] is not None:
        out.append((w, index[w]))
        lcp.append(lw)
        lw = pull(w)
        n = (k + w) // 2
        while n:
            w, lw, loser[n], prefix[n] = play(w, lw, loser[n], prefix[n])
            n //= 2
    return out, np.array(lcp, np.int32)


def repeated_windows(lcp: np.ndarray, lefts: list[bytes], near: np.ndarray, far: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Boolean (suffix, distance): the window that starts ``distance`` before the suffix's anchor stands more than once.
    Boolean (suffix): one of them stands in the text of another owner, told by one suffix of each owner at least.

    Suffixes come in sorted order with their common prefixes; ``lefts`` are the bytes before the
    anchors, read backwards. Distances near..far are the suffix's own windows. Two windows at one
    distance d are equal when their suffixes share length - d bytes and their lefts share d.
    """
    n = len(lcp)
    order = np.array(sorted(range(n), key=lefts.__getitem__), np.int64)
    left_lcp, prev = np.zeros(n, np.int32), b""
    for i, j in enumerate(order.tolist()):
        left_lcp[i] = common_prefix(prev, lefts[j])
        prev = lefts[j]
    widest = int(far.max(initial=-1)) + 1
    out = np.zeros((n, widest), bool)
    left_class, cross = np.empty(n, np.int64), np.zeros(n, bool)
    for d in range(widest):
        live = np.flatnonzero((near <= d) & (d <= far))
        if len(live) < 2:
            continue
        right_class = np.cumsum(lcp < length - d)
        left_class[order] = np.cumsum(left_lcp < d)
        key = right_class[live] * n + left_class[live]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        again = np.append(False, same) | np.append(same, False)
        out[live[by[again]], d] = True
        other = same & (owner[live[by[1:]]] != owner[live[by[:-1]]])
        cross[live[by[np.append(False, other) | np.append(other, False)]]] = True
    return out, cross


def _spans(rows: np.ndarray, hit: np.ndarray, anchor: np.ndarray, length: int = LENGTH):
    """Runs of hit distances as spans: (row, start, end)."""
    edge = np.diff(hit.astype(np.int8), axis=1, prepend=0, append=0)
    i, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    return rows[i], anchor[i] - (hi - 1), anchor[i] - lo + length


# --- the two kinds of work ------------------------------------------------------------------------

#: One row for each coded run (part, rid, run), each member of a run (rid, idx, key, a) and each window of a crowded gram (its owner as part, h1, h2, key, a, the text's rows as idx).
WORK = "kind int, part long, rid long, run binary, idx int, key binary, a int, h1 long, h2 long"
_NOTHING = {"part": 0, "rid": 0, "run": None, "idx": 0, "key": None, "a": 0, "h1": 0, "h2": 0}


def _work(kind: int, n: int, **cols) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, **{k: cols.get(k, v) for k, v in _NOTHING.items()}}, index=range(n))


def _runs(parts: int, most: int = 64 << 20):
    """Texts with their anchors -> coded runs and their members for ordinary grams, window hashes for crowded ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rid = TaskContext.get().partitionId() << 32
        buckets: dict[int, list] = {}
        size = 0
        for pdf in batches:
            for key, text, marks, n in zip(pdf["key"], pdf["text"], pdf["marks"], pdf["n"], strict=True):
                data = text.encode()
                wide = []
                for m in marks:
                    a, lo, hi = m["a"], m["lo"], m["hi"]
                    if m["crowded"]:
                        wide.append(np.arange(lo, hi + 1))
                        continue
                    buckets.setdefault(m["c"] % parts, []).append((data[a : hi + LENGTH], data[lo:a][::-1], n, key, a))
                    size += hi - lo + LENGTH
                if wide:
                    p = np.unique(np.concatenate(wide))
                    arr = np.frombuffer(data, np.uint8)
                    h1, h2 = Prints(arr).of(p, p + LENGTH), Prints(arr, _TABLE2, _STEP2, _INVERSE2).of(p, p + LENGTH)
                    yield _work(2, len(p), part=_owner(key), h1=h1.view(np.int64), h2=h2.view(np.int64), key=[key] * len(p), a=p.astype(np.int32), idx=n)
                if size > most:
                    yield from _coded(buckets, rid)
                    rid += len(buckets)
                    buckets, size = {}, 0
        yield from _coded(buckets, rid)

    return run


def _owner(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _coded(buckets: dict[int, list], rid: int) -> Iterator[pd.DataFrame]:
    """One sorted, front-coded run for each part, equal neighbourhoods once, and the members of its entries."""
    for r, (part, rows) in enumerate(buckets.items(), rid):
        rows.sort(key=lambda x: x[:2])
        idx, suffixes, lefts, info = [], [], [], []  # info: rows, length, owner, in several rows' texts
        for suffix, left, n, key, _ in rows:
            owner = _owner(key)
            if not suffixes or suffix != suffixes[-1] or left != lefts[-1]:
                suffixes.append(suffix)
                lefts.append(left)
                info.append([0, len(suffix), owner, 0])
            info[-1][0] += n
            info[-1][3] |= n > 1 or info[-1][2] != owner
            idx.append(len(suffixes) - 1)
        lcp, tails = front_code(suffixes)
        coded = pickle.dumps((lcp, tails, lefts, np.array(info, np.int64)), protocol=5)
        yield _work(0, 1, part=part, rid=r, run=[coded])
        yield _work(1, len(rows), rid=r, idx=idx, key=[x[3] for x in rows], a=[x[4] for x in rows])


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The runs of one part -> spans of repeated windows of each run entry, from its anchor."""
    loaded = [pickle.loads(b) for b in pdf["run"]]
    rids = pdf["rid"].to_numpy(np.int64)
    order, lcp = merge_runs([(x[0], x[1]) for x in loaded])
    at = np.array(order, np.int64).reshape(-1, 2)
    lefts = [loaded[r][2][i] for r, i in order]
    counts, size, owner, several = np.array([loaded[r][3][i] for r, i in order], np.int64).reshape(-1, 4).T
    near, far = LENGTH - size, np.array([len(x) for x in lefts], np.int64)
    hit, cross = repeated_windows(lcp, lefts, near, far, owner)
    if hit.shape[1]:
        d = np.arange(hit.shape[1])
        hit |= (counts > 1)[:, None] & (near[:, None] <= d) & (d <= far[:, None])
    cross |= several > 0
    rows, start, end = _spans(np.arange(len(at)), hit, np.zeros(len(at), np.int64)) if hit.size else (np.empty(0, np.int64),) * 3
    return pd.DataFrame({"rid": rids[at[rows, 0]], "idx": at[rows, 1].astype(np.int32), "s": start.astype(np.int32), "e": end.astype(np.int32), "cross": cross[rows]})


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key), null text as empty."""
    return only(docs, "doc_id", "text").select("doc_id", as_text("text").alias("text"), text_key().alias("key"))


def repeated_spans(docs: DataFrame, crowd: int = 50_000, per_part: int = 20_000) -> DataFrame:
    """Spans (key, s, e, cross) in bytes whose union is what is repeated in the texts of ``docs``, as ``keyed`` gives them; they overlap.

    A text that shares ``LENGTH`` bytes with another row has a span with ``cross``.
    """
    found = materialize(docs.select("key", "doc_id", "text").mapInArrow(_scan, ANCHOR), "anchors")
    twice = materialize(found.groupBy("c").count().filter("count > 1").select("c"), "grams")
    marks = found.join(twice, "c", "left_semi").groupBy("key", "c", "a", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    marks = materialize(marks, "marks")
    crowded = materialize(marks.groupBy("c").count().filter(F.col("count") > crowd).select("c", F.lit(True).alias("crowded")), "crowded")
    marks = marks.join(F.broadcast(crowded) if crowded.count() <= MOST_CROWDED else crowded, "c", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    parts = max(1, -(-marks.filter("NOT crowded").count() // per_part))
    lists = marks.groupBy("key").agg(
        F.max("n").alias("n"), F.min("first").alias("first"), F.collect_list(F.struct("c", "a", "lo", "hi", "crowded")).alias("marks")
    )
    # One row of each text: rows of equal text and id, if any, come along and change nothing.
    one = docs.select("key", "doc_id", "text").join(lists.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("first")))
    work = materialize(one.select("key", "text", "marks", "n").mapInPandas(_runs(parts), WORK), "runs")
    merged = work.filter("kind = 0").select("part", "rid", "run").groupBy("part").applyInPandas(_merge, "rid long, idx int, s int, e int, cross boolean")
    members = work.filter("kind = 1").select(F.col("rid").alias("r"), F.col("idx").alias("i"), "key", "a")
    spans = members.join(merged, (F.col("r") == F.col("rid")) & (F.col("i") == F.col("idx")))
    spans = spans.select("key", (F.col("a") + F.col("s")).alias("s"), (F.col("a") + F.col("e")).alias("e"), "cross")
    windows = work.filter("kind = 2").select("h1", "h2", "key", "a", F.col("part").alias("owner"), "idx")
    again = windows.groupBy("h1", "h2").agg(F.sum("idx").alias("n"), ((F.min("owner") < F.max("owner")) | (F.max("idx") > 1)).alias("cross")).filter("n > 1")
    wide = windows.select("h1", "h2", "key", "a").join(again, ["h1", "h2"]).select("key", F.col("a").alias("s"), (F.col("a") + LENGTH).alias("e"), "cross")
    return spans.union(wide)


def _passage_grams(words: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            hashes, sizes = [], []
            for lo, hi in _blocks(texts):
                h, first = shingle_hashes([t.translate(_BLANKS) for t in texts[lo:hi]], gram)
                windows = np.maximum(np.diff(np.append(first, len(h))) - (words - gram), 0)
                doc = np.repeat(np.arange(hi - lo), windows)
                if windows.any():
                    start = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
                    h = _window_min(h, words - gram + 1)[start]
                    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))
                    doc, h = doc[new], h[new]
                    order = np.lexsort((h, doc))
                    doc, h = doc[order], h[order]
                    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))  # a gram counts once in a text
                    doc, h = doc[new], h[new]
                else:
                    h = h[:0]
                hashes.append(h.view(np.int64))
                sizes.append(np.bincount(doc, minlength=hi - lo))
            ends = np.cumsum(np.concatenate([[0], *sizes]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(hashes) if hashes else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(texts))), batch.column(0), lists], names=["row", "key", "grams"])
            row += len(texts)

    return run


#: Bytes up to the space separate words.
_BLANKS = bytes([32] * 33 + list(range(33, 256)))


def shared_passages(docs: DataFrame, known: DataFrame | None = None, words: int = PASSAGE_WORDS, gram: int = PASSAGE_GRAM) -> DataFrame:
    """(key) of the texts that share a passage of at least ``words`` words with another row, by winnowing.

    Of the ``gram``-word grams of each window of ``words`` words the one with the smallest hash is
    kept; a text is returned when another row keeps the same. So a passage of ``words`` words or
    more is never missed, and none of fewer than ``gram`` words is ever the reason. Texts in
    ``known`` (key) are compared with, but not returned.
    """
    kept = docs.select("key", "text").mapInArrow(_passage_grams(words, gram), "row long, key binary, grams array<long>").filter(F.size("grams") > 0)
    kept = materialize(kept, "passage-grams")
    shared = kept.select(F.explode("grams").alias("h")).groupBy("h").count().filter("count > 1").select("h")
    asked = kept if known is None else kept.join(known, "key", "left_anti")
    hits = asked.select("row", F.explode("grams").alias("h")).join(shared, "h", "left_semi").select("row").distinct()
    return kept.select("row", "key").join(hits, "row").select("key").distinct()


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc_id, text, spans, shares in zip(pdf["doc_id"], pdf["text"], pdf["spans"], pdf["shares_passage"], strict=True):
            data = text.encode()
            kept, at, removed, runs = [], 0, 0, 0
            if spans is not None and len(spans):
                a = np.array([(x["s"], x["e"]) for x in spans], np.int64)
                a = a[np.argsort(a[:, 0], kind="stable")]
                reach = np.maximum.accumulate(a[:, 1])
                first = np.flatnonzero(np.append(True, a[1:, 0] > reach[:-1]))
                for s, e in zip(a[first, 0].tolist(), reach[np.append(first[1:], len(a)) - 1].tolist(), strict=True):
                    kept.append(data[at:s])
                    at, removed, runs = e, removed + e - s, runs + 1
            kept.append(data[at:])
            rows.append((doc_id, len(data), removed, runs, b"".join(kept), shares))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "shares_passage"])
        yield out.astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes) and shares_passage.

    Null text counts as empty; texts under ``LENGTH`` bytes lose nothing. Rows with any doc_id, null
    or repeated, take part: a string that stands in two rows is repeated, also when the rows are
    equal as a whole. ``shares_passage``: ``LENGTH`` bytes or more than 50 words stand in another row too.
    """
    base = keyed(docs)
    spans = materialize(repeated_spans(base), "spans")
    crossing = spans.filter("cross").select("key").distinct()
    passages = shared_passages(base, crossing).select("key", F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(True))
    lists = spans.union(passages).groupBy(F.col("key").alias("k")).agg(F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", "e"))).alias("spans"), F.max("cross").alias("shares"))
    joined = base.join(lists, base["key"] == lists["k"], "left").select("doc_id", "text", "spans", F.coalesce("shares", F.lit(False)).alias("shares_passage"))
    return joined.mapInPandas(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, shares_passage boolean")


def op9_remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "shares_passage")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
