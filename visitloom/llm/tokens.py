"""Tokenization inside tasks, and offset-mapped attribution of tokens to sections.

A tokenizer file is loaded once per Python worker. The encoders split a text where no token can
cross, look each piece up in a cache and let the tokenizer encode only pieces not seen before; the
ids and the offsets put together from the pieces are those of the tokenizer over the whole text.
Texts with unusual white space, where the split would not be certain, go to the tokenizer whole.
(A call of the tokenizer for every whole text takes about 2,000 CPU seconds a GB of input.)
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm.common import only

#: White space other than space, tab, newline and carriage return.
UNUSUAL_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ASCII_UNUSUAL = "\x0b\x0c\x1c\x1d\x1e\x1f"
#: Pieces of a byte-level BPE text: words with the space before them, runs of white space.
LEADING_SPACE_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s")
CACHE_PIECES, CACHED_CHARS = 1_000_000, 48
#: A word of Latin letters that normalisation leaves as they are but for their case, and one mark after it.
PLAIN_WORD = re.compile("([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?]?)")


def unusual_space(text: str) -> bool:
    """Whether the text holds white space other than space, tab, newline and carriage return."""
    return any(c in text for c in ASCII_UNUSUAL) if text.isascii() else UNUSUAL_SPACE.search(text) is not None


def public_tokenizer_path(name: str) -> str:
    """Where an installed public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """For tokenizers that drop white space and never cross it: ids as little-endian uint16 or uint32 bytes."""

    def __init__(self, path: str, pieces: int = 0):
        self.tokenizer = load_tokenizer(path)
        self.most = pieces or CACHE_PIECES
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 65536 else np.dtype("<u4")
        self.cache: dict[str, bytes] = {"": b""}
        self.byte_chars = _byte_chars()
        self.marks = {m: self._ids([m])[0] if m else b"" for m in ("", *".,;:!?")}
        probe = ["Straße,", "éÀñ.", "Zebra", "ÿŁódź!", "don", "x"]
        self.plain_way = True
        found = self._encode_new(set(probe))
        self.plain_way = [found[p] for p in probe] == self._ids(probe)

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [None if unusual_space(t) else t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        cache = self.cache
        words = set().union(*(p for p in pieces if p is not None))
        new = words.difference(cache)
        if len(cache) + len(new) > self.most:
            cache = self.cache = {w: cache[w] for w in words if w in cache} | {"": b""}
        cache.update(self._encode_new(new))
        out = [b"".join(map(cache.__getitem__, p)) if p is not None else self._ids([t])[0] for p, t in zip(pieces, texts, strict=True)]
        for w in new:
            if len(w) > CACHED_CHARS:
                del cache[w]
        return out

    def _encode_new(self, pieces: set[str]) -> dict[str, bytes]:
        """A plain word is one pre-token and goes straight to the tokenizer's model, a mark after it is another; other pieces take the whole way."""
        out, rest = {}, []
        tokenize, table, cache, code = self.tokenizer.model.tokenize, self.byte_chars, self.cache, self.dtype.char
        plain, fullmatch = self.plain_way, PLAIN_WORD.fullmatch
        for w in pieces:
            if plain and w.isascii() and w.isalpha():
                word, mark = w, ""
            else:
                m = fullmatch(w) if plain else None
                if m is None:
                    rest.append(w)
                    continue
                word, mark = m.groups()
            low = word.lower()
            ids = cache.get(low)
            if ids is None:
                ids = out.get(low)
            if ids is None:
                form = low if low.isascii() else low.encode().decode("latin-1").translate(table)
                ids = array(code, [t.id for t in tokenize(form)]).tobytes()
                if low == w:
                    out[w] = ids
                    continue
            out[w] = ids + self.marks[mark]
        out.update(zip(rest, self._ids(rest), strict=True))
        return out

    def _ids(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(pieces), 4096):
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(pieces[i : i + 4096], add_special_tokens=False)]
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str, pieces: int = 0) -> WordEncoder:
    """The encoder of this Python worker; its cache holds ``pieces`` or ``CACHE_PIECES``."""
    return WordEncoder(path, pieces)


class OffsetEncoder:
    """For byte-level BPE with a leading space: the character spans of all tokens of whole texts."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.tokenizer.encode_special_tokens = True
        self.cache: dict[str, bytes] = {}
        self.skip = int(self._spans([" x"])[0][0, 0])  # 1 where the tokenizer leaves a leading space out of the offsets
        probe = [" Strasse,", "eAn.", " Zebra", " Lodz!", "don", " x", "a", " a", "zzxq;"]
        self.plain_way = True
        found = self._encode_new(set(probe))
        self.plain_way = [found[p] for p in probe] == [self._packed(x) for x in self._spans(probe)]

    def _spans(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.offsets, np.int64).reshape(-1, 2) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    @staticmethod
    def _packed(spans: np.ndarray) -> bytes:
        return spans.astype("<u2").tobytes()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Start and end characters of the tokens of each text, encoded once as a whole."""
        cut = [None if unusual_space(t) else LEADING_SPACE_PIECES.findall(t) for t in texts]
        cut = [p if p is not None and max(map(len, p), default=0) < 1 << 16 else None for p in cut]
        words = set().union(*(p for p in cut if p is not None))
        new = words.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache, new = {}, words
        self.cache.update(self._encode_new(new))
        out = []
        for pieces, text in zip(cut, texts, strict=True):
            if pieces is None:
                spans = self._spans([text])[0]
            else:
                packed = list(map(self.cache.__getitem__, pieces))
                size = np.fromiter(map(len, pieces), np.int32, len(pieces))
                tokens = np.fromiter(map(len, packed), np.int32, len(pieces)) >> 2
                begin = np.repeat(np.cumsum(size, dtype=np.int32) - size, tokens)
                flat = np.frombuffer(b"".join(packed), "<u2")
                out.append((flat[0::2] + begin, flat[1::2] + begin))
                continue
            out.append((spans[:, 0], spans[:, 1]))
        for w in new:
            if len(w) > CACHED_CHARS:
                del self.cache[w]
        return out

    def _encode_new(self, pieces: set[str]) -> dict[str, bytes]:
        """A plain ASCII word with the space before it is one pre-token and goes straight to the model, a mark after it is another, one token."""
        out, rest, tokenize = {}, [], self.tokenizer.model.tokenize
        for w in pieces:
            space = w[:1] == " "
            m = PLAIN_WORD.fullmatch(w, int(space)) if self.plain_way and w.isascii() else None
            if m is None:
                rest.append(w)
                continue
            tokens = [t.value for t in tokenize("\u0120" + m.group(1) if space else m.group(1))]
            if space and len(tokens[0]) == 1:
                rest.append(w)
                continue
            flat, at = [], 0
            for t in tokens:
                flat += (at, at := at + len(t))
            flat[0] = self.skip * space
            if m.group(2):
                flat += (at, at + 1)
            out[w] = array("H", flat).tobytes()
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                out[w] = array("H", chain.from_iterable(e.offsets)).tobytes()
        return out


def _byte_chars() -> dict[int, int]:
    """How byte-level alphabets write a byte that is no printable Latin-1 character: as a character above 255."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}


def count_by_section(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of [no section, section 0, ...]: an interval join of two ascending lists.

    The tokens that lie within a section are one run of the list, found by its ends; those between
    the runs are attributed one by one.
    """
    n = len(lo)
    ends = np.maximum(ends, starts + 1)
    first = np.searchsorted(starts, lo, side="left")
    last = np.maximum(np.searchsorted(ends, hi, side="right"), first)
    gap_lo, gap_hi = np.append(0, last), np.append(first, len(starts))
    size = gap_hi - gap_lo
    between = np.repeat(gap_lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    owner, crossing = attribute(starts[between].astype(np.int64), ends[between].astype(np.int64), lo, hi)
    total = np.bincount(owner + 1, minlength=n + 1)
    total[1:] += last - first
    return total, np.bincount((owner + 1)[crossing], minlength=n + 1)


@lru_cache(maxsize=2)
def offset_encoder(path: str) -> OffsetEncoder:
    return OffsetEncoder(path)


def attribute(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether the token crosses an edge of it.

    Sections [lo, hi) are disjoint and ascending. A token goes to the section that holds most of
    its characters, on a tie to the earlier one; a token that touches none gets -1. A token without
    characters of its own (a later byte of one character) goes by the character it stands at.
    """
    n = len(lo)
    if not n or not len(starts):
        return np.full(len(starts), -1), np.zeros(len(starts), bool)
    ends = np.maximum(ends, starts + 1)
    first = np.searchsorted(hi, starts, side="right")  # first section that ends after the token's start
    last = np.searchsorted(lo, ends, side="left") - 1  # last section that begins before its end
    best, most = np.full(len(starts), -1), np.zeros(len(starts), np.int64)
    for k in range(int(max(0, (last - first).max(initial=-1) + 1))):
        i = first + k
        live = i <= last
        j = np.minimum(i, n - 1)
        overlap = np.where(live, np.minimum(ends, hi[j]) - np.maximum(starts, lo[j]), 0)
        better = overlap > most
        best, most = np.where(better, i, best), np.where(better, overlap, most)
    return best, (best >= 0) & (most < ends - starts)


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the lines that are not empty, without their line ends."""
    at, lo, hi = 0, [], []
    for line in text.split("\n"):
        if line:
            lo.append(at)
            hi.append(at + len(line))
        at += len(line) + 1
    return np.array(lo, np.int64), np.array(hi, np.int64)


def section_tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Token counts by section: rows (doc_id, section_id, start, length, n_tokens, n_crossing), the sections being lines.

    Each document is encoded once, whole; its tokens' character spans meet the sections in a
    sorted interval join inside the task, so that token rows never shuffle. section_id counts from
    0; tokens outside every section (line ends) are on the row with section_id -1, which every
    document has, with the document's whole span. So the counts of a document add up to its
    tokens. Null and empty texts give that row alone with 0 tokens. Rows repeated whole repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = offset_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                cols: list[list[np.ndarray]] = [[], [], [], [], []]
                sizes = []
                for text, (starts, ends) in zip(texts, encoder.encode(texts), strict=True):
                    lo, hi = line_sections(text)
                    counts, crossed = count_by_section(starts, ends, lo, hi)
                    sizes.append(len(lo) + 1)
                    for c, v in zip(cols, (np.arange(-1, len(lo)), np.append(0, lo), np.append(len(text), hi - lo), counts, crossed), strict=True):
                        c.append(v)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), sizes)))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.concatenate(c).astype(np.int64)) for c in cols]], names=["doc_id", "section_id", "start", "length", "n_tokens", "n_crossing"])

    return only(docs, "doc_id", text_col).mapInArrow(run, "doc_id long, section_id long, start long, length long, n_tokens long, n_crossing long")


def attribute_to_spans(docs: DataFrame, spans: DataFrame, path: str) -> DataFrame:
    """As ``section_tokens`` for any sections: ``spans`` holds (doc_id, section_id, start, length) with disjoint spans.

    The spans of one document come together by a cogroup on doc_id; a document without spans has
    all its tokens on the row with section_id -1. Null ids are left out.
    """
    import pandas as pd

    def run(d: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = []
        s = s.sort_values("start")
        for doc_id, text in zip(d["doc_id"], d["text"], strict=True):
            starts, ends = offset_encoder(path).encode([text or ""])[0]
            counts, crossed = count_by_section(starts, ends, s["start"].to_numpy(np.int64), (s["start"] + s["length"]).to_numpy(np.int64))
            out.append(pd.DataFrame({
                "doc_id": doc_id, "section_id": [-1, *s["section_id"]],
                "n_tokens": counts, "n_crossing": crossed,
            }))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "section_id": [], "n_tokens": [], "n_crossing": []})

    left = only(docs, "doc_id", "text").filter("doc_id IS NOT NULL")
    right = only(spans, "doc_id", "section_id", "start", "length").filter("doc_id IS NOT NULL")
    return left.groupBy("doc_id").cogroup(right.groupBy("doc_id")).applyInPandas(run, "doc_id long, section_id long, n_tokens long, n_crossing long")


def op3_section_tokens(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return section_tokens(docs, public_tokenizer_path("byte_bpe_50k.json"))


def token_totals(sections: DataFrame) -> DataFrame:
    """Tokens of each document from its sections."""
    return sections.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"))
