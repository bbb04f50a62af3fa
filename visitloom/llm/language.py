"""Language of words and documents by a linear-chain conditional random field.

A text is a chain of its words (runs of letters, in lower case); labels are languages. A word's score
for a label is the sum of the weights of its features: affixes of one to four letters and n-grams of
one to four characters, both taken from the word between its two edges and hashed into ``1 << BITS`` cells,
and what the lexicon says, that is for each language how much of the word's documents are in it. Transition weights
between labels are learned with them, from chains that switch languages. Forward-backward gives each
word a distribution over the languages in the light of its neighbours; a document's language is the
one with the largest sum, and its score that sum's share.

Learning sees only documents outside the held-out fold whose ``lang`` is not null. The lexicon counts all of
them; the weights are fitted on at most ``MAX_TRAIN`` of them, each giving ``WINDOW`` words in a row
from a place that a hash chooses. Scoring is one scan, and texts are read whole: a chain is
cut into pieces whose transfer matrices are multiplied up, which gives the same distributions as one pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm.common import materialize, only
from visitloom.llm.periods import _blocks as text_blocks

#: Documents used for fitting, as many of each language where there are so many, and the words that each gives.
MAX_TRAIN, WINDOW = 3_000, 48
#: Languages learned: the most frequent ones. Most words of the lexicon: those of the most training documents.
MAX_LANGUAGES, LEXICON = 100, 20_000
BITS, PIECE = 18, 32
#: Steps of a document's share in a language that the lexicon tells apart.
STEPS = np.array([0.02, 0.2, 0.5, 0.8, 0.98])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts and the row of each."""
    letters = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\P{L}+", " ")
    split = pc.ascii_split_whitespace(letters)
    words, owner = split.flatten(), pc.list_parent_indices(split).to_numpy()
    real = pc.greater(pc.binary_length(words), 0)
    return words.filter(real), owner[real.to_numpy(zero_copy_only=False)]


def hashed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(cell, word number) of every n-gram and affix of the words."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    chars = np.frombuffer("".join(f"^{w}$" for w in words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(size)), size)
    end = np.cumsum(size)[owner]
    first = end - size[owner]
    at = np.arange(len(chars))
    cells, owners = [], []
    mix, h = np.uint64(0x9E3779B97F4A7C15), np.zeros(len(chars), np.uint64)
    for n in range(1, 6):
        fits = at + n <= end
        at, h, first, end = at[fits], h[fits], first[fits], end[fits]
        h = h * np.uint64(1_000_003) + chars[at + n - 1]
        edge = slice(None) if n < 5 else (at == first) | (at + n == end)  # five characters only with an edge: affixes of four letters
        cells.append(((h[edge] + np.uint64(n)) * mix >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[at[edge]])
    return np.concatenate(cells), np.concatenate(owners)


def marginals(score: np.ndarray, ends: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each word's distribution over the labels, and (if asked) the expected number of transitions between labels.

    ``score`` are the word scores of several chains one after the other, none of them empty; ``ends`` says where each ends.
    """
    n, k = score.shape
    e = np.exp(np.maximum(score - score.max(1, keepdims=True), -30))
    t, s = np.exp(trans), np.exp(start)
    sizes = np.diff(ends, prepend=0)
    pieces = -(-sizes // PIECE)
    first = np.cumsum(pieces) - pieces
    chain = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(n) - (ends - sizes)[chain]
    row, col = first[chain] + inside // PIECE, inside % PIECE
    total = int(pieces.sum())
    pot = np.ones((total, PIECE, k))
    pot[row, col] = e
    real = np.zeros((total, PIECE), bool)
    real[row, col] = True
    opens = np.zeros(total, bool)
    opens[first] = True

    def step(v: np.ndarray, j: int) -> np.ndarray:
        """Vectors (piece, ..., label) carried over word j of their pieces."""
        new = v @ t
        if j == 0:
            new[opens] = v[opens].sum(-1, keepdims=True) * s  # nothing stands before a chain's first word
        new = new * (pot[:, j] if v.ndim == 2 else pot[:, j, None])
        new /= new.max(axis=tuple(range(1, v.ndim)), keepdims=True)
        return new if real[:, j].all() else np.where(real[:, j].reshape(-1, *[1] * (v.ndim - 1)), new, v)

    transfer = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for j in range(PIECE):
        transfer = step(transfer, j)
    before, after = np.full((total, k), 1.0 / k), np.ones((total, k))
    order = np.argsort(-pieces, kind="stable")
    longest = int(pieces.max()) if len(pieces) else 0
    active = [int(np.searchsorted(-pieces[order], -j, side="left")) for j in range(longest)]  # chains of more than j pieces
    for j in range(1, longest):
        at = first[order[: active[j]]] + j
        v = np.einsum("pi,pij->pj", before[at - 1], transfer[at - 1])
        before[at] = v / v.max(1, keepdims=True)
    for j in range(longest - 1, 0, -1):
        at = first[order[: active[j]]] + j
        v = np.einsum("pij,pj->pi", transfer[at], after[at])
        after[at - 1] = v / v.max(1, keepdims=True)
    alpha, beta = np.empty_like(pot), np.empty_like(pot)
    v = before
    for j in range(PIECE):
        v = alpha[:, j] = step(v, j)
    v = after
    for j in range(PIECE - 1, -1, -1):
        beta[:, j] = v
        new = (v * pot[:, j]) @ t.T
        v = np.where(real[:, j, None], new / new.max(1, keepdims=True), v)
    alpha, beta = alpha[row, col], beta[row, col]
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    if not pairs:
        return gamma, np.zeros((k, k))
    inner = np.flatnonzero(inside > 0)
    both = alpha[inner - 1][:, :, None] * t * (e[inner] * beta[inner])[:, None, :]
    return gamma, (both / both.sum((1, 2), keepdims=True)).sum(0)


@dataclass
class LanguageModel:
    """Labels, weights of hashed and of lexicon features, transitions, and the lexicon with each word's document counts by label."""

    labels: list[str]
    weights: np.ndarray
    lexical: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    lexicon: pa.Array
    shares: np.ndarray

    def lexical_cells(self, words: pa.Array) -> np.ndarray:
        """For each word one lexicon feature a label, or none (-1) where the lexicon lacks the word."""
        found = pc.fill_null(pc.index_in(words, value_set=self.lexicon), -1).to_numpy(zero_copy_only=False)
        out = np.full((len(words), len(self.labels)), -1, np.int64)
        if len(self.lexicon):
            step = np.searchsorted(STEPS, self.shares) + np.arange(len(self.labels)) * (len(STEPS) + 1)
            out[found >= 0] = step[found[found >= 0]]
        return out

    def word_scores(self, words: pa.Array) -> np.ndarray:
        cell, owner = hashed(words)
        out = np.stack([np.bincount(owner, self.weights[cell, k], len(words)) for k in range(len(self.labels))], 1)
        lex = self.lexical_cells(words)
        return out + np.where((lex >= 0)[:, :, None], self.lexical[lex], 0).sum(1)

    def label(self, words: pa.Array, ends: np.ndarray) -> np.ndarray:
        """The distributions of the words of several chains."""
        coded = words.dictionary_encode()
        return marginals(self.word_scores(coded.dictionary)[coded.indices.to_numpy()], ends, self.trans, self.start)[0]


def fit_chains(model: LanguageModel, words: pa.Array, label: np.ndarray, ends: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.2, l2: float = 1e-5) -> None:
    """Learns a model's weights in place: AdaGrad on the log likelihood of labelled chains."""
    k = len(model.labels)
    coded = words.dictionary_encode()
    cell, owner = hashed(coded.dictionary)
    order = np.argsort(owner, kind="stable")
    cell = cell[order]
    begin = np.searchsorted(owner[order], np.arange(len(coded.dictionary) + 1))
    lex, code = model.lexical_cells(coded.dictionary), coded.indices.to_numpy()
    begins = np.append(0, ends[:-1])
    seen = [np.full_like(x, 1e-6) for x in (model.weights, model.lexical, model.trans, model.start)]
    rng = np.random.default_rng(7)

    def move(x: np.ndarray, past: np.ndarray, at, g: np.ndarray) -> None:
        past[at] += g * g
        x[at] += rate * g / np.sqrt(past[at])

    for _ in range(epochs):
        shuffled = rng.permutation(len(ends))
        for b in range(0, len(shuffled), batch):
            chains = shuffled[b : b + batch]
            at = np.concatenate([np.arange(begins[c], ends[c]) for c in chains])
            stops = np.cumsum(ends[chains] - begins[chains])
            used, back = np.unique(code[at], return_inverse=True)
            count = begin[used + 1] - begin[used]
            of = np.repeat(np.arange(len(used)), count)
            cells = cell[np.repeat(begin[used] - (np.cumsum(count) - count), count) + np.arange(len(of))]
            score = np.stack([np.bincount(of, model.weights[cells, j], len(used)) for j in range(k)], 1)
            hit = lex[used]
            score += np.where((hit >= 0)[:, :, None], model.lexical[hit], 0).sum(1)
            gamma, pairs = marginals(score[back], stops, model.trans, model.start, pairs=True)
            y = label[at]
            truth = np.eye(k)[y]
            g = (truth - gamma) / len(at)
            per_word = np.stack([np.bincount(back, g[:, j], len(used)) for j in range(k)], 1)
            touched, place = np.unique(cells, return_inverse=True)
            move(model.weights, seen[0], touched, np.stack([np.bincount(place, per_word[of, j], len(touched)) for j in range(k)], 1) - l2 * model.weights[touched])
            known = hit >= 0
            spread = np.repeat(per_word[:, None], k, 1)[known]
            flat = hit[known]
            move(model.lexical, seen[1], slice(None), np.stack([np.bincount(flat, spread[:, j], len(model.lexical)) for j in range(k)], 1) - l2 * model.lexical)
            inner = np.ones(len(at), bool)
            inner[np.append(0, stops[:-1])] = False
            told = np.zeros((k, k))
            np.add.at(told, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
            move(model.trans, seen[2], slice(None), (told - pairs) / len(at))
            move(model.start, seen[3], slice(None), (truth - gamma)[~inner].sum(0) / len(at))


def switching_chains(windows: list[tuple[int, list[str]]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Chains for learning: three stretches of different windows, mostly of different languages, so that transitions can be learned."""
    rng = np.random.default_rng(11)
    pieces = []
    for label, words in windows:
        while words:
            cut = int(rng.integers(4, 25))
            pieces.append((label, words[:cut]))
            words = words[cut:]
    words, labels, ends = [], [], []
    shuffled = rng.permutation(len(pieces)).tolist()
    for i in range(0, len(shuffled), 3):
        for j in shuffled[i : i + 3]:
            words += pieces[j][1]
            labels += [pieces[j][0]] * len(pieces[j][1])
        ends.append(len(words))
    return words, np.array(labels, np.int64), np.array(ends, np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether a row is of the fold that learning never sees; a null id is as the text "null" would be."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % 3 == 1


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_blocks(batch.column(0)):
            words, owner = words_of(batch.column(0).slice(a, b - a))
            out = []
            bounds = np.searchsorted(owner, np.arange(b - a + 1))
            for i in range(b - a):
                lo, hi = int(bounds[i]), int(bounds[i + 1])
                lo += zlib.crc32((batch.column(0)[a + i].as_py() or "").encode()) % max(1, hi - lo - WINDOW + 1)
                out.append(words.slice(lo, min(WINDOW, hi - lo)).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), batch.column(1).slice(a, b - a)], names=["words", "lang"])


def _counts(labels: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(labels)
        for batch in batches:
            for a, b in text_blocks(batch.column(0)):
                words, owner = words_of(batch.column(0).slice(a, b - a))
                coded = words.dictionary_encode()
                lang = pc.index_in(batch.column(1).slice(a, b - a), value_set=pa.array(labels)).to_numpy(zero_copy_only=False).astype(np.int64)
                once = np.unique(owner * max(1, len(coded.dictionary)) + coded.indices.to_numpy()) if len(words) else np.empty(0, np.int64)
                word = once % max(1, len(coded.dictionary))
                n = np.bincount(word * k + lang[once // max(1, len(coded.dictionary))], minlength=len(coded.dictionary) * k)
                offsets = pa.array(np.arange(len(coded.dictionary) + 1) * k, pa.int32())
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64()))], names=["word", "n"])

    return run


def commonest(words: DataFrame) -> DataFrame:
    """The rows (word, n, ...) from the least ``n`` on that leaves at most ``LEXICON`` of them, in steps of an eighth of a doubling."""
    step = F.floor(8 * F.log2("n"))
    room, least = LEXICON, None
    for r in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 8 * 63 rows
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    return words.filter(F.lit(False) if least is None else step >= least).orderBy("word")


def learn(docs: DataFrame, most: int = MAX_TRAIN) -> LanguageModel:
    """The model of ``docs`` (text, lang): rows without lang are left out. Without any word of a known language it has no labels."""
    known = docs.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    totals = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    counts = {r["lang"]: r["count"] for r in totals}
    labels = sorted(counts)
    k = len(labels)
    none = LanguageModel(labels, np.zeros((1 << BITS, k)), np.zeros((k * (len(STEPS) + 1), k)), np.zeros((k, k)), np.zeros(k), pa.array([], pa.string()), np.zeros((0, k)))
    if not labels:
        return none
    known = known.filter(F.col("lang").isin(labels))
    each = max(1, most // k)
    place = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30))
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, int((1 << 30) * min(1.0, each / n))).otherwise(share)
    windows = known.filter(place < share).mapInArrow(_windows, "words array<string>, lang string").filter(F.size("words") > 0).distinct()  # copies count once
    windows = windows.orderBy(F.xxhash64("words"), "words", "lang").limit(2 * most).collect()
    if not windows:
        none.labels = []
        return none
    summed = known.mapInArrow(_counts(labels), "word string, n array<long>").groupBy("word").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(k)])
    total = sum((F.col(f"n{i}") for i in range(1, k)), F.col("n0"))
    lexicon = commonest(materialize(summed.withColumn("n", total).filter("n > 1"), "lexicon")).toPandas()
    n = lexicon[[f"n{i}" for i in range(k)]].to_numpy(np.float64)
    rates = (n + 0.01) / np.array([counts[x] for x in labels])  # of a language's documents
    model = none
    model.lexicon, model.shares = pa.array(lexicon["word"].tolist(), pa.string()), rates / rates.sum(1, keepdims=True)
    words, label, ends = switching_chains([(labels.index(r["lang"]), list(r["words"])) for r in windows])
    fit_chains(model, pa.array(words, pa.string()), label, ends)
    model.weights = model.weights.astype(np.float32)
    return model


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        k = len(model.labels)
        for batch in batches:
            for a, b in text_blocks(batch.column(1)):
                words, owner = words_of(batch.column(1).slice(a, b - a))
                share = np.zeros((b - a, max(1, k)))
                number = np.bincount(owner, minlength=b - a)
                if len(words) and k:
                    gamma = model.label(words, np.cumsum(number[number > 0]))
                    share = np.stack([np.bincount(owner, gamma[:, j], b - a) for j in range(k)], 1) / np.maximum(number, 1)[:, None]
                best = share.argmax(1)
                told = (number > 0) & (k > 0)
                names = pa.array([model.labels[i] if t else "und" for i, t in zip(best.tolist(), told.tolist(), strict=True)], pa.string())
                score = np.where(told, np.minimum(share[np.arange(b - a), best], 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), names, pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (the mean probability of that language over the words).

    Texts that are null or have no letters are ``und`` with score 0; of equal sums the first label counts.
    Rows repeated whole repeat. Only the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (1 << BITS) + a few cells a label, and LEXICON words
    return only(docs, "doc_id", "text").mapInArrow(_score(shared), "doc_id long, lang_pred string, score double")


def label_words(model: LanguageModel, text: str) -> list[tuple[str, str, float]]:
    """The words of a text, the most probable language of each and its probability."""
    words, _ = words_of(pa.array([text], pa.string()))
    if not len(words) or not model.labels:
        return []
    gamma = model.label(words, np.array([len(words)]))
    return [(w, model.labels[g.argmax()], float(g.max())) for w, g in zip(words.to_pylist(), gamma, strict=True)]


def op11_language(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The language of every document, learned from those outside the held-out fold."""
    model = learn(only(docs, "doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
