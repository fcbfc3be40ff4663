"""Operator 8: toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its whole form and of its letter n-grams of 3 to 5
with word edges, hashed into a fixed table, so a misspelling that was never seen shares vectors with
the known form.  A word of over ``LONGEST`` letters, such as a text without blanks, stands as
overlapping pieces of ``PIECE`` letters, each a word of its own.  A window's vector is the mean over its words and goes into a linear softmax of
two classes.  Vectors and softmax are trained jointly in numpy.  Insults are few in long texts, so a
document is scored by its most toxic window of ``WINDOW`` words: training first averages whole
documents, then alternates between choosing each document's worst windows and fitting on them.

Training takes at most ``per_class`` labelled documents of each class, chosen by a hash of doc_id:
this bound is a parameter, documents count whole.  The model is a fixed-size table of scalars (a
word's part of the linear score), which travels in the closure.

Cases: null and empty texts score as the bias alone says; without labels of both classes
all score 0; repeated rows are scored once each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm.common import batch, crc_mod, keyed, mix64, rows_of

BITS, DIM, WINDOW, PER_CLASS = 18, 8, 2, 600
LONGEST, PIECE = 40, 12
WORDS_KEPT = 500_000
_EDGE = ".,;:!?\"'()[]{}<>|-_/\\=+`~^"
_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def pieces(text: str | None) -> list[str]:
    """The words of a text, long ones as pieces that overlap by half."""
    words = (text or "").split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    step, out = PIECE // 2, []
    for word in words:
        core = word.strip(_EDGE)
        out += [word] if len(core) <= LONGEST else [core[at : at + PIECE] for at in range(0, len(core) - step, step)]
    return out


def edged(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with their edges, one word after the other, and each word's length (2 if
    nothing but edges is left of it)."""
    cores = [f"<{w.strip(_EDGE).lower()}>" for w in words]
    codes = np.frombuffer("".join(cores).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return codes, np.fromiter(map(len, cores), np.int64, len(cores))


def subwords(codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For letter n-grams of 3, 4 and 5 and for whole words: the table place of the one that begins at
    each letter, and whether one does.  All words at once, since most words of a corpus are rare."""
    n, ends = len(codes), np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(n)
    full = np.repeat(lengths > 2, lengths)
    padded = np.append(codes, np.zeros(4, np.uint64))
    h = codes
    for k in range(1, 5):
        h = h * _STEP + padded[k : n + k]
        if k > 1:
            yield _place(h, k), full & (left > k)
    starts = ends - lengths
    whole = np.zeros(n, np.uint64)
    whole[starts] = np.add.reduceat(codes * _powers(int(lengths.max()))[np.arange(n) - np.repeat(starts, lengths)], starts)
    first = np.zeros(n, bool)
    first[starts] = True
    yield _place(whole, 0), full & first


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, _STEP))


def _place(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix64(h + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _window_means(values: np.ndarray) -> np.ndarray:
    """Means of all windows of WINDOW words; the whole where there are fewer."""
    n = min(WINDOW, len(values))
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[n:] - total[:-n]) / n


def train(rows: list[tuple[str, int]], rounds: int = 160, rate: float = 0.1, decay: float = 5e-5, min_docs: int = 12, seed: int = 5) -> dict:
    """Fit vectors and softmax.  ``rows``: (text, label).  Subwords of fewer than ``min_docs``
    documents have no vector: they would only recall single documents."""
    words: dict[str, int] = {}
    docs = [np.array([words.setdefault(w, len(words)) for w in pieces(text)], np.int64) for text, _ in rows]
    y = np.array([label for _, label in rows], float)
    if not words:
        return {"table": np.zeros(1 << BITS, np.float32), "bias": 0.0}
    codes, lengths = edged(list(words))
    word_of = np.repeat(np.arange(len(words)), lengths)
    kinds = [(word_of[inside], ids[inside]) for ids, inside in subwords(codes, lengths)]
    owner, flat = (np.concatenate(x) for x in zip(*kinds, strict=True))
    order = np.argsort(owner, kind="stable")
    owner, flat = owner[order], flat[order]
    counts, begin = np.bincount(owner, minlength=len(words)), np.searchsorted(owner, np.arange(len(words)))
    seen = np.zeros(1 << BITS, np.int64)
    for d in docs:
        inside = np.unique(d)
        each = counts[inside]
        at = np.arange(each.sum()) + np.repeat(begin[inside] - np.cumsum(each) + each, each)
        seen[np.unique(flat[at])] += 1
    least = min(min_docs, max(1, len(docs) // 20))
    kept = seen[flat] >= least
    owner, flat = owner[kept], flat[kept]
    counts = np.bincount(owner, minlength=len(words))
    used, local = np.unique(flat, return_inverse=True)
    share = 1 / np.maximum(counts, 1)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(used), DIM)), rng.normal(0, 0.1, DIM), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))

    def word_vectors() -> np.ndarray:
        return np.stack([np.bincount(owner, params[0][local, d], len(words)) for d in range(DIM)], axis=1) * share[:, None]

    bags = [(d, i) for i, d in enumerate(docs) if len(d)]
    for step in range(1, rounds + 1):
        if step > rounds // 3 and step % 5 == 0:  # the worst window of each document, and two for clean ones
            scalar = word_vectors() @ params[1]
            bags = []
            for i, d in enumerate(docs):
                if not len(d):
                    continue
                means = _window_means(scalar[d])
                worst = [int(means.argmax())]
                if y[i] == 0:
                    worst.append(int(rng.integers(len(means))))
                bags += [(d[at : at + WINDOW], i) for at in worst]
        place = np.concatenate([b for b, _ in bags])
        sizes = np.array([len(b) for b, _ in bags])
        of = np.array([i for _, i in bags])
        bag = np.repeat(np.arange(len(bags)), sizes)
        each = 1 / sizes[bag]
        vec = word_vectors()
        mean = np.stack([np.bincount(bag, vec[place, d] * each, len(bags)) for d in range(DIM)], axis=1)
        error = (_sigmoid(mean @ params[1] + params[2][0]) - y[of]) * weight[of]
        by_word = np.bincount(place, error[bag] * each, len(words)) * share
        by_sub = np.bincount(local, by_word[owner], len(used))
        grads = [by_sub[:, None] * params[1][None, :], error @ mean, np.array([error.sum()])]
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            g = g + decay * p * (p.ndim == 2)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
    table = np.zeros(1 << BITS, np.float32)
    table[used] = params[0] @ params[1]
    return {"table": table, "bias": float(params[2][0])}


class Scorer:
    """Scores of texts; words' scalars are remembered within a bound."""

    def __init__(self, model: dict):
        self.table, self.bias, self.known = model["table"], model["bias"], {}

    def learn(self, texts: list[list[str]]) -> None:
        """Remember the scalars of all words in a batch of texts' pieces."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        new = list({w for t in texts for w in t if w not in self.known})
        for at in range(0, len(new), 1 << 16):
            part = new[at : at + (1 << 16)]
            codes, lengths = edged(part)
            total, count = np.zeros(len(codes)), np.zeros(len(codes))
            for ids, inside in subwords(codes, lengths):
                total += np.where(inside, self.table[ids], 0)
                count += inside
            starts = np.cumsum(lengths) - lengths
            values = np.add.reduceat(total, starts) / np.maximum(np.add.reduceat(count, starts), 1)
            self.known.update(zip(part, values.tolist(), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        split = [pieces(t) for t in texts]
        self.learn(split)
        return [self.score(words) for words in split]

    def score(self, words: list[str]) -> float:
        """The score of a text's pieces, all known."""
        if not words:
            return float(_sigmoid(self.bias))
        values = np.fromiter(map(self.known.__getitem__, words), float, len(words))
        return float(_sigmoid(_window_means(values).max() + self.bias))


_scorers: dict[int, Scorer] = {}


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> list[tuple[str, int]]:
    chosen = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    each = [chosen.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]  # the documented bound
    chosen = each[0].unionByName(each[1])
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most two classes times per_class rows
    return sorted((r["text"], int(r["toxic"])) for r in rows.select("text", "toxic").collect())


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every document."""
    key = zlib.crc32(model["table"].tobytes())

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(model)
        for part in rows_of(batches):
            yield batch(_OUT, part.column(0), _scorers[key].scores(part.column(1).to_pylist()))

    return keyed(docs).mapInArrow(scores, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.7) -> DataFrame:
    """Learn from labels outside the held-out fold and score all documents: doc_id, held_out, score,
    predicted."""
    fold = crc_mod(F.col("doc_id"), 3) == 1
    rows = training_rows(docs, labels.where(~fold & F.col("toxic").isin(0, 1)), per_class)
    both = len({label for _, label in rows}) == 2
    model = train(rows) if both else {"table": np.zeros(1 << BITS, np.float32), "bias": -40.0}
    out = score(docs, model).withColumn("held_out", fold)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
