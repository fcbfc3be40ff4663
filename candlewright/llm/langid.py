"""Operator 4: language of every word by a linear-chain conditional random field.

Each word with a letter has affix features (first and last three letters with the word's edge; shorter
affixes are n-grams with an edge), n-gram features (letter pairs and triples with word edges) and a
lexicon feature (the whole word), hashed into a fixed space, all words of a batch at once.  A chain is up to ``CHAIN`` consecutive words of a document.  Emissions plus learned
transitions give each word's label probabilities by forward-backward; a document's language is the
one with the greatest mean probability over its words, and that mean is its score.

Training.  At most ``per_language`` labelled documents of every language with letters in them, chosen by
a hash of doc_id, and of these as many as ``letters`` characters allow (one at least), are fitted on
the driver, in blocks of chains: these bounds are parameters, documents count whole.  Every fourth chain is spliced from two documents, so that transitions
between languages are learned.  The model is a fixed-size array and travels in the closure.

Cases: a null text, or one without letters, is ``und`` with score 0; without any labelled document
all are ``und``; words without letters have no emission; repeated rows are predicted once each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.llm.common import batch, crc_mod, keyed, mix64, rows_of

BITS, CHAIN, PER_LANGUAGE, LETTERS = 17, 64, 80, 2_000_000
VALUES_KEPT, BLOCK = 1_600_000, 1 << 21
_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_/\\=+`~^@0123456789"


_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = 1 << BITS  # the place of no feature


def _place(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix64(h + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed features of words: for each kind of feature one place per letter (``_NONE`` where no
    feature of the kind begins), where each word's letters begin, and which words have a letter."""
    cores = [w.strip(_EDGE).lower() for w in words]
    lettered = np.fromiter((c.isalpha() or any(map(str.isalpha, c)) for c in cores), bool, len(cores))
    edged = [f"<{c}>" for c in cores]
    codes = np.frombuffer("".join(edged).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, edged), np.int64, len(edged))
    n, ends = len(codes), np.cumsum(lengths)
    starts = ends - lengths
    left, full = np.repeat(ends, lengths) - np.arange(n), np.repeat(lettered, lengths)
    first = np.zeros(n, bool)
    first[starts] = True
    padded, found, h = np.append(codes, np.zeros(4, np.uint64)), [], codes
    for k in range(1, 4):
        h = h * _STEP + padded[k : n + k]
        inside = full & (left > k) & ((k < 3) | first | (left == 4))
        found.append(np.where(inside, _place(h, k), _NONE))
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _STEP))
    whole = np.zeros(n, np.uint64)
    whole[starts] = np.add.reduceat(codes * powers[np.arange(n) - np.repeat(starts, lengths)], starts)
    found.append(np.where(first & full, _place(whole, 0), _NONE))
    return found, starts, lettered


class Emitter:
    """Emissions of words, remembered per distinct word within a bound."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.known = np.vstack([weights, np.zeros((1, weights.shape[1]), weights.dtype)]), {}
        self.table = np.zeros((1024, weights.shape[1]), np.float32)
        self.lettered = np.zeros(1024, bool)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) * self.weights.shape[1] > VALUES_KEPT:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            need = len(self.known) + len(new)
            if need > len(self.table):
                self.table = np.resize(self.table, (2 * need, self.table.shape[1]))
                self.lettered = np.resize(self.lettered, 2 * need)
            for at in range(0, len(new), 1 << 14):
                part, begin = new[at : at + (1 << 14)], len(self.known)
                found, starts, lettered = features(part)
                end = begin + len(part)
                self.table[begin:end] = sum(np.add.reduceat(self.weights[places], starts, axis=0) for places in found)
                self.lettered[begin:end] = lettered
                self.known.update(zip(part, range(begin, end), strict=True))
        rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return self.table[rows], self.lettered[rows]


def forward_backward(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Label probabilities [chain, place, label], summed transition probabilities, log-likelihood
    normaliser.  Chains are padded; places beyond a chain's length have zero emissions and count
    nothing."""
    n, t, k = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e = np.exp(emit - top)
    move, begin = np.exp(trans), np.exp(start)
    live = np.arange(t)[None, :] < lengths[:, None]
    alpha, beta, scale = np.empty((t, n, k)), np.ones((t, n, k)), np.ones((t, n))
    for i in range(t):
        a = (begin if i == 0 else alpha[i - 1] @ move) * e[:, i]
        scale[i] = a.sum(axis=1)
        alpha[i] = a / scale[i][:, None]
        if i:
            alpha[i] = np.where(live[:, i, None], alpha[i], alpha[i - 1])
            scale[i] = np.where(live[:, i], scale[i], 1.0)
    pair = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        b = e[:, i + 1] * beta[i + 1] / scale[i + 1][:, None]
        ok = live[:, i + 1]
        pair += (alpha[i][ok].T @ b[ok]) * move
        beta[i] = np.where(ok[:, None], b @ move.T, beta[i + 1])
    gamma = (alpha * beta).transpose(1, 0, 2)
    gamma = gamma / gamma.sum(axis=2, keepdims=True) * live[:, :, None]
    return gamma, pair, float(np.log(scale).sum() + (top[:, :, 0] * live).sum())


def _chains(words: list[int]) -> list[list[int]]:
    return [words[at : at + CHAIN] for at in range(0, len(words), CHAIN)]


def untrained() -> dict:
    """The model without any language: it finds none."""
    return {"langs": [], "weights": np.zeros((1 << BITS, 1), np.float32), "trans": np.zeros((1, 1)), "start": np.zeros(1)}


def train(rows: list[tuple[str, str]], rounds: int = 30, rate: float = 0.15, decay: float = 1e-4) -> dict:
    """Fit emissions and transitions by Adam on the exact gradient.  ``rows``: (text, language)."""
    langs = sorted({lang for _, lang in rows})
    words: dict[str, int] = {}
    chains, labels = [], []
    for text, lang in rows:
        ids = [words.setdefault(w, len(words)) for w in text.split()]
        for chain in _chains(ids):
            chains.append(chain)
            labels.append([langs.index(lang)] * len(chain))
    for i in range(0, len(chains) - len(chains) // 2, 4):
        j = i + len(chains) // 2
        chains[i], labels[i] = chains[i][: CHAIN // 2] + chains[j][: CHAIN // 2], labels[i][: CHAIN // 2] + labels[j][: CHAIN // 2]
    n, k = len(chains), len(langs)
    if not n:
        return untrained()
    lengths = np.array([len(c) for c in chains])
    place = np.full((n, CHAIN), len(words))
    gold = np.full((n, CHAIN), -1)
    for i, (c, y) in enumerate(zip(chains, labels, strict=True)):
        place[i, : len(c)], gold[i, : len(y)] = c, y
    kinds, starts, lettered = features(list(words))
    of = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(kinds[0]))))
    owner = np.concatenate([of[places < _NONE] for places in kinds])
    used, local = np.unique(np.concatenate([places[places < _NONE] for places in kinds]), return_inverse=True)
    lettered, n_words = np.append(lettered, False), len(words) + 1  # the last stands beyond a chain's end
    gold_pair = np.zeros((k, k))
    before, after = gold[:, :-1].ravel(), gold[:, 1:].ravel()
    np.add.at(gold_pair, (before[after >= 0], after[after >= 0]), 1)
    block = max(1, BLOCK // (CHAIN * k))  # chains whose probabilities are held at a time
    params = [np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        emit = np.stack([np.bincount(owner, params[0][local, c], n_words) for c in range(k)], axis=1)
        by_word, moves, begins = np.zeros((n_words, k)), -gold_pair, np.zeros(k)
        for at in range(0, n, block):
            inside = slice(at, at + block)
            wrong, pair, _ = forward_backward(emit[place[inside]], lengths[inside], params[1], params[2])
            chain, spot = np.nonzero(gold[inside] >= 0)
            wrong[chain, spot, gold[inside][chain, spot]] -= 1
            moves += pair
            begins += wrong[:, 0].sum(axis=0)
            by_word += np.stack([np.bincount(place[inside].ravel(), wrong[:, :, c].ravel(), n_words) for c in range(k)], axis=1)
        by_word *= lettered[:, None]
        grads = [np.stack([np.bincount(local, by_word[owner, c], len(used)) for c in range(k)], axis=1), moves, begins]
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            g = g / n + decay * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros((1 << BITS, k), np.float32)
    weights[used] = params[0]
    return {"langs": langs, "weights": weights, "trans": params[1], "start": params[2]}


def training_rows(docs: DataFrame, per_language: int, letters: int) -> list[tuple[str, str]]:
    """At most ``per_language`` documents of each language and about ``letters`` characters, by a hash of
    doc_id."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    few = labelled.select("doc_id", "lang", "text", F.row_number().over(order).alias("rank")).where(F.col("rank") <= per_language)
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("rank")) - F.length("text")
    rows = few.withColumn("before", before).where(F.col("before") < letters)
    return sorted((r["text"], r["lang"]) for r in rows.select("text", "lang").collect())


_emitters: dict[int, Emitter] = {}


def label_words(model: dict, texts: list[str | None]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
    """For each text: its words, which of them have letters, and their label probabilities."""
    key = zlib.crc32(model["weights"].tobytes()) if "key" not in model else model["key"]
    model["key"] = key
    if key not in _emitters:
        _emitters.clear()
        _emitters[key] = Emitter(model["weights"])
    words = [(t or "").split() for t in texts]
    flat = [w for ws in words for w in ws]
    emit, lettered = _emitters[key](flat)
    counts = np.array([len(w) for w in words])
    chains = -(-counts // CHAIN)
    begin = np.repeat(np.cumsum(counts) - counts, chains) + np.concatenate([np.arange(c) * CHAIN for c in chains]) if len(flat) else np.empty(0, np.int64)
    end = np.minimum(begin + CHAIN, np.repeat(np.cumsum(counts), chains))
    gamma = np.empty((len(flat), len(model["langs"])))
    block = max(1, min(512, BLOCK // (CHAIN * max(1, len(model["langs"])))))
    for at in range(0, len(begin), block):
        b, lengths = begin[at : at + block].astype(np.int64), (end - begin)[at : at + block].astype(np.int64)
        place = b[:, None] + np.arange(CHAIN)[None, :]
        live = np.arange(CHAIN)[None, :] < lengths[:, None]
        e = np.where(live[:, :, None], emit[np.minimum(place, len(flat) - 1)], 0)
        g, _, _ = forward_backward(e, lengths, model["trans"], model["start"])
        gamma[place[live]] = g[live]
    cuts = np.cumsum(counts)[:-1]
    return list(zip(words, np.split(lettered, cuts), np.split(gamma, cuts), strict=True))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, text_bytes=1 << 20):
            out = []
            for _, lettered, gamma in label_words(model, part.column(1).to_pylist()):
                if not model["langs"] or not lettered.any():
                    out.append(("und", 0.0))
                else:
                    mean = gamma[lettered].mean(axis=0)
                    out.append((model["langs"][int(mean.argmax())], float(min(1.0, mean.max()))))
            yield batch(_OUT, part.column(0), [a for a, _ in out], [b for _, b in out])

    return keyed(docs).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE, letters: int = LETTERS) -> DataFrame:
    """Learn from the documents outside the held-out fold and predict all: doc_id, held_out,
    lang_pred, score."""
    fold = crc_mod(F.col("doc_id"), 4) == 2
    model = train(training_rows(docs.where(~fold), per_language, letters))
    model["trans"], model["start"] = model["trans"].astype(np.float64), model["start"].astype(np.float64)
    return identify(docs, model).withColumn("held_out", fold).select("doc_id", "held_out", "lang_pred", "score")
