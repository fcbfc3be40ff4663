"""Operator 13: spelling variants by automata over the halves of words.

Words are maximal runs of letters, counted over all texts.  Two words are near if they differ by one inserted,
deleted or replaced code point.  Of two near words, one edit can't touch both halves of either, so for each word every
near word has its first half as the beginning, or its second half as the end, of the other.

1. Each word is held under its two halves (side, word length, letters).  A hash of the three deals the halves to shards
   of about ``SHARD`` words; halves that more words share are dealt on by a hash of the word, so a shard's memory is bounded.
2. Each word is scanned by every shard that could hold a half of a near word: of the lengths that are one shorter, equal
   or one longer, at the beginning and at the end, six in all.  A shard builds one Aho-Corasick automaton of its halves and
   passes each word through it once.  A match counts if it lies at its side's offset and the lengths differ by at most one; then
   the rest of the two words is verified.  Behind a half that over ``FEW`` words share, rests are looked up by their texts with one letter
   deleted, so the work grows with the words and not with their pairs.
3. A pair is counted under its shared beginning, or else under its shared end, so no pair is counted twice and none leaves a
   task: a shard emits for each word how many near words it found and the best.
4. Forms become roots by doubling pointers.  A form has at least twice the occurrences, so chains are short and have no cycle.

Cases: null and empty texts have no words; rows without a doc_id are counted as they stand (their runs have no planted
deletion); repeated rows count each; very long texts are read piece by piece, cut between runs; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm.common import batch, rows_of, Scratch

LEAST_LENGTH, LEAST_COUNT, TYPO, PIECE, FLUSH = 5, 3, 97, 1 << 20, 200_000
SHARD, FEW = 40_000, 64
RUN, GAP = re.compile("[a-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])
BEGIN, END = 0, 1


def pieces(text: str) -> Iterator[str]:
    """A text in pieces that no run crosses."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE)
        to = gap.start() if gap else len(text)
        yield text[at:to]
        at = to


def add_words(text: str | None, doc_id: int | None, total: Counter) -> None:
    """Adds a text's words, with its planted deletions."""
    start = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
    for piece in pieces(text or ""):
        for run, c in Counter(RUN.findall(piece.encode().lower().decode())).items():
            if start is not None and (h := zlib.crc32(run.encode(), start)) % TYPO == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= LEAST_LENGTH:
                total[run] += c


def word_counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words with ``least`` occurrences or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for part in rows_of(batches):
            for doc_id, text in zip(part.column(0), part.column(1), strict=True):
                add_words(text.as_py(), doc_id.as_py(), total)
            if len(total) >= FLUSH:
                yield batch(_COUNTS, list(total), list(total.values()))
                total.clear()
        yield batch(_COUNTS, list(total), list(total.values()))

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns one into the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def deletions(rest: str) -> set[str]:
    return {rest[:k] + rest[k + 1 :] for k in range(len(rest))}


class Held:
    """The words of one shard that share a half: by their rest, and if they are many by the rest's deletions."""

    def __init__(self) -> None:
        self.rests: dict[str, int] = {}
        self.deleted: dict[str, list[str]] | None = None

    def near(self, rest: str, length: int) -> Iterator[tuple[str, int]]:
        """(rest, n) of held words whose rest is one edit from this one; ``length`` is that of their rests."""
        if len(self.rests) <= FEW:
            found = self.rests
        else:
            if self.deleted is None:
                self.deleted = defaultdict(list)
                for r in self.rests:
                    for d in deletions(r):
                        self.deleted[d].append(r)
            if length < len(rest):
                found = deletions(rest) & self.rests.keys()
            elif length > len(rest):
                found = self.deleted.get(rest, ())
            else:
                found = {r for d in deletions(rest) for r in self.deleted.get(d, ())}
        return ((r, self.rests[r]) for r in found if one_edit(r, rest))


class Shard:
    """An automaton over the halves that one shard holds."""

    def __init__(self) -> None:
        self.halves: dict[str, dict[tuple[int, int], Held]] = defaultdict(lambda: defaultdict(Held))
        self.automaton = None

    def hold(self, word: str, n: int, side: int) -> None:
        h = len(word) // 2
        half, rest = (word[:h], word[h:]) if side == BEGIN else (word[h:], word[:h])
        self.halves[half][side, len(word)].rests[rest] = n

    def scan(self, word: str) -> tuple[int, int, str]:
        """How many near words are found here, and the one of largest n (ties: smallest) behind its n."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for half, held in self.halves.items():
                self.automaton.add_word(half, (half, held))
            self.automaton.make_automaton()
        count, best_n, best = 0, 0, ""
        for end, (half, held) in self.automaton.iter(word) if self.halves else ():
            start = end + 1 - len(half)
            for (side, length), group in held.items():
                if abs(length - len(word)) > 1 or (start if side == BEGIN else len(word) - 1 - end):
                    continue
                for rest, n in group.near(word[end + 1 :] if side == BEGIN else word[:start], length - len(half)):
                    other = half + rest if side == BEGIN else rest + half
                    if side == END and word.startswith(rest):  # counted under its beginning
                        continue
                    count += 1
                    if (-n, other) < (-best_n, best):
                        best_n, best = n, other
        return count, best_n, best


def near_words(words: DataFrame, scratch: Scratch, shard: int = SHARD) -> DataFrame:
    """(word, n_near, form_n, form) of the words that have near words; form is the near word of largest n."""
    shards = max(1, -(-2 * words.count() // shard))
    length, half = F.length("word"), (F.length("word") / 2).cast("int")
    first, second = F.substring("word", F.lit(1), half), F.substring("word", half + 1, length)
    sides = [F.struct(F.lit(BEGIN).alias("side"), length.alias("len"), first.alias("half")), F.struct(F.lit(END).alias("side"), length.alias("len"), second.alias("half"))]
    held = scratch.save(words.select("word", "n", F.explode(F.array(*sides)).alias("k")).select("word", "n", "k.*"), "held")
    looks = []
    for by in (-1, 0, 1):
        of = length + by
        h = (of / 2).cast("int")
        looks += [F.struct(F.lit(BEGIN).alias("side"), of.alias("len"), F.substring("word", F.lit(1), h).alias("half")), F.struct(F.lit(END).alias("side"), of.alias("len"), F.substring("word", length - (of - h) + 1, of - h).alias("half"))]
    scans = words.select("word", F.explode(F.array(*looks)).alias("k")).select("word", "k.*").where(F.col("len") >= LEAST_LENGTH)
    key = ["side", "len", "half"]
    crowded = scratch.save(held.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > shard).select(*key, F.ceil(F.col("c") / shard).alias("parts")), "crowded")
    held = held.join(crowded, key, "left").withColumn("part", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))))
    scans = scans.join(crowded, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    number = F.pmod(F.xxhash64(*key, "part"), F.lit(shards)).alias("shard")
    held = held.select(number, F.col("side").alias("kind"), "word", "n")
    scans = scans.select(number, F.lit(2).alias("kind"), "word", F.lit(0).cast("long").alias("n")).distinct()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = Shard(), None
        for part in rows_of(batches, 1 << 14):
            out = []
            for number, kind, word, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if number != at:
                    now, at = Shard(), number
                if kind != 2:
                    now.hold(word, n, kind)
                elif (found := now.scan(word))[0]:
                    out.append((word, *found))
            if out:
                yield batch(_NEAR, *(list(c) for c in zip(*out, strict=True)))

    rows = held.unionByName(scans).repartition("shard").sortWithinPartitions("shard", "kind", "word")
    found = rows.mapInArrow(look, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("form_n"), F.col("b.form").alias("form"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of the words with a form: the last form that is reached."""
    now = scratch.save(forms.select("word", F.col("form").alias("root")), "root-0")
    step = 0
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step += 1
        joined = scratch.save(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"root-{step}")
        if joined.where("moved").isEmpty():
            return joined.select("word", "root")
        now = joined.select("word", "root")


def variants(docs: DataFrame, scratch: Scratch | None = None, shard: int = SHARD) -> DataFrame:
    """One row per word: word, n, form, root, n_near, form_n."""
    scratch = scratch or Scratch(docs.sparkSession, "op13")
    words = scratch.save(word_counts(docs), "words")
    near = words.join(near_words(words, scratch, shard), "word", "left")
    near = scratch.save(near.withColumn("has", F.col("form_n") >= 2 * F.col("n")).select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("form")).alias("form"), F.when(F.col("has"), F.col("form_n")).alias("form_n")), "near")
    out = near.join(roots(near.where("form IS NOT NULL"), scratch), "word", "left").withColumn("root", F.coalesce("root", "word"))
    return scratch.last(out.select("word", "n", "form", "root", "n_near", "form_n"))
