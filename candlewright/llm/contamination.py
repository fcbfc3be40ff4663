"""Operator 7: benchmark passages in training documents, exact or edited.

Seeds.  Test items are cut into passages of at most ``PASSAGE`` words, half overlapping, and their
word 3-grams are seeds.  A bit table of fixed size tells which grams of a document may be seeds; the
words around them are cut out as regions, and an exact join on gram hashes follows, so the table's
size never decides a result.

Candidates.  A gram of a passage is a seed if at most ``ITEMS`` passages hold it, or if it is among as many of the passage's
rarest that every clean copy of ``SHARE`` of the passage holds ``SEEDS`` of them, wherever it lies (a copy misses fewer grams than
that).  So phrases that all items share, such as a question's opening, are no seeds where a passage has enough
of its own, and nothing is lost by it but heavily edited copies of what is common.  Rarity is counted in the benchmark alone, however many documents hold a
gram: a passage copied into a third of the corpus is found, and so is an edited or partial copy beside
the exact ones.  A pair of region and passage with ``SEEDS`` different seeds, or all of a passage's if it has fewer, is a
candidate.  Hits of a gram with more than ``HOT`` regions are dealt out to several keys of the join.

Alignment.  Smith-Waterman on words (match 2, mismatch -1, gap -1) scores each candidate, as a share
of the score of a perfect copy.  A document is contaminated by an item if some passage reaches
``SHARE``.  No score exceeds the share of the passage's words that the region holds, so candidates
under ``SHARE`` by that count are not aligned.

Cases: null and empty texts, items under three words and items without an item_id match nothing; an item of three words is
found where it is copied exactly; repeated rows are matched once per doc_id; an empty corpus or benchmark gives an empty result; further columns are ignored;
long texts yield many regions, each of bounded reach around its seeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.llm.common import batch, keyed, mix64, rows_of, Scratch

GRAM, PASSAGE, REGION, SEEDS, SHARE, HOT = 3, 64, 256, 2, 0.5, 20_000
ITEMS, FEW = 64, 100_000
TABLE_BITS = 25
MATCH, MISMATCH, GAP = 2, -1, -1
_EDGE = b".,;:!?\"'()[]{}<>|*#$%&"
_REGIONS = pa.schema([("doc_id", pa.int64()), ("region", pa.int64()), ("words", pa.binary()), ("grams", pa.list_(pa.int64()))])
_PASSAGES = pa.schema([("item_id", pa.int64()), ("passage", pa.int64()), ("words", pa.binary()), ("grams", pa.list_(pa.int64()))])
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words, lower-cased and without punctuation at the ends."""
    words = (text or "").lower().encode().split()
    return np.fromiter((xxhash.xxh3_64_intdigest(w.strip(_EDGE) or w) for w in words), np.uint64, len(words))


def gram_hashes(w: np.ndarray) -> np.ndarray:
    if len(w) < GRAM:
        return np.empty(0, np.uint64)
    return mix64(sum(w[k : len(w) - GRAM + 1 + k] * _C[k] for k in range(GRAM)))


def passages(benchmark: DataFrame) -> DataFrame:
    """(item_id, passage, words, grams) of every test item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            out = []
            for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                w = word_hashes(text)
                for k, at in enumerate(range(0, max(1, len(w) - PASSAGE // 2), PASSAGE // 2)):
                    piece = w[at : at + PASSAGE]
                    out.append((item, k, piece.tobytes(), np.unique(gram_hashes(piece)).view(np.int64)))
            yield batch(_PASSAGES, *(list(c) for c in zip(*out, strict=True)))

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(cut, "item_id long, passage long, words binary, grams array<long>")


def seed_grams(tests: DataFrame, share: float = SHARE) -> DataFrame:
    """(item_id, passage, gram, needed): the seeds of each passage, and how many of them make a candidate."""
    grams = tests.select("item_id", "passage", (F.octet_length("words") / 8).alias("length"), F.size("grams").alias("all"), F.explode("grams").alias("gram"))
    counted = grams.join(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram")
    rank = F.row_number().over(Window.partitionBy("item_id", "passage").orderBy("n", "gram"))
    in_copy = F.greatest(F.lit(1), F.ceil(F.col("length") * share) - GRAM + 1)
    kept = counted.withColumn("rank", rank).where((F.col("n") <= ITEMS) | (F.col("rank") <= F.col("all") - in_copy + SEEDS))
    return kept.select("item_id", "passage", "gram", F.least(F.lit(SEEDS), F.col("all")).alias("needed"))


def seed_table(grams: DataFrame) -> np.ndarray:
    """A bit table of seeds: slots are distinct table places, so at most 2**TABLE_BITS of them."""
    table = np.zeros(1 << TABLE_BITS - 3, np.uint8)
    slots = grams.select(F.col("gram").bitwiseAND((1 << TABLE_BITS) - 1).alias("slot")).groupBy(F.shiftright("slot", 3).alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(slot & 7 as int)))").alias("bits"))
    found = slots.select("byte", "bits").toArrow()
    table[found.column("byte").to_numpy()] = found.column("bits").to_numpy().astype(np.uint8)
    return table


def in_table(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    slot = g & np.uint64((1 << TABLE_BITS) - 1)
    return bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1


def regions(docs: DataFrame, spread: Broadcast[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Stretches of documents around grams that the bit table lets through: ``SEEDS`` of them, or one that the second
    table, of passages with a single gram, lets through."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lone = spread.value
        for part in rows_of(batches):
            out = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                w = word_hashes(text)
                g = gram_hashes(w)
                hits = np.flatnonzero(in_table(bits, g))
                if not len(hits):
                    continue
                breaks = np.flatnonzero((hits[1:] - hits[:-1] > PASSAGE)) + 1
                for run in np.split(hits, breaks):
                    for at in range(int(run[0]), int(run[-1]) + 1, REGION - PASSAGE):  # long runs in overlapping pieces
                        inside = run[(run >= at) & (run < at + REGION)]
                        if len(inside) >= SEEDS or in_table(lone, g[inside]).any():
                            lo, hi = max(0, at - PASSAGE), min(len(w), int(inside[-1]) + GRAM + PASSAGE)
                            out.append((doc_id, lo, w[lo:hi].tobytes(), np.unique(g[inside]).view(np.int64)))
            if out:
                yield batch(_REGIONS, *(list(c) for c in zip(*out, strict=True)))

    return keyed(docs).mapInArrow(cut, "doc_id long, region long, words binary, grams array<long>")


def alignment_share(a: np.ndarray, b: np.ndarray) -> float:
    """Smith-Waterman score of the best local alignment, as a share of a perfect copy of ``a``.

    One row per word of ``a``; inside a row the best run of gaps is a running maximum."""
    n = len(b)
    slope = np.arange(n + 1, dtype=np.int64) * GAP
    row = np.zeros(n + 1, np.int64)
    best = 0
    for word in a:
        here = np.maximum(row + GAP, 0)
        here[1:] = np.maximum(here[1:], row[:-1] + np.where(b == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(here - slope) + slope
        best = max(best, int(row.max()))
    return best / (MATCH * len(a)) if len(a) else 0.0


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, name: str = "op7") -> DataFrame:
    """One row per document and test item that it contains: doc_id, item_id, n_seeds, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, name)
    tests = scratch.save(passages(benchmark.where("text IS NOT NULL AND item_id IS NOT NULL")).where(F.size("grams") > 0), "passages")
    grams = scratch.save(seed_grams(tests, share), "seeds")
    spread = spark.sparkContext.broadcast((seed_table(grams), seed_table(grams.where("needed = 1"))))  # of fixed size
    found = scratch.save(regions(docs, spread), "regions")
    spread.destroy()
    hits = found.select("doc_id", "region", F.explode("grams").alias("gram"))
    hits = scratch.save(hits.join(grams.select("gram").distinct(), "gram", "left_semi"), "hits")

    frequent = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    frequent = scratch.save(frequent.select("gram", F.floor(F.col("n") / HOT + 1).alias("parts")), "frequent")
    frequent = F.broadcast(frequent) if frequent.count() <= FEW else frequent
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = hits.join(frequent, "gram", "left").select("gram", F.pmod(F.xxhash64("doc_id", "region"), parts).alias("part"), "doc_id", "region")
    seeds = grams.join(frequent, "gram", "left").select("gram", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "item_id", "passage", "needed")
    pairs = dealt.join(seeds, ["gram", "part"]).groupBy("doc_id", "region", "item_id", "passage", "needed").agg(F.count_distinct("gram").alias("n_seeds")).where("n_seeds >= needed")
    rows = (pairs.join(tests.select("item_id", "passage", F.col("words").alias("test")), ["item_id", "passage"])
            .join(found.select("doc_id", "region", "words"), ["doc_id", "region"]))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_seeds", pa.int64()), ("score", pa.float64())])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            a, b = part.column("test").to_pylist(), part.column("words").to_pylist()
            scores = [score(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)]
            yield batch(schema, part.column("doc_id"), part.column("item_id"), part.column("n_seeds"), scores)

    def score(a: np.ndarray, b: np.ndarray) -> float:
        most = np.isin(a, b).mean()  # each match needs a word of the passage that the region holds
        return alignment_share(a, b) if most >= share else float(most)

    aligned = rows.select("doc_id", "item_id", "n_seeds", "test", "words").mapInArrow(align, "doc_id long, item_id long, n_seeds long, score double")
    return scratch.last(aligned.where(F.col("score") >= share).groupBy("doc_id", "item_id").agg(F.max("n_seeds").alias("n_seeds"), F.max("score").alias("score")))
