"""Operator 6: near-duplicate documents by MinHash, banding and exact confirmation.

Sketch.  Words are runs of bytes other than space and the ASCII control white space, after A-Z are
lower-cased.  A document's set holds its distinct 5-word shingles (fewer words: the whole
sequence), each as a 64-bit hash.  128 universal hashes h(x) = a*x + b (mod 2^64, a odd) give 128
minima, in 32 bands of 4: a pair at similarity 0.75 shares no band with probability 5e-6.

Equal sets first fall into one class each, whose least document stands for it, so copies never meet
in a bucket.  A class is aggregated by salted keys, one part for each shuffle partition, and joined
back by them, so a class of a third of all rows is spread over all tasks.  Links are then found in
two rounds:

1. each document is checked against the least of the documents it shares buckets with;
2. in buckets that still hold documents not known to be linked, those are compared, block by
   block: their minima first (at similarity 0.75 an estimate under 0.55 is more than five deviations
   off, about 1 in 4 million pairs), then the full sets of those that have a partner by their minima; the
   texts of the others don't travel.  At most n-1 links leave a bucket of n.  Buckets beyond ``BLOCK``
   documents are compared in pairs of blocks, spread over tasks, with 256 bytes a document and block.

Each link is confirmed on full shingle sets.  Components come from alternating large-star and
small-star steps.

Cases: null texts and texts without words have an empty set, no links, and are kept; each row of the
input gives one row; rows of one doc_id with different texts are one document to the links, so what
links either links both; rows without a doc_id are left out; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm.common import batch, keyed, mix64, rows_of, salt, Scratch
from candlewright.llm.components import components

SHINGLE, HASHES, BANDS, BLOCK, PAIRS = 5, 128, 32, 1024, 256
#: Bytes of shingle sets that a task of the second round holds.
SETS = 128 << 20
#: Pairs whose share of equal minima is below this are not confirmed: five deviations under 0.75.
ESTIMATE = 0.55
_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2)
_MIX = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64())), ("minima", pa.binary()), ("blob", pa.binary())])
SKETCH_SCHEMA = "doc_id long, n long, h1 long, h2 long, bands array<long>, minima binary, blob binary"


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(w) < SHINGLE:
        return mix64(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64))
    h = w[: len(w) - SHINGLE + 1] * _MIX[0]
    for k in range(1, SHINGLE):
        h += w[k : len(w) - SHINGLE + 1 + k] * _MIX[k]
    return np.unique(mix64(h))


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over a set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 512):
        h = _A[:, None] * s[None, at : at + 512]
        h += _B[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = HASHES // BANDS
    keys = (least.reshape(-1, BANDS, rows) * _MIX[:rows]).sum(axis=2, dtype=np.uint64)
    return mix64(keys + np.arange(BANDS, dtype=np.uint64) * _MIX[15])


def sketch(docs: DataFrame) -> DataFrame:
    """One row per document: its set's size, a digest of it, band keys, minima, and its text compressed."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            texts = part.column(1).to_pylist()
            sets = [shingles(t) for t in texts]
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            halves = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            least = np.array([minima(s) for s in sets])
            keys = band_keys(least).view(np.int64)
            small = (least >> np.uint64(48)).astype("<u2")
            yield batch(_SKETCH, part.column(0), [len(s) for s in sets], halves[:, 0], halves[:, 1], [k if len(s) else [] for k, s in zip(keys, sets, strict=True)], [m.tobytes() for m in small],
                        [pack_text(t) if len(s) else None for t, s in zip(texts, sets, strict=True)])

    return keyed(docs).mapInArrow(sketches, SKETCH_SCHEMA)


def pack_text(text: str | None) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(1).compress((text or "").encode())


def unpack_text(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on sorted distinct arrays."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if not small or 100 * small < percent * large:
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches sorted by them.  A run is held whole, so callers
    bound its size by their keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for part in batches:
        if not part.num_rows:
            continue
        k = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), part.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(k[:, lo].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def confirmed_pairs(pairs: DataFrame, blobs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v), u < v, whose full sets are similar.  ``blobs``: (doc_id, blob), one or more
    texts per doc_id.

    The text of v travels to u's group; a group of many pairs is split, each part with u's text."""
    spread = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PAIRS).alias("parts"))
    pairs = pairs.join(spread, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts"))).select("u", "part", "v")
    heads = pairs.select("u", "part", F.col("u").alias("v")).distinct()
    rows = pairs.unionByName(heads).join(blobs.withColumnRenamed("doc_id", "v"), "v")
    rows = rows.repartition("u", "part").sortWithinPartitions("u", "part", "v")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_sets, done = None, [], None
        for part in rows_of(batches):
            out = []
            for u, p, v, blob in zip(*(part.column(c).to_pylist() for c in ("u", "part", "v", "blob")), strict=True):
                s = shingles(unpack_text(blob).decode())
                if head != (u, p):
                    head, head_sets = (u, p), []
                if u == v:  # the least of its group, so it comes first
                    head_sets.append(s)
                elif done != (u, v) and any(similar(h, s, percent) for h in head_sets):
                    done = (u, v)
                    out.append(done)
            if out:
                yield batch(schema, *(list(c) for c in zip(*out, strict=True)))

    return rows.select("u", "part", "v", "blob").mapInArrow(confirm, "u long, v long")


class _Group:
    """The documents of one pair of blocks of a bucket, with their minima."""

    def __init__(self, group: pa.Table):
        self.ids, self.component, self.block = (group.column(c).to_numpy() for c in ("doc_id", "component", "block"))
        self.minima = np.frombuffer(b"".join(group.column("minima").to_pylist()), "<u2").reshape(len(self.ids), HASHES)
        self.within = group.column("x")[0] == group.column("y")[0]

    def near(self, i: int) -> np.ndarray:
        """Later documents of other components (where there are two blocks: of the other block) whose minima could be those of a link."""
        later = i + 1 + np.flatnonzero(self.component[i + 1 :] != self.component[i])
        if not self.within:
            later = later[self.block[later] != self.block[i]]
        return later[(self.minima[later] == self.minima[i]).sum(axis=1) >= ESTIMATE * HASHES]


class _Sets:
    """Shingle sets of a group's texts, of which at most ``SETS`` bytes are held at a time."""

    def __init__(self, blobs: pa.ChunkedArray):
        self.blobs, self.held, self.size = blobs, {}, 0

    def __getitem__(self, i: int) -> np.ndarray:
        found = self.held.pop(i, None)
        if found is None:
            found = shingles(unpack_text(self.blobs[i].as_py()).decode())
            self.size += found.nbytes
        self.held[i] = found  # the last used is the last to go
        while self.size > SETS and len(self.held) > 2:
            self.size -= self.held.pop(next(iter(self.held))).nbytes
        return found


def candidates(members: DataFrame) -> DataFrame:
    """The documents of each pair of blocks that could be linked there, by minima alone, without their texts.

    ``members``: bucket, x, y (blocks), doc_id, block, component, minima, sorted by group.  A document is returned once for
    each group in which it has a partner, so a bucket of unlike texts returns nothing."""
    names = ["bucket", "x", "y", "doc_id", "block", "component"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["bucket", "x", "y"]):
            group = _Group(table)
            kept = np.zeros(len(group.ids), bool)
            for i in range(len(group.ids)):
                near = group.near(i)
                kept[near] = True
                kept[i] |= len(near) > 0
            if kept.any():
                rows = np.flatnonzero(kept)
                rows = rows[np.unique(group.ids[rows], return_index=True)[1]]
                yield from table.select(names).take(pa.array(rows)).combine_chunks().to_batches()

    return members.mapInArrow(pick, ", ".join(f"{c} long" for c in names))


def bucket_links(members: DataFrame, percent: int) -> DataFrame:
    """Links between documents of different components that share a bucket; ``component`` may be any
    label that linked documents have in common.

    ``members``: bucket, x, y (blocks), doc_id, block, component, minima, blob."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["bucket", "x", "y"]):
            group, sets = _Group(table), _Sets(table.column("blob"))
            root = {c: c for c in group.component.tolist()}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            out = []
            for i in range(len(group.ids)):
                for j in group.near(i).tolist():
                    a, b = find(int(group.component[i])), find(int(group.component[j]))
                    if a != b and similar(sets[i], sets[j], percent):
                        root[max(a, b)] = min(a, b)
                        out.append(sorted((int(group.ids[i]), int(group.ids[j]))))
            if out:
                yield batch(schema, *(list(c) for c in zip(*out, strict=True)))

    return members.mapInArrow(links, "u long, v long")


def _labels(first: DataFrame) -> DataFrame:
    """(doc_id, component): a document that each is already linked to, by two steps of first links."""
    up = first.select(F.col("v").alias("doc_id"), F.col("u").alias("near"))
    far = up.select(F.col("doc_id").alias("near"), F.col("near").alias("far"))
    return up.join(far, "near", "left").select("doc_id", F.coalesce("far", "near").alias("component"))


def _second_round(members: DataFrame, labels: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    placed = members.join(labels, "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.expr("bit_xor(xxhash64(doc_id))").alias("who")).where("lo <> hi")
    mixed = mixed.groupBy("n", "who").agg(F.min("bucket").alias("bucket"))  # buckets with the same documents need one look
    rows = placed.join(mixed.select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks")), "bucket")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    group, placing = ["bucket", "x", "y"], ["doc_id", "block", "component"]
    rows = rows.select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), *placing).join(heads.select("doc_id", "minima"), "doc_id")
    rows = candidates(rows.select(*group, *placing, "minima").repartition(*group).sortWithinPartitions(*group))
    rows = rows.join(heads.select("doc_id", "minima", "blob"), "doc_id").select(*group, *placing, "minima", "blob")
    rows = rows.repartition(*group).sortWithinPartitions(*group)
    return bucket_links(rows, percent)


def near_duplicates(docs: DataFrame, percent: int = 75, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "op6")
    dealt_by = salt(spark, "doc_id", "row").alias("salt")
    sketched = scratch.save(sketch(docs).withColumn("row", F.monotonically_increasing_id()), "sketch")
    full = sketched.where("n > 0")
    dealt = scratch.save(full.groupBy("h1", "h2", dealt_by).agg(F.min(F.struct("doc_id", "row")).alias("least"), F.count(F.lit(1)).alias("copies")), "dealt")
    classes = dealt.groupBy("h1", "h2").agg(F.min("least").alias("least"), F.sum("copies").alias("copies"))
    classes = scratch.save(classes.select("h1", "h2", F.col("least.doc_id").alias("head"), F.col("least.row").alias("row"), "copies"), "classes")
    heads = scratch.save(full.select("row", "doc_id", "bands", "minima", "blob").join(classes.select("row"), "row", "left_semi"), "heads")

    bands = heads.select("doc_id", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first")).where("size > 1").select("bucket", "first")
    members = scratch.save(bands.join(shared, "bucket").distinct(), "members")
    nearest = members.where("first < doc_id").groupBy("doc_id").agg(F.min("first").alias("u")).select("u", F.col("doc_id").alias("v"))
    first = scratch.save(confirmed_pairs(nearest, heads.select("doc_id", "blob"), percent), "first")
    second = _second_round(members.select("bucket", "doc_id"), _labels(first), heads, percent)
    several = sketched.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("doc_id")  # documents with several texts
    own = full.select("doc_id", "h1", "h2").join(several, "doc_id").join(classes.select("h1", "h2", "head"), ["h1", "h2"]).select(F.col("head").alias("u"), F.col("doc_id").alias("v"))
    joined = components(first.unionByName(second).unionByName(own), scratch, "joined")
    scratch.drop("heads", "members")

    known = classes.select("h1", "h2", "head", "copies").join(joined.withColumnRenamed("node", "head"), "head", "left").where("copies > 1 OR component IS NOT NULL")
    known = known.select("h1", "h2", F.coalesce("component", "head").alias("component"))
    known = dealt.select("h1", "h2", "salt").join(known, ["h1", "h2"])
    out = sketched.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2", dealt_by).join(known, ["h1", "h2", "salt"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
