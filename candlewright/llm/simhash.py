"""Operator 12: near-duplicate documents by SimHash and the general pigeonhole principle.

Fingerprint.  Words are runs of bytes other than space and the ASCII control white space, after A-Z are
lower-cased.  A bit of the 64 is set if it is set in over half of the XXH64 hashes (seed 42) of the text's
3-word shingles, repeats included.

Search.  Fingerprints are linked at ``DISTANCE`` or fewer differing bits.  The bits are divided into ``PARTS``
partitions.  If thresholds of the partitions (-1: not looked at) sum to DISTANCE - PARTS + 1, two linked
fingerprints differ in some partition by at most its threshold.

1. Correlated bits are grouped: the 64 x 64 counts of set bits over all fingerprints are summed in Spark, and a
   greedy choice puts bits together that go together, so that the partitions tell fingerprints apart
   independently of each other.
2. A histogram of each partition's values (``CELLS`` cells, all fingerprints) estimates how many candidates a
   threshold brings.  For each fingerprint a dynamic programme over partitions allocates unequal thresholds of least
   estimated cost, so a value that very many share is avoided if another is rare.
3. Each fingerprint lies under its value of every partition and probes those values that its thresholds reach.
   What meets under a value is verified on all 64 bits.

A value where over ``BLOCK`` x ``BLOCK`` comparisons would meet is divided by the same principle: the bits that it doesn't
fix are cut in three, one of which linked fingerprints have equal.  That is repeated until few bits are
left, where few different fingerprints exist, so the rows of a dense cloud grow in proportion to it (at most 3^5 each).  Links are
emitted as a spanning forest of each value's fingerprints, never all pairs; only values of up to ``SMALL`` emit all their links.

Each distinct fingerprint is searched for once, with its least document for a name; copies are counted by salted keys,
one part for each shuffle partition, and get their component back by the same keys.

Cases: null texts and texts without words have fingerprint zero and are linked like any other; each row of the input
gives one row; rows of one doc_id with different texts are one document to the links, so what links either links both;
rows without a doc_id are left out; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm.common import batch, keyed, mix64, rows_of, salt, Scratch
from candlewright.llm.components import components

SHINGLE, SEED, BITS, DISTANCE, PARTS = 3, 42, 64, 2, 3
CELLS, BLOCK, SMALL, FEW_BITS = 1 << 16, 512, 24, 9
#: What one more probe costs, in candidates.
PROBE = 2.0
_ROWS = pa.schema([("key", pa.int64()), ("path", pa.int32()), ("fp", pa.int64()), ("head", pa.int64()), ("role", pa.int8())])
ROWS = "key long, path int, fp long, head long, role byte"
MEMBER, PROBER, BOTH = 0, 1, 2


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        h = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        digest = xxhash.xxh64_intdigest
        h = [digest(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :])]
    bits = np.array(h, "<u8").view(np.uint8).reshape(-1, 8)
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(bits), 1 << 16):
        count += np.unpackbits(bits[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row; fp as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            found = np.fromiter((fingerprint(t.as_py()) for t in part.column(1)), np.uint64, part.num_rows)
            yield batch(schema, part.column(0), found.view(np.int64))

    return keyed(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(prints, "doc_id long, fp long")


def bit_pairs(heads: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints, and how many have both of two bits set, for every pair of bits."""
    schema = pa.schema([("i", pa.int32()), ("c", pa.int64())])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1), np.int64)
        for part in rows_of(batches, 1 << 14):
            ones = np.unpackbits(part.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.concatenate([ones, np.ones((len(ones), 1), np.uint8)], axis=1).astype(np.float32)
            total += (ones.T @ ones).astype(np.int64)
        yield batch(schema, np.arange(total.size, dtype=np.int32), total.ravel())

    got = heads.select("fp").mapInArrow(counts, "i int, c long").groupBy("i").agg(F.sum("c").alias("c")).toPandas()
    total = np.zeros((BITS + 1) ** 2, np.int64)
    total[got["i"].to_numpy(int)] = got["c"].to_numpy()
    total = total.reshape(BITS + 1, BITS + 1)
    return int(total[BITS, BITS]), total[:BITS, :BITS]


def grouped_bits(n: int, both: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """The bits in ``parts`` groups of nearly equal size; correlated bits go together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(p * (1 - p))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.nan_to_num(np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)), posinf=0.0)
    np.fill_diagonal(r, 0)
    left, groups = list(range(len(p))), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        group = [max(left, key=lambda b: (r[b, left].sum(), -b))]
        while len(group) < size:
            group.append(max((b for b in left if b not in group), key=lambda b: (r[b, group].sum(), -b)))
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits at the given places, as one number."""
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def cells(v: np.ndarray) -> np.ndarray:
    return (mix64(v) & np.uint64(CELLS - 1)).astype(np.int64)


def flips(width: int, threshold: int) -> list[np.ndarray]:
    """Masks that change 0, 1, ... up to ``threshold`` bits of a value."""
    return [np.array([sum(1 << b for b in c) for c in itertools.combinations(range(width), k)], np.uint64) for k in range(threshold + 1)]


def histograms(heads: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """How many fingerprints have their value of each group in each cell."""
    schema = pa.schema([("part", pa.int32()), ("cell", pa.int32()), ("c", pa.int64())])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(groups), CELLS), np.int64)
        for part in rows_of(batches, 1 << 14):
            fp = part.column(0).to_numpy().view(np.uint64)
            for k, bits in enumerate(groups):
                total[k] += np.bincount(cells(values(fp, bits)), minlength=CELLS)
        k, cell = np.nonzero(total)
        yield batch(schema, k.astype(np.int32), cell.astype(np.int32), total[k, cell])

    got = heads.select("fp").mapInArrow(counts, "part int, cell int, c long").groupBy("part", "cell").agg(F.sum("c").alias("c")).toPandas()
    total = np.zeros((len(groups), CELLS), np.int64)
    total[got["part"].to_numpy(int), got["cell"].to_numpy(int)] = got["c"].to_numpy()
    return total


def thresholds(fp: np.ndarray, groups: list[list[int]], histogram: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """A threshold for each fingerprint and group, -1 to ``distance``: they sum to distance - groups + 1 and their
    estimated candidates and probes are the fewest."""
    cost = np.zeros((len(groups), distance + 2, len(fp)))  # [.., t + 1, ..] of threshold t
    for k, bits in enumerate(groups):
        v = values(fp, bits)
        for t, masks in enumerate(flips(len(bits), distance)):
            met = np.zeros(len(fp))
            for mask in masks:
                met += histogram[k][cells(v ^ mask)]
            cost[k, t + 1] = cost[k, t] + met + PROBE * len(masks)
    best = np.full((distance + 2, len(fp)), np.inf)
    best[0], chosen = 0, []
    for k in range(len(groups)):
        options = np.full((distance + 2, distance + 2, len(fp)), np.inf)  # [sum of t + 1, own t + 1]
        for s in range(distance + 2):
            for t in range(s + 1):
                options[s, t] = best[s - t] + cost[k, t]
        chosen.append(options.argmin(axis=1))
        best = options.min(axis=1)
    out, s, at = np.empty((len(groups), len(fp)), np.int64), np.full(len(fp), distance + 1), np.arange(len(fp))
    for k in reversed(range(len(groups))):
        t = chosen[k][s, at]
        out[k], s = t - 1, s - t
    return out


def keys(v: np.ndarray, path: int) -> np.ndarray:
    return mix64(v + mix64(np.array([path], np.uint64))).view(np.int64)


def placed(heads: DataFrame, groups: list[list[int]], histogram: np.ndarray) -> DataFrame:
    """The rows of ROWS: each fingerprint under its value of every group, and under those that it probes."""
    sent = heads.sparkSession.sparkContext.broadcast(histogram)  # PARTS x CELLS numbers at any size

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, 1 << 13):
            fp, head = part.column(0).to_numpy().view(np.uint64), part.column(1).to_numpy()
            t = thresholds(fp, groups, sent.value)
            for k, bits in enumerate(groups):
                v, path = values(fp, bits), np.full(len(fp), k, np.int32)
                yield batch(_ROWS, keys(v, k), path, fp.view(np.int64), head, np.where(t[k] >= 0, BOTH, MEMBER).astype(np.int8))
                for reach, masks in enumerate(flips(len(bits), DISTANCE)):
                    own = np.flatnonzero(t[k] >= reach)
                    if reach and len(own):
                        for mask in masks:
                            yield batch(_ROWS, keys(v[own] ^ mask, k), path[own], fp[own].view(np.int64), head[own], np.full(len(own), PROBER, np.int8))

    return heads.select("fp", "head").mapInArrow(place, ROWS)


def open_bits(path: int, groups: list[list[int]]) -> list[int]:
    """The bits that a value of this path doesn't fix.  A path is a group's number, then digits 1 to 3 in base 4."""
    steps = []
    while path >= 4:
        path, step = divmod(path, 4)
        steps.append(step - 1)
    left = [b for k, bits in enumerate(groups) if k != path for b in bits]
    for step in reversed(steps):
        left = [b for k, piece in enumerate(np.array_split(left, 3)) if k != step for b in piece.tolist()]
    return left


def divided(rows: DataFrame, groups: list[list[int]]) -> DataFrame:
    """Rows of crowded values under each third of the bits that are open there."""

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, 1 << 14):
            key, path, fp, head, role = (c.to_numpy() for c in part.columns)
            for p in np.unique(path).tolist():
                own = np.flatnonzero(path == p)
                for step, piece in enumerate(np.array_split(open_bits(p, groups), 3)):
                    v = values(fp[own].view(np.uint64), piece.tolist()) + key[own].view(np.uint64)
                    to = p * 4 + step + 1
                    yield batch(_ROWS, keys(v, to), np.full(len(own), to, np.int32), fp[own], head[own], role[own])

    return rows.mapInArrow(divide, ROWS)


def sparse_rows(heads: DataFrame, groups: list[list[int]], histogram: np.ndarray, scratch: Scratch) -> DataFrame:
    """All rows of ROWS, crowded values divided."""
    rows, paths, done = scratch.save(placed(heads, groups, histogram), "placed"), list(range(len(groups))), []
    for level in itertools.count():
        paths = [p for p in paths if len(open_bits(p, groups)) > FEW_BITS]
        members, probers = (F.sum((F.col("role") != other).cast("long")) for other in (PROBER, MEMBER))
        sizes = rows.where(F.col("path").isin(paths)).groupBy("key").agg(members.alias("m"), probers.alias("q"))
        crowded = scratch.save(sizes.where(F.col("m") * F.col("q") > BLOCK * BLOCK).select("key"), f"crowded-{level}")
        if crowded.isEmpty():
            break
        done.append(rows.join(crowded, "key", "left_anti").select(*_ROWS.names))
        rows = scratch.save(divided(rows.join(crowded, "key", "left_semi").select(*_ROWS.names), groups), f"divided-{level}")
        paths = [p * 4 + step for p in paths for step in (1, 2, 3)]
    for part in done:
        rows = rows.unionByName(part)
    return rows


def near_in_values(rows: DataFrame) -> DataFrame:
    """Links (u, v), u < v, among the fingerprints under each value, enough to connect all that are linked there."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def few(fp: np.ndarray, head: np.ndarray, role: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = starts[:, None] + np.arange(size)
        near = np.bitwise_count(fp[at][:, :, None] ^ fp[at][:, None, :]) <= DISTANCE
        near &= (role[at] != MEMBER)[:, :, None] & (role[at] != PROBER)[:, None, :]
        g, i, j = np.nonzero(near)
        return head[at[g, i]], head[at[g, j]]

    def forest(fp: np.ndarray, head: np.ndarray, role: np.ndarray) -> tuple[list, list]:
        members, label = np.flatnonzero(role != PROBER), np.arange(len(fp))
        us, vs = [], []
        for q in np.flatnonzero(role != MEMBER).tolist():
            near = members[np.bitwise_count(fp[members] ^ fp[q]) <= DISTANCE]
            for other in np.unique(label[near]).tolist():
                if other != label[q]:
                    us.append(head[q])
                    vs.append(head[near[label[near] == other][0]])
                    label[label == other] = label[q]
        return us, vs

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part in itertools.chain(batches, [None]):
            if part is not None:
                if not part.num_rows:
                    continue
                now = [part.column(c).to_numpy() for c in ("key", "fp", "head", "role")]
                held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
                if held[0][0] == held[0][-1]:
                    continue
            if not held:
                return
            key, fp, head, role = held[0], held[1].view(np.uint64), held[2], held[3]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            if part is not None:  # the last value may go on
                held = [x[starts[-1] :] for x in held]
                starts, sizes = starts[:-1], sizes[:-1]
            found = [few(fp, head, role, starts[sizes == s], s) for s in range(2, SMALL + 1) if (sizes == s).any()]
            found += [forest(fp[a : a + s], head[a : a + s], role[a : a + s]) for a, s in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True)]
            if found:
                u, v = (np.concatenate([np.asarray(f[k], np.int64) for f in found]) for k in (0, 1))
                low, high = np.minimum(u, v), np.maximum(u, v)
                if (apart := low < high).any():
                    yield batch(schema, low[apart], high[apart])

    return rows.select("key", "fp", "head", "role").repartition("key").sortWithinPartitions("key").mapInArrow(links, "u long, v long")


def near_fingerprints(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "op12")
    dealt_by = salt(spark, "doc_id").alias("salt")
    prints = scratch.save(fingerprints(docs), "prints")
    dealt = scratch.save(prints.groupBy("fp", dealt_by).agg(F.min("doc_id").alias("head")), "dealt")
    heads = scratch.save(dealt.groupBy("fp").agg(F.min("head").alias("head")), "heads")
    groups = grouped_bits(*bit_pairs(heads))
    rows = sparse_rows(heads, groups, histograms(heads, groups), scratch)
    several = prints.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")  # documents with several texts
    own = prints.join(several, "doc_id").join(heads, "fp").select(F.col("head").alias("u"), F.col("doc_id").alias("v"))
    joined = components(near_in_values(rows).unionByName(own), scratch, "joined")
    known = heads.join(joined.withColumnRenamed("node", "head"), "head", "left").select("fp", F.coalesce("component", "head").alias("component_id"))
    known = dealt.select("fp", "salt").join(known, "fp")
    out = prints.select("doc_id", "fp", dealt_by).join(known, ["fp", "salt"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
