"""Operator 10: removal of long repeated byte strings, by deep-shallow suffix sorting.

Every byte that a ``SPAN``-byte string covers is removed if that string also starts anywhere else,
in the same document or another.  Strings never cross documents.

Sorting all suffixes is not affordable, so suffixes are sorted around anchors.  Every SPAN-byte
window chooses as its anchor the 48-byte gram with the least hash inside it (the last of equals), which
depends on the window's bytes alone: equal windows choose equal grams at equal offsets.  About one byte
in 77 is an anchor.  Then

1. grams that occur once are dropped (counts by salted keys and a join);
2. anchors with equal contexts, the bytes that their windows cover, fall together (a grouped count
   on hashes of 64 and 64 bits): all their windows are repeated;
3. grams with several contexts need their bytes.  One context of each kind is cut out of its text;
   the strings to the right and to the left of a gram are put in order by deep-shallow sorting, and the
   orders and common prefixes tell which windows occur twice;
4. windows become spans, spans are merged in each document, and the bytes go.

A gram with more than ``HOT`` contexts is too much for one task to sort.  Its windows are dealt out
singly instead, each under a 128-bit hash of its bytes, and counted by salted keys.

Cases: null and empty texts have no bytes and no spans; texts under SPAN bytes stay whole; runs of
one byte repeat within their document; repeated rows are repeats of each other; rows of one doc_id
with different texts are judged each by its own text; rows without a doc_id are left out; further
columns are ignored; an empty table gives an empty result; very long texts are searched in chunks
that overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm.common import batch, group_sizes, keyed, mix64, rows_of, salt, Scratch
from candlewright.llm.minhash import pack_text, unpack_text
from candlewright.llm.suffix_sort import repeated_offsets

SPAN, GRAM = 200, 48
WINDOW = SPAN - GRAM + 1
HOT, CHUNK = 20_000, 1 << 20
_rng = np.random.default_rng(77)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = 0x9E3779B97F4A7C15
_POS = np.uint64((1 << 28) - 1)
_ANCHORS = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("copy", pa.int64()), ("at", pa.int64())])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_M, n, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings, by doubling."""
    h = {1: _BYTE[data]}
    for n in (1, 2, 4, 8, 16):
        h[2 * n] = h[n][:-n] * _power(n)
        h[2 * n] += h[n][n:]
    gram = h[32][: len(data) - GRAM + 1] * _power(16)
    gram += h[16][32:]
    return gram


def _context_hashes(gram: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the bytes first..last+SPAN, from grams that cover them."""
    h = (last - first).astype(np.uint64)
    for at in (first, last):
        for step in (0, 48, 96, 144, SPAN - GRAM):
            h = mix64(h * np.uint64(_M) + gram[at + step])
    return h


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    n = len(x)
    rows = -(-n // width)
    full = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    full = full.reshape(rows, width)
    ahead = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(full, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def find_anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: text number, gram hash, context hash, and position
    of the anchor with the least and most offset of its windows, packed as pos<<16 | least<<8 | most."""
    nothing = tuple(np.empty(0, np.int64) for _ in range(4))
    lengths = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < SPAN or lengths.max() < SPAN:
        return nothing
    starts = np.cumsum(lengths) - lengths
    gram = gram_hashes(data)
    order = gram * np.uint64(_M)
    order &= ~_POS
    order |= np.arange(int(_POS), int(_POS) - len(gram), -1, dtype=np.uint64)
    least = _sliding_least(order, WINDOW)
    valid = np.zeros(len(least) + 1, np.int8)
    fits = lengths >= SPAN
    np.add.at(valid, starts[fits], 1)
    np.add.at(valid, starts[fits] + lengths[fits] - SPAN + 1, -1)
    p = np.flatnonzero(np.cumsum(valid[:-1]))
    anchor = (_POS - (least[p] & _POS)).astype(np.int64)
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)) + 1
    lo, hi = np.append(0, cut), np.append(cut - 1, len(p) - 1)
    first, last, a = p[lo], p[hi], anchor[lo]
    text = np.searchsorted(starts, first, side="right") - 1
    most, fewest = a - first, a - last
    context = _context_hashes(gram, first, last)
    return text, mix64(gram[a]).view(np.int64), context.view(np.int64), (a - starts[text]) << 16 | fewest << 8 | most


def copy_key(text: bytes) -> int:
    """Tells the rows of one doc_id apart: Spark's own xxhash64 of the text, so that others can join by it."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, blob): texts compressed before they are shuffled."""
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("blob", pa.binary())])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            texts = part.column(1).to_pylist()
            yield batch(schema, part.column(0), [copy_key((t or "").encode()) for t in texts], [pack_text(t) for t in texts])

    return keyed(docs).mapInArrow(squeeze, "doc_id long, copy long, blob binary")


def anchors(docs: DataFrame) -> DataFrame:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, text_bytes=1 << 16):
            ids = part.column(0).to_numpy()
            texts = [(t or "").encode() for t in part.column(1).to_pylist()]
            copies = np.array([copy_key(t) for t in texts], np.int64)
            chunks = [(i, at) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - SPAN + 1), CHUNK)]  # each window begins in one chunk
            for k in range(0, len(chunks), len(texts)):
                row, base = (np.array(x) for x in zip(*chunks[k : k + len(texts)], strict=True))
                text, gram, context, at = find_anchors([texts[i][b : b + CHUNK + SPAN - 1] for i, b in zip(row.tolist(), base.tolist(), strict=True)])
                if len(text):
                    yield batch(_ANCHORS, gram, context, ids[row[text]], copies[row[text]], at + (base[text] << 16))

    return keyed(docs).mapInArrow(found, "gram long, context long, doc_id long, copy long, at long")


def _contexts(kinds: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of one context of each kind (gram, n, doc_id, copy, at)."""
    wanted = kinds.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("gram", "n", "at")).alias("wanted"))
    rows = packed(docs).dropDuplicates(["doc_id", "copy"]).join(wanted, ["doc_id", "copy"]).select("doc_id", "copy", "blob", "wanted")
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("copy", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("least", pa.int32()), ("most", pa.int32()), ("bytes", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, rows=256):
            out = []
            for doc_id, copy, blob, wanted in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                data = unpack_text(blob)
                for w in wanted:
                    pos, least, most = w["at"] >> 16, w["at"] >> 8 & 255, w["at"] & 255
                    out.append((w["gram"], doc_id, copy, w["at"], w["n"], least, most, data[pos - most : pos - least + SPAN]))
                    if len(out) >= 8192:
                        yield batch(schema, *(list(c) for c in zip(*out, strict=True)))
                        out = []
            if out:
                yield batch(schema, *(list(c) for c in zip(*out, strict=True)))

    return rows.mapInArrow(cut, "key long, doc_id long, copy long, at long, n long, least int, most int, bytes binary")


def _windows(contexts: DataFrame) -> DataFrame:
    """Every window of some contexts by itself: gram, offset and a hash of its bytes, and its place."""
    schema = pa.schema([("key", pa.int64()), ("offset", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("copy", pa.int64()), ("begin", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, rows=256):
            out, digests = [], []
            for key, doc_id, copy, at, least, most, data in zip(*(part.column(c).to_pylist() for c in ("key", "doc_id", "copy", "at", "least", "most", "bytes")), strict=True):
                for offset in range(least, most + 1):
                    digests.append(xxhash.xxh3_128_digest(data[most - offset : most - offset + SPAN]))
                    out.append((key, offset, doc_id, copy, (at >> 16) - offset))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            key, offset, doc_id, copy, begin = zip(*out, strict=True)
            yield batch(schema, list(key), list(offset), halves[:, 0], halves[:, 1], list(doc_id), list(copy), list(begin))

    return contexts.mapInArrow(deal, "key long, offset int, w1 long, w2 long, doc_id long, copy long, begin long")


def _counted(contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """Spans of the windows that occur in two contexts of a hot gram."""
    keys, place = ["key", "offset", "w1", "w2"], ["doc_id", "copy", "begin"]
    windows = scratch.save(_windows(contexts), "windows")
    sizes = group_sizes(windows, keys, place, scratch, "window-counts")
    twice = windows.withColumn("salt", salt(windows.sparkSession, *place)).join(sizes, [*keys, "salt"], "left_semi")
    return twice.select("doc_id", "copy", "begin", (F.col("begin") + SPAN).alias("end"))


def _resolved(contexts: DataFrame) -> DataFrame:
    """Spans (doc_id, copy, begin, end) of windows that occur twice among different contexts of a gram."""
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])

    def spans(table: pa.Table) -> pa.RecordBatch | None:
        key, doc, copy, at, n, least, most = (table.column(c).to_numpy() for c in ("key", "doc_id", "copy", "at", "n", "least", "most"))
        data = table.column("bytes").to_pylist()
        groups = np.cumsum(np.append(0, key[1:] != key[:-1]))
        found = repeated_offsets([d[:m][::-1] for d, m in zip(data, most.tolist(), strict=True)], [d[m:] for d, m in zip(data, most.tolist(), strict=True)], least, most, groups, SPAN)
        found[n > 1] = False  # repeated whole, and known already
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, lo = np.nonzero(edge == 1)
        hi = np.nonzero(edge == -1)[1] - 1
        if not len(i):
            return None
        pos = at[i] >> 16
        return batch(schema, doc[i], copy[i], pos - hi, pos - lo + SPAN)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for part in rows_of(batches, rows=8192):
            key = part.column(0).to_numpy()
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            new = held and held[-1].column(0)[-1].as_py() != key[0]
            if size >= 8192 and (new or len(cut)):
                at = 0 if new else int(cut[0])
                if (out := spans(pa.Table.from_batches([*held, part.slice(0, at)]))) is not None:
                    yield out
                held, size, part = [], 0, part.slice(at)
            held.append(part)
            size += part.num_rows
        if held and (out := spans(pa.Table.from_batches(held))) is not None:
            yield out

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(resolve, "doc_id long, copy long, begin long, end long")


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Spans (doc_id, copy, begin, end), overlapping ones included, that repeated strings cover."""
    place = ["doc_id", "copy", "at"]
    twice = group_sizes(anchors(docs), ["gram"], place, scratch, "grams")
    dealt = anchors(docs).withColumn("salt", salt(docs.sparkSession, *place))
    shared = scratch.save(dealt.join(twice, ["gram", "salt"], "left_semi").drop("salt"), "anchors")
    shared = shared.withColumn("salt", salt(docs.sparkSession, *place))
    parts = scratch.save(shared.groupBy("gram", "context", "salt").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*place)).alias("one")), "parts")
    kinds = scratch.save(parts.groupBy("gram", "context").agg(F.sum("c").alias("n"), F.min("one").alias("one")).select("gram", "context", "n", "one.*"), "kinds")
    several = group_sizes(kinds, ["gram"], ["context"], scratch, "kind-counts").withColumnRenamed("n", "kinds")
    several = scratch.save(kinds.withColumn("salt", salt(docs.sparkSession, "context")).join(several, ["gram", "salt"]), "several")
    partial = scratch.save(_resolved(_contexts(several.where(F.col("kinds") <= HOT), docs)), "partial")
    hot = _counted(_contexts(several.where(F.col("kinds") > HOT), docs), scratch)
    often = parts.select("gram", "context", "salt").join(kinds.where("n > 1").select("gram", "context"), ["gram", "context"])  # a row for each salt of a context
    whole = shared.join(often, ["gram", "context", "salt"], "left_semi")
    pos = F.shiftright("at", 16)
    whole = whole.select("doc_id", "copy", (pos - F.col("at").bitwiseAND(255)).alias("begin"), (pos - F.shiftright("at", 8).bitwiseAND(255) + SPAN).alias("end"))
    return whole.unionByName(partial).unionByName(hot)


def remove_repeats(docs: DataFrame, name: str = "op10", with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, where asked for, copy (the
    xxhash64 of the row's text, empty for null) and the remaining text (bytes that no longer form a character are left out of it)."""
    scratch = Scratch(docs.sparkSession, name)
    spans = scratch.last(repeated_spans(docs, scratch).groupBy("doc_id", "copy").agg(F.collect_set(F.struct("begin", "end")).alias("spans")))
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("copy", pa.int64()), ("kept_text", pa.string())] * with_text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, rows=512):
            out = []
            for doc_id, copy, blob, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "copy", "blob", "spans")), strict=True):
                data = unpack_text(blob)
                kept, runs, done = [], 0, 0
                merged_end = -1
                for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
                    if begin > merged_end:
                        kept.append(data[done:begin])
                        runs += 1
                    done = merged_end = max(end, merged_end)
                kept.append(data[done:])
                rest = b"".join(kept)
                row = (doc_id, len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest())
                out.append((*row, copy, rest.decode(errors="ignore")) if with_text else row)
            yield batch(schema, *(list(c) for c in zip(*out, strict=True)))

    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", copy long, kept_text string" * with_text
    return packed(docs).join(spans, ["doc_id", "copy"], "left").mapInArrow(cut, columns)
