"""Operators 11 to 13 against plain Python, with the awkward cases."""

import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from candlewright.llm import simhash, variants, whitening
from candlewright.llm.common import Scratch
from tests.llm.helpers import frame, texts, words

VECTORS = "vec_id long, embedding array<float>, label int, x string, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS).repartition(3)


def check_whitening(got, rows, d):
    whole = [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]
    x = {tuple(int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v) for _, v in whole}
    n, fit = len(x), np.array(sorted(x), np.int64)
    total = [sum(int(v) for v in fit[:, k]) for k in range(d)]
    mean = [Fraction(t, n) for t in total]
    cov = np.array([[float(sum((Fraction(int(v[i])) - mean[i]) * (Fraction(int(v[j])) - mean[j]) for v in fit) / n) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(16, int((values > d * 2.3e-16 * values[0]).sum()))
    assert len(got) == k * len(whole)
    signs = {}
    by_id = {}
    for i, v in whole:
        by_id.setdefault(i, []).append([int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v])
    seen = Counter()
    for r in got:
        c = r["component"] - 1
        near = []
        for own in by_id[r["vec_id"]]:
            expect = float(np.dot([float(a - m) for a, m in zip(own, mean)], axes[:, c]) / np.sqrt(values[c]))
            near.append((abs(abs(expect) - abs(r["whitened"])), expect, own))
        miss, expect, own = min(near)
        assert miss < 1e-6
        if abs(expect) > 1e-3:
            signs.setdefault(c, set()).add(np.sign(expect * r["whitened"]))
        assert r["n"] == n and abs(r["explained"] / (values[c] / np.trace(cov)) - 1) < 1e-9 and r["identity_error"] < 1e-6
        if len(by_id[r["vec_id"]]) == 1:
            assert r["deviation"] == sum((n * a - t) ** 2 for a, t in zip(own, total))
        seen[r["vec_id"], c] += 1
    assert all(len(s) == 1 for s in signs.values()) and all(seen[i, c] == len(v) for i, v in by_id.items() for c in range(k))


@pytest.mark.parametrize("d", [20, 3])
def test_whitening(spark, monkeypatch, d):
    monkeypatch.setattr(whitening, "PAIRS", 50)
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(d, d))
    rows = [(i, (rng.normal(size=d) @ mix / 8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(7, rows[8][1]), (None, rows[3][1])]
    rows += [(200, None), (201, [None] * d), (202, [float("nan")] + [0.0] * (d - 1)), (203, [float("-inf")] + [0.0] * (d - 1)), (204, []), (205, [1.0] * (d + 1)), (206, [-0.0] * d)]
    check_whitening(whitening.whitened(vectors(spark, rows)).collect(), rows, d)


def test_whitening_of_little(spark):
    assert whitening.whitened(vectors(spark, [])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect() == []
    line = whitening.whitened(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 2.0]), (3, [0.5, 3.0])])).collect()
    assert [(r["vec_id"], r["component"], round(abs(r["whitened"]), 6)) for r in sorted(line)] == [(1, 1, 1.224745), (2, 1, 0.0), (3, 1, 1.224745)]


def test_whitening_beyond_a_long(spark):
    rows = whitening.whitened(vectors(spark, [(1, [1e14, 0.0]), (2, [-1e14, 1.0]), (3, [0.0, 2.0])])).collect()
    assert {r["vec_id"]: r["deviation"] is None for r in rows} == {1: True, 2: True, 3: False}
    moved, deviation = whitening.centred(np.array([[5, 7]]), 3, np.array([12, 24]))
    assert deviation == [18] and moved.tolist() == [[1.0, -1.0]]


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_components(prints):
    parent = {i: i for i, _ in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if (a ^ b).bit_count() <= 2:
                a_, b_ = find(i), find(j)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i, _ in prints}


def clouds(rng):
    """Texts can't be made to measure, so fingerprints are: dense clouds, chains of two flips, and random ones."""
    out = [rng.getrandbits(64) for _ in range(300)]
    for centre in out[:3]:
        out += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)]
    chain = out[5]
    for _ in range(60):
        chain ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        out.append(chain)
    low = rng.getrandbits(64)
    return out + [low ^ rng.getrandbits(9) for _ in range(200)] + [low ^ (rng.getrandbits(12) << 40) for _ in range(200)]


@pytest.mark.parametrize(("block", "small"), [(512, 24), (4, 2), (24, 5)])
def test_simhash_links_equal_all_pairs(spark, monkeypatch, block, small):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL", small)
    prints = sorted(set(clouds(random.Random(3))))
    heads = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(prints)], "fp long, head long").repartition(3)
    groups = simhash.grouped_bits(*simhash.bit_pairs(heads))
    assert sorted(b for g in groups for b in g) == list(range(64)) and [len(g) for g in groups] == [22, 21, 21]
    scratch = Scratch(spark, "test")
    rows = simhash.sparse_rows(heads, groups, simhash.histograms(heads, groups), scratch)
    links = [(r["u"], r["v"]) for r in simhash.near_in_values(rows).collect()]
    assert all(0 < (prints[u] ^ prints[v]).bit_count() <= 2 for u, v in links)
    joined = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(links, "u long, v long"), scratch, "c").collect()}
    assert {i: joined.get(i, i) for i in range(len(prints))} == plain_components(list(enumerate(prints)))


def test_simhash_thresholds_are_the_cheapest():
    rng = np.random.default_rng(9)
    groups = [list(range(k, 12, 3)) for k in range(3)]
    fp = rng.integers(0, 1 << 12, 40).astype(np.uint64)
    histogram = rng.integers(0, 50, (3, simhash.CELLS))

    def cost(f, k, t):
        v = simhash.values(np.array([f], np.uint64), groups[k])
        return sum(histogram[k][simhash.cells(v ^ m)][0] + simhash.PROBE for masks in simhash.flips(4, t) for m in masks) if t >= 0 else 0

    chosen = simhash.thresholds(fp, groups, histogram)
    for n, f in enumerate(fp):
        options = [(cost(f, 0, a) + cost(f, 1, b) + cost(f, 2, -a - b)) for a in range(-1, 3) for b in range(-1, 3) if -1 <= -a - b <= 2]
        assert chosen[:, n].sum() == 0 and np.isclose(sum(cost(f, k, int(chosen[k, n])) for k in range(3)), min(options))


def test_simhash_groups_correlated_bits():
    rng = np.random.default_rng(2)
    half = rng.integers(0, 2, (500, 32))
    bits = np.concatenate([half, half], axis=1)  # bit b goes with bit b + 32
    groups = simhash.grouped_bits(500, bits.T @ bits)
    assert sum(b + 32 in g for g in groups for b in g) >= 30


def test_near_fingerprints(spark):
    rng = random.Random(8)
    long = words(rng, 400)
    rows = texts() + [(200, " ".join(long)), (201, " ".join(long[:-1] + ["other"])), (202, " ".join(long[:200])), (203, "É é A"), (203, "x y z w"), (204, "x y z w"), (205, "É É a")]
    got = spark.createDataFrame([], "doc_id long") if not rows else simhash.near_fingerprints(frame(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    got = got.collect()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    assert sorted((r["doc_id"], r["fingerprint"]) for r in got) == sorted((i, f"{f:016x}") for i, f in prints)
    expect = plain_components(prints)
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(expect.items()) and expect[203] != 0
    assert simhash.near_fingerprints(frame(spark, [])).collect() == []
    assert simhash.near_fingerprints(frame(spark, [(None, "a b c d")])).collect() == []


def plain_variants(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in variants.RUN.findall((text or "").encode().lower().decode()):
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            k = h % len(run)
            run = run[:k] + run[k + 1 :] if h % 97 == 0 else run
            total[run] += len(run) >= 5
    n = {w: c for w, c in total.items() if c >= 3}

    def distance(a, b):
        if abs(len(a) - len(b)) > 1:
            return 2
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    near = {w: [u for u in n if distance(w, u) == 1] for w in n}
    form = {w: min(us, key=lambda u: (-n[u], u)) for w, us in near.items() if us}
    form = {w: u for w, u in form.items() if n[u] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, n[w], form.get(w), root(w), len(near[w]), n.get(form.get(w))) for w in n}


def misspelt(rng):
    base = ["color", "colour", "colours", "couleur", "naïve", "schöne", "schönes", "inter", "interx", "abcdef", "élève", "ÉLÈVE", "Colour"]
    letters = "abcdeéïöü"
    for _ in range(25):
        base.append("".join(rng.choice(letters[:4]) for _ in range(rng.randint(4, 7))))
    out = []
    for w in base:
        for k in range(rng.randint(1, 6)):
            v = list(w)
            at = rng.randrange(len(v))
            (lambda: v.pop(at), lambda: v.insert(at, rng.choice(letters)), lambda: v.__setitem__(at, rng.choice(letters)))[k % 3]()
            out += ["".join(v)] * rng.choice([2, 3, 5, 9])
        out += [w] * rng.choice([3, 10, 40])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("shard", "few"), [(40_000, 64), (7, 0), (25, 3)])
def test_variants(spark, monkeypatch, shard, few):
    monkeypatch.setattr(variants, "FEW", few)
    monkeypatch.setattr(variants, "PIECE", 50)
    monkeypatch.setattr(variants, "FLUSH", 20)
    rng = random.Random(shard)
    runs = misspelt(rng)
    rows = [(i, " ".join(runs[i * 30 : i * 30 + 30]) + "-1\n×÷½") for i in range(len(runs) // 30 + 1)]
    rows += [(None, "colour schönes colour"), (900, None), (901, ""), (902, "abcd " * 50 + "z" * 300), (903, "word" * 60), (3, rows[3][1])] + [(904 + k, "z" * 300 + " " + "z" * 150 + "y" + "z" * 149) for k in range(4)]
    got = variants.variants(frame(spark, rows), shard=shard)
    assert got.columns == ["word", "n", "form", "root", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == plain_variants(rows)


def test_variants_of_nothing(spark):
    assert variants.variants(frame(spark, [])).collect() == []
    assert variants.variants(frame(spark, [(1, None), (2, "a bb ccc"), (3, "single words only")])).collect() == []


def test_one_edit():
    assert all(variants.one_edit(a, b) for a, b in (("abc", "abd"), ("abc", "ab"), ("abc", "xabc"), ("", "a"), ("aab", "ab")))
    assert not any(variants.one_edit(a, b) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "a"), ("", "")))
