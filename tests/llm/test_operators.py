"""Each corpus operator against plain Python, on small fixtures with the awkward cases."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from candlewright.llm import chat, contamination, langid, licenses, minhash, packing, quality, records, repeats, suffix_sort, toxicity
from candlewright.llm.common import Scratch
from tests.llm.helpers import frame, texts, words

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_records_round_trip(spark):
    special = [(90, "it's <|endoftext|>  naïve\r\n  x y 12 don't ÀÉ ’s"), (91, "Ünï-çødé\x1cα βγ"), (92, "x <|endoftext|> y"), (93, "a <|EndOfText|><|startoftext|>b"), (94, "<|endoftext"), (94, "twice"), (None, "none")]
    rows = texts() + special
    got = {r["doc_id"]: r for r in records.token_records(frame(spark, rows), WORD).collect()}
    start = 0
    for i, text in rows[:-3]:
        ids = ids_of(WORD, text)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc(ids)), i
        start += len(ids)
    assert records.token_records(frame(spark, []), WORD).count() == 0


def test_records_detect_damage_and_shuffle(spark):
    blob = records.frame(7, np.array([3, 4, 65535], "<u2")) + b"\n"
    assert records.parse(blob, 0)[0] == 7 and list(records.parse(blob, 0)[1]) == [3, 4, 65535]
    for at in range(len(blob) - 1):
        with pytest.raises(Exception):
            records.parse(blob[:at] + bytes([blob[at] ^ 1]) + blob[at + 1 :], 0)
    scratch = Scratch(spark, "test")
    records.write_records(frame(spark), scratch.path("s"), WORD, shard_bytes=2000)
    index = records.build_index(spark, scratch.path("s"), scratch.path("i"))
    a, b = ([r["doc_id"] for r in records.shuffled_read(spark, scratch.path("s"), index, seed, 1).collect()] for seed in (1, 2))
    assert sorted(a) == sorted(b) == [i for i, _ in texts()] and a != b
    start = 0
    for r in records.with_starts(index).orderBy("doc_id").collect():  # shards of a few records
        assert r["start"] == start
        start += r["n_tokens"]
    assert index.select("shard").distinct().count() > 5


def test_packing(spark):
    rows = texts() + [(92, "x <|endoftext|> y\n<|endoftext|>")]
    out = packing.pack(frame(spark, rows), BYTE, size=256, windows=4).toPandas()
    for i, text in rows:
        ids = ids_of(BYTE, text)
        mine = out[out.doc_id == i].sort_values("start")
        assert b"".join(mine.ids) == np.array(ids, "<u2").tobytes() and (mine.doc_tokens == len(ids)).all()
        for p in mine.itertuples():
            assert p.ids_crc32 == crc(ids[p.start : p.start + p.length])
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s.length.cumsum() - s.length == s.offset).all()
        n = s.length.sum()
        assert n == 256 or n < 256 and n & n - 1 == 0
    assert packing.pack(frame(spark, []), BYTE).count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(3)
    base = words(rng, 200)
    chain = []
    for k in range(14):  # neighbours are alike, ends are not
        base = [w if rng.random() > 0.02 else f"v{k}x{i}" for i, w in enumerate(base)]
        chain.append(" ".join(base))
    rows = texts() + [(100 + k, t) for k, t in enumerate(chain)] + [(200 + k, "same text of only five words here") for k in range(9)]
    want = brute_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_a_bucket_of_unlike_texts_sends_no_texts(spark, monkeypatch):
    """One bucket of many unlike documents in several blocks: only those with a partner by their minima go on."""
    monkeypatch.setattr(minhash, "SETS", 1)  # holds two sets at a time
    rng = random.Random(12)
    rows = [(k, " ".join(words(rng, 60))) for k in range(2500)]
    edited = rows[7][1].split()
    edited[20] = "edited"
    rows += [(5000 + k, " ".join([*edited, f"end{k}"])) for k in range(3)]
    heads = minhash.sketch(frame(spark, rows)).cache()
    ids = heads.select("doc_id")
    members = ids.selectExpr("1L AS bucket", "doc_id", "doc_id % 3 AS block", "doc_id AS component").join(heads.select("doc_id", "minima"), "doc_id")
    blocks = spark.createDataFrame([(x, y) for x in range(3) for y in range(x, 3)], "x long, y long")
    members = members.join(blocks, (members.block == blocks.x) | (members.block == blocks.y)).repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    assert {r["doc_id"] for r in minhash.candidates(members).collect()} == {7, 5000, 5001, 5002}
    sets = {i: set(minhash.shingles(t).tolist()) for i, t in rows}
    alike = {(u, v) for u in (7, 5000, 5001, 5002) for v in (5000, 5001, 5002) if u < v and 100 * len(sets[u] & sets[v]) >= 75 * len(sets[u] | sets[v])}
    bucket = ids.selectExpr("1L AS bucket", "doc_id")
    labels = spark.createDataFrame([], "doc_id long, component long")
    monkeypatch.setattr(minhash, "BLOCK", 900)
    found = {(r["u"], r["v"]) for r in minhash._second_round(bucket, labels, heads, 75).collect()}
    assert found <= alike and len(alike) == 6

    def reach(links):
        group = {7}
        while more := {w for pair in links for w in pair if group & set(pair)} - group:
            group |= more
        return group

    assert reach(found) == reach(alike) == {7, 5000, 5001, 5002}


def test_near_duplicates_of_repeated_rows(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(words(rng, 80)) for _ in range(3))
    rows = [(5, a), (5, b), (3, a), (5, a), (9, b), (7, c), (7, c), (7, None), (None, a)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(5, 76, 3, False), (5, 76, 3, False), (3, 76, 3, True), (5, 76, 3, False), (9, 76, 3, False), (7, 76, 7, True), (7, 76, 7, True), (7, 0, 7, True)])


def test_near_duplicates_empty(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def brute_repeats(rows, span=200):
    seen = Counter(t[p : p + span] for t in rows.values() for p in range(len(t) - span + 1))
    out = {}
    for i, t in rows.items():
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - span + 1):
            if seen[t[p : p + span]] > 1:
                gone[p : p + span] = True
        out[i] = (len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot, chunk", [(20_000, 1 << 24), (1, 300)])
def test_repeats(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rows = texts()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_repeats({i: (t or "").encode() for i, t in rows})


def test_repeats_of_repeated_rows(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(words(rng, 90)) for _ in range(3))
    rows = [(1, a), (1, b), (2, c), (2, c), (3, b[:400] + c[:100]), (1, None), (None, a)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, len(a), 0), (1, len(b), 400), (2, len(c), len(c)), (2, len(c), len(c)), (3, 500, 400), (1, 0, 0)])
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_deep_shallow_is_a_sort():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [b"a" * 40] * 5 + [b"a" * k for k in range(50)]
    groups = np.array([rng.randint(0, 3) for _ in strings])
    order, common = suffix_sort.deep_shallow(strings, groups)
    keys = [(groups[i], strings[i]) for i in order]
    assert keys == sorted(keys)
    for a, b, c in zip(order, order[1:], common[1:]):
        same = 0
        while groups[a] == groups[b] and same < min(len(strings[a]), len(strings[b])) and strings[a][same] == strings[b][same]:
            same += 1
        assert c == same


def test_quality_equals_sql_and_is_native(spark):
    rows = texts() + [(300, "the THE! " * 60), (301, "\n".join(["a line here", "a line here", " ", "other"])), (302, "*** $$$ " * 40)]
    df = frame(spark, rows)
    documents = df.toPandas()[["doc_id", "text", "lang"]]
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(quality.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    out = quality.quality(df)
    got = out.toPandas().sort_values("doc_id").reset_index(drop=True)
    for c in want.columns:
        assert (got[c] == want[c]).all(), c
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality.quality(frame(spark, [])).count() == 0


def test_quality_of_repeated_rows_equals_sql(spark):
    rng = random.Random(15)
    a, b = (" ".join(words(rng, 120)) for _ in range(2))
    rows = [(1, a, "en"), (1, a, "en"), (1, b, "fr"), (1, None, "en"), (2, b, "en"), (2, "", None), (None, a, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    columns = ["doc_id", "n_words", "word_chars", "kept"]
    want = con.sql(quality.ORACLE).df()[columns]
    out = quality.quality(df).toPandas()
    assert sorted(out[columns].values.tolist()) == sorted(want.values.tolist()) and len(out) == 6
    assert out.js_words.dropna().between(0, 1).all()


def many_languages(spark, each):
    """70 languages with words of their own, the last of them with the fewest documents."""
    rng = random.Random(21)
    rows = []
    for k in range(70):
        own = [chr(97 + k % 26) + chr(97 + k // 26) + "aeiou"[j] for j in range(5)]
        rows += [(len(rows) + j, " ".join(rng.choice(own) + ("" if rng.random() < 0.8 else rng.choice("xyz") + rng.choice(own) * 2) for _ in range(60)), f"l{k:02d}") for j in range(each + (k < 65))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_quality_of_many_languages_equals_sql(spark):
    df = many_languages(spark, 2)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.sql(quality.ORACLE).df().set_index("doc_id").kept
    got = quality.quality(df).toPandas().set_index("doc_id").kept
    assert got.to_dict() == want.to_dict()


def test_language_id_of_many_languages(spark):
    got = langid.language_id(many_languages(spark, 8), per_language=3).select("lang_pred").distinct().count()
    assert got == 70


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    emit, trans, start = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    gamma, pair, z = langid.forward_backward(emit, np.array([4]), trans, start)
    total, want, moves = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=4):
        p = np.exp(start[path[0]] + sum(emit[0, t, s] for t, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        total += p
        for t, s in enumerate(path):
            want[t, s] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
    assert np.allclose(gamma[0], want / total) and np.allclose(pair, moves / total) and np.isclose(z, np.log(total))


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.language_id(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4) == 2).all()
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    small = {r["doc_id"]: r["lang_pred"] for r in langid.language_id(frame(spark, [(0, None), (1, "12 !!"), (2, "the")])).collect()}
    assert small[0] == small[1] == "und"
    rows = [("the cat and the dog of thing", "en"), ("le chat et la chose de eux", "fr")] * 20
    (text, lettered, gamma), = langid.label_words(langid.train(rows), ["the dog of thing and " * 3 + "le chat et la chose " * 3])
    assert [int(g.argmax()) for g in gamma] == [0] * 15 + [1] * 15


def test_toxicity(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, 40) + (["you", "blockhead"] if i % 3 == 0 else []) + words(rng, 40))) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows] + [(7, 1, None)], "doc_id long, quality int, toxic int")
    rows += [(900, None), (901, ""), (902, " ".join(words(rng, 200) + ["blockheads"] + words(rng, 200)))]
    got = {r["doc_id"]: r for r in toxicity.toxicity(frame(spark, rows), labels).collect()}
    held = [i for i in range(300) if got[i]["held_out"]]
    assert held and np.mean([got[i]["predicted"] == (i % 3 == 0) for i in held]) > 0.95
    assert got[900]["predicted"] == got[901]["predicted"] == 0 and got[902]["score"] > 0.5 and len(got) == 303
    assert toxicity.toxicity(frame(spark, []), labels).count() == 0
    twice = toxicity.toxicity(frame(spark, rows[:5] + rows[:5] + [(None, "you blockhead")]), labels).collect()
    assert sorted(r["doc_id"] for r in twice) == sorted(2 * [i for i, _ in rows[:5]])
    assert toxicity.toxicity(frame(spark, rows), labels.limit(0)).agg({"score": "max"}).first()[0] < 1e-9


def test_toxicity_scores_equal_plain_loops():
    rng = random.Random(7)
    rows = [(" ".join(words(rng, 30) + (["you", "blockhead"] if i % 3 == 0 else []) + words(rng, 10)), int(i % 3 == 0)) for i in range(120)]
    model = toxicity.train(rows, rounds=30)
    step, top = int(toxicity._STEP), (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & top
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & top
        return x ^ x >> 31

    def value(word):
        codes = [ord(c) for c in f"<{word.strip(toxicity._EDGE).lower()}>"]
        places = []
        if len(codes) > 2:
            for n in (3, 4, 5):
                for i in range(len(codes) - n + 1):
                    h = codes[i]
                    for c in codes[i + 1 : i + n]:
                        h = (h * step + c) & top
                    places.append(mixed(h + n - 1 & top) >> 64 - toxicity.BITS)
            power, whole = 1, 0
            for c in codes:
                power = power * step & top
                whole = whole + c * power & top
            places.append(mixed(whole) >> 64 - toxicity.BITS)
        return float(np.mean(model["table"][places].astype(float))) if places else 0.0

    def plain(text):
        values = [value(w) for w in toxicity.pieces(text)]
        n = min(toxicity.WINDOW, len(values))
        best = max((sum(values[i : i + n]) / n for i in range(len(values) - n + 1)), default=0.0) if n else 0.0
        return 1 / (1 + np.exp(-(best + model["bias"])))

    texts_ = [t for t, _ in rows[:20]] + ["", "...", "You BLOCKHEAD!", "blockheads", "x" * 300, "ab"]
    assert np.allclose(toxicity.Scorer(model).scores(texts_), [plain(t) for t in texts_], atol=1e-6)


def test_toxicity_scores_whole_words():
    rng = random.Random(6)
    rows = [(" ".join(words(rng, 40) + (["you", "blockhead"] if i % 3 == 0 else []) + words(rng, 40)), int(i % 3 == 0)) for i in range(200)]
    scorer = toxicity.Scorer(toxicity.train(rows))
    letters = "".join(rng.choice("abcdefghijklmnop") for _ in range(130))
    for joined in (letters[:60] + "blockhead", letters[:60] + "blockhead" + letters[60:], ".".join(letters[i : i + 5] for i in range(0, 60, 5)) + ".blockhead"):
        clean, insult, plain = scorer.scores([joined.replace("blockhead", "abcdefghi"), joined, "blockhead"])
        assert clean < 0.5 < insult <= plain + 1e-9
    assert b"".join(p.encode()[toxicity.PIECE // 2 if k else 0 :] for k, p in enumerate(toxicity.pieces("".join(map(str, range(60)))))) == "".join(map(str, range(60))).encode()


def test_language_features_of_whole_words():
    start = "abcdefgh" * 6
    count = lambda word: len(set(np.concatenate(langid.features([word])[0]).tolist()))
    assert count(start + "qzwxqzw") > count(start) + 3


def test_language_id_without_letters_to_learn_from(spark):
    rows = [(i, "the cat sat" if i % 4 == 2 else t, "en") for i, t in enumerate([" ", "", "12 !", None] * 6)]
    got = langid.language_id(spark.createDataFrame(rows + [(90, "any text", None)], "doc_id long, text string, lang string").where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 OR text IS NULL OR NOT text RLIKE '[a-z]'")).collect()
    assert got and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got)
    assert langid.language_id(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_contamination(spark):
    rng = random.Random(9)
    items = [words(rng, 45) for _ in range(6)]
    edit = lambda w, k: [x if i % k else "changed%d" % i for i, x in enumerate(w)]
    planted = {0: items[0], 1: edit(items[1], 8), 2: items[2][:20] + ["put", "in"] + items[2][20:], 3: edit(items[3], 5)}
    rows = [(i, " ".join(words(rng, 300) + planted.get(i, []) + words(rng, 200))) for i in range(12)] + [(50 + k, " ".join(words(rng, 20) + items[4])) for k in range(40)] + [(99, None), (100, "")]
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(77, None), (78, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contamination.contaminated(frame(spark, rows), benchmark).collect()}
    assert got == {(i, i) for i in range(4)} | {(50 + k, 4) for k in range(40)}
    assert contamination.contaminated(frame(spark, []), benchmark).count() == 0 == contamination.contaminated(frame(spark, rows), benchmark.limit(0)).count()


def test_contamination_finds_edited_copies_beside_exact_ones(spark):
    rng = random.Random(13)
    first, second = ([f"{letter}{i}" for i in range(59)] for letter in "vw")
    edited = [x if i % 5 else "changed%d" % i for i, x in enumerate(first)]
    rows = [(100 * k + i, " ".join(words(rng, 20) + item + words(rng, 20))) for k, item in enumerate((first, second)) for i in range(40)]
    rows += [(50, " ".join(words(rng, 20) + edited + words(rng, 20))), (150, " ".join(words(rng, 20) + second[:34] + words(rng, 20)))]
    benchmark = spark.createDataFrame([(0, " ".join(first)), (1, " ".join(second))], "item_id long, text string")
    for hot in (20_000, 3):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(contamination, "HOT", hot, raising=False)
            got = {(r["doc_id"], r["item_id"]): r["score"] for r in contamination.contaminated(frame(spark, rows), benchmark).collect()}
        assert set(got) == {(100 * k + i, k) for k in range(2) for i in [*range(40), 50]} and got[50, 0] == pytest.approx(0.7, abs=0.02)


def test_contamination_equals_all_pairs(spark):
    """The query against an alignment of every document with every item, over rates of edits."""
    rng = random.Random(17)
    opening = words(rng, 8)
    items = [opening + words(rng, 40) for _ in range(8)]
    rows = []
    for k, item in enumerate(items):
        for rate in (0.0, 0.1, 0.2, 0.3):
            copy = [w if rng.random() >= rate else f"e{rng.random():.9f}" for w in item]
            rows.append((len(rows), " ".join(words(rng, 30) + copy + words(rng, 30))))
    rows += [(len(rows) + j, " ".join(words(rng, 80) + opening)) for j in range(6)]
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    want = {(i, k): naive_alignment(contamination.word_hashes(" ".join(w)).tolist(), contamination.word_hashes(t).tolist()) for i, t in rows for k, w in enumerate(items)}
    want = {pair: s for pair, s in want.items() if s >= contamination.SHARE}
    for common in (64, 2):  # below 8 items, the opening is no seed
        with pytest.MonkeyPatch.context() as m:
            m.setattr(contamination, "ITEMS", common)
            got = {(r["doc_id"], r["item_id"]): r["score"] for r in contamination.contaminated(frame(spark, rows), benchmark).collect()}
        assert got == pytest.approx(want)


def test_contamination_finds_short_items(spark):
    rng = random.Random(19)
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (1, 2, 3, 4, 5, 12, 200)}
    rows = [(n, " ".join(words(rng, 90) + w + words(rng, 90))) for n, w in items.items()] + [(500 + n, " ".join(w)) for n, w in items.items()]
    rows += [(1000, " ".join(words(rng, 60) + items[200][:60] + words(rng, 30))), (1001, " ".join(words(rng, 60) + items[3][:2] + words(rng, 60)))]
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()] + [(None, " ".join(items[12]))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contamination.contaminated(frame(spark, rows), benchmark).collect()}
    assert got == {(n, n) for n in items if n >= 3} | {(500 + n, n) for n in items if n >= 3} | {(1000, 200)}


def test_contamination_of_items_with_a_common_opening(spark):
    """A hundred items share an opening: all pairs by alignment are found, from copies of the opening alone, too."""
    rng = random.Random(23)
    opening = [f"open{k}" for k in range(40)]
    items = [opening + [f"i{n}w{k}" for k in range(22)] for n in range(100)]
    rows = [(n, " ".join(words(rng, 10) + items[n][:36] + words(rng, 10))) for n in range(4)]
    rows += [(10 + n, " ".join(words(rng, 10) + items[n][31:] + words(rng, 10))) for n in range(4)] + [(20, " ".join(words(rng, 10) + opening[:8] + words(rng, 10))), (21, " ".join(items[5]))]
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contamination.contaminated(frame(spark, rows), benchmark).collect()}
    texts_of = {i: contamination.word_hashes(t) for i, t in rows}
    want = {(i, n) for i, b in texts_of.items() for n, w in enumerate(items) if contamination.alignment_share(contamination.word_hashes(" ".join(w)), b) >= contamination.SHARE}
    assert got == want and len(want) > 400


def naive_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max() / (2 * len(a))


def test_alignment_equals_table():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 20)).astype(np.uint64), rng.integers(0, 5, rng.integers(0, 30)).astype(np.uint64)
        assert contamination.alignment_share(a, b) == naive_alignment(a.tolist(), b.tolist())


def talk(rng, convs, turns=6):
    rows = []
    for k in range(convs):
        for t in range(turns):
            role = ("user", "assistant")[t % 2] if t or k % 3 else "system"
            text = {"system": "You are a careful helper.", "user": f"Why is {rng.choice(words(rng, 3))} so?"}.get(role) or "\n".join(f"Because of {' '.join(words(rng, 9))}." for _ in range(rng.randint(1, 3)))
            rows.append((k, t, role, text))
    return rows


CONVERSATIONS = "conv_id long, turn int, role string, text string"


def test_chat_recovers_roles_not_fitted_on(spark):
    rng = random.Random(31)
    rows = talk(rng, 160) + [(900, 0, "user", None), (901, None, None, ""), (902, 0, "tool", "Some output"), (None, 0, "user", "Hi?"), (903, 0, "user", "One?"), (903, 0, "user", "One?")]
    got = {r["conv_id"]: r for r in chat.chat_turns(spark.createDataFrame(rows, CONVERSATIONS).repartition(3)).collect()}
    held = [k for k in range(160) if got[k]["held_out"]]
    assert all((zlib.crc32(str(k).encode()) % 4 == 2) == got[k]["held_out"] for k in range(160)) and len(held) > 20
    want = {k: [r for c, _, r, _ in rows if c == k] for k in held}
    assert np.mean([got[k]["roles"].split() == want[k] for k in held]) > 0.9
    assert got[900]["n_turns"] == got[901]["n_turns"] == 0 and got[902]["n_turns"] == 1 and got[903]["rendered"].count("One?") == 2 and None not in got
    for k in held:
        if got[k]["roles"].split() == want[k]:
            assert got[k]["rendered"] == chat.render([(r, t) for c, _, r, t in rows if c == k])
    assert chat.chat_turns(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_chat_across_parts_equals_whole(spark, monkeypatch):
    rng = random.Random(32)
    df = spark.createDataFrame(talk(rng, 40, 9), CONVERSATIONS)
    whole = {r["conv_id"]: r for r in chat.chat_turns(df).collect()}
    monkeypatch.setattr(chat, "PART", 2)
    parts = chat.chat_turns(df).toPandas().sort_values(["conv_id", "part"]).groupby("conv_id")
    assert {k: " ".join(x for x in g.roles if x) for k, g in parts} == {k: r["roles"] for k, r in whole.items()}
    assert {k: "".join(g.rendered) for k, g in parts} == {k: r["rendered"] for k, r in whole.items()}


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    for n in (1, 2, 4):
        log = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1]))
        model = {"emit": log(chat.K, chat.OBSERVATIONS), "trans": log(chat.K, chat.K), "start": log(1, chat.K)[0]}
        seen = rng.integers(0, chat.OBSERVATIONS, n).tolist()
        score = lambda p: model["start"][p[0]] + model["emit"][p[0], seen[0]] + sum(model["trans"][a, b] + model["emit"][b, o] for a, b, o in zip(p, p[1:], seen[1:]))  # noqa: E731, B023
        best = max(itertools.product(range(chat.K), repeat=n), key=score)
        path, value = chat.viterbi(model, seen)
        assert tuple(path) == best and np.isclose(value, score(best))


def test_chat_markers():
    assert [chat.marker(x)[0] for x in ("User: hi", "### Assistant", "[system] be", "<Human> x", "**AI:** x", "A", "System] x", "a thing", "Question of taste", "### A list")] == [1, 2, 0, 1, 2, -1, -1, -1, -1, -1]
    assert [w for _, w, _ in chat.observed("### User\nWhy?\n\nAnswer: so")] == ["### User\nWhy?", "Answer: so"]


def licence_files():
    mit, apache = licenses.TEMPLATES["MIT"][1], licenses.TEMPLATES["Apache-2.0"][0]
    rng = random.Random(41)
    filler = " ".join(words(rng, 300))
    rows = [("a/LICENSE", "Copyright (c) 2019 Some One\n\n" + mit), ("a/x.py", "code"), ("a/b/y.py", "code\n" + apache + "\nmore"), ("a/b/c/z.py", ""), ("a/b/c/LICENSE.txt", apache), ("a/b/c/d/w.py", None), ("q.py", "x"), (None, "license?"), ("a/x.py", "code"), ("LICENSE", "All rights")]
    rows += [("long/deep.txt", f"{filler} Our little project is released under the MIT License, see https://example.org for more. {filler}"), ("own/c.c", f"{filler}\n * Copyright 2020 Example Corp. All rights reserved.\n{filler}"), ("own/plain.txt", filler + " software of any kind and the license of rights")]
    rows += [("gpl/COPYING", licenses.TEMPLATES["GPL-3.0"][1].replace("program", "library")), ("gpl/src/deep/er/f.c", filler), ("bsd/LICENSE.md", licenses.TEMPLATES["BSD-3-Clause"][0].replace("copyright holder", "Regents"))]
    return rows


def test_licenses(spark):
    rows = licence_files()
    got = Counter((r["path"], r["license"], r["origin"]) for r in licenses.licences(spark.createDataFrame(rows, "path string, text string")).collect())
    want = [("a/LICENSE", "MIT", "own"), ("a/x.py", "MIT", "directory"), ("a/b/y.py", "Apache-2.0", "own"), ("a/b/c/z.py", "Apache-2.0", "directory"), ("a/b/c/LICENSE.txt", "Apache-2.0", "own"), ("a/b/c/d/w.py", "Apache-2.0", "directory"), ("q.py", None, "none"), (None, None, "none"), ("a/x.py", "MIT", "directory"), ("LICENSE", None, "none")]
    want += [("long/deep.txt", "MIT", "own"), ("own/c.c", "proprietary", "own"), ("own/plain.txt", None, "none"), ("gpl/COPYING", "GPL-3.0", "own"), ("gpl/src/deep/er/f.c", "GPL-3.0", "directory"), ("bsd/LICENSE.md", "BSD-3-Clause", "own")]
    assert got == Counter(want)
    assert licenses.licences(spark.createDataFrame([], "path string, text string")).count() == 0


def test_licence_scan_equals_all_windows():
    """Every window against every template, without the heavy terms' short cut."""
    rng = random.Random(43)
    matcher = licenses.Matcher({"the": 0.9, "of": 0.8, "under": 0.05, "license": 0.01, "rights": 0.02})
    notices = [n for found in licenses.TEMPLATES.values() for n in found]
    for _ in range(12):
        notice = rng.choice(notices).split()
        text = " ".join(words(rng, rng.randint(0, 60)) + [w for w in notice if rng.random() < 0.9] + words(rng, rng.randint(0, 60)))
        tokens, best = licenses.terms(text), (0.0, 0.0)
        for size, templates in matcher.sizes.items():
            for at in range(0, len(tokens), 1 if size <= 16 else size // 4):
                v = matcher.vector(Counter(tokens[at : at + size]))
                for name, vector, _, by_length in templates:
                    cosine = sum(x * v.get(t, 0.0) for t, x in vector.items())
                    if cosine >= licenses.COSINE:
                        best = max(best, (cosine * by_length, cosine))
        name, score = matcher.best(text)
        assert (name is not None) == (best[0] > 0) and (name is None or np.isclose(score, best[1]))


def test_licences_outrank_the_line_above_them(spark):
    """Every template under a copyright line, as a licence file from which a file inherits."""
    rows, want = [], {}
    for name, notices in licenses.TEMPLATES.items():
        for k, notice in enumerate(notices):
            home = f"{name}-{k}"
            rows += [(f"{home}/LICENSE", f"Copyright (c) 2020, Some One. All rights reserved.\n\n{notice}"), (f"{home}/a.c", "int main() {}")]
            want |= {f"{home}/LICENSE": name, f"{home}/a.c": name}
    rows.append(("both/LICENSE", "All rights reserved. Released under the MIT License. " + licenses.TEMPLATES["BSD-3-Clause"][0]))
    got = {r["path"]: r["license"] for r in licenses.licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == want | {"both/LICENSE": "BSD-3-Clause"}


def test_licences_do_not_depend_on_the_number_of_files(spark):
    rows, more = licence_files(), [(f"other/f{i}.txt", " ".join(words(random.Random(i), 20))) for i in range(400)]
    few, many = ({r["path"]: r["license"] for r in licenses.licences(spark.createDataFrame(x, "path string, text string")).collect()} for x in (rows, rows + more))
    assert all(many[p] == few[p] for p, _ in rows)
