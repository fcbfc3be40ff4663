"""Operator 9: quality rules and divergence from language references, on DataFrame functions alone.

Counts.  Words are runs of characters other than space and ASCII control white space.  Per
document: n_words; word_chars, the code points in words; n_symbols; n_dup_lines, lines with a word
that equal an earlier line; n_repeat_words, words inside 3-word windows that occur twice or more.
A document fails the base rules under 50 words, or if more than half of its words are repeats.

Divergence.  For each language, references are computed over all documents: the histogram of six
character classes, and that of the language's most frequent short words (at most five letters) with
one bin for words without a letter and one for all others.  A document is compared with every reference by Jensen-Shannon
distance (base 2), and its least distances count.  It is rejected if either is above its
threshold; documents under ``min_words`` words have histograms too small to judge and are left to
the base rules.

A text is read once: its counts and the histogram of its short words stay in its row and are written as a table.  Only
(language, word) counts and sums per language are shuffled.  The references of all languages, ``COMMON_WORDS`` words and six
classes each, become one row that every document meets, so distances need no shuffle and no key.

Cases: null and empty texts have no words and fail; without any language in the table, or for a
document without words, no divergence is measured; each row of the input is judged by its own text
and gives one row, repeated rows included; rows without a doc_id are left out, of the references
too; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.llm.common import Scratch

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
CLASSES = {"lower": r"[^\p{Ll}]+", "upper": r"[^\p{Lu}]+", "digit": r"[^0-9]+", "space": r"[^\x20\x09-\x0D]+"}
SHORT_WORD = r"^\p{L}{0,5}$"
COMMON_WORDS, MIN_WORDS = 30, 50
#: Clean prose lies under 0.26 and 0.37, symbol-laden, shouted or tabular text above.
CHARS_DISTANCE, WORDS_DISTANCE = 0.29, 0.42


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def count_of(text: Column, others: str) -> Column:
    """Code points left when everything that matches ``others`` is gone."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), others, "")).cast("long")


def with_repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from ``words``.

    Each window's 64-bit hash stands with its place and the array is sorted, so equal windows become
    neighbours; neighbours with equal hashes are compared word by word."""
    w = F.col("words")
    heads = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    df = df.withColumn("p", F.sort_array(F.transform(heads, lambda a, i: F.struct(F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))))
    p = F.col("p")

    def same(x: Column, y: Column) -> Column:
        i, j = x["i"], y["i"]
        return (x["h"] == y["h"]) & (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    twice = F.transform(p, lambda x, k: F.when(F.coalesce(same(x, F.get(p, k + 1)), F.lit(False)) | F.coalesce(same(x, F.get(p, k - 1)), F.lit(False)), x["i"]))
    df = df.withColumn("d", F.sort_array(F.array_compact(twice)))
    d = F.col("d")
    covered = F.transform(d, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1) - x, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("p", "d")


def short_words(words: Column) -> Column:
    """The words of at most five letters; those without a letter are the empty word, all others are left out."""
    kind = F.transform(words, lambda w: F.when(~w.rlike(r"\p{L}"), F.lit("")).when((F.length(w) <= 5) & w.rlike(SHORT_WORD), w))
    return F.array_compact(kind)


def with_histogram(df: DataFrame) -> DataFrame:
    """Adds hist, which maps the short words of ``words`` to how often each occurs: in sorted order, a word's first place to the next one's."""
    df = df.withColumn("s", F.sort_array(short_words(F.col("words"))))
    s = F.col("s")
    first = F.filter(F.transform(s, lambda w, i: F.when((i == 0) | (F.get(s, i - 1) != w), i)), lambda i: i.isNotNull())
    df = df.withColumn("at", first)
    at = F.col("at")
    entries = F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("word"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("n")))
    return df.withColumn("hist", F.map_from_entries(entries)).drop("s", "at")


def features(docs: DataFrame) -> DataFrame:
    """The counts, character classes and short words of each document."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select("doc_id", "lang", "text", F.xxhash64(text).alias("copy"), words_of(F.col("text")).alias("words"), lines.alias("lines"))
    df = with_histogram(with_repeat_words(df))
    classes = [count_of(F.col("text"), others).alias(f"c_{name}") for name, others in CLASSES.items()]
    df = df.select("doc_id", "copy", "lang", "hist", F.size("words").cast("long").alias("n_words"), F.length(text).cast("long").alias("n_chars_all"), count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
                   (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words", *classes)
    df = df.withColumn("word_chars", F.col("n_chars_all") - F.col("c_space")).withColumn("c_symbol", F.col("n_symbols"))
    return df.withColumn("c_other", F.col("n_chars_all") - F.col("c_lower") - F.col("c_upper") - F.col("c_digit") - F.col("c_space") - F.col("c_symbol"))


BINS = ["c_lower", "c_upper", "c_digit", "c_space", "c_symbol", "c_other"]


def _term(p: Column, q: Column) -> Column:
    """One bin's part of the Jensen-Shannon divergence."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) / 2 + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0) / 2


def _root(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def char_references(spoken: DataFrame) -> DataFrame:
    """One row (refs): the class histograms of all languages with characters."""
    total = sum((F.col(b) for b in BINS), F.lit(0))
    return spoken.where(total > 0).agg(F.collect_list(F.array(*[F.col(b) / total for b in BINS])).alias("refs"))


def char_distance(refs: Column) -> Column:
    """Least distance of the character classes; null without references or characters."""
    total = F.col("n_chars_all")
    each = F.transform(refs, lambda ref: _root(sum((_term(F.col(b) / total, F.get(ref, F.lit(k))) for k, b in enumerate(BINS)), F.lit(0.0))))
    return F.when(total > 0, F.array_min(each))


def word_references(per_doc: DataFrame, spoken: DataFrame) -> DataFrame:
    """One row (word_refs): for each language the shares of its most frequent short words, and the sum of those."""
    counted = per_doc.where("lang IS NOT NULL").select("lang", F.explode("hist").alias("word", "n")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    first = [F.desc(F.col("word") == ""), F.desc("n"), "word"]  # the bin of words without a letter always counts
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*first))).where(F.col("rank") <= COMMON_WORDS)
    shares = ranked.join(spoken.select("lang", F.col("words").alias("total")), "lang").select("lang", "word", (F.col("n") / F.col("total")).alias("q"))
    each = shares.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("word", "q"))).alias("words"), F.sum("q").alias("mass"))  # COMMON_WORDS at most
    return each.agg(F.collect_list(F.struct("words", "mass")).alias("word_refs"))


def word_distance(refs: Column, hist: Column, n_words: Column) -> Column:
    """Least distance of the common words.  ``hist`` is read from a table: an expression in its place would be computed again for
    every word of every language."""

    def each(ref: Column) -> Column:
        shares = F.transform(ref["words"], lambda x: F.struct((F.coalesce(F.try_element_at(hist, x["word"]), F.lit(0)) / n_words).alias("p"), x["q"].alias("q")))
        zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("p"))
        total = F.aggregate(shares, zero, lambda a, x: F.struct((a["t"] + _term(x["p"], x["q"])).alias("t"), (a["p"] + x["p"]).alias("p")), lambda a: _root(a["t"] + _term(1 - a["p"], 1 - ref["mass"])))
        return total

    return F.array_min(F.transform(refs, each))


def quality(docs: DataFrame, scratch: Scratch | None = None, chars_distance: float = CHARS_DISTANCE, words_distance: float = WORDS_DISTANCE, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept, js_chars, js_words, copy (xxhash64 of the text, empty for null)."""
    scratch = scratch or Scratch(docs.sparkSession, "op9")
    docs = docs.where("doc_id IS NOT NULL")
    per_doc = scratch.save(features(docs), "features")
    spoken = per_doc.where("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"), *[F.sum(b).alias(b) for b in BINS])
    spoken = scratch.save(spoken, "spoken")
    df = per_doc.crossJoin(F.broadcast(char_references(spoken))).withColumn("js_chars", char_distance(F.col("refs"))).drop("refs")  # one row
    df = df.crossJoin(F.broadcast(scratch.save(word_references(per_doc, spoken), "references")))  # one row
    df = df.withColumn("js_words", F.when(F.col("n_words") > 0, word_distance(F.col("word_refs"), F.col("hist"), F.col("n_words"))))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    far = (F.col("n_words") >= min_words) & ((F.coalesce("js_chars", F.lit(0.0)) > chars_distance) | (F.coalesce("js_words", F.lit(0.0)) > words_distance))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "js_chars", "js_words", "copy")


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents WHERE doc_id IS NOT NULL),
g AS (
  SELECT rid, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS gram
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
r AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1)
  GROUP BY rid),
f AS (
  SELECT d.rid, d.doc_id, lang, len(w) AS n_words, length(text) AS c,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^\p{Ll}]+', '', 'g')) AS lo,
         length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS up,
         length(regexp_replace(text, '[^0-9]+', '', 'g')) AS di,
         length(regexp_replace(text, '[^\x20\x09-\x0D]+', '', 'g')) AS sp
  FROM d LEFT JOIN r ON r.rid = d.rid),
bins AS (
  SELECT rid, lang, c, unnest(range(6)) AS b,
         unnest([lo, up, di, sp, n_symbols, c - lo - up - di - sp - n_symbols]) AS n FROM f),
cref AS (
  SELECT lang, b, n / sum(n) OVER (PARTITION BY lang) AS q
  FROM (SELECT lang, b, sum(n) AS n FROM bins WHERE lang IS NOT NULL GROUP BY lang, b)),
cjs AS (
  SELECT rid, min(js) AS js FROM (
    SELECT rid, r.lang, sqrt(greatest(0, sum(
      CASE WHEN n > 0 THEN n / c * log2(n / c / ((n / c + q) / 2)) ELSE 0 END +
      CASE WHEN q > 0 THEN q * log2(q / ((n / c + q) / 2)) ELSE 0 END) / 2)) AS js
    FROM bins JOIN cref r ON r.b = bins.b WHERE c > 0 GROUP BY rid, r.lang) GROUP BY rid),
w AS (
  SELECT rid, lang, n_words, CASE WHEN regexp_matches(word, '\p{L}') THEN word ELSE '' END AS word
  FROM (SELECT rid, lang, len(w) AS n_words, unnest(w) AS word FROM d)),
top AS (
  SELECT lang, word, n FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY word = '' DESC, n DESC, word) AS rank FROM (
      SELECT lang, word, count(*) AS n FROM w
      WHERE lang IS NOT NULL AND regexp_matches(word, '^\p{L}{0,5}$') GROUP BY lang, word))
  WHERE rank <= 30),
tot AS (SELECT lang, sum(n_words) AS n FROM f WHERE lang IS NOT NULL GROUP BY lang),
wref AS (
  SELECT top.lang, word, top.n / tot.n AS q FROM top JOIN tot ON tot.lang = top.lang
  UNION ALL
  SELECT top.lang, NULL, 1 - sum(top.n / tot.n) FROM top JOIN tot ON tot.lang = top.lang GROUP BY top.lang),
wc AS (SELECT rid, word, count(*) AS n FROM w WHERE word IN (SELECT word FROM top) GROUP BY rid, word),
seen AS (
  SELECT f.rid, wref.lang, wref.word, q, coalesce(wc.n, 0) / f.n_words AS p
  FROM f JOIN wref ON wref.word IS NOT NULL LEFT JOIN wc ON wc.rid = f.rid AND wc.word = wref.word
  WHERE f.n_words > 0),
wall AS (
  SELECT * FROM seen
  UNION ALL
  SELECT s.rid, s.lang, NULL, r.q, s.p
  FROM (SELECT rid, lang, 1 - sum(p) AS p FROM seen GROUP BY rid, lang) s
  JOIN wref r ON r.lang = s.lang AND r.word IS NULL),
wjs AS (
  SELECT rid, min(js) AS js FROM (
    SELECT rid, lang, sqrt(greatest(0, sum(
      CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END +
      CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS js
    FROM wall GROUP BY rid, lang) GROUP BY rid),
v AS (
  SELECT f.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         coalesce(cjs.js, 0) > 0.29 OR coalesce(wjs.js, 0) > 0.42 AS far
  FROM f LEFT JOIN cjs ON cjs.rid = f.rid LEFT JOIN wjs ON wjs.rid = f.rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(c - sp AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept
FROM v
"""
