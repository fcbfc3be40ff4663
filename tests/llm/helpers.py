"""Small fixtures of documents: copies, edits, nulls, empties, ties and clashing columns."""

import random

WORDS = "the of and to in is that it for was on with as be by at this are from or an which had not have one you were her all she there would their we him been has when who will more no if out so said what".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, text_2 string, kept boolean"


def words(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def texts() -> list[tuple[int, str | None]]:
    rng = random.Random(11)
    out: list[str | None] = [None, "", " \n\t ", "one", "two words", "A b C d E", "a B c D e"]
    base = words(rng, 180)
    out += [" ".join(base)] * 3
    for step in (60, 30, 12, 6):
        edited = [w if i % step else "edit%d" % i for i, w in enumerate(base)]
        out.append(" ".join(edited))
    passage = " ".join(words(rng, 60))
    for _ in range(4):
        out.append(" ".join(words(rng, 70)) + "\n" + passage + "\n" + " ".join(words(rng, 50)))
    out += ["x" * 700, "ab" * 300, "é" * 250 + passage, " ".join(words(rng, 3000))]
    out += [" ".join(words(rng, rng.randint(30, 200))) for _ in range(12)]
    return list(enumerate(out))


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, ("en", None, "fr")[(i or 0) % 3], f"src{(i or 0) % 4}", len(t or ""), i, t, (i or 0) % 2 == 0) for i, t in rows], SCHEMA).repartition(3)
