"""Small documents with the cases that operators must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = "row string, tag int, node long, key long, lead long, part long, score double, length long, text_sha256 string, keep_id long, gone_id long, __gone long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgilmnorstu") for _ in range(rng.randint(1, 9))) for _ in range(words))


def cases() -> list[tuple]:
    base, passage = prose(1, 120), prose(2, 60)
    words = base.split(" ")
    texts = [
        base, base, base.replace(" ", "  \n"), " ".join([*words[:60], "changed", *words[61:]]), " ".join(words[:100]), prose(3, 90) + " " + passage + " " + prose(4, 40),
        passage + " " + prose(5, 200), prose(6, 50) + " ÄÖ é漢😀 " + passage, None, "", " ", "one", "one two three four", "One TWO three four", "x" * 700, "é" * 150, "abc " * 300,
        prose(7, 3000) + " " + passage, "a b\x00c <s> ▁ \t end", "idiot moron", "the", prose(8, 5)]
    return [(i, t, "en" if i % 3 else "fr", f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, rows=None):
    return spark.createDataFrame(cases() if rows is None else rows, SCHEMA)


def clashing(spark, rows=None):
    """The same with columns that clash with names used inside."""
    from pyspark.sql import functions as F

    out = frame(spark, rows)
    for part in CLASHING.split(", "):
        name, kind = part.split(" ")
        out = out.withColumn(name, F.lit(7).cast(kind))
    return out


def repeated():
    """Rows that repeat, and a null id."""
    rows = cases()
    return [*rows, rows[0], rows[5], (None, rows[0][1], None, None, None), (None, None, None, None, None)]
