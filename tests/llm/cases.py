"""Small tables with the cases every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that operators use inside or return.
CLASHING = ["id", "tag", "set", "key", "keys", "size", "taken", "target", "score", "n_words", "spans", "kept", "h", "c", "part", "_text", "_key", "held_out"]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def make(seed: int = 1, n: int = 120) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(150)]
    sentence = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, base = sentence(40), sentence(90)
    out = []
    for i in range(n):
        kind = i % 8
        if kind == 0:
            t = " ".join(base)
        elif kind == 1:
            w = list(base)
            for _ in range(r.randint(1, 6)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            t = " ".join(w)
        elif kind == 2:
            t = " ".join(sentence(20) + passage[r.randint(0, 10) :] + sentence(10))
        elif kind == 3:
            t = "\n".join(" ".join(sentence(12)) for _ in range(r.randint(1, 6)))
        elif kind == 4:
            t = " ".join(sentence(r.randint(1, 5)))
        elif kind == 5:
            t = ["", "   ", None, " ", "!!! ???"][i % 5]
        elif kind == 6:
            t = " ".join(sentence(13)) + "  \t" + " ".join(sentence(2)) * 30
        else:
            t = "x" * 3000 + " " + " ".join(sentence(600))
        out.append((i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", None, ""]), len(t or "")))
    r.shuffle(out)
    out.append((3, out[0][1], "en", "s1", 0))  # an id once more, with another text
    out.append(next(x for x in out if x[0] == 0))  # a whole row once more
    out.append((None, " ".join(base), None, None, None))
    return out


def frame(spark, rows, clash: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}) if clash else df
