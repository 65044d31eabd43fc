"""Small documents of every kind."""

import random

from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, token_ids string, evidence string, n_lines string, item_id string, toxicity string, shard string"


def prose(seed, n):
    rng = random.Random(repr(seed))
    return " ".join("".join(rng.choice(["an", "the", "or", "ti", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def lines(seed, n, words=12):
    return "\n".join(prose((seed, i), words) for i in range(n))


LONG = prose("long", 20_000)
#: Nulls, empty and very long texts, repeated rows, ties, null ids.
EDGES = [
    (1, ""), (2, None), (3, " \t\n "), (4, "One two"), (4, "One two"), (5, LONG), (6, LONG), (None, prose("null", 30)),
    (None, None), (7, lines("a", 9)), (8, lines("a", 9)), (9, lines("a", 9) + "\nanother end of the text it is"), (10, "one\x0btwo"),
    (11, "Ünïcode 中文 🙂 text <|endoftext|> x"), (12, "a a a a a a a a a a a a"), (13, "=" * 3000), (7, lines("a", 9)),
]


def documents(spark, rows):
    clash = ("lang", "source", "score", "token_ids", "evidence", "n_lines", "item_id", "toxicity", "shard")
    made = [Row(doc_id=i, text=t, n_chars=None if t is None else len(t), **{c: f"{c}{k % 2}" for c in clash}) for k, (i, t) in enumerate(rows)]
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in made], SCHEMA)
