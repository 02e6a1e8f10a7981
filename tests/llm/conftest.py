from __future__ import annotations

import random

import pytest

WORDS = "the of and to in is was for on with as by at from or an be this which are not but all can has more one two new".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "ed", "ing", "s", "ly"]) for _ in range(n))


def rows(texts: list[tuple[int | None, str | None]]) -> list[tuple]:
    return [(i, t, "en", "src0", None if t is None else len(t)) for i, t in texts]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank, one word, repeated rows, a very long text, ties; plus columns whose names operators use themselves."""
    long = prose(1, 30_000)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (6, prose(2, 60)), (6, prose(2, 60)), (7, long), (None, prose(3, 50)), (None, None), (8, "one two three"), (9, "Ünï cödé \x85 x")]
    df = spark.createDataFrame(rows(texts), DOCS)
    from pyspark.sql import functions as F

    for clash in ("id", "t", "cls", "n", "kept", "slot_", "_group", "score_", "uid", "key", "length_", "y", "_key", "_id", "_rows", "_kept", "_piece", "shard", "Host", "Slot", "Sequence_ID", "copies", "document", "stays", "words", "packing_group", "piece_number"):
        df = df.withColumn(clash, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
