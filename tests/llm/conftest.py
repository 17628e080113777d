import random

import pytest


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    syllables = ["ta", "re", "mi", "no", "ka", "lu", "so", "ve", "di", "po"]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def hard_rows() -> list[tuple]:
    """doc_id, text, lang, source: nulls everywhere, empty and very long texts, ties, repeated rows, copies and near copies."""
    base = prose(1, 300)
    words = base.split()
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.replace(" ", "\n ", 50), "en", "b"), (4, " ".join(words[:290]) + " other end", "en", None),
        (5, " ".join(words[10:]), "fr", "b"), (6, None, "en", "a"), (7, "", None, "a"), (8, " \t\r\n", "fr", None), (9, "ÄÖ ü\x1f ß x", "de", "c"),
        (10, prose(2, 60_000), "en", "c"), (11, "word", "en", "c"), (12, "word", "en", "c"), (12, "word", "en", "c"), (None, "nameless text", "en", "a"),
        (13, prose(3, 40) + " " + base[:700] + " " + prose(4, 40), "fr", "a"), (14, "1234 5678 !!", "de", "a"), (15, "the same " * 400, "en", "b"), (16, "Word", "fr", "b"),
    ]
    return rows + [(100 + i, prose(50 + i % 20, 30 + i), ["en", "fr"][i % 2], f"s{i % 4}") for i in range(60)]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def clashing(hard):
    """Further columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    names = "id size n kept group_size keep_id text_sha256 component_id taken target twin bucket rank digest norm root packed bands token_ids score".split()
    return hard.select("*", *(F.lit("x").alias(n) for n in names))
