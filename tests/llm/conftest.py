"""Documents with every odd case, and an empty table of each kind."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, part int, fp long, key long, score double"


def made_text(draw: random.Random, words: int) -> str:
    sounds = ("the", "re", "an", "ti", "on", "er", "in", "ou", "é", "st", "Wh", "ß")
    return " ".join("".join(draw.choice(sounds) for _ in range(draw.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    draw = random.Random(3)
    texts = [made_text(draw, draw.randint(1, 120)) for _ in range(60)]
    rows = [(i, t, draw.choice(("en", "fr", None)), draw.choice(("a", "b", "Z", "", None)), len(t)) for i, t in enumerate(texts)]
    base = made_text(draw, 400)
    rows += [(100 + i, base, "en", "hot", len(base)) for i in range(40)]  # exact copies
    rows += [(200 + i, base + " " + made_text(draw, 1), "en", "hot", None) for i in range(40)]  # near copies
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, " \t\n\v ", "en", None, 5), (303, "x", "en", "b", 1), (304, None, "fr", "a", 0)]
    rows += [(305, made_text(draw, 30_000), "en", "long", None), (306, "é" * 70_000, "fr", "long", None), (307, "123 456 !!", None, "b", 10)]
    rows += [(None, texts[0], "en", "a", 3), (None, None, None, None, None), (None, "only here and nowhere else at all", "en", "a", 1)]
    rows += [(5, texts[5], "en", "a", 1)] * 3 + [(5, "another text with the same id", "en", "a", 1)]  # repeated rows, tied ids
    rows += [(-7, "token = 'abcdef123456' and " + "0123456789abcdef" * 2, "en", "b", 1), (2**62, "AKIA" + "ABCDEFGH12345678", "en", "c", 1)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows, with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 0.5) for r in odd_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
