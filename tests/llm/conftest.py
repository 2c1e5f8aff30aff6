import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, h string, fp long, component_id long, item string, score double, text_crc32 long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    base = " ".join(word() for _ in range(60))
    texts = [None, "", " \t\n ", "one", "One two\x0bthree", base, base, base + " x", base.upper(), " ".join(word() for _ in range(30_000)), "z" * 50_000, "a@b.co 1.2.3.4 +1 (988) 555-2485 4041894974608795", "line\x1fsep wide İX ΣΣ <|endoftext|> it's 12 ñ"]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(None, "no id", None, None), (None, None, None, None), (5, base, "en", "s2"), (7, "another text of seven", "de", None), (-4, "below zero", "fr", "\U0001f600")]
    return [(*r, None if r[1] is None else len(r[1]), 1, 2, "h", 3, 4, "i", 0.5, 6) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
