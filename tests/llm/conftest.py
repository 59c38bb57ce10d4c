from __future__ import annotations

import re

import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


@pytest.fixture(scope="session")
def docs(spark):
    from conftest import SF

    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "Alpha  beta gamma delta epsilon zeta", "en", "a", 3, "x", 1),
        (1, "Alpha  beta gamma delta epsilon zeta", "en", "a", 3, "x", 1),
        (2, None, None, None, None, None, None),
        (None, "only text here, without any id", "en", None, 1, "y", 2),
        (3, "", "de", "b", 0, "", 0),
        (4, "\n\n", "de", "b", 2, "", 0),
        (5, long, "fr", "b", len(long), "z", 9),
        (6, "...!?", "en", "c", 5, None, 9),
    ]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, key string, n_hit int",
    )
