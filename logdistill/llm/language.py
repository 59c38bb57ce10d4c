"""Language of documents by a conditional random field over their words.

The model is fitted on a bounded sample of labelled rows outside the held-out fifth:
about ``SAMPLE`` per language, pieces of at most ``SAMPLE_CHARS`` characters,
``SAMPLE_TOTAL`` characters in all.  It learns the ``MOST_LANGUAGES`` most frequent
languages (ties: the smaller name), as its tables grow with their number.  It is applied
to whole texts and sees the text only.

Cases: null texts and texts without letters are ``und`` with score 0; without any
labelled row every document is ``und``; null ids count as held out; ties go to the
smaller language name; repeated rows each get their row; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logdistill.llm import crf

FOLDS = 5
SAMPLE = 400
SAMPLE_CHARS = 20_000
SAMPLE_TOTAL = 64_000_000
MOST_LANGUAGES = 128
UNKNOWN = "und"
LEAST_SCORE = 0.3


def held_out() -> Column:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(name) % FOLDS == 0


def training_sample(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(text, lang) of about ``sample`` rows per language, chosen by a hash of id and text.

    Texts longer than ``chars`` give a piece of that length from a place set by the same
    hash.  The driver gets at most 2 * ``sample`` * ``MOST_LANGUAGES`` pieces, and no more
    than ``SAMPLE_TOTAL`` characters: with many languages each gives fewer or shorter ones.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = (
        rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    )
    if not sizes:
        return []
    sample = max(1, min(sample, SAMPLE_TOTAL // (2 * chars * len(sizes))))
    chars = min(chars, SAMPLE_TOTAL // (2 * sample * len(sizes)))
    rates = docs.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, sample / r["n"])) for r in sizes], "lang string, rate double"
    )
    key = F.xxhash64("doc_id", "text")
    share = F.pmod(key, F.lit(1_000_000_000)) / 1e9
    spare = F.greatest(F.char_length("text") - chars, F.lit(0)) + 1
    piece = F.substring(F.col("text"), (F.pmod(F.xxhash64(key), spare) + 1).cast("int"), F.lit(chars))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("share", "text"))
    taken = (
        rows.join(F.broadcast(rates), "lang")  # MOST_LANGUAGES rows at most
        .where(share < F.col("rate"))
        .select("lang", share.alias("share"), piece.alias("text"))
        # Every language keeps its own bound, so none is cut off by the others.
        .withColumn("rank", rank).where(F.col("rank") <= 2 * sample)
        .orderBy("lang", "share", "text")
    )
    return [(r["text"], r["lang"]) for r in taken.select("text", "lang").collect()]


def fit(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> dict:
    rows = training_sample(docs, sample, chars)
    return crf.fit([t for t, _ in rows], [lang for _, lang in rows])


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the mean marginal of that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed tables, a few MB
    names = [*model["languages"], UNKNOWN]

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        whole = ["" if t is None else t for t in texts]
        if len(names) == 1:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(whole), "score": [0.0] * len(whole)})
        shares = crf.label_texts(shared.value, whole)
        best = shares.argmax(axis=1)
        score = shares[np.arange(len(whole)), best]
        return pd.DataFrame(
            {
                "lang_pred": [names[b] if s > 0 else UNKNOWN for b, s in zip(best, score, strict=True)],
                "score": np.minimum(score, 1.0),
            }
        )

    return (
        docs.withColumn("__p", label("text"))
        .withColumn("lang_pred", F.col("__p.lang_pred"))
        .withColumn("score", F.col("__p.score"))
        .drop("__p")
    )


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    narrow = docs.select("doc_id", "text", "lang")
    return predict(narrow, fit(narrow)).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )


def known_language(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Documents in a language that the model knows with at least this score."""
    found = predict(docs, fit(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(docs.columns)
