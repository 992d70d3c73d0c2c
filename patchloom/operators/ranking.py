"""Ranking of texts and of sequences of steps by a scorer that can be exchanged."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A scorer gets two arrays of texts, row by row what is asked and what is ranked, neither null, and gives a number a row.
#: For sequences the ranked one is an array of arrays of texts, the steps in order.
Scorer = Callable[[pa.Array, pa.Array], np.ndarray]
WORD = re.compile(r"\w+")


def _words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shared_words(asked: pa.Array, ranked: pa.Array) -> np.ndarray:
    """The share of all distinct words of both texts that both have; 0 where neither has any."""
    out = np.zeros(len(asked))
    for i, (a, b) in enumerate(zip(asked.to_pylist(), ranked.to_pylist(), strict=True)):
        x, y = set(_words(a)), set(_words(b))
        out[i] = len(x & y) / len(x | y) if x or y else 0.0
    return out


def common_runs(asked: pa.Array, ranked: pa.Array) -> np.ndarray:
    """The share of the ranked text's pairs of neighbouring words that the other has too: a score that minds order."""
    out = np.zeros(len(asked))
    for i, (a, b) in enumerate(zip(asked.to_pylist(), ranked.to_pylist(), strict=True)):
        x, y = _words(a), _words(b)
        pairs = set(zip(y, y[1:], strict=False))
        out[i] = len(pairs & set(zip(x, x[1:], strict=False))) / len(pairs) if pairs else 0.0
    return out


def in_step(asked: pa.Array, ranked: pa.Array) -> np.ndarray:
    """How well a sequence of steps follows a text: the longest run of its steps, in order and with gaps, each of which
    shares a word with a later place of the text than the one before, as a share of all steps.

    A step takes the first place that is left for it, or a later one where this lets more steps follow: the longest
    increasing choice of places, kept as the earliest end for each length.
    """
    out = np.zeros(len(asked))
    for i, (a, steps) in enumerate(zip(asked.to_pylist(), ranked.to_pylist(), strict=True)):
        places: dict[str, list[int]] = {}
        for p, w in enumerate(_words(a)):
            places.setdefault(w, []).append(p)
        ends: list[int] = []
        for step in steps or []:
            # from the last place to the first, so that a step counts once
            for p in sorted({p for w in set(_words(step)) for p in places.get(w, ())}, reverse=True):
                k = int(np.searchsorted(ends, p))
                ends[k : k + 1] = [p]
        out[i] = len(ends) / len(steps) if steps else 0.0
    return out


def ranked(rows: DataFrame, asked: str, text: str, tie: str, *keys: str, scorer: Scorer = shared_words, places: int = 9) -> DataFrame:
    """rows with score and rank within each key, the highest first, ties to the least `tie`.

    scorer is called with batches of two Arrow arrays; nulls are empty texts (or sequences), a score that is no number
    is null and last. Scores are rounded, lest the last bits decide. asked is a text, text a text or an array of texts.
    """
    if not keys:
        raise ValueError("ranks need a key; one rank over all rows would be one task's work")
    none = F.lit("") if rows.schema[text].dataType.typeName() == "string" else F.array().cast("array<string>")

    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.asarray(scorer(a, b), np.float64), pa.float64(), from_pandas=True)

    out = rows.withColumn("score", F.round(score(F.coalesce(asked, F.lit("")), F.coalesce(text, none)), places))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc_nulls_last(), tie)))
