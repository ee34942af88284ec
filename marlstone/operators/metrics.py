"""Quality of transcripts: word error rates and the thresholds that a model must meet."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.model import EngineError

_WORD = re.compile("[a-z0-9]+")
#: The most word errors in clean and in noisy speech, and segments in silence.
CLEAN, NOISY, SILENCE = 0.25, 0.40, 0


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def edit_distance(a: list, b: list) -> int:
    """Least insertions, deletions and replacements that make ``b`` of ``a``, one row of the table at a time."""
    index = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    x = np.array([index[w] for w in b], np.int64)
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for i, w in enumerate(a, 1):
        least = np.minimum(row[1:] + 1, row[:-1] + (x != index[w]))
        row = np.minimum.accumulate(np.concatenate(([i], least)) - steps) + steps
    return int(row[-1])


def word_errors(reference: str, found: str) -> tuple[int, int]:
    """Errors and words of the reference."""
    a = words(reference)
    return edit_distance(a, words(found)), len(a)


def word_error_rate(reference: str, found: str) -> float:
    errors, n = word_errors(reference, found)
    if not n:
        raise EngineError("empty_reference", "a reference without words")
    return errors / n


def word_errors_column(reference: Column, found: Column) -> Column:
    """struct(errors, words) of each pair of texts; null texts have no words."""

    @F.pandas_udf("errors int, words int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield pd.DataFrame([word_errors(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["errors", "words"])

    return run(reference, found)


def corpus_error_rate(pairs: DataFrame, *keys: str) -> DataFrame:
    """keys, errors, words, rate of all (reference, found) pairs together; the rate is null without words."""
    own = pairs.withColumn("e", word_errors_column(F.col("reference"), F.col("found")))
    sums = own.groupBy(*keys).agg(F.sum("e.errors").alias("errors"), F.sum("e.words").alias("words"))
    return sums.withColumn("rate", F.try_divide("errors", "words"))


def accepted(clean: float, noisy: float, silent_segments: int) -> bool:
    return clean <= CLEAN and noisy <= NOISY and silent_segments == SILENCE
