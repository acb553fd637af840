"""Arrow-batched Python functions, for what the built-in functions can't express."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.LongType())
def vowels(s: pd.Series) -> pd.Series:
    """Vowels in a string."""
    return s.str.count("[aeiouAEIOU]").astype("Int64")


@F.udf(T.StringType())
def initials(s: str | None) -> str | None:
    """The first letters of a string's words, a row at a time."""
    return None if s is None else "".join(w[0] for w in s.split())


@F.udf(T.StringType(), useArrow=True)
def initials_by_arrow(s):
    """The same function, its rows sent in Arrow batches."""
    return None if s is None else "".join(w[0] for w in s.split())


@F.pandas_udf(T.DoubleType())
def weighted_mean(value: pd.Series, weight: pd.Series) -> float:
    """An aggregate of two columns."""
    total = weight.sum()
    return float((value * weight).sum() / total) if total else float("nan")


def below_best(pdf: pd.DataFrame) -> pd.DataFrame:
    """How far values are below the column `best` (for applyInPandas)."""
    return pdf.assign(below=(pdf["best"] - pdf["value"]).round(2))[["event_id", "below"]]


def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, words) for mapInPandas."""
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "words": pdf["text"].fillna("").str.split().str.len().astype("int64")})


@F.udtf(returnType=T.StructType([T.StructField("word", T.StringType()), T.StructField("place", T.IntegerType())]))
class Words:
    """A row for each word of a text."""

    def eval(self, text: str):
        for i, w in enumerate((text or "").split(" ")):
            yield w, i
