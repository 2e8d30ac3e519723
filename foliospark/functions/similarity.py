"""Token similarity of two texts: twice the length of matching blocks over all tokens, by the longest block first."""

from __future__ import annotations

import difflib

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import text as X

_TOKEN = regex.compile(r"\p{L}+|\p{Nd}+")


def ratio(a: str | None, b: str | None) -> float:
    ta, tb = _TOKEN.findall((a or "").lower()), _TOKEN.findall((b or "").lower())
    if not ta or not tb:
        return float(not ta and not tb)
    return difflib.SequenceMatcher(None, ta, tb, autojunk=False).ratio()


@F.pandas_udf(T.DoubleType())
def token_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def guarded(pairs: DataFrame, original: str = "original", candidate: str = "candidate", alike: float = 0.72) -> DataFrame:
    """The pairs with similarity and reason. Python compares only pairs that the cheap tests and the upper bound let through.

    Null texts count as empty. Similarity is null where it wasn't needed.
    """
    o, c = F.coalesce(original, F.lit("")), F.coalesce(candidate, F.lit(""))
    judged = pairs.withColumn("_early", X.guard_reason(o, c, alike=alike))
    open_ = F.col("_early").isin("ok", "meta_response", "numbers_changed")
    near = judged.withColumn("similarity", token_similarity(F.when(open_, o), F.when(open_, c)))
    return near.withColumn("reason", F.when(F.col("similarity") < alike, "diverged").otherwise(F.col("_early"))).drop("_early")
