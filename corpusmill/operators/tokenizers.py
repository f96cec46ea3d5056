"""Tokenizers behind one interface: token, start and end (half-open, in characters) of each token of a text."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encode = Callable[[str], list[tuple[str, int, int]]]
KIND = "array<struct<token:string,start:int,end:int>>"


def whitespace(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", text)]


def by_pattern(pattern: str) -> Encode:
    found = re.compile(pattern)
    return lambda text: [(m[0], m.start(), m.end()) for m in found.finditer(text)]


def encoded(text: Column | str, encode: Encode = whitespace) -> Column:
    """The tokens of a text column by any function of that form, in Arrow batches; null for null."""

    @F.pandas_udf(KIND)
    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"token": a, "start": b, "end": c} for a, b, c in encode(t)])

    return batch(F.col(text) if isinstance(text, str) else text)


def tokens(texts: DataFrame, key: str, text: str = "text", encode: Encode = whitespace) -> DataFrame:
    """key, token_no (from 0), token, start and end of each token."""
    return texts.select(key, F.posexplode(encoded(text, encode)).alias("token_no", "_t")).select(key, "token_no", "_t.*")
