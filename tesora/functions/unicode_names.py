"""Compatibility normalisation of names, the one text step the JVM functions lack."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesora.functions.scalar import name_key


@F.pandas_udf(T.StringType())
def nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def distinct_name_keys(df: DataFrame, name: str) -> DataFrame:
    """``(name, name_key)`` once per distinct name, so Python sees each name one time."""
    names = df.select(F.col(name)).where(F.col(name).isNotNull()).distinct()
    return names.withColumn("name_key", name_key(nfkc(F.col(name))))


def nfkc_name_key(c: Column | str) -> Column:
    return name_key(nfkc(F.col(c) if isinstance(c, str) else c))
