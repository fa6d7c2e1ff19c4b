"""Pairs of names of one chunk, compared in Arrow batches; larger sets meet in operators.similar."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import rules


@F.pandas_udf(BooleanType())
def alias_like(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two names are the same letters and digits or alike by a ratio of at least ALIAS."""
    plain = re.compile("[^a-z0-9]+")

    def same(x, y):
        if not x or not y:
            return False
        x, y = x.lower(), y.lower()
        if plain.sub("", x) == plain.sub("", y):
            return True
        m = SequenceMatcher(None, x, y)
        # upper bounds by lengths and by letter counts come first
        return m.real_quick_ratio() >= rules.ALIAS and m.quick_ratio() >= rules.ALIAS and m.ratio() >= rules.ALIAS

    return pd.Series([same(x, y) for x, y in zip(a, b)])
