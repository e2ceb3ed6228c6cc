"""Case folding by Unicode's full table, where lower case with ß written ss isn't enough.

A few hundred characters differ (ligatures, final sigma, Cherokee, ...); ``text.fold``
stays native and is used everywhere else.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("string")
def casefold(words: pd.Series) -> pd.Series:
    """Each word folded; null stays null."""
    return words.map(str.casefold, na_action="ignore")
