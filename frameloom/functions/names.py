"""Actor-name folding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_names(names: DataFrame, source: str = "item", target: str = "label") -> DataFrame:
    """Add the folded form of a name: parentheses dropped (innermost first),
    compatibility-decomposed to ASCII, lower case, letters, digits and single
    spaces only.

    Spark has no Unicode normalization, so this one step runs in Python over
    Arrow batches. Give it distinct names, not rows.
    """

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        folded = values.fillna("")
        while folded.str.contains(r"\([^()]*\)", regex=True).any():
            folded = folded.str.replace(r"\([^()]*\)", "", regex=True)
        ascii_only = folded.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")
        kept = ascii_only.str.lower().str.replace(r"[^a-z0-9\s]+", "", regex=True)
        return kept.str.split().str.join(" ")

    return names.withColumn(target, fold(F.col(source)))
