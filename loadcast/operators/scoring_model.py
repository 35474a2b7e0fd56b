"""Scoring with a trained model package (M16/M17, P35): align request features with the
package's feature list, encode categoricals with the stored vocabulary (unseen -> 0), fill
what is missing, and run the stored pipeline over the whole request table in one
``transform`` (no per-row calls)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


def fill_missing_features(df: DataFrame, feature_columns, fill_numbers: bool = True) -> DataFrame:
    """Absent feature columns are added (categorical -> 'default', numeric -> 0); nulls
    in present columns become 'default' / 0 (NaN is NULL after ingest). With
    ``fill_numbers=False`` nulls of present numeric columns stay, for imputation."""
    out = df
    for c in feature_columns:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(K.CATEGORICAL_FILL) if c in K.CATEGORICAL_COLUMNS
                                 else F.lit(0.0))
    cats = [c for c in feature_columns if c in K.CATEGORICAL_COLUMNS]
    nums = [c for c in feature_columns if c not in K.CATEGORICAL_COLUMNS]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(K.CATEGORICAL_FILL)) for c in cats})
    if not fill_numbers:
        return out
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(out.schema[c].dataType))
                            for c in nums})
