"""Feature ingestion: typed feature array + scalar label, null-checked JVM-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_features(
    df: DataFrame,
    feature_cols: list[str],
    label_col: str,
    key_col: str = "key",
    keep: tuple[str, ...] = ("split",),
) -> DataFrame:
    """``(key, features ARRAY<DOUBLE>, label DOUBLE, *keep)``.

    A null feature or label fails the job (``raise_error``) instead of being silently
    dropped. An array-typed label (an ``(m, 1)`` target) is squeezed to its first element.
    """
    feats = [F.col(c).cast("double") for c in feature_cols]
    label_type = df.schema[label_col].dataType.typeName()
    label = F.element_at(F.col(label_col), 1) if label_type == "array" else F.col(label_col)
    label = label.cast("double")
    any_null = F.lit(False)
    for c in feats:
        any_null = any_null | c.isNull()
    any_null = any_null | label.isNull()
    checked = F.when(any_null, F.raise_error(F.concat(F.lit("null feature/label at key "), F.col(key_col).cast("string")))).otherwise(F.array(*feats))
    extra = [c for c in keep if c in df.columns]
    return df.select(F.col(key_col).alias("key"), checked.alias("features"), label.alias("label"), *extra)
