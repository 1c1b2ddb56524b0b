"""Sources (parquet tables, planted fixtures, feature loading) and sinks."""

from tuneforge.sources.tables import read_table
from tuneforge.sources.features import load_features

__all__ = ["read_table", "load_features"]
