"""Column-expression helpers (JVM-side, codegen friendly)."""

from tuneforge.functions.hashing import hash_uniform, hash_uniform_sql, row_key, row_key_sql

__all__ = ["hash_uniform", "hash_uniform_sql", "row_key", "row_key_sql"]
