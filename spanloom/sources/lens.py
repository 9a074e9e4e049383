"""Lenses: declarative renames and hoists between record shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_lens(df: DataFrame, rules: list[tuple[str, str]], passthrough: bool = False) -> DataFrame:
    """Columns by (path, name): a dotted path hoists a nested field. Unmatched columns stay only with ``passthrough``;
    a path that the table lacks gives a null column."""
    roots = {path.split(".")[0] for path, _ in rules}

    def known(path: str) -> bool:
        kind = df.schema
        for part in path.split("."):
            if not hasattr(kind, "fields") or part not in kind.fieldNames():
                return False
            kind = kind[part].dataType
        return True

    out = [(F.col(path) if known(path) else F.lit(None)).alias(name) for path, name in rules]
    return df.select(*out, *([c for c in df.columns if c not in roots] if passthrough else []))


def resolve_lens(lenses: DataFrame, source: str, target: str) -> DataFrame:
    """The first lens by uri from a source to a target."""
    return lenses.where((F.col("source") == source) & (F.col("target") == target)).orderBy("uri").limit(1)
