"""Digest columns of span lists, for results that are compared by value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    said = F.transform(
        spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    )
    return F.array_join(said, ",")


def digest(found: DataFrame, base_kinds: Sequence[str]) -> DataFrame:
    """Counts of the base kinds, a hash over their spans, and all spans as text."""
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in base_kinds]
    base = F.filter(spans, lambda s: s["kind"].isin(*base_kinds))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
