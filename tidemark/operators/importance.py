"""Feature importances over blocks: means, top features, heatmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.checks import require_columns
from tidemark.operators.shape import normalised

GAIN, SPLIT = "importance_gain", "importance_split"


def importance_columns(df: DataFrame) -> list[str]:
    """Those of gain and split that the frame has; none raises."""
    got = [c for c in (GAIN, SPLIT) if c in df.columns]
    if not got:
        raise ValueError("no importance column")
    return got


def importance_mean(df: DataFrame, feature: str = "feature") -> DataFrame:
    """Mean gain and split of each feature over its blocks."""
    require_columns(df, [feature], "importances")
    return df.groupBy(feature).agg(*[F.avg(c).alias(f"mean_{c.removeprefix('importance_')}") for c in importance_columns(df)])


def top_features(df: DataFrame, k: int, feature: str = "feature", by: str = "mean_gain") -> DataFrame:
    """The ``k`` features of the largest mean, ties by name."""
    return importance_mean(df, feature).orderBy(F.desc(by), feature).limit(k)


def block_importance(df: DataFrame, k: int, feature: str = "feature", block: str = "block_name", col: str = GAIN) -> DataFrame:
    """(feature, block, value) of the features whose mean of ``col`` is largest, 0 where a block lacks one; long form of lines and heatmaps."""
    require_columns(df, [col], "importances")
    top = top_features(df, k, feature, f"mean_{col.removeprefix('importance_')}").select(feature)
    kept = df.join(F.broadcast(top), feature)  # k rows
    cells = top.join(kept.select(block).distinct(), F.lit(True))  # k features x blocks that are reported
    sums = kept.groupBy(feature, block).agg(F.sum(col).alias("value"))
    return cells.join(sums, [feature, block], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def importance_heatmap(df: DataFrame, k: int, feature: str = "feature", block: str = "block_name", col: str = GAIN, scale: bool = True) -> DataFrame:
    """The same, scaled to 0..1 within each feature."""
    out = block_importance(df, k, feature, block, col)
    return normalised(out, "value", [feature]) if scale else out


def heatmap_matrix(df: DataFrame, k: int, blocks: list[str], feature: str = "feature", block: str = "block_name", col: str = GAIN) -> DataFrame:
    """Feature x block matrix of the top features."""
    return importance_heatmap(df, k, feature, block, col, False).groupBy(feature).pivot(block, blocks).agg(F.first("value")).na.fill(0.0)
