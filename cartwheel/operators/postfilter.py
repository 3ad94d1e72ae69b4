"""Post-filters applied to suggestion lists (customer_id, style_id, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import months_before
from ..sources.mart import CUSTOMER, STYLE


def best_per_style(suggestions: DataFrame, score: str = "score",
                   keys: tuple[str, ...] = (CUSTOMER,)) -> DataFrame:
    """One row per (customer, style), keeping the highest score.
    Partial aggregation runs before the shuffle."""
    return suggestions.groupBy(*keys, STYLE).agg(F.max(score).alias(score))


def exclude_recent(suggestions: DataFrame, invoices: DataFrame, months: int,
                   as_of: str | None = None, any_old_purchase: bool = False) -> DataFrame:
    """Drop styles the customer bought.

    ``months <= 0``: every style the customer ever bought is dropped.
    ``months > 0``: a style bought on or after ``as_of - months`` is dropped
    (a purchase strictly before the cutoff is old). With ``any_old_purchase`` a
    style is kept as soon as one purchase of it is old, even if it was bought
    again recently.
    """
    bought = invoices.select(CUSTOMER, STYLE, "invoice_date")
    if months <= 0:
        blocked = bought.select(CUSTOMER, STYLE)
    else:
        if as_of is None:
            raise ValueError("as_of is required when months > 0")
        cutoff = months_before(as_of, months)
        if any_old_purchase:
            blocked = (bought.groupBy(CUSTOMER, STYLE).agg(F.min("invoice_date").alias("first"))
                       .filter(F.col("first") >= cutoff).select(CUSTOMER, STYLE))
        else:
            blocked = bought.filter(F.col("invoice_date") >= cutoff).select(CUSTOMER, STYLE)
    return suggestions.join(blocked, [CUSTOMER, STYLE], "left_anti")


def exclude_tags(suggestions: DataFrame, mixes: DataFrame, excluded: list[str],
                 require_tag: bool = False) -> DataFrame:
    """P5: drop styles carrying any excluded tag. Untagged styles stay unless
    ``require_tag`` (then only tagged styles survive)."""
    out = suggestions
    if excluded:
        bad = mixes.filter(F.col("mix").isin(list(excluded))).select(STYLE)
        out = out.join(bad, STYLE, "left_anti")
    if require_tag:
        out = out.join(mixes.select(STYLE), STYLE, "left_semi")
    return out


def top_k(suggestions: DataFrame, k: int, score: str = "score",
          partition: tuple[str, ...] = (CUSTOMER,), tie: str = STYLE,
          rank_col: str = "rank") -> DataFrame:
    """The k best rows per customer, score descending, ties by style.

    ``row_number() <= k`` lets Spark insert a per-task group limit before the
    shuffle, so a customer with a huge list sends at most k rows per task.
    """
    w = Window.partitionBy(*partition).orderBy(F.col(score).desc(), F.col(tie).asc())
    return (suggestions.withColumn(rank_col, F.row_number().over(w))
            .filter(F.col(rank_col) <= k))
