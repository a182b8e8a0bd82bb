"""Quality of extracted texts against expected and unwanted segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import trimmed


def segment_hits(results: DataFrame, gold: DataFrame, *, key: str = "url", text_col: str = "text") -> DataFrame:
    """(key, segment, wanted, found): whether each expected (``with``) or unwanted (``without``) segment is in the page's text.

    White space is normalised on both sides; a missing text holds nothing.
    """
    rows = gold.select(key, F.explode(F.concat(F.transform("with", lambda s: F.struct(s.alias("segment"), F.lit(True).alias("wanted"))), F.transform("without", lambda s: F.struct(s.alias("segment"), F.lit(False).alias("wanted"))))).alias("s")).select(key, "s.*")
    texts = results.select(key, trimmed(text_col).alias("__text"))
    return rows.join(texts, key, "left").select(key, "segment", "wanted", F.coalesce(F.contains(F.col("__text"), trimmed("segment")), F.lit(False)).alias("found"))


def confusion(hits: DataFrame, *by: str) -> DataFrame:
    """True and false positives and negatives, precision, recall, accuracy and F of segment hits."""
    n = lambda wanted, found: F.count_if((F.col("wanted") == wanted) & (F.col("found") == found))
    out = hits.groupBy(*by).agg(n(True, True).alias("tp"), n(True, False).alias("fn"), n(False, True).alias("fp"), n(False, False).alias("tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    out = out.withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn)).withColumn("accuracy", share(tp + tn, tp + tn + fp + fn))
    return out.withColumn("f_score", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
