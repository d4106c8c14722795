"""Models fitted and scored on whole tables, in sample: no split is held back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import ml
from tidewell.registry import query
from tidewell.session import tables


def _labelled(spark, sf_dir):
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return docs.join(labels.where("quality is not null"), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), "quality")


@query("risk_model_metrics")
def risk_model_metrics(spark, sf_dir):
    """Logistic quality by text length, on every labelled document."""
    rows = _labelled(spark, sf_dir)
    return ml.metrics(ml.score(ml.fit_risk(rows, ["n_chars"], "quality"), rows), "quality")


@query("text_model_metrics")
def text_model_metrics(spark, sf_dir):
    """TF-IDF quality classifier with classes weighing alike, on every labelled document."""
    rows = ml.balance(_labelled(spark, sf_dir), "quality")
    return ml.metrics(ml.score(ml.fit_text(rows, "text", "quality", "weight"), rows), "quality")
