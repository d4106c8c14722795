"""A corpus pipeline over ``documents``: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import cut, prepare, read
from tidewell.llm.jaccard import near_duplicates
from tidewell.llm.linedup import line_dedup
from tidewell.llm.mixing import mix
from tidewell.llm.packing import pack
from tidewell.llm.quality import quality_filter
from tidewell.llm.queries import tokenizer_path

#: Domains by weight, languages and sources in them by their own tokens; 90 % of all tokens, twice at most.
WEIGHTS = {"domain": {"d0": 45, "d1": 20, "d2": 20, "d3": 15}, "lang": "supply", "source": "supply"}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go: a null or empty text has too few words. Repeated rows fare alike."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go from the texts, and documents of which nothing is left. ``n_chars`` is
    counted anew (null for a null text). The least (id, line) of equal windows stays; rows that share id
    and text are one document."""
    out = line_dedup(docs).where("n_removed_lines = 0 or text <> ''")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the least id stays. Texts without words stay
    alone; of rows that share id and text one stays, and so do different texts under the least id."""
    kept = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept"]), "left_semi").dropDuplicates(["doc_id", "text"])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to WEIGHTS: each once for each epoch that it is chosen in. A null language or source is one
    of its own; a text without words has no tokens and goes where its place in the epoch puts it."""
    return mix(docs, WEIGHTS, budget_share=0.9, max_epochs=2).select("record.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 4096; a null or empty text is its end mark alone."""
    return pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near), ("mixing", mixing), ("packing", packing)]

#: Near duplicates, tokens and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
