"""Documents to coded token ids in five stages. Each stage gets all that the one before it kept, written as Parquet and read again."""
from pyspark.sql import functions as F

from studyloom.llm import kneserney, mixing, orderminhash, tiling
from studyloom.llm.filters import without
from studyloom.llm.queries import TOXICITY, encoded, table
from studyloom.llm.tables import Scratch

#: Passes through a source for one through the source repeated least. At this limit every document stays in at least once.
REPEATS = 1.25


def toxicity(spark, docs, sf_dir):
    """Documents that are rejected as toxic go; NULL and empty texts stay."""
    score = kneserney.scorer(spark, docs, table(spark, sf_dir, "labels"), **TOXICITY)
    return docs.where(score(F.col("text")) < 0.5)


def near_duplicates(spark, docs, sf_dir):
    """One document of each class of near duplicates stays, the one with the smallest id."""
    return orderminhash.first_of_each(spark, docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold the greater part of a benchmark item go; documents without an id stay."""
    found = tiling.find(spark, docs, table(spark, sf_dir, "benchmark"))
    return without(docs, "doc_id", found.select("doc_id"), "doc_id")


def mixture(spark, docs, sf_dir):
    """Sources are repeated up to their budgets; a document stands once for every pass that takes its block."""
    return mixing.copied(spark, docs, repeats=REPEATS).select(*docs.columns)


def token_ids(spark, docs, sf_dir):
    """Token ids in coded block files, read back: one row per document and pass."""
    return encoded(spark, docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_ids", token_ids)]
#: Fitted models, tiling and coding are no SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over the documents of ``sf_dir``."""
    tables = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir))
    return docs
