"""A corpus pipeline of five stages over documents: quality rules, line dedup, n-gram Jaccard join,
benchmark decontamination, and mixing of sources to target weights.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last keep the columns of documents.

Defined cases: a document without words (null, empty) is rejected by the first stage; rows that are repeated are
copies of one another, of which the third stage keeps one; null ids, languages and sources stay null and are a
source of their own in the last; very long texts are used whole; ties are broken by id, then by a hash of the
text; an empty table gives an empty result; other columns, whatever their names, are kept up to the last stage."""

from pyspark.sql import DataFrame, SparkSession

from mirrorlake.llm import decontaminate, jaccard, lines, mixing, rules
from mirrorlake.llm.common import stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return rules.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are near an earlier line go from the text; n_chars follows the text. All documents stay."""
    from pyspark.sql import functions as F

    out = lines.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
]

#: Stages 2 to 4 cannot be said in SQL over whole tables; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage{k + 1}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
