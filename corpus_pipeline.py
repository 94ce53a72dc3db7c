"""The corpus pipeline: documents to training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents, in their order and under whatever names,
rows and further columns as they are. Null texts and empty ones are kept by the first four stages and packed as one token each. Rows with a null id are never dropped as copies
or cut. Repeated rows are exact copies of one document: stages keep or drop them together. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm import decontamination, ngram_join, packing, substring_dedup, toxicity
from tabularium.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts to be toxic go; without labels of both kinds all stay."""
    net = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    scored = toxicity.score(plain, net, f"c{docs.columns.index('text')}", "score", "toxic")
    return scored.where("toxic = 0").select(*plain.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are linked by a Jaccard similarity of 0.8, that with the smallest id stays (ties: all rows of that id); texts without words stay."""
    return ngram_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 50 words that also begin in a document with a smaller id go; n_chars, where there is one, follows the text."""
    cut = substring_dedup.dedup_substrings(docs)
    if "n_chars" not in docs.columns:
        return cut
    size = F.coalesce(F.length("text").cast("long"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*(size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item (13 tokens, or a whole shorter item, of which 80 % are equal) go; null and empty texts stay."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of at most 4096 tokens; a null or empty text is one token, and every repeated row gets a place."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: A trained network and min-hashed paths have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
