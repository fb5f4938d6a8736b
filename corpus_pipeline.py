"""From documents to training tokens: quality rules, language ID, near-duplicate removal, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns rows with the columns of documents, the last one those
of its tokens instead of texts. Stages are written and read again between each other. Nulls and repeated rows are handled as
the operators say: documents of less than 50 words, and so null texts, go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, jaccard, langid, mixing, rules
from lexmill.llm.common import cut, remainder
from lexmill.llm.queries import vocabulary

#: Predictions of a language below this score, which are ties but for a hair, are rejected; texts of two languages are not. Texts with so many
#: times the phrases that any known text of their language has are in none of the languages learned.
LEAST_SCORE, MOST_ODDNESS = 1e-4, 2.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rule and the thresholds of their language and source."""
    return rules.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; `und`, doubtful ones and those in a language that was not learned go."""
    model = langid.fit(docs.filter(remainder("doc_id", 4) != 2))
    own = ("lang_pred", "score", "oddness")
    clash = {c: f"_own_{c}" for c in docs.columns if c in own}
    found = langid.predict(docs.withColumnsRenamed(clash), model, outputs=own)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & (F.col("oddness") <= MOST_ODDNESS))
    return kept.drop(*own).withColumnsRenamed({v: k for k, v in clash.items()})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts linked by a similarity of 0.8 on word 5-grams: the one with the smallest id."""
    return jaccard.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (up to twice), dealt out to shards and shuffled."""
    plan = mixing.Plan(cut(mixing.sizes(docs.select("doc_id", "text", "source")), "sizes"))
    return plan.mixed(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and the digest of the text that they decode to."""
    return bpe.encode(docs, vocabulary(), ("ids", "n_tokens", "decoded_sha256"), keep_text=False)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("BPE", tokens),
]

#: SQL can't express the trained model, the thresholds' sketches and the merges; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{i}")
    return docs
