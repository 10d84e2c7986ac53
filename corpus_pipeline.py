"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, encoding.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its
predecessor kept; its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

A null or letterless text goes in the first stage; empty and repeated texts
leave one row; rows without a doc_id come after those with one; texts of any
length are read whole; an empty table gives an empty table; further columns
are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.decontaminate import decontaminated
from chainloom.llm.exactdedup import exact_dedup
from chainloom.llm.languages import UND, fit, predicted
from chainloom.llm.nearcopies import near_copies
from chainloom.llm.pieces import encoded
from chainloom.llm.samples import fresh
from chainloom.session import written

#: Least mean probability of a language that keeps a document. A text of two or three languages has more and stays;
#: less is close to even odds over what was learned: no text of any of them.
CONFIDENT = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a language of at least CONFIDENT; lang becomes what was predicted."""
    lang, score = fresh(docs.columns, "lang_pred", "lang_score")
    out = predicted(docs, fit(docs), lang=lang, score=score).where((F.col(lang) != UND) & (F.col(score) >= CONFIDENT))
    return out.select(*(F.col(lang).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies the one with the smallest doc_id: 5-word shingles, Jaccard 0.8 or more.

    Fingerprints link first; what three bits don't reach is completed exactly.
    """
    return near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of any benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces."""
    import public_tokenizers

    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Language ID, near-dedup and the encoding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
