"""A training corpus from raw documents: toxic texts go, copies go, benchmark leaks go, personal data is
sanitised, and what is left is packed.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame;
between stages it is written as Parquet and read again. All but the last return the columns of
documents, whatever further columns there are and however they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, ngram_join, packing, pii, toxicity
from tracewright.llm.common import cut
from tracewright.llm.queries import table, tokenizer_file
from tracewright.storage import drop_run, gathered, reach_workers, tables_of_run


def carried(docs: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """change(docs), with all columns but doc_id and text under neutral names meanwhile; in files of about 100,000 documents."""
    reach_workers(docs.sparkSession)
    names = {c: c if c in ("doc_id", "text") else f"__carried_{k}" for k, c in enumerate(docs.columns)}
    out = change(docs.toDF(*names.values()))
    return gathered(out.select(*[F.col(n).alias(c) for c, n in names.items()]), docs.count())


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    reach_workers(spark)
    chain = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return carried(docs, lambda d: toxicity.score(d, chain).where("not toxic"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id; of rows that repeat id and text
    one stays, of rows of one id with different texts all that are no near copies, and rows with a null id,
    which can't be grouped, all stay."""
    return carried(docs, ngram_join.keep_one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = table(spark, sf_dir, "benchmark")
    return carried(docs, lambda d: decontaminate.mark(d, items, with_tiles=False).where("not contaminated"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts; n_chars follows."""
    out = carried(docs, pii.sanitise)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1,024 tokens."""
    reach_workers(spark)
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier, nor the join, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Once a stage is written, the tables behind it are deleted; the last one is read from its own."""
    docs = table(spark, sf_dir, "documents")
    with tables_of_run() as own:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = cut(docs, f"stage-{name}")
                drop_run(spark, own, docs)
    return docs
