"""From raw documents to packed training sequences: language, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import common


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; those without text or letters go."""
    from quadrille.llm.langid import keep_identified, train

    return keep_identified(docs, train(docs.select("doc_id", "text", "lang")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, one of those that bear the smallest doc_id.

    Rows are told apart by doc_id and a hash of their text, so rows that share a doc_id go or stay each by its own text;
    of rows equal in both one stays. Rows without a doc_id stay.
    """
    from pyspark.sql import functions as F

    from quadrille.llm.minhash import near_duplicates

    mark, key = common.unused(docs, "text_mark"), common.unused(docs, "id_key")
    text_mark = F.xxhash64(F.coalesce("text", F.lit(""))).alias(mark)
    found = near_duplicates(docs.select("doc_id", "text", text_mark), extra=(mark,)).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(key), mark)
    found = common.materialise(found.agg(F.min("first").alias("first"), F.count("*").alias("n")).where("NOT first OR n > 1"), "pipeline-found")
    marked = docs.select("*", text_mark)
    same = (F.col("doc_id") == F.col(key)) & (marked[mark] == found[mark])
    out = marked.join(found, same, "left_anti").select(*docs.columns)
    repeated = found.where("first")
    if not repeated.isEmpty():  # rows equal in doc_id and text: any one of them
        again = marked.join(repeated.select(key, F.col(mark).alias(mark + "_")), (F.col("doc_id") == F.col(key)) & (F.col(mark) == F.col(mark + "_")))
        out = out.unionByName(again.dropDuplicates(["doc_id", mark]).select(*docs.columns))
    return out


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by the name of its kind; a null text stays null."""
    from pyspark.sql import functions as F

    from quadrille.llm.pii import redact

    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; rows that repeat a doc_id are packed each."""
    from quadrille.llm.packing import pack

    return pack(docs.select("doc_id", "text"))


STAGES = [("language", identified), ("near-duplicates", deduplicated), ("personal data", redacted), ("packing", packed)]

#: SQL can't express language models, MinHash or the tokenizer; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialise(docs, "stage-" + name.replace(" ", "-"))
    return docs
