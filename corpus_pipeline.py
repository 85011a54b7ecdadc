"""The corpus pipeline: five stages from documents to token shards.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again
before the next. All but the last return the columns of documents, extra ones too, whatever their names: the operators see
numbered columns, so none of theirs can clash. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, mixing, simhash, sst
from tidemark.llm.common import shared_folder, written
from tidemark.session import table


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under the names column_0, column_1 and so on, and which name stands for which."""
    names = [f"column_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def named_again(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The numbered columns of found under the names that docs has."""
    return found.select(*[f"column_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or text, and those for which no language has half the probability.

    A null label is no example; a null id is not held out; repeated rows are judged alike."""
    plain, at = numbered(docs)
    model = language_id.train(plain.where(~language_id.held_out(at["doc_id"])), at["text"], at["lang"])
    found = language_id.predict(plain, model, at["text"])
    return named_again(found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= 0.5)), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash component, that with the smallest doc_id, a null id last.

    Repeated rows are one; rows that share an id but lie in unlike components stay, each for its own."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a benchmark's windows cover a twentieth or more; a null or empty text has none and stays."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    plain, at = numbered(docs)
    return named_again(decontaminate.judged(decontaminate.scan(plain, items, at["text"])).where(~F.col("contaminated")), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes its words, to the nearest whole number; 0 drops it, as it does texts without a word.

    Only documents at an end of a shard's run are taken in part, so this keeps the sources' shares."""
    plain, at = numbered(docs)
    times = F.floor(F.col("mix_taken") / F.col("mix_size") + 0.5).cast("int")
    found = mixing.mix(plain, at["doc_id"], at["source"], at["text"]).where((F.col("mix_size") > 0) & (F.col("mix_taken") > 0)).withColumn("times", times).where("times > 0")
    return named_again(found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))), docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and reads them back: doc_id, start, n_tokens, ids_crc32 of each row."""
    import public_tokenizers

    files = sst.write(docs.select("doc_id", "text"), shared_folder(spark), public_tokenizers.path("byte_bpe_50k.json"))
    return sst.read(spark, files)


STAGES = [
    ("language_id", known_language),
    ("simhash", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_shards", token_shards),
]

#: The tokenizer cannot be told in SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
