"""The corpus pipeline: toxicity, line dedup, near duplicates, source mixing, BPE round trip.

A stage takes documents of any further columns and gives the same columns, whatever their names; an
empty table passes through; very long texts are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volscreen.llm import bpe, jaccard, lines, mixing, toxicity
from volscreen.llm.common import fresh, staged, table


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row, and its name: the id, or where ids are null or repeated a number that rises with the id (nulls last)."""
    (key,) = fresh(docs.columns, "row_key")
    own = F.col("doc_id").cast("long")
    ids = docs.select(own.alias("doc_id")).groupBy("doc_id").count()
    if ids.where("doc_id IS NULL OR count > 1").isEmpty():
        return docs.withColumn(key, own), key
    return staged(docs.orderBy(own.asc_nulls_last()).withColumn(key, F.monotonically_increasing_id()), "row-keys"), key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on this stage's input, scores below 0.5; a null text is scored as an empty one."""
    (name,) = fresh(docs.columns, "toxic_score")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=name).where(F.col(name) < 0.5).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of repeated windows, n_chars of what is left; a document that loses every line goes, null and empty texts stay."""
    out = fresh(docs.columns, *lines.OUT)
    cut = lines.dedup_lines(docs, out=tuple(out))
    n, gone, kept = map(F.col, out)
    changed = {"text": kept}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(gone > 0, F.length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.where((gone == 0) | (gone < n)).withColumns(changed).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each component of near copies (null ids last).

    Every row counts by itself: of repeated rows one stays, rows of one id and unrelated texts all stay;
    texts without words are like no other.
    """
    rows, key = keyed(docs)
    gone = jaccard.jaccard_components(rows, id_col=key).where("component_id < doc_id").select(F.col("doc_id").alias(key))
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix enters it: none, once or twice (whole texts); a row without words is never entered."""
    rows, key = keyed(docs)
    copies, copy = fresh(rows.columns, "copies", "copy")
    taken = mixing.taken_words(rows, id_col=key).where("taken > 0")
    taken = taken.select(F.col("doc_id").alias(key), F.ceil(F.col("taken") / F.col("size")).cast("int").alias(copies))
    return rows.join(taken, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_tokens and the digests of ids and decoded text of every document of the mix."""
    return bpe.digests(bpe.encode_documents(docs, bpe.tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", one_of_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: The stages are not all expressible in SQL; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
