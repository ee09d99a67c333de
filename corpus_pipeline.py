"""Corpus pipeline: documents to training tokens, five stages of the llm operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``docs``. ``run`` writes each stage's rows to the shared checkpoint folder and reads them
back for the next, so a lost executor costs at most one stage.

Rows without doc_id pass through the near-duplicate stages; null texts count as empty; rows that
repeat a doc_id stay or go together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspan.llm import jaccard, mixing, pieces, quality, repeats
from sigspan.llm.common import read, stage


ROW = "_whole_row"


def whole_row(docs: DataFrame) -> Column:
    """All columns as one, so that their names meet none of an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; labels of the held-out fold train nothing."""
    train_rows = ~quality.held_out(F.col("doc_id"), 5, 0)
    model = quality.train(docs, read(spark, sf_dir, "labels"), train_rows)
    rows = docs.select("doc_id", "text", whole_row(docs))
    kept = quality.score(rows, model, keep=[ROW]).filter(F.col("score") >= quality.THRESHOLD)
    return kept.select(f"{ROW}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest doc_id, of each class of near-duplicates."""
    kept = jaccard.similar_classes(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    named = docs.filter("doc_id is not null").join(kept, docs["doc_id"] == kept["_kept_id"], "left_semi")
    return named.unionByName(docs.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that also stand earlier; ``n_chars`` follows the text."""
    out = repeats.remove_repeats(docs, counts=("_n_words", "_n_removed"))
    if "n_chars" in docs.columns:
        changed = F.when(F.col("_n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.drop("_n_words", "_n_removed")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document as often as the mix takes it whole, and once more with its first words
    when it takes a part; documents it does not take go."""
    mixed = mixing.mix(docs.select("doc_id", "source", "text", whole_row(docs)), keep=[ROW])
    mixed = mixed.filter("taken > 0").withColumn("whole", F.floor(F.col("taken") / F.col("size")).cast("int"))
    mixed = mixed.withColumn("part", (F.col("taken") - F.col("whole") * F.col("size")).cast("int"))
    copies = F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)
    rows = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).withColumn("partial", F.col("copy") > F.col("whole"))
    text = F.col(ROW).getField("text")
    words = F.slice(F.regexp_extract_all(text, F.lit(f"({mixing.WORD})"), 1), F.lit(1), F.col("part"))
    text = F.when(F.col("partial"), F.array_join(words, " ")).otherwise(text)
    new = {"text": text}
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("partial"), F.length(text)).otherwise(F.col(ROW).getField("n_chars"))
        new["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(ROW).getField(c)).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, source, n_tokens, ids)``: token ids of every text of the mix."""
    out = pieces.encode(docs, keep=["doc_id", "source"])
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("tokens", tokens),
]
ORACLE_SQL = None  # a trained classifier and BPE merges; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
