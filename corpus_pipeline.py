"""A training-data pipeline over ``documents``: each stage's result is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.llm.decontaminate import report
from featlake.llm.nearcopies import near_copies
from featlake.llm.pieces import encode
from featlake.llm.suffixes import remove_repeated_bytes
from featlake.llm.toxicity import toxicity
from featlake.session import scratch_path, settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the chain finds toxic."""
    scored = toxicity(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(~F.col("toxic")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies.

    Near copies share 0.8 of their shingles of five words, or are linked by such texts; SimHash fingerprints find them first, bands of minima and
    rare shingles those whose fingerprints are further apart. Rows that repeat an id all stay if they are in different
    groups; of those in one group the least text stays, once. Rows without id are kept: nothing tells which of them would stay for the others.
    """
    keepers = settle(near_copies(docs).where("doc_id = component_id").groupBy("doc_id", "hash").agg(F.min("root").alias("root")))
    several = settle(keepers.groupBy("doc_id", "root").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "root"))
    texts = docs.where("doc_id is not null").select(*COLUMNS, F.xxhash64("text").alias("hash"))

    def first(some: DataFrame) -> DataFrame:  # copies of one id meet where the join has put them, so texts are shuffled once
        met = texts.join(some, ["doc_id", "hash"])
        return met.groupBy("doc_id", "hash").agg(F.first("root").alias("root"), F.min(F.struct(*COLUMNS[1:])).alias("row"))

    if several.isEmpty():
        stay = first(keepers)
    else:
        rest = first(keepers.join(several, ["doc_id", "root"], "left_semi"))
        stay = first(keepers.join(several, ["doc_id", "root"], "left_anti")).select("doc_id", "row").unionByName(rest.groupBy("doc_id", "root").agg(F.min("row").alias("row")).select("doc_id", "row"))
    return stay.select("doc_id", *[f"row.{c}" for c in COLUMNS[1:]]).unionByName(docs.where("doc_id is null").select(COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 50 bytes that a document with a smaller id also holds; documents that are nothing else go.

    A character that loses some of its bytes goes with them, and so do replacement characters of a text with cuts.
    Texts without a cut stay as they are.
    """
    cut = remove_repeated_bytes(docs.select(COLUMNS)).where("n_removed = 0 or n_removed < n_tokens")
    whole = F.col("n_removed") == 0
    left = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", "")
    out = cut.select("row.doc_id", F.when(whole, F.col("kept").cast("string")).otherwise(left).alias("text"), "row.lang", "row.source", "row.n_chars", whole.alias("whole"))
    return out.withColumn("n_chars", F.when(F.col("whole"), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    bad = report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0").select("doc", "hash").distinct()
    key = F.xxhash64("text")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("doc")) & (key == F.col("hash")), "left_anti").select(COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text and decode it again: (doc_id, lang, source, n_chars, n_pieces, ids, text); ``ids`` holds four bytes for each piece."""
    shown = encode(docs.select(COLUMNS), decoded=True)
    return shown.select("row.doc_id", "row.lang", "row.source", "row.n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), "ids", F.col("decoded").alias("text"))


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_copies), ("suffix-array dedup", cut_repeats),
          ("benchmark decontamination", drop_contaminated), ("sentencepiece", tokenise)]
ORACLE_SQL = None  # fingerprints and fitted models have no SQL form; tests hold every stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
