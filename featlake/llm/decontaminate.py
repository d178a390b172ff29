"""Benchmark passages in documents, found with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from featlake.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK = 1_000_000  # shingle hashes that one broadcast holds at most (16 bytes each)


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, letters, digits and everything beyond ASCII; none for null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BETWEEN), "")


def shingles(df: DataFrame, size: int) -> DataFrame:
    """One row for each run of ``size`` words: ``pos`` from 0 and the hash ``gram``; the other columns stay."""
    n = F.greatest(F.size("words") - (size - 1), F.lit(0))
    runs = F.arrays_zip(*[F.slice("words", i + 1, n).alias(f"w{i}") for i in range(size)])
    return df.select("*", F.posexplode(runs).alias("pos", "run")).withColumn("gram", F.xxhash64(F.lit(size), *[f"run.w{i}" for i in range(size)])).drop("run")


def in_blocks(grams: DataFrame) -> list[DataFrame]:
    """A table of hashes in broadcast parts of bounded size."""
    parts = max(1, -(-grams.count() // BLOCK))
    return [F.broadcast(grams.where(F.pmod("gram", F.lit(parts)) == p)) for p in range(parts)]


def matching(docs: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """Shingles of ``docs`` among ``grams``, one scan for each block of hashes and shingle size."""
    out = None
    for part in in_blocks(grams):
        for size in sizes:
            found = shingles(docs, size).join(part, "gram")
            out = found if out is None else out.unionByName(found)
    return out


def windows_of(items: DataFrame, window: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(item, words, size, start): windows of ``window`` words; a shorter item, unless empty, is one window."""
    cut = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), words_of(F.col(f"`{text_col}`")).alias("all"))
    cut = cut.where(F.size("all") > 0).withColumn("n", F.least(F.size("all"), F.lit(window)))
    return (cut.select("item", F.explode(F.sequence(F.lit(1), F.size("all") - F.col("n") + 1)).alias("at"), "n", "all")
            .select("item", F.slice("all", F.col("at"), F.col("n")).alias("words")).distinct())


def contaminated(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Occurrences of item windows in documents, and the documents with their word counts.

    A window can only occur where all its shingles of ``shingle`` words do, so looking up one of them is enough: the
    one that is rarest in the documents. (1) The shingles of all windows are counted in the documents, pre-aggregated;
    a window with a shingle that never occurs is out. (2) Each window's rarest shingle is its prefix; documents are
    joined on the prefixes only. (3) A match places the window; it must lie within the document (position and length
    bounds). (4) The words there must equal the window's.

    Returns (matches, documents): matches have ``doc``, ``hash`` (of the text), ``start``, ``n`` and ``item`` for every
    occurrence, documents ``doc``, ``hash``, ``n_words``. Null texts and items have no words. Rows that share id and
    text share their matches. An empty table of items gives no match.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"), words_of(F.col(f"`{text_col}`")).alias("words"))
    counted = base.select("doc", "hash", F.size("words").cast("long").alias("n_words"))
    windows = settle(windows_of(items, window, shingle, item_col, item_text))
    distinct = windows.select("words", F.size("words").alias("n")).distinct()
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(shingle))).distinct().collect())  # at most ``shingle`` numbers
    if not sizes:
        none = counted.where(F.lit(False)).select("doc", "hash", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("item"))
        return none, counted
    grams = None
    for size in sizes:
        own = shingles(distinct.where(F.least("n", F.lit(shingle)) == size), size)
        grams = own if grams is None else grams.unionByName(own)
    grams = settle(grams)
    rarity = settle(matching(base.select("words"), grams.select("gram").distinct(), sizes).groupBy("gram").agg(F.count("*").alias("seen")))
    prefix = (grams.join(rarity, "gram", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
              .groupBy("words", "n").agg(F.min(F.struct("seen", "gram", "pos")).alias("rare")).where("rare.seen > 0")
              .select("words", "n", "rare.gram", F.col("rare.pos").alias("offset")))
    prefix = settle(prefix)
    # the words around a match: enough to hold every window that the shingle can stand in
    reach = window - 1
    hit = (matching(base, prefix.select("gram").distinct(), sizes)
           .select("doc", "hash", "gram", "pos", F.least(F.col("pos"), F.lit(reach)).alias("before"),
                   F.slice("words", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(reach)) + window).alias("near")))
    begin = F.col("before") - F.col("offset")
    placed = settle(hit).join(prefix, "gram").where((begin >= 0) & (begin + F.col("n") <= F.size("near")))
    same = placed.where(F.slice("near", begin + 1, F.col("n")) == F.col("words"))
    return same.select("doc", "hash", (F.col("pos") - F.col("offset")).alias("start"), "n", "words").join(windows, "words").select("doc", "hash", "start", "n", "item"), counted


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row for each document: doc, hash, n_words, n_hit (words inside an occurrence), items (sorted ids, as strings)."""
    matches, counted = contaminated(docs, items, **options)
    matches = settle(matches)
    row = Window.partitionBy("doc", "hash")
    spans = (matches.groupBy("doc", "hash", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
             .withColumn("past", F.max("end").over(row.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)))
             .groupBy("doc", "hash").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", F.coalesce("past", "start")), F.lit(0))).cast("long").alias("n_hit")))
    items_of = matches.groupBy("doc", "hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = settle(spans.join(items_of, (spans["doc"].eqNullSafe(items_of["doc"])) & (spans["hash"] == items_of["hash"])).select(spans["doc"].alias("d"), spans["hash"].alias("h"), "n_hit", "items"))
    return (counted.join(found, (F.col("hash") == F.col("h")) & F.col("doc").eqNullSafe(F.col("d")), "left")
            .select("doc", "hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast(T.ArrayType(T.StringType()))).alias("items")))
