"""WARC records and a Merkle audit of two replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featlake.session import settle

FILE_BYTES = 8 << 20    # planned length of one file
RANGE_BYTES = 1 << 16   # bytes of a file below one node of the lowest inner level
BRANCH = 16             # children of the levels above


def hashed(value: Column, parts: Column | int) -> Column:
    """Number from 0 to ``parts - 1``, from the first 32 bits of the md5 of a text."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long") % parts


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """(page_id, file, record, length): one WARC resource record for each page; null urls and bodies are empty.

    The number of files follows the length of all records, so a file stays near ``file_bytes``; a page's file comes
    from the md5 of its id (null: of the empty text).
    """
    body, url = F.coalesce(F.col(f"`{body_col}`"), F.lit("")), F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    record = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                      F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))
    made = pages.select(F.col(f"`{id_col}`").alias("page_id"), record.alias("record")).withColumn("length", F.octet_length("record").cast("long"))
    files = max(1, -(-(made.agg(F.sum("length")).first()[0] or 0) // file_bytes))
    return made.withColumn("file", hashed(F.coalesce(F.col("page_id").cast("string"), F.lit("")), files))


def placed(made: DataFrame) -> DataFrame:
    """Records with ``offset``, their first byte in the file: files hold their records by page_id, then by digest."""
    order = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    return made.withColumn("offset", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def leaves(made: DataFrame) -> DataFrame:
    """(file, offset, page_id, digest) of records that are placed already, or of all records in their order."""
    hashed_ = made.withColumn("digest", F.sha2("record", 256))
    keep = hashed_.select("file", "page_id", "length", "digest", *(["offset"] if "offset" in made.columns else []))
    return (keep if "offset" in made.columns else placed(keep)).select("file", "offset", "page_id", "digest")


def _parents(nodes: DataFrame, span: int) -> DataFrame:
    """Nodes over ``span`` units of the level below: the digest of their children's places and digests in order."""
    children = F.array_sort(F.collect_list(F.struct("at", "digest")))
    text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["at"].cast("string"), c["digest"])), ",")
    return nodes.groupBy("side", "file", F.expr(f"at div {span}").alias("at2")).agg(F.sha2(text, 256).alias("digest")).withColumnRenamed("at2", "at")


def _differing(nodes: DataFrame) -> DataFrame:
    """Places where the two sides do not have the same digest."""
    def of(side: int) -> Column:
        return F.max(F.when(F.col("side") == side, F.col("digest")))

    return nodes.groupBy("file", "at").agg(of(0).alias("digest_a"), of(1).alias("digest_b")).where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records in which two replicas differ: (file, offset, page_id, fault, digest_a, digest_b).

    ``a`` and ``b`` are leaves (file, offset, page_id, digest) with one record at an offset. Both get a tree of digests
    over ordered ranges of offsets: a range of ``RANGE_BYTES``, then ``BRANCH`` ranges at a time up to the file. The roots
    are compared first, then only the children of nodes that differ. ``fault`` is changed, missing (only in a) or extra
    (only in b). Equal replicas and empty ones give no rows.
    """
    both = settle(a.select(F.lit(0).alias("side"), "file", F.col("offset").alias("at"), "digest", "page_id")
                  .unionByName(b.select(F.lit(1).alias("side"), "file", F.col("offset").alias("at"), "digest", "page_id")))
    top = both.agg(F.max("at")).first()[0] or 0
    levels, span = [both.drop("page_id")], RANGE_BYTES
    while True:
        levels.append(settle(_parents(levels[-1], span)))
        top, span = top // span, BRANCH
        if top == 0:
            break
    found = _differing(levels.pop())
    while levels:
        span = BRANCH if len(levels) > 1 else RANGE_BYTES
        below = levels.pop()
        suspects = found.select(F.col("file").alias("f"), F.col("at").alias("up"))
        found = _differing(below.join(suspects, (F.col("file") == F.col("f")) & (F.expr(f"at div {span}") == F.col("up")), "left_semi"))
        found = settle(found)
    names = both.groupBy("file", "at").agg(F.max("page_id").alias("page_id"))
    fault = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    return found.join(names, ["file", "at"]).select("file", F.col("at").alias("offset"), "page_id", fault.alias("fault"), "digest_a", "digest_b")
