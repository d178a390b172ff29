"""Feature-engineering views over the shared test tables.

Each view is a list of SQL expressions that Spark and the checking engine both read. The Spark
side joins only the tables that the asked-for columns need: the dimension keys are unique and
the joins are left joins, so leaving one out never changes the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# column -> (expression, tables it needs besides lineitem)
ADS_COLUMNS = {
    "item_id": ("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE))", ""),
    "user_id": ("o_custkey", "orders"),
    "region": ("r_name", "region"),
    "city": ("n_name", "nation"),
    "town": ("CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 7 = 1 THEN 'ELSEWHERE' ELSE n_name END", "nation"),
    "parent_category_name": ("p_type", "part"),
    "category_name": ("p_brand", "part"),
    "param_1": ("CASE WHEN p_size % 5 = 0 THEN NULL ELSE l_returnflag END", "part"),
    "param_2": ("o_orderpriority", "orders"),
    "user_type": ("c_mktsegment", "customer"),
    "price": ("CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END", ""),
    "item_seq_number": ("CAST(l_quantity AS INT)", ""),
    "activation_date": ("CAST(o_orderdate AS DATE)", "orders"),
    "image_top_1": ("CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE p_size END", "part"),
    "title": ("p_name", "part"),
    "target": ("round(l_discount * 10, 1)", ""),
    "split": ("CASE WHEN l_linestatus = 'O' THEN 'test' ELSE 'train' END", ""),
}
_NEEDS = {"region": ["orders", "customer", "nation", "region"], "nation": ["orders", "customer", "nation"],
          "customer": ["orders", "customer"], "orders": ["orders"], "part": ["part"], "": []}
_ON = {"orders": "l_orderkey = o_orderkey", "customer": "o_custkey = c_custkey", "nation": "c_nationkey = n_nationkey",
       "region": "n_regionkey = r_regionkey", "part": "l_partkey = p_partkey"}


def hash60(key: str) -> str:
    """SQL text of a 60-bit integer from md5; every engine gives the same number."""
    return f"CAST(conv(substr(md5({key}), 1, 15), 16, 10) AS BIGINT)"


def ads(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Listing-grain view; ``cols`` may include ``fold`` (md5 of item_id, 5 folds)."""
    need = {t for c in cols if c != "fold" for t in _NEEDS[ADS_COLUMNS[c][1]]}
    df = table(spark, sf, "lineitem")
    if "orders" in need:  # the dimensions of an order are joined to it before the much larger lineitem
        side = table(spark, sf, "orders")
        for name in ["customer", "nation", "region"]:
            if name in need:
                side = side.join(table(spark, sf, name), F.expr(_ON[name]), "left")
        df = df.join(side, F.expr(_ON["orders"]), "left")
    if "part" in need:
        df = df.join(table(spark, sf, "part"), F.expr(_ON["part"]), "left")
    plain = [c for c in cols if c != "fold"]
    if "fold" in cols and "item_id" not in plain:
        plain = ["item_id", *plain]
    df = df.selectExpr(*[f"{ADS_COLUMNS[c][0]} AS `{c}`" for c in plain])
    if "fold" in cols:
        df = df.withColumn("fold", F.expr(f"CAST(pmod({hash60('item_id')}, 5) AS INT)"))
    return df.select(*cols)


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS item_id", "o_custkey AS user_id", "CAST(o_orderdate AS DATE) AS activation_date")


def periods(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.expr(_ON["orders"]))
            .selectExpr("l_orderkey AS item_id", "l_linenumber AS line",
                        "CAST(o_orderdate AS DATE) AS date_from",
                        "date_add(CAST(o_orderdate AS DATE), CAST(l_quantity AS INT)) AS date_to",
                        "date_add(CAST(o_orderdate AS DATE), -l_linenumber) AS activation_date",
                        "CAST(l_suppkey % 50 AS INT) AS image_top_1"))


def incomes(spark: SparkSession, sf: str) -> DataFrame:
    """Region-like dimension keyed by town; listings may have no town or one that is not in it."""
    return table(spark, sf, "nation").selectExpr(
        "n_name AS town", "CAST(n_nationkey * 1000 + 500 AS DOUBLE) AS income")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "documents")
            .join(table(spark, sf, "labels"), "doc_id", "left")
            .select("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"))


def preds(spark: SparkSession, sf: str, models: int = 5, *more: str) -> DataFrame:
    """Predictions of several models: the target moved by a fixed hash of (item, model); ``more`` names further listing columns."""
    out = ads(spark, sf, "item_id", "target", "split", "fold", *more)
    for m in range(1, models + 1):
        noise = f"(pmod({hash60(f'concat(item_id, {chr(39)}-m{m}{chr(39)})')}, 1000) / 1000.0D - 0.5D) * 0.{m}D"
        out = out.withColumn(f"model_{m}", F.expr(f"round(target + {noise}, 4)"))
    return out


# ---- the same views as SQL text for the checking engine ----
_Q60 = "(('0x' || substr(md5({k}), 1, 15))::BIGINT)"


def sql_hash60(key: str) -> str:
    return _Q60.format(k=key)


ADS_SQL = ("ads0 AS (SELECT " + ", ".join(f"{e} AS {c}" for c, (e, _) in ADS_COLUMNS.items())
           + " FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey"
             " LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
             " LEFT JOIN part ON l_partkey = p_partkey),"
             f" ads AS (SELECT *, CAST({sql_hash60('item_id')} % 5 AS INT) AS fold FROM ads0)")
ITEMS_SQL = "items AS (SELECT o_orderkey AS item_id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS activation_date FROM orders)"
PERIODS_SQL = ("periods AS (SELECT l_orderkey AS item_id, l_linenumber AS line, CAST(o_orderdate AS DATE) AS date_from,"
               " CAST(o_orderdate AS DATE) + CAST(l_quantity AS INT) AS date_to,"
               " CAST(o_orderdate AS DATE) - CAST(l_linenumber AS INT) AS activation_date,"
               " CAST(l_suppkey % 50 AS INT) AS image_top_1"
               " FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
INCOMES_SQL = ("incomes AS (SELECT n_name AS town, CAST(n_nationkey * 1000 + 500 AS DOUBLE) AS income FROM nation)")
DOCS_SQL = ("docs AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic"
            " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")


def preds_sql(models: int = 5) -> str:
    cols = ", ".join(
        f"round(target + (({sql_hash60(f'item_id || {chr(39)}-m{m}{chr(39)}')} % 1000) / 1000.0::DOUBLE - 0.5::DOUBLE)"
        f" * 0.{m}::DOUBLE, 4) AS model_{m}" for m in range(1, models + 1))
    return f"{ADS_SQL}, preds AS (SELECT item_id, category_name, param_2, price, target, split, fold, {cols} FROM ads)"
