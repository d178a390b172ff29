"""URL filters: host and path rules, else a ratio of two character language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import shuffle_partitions
from featlake.llm.decontaminate import LOWER, UPPER
from featlake.session import settle

#: (verdict, host, path): a rule fits the host and its subdomains where the path begins like its own.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ORDER = 5           # characters of the longest context
ALPHABET = 1 << 16  # size of the uniform model below order 0
START, END = "\x02", "\x03"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list) -> tuple[Column, Column]:
    """Longest fitting rule as text, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def log_ratios(grams: DataFrame, order: int) -> DataFrame:
    """(gram, ratio): log of the accepted over the rejected model's probability of a gram's last character.

    ``grams`` has each distinct gram of ``order + 1`` characters once, with its counts ``a`` and ``r`` in accepted and
    rejected URLs (0: not seen there). Models of order 0 to ``order`` are mixed as Witten and Bell do: a context with n
    characters counted, t of them different, gives the next lower order the weight t / (n + t); a context that was
    not seen leaves it all to the lower order, so the order varies with what is known.
    """
    last = F.substring("gram", order + 1, 1)
    lower = None
    for n in range(order + 1):
        rows = grams.groupBy(F.substring("gram", order + 1 - n, n).alias("context"), last.alias("char")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        sums = rows.groupBy("context").agg(*[f for c in ("a", "r") for f in (F.sum(c).alias(f"n_{c}"), F.sum((F.col(c) > 0).cast("long")).alias(f"t_{c}"))])
        rows = settle(rows).join(settle(sums), "context")
        if lower is None:
            rows = rows.withColumns({"low_a": F.lit(1.0 / ALPHABET), "low_r": F.lit(1.0 / ALPHABET)})
        else:
            rows = rows.withColumn("short", F.substring("context", 2, n)).join(lower, ["short", "char"])
        mixed = {f"p_{c}": F.when(F.col(f"n_{c}") == 0, F.col(f"low_{c}"))
                 .otherwise((F.col(c) + F.col(f"t_{c}") * F.col(f"low_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))) for c in ("a", "r")}
        known = settle(rows.select("context", "char", *[v.alias(k) for k, v in mixed.items()]))
        lower = known.select(F.col("context").alias("short"), "char", F.col("p_a").alias("low_a"), F.col("p_r").alias("low_r"))
    return known.select(F.concat("context", "char").alias("gram"), (F.log("p_a") - F.log("p_r")).alias("ratio"))


def scores(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(url, kind, held, score) of distinct URLs with ``kind`` (allow, block, or null: unknown) and ``held`` (not to be counted)."""
    text = F.concat(F.lit(START * order), F.translate("url", UPPER, LOWER), F.lit(END))
    pieces = F.transform(F.sequence(F.lit(1), F.char_length("text") - order), lambda i: F.substring(F.col("text"), i, F.lit(order + 1)))
    grams = settle(urls.withColumn("text", text).select("url", "kind", "held", F.explode(pieces).alias("gram"))
                   .groupBy("url", "kind", "held", "gram").agg(F.count("*").alias("times")))
    counted = F.when(F.col("held"), 0).otherwise(F.col("times"))
    table = settle(grams.groupBy("gram").agg(F.sum(F.when(F.col("kind") == "allow", counted).otherwise(0)).alias("a"),
                                             F.sum(F.when(F.col("kind") == "block", counted).otherwise(0)).alias("r")))
    ratios = settle(log_ratios(table, order))
    return grams.join(ratios, "gram").groupBy("url", "kind", "held").agg((F.sum(F.col("times") * F.col("ratio")) / F.sum("times")).alias("score"))


def cut_point(scored: DataFrame) -> float:
    """Score between the held-out URLs of both kinds, nearer to the kind that spreads less; 0 if a kind has none."""
    got = {r["kind"]: r for r in scored.where("held").groupBy("kind").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd")).collect()}
    if len(got) < 2:
        return 0.0
    a, b = got["allow"], got["block"]
    return (a["mean"] * (b["sd"] + 1e-6) + b["mean"] * (a["sd"] + 1e-6)) / (a["sd"] + b["sd"] + 2e-6)


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list = RULES, order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    URLs that a rule decides are what the models learn from: accepted and rejected ones. Each distinct URL counts once,
    however often it occurs; a fifth of them (by hash) is not counted and sets the cut on the length-normalised log
    likelihood ratio. Other URLs are allowed from the cut on. All counts cover all URLs and stay in tables.

    A null url, or one without ``://``, has empty host and path and no rule; a null url scores 0. Repeated rows each
    get a row; without URLs of a kind the cut is 0; an empty table gives none.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "kind": verdict})
    urls = rows.where("url is not null").select("url", "kind").distinct().repartition(shuffle_partitions(pages.sparkSession), "url")  # each row becomes many
    held = F.col("kind").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(5)) == 0)
    scored = settle(scores(urls.withColumn("held", held), order))
    cut = cut_point(scored)
    known = scored.select(F.col("url").alias("u"), "score")
    out = rows.join(known, F.col("url") == F.col("u"), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.select("page_id", "host", "path", "rule", F.coalesce("kind", F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"), "score")
