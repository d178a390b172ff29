"""Text and vector function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlake.functions import text as T
from featlake.functions import vectors as VF
from featlake.operators.vectorize import pool_vectors
from featlake.plans.registry import query, r6, round_doubles
from featlake.session import spread
from featlake.sources import views as V

GRAM_BYTES = 16 << 20  # bytes of text that a task cuts into n-grams; more would not fit its memory once counted


def _docs(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", "text")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, {q(T.SPACE)}, ' ', 'g'))"


def sql_words(c: str) -> str:
    return f"list_filter(string_split({sql_squeeze(c)}, ' '), lambda w: w <> '')"


# three short words per language of the test documents play the part of a stop-word list
STOP = ["the", "and", "of", "le", "la", "qui", "der", "und", "die", "el", "de", "que"]
_STOP_SQL = "[" + ", ".join(q(w) for w in STOP) + "]"


@query("x1_clean_text", "SELECT doc_id, " + sql_squeeze(
    r"regexp_replace(replace(regexp_replace(lower(text), '\\u[0-9a-f]+', '', 'g'), '===', ' '), '[^\p{L}]', ' ', 'g')") + " AS clean FROM documents")
def x1(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query("x1_clean_text_as_written", "SELECT doc_id, " + sql_squeeze(
    r"regexp_replace(regexp_replace(replace(regexp_replace(lower(text), '\\u[0-9a-f]+', '', 'g'), '===', ' '), '(\p{Nd}+)', ' \1 ', 'g'), '[^\[:alph]\]', ' ', 'g')")
    + " AS clean FROM documents")
def x1_as_written(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_text(F.col("text"), "as_written", "name").alias("clean"))


def _clean_tokens_sql(pattern):
    return (f"SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(lower(text), {q(pattern)}, ' ', 'g')), ' '),"
            f" lambda w: length(w) > 1 AND NOT list_contains({_STOP_SQL}, w)), ' ') AS clean FROM documents")


@query("x2_clean_tokens", _clean_tokens_sql(T.PUNCT))
def x2(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_tokens(F.col("text"), STOP).alias("clean"))


@query("x2_clean_tokens_ascii", _clean_tokens_sql("[^A-Za-z0-9]+"))
def x2_ascii(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_tokens(F.col("text"), STOP, "ascii").alias("clean"))


@query("x3_strip_digits_punct", f"SELECT doc_id, regexp_replace(regexp_replace(text, {q(T.SPACE)}, ' ', 'g'), '[0-9!-/:-@\\[-`{{-~]', ' ', 'g') AS clean FROM documents")
def x3(spark, sf):
    return _docs(spark, sf).select("doc_id", T.strip_digits_punct(F.col("text")).alias("clean"))


@query("x4_strip_symbols", r"""SELECT doc_id, regexp_replace(text, '["\n\t:+=,.]', ' ', 'g') AS clean FROM documents""")
def x4(spark, sf):
    return _docs(spark, sf).select("doc_id", T.strip_symbols(F.col("text")).alias("clean"))


_RULES = [("thing", " thing "), ("eaux", " eau x "), ("the ", "THE "), (".", " ")]


def _rules_sql(c, rules):
    for a, b in rules:
        c = f"replace({c}, {q(a)}, {q(b)})"
    return c


@query("x5_apply_rules", "SELECT doc_id, " + _rules_sql("lower(text)", T.BRAND_RULES + _RULES) + " AS clean FROM documents")
def x5(spark, sf):
    return _docs(spark, sf).select("doc_id", T.apply_rules(F.lower("text"), T.BRAND_RULES + _RULES).alias("clean"))


_MIX = "replace(replace(replace(text, 'the', 'привет'), 'an', 'ы'), 'le', 'мир')"


@query("x6_split_scripts", f"""
SELECT doc_id, regexp_replace(regexp_replace({_MIX}, '([\\x{{0}}-\\x{{ff}}])([^\\x{{0}}-\\x{{ff}}])', '\\1 \\2', 'g'),
  '([^\\x{{0}}-\\x{{ff}}])([\\x{{0}}-\\x{{ff}}])', '\\1 \\2', 'g') AS clean FROM documents""")
def x6(spark, sf):
    return _docs(spark, sf).select("doc_id", T.split_scripts(F.expr(_MIX)).alias("clean"))


@query("x7_join_text", f"WITH {V.ADS_SQL} SELECT item_id, coalesce(param_1, 'nan') || ' ' || title || ' ' || coalesce(param_2, 'nan') AS text_all FROM ads")
def x7(spark, sf):
    return V.ads(spark, sf, "item_id", "param_1", "title", "param_2").select(
        "item_id", T.join_text([F.col("param_1"), F.col("title"), F.col("param_2")], "nan").alias("text_all"))


@query("x8_text_stats", f"""
WITH w AS (SELECT doc_id, text, {sql_words('text')} AS w FROM documents)
SELECT doc_id, CAST(length(text) AS INT) AS text_num_chars, CAST(len(w) AS INT) AS text_num_words, CAST(len(list_distinct(w)) AS INT) AS text_num_unique_words,
       round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) * 100 END, 6) AS text_words_vs_unique FROM w""")
def x8(spark, sf):
    return round_doubles(_docs(spark, sf).select("doc_id", *T.text_stats(F.col("text"), "text")))


def _n(p):
    return f"CAST(len(regexp_extract_all(text, {q(p)})) AS INT)"


@query("x9_case_stats", f"""
SELECT doc_id, {_n(r'\p{Lu}')} AS text_count_upper, {_n(r'\p{Ll}')} + 1 AS text_count_lower,
       round({_n(r'\p{Lu}')} / ({_n(r'\p{Ll}')} + 1), 6) AS text_count_upper_lower_ratio FROM documents""")
def x9(spark, sf):
    return round_doubles(_docs(spark, sf).select("doc_id", *T.case_stats(F.col("text"), "text")))


@query("x10_char_class_counts", f"""
SELECT doc_id, {_n(T.PUNCT)} AS text_num_punct, {_n(r'\p{N}')} AS text_num_digits, {_n(r'\p{S}')} AS text_num_symbols,
       {_n('!')} AS text_num_exclamation, {_n('[?]')} AS text_num_question, {_n(r'[\[A\-Z\]]')} AS as_written FROM documents""")
def x10(spark, sf):
    return _docs(spark, sf).select("doc_id", *T.char_class_counts(F.col("text"), "text"),
                                   T.count_chars(F.col("text"), T.CLASS_AS_CHARS).alias("as_written"))


@query("x11_stopword_count", f"""
SELECT doc_id, CAST(len(list_filter({sql_words('lower(text)')}, lambda w: list_contains({_STOP_SQL}, w))) AS INT) AS n_stop,
       CAST(len(regexp_extract_all(lower(text), '[aeiou]')) AS INT) AS n_char_stop FROM documents""")
def x11(spark, sf):
    low = F.lower("text")
    return _docs(spark, sf).select("doc_id", T.stopword_count(low, STOP).alias("n_stop"),
                                   T.stopword_count(low, list("aeiou"), "char").alias("n_char_stop"))


@query("x12_text_ratios", f"""
WITH w AS (SELECT doc_id, {sql_words('lower(text)')} AS w, lower(text) AS text, text AS raw FROM documents),
c AS (SELECT doc_id, len(w) AS nw, length(text) AS nc, {_n(T.PUNCT)} AS np, {_n(r'\p{N}')} AS nd, len(list_distinct(w)) AS nu,
  len(list_filter(w, lambda t: list_contains({_STOP_SQL}, t))) AS ns, len(regexp_extract_all(raw, '\\p{{Lu}}')) AS na FROM w)
SELECT doc_id, round(nu / nw, 6) AS text_words_vs_unique, round(nc / nw, 6) AS text_letters_per_word, round(np / nc, 6) AS text_punct_by_letters,
  round(np / nw, 6) AS text_punct_by_words, round(nd / nc, 6) AS text_digits_by_letters, round(na / nc, 6) AS text_alphabets_by_letters,
  round(ns / nw, 6) AS text_stopwords_by_words, round(nw / nc * 10, 6) AS text_mean FROM c""")
def x12(spark, sf):
    return round_doubles(_docs(spark, sf).select("doc_id", *T.text_ratios(F.col("text"), STOP, "text")))


@query("x13_log_length", "SELECT doc_id, round(ln(1 + length(text)), 6) AS log_len FROM documents")
def x13(spark, sf):
    return _docs(spark, sf).select("doc_id", r6(T.log_length(F.col("text"))).alias("log_len"))


@query("x14_tokenize", "SELECT doc_id, " + ", ".join(
    f"array_to_string(regexp_extract_all(text, {q(p)}), '|') AS {n}, CAST(len(regexp_extract_all(text, {q(p)})) AS INT) AS n_{n}"
    for n, p in (("word", T.WORD), ("no_punct", T.WORD_NO_PUNCT), ("word_punct", T.WORD_OR_PUNCT))) + " FROM documents")
def x14(spark, sf):
    kinds = ["word", "no_punct", "word_punct"]
    return _docs(spark, sf).select("doc_id", *[F.array_join(T.tokenize(F.col("text"), k), "|").alias(k) for k in kinds],
                                   *[F.size(T.tokenize(F.col("text"), k)).alias(f"n_{k}") for k in kinds])


@query("x15_char_ngrams", f"""
WITH t AS (SELECT doc_id, unnest({sql_words('text')}) AS tok FROM documents),
g AS (SELECT doc_id, unnest(list_transform(generate_series(1, length(tok) - 2), lambda i: substr(tok, CAST(i AS INT), 3))) AS gram FROM t WHERE length(tok) >= 3)
SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2""")
def x15(spark, sf):
    g = _docs(spark, sf).select("doc_id", F.explode(T.char_ngrams(T.words(F.col("text")), 3)).alias("gram"))
    return g.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n"))


def sql_ngrams(t: str, lo: int, hi: int) -> str:
    def one(n):
        if n == 1:
            return t
        return f"list_transform(generate_series(1, len({t}) - {n - 1}), lambda i: array_to_string({t}[i:i + {n - 1}], ' '))"
    out = one(lo)
    for n in range(lo + 1, hi + 1):
        out = f"list_concat({out}, {one(n)})"
    return out


@query("x16_word_ngrams", f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), {q(T.WORD)}) AS t FROM documents),
g AS (SELECT doc_id, unnest({sql_ngrams('t', 1, 3)}) AS gram FROM t) SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def x16(spark, sf):
    d = spread(_docs(spark, sf), ["doc_id", "text"], GRAM_BYTES, F.octet_length("text"))
    g = d.select(F.explode(T.word_ngrams(T.tokenize(F.lower("text")), 1, 3)).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("x17_field_tokens", f"""
WITH {V.ADS_SQL} SELECT item_id, 'Y' || year(activation_date) || ' WD' || (isodow(activation_date) - 1) || ' UI' || user_id || ' R' || region
  || ' C' || city || ' PO' || coalesce(param_1, 'nan') || ' UXC' || user_id || '_' || city || ' IT' || coalesce(CAST(image_top_1 AS VARCHAR), 'nan') AS line FROM ads""")
def x17(spark, sf):
    a = V.ads(spark, sf, "item_id", "activation_date", "user_id", "region", "city", "param_1", "image_top_1")
    c = F.col
    return a.select("item_id", T.field_tokens([
        ("Y", F.year("activation_date")), ("WD", F.weekday("activation_date")), ("UI", c("user_id")), ("R", c("region")), ("C", c("city")),
        ("PO", c("param_1")), ("UXC", F.concat_ws("_", c("user_id").cast("string"), c("city"))), ("IT", c("image_top_1"))]).alias("line"))


@query("v1_vector_moments", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS l FROM embeddings),
m AS (SELECT vec_id, l, list_sum(l) AS s, list_sum(l) / len(l) AS mu, len(l) AS n FROM e),
c AS (SELECT vec_id, x, s, mu, n FROM (SELECT vec_id, unnest(l) AS x, s, mu, n FROM m)),
k AS (SELECT vec_id, max(mu) AS mu, max(x) AS mx, min(x) AS mn, max(s) AS s, sum((x - mu) ** 2) / max(n) AS m2, sum((x - mu) ** 3) / max(n) AS m3,
  sum((x - mu) ** 4) / max(n) AS m4, -sum(CASE WHEN x > 0 THEN x / s * ln(x / s) ELSE 0 END) AS en FROM c GROUP BY 1)
SELECT vec_id, round(mu, 6) AS v_mean, round(mx, 6) AS v_max, round(mn, 6) AS v_min, round(sqrt(m2), 6) AS v_std, round(s, 6) AS v_sum,
  round(m3 / m2 ** 1.5, 6) AS v_skew, round(m4 / (m2 * m2) - 3, 6) AS v_kurtosis, round(en, 6) AS v_entropy FROM k""")
def v1(spark, sf):
    sq = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    return round_doubles(V.table(spark, sf, "embeddings").select("vec_id", sq.alias("sq")).select(
        "vec_id", *VF.vector_moments(F.col("sq"))))


def _pool_sql(how):
    norm = "/ sqrt(sum(v * v) OVER (PARTITION BY label))" if how == "sum" else ""
    return f"""
WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
p AS (SELECT label, i, {how}(x) AS v FROM e GROUP BY 1, 2)
SELECT label, CAST(i AS INT) AS i, round(v {norm}, 6) AS v FROM p"""


def _pool(how):
    @query(f"v2_pool_vectors_{how}", _pool_sql(how))
    def run(spark, sf):
        p = pool_vectors(V.table(spark, sf, "embeddings"), "label", "embedding", 64, how)
        return round_doubles(p.select("label", F.posexplode("pooled").alias("i", "v")).withColumn("i", F.col("i") + 1))
    return run


for _how in ("sum", "min", "max"):
    _pool(_how)


@query("v3_pad_sequence", f"""
WITH t AS (SELECT doc_id, list_transform({sql_words('text')}, lambda w: CAST(length(w) AS INT)) AS l FROM documents)
SELECT doc_id, array_to_string(CASE WHEN len(l) >= 80 THEN l[len(l) - 79:] ELSE list_concat(list_transform(generate_series(1, 80 - len(l)), lambda i: 0), l) END, ' ') AS ids FROM t""")
def v3(spark, sf):
    ids = F.transform(T.words(F.col("text")), lambda w: F.length(w))
    return _docs(spark, sf).select("doc_id", F.array_join(VF.pad_sequence(ids, 80).cast("array<string>"), " ").alias("ids"))


@query("v4_vector_columns", "SELECT vec_id, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS v_{i}" for i in range(64)) + " FROM embeddings")
def v4(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id", *VF.vector_to_columns(F.col("embedding"), 64))
    back = e.select("vec_id", VF.columns_to_vector([f"v_{i}" for i in range(64)]).alias("v"))
    return round_doubles(back.select("vec_id", *[c.cast("double").alias(f"v_{i}") for i, c in enumerate(
        VF.vector_to_columns(F.col("v"), 64))]))


_ONE_HOT = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("v5_one_hot", f"WITH {V.ADS_SQL} SELECT item_id, " + ", ".join(f"CAST(user_type = '{v}' AS INT) AS is_{v}" for v in _ONE_HOT) + " FROM ads")
def v5(spark, sf):
    return V.ads(spark, sf, "item_id", "user_type").select("item_id", *VF.one_hot(F.col("user_type"), _ONE_HOT, "is_"))
