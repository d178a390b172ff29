"""Text vectorising queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlake.functions import text as T
from featlake.operators import ranks as R
from featlake.operators import vectorize as Z
from featlake.plans.registry import query, round_doubles
from featlake.plans.text import STOP, q, sql_ngrams, sql_words
from featlake.session import settle
from featlake.sources import views as V

_STOPS = "[" + ", ".join(q(w) for w in STOP) + "]"


def _terms_sql(lo, hi, stop=False, src="documents", key="doc_id", col="text"):
    toks = f"regexp_extract_all(lower({col}), {q(T.WORD)})"
    if stop:
        toks = f"list_filter({toks}, lambda w: NOT list_contains({_STOPS}, w))"
    return (f"tk AS (SELECT {key}, {toks} AS t FROM {src}), tx AS (SELECT {key}, unnest({sql_ngrams('t', lo, hi)}) AS term FROM tk),"
            f" tf AS (SELECT {key}, term, count(*) AS n FROM tx GROUP BY 1, 2)")


def _docs(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", "text")


@query("i1_count_vectors", f"WITH {_terms_sql(1, 2)} SELECT doc_id, term, n FROM tf")
def i1(spark, sf):
    return Z.count_vectors(_docs(spark, sf), "doc_id", "text", (1, 2))


@query("i2_doc_freq", f"""
WITH {_terms_sql(1, 2)} SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS cf FROM tf GROUP BY 1
HAVING count(*) >= 3 AND count(*) <= 0.9 * (SELECT count(*) FROM documents)""")
def i2(spark, sf):
    d = _docs(spark, sf)
    return Z.doc_freq(Z.count_vectors(d, "doc_id", "text", (1, 2)), 3, 0.9, d.agg(F.count(F.lit(1))).scalar())


@query("g2_top_terms", f"""
WITH {_terms_sql(1, 1)} SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS cf FROM tf GROUP BY 1
HAVING count(*) >= 3 ORDER BY cf DESC, term LIMIT 1000""")
def g2(spark, sf):
    df = Z.doc_freq(Z.count_vectors(_docs(spark, sf), "doc_id", "text", (1, 1)), 3)
    return df.orderBy(F.desc("cf"), "term").limit(1000)


def _tfidf_sql(lo, hi, smooth, limit):
    idf = "ln((1 + nd) / (1 + df)) + 1" if smooth else "ln(nd / df) + 1"
    return f"""
WITH {_terms_sql(lo, hi, stop=True)}, nd AS (SELECT count(*)::DOUBLE AS nd FROM documents),
v AS (SELECT term, {idf} AS idf FROM (SELECT term, count(*) AS df, sum(n) AS cf FROM tf GROUP BY 1), nd
      WHERE df >= 3 AND df <= 0.9 * nd ORDER BY cf DESC, term LIMIT {limit}),
w AS (SELECT doc_id, term, (1 + ln(n)) * idf AS w FROM tf JOIN v USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


@query("i3_tfidf", _tfidf_sql(1, 2, False, 5000))
def i3(spark, sf):
    return round_doubles(Z.tfidf(_docs(spark, sf), "doc_id", "text", (1, 2), min_df=3, max_df=0.9, max_features=5000, stopwords=STOP))


@query("i3_tfidf_smooth", _tfidf_sql(1, 1, True, 5000))
def i3_smooth(spark, sf):
    return round_doubles(Z.tfidf(_docs(spark, sf), "doc_id", "text", smooth=True, min_df=3, max_df=0.9, max_features=5000, stopwords=STOP))


_FT = "regexp_extract_all(lower(p_name), " + q(T.WORD) + ")"


def _weigh(name, n_grams, terms):
    return f"""{name}_x AS (SELECT p_partkey, unnest({terms}) AS term FROM part),
{name}_tf AS (SELECT p_partkey, term, count(*) AS n FROM {name}_x GROUP BY 1, 2),
{name}_v AS (SELECT term, ln((SELECT count(*) FROM part) / count(*)) + 1 AS idf FROM {name}_tf GROUP BY 1),
{name}_w AS (SELECT p_partkey, term, (1 + ln(n)) * idf AS w FROM {name}_tf JOIN {name}_v USING (term))"""


_CHARS = "list_concat(list_concat(list_transform(generate_series(1, length(p_name)), lambda i: substr(lower(p_name), CAST(i AS INT), 1))," \
         " list_transform(generate_series(1, length(p_name) - 1), lambda i: substr(lower(p_name), CAST(i AS INT), 2)))," \
         " list_concat(list_transform(generate_series(1, length(p_name) - 2), lambda i: substr(lower(p_name), CAST(i AS INT), 3))," \
         " list_transform(generate_series(1, length(p_name) - 3), lambda i: substr(lower(p_name), CAST(i AS INT), 4))))"


@query("i4_tfidf_fields", f"""
WITH {_weigh('a', 2, sql_ngrams(_FT, 1, 2))}, {_weigh('c', 4, _CHARS)}
SELECT p_partkey, 'title__' || term AS term, round(w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)), 6) AS weight FROM a_w
UNION ALL SELECT p_partkey, 'title_char__' || term, round(w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)), 6) FROM c_w
UNION ALL SELECT p_partkey, 'kind__' || lower(p_type), 1.0::DOUBLE FROM part""")
def i4(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return round_doubles(Z.tfidf_fields(p, "p_partkey", {
        "title": {"text": "p_name", "ngram": (1, 2)},
        "title_char": {"text": "p_name", "ngram": (1, 4), "analyzer": "char"},
        "kind": {"text": "p_type", "kind": "count"}}))


@query("i5_hash_vectors", f"""
WITH {_terms_sql(1, 1)} SELECT DISTINCT doc_id, CAST({V.sql_hash60('term')} % 1024 AS INT) AS bucket, 1.0::DOUBLE AS value FROM tf""")
def i5(spark, sf):
    return Z.hash_vectors(_docs(spark, sf), "doc_id", "text", 1024)


_BAG = f"""t AS (SELECT doc_id, regexp_extract_all(lower(text), {q(T.WORD)}) AS t FROM documents),
x AS (SELECT doc_id, unnest(t) AS term, 1.5 AS w FROM t UNION ALL SELECT doc_id, unnest({sql_ngrams('t', 2, 2)}), 1.0 FROM t),
h AS (SELECT doc_id, CAST({V.sql_hash60('term')} % 536870912 AS INT) AS bucket, max(w) AS value FROM x GROUP BY 1, 2)"""


@query("i5_hash_word_bag", f"WITH {_BAG} SELECT doc_id, bucket, CAST(value AS DOUBLE) AS value FROM h")
def i5_bag(spark, sf):
    return Z.hash_vectors(_docs(spark, sf), "doc_id", "text", 2 ** 29, weights=[1.5, 1.0])


@query("i6_drop_rare", f"""
WITH {_BAG} SELECT doc_id, bucket, CAST(value AS DOUBLE) AS value FROM h
WHERE bucket IN (SELECT bucket FROM h GROUP BY 1 HAVING count(*) > 3)""")
def i6(spark, sf):
    return Z.drop_rare(Z.hash_vectors(_docs(spark, sf), "doc_id", "text", 2 ** 29, weights=[1.5, 1.0]), 3)


@query("i7_token_sequences", f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), {q(T.WORD)}) AS t FROM documents),
x AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM t),
v AS (SELECT tok, row_number() OVER (ORDER BY count(*) DESC, tok) AS id FROM x GROUP BY 1 ORDER BY id LIMIT 2000),
s AS (SELECT doc_id, list(id ORDER BY i) AS l FROM x JOIN v USING (tok) GROUP BY 1),
d AS (SELECT doc_id, coalesce(l, []) AS l FROM documents LEFT JOIN s USING (doc_id))
SELECT doc_id, array_to_string(CASE WHEN len(l) >= 80 THEN l[len(l) - 79:] ELSE list_concat(list_transform(generate_series(1, 80 - len(l)), lambda i: 0), l) END, ' ') AS ids FROM d""")
def i7(spark, sf):
    s = Z.token_sequences(_docs(spark, sf), "doc_id", "text", 2000, 80)
    return s.select("doc_id", F.array_join(F.col("sequence").cast("array<string>"), " ").alias("ids"))


@query("c11_tokens_to_ids", f"""
WITH x AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents)),
v AS (SELECT tok, row_number() OVER (ORDER BY count(*) DESC, tok) AS id FROM x GROUP BY 1)
SELECT d.doc_id, coalesce(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i), '') AS ids FROM documents d LEFT JOIN (x JOIN v USING (tok)) y ON d.doc_id = y.doc_id GROUP BY 1""")
def c11(spark, sf):
    toks = V.table(spark, sf, "documents").select("doc_id", T.words(F.col("text")).alias("toks"))
    vocab = settle(R.build_vocab(toks.select(F.explode("toks").alias("token")), "token"))
    ids = Z.tokens_to_ids(toks, "doc_id", "toks", vocab)
    return ids.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("c11_tokens_to_vectors", f"""
WITH x AS (SELECT doc_id, unnest(w) AS tok FROM (SELECT doc_id, regexp_extract_all(lower(text), {q(T.WORD)}) AS w FROM documents)),
v AS (SELECT tok, row_number() OVER (ORDER BY count(*) DESC, tok) - 1 AS id FROM x GROUP BY 1)
SELECT doc_id, round(sum(embedding[1]::DOUBLE), 4) AS first, round(sum(embedding[64]::DOUBLE), 4) AS last, count(*) AS n
FROM x JOIN v USING (tok) JOIN embeddings ON vec_id = id GROUP BY 1""")
def c11_vectors(spark, sf):
    toks = V.table(spark, sf, "documents").select("doc_id", T.tokenize(F.lower("text")).alias("toks"))
    vocab = R.build_vocab(toks.select(F.explode("toks").alias("token")), "token")
    vectors = (vocab.join(V.table(spark, sf, "embeddings"), F.expr("vec_id = id - 1"))
               .select("token", F.col("embedding").alias("vector")))
    hit = Z.tokens_to_vectors(toks, "doc_id", "toks", settle(vectors))
    at = lambda i: F.round(F.sum(F.col("vector")[i].cast("double")), 4)
    return hit.groupBy("doc_id").agg(at(0).alias("first"), at(63).alias("last"), F.count(F.lit(1)).alias("n"))
