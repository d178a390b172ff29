"""Relational text vectorising: counts, TF-IDF, hashing, token sequences and pooled word vectors.

Texts are spread by document key before they are cut into terms, so that counting the terms of
a document and scaling its vector need no further shuffle of the much larger term rows. A task
gets ``TEXT`` bytes of text, as its terms take some forty times as much memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.functions import text as T
from featlake.functions.numeric import stable_hash
from featlake.functions.vectors import pad_sequence
from featlake.operators.ranks import build_vocab
from featlake.session import settle, spread

TEXT = 4 << 20


def _spread(df: DataFrame, doc: str, text: str) -> DataFrame:
    return spread(df.select(doc, text), [doc], TEXT, F.octet_length(text))


def _terms(text: Column, ngram: tuple[int, int], stopwords: list[str], analyzer: str) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    if analyzer == "char":
        return T.text_char_ngrams(F.regexp_replace(low, T.SPACE, " "), *ngram)
    toks = T.tokenize(low)
    if stopwords:
        toks = F.filter(toks, lambda t: ~t.isin(list(stopwords)))
    return T.word_ngrams(toks, *ngram)


def count_vectors(df: DataFrame, doc: str, text: str, ngram: tuple[int, int] = (1, 1), stopwords: list[str] = (),
                  analyzer: str = "word") -> DataFrame:
    """(doc, term, n) with the term counts of every document."""
    return (_spread(df, doc, text)
            .select(doc, F.explode(_terms(F.col(text), ngram, stopwords, analyzer)).alias("term"))
            .groupBy(doc, "term").agg(F.count(F.lit(1)).alias("n")))


def _bound(limit: float | int, docs: Column) -> Column:
    return F.lit(limit) if isinstance(limit, int) else F.lit(limit) * docs


def doc_freq(terms: DataFrame, min_df: float | int = 1, max_df: float | int = 1.0, n_docs: Column | None = None) -> DataFrame:
    """(term, df, cf): documents and occurrences per term; whole numbers are counts, fractions are shares."""
    docs = n_docs if n_docs is not None else F.lit(0)
    out = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))
    out = out.where(F.col("df") >= _bound(min_df, docs))
    return out if max_df == 1.0 and isinstance(max_df, float) else out.where(F.col("df") <= _bound(max_df, docs))


def tfidf(df: DataFrame, doc: str, text: str, ngram: tuple[int, int] = (1, 1), smooth: bool = False, sublinear: bool = True,
          min_df: float | int = 1, max_df: float | int = 1.0, max_features: int | None = None,
          stopwords: list[str] = (), analyzer: str = "word") -> DataFrame:
    """(doc, term, weight) with (1 + ln n) * idf weights, each document scaled to length 1.

    idf is ln(N / df) + 1, or ln((1 + N) / (1 + df)) + 1 when smoothed. ``max_features`` keeps the
    most frequent terms, ties in text order.
    """
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    terms = count_vectors(df, doc, text, ngram, stopwords, analyzer)
    vocab = doc_freq(terms, min_df, max_df, n_docs)
    if max_features is not None:
        vocab = vocab.orderBy(F.desc("cf"), "term").limit(max_features)
    ratio = (1 + n_docs) / (1 + F.col("df")) if smooth else n_docs / F.col("df")
    vocab = settle(vocab.select("term", (F.log(ratio) + 1).alias("_idf")))
    tf = 1 + F.log("n") if sublinear else F.col("n").cast("double")
    raw = terms.join(vocab, "term").withColumn("_w", tf * F.col("_idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))
    return raw.select(doc, "term", (F.col("_w") / norm).alias("weight"))


def tfidf_fields(df: DataFrame, doc: str, spec: dict[str, dict]) -> DataFrame:
    """Union of one vectoriser per entry; terms carry the entry's name.

    Each entry names its ``text`` column, may ask for plain counts (``kind="count"``), and passes
    the rest to :func:`tfidf` or :func:`count_vectors`.
    """
    out = None
    for name, opts in spec.items():
        opts = dict(opts)
        text, kind = opts.pop("text"), opts.pop("kind", "tfidf")
        if kind == "count":
            part = count_vectors(df, doc, text, **opts).withColumnRenamed("n", "weight").withColumn("weight", F.col("weight").cast("double"))
        else:
            part = tfidf(df, doc, text, **opts)
        part = part.select(doc, F.concat(F.lit(f"{name}__"), "term").alias("term"), "weight")
        out = part if out is None else out.unionByName(part)
    return out


def hash_vectors(df: DataFrame, doc: str, text: str, buckets: int, binary: bool = True, weights: list[float] = (1.0,)) -> DataFrame:
    """(doc, bucket, value): terms hashed into ``buckets`` columns; the i-th weight is for runs of i words.

    Binary vectors hold the largest weight that falls into a bucket, others the sum.
    """
    def weighted(grams, w):
        return F.transform(F.array_distinct(grams) if binary else grams, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))

    toks = T.tokenize(F.lower(F.coalesce(F.col(text), F.lit(""))))
    parts = [weighted(T.word_ngrams(toks, i, i), float(w)) for i, w in enumerate(weights, 1)]
    rows = (_spread(df, doc, text).select(doc, F.explode(F.concat(*parts)).alias("s"))
            .select(doc, F.pmod(stable_hash(F.col("s.term")), F.lit(buckets)).cast("int").alias("bucket"), F.col("s.w").alias("w")))
    return rows.groupBy(doc, "bucket").agg((F.max("w") if binary else F.sum("w")).alias("value"))


def drop_rare(vecs: DataFrame, min_docs: int, column: str = "bucket") -> DataFrame:
    """Keep the columns that are set in more than ``min_docs`` documents.

    The vectors are settled, as they are read twice: to count the columns and to keep their cells.
    """
    vecs = settle(vecs)
    kept = vecs.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_docs).select(column)
    return vecs.join(settle(kept), column, "left_semi")


def tokens_to_ids(df: DataFrame, doc: str, tokens: str, vocab: DataFrame, out: str = "ids") -> DataFrame:
    """Replace each document's token array by ids in order; unknown tokens are left out.

    The ids gathered for one document are at most the tokens of its own row.
    """
    rows = df.select(doc, tokens).repartition(doc)
    hits = (rows.select(doc, F.posexplode(tokens).alias("_pos", "token"))
            .join(vocab.select("token", "id"), "token")
            .groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("_pos", "id"))).alias("_s"))
            .select(doc, F.transform("_s", lambda s: s["id"].cast("int")).alias(out)))
    return rows.select(doc).join(hits, doc, "left").withColumn(
        out, F.coalesce(out, F.array().cast("array<int>")))


def tokens_to_vectors(df: DataFrame, doc: str, tokens: str, vectors: DataFrame) -> DataFrame:
    """(doc, pos, token, vector) for the tokens that have a vector."""
    return (df.select(doc, F.posexplode(tokens).alias("pos", "token")).join(vectors, "token")
            .select(doc, "pos", "token", "vector"))


def token_sequences(df: DataFrame, doc: str, text: str, vocab_size: int, maxlen: int, side: str = "left") -> DataFrame:
    """Padded id sequences over the most frequent words; ids start at 1, 0 is padding."""
    toks = df.select(doc, T.tokenize(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("_t"))
    vocab = settle(build_vocab(toks.select(F.explode("_t").alias("token")), "token", vocab_size))
    ids = tokens_to_ids(toks, doc, "_t", vocab, "sequence")
    return ids.withColumn("sequence", pad_sequence(F.col("sequence"), maxlen, side))


def pool_vectors(df: DataFrame, by: str, vector: str, dim: int, how: str = "sum", out: str = "pooled") -> DataFrame:
    """Sum (scaled to length 1), smallest or largest element of all vectors of a key, combined map-side."""
    fn = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    agg = df.where(F.col(by).isNotNull()).groupBy(by).agg(*[
        fn(F.col(vector)[i].cast("double")).alias(f"_{i}") for i in range(dim)])
    pooled = agg.select(by, F.array(*[F.col(f"_{i}") for i in range(dim)]).alias(out))
    if how != "sum":
        return pooled
    norm = F.sqrt(F.aggregate(F.col(out), F.lit(0.0), lambda a, v: a + v * v))
    return pooled.withColumn("_n", norm).withColumn(
        out, F.transform(out, lambda v: F.coalesce(F.try_divide(v, F.col("_n")), F.lit(0.0)))).drop("_n")
