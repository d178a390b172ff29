import pytest
from pyspark.sql import functions as F

from featlake.functions import text as T
from featlake.functions import vectors as VF
from featlake.operators import vectorize as Z


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,want", [
    ("Привет,  МИР 5шт", "привет мир шт"), ("a===b\\u00abc", "a b"), ("", ""), ("!!! ...", ""), (None, "nan"),
    ("12abc34", "abc"), ("x y z", "x y z"), ("😀 ok", "ok")])
def test_clean_text(spark, text, want):
    assert one(spark, text, T.clean_text) == want


def test_clean_text_variants(spark):
    assert one(spark, None, lambda c: T.clean_text(c, null="name")) == "name error"
    assert one(spark, "ab12c, d]", lambda c: T.clean_text(c, "as_written")) == "ab 12 c,"
    assert one(spark, "The cat, a DOG!", lambda c: T.clean_tokens(c, ["the"])) == "cat dog"
    assert one(spark, "кот cat 2x", lambda c: T.clean_tokens(c, alphabet="ascii")) == "cat 2x"
    assert one(spark, 'a"b:c', T.strip_symbols) == "a b c"
    assert one(spark, "asusintel 00asus gtx1080 seilmann", T.apply_rules).split() == "asus intel asus gtx 1080 steilmann".split()


@pytest.mark.parametrize("text,want", [("iphoneчехол", "iphone чехол"), ("чехолiphone6s", "чехол iphone6s"), ("aбaб", "a б a б"),
                                       ("only latin", "only latin"), ("", "")])
def test_split_scripts(spark, text, want):
    assert one(spark, text, T.split_scripts) == want


def test_counts(spark):
    df = spark.createDataFrame([("Aa bB a! 1?",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(*T.text_stats(F.col("t"), "t")).collect()]
    assert got == [(11, 4, 4, 100.0), (0, 0, 0, None), (0, 0, 0, None)]
    r = df.select(*T.case_stats(F.col("t"), "t"), *T.char_class_counts(F.col("t"), "t")).first()
    assert (r.t_count_upper, r.t_count_lower, r.t_num_punct, r.t_num_digits, r.t_num_exclamation, r.t_num_question) == (2, 4, 2, 1, 1, 1)
    assert one(spark, "[A-Z]x", lambda c: T.count_chars(c, T.CLASS_AS_CHARS)) == 5
    assert one(spark, "the cat on the mat", lambda c: T.stopword_count(c, ["the", "on"])) == 3
    ratios = spark.createDataFrame([("the cat",), ("",)], "t string").select(*T.text_ratios(F.col("t"), ["the"], "t")).collect()
    assert ratios[0].t_letters_per_word == 3.5 and ratios[0].t_stopwords_by_words == 0.5
    assert ratios[1].t_letters_per_word is None and ratios[1].t_mean == 0.0


def test_tokens_and_ngrams(spark):
    assert one(spark, "Ёлка_1, don't", T.tokenize) == ["Ёлка_1", "don", "t"]
    assert one(spark, "a_b!", lambda c: T.tokenize(c, "no_punct")) == ["a", "b"]
    assert one(spark, "a, b!!", lambda c: T.tokenize(c, "word_punct")) == ["a", ",", "b", "!!"]
    assert one(spark, "ab abcd x😀yz", lambda c: T.char_ngrams(T.words(c), 3)) == ["abc", "bcd", "x😀y", "😀yz"]
    assert one(spark, "a b c", lambda c: T.word_ngrams(T.words(c), 1, 2)) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, "a", lambda c: T.word_ngrams(T.words(c), 2, 3)) == []
    assert one(spark, "ab", lambda c: T.text_char_ngrams(c, 1, 3)) == ["a", "b", "ab"]


@pytest.mark.parametrize("n,want", [(2, [0, 0, 0, 1, 2]), (5, [1, 2, 3, 4, 5]), (7, [3, 4, 5, 6, 7]), (0, [0] * 5)])
def test_pad_sequence(spark, n, want):
    df = spark.createDataFrame([(list(range(1, n + 1)),)], "a array<int>")
    assert df.select(VF.pad_sequence(F.col("a"), 5).alias("r")).first()["r"] == want


def test_vector_moments(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 6.0],), ([2.0, 2.0],), ([-1.0, 1.0],), ([],)], "a array<double>")
    a, b, c, d = df.select(*VF.vector_moments(F.col("a"))).collect()
    assert (a.v_mean, a.v_max, a.v_min, a.v_sum) == (3.0, 6.0, 1.0, 12.0) and a.v_std == pytest.approx(3.5 ** 0.5)
    assert a.v_skew == pytest.approx(4.5 / 3.5 ** 1.5) and a.v_kurtosis == pytest.approx(24.5 / 3.5 ** 2 - 3)
    assert b.v_skew is None and b.v_entropy == pytest.approx(0.6931471805599453) and c.v_entropy is None
    assert d.v_mean is None and d.v_sum == 0.0 and d.v_max is None


def test_tfidf_is_unit_length_and_respects_cuts(spark):
    df = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, "blue"), (4, None)], "d int, t string")
    w = Z.tfidf(df, "d", "t")
    for r in w.groupBy("d").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect():
        assert r.s == pytest.approx(1.0)
    assert {r.term for r in Z.tfidf(df, "d", "t", min_df=2).select("term").distinct().collect()} == {"blue"}
    assert {r.term for r in Z.tfidf(df, "d", "t", max_df=0.5).select("term").distinct().collect()} == {"red", "green"}
    assert {r.term for r in Z.tfidf(df, "d", "t", max_features=1).select("term").distinct().collect()} == {"blue"}


def test_sequences_keep_documents_without_known_words(spark, rows):
    df = spark.createDataFrame([(1, "b a b"), (2, "zzz"), (3, None)], "d int, t string")
    assert rows(Z.token_sequences(df, "d", "t", 1, 3)) == [(1, [0, 1, 1]), (2, [0, 0, 0]), (3, [0, 0, 0])]


def test_hashing_is_stable_and_drops_rare(spark):
    df = spark.createDataFrame([(1, "x y"), (2, "x"), (3, "x z")], "d int, t string")
    v = Z.hash_vectors(df, "d", "t", 1 << 20, weights=[1.5, 1.0])
    assert sorted(r.value for r in v.where("d = 1").collect()) == [1.0, 1.5, 1.5]
    kept = Z.drop_rare(v, 1)
    assert kept.count() == 3 and kept.select("bucket").distinct().count() == 1


def test_pooling(spark, rows):
    df = spark.createDataFrame([("a", [3.0, 0.0]), ("a", [0.0, 4.0]), ("b", [0.0, 0.0])], "k string, v array<float>")
    assert rows(Z.pool_vectors(df, "k", "v", 2)) == [("a", [0.6, 0.8]), ("b", [0.0, 0.0])]
    assert rows(Z.pool_vectors(df, "k", "v", 2, "min")) == [("a", [0.0, 0.0]), ("b", [0.0, 0.0])]


def test_terms_of_a_task_do_not_grow_with_the_table(spark, monkeypatch):
    """The number of partitions follows the text, so the terms of a task stay the same when there are more documents."""
    monkeypatch.setattr(Z, "TEXT", 500)
    small, large = (spark.createDataFrame([(i, f"some words of text {i} " * 5) for i in range(n)], "d long, t string") for n in (40, 400))
    parts = lambda df: df.select("d").rdd.getNumPartitions()
    for vectors in (lambda df: Z.count_vectors(df, "d", "t", (1, 2)), lambda df: Z.hash_vectors(df, "d", "t", 1 << 20)):
        assert parts(vectors(large)) > 8 * parts(vectors(small)) > 8


def test_ngrams_are_cut_in_small_tasks(spark, tmp_path, monkeypatch):
    """A task gets a bounded part of the text, also where ids repeat or are null."""
    from collections import Counter

    from featlake.plans import QUERIES
    from featlake.plans import text as P

    texts = [f"a b c{i % 9} d" for i in range(600)] + [None, ""]
    spark.createDataFrame([(None if i % 2 else i % 5, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(P, "GRAM_BYTES", 200)
    out = QUERIES["x16_word_ngrams"](spark, str(tmp_path))
    words = [(t or "").split() for t in texts]
    assert {r.gram: r.n for r in out.collect()} == Counter(" ".join(w[i:i + n]) for w in words for n in (1, 2, 3) for i in range(len(w) - n + 1))
    assert f"{-(-sum(len(t or '') for t in texts) // 200)}), REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()
