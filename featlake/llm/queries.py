"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlake.llm import decontaminate, embeddings, maxent, simhash, spelling, urls, warc, whitening
from featlake.llm.common import table
from featlake.llm.pieces import BLANK, encode
from featlake.llm.quality import quality
from featlake.llm.substring import remove_repeated_words
from featlake.llm.suffixes import remove_repeated_bytes
from featlake.llm.toxicity import CHAIN, toxicity
from featlake.session import scratch_path

LLM_QUERIES = {}
LLM_ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLES[name] = sql
        return fn

    return add


@query("op3_substring_dedup")
def op3_substring_dedup(spark, sf_dir):
    cut = remove_repeated_words(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return cut.select("row.doc_id", F.col("n_tokens").alias("n_words"), "n_removed", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark, sf_dir):
    cut = remove_repeated_bytes(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return cut.select("row.doc_id", F.col("n_tokens").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '{WORD}') AS w FROM documents),
     i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '{WORD}') AS w FROM benchmark),
     win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, w[s:s + least(10, len(w)) - 1] AS k
             FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(s) WHERE len(w) > 0),
     spot AS (SELECT doc_id, n, s, w[s:s + n - 1] AS k FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(s)),
     hit AS (SELECT DISTINCT doc_id, s, win.n, item_id FROM spot JOIN win USING (k)),
     words AS (SELECT doc_id, count(DISTINCT s + o) AS n_hit FROM hit, unnest(range(0, n)) AS t(o) GROUP BY doc_id),
     items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op1_decontaminate", OP1)
def op1_decontaminate(spark, sf_dir):
    rows = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op2_simhash")
def op2_simhash(spark, sf_dir):
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("row.doc_id", *[f"p_{c}" for c in CHAIN], "toxic")


@query("op5_quality")
def op5_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP6 = f"""
WITH made AS (SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
                     || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
                     || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
     files AS (SELECT greatest(1, ceil(sum(strlen(record)) / {warc.FILE_BYTES}))::BIGINT AS n FROM made),
     leaf AS (SELECT page_id, record, strlen(record) AS length, sha256(record) AS digest,
                     ('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 1, 8))::BIGINT % (SELECT n FROM files) AS file,
                     ('0x' || substr(md5('damage' || page_id::VARCHAR), 1, 8))::BIGINT % 200 AS k FROM made),
     placed AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM leaf)
SELECT file, "offset", page_id, CASE k WHEN 0 THEN 'changed' ELSE 'missing' END AS fault, digest AS digest_a,
       CASE k WHEN 0 THEN sha256('X' || substr(record, 2)) END AS digest_b
FROM placed WHERE k IN (0, 1)"""


@query("op6_warc_fixity", OP6)
def op6_warc_fixity(spark, sf_dir):
    """A replica written to the shared folder, of which some records are damaged and some lost, against the source."""
    made = warc.records(table(spark, sf_dir, "pages"))
    k = warc.hashed(F.concat(F.lit("damage"), F.col("page_id").cast("string")), 200)
    stored = warc.placed(made.withColumn("digest", F.sha2("record", 256))).drop("digest")
    damaged = F.when(k == 0, F.concat(F.lit("X"), F.expr("substring(record, 2)"))).otherwise(F.col("record"))
    path = scratch_path(spark, "replica")
    stored.where(F.coalesce(k, F.lit(-1)) != 1).withColumn("record", damaged).write.parquet(path)
    return warc.audit(warc.leaves(made), warc.leaves(spark.read.parquet(path)))


@query("op9_url_filter")
def op9_url_filter(spark, sf_dir):
    return urls.judged(table(spark, sf_dir, "pages"))


@query("op7_sentencepiece")
def op7_sentencepiece(spark, sf_dir):
    shown = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    plain = F.replace("text", F.lit(BLANK), F.lit(" "))  # the model writes both as a space
    return shown.select("row.doc_id", F.char_length("text").cast("long").alias("n_chars"), (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.col("decoded").eqNullSafe(plain).alias("round_trip"))


@query("op8_embedding_dedup")
def op8_embedding_dedup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP13 = f"""
WITH RECURSIVE
     run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents),
     seen AS (SELECT doc_id, r, count(*) AS n FROM run WHERE length(r) >= {spelling.SHORTEST} GROUP BY ALL),
     poly AS (SELECT 3988292384::BIGINT AS p),
     crc AS (SELECT k::BIGINT AS k, list_reduce([k::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, p) ELSE c >> 1 END) AS v FROM range(256) t(k), poly),
     tab AS (SELECT list(v ORDER BY k) AS t FROM crc),
     bytes AS (SELECT doc_id, r, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || r, ''),
                      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM seen),
     summed AS (SELECT r, n, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h FROM bytes, tab),
     word AS (SELECT CASE WHEN h % {spelling.DROP} = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, n FROM summed),
     vocab AS (SELECT word, sum(n)::BIGINT AS n FROM word WHERE length(word) >= {spelling.SHORTEST} GROUP BY 1 HAVING sum(n) >= {spelling.FEWEST}),
     cut AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM vocab, unnest(range(1, length(word) + 1)) AS t(i)),
     near AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
              UNION SELECT c.word, v.word, v.n FROM cut c JOIN vocab v ON v.word = c.rest
              UNION SELECT v.word, c.word, c.n FROM cut c JOIN vocab v ON v.word = c.rest),
     best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY 1),
     form AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= 2 * v.n THEN b.m END AS form_n,
                     CASE WHEN b.m >= 2 * v.n THEN (SELECT min(other) FROM near x WHERE x.word = v.word AND x.m = b.m) END AS form FROM vocab v LEFT JOIN best b USING (word)),
     walk AS (SELECT word, word AS tip, 0 AS step FROM form UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN form f ON f.word = w.tip WHERE f.form IS NOT NULL),
     last AS (SELECT word, arg_max(tip, step) AS root FROM walk GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM form JOIN last USING (word)"""


@query("op13_spelling_variants", OP13)
def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op11_maxent_score")
def op11_maxent_score(spark, sf_dir):
    return maxent.score(table(spark, sf_dir, "documents"))


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
