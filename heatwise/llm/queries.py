"""Registered queries of the numbered operators over the whole given tables."""
from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession, functions as F

from heatwise.llm import (annlink, chat, collocations, neardup, packing, pii, piece, quality, secrets, toxicity,
                          urlfilter, warc, whiten)
from heatwise.llm.scratch import Scratch
from heatwise.llm.ship import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed values of the URL contract.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url_rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join(str(r) for r in URL_RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, verdict)")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), url_rules(spark), keep=("page_id",))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_table(spark, sf_dir, "conversations"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = Scratch(spark, "quality").keep(quality.with_measures(docs).drop("text"), "measures")
    return quality.with_verdict(measured, quality.fit(measured)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "quality")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = piece.encode(docs, model).drop("text")
    return piece.decode(encoded, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def warc_rows(read: DataFrame) -> DataFrame:
    """Page columns of the records that were read back."""
    def page(name: str):
        number = F.substring_index(name, ":", -1)
        return F.when(number != "null", number.cast("long"))
    return read.where("kind = 'record'").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_rows(warc.round_trip(_table(spark, sf_dir, "pages"), Scratch(spark, "warc")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annlink.link_vectors(_table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.fit(docs, _table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a sum of squares past 64 bits has no long; the operator's decimal keeps it
    rows = whiten.whiten(_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_chat_format": op2_chat_format,
    "op3_secret_scan": op3_secret_scan,
    "op4_minhash_neardup": op4_minhash_neardup,
    "op5_quality_rules": op5_quality_rules,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_embedding_neardup": op9_embedding_neardup,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_whitening": op12_whitening,
    "op13_pii": op13_pii,
}

ORACLES = {
    "op1_url_filter": r"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
             FROM pages),
parts AS (SELECT page_id,
                 coalesce(translate(regexp_extract(rest, '^[^/?#]*'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
""",
    "op2_chat_format": r"""
WITH logged AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                       md5(coalesce(role, '') || chr(31) || coalesce(text, '')) AS cid FROM conversations),
placed AS (SELECT *, row_number() OVER w AS position, string_agg(cid, '') OVER w AS prefix,
                  count(*) OVER (PARTITION BY conv_id) AS n_turns
           FROM logged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, cid
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
stay AS (SELECT prefix, min(conv_id) AS conv_id FROM placed WHERE position = n_turns
           AND prefix NOT IN (SELECT prefix FROM placed WHERE position < n_turns) GROUP BY prefix)
SELECT p.conv_id, p.turn, p.position, p.n_turns, p.role,
       '<|im_start|>' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10) AS rendered
FROM placed p JOIN stay s ON p.conv_id = s.conv_id
""",
    "op7_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
           FROM pages)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(sha1(payload), 5 * (j // 4) + 1, 5))::BIGINT >> (15 - 5 * (j % 4))) & 31) + 1)::INT, 1)), '')
           AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
""",
    "op9_embedding_neardup": r"""
WITH RECURSIVE ok AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings
                     UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, min(r) AS component_id,
       min(r) = vec_id AS kept
FROM reach GROUP BY vec_id
""",
    "op11_collocations": r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT unnest([1, 2, 3, 4, 5]) AS m),
f AS (SELECT lang, phrase, m, count(*) AS f FROM (
          SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
          FROM words, sizes WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cuts AS (SELECT p.lang, p.phrase, p.m, p.f AS a, t.n, k, x.phrase AS lp, y.phrase AS rp, x.f AS l, y.f AS r,
                ((1000::HUGEINT * p.f * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
         FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1) p JOIN totals t USING (lang)
         JOIN f x ON x.lang = p.lang AND x.phrase = array_to_string(p.w[1:k], ' ')
         JOIN f y ON y.lang = p.lang AND y.phrase = array_to_string(p.w[k + 1:p.m], ' ')),
inside AS (SELECT lang, lp AS phrase FROM cuts WHERE k = m - 1 AND 100 * a >= 100 * l
           UNION SELECT lang, rp FROM cuts WHERE k = 1 AND 100 * a >= 100 * r),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best ANTI JOIN inside USING (lang, phrase) QUALIFY rank <= 2000
""",
}
