"""Registered queries of the training-data operators: name -> plan builder, and DuckDB SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
import public_tokenizers

from wattspark.llm import decontaminate, langid, mixing, neighbours, packing, prefix_trie, quality, sharding, simhash, spelling, suffixes, word_windows, wordpiece
from wattspark.llm.shared import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.fit(docs), carry=["doc_id"])
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tkey")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).withColumn("rate", F.round("rate", 9))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.drop_repeats(table(spark, sf_dir, "documents"), length=400)


def op8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_windows.drop_repeats(table(spark, sf_dir, "documents"), width=35)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40, carry=["doc_id"])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=4096, end=2)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"), every=199, shortest=6, least=5)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_neighbours": op2_neighbours,
    "op3_decontaminate": op3_decontaminate,
    "op4_mixing": op4_mixing,
    "op5_tokens": op5_tokens,
    "op6_simhash": op6_simhash,
    "op7_suffixes": op7_suffixes,
    "op8_windows": op8_windows,
    "op9_sharding": op9_sharding,
    "op10_quality": op10_quality,
    "op11_packing": op11_packing,
    "op12_spelling": op12_spelling,
    "op13_trie": op13_trie,
}

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE_SQL: dict[str, str] = {
    "op7_suffixes": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, s, hash(substr(h, 2 * s + 1, 800)) AS k
      FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 399, 0))) AS s FROM d)),
r AS (SELECT doc_id, s FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
e AS (SELECT doc_id, s, max(s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 400 AS before FROM r),
g AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM e),
x AS (SELECT doc_id, span, min(s) AS a, max(s) + 400 AS b FROM g GROUP BY doc_id, span),
c AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail FROM x GROUP BY doc_id),
k AS (SELECT x.doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept
      FROM (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM x) x JOIN d USING (doc_id) GROUP BY x.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN c.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
""",
    "op8_windows": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + 35], ' ')) AS k
      FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 34, 0))) AS s FROM d)),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM a ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
    "op4_mixing": """
WITH s AS (SELECT source, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS units FROM documents GROUP BY source),
w AS (SELECT source, units, CAST(floor(sqrt(units) * 1000) AS BIGINT) AS weight FROM s),
r AS (SELECT source, CAST(weight AS DOUBLE) * CAST((SELECT sum(units) FROM w) AS DOUBLE)
             / (CAST((SELECT sum(weight) FROM w) AS DOUBLE) * CAST(units AS DOUBLE)) AS rate FROM w),
k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT))) AS k FROM r),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT doc_id, source, text,
             CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
      FROM documents),
n AS (SELECT doc_id, source, text, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u) AS copies FROM u),
e AS (SELECT doc_id, source, text, copies, unnest(range(1, copies + 1)) AS copy FROM n)
SELECT e.doc_id, e.source, e.text, copy, copies, round(rate, 9) AS rate,
       md5('mix-1-order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(e.text, '')) || ':' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM e JOIN r ON e.source IS NOT DISTINCT FROM r.source
""",
    "op3_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 13) AS l FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[s + 1 : s + l], ' ') AS win
       FROM (SELECT item_id, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM b)),
dw AS (SELECT doc_id, l, s, array_to_string(w[s + 1 : s + l], ' ') AS win
       FROM (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS s
             FROM d CROSS JOIN (SELECT DISTINCT l FROM b) WHERE len(w) >= l)),
hits AS (SELECT doc_id, item_id, s, dw.l AS l FROM dw JOIN bw ON dw.win = bw.win AND dw.l = bw.l),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hits) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
