"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

A benchmark item is cut into windows of ``width`` consecutive words (a shorter
item is one window). A window occurs in a document only if *all* of its word
shingles do, so at containment 1 the necessary prefix of a window, with its
shingles ordered by rarity, is its single rarest shingle:

1. Count each benchmark shingle over all documents (rarity).
2. Keep, for every window, the rarest shingle and its offset; a window whose
   rarest shingle never occurs cannot match and goes.
3. Explode document words, join every shingle with those prefix tokens, and
   accept a candidate when the window fits (``0 <= start`` and
   ``start + length <= n``: positional and length bounds) and the words of the
   document at that place equal the window's (exact check). All of it is one
   code-generated stage without a shuffle; the array of words is only
   referenced, not copied per row.
4. Cover: hits of a document are intervals; their union counts the hit words.

The benchmark side is broadcast in blocks of at most ``block_bytes`` measured
bytes; a larger benchmark takes further passes over the documents, so what is
broadcast never grows with the data.

Defined cases: a null or empty text has no words (never contaminated, hash of
the empty string); an item without words has no window; an item whose id is
null still marks words but is not counted; repeated rows each get their result;
rows that share a doc_id but not a text are judged apart; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark.llm.shared import lower_ascii, stage_table

#: A word is a run of anything else.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
BLOCK_BYTES = 16 << 20


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD), "")


def _shingle(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(k)])


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(wid, item, win): every window of every item, once."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    n = F.least(F.size("w"), F.lit(width))
    starts = F.sequence(F.lit(0), F.size("w") - n)
    wins = items.where(F.size("w") > 0).select(
        "item", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, n))).alias("win"))
    return wins.select(F.md5(F.concat_ws(" ", "win")).alias("wid"), "item", "win").distinct()


def _doc_words(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64("text").alias("tkey"), words_of(F.col("text")).alias("w"))


def _block_count(df: DataFrame, block_bytes: int) -> int:
    size = df.agg(F.sum(F.octet_length(F.concat_ws(" ", "win")) + 24 * F.size("win") + 64)).first()[0] or 0
    return max(1, -(-int(size) // block_bytes))


def _rarest(documents: DataFrame, wins: DataFrame, k: int, blocks: int) -> DataFrame:
    """wins plus (key, off): its rarest shingle over all documents; windows that cannot occur are left out."""
    n = F.size("win") - k
    shingles = wins.select("wid", "win", F.explode(F.sequence(F.lit(0), n)).alias("off"))
    shingles = shingles.withColumn("key", _shingle(F.col("win"), F.col("off"), k))
    keys = shingles.select("key").distinct()
    docs = _doc_words(documents).select("w", F.posexplode("w").alias("at", "word"))
    docs = docs.select(_shingle(F.col("w"), F.col("at"), k).alias("key"))
    counts = [docs.join(F.broadcast(keys.where(F.pmod(F.col("key"), F.lit(blocks)) == b)), "key")
              .groupBy("key").agg(F.count(F.lit(1)).alias("freq")) for b in range(blocks)]
    freq = reduce(DataFrame.unionAll, counts)
    best = shingles.join(freq, "key", "left").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "key", "off")).alias("b"), F.first("win").alias("win"))
    return best.where(F.col("b.freq") > 0).select("wid", "win", F.col("b.key").alias("key"), F.col("b.off").alias("off"))


def _hits(documents: DataFrame, prefix: DataFrame, k: int, marks: bool) -> DataFrame:
    """(doc_id, tkey, n_words, start, end, wid): verified occurrences, and one row without wid per document (marks)."""
    right = F.broadcast(prefix)
    # a last, empty word stands for the document itself; its key is null and joins nothing
    docs = _doc_words(documents).withColumn("n_words", F.size("w"))
    rows = docs.select("doc_id", "tkey", "w", "n_words", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("at", "word"))
    rows = rows.withColumn("key", F.when(F.col("at") < F.col("n_words"), _shingle(F.col("w"), F.col("at"), k)))
    start, n = F.col("at") - F.col("off"), F.size("win")
    fits = (start >= 0) & (start + n <= F.col("n_words"))
    same = F.when(fits, F.slice("w", F.greatest(start, F.lit(0)) + 1, n) == F.col("win")).otherwise(F.lit(False))
    out = rows.join(right.withColumnRenamed("key", "pkey"), (F.col("key") == F.col("pkey")) & same,
                    "left" if marks else "inner")
    if marks:
        out = out.where(F.col("wid").isNotNull() | (F.col("at") == F.col("n_words")))
    return out.select("doc_id", "tkey", F.col("n_words").cast("long").alias("n_words"),
                      F.when(F.col("wid").isNotNull(), start).alias("start"),
                      F.when(F.col("wid").isNotNull(), start + n).alias("end"), "wid")


def find_contamination(documents: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20,
                       shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: doc_id, tkey (hash of its text), n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated when at least one word in ``share`` is hit.
    """
    windows = stage_table(benchmark_windows(benchmark, width), "decontam-windows")
    wins = windows.select("wid", "win").distinct()
    ks = sorted(r[0] for r in wins.select(F.least(F.size("win"), F.lit(shingle))).distinct().collect())  # at most `shingle` values
    passes = []
    for k in ks or [shingle]:
        own = wins.where(F.least(F.size("win"), F.lit(shingle)) == k)
        prefix = stage_table(_rarest(documents, own, k, _block_count(own, block_bytes)), "decontam-prefix")
        blocks = _block_count(prefix, block_bytes)
        passes += [(prefix.where(F.pmod(F.col("key"), F.lit(blocks)) == b), k) for b in range(blocks)]
    found = stage_table(reduce(DataFrame.unionAll, [_hits(documents, p, k, i == 0) for i, (p, k) in enumerate(passes)]),
                        "decontam-hits")
    docs = found.where("wid is null").groupBy("doc_id", "tkey").agg(
        F.max("n_words").alias("n_words"), F.count(F.lit(1)).cast("int").alias("copies"))
    hits = found.where("wid is not null")
    spans = hits.groupBy("doc_id", "tkey", "start").agg(F.max("end").alias("end"))
    before = F.expr("max(end) over (partition by doc_id, tkey order by start rows between unbounded preceding and 1 preceding)")
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    cover = spans.withColumn("fresh", fresh).groupBy("doc_id", "tkey").agg(F.sum("fresh").alias("n_hit"))
    items = hits.select("doc_id", "tkey", "wid").distinct().join(windows.select("wid", "item"), "wid") \
        .groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = cover.join(items, cover.doc_id.eqNullSafe(items.doc_id) & (cover.tkey == items.tkey)).select(
        cover.doc_id.alias("h_id"), cover.tkey.alias("h_key"), "n_hit", "items")
    out = docs.join(both, docs.doc_id.eqNullSafe(F.col("h_id")) & (docs.tkey == F.col("h_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "tkey", "n_words", n_hit.alias("n_hit"),
        F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``documents`` (all its columns) without the contaminated rows."""
    bad = find_contamination(documents, benchmark, **options).where("contaminated").select("doc_id", "tkey").distinct()
    # one column holds the document, so that no name of its columns can clash
    rows = documents.select(F.struct(*[documents[f"`{c}`"] for c in documents.columns]).alias("doc"))
    kept = rows.join(bad, F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("doc.text") == F.col("tkey")), "left_anti")
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in documents.columns])
