"""Spelling variants by an index of variable-length grams.

Two words are near if one inserted, deleted or replaced letter turns one into
the other. The near pairs of a vocabulary are found by list merging over grams:

1. **Dictionary.** Grams of ``SHORTEST`` to ``LONGEST`` letters (a word ends with a
   mark) are counted over the vocabulary. A gram with over 1/``FREQUENT`` of all
   gram places is too frequent to select well and is extended by a letter; all
   others are not, so the dictionary is cut back to rare grams and no gram of
   it begins another.
2. **Decomposition.** At every letter of a word starts exactly one gram of the
   dictionary. Which one depends on its own letters only, so one edit affects
   just the grams that lie over it, and the most that lie over one letter of a
   word is that word's bound.
3. **List merging.** Of two near words, at least ``grams - bound`` grams of either
   are shared. Hence the rarest ``bound + 1`` grams of both (in one order of all
   grams: by count, then as strings) have one in common, and only those lists
   are joined. An unaffected gram has all of the word on its left, or all on its
   right, unaffected too: that part and the length, equal or one more, belong to
   the key of a list, which keeps the lists of frequent grams short.
4. **Verification.** Pairs that share enough of *all* their grams are compared by
   edit distance.

The dictionary on the driver holds grams with over 1/``KNOWN`` of all places: at
most ``(LONGEST - SHORTEST + 1) * KNOWN``, at every size of the vocabulary. Runs are
counted with map-side aggregation, so a frequent word is one row a task.

Defined cases: a null text has no words; a null doc_id counts as the text
``null`` in the hash; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.llm.shared import lower_ascii, stage_table

RUN = r"[A-Za-zÀ-ÿ]+"
SHORTEST, LONGEST = 2, 5
FREQUENT, KNOWN = 1 << 13, 1 << 16
END = "\0"
#: A form is so many times as frequent at least, so a chain of forms has at most 27 words.
RATIO = 5
MOST_HOPS = 27


def count_words(documents: DataFrame, every: int = 199, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts; of each run whose hash ``every`` divides, one letter is left out."""
    text = lower_ascii(F.coalesce("text", F.lit("")))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    runs = documents.select(doc.alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    runs = runs.where(F.char_length("run") >= shortest).select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    word = F.when(F.col("h") % every == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))) \
        .otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= shortest).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def dictionary(words: DataFrame) -> tuple[dict[str, int], int]:
    """Counts of the grams that are frequent enough to matter, and the count above which a gram is extended."""
    marked = F.concat("word", F.lit(END))
    grams = words.select(marked.alias("w"), F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("p")).select(
        F.explode(F.array(*[F.substring("w", F.col("p"), F.lit(q)) for q in range(SHORTEST, LONGEST + 1)])).alias("gram"))
    total = words.agg(F.sum(F.char_length("word"))).first()[0] or 0
    # a gram cut short by the end of its word is counted once for every longer size: that alters the order only
    known = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > total // KNOWN)
    return {r.gram: r.n for r in known.toLocalIterator()}, total // FREQUENT


def decompose(word: str, counts: dict[str, int], most: int) -> list[str]:
    """The gram that starts at each letter of a word."""
    word += END
    out = []
    for p in range(len(word) - 1):
        q = p + SHORTEST
        while q < len(word) and q - p < LONGEST and counts.get(word[p:q], 0) > most:
            q += 1
        out.append(word[p:q])
    return out


def affected(grams: list[str]) -> int:
    """The most grams that one edit affects: those over one letter."""
    over = [0] * (len(grams) + LONGEST + 1)
    for p, g in enumerate(grams):
        over[p] += 1
        over[p + len(g)] -= 1
    return int(np.cumsum(over)[:len(grams)].max())


def labelled(grams: list[str]) -> list[str]:
    """Grams with the number of their occurrence, so that shared ones can be counted as sets."""
    seen: dict[str, int] = {}
    out = []
    for g in grams:
        seen[g] = k = seen.get(g, 0) + 1
        out.append(g if k == 1 else f"{g}{END}{k}")
    return out


def index(words: DataFrame) -> DataFrame:
    """Lists of the rarest grams: (part, side, size, word, n, need, grams), a row for each entry and side.

    part: the word from its start to the gram's end (side 0), or from the gram's start to its end (side 1).
    """
    counts, most = dictionary(words)
    shared = words.sparkSession.sparkContext.broadcast((counts, most))

    def run(batches):
        counts, most = shared.value
        for b in batches:
            out = [[] for _ in range(7)]
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                grams = decompose(word, counts, most)
                bound = affected(grams)
                if bound >= len(grams):
                    raise ValueError(f"words need over {LONGEST} letters: {word!r}")
                rare = sorted(range(len(grams)), key=lambda p: (counts.get(grams[p], 0), grams[p], p))[:bound + 1]
                marks = labelled(grams)
                for p in rare:
                    q = len(grams[p])
                    for side, part in ((0, (word + END)[:p + q]), (1, word[p:])):
                        for col, v in zip(out, (f"{q}{part}", side, len(word), word, n, len(grams) - bound, marks)):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    names = ["part", "side", "size", "word", "n", "need", "grams"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())]
    schema = "part string, side int, size int, word string, n long, need int, grams array<string>"
    return words.select("word", "n").mapInArrow(run, schema).select(
        F.xxhash64("part", "side").alias("key"), "size", "word", "n", "need", F.transform("grams", lambda g: F.hash(g)).alias("grams"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words one edit apart, once; a is the shorter, or the lesser of equal length."""
    lists = stage_table(index(words), "spelling-lists")
    a = lists.select("key", F.explode(F.array("size", F.col("size") + 1)).alias("size"), F.col("size").alias("a_size"),
                     *[F.col(c).alias(f"a_{c}") for c in ("word", "n", "need", "grams")])
    b = lists.select("key", "size", *[F.col(c).alias(f"b_{c}") for c in ("word", "n", "need", "grams")])
    enough = F.size(F.array_intersect("a_grams", "b_grams")) >= F.greatest("a_need", "b_need")
    pairs = a.join(b, ["key", "size"]).where((F.col("a_size") < F.col("size")) | (F.col("a_word") < F.col("b_word"))).where(enough).where(
        F.levenshtein("a_word", "b_word", 1) == 1)
    return pairs.groupBy(F.col("a_word").alias("a"), F.col("b_word").alias("b")).agg(F.min("a_n").alias("a_n"), F.min("b_n").alias("b_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of each chain of forms. Every round follows twice as many forms."""
    out = stage_table(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    hops = 1
    while hops < MOST_HOPS:
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = stage_table(out.join(ahead, "root", "left").select(
            "word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "spelling-roots")
        out, hops = moved.select("word", "root"), 2 * hops
        if moved.where("moved").isEmpty():
            break
    return out


def variants(words: DataFrame) -> DataFrame:
    """One row per word of (word, n): word, form, root, n, n_near, form_n."""
    pairs = stage_table(near_pairs(words), "spelling-pairs")
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    takes = -F.col("best.n") >= RATIO * F.col("n")
    own = stage_table(words.join(best, "word", "left").select(
        "word", F.when(takes, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, -F.col("best.n")).alias("form_n")), "spelling-forms")
    last = roots(own.where("form is not null"))
    return own.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(documents: DataFrame, every: int = 199, shortest: int = 6, least: int = 5) -> DataFrame:
    """Spelling variants among the words of ``documents``: one row per word of ``count_words``."""
    return variants(stage_table(count_words(documents, every, shortest, least), "spelling-words"))
