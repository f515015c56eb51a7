"""Spelling variants of frequent words by a permuterm index.

A word w of L letters, closed by a terminator $, has the rotations w[i+1:] $ w[:i] w[i]. Those that skip the last letter are
prefixes that all words share which differ from w in letter i alone; a word without that letter has the prefix as a whole
rotation. So all rotations are sorted over the cluster by range, each group of one prefix lies in one partition, and one scan
of a group gives each member its number of near words in it and the greatest of them: one row per member, not per pair. A
group holds at most one word per letter and one whole rotation, whatever the table. In a run of equal letters (``ll``) only
the first counts as left out, so that a pair meets once.

A word's form is the near word of largest n, if that is at least ``ratio`` times the word's n. As n grows by the ratio at
each step, following forms ends within log(n) steps; the chains are doubled, so a few joins do.

Prefixes of more than ``LONG`` code points are kept as SHA-256, which bounds the index for very long words.

Defined cases: a null or empty text has no words; a null doc_id stands as an empty string before the colon; repeated rows
count each; ties in n go to the word that is smaller by code points; very long texts and words are taken whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in this many loses a letter, by the checksum of its document and itself.
EVERY = 199
LONG = 64
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frequent_words(docs: DataFrame, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of at least ``letters`` code points that stand at ``count`` places or more."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.translate(F.col("text").cast("string"), *_LOWER).alias("text"))
    runs = texts.select("doc", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= letters)
    h = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = h.select(F.when(F.col("h") % EVERY == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, whole, first, word, n): skipping rotations of each word, and its whole ones; first: not within a run of equal letters."""
    size = F.length("word")
    after = F.expr("substring(word, i + 2, length(word))")
    before = F.expr("substring(word, 1, i)")
    fold = lambda key: F.when(F.length(key) > LONG, F.sha2(key, 256)).otherwise(key)
    skipping = words.select("word", "n", F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    first = F.expr("i = 0 OR substring(word, i, 1) <> substring(word, i + 1, 1)")
    skipping = skipping.select(fold(F.concat(after, F.lit("$"), before)).alias("key"), F.lit(False).alias("whole"), first.alias("first"), "word", "n")
    whole = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    whole = whole.select(fold(F.concat(F.expr("substring(word, i + 1, length(word))"), F.lit("$"), before)).alias("key"), F.lit(True).alias("whole"), F.lit(True).alias("first"), "word", "n")
    return skipping.union(whole)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are near, and the greatest of them as (-n, word)."""
    place = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    rows = rotations(words).withColumn("place", place)
    rows = rows.repartitionByRange("key").sortWithinPartitions("key", "place")
    group = Window.partitionBy("key")
    skips, turns = ~F.col("whole"), F.col("whole")
    ranked = rows.withColumns(
        {
            "_skips": F.count(F.when(skips, 1)).over(group),
            "_firsts": F.count(F.when(skips & F.col("first"), 1)).over(group),
            "_whole": F.min(F.when(turns, F.col("place"))).over(group),
            "_best": F.min(F.when(skips, F.col("place"))).over(group),
            "_best_first": F.min(F.when(skips & F.col("first"), F.col("place"))).over(group),
        }
    ).where("_skips > 1 OR (_skips = 1 AND _whole IS NOT NULL)")
    others = ranked.withColumn("_second", F.min(F.when(skips & (F.col("place") != F.col("_best")), F.col("place"))).over(group))
    replaced = F.when(F.col("place") == F.col("_best"), F.col("_second")).otherwise(F.col("_best"))
    shorter = F.when(F.col("first"), F.col("_whole"))
    found = others.select(
        "word",
        F.when(turns, F.col("_firsts")).otherwise(F.col("_skips") - 1 + shorter.isNotNull().cast("long")).alias("n_near"),
        F.when(turns, F.col("_best_first")).otherwise(F.least(replaced, shorter)).alias("best"),
    )
    return found.where("n_near > 0").groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def group_variants(docs: DataFrame, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each frequent word of ``docs`` (doc_id, text)."""
    words = written(frequent_words(docs, letters, count))
    near = near_words(words)
    best_n = -F.col("best.less")
    formed = F.when(best_n >= ratio * F.col("n"), F.col("best.word"))
    rows = words.join(near, "word", "left").select("word", formed.alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed.isNotNull(), best_n).alias("form_n"))
    rows = written(rows)
    chains = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = chains.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        joined = chains.join(further, F.col("root") == F.col("_word"), "left")
        moved = written(joined.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")))
        chains = moved.select("word", "root")
        if not moved.where("_moved").limit(1).count():
            break
    return rows.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
