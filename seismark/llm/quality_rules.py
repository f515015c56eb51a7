"""Quality rules: text statistics of each document, and cross-document line frequency per host. DataFrame functions only.

Normalised lines are hashed; a line that stands in more than max(min_documents, share of the host's documents) distinct
documents of a host is boilerplate there and removed from the text; a document that loses more than half of its words is
depleted.

Defined cases: a null text counts as empty and stays null; blank lines never count and stay; a null host is a host of its own; repeated rows of a
document count once for a line's frequency; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A line is boilerplate above both; the floor is small, so that the share decides for hosts of more than 500 documents.
MIN_DOCUMENTS, MAX_SHARE = 5, 0.01
MIN_WORDS, MAX_REPEATED = 50, 50
#: Positions are packed into so many bits beside a hash; longer texts are compared without the hash.
_BITS = 21


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def normal_line(line: Column) -> Column:
    """The words of a line in lower case, digits as 0."""
    return split_words(F.translate(F.lower(line), "123456789", "0" * 9))


def _twins(items: Column, same) -> Column:
    """Of sorted ``items``, those that a neighbour equals."""
    last = F.size(items) - 1
    return F.filter(items, lambda x, i: ((i > 0) & same(x, F.get(items, i - 1))) | ((i < last) & same(x, F.get(items, i + 1))))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Repeated three-word windows: hashes with positions in their low bits are sorted, neighbours with equal hashes are
    candidates, and only those are compared as words.
    """
    low = (1 << _BITS) - 1
    out = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("_words", split_words(F.col("_text"))).withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: without(x, BLANKS) != ""))
    out = out.withColumn("_at", F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.array().cast("array<int>")))
    word = lambda i: F.get(F.col("_words"), i)
    out = out.withColumn("_hashed", F.sort_array(F.transform("_at", lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)).bitwiseAND(~low).bitwiseOR(i.cast("long")))))
    out = out.withColumn(
        "_maybe",
        F.when(F.col("n_words") > low, F.col("_at")).otherwise(
            F.transform(_twins(F.col("_hashed"), lambda a, b: F.shiftright(a, _BITS) == F.shiftright(b, _BITS)), lambda x: x.bitwiseAND(low).cast("int"))
        ),
    )
    out = out.withColumn("_windows", F.sort_array(F.transform("_maybe", lambda i: F.struct(word(i).alias("a"), word(i + 1).alias("b"), word(i + 2).alias("c"), i.alias("i")))))
    out = out.withColumn("_repeated", F.sort_array(F.transform(_twins(F.col("_windows"), lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])), lambda x: x["i"])))
    steps = F.transform("_repeated", lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_repeated"), i + 1) - x, F.lit(3))))
    return out.select(
        *docs.columns,
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x).alias("n_repeat_words"),
    )


def placed_lines(text: Column) -> Column:
    """Hash (line) and place (at) of each line that has words."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(normal_line(x).alias("words"), i.alias("at"))), lambda x: F.size(x["words"]) > 0)
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x["words"]).alias("line"), x["at"].alias("at")))


def quality_rules(docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, the text without frequent lines, the statistics of the text as it was, base_failed, removed_words and kept."""
    plain = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"))
    plain = plain.withColumn("key", F.xxhash64("text"))
    known = written(plain.select("doc_id", "key", "host", placed_lines(F.col("text")).alias("_lines")))
    lines = known.select("doc_id", "key", "host", F.explode("_lines").alias("_line")).select("doc_id", "key", "host", "_line.*")
    hosts = known.groupBy("host").agg(F.countDistinct("doc_id").alias("documents"))
    counted = lines.groupBy("host", "line", "doc_id").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_documents)
    frequent = counted.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).where(F.col("n") > max_share * F.col("documents"))
    frequent = frequent.select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    removed = (
        lines.join(frequent, (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host")))
        .groupBy("doc_id", "key", "host")
        .agg(F.collect_set("at").alias("_removed"))
        .select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.col("host").alias("_host"), "_removed")
    )
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("host").eqNullSafe(F.col("_host"))
    clean = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_removed", i)), "\n"))
    joined = text_statistics(plain).join(removed, same, "left").withColumn("_clean", clean)
    lost = F.when(F.col("_removed").isNull(), F.lit(0)).otherwise(F.col("n_words") - F.size(split_words(F.col("_clean")))).cast("long")
    joined = joined.withColumn("_lost", lost)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return joined.select(
        "doc_id", F.col("_clean").alias("text"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.col("_lost").alias("removed_words"), (~failed & (2 * F.col("_lost") <= F.col("n_words"))).alias("kept")
    )
