"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, licences, mixing, neardup, neighbours, packing, pii, quality_rules, spelling, substrings, suffixes, topk, whitening

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_pieces(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_units(table(spark, sf_dir, "documents"))
    rows = mixed.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("text")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = neighbours.score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
        pii.spans_text(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand as source/doc_id, pages at their URL; tags of a page break its lines."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select(F.concat(F.lit("documents/"), "doc_id").alias("file"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    pages = table(spark, sf_dir, "pages")
    text = F.regexp_replace("html", "<[^>]*>", "\n")
    pages = pages.select(F.concat(F.lit("pages/"), "page_id").alias("file"), licences.url_path(F.col("url")).alias("path"), text.alias("text"))
    return licences.scan_licences(docs.union(pages))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return whitened.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_mixing": op3_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_top_k": op7_top_k,
    "op8_licences": op8_licences,
    "op9_pii": op9_pii,
    "op10_language_id": op10_language_id,
    "op11_whitening": op11_whitening,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}
_WORDS = r"w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS ws FROM documents)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES: dict[str, str] = {
    "op2_near_duplicates": f"""
        WITH RECURSIVE {_WORDS.format(text=_LOWER)}, s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 3], ' ') END AS shingle
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM w)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        links AS (
            SELECT p.u AS u, p.v AS v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2) p
            JOIN n a ON a.doc_id = p.u JOIN n b ON b.doc_id = p.v WHERE 100 * shared >= 80 * (a.n + b.n - shared)
        ), r(u, v) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.u, links.v FROM r JOIN links ON links.u = r.v),
        c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY 1)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = w.doc_id AS kept FROM w JOIN c ON c.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
    """,
    "op4_substring_dedup": f"""
        WITH {_WORDS.format(text="coalesce(text, '')")},
        k AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS place FROM k) WHERE place > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM later),
        each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
        left_over AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.pos) FILTER (gone.pos IS NULL) AS kept, count(gone.pos) AS n_removed FROM each e LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.pos = e.pos GROUP BY 1)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN left_over l ON l.doc_id = w.doc_id
    """,
    "op5_quality_rules": rf"""
        WITH {_WORDS.format(text="coalesce(text, '')")},
        h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3))),
        repeated AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS pos FROM h WHERE n > 1) GROUP BY 1),
        line AS (SELECT doc_id, source, regexp_extract_all(translate(lower(l), '123456789', '000000000'), '[^ 	-
]+') AS lw FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l FROM w)),
        keyed AS (SELECT doc_id, source, array_to_string(lw, ' ') AS key, len(lw) AS n FROM line WHERE len(lw) > 0),
        host AS (SELECT source, count(DISTINCT doc_id) AS documents FROM w GROUP BY 1),
        frequent AS (SELECT k.source, key FROM keyed k JOIN host ON host.source IS NOT DISTINCT FROM k.source GROUP BY k.source, key, documents HAVING count(DISTINCT doc_id) > 5 AND count(DISTINCT doc_id) > 0.01 * documents),
        lost AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM keyed k JOIN frequent f ON f.source IS NOT DISTINCT FROM k.source AND f.key = k.key GROUP BY 1),
        b AS (
            SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                   CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')))) AS BIGINT) AS n_dup_lines,
                   coalesce(r.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS removed_words
            FROM w LEFT JOIN repeated r ON r.doc_id = w.doc_id LEFT JOIN lost ON lost.doc_id = w.doc_id
        ), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
        SELECT *, NOT base_failed AND 2 * removed_words <= n_words AS kept FROM f
    """,
    "op7_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op12_suffix_dedup": """
        WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS data, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS digits FROM documents),
        k AS (SELECT doc_id, i, sha256(digits[2 * i + 1 : 2 * i + 800]) AS key FROM (SELECT doc_id, digits, unnest(range(n - 399)) AS i FROM b WHERE n >= 400)),
        hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY key) AS places FROM k) WHERE places > 1),
        edge AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM hit),
        run AS (SELECT doc_id, i, sum(CASE WHEN step <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM edge),
        gone AS (SELECT doc_id, span, min(i) AS low, max(i) + 400 AS high FROM run GROUP BY 1, 2),
        stay AS (SELECT doc_id, high AS low, lead(low) OVER (PARTITION BY doc_id ORDER BY low) AS high FROM (SELECT doc_id, low, high FROM gone UNION ALL SELECT doc_id, -1, 0 FROM b)),
        kept AS (SELECT b.doc_id, string_agg(digits[2 * s.low + 1 : 2 * coalesce(s.high, n)], '' ORDER BY s.low) AS digits FROM b JOIN stay s ON s.doc_id = b.doc_id GROUP BY 1),
        sums AS (SELECT doc_id, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans FROM gone GROUP BY 1)
        SELECT b.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.digits)) AS kept_sha256
        FROM b JOIN kept ON kept.doc_id = b.doc_id LEFT JOIN sums ON sums.doc_id = b.doc_id
    """,
    "op13_spelling_variants": rf"""
        WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
        run AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
        each AS (SELECT doc_id, run, count(*) AS n, hex(encode(concat(doc_id, ':', run))) AS digits FROM run WHERE length(run) >= 6 GROUP BY doc_id, run),
        byte AS (SELECT doc_id, run, n, list_transform(range(length(digits) // 2), lambda i: CAST(concat('0x', digits[2 * i + 1 : 2 * i + 2]) AS BIGINT)) AS bytes FROM each),
        sums AS (SELECT doc_id, run, n, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) AS h FROM byte, tab),
        word AS (SELECT CASE WHEN h % 199 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM sums),
        w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM word WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
        less AS (SELECT word, n, i, concat(left(word, i), substr(word, i + 2)) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
        near AS (
            SELECT a.word AS word, a.n AS n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN w b ON a.rest = b.word
            UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN w b ON a.rest = b.word
        ),
        best AS (SELECT word, n, m, other, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM near),
        f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM w LEFT JOIN best b ON b.word = w.word AND place = 1),
        chain(word, last) AS (SELECT word, word FROM f UNION SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON c.word = f.word JOIN f g ON g.word = c.last WHERE g.form IS NULL
    """,
}
