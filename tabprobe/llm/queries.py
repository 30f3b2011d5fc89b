"""One query per operator over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.llm import (
    alignment, bpe, context_mixing, exact_dedup, html_extraction, language, mixing, ngram_jaccard, spelling, spotsigs, suffix_dedup, token_files, toxicity,
)
from tabprobe.llm.common import cut, remove, shared_path

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_jaccard.jaccard_components(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "component_size")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.sized(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return mixing.mix(rows, size_col="size", quality_col="quality", carry=["doc_id"])


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    found = html_extraction.extract(pages, html_extraction.fit(pages), carry=["page_id", "url"])
    return found.select("page_id", "url", "text", "n_chars", "n_blocks.chosen", "n_blocks.all")


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.edit_likeness(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("signatures", " ").alias("fingerprint"),
        F.array_join("edited_signatures", " ").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs, fold=~language.held_out(F.col("doc_id")))
    found = language.identify(docs, model, carry=["doc_id"])
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = context_mixing.held_out(F.col("doc_id"))
    found = context_mixing.scores(read(spark, sf_dir, "documents"), ~held_out)
    return found.withColumnRenamed("id", "doc_id").withColumn("held_out", held_out)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, fold=~toxicity.held_out(F.col("doc_id")))
    found = toxicity.score(docs, model, carry=["doc_id"])
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), vocabulary_path(), carry=["doc_id"], digests=True)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), carry=["doc_id"])


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
    return alignment.align(read(spark, sf_dir, "documents"), a, b, carry=["doc_id"])


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-files")
    try:
        token_files.write_ids(read(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), folder)
        return cut(token_files.read_documents(spark, folder))
    finally:
        remove(spark, folder)


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_mixing": op2_mixing,
    "op3_html_extraction": op3_html_extraction,
    "op4_spotsigs": op4_spotsigs,
    "op5_language_id": op5_language_id,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_spelling": op11_spelling,
    "op12_alignment": op12_alignment,
    "op13_token_files": op13_token_files,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def spotsigs_sql(anchors: list[str]) -> str:
    """SpotSigs by joins over numbered words."""
    common = ", ".join(f"'{a}'" for a in dict.fromkeys(anchors))
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        e AS (
            SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text,
                   coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id
            FROM d WINDOW o AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        t AS (
            SELECT doc_id, 0 AS kind, text FROM e UNION ALL
            SELECT doc_id, 1, substr(text, 1, n - n // 3) || substr(next_text, 1, n // 3) FROM e),
        w AS (SELECT doc_id, kind, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS ws FROM t),
        u AS (SELECT doc_id, kind, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
        m AS (SELECT *, w IN ({common}) AS anchor FROM u),
        k AS (
            SELECT *, sum(CASE WHEN anchor THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, kind ORDER BY i) AS r,
                   lead(anchor) OVER (PARTITION BY doc_id, kind ORDER BY i) AS next_anchor FROM m),
        c AS (SELECT doc_id, kind, r, w FROM k WHERE NOT anchor),
        s AS (
            SELECT k.doc_id, k.kind, k.w || ' ' || c1.w || ' ' || c2.w AS s FROM k
            JOIN c c1 ON c1.doc_id = k.doc_id AND c1.kind = k.kind AND c1.r = k.r + 1
            JOIN c c2 ON c2.doc_id = k.doc_id AND c2.kind = k.kind AND c2.r = k.r + 2
            WHERE k.anchor AND NOT k.next_anchor),
        g AS (SELECT doc_id, kind, list(DISTINCT s) AS chains FROM s GROUP BY 1, 2),
        h AS (
            SELECT w.doc_id, w.kind, w.text, ws, coalesce(chains, []) AS chains, list_filter(ws, lambda x: x NOT IN ({common})) AS content
            FROM w LEFT JOIN g USING (doc_id, kind)),
        f AS (
            SELECT doc_id, kind, text,
                   list_sort(list_distinct(list_transform(CASE WHEN text = '' THEN [] WHEN len(ws) = 0 THEN [text] ELSE list_concat(chains,
                       list_filter(CASE WHEN len(content) > 0 THEN content ELSE ws END,
                           lambda x: ('0x' || substr(md5(x), 1, 2))::INT * 64 < 256 * (64 - len(chains)))) END,
                       lambda x: substr(md5(x), 1, 16)))) AS p
            FROM h),
        a AS (
            SELECT e.doc_id, e.n AS n_chars, sha256(y.text) AS edited_sha256, x.p AS p, y.p AS q, z.p AS r FROM e
            JOIN f x ON x.doc_id = e.doc_id AND x.kind = 0 JOIN f y ON y.doc_id = e.doc_id AND y.kind = 1 JOIN f z ON z.doc_id = e.next_id AND z.kind = 0)
        SELECT doc_id, n_chars, edited_sha256, array_to_string(p, ' ') AS fingerprint, array_to_string(q, ' ') AS edited_fingerprint,
               CASE WHEN len(p) + len(q) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(p, q))::DOUBLE / (len(p) + len(q) - len(list_intersect(p, q))) END AS near_edited,
               CASE WHEN len(p) + len(r) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(p, r))::DOUBLE / (len(p) + len(r) - len(list_intersect(p, r))) END AS near_next
        FROM a"""


ORACLE: dict[str, str] = {
    "op1_ngram_jaccard": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS grams FROM w),
        g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
            FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM common WHERE 100 * k >= 80 * (na + nb - k)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, len(grams)::BIGINT AS n_shingles, component_id, count(*) OVER (PARTITION BY component_id) AS component_size
        FROM s JOIN comp USING (doc_id)""",
    "op4_spotsigs": spotsigs_sql(spotsigs.ANCHORS),
    "op6_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        n AS (SELECT doc_id, h, length(h) // 2 AS n_bytes FROM d),
        p AS (SELECT doc_id, unnest(range(0, n_bytes - 49)) AS i, h FROM n WHERE n_bytes >= 50),
        s AS (SELECT doc_id, i, md5_number(h[2 * i + 1 : 2 * i + 100]) AS w FROM p),
        hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first FROM s) WHERE first < doc_id),
        edge AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 50 THEN 0 ELSE 1 END AS new FROM hit WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
        span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
        per AS (
            SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends
            FROM span GROUP BY doc_id)
        SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(starts) + 2),
                   lambda k: h[(CASE WHEN k = 1 THEN 0 ELSE 2 * ends[k - 1] END) + 1 : (CASE WHEN k > len(starts) THEN length(h) ELSE 2 * starts[k] END)]), '') END)) AS kept_sha256
        FROM n LEFT JOIN per USING (doc_id)""",
    "op10_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {LOWERED} AS n FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(n) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY n)""",
    "op11_spelling": f"""
        WITH RECURSIVE bits AS (
            SELECT i AS start, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL
            SELECT start, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
        crc AS (SELECT list(c ORDER BY start) AS t FROM bits WHERE k = 8),
        per AS (SELECT doc_id, run, count(*) AS k FROM (
            SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY 1, 2),
        bytes AS (SELECT run, k, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
            lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM per),
        hashed AS (SELECT run, k, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
        counted AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM hashed GROUP BY 1),
        v AS (SELECT word, n FROM counted WHERE n >= 5 AND length(word) >= 6),
        gaps AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
        near AS (
            SELECT a.word AS word, b.word AS near FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION
            SELECT g.word, v.word FROM gaps g JOIN v ON g.rest = v.word UNION
            SELECT v.word, g.word FROM gaps g JOIN v ON g.rest = v.word),
        ranked AS (SELECT near.word, near, v.n AS near_n, row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, near) AS r, count(*) OVER (PARTITION BY near.word) AS n_near
            FROM near JOIN v ON near.near = v.word),
        formed AS (
            SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
            FROM v LEFT JOIN ranked ON ranked.word = v.word AND r = 1),
        walk AS (
            SELECT word, word AS root, form AS next FROM formed UNION ALL
            SELECT walk.word, formed.word, formed.form FROM walk JOIN formed ON walk.next = formed.word)
        SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN walk ON walk.word = formed.word AND walk.next IS NULL""",
}
