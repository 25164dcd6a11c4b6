"""The queries op1 to op13 over the test tables, with SQL where it can express them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, exact_dedup, hard_negatives, langid, line_dedup, lm, ngram_join, quality, spelling, substring_dedup, toxicity
from .common import remainder, table


def vocabulary() -> str:
    """The installed vocabulary file of the 50k byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), remainder("doc_id", 4) == 2)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 4) == 2)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_substrings(table(spark, sf_dir, "documents"), 50).drop("kept_text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 3) == 1)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_join(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows by turn, and one conversation more that is a JSON record with messages; its fingerprint selects the mapping."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    record = json.dumps({"id": -7, "messages": [{"role": role, "content": said} for role in ("user", "assistant")]})
    more = chat.from_json_text(spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(record).alias("record")))
    return chat.digests(chat.formatted(chat.from_rows(rows).unionByName(more.select("conv_id", "turns"))))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_model(table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 1)


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op10_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by the operator's first name for both kinds of matches."""
    return op10_decontam(spark, sf_dir)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents")).drop("kept_text")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_langid, op2_toxicity, op3_bpe, op4_exact_dedup, op5_substring_dedup, op6_quality, op7_ngram_join, op8_chat, op9_lm, op10_decontam, op10_matches, op11_hard_negatives, op12_line_dedup, op13_spelling)}

_WORDS5 = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x)
    """,
    "op5_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, {_WORDS5} AS w FROM documents),
        pl AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM pl),
        lows AS (SELECT k, min(doc_id) AS low FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
        bad AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN lows USING (k) WHERE doc_id > low),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS x, count(*) AS n FROM words ANTI JOIN bad USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op7_ngram_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM d),
        c AS (SELECT doc_id, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY g) END AS class_id,
              CASE WHEN len(g) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY g) END AS class_size FROM s),
        r AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s JOIN (SELECT DISTINCT class_id AS doc_id FROM c) USING (doc_id)),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
              FROM r a JOIN r b ON a.x = b.x AND a.doc_id != b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM p WHERE k >= 0.8 * (na + nb - k)),
        reach AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
        g AS (SELECT a AS class_id, min(b) AS group_id FROM reach GROUP BY a),
        n AS (SELECT a AS class_id, count(*) AS n_links FROM l GROUP BY a)
        SELECT doc_id, class_id, class_size, coalesce(n_links, 0) AS n_links, group_id, doc_id = group_id AS kept
        FROM c JOIN g USING (class_id) LEFT JOIN n USING (class_id)
    """,
    "op8_chat": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (SELECT *, replace(replace(replace(role, '\', '\b'), '<', '\l'), '[', '\o') AS r, replace(replace(replace(text, '\', '\b'), '<', '\l'), '[', '\o') AS x FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(length('<s>[ROLE]' || r || '[/ROLE]' || x || '</s>')) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op10_decontam": rf"""
        WITH words AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS x
                 FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
        pl AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
        hits AS (SELECT pl.doc_id, pl.i, k.n, wins.item_id FROM pl CROSS JOIN (SELECT DISTINCT n FROM wins) k
                 JOIN wins ON wins.n = k.n AND wins.x = array_to_string(w[i:i + k.n - 1], ' ') WHERE i + k.n - 1 <= len(w)),
        n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        ids AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
                FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id),
        bag AS (SELECT DISTINCT item_id, word, min(o) OVER (PARTITION BY item_id, word) AS o FROM (SELECT item_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS o FROM items)),
        tok AS (SELECT doc_id, i, w[i] AS word FROM pl),
        df AS (SELECT word, count(*) AS df FROM tok GROUP BY word),
        rare AS (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY df, o) AS r FROM bag JOIN df USING (word)),
        duo AS (SELECT a.item_id, a.word AS t1, b.word AS t2 FROM rare a JOIN rare b ON a.item_id IS NOT DISTINCT FROM b.item_id AND a.r = 1 AND b.r = 2),
        beside AS (SELECT duo.item_id, a.doc_id, min(abs(a.i - b.i)) AS gap FROM duo JOIN tok a ON a.word = t1 JOIN tok b ON b.word = t2 AND b.doc_id = a.doc_id AND abs(a.i - b.i) <= 20 GROUP BY duo.item_id, a.doc_id),
        near AS (SELECT doc_id, count(*) AS n_near, CAST(min(gap) AS INTEGER) AS nearest FROM beside GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near, nearest
        FROM words LEFT JOIN n_hit USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN near USING (doc_id)
    """,
    "op11_hard_negatives": r"""
        WITH v AS (
            SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id != b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
        n AS (
            SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
    "op12_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
        k AS (SELECT *, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        lows AS (SELECT key, min(doc_id) AS low FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        m AS (SELECT k.*, low IS NOT NULL AND doc_id != low AS gone FROM k LEFT JOIN lows USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op13_spelling": r"""
        WITH RECURSIVE table8 AS (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
        runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
        counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
        hashed AS (
            SELECT run, n, xor(list_reduce([4294967295] || flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
                     lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
            FROM counted, table8),
        words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
                SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed)
            WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
        pairs AS (
            SELECT a.word, b.word AS near FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word
            UNION SELECT less.word, words.word FROM less JOIN words ON less.rest = words.word
            UNION SELECT words.word, less.word FROM less JOIN words ON less.rest = words.word),
        ranked AS (
            SELECT p.word, near, v.n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, near) AS r
            FROM pairs p JOIN words v ON v.word = p.near),
        forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN near END AS form, CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
            FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
        steps AS (SELECT word, word AS place, 0 AS k FROM forms UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN forms f ON f.word = s.place WHERE f.form IS NOT NULL)
        SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(place, k) AS root FROM steps GROUP BY word) USING (word)
    """,
}
ORACLE_SQL["op10_matches"] = ORACLE_SQL["op10_decontam"]
