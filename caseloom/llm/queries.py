"""Registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import bands, decontaminate, jaccard, langid, linededup, pieces, quality, roles, samples, substrings
from caseloom.llm import tokenfile, toxicity, variants, warc
from caseloom.llm.arrow import crc_mod


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as WARC records in seekable bundles, read back."""
    return warc.archive(table(spark, folder, "pages"))


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the best match of each."""
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of every text without passages of 20 words that start earlier."""
    return substrings.remove_repeats(table(spark, folder, "documents"), texts=False)


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text, learned from the documents that are not held out."""
    docs = table(spark, folder, "documents")
    fold = crc_mod(F.col("doc_id"), 5)
    found = langid.predict(docs, langid.learn(docs.where(fold != 0).select("text", "lang")))
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every text, learned from the labels that are not held out."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    fold = crc_mod(F.col("doc_id"), 5)
    found = toxicity.score(docs, toxicity.learn(samples.labelled_texts(docs, labels, "toxic", fold != 0)))
    return found.withColumn("held_out", fold == 0).select("doc_id", "held_out", "score", "predicted", *toxicity.FEATURES)


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level ids of all texts, written as addressable files and read back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokenfile.encode_to_files(table(spark, folder, "documents"), path, end_id=2)


def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose word shingles are similar."""
    return jaccard.near_duplicates(table(spark, folder, "documents"))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every text, learned from the labels that are not held out."""
    fold = crc_mod(F.col("doc_id"), 4)
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = quality.quality_scores(docs, labels, fold != 2)
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return found.select("doc_id", (fold == 2).alias("held_out"), "score", predicted)


def op9_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Base rule and compression bands for every text."""
    return bands.quality_rules(table(spark, folder, "documents"))


def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text and what they decode to, as digests."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode(table(spark, folder, "documents"), path, extra=["covered_bytes"])


def counted_words(docs: DataFrame) -> DataFrame:
    """Words of at least 7 letters that occur twice, some with a letter lost, and how often."""
    # runs of 7 letters and more are whole runs, since a match takes all letters it can
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z\u00C0-\u00FF]{7,}"), F.lit(0))).alias("run"))
    lowered = runs.select("doc_id", linededup.ascii_lower(F.col("run")).alias("run"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
    hashed = lowered.select("run", F.crc32(F.encode(key, "UTF-8")).alias("h"))
    lost = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), lost), F.substring("run", lost + 2, F.length("run")))
    word = F.when(F.col("h") % 31 == 0, shorter).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= 7).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Near words and more frequent forms of all longer words of the documents."""
    return variants.group_variants(counted_words(table(spark, folder, "documents")))


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Conversation rows with some dropped, emptied, cut, repeated or given to the user."""
    blank = F.lit(" ")
    plain = turns.select("conv_id", "turn", *(F.coalesce(c, blank).alias(c) for c in ("role", "text")))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")))
    fault = F.crc32(F.encode(key, "UTF-8")) % 20
    hit = plain.withColumn("fault", fault).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, 2).otherwise(1)
    changed = hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
    return changed.drop("copy")


def op12_role_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of all conversations after damage, and the cheapest repair of each."""
    turns = table(spark, folder, "conversations")
    return roles.repair_roles(damaged_turns(turns), turns)


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of every text without the lines that three documents share."""
    return linededup.remove_repeated_lines(table(spark, folder, "documents"), texts=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_bundles,
        op2_benchmark_decontamination,
        op3_substring_dedup,
        op4_language_id,
        op5_toxicity,
        op6_token_files,
        op7_ngram_jaccard,
        op8_quality_classifier,
        op9_compression_bands,
        op10_sentencepiece,
        op11_spelling_variants,
        op12_role_repair,
        op13_line_dedup,
    )
} | {"pipeline": corpus_pipeline.run}

SQL: dict[str, str] = {
    "op1_warc_bundles": """
        WITH digests AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
        ), last AS (
            SELECT *, max(page_id) OVER (PARTITION BY html) AS response FROM digests
        )
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::INT // (1 << (15 - 5 * (i % 4))::INT)) % 32 + 1, 1)), '')
                AS payload_digest,
            CASE WHEN page_id IS NOT DISTINCT FROM response THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
        FROM last
    """,
    "op3_substring_dedup": r"""
        WITH texts AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), starts AS (
            SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM texts WHERE len(w) >= 20
        ), windows AS (
            SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS s FROM starts
        ), ranked AS (
            SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM windows
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE r > 1
        ), lists AS (
            SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id
        ), words AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM texts
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
            sha256(coalesce(k, '')) AS kept_sha256
        FROM texts t LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op7_ngram_jaccard": r"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, s FROM (
                SELECT doc_id, unnest(CASE
                    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM texts)
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * c >= 80 * (p.n + q.n - c)
        ), edges AS (
            SELECT x, y FROM links UNION ALL SELECT y, x FROM links
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION
            SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x
        ), bodies AS (
            SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS body FROM shingles GROUP BY doc_id
        ), degrees AS (
            SELECT x AS doc_id, count(DISTINCT b.body) AS n_links FROM edges
            JOIN bodies a ON a.doc_id = x JOIN bodies b ON b.doc_id = y WHERE a.body != b.body GROUP BY x
        )
        SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id,
            coalesce(any_value(g.n_links), 0) AS n_links
        FROM documents d JOIN reach r USING (doc_id) LEFT JOIN sizes s USING (doc_id) LEFT JOIN degrees g USING (doc_id)
        GROUP BY d.doc_id
    """,
    "op11_spelling_variants": r"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
            WHERE length(run) >= 7 GROUP BY ALL
        ), bytes AS (
            SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hex FROM runs
        ), hashed AS (
            SELECT run, times, xor(4294967295, list_reduce([4294967295] || list_transform(range(0, len(hex) * 4),
                lambda i: CASE WHEN i % 8 = 0 THEN ('0x' || substr(hex, (i // 4 + 1)::INT, 2))::BIGINT ELSE 0 END),
                lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)))) AS h FROM bytes
        ), damaged AS (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                ELSE run END AS word, times FROM hashed
        ), words AS (
            SELECT word, sum(times)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
        ), cut AS (
            -- the whole word (i = 0), and without its i-th code point
            SELECT word, n, i, CASE i WHEN 0 THEN word ELSE substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) END AS piece
            FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM words)
        ), near AS (
            SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (piece)
            WHERE a.word != b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)
        ), best AS (
            SELECT word, count(*) AS n_near, any_value(n) AS n, max(other_n) AS m,
                min(encode(other)) FILTER (other_n = top)::BLOB AS form
            FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word
        ), forms AS (
            SELECT word, decode(form) AS form, m AS form_n FROM best WHERE m >= 10 * n
        ), chain AS (
            SELECT word, word AS root, 0 AS steps FROM words
            UNION ALL
            SELECT c.word, f.form, steps + 1 FROM chain c JOIN forms f ON c.root = f.word
        ), last AS (
            SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word
        )
        SELECT w.word, f.form, l.root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
        FROM words w JOIN last l USING (word) LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word)
    """,
    "op12_role_repair": r"""
        WITH RECURSIVE plain AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS hex FROM conversations
        ), hashed AS (
            SELECT * EXCLUDE hex, xor(4294967295, list_reduce([4294967295] || list_transform(range(0, len(hex) * 4),
                lambda i: CASE WHEN i % 8 = 0 THEN ('0x' || substr(hex, (i // 4 + 1)::INT, 2))::BIGINT ELSE 0 END),
                lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)))) % 20 AS f FROM plain
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
            FROM hashed WHERE f != 0
        ), numbered AS (
            SELECT conv_id, turn, role, text, substr(role, 1, 1) AS i,
                trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
                row_number() OVER w AS p, lag(substr(role, 1, 1)) OVER w AS before,
                row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
            FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text), copy)
        ), turns AS (
            SELECT *, bare = '' AS blank, bare != '' AND again AS duplicate,
                bare != '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM numbered
        ), edits AS (
            SELECT conv_id, p, role, text, i, blank OR duplicate AS bad, CASE WHEN truncated THEN 3 ELSE 0 END AS t FROM turns
        ), steps AS (
            -- the cheapest ways to: nothing (z), after system (s), after user (u), after assistant (a)
            SELECT conv_id, 0::BIGINT AS p, {'c': 0, 'e': '', 't': ''} AS z, NULL::STRUCT(c INT, e VARCHAR, t VARCHAR) AS s,
                NULL::STRUCT(c INT, e VARCHAR, t VARCHAR) AS u, NULL::STRUCT(c INT, e VARCHAR, t VARCHAR) AS a
            FROM (SELECT DISTINCT conv_id FROM edits)
            UNION ALL
            SELECT conv_id, p,
                {'c': z.c + 4, 'e': z.e || 'D', 't': z.t},
                least(CASE WHEN s IS NOT NULL THEN {'c': s.c + 4, 'e': s.e || 'D', 't': s.t} END,
                    CASE WHEN NOT bad AND i = 's' THEN {'c': z.c + t, 'e': z.e || 'K', 't': z.t || chr(10) || role || ':' || text} END),
                least({'c': u.c + 4, 'e': u.e || 'D', 't': u.t},
                    CASE WHEN NOT bad THEN {'c': f.c + t + CASE WHEN i = 'u' THEN 0 ELSE 3 END,
                        'e': f.e || CASE WHEN i = 'u' THEN 'K' ELSE 'R' END,
                        't': f.t || chr(10) || CASE WHEN i = 'u' THEN role ELSE 'user' END || ':' || text} END),
                least({'c': a.c + 4, 'e': a.e || 'D', 't': a.t},
                    CASE WHEN NOT bad THEN {'c': u.c + t + CASE WHEN i = 'a' THEN 0 ELSE 3 END,
                        'e': u.e || CASE WHEN i = 'a' THEN 'K' ELSE 'R' END,
                        't': u.t || chr(10) || CASE WHEN i = 'a' THEN role ELSE 'assistant' END || ':' || text} END)
            FROM (
                SELECT *, CASE WHEN a IS NULL THEN least(z, s) ELSE least(z, s, a) END AS f FROM (
                    SELECT *, CASE WHEN u IS NOT NULL THEN least(b, {'c': u.c + 3, 'e': u.e || 'I', 't': u.t || chr(10) || 'assistant:'}) END AS a FROM (
                        SELECT * EXCLUDE (a, u), a AS b, least(u, {'c': g.c + 3, 'e': g.e || 'I', 't': g.t || chr(10) || 'user:'}) AS u FROM (
                            SELECT steps.conv_id, edits.p, z, s, u, a, least(z, s, a) AS g, role, text, i, bad, edits.t
                            FROM steps JOIN edits ON steps.conv_id IS NOT DISTINCT FROM edits.conv_id AND edits.p = steps.p + 1)))
            )
        ), ends AS (
            SELECT conv_id, least(z, a, {'c': u.c + 3, 'e': u.e || 'I', 't': u.t || chr(10) || 'assistant:'},
                {'c': s.c + 6, 'e': s.e || 'II', 't': s.t || chr(10) || 'user:' || chr(10) || 'assistant:'}) AS w
            FROM steps s1 WHERE p = (SELECT count(*) FROM edits e WHERE e.conv_id IS NOT DISTINCT FROM s1.conv_id)
        ), counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
                count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
                count_if(before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
            FROM turns GROUP BY conv_id
        )
        SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
            coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
            coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.c, 0)::BIGINT AS cost, coalesce(w.e, '') AS audit,
            sha256(coalesce(substr(w.t, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) d
        LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
        LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM d.conv_id
    """,
    "op13_line_dedup": r"""
        WITH rows AS (
            SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), lines AS (
            SELECT doc_id, r, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM rows
        ), keys AS (
            SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), known AS (
            SELECT key, max(doc_id) AS keeper FROM keys WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), judged AS (
            SELECT r, p, line, coalesce(doc_id < keeper, false) AS gone FROM keys LEFT JOIN known USING (key)
        ), kept AS (
            SELECT r, count(*) AS n_lines, count_if(gone) AS n_dropped, string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone) AS k
            FROM judged GROUP BY r
        )
        SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(k, '')) AS kept_sha256
        FROM rows JOIN kept USING (r)
    """,
}
