"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.bpe import encode_decode
from fleetlens.llm.collocations import collocations
from fleetlens.llm.conversations import damaged, repair, with_digest
from fleetlens.llm.cotraining import classify_quality
from fleetlens.llm.decontaminate import mark_contaminated
from fleetlens.llm.frames import table
from fleetlens.llm.licenses import scan_licenses
from fleetlens.llm.line_dedup import drop_repeated_chunks
from fleetlens.llm.quality_rules import quality_rules
from fleetlens.llm.sharding import shuffle_into_shards
from fleetlens.llm.simhash import hex_of, near_components
from fleetlens.llm.substring_dedup import drop_repeated_substrings
from fleetlens.llm.token_files import read_token_files, write_token_files
from fleetlens.llm.url_filter import judge_urls
from fleetlens.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = F.array_union("base_labels", F.col("spans.label"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("spans.cover")), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", F.array_sort("base_labels")).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(labels))).alias("labels"), score.alias("score"),
        F.size("spans").alias("n_spans"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), TOKENIZER, scratch_path(spark, "tokens"))
    return read_token_files(manifest).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_into_shards(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.col("text"), 256).alias("text_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return docs.select("doc_id", hex_of("fingerprint").alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = classify_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    return judged.select("doc_id", "p_text", "p_meta", "score", "kept")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_digest(repair(damaged(table(spark, sf_dir, "conversations"))))
    return done.select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeated_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_license_scan, op2_token_files, op3_shuffle_shards, op4_url_filter, op5_line_dedup, op6_quality_rules, op7_simhash_near_dedup, op8_decontamination, op9_quality_classifier, op10_bpe,
        op11_conversation_repair, op12_substring_dedup, op13_collocations)}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[q:q + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS q FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
hit AS (SELECT doc_id, p, dw.size, item_id FROM dw JOIN iw USING (size, win)),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + size - 1)) AS x FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS ids FROM hit GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, i, l[i] AS line, len(l) AS n,
             len(l[i]) >= 99 AND len(regexp_extract_all(l[i], '[^ \t\r]+')) >= 50 AS long
      FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM d)),
e AS (SELECT *, i = n OR long OR coalesce(lead(long) OVER w, false)
                OR (i >= 2 AND md5(md5(lag(line) OVER w) || md5(line))[1] < '4') AS ends
      FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(ends::int) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM e),
k AS (SELECT doc_id, no, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS body, bool_or(long) AS long FROM c GROUP BY 1, 2),
m AS (SELECT *, (lines > 1 OR long) AND regexp_matches(body, '[^ \t\n\x0B\f\r]')
               AND row_number() OVER (PARTITION BY body, lines > 1 OR long ORDER BY doc_id, no) > 1 AS gone FROM k)
SELECT d.doc_id, coalesce(len(l), 0)::bigint AS n_lines, coalesce(sum(lines) FILTER (gone), 0)::bigint AS n_removed_lines,
       count(*) FILTER (gone) AS n_removed_chunks,
       sha256(CASE WHEN count(*) FILTER (gone) = 0 THEN any_value(text) ELSE coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (NOT gone), '') END) AS text_sha256
FROM d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id, l
"""


SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS k
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS x FROM win JOIN f USING (k) WHERE doc_id > m),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS x FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY x) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, x) GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, sum(len(w))::hugeint AS n FROM p GROUP BY 1),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::hugeint AS f
      FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, unnest(generate_series(1, 5)) AS s(k) WHERE len(w) >= k)
      GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE k > 1),
left_over AS (SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c AS q WHERE q.lang = c.lang AND q.k > c.k AND 100 * q.f >= 100 * c.f AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))),
cut AS (SELECT lang, phrase, f AS a, k, w, unnest(generate_series(1, k - 1)) AS j FROM (SELECT *, string_split(phrase, ' ') AS w FROM left_over)),
scored AS (SELECT cut.lang, cut.phrase, a, j, l.f AS l, r.f AS r, n, (1000 * a * n) // (l.f * r.f) AS score
           FROM cut JOIN f AS l ON l.lang = cut.lang AND l.phrase = array_to_string(w[:j], ' ')
           JOIN f AS r ON r.lang = cut.lang AND r.phrase = array_to_string(w[j + 1:], ' ') JOIN n ON n.lang = cut.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER best AS rank, phrase, a::bigint AS a, l::bigint AS l, r::bigint AS r, n::bigint AS n, score::bigint AS score
FROM worst WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER best <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_dedup": LINE_DEDUP, "op8_decontamination": DECONTAMINATION,
        "op12_substring_dedup": SUBSTRING_DEDUP, "op13_collocations": COLLOCATIONS}
