"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, media, mixing, packing, pii, quality, substring, urlfilter, warc, wordpiece
from .common import stored, table

#: Where the public tokenizers' vocabularies lie; None: the installed public_tokenizers package tells.
TOKENIZERS: str | None = None


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, payloads = warc.write_archive(table(spark, sf_dir, "pages"))
    records = warc.record_bytes(warc.read_archive(headers, payloads))
    whole = (F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", *whole)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), ngram=3, percent=90)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.decode_media(stored(media.encode_texts(table(spark, sf_dir, "documents")), "media"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_quality, op3_pii, op4_token_counts, op5_packing, op6_warc, op7_substring_dedup, op8_media, op9_jaccard_join, op10_url_filter)}


SPACES = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STOP = ", ".join(f"'{w}'" for w in sorted({v for w in quality.STOP_WORDS.split() for v in (w, w.capitalize(), w.upper())}))

OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ws AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT r, i, gram FROM (SELECT r, i, string_agg(x, ' ') OVER k AS gram, count(*) OVER k AS n FROM ws WINDOW k AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM dup) GROUP BY r),
c AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS n_upper,
    len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop_words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)),
f AS (SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.25 AND n_stop_words / n_words >= 0.01 AND n_dup_lines / n_lines <= 0.5 AND n_upper / word_chars <= 0.35 AS kept
FROM f
"""

OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, replace(replace(coalesce(url, ''), chr(13), ''), chr(10), '') AS u, chr(13) || chr(10) AS e FROM pages),
s AS (SELECT *, strlen(h) AS payload_bytes, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS top FROM p),
r AS (SELECT *, page_id = top AS own,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest FROM s),
w AS (SELECT *, 'WARC/1.1' || e || 'WARC-Type: ' || CASE WHEN own THEN 'response' ELSE 'revisit' END || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Date: 1970-01-01T00:00:00Z' || e || 'WARC-Target-URI: ' || u || e || 'WARC-Payload-Digest: sha1:' || payload_digest || e
  || CASE WHEN own THEN '' ELSE 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || e || 'WARC-Refers-To: <urn:page:' || top || '>' || e END
  || 'Content-Type: text/html' || e || 'X-Payload-Length: ' || payload_bytes || e || 'Content-Length: ' || CASE WHEN own THEN payload_bytes ELSE 0 END || e || e || CASE WHEN own THEN h ELSE '' END || e || e AS record FROM r)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT own THEN top END AS refers_to,
  strlen(record)::BIGINT AS record_bytes, sha256(record) AS record_sha256
FROM w
"""

_WORDS = r"""d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM documents),
ws AS (SELECT r, doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT r, doc_id, i, gram FROM (SELECT r, doc_id, i, string_agg(x, ' ') OVER k AS gram, count(*) OVER k AS n FROM ws WINDOW k AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {more} FOLLOWING)) WHERE n = {more} + 1)"""

OP7_SQL = (
    "WITH "
    + _WORDS.format(text="coalesce(text, '')", more=12)
    + """,
f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram),
c AS (SELECT DISTINCT r, i + j AS i FROM (SELECT r, i FROM g JOIN f USING (gram) WHERE doc_id > first) CROSS JOIN range(13) t(j)),
k AS (SELECT ws.r, string_agg(x, ' ' ORDER BY ws.i) AS kept, count(*) AS n FROM ws ANTI JOIN c USING (r, i) GROUP BY ws.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
)

OP9_SQL = (
    "WITH RECURSIVE "
    + _WORDS.format(text=f"translate(coalesce(text, ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}')", more=2)
    + """,
s AS MATERIALIZED (SELECT DISTINCT r, gram FROM g UNION SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
q AS (SELECT s.r, gram, n FROM s JOIN n USING (r)),
e AS MATERIALIZED (SELECT a.r AS ra, b.r AS rb FROM q a JOIN q b ON a.gram = b.gram AND a.r <> b.r AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(r, o) AS (SELECT r, r FROM n UNION SELECT reach.r, e.rb FROM reach JOIN e ON e.ra = reach.o),
c AS (SELECT reach.r, min(d.doc_id) AS least FROM reach JOIN d ON d.r = reach.o GROUP BY reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE c.least END AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""
)

_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in urlfilter.RULES)
OP10_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, host, path) AS (VALUES {_RULES}),
m AS (SELECT s.page_id, arg_max(r.host || r.path, length(r.host || r.path) * 1000 + length(r.host)) AS rule, arg_max(r.verdict, length(r.host || r.path) * 1000 + length(r.host)) AS verdict
  FROM s JOIN r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY s.page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN m USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": OP2_SQL, "op6_warc": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op9_jaccard_join": OP9_SQL, "op10_url_filter": OP10_SQL}
