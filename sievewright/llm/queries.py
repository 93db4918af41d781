"""The queries that apply each operator of this folder to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .chat import as_transcripts, format_transcripts, train_role_model
from .ctph import fingerprint_matches
from .langid import identify_languages
from .linededup import repeated_lines
from .mixing import mix_sources
from .quality import score_quality, train_quality_model
from .simhash import near_duplicate_groups
from .tokenstore import token_store
from .warc import convert_archives, pack_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_matches(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality_model(docs, _table(spark, sf_dir, "labels")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(_table(spark, sf_dir, "documents")).drop("d1", "d2")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return format_transcripts(as_transcripts(turns), train_role_model(turns))


def op8_withheld_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where half the conversations and a third of the others' turns have no marker: there the model alone tells the roles."""
    turns = _table(spark, sf_dir, "conversations")
    return format_transcripts(as_transcripts(turns, withhold=True), train_role_model(turns))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = convert_archives(pack_pages(_table(spark, sf_dir, "pages"))).where("warc_type <> 'warcinfo'")
    return records.select("record_id", "warc_type", "target_uri", "warc_date", "ip_address", "content_type", "content_length", "block_digest", "payload_digest", F.col("record").cast("string").alias("record"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash_near_dedup, op2_source_mixing, op3_language_id, op4_document_fingerprints, op5_quality_rules, op6_byte_bpe, op7_line_dedup, op8_chat_formatting, op8_withheld_markers, op9_arc_to_warc, op10_token_store)}

_LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, line_no, line, strlen(line) AS size FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) t WHERE line <> ''),
each AS (SELECT line, size, count(*) AS n, min(struct_pack(d := doc_id, l := line_no)) AS first FROM lines GROUP BY line, size),
longer AS (SELECT line, size - unnest([0, 1, 2]) AS fits FROM each WHERE size >= 20),
pairs AS (
  SELECT a.line AS a, b.line AS b FROM (
    SELECT line, size, substr(line, 1, length(line) // 3) AS s1, substr(line, length(line) // 3 + 1, length(line) // 3) AS s2,
           substr(line, 2 * (length(line) // 3) + 1) AS s3 FROM each WHERE size >= 20) a
  JOIN longer b ON b.fits = a.size
  WHERE a.line <> b.line AND (strlen(b.line) > a.size OR a.line < b.line)
    AND (contains(b.line, a.s1) OR contains(b.line, a.s2) OR contains(b.line, a.s3)) AND levenshtein(a.line, b.line) <= 2),
ways AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs UNION ALL SELECT line, line FROM each),
groups AS (
  SELECT x AS line, sum(n) AS n_lines, min(first) AS first FROM ways JOIN each ON each.line = ways.y GROUP BY x HAVING sum(n) > 1),
marked AS (
  SELECT doc_id, line_no, line, n_lines, first, (first.d = doc_id AND first.l = line_no) AS is_first,
         line_no > min(line_no) OVER (PARTITION BY doc_id, first) AS inn
  FROM lines JOIN groups USING (line))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, first.d AS first_doc_id, CAST(first.l AS INTEGER) AS first_line_no, CAST(n_lines AS BIGINT) AS n_lines,
       inn OR (NOT is_first AND (n_lines > 6 OR len(regexp_extract_all(line, '[^ \\t\\r\\v\\f]+')) >= 50)) AS removed
FROM marked
"""

# The transcripts mark every speaker, so the roles to recover are those of the table.
_CHAT_SQL = """
WITH said AS (
  SELECT conv_id, turn, role, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS content FROM conversations),
full_ AS (SELECT * FROM said WHERE content <> ''),
marked AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS opens FROM full_),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM marked),
turns AS (SELECT conv_id, k, min(role) AS role, string_agg(content, chr(10) ORDER BY turn) AS content FROM numbered GROUP BY conv_id, k)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, list(role ORDER BY k) AS roles,
       string_agg('<|' || role || '|>' || chr(10) || content || chr(10) || '<|end|>' || chr(10), '' ORDER BY k) AS rendered
FROM turns GROUP BY conv_id
"""


def _base32(hex40: str) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return f"""'sha1:' || array_to_string(list_transform(range(32), lambda i: substr('{letters}',
      1 + ((CAST('0x' || substr({hex40} || '0', CAST((5 * i) // 4 + 1 AS BIGINT), 3) AS INTEGER) >> CAST(7 - (5 * i) % 4 AS INTEGER)) & 31), 1)), '')"""


_WARC_SQL = f"""
WITH pages_ AS (
  SELECT url, html, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html AS block,
    strftime(TIMESTAMP '2000-01-01 00:00:00' + to_seconds(page_id), '%Y%m%d%H%M%S') AS arc_date,
    strftime(TIMESTAMP '2000-01-01 00:00:00' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS warc_date
  FROM pages),
hashed AS (SELECT *, sha1(block) AS bh, sha1(html) AS ph FROM pages_),
digested AS (SELECT *, {_base32('bh')} AS block_digest, {_base32('ph')} AS payload_digest FROM hashed),
named AS (SELECT *, md5(url || ' ' || warc_date || ' ' || block_digest) AS h FROM digested),
ids AS (
  SELECT *, '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21) || '>' AS record_id,
    chr(13) || chr(10) AS nl FROM named)
SELECT record_id, 'response' AS warc_type, url AS target_uri, warc_date, CAST(NULL AS VARCHAR) AS ip_address, 'application/http; msgtype=response' AS content_type,
  CAST(strlen(block) AS BIGINT) AS content_length, block_digest, payload_digest,
  'WARC/1.0' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: ' || record_id || nl || 'WARC-Date: ' || warc_date || nl
    || 'WARC-Target-URI: ' || url || nl || 'WARC-Block-Digest: ' || block_digest || nl || 'WARC-Payload-Digest: ' || payload_digest || nl
    || 'Content-Type: application/http; msgtype=response' || nl || 'Content-Length: ' || strlen(block) || nl || nl || block || nl || nl AS record
FROM ids
"""

ORACLES: dict[str, str] = {"op7_line_dedup": _LINE_DEDUP_SQL, "op8_chat_formatting": _CHAT_SQL, "op9_arc_to_warc": _WARC_SQL}
