"""Shared SQL fragments for the DuckDB oracle (independent re-statement of each query in SQL).

DuckDB runs RE2, which accepts the same Unicode classes as the Spark expressions.
"""

from __future__ import annotations

URL_RE = r"https?://[^\x09-\x0D\x1C-\x20\x{85}\p{Z}]+|www\.[^\x09-\x0D\x1C-\x20\x{85}\p{Z}]+"
MENTION_RE = r"@[\p{L}\p{N}_]+"
HASH_RE = "#"
NON_WORD_RE = r"[^\p{L}\p{N}_\x09-\x0D\x1C-\x20\x{85}\p{Z}]"
SPACES_RE = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+"
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"


def q(s: str) -> str:
    """SQL string literal with quotes doubled."""
    return "'" + s.replace("'", "''") + "'"


def clean_sql(col: str) -> str:
    """T1-T6 cleaning as a DuckDB expression over ``col`` (same classes as the Spark expression)."""
    x = f"lower({col})"
    x = f"regexp_replace({x}, {q(URL_RE)}, '', 'g')"
    x = f"regexp_replace({x}, {q(MENTION_RE)}, '', 'g')"
    x = f"regexp_replace({x}, {q(HASH_RE)}, '', 'g')"
    x = f"regexp_replace({x}, {q(NON_WORD_RE)}, ' ', 'g')"
    x = f"regexp_replace({x}, {q(SPACES_RE)}, ' ', 'g')"
    return f"trim({x})"


def tokens_sql(col: str) -> str:
    """T8b vectoriser tokens as a DuckDB list expression."""
    return f"regexp_extract_all({col}, {q(TOKEN_RE)})"


def words_sql(col: str) -> str:
    """T8a white-space words of a cleaned text as a DuckDB list (empty text -> empty list)."""
    return f"CASE WHEN {col} = '' THEN []::VARCHAR[] ELSE string_split({col}, ' ') END"


SCORED_CTE = """
scored0 AS (
  SELECT d.doc_id AS id, d.text, d.source AS source_dataset, d.lang,
         [8.0 * CAST(v.embedding[1] AS DOUBLE), 8.0 * CAST(v.embedding[2] AS DOUBLE),
          8.0 * CAST(v.embedding[3] AS DOUBLE)] AS logits
  FROM documents d JOIN embeddings v ON v.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)
),
scored1 AS (
  SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM scored0
),
scored2 AS (
  SELECT * EXCLUDE (ex), list_transform(ex, lambda x: x / (ex[1] + ex[2] + ex[3])) AS probs FROM scored1
),
scored AS (
  SELECT *, (['negative','neutral','positive'])[list_position(probs, list_max(probs))] AS sentiment,
         round(list_max(probs), 6) AS confidence
  FROM scored2
)"""

LABELED_CTE = SCORED_CTE + """,
labeled AS (
  SELECT s.id, s.text, """ + clean_sql("s.text") + """ AS preprocessed_text, s.sentiment, s.confidence,
         CAST(floor(e.value * 10) AS INTEGER) AS favorite_count, e.ts AS created_at,
         e.event_type AS location, 'user_' || CAST(e.user_id AS VARCHAR) AS username,
         s.source_dataset, s.lang, s.logits, s.probs, e.event_id IS NOT NULL AS has_metadata
  FROM scored s LEFT JOIN events e ON e.event_id = s.id AND e.event_type <> 'error'
)"""

BASE_CTE = LABELED_CTE + """,
texts AS (SELECT id, text, preprocessed_text, created_at, source_dataset FROM labeled),
sentiments AS (SELECT id AS text_id, sentiment, confidence FROM labeled),
metadata AS (SELECT id AS text_id, favorite_count, location, username FROM labeled WHERE has_metadata),
truth AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
                 ELSE 'neutral' END AS actual FROM labels)"""


def with_labeled(body: str) -> str:
    """Prefix ``body`` with the canonical labelled-input CTEs."""
    return "WITH " + LABELED_CTE + body


def with_base(body: str) -> str:
    """Prefix ``body`` with the labelled input and the three base tables."""
    return "WITH " + BASE_CTE + body
