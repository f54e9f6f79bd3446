"""DuckDB SQL for the quality rules, built from the same fixed values and limits."""

from __future__ import annotations

from .quality import CLASS_SHARES, COMMON_WORDS, LANGUAGES, Limits, farthest, with_rest

_LIMITS = Limits()
_WS = "\\x20\\x09-\\x0D"


def _js(p: str, q: str) -> str:
    """The distance of two lists of shares."""
    part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda x: {part.format('x[1]', 'x[2]')} + {part.format('x[2]', 'x[1]')})) / 2))"


def _list(shares) -> str:
    return "[" + ", ".join(f"{x!r}::DOUBLE" for x in shares) + "]"


def _shares(words: dict[str, float]) -> str:
    return "[" + ", ".join(f"len(list_filter(ws, lambda w: w = '{w}'))::DOUBLE / n_words" for w in words) + "]"


_SHARES = ", ".join(f"{_shares(COMMON_WORDS[x])} AS p_{x}" for x in LANGUAGES)
_RATIOS = "[" + ", ".join(f"{_js(f'list_append(p_{x}, greatest(0.0, 1 - list_sum(p_{x})))', _list(with_rest(COMMON_WORDS[x])))} / {farthest(COMMON_WORDS[x])!r}" for x in LANGUAGES) + "]"
_CLASSES = "[letter / n, space / n, digit / n, punctuation / n, (n - letter - space - digit - punctuation) / n]"
_USUAL = "[" + ", ".join(_list(CLASS_SHARES[x]) for x in LANGUAGES) + "]"

QUALITY_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '[{_WS}]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')) AS lines
  FROM t
), g AS (
  SELECT *, len(words) AS n_words, list_transform(words, lambda x: lower(x)) AS ws,
    [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)] AS grams
  FROM w
), places AS (
  SELECT doc_id, gram, place, count(*) OVER (PARTITION BY doc_id, gram) AS n
  FROM (SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS place FROM g)
), covered AS (
  SELECT doc_id, sum(least(3, coalesce(next - place, 3))) AS n_repeat_words
  FROM (SELECT doc_id, place, lead(place) OVER (PARTITION BY doc_id ORDER BY place) AS next FROM places WHERE n > 1)
  GROUP BY doc_id
), m AS (
  SELECT g.doc_id, n_words::BIGINT AS n_words, ws, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[{_WS}]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    length(text)::DOUBLE AS n,
    (length(text) - length(regexp_replace(text, '\\p{{L}}', '', 'g')))::DOUBLE AS letter,
    (length(text) - length(regexp_replace(text, '[{_WS}]', '', 'g')))::DOUBLE AS space,
    (length(text) - length(regexp_replace(text, '[0-9]', '', 'g')))::DOUBLE AS digit,
    (length(text) - length(regexp_replace(text, '[.,;:!?''"()\\-]', '', 'g')))::DOUBLE AS punctuation
  FROM g LEFT JOIN covered USING (doc_id)
), p AS (
  SELECT *, n_words < {_LIMITS.min_words} OR 100 * n_repeat_words > {_LIMITS.max_repeat_percent} * n_words AS base_failed, {_SHARES} FROM m
), r AS (
  SELECT *, CASE WHEN n_words >= {_LIMITS.min_words} AND n >= {_LIMITS.min_chars} THEN {_RATIOS} END AS ratios FROM p
), j AS (
  SELECT *, list_min(ratios) AS word_ratio, {_js(_CLASSES, f"{_USUAL}[list_position(ratios, list_min(ratios))]")} AS class_js FROM r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(class_js > {_LIMITS.max_class_js} OR word_ratio > {_LIMITS.max_word_ratio} OR (class_js > {_LIMITS.wary_class_js} AND word_ratio > {_LIMITS.wary_word_ratio}), FALSE) AS kept
FROM j
"""
