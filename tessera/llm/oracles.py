"""SQL for DuckDB that says what some of the registered queries must return; the others are tested against brute force."""

from __future__ import annotations

from .quality import GRID, PATH
from .sharding import SPLITS, SPREAD, TOLERANCE

#: A byte of the two hexadecimal digits p, and the checksum CRC-32 of a text's bytes by its table.
_BYTE = "(instr('0123456789ABCDEF', p[1]) - 1) * 16 + instr('0123456789ABCDEF', p[2]) - 1"
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
_CRC = f"""xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: {_BYTE}),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"""


def sharding(shards: int = 24) -> str:
    return f"""WITH crc AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size, md5(coalesce(text, '')) AS digest,
  (((doc_id % {SPREAD}) + {SPREAD}) % {SPREAD}) % {SPLITS} AS split FROM documents),
c AS (SELECT text, {_CRC} AS crc FROM (SELECT DISTINCT text FROM d), crc),
p AS (SELECT *, sum(size) OVER w - size AS start_at, row_number() OVER w - 1 AS place, sum(size) OVER (PARTITION BY digest) AS own, sum(size) OVER () / {shards} AS target
  FROM d WINDOW w AS (ORDER BY digest, split, doc_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CAST(least(floor(CASE WHEN own <= target * {TOLERANCE} THEN min(start_at) OVER (PARTITION BY digest) + own / 2 ELSE start_at + size / 2 END / target), {shards - 1}) AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s JOIN c USING (text)"""


def suffix_dedup(length: int = 100) -> str:
    """For tables without repeated ids; all windows of all texts are compared."""
    return f"""WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, n, h, unnest(range(0, n - {length - 1}, 500)) AS base FROM d WHERE n >= {length}),
segments AS (SELECT doc_id, base, least(500, n - {length - 1} - base) AS windows, substr(h, 2 * base + 1, {2 * (500 + length)}) AS seg FROM parts),
w AS (SELECT doc_id, base + k AS pos, substr(seg, 2 * k + 1, {2 * length}) AS win FROM (SELECT doc_id, base, seg, unnest(range(0, windows)) AS k FROM segments)),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM w) WHERE nth > 1),
marked AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {length} THEN 0 ELSE 1 END AS fresh FROM again),
runs AS (SELECT doc_id, min(pos) AS first, max(pos) + {length} AS last FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked) GROUP BY doc_id, run),
pieces AS (SELECT doc_id, first, last, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) AS before FROM runs),
cut AS (SELECT doc_id, sum(last - first) AS removed, count(*) AS spans, max(last) AS tail, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (first - before) AS BIGINT)), '' ORDER BY first) AS kept
  FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(tail, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)"""


_MEASURES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "n_letters"),
    "long_words": ("word_chars", "(n_words * 32)"),
}


def _measure(rule: str) -> str:
    if rule == "short_words":
        return f"CASE WHEN n_words > 0 THEN 1.0::DOUBLE - {_measure('long_words')} ELSE 0.0 END"
    a, b = _MEASURES[rule]
    return f"coalesce(least(1.0::DOUBLE, {a} / nullif({b}, 0)), 0.0)"


def quality(limit: float = 0.02, error: float = 0.05) -> str:
    """Counts, base rule, and the verdict of the level that is chosen for each language."""
    level = ", ".join(f"ceil(({loose!r}::DOUBLE - {_measure(rule)}) * {GRID / (loose - tight)!r}::DOUBLE)" for rule, (loose, tight) in PATH.items())
    return rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (SELECT doc_id, k, array_to_string(words[k : k + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS k FROM d)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (
  SELECT doc_id, unnest(range(k, k + 5)) AS place FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM grams) WHERE times > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(lines.dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CAST(greatest(1, least({GRID + 1}, {level})) AS INTEGER) AS level FROM f),
good AS (SELECT lang, level FROM g JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1) USING (doc_id) WHERE NOT base_failed),
tried AS (SELECT s.lang, t.t, s.n, (SELECT count(*) FROM good WHERE good.lang IS NOT DISTINCT FROM s.lang AND level <= t.t) AS k, count(*) OVER (PARTITION BY t.t) AS strata
  FROM (SELECT lang, count(*) AS n FROM good GROUP BY lang) s, range(1, {GRID + 1}) t(t)),
tested AS (SELECT lang, t, k < {limit} * n AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({limit}) + (n - i) * ln(1 - {limit})))) <= {error} / strata AS sure
  FROM tried),
chosen AS (SELECT lang, coalesce(min(t) FILTER (NOT sure), {GRID + 1}) - 1 AS chosen FROM tested GROUP BY lang)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT (base_failed OR level <= coalesce(chosen, 0)) AS kept
FROM g LEFT JOIN chosen ON g.lang IS NOT DISTINCT FROM chosen.lang"""


def fold() -> str:
    """Whether crc32 of the id as text is divisible by 5."""
    return f"""WITH crc AS (SELECT {_CRC_TABLE} AS t), d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS text FROM documents)
SELECT doc_id, coalesce({_CRC} % 5 = 0, false) AS held_out, true AS sound FROM d, crc"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_sharding": sharding(),
        "op7_suffix_dedup": suffix_dedup(),
        "op9_quality_rules": quality(),
        "law_nearest": "SELECT vec_id AS query_id, least(20, (SELECT count(*) FROM embeddings) - 1) AS n, true AS exact, true AS ordered FROM embeddings WHERE vec_id % 20 = 0",
        "law_packing": "SELECT 'sequences' AS of, true AS sound, CAST(NULL AS BIGINT) AS n UNION ALL SELECT 'documents', true, count(*) FROM documents",
        "law_token_counts": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, true AS limit_holds FROM documents",
        "law_byte_bpe": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
        "law_toxicity": fold(),
    }
