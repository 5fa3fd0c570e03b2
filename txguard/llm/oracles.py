"""The registered queries of this package in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size
  FROM documents
), sources AS (
  SELECT k, any_value(source) AS source, sum(size)::HUGEINT AS s FROM sized GROUP BY k
), weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::HUGEINT AS w
  FROM sources
), summed AS (
  SELECT *, sum(s) OVER ()::HUGEINT AS all_s, sum(w) OVER ()::HUGEINT AS all_w,
         coalesce(sum(s) OVER before, 0)::HUGEINT AS before_s, coalesce(sum(w) OVER before, 0)::HUGEINT AS before_w
  FROM weighed
  WINDOW before AS (ORDER BY s * (10 // w), source IS NULL, encode(source)
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, 4 * s * (all_w - before_w) <= w * (3 * all_s - 4 * before_s) AS stops FROM summed
), rest AS (
  SELECT (3 * any_value(all_s) - 4 * coalesce(sum(s) FILTER (stops), 0))::HUGEINT AS r,
         (any_value(all_w) - coalesce(sum(w) FILTER (stops), 0))::HUGEINT AS free FROM marked
), targets AS (
  SELECT k, s, CASE WHEN stops THEN (2 * s)::DOUBLE ELSE (w * r)::DOUBLE / (2 * free)::DOUBLE END AS target,
         CASE WHEN s = 0 THEN 0 WHEN stops THEN 2 ELSE w * r END AS per,
         CASE WHEN stops THEN 1 ELSE s * 2 * free END AS of,
         ('0x' || substr(sha256('mix:' || k), 1, 8))::BIGINT::HUGEINT AS chance
  FROM marked, rest
), placed AS (
  SELECT doc_id, size, s, target, per, of, (chance * of) // 4294967296 AS off,
         (row_number() OVER (PARTITION BY k ORDER BY size, doc_id) - 1)::HUGEINT AS place
  FROM sized JOIN targets USING (k)
), copied AS (
  SELECT *, (((place + 1) * per + off) // of - (place * per + off) // of)::BIGINT AS copies FROM placed
)
SELECT doc_id, size, s::BIGINT AS source_size, target, copies * size AS taken, copies FROM copied
"""

OP5 = rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i + 1:i + 20], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 19, 0))) AS i FROM split)
), later AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(20)) AS i FROM later
), placed AS (
  SELECT doc_id, unnest(range(len(words))) AS i, unnest(words) AS word FROM split
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

_CONTROL = r"<\\*(?:<SYS>>|</SYS>>|/s>|s>|<TURN|</TURN>>)|\[\\*(?:/INST\]|INST\])"

OP9 = rf"""
WITH given AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) +
    CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10
    ELSE 12 + coalesce(10 + length(role), 9) END AS chars
  FROM given
), folded AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, text) FILTER (role = 'assistant'), '') AS lost,
         sum(chars)::BIGINT AS formatted_chars,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END, ''
                    ORDER BY turn NULLS LAST, role, text) AS roles
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(lost)::BIGINT AS loss_chars, sha256(lost) AS loss_sha256,
       formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid
FROM folded
"""

OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sized AS (
  SELECT k, lang, w, unnest(range(1, len(w) - k + 2)) AS i FROM split, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(w) >= k
), counted AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f FROM sized GROUP BY ALL
), words AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang
), often AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE f >= 30
), cuts AS (
  SELECT lang, phrase, f AS a, w, unnest(range(1, k)) AS cut FROM often WHERE k >= 2
), scores AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, cut, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:cut], ' ')
              JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')
), lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), parts AS (
  SELECT lang, f, k, w, size, unnest(range(1, k - size + 2)) AS i FROM often, (VALUES (2), (3)) AS v(size) WHERE k > size
), most AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(f) AS most FROM parts GROUP BY ALL
), ranked AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank
  FROM lowest c LEFT JOIN most m ON m.lang = c.lang AND m.phrase = c.phrase
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN words USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op3_mixing_sources": OP3,
    "op5_substring_dedup": OP5,
    "op9_chat_formatting": OP9,
    "op13_phrase_mining": OP13,
}
