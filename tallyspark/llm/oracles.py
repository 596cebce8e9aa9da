"""SQL for the corpus queries that SQL can express in full."""

from __future__ import annotations

WINDOW = 35

#: Windows as texts of their words; a word goes if a window over it stands at two places or more.
SUBSTRINGS = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), starts AS (
  SELECT r, unnest(range(1, len(words) - {WINDOW} + 2)) AS s, words FROM d WHERE len(words) >= {WINDOW}
), keyed AS (
  SELECT r, s, md5(array_to_string(words[s : s + {WINDOW - 1}], ' ')) AS k FROM starts
), marked AS (
  SELECT r, s, count(*) OVER (PARTITION BY k) > 1 AS again FROM keyed
), gone AS (
  SELECT DISTINCT r, unnest(range(s, s + {WINDOW})) AS p FROM marked WHERE again
), placed AS (
  SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d
), left_over AS (
  SELECT placed.r, string_agg(word, ' ' ORDER BY placed.p) AS kept, count(*) AS n
  FROM placed ANTI JOIN gone USING (r, p) GROUP BY placed.r
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)
"""

AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), known AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), flagged AS (
  SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS e4,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e, quality, toxic
  FROM d LEFT JOIN known USING (doc_id)
), rows AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * e4::INT + 16 * e::INT AS mask,
         coalesce(quality = 1, false)::INT AS good, coalesce(toxic = 1, false)::INT AS bad
  FROM flagged
), letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT row_number() OVER () AS o, u.f || v.f || w.f || x.f || y.f AS filter_order,
         [u.bit, v.bit, w.bit, x.bit, y.bit] AS bits
  FROM letters u, letters v, letters w, letters x, letters y
  WHERE u.bit + v.bit + w.bit + x.bit + y.bit = 31 AND len(list_distinct([u.f, v.f, w.f, x.f, y.f])) = 5
), steps AS (
  SELECT filter_order, s AS step, bits[s] AS this, coalesce(list_sum(bits[1 : s - 1]), 0)::INT AS gone
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM rows GROUP BY part, mask
), one AS (
  SELECT part, filter_order, step, this,
         coalesce(sum(n) FILTER (mask & (gone | this) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & gone = 0 AND mask & this <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & gone <> 0 AND mask & this <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = this), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & gone = 0 AND mask & this <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(bad) FILTER (mask & gone = 0 AND mask & this <> 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, this
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, this))::BIGINT AS shapley
FROM one
"""

FIM = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), cut AS (
  SELECT *, substr(t, 1, least(a, b)) AS prefix, substr(t, least(a, b) + 1, abs(a - b)) AS middle,
         substr(t, greatest(a, b) + 1) AS suffix
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN abs(a - b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""

ORACLES = {"op10_substrings": SUBSTRINGS, "op11_audit": AUDIT, "op13_fim": FIM}
