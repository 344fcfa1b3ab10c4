"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from orrery.llm import license_scan

OP5 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         row_number() OVER () AS rn
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER g AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER g = 1 AS kept,
       text_sha256
FROM d
WINDOW g AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, rn)
"""

OP8 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), g AS (
  SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
         CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS holder
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder = page_id THEN NULL ELSE holder END AS refers_to
FROM g
"""

#: Piece by piece, every phrase of 1 to 3 words is counted by itself; HUGEINT keeps products exact.
OP11 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(k))
  GROUP BY ALL HAVING count(*) >= 10
), c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
cuts AS (SELECT lang, phrase, k, a, j, array_to_string(w[:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM c, (VALUES (1), (2)) t(j) WHERE j < k),
s AS (
  SELECT cuts.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score,
         row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY 1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f), j) AS pick
  FROM cuts JOIN g l ON l.lang = cuts.lang AND l.phrase = x JOIN g r ON r.lang = cuts.lang AND r.phrase = y
), gone AS (
  SELECT DISTINCT b.lang, b.phrase
  FROM c t JOIN c b ON t.lang = b.lang AND t.k = 3 AND b.k = 2 AND (b.phrase = array_to_string(t.w[1:2], ' ') OR b.phrase = array_to_string(t.w[2:3], ' ')) AND 100 * t.a >= 50 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s ANTI JOIN gone USING (lang, phrase) WHERE pick = 1) JOIN n USING (lang)
WHERE rank <= 2000
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), k AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y, u
  FROM k
), t AS (SELECT *, array_to_string(u[:x], '') AS prefix, array_to_string(u[x + 1:y], '') AS middle, array_to_string(u[y + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM t
"""


def _op12(every: list[tuple[str, bool, list[str], list[tuple[int, str]], bool]], rare: int, agree: int, few: int, share: int) -> str:
    """The license scan by joins of all words. ``every``: label, base, words, key words of each template, and whether it is a text."""
    values = ", ".join(f"({t}, '{label}', {base}, {long})" for t, (label, base, _, _, long) in enumerate(every))
    places = ", ".join(f"({t}, {p}, '{w}')" for t, (_, _, words, _, _) in enumerate(every) for p, w in enumerate(words))
    keys = ", ".join(f"({t}, {p}, '{w}')" for t, (_, _, _, key, _) in enumerate(every) for p, w in key)
    return rf"""
WITH t(t, label, base, long) AS (VALUES {values}), places(t, place, word) AS (VALUES {places}), keys(t, place, word) AS (VALUES {keys}),
d AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), w AS (SELECT rn, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
df AS (SELECT word, count(DISTINCT rn) AS df FROM (SELECT DISTINCT word FROM places) LEFT JOIN w USING (word) GROUP BY 1),
ranked AS (
  SELECT t, place, word, long, ln((SELECT count(*) + 1 FROM d) / (df + 1)) + 1e-9 AS idf, df <= (SELECT greatest({few}, count(*) // {share}) FROM d) AS seldom,
         row_number() OVER (PARTITION BY t ORDER BY df, word, place) AS k
  FROM places JOIN df USING (word) JOIN t USING (t)
), index AS (SELECT t, place, word, idf, long FROM ranked WHERE CASE WHEN long THEN seldom ELSE k = 1 END),
whole AS (SELECT t, sum(idf) AS whole, CASE WHEN bool_or(long) THEN {agree} ELSE 1 END AS need FROM index GROUP BY 1),
own AS (
  SELECT rn, word, row_number() OVER (PARTITION BY rn ORDER BY df, word) AS k
  FROM (SELECT DISTINCT rn, word FROM w) JOIN df USING (word) WHERE word IN (SELECT word FROM index WHERE long)
), looked AS (SELECT rn, word FROM own WHERE k <= {rare} UNION SELECT DISTINCT rn, word FROM w WHERE word IN (SELECT word FROM index WHERE NOT long)),
votes AS (SELECT rn, t, i - place AS spot, count(*) AS n FROM w JOIN looked USING (rn, word) JOIN index USING (word) GROUP BY ALL),
places_held AS (SELECT rn, t, spot, sum(idf) AS held FROM votes v JOIN whole USING (t) JOIN index USING (t) JOIN w USING (rn) WHERE n >= need AND w.i = spot + index.place AND w.word = index.word GROUP BY ALL),
agreed AS (SELECT rn, t, spot, least(held / whole, 1.0) AS score FROM places_held JOIN whole USING (t)),
stands AS (SELECT rn, a.t, spot, count(*) AS n FROM agreed a JOIN keys k ON a.t = k.t JOIN w USING (rn) WHERE w.i = spot + k.place AND w.word = k.word GROUP BY ALL),
matches AS (
  SELECT rn, label, base, spot, score FROM agreed JOIN stands s USING (rn, t, spot) JOIN t USING (t) JOIN (SELECT t, count(*) AS m FROM keys GROUP BY 1) USING (t) WHERE s.n = m
), found AS (
  SELECT rn, count(*) FILTER (base) AS n_base, min(spot) FILTER (base) AS first_word, max(spot) FILTER (base) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, round(max(score), 6) AS score
  FROM matches GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN found USING (rn)
"""


OP12 = _op12(
    [(x.label, k < len(license_scan.PHRASES), x.words(), x.key_words(), bool(x.keys)) for k, x in enumerate([*license_scan.PHRASES, *license_scan.TEMPLATES])],
    license_scan.RARE, license_scan.AGREE, license_scan.FEW, license_scan.SHARE,
)

SQL: dict[str, str] = {"op5_exact_dedup": OP5, "op8_warc": OP8, "op11_collocations": OP11, "op12_license_scan": OP12, "op13_fill_in_middle": OP13}
