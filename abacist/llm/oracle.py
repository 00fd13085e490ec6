"""DuckDB statements for the queries of this subpackage that SQL can express."""

from __future__ import annotations

# Every prefix of every conversation as the text of its turns; a conversation goes if it is a prefix of a longer one.
_CHATS = """
WITH placed AS (
  SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)) || chr(3) AS said,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST)
), prefix AS (
  SELECT conv_id, place, n, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY place) AS said FROM placed
), whole AS (
  SELECT said, min(conv_id) AS conv_id FROM prefix WHERE place = n GROUP BY said
), kept AS (
  SELECT conv_id FROM whole WHERE said NOT IN (SELECT said FROM prefix WHERE place < n)
)
SELECT conv_id, count(*) AS n_turns, string_agg(line, '' ORDER BY place) AS text
FROM placed WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id
"""

_SUBSTRINGS = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i AS start, array_to_string(w[i : i + 19], ' ') AS said
  FROM words, unnest(range(1, len(w) - 18)) AS t(i) WHERE len(w) >= 20
), firsts AS (
  SELECT said, min((doc_id, start)) AS first FROM windows GROUP BY said HAVING count(*) > 1
), hits AS (
  SELECT doc_id, start FROM windows JOIN firsts USING (said) WHERE (doc_id, start) > first
), gone AS (
  SELECT DISTINCT doc_id, start + k AS place FROM hits, unnest(range(0, 20)) AS t(k)
), places AS (
  SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1),
              lambda i: NOT coalesce(list_contains(places, i), false)), lambda i: w[i]), ' ')) AS kept_sha256
FROM words LEFT JOIN places USING (doc_id)
"""

_EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), usable AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degrees AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least USING (vec_id) LEFT JOIN degrees USING (vec_id)
"""

# Equal six-grams of a document at a lag, as islands: a run of period q has max(12 - q, q) words, six at least, that
# equal the word q places on, so it has such a pair. What has the same words with a smaller period goes.
_RUNS = """
WITH given AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), hashed AS (
  SELECT *, len(w) AS n, xor(list_reduce(
           [4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
           lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0],
                                    lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) AS h
  FROM given
), turned AS (
  SELECT *, (h // 10) % greatest(n, 1) AS a,
         1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p
  FROM hashed
), docs AS (
  SELECT row, doc_id, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w
  FROM turned
), grams AS (
  SELECT row, i, hash(w[i + 1 : i + 6]) AS gram
  FROM docs, unnest(range(len(w) - 5)) AS t(i) WHERE len(w) >= 12
), equal AS (
  SELECT x.row, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.row = y.row AND x.gram = y.gram AND x.i < y.i
), islands AS (
  SELECT row, q, min(i) AS start, count(*) + 5 AS stretch
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM equal) GROUP BY row, q, island
), runs AS (
  SELECT row, start, stretch + q AS length, min(q) AS period FROM islands
  WHERE stretch >= greatest(12 - q, q) GROUP BY row, start, length
), gone AS (
  SELECT DISTINCT row, start + period + k AS i FROM runs, unnest(range(length - period)) AS t(k)
), kept AS (
  SELECT row, list(i) AS places FROM gone GROUP BY row
), figures AS (
  SELECT row, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, p := period),
         struct_pack(l := -length, s := start, p := period)) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY row
)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start,
       CAST(best.l AS BIGINT) AS length, CAST(best.p AS BIGINT) AS period,
       CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(array_to_string(list_transform(list_filter(range(len(w)),
              lambda i: NOT coalesce(list_contains(places, i), false)), lambda i: w[i + 1]), ' ')) AS collapsed_sha256
FROM docs LEFT JOIN figures USING (row) LEFT JOIN kept USING (row)
"""

# Every phrase of one to five words by its text; cuts by the positions of its blanks.
_COLLOCATIONS = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), counts AS (
  SELECT lang, w[i : i + k - 1] AS words, count(*) AS f
  FROM lists, unnest(range(1, 6)) AS s(k), unnest(range(1, len(w) + 1)) AS t(i)
  WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING f >= 100
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang
), cuts AS (
  SELECT c.lang, c.words, c.f AS a, c.k, l.f AS l, r.f AS r, totals.n,
         1000::HUGEINT * c.f * totals.n // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM counts WHERE len(words) > 1) AS c
  JOIN totals ON totals.lang = c.lang
  JOIN counts AS l ON l.lang = c.lang AND l.words = c.words[1 : k]
  JOIN counts AS r ON r.lang = c.lang AND r.words = c.words[k + 1 :]
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, words[i : i + k - 1] AS words, max(f) AS longer
  FROM counts, unnest(range(2, 5)) AS s(k), unnest(range(1, 5)) AS t(i)
  WHERE k < len(words) AND i + k - 1 <= len(words) GROUP BY ALL
), free AS (
  SELECT best.*, array_to_string(words, ' ') AS phrase FROM best LEFT JOIN inner_ USING (lang, words)
  WHERE longer IS NULL OR 100 * longer < 100 * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

STATEMENTS = {
    "op2_chat_formatting": _CHATS,
    "op6_substring_dedup": _SUBSTRINGS,
    "op7_embedding_near_dedup": _EMBEDDINGS,
    "op11_run_detection": _RUNS,
    "op13_collocations": _COLLOCATIONS,
}
