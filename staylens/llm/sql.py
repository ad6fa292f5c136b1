"""The same results as DuckDB SQL, over the driver's tables, for operators that
SQL can express."""

from __future__ import annotations

#: op12: fill-in-the-middle by substrings of whole texts.
FIM = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents),
h AS (
  SELECT doc_id, t, n,
         ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4
  FROM d),
f AS (
  SELECT doc_id, t, n, least(c1, c2) AS low, greatest(c1, c2) AS high,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT *, substr(t, 1, low) AS prefix, substr(t, low + 1, high - low) AS middle, substr(t, high + 1) AS suffix
  FROM f)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

#: op11: phrases of 2 to 5 words with their least score over all cuts.
COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 100),
inside AS (
  SELECT lang, k - 1 AS k, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase, a FROM c WHERE k > 2
  UNION ALL
  SELECT lang, k - 2, unnest([array_to_string(w[1:k - 2], ' '), array_to_string(w[2:k - 1], ' '), array_to_string(w[3:k], ' ')]), a FROM c WHERE k > 3
  UNION ALL
  SELECT lang, k - 3, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' '), array_to_string(w[3:4], ' '), array_to_string(w[4:5], ' ')]), a FROM c WHERE k = 5),
longer AS (SELECT lang, k, phrase, max(a) AS b FROM inside GROUP BY ALL),
kept AS (
  SELECT c.* FROM c LEFT JOIN longer USING (lang, k, phrase) WHERE b IS NULL OR 100 * b < 100 * c.a),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cut, l.a AS l, r.a AS r, n.n,
         (1000::HUGEINT * cuts.a * n.n // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = cuts.head
            JOIN f r ON r.lang = cuts.lang AND r.phrase = cuts.tail
            JOIN n ON n.lang = cuts.lang),
best AS (
  SELECT lang, phrase, a, l, r, n, score FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best
QUALIFY rank <= 2000
"""

#: op13: words covered by a window of 35 words that starts in two places.
REPEATS = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT id, i + j AS p FROM (SELECT id, i, unnest(range(0, 35)) AS j FROM s WHERE h IN (SELECT h FROM again))),
gone AS (SELECT id, count(*) AS n FROM hit GROUP BY id),
words AS (SELECT id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT id, string_agg(word, ' ' ORDER BY p) AS t
  FROM words LEFT JOIN (SELECT id, p, TRUE AS out FROM hit) USING (id, p) WHERE out IS NULL GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (id) LEFT JOIN kept USING (id)
"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: op1: turns in order; the template's escapes and marks counted.
CHAT = r"""
WITH c AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')),
t AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS n_text,
         length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS n_role,
         CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt
  FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said,
         string_agg(learnt, '' ORDER BY i) AS learnt, sum(4 + n_role + 2 + n_text + 8) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(learnt)::BIGINT AS loss_chars,
       sha256(learnt) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM g
"""

#: op5: sets of 5-word shingles, pairs by shared shingles, components by closure.
JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n, string_agg(g, chr(10) ORDER BY g) AS whole FROM s GROUP BY id),
e AS (SELECT id, n, min(id) OVER (PARTITION BY sha256(whole)) AS cls FROM n),
r AS (SELECT s.id, s.g, e.n FROM s JOIN e USING (id) WHERE e.cls = s.id),
common AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM r a JOIN r b USING (g) WHERE a.id < b.id GROUP BY ALL),
near AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT DISTINCT cls AS a, cls AS b FROM e UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a AS cls, min(d.doc_id) AS component_id FROM reach JOIN e ON e.cls = reach.b JOIN d USING (id) GROUP BY 1)
SELECT d.doc_id, coalesce(e.n, 0)::BIGINT AS n_shingles, CASE WHEN e.n IS NULL THEN d.doc_id ELSE component_id END AS component_id
FROM d LEFT JOIN e USING (id) LEFT JOIN least USING (cls)
"""

#: op7: windows of 10 words; runs of matching windows on one diagonal are the longest matches.
DECONTAMINATE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT row_number() OVER () AS it, item_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT it, item_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT it, item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (
  SELECT id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT dw.id, dw.i, dw.k, bw.it, bw.item_id, bw.p FROM dw JOIN bw USING (k, g)),
hit AS (SELECT id, count(DISTINCT x) AS n FROM (SELECT id, unnest(range(i, i + k)) AS x FROM m) GROUP BY id),
items AS (SELECT id, count(*) AS n, string_agg(v, ',' ORDER BY v) AS listed FROM (SELECT DISTINCT id, item_id::VARCHAR AS v FROM m) GROUP BY id),
runs AS (
  SELECT id, min(i) - 1 AS place, count(*) + any_value(k) - 1 AS n
  FROM (SELECT id, it, i, p, k, i - row_number() OVER (PARTITION BY id, it, i - p ORDER BY i) AS run FROM m) GROUP BY id, it, i - p, run),
longest AS (SELECT id, place, n FROM runs QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, place) = 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated,
       coalesce(longest.n, 0)::BIGINT AS longest_match, coalesce(longest.place, 0)::BIGINT AS longest_at
FROM d LEFT JOIN hit USING (id) LEFT JOIN items USING (id) LEFT JOIN longest USING (id)
"""

#: op8: links by cosine within a label, components by closure.
NEAR_VECTORS = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (
  SELECT * FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM v LEFT JOIN n ON n.a = vec_id JOIN least ON least.a = vec_id
"""

#: op9: digests in base 32, and the first page of each payload.
WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(x, i // 4 * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4)) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
