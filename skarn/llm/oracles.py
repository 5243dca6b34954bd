"""DuckDB SQL with the rows of the operators that SQL can express."""

from __future__ import annotations

#: Table ``crc`` (t): the checksum's 256 steps, from its polynomial; bytes and checksum of a string against it.
_CRC = """crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: if(c & 1 = 1, xor(CAST(3988292384 AS BIGINT), c >> 1), c >> 1)) AS c FROM range(256) r(i)))"""


def _crc32(text: str) -> str:
    code = f"hex(encode({text}))"
    digits = f"list_transform(range(CAST(length({code}) AS BIGINT) // 2), lambda i: CAST('0x' || substr({code}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {digits}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT))"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The given pages have their text in one article element, of paragraphs and bold runs, with three named references.
_REFERENCES = "replace(replace(regexp_replace(regexp_replace(regexp_replace(body, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g'), '&quot;', '\"', 'g'), '&amp;', '&'), '&amp', '&')"
OP11_SQL = f"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, trim(regexp_replace({_REFERENCES}, '\\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM b
"""

OP12_SQL = rf"""
WITH {_CRC},
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word FROM d),
b AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
h AS (SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT word FROM w UNION SELECT word FROM b), crc),
s AS (SELECT bucket, count(*) AS n FROM w JOIN h USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN h USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM w) AS big_s, (SELECT count(*) FROM b) AS big_t),
g AS (SELECT i AS bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1) * (big_s + 10000))::DOUBLE / ((coalesce(s.n, 0) + 1) * (big_t + 10000)))) AS BIGINT) AS gain
  FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i, totals),
m AS (SELECT doc_id, CAST(sum(gain) AS DOUBLE) AS total FROM w JOIN h USING (word) JOIN g USING (bucket) GROUP BY doc_id),
p AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(floor(total / nullif(len(words), 0)), 0) AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM r
"""

#: Near words by what is left of them without one letter: two words of a length have the same rest at a place, or one is the other's rest.
OP13_SQL = f"""
WITH RECURSIVE {_CRC},
u AS (SELECT DISTINCT doc_id, run FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 5),
c AS (SELECT doc_id, run, {_crc32("CAST(doc_id AS VARCHAR) || ':' || run")} AS h FROM u, crc),
o AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM o JOIN c USING (doc_id, run)),
words AS (SELECT word, count(*) AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT DISTINCT a.word AS word, a.n AS n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON chain.root = f.word WHERE f.form IS NOT NULL),
last AS (SELECT chain.word, chain.root FROM chain JOIN f ON chain.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, last.root, f.n, f.n_near, f.form_n FROM f JOIN last ON f.word = last.word
"""
