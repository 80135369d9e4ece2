"""SQL for the operators that it can express: the same rows by plainer, quadratic means, for small inputs."""

from __future__ import annotations

from opslake.llm import neardup, phrases, secret_scan, spelling, suffixes, vectors


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


NEARDUP = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
runs AS (
  SELECT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - {neardup.WORDS - 2})),
                                       lambda i: array_to_string(w[i:i + {neardup.WORDS - 1}], ' '))) AS run
  FROM words WHERE len(w) > 0),
weights AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
totals AS (SELECT doc_id, sum(n) AS total FROM weights GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS common
  FROM weights a JOIN weights b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN totals tx ON tx.doc_id = x JOIN totals ty ON ty.doc_id = y
  WHERE common / CAST(tx.total + ty.total - common AS double) >= {neardup.SIMILARITY}),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION
  SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.seen)
SELECT doc_id, min(seen) AS class_id, doc_id = min(seen) AS kept FROM reach GROUP BY doc_id"""


def _spans(kind: str, order: int, pattern: str, keeps: str) -> str:
    """Matches of a pattern with their places, from what lies between and what matches."""
    return f"""
  SELECT doc_id, '{kind}' AS kind, {order} AS kind_order, i, m[i] AS found,
         list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, m, regexp_split_to_array(text, '{_quoted(pattern)}') AS g, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, text, regexp_extract_all(text, '{_quoted(pattern)}', 0) AS m FROM docs) WHERE len(m) > 0)
  WHERE {keeps}"""


_CLASS = f"""CASE WHEN NOT regexp_matches(bare, '[A-Za-z]') THEN NULL WHEN regexp_full_match(bare, '[a-z]+|[A-Z]+') THEN 'one case'
  WHEN regexp_full_match(bare, '[A-Za-z]+') THEN CASE WHEN NOT regexp_matches(bare, '{_quoted(secret_scan.NAME)}') THEN 'letters' END
  WHEN NOT regexp_matches(bare, '[0-9]') THEN NULL WHEN regexp_full_match(bare, '[0-9a-fA-F]+') THEN 'hex'
  WHEN regexp_full_match(bare, '[0-9A-Za-z]+') THEN 'alphanumeric' ELSE 'base64' END"""
_LEAST = "CASE class " + " ".join(f"WHEN '{name}' THEN {bits}" for name, (_, bits) in secret_scan.CLASSES.items()) + " END"
_FOLDED = ", ".join(f"'{name}'" for name in secret_scan.FOLDED)
_ALLOWED = " OR ".join(f"regexp_matches(bare, '{_quoted(p)}')" for p in secret_scan.ALLOWED)
_GROUP_2 = f"length(regexp_extract(m[i], '{_quoted(secret_scan.ASSIGN)}', 2)) >= {secret_scan.ASSIGNED_CHARS}"

SECRETS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_spans("assign", 0, secret_scan.ASSIGN, _GROUP_2)}
  UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", "length(m[i]) >= 20")}
  UNION ALL {_spans("hex", 2, "[0-9a-f]+", "length(m[i]) >= 24")}),
long_words AS ({_spans("entropy", 3, "[A-Za-z0-9+/_-]{20,}", "regexp_matches(m[i], '[A-Za-z]')")}),
classed AS (SELECT *, {_CLASS} AS class FROM (SELECT *, regexp_replace(found, '{_quoted(secret_scan.DATES)}', '') AS bare FROM long_words)),
candidates AS (
  SELECT *, CASE WHEN class IN ({_FOLDED}) THEN lower(bare) ELSE bare END AS measured, {_LEAST} AS least
  FROM classed WHERE class IS NOT NULL AND NOT ({_ALLOWED})),
letters AS (
  SELECT doc_id, i, pos, measured[pos + k] AS letter, count(*) AS n
  FROM (SELECT *, unnest(range(0, {secret_scan.WINDOW})) AS k
        FROM (SELECT *, unnest(range(1, length(measured) - {secret_scan.WINDOW - 2})) AS pos FROM candidates))
  GROUP BY ALL),
windows AS (
  SELECT doc_id, i, -sum(n / {secret_scan.WINDOW}.0 * log2(n / {secret_scan.WINDOW}.0)) AS bits FROM letters GROUP BY doc_id, i, pos),
random AS (
  SELECT c.doc_id, c.kind, c.kind_order, c.i, c.found, c.start
  FROM candidates c JOIN (SELECT doc_id, i, max(bits) AS best FROM windows GROUP BY ALL) w ON w.doc_id = c.doc_id AND w.i = c.i
  WHERE w.best >= c.least - 1e-9),
every AS (
  SELECT doc_id, kind, kind_order, CAST(start AS bigint) AS start, CAST(start + length(found) AS bigint) AS stop FROM (SELECT * FROM base UNION ALL SELECT * FROM random)),
said AS (SELECT *, concat(kind, ':', CAST(start AS string), ':', CAST(stop AS string)) AS span FROM every)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind_order) FILTER (WHERE kind_order < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind_order), '') AS spans
FROM docs d LEFT JOIN said s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""

VECTORS = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS double[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {vectors.COSINE}),
reach AS (
  SELECT vec_id, vec_id AS seen FROM embeddings
  UNION
  SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.seen),
parts AS (SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY vec_id)
SELECT p.vec_id, (SELECT count(*) FROM links l WHERE l.x = p.vec_id) AS n_links, p.component_id, p.vec_id = p.component_id AS kept
FROM parts p"""

# The pages of the test tables mark their article and nest nothing inside it, so replacements find its blocks.
HTML = r"""
WITH blocks AS (
  SELECT page_id, url, list_transform(
           regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>'),
           lambda b: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(b, '</?b>', '', 'g'), '<br>', ' ', 'g'),
             '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS b
  FROM pages)
SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) AS text,
       CAST(length(array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10))) AS bigint) AS n_chars
FROM blocks"""

# Two hexadecimal digits stand for a byte.
SUFFIXES = f"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, {2 * suffixes.LENGTH}) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {suffixes.LENGTH - 1})) AS p FROM docs)),
repeats AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth FROM strings) WHERE nth > 1),
islands AS (
  SELECT doc_id, p, sum(CASE WHEN p <= before + {suffixes.LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS island
  FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM repeats)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + {suffixes.LENGTH} AS b FROM islands GROUP BY doc_id, island),
listed AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS gone FROM spans GROUP BY doc_id),
cut AS (
  SELECT d.doc_id, h, coalesce(gone, 0) AS gone, coalesce(len(a), 0) AS n, list_prepend(0, coalesce(b, [])) AS low,
         list_append(coalesce(a, []), length(h) // 2) AS high
  FROM docs d LEFT JOIN listed l ON l.doc_id = d.doc_id)
SELECT doc_id, CAST(length(h) // 2 AS bigint) AS n_bytes, CAST(gone AS bigint) AS n_removed, CAST(n AS bigint) AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, n + 2), lambda i: substr(h, 2 * low[i] + 1, 2 * (high[i] - low[i]))), ''))) AS kept_sha256
FROM cut"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PHRASES = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{phrases.NO_LANG}') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS bigint) AS n FROM worded GROUP BY lang),
runs AS (
  SELECT lang, size, array_to_string(w[pos:pos + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS pos
        FROM (SELECT lang, w, unnest(range(1, {phrases.WORDS + 1})) AS size FROM worded) WHERE size <= len(w))),
frequent AS (
  SELECT lang, phrase, size, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= {phrases.OCCURRENCES}),
inner_runs AS (
  SELECT lang, array_to_string(w[pos:pos + m - 1], ' ') AS phrase, max(f) AS around
  FROM (SELECT lang, f, w, m, unnest(range(1, size - m + 2)) AS pos
        FROM (SELECT lang, f, size, string_split(phrase, ' ') AS w, unnest(range(2, size)) AS m FROM frequent WHERE size > 2)) GROUP BY ALL),
candidates AS (
  SELECT c.lang, c.phrase, c.f AS a, c.size, string_split(c.phrase, ' ') AS w
  FROM frequent c LEFT JOIN inner_runs i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE c.size > 1 AND (around IS NULL OR 100 * around < {phrases.COVERED} * c.f)),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:size], ' ') AS y
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
scored AS (
  SELECT c.*, x.f AS l, y.f AS r, t.n, CAST({phrases.SCALE}::hugeint * a * t.n // (x.f::hugeint * y.f) AS bigint) AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = c.x JOIN frequent y ON y.lang = c.lang AND y.phrase = c.y
  JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= {phrases.TOP}"""

_LETTERS = "[A-Za-z\\x{00C0}-\\x{00FF}]+"
# The crc32 of a string, byte by byte over a table of its 256 remainders.
SPELLING = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(r ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
                          lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::bigint) ELSE c >> 1 END) AS r
    FROM range(0, 256) AS s(i))),
found AS (
  SELECT coalesce(CAST(doc_id AS varchar), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '{_LETTERS}')) AS run FROM documents),
lowered AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM found WHERE length(run) >= {spelling.LETTERS} GROUP BY ALL),
hexed AS (SELECT w, n, hex(encode(id || ':' || w)) AS h FROM lowered),
hashed AS (
  SELECT w, n, xor(list_reduce(
      list_prepend(4294967295::bigint, list_transform(range(1, length(h) // 2 + 1), lambda i:
        CAST(16 * (instr('0123456789ABCDEF', h[2 * i - 1]) - 1) + instr('0123456789ABCDEF', h[2 * i]) - 1 AS bigint))),
      lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS int) + 1])), 4294967295::bigint) AS crc
  FROM hexed, crc_table),
damaged AS (
  SELECT CASE WHEN crc % {spelling.DAMAGED} = 0 THEN left(w, CAST(crc % length(w) AS int)) || substr(w, CAST(crc % length(w) AS int) + 2) ELSE w END AS word, n
  FROM hashed),
known AS (
  SELECT word, CAST(sum(n) AS bigint) AS n FROM damaged WHERE length(word) >= {spelling.LETTERS}
  GROUP BY word HAVING sum(n) >= {spelling.OCCURRENCES}),
without AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM known)),
pairs AS (
  SELECT a.word, b.word AS near FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT w.word, k.word FROM without w JOIN known k ON k.word = w.rest
  UNION SELECT k.word, w.word FROM without w JOIN known k ON k.word = w.rest),
told AS (
  SELECT p.word, count(*) AS n_near, first(p.near ORDER BY k.n DESC, p.near) AS near, max(k.n) AS near_n
  FROM pairs p JOIN known k ON k.word = p.near GROUP BY p.word),
forms AS (
  SELECT k.word, k.n, coalesce(t.n_near, 0) AS n_near, CASE WHEN near_n >= {spelling.RATIO} * k.n THEN near END AS form,
         CASE WHEN near_n >= {spelling.RATIO} * k.n THEN near_n END AS form_n
  FROM known k LEFT JOIN told t ON t.word = k.word),
chain AS (
  SELECT word, word AS reached, 0 AS steps FROM forms
  UNION ALL
  SELECT c.word, f.form, c.steps + 1 FROM chain c JOIN forms f ON f.word = c.reached WHERE f.form IS NOT NULL)
SELECT f.word, f.form, (SELECT c.reached FROM chain c WHERE c.word = f.word ORDER BY c.steps DESC LIMIT 1) AS root, f.n, f.n_near, f.form_n
FROM forms f"""

ORACLES = {"op2_neardup": NEARDUP, "op4_secrets": SECRETS, "op6_vectors": VECTORS, "op10_html_text": HTML, "op11_spelling": SPELLING, "op12_phrases": PHRASES, "op13_suffixes": SUFFIXES}
