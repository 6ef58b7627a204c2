"""SQL statements, for DuckDB, of the queries that SQL can express."""

# CRC-32 by its byte table: eight shifts make the table, one fold per text uses it.
_CRC = """
step(i, k, v) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM step WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8)"""

_CRC_OF_HEX = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2),
    lambda p: (strpos('0123456789ABCDEF', h[p]) * 16 + strpos('0123456789ABCDEF', h[p + 1]) - 17)::BIGINT)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)::BIGINT"""

SHARDING = f"""
WITH RECURSIVE {_CRC}, sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), summed AS (
  SELECT doc_id, size, {_CRC_OF_HEX} AS text_crc32 FROM sized, crc
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto,
    row_number() OVER (ORDER BY doc_id, text_crc32, size) AS r, (SELECT sum(size) FROM sized)::BIGINT AS total
  FROM summed
), sharded AS (
  SELECT *, least((2 * upto - size) * 40 // (2 * total), 39)::INT AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY r) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM sharded"""

TOP_K = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
  FROM good q, good r WHERE q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id AND len(q.v) = len(r.v)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5"""

# Base 32 of a digest: 160 bits in groups of five.
WARC = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
    sha1(coalesce(html, '')) AS d FROM pages
), bits AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(1, 41),
    lambda i: lpad(bin(strpos('0123456789abcdef', d[i]) - 1), 4, '0')), 'string_agg', '') AS b
  FROM payloads
), digests AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(1, 161, 5), lambda p: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    16 * b[p]::INT + 8 * b[p + 1]::INT + 4 * b[p + 2]::INT + 2 * b[p + 3]::INT + b[p + 4]::INT + 1]), 'string_agg', '') AS payload_digest
  FROM bits
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM digests)"""


SUBSTRINGS = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i:i + 12] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)
), firsts AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM windows
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM firsts WHERE f < doc_id
), gone AS (
  SELECT doc_id, list(p) AS ps FROM covered GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, w, ps, CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END AS k
  FROM docs d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept"""


# All links by shared shingles, then labels spread until nothing changes.
NEAR_DUPLICATES = """
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id,
  least(d.doc_id, coalesce(c, d.doc_id)) = d.doc_id AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN component USING (doc_id)"""


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _matches_of(rank: int, kind: str, pattern: str, holds: str) -> str:
    """Matches of one kind with the text before each; ``holds`` says which count, by the match m and the pattern p."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT row, {rank} AS rank, '{kind}' AS kind, i, m, g, {holds.replace("{p}", p)} AS holds FROM (
    SELECT row, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS m, unnest(g[:len(a)]) AS g
    FROM (SELECT row, regexp_extract_all(text, {p}) AS a, string_split_regex(text, {p}) AS g FROM texts))"""


_GIVEN = "[\"']?\\x20*[:=]\\x20*[\"']?"
_SECRET_KINDS = [
    ("assign", f"({_either_case('password|passwd|secret|token|api_?key')}){_GIVEN}([A-Za-z0-9+/_.=-]+)", "length(regexp_extract(m, {p}, 2)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ("login", f"({_either_case('user_?name|user_?id|user|login|client_?id|account')}){_GIVEN}([A-Za-z0-9+/_.=@-]+)", "length(regexp_extract(m, {p}, 2)) >= 3"),
    ("opaque", "[A-Za-z0-9+/_-]{20,}", "regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')"),
    ("endpoint", "[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\\x20\\x09-\\x0D\"'<>]+", "true"),
]


def _in_scope(*kinds: str) -> str:
    listed = ", ".join(f"'{k}'" for k in kinds)
    return f"EXISTS (SELECT 1 FROM free o WHERE o.row = w.row AND o.kind IN ({listed}) AND abs(o.s - w.s) <= 250)"


SECRETS = f"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
  {" UNION ALL ".join(_matches_of(n, *k) for n, k in enumerate(_SECRET_KINDS))}
), ended AS (
  SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY row, kind ORDER BY i))::BIGINT AS e FROM cut
), placed AS (
  SELECT row, rank, kind, e - length(m) AS s, e FROM ended WHERE holds
), free AS (
  SELECT * FROM placed w WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM placed o WHERE o.row = w.row AND o.rank < 3 AND o.s < w.e AND o.e > w.s)
), reported AS (
  SELECT * FROM free w WHERE rank < 3
    OR kind = 'login' AND ({_in_scope("assign", "hex")} OR {_in_scope("opaque")} AND {_in_scope("endpoint")})
    OR kind = 'opaque' AND ({_in_scope("access")} OR {_in_scope("login")} AND {_in_scope("endpoint")})
    OR kind = 'endpoint' AND {_in_scope("access", "login")} AND {_in_scope("assign", "hex", "opaque")}
), listed AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM reported GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (row)"""

SPELLING = f"""
WITH RECURSIVE {_CRC}, runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, {_CRC_OF_HEX} AS c FROM counted, crc
), vocab AS (
  SELECT CASE WHEN c % 97 = 0 THEN substr(run, 1, c % length(run)) || substr(run, c % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(k) >= 3
), gaps AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM vocab)
), taken AS (
  SELECT DISTINCT g.word, g.n, v.word AS shorter, v.n AS shorter_n FROM gaps g JOIN vocab v ON g.rest = v.word
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT word, shorter, shorter_n FROM taken UNION ALL SELECT shorter, word, n FROM taken
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word
), formed AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.near_n >= 2 * v.n THEN b.near END AS form,
    CASE WHEN b.near_n >= 2 * v.n THEN b.near_n END::BIGINT AS form_n
  FROM vocab v LEFT JOIN best b USING (word)
), chain(word, last, form) AS (
  SELECT word, word, form FROM formed
  UNION ALL SELECT c.word, c.form, f.form FROM chain c JOIN formed f ON f.word = c.form
)
SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.form IS NULL"""

# One step per row of a conversation: for every state the least (cost, audit), with the text it repairs to.
_STEP = {"s": [("0", "s")], "u": [("0", "u"), ("s", "u"), ("a", "u")], "a": [("u", "a")]}


def _least(cells: list[str]) -> str:
    return f"list_min([{', '.join(cells)}])"


def _moved(state: str, cost: str, sign: str, line: str, when: str) -> str:
    return f"CASE WHEN {when} AND c_{state} IS NOT NULL THEN {{'c': c_{state}.c + {cost}, 'a': c_{state}.a || '{sign}', 't': c_{state}.t || {line}}} END"


def _after_row(state: str) -> str:
    cells = [_moved(state, "3", "D", "''", "true")]
    for kind, moves in _STEP.items():
        for a, b in moves:
            if b == state:
                cells.append(_moved(a, "open", "K", "role || ':' || text || chr(10)", f"NOT gone AND role[1] = '{kind}'"))
                if kind in "ua":
                    name = {"u": "user", "a": "assistant"}[kind]
                    cells.append(_moved(a, "2 + open", "R", f"'{name}:' || text || chr(10)", "NOT gone"))
    return _least(cells)


def _with_inserts() -> str:
    """At most two inserted rows lead from any state to any other that rows can lead to."""
    def add(state: str, kinds: str) -> str:
        lines = " || ".join("'user:' || chr(10)" if k == "u" else "'assistant:' || chr(10)" for k in kinds)
        return f"CASE WHEN r_{state} IS NOT NULL THEN {{'c': r_{state}.c + {2 * len(kinds)}, 'a': r_{state}.a || '{'I' * len(kinds)}', 't': r_{state}.t || {lines}}} END"
    u = _least(["r_u", add("0", "u"), add("s", "u"), add("a", "u")])
    a = _least(["r_a", add("u", "a"), add("0", "ua"), add("s", "ua")])
    return f"r_0 AS c_0, r_s AS c_s, {u} AS c_u, {a} AS c_a"


_CELL = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
CONVERSATIONS = f"""
WITH RECURSIVE {_CRC}, given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations
), drawn AS (
  SELECT *, {_CRC_OF_HEX} % 20 AS d FROM given, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' WHEN role = '' THEN ' ' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn
), seated AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 24), sha256(text))
), judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    before IS NOT NULL AND (before[1] || role[1]) NOT IN ('su', 'ua', 'au') AS wrong,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS unended FROM seated
), faults AS (
  SELECT *, blank OR again AS gone, CASE WHEN unended AND NOT blank AND NOT again THEN 1 ELSE 0 END AS open FROM judged
), counted AS (
  SELECT conv_id, count(*) AS rows_left, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(open)::BIGINT AS truncated,
    count(*) FILTER (wrong) AS illegal FROM faults GROUP BY conv_id
), parsed(conv_id, k, c_0, c_s, c_u, c_a) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 't': ''}}::{_CELL}, NULL::{_CELL},
    {{'c': 2, 'a': 'I', 't': 'user:' || chr(10)}}::{_CELL}, {{'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}}::{_CELL} FROM counted
  UNION ALL
  SELECT conv_id, k, {_with_inserts()} FROM (
    SELECT p.conv_id, f.k, {", ".join(f"{_after_row(s)} AS r_{s}" for s in "0sua")}
    FROM parsed p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.k = p.k + 1)
), best AS (
  SELECT p.conv_id, list_min([c_0, c_a]) AS cell FROM parsed p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.k = c.rows_left
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cell.c, 0) AS cost, coalesce(cell.a, '') AS audit,
  sha256(coalesce(substr(cell.t, 1, length(cell.t) - 1), '')) AS repaired_sha256
FROM ids i LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id"""
