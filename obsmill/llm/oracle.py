"""The results that SQL can express, for the registered queries of the corpus operators."""

from __future__ import annotations


WARC = """
WITH payload AS (
  SELECT page_id, translate(url, chr(13) || chr(10), '') AS url, coalesce(html, '') AS html FROM pages
),
hashed AS (SELECT page_id, url, strlen(html) AS n, sha256(html) AS d FROM payload),
firsts AS (SELECT d, min(page_id) AS first_id FROM hashed GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n < 100 OR page_id = first_id THEN NULL ELSE first_id END AS refers_to,
  url AS target_uri
FROM hashed JOIN firsts USING (d)
"""


TOPK = """
WITH usable AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::DOUBLE for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SKETCH_DEDUP = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS s FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL
),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)
),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other
)
SELECT doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


def _cheapest(state: str, own: str, follows: str, goes_to: str) -> str:
    """The cheapest edits of a message in a state, with what comes after them."""
    edit = "{{c: d.{to}.c + {cost}, a: '{mark}' || d.{to}.a, t: list_prepend({role} || ':' || text, d.{to}.t)}}"
    deletes = f"{{c: d.{state}.c + 3, a: 'D' || d.{state}.a, t: d.{state}.t}}"
    keeps = edit.format(to=goes_to, cost="cut", mark="K", role="role")
    gives = edit.format(to=goes_to, cost="cut + 2", mark="R", role=f"'{follows}'")
    begins = edit.format(to="s", cost="cut", mark="K", role="role")
    system = f"WHEN initial = 's' THEN [{deletes}, {gives}, {begins}] " if state == "n" else ""
    return (
        f"list_min(CASE WHEN fault IN ('blank', 'duplicate') THEN [{deletes}] WHEN initial = '{own}' THEN [{deletes}, {keeps}] "
        f"{system}ELSE [{deletes}, {gives}] END)"
    )


def _inserted(state: str, role: str) -> str:
    return f"{{c: {state}.c + 2, a: 'I' || {state}.a, t: list_prepend('{role}:', {state}.t)}}"


#: States: none yet, after the system, the user, the assistant.  d holds for each the cheapest repair of what comes later.
REPAIR = rf"""
WITH RECURSIVE table_of AS (
  SELECT list(list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT for x in range(8)]),
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS crcs
  FROM range(256) r(i)
),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    [ord(x)::UBIGINT for x in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS bytes
  FROM conversations
),
told AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) % 256 + 1)::INTEGER])), 4294967295::UBIGINT) % 20 AS kind
  FROM given, table_of
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM told WHERE kind <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again
  FROM damaged
),
faulty AS (
  SELECT *, role[1] AS initial, lead(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS next,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM placed
),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
),
edits AS (SELECT *, (fault = 'truncated')::BIGINT AS cut FROM faulty),
repairs AS (
  SELECT conv_id, n + 1 AS i, {{
    n: {{c: 0::BIGINT, a: '', t: []::VARCHAR[]}}, s: {{c: 4::BIGINT, a: 'II', t: ['user:', 'assistant:']}},
    u: {{c: 2::BIGINT, a: 'I', t: ['assistant:']}}, a: {{c: 0::BIGINT, a: '', t: []::VARCHAR[]}}}} AS d
  FROM counted
  UNION ALL
  SELECT conv_id, i, {{n: list_min([n, {_inserted("u", "user")}]), s: list_min([s, {_inserted("u", "user")}]), u: u, a: a}} AS d
  FROM (
    SELECT conv_id, i, n, s, list_min([u, {_inserted("a", "assistant")}]) AS u, list_min([a, {_inserted("u", "user")}]) AS a
    FROM (
      SELECT e.conv_id, e.i, {_cheapest("n", "u", "user", "u")} AS n, {_cheapest("s", "u", "user", "u")} AS s,
        {_cheapest("u", "a", "assistant", "a")} AS u, {_cheapest("a", "u", "user", "u")} AS a
      FROM repairs JOIN edits e ON e.conv_id IS NOT DISTINCT FROM repairs.conv_id AND e.i = repairs.i - 1
    )
  )
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(r.d.n.c, 0) AS cost, coalesce(r.d.n.a, '') AS audit,
  sha256(coalesce(array_to_string(r.d.n.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repairs r ON r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.i = 1
"""


LEXICAL = rf"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
whole AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, whole GROUP BY term
),
measures AS (SELECT doc_id, 100 - 75 + ((75 * n * big_n) // big_l) AS m FROM lengths, whole),
asked AS (
  SELECT item_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN measures USING (doc_id) GROUP BY ALL
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def oracle() -> dict[str, str]:
    return {
        "op7_warc": WARC,
        "op9_topk": TOPK,
        "op11_sketch_dedup": SKETCH_DEDUP,
        "op12_conversation_repair": REPAIR,
        "op13_lexical_search": LEXICAL,
    }
