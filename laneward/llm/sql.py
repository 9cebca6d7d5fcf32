"""DuckDB SQL that checks the queries it can express, written from their contracts."""

from __future__ import annotations

from laneward.llm.mixing import CEILINGS, REST, ROUNDS, SEED
from laneward.llm.quality import RULES, STOP_WORDS

#: What parts words, and the words, for DuckDB's patterns.
_WORD = r"[^\x20\x09-\x0D]+"


def words_cte(name: str, source: str, text: str = "text") -> str:
    return f"{name} AS (SELECT *, regexp_extract_all(coalesce({text}, ''), '{_WORD}') AS w FROM {source})"


def _quality_sql(source: str = "documents") -> str:
    stop = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
    tests = []
    for r in RULES:
        ratio = f"(CASE WHEN {r.bottom} > 0 THEN {r.top} / {r.bottom} ELSE 0.0 END)"
        tests += [f"{ratio} >= {r.least!r}"] if r.least is not None else []
        tests += [f"{ratio} <= {r.most!r}"] if r.most is not None else []
    return f"""
WITH {words_cte("worded", source)},
positions AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM worded WHERE len(w) >= 3),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM positions),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM counted, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines,
    len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}]+'), lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
    length(regexp_replace(coalesce(text, ''), '[^\\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper
  FROM worded),
numbers AS (
  SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_stop_words, n_upper,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM measured LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM numbers)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(tests)} AS kept
FROM judged"""


QUALITY = _quality_sql()


def _groups_sql(source: str = "documents", size: int = 5, percent: int = 80) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE {words_cte("worded", source, lower)},
grams AS (
  SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM worded WHERE len(w) >= {size}),
sets AS (
  SELECT DISTINCT doc_id, {gram} AS g FROM grams
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM worded WHERE len(w) BETWEEN 1 AND {size - 1}),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= {percent} * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ways
  UNION SELECT node, b FROM reach JOIN both_ways ON other = a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least_id, doc_id) AS component_id
FROM {source} LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT node AS doc_id, min(other) AS least_id FROM reach GROUP BY node) USING (doc_id)"""


GROUPS = _groups_sql()


def _repeats_sql(source: str = "documents", size: int = 50) -> str:
    return f"""
WITH {words_cte("worded", source)},
starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM worded WHERE len(w) >= {size}),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {size - 1}], ' ')) AS g FROM starts),
firsts AS (SELECT g, min(doc_id) AS first_doc FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (g) WHERE doc_id > first_doc),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS holes FROM hits, range({size}) AS t(k) GROUP BY doc_id),
left_over AS (
  SELECT doc_id, len(w) AS n_words, len(coalesce(holes, [])) AS n_removed,
    CASE WHEN holes IS NULL THEN w
      ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: NOT list_contains(holes, p[2])), lambda p: p[1]) END AS kept
  FROM worded LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
  sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM left_over"""


REPEATS = _repeats_sql()


def _mixing_sql(source: str = "documents") -> str:
    named = {d: ", ".join(f"'{k}'" for k in t) for d, t in CEILINGS.items()}
    pooled = ", ".join(f"CASE WHEN {d} IN ({named[d]}) THEN {d} ELSE '{REST}' END AS {d}_key" for d in CEILINGS)
    keys = [f"{d}_key" for d in CEILINGS]
    step = "SELECT round, " + ", ".join(keys) + ", n, mass FROM fit"
    for d in CEILINGS:
        step = (
            f"SELECT round, {', '.join(keys)}, n, mass * share / sum(mass) OVER (PARTITION BY {d}_key) AS mass "
            f"FROM ({step}) JOIN {d}_target ON {d}_key = value"
        )
    present = ", ".join(
        f"{d}_held AS (SELECT {d}_key AS value, sum(n) / (SELECT sum(n) FROM cells) AS held FROM cells GROUP BY ALL), "
        f"{d}_cut AS (SELECT value, least(held, CASE "
        + " ".join(f"WHEN value = '{k}' THEN {v!r}" for k, v in t.items())
        + f" END) AS share FROM {d}_held WHERE value <> '{REST}' UNION ALL "
        f"SELECT value, 1 - (SELECT coalesce(sum(least(held, CASE "
        + " ".join(f"WHEN value = '{k}' THEN {v!r}" for k, v in t.items())
        + f" END)), 0) FROM {d}_held WHERE value <> '{REST}') FROM {d}_held WHERE value = '{REST}'), "
        f"{d}_target AS (SELECT value, share / sum(share) OVER () AS share FROM {d}_cut)"
        for d, t in CEILINGS.items()
    )
    return f"""
WITH RECURSIVE counted AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS n_tokens,
    length(regexp_replace(coalesce(text, ''), '[^|]+', '', 'g')) AS bars FROM {source}),
formed AS (
  SELECT *, CASE WHEN n_tokens > 0 AND 4 * bars >= n_tokens THEN 'table' WHEN n_tokens < 300 THEN 'short' ELSE 'long' END AS topic
  FROM counted),
keyed AS (SELECT *, {pooled} FROM formed),
cells AS (SELECT {", ".join(keys)}, sum(n_tokens)::DOUBLE AS n FROM keyed WHERE n_tokens > 0 GROUP BY ALL),
{present},
fit AS (
  SELECT 0 AS round, {", ".join(keys)}, n, n AS mass FROM cells
  UNION ALL SELECT round + 1, {", ".join(keys)}, n, mass FROM ({step}) WHERE round < {ROUNDS}),
weights AS (SELECT {", ".join(keys)}, mass / n / max(mass / n) OVER () AS probability FROM fit WHERE round = {ROUNDS})
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(p, 0), 6) AS probability, draw < coalesce(p, 0) AS kept
FROM (
  SELECT *, CASE WHEN n_tokens > 0 THEN probability END AS p,
    ('0x' || md5('{SEED}:' || doc_id)[1:8])::BIGINT / 4294967296.0 AS draw
  FROM keyed LEFT JOIN weights USING ({", ".join(keys)}))"""


MIXING = _mixing_sql()


#: Rows of conversations as op11 damages them; the checksum is worked out byte by byte.
_DAMAGED = """
crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda b: ascii(b)::BIGINT)),
      lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM fated, range(CASE WHEN fate = 3 THEN 2 ELSE 1 END) WHERE fate <> 0)"""

_LAST = r"rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _repair_sql() -> str:
    """A dynamic program over rows from the last to the first, comparing whole audits."""
    states = {"n": ("u", True), "s": ("u", False), "u": ("a", False), "a": ("u", True)}  # due next, may end
    never = "{'c': 1000000, 'p': ''}"
    add = lambda cost, letter, rest: f"{{'c': {cost} + {rest}.c, 'p': '{letter}' || {rest}.p}}"
    keeps = {("n", "s"): "s", ("n", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    bare, full = [], []
    for state, (due, _) in states.items():
        ways = [add("3", "D", f"o.{state}"), f"CASE WHEN r.gone THEN {never} ELSE {add('2 + r.cut', 'R', f'o.{due}')} END"]
        ways += [
            f"CASE WHEN NOT r.gone AND r.i = '{role}' THEN {add('r.cut', 'K', f'o.{to}')} ELSE {never} END"
            for (at, role), to in keeps.items()
            if at == state
        ]
        bare.append(f"least({', '.join(ways)}) AS {state}")
        once, twice = due, states[due][0]
        full.append(f"least({state}, {add('2', 'I', once)}, {{'c': 4 + {twice}.c, 'p': 'II' || {twice}.p}}) AS {state}")
    return f"""
WITH RECURSIVE {_DAMAGED},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k,
    substring(role, 1, 1) AS i, {_LAST} AS bare FROM damaged),
faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM placed),
counted AS (
  SELECT conv_id, count(*) AS held, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
rowed AS (
  SELECT conv_id, k, i, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::INT AS cut FROM faulty),
best AS (
  SELECT conv_id, held AS k, {{'c': 0, 'p': ''}} AS n, {{'c': 4, 'p': 'II'}} AS s, {{'c': 2, 'p': 'I'}} AS u, {{'c': 0, 'p': ''}} AS a FROM counted
  UNION ALL
  SELECT conv_id, k, {", ".join(full)} FROM (
    SELECT r.conv_id, r.k - 1 AS k, {", ".join(bare)}
    FROM best o JOIN rowed r ON r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.k = o.k)),
chosen AS (SELECT conv_id, n.c AS cost, n.p AS audit FROM best WHERE k = 0),
lettered AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM chosen),
edits AS (
  SELECT conv_id, j, audit[j] AS e,
    count(*) FILTER (audit[j] <> 'I') OVER w AS k, count(*) FILTER (audit[j] <> 'D') OVER w AS place
  FROM lettered WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
repaired AS (
  SELECT e.conv_id, e.j, e.e, e.place,
    CASE WHEN e.e <> 'I' THEN f.role END AS role, CASE WHEN e.e = 'I' THEN '' ELSE f.text END AS text,
    max((e.e = 'K' AND f.i = 's')::INT) OVER (PARTITION BY e.conv_id) AS lead
  FROM edits e JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.k = greatest(e.k, 1) WHERE e.e <> 'D'),
hashed AS (
  SELECT conv_id, sha256(string_agg(
    CASE WHEN e = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS h
  FROM repaired GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen p ON p.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM o.conv_id"""


REPAIR = _repair_sql()

_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '<turn', '<\turn'), '</turn', '<\/turn')"

CHAT = f"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM range(2) AS r(t))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn:') + length(replace({_ESCAPED.format("role")}, '>', '\\g')) + 1 + length({_ESCAPED.format("text")}) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM told GROUP BY conv_id"""


def _search_sql(source: str = "documents", k: int = 50) -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH found AS (
  SELECT doc_id, text, regexp_extract_all({lower.format("coalesce(text, '')")}, '{term}') AS t FROM {source}),
rowed AS (SELECT row_number() OVER () AS r, doc_id, t, len(t) AS n FROM found WHERE len(t) > 0),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS length FROM rowed),
counts AS (SELECT r, doc_id, n, unnest(t) AS term FROM rowed),
posted AS (SELECT r, doc_id, n, term, count(*) AS tf FROM counts GROUP BY ALL),
weighed AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posted, whole GROUP BY term, n_docs),
asked AS (
  SELECT DISTINCT i, item_id, term FROM (
    SELECT i, item_id, unnest(regexp_extract_all({lower.format("coalesce(text, '')")}, '{term}')) AS term
    FROM (SELECT row_number() OVER () AS i, * FROM benchmark))),
scored AS (
  SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // length))))::BIGINT AS score
  FROM asked JOIN posted USING (term) JOIN weighed USING (term), whole GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""


SEARCH = _search_sql()
