"""SQL for the queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

from wayfare.llm.decontaminate import LEAST_PERCENT, SHORTEST, WINDOW_WORDS
from wayfare.llm.mixing import DOMAIN_WEIGHTS, DOMAINS, LANGUAGE_WEIGHTS, SOURCE_WEIGHTS
from wayfare.llm.secrets import RULES

_LEVELS = ("domain", "language", "origin")


def _case(of: str, values: dict, default: object) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {of} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in values.items()) + f" ELSE {quote(default)} END" if values else quote(default)


def mix_sql(budget_percent: int = 80, max_epochs: int = 2, seed: str = "mix-1") -> str:
    domain = _case("coalesce(source, 'unknown')", {s: d for d, names in DOMAINS.items() for s in names}, "other")
    steps = [
        f"""d AS (SELECT doc_id, coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS origin, {domain} AS domain,
          CAST((strlen(coalesce(text, '')) + 3) // 4 AS BIGINT) AS n_tokens FROM documents)""",
        "leaf AS (SELECT domain, language, origin, CAST(sum(n_tokens) AS HUGEINT) AS tokens FROM d GROUP BY ALL)",
    ]
    above, parent = f"(SELECT (sum(tokens) * {budget_percent}) // 100 AS given FROM leaf)", ""
    for depth, (level, weights) in enumerate(zip(_LEVELS, (DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, SOURCE_WEIGHTS), strict=True)):
        path = ", ".join(_LEVELS[: depth + 1])
        over = f"PARTITION BY {parent}" if parent else ""
        join = f"JOIN {above} USING ({parent})" if parent else f"CROSS JOIN {above}"
        steps.append(f"n{depth} AS (SELECT {path}, sum(tokens) * {max_epochs} AS cap, CAST({_case(level, dict(weights), 1)} AS HUGEINT) AS weight FROM leaf GROUP BY {path})")
        steps.append(
            f"""w{depth} AS (SELECT {path}, cap, weight, given, cap * coalesce(sum(weight) OVER ({over} ORDER BY cap / weight, {level} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)
              <= (given - sum(cap) OVER ({over} ORDER BY cap / weight, {level} ROWS UNBOUNDED PRECEDING)) * weight AS is_full FROM n{depth} {join})"""
        )
        steps.append(
            f"""b{depth} AS (SELECT {path}, CASE WHEN is_full THEN cap ELSE ((given - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({over}), 0)) * weight)
              // sum(CASE WHEN NOT is_full THEN weight END) OVER ({over}) END AS given FROM w{depth})"""
        )
        above, parent = f"b{depth}", path
    steps.append("plan AS (SELECT *, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS epochs FROM leaf JOIN b2 USING (domain, language, origin))")
    steps.append(
        f"""summed AS (SELECT d.*, given, epochs, given - epochs * tokens AS part,
          sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY md5('{seed}:' || epochs || ':' || doc_id), CAST(doc_id AS VARCHAR) ROWS UNBOUNDED PRECEDING) AS upto
          FROM d JOIN plan USING (domain, language, origin))"""
    )
    last = "SELECT doc_id, domain, language, origin, n_tokens, CAST(given AS BIGINT) AS leaf_budget, CAST(epochs + CASE WHEN part > 0 AND upto <= part THEN 1 ELSE 0 END AS BIGINT) AS copies FROM summed"
    return "WITH " + ",\n".join(steps) + "\n" + last


def seeds_sql() -> str:
    """Windows of all items against all places of all documents; no seed or mask in it."""
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    n = f"least(size, {WINDOW_WORDS})"
    return f"""WITH docs AS (SELECT DISTINCT doc_id, {words} AS words FROM documents), items AS (SELECT DISTINCT item_id, {words} AS words FROM benchmark),
doc_words AS (SELECT doc_id, hash(words) AS text, unnest(range(len(words))) AS pos, unnest(words) AS word FROM docs),
item_words AS (SELECT item_id, hash(words) AS item, len(words) AS size, unnest(range(len(words))) AS item_pos, unnest(words) AS word FROM items),
same AS (SELECT doc_id, text, item_id, item, size, pos - item_pos AS shift, item_pos FROM doc_words JOIN item_words USING (word)),
rich AS (SELECT * FROM same QUALIFY count(*) OVER (PARTITION BY doc_id, text, item_id, item, shift) * 100 >= {n} * {LEAST_PERCENT}),
counted AS (SELECT doc_id, item_id, size, count(*) OVER (PARTITION BY doc_id, text, item_id, item, shift ORDER BY item_pos RANGE BETWEEN CURRENT ROW AND {WINDOW_WORDS - 1} FOLLOWING) AS equal FROM rich),
best AS (SELECT doc_id, item_id, max(equal) AS equal FROM counted WHERE CASE WHEN size < {SHORTEST} THEN equal = size ELSE equal * 100 >= {n} * {LEAST_PERCENT} END GROUP BY ALL)
SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS item_ids, CAST(max(equal) AS INTEGER) AS most_equal_words FROM best GROUP BY 1"""


def secrets_sql() -> str:
    quoted = lambda p: p.replace("'", "''")
    each = [
        f"""SELECT doc_id, '{r.kind}' AS kind, {i} AS rank, {r.least} AS least, unnest(range(len(w))) AS i, unnest(w) AS whole, unnest(v) AS value, unnest(g[:len(w)]) AS gap
        FROM (SELECT doc_id, regexp_extract_all(t, '{quoted(r.pattern)}', 0) AS w, regexp_extract_all(t, '{quoted(r.pattern)}', {r.value}) AS v, string_split_regex(t, '{quoted(r.pattern)}') AS g FROM docs) WHERE len(w) > 0"""
        for i, r in enumerate(RULES)
    ]
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    text = "kind || ':' || (ends - length(whole)) || ':' || ends"
    counts = ", ".join(f"count(kind) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), pieces AS ({" UNION ALL ".join(each)}),
placed AS (SELECT *, CAST(sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS ends FROM pieces),
found AS (SELECT * FROM placed WHERE length(value) >= least)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({text}, ',' ORDER BY ends - length(whole), rank) FILTER (kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg({text}, ',' ORDER BY ends - length(whole), rank), '') AS spans, sha256(any_value(d.t)) AS blob
FROM docs d LEFT JOIN found f USING (doc_id) GROUP BY d.doc_id"""


#: CRC-32's table, from its polynomial.
CRC_TABLE = """(SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM (SELECT unnest(range(256)) AS b)))"""


def crc32_sql(text: str, table: str) -> str:
    """The unsigned CRC-32 of a text's bytes."""
    each = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({each}, lambda c, b: xor({table}[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"


def _added(weight: str, cost: str | int, label: str) -> str:
    """A weight after one more edit. Weights are nine digits of cost and then the labels, so text order is theirs; null: not reached."""
    return f"(printf('%09d', CAST(left({weight}, 9) AS INTEGER) + {cost}) || substr({weight}, 10) || '{label}')"


def _least(*weights: str) -> str:
    return f"least({', '.join(weights)})"


def repair_sql() -> str:
    """Rows after damage, then weights of the grammar's four states row by row, then the repaired rows of the least path."""
    stays = "CASE WHEN r.stays THEN {} END"
    step = {
        "w0": _added("w0", 3, "D"),
        "w1": _least(_added("w1", 3, "D"), f"CASE WHEN r.stays AND r.initial = 's' THEN {_added('w0', 'r.late', 'K')} END"),
        "w2": _least(_added("w2", 3, "D"), *[x for w in ("w0", "w1", "w3") for x in (f"CASE WHEN r.stays AND r.initial = 'u' THEN {_added(w, 'r.late', 'K')} END", stays.format(_added(w, "2 + r.late", "R")))]),
        "w3": _least(_added("w3", 3, "D"), f"CASE WHEN r.stays AND r.initial = 'a' THEN {_added('w2', 'r.late', 'K')} END", stays.format(_added("w2", "2 + r.late", "R"))),
    }
    # Insertions: an empty user row leads to the third state, an empty assistant row from there to the fourth.
    users = _least("w2", *[_added(w, 2, "I") for w in ("w0", "w1", "w3")])
    closed = f"w0, w1, {users} AS w2, {_least('w3', _added(users, 2, 'I'))} AS w3"
    return f"""WITH RECURSIVE crc AS {CRC_TABLE},
one AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
dealt AS (SELECT *, {crc32_sql("name", "crc.t")} % 20 AS fault FROM one, crc),
damaged AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM dealt WHERE fault <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM damaged),
judged AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
  WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
rows AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS late, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair FROM judged),
convs AS (SELECT conv_id, max(place) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, {closed} FROM (SELECT conv_id, '000000000' AS w0, NULL::VARCHAR AS w1, NULL::VARCHAR AS w2, NULL::VARCHAR AS w3 FROM convs)
  UNION ALL SELECT conv_id, pos, {closed} FROM (SELECT w.conv_id, w.pos + 1 AS pos, {", ".join(f"{e} AS {n}" for n, e in step.items())} FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.place = w.pos + 1)),
best AS (SELECT c.*, CAST(left(w, 9) AS BIGINT) AS cost, substr(w, 10) AS audit FROM (SELECT conv_id, pos, least(w0, w3) AS w FROM walk) x JOIN convs c ON c.conv_id IS NOT DISTINCT FROM x.conv_id AND c.n = x.pos),
edits AS (SELECT conv_id, k, substr(audit, k, 1) AS edit, length(replace(left(audit, k), 'I', '')) AS place, length(replace(left(audit, k), 'D', '')) AS nth FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best)),
kept AS (SELECT e.conv_id, e.k, e.edit, e.nth, r.role, coalesce(r.text, '') AS text FROM edits e LEFT JOIN rows r ON e.edit <> 'I' AND r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.place = e.place WHERE e.edit <> 'D'),
headed AS (SELECT *, max(CASE WHEN nth = 1 AND edit = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS head FROM kept),
written AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha FROM headed GROUP BY conv_id)
SELECT o.conv_id, coalesce(b.gaps, 0) AS gaps, coalesce(b.blank, 0) AS blank, coalesce(b.duplicate, 0) AS duplicate, coalesce(b.truncated, 0) AS truncated, coalesce(b.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost,
  coalesce(b.audit, '') AS audit, coalesce(w.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM o.conv_id"""


def variants_sql() -> str:
    """Words from the documents' runs, all near pairs through shortened strings, and paths of forms."""
    capitals, small = ("".join(map(chr, range(a, a + 26))) for a in (65, 97))
    return f"""WITH RECURSIVE crc AS {CRC_TABLE},
runs AS (SELECT doc_id, translate(raw, '{capitals}', '{small}') AS run, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents) WHERE length(raw) >= 7 GROUP BY ALL),
hashed AS (SELECT *, {crc32_sql("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)", "crc.t")} AS h FROM runs, crc),
words AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM hashed) GROUP BY word HAVING length(word) >= 7 AND sum(m) >= 2),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM near GROUP BY word),
found AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
path AS (SELECT word, word AS pos, 0 AS steps FROM found UNION ALL SELECT p.word, f.form, p.steps + 1 FROM path p JOIN found f ON f.word = p.pos WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM found JOIN (SELECT word, arg_max(pos, steps) AS root FROM path GROUP BY word) USING (word)"""
