"""DuckDB SQL for the llm queries that SQL can express: chat formatting, WARC records and quality rules.

Hash votes, trained weights, piece merges, trees of pages, sound frames and seeded rounding are beyond SQL:
their queries are tested against brute force, the library itself, round trips or held-out rows.
"""

from __future__ import annotations

from meshwork.llm import chat, rules, warc


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _literal(s: str) -> str:
    """A string as an expression, line breaks spelled out."""
    return "(" + " || chr(10) || ".join(_quoted(p) for p in s.split("\n")) + ")"


def _escaped(x: str, t: chat.Template) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in t.control:
        x = f"replace({x}, {_literal(c)}, {_literal(c[0] + chr(92) + c[1:])})"
    return x


def chat_sql(t: chat.Template = chat.DEFAULT) -> str:
    """Control strings don't overlap one another or themselves, so that replacing one after the other escapes all."""
    esc = _escaped("text", t)
    allowed = " OR ".join(f"(last IS NOT DISTINCT FROM {_quoted(a)} AND role = {_quoted(b)})" for a, b in (("system", "user"), ("user", "assistant"), ("assistant", "user")))
    head = f"{_literal(t.opened)} || {_escaped('role', t)} || {_literal(t.closed)}"
    return f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER w - 1 AS nth, lag(role) OVER w AS last FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
k AS (SELECT *, CASE WHEN nth = 0 THEN role IN ('system', 'user') ELSE {allowed} END AS ok FROM o),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth) AS told,
 coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '') AS loss,
 string_agg({head} || {esc} || {_literal(t.tail)}, '' ORDER BY nth) AS formatted,
 min(nth) FILTER (NOT ok) AS bad, arg_max(role, nth) AS final FROM k GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, length(formatted) AS formatted_chars,
 bad IS NULL AND final = 'assistant' AS valid, cast(bad AS integer) AS bad_turn FROM g"""


def warc_sql(min_bytes: int = warc.MIN_REVISIT) -> str:
    return f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, CASE WHEN octet_length(b) >= {min_bytes} THEN sha1(b) END AS k FROM p),
m AS (SELECT k, max(page_id) AS holder FROM d WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1)
SELECT page_id, cast(n AS bigint) AS payload_bytes, h AS payload_digest,
 CASE WHEN holder IS NOT NULL AND page_id IS DISTINCT FROM holder THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN holder IS NOT NULL AND page_id IS DISTINCT FROM holder THEN holder END AS refers_to FROM d LEFT JOIN m USING (k)"""


def rules_sql() -> str:
    bits = " | ".join(f"(CASE WHEN {failed} THEN {1 << bit} ELSE 0 END)" for bit, (_, failed) in enumerate(rules.RULES))
    base, current = rules.mask_of(rules.POLICIES[1]), rules.mask_of(rules.POLICIES[rules.CURRENT])
    blank = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]+"
    return rf"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{word}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM t),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, i + o AS at FROM d, (SELECT unnest([0, 1, 2]) AS o)) GROUP BY rid),
m AS (SELECT doc_id, cast(len(words) AS bigint) AS n_words, cast(length(regexp_replace(text, '{blank}', '', 'g')) AS bigint) AS word_chars,
 cast(length(text) - length(translate(text, '#*$%&|<>', '')) AS bigint) AS n_symbols, cast(len(lines) AS bigint) AS n_lines,
 cast(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
 length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_upper FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, cast({bits} AS bigint) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {base} <> 0 AS base_failed, failed & {base} = 0 AND failed & {current} = 0 AS kept, failed FROM f"""


ORACLES: dict[str, str] = {"op1_chat_format": chat_sql(), "op6_warc": warc_sql(), "op10_quality_rules": rules_sql()}
