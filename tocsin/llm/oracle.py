"""DuckDB SQL for those of the registered queries that SQL can say, over whole tables."""

from __future__ import annotations

from itertools import permutations

from tocsin.llm import chat, divergence, filter_audit, licenses, quality, secret_scan

_DOCS = "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"

TOP_K = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, o.vec_id, CAST(list_dot_product(q.e, o.e) AS BIGINT) AS score
  FROM v q JOIN v o ON q.vec_id <> o.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) t
WHERE rank <= 5"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def private_keys(order: int, kind: str) -> str:
    """Parts of a text behind each BEGIN, measured by the same patterns."""
    label, whole, named, stop, last = (
        _text(getattr(secret_scan, f"KEY_{x}")) for x in ("LABEL", "WHOLE", "NAMED", "STOP", "LAST")
    )
    begin, size = _text(secret_scan.BEGIN), len(secret_scan.BEGIN)
    body = lambda x: f"length(string_split_regex({x}, {stop})[1])"
    full = lambda x, n: f"CASE WHEN {n} > 0 THEN {n} + length(regexp_extract({x}[{n} + 1:], {last})) ELSE 0 END"
    return f"""SELECT r, {order} AS k, '{kind}' AS kind, start, start + {size} + (CASE WHEN whole > 0 THEN whole
    WHEN named > 0 AND m > 0 THEN label + named + {full("inner_rest", "m")} ELSE label + {full("rest", "n")} END) AS stop
FROM (SELECT *, {body("rest")} AS n, {body("inner_rest")} AS m FROM (SELECT *, rest[named + 1:] AS inner_rest FROM (
  SELECT *, length(regexp_extract(rest, {named})) AS named FROM (
  SELECT r, start, label, length(regexp_extract(part, {whole})) AS whole, part[label + 1:] AS rest FROM (
  SELECT r, start, part, length(regexp_extract(part, {label})) AS label FROM (
  SELECT r, i, part, sum(length(part) + {size}) OVER (PARTITION BY r ORDER BY i) - length(part) - 2 * {size} AS start FROM (
  SELECT r, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
    SELECT r, string_split(text, {begin}) AS parts FROM d) a0) a1) a2 WHERE i > 1) a3 WHERE label > 0) a4) a5) a6) a7"""


def secrets() -> str:
    """Matches and the text between them take turns, so their lengths add up to places."""
    kinds = []
    for order, rule in enumerate(secret_scan.RULES):
        if not rule.pattern:
            kinds.append(private_keys(order, rule.kind))
            continue
        pattern = _text(rule.pattern)
        enough = f"length(regexp_extract(m, {pattern}, {rule.group})) >= {rule.least}"
        kinds.append(f"""SELECT r, {order} AS k, '{rule.kind}' AS kind, upto - length(m) AS start, upto AS stop FROM (
  SELECT r, m, sum(length(m) + length(gaps[i])) OVER (PARTITION BY r ORDER BY i) AS upto FROM (
    SELECT r, string_split_regex(text, {pattern}) AS gaps, unnest(found) AS m, generate_subscripts(found, 1) AS i
    FROM (SELECT r, text, regexp_extract_all(text, {pattern}) AS found FROM d) f) g) h WHERE {enough}""")
    said = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, k, stop)"
    base = len(secret_scan.BASE)
    counts = ", ".join(
        f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE
    )
    return f"""WITH {_DOCS}, spans AS ({" UNION ALL ".join(kinds)})
SELECT d.doc_id, {counts}, sha256(coalesce({said} FILTER (WHERE k < {base}), '')) AS base_sha256,
  coalesce({said}, '') AS spans
FROM d LEFT JOIN spans s ON s.r = d.r GROUP BY d.r, d.doc_id"""


def quality_rules(limits: quality.Limits = quality.Limits()) -> str:
    low, high = limits.mean_word_length
    space = r"[ \t\n\x0b\f\r]"
    lines = f"list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{space[1:]}'))"
    symbols = "[" + "".join("\\" + c for c in quality.SYMBOLS) + "]"
    return f"""WITH {_DOCS},
w AS (
  SELECT r, doc_id, text, list_filter(string_split_regex(text, '{space}+'), lambda x: x <> '') AS words,
    CAST(length(regexp_replace(text, '{space}+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, {_text(symbols)}, '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS BIGINT) AS n_capitals,
    {lines} AS lines FROM d),
placed AS (SELECT r, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
windows AS (SELECT r, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM placed
            WINDOW p AS (PARTITION BY r ORDER BY i)),
often AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows WHERE c IS NOT NULL),
inside AS (SELECT r, count(DISTINCT i + k) AS n FROM often, (SELECT unnest([0, 1, 2]) AS k) o WHERE n > 1 GROUP BY r),
counted AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, word_chars, n_symbols, n_capitals,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(i.n, 0) AS n_repeat_words FROM w LEFT JOIN inside i ON i.r = w.r),
judged AS (
  SELECT *, n_words < {limits.least_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n_words AS base_failed
  FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols > word_chars * CAST({limits.symbols_per_char} AS DOUBLE)
    OR n_dup_lines > n_lines * CAST({limits.dup_line_share} AS DOUBLE)
    OR word_chars < n_words * CAST({low} AS DOUBLE) OR word_chars > n_words * CAST({high} AS DOUBLE)
    OR n_capitals > word_chars * CAST({limits.capital_share} AS DOUBLE)) AS kept
FROM judged"""


def _texts(words: list[str]) -> str:
    return "[" + ", ".join(map(_text, words)) + "]"


def license_scan() -> str:
    """Every place of every template's key phrases, without an index."""
    hits = []
    for t in licenses.TEMPLATES:
        lead, first = t.key_words[0], t.keys_at[0]
        same = " AND ".join(f"w[i + {j}] = {_text(x)}" for j, x in enumerate(lead))
        shifts = ["0"]
        for key, at in zip(t.key_words[1:], t.keys_at[1:], strict=True):
            place = f"i + {at - first} + s"
            shifts.append(
                f"list_filter({licenses.SHIFTS}, lambda s: {place} >= 1 AND w[{place}:{place} + {len(key) - 1}] = {_texts(key)})[1]"
            )
        found = f"list_filter(range(1, len(w) + 1), lambda i: {same})"
        placed = f"list_transform({found}, lambda i: {{'i': i - {first}, 'shifts': [{', '.join(shifts)}]}})"
        whole = f"list_filter({placed}, lambda p: len(list_filter(p.shifts, lambda s: s IS NULL)) = 0)"
        in_place = (
            f"list_filter(range(1, {len(t.words) + 1}), lambda j: len(list_filter(p.shifts, lambda s: "
            f"p.i + s + j - 1 >= 1 AND w[p.i + s + j - 1] = {_texts(t.words)}[j])) > 0)"
        )
        hits.append(
            f"list_transform({whole}, lambda p: {{'label': '{t.label}', 'base': {t.base}, 'start': p.i - 1, "
            f"'share': len({in_place}) / CAST({len(t.words)} AS DOUBLE)}})"
        )
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    separators = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def labels(found: str) -> str:
        return f"array_to_string(list_sort(list_distinct(list_transform({found}, lambda h: h.label))), ',')"

    return f"""WITH {_DOCS},
split AS (SELECT doc_id, list_filter(string_split_regex(translate(text, '{upper}', '{upper.lower()}'), '{separators}'),
  lambda x: x <> '') AS w FROM d),
found AS (SELECT doc_id, w, list_concat({", ".join(hits)}) AS hits FROM split),
parted AS (SELECT *, list_filter(hits, lambda h: h.base) AS base FROM found)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base,
  list_min(list_transform(base, lambda h: h.start)) AS first_word,
  list_max(list_transform(base, lambda h: h.start)) AS last_word,
  {labels("base")} AS base_labels, {labels("hits")} AS labels,
  coalesce(list_max(list_transform(hits, lambda h: h.share)), 0.0) AS score
FROM parted"""


def filter_audit_sql() -> str:
    """Every order of the filters, each step's documents counted from the masks anew."""
    letters = filter_audit.LETTERS
    steps = " UNION ALL ".join(
        f"SELECT '{''.join(order)}' AS filter_order, {i + 1} AS step, {sum(map(filter_audit.bit, order[:i]))} AS applied, "
        f"{filter_audit.bit(order[i])} AS b"
        for order in permutations(letters)
        for i in range(len(letters))
    )
    return f"""WITH known AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS m
  FROM d LEFT JOIN known USING (doc_id)),
cells AS (SELECT part, m, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM masks GROUP BY part, m),
steps AS ({steps}),
found AS (
  SELECT part, filter_order, step, b,
    coalesce(sum(n) FILTER (WHERE m & (applied | b) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE m & applied = 0 AND m & b <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE m & applied <> 0 AND m & b <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE m = b), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE m & applied = 0 AND m & b <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE m & applied = 0 AND m & b <> 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, b)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
FROM found"""


def chat_sql() -> str:
    """The digests of the texts as they are: what a template that loses nothing must give back."""
    controls = "|".join(chat.CONTROLS)
    known = " ".join(f"WHEN '{role}' THEN {len(control) + 1}" for role, control in chat.ROLES.items())
    named = len(chat.RENDERED[-3]) + len(chat.RENDERED[-2])

    def escaped(column: str) -> str:
        return f"length({column}) + len(regexp_extract_all({column}, '{controls}'))"

    return f"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
sized AS (SELECT *, {escaped("text")} + {len(chat.RENDERED[-1])}
  + CASE role {known} ELSE {named} + {escaped("role")} END AS chars FROM t),
said AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(chars) AS chars FROM sized GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM said"""


def divergence_sql() -> str:
    """Every kept term in every group, and every pair of groups over all kept terms."""
    upper = divergence.CAPITALS
    return f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
words AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (coalesce(t.total, 0) + s.v)::HUGEINT AS p
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN totals t USING (lang, source)
  LEFT JOIN counts c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 1)::HUGEINT) // (any_value(total) + any_value(v))::HUGEINT AS q
  FROM counts JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) USING (lang) JOIN sizes USING (lang)
  GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN pairs x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
WHERE part = 'pair' OR rank <= 200"""


ORACLES = {
    "op3_topk": TOP_K,
    "op5_secrets": secrets(),
    "op7_quality": quality_rules(),
    "op8_licenses": license_scan(),
    "op11_filter_audit": filter_audit_sql(),
    "op12_chat": chat_sql(),
    "op13_divergence": divergence_sql(),
}
