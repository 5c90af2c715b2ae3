"""The watch rules as DuckDB SQL, made from the same fixed values: a row for each brand that a text names, then plain joins and folds.

RE2 has no lookaround. A place is the length of what a lazy group before the
pattern takes; \\b is ASCII there as in the rules; the one lookbehind of the
dictionary becomes a second pattern that must not match.
"""

from __future__ import annotations

from tallyrill.functions import watches as W

FAR = (1 << 31) - 1
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
_THE = r"(?<!\bthe\s)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _has(t: str, pattern: str, flags: str = "i") -> str:
    fine = f"regexp_matches({t}, {_q(pattern.replace(_THE, ''))}, '{flags or 'c'}')"
    if _THE in pattern:
        fine += f" AND NOT regexp_matches({t}, {_q(pattern.replace(_THE, chr(92) + 'bthe' + chr(92) + 's'))}, '{flags or 'c'}')"
    return fine


def _any(t: str, patterns: tuple[str, ...], flags: str = "i") -> str:
    return _has(t, "|".join(f"(?:{p})" for p in patterns), flags)


def _parts(t: str, pattern: str, flags: str) -> str:
    """A struct a (what is before the first match), b (the match)."""
    return f"regexp_extract({t}, {_q(f'(?s{flags})^(.*?)({pattern.replace(_THE, str())})')}, ['a', 'b'])"


def _trim(t: str) -> str:
    return f"trim({t}, {_SPACE})"


def spans(texts: str) -> str:
    """CTEs from texts (k, t: trimmed and not null): spans (k, i, name, start, stop) and limits (k, far)."""
    rows = []
    for i, b in enumerate(W.BRANDS):
        for n, (p, f) in enumerate(W.brand_patterns(b)):
            guard = f"contains(low, {_q(b[1][n].lower())}) AND " if n < len(b[1]) else ""
            rows.append(f"SELECT k, {i} AS i, {_q(b[0])} AS name, {_parts('t', p, f)} AS m FROM low WHERE {guard}{_has('t', p, f)}")
    compares = "|".join(f"(?:{p})" for p in W.COMPARISON)
    return f"""low AS (SELECT k, t, lower(t) AS low FROM {texts}),
each AS ({" UNION ALL ".join(rows)}),
spans AS (SELECT k, i, name, s.a AS start, s.a - s.less AS stop FROM (SELECT k, i, name, min(struct_pack(a := length(m.a), less := -length(m.b))) AS s FROM each GROUP BY k, i, name)),
limits AS (SELECT k, CASE WHEN {_has('t', compares)} THEN length({_parts('t', compares, 'i')}.a) ELSE {FAR} END AS far FROM low)"""


def parsed(texts: str) -> str:
    """CTEs from texts (k, t) to parsed (k, brand, reference)."""
    rows = []
    for i, b in enumerate(W.BRANDS):
        rest = "t"
        for p, f in W.brand_patterns(b):
            rest = f"regexp_replace({rest}, {_q(p.replace(_THE, ''))}, ' ', 'g{f}')"
        tries = []
        for p, f in b[3] or W.ANY_REFERENCE:
            word = _trim(f"regexp_extract(rest, {_q(p)}, 0, '{f or 'c'}')")
            noise = f"lower({word}) IN ({', '.join(map(_q, W.NOISE))}) OR {_has(f'lower({word})', W.NOISE_SHAPES)}"
            tries.append(f"CASE WHEN {_has('rest', p, f)} AND NOT ({noise}) THEN upper({word}) END")
        rows.append(f"SELECT k, {_q(b[0])} AS brand, coalesce({', '.join(tries)}, NULL) AS reference FROM (SELECT k, {rest} AS rest FROM best JOIN low USING (k) WHERE i = {i})")
    hints = ", ".join(f"CASE WHEN {_has('t', p)} THEN struct_pack(brand := {_q(n)}, reference := upper(regexp_extract(t, {_q(p)}, 0, 'i'))) END" for n, p in W.HINTS)
    score = f"greatest({W.LEAST_LENGTH}, stop - start) * {W.PER_CHARACTER} + CASE WHEN start < {W.EARLY} THEN {W.EARLY_BONUS} ELSE 0 END + CASE WHEN start >= far THEN {W.COMPARED} ELSE 0 END"
    return f"""{spans(texts)},
best AS (SELECT k, min(struct_pack(less := -({score}), start := start, i := i)).i AS i FROM spans JOIN limits USING (k) GROUP BY k),
parsed AS ({" UNION ALL ".join(rows)} UNION ALL SELECT k, h.brand, h.reference FROM (SELECT k, coalesce({hints}) AS h FROM low ANTI JOIN best USING (k)))"""


def offered(texts: str) -> str:
    """CTEs from texts (k, t) to offered (k, brands: a sorted list)."""
    kept = "list_reduce(list_sort(list(struct_pack(less := start - stop, start := start, name := name, stop := stop))), lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: x.start < y.stop AND y.start < x.stop)) > 0 THEN kept ELSE list_append(kept, x) END, CAST([] AS STRUCT(less BIGINT, \"start\" BIGINT, name VARCHAR, stop BIGINT)[]))"
    return f"""{spans(texts)},
offered AS (SELECT k, list_sort(list_transform({kept}, lambda x: x.name)) AS brands FROM spans JOIN limits USING (k) WHERE start < far GROUP BY k)"""


def without_trades(t: str) -> str:
    bare = _trim("line")
    sale = f"({_has('line', W.SALE_HEADER)} OR {_has(bare, r'^' + chr(92) + '$' + chr(92) + 's*' + chr(92) + 'd')})"
    step = f"""CASE WHEN a.skip AND {sale} THEN struct_pack(skip := false, lines := list_append(a.lines, line)) WHEN a.skip THEN struct_pack(skip := {bare} <> '', lines := a.lines)
      WHEN {_has('line', W.TRADE_HEADER)} THEN struct_pack(skip := true, lines := a.lines) ELSE struct_pack(skip := false, lines := list_append(a.lines, line)) END"""
    return f"array_to_string(list_reduce(list_transform(regexp_split_to_array({t}, '\\r?\\n'), lambda x: struct_pack(skip := false, lines := [x])), lambda a, b: list_transform([b.lines[1]], lambda line: {step})[1], struct_pack(skip := false, lines := CAST([] AS VARCHAR[]))).lines, chr(10))"


WHOLE = "array_to_string(list_filter([title, description], lambda x: coalesce(x, '') <> ''), chr(10) || chr(10))"
#: Distinct texts are looked at once.
PARSE = f""", texts AS (SELECT title AS k, {_trim('title')} AS t FROM (SELECT DISTINCT title FROM listings)), {parsed('texts')}
SELECT id, brand, reference FROM (SELECT id, title FROM listings) LEFT JOIN parsed ON title = k"""



def offers(rows: str) -> str:
    """CTEs from rows (k: a whole text) to offered (k, brands), trade wishes left out."""
    return f"""texts AS (SELECT k, {_trim(without_trades('k'))} AS t FROM (SELECT DISTINCT k FROM {rows})), {offered('texts')}"""


HITS = f""", wholes AS (SELECT {WHOLE} AS k FROM listings), {offers('wholes')} SELECT id, coalesce(array_to_string(brands, ','), '') AS brands FROM (SELECT id, {WHOLE} AS k FROM listings) LEFT JOIN offered USING (k)"""


def counts(texts: str) -> str:
    """A CTE counted (k) of the texts (k, m: lower case) whose 'x2' counts watches: a row for each match, with what is before and behind it."""
    x = _q(r"\bx\s*(\d+)\b")
    size = [_has("b", r"[0-9]+(?:\.[0-9]+)?\s*$", ""), "regexp_matches(e, '^\\.[0-9]')", _has("e", r"^\s*[0-9]+(?:\.[0-9]+)?\s*(?:mm|cm|\"|''|in(?:ch|ches)?)\b", ""), _has("b", r"(?:mm|cm)\s*$")]
    links = f"({_has('tail', chr(92) + 'blinks?' + chr(92) + 'b')} AND NOT {_has('behind_links', W.LISTING_ANCHOR)})"
    return f"""split AS (SELECT k, regexp_split_to_array(m, {x}) AS p, regexp_extract_all(m, {x}) AS f FROM {texts} WHERE regexp_matches(m, {x})),
pieces AS (SELECT k, n, list_reduce(list_transform(range(1, n + 1), lambda j: p[j] || CASE WHEN j < n THEN f[j] ELSE '' END), lambda a, y: a || y) AS b,
    list_reduce(list_transform(range(n + 1, len(f) + 2), lambda j: p[j] || coalesce(f[j], '')), lambda a, y: a || y) AS e FROM (SELECT k, p, f, unnest(range(1, len(f) + 1)) AS n FROM split)),
tails AS (SELECT *, right(regexp_extract(b, '[^\\n]*$'), 80) AS tail FROM pieces),
counted AS (SELECT DISTINCT k FROM (SELECT *, regexp_split_to_array(tail, '(?i)\\blinks?\\b')[-1] AS behind_links FROM tails) WHERE NOT ({' OR '.join(size)} OR {_has('tail', W.ACCESSORY_BEFORE)} OR {links}))"""


def _masked(t: str) -> str:
    for p in W.SELLER_BIO:
        t = f"regexp_replace({t}, {_q(p)}, ' ', 'g')"
    return t


BUNDLES = f""", asked AS (SELECT DISTINCT title, description FROM listings),
whole AS (SELECT title, description, {_trim("coalesce(title, '')")} AS head, array_to_string(list_filter([{_trim("coalesce(title, '')")}, {_trim("coalesce(description, '')")}], lambda x: x <> ''), chr(10) || chr(10)) AS w FROM asked),
offer AS (SELECT *, regexp_replace({without_trades('w')}, '\\br/[\\w-]+\\b', ' ', 'gi') AS o FROM whole),
texts AS (SELECT DISTINCT o AS k, {_trim('o')} AS t FROM offer), {offered('texts')},
masked AS (SELECT *, {_masked('lower(o)')} AS m FROM offer),
asked_counts AS (SELECT DISTINCT o AS k, m FROM masked), {counts('asked_counts')},
judged AS (SELECT title, description, w <> '' AND (regexp_matches(regexp_replace(m, {_q(W.ACCESSORY_BUNDLE)}, ' ', 'g'), '\\bbundles?\\b') OR (regexp_matches(m, '\\bwholesale\\b') AND (regexp_matches(m, {_q(W.WHOLESALE_LOT)}) OR {_any('m', W.COUNTED, '')}))
    OR {_any('m', W.LOT, '')} OR {_any('m', W.SEVERAL)} OR o IN (SELECT k FROM counted) OR length(head) - length(replace(head, '/', '')) >= 3 OR (regexp_matches(o, '[,/+]') AND len(coalesce(brands, [])) >= 2)) AS is_bundle
  FROM masked LEFT JOIN offered ON o = k)
SELECT l.id, j.is_bundle FROM listings l JOIN judged j ON l.title = j.title AND l.description IS NOT DISTINCT FROM j.description"""
