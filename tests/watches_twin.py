"""The watch rules in plain Python, one text at a time: what the SQL expressions are compared with."""

import re
from functools import cache

from tallyrill.functions.regex import py
from tallyrill.functions.watches import (
    ACCESSORY_BEFORE, ACCESSORY_BUNDLE, ANY_REFERENCE, BRANDS, COMPARED, COMPARISON, COUNTED, EARLY, EARLY_BONUS, HINTS, LEAST_LENGTH, LISTING_ANCHOR, LOT, NOISE, NOISE_SHAPES, PER_CHARACTER, SALE_HEADER, SELLER_BIO, SEVERAL, TRADE_HEADER, WHOLESALE_LOT,
)

_JS_SPACE = "\t\n\x0b\x0c\r " + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def _any(patterns: tuple[str, ...], flags: str = "i") -> re.Pattern:
    return py("|".join(f"(?:{p})" for p in patterns), flags)


@cache
def _rules():
    """All compiled patterns."""
    brands = []
    for name, terms, patterns, references in BRANDS:
        found = [py(f"(?:^|[^a-z0-9]){re.escape(t)}(?:$|[^a-z0-9])", "i") for t in terms]
        # Python wants lookbehinds of one width, which an edge and a single space have
        found += [py(p, f) for p, f in patterns]
        brands.append((name, found, [py(p, f) for p, f in (references or ANY_REFERENCE)]))
    one = lambda p, f="i": py(p, f)
    return {
        "brands": brands, "hints": [(n, one(p)) for n, p in HINTS], "comparison": _any(COMPARISON), "noise": one(NOISE_SHAPES), "trade": one(TRADE_HEADER),
        "sale": one(SALE_HEADER), "dollars": one(r"^\$\s*\d"), "x": one(r"\bx\s*(\d+)\b", ""), "before_number": one(r"\d+(?:\.\d+)?\s*$", ""),
        "unit_after": one(r"^\s*\d+(?:\.\d+)?\s*(?:mm|cm|\"|''|in(?:ch|ches)?)\b", ""), "unit_before": one(r"(?:mm|cm)\s*$"), "accessory": one(ACCESSORY_BEFORE),
        "links": one(r"\blinks?\b"), "anchor": one(LISTING_ANCHOR), "kit": one(ACCESSORY_BUNDLE, ""), "lot": _any(LOT, ""), "bio": [one(p, "") for p in SELLER_BIO],
        "bundle": one(r"\bbundles?\b", ""), "wholesale": one(r"\bwholesale\b", ""), "wholesale_lot": one(WHOLESALE_LOT, ""), "counted": _any(COUNTED, ""),
        "several": _any(SEVERAL), "path": one(r"\br\/[\w-]+\b"), "plus": one(r"\s\+\s", ""),
    }


def _first_span(text: str, patterns: list[re.Pattern]) -> tuple[int, int] | None:
    """(start, end) of a brand's earliest match, the longest of those that start there."""
    spans = [m.span() for m in (p.search(text) for p in patterns) if m]
    return min(spans, key=lambda s: (s[0], -s[1])) if spans else None


def _brand_spans(text: str) -> tuple[list[tuple[int, str, int, int]], float]:
    """(place in the dictionary, brand, start, end) of each brand found, and where comparisons start."""
    rules = _rules()
    spans = [(i, name, *s) for i, (name, found, _) in enumerate(rules["brands"]) if (s := _first_span(text, found))]
    m = rules["comparison"].search(text) if spans else None
    return spans, m.start() if m else float("inf")


def brand_hits(text: str | None) -> list[str]:
    """Brands on offer, sorted: earliest spans before any comparison; of overlapping spans the longer stays, then the earlier."""
    text = (text or "").strip(_JS_SPACE)
    spans, limit = _brand_spans(text)
    kept: list[tuple[int, int, str]] = []
    for a, b, name in sorted(((a, b, n) for _, n, a, b in spans if a < limit), key=lambda s: (s[0] - s[1], s[0], s[2])):
        if not any(a < d and c < b for c, d, _ in kept):
            kept.append((a, b, name))
    return sorted(n for _, _, n in kept)


def watch_of(title: str | None) -> tuple[str | None, str | None]:
    """(brand, reference) of the watch that a title offers."""
    text = (title or "").strip(_JS_SPACE)
    rules = _rules()
    spans, limit = _brand_spans(text)
    if not spans:
        for brand, pattern in rules["hints"]:
            if m := pattern.search(text):
                return brand, m[0].upper()
        return None, None

    def rank(s: tuple[int, str, int, int]) -> tuple[int, int, int]:
        i, _, a, b = s
        score = max(LEAST_LENGTH, b - a) * PER_CHARACTER + (EARLY_BONUS if a < EARLY else 0) + (COMPARED if a >= limit else 0)
        return -score, a, i

    name, found, references = rules["brands"][min(spans, key=rank)[0]]
    rest = text
    for p in found:
        rest = p.sub(" ", rest)
    for p in references:
        if m := p.search(rest):
            word = m[0].strip(_JS_SPACE)
            if word.lower() not in NOISE and not rules["noise"].search(word.lower()):
                return name, word.upper()
    return name, None


def without_trades(text: str) -> str:
    """The lines but those of sections that tell what the seller would take in trade."""
    rules, out, skipping = _rules(), [], False
    for line in re.split("\r?\n", text):
        bare = line.strip(_JS_SPACE)
        if skipping:
            if rules["sale"].search(line) or rules["dollars"].search(bare):
                skipping = False
                out.append(line)
            elif not bare:
                skipping = False
        elif rules["trade"].search(line):
            skipping = True
        else:
            out.append(line)
    return "\n".join(out)


def has_count(text: str) -> bool:
    """Whether an 'x2' counts watches: not sizes, not accessories. text: lower case."""
    rules = _rules()
    for m in rules["x"].finditer(text):
        before, after = text[: m.start()], text[m.end() :]
        if rules["before_number"].search(before) or re.match(r"\.[0-9]", after) or rules["unit_after"].search(after) or rules["unit_before"].search(before.rstrip(_JS_SPACE)):
            continue
        tail = before[before.rfind("\n") + 1 :][-80:]
        if rules["accessory"].search(tail.rstrip(_JS_SPACE)):
            continue
        links = list(rules["links"].finditer(tail))
        if links and not rules["anchor"].search(tail[links[-1].end() :]):
            continue
        return True
    return False


def is_bundle(title: str | None, *others: str | None) -> bool:
    """Whether a listing offers several watches."""
    rules = _rules()
    title = (title or "").strip(_JS_SPACE)
    whole = "\n\n".join(t for t in [title, *((x or "").strip(_JS_SPACE) for x in others)] if t)
    if not whole:
        return False
    offered = rules["path"].sub(" ", without_trades(whole))
    t = offered.lower()
    for p in rules["bio"]:
        t = p.sub(" ", t)
    counted = has_count(t)
    wholesale = rules["wholesale"].search(t) and (rules["wholesale_lot"].search(t) or rules["counted"].search(t))
    if rules["bundle"].search(rules["kit"].sub(" ", t)) or wholesale or rules["lot"].search(t) or rules["several"].search(t) or counted or title.count("/") >= 3:
        return True
    # any separator and two brands; a plus between spaces is one
    return any(c in offered for c in ",/+") and len(brand_hits(offered)) >= 2


