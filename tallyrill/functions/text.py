"""Signals in listing texts: prices, sold marks, states, conditions, eras. All are Columns, evaluated on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import any_like, any_of, bind, first_group, js, like, may_match, replace
from .scalars import half_up

# ---- fixed values -------------------------------------------------------------------------------------------------
_AMOUNT = r"(\d[\d,]*(?:\.\d{2})?)"
_GROUPED = r"\d{1,3}(?:,\d{3})+(?:\.\d{2})?"
#: (pattern, flags, least, least included, factor), in the order in which they are tried.
PRICES = (
    (rf"\bprice\s*:\s*\$?\s*{_AMOUNT}usd\b", "i", 10, True, 1),
    (rf"\bprice\s*:\s*\$?\s*{_AMOUNT}\s+usd\b", "i", 10, True, 1),
    (rf"\bprice\s*:\s*\$\s*{_AMOUNT}\b", "i", 10, True, 1),
    (rf"\bprice\s*:\s*{_AMOUNT}\b", "i", 10, True, 1),
    (r"\$\s*(\d+(?:\.\d+)?)\s*k\b", "i", 20, False, 1000),
    (rf"\$\s*({_GROUPED})", "", 10, True, 1),
    (r"\$\s*(\d{2,7}(?:\.\d{2})?)", "", 10, True, 1),
    (rf"({_GROUPED}|\d{{2,7}}(?:\.\d{{2}})?)\s*\$", "", 10, True, 1),
    (rf"\b(?:asking|price|obo|usd|shipped|firm|sale)\b\s*[:\-]?\s*\$?\s*({_GROUPED}|\d{{3,7}}(?:\.\d{{2}})?)", "i", 50, False, 1),
    (rf"({_GROUPED}|\d{{3,7}}(?:\.\d{{2}})?)\s*(?:usd|shipped|obo|firm)\b", "i", 50, False, 1),
)
PRICE_LIMIT = 10_000_000
FLAIR_RANGE = r"\$\s*(\d+(?:\.\d+)?)\s*(k)?\s*(?:-|–|—|to)\s*\$?\s*(\d+(?:\.\d+)?)\s*(k)?"
FLAIR_UNDER = r"(?:under|below|<|less than)\s*\$?\s*(\d+(?:\.\d+)?)\s*(k)?"
FLAIR_OVER = r"(?:over|above|>|more than)?\s*\$\s*(\d+(?:\.\d+)?)\s*(k)?\s*\+?"
SOLD_BRACKET = r"\[\s*sold(?:\s+pending)?\s*\]"
SOLD_TITLE = (SOLD_BRACKET, r"(^|\s)sold\s*[:\-]", r"[\s\-]sold\s*$")
SOLD_COMMENT = (SOLD_BRACKET, r"\bsold\s*[!.]", r"\bsold\s+to\b", r"\bhas\s+been\s+sold\b", r"\bthanks[,.!]?\s+sold\b")
SCORE = r"\b(?:condition\s*[:\-–]?\s*)?(\d+(?:\.\d)?)\s*\/\s*10\b"
UNWORN_CAPITALS = (r"\bBNIB\b", r"\bLNIB\b", r"\bNOS\b")
UNWORN = (
    r"\bunworn\b", r"\bnever[\s-]?(?:really\s+)?worn\b", r"\bnever[\s-]?(?:really\s+)?used\b", r"\bunused\b", r"\bbrand[\s-]new\b",
    r"\bnew\s+(?:condition|in\s+box)\b", r"\bin\s+new\s+condition\b", r"\bnew[\s/]old\s+stock\b", r"\btags?\s+(?:still\s+)?attached\b",
    r"\bstill\s+in\s+(?:plastic|wrap)\b", r"\bnever\s+(?:been\s+)?paired\b",
)
VERY_GOOD_SAID = (r"\bvery\s+good\s+(?:pre[\s-]?owned\s+)?condition\b", r"\bcondition\s*:\s*very\s+good\b", r"\boverall\s+(?:is\s+)?very\s+good\b")
EXCELLENT = (
    r"\bmint\s+condition\b", r"\bminty\s+condition\b", r"\bnear[\s-]mint\b", r"\bminty\b", r"\blike[\s-]new\b", r"\bhardly[\s-](?:worn|used)\b",
    r"\brarely[\s-](?:worn|used)\b", r"\bsafe[\s-]queen\b", r"\bno\s+(?:visible\s+)?scratches?\b", r"\bpristine\b", r"\bimmaculate\b",
    r"\bperfect\s+condition\b", r"\bbeautiful\s+(?:\w+\s+)?condition\b",
)
FLAWLESS, NOT_FLAWLESS = r"\bflawless\b", r"\bworn\s+(?:a\s+)?(?:fair|good)\s+(?:bit|amount)\b"
VERY_GOOD_CAPITALS = (r"\bVG\+?\b",)
VERY_GOOD = (
    r"\bexcellent\s+condition\b", r"\bexcellent\b", r"\blightly[\s-](?:worn|used)\b", r"\blight\s+(?:wear|use|scratches?|scuffs?)\b",
    r"\bminimal\s+(?:wear|signs?\s+of\s+wear|scratches?|scuffs?|marks?)\b", r"\bminor\s+(?:wear|scratches?|scuffs?|marks?|signs?\s+of\s+(?:wear|use))\b",
    r"\bvery\s+good\s+condition\b", r"\bgreat\s+(?:condition|shape)\b", r"\bwell[\s-](?:maintained|kept|cared[\s-]for)\b",
    r"\bclean\s+(?:condition|watch|piece|crystal|dial)\b", r"\bvery\s+clean\b", r"\bhairlines?\b",
)
FAIR_SAID = (r"\bin\s+fair\s+condition\b", r"\bfair\s+condition\b")
GOOD = (
    r"\bgood\s+(?:condition|shape|original\s+condition)\b", r"\bcondition\s*:\s*good\b", r"\boverall\s+(?:is\s+)?good\b", r"\bnormal\s+(?:wear|use)\b",
    r"\bregular\s+(?:wear|use)\b", r"\bdaily[\s-](?:driver|wear|worn|wearer)\b", r"\bsome\s+(?:scratches?|scuffs?|wear|marks?)\b", r"\bwear\s+marks?\b",
    r"\bscratches?\s+on\b", r"\bbeen[\s-]worn\b", r"\bworn\s+(?:well|daily|regularly|frequently|a\s+fair\s+bit)\b", r"\beveryday\s+(?:wear|use)\b",
    r"\bsigns?\s+of\s+(?:wear|use)\b", r"\bwell[\s-]worn\b", r"\bdesk[\s-]?(?:diver|diving)\s+marks?\b", r"\bdesk[\s-]?diver\b",
)
FAIR = (
    r"\bbeater\b", r"\bproject\s+watch\b", r"\bfor\s+parts\b", r"\bheavy\s+(?:wear|scratches?|use)\b", r"\bneeds?\s+(?:service|repair|polish)\b",
    r"\brough\s+(?:condition|shape)\b", r"\bworn\s+hard\b", r"\bfixer[\s-]upper\b", r"\bdamage[ds]?\b", r"\bdent(?:s|ed)?\b", r"\bcracks?\b", r"\bbroken\b",
    r"\bnot\s+(?:running|working|keeping\s+time)\b", r"\bcrown\s+issues?\b", r"\brunning\s+issues?\b", r"\bcrown\s+doesn'?t\b",
    r"\b(?:serious\s+)?running\s+problems?\b",
)
OLD_YEAR = r"\b(?:193\d|194\d|195\d|196\d|197[0-8]|198[0-5])\b"
OLD_YEAR_BRANDS = r"\b(omega|rolex|seiko|tudor|longines|iwc|cartier|hamilton|zenith|jaeger|breitling|movado|zodiac|oris|universal|heuer|timex)\b"
GONE = ("[deleted]", "[removed]", "deleted", "removed")
REFERENCE_SHAPES = (r"\b\d{4,6}[A-Z]{0,4}(?:-\d{1,4})?\b", r"\b[A-Z]{2,4}\d{3,6}[A-Z0-9]*\b", r"\b\d{3,5}-\d{3,5}[A-Z0-9]*\b")
#: Codes of item conditions.
CONDITION_CODES = {
    "1000": "new", "1500": "unworn", "1750": "unworn", "2000": "used", "2010": "used", "2020": "used", "2030": "used", "2500": "used", "2750": "used",
    "3000": "used", "4000": "used", "5000": "used", "6000": "used", "7000": "used",
}
CURRENCIES = {"$": "USD", "US$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
# -------------------------------------------------------------------------------------------------------------------


def _given(*texts: Column) -> Column:
    return F.filter(F.array(*texts), lambda t: F.coalesce(t, F.lit("")) != "")


def joined(separator: str, *texts: Column) -> Column:
    """The texts that are there, joined; empty if none is."""
    return F.array_join(_given(*texts), separator)


def plain_digits(text: Column) -> Column:
    """Keycap digits as digits."""
    return F.when(F.contains(text, F.lit("\u20e3")), F.regexp_replace(text, r"(\d)\x{FE0F}?\x{20E3}", "$1")).otherwise(text)


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def _cents(least: float, included: bool):
    return lambda n: F.when(((n >= least) if included else (n > least)) & (n < PRICE_LIMIT), half_up(n * 100))


def _price(text: Column) -> Column:
    def first(s: Column) -> Column:
        tries = []
        for pattern, flags, least, included, factor in PRICES:
            number = _number(F.regexp_extract(s["t"], js(pattern, flags), 1)) * factor
            tries.append(F.when(may_match(s["low"], pattern), bind(number, _cents(least, included))))
        return F.coalesce(*tries)

    return bind(plain_digits(text), lambda t: bind(F.struct(t.alias("t"), F.lower(t).alias("low")), first))


def usd_price_cents(*texts: Column) -> Column:
    """The price in cents; texts after the first that tell of a price change come first."""

    def of(given: Column) -> Column:
        tail = F.array_join(F.slice(given, 2, len(texts)), " \n ")
        change = r"\bprice\s+change\b"
        changed = lambda t: F.when(may_match(F.lower(t), change) & like(t, change, "i"), _price(t))
        return F.coalesce(bind(tail, changed), _price(F.array_join(given, " \n ")))

    return bind(_given(*texts), of)


def flair_range(flair: Column) -> Column:
    """A struct min_cents, max_cents, mid_cents of a price bucket; null if it is none."""
    make = lambda a, b, m: F.struct(a.alias("min_cents"), b.alias("max_cents"), half_up(m * 100).alias("mid_cents"))
    none = F.lit(None).cast("bigint")

    def of(f: Column) -> Column:
        number = lambda pattern, n, k: _number(F.regexp_extract(f, js(pattern), n)) * F.when(F.regexp_extract(f, js(pattern), k) != "", 1000).otherwise(1)
        fits = lambda x: (x > 0) & (x < PRICE_LIMIT)
        between = lambda r: F.when((r["b"] >= r["a"]) & (r["b"] < PRICE_LIMIT), make(half_up(r["a"] * 100), half_up(r["b"] * 100), (r["a"] + r["b"]) / 2))
        under = lambda x: F.when(fits(x), make(none, half_up(x * 100), x / 2))
        over = lambda x: F.when(fits(x) & f.rlike(r"\+|over|above|>|more than"), make(half_up(x * 100), none, x))
        return F.coalesce(
            bind(F.struct(number(FLAIR_RANGE, 1, 2).alias("a"), number(FLAIR_RANGE, 3, 4).alias("b")), between),
            bind(number(FLAIR_UNDER, 1, 2), under),
            bind(number(FLAIR_OVER, 1, 2), over),
        )

    return bind(F.lower(F.replace(flair, F.lit(","), F.lit(""))), of)


def is_sold(title: Column, flair: Column | None = None, comment: Column | None = None) -> Column:
    parts = any_like(F.trim(title), SOLD_TITLE)
    if flair is not None:
        parts = parts | F.coalesce(like(flair, r"\bsold\b", "i"), F.lit(False))
    if comment is not None:
        parts = parts | F.coalesce(any_like(comment, SOLD_COMMENT) | like(comment, r"^\s*sold\s*$", "im"), F.lit(False))
    return F.coalesce(parts, F.lit(False))


def us_state(title: Column) -> Column:
    """Of the first bracket that is two capitals, or has two after a comma."""
    inside = F.regexp_extract_all(title, F.lit(r"\[([^\]]{1,40})\]"), F.lit(1))
    found = F.transform(inside, lambda t: F.when(F.trim(t).rlike(r"^[A-Z]{2}\z"), F.trim(t)).otherwise(first_group(t, r",\s*([A-Z]{2})\b")))
    return F.try_element_at(F.array_compact(found), F.lit(1))


def condition(*texts: Column) -> Column:
    """unworn, excellent, very good, good, fair or null."""

    def by_words(s: Column) -> Column:
        said = lambda patterns, flags="i": any_of(s["t"], s["low"], patterns, flags)
        return (
            F.when(said(UNWORN_CAPITALS, "") | said(UNWORN), "unworn")
            .when(said(VERY_GOOD_SAID), "very good")
            .when(said(EXCELLENT) | (said((FLAWLESS,)) & ~said((NOT_FLAWLESS,))), "excellent")
            .when(said(VERY_GOOD) | said(VERY_GOOD_CAPITALS, ""), "very good")
            .when(said(FAIR_SAID), "fair")
            .when(said(GOOD), "good")
            .when(said(FAIR), "fair")
        )

    def of(s: Column) -> Column:
        score = F.when(F.contains(s["t"], F.lit("10")), first_group(s["t"], SCORE, "i").try_cast("double"))
        by_score = lambda n: F.when(n >= 10, "unworn").when(n >= 9.5, "excellent").when(n >= 8.5, "very good").when(n >= 7, "good").when(n > 0, "fair")
        return F.coalesce(bind(score, by_score), by_words(s))

    return bind(joined(" ", *texts), lambda t: bind(F.struct(t.alias("t"), F.lower(t).alias("low")), of))


def watch_type(*texts: Column) -> Column:
    """vintage or null."""

    def of(s: Column) -> Column:
        t, low = s["t"], s["low"]
        vintage = F.contains(low, F.lit("vintage")) & like(replace(t, r"\bvintage\s+style\b", " ", "i"), r"\bvintage\b", "i")
        said = vintage | any_of(t, low, (r"\bantique\b",)) | any_of(t, low, (r"\bNOS\b",), "")
        old = any_of(t, low, (OLD_YEAR_BRANDS,)) & like(t, OLD_YEAR)
        return F.when(said | old, "vintage")

    return bind(joined(" ", *texts), lambda t: bind(F.struct(t.alias("t"), F.lower(t).alias("low")), of))


def clean_title(title: Column) -> Column:
    return F.trim(replace(F.regexp_replace(title, r"\[[^\]]*\]", " "), r"\s+", " "))


def usable_body(body: Column) -> Column:
    t = F.trim(body)
    return F.when(~F.lower(t).isin("", "[deleted]", "[removed]"), t)


def is_gone(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*GONE), F.lit(False))


def is_wts(stickied: Column, removed: Column, author: Column, title: Column, body: Column, flair: Column) -> Column:
    """A post that offers something and is still there."""
    there = ~F.coalesce(stickied, F.lit(False)) & (F.coalesce(removed, F.lit("")) == "") & ~is_gone(author) & ~is_gone(title) & ~is_gone(body)
    return there & ((F.upper(F.coalesce(flair, F.lit(""))) == "WTS") | F.coalesce(like(title, r"^\s*\[wts\]", "i"), F.lit(False)))


def image_of(preview: Column, gallery: Column, thumbnail: Column) -> Column:
    return F.coalesce(preview, F.get(gallery, F.lit(0)), F.when(F.lower(thumbnail).startswith("http"), thumbnail))


def condition_of_code(code: Column, said: Column) -> Column:
    c = F.lower(F.coalesce(said, F.lit("")))
    by_code = F.create_map(*[F.lit(x) for pair in CONDITION_CODES.items() for x in pair])[code]
    by_words = (
        F.when(c.contains("new with tag") | (c == "new"), "new").when(c.contains("open box") | c.contains("unworn"), "unworn")
        .when(c.contains("pre-owned") | c.contains("used") | c.contains("refurb"), "used").when(c.contains("vintage"), "vintage")
    )
    return F.coalesce(by_code, by_words)


def currency_of(symbol: Column) -> Column:
    """ISO code of a symbol; of others three capitals as they are, else USD."""
    t = F.trim(symbol)
    known = F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair])[t]
    return F.coalesce(known, F.when(t.rlike(r"^[A-Z]{3}\z"), t), F.lit("USD"))


def minor_units(amount: Column, currency: Column) -> Column:
    """Cents; of yen, whole yen."""
    return half_up(F.when(currency == "JPY", amount).otherwise(amount * 100))


def feed_price_cents(text: Column) -> Column:
    """Of a feed's price cell; a cell that is only a currency is 0, as an empty number is."""
    number = F.regexp_replace(F.regexp_replace(text, js(r"[$€£,\s]"), ""), "(?i)USD|EUR|GBP", "")
    return half_up(F.when(number == "", F.lit(0.0)).otherwise(number.try_cast("double")) * 100)


def catalog_price_cents(text: Column) -> Column:
    return half_up(F.nullif(F.trim(text), F.lit("")).try_cast("double") * 100)


def catalog_state(country: Column, state: Column) -> Column:
    return F.when((country == "US") & F.trim(state).rlike(r"^[A-Z]{2}\z"), F.trim(state))


def normal_text(title: Column, body: Column) -> Column:
    """Input of the text models: title and 2000 characters of the body, lower case, without links and tags, prices as one token."""
    t = F.lower(F.concat_ws(" ", title, F.when(body != "", F.substring(body, 1, 2000))))
    t = replace(t, r"https?:\/\/\S+", " ")
    t = F.regexp_replace(t, r"\[[^\]]*\]", " ")
    t = F.regexp_replace(t, r"\$[\d,]+(?:\.\d{2})?", " _PRICE_ ")
    return F.trim(replace(t, r"\s+", " "))


def reference_candidates(title: Column) -> Column:
    """Strings shaped like a reference, in order of the shapes, each once, no years."""
    found = F.concat(*[F.regexp_extract_all(title, F.lit(js(p)), F.lit(0)) for p in REFERENCE_SHAPES])
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.rlike(r"^(19|20)\d{2}\z")))
