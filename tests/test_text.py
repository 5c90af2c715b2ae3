"""Golden rows of the text signals."""

import random

import pytest
from pyspark.sql import functions as F

from tallyrill.functions import scalars as S
from tallyrill.functions import text as T
from tallyrill.functions import watches as W
from tallyrill.functions.regex import bind, needles
from tests import watches_twin as twin


def one(spark, rows, make):
    width = max(len(r) for r in rows)
    names = [f"c{i}" for i in range(width)]
    df = spark.createDataFrame([(i, *r, *[None] * (width - len(r))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r["v"] for r in df.select("i", make(*[F.col(n) for n in names]).alias("v")).orderBy("i").collect()]


def test_prices(spark):
    rows = [
        ("Omega Seamaster Diver", "$6799 shipped CONUS"),
        ("Omega Speedmaster Professional $7,600",),
        ("[WTS] Omega Speedmaster 38mm $11,000", "Edit: price in title is correct — body typo $11,00"),
        ("[WTS]", "LM Linen Dial\nPrice: 320USD\nShipping: $50 USD"),
        ("SeikoDials mod — $800", "price change: $700 firm\nPayPal F&F preferred."),
        ("2024 Tudor Pelagos FXD M.N.24 Full Set $3️⃣,1️⃣0️⃣0️⃣ Shipped",),
        ("[WTS] Omega", "$3,1️⃣0️⃣0️⃣ shipped"),
        ("asking 4500", None),
        ("$4.8k", ""),
        ("$5 shipping only", None),
        (None, None),
    ]
    assert one(spark, rows, T.usd_price_cents) == [679900, 760000, 1100000, 32000, 70000, 310000, 310000, 450000, 480000, None, None]


def test_flair(spark):
    rows = [("$1000-$1999",), ("Under $500",), ("$10,000+",), ("WTS",), (None,), ("$100 - $50",)]
    got = one(spark, rows, T.flair_range)
    assert [g and (g.min_cents, g.max_cents, g.mid_cents) for g in got[:5]] == [(100000, 199900, 149950), (None, 50000, 25000), (1000000, None, 1000000), None, None]


def test_condition_and_era(spark):
    rows = [("Brand new 2025",), ("Vintage Style Waffle Strap",), ("serious running issues and crown doesn't screw down",), ("1969 Omega Seamaster Cosmic crosshair dial",), ("9.5/10",), ("0/10 mint condition",), ("BNIB",), ("bnib",), (None,)]
    assert one(spark, rows, T.condition) == ["unworn", None, "fair", None, "excellent", "excellent", "unworn", None, None]
    assert one(spark, rows, T.watch_type) == [None, None, None, "vintage", None, None, None, None, None]
    assert one(spark, [("1979 Omega",), ("1985 Rolex",), ("1960 dial",)], T.watch_type) == [None, "vintage", None]


def test_sold(spark):
    rows = [("Seiko", "WTS", "[SOLD] Thanks everyone!"), ("Seiko", "WTS", "sold to u/someone"), ("[SOLD PENDING] x", None, None), ("Seiko", "SOLD", None), ("Seiko", None, "almost sold on this"), ("Omega - sold", None, None)]
    assert one(spark, rows, T.is_sold) == [True, True, True, True, False, True]


def test_state(spark):
    rows = [("[WTS] [CA] x",), ("[WTS] [Los Angeles, CA]",), ("none",), (None,)]
    assert one(spark, rows, T.us_state) == ["CA", "CA", None, None]


def test_ascii_edges(spark):
    # a letter beyond ASCII is no word character in the dialect of the patterns
    assert one(spark, [("éNOS x",), ("xNOS",)], T.condition) == ["unworn", None]
    assert one(spark, [("brand new",)], T.condition) == ["unworn"]


@pytest.mark.parametrize(
    "title,brand,reference",
    [
        ("[WTS] Seiko Gold Tank 5933-5080", "Seiko", "5933-5080"),
        ("[WTS] Omega Geneve 166.0168", "Omega", "166.0168"),
        ("[WTS] Omega Seamaster 166.0167", "Omega", "166.0167"),
        ("[WTS] IWC Big Pilot Heritage IW501004", "IWC", "IW501004"),
        ("[WTS] Parmigiani Fleurier PFC912-1020001-100182", "Parmigiani Fleurier", "PFC912-1020001-100182"),
        ("[WTS] Fave Leuba Sea King automatic", "Favre Leuba", None),
        ("[WTS] Glashütte Original Senator Panorama", "Glashütte", None),
        ("[WTS] Glashutte Original Seventies", "Glashütte", None),
        ("[WTS] Glashutte Sixties Chronograph", "Glashütte", None),
        ("[WTS] Nomos Glashütte Orion 39", "Nomos", None),
        ("[WTS] Mühle-Glashütte S.A.R. Flieger", "Mühle-Glashütte", None),
        ("[WTS] Muhle Glashutte Terrasport", "Mühle-Glashütte", None),
        ("SBDL103 - Night Vision", "Seiko", "SBDL103"),
        ("", None, None),
        (None, None, None),
        ("nothing here", None, None),
    ],
)
def test_parse(spark, title, brand, reference):
    r = spark.createDataFrame([(title,)], "t string").select(W.parse_watch("t").alias("w")).first().w
    assert (r.brand, r.reference) == (brand, reference) == twin.watch_of(title)


def test_brand_hits(spark):
    expected = {
        "Grand Seiko Diver SBGA229": ["Grand Seiko"],
        "Rolex Submariner + Omega Speedmaster": ["Omega", "Rolex"],
        "Rolex/Tudor/Omega": ["Tudor"],  # neighbours share their separator
        "Tudor, looks like a Rolex": ["Tudor"],
        "": [],
        None: [],
    }
    rows = spark.createDataFrame([(t,) for t in expected], "t string").select("t", W.brand_list("t").alias("b")).collect()
    assert {r.t: r.b for r in rows} == expected == {t: twin.brand_hits(t) for t in expected}


TRADES = "Asking $5000.\n\nTrades: modern Rolex, AP, or Patek Philippe\n\nThanks"


@pytest.mark.parametrize(
    "title,body,expected",
    [
        ("Glashütte Original Senator", "selling this at WHOLESALE for $9,800 — single piece from AD.", False),
        ("Omega Speedmaster", "I sell a lot of watches, see r/tudor, references on request", False),
        ("Parmigiani Fleurier Tonda PF", TRADES, False),
        ("Rolex GMT-Master Pepsi", TRADES, False),
        ("Hamilton Murph Bracelet Bundle", "one watch and a strap", False),
        ("Seiko SARB033 Full Set + Extra Black Leather Strap", "", False),
        ("Custom Seiko mods", "a couple custom pieces, $160/ea", True),
        ("Sternglas Hamburg Chrono & Naos", "two Sternglas watches", True),
        ("Watch collection sale", "Rolex $1, Omega $2, Seiko $3", True),
        ("Rolex Submariner + Omega Speedmaster", "", True),
        ("Wholesale lot", "three Omega Speedmasters", True),
        ("Selling as a bundle with extras", None, True),
        ("Seiko", "bracelet links x3", False),
        ("Seiko", "40 x 48mm", False),
        ("Seiko", "34.4 x 44.5mm", False),
        ("Seiko x2", "", True),
        (None, None, False),
    ],
)
def test_bundle(spark, title, body, expected):
    r = spark.createDataFrame([(title, body)], "t string, b string").select(W.detect_bundle("t", "b").alias("v")).first()
    assert r.v is expected is twin.is_bundle(title, body)


def test_trades_are_cut(spark):
    texts = [TRADES, "Trades: AP\nPrice: 5\nx", "Trades: AP\r\n\r\nx", "no such thing\r\nhere", "open to trades\n$ 5\nTrades: x", ""]
    cut = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(W.strip_trades("t").alias("v")).collect()]
    assert cut == [twin.without_trades(t) for t in texts] and "AP" not in cut[0] and cut[1:3] == ["Price: 5\nx", "x"]


PIECES = [
    *(b[0] for b in W.BRANDS), *(t for b in W.BRANDS for t in b[1]), *W.NOISE, "vs", "looks like a", "aka", "166.0168", "5933-5080", "SBGA229", "SARB033", "IW501004", "PFC912-1020001", "145.022", "126610LN", "1968", "x2", "x 3", "40 x 44mm",
    "bracelet links x2", "the grandeur", "grandeur", "apple watch", "bundle", "strap bundle", "wholesale lot", "3 watches", "couple pieces", "lot of 3 seiko watches", "trades: ap", "price: $5", "\n", "\n\n", "r/tudor", "$160/ea", "dealer", "ünïcode", "\u00a0", "İ", "x1.5", "2.5 x2",
]


def test_expressions_equal_the_twin(spark):
    """Random texts of brands, references, comparisons, counts and trades."""
    r = random.Random(4)
    glue = lambda: r.choice([" ", " ", " ", "/", ", ", " + ", "-", "", "\n"])
    make = lambda n: "".join(x for _ in range(n) for x in (r.choice([str.upper, str.lower, str.title, str])(r.choice(PIECES)), glue()))
    texts = [(i, make(r.choice([1, 2, 3, 5, 9])), r.choice([None, "", make(6), make(25)])) for i in range(3000)]
    rows = spark.createDataFrame(texts, "i int, t string, b string").repartition(8)
    got = rows.select("i", "t", "b", W.parse_watch("t").alias("w"), W.brand_list("t").alias("hits"), W.detect_bundle("t", "b").alias("bundle"), W.offered_brands(F.col("t"), F.col("b")).alias("offered")).collect()
    for x in got:
        assert tuple(x.w) == twin.watch_of(x.t), x.t
        assert x.hits == twin.brand_hits(x.t), x.t
        assert x.bundle == twin.is_bundle(x.t, x.b), (x.t, x.b)
        assert x.offered == twin.brand_hits(twin.without_trades("\n\n".join(p for p in (x.t, x.b) if p))), (x.t, x.b)
    assert 0.2 < sum(x.bundle for x in got) / len(got) < 0.95 and len({x.w.brand for x in got}) > 90


def test_scalars(spark):
    df = spark.range(1)
    get = lambda c: df.select(c.alias("v")).first()["v"]
    lit = lambda x, t=None: F.lit(x).cast(t) if t else F.lit(x)
    none = lit(None, "bigint")
    assert get(S.format_usd(lit(123450))) == "$1,235" and get(S.format_usd(none)) == "—"
    assert get(S.format_usd_range(none, lit(75000), lit(99900))) == "$750–$999"
    assert get(S.format_usd_range(none, lit(1000000), none)) == "$10,000+" and get(S.format_usd_range(none, none, lit(50000))) == "under $500"
    assert get(S.clamp_whole(lit(float("nan")), 1, 5, 3)) == 3 and get(S.clamp_real(lit(float("nan")), 1, 5)) == 1.0
    assert get(S.usd_to_cents(lit("$1,234.50"))) == 123450 and get(S.usd_to_cents(lit("x"))) is None
    assert get(S.tri_state(lit("TRUE"))) is True and get(S.tri_state(lit("2"))) is None
    assert get(S.brand_outcome(lit(True), lit(" "))) == "unknown" and get(S.brand_outcome_key(lit(True), lit(" Omega "))) == "value:Omega"
    assert get(S.safe_url(lit("javascript:x"))) is False and get(S.safe_url(lit("https://a.b/c"))) is True
    assert get(S.gold_price_cell(none, none, none)) == "Unknown" and get(S.gold_price_cell(lit(0), none, none)) == "—"
    assert get(S.source_label(lit("regex"), lit(0.87))) == "R0.87"
    assert get(T.feed_price_cents(lit("USD"))) == 0 and get(T.feed_price_cents(lit("$1,299.99 USD"))) == 129999
    assert get(T.minor_units(lit(5000.0), lit("JPY"))) == 5000 and get(T.currency_of(lit("€"))) == "EUR"
    assert get(T.condition_of_code(lit("3000"), lit("x"))) == "used" and get(T.condition_of_code(lit(None, "string"), lit("Open Box"))) == "unworn"


def test_needles():
    """What is told to be in every match is there; alternatives are told together."""
    assert needles(r"\b(?:vs\.?|versus)\b") == ("versus", "vs") and needles(r"\bwatches?\b") == ("watche",) and needles(r"(\d+)?\s*") == ()
    assert needles(r"(?:a\s+)?couple") == ("couple",) and needles(r"(?:x|\d)y?") == () and needles(r"(?:AB)+c{0,2}") == ("ab",)


def test_bind_gives_one_value(spark):
    """A second parameter keeps its default: it is not given the place in the array."""
    seen = lambda x, more=None: x if more is None else F.concat(x, more.cast("string"))
    assert spark.range(1).select(bind(F.lit("a"), seen).alias("v")).first().v == "a"


def test_texts_are_made_once(spark):
    """The text of a rule is no part of each of its patterns, nor is a pattern searched for each use of what it finds."""
    df = spark.createDataFrame([("x", "y")], "title string, description string")
    for make, mark, most in ((T.usd_price_cents, "20E3", 3), (T.condition, "array_join", 3), (T.watch_type, "array_join", 3)):
        plan = df.select(make(F.col("title"), F.col("description")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count(mark) <= most, mark
    price = df.select(T.usd_price_cents(F.col("title")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert price.count("regexp_extract") <= 2 * len(T.PRICES)
