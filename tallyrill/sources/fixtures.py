"""The listing store's tables, derived from the star-schema Parquet.

Each view is one SELECT that Spark and DuckDB both run; only array access and
timestamp literals differ. `view()` gives the DataFrame, `with_views()` the
same as common table expressions in front of a DuckDB query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LISTINGS_AS_OF = "2001-11-05"
EVENTS_AS_OF = "2024-01-31"
WINDOW_DAYS = 180

#: Values of the derived columns; fixed.
BRAND_NAMES = (
    "Rolex", "Omega", "Grand Seiko", "Seiko", "Tudor", "Cartier", "IWC", "Breitling", "Hamilton", "Longines", "Tissot", "Zenith", "Oris",
    "Sinn", "Nomos", "Citizen", "Casio", "Orient", "Bulova", "Mido", "Doxa", "Timex", "Panerai", "Hublot", "Zodiac",
)
CONDITION_NAMES = ("unworn", "excellent", "very good", "good", "fair")
REGION_NAMES = (
    "CA", "NY", "TX", "FL", "WA", "OR", "IL", "GA", "MA", "PA", "OH", "NC", "NJ", "VA", "AZ", "CO", "MI", "MN", "WI", "MO", "TN", "IN", "MD", "SC", "UT",
)
SOURCE_NAMES = ("regex", "local", "ai", "manual", "legacy")
BODIES = (
    "Full set, light wear. Asking $1,250 shipped.",
    "BNIB, never worn.\nTrades: Rolex, AP\n\nPrice: 3200 USD",
    "Beater with scratches on the crystal, needs service.",
    "[no comment]",
    "Excellent condition 9.5/10, 1969 dial. OBO.",
)


def _pick(dialect: str, values: tuple[str, ...], index: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''").replace("\n", "'||chr(10)||'") + "'" for v in values)
    return f"element_at(array({quoted}), cast({index} as int))" if dialect == "spark" else f"list_extract([{quoted}], {index})"


def _time(dialect: str, text: str) -> str:
    return f"TIMESTAMP_NTZ'{text} 00:00:00'" if dialect == "spark" else f"TIMESTAMP '{text} 00:00:00'"


def _listings(d: str) -> str:
    return f"""
    SELECT *, concat('[WTS] [', region, '] ', coalesce(brand, 'Unbranded'), ' ', p_name, ' ', cast(100000 + l_partkey as string),
        CASE WHEN price_cents IS NULL THEN '' ELSE concat(' $', cast(cast(floor(price_cents / cast(100 as double)) as bigint) as string)) END) AS title,
      CASE WHEN l_linenumber = 3 THEN price_cents - price_cents % 100000 END AS price_min_cents,
      CASE WHEN l_linenumber = 3 THEN price_cents - price_cents % 100000 + 99900 END AS price_max_cents
    FROM (
      SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS id, l_suppkey AS source_id,
        concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) AS external_id,
        CASE WHEN l_partkey % 7 <> 0 THEN {_pick(d, BRAND_NAMES, "cast(substr(p_brand, 7) as bigint) % 25 + 1")} END AS brand,
        CASE WHEN l_partkey % 13 <> 0 THEN cast(100000 + l_partkey as string) END AS reference,
        CASE WHEN l_partkey % 11 <> 0 THEN cast(floor(l_extendedprice * 100 + 0.5) as bigint) END AS price_cents,
        CASE WHEN p_size % 6 <> 0 THEN {_pick(d, CONDITION_NAMES, "p_size % 5 + 1")} END AS condition,
        CASE WHEN p_type = 'ECONOMY' THEN 'vintage' END AS watch_type,
        {_pick(d, REGION_NAMES, "s_nationkey + 1")} AS region,
        CASE WHEN l_partkey % 6 = 0 THEN NULL WHEN l_partkey % 6 = 1 THEN '' ELSE {_pick(d, BODIES, "l_orderkey % 5 + 1")} END AS description,
        l_quantity >= 45 AS is_bundle, l_returnflag = 'R' AS is_sold, CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS sold_at,
        o_orderdate AS first_seen_at, l_shipdate AS last_seen_at,
        concat('https://example.com/item/', cast(l_orderkey as string)) AS listing_url,
        CASE WHEN l_partkey % 7 <> 0 THEN {_pick(d, SOURCE_NAMES, "l_partkey % 5 + 1")} END AS brand_source,
        CASE WHEN l_partkey % 13 <> 0 THEN {_pick(d, SOURCE_NAMES, "l_partkey % 5 + 1")} END AS reference_source,
        CASE WHEN p_size % 6 <> 0 THEN {_pick(d, SOURCE_NAMES, "(l_partkey + 1) % 5 + 1")} END AS condition_source,
        CASE WHEN p_type = 'ECONOMY' THEN 'local' END AS watch_type_source,
        CASE WHEN l_partkey % 4 <> 0 THEN {_pick(d, SOURCE_NAMES, "l_partkey % 5 + 1")} END AS classifier_source,
        CASE WHEN l_partkey % 13 <> 0 AND l_partkey % 3 <> 0 THEN cast(cast(l_partkey % 1000 as double) / 1000 as decimal(4, 3)) END AS reference_confidence,
        CASE WHEN l_partkey % 7 <> 0 AND l_partkey % 5 = 1 THEN cast(cast((l_partkey * 7) % 1000 as double) / 1000 as decimal(4, 3)) END AS brand_confidence,
        CASE WHEN p_size % 6 <> 0 AND l_partkey % 5 = 0 THEN cast(cast((l_partkey * 3) % 1000 as double) / 1000 as decimal(4, 3)) END AS condition_confidence,
        CASE WHEN l_suppkey % 3 <> 0 THEN cast(cast(l_partkey % 100 as double) / 100 as decimal(3, 2)) END AS local_confidence,
        CASE WHEN l_suppkey % 3 <> 0 THEN l_shipdate END AS local_classified_at,
        CASE WHEN l_suppkey % 4 = 0 THEN cast(cast((l_partkey * 3) % 100 as double) / 100 as decimal(3, 2)) END AS ai_confidence,
        CASE WHEN l_suppkey % 4 = 0 THEN l_shipdate END AS ai_classified_at,
        l_partkey, l_linenumber, p_name
      FROM (
        SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_extendedprice DESC,
          l_quantity DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM {{lineitem}}
      ) l
      JOIN {{orders}} o ON o_orderkey = l_orderkey JOIN {{part}} p ON p_partkey = l_partkey JOIN {{supplier}} s ON s_suppkey = l_suppkey
      WHERE rn = 1
    ) x"""


def _sources(d: str) -> str:
    return "SELECT s_suppkey AS id, lower(replace(s_name, '#', '-')) AS slug, s_name AS name, s_acctbal >= 0 AS is_active FROM {supplier}"


def _reviews(d: str) -> str:
    flag = lambda bit: f"cast(floor(l_partkey / cast({2**bit} as double)) as bigint) % 2 = 1"
    return f"""
    SELECT id AS listing_id, CASE WHEN {flag(1)} THEN {_pick(d, BRAND_NAMES, "l_partkey % 25 + 1")} END AS brand,
      CASE WHEN {flag(2)} THEN cast(200000 + l_partkey as string) END AS reference,
      CASE WHEN {flag(3)} THEN {_pick(d, CONDITION_NAMES, "l_partkey % 5 + 1")} END AS condition,
      CASE WHEN {flag(4)} THEN 'vintage' END AS watch_type,
      {flag(0)} AS brand_reviewed, {flag(1)} AS reference_reviewed, {flag(2)} AS condition_reviewed, {flag(3)} AS watch_type_reviewed,
      {flag(4)} AS price_reviewed, {flag(5)} AS sold_reviewed, {flag(6)} AS local_reviewed, {flag(7)} AS bundle_reviewed,
      {flag(8)} AS multi_brand_reviewed, CASE WHEN {flag(5)} THEN price_cents + 100 END AS price_cents,
      cast(NULL as bigint) AS price_min_cents, cast(NULL as bigint) AS price_max_cents,
      CASE WHEN {flag(2)} THEN ' checked ' END AS notes, last_seen_at AS reviewed_at
    FROM {{listings}} WHERE l_partkey % 5 = 0"""


def _gold(d: str) -> str:
    off = "id % 4 = 0"
    return f"""
    SELECT id AS listing_id, CASE WHEN {off} THEN 'Other' ELSE upper(brand) END AS brand, reference,
      CASE WHEN {off} THEN 'fair' ELSE condition END AS condition, watch_type,
      CASE WHEN {off} THEN price_cents + 1 WHEN price_min_cents IS NULL THEN price_cents END AS price_cents,
      price_min_cents, price_max_cents, CASE WHEN id % 3 = 0 THEN NULL ELSE is_bundle END AS is_bundle,
      CASE WHEN {off} THEN NOT is_sold ELSE is_sold END AS is_sold, first_seen_at AS created_at
    FROM {{listings}} WHERE l_partkey % 9 = 0"""


def _events(d: str) -> str:
    k = "cast(regexp_replace(props, '[^0-9]', '') as bigint)" if d == "spark" else "cast(regexp_replace(props, '[^0-9]', '', 'g') as bigint)"
    day = "cast(cast(ts as date) as string)"
    return f"""
    SELECT event_id AS id,
      CASE event_type WHEN 'view' THEN 'page_view' WHEN 'purchase' THEN 'search' WHEN 'signup' THEN 'filter_apply' ELSE 'click' END AS event_type,
      concat(cast(user_id as string), '|', {day}) AS session_id,
      CASE WHEN event_type = 'purchase' AND k % 5 <> 0 THEN {_pick(d, BRAND_NAMES, "k % 25 + 1")} WHEN event_type = 'purchase' THEN '' END AS query,
      CASE WHEN event_type = 'click' AND k % 3 <> 0 THEN {_pick(d, ("search", "home", "listing"), "k % 3 + 1")} END AS placement,
      CASE WHEN event_type = 'click' THEN user_id % 100 + 1 END AS source_id,
      CASE WHEN event_type = 'signup' THEN concat('{{{{"brands":[', CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '"a"' ELSE '"a","b"' END, ']',
        CASE WHEN k % 4 <> 0 THEN concat(',"minPrice":', cast(k as string)) ELSE '' END, CASE WHEN k % 5 = 0 THEN ',"state":"CA"' ELSE '' END,
        ',"includeSold":', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, '}}}}') END AS metadata_json,
      user_id, ts AS created_at
    FROM (SELECT *, {k} AS k FROM {{events}}) e WHERE event_type <> 'error'"""


def _clicks(d: str) -> str:
    return """
    SELECT e.id, l.id AS listing_id, l.source_id, e.placement, e.created_at
    FROM {analytics_events} e JOIN (SELECT source_id, min(id) AS low, max(id) AS high FROM {listings} GROUP BY source_id) r ON r.source_id = e.source_id
    JOIN {listings} l ON l.id = CASE WHEN e.id % 2 = 0 THEN r.low ELSE r.high END
    WHERE e.event_type = 'click'"""


_VIEWS = {
    "listings": (_listings, ("lineitem", "orders", "part", "supplier")),
    "sources": (_sources, ("supplier",)),
    "reviews": (_reviews, ("listings",)),
    "gold": (_gold, ("listings",)),
    "analytics_events": (_events, ("events",)),
    "clicks": (_clicks, ("analytics_events", "listings")),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    make, needs = _VIEWS[name]
    inputs = {n: view(spark, sf_dir, n) if n in _VIEWS else table(spark, sf_dir, n) for n in needs}
    if "lineitem" in inputs:
        # lines of one order lie together: neither the window nor the join of orders moves them again
        inputs["lineitem"] = inputs["lineitem"].repartition("l_orderkey")
    return spark.sql(make("spark"), **inputs)


def with_views(sql: str, *names: str) -> str:
    """A DuckDB query with the views that it names."""
    done: list[str] = []

    def add(name: str) -> None:
        for n in _VIEWS[name][1]:
            if n in _VIEWS:
                add(n)
        if name not in done:
            done.append(name)

    for n in names:
        add(n)
    parts = []
    for n in done:
        make, needs = _VIEWS[n]
        parts.append(f"{n} AS ({make('duckdb').format(**{x: x for x in needs})})")
    return "WITH " + ",\n".join(parts) + sql if sql.lstrip().startswith(",") else "WITH " + ",\n".join(parts) + "\n" + sql
