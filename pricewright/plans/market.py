"""Queries on listings, snapshots, matching and valuation, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.config import COMMISSION_TIERS, RESERVE_TIERS
from pricewright.functions import pricing as P
from pricewright.functions.numbers import half_up, tier
from pricewright.operators import listings as L
from pricewright.operators import audit, matching, serving, snapshots, valuation, versions
from pricewright.plans import views as V
from pricewright.plans.folders import versions_folder

PERCENTILES = ("make", "model", "variant", "year", "n", "n_kept", "p5", "p35", "p50", "p60", "p95", "min_price", "max_price")
MILEAGE = ("make", "model", "variant", "year", "n_mileages", "median_mileage", "mean_mileage", "decay", "decay_source")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshots(V.listings(spark, sf_dir), V.specs(spark, sf_dir), V.CONFIG, ids=False).withColumns({c: F.col(c).cast("int") for c in ("n_kept", "n_mileages")})


def dedup_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.unique_listings(spark, sf_dir)


def dedup_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.raw_listings(spark, sf_dir).select("make", "model", "year", "price", "city", "listing_id")
    return L.first_of(rows, ["make", "model", "year", "price"], [F.col("city"), F.col("listing_id")])


def sanity_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.unique_listings(spark, sf_dir)
    c = F.col
    return rows.select(
        "listing_id", L.sane_price(c("price"), V.CONFIG).alias("price_ok"), L.sane_year(c("year"), V.CONFIG).alias("year_ok"),
        L.sane_mileage(c("mileage"), c("year"), c("price"), V.CONFIG).alias("mileage"),
    )


def clean_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.listings(spark, sf_dir).where("NOT is_damaged").select("listing_id", "make", "model", "variant", "year", "price", "mileage")


def snapshot_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir).select(*PERCENTILES)


def snapshot_mileage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir).select(*MILEAGE)


def snapshot_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir).select("snapshot_id", "n", "base_confidence", "quality", "body", "fuel", "transmission")


def snapshot_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every segment as one text: the list is the result."""
    rows = V.listings(spark, sf_dir).where("NOT is_damaged").groupBy(*snapshots.SEGMENT).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("listing_id")).alias("ids"))
    return rows.select(*snapshots.SEGMENT, "n", F.array_join("ids", ",").alias("listing_ids"))


def model_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.percentile_prices(V.listings(spark, sf_dir), ["make", "model", "year"])


def dual_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.two_averages(V.listings(spark, sf_dir), ["make", "model", "variant", "year"])


def best_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_of(_snapshots(spark, sf_dir), ["make", "model"], [F.col("n").desc(), F.col("year").desc(), F.col("variant"), F.col("snapshot_id")]).select("make", "model", "variant", "year", "n", "p50")


def top_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("n").desc(), F.col("year").desc(), F.col("variant"), F.col("snapshot_id")]
    rows = _snapshots(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("make", "model").orderBy(*order)))
    return rows.where("rank <= 10").select("make", "model", "rank", "variant", "year", "n")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.candidates(V.requests(spark, sf_dir), _snapshots(spark, sf_dir))


def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    return rows.groupBy("request_id", "level").agg(F.count("*").alias("n_snapshots"), F.sum("s_n").alias("n"), F.min_by("s_snapshot_id", "rank").alias("first_id"), F.max_by("s_snapshot_id", "rank").alias("last_id"))


def year_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.matched(V.requests(spark, sf_dir), _snapshots(spark, sf_dir), V.CONFIG)
    return rows.where("level IN (2, 3)").select("request_id", "level", half_up(F.col("growth") * 1_000_000).alias("growth_millionths"))


MATCH = ("request_id", "level", "n", "p5", "p35", "p50", "p60", "p95", "median_mileage", "decay_source", "base_confidence", "snapshot_id")
VALUED = ("request_id", "status", "level", "n", "fmv", "adjusted_p35", "required", "cash_offer", "cash_min", "cash_max", "listing_price", "expected_sale", "fee", "customer_net", "days_min", "days_max", "confidence", "gross_reserve", "net_profit")


def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matched(V.requests(spark, sf_dir), _snapshots(spark, sf_dir), V.CONFIG).select(*MATCH)


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valuation.valued(V.requests(spark, sf_dir), _snapshots(spark, sf_dir), V.CONFIG)


def valuation_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _valued(spark, sf_dir)
    return rows.select(*(F.col(c).cast("long").alias(c) if c not in ("request_id", "status") else F.col(c) for c in VALUED))


def comparables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.matched(V.requests(spark, sf_dir), _snapshots(spark, sf_dir), V.CONFIG)
    return valuation.comparables(found, V.listings(spark, sf_dir))


def consignment_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third year's requests have a valuation already; the others are valued first."""
    asked, snaps = V.requests(spark, sf_dir), _snapshots(spark, sf_dir)
    known = valuation.valued(asked.where("year % 3 = 0"), snaps, V.CONFIG)
    rows = valuation.intake(asked.where("damage <> 'YES'").select("request_id", "desired"), known, asked, snaps, V.CONFIG)
    return rows.select("request_id", "status", F.col("customer_net").cast("long").alias("customer_net"), F.col("expected_sale").cast("long").alias("expected_sale"))


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers of the same valuations: they agree in every field."""
    rows = _valued(spark, sf_dir)
    return valuation.audit(rows, rows).select("field", "n_equal", "n_probes")


AUDITED = ("level", "n", "fmv", "adjusted_p35", "required", "cash_offer", "listing_price", "customer_net", "gross_reserve", "net_profit", "status")


def audit_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored offers, some of which were changed since, against the match and against offers made anew.

    Changed are the cash offers of damaged vehicles of 1999 and the numbers of
    listings of requests at a multiple of 7,000 km.
    """
    folder = versions_folder(spark)
    # Each layer is read several times, and so written once; the offers are made anew from the match.
    tables = {
        "match": matching.matched(V.requests(spark, sf_dir), _snapshots(spark, sf_dir), V.CONFIG),
        "offers": lambda at: valuation.offered(spark.read.parquet(f"{at}/match"), V.CONFIG).select("request_id", *AUDITED, "year", "damage", "mileage"),
    }
    versions.update(spark, folder, lambda base: tables)
    found, again = versions.read(spark, folder, "match"), versions.read(spark, folder, "offers")
    stored = again
    changed = stored.withColumns({
        "cash_offer": F.when((F.col("year") == 1999) & (F.col("damage") == "YES"), F.col("cash_offer") + 5000).otherwise(F.col("cash_offer")), "n": F.when(F.col("mileage") % 7000 == 0, F.col("n") + 1).otherwise(F.col("n")),
    })
    layers = {"match": found.select("request_id", "level", "n"), "stored": changed.select("request_id", *AUDITED), "recomputed": again.select("request_id", *AUDITED)}
    return audit.summary(layers, "request_id", AUDITED)


def offer_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reserve, commission and roundings of every order's value."""
    x = F.col("price")
    rows = V.table(spark, sf_dir, "orders").select("o_orderkey", half_up(F.col("o_totalprice") * 20).alias("price"))
    return rows.select(
        "o_orderkey", "price", tier(x, RESERVE_TIERS, 1).cast("double").alias("reserve_rate"), tier(x, RESERVE_TIERS, 2).alias("least_reserve"),
        P.reserve(x, F.lit(12)).alias("reserve"), P.reserve(x, F.lit(3)).alias("reserve_few"), tier(x, COMMISSION_TIERS, 1).alias("commission_rate"), P.commission(x).alias("commission"),
        P.cash_rounded(x).alias("cash"), P.psychological(x, x).alias("psychological"), P.gallery_rounded(x).alias("gallery"),
    )


def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.unique_listings(spark, sf_dir).groupBy("make").agg(F.count("*").alias("n"), F.count_if("is_damaged").alias("n_damaged"))


def model_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = serving.breakdown(V.listings(spark, sf_dir), "model", "variant")
    return rows.select("model", "n", "n_members", F.array_join("members", ",").alias("members"))


def probe_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.requests(spark, sf_dir).withColumn("name", F.concat_ws(" ", "make", "model"))
    return serving.over_cap(rows, "name", 7)


QUERIES = (
    dedup_listings, dedup_prices, sanity_bounds, clean_listings, snapshot_percentiles, snapshot_mileage, snapshot_quality, snapshot_members, model_percentiles, dual_mean, best_snapshot,
    top_snapshots, match_candidates, year_rate, match_cascade, valuation_preview, comparables, consignment_intake, audit_report, audit_layers, offer_tiers, group_count, model_breakdown, probe_cap,
)

_SNAP = f"WITH {V.LISTINGS}, {V.SPECS}, {V.SNAPSHOTS}"
_ORDER = "s.n DESC, s.year DESC, s.variant, s.snapshot_id"
_MATCH = f"""{_SNAP}, {V.REQUESTS}, pairs AS (
  SELECT r.request_id, r.year AS asked_year, unnest(list_filter([CASE WHEN f AND s.year = r.year THEN 1 END, CASE WHEN f AND abs(s.year - r.year) <= 1 THEN 2 END, 3], lambda x: x IS NOT NULL)) AS level, s.*,
    trim(r.variant) <> '' AND trim(r.body) <> '' AND trim(r.fuel) <> '' AND trim(r.transmission) <> '' AND s.transmission <> '' AND s.body <> '' AND s.fuel <> ''
      AND r.variant = s.variant AND r.body = s.body AND r.fuel = s.fuel AND r.transmission = s.transmission AND s.n >= 5 AS exact
  FROM (SELECT * FROM requests) r JOIN snapshots s ON s.make = r.make AND s.model = r.model AND abs(s.year - r.year) <= 2
  CROSS JOIN LATERAL (SELECT r.variant IN ('', 'Standart', 'FarkliVaryant') OR r.variant = s.variant AS f)
), candidates AS (
  SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY request_id, level ORDER BY {_ORDER}) AS rank FROM pairs s) WHERE rank = 1 OR level > 1 AND rank <= 10
), grown AS (
  SELECT request_id, level, any_value(asked_year) AS asked_year, count(*) AS n_snapshots, sum(n)::BIGINT AS n, min(year) FILTER (p50 > 0) AS low, max(year) FILTER (p50 > 0) AS high, list(exact)[1] AS exact,
    list({{'n': n, 'year': year, 'p5': p5, 'p35': p35, 'p50': p50, 'p60': p60, 'p95': p95, 'm': median_mileage, 'd': decay, 's': decay_source, 'id': snapshot_id}} ORDER BY rank) AS snaps
  FROM candidates GROUP BY request_id, level
), rated AS (
  SELECT *, CASE WHEN n_snapshots >= 2 AND high > low THEN pow(list_filter(snaps, lambda x: x.year = high)[-1].p50::DOUBLE / list_filter(snaps, lambda x: x.year = low)[-1].p50::DOUBLE, 1::DOUBLE / (high - low)) - 1 END AS learned
  FROM grown WHERE level = 1 AND exact OR level = 2 AND n >= 5 OR level = 3 AND n >= 3
), chosen AS (
  SELECT *, CASE WHEN learned > 0.01 AND learned < 0.20 THEN learned ELSE 0.08::DOUBLE END AS rate,
    list_transform(snaps, lambda x: x.n * pow(0.92::DOUBLE, abs(asked_year - x.year))) AS w
  FROM rated QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY level) = 1
), found AS (
  SELECT request_id, level, n, rate, {", ".join(f"CASE WHEN level = 1 THEN snaps[1].{p} ELSE floor(list_sum(list_transform(snaps, lambda x, i: x.{p}::DOUBLE * (1 + (asked_year - x.year) * rate) * w[i])) / list_sum(w) + 0.5::DOUBLE)::BIGINT END AS {p}" for p in ("p5", "p35", "p50", "p60", "p95"))},
    snaps[-1].m AS median_mileage, snaps[-1].d AS decay, snaps[-1].s AS decay_source, snaps[1].id AS snapshot_id,
    CASE level WHEN 1 THEN least(99, greatest(83, 95 + n // 12)) WHEN 2 THEN least(88, greatest(76, 78 + n // 20)) ELSE least(78, greatest(62, 65 + n // 25)) END::INT AS base_confidence
  FROM chosen
), matched AS (
  SELECT r.*, coalesce(level, 4)::INT AS level, coalesce(n, 0)::BIGINT AS n, rate, p5, p35, p50, p60, p95, median_mileage, decay, decay_source, coalesce(base_confidence, 0) AS base_confidence, snapshot_id
  FROM requests r LEFT JOIN found f ON f.request_id = r.request_id
)"""


def _tiers(x: str, tiers: tuple, k: int) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {t[0]} THEN {t[k]}::DOUBLE" for t in tiers[:-1]) + f" ELSE {tiers[-1][k]}::DOUBLE END"


def _reserve(x: str, n: str) -> str:
    velocity = f"CASE WHEN {x} > 5000000 THEN 0.01::DOUBLE WHEN {x} < 1000000 THEN -0.005::DOUBLE ELSE 0 END"
    return f"greatest({_tiers(x, RESERVE_TIERS, 2)}, floor({x} * ({_tiers(x, RESERVE_TIERS, 1)} + {velocity} + CASE WHEN {n} < 8 THEN 0.025::DOUBLE ELSE 0 END) + 0.5::DOUBLE))"


def _cash(x: str) -> str:
    return f"CASE WHEN {x} <= 1000000 THEN floor({x} / 5000::DOUBLE) * 5000 ELSE floor({x} / 10000::DOUBLE) * 10000 END"


def _round(x: str) -> str:
    return f"floor({x} + 0.5::DOUBLE)"


def _psychological(x: str, market: str) -> str:
    capped = f"least({x}, {_round(f'{market} * 1.03::DOUBLE')})"
    return f"CASE WHEN floor({capped} / 1000) * 1000 - 1000 > 100000 THEN floor({capped} / 1000) * 1000 - 1000 ELSE {capped} END"


_VALUED = f"""{_MATCH}, a AS (
  SELECT *, greatest(-0.10::DOUBLE, least(0.12::DOUBLE, (mileage - CASE WHEN median_mileage > 0 THEN median_mileage ELSE greatest(1, 2002 - year) * 15000 END) / 10000::DOUBLE * decay)) AS ratio,
    CASE damage WHEN 'NO' THEN 0 WHEN 'YES' THEN 0.08::DOUBLE ELSE 0.04::DOUBLE END AS penalty FROM matched
), b AS (
  SELECT *, greatest(100000, p50 - {_round('p50 * ratio')} - {_round('p50 * penalty')}) AS fmv, p35 - {_round('p50 * ratio')} - {_round('p50 * penalty')} AS adjusted_p35,
    p60 - {_round('p50 * ratio')} - {_round('p50 * penalty')} AS adjusted_p60 FROM a
), c AS (SELECT *, {_reserve('fmv', 'n')} AS required FROM b
), d AS (SELECT *, CASE WHEN fmv - adjusted_p35 < required THEN fmv - required ELSE least(fmv - required, adjusted_p35) END AS raw FROM c
), e AS (SELECT *, {_cash('raw')} AS cash_offer, CASE WHEN desired > 0 THEN {_psychological('desired', '(fmv * 1.05::DOUBLE)')} ELSE {_psychological('adjusted_p60', 'fmv')} END AS listing_price FROM d
), f AS (SELECT *, greatest(cash_offer + 30000, listing_price - {_round('listing_price * 0.015::DOUBLE')}) AS expected_sale FROM e
), g AS (SELECT *, greatest({_tiers('expected_sale', COMMISSION_TIERS, 2)}, {_round(f"expected_sale * ({_tiers('expected_sale', COMMISSION_TIERS, 1)})")}) AS fee FROM f
), valued AS (
  SELECT request_id, CASE WHEN level = 4 OR p50 IS NULL OR p50 <= 0 THEN 'INSUFFICIENT_DATA' WHEN fmv < 400000 AND cash_offer / fmv < 0.85::DOUBLE THEN 'MANUAL_EVALUATION_REQUIRED' ELSE 'SUCCESS' END AS status,
    level::BIGINT AS level, n, fmv::BIGINT AS fmv, adjusted_p35::BIGINT AS adjusted_p35, required::BIGINT AS required, cash_offer::BIGINT AS cash_offer,
    ({_cash('(cash_offer * 0.96::DOUBLE)')})::BIGINT AS cash_min, ({_cash('(cash_offer * 1.02::DOUBLE)')})::BIGINT AS cash_max, listing_price::BIGINT AS listing_price, expected_sale::BIGINT AS expected_sale,
    fee::BIGINT AS fee, {_round('(expected_sale - fee)')}::BIGINT AS customer_net, CASE WHEN fmv > 5000000 THEN 20 WHEN fmv < 1000000 THEN 7 ELSE 14 END::BIGINT AS days_min,
    CASE WHEN fmv > 5000000 THEN 42 WHEN fmv < 1000000 THEN 18 ELSE 28 END::BIGINT AS days_max,
    greatest(0, least(99, base_confidence - CASE WHEN n < 8 THEN 10 ELSE 0 END - CASE WHEN level = 4 THEN 20 ELSE 0 END))::BIGINT AS confidence, (fmv - cash_offer)::BIGINT AS gross_reserve,
    greatest(0, fmv - cash_offer - ({_round('listing_price * 0.015::DOUBLE')} + 20000 + {_round('cash_offer * 0.01::DOUBLE')}))::BIGINT AS net_profit, damage, year
  FROM g
)"""
_OFFERS = ", ".join(f"CASE WHEN status <> 'INSUFFICIENT_DATA' THEN {c} END AS {c}" for c in VALUED if c not in ("request_id", "status", "level", "n"))

ORACLES = {
    "dedup_listings": f"WITH {V.LISTINGS} SELECT * FROM unique_listings",
    "dedup_prices": f"WITH {V.LISTINGS} SELECT make, model, year, price, city, listing_id FROM raw_listings QUALIFY row_number() OVER (PARTITION BY make, model, year, price ORDER BY city, listing_id) = 1",
    "sanity_bounds": f"""WITH {V.LISTINGS} SELECT listing_id, price BETWEEN 150000 AND 10000000 AS price_ok, year BETWEEN 1980 AND 2002 AS year_ok,
      CASE WHEN mileage BETWEEN 0 AND 2000000 AND mileage <> year AND mileage <> price THEN mileage END AS mileage FROM unique_listings""",
    "clean_listings": f"WITH {V.LISTINGS} SELECT listing_id, make, model, variant, year, price, mileage FROM listings WHERE NOT is_damaged",
    "snapshot_percentiles": f"{_SNAP} SELECT {', '.join(PERCENTILES)} FROM snapshots",
    "snapshot_mileage": f"{_SNAP} SELECT {', '.join(MILEAGE)} FROM snapshots",
    "snapshot_quality": f"{_SNAP} SELECT snapshot_id, n, base_confidence, quality, body, fuel, transmission FROM snapshots",
    "snapshot_members": f"WITH {V.LISTINGS} SELECT make, model, variant, year, count(*) AS n, string_agg(listing_id, ',' ORDER BY listing_id) AS listing_ids FROM listings WHERE NOT is_damaged GROUP BY ALL",
    "model_percentiles": f"""WITH {V.LISTINGS}, v AS (SELECT make, model, year, list(price::DOUBLE ORDER BY price) AS v FROM listings GROUP BY ALL)
      SELECT make, model, year, len(v)::INT AS n, {", ".join(f"CASE WHEN (len(v) - 1) * {p / 100}::DOUBLE = floor((len(v) - 1) * {p / 100}::DOUBLE) THEN v[1 + ((len(v) - 1) * {p / 100}::DOUBLE)::INT] ELSE floor(v[1 + floor((len(v) - 1) * {p / 100}::DOUBLE)::INT] * (1 - ((len(v) - 1) * {p / 100}::DOUBLE - floor((len(v) - 1) * {p / 100}::DOUBLE))) + v[2 + floor((len(v) - 1) * {p / 100}::DOUBLE)::INT] * ((len(v) - 1) * {p / 100}::DOUBLE - floor((len(v) - 1) * {p / 100}::DOUBLE)) + 0.5::DOUBLE) END AS p{p}" for p in (5, 35, 50, 60, 95))},
      CASE WHEN len(v) <= 4 THEN floor(list_avg(v) + 0.5::DOUBLE) ELSE floor(list_avg(v[1 + greatest(1, floor(len(v) * 0.1::DOUBLE)::INT) : len(v) - greatest(1, floor(len(v) * 0.1::DOUBLE)::INT)]) + 0.5::DOUBLE) END::BIGINT AS clean_average FROM v""",
    "dual_mean": f"""WITH {V.LISTINGS} SELECT make, model, variant, year, count(*) AS n, floor(sum(price)::DOUBLE / count(*) + 0.5::DOUBLE)::BIGINT AS average,
      coalesce(floor(sum(price) FILTER (NOT is_damaged)::DOUBLE / nullif(count(*) FILTER (NOT is_damaged), 0) + 0.5::DOUBLE), floor(sum(price)::DOUBLE / count(*) + 0.5::DOUBLE))::BIGINT AS clean_average FROM listings GROUP BY ALL""",
    "best_snapshot": f"{_SNAP} SELECT make, model, variant, year, n, p50 FROM snapshots s QUALIFY row_number() OVER (PARTITION BY make, model ORDER BY {_ORDER}) = 1",
    "top_snapshots": f"{_SNAP} SELECT make, model, (row_number() OVER (PARTITION BY make, model ORDER BY {_ORDER}))::INT AS rank, variant, year, n FROM snapshots s QUALIFY rank <= 10",
    "match_candidates": f"{_MATCH} SELECT request_id, level, count(*) AS n_snapshots, sum(n)::BIGINT AS n, arg_min(snapshot_id, rank) AS first_id, arg_max(snapshot_id, rank) AS last_id FROM candidates GROUP BY ALL",
    "year_rate": f"{_MATCH} SELECT request_id, level, floor(rate * 1000000 + 0.5::DOUBLE)::BIGINT AS growth_millionths FROM matched WHERE level IN (2, 3)",
    "match_cascade": f"{_MATCH} SELECT {', '.join(MATCH)} FROM matched",
    "valuation_preview": f"{_VALUED} SELECT request_id, status, level, n, {_OFFERS} FROM valued",
    "comparables": f"""{_MATCH}, members AS (SELECT make, model, variant, year, sha256(concat_ws('|', make, model, variant, year)) AS snapshot_id, list(listing_id ORDER BY listing_id) AS ids FROM listings WHERE NOT is_damaged GROUP BY ALL),
      firsts AS (SELECT request_id, unnest(ids[1:5]) AS listing_id, unnest(range(0, least(5, len(ids)))) AS position FROM matched JOIN members USING (snapshot_id))
      SELECT request_id, position::INT AS position, listing_id, price, mileage FROM firsts JOIN listings USING (listing_id)""",
    "consignment_intake": f"""{_VALUED} SELECT request_id, status, CASE WHEN status <> 'INSUFFICIENT_DATA' THEN customer_net END AS customer_net, CASE WHEN status <> 'INSUFFICIENT_DATA' THEN expected_sale END AS expected_sale
      FROM valued WHERE damage <> 'YES'""",
    "audit_report": f"{_MATCH} SELECT unnest(['level', 'n', 'fmv', 'adjusted_p35', 'required', 'cash_offer', 'listing_price', 'customer_net', 'gross_reserve', 'net_profit', 'status']) AS field, count(*) AS n_equal, count(*) AS n_probes FROM matched GROUP BY 1",
    "audit_layers": f"""{_VALUED}, v AS (SELECT status, mileage, damage = 'YES' AND year = 1999 AND status <> 'INSUFFICIENT_DATA' AS planted FROM (SELECT v.*, r.mileage FROM valued v JOIN requests r USING (request_id)))
      SELECT f.field, count(*) FILTER (NOT (f.field = 'cash_offer' AND planted OR f.field = 'n' AND mileage % 7000 = 0)) AS n_equal, count(*) AS n_probes FROM v CROSS JOIN (SELECT unnest({list(AUDITED)}) AS field) f GROUP BY 1""",
    "offer_tiers": f"""WITH o AS (SELECT o_orderkey, floor(o_totalprice * 20 + 0.5::DOUBLE)::BIGINT AS price FROM orders)
      SELECT o_orderkey, price, {_tiers('price', RESERVE_TIERS, 1)} AS reserve_rate, ({_tiers('price', RESERVE_TIERS, 2)})::INT AS least_reserve, ({_reserve('price', '12')})::BIGINT AS reserve, ({_reserve('price', '3')})::BIGINT AS reserve_few,
      {_tiers('price', COMMISSION_TIERS, 1)} AS commission_rate, greatest({_tiers('price', COMMISSION_TIERS, 2)}, {_round(f"price * ({_tiers('price', COMMISSION_TIERS, 1)})")})::BIGINT AS commission,
      ({_cash('price')})::BIGINT AS cash, ({_psychological('price', 'price')})::BIGINT AS psychological,
      CASE WHEN price >= 5000000 THEN floor(price / 50000::DOUBLE + 0.5::DOUBLE) * 50000 WHEN price >= 1000000 THEN floor(price / 10000::DOUBLE + 0.5::DOUBLE) * 10000 ELSE floor(price / 5000::DOUBLE + 0.5::DOUBLE) * 5000 END::BIGINT AS gallery FROM o""",
    "group_count": f"WITH {V.LISTINGS} SELECT make, count(*) AS n, count(*) FILTER (is_damaged) AS n_damaged FROM unique_listings GROUP BY ALL",
    "model_breakdown": f"WITH {V.LISTINGS} SELECT model, count(*) AS n, count(DISTINCT variant)::INT AS n_members, array_to_string(list_sort(list(DISTINCT variant))[1:10], ',') AS members FROM listings GROUP BY ALL",
    "probe_cap": f"WITH {V.REQUESTS} SELECT concat_ws(' ', make, model) AS name, count(*) AS n FROM requests GROUP BY 1 HAVING count(*) > 7",
}
