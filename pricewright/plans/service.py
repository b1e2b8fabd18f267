"""Queries of the service: the whole stock valued and reported, choices, price moves, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions import text as X
from pricewright.operators import market_sync, reports, serving, valuation, versions
from pricewright.plans import views as V
from pricewright.plans.catalogue import _R
from pricewright.plans.folders import versions_folder
from pricewright.plans.market import _OFFERS, _VALUED, VALUED, _snapshots

# Titles that parts are dealt to.
TITLES = ("Ağır hasar kayıtlı", "PERT kayıtlı", "hasar kaydı yok", "Hasarlı araç", "hasar kayit 5000 TL", "Tavan boyalı", "komple boyali, temiz", "dosta gider", "", None, "agir hasarlı", "expert kontrolünde")


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing as a request at its own price; without a mileage, at the yearly one."""
    rows = V.listings(spark, sf_dir).withColumns(V.spec_data("make", "model", "variant"))
    usual = F.greatest(F.lit(1), F.lit(V.CONFIG.ref_year) - F.col("year")) * V.CONFIG.yearly_mileage
    damage = F.when(F.col("is_damaged"), "YES").otherwise("NO")
    return rows.select(F.col("listing_id").alias("request_id"), "make", "model", "variant", "year", F.coalesce("mileage", usual.cast("long")).alias("mileage"), damage.alias("damage"), F.col("price").cast("double").alias("desired"), "body", "fuel", "transmission", F.lit("").alias("trim"))


def _valued_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valuation.valued_in_bulk(stock(spark, sf_dir), _snapshots(spark, sf_dir), V.CONFIG)


def stock_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A valuation of every listing."""
    return _valued_stock(spark, sf_dir).select(*(F.col(c).cast("long").alias(c) if c not in ("request_id", "status") else F.col(c) for c in VALUED))


SHOWN = {"request_id": "Listing", "make": "Make", "model": "Model", "year": "Year", "fmv": "Market value", "cash_offer": "Cash offer", "listing_price": "Listing price", "gross_reserve": "Reserve", "n": "Comparables", "confidence": "Confidence", "level": "Level", "segment": "Segment"}
TITLE, TOP = "Valuation of the stock", 50


def stock_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a report on all listings: the largest reserves, and figures of all, if they pass the rules.

    The valuations are stored first, as both the facts and the rows are read from them.
    """
    folder = versions_folder(spark)
    versions.publish(_valued_stock(spark, sf_dir), folder, "valuations", min_rows=0)
    rows = versions.read(spark, folder).select(*(c for c in SHOWN if c != "segment"), "status", X.short_id(F.col("snapshot_id")).alias("segment"))
    rows = rows.withColumns({c: F.col(c).cast("long") for c in ("fmv", "cash_offer", "listing_price", "gross_reserve", "confidence")}).withColumn("year", F.col("year").cast("string"))
    is_, valued = lambda status: F.col("status") == status, F.col("status") == valuation.SUCCESS
    facts = rows.agg(
        F.count("*").alias("listings"), F.count_if(valued).alias("valued"), F.count_if(is_(valuation.MANUAL)).alias("manual"), F.count_if(is_(valuation.INSUFFICIENT)).alias("insufficient"),
        F.countDistinct(F.when(valued, F.col("make"))).alias("makes"), F.count_if(valued & (F.col("level") == 1)).alias("exact"),
    )
    c = F.col
    rules = {"half are valued": ("valued", 2 * c("valued") >= c("listings")), "eight makes": ("makes", c("makes") >= 8), "one in twenty is exact": ("exact", 20 * c("exact") >= c("valued")), "one in five lacks data at most": ("insufficient", 5 * c("insufficient") <= c("listings"))}
    return reports.lines(rows.where(valued), facts, rules, TITLE, SHOWN, [c("gross_reserve").desc(), c("request_id")], TOP)


def catalogue_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makes, their models and those models' variants with their listings."""
    return serving.choices(V.listings(spark, sf_dir), ("make", "model", "variant"))


MOVED = "Brand#11"


def market_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List prices of all specs after one make's was raised, January's run twice, and February's."""
    folder = versions_folder(spark)
    versions.publish(V.specs(spark, sf_dir).withColumn("msrp", F.when(F.col("size") % 10 != 0, F.col("msrp"))), folder, "specs")
    market_sync.adjust(spark, folder, 10, [MOVED])
    for month in ("2026-01", "2026-01", "2026-02"):
        market_sync.monthly(spark, folder, month)
    return market_sync.specs(spark, folder).select("make", "model", "variant", "year", "msrp")


def damage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of damage that each part's title tells of."""
    titles = spark.createDataFrame(list(enumerate(TITLES)), "k int, title string")
    parts = V.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(TITLES)).cast("int").alias("k"), "p_name")
    title = F.concat_ws(" ", "p_name", "title")
    return parts.join(F.broadcast(titles), "k").select("p_partkey", X.damage_level(title).alias("damage"))


QUERIES = (stock_values, stock_report, catalogue_choices, market_prices, damage_levels)

_STOCK = f"""
requests AS (
  SELECT listing_id AS request_id, make, model, variant, year, coalesce(mileage, greatest(1, 2002 - year) * 15000)::BIGINT AS mileage, CASE WHEN is_damaged THEN 'YES' ELSE 'NO' END AS damage, price::DOUBLE AS desired, {V.DATA}, '' AS trim
  FROM (SELECT *, concat_ws('|', make, model, variant) AS name FROM listings)
)"""
_VALUED_STOCK = _VALUED.replace(V.REQUESTS, _STOCK)
_DOTS = lambda x: f"coalesce(replace(format('{{:,}}', {x}::BIGINT), ',', '.'), '-')"
_TEXT = ("request_id", "make", "model", "year", "segment")
_FACTS = {
    "listings": "count(*)", "valued": "count(*) FILTER (status = 'SUCCESS')", "manual": "count(*) FILTER (status = 'MANUAL_EVALUATION_REQUIRED')", "insufficient": "count(*) FILTER (status = 'INSUFFICIENT_DATA')",
    "makes": "count(DISTINCT make) FILTER (status = 'SUCCESS')", "exact": "count(*) FILTER (status = 'SUCCESS' AND level = 1)",
}
_RULES = {"half are valued": ("valued", "2 * valued >= listings"), "eight makes": ("makes", "makes >= 8"), "one in twenty is exact": ("exact", "20 * exact >= valued"), "one in five lacks data at most": ("insufficient", "5 * insufficient <= listings")}
_REPORT = f"""{_VALUED_STOCK}, v AS (
  SELECT v.*, r.make, r.model, left(m.snapshot_id, 8) AS segment FROM valued v JOIN requests r USING (request_id) JOIN matched m USING (request_id)
), facts AS (SELECT {", ".join(f"{x} AS {name}" for name, x in _FACTS.items())} FROM v
), failed AS (SELECT list_filter([{", ".join(f"CASE WHEN NOT ({holds}) THEN '- {name}: ' || {_DOTS(fact)} END" for name, (fact, holds) in _RULES.items())}], lambda x: x IS NOT NULL) AS f, facts.* FROM facts
), first AS (SELECT *, (row_number() OVER (ORDER BY gross_reserve DESC, request_id))::INT AS position FROM v WHERE status = 'SUCCESS' QUALIFY position <= {TOP})
SELECT 0 AS section, 1 AS position, CASE WHEN len(f) = 0 THEN '# {TITLE}' ELSE '# {TITLE}: failed' END AS line FROM failed
UNION ALL SELECT 1, 1, '| # | {" | ".join(SHOWN.values())} |' FROM failed WHERE len(f) = 0 UNION ALL SELECT 1, 2, '{"| ---: " * (1 + len(SHOWN))}|' FROM failed WHERE len(f) = 0
UNION ALL SELECT 2, position, '| ' || position || {" || ".join(f"' | ' || {f'''coalesce({c}::VARCHAR, '-')''' if c in _TEXT else _DOTS(c)}" for c in SHOWN)} || ' |' FROM first WHERE (SELECT len(f) FROM failed) = 0
{" ".join(f"UNION ALL SELECT 3, {k}, '- {name}: ' || {_DOTS(name)} FROM failed WHERE len(f) = 0" for k, name in enumerate(_FACTS, 1))}
UNION ALL SELECT 3, unnest(range(1, len(f) + 1))::INT, unnest(f) FROM failed"""
_LEVEL = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in X.DAMAGE_LEVELS.items()) + " END"
_TITLE_VALUES = ", ".join("({}, {})".format(k, "NULL" if t is None else f"'{t}'") for k, t in enumerate(TITLES))
_MONTH = lambda x: _R(f"({x}) * {1 + market_sync.Settings.monthly_percent / 100!r}::DOUBLE")
ORACLES = {
    "stock_values": f"{_VALUED_STOCK} SELECT request_id, status, level, n, {_OFFERS} FROM valued",
    "stock_report": _REPORT,
    "catalogue_choices": f"""WITH {V.LISTINGS}, c AS (SELECT make, model, variant, count(*) AS n FROM listings GROUP BY ALL)
      SELECT 3 AS level, make, model, variant, n, 0::BIGINT AS n_below FROM c UNION ALL SELECT 2, make, model, NULL, sum(n)::BIGINT, count(*) FROM c GROUP BY ALL UNION ALL SELECT 1, make, NULL, NULL, sum(n)::BIGINT, count(DISTINCT model) FROM c GROUP BY ALL""",
    "market_prices": f"""WITH {V.SPECS}, s AS (SELECT make, model, variant, year, CASE WHEN size % 10 <> 0 THEN msrp END AS msrp FROM specs), a AS (SELECT * REPLACE (CASE WHEN make = '{MOVED}' THEN {_R(f'msrp * {1 + 10 / 100.0!r}::DOUBLE')} ELSE msrp END AS msrp) FROM s)
      SELECT make, model, variant, year, ({_MONTH(_MONTH('msrp'))})::DOUBLE AS msrp FROM a""",
    "damage_levels": f"SELECT p_partkey, {_LEVEL} AS damage FROM (SELECT p_partkey, lower(concat_ws(' ', p_name, title)) AS t FROM part JOIN (VALUES {_TITLE_VALUES}) t(k, title) ON k = p_partkey % {len(TITLES)})",
}
