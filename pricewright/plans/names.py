"""Queries that tell makes, models, tiers and prices from names, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions import inference
from pricewright.functions.inference import TRIMS
from pricewright.functions.numbers import half_up
from pricewright.functions.tiers import OTHERS, TIERS
from pricewright.operators import detection, ledger, reference, serving, versions
from pricewright.plans import views as V
from pricewright.plans.catalogue import _BY_YEAR, _HTML, _NAMES, _R, pages_of, raw_names
from pricewright.plans.folders import versions_folder
from pricewright.sources import heads, html

# Catalogue names that parts are dealt to: make, model, variant.
VEHICLES = (
    ("Porsche", "911", "GT3 RS"), ("Porsche", "Cayenne", "S"), ("Porsche", "Boxster", None), ("Ferrari", "Roma", "V8"), ("Rolls-Royce", "Ghost", "V12"), ("Audi", "A6", "45 TFSI quattro"), ("Audi", "A6", "2.0 TDI"), ("Audi", "RS6", "Avant"),
    ("Audi", "100", "2.3"), ("BMW", "5 Serisi", "520d"), ("BMW", "M2", "Competition"), ("BMW", "M4", "Cabrio"), ("BMW", "X5", "M60i"), ("BMW Alpina", "B3", "x"), ("Mercedes-Benz", "E Serisi", "E 200"), ("Mercedes-Benz", "G Serisi", "G 63"),
    ("VW", "Golf", "1.6 TDI"), ("Volkswagen", "Amarok", "V6"), ("Fiat", "Egea", "Cross 1.4"), ("Fiat", "Egea", "1.3 Multijet"), ("Renault", "Clio", "Joy"), ("Peugeot", "3008", "GT"), ("Toyota", "Corolla", "1.6"), ("Hyundai", "Accent Blue", "1.6"),
    ("Ford", "Focus", "Titanium"), ("Honda", "Civic", "1.5"), ("Volvo", "XC40", "T3"), ("Range Rover", "Range Rover Sport", "3.0"), ("Land Rover", "Discovery", "HSE"), ("Togg", "T10X", "V2 Uzun"), ("Togg", "T10X", "V1"), ("Tesla", "Model Y", "Performance"),
    ("Tesla", "Model Y", "Long Range"), ("Škoda", "Octavia", "1.5 TSI"), ("Citroën", "C4", "e-C4"), ("Dacia", "Duster", "4x4"), ("Opel", "Vectra", "2.0"), ("Lada", "Niva", "1.7"), (None, "Golf", "1.0"), ("Kia", None, "Rio 1.2"),
)


def detected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Make, model and trim of every part's scraped folder, file, tag and title."""
    c = F.col
    rows = raw_names(spark, sf_dir).select("id", "make", "model", "variant", "title")
    return detection.detected(rows, c("make"), c("model"), c("variant"), c("title"), "d").select("id", "d.*")


def classified_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a vehicle of the catalogue, with the tier and prices of the published reference table."""
    folder = versions_folder(spark)
    versions.publish(reference.catalogue(spark), folder, "tiers")
    names = spark.createDataFrame([(k, *row) for k, row in enumerate(VEHICLES)], "k int, make string, model string, variant string")
    parts = V.table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_partkey") % len(VEHICLES)).cast("int").alias("k"), (2003 + F.col("p_partkey") % 26).cast("int").alias("year"), half_up(F.col("p_retailprice") * 1000).cast("double").alias("msrp")
    )
    rows = reference.recalibrated(parts.join(F.broadcast(names), "k"), versions.read(spark, folder))
    return rows.select("p_partkey", "make", "model", "variant", "year", "tier", "base_price", "new_msrp", "market_average", "clean_average", "listing_average", "min_price", "max_price", "selling_days", "changed")


def _imported(spark: SparkSession, sf_dir: str) -> str:
    """The folder of two imports: part of a catalogue file, twice, and the file with higher prices."""
    part = V.table(spark, sf_dir, "part")

    def rows(part: DataFrame, factor: int) -> DataFrame:
        return part.select(
            F.col("p_partkey").alias("line"), F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.col("p_brand")).alias("Brand"), F.lit(None).cast("string").alias("brand"), F.col("p_type").alias("Model"), F.col("p_name").alias("variant"),
            F.when(F.col("p_size") % 2 == 0, "Comfort").alias("package"), (1995 + F.col("p_partkey") % 3).cast("string").alias("Year"), F.col("p_size").cast("string").alias("horsepower"),
            F.when(F.col("p_partkey") % 5 == 0, "4x4").alias("driveType"), (F.col("p_partkey") % 4 + 2).cast("string").alias("doors"), (F.col("p_size") * factor).cast("string").alias("price"),
        )

    folder = versions_folder(spark)
    for name, found in (("a", rows(part.where("p_partkey % 3 <> 0"), 1000)), ("a", rows(part.where("p_partkey % 3 <> 0"), 1000)), ("b", rows(part, 1001))):
        ledger.run(found, folder, name)
    return folder


def import_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every row of two imports, one of which ran twice."""
    return versions.read(spark, _imported(spark, sf_dir), "ledger").select("import_id", "line", "outcome")


def import_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spec after two imports, with its names, its variant's engine and its price."""
    rows = ledger.chain(spark, _imported(spark, sf_dir))
    return rows.select("make", "model", "variant", "package", "year", "body", "fuel", "transmission", "drive", "horsepower", "doors", "market_average", "listing_average", F.get_json_object("regional", "$.Ankara").cast("double").alias("ankara"))


def power_trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuel, gears and drive of every part's scraped name, some of them electric, hybrid or exotic."""
    rows = raw_names(spark, sf_dir)
    electric, hybrid, exotic = F.col("id") % 7 == 0, F.col("id") % 5 == 0, F.col("id") % 11 == 0
    make, variant = F.coalesce("make", F.lit("")), F.coalesce("variant", F.lit(""))
    return rows.select("id", inference.fuel(variant, electric, hybrid, make).alias("fuel"), inference.transmission(make).alias("transmission"), inference.drive(variant, electric, exotic).alias("drive"))


def page_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brand of every page by its address's last part and its head, the first characters here, else its host."""
    parts = F.split("url", "/")
    rows = V.table(spark, sf_dir, "pages").select("page_id", F.get(parts, F.lit(2)).alias("host"), F.translate(F.element_at(parts, -1), "-_", "  ").alias("name"), F.substring("html", 1, heads.HEAD_BYTES).alias("head"))
    return heads.with_brand(rows, F.col("host"), F.col("name"), F.col("head")).select("page_id", "brand")


def page_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of listing pages, from their rows, or from the whole text for the pages whose rows are not marked."""
    rows = pages_of(V.unique_listings(spark, sf_dir))
    bare = F.length("page") % 2 == 0
    rows = rows.withColumn("body", F.when(bare, F.replace("body", F.lit("searchResultsItem"), F.lit("item"))).otherwise(F.replace("body", F.lit("<table>"), F.lit("<p>999.999 TL</p><table>"))))
    return html.prices_or_harvest(rows, "body", "page").groupBy("page").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices of all facets with their numbers of listings, each under what is chosen in the others."""
    rows = V.listings(spark, sf_dir).withColumns(V.spec_data("make", "model", "variant"))
    return serving.facet_counts(rows, {"year": 1999}, {"body": "Sedan", "fuel": "Dizel", "make": None}, ("make", "variant", "body", "fuel", "transmission"), top=20)


QUERIES = (detected_names, classified_prices, import_ledger, import_chain, power_trains, page_brands, page_prices, facet_counts)

_Q = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)
_HIT = lambda field, needles: "(" + " OR ".join(f"contains({field}, {_Q(n)})" for n in needles) + ")"
_DETECT = f"""WITH {_NAMES}, f AS (
  SELECT id, coalesce(make, '') AS folder, coalesce(variant, '') AS tag, upper(concat_ws(' ', coalesce(make, ''), coalesce(model, ''), coalesce(variant, ''), coalesce(title, ''))) AS joint, upper(coalesce(make, '')) AS uf, upper(concat_ws(' ', coalesce(title, ''), coalesce(variant, ''))) AS tt FROM raw_names
), m AS (
  SELECT *, CASE {" ".join(f"WHEN {_HIT('joint', joint)}{' OR ' + _HIT('uf', folder) if folder else ''} THEN {_Q(make)}" for make, joint, folder in detection.MAKES)}
    WHEN folder IN ({", ".join(map(_Q, detection.OTHER_FOLDERS))}) THEN {_Q(detection.DEFAULT_MAKE)} ELSE folder END AS make FROM f
)
SELECT id, make, coalesce(CASE {" ".join(f"WHEN make = {_Q(make)} THEN CASE " + " ".join(f"WHEN {_HIT('joint', n.split('|'))} THEN {_Q(m)}" for n, m in rules) + " END" for make, rules in detection.MODELS.items())} END,
  nullif(tag, ''), {_Q(detection.DEFAULT_MODEL)}) AS model, CASE {" ".join(f"WHEN {_HIT('tt', n)} THEN {_Q(t)}" for n, t in TRIMS)} ELSE {_Q(detection.DEFAULT_TRIM)} END AS trim FROM m"""

_RULES = ", ".join(
    f"({place}, {_Q(how)}, {_Q(make)}, {k}, {_Q(rule[0])}, {_Q(rule[2] if len(rule) > 2 else tier)}, {rule[1]})"
    for place, (how, make, tier, price, rules) in enumerate(TIERS) for k, rule in enumerate((*rules, (None, OTHERS[1] if price is None else price)))
)
_CLASSIFIED = f"""WITH names(k, make, model, variant) AS (VALUES {", ".join(f"({k}, {', '.join(map(_Q, row))})" for k, row in enumerate(VEHICLES))}), rules(place, how, mk, rule, words, tier, price) AS (VALUES {_RULES}),
p AS (SELECT p_partkey, p_partkey % {len(VEHICLES)} AS k, (2003 + p_partkey % 26)::INT AS model_year, floor(p_retailprice * 1000 + 0.5::DOUBLE)::DOUBLE AS msrp FROM part),
n AS (SELECT *, lower(coalesce(make, '')) AS lm, concat_ws(' ', lower(coalesce(model, '')), lower(coalesce(variant, ''))) AS name FROM names),
mk AS (SELECT DISTINCT place, how, unnest(string_split(mk, '|')) AS needle FROM rules),
fam AS (SELECT k, min(place) AS place FROM n JOIN mk ON how = 'is' AND lm = needle OR how = 'has' AND contains(lm, needle) GROUP BY k),
hit AS (SELECT n.k, tier, price FROM n JOIN fam USING (k) JOIN rules USING (place)
  WHERE words IS NULL OR len(list_filter(string_split(words, '|'), lambda w: len(list_filter(string_split(w, '+'), lambda x: NOT contains(name, x))) = 0)) > 0 QUALIFY row_number() OVER (PARTITION BY n.k ORDER BY rule) = 1),
t AS (SELECT p.*, make, model, variant, coalesce(tier, '{OTHERS[0]}') AS tier, coalesce(price, {OTHERS[1]})::BIGINT AS base FROM p JOIN names USING (k) LEFT JOIN hit USING (k)),
m AS (SELECT *, {_R(f'base * {_BY_YEAR}')} AS new_msrp FROM t), a AS (SELECT *, {_R('new_msrp / 1.2::DOUBLE')} AS average FROM m)
SELECT p_partkey, make, model, variant, model_year AS year, tier, base AS base_price, new_msrp, average AS market_average, {_R('average * 1.05::DOUBLE')} AS clean_average, {_R('average * 1.03::DOUBLE')} AS listing_average,
  {_R('average * 0.92::DOUBLE')} AS min_price, {_R('average * 1.08::DOUBLE')} AS max_price, CASE WHEN tier = 'economy' THEN 12 ELSE 20 END AS selling_days, new_msrp <> msrp AS changed FROM a"""
# Rows of both imports in order; of a spec the first line creates and the last stands.
_IMPORTS = """WITH r AS (
  SELECT i.import_id, i.nth, p_partkey AS line, p_partkey % 11 <> 0 AS valid, p_brand AS make, p_type AS model, p_name AS variant, CASE WHEN p_size % 2 = 0 THEN 'Comfort' END AS package, (1995 + p_partkey % 3)::INT AS year,
    coalesce(nullif(p_size, 0), 110)::DOUBLE AS horsepower, CASE WHEN p_partkey % 5 = 0 THEN '4x4' ELSE 'Önden Çekiş' END AS drive, (p_partkey % 4 + 2)::DOUBLE AS doors, coalesce(nullif(p_size * i.factor, 0), 500000)::DOUBLE AS average
  FROM part CROSS JOIN (VALUES ('a', 1, 1000), ('b', 2, 1001)) i(import_id, nth, factor) WHERE i.nth = 2 OR p_partkey % 3 <> 0
  QUALIFY row_number() OVER (PARTITION BY import_id, CASE WHEN p_partkey % 11 <> 0 THEN p_brand ELSE '' END, p_type, p_name, p_size, p_partkey % 3, p_partkey % 5 = 0, p_partkey % 4 ORDER BY p_partkey DESC) = 1
), v AS (SELECT * FROM r WHERE valid)"""
_LAST = "row_number() OVER (PARTITION BY make, model, variant, package, year ORDER BY nth DESC, line DESC)"
ORACLES = {
    "detected_names": _DETECT, "classified_prices": _CLASSIFIED,
    "power_trains": f"""WITH {_NAMES}, n AS (SELECT id, lower(coalesce(make, '')) AS lm, lower(coalesce(variant, '')) AS lv, id % 7 = 0 AS electric, id % 5 = 0 AS hybrid, id % 11 = 0 AS exotic FROM raw_names)
      SELECT id, CASE WHEN electric THEN 'Elektrik' WHEN hybrid THEN 'Hibrit' WHEN {_HIT('lm', inference.GAS_MAKES)} THEN 'LPG' WHEN {_HIT('lv', inference.DIESEL)} THEN 'Dizel' ELSE 'Benzin' END AS fuel,
        CASE WHEN {_HIT('lm', inference.MANUAL_MAKES)} THEN 'Manuel' ELSE 'Otomatik' END AS transmission,
        CASE WHEN exotic AND NOT electric THEN 'Arkadan İtiş' WHEN {_HIT('lv', inference.FOUR_WHEELS)} THEN '4x4' WHEN electric THEN 'Arkadan İtiş' ELSE 'Önden Çekiş' END AS drive FROM n""",
    "page_brands": f"""WITH p AS (SELECT page_id, string_split(url, '/')[3] AS host, lower(translate(string_split(url, '/')[-1], '-_', '  ')) AS name, lower(left(html, 5000)) AS head FROM pages)
      SELECT page_id, coalesce(CASE {" ".join(f"WHEN contains(name, {_Q(b.lower() + ' ')}) THEN {_Q(b)}" for b in heads.BRANDS)} END, CASE {" ".join(f"WHEN contains(head, {_Q(b.lower())}) THEN {_Q(b)}" for b in heads.BRANDS)} END, host) AS brand FROM p""",
    "page_prices": f"""{_HTML}, p AS (SELECT page, price, row_number() OVER (PARTITION BY page ORDER BY listing_id) AS r FROM shown)
      SELECT page, count(*) AS n, sum(price)::BIGINT AS total FROM p WHERE (length(page) % 2 = 0 OR r <= {html.PAGE_ROWS}) AND price > 50000 AND price < 100000000 GROUP BY page""",
    "facet_counts": f"""WITH {V.LISTINGS}, s AS (SELECT l.*, {V.DATA} FROM (SELECT *, concat_ws('|', make, model, variant) AS name FROM listings WHERE year = 1999) l),
      c AS (SELECT 'make' AS facet, make AS choice FROM s WHERE body = 'Sedan' AND fuel = 'Dizel' UNION ALL SELECT 'variant', variant FROM s WHERE body = 'Sedan' AND fuel = 'Dizel' UNION ALL SELECT 'body', body FROM s WHERE fuel = 'Dizel'
        UNION ALL SELECT 'fuel', fuel FROM s WHERE body = 'Sedan' UNION ALL SELECT 'transmission', transmission FROM s WHERE body = 'Sedan' AND fuel = 'Dizel'),
      n AS (SELECT facet, choice, count(*) AS n FROM c GROUP BY ALL)
      SELECT facet, choice, n, (row_number() OVER (PARTITION BY facet ORDER BY n DESC, choice))::INT AS rank, count(*) OVER (PARTITION BY facet) AS n_choices FROM n QUALIFY rank <= 20""",
    "import_ledger": f"""{_IMPORTS} SELECT import_id, line, CASE WHEN row_number() OVER (PARTITION BY make, model, variant, package, year ORDER BY nth, line) = 1 THEN 'created' ELSE 'updated' END AS outcome FROM v
      UNION ALL SELECT import_id, line, 'rejected' FROM r WHERE NOT valid""",
    "import_chain": f"""{_IMPORTS}, s AS (SELECT *, first_value(drive) OVER (PARTITION BY make, model, variant, package, year ORDER BY nth, line) AS first_drive FROM v QUALIFY {_LAST} = 1),
      e AS (SELECT make, model, variant, horsepower FROM v QUALIFY row_number() OVER (PARTITION BY make, model, variant ORDER BY nth DESC, line DESC) = 1)
      SELECT s.make, s.model, s.variant, package, year, 'Sedan' AS body, 'Benzin' AS fuel, 'Manuel' AS transmission, first_drive AS drive, e.horsepower, doors, average AS market_average, average * 1.03::DOUBLE AS listing_average, 0.98::DOUBLE AS ankara
      FROM s JOIN e ON e.make = s.make AND e.model = s.model AND e.variant = s.variant""",
}
