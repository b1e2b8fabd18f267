"""Queries on names, prices, mutations, serving, imports and events, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions import curves, inference
from pricewright.functions import numbers as N
from pricewright.functions import text as X
from pricewright.operators import imports, listings, mutations, prices, serving, snapshots, versions
from pricewright.operators.normalize import BAD_MAKE as N_BAD_MAKE
from pricewright.operators.normalize import BAD_MODEL as N_BAD_MODEL
from pricewright.operators.normalize import MAKES as N_MAKES
from pricewright.operators.normalize import MODEL_DEBRIS as N_DEBRIS
from pricewright.operators.normalize import MODELS as N_MODELS
from pricewright.operators.normalize import VARIANT_DEBRIS as N_VARIANT_DEBRIS
from pricewright.operators.normalize import canonical
from pricewright.plans import views as V
from pricewright.plans.folders import versions_folder
from pricewright.sources import html

# Raw names as scraping leaves them: make, model, variant, title.
RAW_NAMES = (
    ("DS Automobiles", "DS 4 Fiyatları & Modelleri sahibinden.com'da - 2", "1.5 BlueHDi", "Temiz DS 4"), ("DS Automobiles", "DS Automobiles & Modelleri sahibinden.com'da - 4", "Standart", ""),
    ("BYD", "BYD Atto 3 Fiyatları sahibinden.com'da - 1", "Design", ""), ("BYD", "BYD Modelleri sahibinden.com'da", None, None), ("Cupra", "Cupra Formentor 1.5 TSI VZ - 3", "1.5 TSI", "VZ"),
    ("Cupra", "Cupra Fiyatları & Modelleri", "", ""), ("Daihatsu", "Daihatsu Sirion 1.3 - 2", "1.3", ""), ("Daihatsu", "Daihatsu Genel Model", "FarkliVaryant", ""),
    ("AUDI", "Audi_A3", "35 TFSI", "Ağır hasar kayıtlı"), ("bmw", "320i ED", "M Sport", "dosta gider"), ("Citroën", "C-Elysee", "1.6", ""), ("Alfa Romeo", "Sedan", "156", "Giulia Veloce"),
    ("Mercedes", "C 180", "156", "ekspertiz temiz"), ("VW Satılık", "Golf - 10", "1.6 TDI", "pert"), ("Renault", "Mégane", "FarkliVaryant", ""), ("X", "Y", "Z", ""), ("Peugeot", "3008 2. El Otomobil", "Allure", ""),
    ("Škoda", "Octavia", "1.6 TDI - 4", "Satılık"), ("Opel", "Opel", "Edition", ""), ("Tofaş", "Şahin", "S", "sahibinden.com"), (None, "A", None, None), ("Fıat", "Egea", "1.4 Fire", "agir hasarli"),
)


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under scraped names, dealt by their key."""
    names = spark.createDataFrame([(k, *row) for k, row in enumerate(RAW_NAMES)], "k int, make string, model string, variant string, title string")
    parts = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % len(RAW_NAMES)).cast("int").alias("k"), "p_retailprice")
    return parts.join(F.broadcast(names), "k").drop("k")


def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return raw_names(spark, sf_dir).select("id", canonical(c("make"), c("model"), c("variant"), c("title")).alias("n")).select("id", "n.*")


def cleaned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    model = X.cleaned(c("model"))
    return raw_names(spark, sf_dir).select(
        "id", model.alias("model"), X.folded_upper(X.cleaned(c("make"))).alias("make"), X.without_prefix(model, F.coalesce(c("make"), F.lit(""))).alias("short"),
        X.damaged(c("title")).alias("is_damaged"), X.damaged(F.coalesce(c("title"), F.lit("")), strict=True).alias("is_damaged_strict"), X.known_variant(c("variant")).alias("known_variant"),
        X.numeric_only(F.coalesce(c("variant"), F.lit(""))).alias("is_number"),
    )


def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and quarantined scraped listings, by what became of them; two neighbouring parts share an id."""
    return _quarantined(spark, sf_dir, F.floor(F.col("id") / 2), 60)


def _quarantined(spark: SparkSession, sf_dir: str, listing_id: Column, factor: int) -> DataFrame:
    c = F.col
    raw = raw_names(spark, sf_dir).select(
        F.lit("web").alias("source"), listing_id.cast("string").alias("listing_id"), "make", "model", "variant", "title", F.concat(F.lit("Yıl "), 1990 + c("id") % 40).alias("year"),
        F.concat((c("id") * 997 % 300_000).cast("string"), F.lit(" km")).alias("mileage"), F.concat(F.format_number(c("p_retailprice") * factor, 0), F.lit(" TL")).alias("price"),
    )
    valid, bad = listings.split(listings.judged(raw))
    return valid.select("listing_id", "make", "model", "year", "price", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("listing_id", F.col("raw_make").alias("make"), F.col("raw_model").alias("model"), "year", "price", "reason"))


def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits out of addresses' and prices' text, a place split at its slash, and dotted thousands."""
    rows = V.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws(" ", F.format_number("s_acctbal", 2), F.lit("TL")).alias("price"), "s_name", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit(" / Kadıköy"))).alias("place"))
    return rows.select(
        "s_suppkey", N.digits(F.col("price")).alias("price_digits"), N.digits(F.col("s_name")).alias("name_digits"), X.city(F.col("place")).alias("city"), X.district(F.col("place")).alias("district"),
        X.thousands(F.col("s_suppkey") * 12_345).alias("dotted"), X.phone(F.lpad((F.col("s_suppkey") * 7919).cast("string"), 10, "5")).alias("phone"),
    )


def technical_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_names(spark, sf_dir)
    kind = inference.body(F.coalesce("variant", F.lit("")))
    engine = inference.engine(F.col("model"), F.col("variant"))
    return rows.select(
        "id", engine["engine_cc"].alias("engine_cc"), engine["horsepower"].alias("horsepower"), engine["torque"].alias("torque"), inference.fuel(F.coalesce("variant", F.lit(""))).alias("fuel"), kind.alias("body"),
        inference.doors(kind).alias("doors"), inference.seats(kind).alias("seats"), inference.drive(F.coalesce("variant", F.lit(""))).alias("drive"), inference.trim_level(F.col("title"), F.col("variant")).alias("trim"),
    )


TIERS = ("exotic", "luxury", "standard", "economy")


def _tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.specs(spark, sf_dir)
    tier = F.element_at(F.array(*map(F.lit, TIERS)), F.col("size") % 4 + 1)
    return rows.withColumns({"tier": tier, "model_year": F.col("year") * 4 - 5978 + F.col("size") % 4})


def depreciation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every curve at every catalogue vehicle's age."""
    rows = _tiered(spark, sf_dir)
    c, age = F.col, F.greatest(F.lit(0), F.lit(2026) - F.col("model_year"))
    base = c("msrp")
    return rows.select(
        "make", "model", "variant", "year", curves.to_floor(base, base * 0.25, age).alias("to_floor"), curves.geometric(base, age).alias("geometric"), N.half_up(base * curves.concave(age) * curves.package_surcharge(F.coalesce("package", F.lit("")))).alias("concave"),
        N.half_up(base * curves.by_year(c("tier"), c("model_year"))).alias("by_year"), curves.linear(base, age).alias("linear"), curves.catalogue_price(base, base * 0.2, F.lit(0.9), age, c("variant"), F.coalesce("package", F.lit(""))).alias("catalogue"),
    )


def recalibrated_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tiered(spark, sf_dir).withColumn("base_price", F.col("msrp")).withColumn("year", F.col("model_year"))
    return prices.recalibrated(rows).select("make", "model", "variant", "year", "new_msrp", "market_average", "clean_average", "listing_average", "min_price", "max_price", "selling_days", "changed")


def inflation_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.inflated(V.specs(spark, sf_dir), 2.5, ["Brand#11", "Brand#22", "Brand#33"]).select("make", "model", "variant", "year", "msrp")


def fallback_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    averages = snapshots.two_averages(V.listings(spark, sf_dir), ["make", "model", "variant", "year"]).where("n >= 3")
    return prices.with_fallback(V.specs(spark, sf_dir), averages, ["make", "model", "variant", "year"], V.CONFIG).select("make", "model", "variant", "year", "source", "average", "clean_average")


def flat_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.fanned_out(V.listings(spark, sf_dir), ["make", "model"], (2024, 2023, 2022, 2021, 2020))


def spec_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.specs(spark, sf_dir)
    packages = rows.where("package IS NOT NULL").select("make", "model", "package").distinct()
    return prices.catalogue(rows.select("make", "model", "variant").distinct(), packages, (1999, 2000, 2001), ["make", "model"]).select("make", "model", "variant", "package", "year")


def spec_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technical data of listings by names in any case; listings of a later year find none."""
    rows = V.listings(spark, sf_dir).select("listing_id", F.upper("make").alias("make"), "model", F.upper("variant").alias("variant"), (F.col("year") + F.col("price") % 2).cast("int").alias("year"))
    return snapshots.with_specs(rows, V.specs(spark, sf_dir)).select("listing_id", "body", "fuel", "transmission")


def models_without_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.specs(spark, sf_dir)
    return prices.without_specs(rows.select("make", "variant").distinct(), rows.where("size > 10").select("make", "variant"), ["make", "variant"])


def _prices_old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = V.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    old = rows.where("p_partkey % 3 <> 0")
    new = rows.where("p_partkey % 3 <> 1").withColumn("p_retailprice", F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")))
    return old, new.withColumn("p_size", F.col("p_size") + 100)


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.upsert(*_prices_old_new(spark, sf_dir), ["p_partkey"], ["p_retailprice"])


def find_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.find_or_create(*_prices_old_new(spark, sf_dir), ["p_partkey"])


def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.changed(*_prices_old_new(spark, sf_dir), ["p_partkey"], ["p_retailprice"])


def replace_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _prices_old_new(spark, sf_dir)
    return mutations.replace_groups(old, new.where("p_brand < 'Brand#3'"), ["p_brand"])


def filtered_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return mutations.delete_keys(rows, V.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of nations, customers and orders once two nations go."""
    t = lambda n: V.table(spark, sf_dir, n)
    nation = t("nation")
    levels = [(nation, "n_nationkey", "n_nationkey"), (t("customer"), "c_custkey", "c_nationkey"), (t("orders"), "o_orderkey", "o_custkey")]
    names = ("nation", "customer", "orders")
    parts = [rows.select(F.lit(n).alias("level"), F.col(own).cast("long").alias("key")) for n, (_, own, _), rows in zip(names, levels, mutations.cascade(levels, nation.where("n_nationkey IN (3, 7)"), "n_nationkey"), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def published_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version that is written, checked, pointed to and read again."""
    folder = versions_folder(spark)
    rows = V.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    versions.publish(rows.limit(0).unionByName(rows), folder, "a")
    versions.publish(rows.where("n > 0"), folder, "b")
    return versions.read(spark, folder)


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = serving.facets(V.specs(spark, sf_dir), {"year": 1999, "make": "Brand#11"}, {"body": "Sedan", "fuel": "Dizel"}, ("model", "body", "fuel", "transmission", "package"))
    return rows.select("facet", F.array_join("choices", ",").alias("choices"), "auto")


def dashboard_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = V.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "O", "APPROVED").otherwise("COMPLETED")
    value = N.half_up(F.col("o_totalprice"))
    return serving.dashboard(orders.select(value.alias("estimated_value")), orders.select(status.alias("status")))


def latest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.page(V.table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", limit=100, offset=200).select("o_orderkey", "o_orderdate", "o_totalprice")


def recent_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest orders with customer and nation; the joins come after the choice."""
    newest = serving.page(V.table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", limit=5)
    rows = newest.join(V.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(V.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("o_orderkey", "o_totalprice", "c_name", "n_name")


def price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.specs(spark, sf_dir).where("make = 'Brand#12'")
    return rows.select("make", "model", "variant", "year", F.coalesce("package", F.lit("-")).alias("package"), X.thousands(F.col("msrp")).alias("msrp")).orderBy("make", "model", F.col("year").desc(), "variant")


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "customer")
    return serving.search(rows, "BUILD", ["c_name", "c_mktsegment", "c_custkey"]).select("c_custkey", "c_mktsegment")


def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.search_terms(V.table(spark, sf_dir, "part"), ["#13", "PROMO"], ["p_brand", "p_type"]).select("p_partkey", "p_brand", "p_type")


def nested_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: V.table(spark, sf_dir, n)
    customers = t("customer").withColumnRenamed("c_nationkey", "n_nationkey")
    orders = t("orders").where("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey")
    return serving.having(t("nation"), (customers, "c_custkey", "n_nationkey"), (orders, "o_orderkey", "c_custkey")).select("n_nationkey", "n_name")


def unknown_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = V.table(spark, sf_dir, "part")
    return serving.missing(parts.select("p_brand").distinct(), parts.where("p_size > 45").select(F.upper("p_brand").alias("p_brand")), "p_brand")


def permission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _permissions(V.table(spark, sf_dir, "customer"))


def _permissions(rows: DataFrame) -> DataFrame:
    granted = F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.array(F.col("c_mktsegment"), F.lit("READ")))
    required = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise(F.array(F.lit("BUILDING"), F.lit("READ")))
    return rows.select("c_custkey", serving.permitted(granted, required).alias("permitted"))


def damage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, "l_orderkey", "l_linenumber")


def _points(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Penalty points and lists of parts by state, of parts and flags made from order lines."""
    n = F.col("l_quantity").cast("int")
    state = lambda k: F.element_at(F.array(*map(F.lit, ("DEGISEN", "BOYALI", "LOKAL", "ORIJINAL"))), (n + k) % 4 + 1)
    parts = F.create_map(F.lit("Motor Kaputu"), state(0), F.lit("Tavan"), state(1), F.lit("Sol Kapı"), state(2), F.lit("Sağ Kapı"), state(n % 3))
    flags = {"heavy_damage": F.col("l_returnflag") == "R", "chassis_action": F.col("l_tax") > 0.07, "scratch_dent": F.col("l_linestatus") == "O"}
    rows = V.table(spark, sf_dir, "lineitem")
    rows = rows.select("l_quantity", "l_returnflag", "l_linestatus", "l_tax").distinct() if not keys else rows
    return rows.select(
        *keys, "l_quantity", "l_returnflag", "l_linestatus", "l_tax", serving.damage_points(parts, flags).alias("points"), F.array_join(serving.parts_in(parts, "DEGISEN"), ",").alias("replaced"),
        F.array_join(serving.parts_in(parts, "BOYALI"), ",").alias("painted"),
    )


def json_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of the audit log; every tenth is broken and becomes null."""
    text = F.when(F.col("event_id") % 10 == 0, F.substring("props", 2, 100)).otherwise(F.col("props"))
    rows = V.table(spark, sf_dir, "events").select("event_id", serving.details(text, "k int").alias("d"))
    return rows.select("event_id", "d.k", F.to_json(F.struct(F.col("d.k").alias("k"), F.col("event_id").alias("id"))).alias("json"))


def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue file with mixed headers, defaults and repeated specs."""
    part = V.table(spark, sf_dir, "part")
    rows = part.select(
        F.col("p_partkey").alias("line"), F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.col("p_brand")).alias("Brand"), F.lit(None).cast("string").alias("brand"), F.col("p_type").alias("Model"), F.col("p_name").alias("variant"),
        F.when(F.col("p_size") % 2 == 0, F.lit(" ")).otherwise("SUV").alias("BodyType"), (1995 + F.col("p_partkey") % 7).cast("string").alias("Year"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("0").alias("horsepower"),
        (F.col("p_size") * 1000).cast("string").alias("price"),
    )
    return imports.latest_specs(imports.imported(rows)).select("line", "make", "model", "variant", "year", "body", "fuel", "horsepower", "doors", "market_average", "listing_average", "min_price", "max_price", "selling_days")


def dimension_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.dimension(V.specs(spark, sf_dir), "make", "model")


def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.rows_by_pattern(_pages(spark, sf_dir), "body").select("page", "year", "price", "tag")


def html_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.harvested_prices(_pages(spark, sf_dir), "body").groupBy("page").agg(F.count("*").alias("n"), F.min("price").alias("least"), F.max("price").alias("most"))


def html_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.rows_by_class(_pages(spark, sf_dir), "body", ["page"]).select("page", "listing_id", "title", "year", "price", "tag")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(V.unique_listings(spark, sf_dir))


def pages_of(rows: DataFrame, title: str = "model", models: DataFrame | None = None) -> DataFrame:
    """Results pages of all listings, as many a model as give about ``PAGE_ROWS`` listings each; ``models`` are the ``page_counts`` of the rows, if they were stored."""
    number = F.conv(F.substring(F.md5(F.col("listing_id").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("pages")
    return _paged(rows.join(page_counts(rows) if models is None else models, ["make", "model"]), F.concat("make", F.lit("/"), "model", F.lit("-"), number, F.lit(".html")), title)


def page_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("make", "model").agg(F.ceil(F.count("*") / html.PAGE_ROWS).alias("pages"))


def _paged(rows: DataFrame, page: Column, title: str) -> DataFrame:
    texts = {
        "listing": F.col("listing_id"), "tag": F.regexp_replace("variant", " ", "-"), "title": F.col(title), "year": F.col("year").cast("string"),
        "mileage": F.coalesce(F.col("mileage").cast("string"), F.lit("")), "price": X.thousands(F.col("price")),
    }
    cell = lambda css, *parts: F.concat(F.lit(f'<td class="{css}">'), *parts, F.lit("</td>"))
    row = lambda x: F.concat(
        F.lit('<tr class="searchResultsItem" data-id="'), x["listing"], F.lit('">'), cell("searchResultsTagAttributeValue", F.lit(" "), x["tag"], F.lit(" ")),
        cell("searchResultsTitleValue", F.lit("<a>"), x["title"], F.lit("</a>")), cell("searchResultsAttributeValue", F.lit(" "), x["year"]),
        cell("searchResultsAttributeValue", x["mileage"]), cell("searchResultsPriceValue", F.lit("<span>"), x["price"], F.lit(" TL</span>")), F.lit("</tr>"),
    )
    # Only the texts are shuffled; a row is many times as long.
    shown = F.filter(F.transform(F.collect_list(F.struct(*(text.alias(name) for name, text in texts.items()))), row), lambda x: x.isNotNull())
    body = F.concat(F.lit("<html><body><p>1.234 TL</p><table>"), F.array_join(F.sort_array(shown), "\n"), F.lit("</table></body></html>"))
    return rows.groupBy(page.alias("page")).agg(body.alias("body"))


def price_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = N.half_up(F.col("p_retailprice") * 1000)
    s, d = curves.simulated(x, F.col("p_size") * 0.004, F.col("p_size") * 0.002, 1.02, 0.01), curves.display_prices(x)
    title = X.title_case(F.concat(F.lit("istanbul ILGAZ "), F.lower("p_type")))
    return V.table(spark, sf_dir, "part").select("p_partkey", s["value"].alias("value"), s["buying"].alias("buying"), s["listing"].alias("listing"), d["market"].alias("market"), d["low"].alias("low"), d["net"].alias("net"), title.alias("title"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the original surface: events by day and kind."""
    rows = V.table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(N.half_up(F.col("value") * 100)).alias("hundredths"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "hundredths")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the original surface: a user's sessions, ended by six hours without events."""
    rows = V.table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"), F.sum("n").alias("n_events"))


def price_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the original surface: counts and price sums by make, model and year, with subtotals."""
    return V.listings(spark, sf_dir).rollup("make", "model", "year").agg(F.count("*").alias("n"), F.sum("price").alias("total"), F.grouping_id().cast("int").alias("level"))


QUERIES = (
    canonical_names, cleaned_names, quarantine_split, parsed_numbers, technical_data, depreciation, recalibrated_prices, inflation_sync, fallback_prices, flat_prices, spec_cross, spec_lookup,
    models_without_specs, upsert_merge, find_or_create, conditional_update, replace_prices, filtered_delete, cascade_delete, published_version, facets, dashboard_kpis, latest_page, recent_joined, price_list,
    text_search, term_search, nested_exists, unknown_brands, permission_check, damage_points, json_details, import_rows, dimension_keys, html_rows, html_prices, html_parsed, price_display, event_windows,
    event_sessions, price_rollup,
)

def _values() -> str:
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({k}, {', '.join(map(quote, row))})" for k, row in enumerate(RAW_NAMES))


_NAMES = f"""names(k, make, model, variant, title) AS (VALUES {_values()}), raw_names AS (
  SELECT p_partkey AS id, make, model, variant, title, p_retailprice FROM part JOIN names ON k = p_partkey % {len(RAW_NAMES)}
)"""


def _clean(x: str) -> str:
    out = f"regexp_replace(coalesce({x}, ''), '\\s*-\\s*[0-9]+$', '')"
    for fragment in X.JUNK:
        fragment = fragment.replace("'", "''")
        out = f"regexp_replace({out}, '{fragment}', '', 'gi')"
    return f"trim(regexp_replace(regexp_replace({out}, '[-_]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _fold(x: str) -> str:
    return f"translate({x}, '{X.TURKISH}', '{X.PLAIN}')"


def _any(fields: list[str], needles: tuple) -> str:
    return "(" + " OR ".join(f"contains({f}, '{n}')" for f in fields for n in needles) + ")"


def _case(fields: list[str], rules: tuple, default: str, pick=lambda v: f"'{v}'") -> str:
    return "CASE " + " ".join(f"WHEN {_any(fields, n)} THEN {pick(v)}" for n, v in rules) + f" ELSE {default} END"


_FIELDS = {"model": "um", "title": "ut", "variant": "uv", "raw_model": "m", "raw_title": "t", "all": "concat_ws(' ', um, ut, uv)"}


def _models() -> str:
    return "CASE " + " ".join(
        f"WHEN cmake = '{make}' THEN CASE " + " ".join(f"WHEN {' OR '.join(_any([_FIELDS[f]], n) for f, n in needles.items())} THEN '{out}'" for needles, out in rules) + " END" for make, rules in N_MODELS.items()
    ) + " END"


_CANONICAL = f"""{_NAMES}, n1 AS (SELECT *, {_clean('make')} AS mk, {_clean('model')} AS m, {_clean('variant')} AS v, {_clean('title')} AS t FROM raw_names),
n2 AS (SELECT *, {_fold('upper(mk)')} AS umk, {_fold('upper(m)')} AS um, {_fold('upper(t)')} AS ut, {_fold('upper(v)')} AS uv FROM n1),
n3 AS (SELECT *, {_case(['umk'], N_MAKES, 'mk')} AS cmake FROM n2),
n4 AS (SELECT *, {_models()} AS known FROM n3),
n5 AS (SELECT *, CASE WHEN cmake IN ('DS Automobiles', 'BYD', 'Cupra', 'Daihatsu') THEN known ELSE coalesce(known, m) END AS cmodel FROM n4),
n6 AS (SELECT *, CASE WHEN length(cmake) < 2 THEN '{N_BAD_MAKE}' WHEN cmodel IS NULL OR length(cmodel) < 2 OR cmodel = 'Genel Model' OR upper(cmodel) = upper(cmake)
    OR upper(cmodel) = regexp_replace(upper(cmake), '\\s+', '', 'g') OR regexp_replace(upper(cmodel), '\\s+', '', 'g') = upper(cmake) OR {_any(['upper(cmodel)'], N_DEBRIS)} THEN '{N_BAD_MODEL}' END AS reason FROM n5),
canonical AS (SELECT id, CASE WHEN reason = '{N_BAD_MAKE}' THEN coalesce(make, '') ELSE cmake END AS cmake, CASE WHEN reason IS NULL THEN cmodel ELSE coalesce(model, '') END AS cmodel,
  CASE WHEN reason IS NULL AND v <> '' AND v NOT IN ('Standart', 'FarkliVaryant', 'Genel Model') AND NOT regexp_matches(v, '^[0-9]+$') AND NOT {_any(['lower(v)'], N_VARIANT_DEBRIS)} THEN v END AS cvariant,
  reason IS NULL AS is_valid, reason, make AS raw_make, model AS raw_model, title, p_retailprice FROM n6)"""
_DAMAGED = _any(["lower(coalesce(title, ''))"], X.DAMAGE_WORDS)
_TIERED = f"""WITH {V.SPECS}, tiered AS (SELECT *, ['exotic', 'luxury', 'standard', 'economy'][1 + size % 4] AS tier, year * 4 - 5978 + size % 4 AS model_year, coalesce(package, '') AS pkg FROM specs),
aged AS (SELECT *, greatest(0, 2026 - model_year) AS age FROM tiered)"""
_R = lambda x: f"floor({x} + 0.5::DOUBLE)::BIGINT"
_D = lambda v: f"{v!r}::DOUBLE"
_BY_YEAR = "CASE tier " + " ".join(f"WHEN '{k}' THEN CASE WHEN model_year >= 2026 THEN 1::DOUBLE WHEN model_year <= 2004 THEN {_D(v[-1] * 0.9)} ELSE {[float(x) for x in v]}[1 + 2026 - model_year]::DOUBLE END" for k, v in curves.YEAR_CURVES.items()) + " END"
_PACKAGE = "CASE " + " ".join(f"WHEN pkg IN {tuple(n)} THEN {_D(f)}" for n, f in curves.PACKAGES) + " ELSE 1::DOUBLE END"
_OLD_NEW = """WITH o AS (SELECT p_partkey, p_brand, p_size, p_retailprice FROM part WHERE p_partkey % 3 <> 0), n AS (
  SELECT p_partkey, p_brand, p_size + 100 AS p_size, CASE WHEN p_size % 2 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part WHERE p_partkey % 3 <> 1)"""
_SEGMENT = lambda k: f"CASE WHEN {_any(['lower(make)'], curves.SEGMENTS[0][0])} THEN {curves.SEGMENTS[0][k]} WHEN {_any(['lower(make)'], curves.SEGMENTS[1][0])} THEN {curves.SEGMENTS[1][k]} WHEN {_any(['lower(make)'], curves.SEGMENTS[2][0])} OR contains(lower(model), 'clio') THEN {curves.SEGMENTS[2][k]} ELSE {curves.DEFAULT_SEGMENT[k - 1]} END"
_HTML = f"""WITH {V.LISTINGS}, counted AS (SELECT *, ceil(count(*) OVER (PARTITION BY make, model) / {html.PAGE_ROWS})::BIGINT AS pages FROM unique_listings),
shown AS (SELECT concat(make, '/', model, '-', ('0x' || substr(md5(listing_id), 1, 8))::BIGINT % pages, '.html') AS page, * FROM counted)"""
_STATE = lambda k: f"['DEGISEN', 'BOYALI', 'LOKAL', 'ORIJINAL'][1 + (n + {k}) % 4]"
_PARTS = {"Motor Kaputu": _STATE("0"), "Tavan": _STATE("1"), "Sol Kapı": _STATE("2"), "Sağ Kapı": _STATE("n % 3")}
_POINTS = " + ".join(f"CASE {s} " + " ".join(f"WHEN '{state}' THEN {v[0] if part in serving.MAIN_PARTS else v[1]}" for state, v in serving.PART_POINTS.items()) + " ELSE 0 END" for part, s in _PARTS.items())
_IN_STATE = lambda state: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {s} = '{state}' THEN '{p}' END" for p, s in _PARTS.items()) + "], lambda x: x IS NOT NULL)), ',')"

ORACLES = {
    "canonical_names": f"WITH {_CANONICAL} SELECT id, cmake AS make, cmodel AS model, cvariant AS variant, is_valid, reason FROM canonical",
    "cleaned_names": f"""WITH {_NAMES}, c AS (SELECT *, {_clean('model')} AS m, {_clean('make')} AS k, coalesce(make, '') AS b FROM raw_names)
      SELECT id, m AS model, {_fold('upper(k)')} AS make, CASE WHEN starts_with(lower(m), lower(b) || ' ') THEN trim(substr(m, length(b) + 2)) ELSE m END AS short, {_DAMAGED} AS is_damaged,
      regexp_matches(lower({_fold("coalesce(title, '')")}), '\\b(agir hasar\\w*|pert)\\b') AS is_damaged_strict, CASE WHEN trim(coalesce(variant, '')) NOT IN ('', 'Standart', 'FarkliVaryant') THEN variant END AS known_variant,
      regexp_matches(trim(coalesce(variant, '')), '^[0-9]+$') AS is_number FROM c""",
    "quarantine_split": f"""WITH {_CANONICAL}, judged AS (
        SELECT (id // 2)::VARCHAR AS listing_id, cmake, cmodel, cvariant, title, (1990 + id % 40)::INT AS year, id * 997 % 300000 AS mileage, round(p_retailprice * 60)::BIGINT AS price, raw_make, raw_model, {_DAMAGED} AS is_damaged,
          CASE WHEN price NOT BETWEEN 50000 AND 150000000 THEN '{listings.BAD_PRICE}' WHEN year NOT BETWEEN 1980 AND 2026 THEN '{listings.BAD_YEAR}' ELSE reason END AS why FROM canonical),
      bad AS (SELECT * FROM judged WHERE why IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listing_id, why ORDER BY price, listing_id, why, raw_make NULLS LAST, raw_model NULLS LAST, year) = 1),
      good AS (SELECT *, CASE WHEN mileage NOT IN (year, price) THEN mileage END AS km FROM judged WHERE why IS NULL
        QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY price, km NULLS LAST, cmake, cmodel, cvariant NULLS LAST, title NULLS LAST, year, is_damaged) = 1)
      SELECT listing_id, cmake AS make, cmodel AS model, year, price, NULL::VARCHAR AS reason FROM good WHERE listing_id NOT IN (SELECT listing_id FROM bad)
      UNION ALL SELECT listing_id, raw_make, raw_model, year, price, why FROM bad""",
    "parsed_numbers": """WITH r AS (SELECT s_suppkey, format('{:,.2f} TL', s_acctbal) AS price, s_name, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE s_name || ' / Kadıköy' END AS place, lpad((s_suppkey * 7919)::VARCHAR, 10, '5') AS phone FROM supplier)
      SELECT s_suppkey, regexp_replace(price, '[^0-9]', '', 'g')::BIGINT AS price_digits, regexp_replace(s_name, '[^0-9]', '', 'g')::BIGINT AS name_digits, trim(string_split(place, '/')[1]) AS city,
      CASE WHEN contains(place, '/') THEN trim(string_split(place, '/')[2]) ELSE '' END AS district, replace(format('{:,}', s_suppkey * 12345), ',', '.') AS dotted,
      CASE WHEN starts_with(phone, '90') THEN phone WHEN starts_with(phone, '0') THEN '9' || phone WHEN length(phone) = 10 THEN '90' || phone ELSE phone END AS phone FROM r""",
    "technical_data": f"""WITH {_NAMES}, e AS (SELECT *, upper(concat_ws(' ', coalesce(model, ''), coalesce(variant, ''))) AS name, lower(coalesce(variant, '')) AS lv, upper(concat_ws(' ', coalesce(title, ''), coalesce(variant, ''))) AS tt FROM raw_names),
      f AS (SELECT *, {_case(['name'], inference.ENGINES, '120', lambda v: str(v[1]))} AS horsepower, {_case(['lv'], inference.BODIES, "'Sedan'")} AS body FROM e)
      SELECT id, round(({_case(['name'], inference.ENGINES, '1.6', lambda v: str(v[0]))}) * 1000)::INT AS engine_cc, horsepower::INT AS horsepower, floor(horsepower * 1.8::DOUBLE + 0.5::DOUBLE)::INT AS torque,
      CASE WHEN {_any(['lv'], inference.DIESEL)} THEN 'Dizel' ELSE 'Benzin' END AS fuel, body, CASE WHEN body IN ('Coupe', 'Cabrio') THEN 2 WHEN body = 'Hatchback' THEN 5 ELSE 4 END AS doors, CASE WHEN body = 'Coupe' THEN 4 ELSE 5 END AS seats,
      CASE WHEN {_any(['lv'], inference.FOUR_WHEELS)} THEN '4x4' ELSE 'Önden Çekiş' END AS drive, {_case(['tt'], inference.TRIMS, "'Paket'")} AS trim FROM f""",
    "depreciation": f"""{_TIERED} SELECT make, model, variant, year, {_R('msrp * 0.25::DOUBLE + (msrp - msrp * 0.25::DOUBLE) * pow(0.88::DOUBLE, age)')} AS to_floor, {_R('msrp * pow(0.92::DOUBLE, age)')} AS geometric,
      {_R(f'msrp * greatest(0.48::DOUBLE, 1 - age * 0.025::DOUBLE - pow(age::DOUBLE, 1.2::DOUBLE) * 0.002::DOUBLE) * {_PACKAGE}')} AS concave, {_R(f'msrp * {_BY_YEAR}')} AS by_year,
      {_R('msrp * greatest(0.30::DOUBLE, 1 - age * 0.06::DOUBLE)')} AS linear,
      {_R(f"(msrp * 0.2::DOUBLE + (msrp - msrp * 0.2::DOUBLE) * pow(0.9::DOUBLE, age)) * {_case(['lower(variant)'], curves.VARIANT_FACTORS, '1::DOUBLE', _D)} * {_case(['pkg'], curves.PACKAGE_FACTORS, '1::DOUBLE', _D)}")} AS catalogue FROM aged""",
    "recalibrated_prices": f"""{_TIERED}, m AS (SELECT *, {_R(f'msrp * {_BY_YEAR}')} AS new_msrp FROM aged), a AS (SELECT *, {_R('new_msrp / 1.2::DOUBLE')} AS average FROM m)
      SELECT make, model, variant, model_year::INT AS year, new_msrp, average AS market_average, {_R('average * 1.05::DOUBLE')} AS clean_average, {_R('average * 1.03::DOUBLE')} AS listing_average, {_R('average * 0.92::DOUBLE')} AS min_price,
      {_R('average * 1.08::DOUBLE')} AS max_price, CASE WHEN tier = 'economy' THEN 12 ELSE 20 END AS selling_days, new_msrp <> msrp AS changed FROM a""",
    "inflation_sync": f"WITH {V.SPECS} SELECT make, model, variant, year, CASE WHEN msrp > 0 AND make IN ('Brand#11', 'Brand#22', 'Brand#33') THEN floor(msrp * 1.025::DOUBLE + 0.5::DOUBLE) ELSE msrp END AS msrp FROM specs",
    "fallback_prices": f"""WITH {V.LISTINGS}, {V.SPECS}, known AS (SELECT make, model, variant, year, count(*) AS n, {_R('sum(price)::DOUBLE / count(*)')} AS a, coalesce({_R('sum(price) FILTER (NOT is_damaged)::DOUBLE / nullif(count(*) FILTER (NOT is_damaged), 0)')}, {_R('sum(price)::DOUBLE / count(*)')}) AS c FROM listings GROUP BY ALL HAVING count(*) >= 3),
      back AS (SELECT *, {_R(f'{_SEGMENT(2)} + ({_SEGMENT(1)} - {_SEGMENT(2)}) * pow(0.88::DOUBLE, greatest(0, 2002 - year))')} AS b FROM specs)
      SELECT make, model, variant, year, CASE WHEN a IS NULL THEN 'Fallback Model' ELSE 'Scraped' END AS source, coalesce(a, b) AS average, coalesce(c, {_R('b * 1.05::DOUBLE')}) AS clean_average FROM back LEFT JOIN known USING (make, model, variant, year)""",
    "flat_prices": f"""WITH {V.LISTINGS}, v AS (SELECT make, model, list(price ORDER BY price) AS v FROM listings GROUP BY ALL)
      SELECT make, model, unnest([2024, 2023, 2022, 2021, 2020]) AS year, len(v)::INT AS n, {", ".join(f"v[1 + floor(len(v) * {p}::DOUBLE)::INT] AS {c}" for c, p in (("min_price", 0.05), ("cash_price", 0.35), ("average", 0.5), ("listing_price", 0.6), ("max_price", 0.95)))} FROM v""",
    "spec_cross": f"""WITH {V.SPECS}, p AS (SELECT DISTINCT make, model, package FROM specs WHERE package IS NOT NULL), v AS (SELECT DISTINCT make, model, variant FROM specs)
      SELECT v.make, v.model, variant, p.package, unnest([1999, 2000, 2001]) AS year FROM v LEFT JOIN p ON v.make = p.make AND v.model = p.model""",
    "spec_lookup": f"""WITH {V.LISTINGS}, {V.SPECS} SELECT listing_id, coalesce(body, '') AS body, coalesce(fuel, '') AS fuel, coalesce(transmission, '') AS transmission
      FROM listings l LEFT JOIN specs s ON lower(s.make) = lower(l.make) AND s.model = l.model AND lower(s.variant) = lower(l.variant) AND s.year = l.year + l.price % 2""",
    "models_without_specs": f"WITH {V.SPECS} SELECT DISTINCT make, variant FROM specs EXCEPT SELECT make, variant FROM specs WHERE size > 10",
    "upsert_merge": f"{_OLD_NEW} SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, coalesce(o.p_brand, n.p_brand) AS p_brand, coalesce(o.p_size, n.p_size) AS p_size, coalesce(n.p_retailprice, o.p_retailprice) AS p_retailprice FROM o FULL JOIN n ON o.p_partkey = n.p_partkey",
    "find_or_create": f"{_OLD_NEW} FROM o UNION ALL FROM n WHERE p_partkey NOT IN (SELECT p_partkey FROM o)",
    "conditional_update": f"{_OLD_NEW} SELECT n.p_partkey, n.p_retailprice FROM n JOIN o ON o.p_partkey = n.p_partkey WHERE n.p_retailprice <> o.p_retailprice",
    "replace_prices": f"{_OLD_NEW} FROM o WHERE p_brand NOT IN (SELECT p_brand FROM n WHERE p_brand < 'Brand#3') UNION ALL FROM n WHERE p_brand < 'Brand#3'",
    "filtered_delete": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "cascade_delete": """SELECT 'nation' AS level, n_nationkey::BIGINT AS key FROM nation WHERE n_nationkey NOT IN (3, 7) UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_nationkey NOT IN (3, 7)
      UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7))""",
    "published_version": "SELECT p_brand, count(*) AS n FROM part GROUP BY 1",
    "facets": f"""WITH {V.SPECS}, b AS (SELECT * FROM specs WHERE year = 1999 AND make = 'Brand#11'), f AS (
        SELECT 'model' AS facet, list_sort(list(DISTINCT model)) AS c FROM b UNION ALL SELECT 'body', list_sort(list(DISTINCT body)) FROM b UNION ALL SELECT 'fuel', list_sort(list(DISTINCT fuel)) FROM b WHERE body = 'Sedan'
        UNION ALL SELECT 'transmission', list_sort(list(DISTINCT transmission)) FROM b WHERE body = 'Sedan' AND fuel = 'Dizel' UNION ALL SELECT 'package', list_sort(list(DISTINCT package) FILTER (package IS NOT NULL)) FROM b WHERE body = 'Sedan' AND fuel = 'Dizel')
      SELECT facet, coalesce(array_to_string(c, ','), '') AS choices, CASE WHEN len(c) = 1 THEN c[1] END AS auto FROM f""",
    "dashboard_kpis": f"""SELECT count(*) AS n_evaluations, {_R('sum(floor(o_totalprice + 0.5::DOUBLE)::BIGINT)::DOUBLE / count(*)')} AS average_valuation, count(*) AS n_consignments, count(*) FILTER (o_orderstatus = 'P') AS n_pending,
      count(*) FILTER (o_orderstatus = 'O') AS n_approved, count(*) FILTER (o_orderstatus NOT IN ('P', 'O')) AS n_completed FROM orders""",
    "latest_page": "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 200",
    "recent_joined": "SELECT o_orderkey, o_totalprice, c_name, n_name FROM (FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5) LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
    "price_list": f"WITH {V.SPECS} SELECT make, model, variant, year, coalesce(package, '-') AS package, replace(format('{{:,}}', msrp::BIGINT), ',', '.') AS msrp FROM specs WHERE make = 'Brand#12'",
    "text_search": "SELECT c_custkey, c_mktsegment FROM customer WHERE contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')",
    "term_search": "SELECT p_partkey, p_brand, p_type FROM part WHERE contains(p_brand, '#13') OR contains(p_type, 'PROMO') OR contains(p_brand, 'PROMO') OR contains(p_type, '#13')",
    "nested_exists": "SELECT n_nationkey, n_name FROM nation WHERE EXISTS (FROM customer WHERE c_nationkey = n_nationkey AND EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000))",
    "unknown_brands": "SELECT DISTINCT p_brand FROM part WHERE lower(p_brand) NOT IN (SELECT lower(p_brand) FROM part WHERE p_size > 45)",
    "permission_check": """SELECT c_custkey, c_custkey % 5 = 0 OR c_custkey % 7 <> 0 AND c_mktsegment = 'BUILDING' AS permitted FROM customer""",
    "damage_points": f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus, l_tax, l_quantity::INT AS n FROM lineitem)
      SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus, l_tax, least(60, {_POINTS} + CASE WHEN l_returnflag = 'R' THEN 35 ELSE 0 END + CASE WHEN l_tax > 0.07::DOUBLE THEN 25 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 2 ELSE 0 END)::INT AS points,
      {_IN_STATE('DEGISEN')} AS replaced, {_IN_STATE('BOYALI')} AS painted FROM l""",
    "json_details": """SELECT event_id, k, CASE WHEN k IS NULL THEN concat('{"id":', event_id, '}') ELSE concat('{"k":', k, ',"id":', event_id, '}') END AS json
      FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN (props->>'$.k')::INT END AS k FROM events)""",
    "import_rows": f"""WITH r AS (SELECT p_partkey AS line, p_brand AS make, p_type AS model, p_name AS variant, (1995 + p_partkey % 7)::INT AS year, CASE WHEN p_size % 2 = 0 THEN 'Sedan' ELSE 'SUV' END AS body, 'Benzin' AS fuel,
        CASE WHEN p_size > 25 THEN p_size ELSE 110 END::DOUBLE AS horsepower, 4::DOUBLE AS doors, (p_size * 1000)::DOUBLE AS market_average, 20::DOUBLE AS selling_days FROM part WHERE p_partkey % 11 <> 0)
      SELECT line, make, model, variant, year, body, fuel, horsepower, doors, market_average, market_average * 1.03::DOUBLE AS listing_average, market_average * 0.92::DOUBLE AS min_price, market_average * 1.08::DOUBLE AS max_price, selling_days
      FROM r QUALIFY row_number() OVER (PARTITION BY year, make, model, variant, body ORDER BY line DESC) = 1""",
    "dimension_keys": f"WITH {V.SPECS} SELECT DISTINCT make, model, sha256(concat(make, chr(1), model)) AS model_id FROM specs",
    "html_rows": f"{_HTML} SELECT page, year, price, replace(variant, ' ', '-') AS tag FROM shown WHERE price BETWEEN 50000 AND 150000000",
    "html_prices": f"{_HTML} SELECT page, count(*) AS n, min(price) AS least, max(price) AS most FROM shown WHERE price > 50000 GROUP BY 1",
    "html_parsed": f"{_HTML} SELECT page, listing_id, model AS title, year, price, replace(variant, ' ', '-') AS tag FROM shown",
    "price_display": f"""WITH p AS (SELECT *, {_R('p_retailprice * 1000')} AS x FROM part), v AS (SELECT *, {_R('x * ((1 - p_size * 0.004::DOUBLE - p_size * 0.002::DOUBLE) * 1.02::DOUBLE + 0.01::DOUBLE)')} AS value, {_R('x / 0.88::DOUBLE')} AS market FROM p)
      SELECT p_partkey, value, {_R('value * 0.91::DOUBLE')} AS buying, {_R('value * 1.08::DOUBLE')} AS listing, market, {_R('market * 0.94::DOUBLE')} AS low, {_R('market * 0.96::DOUBLE')} AS net,
      'İstanbul Ilgaz ' || array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(translate(w[1], 'iı', 'İI')) || w[2:]), ' ') AS title FROM v""",
    "event_windows": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, sum(floor(value * 100 + 0.5::DOUBLE)::BIGINT)::BIGINT AS hundredths FROM events GROUP BY ALL",
    "event_sessions": """WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR AS near FROM events), s AS (SELECT user_id, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
      c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS n_sessions, max(n) AS longest, sum(n)::BIGINT AS n_events FROM c GROUP BY 1""",
    "price_rollup": f"WITH {V.LISTINGS} SELECT make, model, year, count(*) AS n, sum(price)::BIGINT AS total, grouping(make, model, year)::INT AS level FROM listings GROUP BY ROLLUP (make, model, year)",
}
