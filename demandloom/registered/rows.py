"""Sources, sinks, projections, filters, row changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.functions import money_label
from demandloom.operators import catalog, features as feat
from demandloom.registered.base import query
from demandloom.schemas import BOOKING_CSV, LISTING_CSV, LISTING_VIEW, listing_rules
from demandloom.session import scratch_path
from demandloom.sources import demo
from demandloom.sources.tables import (
    append_new,
    scan_csv,
    scan_offline,
    scan_projected,
    write_offline,
)

KEY, LABEL = LISTING_VIEW.key, LISTING_VIEW.label
FEATURES = LISTING_VIEW.feature_names
STORED = "vehicle_id, technology, num_images, street_parked, description, price_diff, num_reservations"


@query("scan_entities_csv", "listings", "SELECT * EXCLUDE (source), 'csv' AS source FROM listings")
def scan_entities_csv(spark, folder):
    path = scratch_path(spark, "vehicles-csv")
    demo.listings(spark, folder).drop("source").write.option("header", True).csv(path)
    return scan_csv(spark, path, LISTING_CSV, "csv")


@query(
    "scan_facts_csv",
    "",
    "SELECT l_partkey AS vehicle_id, CAST(l_shipdate AS DATE) AS created_day, count(*) AS n FROM lineitem GROUP BY ALL",
)
def scan_facts_csv(spark, folder):
    path = scratch_path(spark, "reservations-csv")
    items = demo.table(spark, folder, "lineitem")
    items.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_partkey").alias("vehicle_id"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    ).write.option("header", True).csv(path)
    facts = scan_csv(spark, path, BOOKING_CSV)
    return facts.groupBy("vehicle_id", F.col("created_at").cast("date").alias("created_day")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("scan_projected", "", "SELECT l_partkey, CAST(l_shipdate AS DATE) AS shipped FROM lineitem")
def scan_projected_query(spark, folder):
    rows = scan_projected(spark, f"{folder}/lineitem.parquet", ["l_partkey", "l_shipdate"])
    return rows.select("l_partkey", F.col("l_shipdate").cast("date").alias("shipped"))


@query("scan_offline", "offline", "SELECT vehicle_id, price_diff, num_reservations FROM offline")
def scan_offline_query(spark, folder):
    path = scratch_path(spark, "offline")
    write_offline(demo.offline(spark, folder), path)
    return scan_offline(spark, path).select(KEY, "price_diff", LABEL)


@query("sink_offline", "offline", f"SELECT {STORED} FROM offline")
def sink_offline(spark, folder):
    path = scratch_path(spark, "offline")
    write_offline(demo.offline(spark, folder).limit(0), path)
    write_offline(demo.offline(spark, folder), path)
    return spark.read.parquet(path).drop("event_timestamp")


@query("load_idempotent", "listings", "SELECT * FROM listings")
def load_idempotent(spark, folder):
    path = scratch_path(spark, "vehicles")
    rows = demo.listings(spark, folder)
    append_new(spark, rows.where(F.col("source") == "csv"), path, KEY, unique=True)
    append_new(spark, rows.unionByName(rows), path, KEY, unique=True)
    append_new(spark, rows, path, KEY, unique=True)
    return spark.read.parquet(path)


@query(
    "load_grown_file",
    "bookings",
    "SELECT nullif(vehicle_id, 3) AS vehicle_id, created_at FROM bookings UNION ALL "
    "SELECT nullif(vehicle_id, 3), created_at FROM bookings WHERE vehicle_id < 9",
)
def load_grown_file(spark, folder):
    """Facts with repeated and NULL keys: a file that has grown by repeats, loaded twice."""
    path = scratch_path(spark, "reservations")
    first = demo.bookings(spark, folder)
    grown = first.unionByName(first.where(F.col(KEY) < 9))
    for part in (first, grown, grown):
        rows = part.withColumn(KEY, F.when(F.col(KEY) != 3, F.col(KEY)))
        append_new(spark, rows, path, [KEY, "created_at"])
    return spark.read.parquet(path)


@query("price_diff", "listings", "SELECT vehicle_id, actual_price - recommended_price AS price_diff FROM listings")
def price_diff(spark, folder):
    return feat.price_diff(demo.listings(spark, folder)).select(KEY, "price_diff")


@query("price_ratio", "listings", "SELECT vehicle_id, actual_price / recommended_price AS price_ratio FROM listings")
def price_ratio(spark, folder):
    return feat.price_ratio(demo.listings(spark, folder)).select(KEY, "price_ratio")


@query(
    "money_label",
    "listings",
    """SELECT vehicle_id, CASE WHEN d >= 0 THEN '+' ELSE '' END || '$' || CAST(CAST(round(d) AS BIGINT) AS VARCHAR)
       AS price_label FROM (SELECT vehicle_id, actual_price - recommended_price AS d FROM listings)""",
)
def money_label_query(spark, folder):
    rows = feat.price_diff(demo.listings(spark, folder))
    return rows.select(KEY, money_label("price_diff").alias("price_label"))


@query("feature_build", "features", f"SELECT {STORED} FROM features")
def feature_build(spark, folder):
    built = feat.feature_build(demo.listings(spark, folder), demo.bookings(spark, folder))
    return built.drop("event_timestamp")


@query(
    "feature_build_all_items",
    "listings",
    """SELECT l.vehicle_id, technology, num_images, street_parked, description,
       actual_price - recommended_price AS price_diff,
       coalesce(sold, CASE source WHEN 'csv' THEN 0 END) AS num_reservations
       FROM listings l LEFT JOIN (SELECT l_partkey, count(*) AS sold FROM lineitem GROUP BY ALL)
       ON l_partkey = l.vehicle_id""",
)
def feature_build_all_items(spark, folder):
    items = demo.table(spark, folder, "lineitem").select(F.col("l_partkey").alias(KEY))
    return feat.feature_build(demo.listings(spark, folder), items).drop("event_timestamp")


@query("conditional_zero_fill", "catalog", "SELECT vehicle_id, source, num_reservations FROM catalog")
def conditional_zero_fill(spark, folder):
    counted = feat.left_join_counts(demo.listings(spark, folder), demo.bookings(spark, folder), KEY)
    return feat.conditional_zero_fill(counted, LABEL, "source").select(KEY, "source", LABEL)


@query("fleet_rows", "features", f"SELECT {STORED} FROM features WHERE num_reservations IS NOT NULL")
def fleet_rows(spark, folder):
    return feat.fleet_rows(demo.features(spark, folder)).drop("event_timestamp")


@query("new_arrivals", "features", f"SELECT {STORED} FROM features WHERE num_reservations IS NULL")
def new_arrivals(spark, folder):
    return feat.new_arrivals(demo.features(spark, folder)).drop("event_timestamp")


@query(
    "feature_select",
    "features",
    "SELECT vehicle_id, technology, num_images, street_parked, description, price_diff FROM features",
)
def feature_select(spark, folder):
    return feat.feature_select(demo.features(spark, folder), LISTING_VIEW, keep=[KEY])


@query(
    "coerce_types",
    "listings",
    """SELECT vehicle_id, technology, num_images, street_parked, description,
       actual_price - recommended_price AS price_diff, CAST(NULL AS BIGINT) AS num_reservations FROM listings""",
)
def coerce_types(spark, folder):
    text = demo.listings(spark, folder).select(
        *[F.col(c).cast("string") for c in (KEY, "technology", "num_images", "street_parked", "description")],
        (F.col("actual_price") - F.col("recommended_price")).alias("price_diff"),
    )
    return feat.coerce_types(text, LISTING_VIEW.schema).drop("event_timestamp")


BROKEN_LISTINGS = """SELECT vehicle_id,
    CASE WHEN c_acctbal IS NOT NULL AND c_nationkey > 20 THEN 2 ELSE technology END AS technology,
    CASE WHEN c_acctbal < 0 THEN c_acctbal ELSE actual_price END AS actual_price,
    recommended_price,
    CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE num_images END AS num_images,
    street_parked, description
    FROM listings LEFT JOIN customer ON c_custkey = vehicle_id"""


def broken_listings(spark, folder):
    """Listings damaged by customer values: wrong flag, negative price, missing photo count."""
    customer = demo.table(spark, folder, "customer").select(
        F.col("c_custkey").alias(KEY), "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    rows = demo.listings(spark, folder).join(customer, KEY, "left")
    return rows.select(
        KEY,
        F.when(F.col("c_nationkey") > 20, 2).otherwise(F.col("technology")).alias("technology"),
        F.when(F.col("c_acctbal") < 0, F.col("c_acctbal")).otherwise(F.col("actual_price")).alias("actual_price"),
        "recommended_price",
        F.when(F.col("c_mktsegment") == "BUILDING", None).otherwise(F.col("num_images")).alias("num_images"),
        "street_parked",
        "description",
    )


@query(
    "validate_rows",
    "listings",
    f"""SELECT vehicle_id, array_to_string(list_filter([
         CASE WHEN coalesce(vehicle_id > 0, false) THEN NULL ELSE 'vehicle_id' END,
         CASE WHEN coalesce(technology BETWEEN 0 AND 1, false) THEN NULL ELSE 'technology' END,
         CASE WHEN coalesce(actual_price > 0, false) THEN NULL ELSE 'actual_price' END,
         CASE WHEN coalesce(recommended_price > 0, false) THEN NULL ELSE 'recommended_price' END,
         CASE WHEN coalesce(num_images >= 0, false) THEN NULL ELSE 'num_images' END,
         CASE WHEN coalesce(street_parked BETWEEN 0 AND 1, false) THEN NULL ELSE 'street_parked' END,
         CASE WHEN coalesce(description >= 0, false) THEN NULL ELSE 'description' END],
         lambda x: x IS NOT NULL), ',') AS errors FROM ({BROKEN_LISTINGS})""",
)
def validate_rows(spark, folder):
    valid, rejects = feat.validate_rows(broken_listings(spark, folder), listing_rules())
    return (
        valid.select(KEY, F.lit("").alias("errors"))
        .unionByName(rejects.select(KEY, F.concat_ws(",", "errors").alias("errors")))
    )


@query(
    "null_guard",
    "listings",
    f"""SELECT vehicle_id, technology IS NOT NULL AND actual_price IS NOT NULL AND num_images IS NOT NULL
        AS complete FROM ({BROKEN_LISTINGS})""",
)
def null_guard(spark, folder):
    ok, missing = feat.null_guard(broken_listings(spark, folder), ["technology", "actual_price", "num_images"])
    return ok.select(KEY, F.lit(True).alias("complete")).unionByName(
        missing.select(KEY, F.lit(False).alias("complete"))
    )


SEARCHED = """contains(CAST(vehicle_id AS VARCHAR), '{q}') OR
    contains(regexp_replace(CAST(actual_price AS VARCHAR), '\\.0$', ''), '{q}')"""


@query(
    "search_filter",
    "catalog",
    f"SELECT vehicle_id, actual_price FROM catalog WHERE {SEARCHED.format(q='90')}",
)
def search_filter(spark, folder):
    return catalog.search_filter(demo.listings(spark, folder), "90").select(KEY, "actual_price")


@query(
    "split_and_limit",
    "catalog",
    f"""SELECT vehicle_id, side, rank, total FROM (
        SELECT vehicle_id, side, row_number() OVER (PARTITION BY side ORDER BY vehicle_id) AS rank,
               count(*) OVER (PARTITION BY side) AS total
        FROM (SELECT vehicle_id, CASE WHEN num_reservations IS NULL THEN 'arrivals' ELSE 'fleet' END AS side
              FROM catalog WHERE {SEARCHED.format(q='1')})) WHERE rank <= 50""",
)
def split_and_limit(spark, folder):
    rows = catalog.list_entities(demo.listings(spark, folder), demo.bookings(spark, folder))
    page = catalog.split_and_limit(catalog.search_filter(rows, "1"))
    return page.select(KEY, "side", F.col("rank").cast("long").alias("rank"), "total")


@query(
    "listing_bands",
    "listings",
    """SELECT vehicle_id,
       CASE WHEN actual_price / recommended_price <= 0.9 THEN 'Below market'
            WHEN actual_price / recommended_price <= 1.1 THEN 'At market' ELSE 'Above market' END AS price_band,
       CASE WHEN num_images >= 15 THEN 'Excellent' WHEN num_images >= 8 THEN 'Good'
            WHEN num_images >= 3 THEN 'Fair' ELSE 'Poor' END AS photo_band,
       CASE WHEN description >= 300 THEN 'Detailed' WHEN description >= 100 THEN 'Basic'
            ELSE 'Minimal' END AS description_band FROM listings""",
)
def listing_bands(spark, folder):
    return feat.listing_bands(demo.listings(spark, folder)).select(
        KEY, "price_band", "photo_band", "description_band"
    )


@query("positive_only", "explored", "SELECT vehicle_id, num_reservations FROM explored WHERE num_reservations > 0")
def positive_only(spark, folder):
    return feat.positive_only(demo.explored(spark, folder), LABEL).select(KEY, LABEL)


@query(
    "round_outputs",
    "",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / 7, 2) AS predicted,
       round(l_extendedprice / 11, 3) AS latency_ms, round(l_extendedprice / 13, 4) AS metric FROM lineitem""",
)
def round_outputs(spark, folder):
    rows = demo.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_extendedprice") / 7).alias("predicted"),
        (F.col("l_extendedprice") / 11).alias("latency_ms"),
        (F.col("l_extendedprice") / 13).alias("metric"),
    )
    return feat.round_outputs(rows, {"predicted": 2, "latency_ms": 3, "metric": 4})


@query(
    "insert_with_id",
    "listings",
    """SELECT vehicle_id, actual_price, source FROM listings UNION ALL
       SELECT (SELECT max(vehicle_id) FROM listings) + row_number() OVER (ORDER BY c_custkey),
              CAST(c_nationkey + 30 AS DOUBLE), 'ui' FROM customer""",
)
def insert_with_id(spark, folder):
    existing = demo.listings(spark, folder)
    new = demo.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("request"),
        F.lit(1).cast("long").alias("technology"),
        (F.col("c_nationkey") + 30).cast("double").alias("actual_price"),
        F.lit(50.0).alias("recommended_price"),
        F.lit(8).cast("long").alias("num_images"),
        F.lit(0).cast("long").alias("street_parked"),
        F.lit(250).cast("long").alias("description"),
    )
    merged, _ = catalog.insert_with_id(existing, new, KEY, "request")
    return merged.select(KEY, "actual_price", "source")


@query(
    "delete_new_arrival",
    "listings",
    "SELECT * FROM listings WHERE NOT (source = 'ui' AND vehicle_id IN (SELECT s_suppkey FROM supplier))",
)
def delete_new_arrival(spark, folder):
    ids = demo.table(spark, folder, "supplier").select(F.col("s_suppkey").alias(KEY))
    return catalog.delete_new_arrival(demo.listings(spark, folder), ids)[0]


@query(
    "delete_report",
    "listings",
    """SELECT c_custkey * 2 AS vehicle_id, CASE WHEN source IS NULL THEN 'absent' WHEN source = 'ui' THEN 'deleted'
       ELSE 'blocked' END AS outcome FROM customer LEFT JOIN listings ON vehicle_id = c_custkey * 2""",
)
def delete_report(spark, folder):
    ids = demo.table(spark, folder, "customer").select((F.col("c_custkey") * 2).alias(KEY))
    return catalog.delete_new_arrival(demo.listings(spark, folder), ids)[1]


@query(
    "batch_limit_guard",
    "",
    """SELECT c_custkey AS request, coalesce(n, 0) AS size, CASE WHEN n IS NULL THEN 'empty'
       WHEN n <= 1000 THEN 'accepted' ELSE 'too large' END AS answer
       FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY ALL) ON user_id = c_custkey""",
)
def batch_limit_guard(spark, folder):
    requests = demo.table(spark, folder, "customer").select(F.col("c_custkey").alias("request"))
    asked = demo.table(spark, folder, "events").select(F.col("user_id").alias("request"))
    return feat.batch_limit_guard(requests, asked, "request")


@query("add_missing_column", "listings", "SELECT vehicle_id, 'csv' AS source FROM listings")
def add_missing_column(spark, folder):
    old = demo.listings(spark, folder).drop("source")
    return feat.add_missing_column(old, "source", "csv").select(KEY, "source")


CATALOG = "vehicle_id, technology, actual_price, recommended_price, num_images, street_parked, description, source"


@query("list_entities", "catalog", f"SELECT {CATALOG}, num_reservations FROM catalog")
def list_entities(spark, folder):
    return catalog.list_entities(demo.listings(spark, folder), demo.bookings(spark, folder))


@query(
    "list_entities_without_facts",
    "listings",
    f"SELECT {CATALOG}, CAST(CASE WHEN source = 'csv' THEN 0 END AS BIGINT) AS num_reservations FROM listings",
)
def list_entities_without_facts(spark, folder):
    return catalog.list_entities(demo.listings(spark, folder))


@query("order_by_key", "listings", f"SELECT {CATALOG} FROM listings")
def order_by_key(spark, folder):
    return catalog.order_by_key(demo.listings(spark, folder), KEY)


@query("head", "listings", f"SELECT {CATALOG} FROM listings ORDER BY vehicle_id LIMIT 5")
def head(spark, folder):
    return catalog.head(demo.listings(spark, folder), KEY)
