from conftest import rows

from demandloom.operators import catalog
from demandloom.schemas import LISTING


def test_saved_rows_are_listed_with_null_counts_in_id_order(spark, bookings):
    ui = spark.createDataFrame([(i, 1, 62.0, 70.0, 9, 0, 180, "ui") for i in (12, 10, 11)], LISTING)
    listed = catalog.list_entities(ui, bookings).collect()
    assert [(r.vehicle_id, r.num_reservations) for r in listed] == [(10, None), (11, None), (12, None)]


def test_listing_joins_counts(listings, bookings):
    assert rows(catalog.list_entities(listings, bookings), "vehicle_id", "num_reservations") == [(1, 2), (2, 4), (3, 1)]


def test_listing_without_a_fact_table(spark):
    both = spark.createDataFrame(
        [(1, 1, 62.0, 70.0, 9, 0, 180, "csv"), (2, 1, 62.0, 70.0, 9, 0, 180, "ui")], LISTING
    )
    assert rows(catalog.list_entities(both), "vehicle_id", "num_reservations") == [(1, 0), (2, None)]


def test_delete_rules(spark):
    table = spark.createDataFrame(
        [(1, 1, 62.0, 70.0, 9, 0, 180, "csv"), (2, 1, 62.0, 70.0, 9, 0, 180, "ui"), (3, 1, 62.0, 70.0, 9, 0, 180, None)],
        LISTING,
    )
    ids = spark.createDataFrame([(1,), (2,), (2,), (3,), (99,)], "vehicle_id long")
    kept, report = catalog.delete_new_arrival(table, ids)
    assert rows(kept, "vehicle_id") == [(1,), (3,)]
    assert rows(report) == [(1, "blocked"), (2, "deleted"), (3, "blocked"), (99, "absent")]


def test_ids_follow_the_high_water_mark(spark, listings):
    new = spark.createDataFrame(
        [(20, 0, 1.0, 2.0, 3, 1, 4), (10, 1, 5.0, 6.0, 7, 0, 8)],
        "request long, technology long, actual_price double, recommended_price double, num_images long,"
        "street_parked long, description long",
    )
    merged, mark = catalog.insert_with_id(listings, new, "vehicle_id", "request")
    added = merged.where("source = 'ui'")
    assert rows(added, "vehicle_id", "actual_price") == [(4, 5.0), (5, 1.0)]
    assert mark.first()[0] == 5
    # The newest rows are deleted; their ids stay used.
    again, mark = catalog.insert_with_id(listings, new, "vehicle_id", "request", high_water=5)
    assert rows(again.where("source = 'ui'"), "vehicle_id") == [(6,), (7,)]
    empty, mark = catalog.insert_with_id(listings.limit(0), new, "vehicle_id", "request")
    assert rows(empty, "vehicle_id") == [(1,), (2,)] and mark.first()[0] == 2


def test_search_matches_id_or_price_text(spark):
    df = spark.createDataFrame([(45, 10.0), (2, 45.0), (3, 45.5), (4, 5.0)], "vehicle_id long, actual_price double")
    assert rows(catalog.search_filter(df, "45"), "vehicle_id") == [(2,), (3,), (45,)]
    assert rows(catalog.search_filter(df, "5.0"), "vehicle_id") == []
    assert catalog.search_filter(df, "").count() == 4


def test_pages_hold_fifty_rows_per_side(spark):
    df = spark.range(300).selectExpr("id as vehicle_id", "if(id % 3 = 0, null, id) as num_reservations")
    page = catalog.split_and_limit(df)
    assert page.count() == 100
    first = page.where("side = 'arrivals'").orderBy("rank").first()
    assert (first.vehicle_id, first.total) == (0, 100)
    assert page.where("side = 'fleet'").agg({"vehicle_id": "max"}).first()[0] == 74


def test_catalog_status(spark):
    entities = spark.createDataFrame([(1,), (2,), (3,), (4,)], "vehicle_id long")
    resolved = spark.createDataFrame(
        [(1, "online", True), (2, "offline", True), (3, "none", False)],
        "vehicle_id long, store string, materialized boolean",
    )
    predictions = spark.createDataFrame([(1, 2.5)], "vehicle_id long, predicted_reservations double")
    view = catalog.catalog_view(entities, resolved, predictions)
    assert rows(view, "vehicle_id", "status", "can_score", "predicted_reservations") == [
        (1, "Online Store", True, 2.5),
        (2, "Offline Store", True, None),
        (3, "Pending", False, None),
        (4, "Pending", False, None),
    ]
    assert catalog.first_materialized(entities, resolved).first()[0] == 1
