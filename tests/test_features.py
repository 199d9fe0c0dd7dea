import pytest
from conftest import rows
from pyspark.sql import functions as F

from demandloom.functions import money_label, number_text, zipped_sum
from demandloom.operators import features as feat
from demandloom.schemas import LISTING, LISTING_VIEW, listing_rules


def test_counts_and_price_gap(listings, bookings):
    built = feat.feature_build(listings, bookings)
    assert rows(built, "vehicle_id", "num_reservations") == [(1, 2), (2, 4), (3, 1)]
    assert dict(rows(built, "vehicle_id", "price_diff"))[1] == -8.75


def test_raw_prices_and_source_are_dropped_and_a_stamp_added(listings, bookings):
    built = feat.feature_build(listings, bookings)
    assert set(built.columns) == set(LISTING_VIEW.schema.fieldNames())
    assert built.select("event_timestamp").distinct().count() == 1


def test_zero_for_observed_sources_null_for_the_others(spark, bookings):
    none = bookings.limit(0)
    both = spark.createDataFrame(
        [(1, 1, 62.0, 70.0, 9, 0, 180, "csv"), (2, 1, 62.0, 70.0, 9, 0, 180, "ui")], LISTING
    )
    assert rows(feat.feature_build(both, none), "vehicle_id", "num_reservations") == [(1, 0), (2, None)]


def test_unobserved_source_with_facts_keeps_its_count(spark, bookings):
    one = spark.createDataFrame([(1, 1, 62.0, 70.0, 9, 0, 180, "ui")], LISTING)
    assert rows(feat.feature_build(one, bookings), "num_reservations") == [(2,)]


def test_orphan_and_keyless_facts_fall_away(spark, listings):
    facts = spark.createDataFrame([(1,), (99,), (None,)], "vehicle_id long")
    counted = feat.left_join_counts(listings, facts, "vehicle_id")
    assert rows(counted, "vehicle_id", "num_reservations") == [(1, 1), (2, None), (3, None)]


def test_dominant_key_is_counted_whole(spark):
    facts = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"))
    assert dict(rows(feat.count_per_key(facts, "k")))[7] == 40_000


def test_fleet_and_arrivals_split_on_the_label(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 5)], "vehicle_id long, num_reservations long")
    assert rows(feat.fleet_rows(df), "vehicle_id") == [(1,), (3,)]
    assert rows(feat.new_arrivals(df), "vehicle_id") == [(2,)]
    assert rows(feat.positive_only(df, "num_reservations"), "vehicle_id") == [(3,)]


def test_feature_refs(listings, bookings):
    built = feat.feature_build(listings, bookings)
    chosen = feat.feature_select(built, LISTING_VIEW)
    assert chosen.columns == ["technology", "num_images", "street_parked", "description", "price_diff"]
    assert set(LISTING_VIEW.columns_of(LISTING_VIEW.feature_refs)) <= set(LISTING_VIEW.schema.fieldNames())
    assert LISTING_VIEW.label_ref not in LISTING_VIEW.feature_refs
    with pytest.raises(ValueError, match="cannot be a feature"):
        feat.feature_select(built, LISTING_VIEW, [LISTING_VIEW.label_ref])
    with pytest.raises(ValueError, match="unknown"):
        feat.feature_select(built, LISTING_VIEW, ["other:technology"])


def test_validation_names_every_broken_rule(spark):
    bad = spark.createDataFrame(
        [
            (1, 1, 62.0, 70.0, 9, 0, 180, "ui"),
            (2, 2, 62.0, 70.0, 9, 0, 180, "ui"),
            (3, 1, -3.0, 70.0, 9, 0, 180, "ui"),
            (4, 1, 0.0, None, 9, 0, 180, "ui"),
            (0, 1, 62.0, 70.0, -1, 0, None, "ui"),
        ],
        LISTING,
    )
    valid, rejects = feat.validate_rows(bad, listing_rules())
    assert rows(valid, "vehicle_id") == [(1,)]
    assert rows(rejects, "vehicle_id", "errors") == [
        (0, ["vehicle_id", "num_images", "description"]),
        (2, ["technology"]),
        (3, ["actual_price"]),
        (4, ["actual_price", "recommended_price"]),
    ]


def test_null_guard_keeps_every_row_on_one_side(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "a long, b double")
    ok, missing = feat.null_guard(df, ["a", "b"])
    assert rows(ok) == [(1, 1.0)] and rows(missing) == [(2, None)]


def test_ratio_without_a_recommendation_is_zero(spark):
    df = spark.createDataFrame([(45.0, 50.0), (45.0, 0.0), (45.0, -1.0)], "a double, r double")
    assert [r[2] for r in feat.price_ratio(df, "a", "r").collect()] == [0.9, 0.0, 0.0]


def test_band_edges(spark):
    df = spark.createDataFrame(
        [(90.0, 100.0, 15, 300), (110.0, 100.0, 8, 100), (111.0, 100.0, 3, 99), (1.0, 100.0, 2, 0)],
        "actual_price double, recommended_price double, num_images long, description long",
    )
    banded = feat.listing_bands(df).select("price_band", "photo_band", "description_band").collect()
    assert [tuple(r) for r in banded] == [
        ("Below market", "Excellent", "Detailed"),
        ("At market", "Good", "Basic"),
        ("Above market", "Fair", "Minimal"),
        ("Below market", "Poor", "Minimal"),
    ]


def test_missing_column_takes_its_default(spark):
    old = spark.createDataFrame([(1,)], "vehicle_id long")
    assert rows(feat.add_missing_column(old, "source", "csv")) == [(1, "csv")]
    merged = spark.createDataFrame([(1, None), (2, "ui")], "vehicle_id long, source string")
    assert rows(feat.add_missing_column(merged, "source", "csv")) == [(1, "csv"), (2, "ui")]


def test_coercion_to_the_stored_schema(spark):
    df = spark.createDataFrame([("7", "1", "-5.5")], "vehicle_id string, technology string, price_diff string")
    typed = feat.coerce_types(df, LISTING_VIEW.schema)
    assert typed.schema == LISTING_VIEW.schema
    assert typed.first()["price_diff"] == -5.5 and typed.first()["num_reservations"] is None


def test_number_and_money_text(spark):
    df = spark.createDataFrame([(45.0,), (45.5,), (0.0,), (12345678.0,), (12345678.25,)], "x double")
    assert [r[0] for r in df.select(number_text("x")).collect()] == ["45", "45.5", "0", "12345678", "12345678.25"]
    gaps = spark.createDataFrame([(5.4,), (-12.0,), (0.0,)], "x double")
    assert [r[0] for r in gaps.select(money_label("x")).collect()] == ["+$5", "$-12", "+$0"]


def test_zip_add_refuses_unequal_lengths(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert df.select(zipped_sum("a", "b")).first()[0] == [4.0, 6.0]
    uneven = spark.createDataFrame([([1.0], [3.0, 4.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="differ in length"):
        uneven.select(zipped_sum("a", "b")).collect()


def test_request_sizes(spark):
    requests = spark.createDataFrame([(1,), (2,), (3,)], "request long")
    asked = spark.range(1004).select(F.when(F.col("id") < 1001, 1).otherwise(2).cast("long").alias("request"))
    assert rows(feat.batch_limit_guard(requests, asked, "request")) == [
        (1, 1001, "too large"),
        (2, 3, "accepted"),
        (3, 0, "empty"),
    ]
