"""Registration and the table expressions the SQL statements share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TABLES = {
    "listings": """SELECT p_partkey AS vehicle_id,
        CAST(CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS BIGINT) AS technology,
        floor(p_retailprice * (75 + p_size) + 0.5) / 100 AS actual_price,
        p_retailprice AS recommended_price,
        CAST(p_size % 18 AS BIGINT) AS num_images,
        CAST(p_partkey % 2 AS BIGINT) AS street_parked,
        CAST((p_partkey * 37) % 401 AS BIGINT) AS description,
        CASE WHEN p_partkey % 10 = 0 THEN 'ui' ELSE 'csv' END AS source
        FROM part""",
    "bookings": "SELECT user_id AS vehicle_id, ts AS created_at FROM events",
    "counts": "SELECT vehicle_id, count(*) AS booked FROM bookings GROUP BY ALL",
    "catalog": """SELECT l.*, coalesce(booked, CASE source WHEN 'csv' THEN 0 END) AS num_reservations,
        actual_price - recommended_price AS price_diff
        FROM listings l LEFT JOIN counts USING (vehicle_id)""",
    "features": """SELECT vehicle_id, technology, num_images, street_parked, description, price_diff,
        num_reservations FROM catalog""",
    "offline": "SELECT * FROM features WHERE num_reservations IS NOT NULL",
    "online": "SELECT * FROM features WHERE num_reservations IS NULL AND num_images >= 3",
    "explored": """SELECT l.*, coalesce(booked, 0) AS num_reservations,
        actual_price - recommended_price AS price_diff, actual_price / recommended_price AS price_ratio
        FROM listings l LEFT JOIN counts USING (vehicle_id)""",
    "resolved": """SELECT l.vehicle_id,
        CASE WHEN o.vehicle_id IS NOT NULL THEN 'offline' WHEN n.vehicle_id IS NOT NULL THEN 'online'
             ELSE 'none' END AS store,
        o.vehicle_id IS NOT NULL OR n.vehicle_id IS NOT NULL AS materialized,
        coalesce(o.technology, n.technology) AS technology,
        coalesce(o.num_images, n.num_images) AS num_images,
        coalesce(o.street_parked, n.street_parked) AS street_parked,
        coalesce(o.description, n.description) AS description,
        coalesce(o.price_diff, n.price_diff) AS price_diff
        FROM listings l LEFT JOIN offline o USING (vehicle_id) LEFT JOIN online n USING (vehicle_id)""",
    "registry_versions": """SELECT 'model_' || c_nationkey || '_' || lower(c_mktsegment) AS model_name,
        c_custkey AS version, 'run_' || c_custkey AS run_id, c_acctbal AS balance,
        CASE WHEN c_acctbal >= 1000 THEN c_acctbal END AS metric, c_acctbal / 8 AS train_mae,
        c_mktsegment AS segment, c_name AS account, c_nationkey AS nation FROM customer""",
    "candidates": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY version DESC) AS r
        FROM registry_versions) WHERE r = 1""",
    "champions": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY version DESC) AS r
        FROM registry_versions WHERE segment = 'BUILDING' OR (segment <> 'AUTOMOBILE' AND (balance < 1000 OR balance > 7000)))
        WHERE r = 1""",
    "samples": """SELECT event_type, value,
        row_number() OVER (PARTITION BY event_type ORDER BY event_id, value NULLS LAST) - 1 AS iteration FROM events""",
    "latencies": """SELECT event_type AS source, event_id AS iteration, value AS feature_ms,
        CAST(json_extract_string(props, '$.k') AS DOUBLE) AS predict_ms FROM events
        UNION ALL
        SELECT 'raw', iteration, f.value, p.value FROM (FROM samples WHERE event_type = 'click') f
        FULL JOIN (FROM samples WHERE event_type = 'view') p USING (iteration)
        UNION ALL
        SELECT 'online_store', iteration, f.value, p.value FROM (FROM samples WHERE event_type = 'purchase') f
        FULL JOIN (FROM samples WHERE event_type = 'signup') p USING (iteration)""",
    "folds": """SELECT vehicle_id, num_reservations, num_images / 3.0 AS prediction,
        CAST(ntile(5) OVER (ORDER BY vehicle_id) - 1 AS INTEGER) AS fold FROM offline""",
}
NEEDS = {
    "counts": ["bookings"],
    "catalog": ["listings", "counts"],
    "features": ["catalog"],
    "offline": ["features"],
    "online": ["features"],
    "explored": ["listings", "counts"],
    "resolved": ["listings", "offline", "online"],
    "latencies": ["samples"],
    "candidates": ["registry_versions"],
    "champions": ["registry_versions"],
    "folds": ["offline"],
}


def with_tables(names: str, body: str) -> str:
    """The statement with the shared table expressions it names, and theirs, in front."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in ordered) + "\n" + body


def half_up(x: str, digits: int) -> str:
    """Half-up rounding of the decimal digits of a double, as Spark's `round` does it."""
    return f"CAST(round(CAST({x} AS DECIMAL(28, 10)), {digits}) AS DOUBLE)"


def query(name: str, tables: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a key, with its SQL when it can be stated."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_tables(tables, sql)
        return run

    return register
