"""The driver's tables, and listings made of them by plain expressions that Spark and the oracle read alike."""

from pyspark.sql import DataFrame, SparkSession

#: Adverts: each order advertises the flat of its customer.
ADVERTS = {
    "id": "o_orderkey",
    "flat": "o_custkey",
    "owner_id": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 53 END",
    "market": "CASE WHEN o_custkey % 17 = 0 THEN 'PRIMARY' ELSE 'SECONDARY' END",
    "status": "CASE WHEN o_orderstatus = 'F' THEN 'removed_by_user' ELSE 'active' END",
    "created_at": "o_orderdate",
    "price": "CAST(floor(o_totalprice) AS BIGINT)",
    "area": "3e1 + (o_custkey * 37 % 900) / 1e1 + 5e-2",
    "rooms": "CAST(1 + o_custkey % 4 AS INT)",
    "floor": "CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 7 = 1 THEN 'GROUND_FLOOR' WHEN o_custkey % 7 = 2 THEN 'GARRET' ELSE concat('FLOOR_', CAST(o_custkey % 7 AS VARCHAR(5))) END",
    "latitude": "5e1 + (o_custkey * 7919 % 10007) / 10007e0 * 3e-1",
    "longitude": "198e-1 + (o_custkey * 104729 % 10009) / 10009e0 * 4e-1",
    "city_id": "o_custkey % 23",
}
#: Flats: one for each customer.
FLATS = {
    "id": "c_custkey",
    "group_id": "c_custkey % 1000",
    "kind": "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END",
    "market": "CASE WHEN c_custkey % 3 = 0 THEN 'PRIMARY' ELSE 'SECONDARY' END",
    "area": "3e1 + (c_custkey * 37 % 900) / 1e1 + 5e-2",
    "price": "CAST(200000 + c_custkey * 7907 % 700000 AS BIGINT)",
    "price_per_m2": "(200000 + c_custkey * 7907 % 700000) / (3e1 + (c_custkey * 37 % 900) / 1e1 + 5e-2)",
    "latitude": "5e1 + (c_custkey * 7919 % 10007) / 10007e0 * 3e-1",
    "longitude": "198e-1 + (c_custkey * 104729 % 10009) / 10009e0 * 4e-1",
    "street_key": "concat('street', CAST(c_custkey % 29 AS VARCHAR(5)))",
}
#: Sales: orders of the register, of flats a little away from the customer's pin.
SALES = {
    "id": "o_orderkey",
    "sold_at": "o_orderdate",
    "price": "2e5 + o_orderkey * 7907 % 700000",
    "area": "3e1 + (o_custkey * 37 % 900) / 1e1 + 5e-2 + (o_orderkey % 5) / 1e1",
    "price_per_m2": "(2e5 + o_orderkey * 7907 % 700000) / (3e1 + (o_custkey * 37 % 900) / 1e1 + 5e-2 + (o_orderkey % 5) / 1e1)",
    "rooms": "CAST(CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 1 + o_custkey % 4 END AS INT)",
    "market": "CASE WHEN o_orderkey % 3 = 0 THEN 'PRIMARY' ELSE 'SECONDARY' END",
    "latitude": "5e1 + (o_custkey * 7919 % 10007) / 10007e0 * 3e-1 + (o_orderkey % 13) / 1e4",
    "longitude": "198e-1 + (o_custkey * 104729 % 10009) / 10009e0 * 4e-1 + (o_orderkey % 7) / 1e4",
    "street_key": "concat('street', CAST(o_custkey % 29 AS VARCHAR(5)))",
}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def made(spark: SparkSession, sf: str, table: str, columns: dict[str, str]) -> DataFrame:
    return read(spark, sf, table).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def adverts(spark: SparkSession, sf: str) -> DataFrame:
    return made(spark, sf, "orders", ADVERTS)


def flats(spark: SparkSession, sf: str) -> DataFrame:
    return made(spark, sf, "customer", FLATS)


def sales(spark: SparkSession, sf: str) -> DataFrame:
    return made(spark, sf, "orders", SALES)


def as_sql(table: str, columns: dict[str, str]) -> str:
    return "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {table})"


ADVERTS_SQL, FLATS_SQL, SALES_SQL = as_sql("orders", ADVERTS), as_sql("customer", FLATS), as_sql("orders", SALES)
