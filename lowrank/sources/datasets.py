"""The matrices this library is exercised on, defined over the given tables.

* ``embeddings``  : dense, 64 wide (FLOAT elements read as DOUBLE), row = vec_id
* ``lineitem``    : dense, 4 wide (quantity, price, discount, tax), no row key
* ``customer_part``: sparse, i = o_custkey, j = l_partkey, v = sum of quantity
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import TallMatrix
from .tables import load_table, matrix_from_array, matrix_from_columns, matrix_from_entries

LINEITEM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def embeddings_matrix(spark: SparkSession, sf_dir: str) -> TallMatrix:
    return matrix_from_array(load_table(spark, sf_dir, "embeddings"), "embedding", "vec_id")


def lineitem_matrix(spark: SparkSession, sf_dir: str, n_rows: int | None = None) -> TallMatrix:
    return matrix_from_columns(load_table(spark, sf_dir, "lineitem"), LINEITEM_COLS, n_rows=n_rows)


def customer_part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts ``(i, j, v)`` that the entries of the customer x part quantity
    matrix sum up: a shuffle join on the order key (AQE splits skewed keys)."""
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    od = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(od, li.l_orderkey == od.o_orderkey)
            .select(F.col("o_custkey").cast("long").alias("i"), F.col("l_partkey").cast("int").alias("j"), F.col("l_quantity").alias("v")))


def customer_part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate entries of the customer x part quantity matrix: the lines
    grouped on the cell with map-side partial sums."""
    return customer_part_lines(spark, sf_dir).groupBy("i", "j").agg(F.sum("v").alias("v"))


def customer_part_shape(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """(rows, cols) from the key ranges of customer and part (zero-based keys)."""
    n = load_table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]
    d = load_table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    return int(n) + 1, int(d) + 1


def customer_part_matrix(spark: SparkSession, sf_dir: str) -> TallMatrix:
    n, d = customer_part_shape(spark, sf_dir)
    return matrix_from_entries(customer_part_lines(spark, sf_dir), n_rows=n, n_cols=d, duplicates="total")
