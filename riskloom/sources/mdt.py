"""The modelling table derived from ``orders`` and ``customer`` (see FIXTURES.md).

It stands in for a one-row-per-customer-and-month credit table: the arithmetic on
the keys is fixture data, not an operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.tables import read_input


def modelling_table(spark: SparkSession, folder: str, start_month: int | None = None) -> DataFrame:
    """Derive the table; ``start_month`` (yyyyMM) adds the equal date filter to the scan."""
    orders = read_input(spark, folder, "orders")
    if start_month is not None:
        first_day = f"{start_month // 100:04d}-{start_month % 100:02d}-01 00:00:00"
        orders = orders.filter(F.col("o_orderdate") >= F.expr(f"timestamp_ntz'{first_day}'"))
    customer = read_input(spark, folder, "customer").select("c_custkey", "c_acctbal")

    key, client = F.col("o_orderkey"), F.col("o_custkey")
    balance, total = F.col("c_acctbal"), F.col("o_totalprice")
    spread = (key * 37) % 300

    def unless(divisor, value):
        return F.when(key % divisor != 0, value)

    def model_type(number):
        return F.when(number % 13 >= 6, "MOD_CE").otherwise("MOD_SE")

    bad_below = 160 - F.floor(spread / 3) - F.when(balance > 3000, 30).otherwise(0)
    return orders.join(customer, client == F.col("c_custkey")).select(
        key.alias("row_id"),
        client.alias("identificacion_cliente"),
        (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("int").alias("codigo_periodo"),
        F.when((key * 7919) % 1000 < bad_below, 1).otherwise(0).alias("y"),
        (6 + key % 30).cast("int").alias("numero_registros_riesgo"),
        (client % 13).cast("int").alias("reportes_u12m"),
        ((key * 31) % 120).cast("int").alias("mora_mes_anterior"),
        unless(29, (700 + spread)).cast("int").alias("score_buro"),
        (1 + key % 6).cast("string").alias("clasificacion"),
        unless(23, (key * 13) % 260).cast("double").alias("antiguedad_buro"),
        unless(17, balance / 8).alias("saldo_cuentas"),
        unless(19, total / 512).alias("avg_saldo_u3m"),
        unless(31, total / 400).alias("avg_saldo_u6m"),
        unless(37, model_type(client)).alias("tipo_modelo_fa"),
        model_type(client + 1).alias("tipo_modelo_12d"),
        (700 + (key * 53) % 300).cast("int").alias("score_12d"),
        unless(13, balance / 16).alias("saldo_12d"),
    )
