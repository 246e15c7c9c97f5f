"""Dirty staging tables derived from the test tables, for checks and the bench.

The same derivation exists as portable SQL for the oracle; see ``FIXTURES.md``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monofila.operators.universe import Channel
from monofila.rules import DESK, OFFICIAL, WEB

# Document-type catalogue (name, code, abbreviation). Code 4 is there twice.
CATALOGUE = [
    ("Cédula de Ciudadanía", 3, "CC"),
    ("Cédula de Extranjería", 2, "CE"),
    ("Tarjeta de Identidad", 15, "TI"),
    ("Registro Civil", 1, "RC"),
    ("Pasaporte", 5, "PA"),
    ("Permiso Especial", 12, "PE"),
    ("NIT", 4, "NI"),
    ("NIT", 4, "NT"),
    ("Carné Diplomático", 6, "CD"),
    ("Adulto sin Identificación", 9, "AS"),
    ("Menor sin Identificación", 10, "MS"),
]

_TYPE = "CASE {k} % 8 WHEN 0 THEN 'CE' WHEN 1 THEN 'TI' WHEN 2 THEN 'NI' WHEN 3 THEN 'PA' WHEN 4 THEN 'RC' ELSE 'CC' END"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def catalogue(spark: SparkSession) -> DataFrame:
    """Inline relation: Catalyst knows its exact size and broadcasts it."""
    rows = ", ".join(f"('{n}', {c}, '{a}')" for n, c, a in CATALOGUE)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS c(name, code, abbr)")


def _base(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("pr"),
        F.col("o_orderstatus").alias("st"),
        F.expr("CASE WHEN o_orderkey % 8 < 4 THEN 0 ELSE 1 END").alias("tenant"),
        F.expr(_TYPE.format(k="o_custkey")).alias("ty"),
        F.expr("CAST(o_custkey * 4 + o_orderkey % 4 AS STRING)").alias("doc"),
        F.date_format("o_orderdate", "dd/MM/yy").alias("dmy"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("iso"),
        F.expr("CASE WHEN o_orderkey % 83 <> 0 THEN concat('A', 100 + o_orderkey % 100) END").alias("advisor"),
        F.expr("CASE WHEN o_orderkey % 31 <> 0 THEN lpad(CAST(o_custkey % 25 AS STRING), 2, '0') END").alias("dept"),
        F.expr(
            "CASE o_custkey % 5 WHEN 0 THEN ' contributivo ' WHEN 1 THEN 'REGIMEN CONTRIBUTIVO' "
            "WHEN 2 THEN 'Subsidiado' WHEN 3 THEN NULL ELSE 'ESPECIAL' END"
        ).alias("regime"),
    )


def desk(spark: SparkSession, folder: str) -> DataFrame:
    return _base(spark, folder).filter("pr = '5-LOW'").select(
        "tenant",
        "id",
        F.expr("CASE WHEN id % 97 = 0 THEN 'PS' ELSE concat(' ', ty, ' ') END").alias("doc_type"),
        F.expr("CASE WHEN id % 101 <> 0 THEN doc END").alias("doc_num"),
        F.expr("CASE WHEN id % 53 = 0 THEN '31/02/25' ELSE dmy END").alias("filed"),
        "regime",
        "dept",
        F.lit("001").alias("muni"),
        "advisor",
    )


def web(spark: SparkSession, folder: str) -> DataFrame:
    return _base(spark, folder).filter("pr IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')").select(
        "tenant",
        "id",
        F.expr("CASE WHEN id % 89 = 0 THEN 'PS' ELSE ty END").alias("doc_type"),
        F.expr("concat(doc, ' ')").alias("doc_num"),
        F.expr("CASE WHEN st = 'F' THEN iso END").alias("filed"),
        F.expr("CASE WHEN id % 61 <> 0 THEN iso END").alias("requested"),
        F.expr("CASE st WHEN 'F' THEN 'radicado ' WHEN 'O' THEN 'ANULADO' ELSE 'RECHAZADO' END").alias("status"),
        "regime",
        F.expr("dept || '001'").alias("dane"),
        "advisor",
    )


def official(spark: SparkSession, folder: str) -> DataFrame:
    codes = catalogue(spark).select(F.col("abbr").alias("ty"), "code")
    return _base(spark, folder).filter("pr = '1-URGENT'").join(codes, "ty").select(
        "tenant",
        "id",
        F.expr("CASE WHEN id % 71 = 0 THEN '99' ELSE CAST(code AS STRING) END").alias("doc_type"),
        F.col("doc").alias("doc_num"),
        F.col("dmy").alias("filed"),
        "regime",
        "dept",
        F.lit("001").alias("muni"),
        "advisor",
    )


def history(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    slots = customers.withColumn("tenant", F.explode(F.expr(
        "CASE WHEN c_custkey % 2 = 0 THEN array(0, 1) ELSE array(0) END"
    ))).withColumn("slot", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return slots.select(
        "tenant",
        F.expr(_TYPE.format(k="c_custkey")).alias("doc_type"),
        F.expr("CAST(c_custkey * 4 + slot AS STRING)").alias("doc_num"),
        F.expr(
            "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'NUEVA EPS S.A.' WHEN 'MACHINERY' THEN 'Nueva EPS S.A. -CM' "
            "WHEN 'FURNITURE' THEN NULL ELSE concat(c_mktsegment, ' EPS') END"
        ).alias("entity"),
    )


def labour(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.expr("CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END").alias("tenant"),
        F.expr(
            "CASE event_type WHEN 'view' THEN 'CARGUE_EXITOSO' WHEN 'click' THEN 'CARGUE_EXITOSO ' "
            "WHEN 'signup' THEN NULL ELSE upper(event_type) END"
        ).alias("log"),
    )


DESK_COLUMNS = Channel(
    name=DESK, lookup="abbr", date_style="dmy", filing_id="id", doc_type="doc_type", doc_number="doc_num",
    filed=("filed",), regime="regime", dept="dept", municipality="muni", advisor="advisor",
)
OFFICIAL_COLUMNS = Channel(
    name=OFFICIAL, lookup="code", date_style="dmy", filing_id="id", doc_type="doc_type", doc_number="doc_num",
    filed=("filed",), regime="regime", dept="dept", municipality="muni", advisor="advisor",
)
WEB_COLUMNS = Channel(
    name=WEB, lookup="abbr", date_style="iso", filing_id="id", doc_type="doc_type", doc_number="doc_num",
    filed=("filed", "requested"), regime="regime", residence="dane", advisor="advisor", status="status",
)
