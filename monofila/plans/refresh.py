"""From files to the materialised table for one tenant."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monofila import schemas as S
from monofila.operators.consolidate import as_table, consolidate_people
from monofila.operators.universe import universe
from monofila.rules import DESK, OFFICIAL, WEB, Rules
from monofila.sources.delimited import DEFAULT_ENCODING, load_all, staged
from monofila.sources.storage import read_tenants, replace_tenants, write_csv


@dataclass(frozen=True)
class Staging:
    """Staging tables in the names the operators use, optionally of one tenant; then
    other tenants' folders are not even listed."""

    spark: SparkSession
    warehouse: str
    tenant: int | None = None

    def source(self, source: S.Source) -> DataFrame:
        return staged(self.spark, self.warehouse, source, self.tenant)

    @property
    def catalogue(self) -> DataFrame:
        """One row per abbreviation, so that a lookup never multiplies filings."""
        rows = self.source(S.CATALOGUE).groupBy(F.col("Abreviatura").alias("abbr"))
        return rows.agg(F.min(F.struct("CODIGO", "Tipo_Documento_Afiliado")).alias("c")).select(
            F.col("c.Tipo_Documento_Afiliado").alias("name"), F.col("c.CODIGO").alias("code"), "abbr"
        )

    @property
    def history(self) -> DataFrame:
        return self.source(S.HISTORY_SOURCE).select(
            "tenant", F.col("TIPO_IDENTIFICACION").alias("doc_type"),
            F.col("NUMERO_IDENTIFICACION").alias("doc_num"), F.col("ENTIDAD").alias("entity"),
        )

    @property
    def notices(self) -> DataFrame:
        return self.source(S.NOTICES_SOURCE).select("tenant", F.col("LOG_ERRORES").alias("log"))

    def universe(self, rules: Rules = Rules()) -> DataFrame:
        return universe(
            [
                (S.DESK_CHANNEL, self.source(S.DESK_SOURCE)),
                (S.WEB_CHANNEL, self.source(S.WEB_SOURCE)),
                (S.OFFICIAL_CHANNEL, self.source(S.OFFICIAL_SOURCE)),
            ],
            self.catalogue,
            rules,
        )

    @property
    def sources(self) -> dict[str, DataFrame]:
        return {
            DESK: self.source(S.DESK_SOURCE), WEB: self.source(S.WEB_SOURCE), OFFICIAL: self.source(S.OFFICIAL_SOURCE),
            "XML_HISTORICO": self.source(S.HISTORY_SOURCE), "PROCESO_IRL": self.source(S.NOTICES_SOURCE),
        }


def materialise(spark: SparkSession, warehouse: str, tenant: int, rules: Rules = Rules()) -> int:
    """Recompute one tenant's consolidated rows; returns how many.

    Sorted inside each file by what reports filter and group on, so that channel and
    month filters skip row groups. The counters of ``people`` lie in the same files; a reader
    of one reads no column of the other.
    """
    staging = Staging(spark, warehouse, tenant)
    table = as_table(consolidate_people(staging.universe(rules), staging.history, rules))
    placed = table.sortWithinPartitions("tenant", "channel", "period")
    return replace_tenants(placed, f"{warehouse}/consolidated", [tenant])[tenant]


def consolidated(spark: SparkSession, warehouse: str, tenant: int | None = None) -> DataFrame:
    return read_tenants(spark, f"{warehouse}/consolidated", S.CONSOLIDATED, tenant)


def people(spark: SparkSession, warehouse: str, tenant: int | None = None, rules: Rules = Rules()) -> DataFrame:
    """What each person filed in each channel, from the files of the consolidated table."""
    return read_tenants(spark, f"{warehouse}/consolidated", S.people(rules), tenant)


def refresh(
    spark: SparkSession, folder: str, warehouse: str, tenant: int, rules: Rules = Rules(),
    encoding: str = DEFAULT_ENCODING, **options,
) -> tuple[DataFrame, int]:
    """Load a folder for one tenant and rebuild its consolidated rows.

    Returns the load report and the number of consolidated rows. Loads publish per
    source and the table last, so a failed load leaves the old table in place.
    """
    report = load_all(spark, folder, warehouse, tenant, encoding=encoding, **options)
    return report, materialise(spark, warehouse, tenant, rules)


def export_csv(spark: SparkSession, warehouse: str, tenant: int, path: str, single_file: bool = False) -> None:
    """One tenant's consolidated table for spreadsheets, with the headings they know."""
    rows = consolidated(spark, warehouse, tenant)
    headed = rows.select([F.col(c).alias(h) for c, h in S.CONSOLIDATED_HEADINGS.items()])
    write_csv(headed, path, single_file=single_file)
