"""Reusable measures over the consolidated table, usable in any ``agg``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _share(name: str) -> Column:
    return F.try_divide(F.sum(name), F.count("*"))


def _complement(name: str) -> Column:
    return F.lit(1.0) - _share(name)


# Measure name -> title people know it by.
MEASURE_TITLES = {
    "filings": "Trámites",
    "effective": "Producción efectiva",
    "effective_share": "% Efectiva",
    "multi_channel": "Duplicados multicanal",
    "multi_channel_share": "% Duplicidad multicanal",
    "internal": "Duplicados internos",
    "internal_share": "% Duplicidad interna",
    "critical": "Registros críticos",
    "critical_share": "% Críticos",
    "homologation_share": "% Homologación",
    "territory_share": "% Territorio completo",
}


def measures() -> dict[str, Column]:
    """Ratios between 0 and 1; NULL, not an error, when there is nothing to divide by."""
    return {
        "filings": F.count("*"),
        "effective": F.sum("is_effective"),
        "effective_share": _share("is_effective"),
        "multi_channel": F.sum("m_multi_channel"),
        "multi_channel_share": _share("m_multi_channel"),
        "internal": F.sum("m_internal"),
        "internal_share": _share("m_internal"),
        "critical": F.sum("m_critical"),
        "critical_share": _share("m_critical"),
        "homologation_share": _complement("m_not_in_catalogue"),
        "territory_share": _complement("m_incomplete_territory"),
    }


def pick(names: list[str] | None = None) -> list[Column]:
    known = measures()
    return [known[n].alias(n) for n in (names or known)]
