"""Catalogue lookups and the universe: all channels in one aligned shape.

The universe is map-only. The catalogue is a few dozen rows and carries no
broadcast hint: Spark broadcasts it because its measured size is below
``spark.sql.autoBroadcastJoinThreshold``, and beyond that falls back to a
sort-merge join whose hot document types AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monofila.functions.columns import blank_to_null, parse_dmy, parse_iso
from monofila.rules import Rules

UNIVERSE_COLUMNS = (
    "tenant", "channel", "filing_id", "doc_type", "doc_number", "person_key", "doc_type_received",
    "filed_at", "regime", "dept", "municipality", "advisor", "provider", "status", "member_type", "request_type",
)


@dataclass(frozen=True)
class Channel:
    """Where a channel keeps each business field; None means it has none.

    ``filed`` lists date columns in order of preference. ``residence`` is a
    five-digit place code that yields both department and municipality.
    """

    name: str
    lookup: str
    date_style: str
    filing_id: str
    doc_type: str
    doc_number: str
    filed: tuple[str, ...]
    regime: str
    dept: str | None = None
    municipality: str | None = None
    residence: str | None = None
    advisor: str | None = None
    provider: str | None = None
    status: str | None = None
    member_type: str | None = None
    request_type: str | None = None


def by_code(catalogue: DataFrame) -> DataFrame:
    """One abbreviation per numeric code, and how many share it."""
    return (
        catalogue.filter(F.col("code").isNotNull())
        .groupBy("code")
        .agg(F.min("abbr").alias("abbr"), F.count("*").alias("n_abbreviations"))
    )


def collisions(catalogue: DataFrame) -> DataFrame:
    """Codes that several abbreviations share."""
    return by_code(catalogue).filter("n_abbreviations > 1")


def homologate(rows: DataFrame, received: Column, catalogue: DataFrame, lookup: str, rules: Rules) -> DataFrame:
    """Add ``homologated``: the catalogue abbreviation or the unknown marker.

    ``lookup='abbr'`` matches the abbreviation, ``'code'`` the numeric code as text
    (``'03'`` is not 3). The catalogue side is unique either way, so rows never
    multiply.
    """
    if lookup == "abbr":
        known = catalogue.select(F.col("abbr").alias("_match"), F.col("abbr").alias("_abbr"))
    else:
        known = by_code(catalogue).select(F.col("code").cast("string").alias("_match"), F.col("abbr").alias("_abbr"))
    joined = rows.join(known, blank_to_null(received) == F.col("_match"), "left")
    return joined.withColumn("homologated", F.coalesce("_abbr", F.lit(rules.unknown_type))).drop("_match", "_abbr")


def align(rows: DataFrame, channel: Channel, catalogue: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Project one channel onto the sixteen universe columns."""

    def text(name: str | None) -> Column:
        return F.lit(None).cast("string") if name is None else F.col(name).cast("string")

    parse = parse_dmy if channel.date_style == "dmy" else parse_iso
    number = F.trim(text(channel.doc_number))
    if channel.residence:
        place = blank_to_null(text(channel.residence))
        dept, municipality = F.left(place, F.lit(2)), place
    else:
        dept, municipality = blank_to_null(text(channel.dept)), blank_to_null(text(channel.municipality))

    typed = homologate(rows, text(channel.doc_type), catalogue, channel.lookup, rules)
    return typed.select(
        F.col("tenant"),
        F.lit(channel.name).alias("channel"),
        text(channel.filing_id).alias("filing_id"),
        F.col("homologated").alias("doc_type"),
        number.alias("doc_number"),
        F.concat(F.col("homologated"), F.lit("-"), number).alias("person_key"),
        text(channel.doc_type).alias("doc_type_received"),
        F.coalesce(*[parse(text(c)) for c in channel.filed]).alias("filed_at"),
        F.upper(F.trim(text(channel.regime))).alias("regime"),
        dept.alias("dept"),
        municipality.alias("municipality"),
        blank_to_null(text(channel.advisor)).alias("advisor"),
        blank_to_null(text(channel.provider)).alias("provider"),
        F.upper(F.trim(text(channel.status))).alias("status"),
        F.upper(F.trim(text(channel.member_type))).alias("member_type"),
        text(channel.request_type).alias("request_type"),
    )


def universe(
    channels: Iterable[tuple[Channel, DataFrame]], catalogue: DataFrame, rules: Rules = Rules()
) -> DataFrame:
    """All filings of all channels. Labour notices are not filings and stay out."""
    channels = list(channels)
    unranked = [c.name for c, _ in channels if c.name not in rules.priority]
    if unranked:
        raise ValueError(f"channels without a priority: {', '.join(unranked)}")
    return reduce(DataFrame.unionByName, [align(rows, c, catalogue, rules) for c, rows in channels])
