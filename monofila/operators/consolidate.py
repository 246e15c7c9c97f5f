"""One row per person: survivor, class, regime and quality flags.

Two shuffles in all, both after map-side combining: filings by (tenant, person_key)
and history by the same key. The survivor is the minimum of a struct that starts
with the ordering fields, taken in the same aggregation that counts filings per
channel; the duplicity profile therefore needs no second pass and no join, and
the key shared by every filing without a document number is reduced before it
reaches the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monofila.functions.columns import flag, period
from monofila.operators.profiles import channel_counts, distinct_channels, history_by_key, tally_tests, total_filings
from monofila.rules import CLASS_NEW, CLASS_RETURN, CLASS_TRANSFER, Rules

_CARRIED = (
    "channel", "doc_type", "doc_number", "doc_type_received", "regime", "dept", "municipality", "advisor",
    "provider", "status", "member_type",
)


def priority_of(channel: Column, rules: Rules) -> Column:
    ranked = F.when(channel == rules.priority[0], 1)
    for place, name in enumerate(rules.priority[1:], start=2):
        ranked = ranked.when(channel == name, place)
    return ranked.otherwise(9)


def survivors(universe: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The filing that stands for each person, with the person's channel counters and tallies.

    Best channel first, then the earliest filing (unknown dates before any date),
    then the filing id compared as text.
    """
    best = F.min(F.struct(priority_of(F.col("channel"), rules).alias("place"), "filed_at", "filing_id", *_CARRIED))
    carried = [F.col(f"best.{c}").alias(c) for c in ("filed_at", "filing_id", *_CARRIED)]
    counters = [f"n_{c}" for c in rules.priority]
    tests = tally_tests(rules)

    keyed = universe.filter(F.col("person_key").isNotNull()) if rules.keep_null_keys else universe
    chosen = (
        keyed.groupBy("tenant", "person_key")
        .agg(best.alias("best"), *channel_counts(rules), *[F.count_if(test).alias(c) for c, test in tests.items()])
        .select("tenant", "person_key", *counters, *tests, *carried)
    )
    if not rules.keep_null_keys:
        return chosen
    zero = [F.lit(0).cast("bigint").alias(c) for c in counters]
    loose = universe.filter(F.col("person_key").isNull())
    own = [flag(test).cast("bigint").alias(c) for c, test in tests.items()]
    return chosen.unionByName(loose.select("tenant", "person_key", *zero, *own, "filed_at", "filing_id", *_CARRIED))


def regime_group(c: Column) -> Column:
    return (
        F.when(c.contains("CONTRIBUTIVO"), "CONTRIBUTIVO")
        .when(c.contains("SUBSIDIADO"), "SUBSIDIADO")
        .when(F.nullif(c, F.lit("")).isNull(), "SIN DATO")
        .otherwise("OTRO")
    )


def classification(own: Column, other: Column) -> Column:
    """History decides, own insurer first. Quality never changes the class."""
    return F.when(own, CLASS_RETURN).when(other, CLASS_TRANSFER).otherwise(CLASS_NEW)


def consolidate(universe: DataFrame, history: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Consolidated view: 27 columns, ``filed_at`` still a timestamp."""
    rows = consolidate_people(universe, history, rules)
    return rows.drop(*[f"n_{c}" for c in rules.priority], *tally_tests(rules))


def consolidate_people(universe: DataFrame, history: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The consolidated view, followed by what each person filed in each channel.

    The counters come from the aggregation that finds the survivor, so reports on raw
    filings and on persons need not read, look up and move the filings again.
    """
    people = survivors(universe, rules).join(history_by_key(history, rules), ["tenant", "person_key"], "left")

    own = F.array_contains("own_lengths", F.length("doc_type"))
    other = F.array_contains("other_lengths", F.length("doc_type"))

    unknown = F.col("doc_type") == rules.unknown_type
    empty = F.nullif(F.col("doc_number"), F.lit("")).isNull()
    undated = F.col("filed_at").isNull()
    total, channels = total_filings(rules), distinct_channels(rules)
    one = F.lit(1).cast("bigint")

    return people.select(
        "tenant",
        "person_key",
        "channel",
        "filing_id",
        "doc_type",
        "doc_type_received",
        "doc_number",
        "filed_at",
        period(F.col("filed_at")).alias("period"),
        "advisor",
        "dept",
        "municipality",
        "provider",
        "member_type",
        "status",
        regime_group(F.col("regime")).alias("regime"),
        classification(own, other).alias("classification"),
        flag(unknown).alias("m_not_in_catalogue"),
        flag(empty).alias("m_empty_document"),
        flag(F.col("dept").isNull() | F.col("municipality").isNull()).alias("m_incomplete_territory"),
        flag(undated).alias("m_invalid_date"),
        flag(channels > 1).alias("m_multi_channel"),
        flag(total > channels).alias("m_internal"),
        flag(unknown | empty | undated).alias("m_critical"),
        flag((F.col("channel") != rules.status_channel) | (F.col("status") == rules.effective_status)).alias(
            "is_effective"
        ),
        F.greatest(channels, one).cast("int").alias("n_channels"),
        F.greatest(total, one).cast("int").alias("n_filings"),
        *[f"n_{c}" for c in rules.priority],
        *tally_tests(rules),
    )


def as_table(consolidated: DataFrame) -> DataFrame:
    """The materialised shape: the timestamp decided the survivor, the table keeps a date."""
    at = consolidated.columns.index("filed_at")
    names = consolidated.columns
    return consolidated.select(
        *names[:at], F.col("filed_at").cast("date").alias("filed_on"), *names[at + 1 :]
    )
