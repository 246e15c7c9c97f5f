"""Per-person profiles: history with each insurer and presence in the channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monofila.functions.columns import blank_to_null, flag
from monofila.rules import Rules


def _insurer_flags(rules: Rules) -> tuple[Column, Column]:
    """Own and other insurer. The prefix test does not trim, so a leading space
    counts as another insurer; NULL and blank count as neither."""
    own = F.upper("entity").startswith(rules.own_insurer_prefix)
    return own, ~own & blank_to_null(F.col("entity")).isNotNull()


def history_profile(history: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per tenant, type and number: ever in the own insurer, ever in another, rows."""
    own, other = _insurer_flags(rules)
    return (
        history.withColumn("doc_number", F.trim("doc_num"))
        .filter(blank_to_null(F.col("doc_number")).isNotNull())
        .groupBy("tenant", F.trim("doc_type").alias("doc_type"), "doc_number")
        .agg(
            F.max(flag(own)).alias("own_insurer"),
            F.max(flag(other)).alias("other_insurer"),
            F.count("*").alias("n_history"),
        )
    )


def history_by_key(history: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """History profile keyed like the consolidated row, so both sides of the join
    are already partitioned by (tenant, person_key) and neither moves again.

    ``type-number`` alone could confuse ('A-B', '1') with ('A', 'B-1'). Given equal
    keys, types are equal exactly when their lengths are, so each flag is the set of
    type lengths seen, at most one per dash in the key.
    """
    own, other = _insurer_flags(rules)

    def lengths(test: Column) -> Column:
        return F.collect_set(F.when(test, F.length("type")))

    return (
        history.select("tenant", "entity", F.trim("doc_type").alias("type"), F.trim("doc_num").alias("number"))
        .filter(blank_to_null(F.col("number")).isNotNull())
        .groupBy("tenant", F.concat("type", F.lit("-"), "number").alias("person_key"))
        .agg(lengths(own).alias("own_lengths"), lengths(other).alias("other_lengths"))
    )


def channel_counts(rules: Rules = Rules()) -> list[Column]:
    """Filings of a person that count for duplicity, one counter per channel."""
    eligible = (F.col("doc_type") != rules.unknown_type) & (F.nullif(F.col("doc_number"), F.lit("")).isNotNull())
    return [F.count(F.when(eligible & (F.col("channel") == c), 1)).alias(f"n_{c}") for c in rules.priority]


def total_filings(rules: Rules = Rules()) -> Column:
    return sum((F.col(f"n_{c}") for c in rules.priority[1:]), F.col(f"n_{rules.priority[0]}"))


def distinct_channels(rules: Rules = Rules()) -> Column:
    present = [flag(F.col(f"n_{c}") > 0) for c in rules.priority]
    return sum(present[1:], present[0]).cast("bigint")


#: What is counted of a person's filings in each channel, whether they count for duplicity or not.
TALLIES = ("filings", "typed", "numbered", "placed", "dated")


def tally(name: str, channel: str) -> str:
    return f"{name}_{channel}"


def tally_tests(rules: Rules = Rules()) -> dict[str, Column]:
    """Which filings each counter of ``TALLIES`` takes, by the counter's column name."""
    tests = dict(zip(TALLIES, (
        F.lit(True),
        F.col("doc_type") != rules.unknown_type,
        F.nullif(F.col("doc_number"), F.lit("")).isNotNull(),
        F.col("dept").isNotNull() & F.col("municipality").isNotNull(),
        F.col("filed_at").isNotNull(),
    )))
    return {tally(name, c): (F.col("channel") == c) & test for c in rules.priority for name, test in tests.items()}


def duplicity_profile(universe: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per person: distinct channels, filings, repeats inside a channel, presence.

    One aggregation with fixed-width counters: partial sums leave the map side, so a
    person with very many filings costs one row per map task.
    """
    counted = (
        universe.filter((F.col("doc_type") != rules.unknown_type) & F.nullif(F.col("doc_number"), F.lit("")).isNotNull())
        .groupBy("tenant", "person_key")
        .agg(*channel_counts(rules))
    )
    return _presence(counted, rules)


def duplicity_of_people(people: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The duplicity profile from the counters that consolidation left: nothing moves."""
    return _presence(people.filter(total_filings(rules) > 0), rules)


def _presence(counted: DataFrame, rules: Rules) -> DataFrame:
    return counted.select(
        "tenant",
        "person_key",
        distinct_channels(rules).alias("n_channels"),
        total_filings(rules).alias("n_filings"),
        (total_filings(rules) - distinct_channels(rules)).alias("n_repeats"),
        *[flag(F.col(f"n_{c}") > 0).alias(f"in_{c.lower()}") for c in rules.priority],
    )
