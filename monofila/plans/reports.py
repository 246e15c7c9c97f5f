"""Reports over the universe, the notices and the materialised consolidated table.

Every report takes optional ``tenant`` and ``channel`` scopes. Each is one
aggregation with a map-side combine; totals come from scalar subqueries that reuse
the grouped exchange, so no unbounded set of groups is pulled into a single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from monofila.functions.columns import (
    channel_label, department_label, flag, month_label, pct, pct1, serial_date, thousands, traffic_light,
)
from monofila.functions.measures import pick
from monofila.operators.profiles import duplicity_of_people, tally, tally_tests
from monofila.rules import (
    BATCH_TITLES, CLASS_NEW, CLASS_RETURN, CLASS_TRANSFER, COMBINATIONS, HEADLINE, ONE_CHANNEL,
    WORKBOOK_HEADINGS, Rules,
)
from monofila.sources.storage import write_scratch

ALL = "TODOS"


def scope(df: DataFrame, tenant: int | None = None, channel: str | None = None) -> DataFrame:
    if tenant is not None:
        df = df.filter(F.col("tenant") == tenant)
    if channel is not None:
        df = df.filter(F.col("channel") == channel)
    return df


def _counts(df: DataFrame, *dims: Column | str) -> DataFrame:
    return df.groupBy(*dims).agg(F.count("*").alias("n"))


def with_share(grouped: DataFrame) -> DataFrame:
    """Share of the grand total for each row of a ``n``-counted report."""
    total = grouped.agg(F.sum("n")).scalar()
    return grouped.withColumn("share", pct(F.col("n"), total))


def _rows(df: DataFrame, structs: list[Column]) -> DataFrame:
    """One wide row turned into a long report."""
    return df.select(F.inline(F.array(*structs)))


# ---- A-K: figures of the batch report -------------------------------------


def headline(
    consolidated: DataFrame, universe: DataFrame, notices: DataFrame, tenant: int | None = None, rules: Rules = Rules()
) -> DataFrame:
    """Ten indicators from one pass over each input."""
    failed = F.sum((F.trim("log") != rules.notice_success).cast("int"))
    noticed = scope(notices, tenant).agg(F.count("*").alias("n_notices"), failed.alias("n_failed"))
    raw = scope(universe, tenant).agg(F.count("*").alias("n_raw"))
    flags = ("is_effective", "m_multi_channel", "m_internal", "m_not_in_catalogue", "m_incomplete_territory", "m_critical")
    wide = (
        scope(consolidated, tenant)
        .agg(F.count("*").alias("n"), *[F.sum(f).alias(f) for f in flags])
        .withColumn("n_raw", raw.scalar())
        .withColumn("n_notices", noticed.select("n_notices").scalar())
        .withColumn("n_failed", noticed.select("n_failed").scalar())
    )

    def line(label: str, value: str, total: str | None = None) -> Column:
        share = pct(F.col(value), F.col(total)) if total else F.lit(None).cast("double")
        return F.struct(F.lit(label).alias("indicator"), F.col(value).alias("value"), share.alias("percentage"))

    return _rows(wide, [line(*parts) for parts in HEADLINE])


def tenant_totals(consolidated: DataFrame, tenant: int) -> DataFrame:
    """Totals of one tenant through SQL with a named parameter."""
    return consolidated.sparkSession.sql(
        """
        SELECT :tenant AS tenant, count(*) AS filings, sum(is_effective) AS effective, sum(m_critical) AS critical
        FROM {consolidated} WHERE tenant = :tenant
        """,
        args={"tenant": tenant},
        consolidated=consolidated,
    )


def by_classification(consolidated: DataFrame, tenant: int | None = None, channel: str | None = None) -> DataFrame:
    counted = _counts(scope(consolidated, tenant, channel), "classification")
    return with_share(counted).orderBy(F.desc("n"), "classification")


def source_contribution(universe: DataFrame, consolidated: DataFrame, tenant: int | None = None) -> DataFrame:
    """Filings each channel sent, kept and lost to consolidation."""
    sent = scope(universe, tenant).groupBy("channel").agg(F.count("*").alias("contributed"))
    kept = scope(consolidated, tenant).groupBy("channel").agg(F.count("*").alias("_kept"))
    survived = F.coalesce("_kept", F.lit(0))
    return (
        sent.join(kept, "channel", "left")
        .select(
            "channel",
            "contributed",
            survived.alias("survived"),
            (F.col("contributed") - survived).alias("discarded"),
            pct(survived, F.col("contributed")).alias("pct_survives"),
        )
        .orderBy(F.desc("survived"), "channel")
    )


def by_regime(consolidated: DataFrame, tenant: int | None = None, channel: str | None = None) -> DataFrame:
    return with_share(_counts(scope(consolidated, tenant, channel), "regime")).orderBy(F.desc("n"), "regime")


def advisor_pareto(consolidated: DataFrame, tenant: int | None = None, top: int = 30) -> DataFrame:
    """Largest advisors with share and cumulative share; equal counts share the latter.

    The cumulative total of an advisor is the sum over all advisors with at least as
    many filings. Only the ``top`` largest distinct counts can matter, so the running
    sum sees at most ``top`` rows instead of every advisor.
    """
    advisors = _counts(scope(consolidated, tenant), F.coalesce("advisor", F.lit("SIN ASESOR")).alias("advisor"))
    total = advisors.agg(F.sum("n")).scalar()
    levels = advisors.groupBy("n").agg(F.sum("n").alias("at_level")).orderBy(F.desc("n")).limit(top)
    running = F.sum("at_level").over(Window.orderBy(F.desc("n")))
    cumulative = levels.select("n", running.alias("reached"))
    return (
        advisors.orderBy(F.desc("n"), "advisor").limit(top)
        .join(cumulative, "n")
        .select("advisor", "n", pct(F.col("n"), total).alias("share"), pct(F.col("reached"), total).alias("cumulative"))
        .orderBy(F.desc("n"), "advisor")
    )


def by_territory(consolidated: DataFrame, tenant: int | None = None, channel: str | None = None) -> DataFrame:
    counted = _counts(scope(consolidated, tenant, channel), F.coalesce("dept", F.lit("SIN DATO")).alias("dept"))
    return with_share(counted).orderBy(F.desc("n"), "dept")


def trend(consolidated: DataFrame, tenant: int | None = None, channel: str | None = None) -> DataFrame:
    def of(name: str) -> Column:
        return F.sum((F.col("classification") == name).cast("int"))

    return (
        scope(consolidated, tenant, channel).filter(F.col("period").isNotNull())
        .groupBy("period")
        .agg(
            F.count("*").alias("n"),
            of(CLASS_NEW).alias("n_new"),
            of(CLASS_TRANSFER).alias("n_transfer"),
            of(CLASS_RETURN).alias("n_return"),
        )
        .orderBy("period")
    )


def quality_by_source(
    people: DataFrame, tenant: int | None = None, rules: Rules = Rules(), unknown: bool = False
) -> DataFrame:
    """Quality of what each channel sends, on raw filings: those that lose to a better
    one still count here. ``people`` holds one row per tenant and person, so one tenant's
    distinct persons are a plain sum; over all tenants, rows of one person meet first.
    ``unknown`` adds the number of filings whose type the catalogue does not know."""
    counters = list(tally_tests(rules))
    rows = scope(people, tenant)
    if tenant is None:
        rows = rows.groupBy("person_key").agg(*[F.sum(c).alias(c) for c in counters])
    filed = {c: F.col("person_key").isNotNull() & (F.col(tally("filings", c)) > 0) for c in rules.priority}
    wide = rows.agg(*[F.sum(c).alias(c) for c in counters], *[F.count_if(test).alias(f"persons_{c}") for c, test in filed.items()])

    def line(channel: str) -> Column:
        n, typed, numbered, placed, dated = (F.col(tally(t, channel)) for t in ("filings", "typed", "numbered", "placed", "dated"))
        persons = F.col(f"persons_{channel}")
        return F.struct(
            F.lit(channel).alias("channel"),
            n.alias("n"),
            pct(typed, n).alias("pct_homologated"),
            pct(numbered, n).alias("pct_document"),
            pct(placed, n).alias("pct_territory"),
            pct(dated, n).alias("pct_date"),
            persons.alias("n_persons"),
            (n - persons).alias("n_repeats"),
            *([(n - typed).alias("n_unknown")] if unknown else []),
        )

    return _rows(wide, [line(c) for c in rules.priority]).filter("n > 0").orderBy(F.desc("n"), "channel")


def out_of_catalogue(
    universe: DataFrame, tenant: int | None = None, top: int | None = None, rules: Rules = Rules()
) -> DataFrame:
    """Document types received that the catalogue does not know; ``top`` for a short list."""
    unknown = scope(universe, tenant).filter(F.col("doc_type") == rules.unknown_type)
    ordered = _counts(unknown, "channel", "doc_type_received").orderBy(F.desc("n"), "channel", "doc_type_received")
    return ordered if top is None else ordered.limit(top)


def channel_combinations(people: DataFrame, tenant: int | None = None, rules: Rules = Rules()) -> DataFrame:
    """Persons by the combination of channels they used."""
    combination = F.when(F.lit(False), ONE_CHANNEL)
    for channels, label in COMBINATIONS.items():
        together = reduce(Column.__and__, [F.col(f"in_{c.lower()}") == 1 for c in channels])
        combination = combination.when(together, label)
    combination = combination.otherwise(ONE_CHANNEL)
    profile = duplicity_of_people(scope(people, tenant), rules)
    return _counts(profile, combination.alias("combination")).orderBy(F.desc("n"), "combination")


def labour_reasons(notices: DataFrame, tenant: int | None = None) -> DataFrame:
    """Notices by outcome; a missing outcome is a group of its own."""
    counted = _counts(scope(notices, tenant), F.trim("log").alias("outcome"))
    return with_share(counted).orderBy(F.desc("n"), "outcome")


def labour_inconsistency(notices: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Failed notices per tenant. Without an outcome a notice is neither success nor
    failure, yet it stays in the denominator."""
    failed = F.sum((F.trim("log") != rules.notice_success).cast("int"))
    return (
        notices.groupBy("tenant")
        .agg(F.count("*").alias("n"), failed.alias("failed"), pct(failed, F.count("*")).alias("pct_failed"))
        .orderBy("tenant")
    )


# ---- dashboard -------------------------------------------------------------

_KPI_FLAGS = {
    "effective": "is_effective",
    "multi_channel": "m_multi_channel",
    "internal": "m_internal",
    "not_in_catalogue": "m_not_in_catalogue",
    "incomplete_territory": "m_incomplete_territory",
    "invalid_date": "m_invalid_date",
    "critical": "m_critical",
}


def _kpi_sums() -> list[Column]:
    return [F.count("*").alias("consolidated"), *[F.sum(c).alias(n) for n, c in _KPI_FLAGS.items()]]


#: Panels of the dashboard and the column each is drawn over, beside the channel.
PANELS = {
    "kpis": None, "trend": "period", "classification": "classification", "territory": "dept", "status": "status", "regime": "regime",
}


def figures(consolidated: DataFrame, tenant: int | None = None) -> DataFrame:
    """The finest sums any panel needs: one row per channel, month, class, department, status
    and regime that occur together. Every panel re-aggregates from it."""
    fine = [c for c in PANELS.values() if c]
    return scope(consolidated, tenant).groupBy("channel", *fine).agg(*_kpi_sums(), _repeated().alias("duplicated"))


def panels(consolidated: DataFrame, tenant: int | None = None) -> DataFrame:
    """All panels as one long report from one scan: panel, channel, value and sums. Rows are
    spread over the panels after the first aggregation, never before. Months a filing does not
    have are no point of the trend."""
    sums = ["consolidated", *_KPI_FLAGS, "duplicated"]
    spread = F.array(*[
        F.struct(
            F.lit(name).alias("panel"), (F.lit(None).cast("string") if column is None else F.col(column)).alias("value")
        )
        for name, column in PANELS.items()
    ])
    return (
        figures(consolidated, tenant).select("channel", *sums, F.inline(spread))
        .filter((F.col("panel") != "trend") | F.col("value").isNotNull())
        .groupBy("panel", "channel", "value").agg(*[F.sum(c).alias(c) for c in sums])
    )


def _repeated() -> Column:
    return F.sum((F.col("m_multi_channel") + F.col("m_internal") > 0).cast("int"))


def kpis_by_channel(consolidated: DataFrame, tenant: int | None = None) -> DataFrame:
    return scope(consolidated, tenant).groupBy("channel").agg(*_kpi_sums()).orderBy("channel")


def kpis_rollup(consolidated: DataFrame, tenant: int | None = None) -> DataFrame:
    """KPIs per channel and for all of them, in one aggregation.

    The total is rolled up from the channel partials, so rows are not expanded.
    """
    partial = scope(consolidated, tenant).groupBy("channel").agg(*_kpi_sums())
    sums = [F.sum(n).alias(n) for n in ("consolidated", *_KPI_FLAGS)]
    return (
        partial.rollup("channel").agg(F.grouping("channel").cast("int").alias("is_total"), *sums)
        .withColumn("channel", F.coalesce("channel", F.lit(ALL)))
        .orderBy("is_total", "channel")
    )


def source_counts(
    sources: dict[str, DataFrame], catalogue: DataFrame, tenant: int | None = None, catalogue_name: str = "HOMOLOGACION_DOCUMENTOS"
) -> DataFrame:
    """Rows that came in per source. The catalogue is shared, so no tenant applies."""
    def counted(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")

    parts = [counted(name, scope(df, tenant)) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, [*parts, counted(catalogue_name, catalogue)])


def trend_by_channel(consolidated: DataFrame, tenant: int | None = None) -> DataFrame:
    return (
        scope(consolidated, tenant).filter(F.col("period").isNotNull())
        .groupBy("period", "channel")
        .agg(F.count("*").alias("n"), F.sum("is_effective").alias("effective"), _repeated().alias("duplicated"))
        .orderBy("period", "channel")
    )


def by_classification_by_channel(consolidated: DataFrame, tenant: int | None = None) -> DataFrame:
    return _counts(scope(consolidated, tenant), "channel", "classification")


def by_territory_by_channel(consolidated: DataFrame, tenant: int | None = None) -> DataFrame:
    counted = _counts(scope(consolidated, tenant), "channel", "dept")
    return counted.select("channel", "dept", department_label(F.col("dept"), "Sin dato").alias("department"), "n")


def by_status_by_channel(consolidated: DataFrame, tenant: int | None = None) -> DataFrame:
    """Grouped by the stored status, then shown with a default: a literal default and
    a missing status stay two rows."""
    counted = _counts(scope(consolidated, tenant), "channel", "status")
    return counted.select("channel", F.coalesce("status", F.lit("SIN ESTADO")).alias("status"), "n")


def by_regime_by_channel(consolidated: DataFrame, tenant: int | None = None) -> DataFrame:
    counted = _counts(scope(consolidated, tenant), "channel", "regime")
    return counted.select("channel", F.coalesce("regime", F.lit("SIN DATO")).alias("regime"), "n")


def territory_labels(consolidated: DataFrame, tenant: int | None = None, channel: str | None = None) -> DataFrame:
    """Filings by department name; the label runs on grouped codes, not on rows."""
    coded = _counts(scope(consolidated, tenant, channel), "dept")
    named = coded.select(department_label(F.col("dept"), "Sin dato").alias("department"), "n")
    return named.groupBy("department").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "department")


def top_territories(
    consolidated: DataFrame, tenant: int | None = None, channel: str | None = None, top: int = 10
) -> DataFrame:
    return territory_labels(consolidated, tenant, channel).limit(top)


def kpi_status(consolidated: DataFrame, tenant: int | None = None) -> DataFrame:
    """Traffic lights per channel and overall.

    Data quality subtracts unknown types and incomplete territory separately, so a
    filing with both counts twice.
    """
    total = F.col("consolidated")
    clean = total - F.col("not_in_catalogue") - F.col("incomplete_territory")

    def light(name: str, part: Column, good: float, fair: float, higher: bool) -> Column:
        value = pct1(part, total)
        return F.struct(
            F.lit(name).alias("kpi"), part.alias("n"), value.alias("value"),
            traffic_light(value, good, fair, higher).alias("status"),
        )

    # Thresholds of each light (good, fair).
    lights = F.array(
        light("effective", F.col("effective"), 90, 80, True),
        light("multi_channel", F.col("multi_channel"), 1, 3, False),
        light("internal", F.col("internal"), 5, 8, False),
        light("data_quality", clean, 97, 92, True),
        light("critical", F.col("critical"), 1, 3, False),
    )
    return kpis_rollup(consolidated, tenant).select("channel", F.inline(lights))


def quality_status(people: DataFrame, tenant: int | None = None, rules: Rules = Rules()) -> DataFrame:
    """Traffic light for each quality percentage of each channel."""
    def cell(name: str, column: str) -> Column:
        # Good from 95, fair from 85.
        return F.struct(
            F.lit(name).alias("measure"), F.col(column).alias("value"),
            traffic_light(F.col(column), 95, 85, True).alias("status"),
        )

    cells = F.array(cell("homologated", "pct_homologated"), cell("territory", "pct_territory"), cell("date", "pct_date"))
    return quality_by_source(people, tenant, rules).select("channel", F.inline(cells))


def _totals(consolidated: DataFrame) -> DataFrame:
    return consolidated.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum("is_effective"), F.lit(0)).alias("effective"),
        F.coalesce(F.sum("m_internal"), F.lit(0)).alias("internal"),
    )


def funnel(
    universe: DataFrame, consolidated: DataFrame, tenant: int | None = None, channel: str | None = None
) -> DataFrame:
    """Received, discarded, consolidated, effective; width is the share of received."""
    def step(position: int, name: str, column: str) -> Column:
        width = F.greatest(pct1(F.col(column), F.col("received")), F.lit(0.5))
        return F.struct(
            F.lit(position).alias("position"), F.lit(name).alias("step"),
            F.col(column).alias("n"), width.alias("width"),
        )

    received = scope(universe, tenant, channel).agg(F.count("*")).scalar()
    row = (
        _totals(scope(consolidated, tenant, channel))
        .withColumn("received", received)
        .withColumn("discarded", F.col("received") - F.col("total"))
    )
    return _rows(row, [
        step(1, "received", "received"),
        step(2, "discarded", "discarded"),
        step(3, "consolidated", "total"),
        step(4, "effective", "effective"),
    ])


def _monthly(consolidated: DataFrame, tenant: int | None, channel: str | None) -> DataFrame:
    return _counts(scope(consolidated, tenant, channel).filter(F.col("period").isNotNull()), "period")


def _round_tenths(value: Column) -> Column:
    """One-decimal figure to a whole number, half up."""
    return F.floor(value + F.lit(0.5)).cast("double")


def peak_month(consolidated: DataFrame, tenant: int | None = None, channel: str | None = None) -> DataFrame:
    """Busiest month, the first one on ties, and its excess over the monthly mean."""
    peak = F.max_by("period", F.struct("n", (-F.replace("period", F.lit("-"), F.lit("")).cast("int")).alias("first")))
    total, months, top = F.sum("n"), F.count("*"), F.max("n")
    return (
        _monthly(consolidated, tenant, channel)
        .agg(
            peak.alias("period"),
            top.alias("n"),
            months.alias("n_months"),
            (total / months).alias("monthly_mean"),
            _round_tenths(pct1(top * months - total, total)).alias("excess_pct"),
        )
        .filter("n_months > 0")
        .withColumn("label", month_label(F.col("period")))
    )


def incomplete_last_month(consolidated: DataFrame, tenant: int | None = None, channel: str | None = None) -> DataFrame:
    """Whether the last month is far below the upper median of all months.

    The list holds one number per calendar month, never one per filing.
    """
    ordered = F.sort_array(F.collect_list("n"))
    wide = _monthly(consolidated, tenant, channel).agg(
        F.max("period").alias("period"),
        F.max_by("n", "period").alias("n"),
        F.count("*").alias("n_months"),
        F.try_element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int")).alias("upper_median"),
    )
    late = (F.col("n_months") > 2) & (F.col("n") < F.col("upper_median") * 0.25)
    return wide.filter("n_months > 0").withColumn("is_incomplete", flag(late))


def findings(
    people: DataFrame, consolidated: DataFrame, tenant: int | None = None, channel: str | None = None,
    rules: Rules = Rules(),
) -> DataFrame:
    """Facts worth telling: kind, subject, percentage, count and status.

    The out-of-catalogue total covers every unknown type, not only a top list.
    """
    sources = quality_by_source(people, tenant, rules, unknown=True)
    in_scope = F.lit(True) if channel is None else F.col("channel") == channel
    summary = sources.agg(
        F.coalesce(F.sum(F.when(in_scope, F.col("n"))), F.lit(0)).alias("received"),
        F.coalesce(F.sum("n_unknown"), F.lit(0)).alias("unknown"),
        F.min_by(F.struct("channel", "pct_territory", "n"), F.struct("pct_territory", "channel")).alias("worst"),
    )
    row = (
        _totals(scope(consolidated, tenant, channel))
        .withColumn("s", summary.select(F.struct("*")).scalar())
        .select("total", "effective", "internal", "s.*")
        .withColumn("discarded", F.col("received") - F.col("total"))
    )
    effective = pct1(F.col("effective"), F.col("total"))
    discarded = pct1(F.col("discarded"), F.col("received"))
    internal = pct1(F.col("internal"), F.col("total"))
    territory = F.col("worst.pct_territory")
    nothing, no_value = F.lit(None).cast("string"), F.lit(None).cast("double")

    def told(
        position: int, kind: str, value: Column, n: str, status: Column, when: Column, subject: Column = nothing
    ) -> Column:
        return F.struct(
            F.lit(position).alias("position"), F.lit(kind).alias("kind"), subject.alias("subject"),
            value.alias("value"), F.col(n).cast("bigint").alias("n"), status.alias("status"), when.alias("told"),
        )

    facts = F.array(
        told(1, "effective", _round_tenths(effective), "effective", traffic_light(effective, 90, 80, True), F.lit(True)),
        told(3, "discarded", discarded, "discarded", F.when(discarded > 8, "alerta").otherwise("neutro"), F.col("discarded") > 0),
        told(4, "internal", internal, "internal", F.lit("mal"), internal > 5),
        told(
            6, "worst_territory", territory, "worst.n", F.when(territory < 92, "mal").otherwise("alerta"),
            territory < 97, channel_label(F.col("worst.channel")),
        ),
        told(7, "out_of_catalogue", no_value, "unknown", F.lit("alerta"), F.col("unknown") > 0),
    )
    parts = [row.select(F.inline(F.filter(facts, lambda x: x["told"]))).drop("told")]

    def fact(df: DataFrame, position: int, kind: str, subject: Column, value: Column) -> DataFrame:
        return df.select(
            F.lit(position).alias("position"), F.lit(kind).alias("kind"), subject.alias("subject"),
            value.alias("value"), "n", F.lit("neutro").alias("status"),
        )

    if channel is None:
        by_channel = _counts(scope(consolidated, tenant), "channel")
        largest = by_channel.orderBy(F.desc("n"), "channel").limit(1)
        share = pct1(F.col("n"), by_channel.agg(F.sum("n")).scalar())
        parts.append(fact(largest, 2, "top_channel", channel_label(F.col("channel")), share))
    peak = peak_month(consolidated, tenant, channel).filter("n_months > 1")
    parts.append(fact(peak, 5, "peak_month", F.col("label"), F.col("excess_pct")))
    return reduce(DataFrame.unionByName, parts).orderBy("position")


# ---- workbook --------------------------------------------------------------


def measures_by(
    consolidated: DataFrame, *dims: str, names: list[str] | None = None, tenant: int | None = None,
    channel: str | None = None, regime: str | None = None,
) -> DataFrame:
    """Any measures by any dimensions, with the workbook's channel and regime slicers."""
    rows = scope(consolidated, tenant, channel)
    if regime is not None:
        rows = rows.filter(F.col("regime") == regime)
    return rows.groupBy(*dims).agg(*pick(names)).orderBy(*dims)


def pivot_period_channel(
    consolidated: DataFrame, tenant: int | None = None, regime: str | None = None, rules: Rules = Rules()
) -> DataFrame:
    """Months down, channels across; the channel list is given, so no extra pass finds it."""
    rows = scope(consolidated, tenant)
    if regime is not None:
        rows = rows.filter(F.col("regime") == regime)
    return rows.groupBy("period").pivot("channel", list(rules.priority)).count().orderBy("period")


def report_table(consolidated: DataFrame, tenant: int | None = None) -> DataFrame:
    """Fifteen columns with the headings and labels the workbook expects, by month.

    Ordering inside a month lets the range sort split a month that holds most rows.
    """
    ordered = scope(consolidated, tenant).orderBy("period", "channel", "filing_id", "tenant")
    cells = [
        channel_label(F.col("channel")), F.col("period"), serial_date(F.col("filed_on")), department_label(F.col("dept"), None),
        *map(F.col, (
            "regime", "status", "classification", "doc_type", "is_effective", "m_multi_channel", "m_internal", "m_not_in_catalogue",
            "m_incomplete_territory", "m_invalid_date", "m_critical",
        )),
    ]
    return ordered.select(*[c.alias(h) for c, h in zip(cells, WORKBOOK_HEADINGS)])


def as_json(report: DataFrame, column: str = "payload") -> DataFrame:
    """Each row as one JSON text; decimals become doubles first."""
    plain = [
        F.col(f"`{f.name}`").cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f"`{f.name}`")
        for f in report.schema
    ]
    return report.select(F.to_json(F.struct(*plain)).alias(column))


def has_data(consolidated: DataFrame, tenant: int) -> bool:
    return not scope(consolidated, tenant).isEmpty()


def printable(report: DataFrame) -> DataFrame:
    """Figures as people read them: separators in whole numbers, a dash for nothing."""
    whole = ("byte", "short", "integer", "long")
    return report.select([
        thousands(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in whole
        else F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("—")).alias(f.name)
        for f in report.schema
    ])


def batch_report(
    consolidated: DataFrame, people: DataFrame, universe: DataFrame, notices: DataFrame, tenant: int, rules: Rules = Rules()
) -> dict[str, DataFrame]:
    """The five tables a batch run ends with, by title."""
    quality = quality_by_source(people, tenant, rules)
    return dict(zip(BATCH_TITLES, (
        headline(consolidated, universe, notices, tenant, rules),
        by_classification(consolidated, tenant),
        source_contribution(universe, consolidated, tenant).drop("pct_survives"),
        quality.select("channel", "n", "pct_homologated", "pct_territory", "pct_date"),
        out_of_catalogue(universe, tenant, 10, rules),
    )))


def dashboard(
    consolidated: DataFrame, people: DataFrame, universe: DataFrame, sources: dict[str, DataFrame], catalogue: DataFrame,
    tenant: int, rules: Rules = Rules(),
) -> dict[str, DataFrame]:
    """Everything one dashboard page shows, each with the channel as a dimension.

    The panels over the consolidated table come from one scan of it: they are written
    aside together, a few hundred rows, and each panel reads its own.
    """
    drawn = write_scratch(panels(consolidated, tenant), "panels")

    def panel(name: str, *columns: Column | str) -> DataFrame:
        return drawn.filter(F.col("panel") == name).select(*columns)

    n, value = F.col("consolidated").alias("n"), F.col("value")
    return {
        "kpis": panel("kpis", "channel", "consolidated", *_KPI_FLAGS).orderBy("channel"),
        "sources": source_counts(sources, catalogue, tenant),
        "contribution": source_contribution(universe, consolidated, tenant),
        "quality": quality_by_source(people, tenant, rules),
        "out_of_catalogue": out_of_catalogue(universe, tenant, 10, rules),
        "trend": panel("trend", value.alias("period"), "channel", n, "effective", "duplicated").orderBy("period", "channel"),
        "classification": panel("classification", "channel", value.alias("classification"), n),
        "territory": panel("territory", "channel", value.alias("dept"), department_label(value, "Sin dato").alias("department"), n),
        "status": panel("status", "channel", F.coalesce(value, F.lit("SIN ESTADO")).alias("status"), n),
        "regime": panel("regime", "channel", F.coalesce(value, F.lit("SIN DATO")).alias("regime"), n),
    }
