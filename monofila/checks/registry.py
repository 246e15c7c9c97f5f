"""Every query by name, built on tables derived from one data folder."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from monofila.functions.columns import department_label, lookup, period, strip_blank
from monofila.operators import bitmaps as B
from monofila.operators import consolidate as C
from monofila.operators import events as E
from monofila.operators import profiles as P
from monofila.operators import sampling as M
from monofila.operators import universe as U
from monofila.plans import reports as R
from monofila.rules import DESK, OFFICIAL, WEB, Rules
from monofila.schemas import CATALOGUE, CONSOLIDATED, CONSOLIDATED_HEADINGS, DESK_CHANNEL, DESK_SOURCE, HISTORY_SOURCE, NOTICES_SOURCE, OFFICIAL_CHANNEL, OFFICIAL_SOURCE, SOURCES, Source, WEB_CHANNEL, WEB_SOURCE, people
from monofila.sources import staged as S
from monofila.operators.universe import Channel
from monofila.sources.delimited import BY_FILE, completeness, load_source, load_total, oversized, refused, staged, violations
from monofila.sources.storage import ensure_tenant, read_tenants, replace_tenants, scratch_path, write_csv, write_scratch

RULES = Rules()
#: Tenants of the derived tables.
TENANTS = (0, 1)


LANDED = ((DESK_CHANNEL, DESK_SOURCE, "desk"), (WEB_CHANNEL, WEB_SOURCE, "web"), (OFFICIAL_CHANNEL, OFFICIAL_SOURCE, "official"))


def _file_names(channel: Channel) -> dict[str, str]:
    """Staged name of each column of a channel and its name in the file."""
    names = {
        "id": channel.filing_id, "doc_type": channel.doc_type, "doc_num": channel.doc_number, "filed": channel.filed[0],
        "regime": channel.regime, "advisor": channel.advisor,
    }
    if channel.name == WEB:
        return names | {"requested": channel.filed[1], "status": channel.status, "dane": channel.residence}
    return names | {"dept": channel.dept, "muni": channel.municipality}


def _as_file(df: DataFrame, channel: Channel) -> DataFrame:
    return df.select(*[F.col(c).alias(name) for c, name in _file_names(channel).items()])


def _delimited(df: DataFrame, separator: str, path: str) -> None:
    df.write.mode("append").option("header", True).option("sep", separator).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)


def _side_by_side(spark: SparkSession, turns: list[list[Callable[[], tuple]]]) -> list[tuple]:
    """Results of loads. Those of one turn run one after the other; turns run at the same time, so that
    what one load leaves idle (listing, headers, last tasks, commits) another one uses."""
    with ThreadPoolExecutor(max_workers=len(turns)) as pool:
        done = pool.map(inheritable_thread_target(spark)(lambda turn: [load() for load in turn]), turns)
        return [row for rows in done for row in rows]


_LOADED = "tenant int, file string, state string, rows bigint, discarded bigint, ignored array<string>, encoding string, refused bigint"


class Bench:
    """Staging and derived tables of one folder.

    Lazy DataFrames, except the consolidated table: reports read it as a written
    table, computed once per session and folder.
    """

    _known: dict[tuple[str, str], Bench] = {}

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @classmethod
    def at(cls, spark: SparkSession, folder: str) -> Bench:
        key = (spark.sparkContext.applicationId, folder)
        if key not in cls._known or cls._known[key].spark is not spark:
            cls._known[key] = cls(spark, folder)
        return cls._known[key]

    def table(self, name: str) -> DataFrame:
        return S.table(self.spark, self.folder, name)

    @cached_property
    def catalogue(self) -> DataFrame:
        return S.catalogue(self.spark)

    @cached_property
    def desk(self) -> DataFrame:
        return S.desk(self.spark, self.folder)

    @cached_property
    def web(self) -> DataFrame:
        return S.web(self.spark, self.folder)

    @cached_property
    def official(self) -> DataFrame:
        return S.official(self.spark, self.folder)

    @cached_property
    def history(self) -> DataFrame:
        return S.history(self.spark, self.folder)

    @cached_property
    def notices(self) -> DataFrame:
        return S.labour(self.spark, self.folder)

    @cached_property
    def universe(self) -> DataFrame:
        channels = [(S.DESK_COLUMNS, self.desk), (S.WEB_COLUMNS, self.web), (S.OFFICIAL_COLUMNS, self.official)]
        return U.universe(channels, self.catalogue, RULES)

    @cached_property
    def computed(self) -> DataFrame:
        return C.as_table(C.consolidate(self.universe, self.history, RULES))

    @cached_property
    def written(self) -> str:
        """The table a refresh writes: partitioned by tenant, sorted by channel and month."""
        path = scratch_path(self.spark, "consolidated")
        table = C.as_table(C.consolidate_people(self.universe, self.history, RULES))
        replace_tenants(table, path, TENANTS, ("channel", "period"))
        return path

    @cached_property
    def consolidated(self) -> DataFrame:
        return read_tenants(self.spark, self.written, CONSOLIDATED)

    @cached_property
    def people(self) -> DataFrame:
        return read_tenants(self.spark, self.written, people(RULES))

    @property
    def received(self) -> DataFrame:
        """Tenant and channel of every filing. A lookup never multiplies filings, so counting
        them needs none."""
        parts = ((DESK, self.desk), (WEB, self.web), (OFFICIAL, self.official))
        rows = [df.select("tenant", F.lit(name).alias("channel")) for name, df in parts]
        return rows[0].unionByName(rows[1]).unionByName(rows[2])

    @cached_property
    def landed(self) -> tuple[DataFrame, str]:
        """The channels written as delimited files, loaded again tenant by tenant: the load
        reports and the warehouse. Files of a source differ in header order and columns, and
        every thirty-seventh filing of some is a short row."""
        folder, warehouse = scratch_path(self.spark, "landing"), scratch_path(self.spark, "warehouse")

        def land(tenant: int, channel: Channel, source: Source, df: str) -> tuple:
            rows = _as_file(getattr(self, df).filter(F.col("tenant") == tenant), channel)
            some = F.col(channel.filing_id) % 3 == 0
            short = some & (F.col(channel.filing_id) % 37 == 0)
            target = f"{folder}/{tenant}/{source.file}"
            _delimited(rows.filter(~some), source.separator, target)
            turned = rows.filter(some & ~short).withColumn("EXTRA", F.lit("not wanted"))
            _delimited(turned.select(*reversed(turned.columns)), source.separator, target)
            header = source.separator.join(rows.columns)
            lines = rows.filter(short).select(F.col(channel.filing_id).cast("string").alias(header))
            lines.write.mode("append").option("header", True).option("sep", "\x01").option("quote", "\x00").csv(target)
            return (tenant, *load_source(self.spark, f"{folder}/{tenant}", warehouse, source, tenant, encoding="UTF-8"))

        reports = _side_by_side(self.spark, [[partial(land, tenant, *place)] for tenant in TENANTS for place in LANDED])
        return self.spark.createDataFrame(reports, _LOADED), warehouse

    @cached_property
    def landed_rest(self) -> tuple[DataFrame, str]:
        """The three sources that are no channel, written as files and loaded tenant by tenant. Every
        other file of a source is UTF-8, the others are Latin-1; the load finds out."""
        folder, warehouse = scratch_path(self.spark, "landing"), scratch_path(self.spark, "warehouse")
        shared = self.catalogue.select(F.col("name").alias("Tipo_Documento_Afiliado"), F.col("code").alias("CODIGO"), F.col("abbr").alias("Abreviatura"))
        told = F.concat("log", F.lit(" · Ñandú"))
        rest = (
            (CATALOGUE, shared),
            (HISTORY_SOURCE, self.history.select(
                "tenant", F.col("doc_type").alias("TIPO_IDENTIFICACION"), F.col("doc_num").alias("NUMERO_IDENTIFICACION"), F.col("entity").alias("ENTIDAD")
            )),
            (NOTICES_SOURCE, self.notices.select("tenant", F.col("log").alias("LOG_ERRORES"), told.alias("ORIGEN"))),
        )

        def land(tenant: int, source: Source, rows: DataFrame) -> tuple:
            df = rows if source.shared else rows.filter(F.col("tenant") == tenant).drop("tenant")
            target = f"{folder}/{tenant}/{source.file}"
            half = F.pmod(F.hash(*df.columns), F.lit(2))
            for part, encoding in enumerate(("UTF-8", "ISO-8859-1")):
                df.filter(half == part).write.mode("append").option("header", True).option("sep", source.separator).option("encoding", encoding).csv(target)
            return (tenant, *load_source(self.spark, f"{folder}/{tenant}", warehouse, source, tenant, encoding=BY_FILE))

        # A table that all tenants share is replaced as a whole, so its loads follow one another.
        turns = [[partial(land, tenant, source, rows) for tenant in TENANTS] for source, rows in rest if source.shared]
        turns += [[partial(land, tenant, source, rows)] for source, rows in rest if not source.shared for tenant in TENANTS]
        return self.spark.createDataFrame(_side_by_side(self.spark, turns), _LOADED), warehouse

    @property
    def sources(self) -> dict[str, DataFrame]:
        return {
            DESK: self.desk, WEB: self.web, OFFICIAL: self.official,
            "XML_HISTORICO": self.history, "PROCESO_IRL": self.notices,
        }


def _homologation_hits(b: Bench) -> DataFrame:
    parts = [
        U.homologate(df, F.col("doc_type"), b.catalogue, "abbr", RULES).select(
            F.lit(name).alias("channel"), "doc_type", "homologated"
        )
        for name, df in ((DESK, b.desk), (WEB, b.web))
    ]
    return (
        parts[0].unionByName(parts[1])
        .groupBy("channel", F.trim("doc_type").alias("received"), "homologated")
        .agg(F.count("*").alias("n"))
    )


def _homologation_code(b: Bench) -> DataFrame:
    rows = U.homologate(b.official, F.col("doc_type"), b.catalogue, "code", RULES)
    return rows.groupBy(F.trim("doc_type").alias("received"), "homologated").agg(F.count("*").alias("n"))


def _per_code(b: Bench, only_shared: bool) -> DataFrame:
    """Catalogue by code with the filings that arrived under each code."""
    codes = U.collisions(b.catalogue) if only_shared else U.by_code(b.catalogue)
    used = (
        b.official.groupBy(F.trim("doc_type").try_cast("int").alias("code")).agg(F.count("*").alias("_n"))
    )
    return codes.join(used, "code", "left").select(
        "code", "abbr", "n_abbreviations", F.coalesce("_n", F.lit(0)).alias("n_filings")
    )


TEXTS = {
    DESK: ("doc_type", "doc_num", "filed", "regime", "dept", "muni", "advisor"),
    WEB: ("doc_type", "doc_num", "filed", "requested", "status", "regime", "dane", "advisor"),
    OFFICIAL: ("doc_type", "doc_num", "filed", "regime", "dept", "muni", "advisor"),
}


def _blank_to_null(b: Bench) -> DataFrame:
    """Every text of every channel, surrounded by mixed blanks, as loaded."""
    parts = []
    for name, texts in TEXTS.items():
        noisy = [F.concat(F.lit("\t "), F.coalesce(t, F.lit("")), F.lit(" \r\n")).alias(t) for t in texts]
        clean = [strip_blank(F.col(t)).alias(t) for t in texts]
        parts.append(b.sources[name].select("tenant", "id", *noisy).select(F.lit(name).alias("channel"), "tenant", "id", *clean))
    return parts[0].unionByName(parts[1], True).unionByName(parts[2], True)


def _width_violations(b: Bench) -> DataFrame:
    """Every channel against the widths its file may have. Staged names are shorter than the
    file's, so widths go through the channel mapping."""
    parts = []
    for channel, source, df in LANDED:
        names = {c: n for c, n in _file_names(channel).items() if c in ("id", "doc_type", "doc_num", "filed", "regime", "advisor")}
        # Texts as an unpadded sender would repeat them: some outgrow their column.
        grown = getattr(b, df).withColumns({n: F.repeat(F.col(n), F.pmod("id", F.lit(4)).cast("int") + 1) for n in names if n != "id"})
        rules = {n: source.columns[column] for n, column in names.items()}
        parts.append(violations(grown, rules, "tenant", F.lit(channel.name).alias("channel"), F.col("id").alias("filing")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _loaded(b: Bench) -> DataFrame:
    """Rows of the staging tables after a load, in staged names."""
    parts = []
    for channel, source, _ in LANDED:
        rows = staged(b.spark, b.landed[1], source)
        parts.append(rows.select("tenant", F.lit(channel.name).alias("channel"), *[
            F.col(name).cast("string").alias(c) for c, name in _file_names(channel).items()
        ]))
    return parts[0].unionByName(parts[1], True).unionByName(parts[2], True)


def _load_report(b: Bench) -> DataFrame:
    return b.landed[0].select("tenant", "file", "state", "rows", "discarded", F.array_join("ignored", ",").alias("ignored"))


def _loaded_rest(b: Bench) -> DataFrame:
    """Catalogue, history and notices after two loads each: the catalogue is replaced as a whole,
    the others tenant by tenant."""
    warehouse = b.landed_rest[1]
    catalogue, history, notices = (staged(b.spark, warehouse, source) for source in (CATALOGUE, HISTORY_SOURCE, NOTICES_SOURCE))
    parts = [
        catalogue.select(F.lit(None).cast("int").alias("tenant"), F.lit("catalogue").alias("source"), F.concat_ws("|", "Abreviatura", "CODIGO", "Tipo_Documento_Afiliado").alias("row")),
        history.select("tenant", F.lit("history").alias("source"), F.concat_ws("|", "TIPO_IDENTIFICACION", "NUMERO_IDENTIFICACION", "ENTIDAD").alias("row")),
        notices.select("tenant", F.lit("notices").alias("source"), F.concat_ws("|", "LOG_ERRORES", "ORIGEN").alias("row")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("tenant", "source", "row").agg(F.count("*").alias("n"))


def _quarantine(b: Bench) -> DataFrame:
    """Desk filings with values that do not fit, loaded by one write each: what was accepted and what
    was refused for which values."""
    folder, warehouse = scratch_path(b.spark, "landing"), scratch_path(b.spark, "warehouse")
    for tenant in TENANTS:
        rows = b.desk.filter(F.col("tenant") == tenant).select(
            F.concat(F.when(F.col("id") % 11 == 0, "x").otherwise(""), F.col("id")).alias("ID"), F.col("id").cast("string").alias("SOLICITUD"),
            F.repeat("advisor", F.pmod("id", F.lit(8)).cast("int") + 1).alias("CODIGOASESOR"),
        )
        _delimited(rows, DESK_SOURCE.separator, f"{folder}/{tenant}/{DESK_SOURCE.file}")
        load_source(b.spark, f"{folder}/{tenant}", warehouse, DESK_SOURCE, tenant, encoding="UTF-8", quarantine=True)
    told = F.array_join(F.transform("problems", lambda x: F.concat_ws(":", x["column"], x["problem"], x["length"], x["value"])), ", ")
    columns = ("tenant", F.col("SOLICITUD").alias("filing"), F.col("ID").alias("id"))
    accepted = staged(b.spark, warehouse, DESK_SOURCE).select(*columns, F.lit("accepted").alias("verdict"), F.lit("").alias("problems"))
    return accepted.unionByName(refused(b.spark, warehouse, DESK_SOURCE).select(*columns, F.lit("refused").alias("verdict"), told.alias("problems")))


def _load_total(b: Bench) -> DataFrame:
    """The grand total of all loads of both tenants, all six sources."""
    return load_total(b.landed[0].unionByName(b.landed_rest[0]))


def _oversized(b: Bench) -> DataFrame:
    """Every page as a file that somebody sends, against a limit of the deployment."""
    sent = b.table("pages").select(F.concat("url", F.lit(".csv")).alias("file"), F.octet_length("html").cast("bigint").alias("bytes"))
    return oversized(sent, 2_000)


def _backfilled(b: Bench) -> DataFrame:
    """A table from before tenants existed, written without the column and read as today's."""
    old = write_scratch(b.table("customer").select("c_custkey", "c_mktsegment"), "before-tenants")
    return ensure_tenant(old)


def _emptiness(b: Bench) -> DataFrame:
    """Which tenants have consolidated rows; nobody is tenant 99."""
    return b.spark.createDataFrame([(t, R.has_data(b.consolidated, t)) for t in (*TENANTS, 99)], "tenant int, has_data boolean")


def _persons_rollup(b: Bench) -> DataFrame:
    dims = ("tenant", "channel", "period")
    filings = b.universe.select("person_key", "tenant", "channel", period(F.col("filed_at")).alias("period"))
    return B.persons_rollup(write_scratch(B.person_bitmaps(filings, *dims), "bitmaps"), *dims)


def _export_round_trip(b: Bench) -> DataFrame:
    """The consolidated table as a spreadsheet file, read back."""
    path = scratch_path(b.spark, "export")
    headed = b.consolidated.select([F.col(c).alias(h) for c, h in CONSOLIDATED_HEADINGS.items()])
    write_csv(headed, path)
    back = b.spark.read.option("sep", ";").option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    # The byte-order mark stands before the first heading.
    back = back.withColumnRenamed(back.columns[0], back.columns[0].lstrip("\ufeff"))
    return back.select([F.col(h).alias(c) for c, h in CONSOLIDATED_HEADINGS.items()])


def _input_completeness(b: Bench) -> DataFrame:
    """File names as each tenant's rows announce them, against the six expected."""
    files = {"5-LOW": "AFILIACIONES.csv", "2-HIGH": "DIGITAL.csv", "1-URGENT": "SAT.csv"}
    orders = b.table("orders").select(
        F.expr("CASE WHEN o_orderkey % 8 < 4 THEN 0 ELSE 1 END").alias("tenant"),
        F.coalesce(lookup(F.col("o_orderpriority"), files), F.concat("o_orderpriority", F.lit(".csv"))).alias("file"),
    )
    expected = orders.select("tenant").distinct().select(
        "tenant", F.explode(F.array(*[F.lit(s.file) for s in SOURCES])).alias("file")
    )
    return completeness(orders, expected, "tenant")


STATUS_WEIGHTS = (("RADICADO", 93.5), ("ANULADO", 2.4), ("SIN-PRERADICAR", 2.1), ("RECHAZADO", 1.9), ("DEVOLUCIÓN", 0.1))
COHORTS = (("none", 0.065), ("own", 0.73))


def _filings(b: Bench) -> DataFrame:
    return b.table("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("channel")
    )


def _universe(b: Bench) -> DataFrame:
    return b.universe.withColumn("filed_at", F.date_format("filed_at", "yyyy-MM-dd HH:mm:ss"))


def registered() -> dict[str, Callable[[Bench], DataFrame]]:
    return {
        # universe and profiles
        "q_universe": _universe,
        "q_catalogue_by_code": lambda b: _per_code(b, False),
        "q_catalogue_collisions": lambda b: _per_code(b, True),
        "q_homologation_hits": _homologation_hits,
        "q_homologation_code": _homologation_code,
        "q_history_profile": lambda b: P.history_profile(b.history, RULES),
        "q_duplicity_profile": lambda b: P.duplicity_profile(b.universe, RULES),
        "q_duplicity_of_people": lambda b: P.duplicity_of_people(b.people, RULES),
        # consolidated row
        "q_consolidated": lambda b: b.computed,
        "q_classification": lambda b: b.consolidated.select("tenant", "person_key", "classification"),
        "q_quality_flags": lambda b: b.consolidated.select(
            "tenant", "person_key", "m_not_in_catalogue", "m_empty_document", "m_incomplete_territory",
            "m_invalid_date", "m_critical",
        ),
        "q_duplicate_flags": lambda b: b.consolidated.select(
            "tenant", "person_key", "m_multi_channel", "m_internal", "n_channels", "n_filings"
        ),
        "q_effective": lambda b: b.consolidated.select("tenant", "person_key", "channel", "status", "is_effective"),
        # batch report
        "q_headline": lambda b: R.headline(b.consolidated, b.received, b.notices),
        "q_headline_tenant": lambda b: R.headline(b.consolidated, b.received, b.notices, tenant=1),
        "q_tenant_totals": lambda b: R.tenant_totals(b.consolidated, 1),
        "q_by_classification": lambda b: R.by_classification(b.consolidated),
        "q_source_contribution": lambda b: R.source_contribution(b.received, b.consolidated),
        "q_by_regime": lambda b: R.by_regime(b.consolidated),
        "q_advisor_pareto": lambda b: R.advisor_pareto(b.consolidated),
        "q_by_territory": lambda b: R.by_territory(b.consolidated),
        "q_trend": lambda b: R.trend(b.consolidated),
        "q_quality_by_source": lambda b: R.quality_by_source(b.people),
        "q_out_of_catalogue": lambda b: R.out_of_catalogue(b.universe, top=10),
        "q_channel_combinations": lambda b: R.channel_combinations(b.people),
        "q_labour_inconsistency": lambda b: R.labour_inconsistency(b.notices),
        "q_labour_reasons": lambda b: R.labour_reasons(b.notices),
        # dashboard
        "q_kpis_by_channel": lambda b: R.kpis_by_channel(b.consolidated, tenant=0),
        "q_quality_by_source_tenant": lambda b: R.quality_by_source(b.people, tenant=1),
        "q_distinct_persons": _persons_rollup,
        "q_dashboard_panels": lambda b: R.panels(b.consolidated),
        "q_kpis_rollup": lambda b: R.kpis_rollup(b.consolidated),
        "q_source_counts": lambda b: R.source_counts(b.sources, b.catalogue, tenant=0),
        "q_trend_by_channel": lambda b: R.trend_by_channel(b.consolidated, tenant=0),
        "q_by_status": lambda b: R.by_status_by_channel(b.consolidated),
        "q_by_classification_by_channel": lambda b: R.by_classification_by_channel(b.consolidated, tenant=0),
        "q_by_regime_by_channel": lambda b: R.by_regime_by_channel(b.consolidated, tenant=0),
        "q_by_territory_by_channel": lambda b: R.by_territory_by_channel(b.consolidated, tenant=0),
        "q_territory_labels": lambda b: R.territory_labels(b.consolidated),
        "q_territory_labels_of_channel": lambda b: R.territory_labels(b.consolidated, channel=WEB),
        "q_top_territories": lambda b: R.top_territories(b.consolidated),
        "q_kpi_status": lambda b: R.kpi_status(b.consolidated),
        "q_quality_status": lambda b: R.quality_status(b.people),
        "q_funnel": lambda b: R.funnel(b.received, b.consolidated),
        "q_findings": lambda b: R.findings(b.people, b.consolidated),
        "q_peak_month": lambda b: R.peak_month(b.consolidated),
        "q_incomplete_last_month": lambda b: R.incomplete_last_month(b.consolidated),
        # workbook
        "q_measures_by_channel": lambda b: R.measures_by(b.consolidated, "channel"),
        "q_measures_by_classification": lambda b: R.measures_by(
            b.consolidated, "classification", names=["filings", "effective_share"]
        ),
        "q_measures_sliced": lambda b: R.measures_by(
            b.consolidated, "classification", names=["filings", "effective_share"], regime="SUBSIDIADO"
        ),
        "q_measures_by_department": lambda b: R.measures_by(
            b.consolidated.withColumn("department", department_label(F.col("dept"), None)),
            "department", names=["filings", "territory_share"],
        ),
        "q_pivot_period_channel": lambda b: R.pivot_period_channel(b.consolidated),
        "q_report_table": lambda b: R.report_table(b.consolidated),
        # loading and sampling
        "q_load_blank_to_null": _blank_to_null,
        "q_width_violations": _width_violations,
        "q_load_rows": _loaded,
        "q_load_report": _load_report,
        "q_load_rest": _loaded_rest,
        "q_load_total": _load_total,
        "q_load_quarantine": _quarantine,
        "q_oversized_files": _oversized,
        "q_tenant_backfill": _backfilled,
        "q_has_data": _emptiness,
        "q_printed_figures": lambda b: R.printable(R.kpis_rollup(b.consolidated)),
        "q_export_round_trip": _export_round_trip,
        "q_input_completeness": _input_completeness,
        "q_cohort_split": lambda b: M.split_cohorts(
            b.table("customer").select("c_custkey"), "cohorts", ["c_custkey"], COHORTS, "other"
        ),
        "q_weighted_draw": lambda b: b.table("orders").select(
            "o_orderkey", M.weighted_draw("status", STATUS_WEIGHTS, "o_orderkey").alias("status")
        ),
        "q_duplicate_injection": lambda b: M.inject_duplicates(_filings(b), "inject", "id", "person", "channel"),
        # events
        "q_rate_limit": lambda b: E.rate_limit(b.table("events"), window_seconds=86_400),
        "q_lockouts": lambda b: E.lockouts(
            b.table("events"), F.col("event_type") == "error", failures=3, lock_seconds=86_400
        ),
        "q_failure_streaks": lambda b: E.failure_streaks(b.table("events"), F.col("event_type") == "error"),
        "q_retention": lambda b: E.retain(b.table("events")).select(
            "event_id", "user_id", "event_type", F.col("ts").cast("date").alias("day")
        ),
        "q_report_json": lambda b: R.as_json(R.trend_by_channel(b.consolidated)),
    }
