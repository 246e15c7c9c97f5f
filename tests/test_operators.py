"""Hand-written rows for what the test tables cannot show."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from monofila.functions import columns as C
from monofila.functions.measures import MEASURE_TITLES, measures
from monofila.operators.bitmaps import distinct_persons, person_bitmaps, persons_rollup
from monofila.operators.consolidate import as_table, consolidate, consolidate_people, survivors
from monofila.operators.profiles import duplicity_of_people, duplicity_profile, history_by_key, history_profile
from monofila.operators.universe import UNIVERSE_COLUMNS, Channel, universe
from monofila.plans import reports as R
from monofila.rules import DESK, OFFICIAL, WEB, Rules

HISTORY = "tenant int, doc_type string, doc_num string, entity string"
CATALOGUE = [("Cédula", 3, "CC"), ("NIT", 4, "NI"), ("NIT", 4, "NT"), ("Tarjeta", 15, "TI")]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def filings(spark, *rows):
    """(tenant, channel, id, type, number, filed_at) as universe rows."""
    data = [
        (t, ch, i, ty, n, None if n is None else f"{ty}-{n}", ty, d, None, "05", "001", None, None, None, None, None)
        for t, ch, i, ty, n, d in rows
    ]
    types = ["int"] + ["string"] * 6 + ["timestamp_ntz"] + ["string"] * 8
    return spark.createDataFrame(data, ", ".join(f"{n} {t}" for n, t in zip(UNIVERSE_COLUMNS, types)))


def no_history(spark):
    return spark.createDataFrame([], HISTORY)


@pytest.mark.parametrize("text, expected", [
    ("05/03/25", datetime(2025, 3, 5)),
    (" 5/3/25 ", datetime(2025, 3, 5)),
    ("01/01/69", datetime(2069, 1, 1)),
    ("01/01/70", datetime(1970, 1, 1)),
    ("05/03/95", datetime(1995, 3, 5)),
    ("29/02/96", datetime(1996, 2, 29)),
    ("31/02/25", None),
    ("05/03/2025", None),
    ("2025-03-05", None),
    ("2025-03-05 10:00:00 America/Bogota", None),
    ("", None),
    (None, None),
])
def test_parse_dmy(spark, text, expected):
    assert one(spark, C.parse_dmy(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize("text, expected", [
    ("2025-03-05 10:20:30", datetime(2025, 3, 5, 10, 20, 30)),
    ("2025-3-5 1:2:3", datetime(2025, 3, 5, 1, 2, 3)),
    ("2025-02-30 10:20:30", None),
    ("05/03/25", None),
    ("  ", None),
])
def test_parse_iso(spark, text, expected):
    assert one(spark, C.parse_iso(F.lit(text))) == expected


def test_dates_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert one(spark, C.parse_iso(F.lit("2025-03-09 02:30:00"))) == datetime(2025, 3, 9, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_percentages_round_half_up_and_survive_zero(spark):
    assert one(spark, C.pct(F.lit(1), F.lit(800))) == 0.13
    assert one(spark, C.pct(F.lit(0), F.lit(0))) is None
    assert one(spark, C.pct1(F.lit(1), F.lit(2000))) == 0.1
    assert one(spark, C.pct1(F.lit(5), F.lit(0))) == 0.0
    # Below zero the nearest tenth as well, halves up.
    assert one(spark, C.pct1(F.lit(-10), F.lit(10))) == -100.0
    assert one(spark, C.pct1(F.lit(-1), F.lit(3))) == -33.3
    assert one(spark, C.pct1(F.lit(-1), F.lit(2000))) == 0.0
    assert one(spark, C.pct1(F.lit(-3), F.lit(2000))) == -0.1
    assert one(spark, C.pct(F.lit(-7), F.lit(3))) == -233.33


def test_labels(spark):
    assert one(spark, C.department_label(F.lit(" 05001 "), "Sin dato")) == "Antioquia"
    assert one(spark, C.department_label(F.lit("77"), "Sin dato")) == "Código 77"
    assert one(spark, C.department_label(F.lit(None).cast("string"), "Sin dato")) == "Sin dato"
    assert one(spark, C.department_label(F.lit(" "), None)) is None
    assert one(spark, C.channel_label(F.lit("OTHER"))) == "OTHER"
    assert one(spark, C.month_label(F.lit("2026-01"))) == "ene 2026"
    assert one(spark, C.serial_date(F.lit("2026-01-05"))) == 46027
    assert one(spark, C.thousands(F.lit(1234567))) == "1,234,567"
    assert one(spark, C.thousands(F.lit(None).cast("int"))) == "—"


def test_strip_blank(spark):
    assert one(spark, C.strip_blank(F.lit("\t  a b \r\n"))) == "a b"
    assert one(spark, C.strip_blank(F.lit("  \t"))) is None


def test_universe_aligns_channels(spark):
    channel = Channel(
        name=OFFICIAL, lookup="code", date_style="dmy", filing_id="id", doc_type="ty", doc_number="num",
        filed=("at",), regime="reg", dept="dep", municipality="mun", provider="ips",
    )
    rows = spark.createDataFrame(
        [(1, 1, "4", "9", "05/03/25", " x ", "", " 001", "ips"), (1, 2, "03", "9", "x", None, "05", "001", None)],
        "tenant int, id int, ty string, num string, at string, reg string, dep string, mun string, ips string",
    )
    catalogue = spark.createDataFrame(CATALOGUE, "name string, code int, abbr string")
    got = {r["filing_id"]: r for r in universe([(channel, rows)], catalogue).collect()}
    assert len(got) == 2 and tuple(got["1"].asDict()) == UNIVERSE_COLUMNS
    assert got["1"]["person_key"] == "NI-9" and got["2"]["person_key"] == "NO_HOMOLOGADO-9"
    assert (got["1"]["regime"], got["1"]["dept"], got["1"]["municipality"]) == ("X", None, "001")


def test_survivor_order(spark):
    day, later = datetime(2025, 1, 1), datetime(2025, 1, 1, 5)
    u = filings(
        spark,
        (1, DESK, "1", "CC", "1", day), (1, WEB, "2", "CC", "1", later), (1, OFFICIAL, "3", "CC", "1", later),
        (1, DESK, "9", "CC", "2", day), (1, DESK, "10", "CC", "2", day),
        (1, WEB, "5", "CC", "3", day), (1, WEB, "6", "CC", "3", None),
        (1, WEB, "7", "CC", "4", later), (1, WEB, "8", "CC", "4", day),
        (1, "OTHER", "0", "CC", "5", day), (1, DESK, "1", "CC", "5", later),
    )
    assert {r["person_key"]: r["filing_id"] for r in survivors(u).collect()} == {
        "CC-1": "3", "CC-2": "10", "CC-3": "6", "CC-4": "8", "CC-5": "1"
    }


def test_null_keys_and_tenants(spark):
    u = filings(
        spark, (1, DESK, "1", "CC", None, None), (1, WEB, "2", "TI", None, None), (2, DESK, "3", "CC", None, None),
        (1, DESK, "4", "CC", "7", None), (2, DESK, "5", "CC", "7", None),
    )
    got = consolidate(u, no_history(spark)).collect()
    assert sorted((r["tenant"], r["filing_id"], r["n_filings"]) for r in got) == [(1, "2", 1), (1, "4", 1), (2, "3", 1), (2, "5", 1)]
    kept = consolidate(u, no_history(spark), Rules(keep_null_keys=True)).collect()
    assert sorted(r["filing_id"] for r in kept) == ["1", "2", "3", "4", "5"]
    assert all(r["m_critical"] == 1 for r in kept)


def test_duplicates_across_and_inside_channels(spark):
    u = filings(
        spark, (1, DESK, "1", "CC", "1", None), (1, WEB, "2", "CC", "1", None), (1, WEB, "3", "CC", "1", None),
        (1, DESK, "4", "NO_HOMOLOGADO", "1", None), (1, WEB, "5", "NO_HOMOLOGADO", "1", None), (1, DESK, "6", "CC", "", None),
        (1, DESK, "7", "CC", "", None),
    )
    profile = {r["person_key"]: r for r in duplicity_profile(u).collect()}
    assert list(profile) == ["CC-1"]
    assert (profile["CC-1"]["n_channels"], profile["CC-1"]["n_filings"], profile["CC-1"]["n_repeats"]) == (2, 3, 1)
    rows = {r["person_key"]: r for r in consolidate(u, no_history(spark)).collect()}
    assert (rows["CC-1"]["m_multi_channel"], rows["CC-1"]["m_internal"]) == (1, 1)
    for key in ("NO_HOMOLOGADO-1", "CC-"):
        assert (rows[key]["m_multi_channel"], rows[key]["m_internal"], rows[key]["n_filings"]) == (0, 0, 1)
    assert rows["CC-"]["m_empty_document"] == 1 and rows["NO_HOMOLOGADO-1"]["m_not_in_catalogue"] == 1


def test_history_decides_the_class_and_types_do_not_mix(spark):
    history = spark.createDataFrame([
        (1, "CC ", " 1", "Nueva EPS S.A. -CM"), (1, "CC", "1", "OTRA EPS"), (1, "CC", "2", " NUEVA EPS"),
        (1, "CC", "3", None), (1, "CC", "4", " "), (2, "CC", "5", "NUEVA EPS"), (1, "CC", None, "NUEVA EPS"),
        (1, "CC-6", "7", "NUEVA EPS"), (1, "CC", "8-9", "NUEVA EPS"), (1, "X" * 70, "1", "NUEVA EPS"),
    ], HISTORY)
    numbers = ["1", "2", "3", "4", "5", "6-7", "8-9"]
    u = filings(spark, *[(1, DESK, n, "CC", n, None) for n in numbers], (1, DESK, "n", "CC", None, None))
    got = {r["doc_number"]: r["classification"] for r in consolidate(u, history).collect()}
    assert got == {
        "1": "Reinscripción", "2": "Traslado", "3": "Afiliación Nueva", "4": "Afiliación Nueva", "5": "Afiliación Nueva",
        "6-7": "Afiliación Nueva", "8-9": "Reinscripción", None: "Afiliación Nueva",
    }


@pytest.mark.parametrize("length", [2, 62, 63, 64, 66, 200])
def test_history_matches_types_of_any_length(spark, length):
    kind = "T" * length
    shorter = "T" * (length - 2)
    history = spark.createDataFrame([
        (1, kind, "1", "NUEVA EPS"), (1, f"{kind}-2", "3", "NUEVA EPS"), (1, f"{shorter}-4", "5", "OTRA"),
    ], HISTORY)
    u = filings(spark, (1, DESK, "a", kind, "1", None), (1, DESK, "b", kind, "2-3", None), (1, DESK, "c", shorter, "4-5", None))
    got = {r["filing_id"]: r["classification"] for r in consolidate(u, history).collect()}
    assert got == {"a": "Reinscripción", "b": "Afiliación Nueva", "c": "Afiliación Nueva"}


def test_history_profile_flags(spark):
    history = spark.createDataFrame([
        (1, "CC ", " 1", "Nueva EPS S.A. -CM"), (1, "CC", "1", "OTRA EPS"), (1, "CC", "3", None),
    ], HISTORY)
    profile = {(r["doc_type"], r["doc_number"]): r for r in history_profile(history).filter("tenant = 1").collect()}
    assert (profile[("CC", "1")]["own_insurer"], profile[("CC", "1")]["other_insurer"], profile[("CC", "1")]["n_history"]) == (1, 1, 2)
    assert (profile[("CC", "3")]["own_insurer"], profile[("CC", "3")]["other_insurer"]) == (0, 0)


def test_table_keeps_a_date(spark):
    u = filings(spark, (1, WEB, "1", "CC", "1", datetime(2025, 1, 1, 23, 59)))
    assert str(as_table(consolidate(u, no_history(spark))).first()["filed_on"]) == "2025-01-01"


def test_reports_on_nothing(spark):
    u = filings(spark)
    table = as_table(consolidate(u, no_history(spark)))
    notices = spark.createDataFrame([], "tenant int, log string")
    lines = {r["indicator"]: (r["value"], r["percentage"]) for r in R.headline(table, u, notices).collect()}
    assert lines["Producción consolidada"] == (0, None) and lines["Registros críticos"] == (None, None)
    assert R.peak_month(table).count() == R.incomplete_last_month(table).count() == 0
    assert [r["kind"] for r in R.findings(consolidate_people(u, no_history(spark)), table).collect()] == ["effective"]


def test_scopes_and_literal_default_stays_apart(spark):
    u = filings(spark, (1, WEB, "1", "CC", "1", None), (1, WEB, "2", "CC", "2", None), (2, DESK, "3", "CC", "3", None))
    u = u.withColumn("status", F.when(F.col("filing_id") == "1", "SIN ESTADO"))
    table = as_table(consolidate(u, no_history(spark)))
    assert [r["n"] for r in R.by_status_by_channel(table, tenant=1).collect()] == [1, 1]
    assert R.by_territory(table, tenant=1, channel=DESK).count() == 0
    people, catalogue = consolidate_people(u, no_history(spark)), spark.createDataFrame(CATALOGUE, "a string, b int, c string")
    page = R.dashboard(table, people, u, {WEB: u}, catalogue, 1)
    alone = {
        "kpis": R.kpis_by_channel, "trend": R.trend_by_channel, "classification": R.by_classification_by_channel,
        "territory": R.by_territory_by_channel, "status": R.by_status_by_channel, "regime": R.by_regime_by_channel,
    }
    for name, report in alone.items():
        theirs = report(table, 1)
        assert page[name].columns == theirs.columns and sorted(page[name].collect()) == sorted(theirs.collect()), name
    assert [tuple(r) for r in page["quality"].collect()] == [(WEB, 2, 100.0, 100.0, 100.0, 0.0, 2, 0)]


def test_batch_report_prints(spark):
    u = filings(spark, *[(1, WEB, str(i), "CC", str(i), None) for i in range(1200)])
    notices = spark.createDataFrame([(1, None)], "tenant int, log string")
    people = as_table(consolidate_people(u, no_history(spark)))
    tables = R.batch_report(people, people, u, notices, 1)
    lines = {r["indicator"]: (r["value"], r["percentage"]) for r in R.printable(tables["Cifras principales"]).collect()}
    assert lines["Producción consolidada"] == ("1,200", "—") and lines["Registros críticos"] == ("1,200", "100.0")
    assert lines["Inconsistencia operativa IRL"] == ("—", "—") and len(tables) == 5


def test_upper_median_and_last_month(spark):
    rows = [("2025-01", 10), ("2025-02", 20), ("2025-03", 30), ("2025-04", 7)]
    months = spark.createDataFrame([(1, WEB, p) for p, n in rows for _ in range(n)], "tenant int, channel string, period string")
    got = R.incomplete_last_month(months).first()
    assert (got["period"], got["n"], got["upper_median"], got["is_incomplete"]) == ("2025-04", 7, 20, 0)
    peak = R.peak_month(months).first()
    assert (peak["period"], peak["n"], peak["excess_pct"], peak["label"]) == ("2025-03", 30, 79.0, "mar 2025")


def test_pareto_ties_share_the_cumulative_value(spark):
    counts = {"a": 4, "b": 2, "c": 2, "d": 2}
    rows = [(1, WEB, k) for k, n in counts.items() for _ in range(n)]
    table = spark.createDataFrame(rows, "tenant int, channel string, advisor string")
    assert [(r["advisor"], r["share"], r["cumulative"]) for r in R.advisor_pareto(table, top=2).collect()] == [
        ("a", 40.0, 40.0), ("b", 20.0, 100.0)
    ]


def test_measures_have_titles_and_no_division_error(spark):
    assert set(measures()) == set(MEASURE_TITLES)
    table = as_table(consolidate(filings(spark), no_history(spark)))
    assert table.agg(measures()["effective_share"].alias("x")).first()["x"] is None


@pytest.mark.parametrize("loose", [False, True])
def test_counters_of_people_equal_the_filings(spark, loose):
    rules = Rules(keep_null_keys=loose)
    u = filings(
        spark, (1, WEB, "1", "CC", "1", datetime(2025, 1, 1)), (1, WEB, "2", "CC", "1", None), (1, DESK, "3", "CC", "1", None),
        (1, DESK, "4", "CC", None, None), (1, DESK, "5", "NO_HOMOLOGADO", None, None), (1, DESK, "6", "CC", "", None),
        (2, DESK, "7", "CC", "1", None), (2, OFFICIAL, "8", "NO_HOMOLOGADO", "9", None),
    )
    people = consolidate_people(u, no_history(spark), rules)
    assert set(duplicity_of_people(people, rules).collect()) == set(duplicity_profile(u, rules).collect())
    told = {r["channel"]: tuple(r)[1:] for r in R.quality_by_source(people, rules=rules, unknown=True).collect()}
    # n, typed, numbered, placed, dated (percent), persons, repeats, unknown; CC-1 files at the desk of both tenants.
    assert told == {
        DESK: (5, 80.0, 40.0, 100.0, 0.0, 2, 3, 1), WEB: (2, 100.0, 100.0, 100.0, 50.0, 1, 1, 0), OFFICIAL: (1, 0.0, 100.0, 100.0, 0.0, 1, 0, 1),
    }
    one_tenant = {r["channel"]: (r["n"], r["n_persons"]) for r in R.quality_by_source(people, 1, rules).collect()}
    assert one_tenant == {DESK: (4, 2), WEB: (2, 1)}
    assert consolidate(u, no_history(spark), rules).columns == people.columns[:27]


def test_bitmaps_count_persons_at_every_level(spark):
    rows = spark.range(70_000).selectExpr(
        "IF(id % 7000 = 0, NULL, CAST(id % 50000 AS string)) AS person_key", "CAST(id % 2 AS int) AS tenant", "IF(id % 5 = 0, NULL, id % 3) AS month"
    )
    maps = person_bitmaps(rows, "tenant", "month")
    assert maps.count() > 8, "more than one bucket a group"
    keyed = rows.filter("person_key IS NOT NULL")
    want = {(2, *r[:2], r[2]) for r in keyed.groupBy("tenant", "month").agg(F.count_distinct("person_key")).collect()}
    want |= {(1, r[0], None, r[1]) for r in keyed.groupBy("tenant").agg(F.count_distinct("person_key")).collect()}
    want |= {(0, None, None, keyed.select("person_key").distinct().count())}
    assert {tuple(r) for r in persons_rollup(maps, "tenant", "month").collect()} == want
    by_month = {tuple(r) for r in keyed.groupBy("month").agg(F.count_distinct("person_key")).collect()}
    assert {tuple(r) for r in distinct_persons(maps, "month").collect()} == by_month
    nobody = person_bitmaps(rows.filter("false"), "tenant")
    assert [tuple(r) for r in persons_rollup(nobody, "tenant").collect()] == [(0, None, 0)]
