"""The same questions in portable SQL, written without looking at the Spark plans."""

from __future__ import annotations

# Fixed values, written out once more: a wrong one in the library must not pass.
DEPARTMENT_LABELS = {
    "05": "Antioquia", "08": "Atlántico", "11": "Bogotá D.C.", "13": "Bolívar",
    "15": "Boyacá", "17": "Caldas", "18": "Caquetá", "19": "Cauca",
    "20": "Cesar", "23": "Córdoba", "25": "Cundinamarca", "27": "Chocó",
    "41": "Huila", "44": "La Guajira", "47": "Magdalena", "50": "Meta",
    "52": "Nariño", "54": "Norte de Santander", "63": "Quindío", "66": "Risaralda",
    "68": "Santander", "70": "Sucre", "73": "Tolima", "76": "Valle del Cauca",
    "81": "Arauca", "85": "Casanare", "86": "Putumayo", "88": "San Andrés",
    "91": "Amazonas", "94": "Guainía", "95": "Guaviare", "97": "Vaupés",
    "99": "Vichada",
}
MONTHS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")
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

_CATALOGUE = ", ".join(f"('{n}', {c}, '{a}')" for n, c, a in CATALOGUE)
EXPORTED = (
    "tenant", "person_key", "channel", "filing_id", "doc_type", "doc_type_received", "doc_number", "filed_on", "period", "advisor",
    "dept", "municipality", "provider", "member_type", "status", "regime", "classification", "m_not_in_catalogue",
    "m_empty_document", "m_incomplete_territory", "m_invalid_date", "m_multi_channel", "m_internal", "m_critical", "is_effective",
    "n_channels", "n_filings",
)


STAGING = f"""
catalog AS (SELECT * FROM (VALUES {_CATALOGUE}) AS c(name, code, abbr)),
base AS (SELECT o_orderkey k, o_orderpriority pr, o_orderstatus st, CASE WHEN o_orderkey % 8 < 4 THEN 0 ELSE 1 END tenant,
  (CASE o_custkey % 8 WHEN 0 THEN 'CE' WHEN 1 THEN 'TI' WHEN 2 THEN 'NI' WHEN 3 THEN 'PA' WHEN 4 THEN 'RC' ELSE 'CC' END) ty,
  CAST(o_custkey * 4 + o_orderkey % 4 AS VARCHAR) doc, strftime(o_orderdate, '%d/%m/%y') dmy,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') iso,
  CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE 'A' || CAST(100 + o_orderkey % 100 AS VARCHAR) END advisor,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE lpad(CAST(o_custkey % 25 AS VARCHAR), 2, '0') END dept,
  CASE o_custkey % 5 WHEN 0 THEN ' contributivo ' WHEN 1 THEN 'REGIMEN CONTRIBUTIVO' WHEN 2 THEN 'Subsidiado' WHEN 3 THEN NULL
    ELSE 'ESPECIAL' END regime FROM orders),
s_desk AS (SELECT tenant, k AS id, CASE WHEN k % 97 = 0 THEN 'PS' ELSE ' ' || ty || ' ' END doc_type,
  CASE WHEN k % 101 = 0 THEN NULL ELSE doc END doc_num, CASE WHEN k % 53 = 0 THEN '31/02/25' ELSE dmy END filed,
  regime, dept, '001' muni, advisor FROM base WHERE pr = '5-LOW'),
s_web AS (SELECT tenant, k AS id, CASE WHEN k % 89 = 0 THEN 'PS' ELSE ty END doc_type, doc || ' ' doc_num,
  CASE WHEN st = 'F' THEN iso END filed, CASE WHEN k % 61 = 0 THEN NULL ELSE iso END requested,
  CASE st WHEN 'F' THEN 'radicado ' WHEN 'O' THEN 'ANULADO' ELSE 'RECHAZADO' END status, regime, dept || '001' AS dane, advisor
  FROM base WHERE pr IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')),
s_official AS (SELECT tenant, k AS id, CASE WHEN k % 71 = 0 THEN '99' ELSE CAST(code AS VARCHAR) END doc_type, doc doc_num,
  dmy filed, regime, dept, '001' muni, advisor FROM base JOIN catalog ON abbr = ty WHERE pr = '1-URGENT'),
s_history AS (SELECT t.tenant, (CASE c_custkey % 8 WHEN 0 THEN 'CE' WHEN 1 THEN 'TI' WHEN 2 THEN 'NI' WHEN 3 THEN 'PA'
  WHEN 4 THEN 'RC' ELSE 'CC' END) doc_type, CAST(c_custkey * 4 + j.j AS VARCHAR) doc_num,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'NUEVA EPS S.A.' WHEN 'MACHINERY' THEN 'Nueva EPS S.A. -CM' WHEN 'FURNITURE' THEN NULL
    ELSE c_mktsegment || ' EPS' END entity
  FROM customer CROSS JOIN (VALUES (0), (1), (2)) AS j(j) CROSS JOIN (VALUES (0), (1)) AS t(tenant)
  WHERE t.tenant = 0 OR c_custkey % 2 = 0),
s_labour AS (SELECT CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END tenant, CASE event_type WHEN 'view' THEN 'CARGUE_EXITOSO'
  WHEN 'click' THEN 'CARGUE_EXITOSO ' WHEN 'signup' THEN NULL ELSE upper(event_type) END log FROM events)
"""

# One long table of raw filings, one lookup table for both ways of naming a type, and a
# single projection that cleans everything.
UNIVERSE = """
by_code AS (SELECT code, min(abbr) abbr, count(*) n_abbreviations FROM catalog WHERE code IS NOT NULL GROUP BY code),
lookup AS (SELECT 'abbr' AS by_what, abbr AS received, abbr FROM catalog
  UNION ALL SELECT 'code', CAST(code AS VARCHAR), abbr FROM by_code),
raw AS (
  SELECT 'AFILIACIONES' AS channel, 'abbr' AS by_what, try_strptime(trim(filed), '%d/%m/%y') AS filed_at, * EXCLUDE (filed) FROM s_desk
  UNION ALL BY NAME
  SELECT 'SAT' AS channel, 'code' AS by_what, try_strptime(trim(filed), '%d/%m/%y') AS filed_at, * EXCLUDE (filed) FROM s_official
  UNION ALL BY NAME
  SELECT 'DIGITAL' AS channel, 'abbr' AS by_what,
    ifnull(try_strptime(trim(filed), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(requested), '%Y-%m-%d %H:%M:%S')) AS filed_at,
    substr(trim(dane), 1, 2) AS dept, trim(dane) AS muni, * EXCLUDE (filed, requested, dane) FROM s_web),
named AS (SELECT r.*, ifnull(l.abbr, 'NO_HOMOLOGADO') AS known FROM raw r
  LEFT JOIN lookup l ON l.by_what = r.by_what AND l.received = trim(r.doc_type)),
universe AS (SELECT tenant, channel, id::VARCHAR AS filing_id, known AS doc_type, trim(doc_num) AS doc_number,
  known || '-' || trim(doc_num) AS person_key, doc_type AS doc_type_received, filed_at, upper(trim(regime)) AS regime,
  nullif(trim(dept), '') AS dept, nullif(trim(muni), '') AS municipality, nullif(trim(advisor), '') AS advisor,
  NULL::VARCHAR AS provider, upper(trim(status)) AS status, NULL::VARCHAR AS member_type, NULL::VARCHAR AS request_type FROM named)
"""

CONSOLIDATED = """
insurers AS (SELECT tenant, trim(doc_type) AS doc_type, trim(doc_num) AS doc_number, starts_with(upper(entity), 'NUEVA EPS') AS own,
  trim(entity) <> '' AS named FROM s_history WHERE trim(doc_num) <> ''),
history_profile AS (SELECT tenant, doc_type, doc_number, ifnull(bool_or(own), false)::INTEGER AS own_insurer,
  ifnull(bool_or(named AND NOT own), false)::INTEGER AS other_insurer, count(*) AS n_history FROM insurers GROUP BY ALL),
presence AS (SELECT tenant, person_key, channel, count(*) AS n FROM universe
  WHERE doc_type <> 'NO_HOMOLOGADO' AND doc_number <> '' GROUP BY ALL),
duplicity AS (SELECT tenant, person_key, count(*) AS n_channels, sum(n)::BIGINT AS n_filings, (sum(n) - count(*))::BIGINT AS n_repeats,
  bool_or(channel = 'SAT')::INTEGER AS in_sat, bool_or(channel = 'DIGITAL')::INTEGER AS in_digital,
  bool_or(channel = 'AFILIACIONES')::INTEGER AS in_afiliaciones FROM presence GROUP BY ALL),
kept AS (SELECT DISTINCT ON (tenant, person_key) * FROM universe
  ORDER BY tenant, person_key, list_position(['SAT', 'DIGITAL', 'AFILIACIONES'], channel), filed_at NULLS FIRST, filing_id),
checked AS (SELECT *, doc_type = 'NO_HOMOLOGADO' AS unknown, ifnull(doc_number, '') = '' AS nameless, filed_at IS NULL AS undated FROM kept),
consolidated AS (SELECT k.tenant, k.person_key, k.channel, k.filing_id, k.doc_type, k.doc_type_received, k.doc_number,
  k.filed_at::DATE AS filed_on, strftime(k.filed_at, '%Y-%m') AS period, k.advisor, k.dept, k.municipality, k.provider,
  k.member_type, k.status,
  CASE WHEN contains(k.regime, 'CONTRIBUTIVO') THEN 'CONTRIBUTIVO' WHEN contains(k.regime, 'SUBSIDIADO') THEN 'SUBSIDIADO'
    WHEN ifnull(k.regime, '') = '' THEN 'SIN DATO' ELSE 'OTRO' END AS regime,
  ifnull(['Afiliación Nueva', 'Traslado', 'Reinscripción'][1 + greatest(2 * h.own_insurer, h.other_insurer)], 'Afiliación Nueva') AS classification,
  unknown::INTEGER AS m_not_in_catalogue, nameless::INTEGER AS m_empty_document,
  (k.dept IS NULL OR k.municipality IS NULL)::INTEGER AS m_incomplete_territory, undated::INTEGER AS m_invalid_date,
  (ifnull(d.n_channels, 1) > 1)::INTEGER AS m_multi_channel, (ifnull(d.n_repeats, 0) > 0)::INTEGER AS m_internal,
  (unknown OR nameless OR undated)::INTEGER AS m_critical,
  (k.channel <> 'DIGITAL' OR ifnull(k.status, '') = 'RADICADO')::INTEGER AS is_effective,
  ifnull(d.n_channels, 1)::INTEGER AS n_channels, ifnull(d.n_filings, 1)::INTEGER AS n_filings
  FROM checked k LEFT JOIN history_profile h USING (tenant, doc_type, doc_number) LEFT JOIN duplicity d USING (tenant, person_key))
"""


def _pct(part: str, total: str) -> str:
    return f"CAST((20000 * CAST({part} AS BIGINT) + ({total})) // nullif(2 * ({total}), 0) AS DOUBLE) / 100"


def _pct1(part: str, total: str) -> str:
    return f"coalesce(CAST((2000 * CAST({part} AS BIGINT) + ({total})) // nullif(2 * ({total}), 0) AS DOUBLE) / 10, 0.0)"


def _staged(query: str) -> str:
    return f"WITH {STAGING} {query}"


def _on_universe(query: str) -> str:
    return f"WITH {STAGING}, {UNIVERSE} {query}"


def _on_consolidated(query: str) -> str:
    return f"WITH {STAGING}, {UNIVERSE}, {CONSOLIDATED} {query}"


def _sum(column: str) -> str:
    return f"CAST(sum({column}) AS BIGINT)"


def _share_report(table: str, dim: str, alias: str) -> str:
    return (
        f"SELECT {dim} AS {alias}, count(*) AS n, {_pct('count(*)', 'CAST(sum(count(*)) OVER () AS BIGINT)')} AS share "
        f"FROM {table} GROUP BY {dim}"
    )


def _headline(where: str) -> str:
    flags = [
        ("Producción efectiva (radicada)", "is_effective"), ("Duplicidad multicanal", "m_multi_channel"),
        ("Duplicidad interna (mismo canal)", "m_internal"), ("Documentos no homologados", "m_not_in_catalogue"),
        ("Territorio incompleto", "m_incomplete_territory"), ("Registros críticos", "m_critical"),
    ]
    lines = [
        f"SELECT 'Producción consolidada' AS indicator, count(*) AS value, CAST(NULL AS DOUBLE) AS percentage FROM consolidated {where}",
        f"SELECT 'Registros brutos', count(*), NULL FROM universe {where}",
        *[f"SELECT '{t}', {_sum(c)}, {_pct(f'sum({c})', 'count(*)')} FROM consolidated {where}" for t, c in flags],
        f"SELECT 'Novedades laborales', count(*), NULL FROM s_labour {where}",
        "SELECT 'Inconsistencia operativa IRL', "
        f"{_sum('CASE trim(log) <> ' + chr(39) + 'CARGUE_EXITOSO' + chr(39) + ' WHEN true THEN 1 WHEN false THEN 0 END')}, "
        + _pct("sum(CASE trim(log) <> 'CARGUE_EXITOSO' WHEN true THEN 1 WHEN false THEN 0 END)", "count(*)")
        + f" FROM s_labour {where}",
    ]
    return " UNION ALL ".join(lines)


_KPIS = (
    ("effective", "is_effective"), ("multi_channel", "m_multi_channel"), ("internal", "m_internal"),
    ("not_in_catalogue", "m_not_in_catalogue"), ("incomplete_territory", "m_incomplete_territory"),
    ("invalid_date", "m_invalid_date"), ("critical", "m_critical"),
)
_KPI_SUMS = "count(*) AS consolidated, " + ", ".join(f"{_sum(c)} AS {n}" for n, c in _KPIS)

_QUALITY = f"""quality AS (SELECT channel, count(*) AS n,
  {_pct("sum(CASE WHEN doc_type <> 'NO_HOMOLOGADO' THEN 1 ELSE 0 END)", "count(*)")} AS pct_homologated,
  {_pct("sum(CASE WHEN nullif(doc_number, '') IS NOT NULL THEN 1 ELSE 0 END)", "count(*)")} AS pct_document,
  {_pct("sum(CASE WHEN dept IS NOT NULL AND municipality IS NOT NULL THEN 1 ELSE 0 END)", "count(*)")} AS pct_territory,
  {_pct("sum(CASE WHEN filed_at IS NOT NULL THEN 1 ELSE 0 END)", "count(*)")} AS pct_date,
  count(DISTINCT person_key) AS n_persons, count(*) - count(DISTINCT person_key) AS n_repeats FROM universe GROUP BY channel)"""

_DEPARTMENTS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in DEPARTMENT_LABELS.items()) + "}"


def _department(column: str, blank: str) -> str:
    code = f"trim(coalesce({column}, ''))"
    return f"CASE WHEN {code} = '' THEN {blank} ELSE coalesce({_DEPARTMENTS}[left({code}, 2)], 'Código ' || {code}) END"


_CHANNEL = "CASE {c} WHEN 'DIGITAL' THEN 'Digital' WHEN 'AFILIACIONES' THEN 'Físico' ELSE {c} END"
_MONTH = "list_extract([" + ", ".join(f"'{m}'" for m in MONTHS) + "], CAST(right(period, 2) AS INTEGER)) || ' ' || left(period, 4)"


def _light(value: str, good: float, fair: float, higher: bool) -> str:
    op = ">=" if higher else "<="
    return f"CASE WHEN {value} {op} {good} THEN 'bien' WHEN {value} {op} {fair} THEN 'alerta' ELSE 'mal' END"


def _kpi_status() -> str:
    clean = "consolidated - not_in_catalogue - incomplete_territory"
    lights = [
        ("effective", "effective", 90, 80, True), ("multi_channel", "multi_channel", 1, 3, False),
        ("internal", "internal", 5, 8, False), ("data_quality", clean, 97, 92, True), ("critical", "critical", 1, 3, False),
    ]
    parts = []
    for name, part, good, fair, higher in lights:
        value = _pct1(f"({part})", "consolidated")
        parts.append(
            f"SELECT channel, '{name}' AS kpi, {part} AS n, {value} AS value, {_light(value, good, fair, higher)} AS status FROM k"
        )
    return f", k AS (SELECT coalesce(channel, 'TODOS') AS channel, {_KPI_SUMS} FROM consolidated GROUP BY ROLLUP (channel)) " + " UNION ALL ".join(parts)


def _quality_status() -> str:
    cells = (("homologated", "pct_homologated"), ("territory", "pct_territory"), ("date", "pct_date"))
    return f", {_QUALITY} " + " UNION ALL ".join(
        f"SELECT channel, '{n}' AS measure, {c} AS value, {_light(c, 95, 85, True)} AS status FROM quality" for n, c in cells
    )


_TOTALS = """totals AS (SELECT (SELECT count(*) FROM universe) AS received, count(*) AS total, CAST(sum(is_effective) AS BIGINT) AS effective,
  CAST(sum(m_internal) AS BIGINT) AS internal FROM consolidated)"""

_MONTHS_CTE = "months AS (SELECT period, count(*) AS n FROM consolidated WHERE period IS NOT NULL GROUP BY period)"

_PEAK = f"""peak AS (SELECT (SELECT period FROM months ORDER BY n DESC, period LIMIT 1) AS period, max(n) AS n, count(*) AS n_months,
  CAST(sum(n) AS DOUBLE) / count(*) AS monthly_mean,
  floor({_pct1("max(n) * count(*) - CAST(sum(n) AS BIGINT)", "CAST(sum(n) AS BIGINT)")} + 0.5) AS excess_pct FROM months)"""


def _funnel() -> str:
    steps = (("received", "received"), ("discarded", "received - total"), ("consolidated", "total"), ("effective", "effective"))
    return f", {_TOTALS} " + " UNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS step, {c} AS n, greatest({_pct1(f'({c})', 'received')}, 0.5) AS width FROM totals"
        for i, (n, c) in enumerate(steps, start=1)
    )


def _findings() -> str:
    effective, discarded = _pct1("effective", "total"), _pct1("(received - total)", "received")
    internal = _pct1("internal", "total")
    return f""", {_TOTALS}, {_MONTHS_CTE}, {_PEAK}, {_QUALITY},
    tops AS (SELECT channel, count(*) AS n FROM consolidated GROUP BY channel ORDER BY n DESC, channel LIMIT 1),
    worst AS (SELECT * FROM quality ORDER BY pct_territory, channel LIMIT 1)
    SELECT 1 AS position, 'effective' AS kind, CAST(NULL AS VARCHAR) AS subject, floor({effective} + 0.5) AS value, effective AS n,
      {_light(effective, 90, 80, True)} AS status FROM totals
    UNION ALL SELECT 2, 'top_channel', {_CHANNEL.format(c='channel')}, {_pct1("n", "(SELECT total FROM totals)")}, n, 'neutro' FROM tops
    UNION ALL SELECT 3, 'discarded', NULL, {discarded}, received - total, CASE WHEN {discarded} > 8 THEN 'alerta' ELSE 'neutro' END
      FROM totals WHERE received > total
    UNION ALL SELECT 4, 'internal', NULL, {internal}, internal, 'mal' FROM totals WHERE {internal} > 5
    UNION ALL SELECT 5, 'peak_month', {_MONTH}, excess_pct, n, 'neutro' FROM peak WHERE n_months > 1
    UNION ALL SELECT 6, 'worst_territory', {_CHANNEL.format(c='channel')}, pct_territory, n,
      CASE WHEN pct_territory < 92 THEN 'mal' ELSE 'alerta' END FROM worst WHERE pct_territory < 97
    UNION ALL SELECT 7, 'out_of_catalogue', NULL, CAST(NULL AS DOUBLE), n, 'alerta' FROM
      (SELECT count(*) AS n FROM universe WHERE doc_type = 'NO_HOMOLOGADO') WHERE n > 0"""


def _share(column: str) -> str:
    return f"CAST(sum({column}) AS DOUBLE) / nullif(count(*), 0)"


_MEASURES = {
    "filings": "count(*)",
    "effective": _sum("is_effective"),
    "effective_share": _share("is_effective"),
    "multi_channel": _sum("m_multi_channel"),
    "multi_channel_share": _share("m_multi_channel"),
    "internal": _sum("m_internal"),
    "internal_share": _share("m_internal"),
    "critical": _sum("m_critical"),
    "critical_share": _share("m_critical"),
    "homologation_share": "1 - " + _share("m_not_in_catalogue"),
    "territory_share": "1 - " + _share("m_incomplete_territory"),
}


def _measures(*names: str) -> str:
    return ", ".join(f"{_MEASURES[n]} AS {n}" for n in (names or _MEASURES))


_TREND_BY_CHANNEL = f"""SELECT period, channel, count(*) AS n, {_sum('is_effective')} AS effective,
  CAST(sum(CASE WHEN m_multi_channel + m_internal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS duplicated
  FROM consolidated WHERE period IS NOT NULL {{and_tenant}} GROUP BY period, channel"""


def _hash(seed: str, key: str) -> str:
    return f"CAST('0x' || left(md5('{seed}:' || CAST({key} AS VARCHAR)), 15) AS BIGINT)"


_WEIGHT = 93.5 + 2.4 + 2.1 + 1.9 + 0.1


def oracle_queries() -> dict[str, str]:
    flags = "tenant, person_key, m_not_in_catalogue, m_empty_document, m_incomplete_territory, m_invalid_date, m_critical"
    per_code = """, used AS (SELECT try_cast(trim(doc_type) AS INTEGER) AS code, count(*) AS n FROM s_official GROUP BY ALL)
      SELECT c.code, c.abbr, c.n_abbreviations, coalesce(u.n, 0) AS n_filings FROM by_code c LEFT JOIN used u ON c.code = u.code"""
    return {
        "q_universe": _on_universe("SELECT * REPLACE (strftime(filed_at, '%Y-%m-%d %H:%M:%S') AS filed_at) FROM universe"),
        "q_catalogue_by_code": _on_universe(per_code),
        "q_catalogue_collisions": _on_universe(per_code + " WHERE c.n_abbreviations > 1"),
        "q_homologation_hits": _staged(
            """SELECT channel, trim(r.doc_type) AS received, coalesce(h.abbr, 'NO_HOMOLOGADO') AS homologated, count(*) AS n
            FROM (SELECT 'AFILIACIONES' AS channel, doc_type FROM s_desk UNION ALL SELECT 'DIGITAL', doc_type FROM s_web) r
            LEFT JOIN catalog h ON trim(r.doc_type) = h.abbr GROUP BY ALL"""
        ),
        "q_homologation_code": _on_universe(
            """SELECT trim(s.doc_type) AS received, coalesce(h.abbr, 'NO_HOMOLOGADO') AS homologated, count(*) AS n
            FROM s_official s LEFT JOIN by_code h ON trim(s.doc_type) = CAST(h.code AS VARCHAR) GROUP BY ALL"""
        ),
        "q_history_profile": _on_consolidated("SELECT * FROM history_profile"),
        "q_duplicity_profile": _on_consolidated("SELECT * FROM duplicity"),
        "q_duplicity_of_people": _on_consolidated("SELECT * FROM duplicity"),
        "q_consolidated": _on_consolidated("SELECT * FROM consolidated"),
        "q_classification": _on_consolidated("SELECT tenant, person_key, classification FROM consolidated"),
        "q_quality_flags": _on_consolidated(f"SELECT {flags} FROM consolidated"),
        "q_duplicate_flags": _on_consolidated(
            "SELECT tenant, person_key, m_multi_channel, m_internal, n_channels, n_filings FROM consolidated"
        ),
        "q_effective": _on_consolidated("SELECT tenant, person_key, channel, status, is_effective FROM consolidated"),
        "q_headline": _on_consolidated(_headline("")),
        "q_headline_tenant": _on_consolidated(_headline("WHERE tenant = 1")),
        "q_tenant_totals": _on_consolidated(
            f"SELECT 1 AS tenant, count(*) AS filings, {_sum('is_effective')} AS effective, {_sum('m_critical')} AS critical "
            "FROM consolidated WHERE tenant = 1"
        ),
        "q_by_classification": _on_consolidated(_share_report("consolidated", "classification", "classification")),
        "q_source_contribution": _on_consolidated(
            f"""SELECT u.channel, u.n AS contributed, coalesce(c.n, 0) AS survived, u.n - coalesce(c.n, 0) AS discarded,
            {_pct("coalesce(c.n, 0)", "u.n")} AS pct_survives
            FROM (SELECT channel, count(*) AS n FROM universe GROUP BY channel) u
            LEFT JOIN (SELECT channel, count(*) AS n FROM consolidated GROUP BY channel) c ON u.channel = c.channel"""
        ),
        "q_by_regime": _on_consolidated(_share_report("consolidated", "regime", "regime")),
        "q_advisor_pareto": _on_consolidated(
            f""", t AS (SELECT coalesce(advisor, 'SIN ASESOR') AS advisor, count(*) AS n FROM consolidated GROUP BY ALL)
            SELECT advisor, n, {_pct("n", "CAST(sum(n) OVER () AS BIGINT)")} AS share,
            {_pct("sum(n) OVER (ORDER BY n DESC)", "CAST(sum(n) OVER () AS BIGINT)")} AS cumulative
            FROM t ORDER BY n DESC, advisor LIMIT 30"""
        ),
        "q_by_territory": _on_consolidated(_share_report("consolidated", "coalesce(dept, 'SIN DATO')", "dept")),
        "q_trend": _on_consolidated(
            """SELECT period, count(*) AS n, count(*) FILTER (classification = 'Afiliación Nueva') AS n_new,
            count(*) FILTER (classification = 'Traslado') AS n_transfer, count(*) FILTER (classification = 'Reinscripción') AS n_return
            FROM consolidated WHERE period IS NOT NULL GROUP BY period"""
        ),
        "q_quality_by_source": _on_universe(f", {_QUALITY} SELECT * FROM quality"),
        "q_quality_by_source_tenant": _on_universe(f", {_QUALITY.replace('FROM universe', 'FROM universe WHERE tenant = 1')} SELECT * FROM quality"),
        "q_distinct_persons": _on_universe(
            """, f AS (SELECT tenant, channel, strftime(filed_at, '%Y-%m') AS period, person_key FROM universe WHERE person_key IS NOT NULL)
            SELECT CAST(3 - grouping(tenant) - grouping(channel) - grouping(period) AS INTEGER) AS level, tenant, channel, period,
            count(DISTINCT person_key) AS n_persons FROM f GROUP BY ROLLUP (tenant, channel, period)"""
        ),
        "q_dashboard_panels": _on_consolidated(" UNION ALL ".join(
            f"SELECT '{panel}' AS panel, channel, {value} AS value, {_KPI_SUMS}, "
            f"CAST(sum((m_multi_channel + m_internal > 0)::INTEGER) AS BIGINT) AS duplicated FROM consolidated {where} GROUP BY ALL"
            for panel, value, where in (
                ("kpis", "CAST(NULL AS VARCHAR)", ""), ("trend", "period", "WHERE period IS NOT NULL"), ("classification", "classification", ""),
                ("territory", "dept", ""), ("status", "status", ""), ("regime", "regime", ""),
            )
        )),
        "q_out_of_catalogue": _on_universe(
            """SELECT channel, doc_type_received, count(*) AS n FROM universe WHERE doc_type = 'NO_HOMOLOGADO'
            GROUP BY ALL ORDER BY n DESC, channel, doc_type_received LIMIT 10"""
        ),
        "q_channel_combinations": _on_consolidated(
            """SELECT CASE WHEN in_afiliaciones = 1 AND in_digital = 1 AND in_sat = 1 THEN 'Físico + Digital + SAT'
            WHEN in_digital = 1 AND in_sat = 1 THEN 'Digital + SAT' WHEN in_afiliaciones = 1 AND in_sat = 1 THEN 'Físico + SAT'
            WHEN in_afiliaciones = 1 AND in_digital = 1 THEN 'Físico + Digital' ELSE 'Un solo canal' END AS combination,
            count(*) AS n FROM duplicity GROUP BY ALL"""
        ),
        "q_labour_inconsistency": _staged(
            f"""SELECT tenant, count(*) AS n, count(*) FILTER (trim(log) <> 'CARGUE_EXITOSO') AS failed,
            {_pct("count(*) FILTER (trim(log) <> 'CARGUE_EXITOSO')", "count(*)")} AS pct_failed FROM s_labour GROUP BY tenant"""
        ),
        "q_labour_reasons": _staged(_share_report("s_labour", "trim(log)", "outcome")),
        "q_kpis_by_channel": _on_consolidated(f"SELECT channel, {_KPI_SUMS} FROM consolidated WHERE tenant = 0 GROUP BY channel"),
        "q_kpis_rollup": _on_consolidated(
            f"""SELECT coalesce(channel, 'TODOS') AS channel, CAST(grouping(channel) AS INTEGER) AS is_total, {_KPI_SUMS}
            FROM consolidated GROUP BY ROLLUP (channel)"""
        ),
        "q_source_counts": _staged(
            " UNION ALL ".join(
                f"SELECT '{n}' AS source, count(*) AS n FROM {t} WHERE tenant = 0"
                for n, t in (
                    ("AFILIACIONES", "s_desk"), ("DIGITAL", "s_web"), ("SAT", "s_official"),
                    ("XML_HISTORICO", "s_history"), ("PROCESO_IRL", "s_labour"),
                )
            )
            + " UNION ALL SELECT 'HOMOLOGACION_DOCUMENTOS', count(*) FROM catalog"
        ),
        "q_trend_by_channel": _on_consolidated(_TREND_BY_CHANNEL.format(and_tenant="AND tenant = 0")),
        "q_by_status": _on_consolidated(
            "SELECT channel, coalesce(status, 'SIN ESTADO') AS status, count(*) AS n FROM consolidated GROUP BY channel, consolidated.status"
        ),
        "q_by_classification_by_channel": _on_consolidated(
            "SELECT channel, classification, count(*) AS n FROM consolidated WHERE tenant = 0 GROUP BY ALL"
        ),
        "q_by_regime_by_channel": _on_consolidated(
            "SELECT channel, regime, count(*) AS n FROM consolidated WHERE tenant = 0 GROUP BY ALL"
        ),
        "q_by_territory_by_channel": _on_consolidated(
            f"""SELECT channel, dept, {_department("dept", "'Sin dato'")} AS department, count(*) AS n
            FROM consolidated WHERE tenant = 0 GROUP BY ALL"""
        ),
        "q_territory_labels": _on_consolidated(
            f"""SELECT {_department("dept", "'Sin dato'")} AS department, count(*) AS n FROM consolidated GROUP BY ALL"""
        ),
        "q_territory_labels_of_channel": _on_consolidated(
            f"""SELECT {_department("dept", "'Sin dato'")} AS department, count(*) AS n FROM consolidated
            WHERE channel = 'DIGITAL' GROUP BY ALL"""
        ),
        "q_top_territories": _on_consolidated(
            f"""SELECT {_department("dept", "'Sin dato'")} AS department, count(*) AS n FROM consolidated
            GROUP BY ALL ORDER BY n DESC, department LIMIT 10"""
        ),
        "q_kpi_status": _on_consolidated(_kpi_status()),
        "q_quality_status": _on_universe(_quality_status()),
        "q_funnel": _on_consolidated(_funnel()),
        "q_findings": _on_consolidated(_findings()),
        "q_peak_month": _on_consolidated(f", {_MONTHS_CTE}, {_PEAK} SELECT *, {_MONTH} AS label FROM peak"),
        "q_incomplete_last_month": _on_consolidated(
            f""", {_MONTHS_CTE}, s AS (SELECT list(n ORDER BY n) AS ns, count(*) AS n_months, max(period) AS period FROM months),
            w AS (SELECT s.period, m.n, s.n_months, s.ns[s.n_months // 2 + 1] AS upper_median FROM s JOIN months m ON m.period = s.period)
            SELECT *, CASE WHEN n_months > 2 AND n < upper_median * 0.25 THEN 1 ELSE 0 END AS is_incomplete FROM w"""
        ),
        "q_measures_by_channel": _on_consolidated(f"SELECT channel, {_measures()} FROM consolidated GROUP BY channel"),
        "q_measures_by_classification": _on_consolidated(
            f"SELECT classification, {_measures('filings', 'effective_share')} FROM consolidated GROUP BY classification"
        ),
        "q_measures_sliced": _on_consolidated(
            f"SELECT classification, {_measures('filings', 'effective_share')} FROM consolidated WHERE regime = 'SUBSIDIADO' GROUP BY classification"
        ),
        "q_measures_by_department": _on_consolidated(
            f"SELECT {_department('dept', 'NULL')} AS department, {_measures('filings', 'territory_share')} FROM consolidated GROUP BY ALL"
        ),
        "q_pivot_period_channel": _on_consolidated(
            "SELECT period, "
            + ", ".join(f"nullif(count(*) FILTER (channel = '{c}'), 0) AS \"{c}\"" for c in ("SAT", "DIGITAL", "AFILIACIONES"))
            + " FROM consolidated GROUP BY period"
        ),
        "q_report_table": _on_consolidated(
            f"""SELECT {_CHANNEL.format(c='channel')} AS "Canal", period AS "Periodo",
            CAST(filed_on - DATE '1899-12-30' AS INTEGER) AS "Fecha radicación", {_department("dept", "NULL")} AS "Departamento",
            regime AS "Régimen", status AS "Estado", classification AS "Clasificación", doc_type AS "Tipo de documento",
            is_effective AS "Efectiva", m_multi_channel AS "Duplicado multicanal", m_internal AS "Duplicado interno",
            m_not_in_catalogue AS "No homologado", m_incomplete_territory AS "Territorio incompleto",
            m_invalid_date AS "Fecha inválida", m_critical AS "Registro crítico" FROM consolidated"""
        ),
        "q_load_blank_to_null": _staged(" UNION ALL BY NAME ".join(
            f"SELECT '{channel}' AS channel, tenant, id, " + ", ".join(f"nullif(trim({c}), '') AS {c}" for c in columns) + f" FROM {table}"
            for channel, table, columns in (
                ("AFILIACIONES", "s_desk", ("doc_type", "doc_num", "filed", "regime", "dept", "muni", "advisor")),
                ("DIGITAL", "s_web", ("doc_type", "doc_num", "filed", "requested", "status", "regime", "dane", "advisor")),
                ("SAT", "s_official", ("doc_type", "doc_num", "filed", "regime", "dept", "muni", "advisor")),
            )
        )),
        "q_width_violations": _staged(" UNION ALL ".join(
            f"SELECT tenant, '{channel}' AS channel, id AS filing, '{c}' AS \"column\", 'too_long' AS problem, "
            f"CAST(length(repeat({c}, 1 + id % 4)) AS INTEGER) AS length, left(repeat({c}, 1 + id % 4), 60) AS value "
            f"FROM {table} WHERE length(repeat({c}, 1 + id % 4)) > {width}"
            for channel, table in (("AFILIACIONES", "s_desk"), ("DIGITAL", "s_web"), ("SAT", "s_official"))
            for c, width in (("doc_type", 5), ("doc_num", 20), ("filed", 30), ("regime", 50), ("advisor", 20))
        )),
        "q_load_rows": _staged(" UNION ALL BY NAME ".join(
            f"SELECT tenant, '{channel}' AS channel, CAST(id AS VARCHAR) AS id, "
            + ", ".join(f"nullif(trim({c}), '') AS {c}" for c in columns) + f" FROM {table} WHERE id % 3 <> 0 OR id % 37 <> 0"
            for channel, table, columns in (
                ("AFILIACIONES", "s_desk", ("doc_type", "doc_num", "filed", "regime", "advisor", "dept", "muni")),
                ("DIGITAL", "s_web", ("doc_type", "doc_num", "filed", "regime", "advisor", "requested", "status", "dane")),
                ("SAT", "s_official", ("doc_type", "doc_num", "filed", "regime", "advisor", "dept", "muni")),
            )
        )),
        "q_load_report": _staged(" UNION ALL ".join(
            f"SELECT tenant, '{file}' AS file, 'loaded' AS state, count(*) FILTER (id % 3 <> 0 OR id % 37 <> 0) AS \"rows\", "
            f"count(*) FILTER (id % 3 = 0 AND id % 37 = 0) AS discarded, 'EXTRA' AS ignored FROM {table} GROUP BY tenant"
            for file, table in (("AFILIACIONES.csv", "s_desk"), ("DIGITAL.csv", "s_web"), ("SAT.csv", "s_official"))
        )),
        "q_load_rest": _staged("""SELECT NULL::INTEGER AS tenant, 'catalogue' AS source, concat_ws('|', abbr, code, name) AS row, count(*) AS n FROM catalog GROUP BY ALL
            UNION ALL SELECT tenant, 'history', concat_ws('|', nullif(trim(doc_type), ''), nullif(trim(doc_num), ''), nullif(trim(entity), '')), count(*) FROM s_history GROUP BY ALL
            UNION ALL SELECT tenant, 'notices', concat_ws('|', nullif(trim(log), ''), log || ' · Ñandú'), count(*) FROM s_labour GROUP BY ALL"""),
        "q_load_quarantine": _staged("""SELECT tenant, CAST(id AS VARCHAR) AS filing, CASE WHEN id % 11 <> 0 THEN CAST(id AS INTEGER) END AS id,
            CASE WHEN len(found) > 0 THEN 'refused' ELSE 'accepted' END AS verdict, array_to_string(found, ', ') AS problems
            FROM (SELECT tenant, id, list_filter([
              CASE WHEN id % 11 = 0 THEN 'ID:not_integer:' || (1 + length(CAST(id AS VARCHAR))) || ':x' || id END,
              CASE WHEN 4 * (1 + id % 8) > 20 AND advisor IS NOT NULL THEN 'CODIGOASESOR:too_long:' || 4 * (1 + id % 8) || ':' || repeat(advisor, CAST(1 + id % 8 AS BIGINT)) END
            ], lambda x: x IS NOT NULL) AS found FROM s_desk)"""),
        "q_load_total": _staged("""SELECT 12::BIGINT AS sources, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(short) AS BIGINT) AS discarded FROM (
            SELECT count(*) FILTER (id % 3 <> 0 OR id % 37 <> 0) AS n, count(*) FILTER (id % 3 = 0 AND id % 37 = 0) AS short
              FROM (SELECT id FROM s_desk UNION ALL SELECT id FROM s_web UNION ALL SELECT id FROM s_official)
            UNION ALL SELECT count(*), 0 FROM s_history UNION ALL SELECT count(*), 0 FROM s_labour UNION ALL SELECT 2 * count(*), 0 FROM catalog)"""),
        "q_oversized_files": "SELECT url || '.csv' AS file, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages WHERE octet_length(encode(html)) > 2000",
        "q_tenant_backfill": "SELECT c_custkey, c_mktsegment, 0 AS tenant FROM customer",
        "q_has_data": _on_consolidated(
            "SELECT t.tenant, EXISTS (SELECT 1 FROM consolidated c WHERE c.tenant = t.tenant) AS has_data FROM (VALUES (0), (1), (99)) AS t(tenant)"
        ),
        "q_printed_figures": _on_consolidated(
            "SELECT coalesce(channel, 'TODOS') AS channel, CAST(grouping(channel) AS VARCHAR) AS is_total, format('{:,}', count(*)) AS consolidated, "
            + ", ".join(f"format('{{:,}}', {_sum(c)}) AS {n}" for n, c in _KPIS) + " FROM consolidated GROUP BY ROLLUP (channel)"
        ),
        "q_export_round_trip": _on_consolidated(
            "SELECT " + ", ".join(f"nullif(CAST({c} AS VARCHAR), '') AS {c}" for c in EXPORTED) + " FROM consolidated"
        ),
        "q_input_completeness": """WITH received AS (SELECT DISTINCT CASE WHEN o_orderkey % 8 < 4 THEN 0 ELSE 1 END AS tenant,
            CASE o_orderpriority WHEN '5-LOW' THEN 'AFILIACIONES.csv' WHEN '2-HIGH' THEN 'DIGITAL.csv' WHEN '1-URGENT' THEN 'SAT.csv'
            ELSE o_orderpriority || '.csv' END AS file FROM orders),
            expected AS (SELECT tenant, unnest(['HOMOLOGACION_DOCUMENTOS.csv', 'AFILIACIONES.csv', 'DIGITAL.csv', 'SAT.csv',
            'PROCESO_IRL.csv', 'XML.csv']) AS file FROM (SELECT DISTINCT tenant FROM received))
            SELECT *, 'missing' AS problem FROM (SELECT * FROM expected EXCEPT SELECT * FROM received)
            UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM received EXCEPT SELECT * FROM expected)""",
        "q_cohort_split": f"""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY {_hash('cohorts', 'c_custkey')}, c_custkey) - 1 AS place,
            count(*) OVER () AS n FROM customer),
            c AS (SELECT *, CAST(floor(n * CAST(0.065 AS DOUBLE)) AS BIGINT) AS a FROM r)
            SELECT c_custkey, CASE WHEN place < a THEN 'none' WHEN place < a + CAST(floor((n - a) * CAST(0.73 AS DOUBLE)) AS BIGINT)
            THEN 'own' ELSE 'other' END AS cohort FROM c""",
        "q_weighted_draw": f"""WITH u AS (SELECT o_orderkey, {_hash('status', 'o_orderkey')} / CAST(1152921504606846976 AS DOUBLE) AS u FROM orders)
            SELECT o_orderkey, CASE WHEN u < {93.5 / _WEIGHT}::DOUBLE THEN 'RADICADO' WHEN u < {(93.5 + 2.4) / _WEIGHT}::DOUBLE THEN 'ANULADO'
            WHEN u < {(93.5 + 2.4 + 2.1) / _WEIGHT}::DOUBLE THEN 'SIN-PRERADICAR' WHEN u < {(93.5 + 2.4 + 2.1 + 1.9) / _WEIGHT}::DOUBLE
            THEN 'RECHAZADO' ELSE 'DEVOLUCIÓN' END AS status FROM u""",
        "q_duplicate_injection": f"""WITH f AS (SELECT o_orderkey AS id, o_custkey AS person, o_orderpriority AS channel,
            row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_hash('inject', 'o_orderkey')}, o_orderkey) - 1 AS place,
            count(*) OVER (PARTITION BY o_orderpriority) AS n, {_hash('inject-donor', 'o_orderkey')} AS draw FROM orders),
            k AS (SELECT *, CASE WHEN place < floor(n * CAST(0.012 AS DOUBLE)) THEN 'multi'
              WHEN place < floor(n * CAST(0.012 AS DOUBLE)) + floor(n * CAST(0.06 AS DOUBLE)) THEN 'internal' END AS injected FROM f),
            s AS (SELECT own.channel AS own, o.channel AS other, o.n,
              sum(o.n) OVER (PARTITION BY own.channel ORDER BY o.channel) - o.n AS start, sum(o.n) OVER (PARTITION BY own.channel) AS pool
              FROM (SELECT DISTINCT channel FROM f) own JOIN (SELECT DISTINCT channel, n FROM f) o ON o.channel <> own.channel),
            d AS (SELECT k.id, s.other AS source, k.draw % s.pool - s.start AS at FROM k JOIN s ON s.own = k.channel
              AND k.draw % s.pool >= s.start AND k.draw % s.pool < s.start + s.n WHERE k.injected = 'multi'
              UNION ALL SELECT id, channel, draw % n FROM k WHERE injected = 'internal')
            SELECT k.id, coalesce(p.person, k.person) AS person, k.channel, k.injected FROM k LEFT JOIN d ON d.id = k.id
            LEFT JOIN f p ON p.channel = d.source AND p.place = d.at""",
        "q_rate_limit": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
            walk AS (SELECT event_id, user_id, i, 1 AS accepted, [us] AS recent FROM e WHERE i = 1
            UNION ALL SELECT e.event_id, e.user_id, e.i,
              CASE WHEN len(list_filter(w.recent, lambda a: e.us - a < 86400000000)) < 3 THEN 1 ELSE 0 END,
              CASE WHEN len(list_filter(w.recent, lambda a: e.us - a < 86400000000)) < 3
                THEN list_append(list_filter(w.recent, lambda a: e.us - a < 86400000000), e.us) ELSE w.recent END
            FROM walk w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
            SELECT event_id, user_id, accepted FROM walk""",
        "q_lockouts": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type = 'error' AS failed,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
            walk AS (SELECT event_id, user_id, i, CASE WHEN failed THEN 'fail' ELSE 'ok' END AS outcome,
              CASE WHEN failed THEN 1 ELSE 0 END AS streak, CAST(0 AS BIGINT) AS until FROM e WHERE i = 1
            UNION ALL SELECT e.event_id, e.user_id, e.i,
              CASE WHEN w.until > e.us THEN 'refused' WHEN NOT e.failed THEN 'ok' WHEN w.streak + 1 >= 3 THEN 'lock' ELSE 'fail' END,
              CASE WHEN w.until > e.us THEN w.streak WHEN NOT e.failed OR w.streak + 1 >= 3 THEN 0 ELSE w.streak + 1 END,
              CASE WHEN w.until <= e.us AND e.failed AND w.streak + 1 >= 3 THEN e.us + 86400000000 ELSE w.until END
            FROM walk w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
            SELECT event_id, user_id, outcome FROM walk""",
        "q_failure_streaks": """WITH e AS (SELECT *, event_type = 'error' AS failed,
            sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
            SELECT user_id, CAST(island AS BIGINT) AS n_successes_before, count(*) AS n_failures,
            arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id, CAST(min(ts) AS DATE) AS first_on
            FROM e WHERE failed GROUP BY user_id, island""",
        "q_retention": """SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day FROM events
            WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 15 DAY""",
        "q_report_json": _on_consolidated(
            "SELECT '{\"period\":\"' || period || '\",\"channel\":\"' || channel || '\",\"n\":' || n || ',\"effective\":' || effective "
            "|| ',\"duplicated\":' || duplicated || '}' AS payload FROM (" + _TREND_BY_CHANNEL.format(and_tenant="") + ")"
        ),
    }
