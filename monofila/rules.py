"""Business rules as data: every operator takes them as an argument."""

from __future__ import annotations

from dataclasses import dataclass

# Channel codes, class names and markers that appear in the results.
DESK = "AFILIACIONES"
WEB = "DIGITAL"
OFFICIAL = "SAT"
UNKNOWN_TYPE = "NO_HOMOLOGADO"
CLASS_RETURN = "Reinscripción"
CLASS_TRANSFER = "Traslado"
CLASS_NEW = "Afiliación Nueva"

# What people read instead of a channel code.
CHANNEL_LABELS = {"DIGITAL": "Digital", "AFILIACIONES": "Físico", "SAT": "SAT"}

# Department names by two-digit national code.
DEPARTMENT_LABELS = {
    "05": "Antioquia", "08": "Atlántico", "11": "Bogotá D.C.", "13": "Bolívar",
    "15": "Boyacá", "17": "Caldas", "18": "Caquetá", "19": "Cauca", "20": "Cesar",
    "23": "Córdoba", "25": "Cundinamarca", "27": "Chocó", "41": "Huila",
    "44": "La Guajira", "47": "Magdalena", "50": "Meta", "52": "Nariño",
    "54": "Norte de Santander", "63": "Quindío", "66": "Risaralda", "68": "Santander",
    "70": "Sucre", "73": "Tolima", "76": "Valle del Cauca", "81": "Arauca",
    "85": "Casanare", "86": "Putumayo", "88": "San Andrés", "91": "Amazonas",
    "94": "Guainía", "95": "Guaviare", "97": "Vaupés", "99": "Vichada",
}

# Short month names used in trend labels.
MONTHS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")

# Lines of the batch report, as (label, figure, total that it is a share of).
HEADLINE = (
    ("Producción consolidada", "n", None),
    ("Registros brutos", "n_raw", None),
    ("Producción efectiva (radicada)", "is_effective", "n"),
    ("Duplicidad multicanal", "m_multi_channel", "n"),
    ("Duplicidad interna (mismo canal)", "m_internal", "n"),
    ("Documentos no homologados", "m_not_in_catalogue", "n"),
    ("Territorio incompleto", "m_incomplete_territory", "n"),
    ("Registros críticos", "m_critical", "n"),
    ("Novedades laborales", "n_notices", None),
    ("Inconsistencia operativa IRL", "n_failed", "n_notices"),
)

# Channels that a person used together.
COMBINATIONS = {
    (DESK, WEB, OFFICIAL): "Físico + Digital + SAT",
    (WEB, OFFICIAL): "Digital + SAT",
    (DESK, OFFICIAL): "Físico + SAT",
    (DESK, WEB): "Físico + Digital",
}
ONE_CHANNEL = "Un solo canal"

# Headings of the workbook's table, in order.
WORKBOOK_HEADINGS = (
    "Canal", "Periodo", "Fecha radicación", "Departamento", "Régimen", "Estado", "Clasificación", "Tipo de documento", "Efectiva",
    "Duplicado multicanal", "Duplicado interno", "No homologado", "Territorio incompleto", "Fecha inválida", "Registro crítico",
)

# Titles of the tables that a batch run ends with.
BATCH_TITLES = (
    "Cifras principales", "Clasificación del trámite", "Aporte y depuración por fuente", "Calidad por fuente (%)",
    "Tipos de documento fuera de catálogo",
)


@dataclass(frozen=True)
class Rules:
    """What a deployment may change without touching the operators.

    ``priority`` lists the channels from most to least authoritative; the set is
    closed, so the presence of a person in each one is a fixed-width counter and
    distinct channels never need a distinct aggregate.
    """

    priority: tuple[str, ...] = (OFFICIAL, WEB, DESK)
    status_channel: str = WEB
    effective_status: str = "RADICADO"
    own_insurer_prefix: str = "NUEVA EPS"
    notice_success: str = "CARGUE_EXITOSO"
    unknown_type: str = UNKNOWN_TYPE
    # One survivor per tenant stands for all filings without a document number.
    # True keeps every such filing instead.
    keep_null_keys: bool = False
