"""The six sources: file, separator, columns with their widths, and channel mappings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from monofila.operators.profiles import TALLIES, tally
from monofila.operators.universe import Channel
from monofila.rules import DESK, OFFICIAL, WEB, Rules

INTEGER = 0


@dataclass(frozen=True)
class Source:
    """``columns`` maps each business column to its greatest length, or INTEGER."""

    name: str
    file: str
    separator: str
    columns: dict[str, int]
    shared: bool = False

    def schema(self) -> T.StructType:
        fields = [T.StructField(c, T.IntegerType() if w == INTEGER else T.StringType()) for c, w in self.columns.items()]
        tenant = [] if self.shared else [T.StructField("tenant", T.IntegerType())]
        return T.StructType(tenant + fields)


# File names, separators, column names and widths of the inputs.
CATALOGUE = Source("catalogue", "HOMOLOGACION_DOCUMENTOS.csv", "|", {
    "Tipo_Documento_Afiliado": 100, "CODIGO": INTEGER, "Abreviatura": 5,
}, shared=True)

DESK_SOURCE = Source("desk", "AFILIACIONES.csv", "|", {
    "ID": INTEGER, "CODIGOASESOR": 20, "SOLICITUD": 50, "TIPODOCUMENTO": 5, "NUMERODOCUMENTO": 20,
    "DEPARTAMENTOID": 5, "MUNICIPIOID": 5, "CODIGOAFILIACION": 20, "NOMBREIPS": 200, "CANTBENEFICIARIO": 10,
    "TIPODOCUMENTOEMPLEADOR": 5, "NUMERODOCUMENTOEMPLEADOR": 20, "FECHARADICACION": 30, "REGIMEN": 50,
    "TIPOAFILIACION": 100, "SISBEN": 10, "POBLACIONESPECIAL": 500, "EXCEPCIONTRASLADO": 5, "CAUSALEXCEPCION": 255,
})

WEB_SOURCE = Source("web", "DIGITAL.csv", "|", {
    "IDPRODUCCION": INTEGER, "ESTADOAFILIACION": 50, "DESCRIPCIONESTADO": 100, "FECHASOLICITUD": 30,
    "FECHARADICACION": 30, "TIPOREGIMEN": 50, "CODIGOASESOR": 20, "TIPOAFILIACION": 100, "CONTRIBUSOLIDARIA": 5,
    "TIPOCOTIZANTE": 50, "INTERNOMEDICINA": 20, "CARGO": 50, "TIPOAFILIADO": 50, "PARENTESCO": 50,
    "TIPODOCUMENTOAFILIADO": 5, "NUM_AFILIADO": 20, "NOMBRE1": 100, "NOMBRE2": 100, "APELLIDO1": 100,
    "APELLIDO2": 100, "FECHANACIMIENTO": 30, "SEXO_IDENTIFICACION": 5, "NACIONALIDAD": 50, "PAISNACIMIENTO": 50,
    "DANE_NACIMIENTO": 15, "DEPARTAMENTONACIMIENTO": 100, "MUNICIPIONACIMIENTO": 100, "ZONA": 50,
    "DANE_RESIDENCIA": 15, "CODIGOIPS": 20, "COMUNIDADINDIGENA": 100, "ENCUESTASISBEN": 20, "NIVELSISBEN": 10,
    "SUBGRUPOSISBEN": 10, "TIPODOCUMENTOEMPLEADOR": 5, "NUMERODOCUMENTOEMPLEADOR": 20,
    "TARIFACONTRIBUCIONSOLIDARIA": 20, "METODOLOGIAGRUPOPOBLACIONAL": 100, "TIPOPOBLACIONESPECIAL": 20,
    "DISCAPACIDAD": 5, "TIPODECONDICION": 10, "FECHANOVEDAD": 30, "NOFORMULARIOVIRTUAL": 50, "RUTAARCHIVOS": 255,
    "CAUSALEXCEPCION": 50, "DESCRIPCIONCAUSALEXCEPCION": 255, "CERTIFICACION_GRUPO_FAMILIAR": 5,
    "SOPORTE_QUEJA_SUPER_SALUD": 5, "TRASLADO": 5, "VALOREPSANTERIOR": 100,
})

OFFICIAL_SOURCE = Source("official", "SAT.csv", "|", {
    "ID": INTEGER, "NORADICADOSAT": 100, "CODIGOASESOR": 20, "TIPODOCUMENTO": 5, "NUMERODOCUMENTOAFILIADO": 20,
    "SOLICITUD": 100, "FECHARADICACION": 30, "REGIMEN": 50, "TIPODOCUMENTOEMPLEADOR": 5,
    "NUMERODOCUMENTOEMPLEADOR": 20, "TIPOCOTIZANTE": 50, "CANTBENEFICIARIO": 10, "DEPARTAMENTOID": 5,
    "MUNICIPIOID": 5, "CODIGOAFILIACION": 20, "NOMBREIPS": 200, "CODIGOOCUPACION": 20, "NOMBREOCUPACION": 200,
})

NOTICES_SOURCE = Source("notices", "PROCESO_IRL.csv", "|", {
    "TIPO_DOC": 5, "NUMDOC": 20, "CARGO": 100, "TIPO_DOC_EMP": 5, "NUMEMP": 20, "FECHADEINGRESO": 30, "ASESOR": 50,
    "TIPO_DE_EMPLEADOR": 100, "TIPO_DE_RESPUESTA": 100, "N_ARCHIVO": 255, "F_RECIBIDO": 30, "F_PROCESO": 30,
    "ORIGEN": 100, "LOG_ERRORES": 255, "ID_TRAMITE": 50,
})

HISTORY_SOURCE = Source("history", "XML.csv", ";", {
    "IDENTIFICADOR": 50, "SERIAL": 50, "TIPO_IDENTIFICACION": 5, "NUMERO_IDENTIFICACION": 20, "PRIMER_NOMBRE": 100,
    "SEGUNDO_NOMBRE": 100, "PRIMER_APELLIDO": 100, "SEGUNDO_APELLIDO": 100, "NACIMIENTO_FECHA": 30, "DEPTO": 60,
    "MUNI": 80, "ESTADO": 50, "ENT_ID": 20, "ENTIDAD": 150, "REGIMEN": 50, "FECHA_CONTRATO": 60,
    "FECHA_FIN_CONTRATO": 30, "AFILIACION_ENTIDAD_FECHA": 30, "ESTADO_FECHA": 30, "TIPO_AFILIADO": 50,
    "FECHA_AFILIACION_EFECTIVA": 30, "cantidad_grp_fml": 10, "cruce_bdex_rnec": 20, "fecha_novedad": 30,
    "CANAL": 50, "ID_TRAMITE_RADICADO": 50, "FECHA_CONSULTA": 30,
})

SOURCES = (CATALOGUE, DESK_SOURCE, WEB_SOURCE, OFFICIAL_SOURCE, NOTICES_SOURCE, HISTORY_SOURCE)

# Where each channel file keeps the business fields.
DESK_CHANNEL = Channel(
    name=DESK, lookup="abbr", date_style="dmy", filing_id="ID", doc_type="TIPODOCUMENTO", doc_number="NUMERODOCUMENTO",
    filed=("FECHARADICACION",), regime="REGIMEN", dept="DEPARTAMENTOID", municipality="MUNICIPIOID",
    advisor="CODIGOASESOR", provider="NOMBREIPS", request_type="TIPOAFILIACION",
)
WEB_CHANNEL = Channel(
    name=WEB, lookup="abbr", date_style="iso", filing_id="IDPRODUCCION", doc_type="TIPODOCUMENTOAFILIADO",
    doc_number="NUM_AFILIADO", filed=("FECHARADICACION", "FECHASOLICITUD"), regime="TIPOREGIMEN",
    residence="DANE_RESIDENCIA", advisor="CODIGOASESOR", provider="CODIGOIPS", status="ESTADOAFILIACION",
    member_type="TIPOAFILIADO", request_type="TIPOAFILIACION",
)
OFFICIAL_CHANNEL = Channel(
    name=OFFICIAL, lookup="code", date_style="dmy", filing_id="ID", doc_type="TIPODOCUMENTO",
    doc_number="NUMERODOCUMENTOAFILIADO", filed=("FECHARADICACION",), regime="REGIMEN", dept="DEPARTAMENTOID",
    municipality="MUNICIPIOID", advisor="CODIGOASESOR", provider="NOMBREIPS", request_type="SOLICITUD",
)

# Headings of the consolidated table for downstream spreadsheets, in table order.
CONSOLIDATED_HEADINGS = {
    "tenant": "usuario_id", "person_key": "llave_afiliado", "channel": "canal_origen", "filing_id": "id_radicado",
    "doc_type": "tipo_documento_homologado", "doc_type_received": "tipo_documento_recibido",
    "doc_number": "numero_documento", "filed_on": "fecha_radicacion", "period": "periodo",
    "advisor": "codigo_asesor", "dept": "codigo_departamento", "municipality": "codigo_municipio",
    "provider": "nombre_ips", "member_type": "tipo_afiliado", "status": "estado_registro", "regime": "regimen",
    "classification": "clasificacion_tramite", "m_not_in_catalogue": "marca_no_homologado",
    "m_empty_document": "marca_documento_vacio", "m_incomplete_territory": "marca_territorio_incompleto",
    "m_invalid_date": "marca_fecha_invalida", "m_multi_channel": "marca_duplicado_multicanal",
    "m_internal": "marca_duplicado_interno", "m_critical": "marca_registro_critico",
    "is_effective": "es_produccion_efectiva", "n_channels": "canales_en_que_aparece", "n_filings": "veces_radicado",
}


def _consolidated_type(name: str) -> T.DataType:
    if name == "filed_on":
        return T.DateType()
    whole = name in ("tenant", "is_effective", "n_channels", "n_filings") or name.startswith("m_")
    return T.IntegerType() if whole else T.StringType()


CONSOLIDATED = T.StructType([T.StructField(c, _consolidated_type(c)) for c in CONSOLIDATED_HEADINGS])


def people(rules: Rules = Rules()) -> T.StructType:
    """The counters per person that are stored beside the consolidated row."""
    counters = [f"n_{c}" for c in rules.priority] + [tally(t, c) for c in rules.priority for t in TALLIES]
    keys = [T.StructField("tenant", T.IntegerType()), T.StructField("person_key", T.StringType())]
    return T.StructType(keys + [T.StructField(c, T.LongType()) for c in counters])
