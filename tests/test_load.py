"""Files on disk: binding, quirks, tenant isolation, sinks."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from monofila import schemas as S
from monofila.plans import refresh as R
from monofila.plans import reports
from monofila.sources import delimited as D
from monofila.sources import storage

CATALOGUE = "Tipo_Documento_Afiliado|CODIGO|Abreviatura\nCédula|3|CC\nNIT|4|NI\nNIT|4|NT\nTarjeta|15|TI\n"
DESK = (
    "ID|TIPODOCUMENTO|NUMERODOCUMENTO|FECHARADICACION|REGIMEN|DEPARTAMENTOID|MUNICIPIOID|EXTRA|NOMBREIPS\n"
    "1| CC |100|05/03/25|Contributivo|05|001|x|Clínica Ñ\n"
    "2|CC|100\n"
    "\n"
    "3|PS||31/02/25||05||x|y|more\n"
    '4|CC|"200"|05/03/95|ESPECIAL|08|001|"a|b"|"dos\nlíneas"\n'
    "9|TI|300|05/03/25|x|11|001|e|f\n"
    "10|TI|300|05/03/25|x|11|001|e|f\n"
    "11|TI|400|05/03/2025|x|11|001|e|\n"
)
WEB = (
    "IDPRODUCCION|ESTADOAFILIACION|FECHASOLICITUD|FECHARADICACION|TIPODOCUMENTOAFILIADO|NUM_AFILIADO|DANE_RESIDENCIA|TIPOREGIMEN\n"
    "1|radicado|2025-01-02 03:04:05|2025-02-03 04:05:06|CC|100|05001|Subsidiado\n"
    "2|Anulado|2025-01-02 03:04:05||CC|500|76001|Subsidiado\n"
)
OFFICIAL = (
    "ID|TIPODOCUMENTO|NUMERODOCUMENTOAFILIADO|FECHARADICACION|REGIMEN|DEPARTAMENTOID|MUNICIPIOID\n"
    "1|4|900|01/01/25|x|05|001\n2|03|100|01/01/25|x|05|001\n"
)
NOTICES = "LOG_ERRORES|TIPO_DOC\nCARGUE_EXITOSO|CC\n|CC\nBENEFICIARIO|CC\n"
HISTORY = (
    "TIPO_IDENTIFICACION;NUMERO_IDENTIFICACION;ENTIDAD\nCC;100;Nueva EPS S.A. -CM\nCC;100;OTRA\nCC;200; NUEVA EPS\nTI;300;\n"
)


@pytest.fixture(scope="module")
def folders():
    source, warehouse = tempfile.mkdtemp(prefix="monofila-in-"), tempfile.mkdtemp(prefix="monofila-wh-")
    texts = dict(zip([s.file for s in S.SOURCES], [CATALOGUE, DESK, WEB, OFFICIAL, NOTICES, HISTORY]))
    for name, text in texts.items():
        with open(f"{source}/{name}", "w", encoding="latin-1", newline="") as f:
            f.write(text)
    return source, warehouse


@pytest.fixture(scope="module")
def loaded(spark, folders):
    report, rows = R.refresh(spark, *folders, tenant=7)
    R.refresh(spark, *folders, tenant=8)
    return {r["file"]: r for r in report.collect()}, rows


def test_report_counts_short_and_blank_rows_but_keeps_long_ones(loaded):
    desk = loaded[0]["AFILIACIONES.csv"]
    assert (desk["state"], desk["rows"], desk["discarded"], desk["ignored"]) == ("loaded", 6, 2, ["EXTRA"])
    assert desk["encoding"] == "ISO-8859-1"
    assert loaded[0]["XML.csv"]["rows"] == 4


def test_values_are_stripped_bound_by_name_and_blank_is_null(spark, folders, loaded):
    rows = {r["ID"]: r for r in R.Staging(spark, folders[1], 7).source(S.DESK_SOURCE).collect()}
    assert rows[1]["TIPODOCUMENTO"] == "CC" and rows[1]["NOMBREIPS"] == "Clínica Ñ"
    assert rows[3]["NUMERODOCUMENTO"] is None and rows[3]["MUNICIPIOID"] is None and rows[3]["SISBEN"] is None
    assert rows[4]["NOMBREIPS"] == "dos\nlíneas"


def test_consolidated_rows(spark, folders, loaded):
    table = R.consolidated(spark, folders[1]).filter("tenant = 7")
    rows = {r["person_key"]: r for r in table.collect()}
    assert loaded[1] == len(rows) == table.count() == 8

    both = rows["CC-100"]
    assert (both["channel"], both["filing_id"], both["classification"]) == ("DIGITAL", "1", "Reinscripción")
    assert (both["m_multi_channel"], both["m_internal"], both["n_channels"], both["n_filings"]) == (1, 0, 2, 2)
    assert (both["dept"], both["municipality"], str(both["filed_on"]), both["is_effective"]) == ("05", "05001", "2025-02-03", 1)
    assert rows["CC-200"]["classification"] == "Reinscripción" and str(rows["CC-200"]["filed_on"]) == "1995-03-05"
    assert rows["CC-200"]["regime"] == "OTRO"
    assert rows["TI-300"]["filing_id"] == "10" and rows["TI-300"]["classification"] == "Afiliación Nueva"
    assert (rows["TI-300"]["m_internal"], rows["TI-300"]["n_filings"]) == (1, 2)
    assert rows["TI-400"]["m_invalid_date"] == 1
    assert (rows["CC-500"]["is_effective"], rows["CC-500"]["period"]) == (0, "2025-01")
    assert rows["NI-900"]["doc_type"] == "NI"
    assert rows["NO_HOMOLOGADO-100"]["m_not_in_catalogue"] == 1


def test_null_keys_collapse_to_one_row_per_tenant(spark, folders, loaded):
    # The filing without a number (id 3) would be the eighth key were it not NULL.
    table = R.consolidated(spark, folders[1])
    nulls = table.filter("person_key IS NULL").groupBy("tenant").count().collect()
    assert {r["tenant"]: r["count"] for r in nulls} == {7: 1, 8: 1}


def test_tenants_do_not_touch_each_other(spark, folders, loaded):
    before = R.consolidated(spark, folders[1]).filter("tenant = 7").count()
    empty = R.consolidated(spark, folders[1]).filter("false")
    assert storage.replace_tenants(empty, f"{folders[1]}/consolidated", [8]) == {8: 0}
    after = R.consolidated(spark, folders[1])
    assert after.filter("tenant = 8").count() == 0 and after.filter("tenant = 7").count() == before
    assert not reports.has_data(after, 8) and reports.has_data(after, 7)
    R.materialise(spark, folders[1], 8)
    assert R.consolidated(spark, folders[1]).filter("tenant = 8").count() == before


def test_one_tenant_lists_only_its_folder(spark, folders, loaded):
    mine = R.consolidated(spark, folders[1], 7)
    assert mine.schema == S.CONSOLIDATED and mine.select("tenant").distinct().collect()[0][0] == 7
    assert all("tenant=7" in f for f in mine.inputFiles())
    assert R.consolidated(spark, folders[1], 99).isEmpty() and R.Staging(spark, folders[1], 99).history.isEmpty()
    assert R.materialise(spark, folders[1], 99) == 0


def test_csv_export_has_mark_headings_and_one_tenant(spark, folders, loaded):
    out = tempfile.mkdtemp(prefix="monofila-out-")
    R.export_csv(spark, folders[1], 7, out, single_file=True)
    (path,) = glob.glob(f"{out}/part-*.csv")
    raw = open(path, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfusuario_id;llave_afiliado;canal_origen")
    assert raw.decode("utf-8-sig").count("\n7;") == 8


@pytest.mark.parametrize("size", [0, 3, 5_000])
def test_one_file_from_many_tasks_equals_the_one_of_one_task(spark, monkeypatch, size):
    rows = spark.range(0, size, 1, 7).select(
        F.col("id").alias("a;b"), F.expr("CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' x\"y;' ELSE repeat('ñ', 9) END").alias("text")
    )
    out = tempfile.mkdtemp(prefix="monofila-out-")
    assert storage._concatenates(spark, out)
    storage.write_csv(rows, f"{out}/many", single_file=True)
    storage.write_csv(rows, f"{out}/many", single_file=True)
    monkeypatch.setattr(storage, "_concatenates", lambda *_: False)
    storage.write_csv(rows, f"{out}/one", single_file=True)
    (many,), (one,) = glob.glob(f"{out}/many/part-*"), glob.glob(f"{out}/one/part-*")
    assert open(many, "rb").read() == open(one, "rb").read()
    assert sorted(os.listdir(out)) == ["many", "one"]


def test_absent_and_empty_files_are_reported(spark):
    folder, warehouse = tempfile.mkdtemp(), tempfile.mkdtemp()
    with pytest.raises(FileNotFoundError):
        D.load_all(spark, folder, warehouse, 1)
    open(f"{folder}/SAT.csv", "w").close()
    states = {r["file"]: r["state"] for r in D.load_all(spark, folder, warehouse, 1).collect()}
    assert states["SAT.csv"] == "empty" and states["XML.csv"] == "absent"


def test_values_that_do_not_fit_fail_the_load_and_keep_the_old_rows(spark):
    folder, warehouse = tempfile.mkdtemp(), tempfile.mkdtemp()

    def load(text, **options):
        with open(f"{folder}/SAT.csv", "w") as f:
            f.write(text)
        return D.load_source(spark, folder, warehouse, S.OFFICIAL_SOURCE, 1, **options)

    load("ID|TIPODOCUMENTO\n1|3\n")
    with pytest.raises(Exception, match="column TIPODOCUMENTO of SAT.csv holds 7 characters it cannot take, from: 1234567"):
        load("ID|TIPODOCUMENTO\n2|1234567\n")
    assert [r["ID"] for r in D.staged(spark, warehouse, S.OFFICIAL_SOURCE).collect()] == [1]
    assert load("ID|TIPODOCUMENTO\nx|3\n2|1234567\n", strict=False)[1:4] == ("loaded", 2, 0)
    found = D.violations(D.scan(spark, f"{folder}/SAT.csv", S.OFFICIAL_SOURCE).rows, S.OFFICIAL_SOURCE.columns, "ID")
    assert {(r["column"], r["problem"], r["length"]) for r in found.collect()} == {
        ("ID", "not_integer", 1), ("TIPODOCUMENTO", "too_long", 7)
    }


def test_rows_that_do_not_fit_go_beside_the_table(spark):
    folder, warehouse = tempfile.mkdtemp(), tempfile.mkdtemp()

    def load(text, tenant=1, source=S.OFFICIAL_SOURCE):
        with open(f"{folder}/{source.file}", "w") as f:
            f.write(text)
        report = D.load_source(spark, folder, warehouse, source, tenant, quarantine=True)
        kept, wrong = (r(spark, warehouse, source, tenant) for r in (D.staged, D.refused))
        return (report[2], report[3], report[6]), kept, wrong

    load("ID|TIPODOCUMENTO\n9|3\n8|tooolong\n", tenant=2)
    counts, kept, wrong = load("ID|TIPODOCUMENTO|NOMBREIPS\n1|3|a\nx|1234567|b\n2|4\n3|4|" + "z" * 201 + "\n")
    assert counts == (1, 1, 2) and kept.schema == S.OFFICIAL_SOURCE.schema() and [r["ID"] for r in kept.collect()] == [1]
    told = {r["ID"]: [tuple(p) for p in r["problems"]] for r in wrong.collect()}
    assert told == {
        None: [("ID", "not_integer", 1, "x"), ("TIPODOCUMENTO", "too_long", 7, "1234567")], 3: [("NOMBREIPS", "too_long", 201, "z" * 60)],
    }
    counts, kept, wrong = load("ID|TIPODOCUMENTO\n5|3\n")
    assert counts == (1, 0, 0) and kept.count() == 1 and wrong.isEmpty(), "an earlier load's refusals go with its rows"
    counts, kept, wrong = load("ID|TIPODOCUMENTO\n5|1234567\n")
    assert counts == (0, 0, 1) and kept.isEmpty() and wrong.count() == 1
    assert D.staged(spark, warehouse, S.OFFICIAL_SOURCE, 2).count() == D.refused(spark, warehouse, S.OFFICIAL_SOURCE, 2).count() == 1
    counts, kept, wrong = load("Abreviatura|CODIGO\nCC|3\nNI|four\n", source=S.CATALOGUE)
    assert counts == (1, 0, 1) and kept.count() == wrong.count() == 1
    assert not [f for f in os.listdir(warehouse) if f.startswith("_routed")]


def test_unknown_header_is_an_error(spark):
    folder = tempfile.mkdtemp()
    with open(f"{folder}/SAT.csv", "w") as f:
        f.write("A|B\n1|2\n")
    with pytest.raises(ValueError, match="none of these headings"):
        D.scan(spark, f"{folder}/SAT.csv", S.OFFICIAL_SOURCE)


def test_every_file_of_a_source_is_bound_by_its_own_header(spark):
    folder, warehouse = tempfile.mkdtemp(prefix="monofila in ñ "), tempfile.mkdtemp()
    os.mkdir(f"{folder}/SAT.csv")
    parts = ["ID|TIPODOCUMENTO|NOMBREIPS\n1|3|Uno\n\n2|4|dos\n", "NOMBREIPS|OTHER|ID\n\"tres\nlíneas\"|x|3\n4\n", "ID|TIPODOCUMENTO|NOMBREIPS\n5|3|\"a\" b\n"]
    for i, text in enumerate(parts):
        with open(f"{folder}/SAT.csv/part {i}.csv", "w", encoding="latin-1", newline="") as f:
            f.write(text)
    report = D.load_source(spark, folder, warehouse, S.OFFICIAL_SOURCE, 1)
    assert report[1:5] == ("loaded", 4, 2, ["OTHER"])
    got = {r["ID"]: (r["TIPODOCUMENTO"], r["NOMBREIPS"]) for r in D.staged(spark, warehouse, S.OFFICIAL_SOURCE).collect()}
    # Text behind a closing quote is no quoted field; it stays as it was written.
    assert got == {1: ("3", "Uno"), 2: ("4", "dos"), 3: (None, "tres\nlíneas"), 5: ("3", '"a" b')}


def test_one_line_break_does_not_keep_other_files_in_one_piece(spark):
    folder = tempfile.mkdtemp()
    os.mkdir(f"{folder}/SAT.csv")
    with open(f"{folder}/SAT.csv/a.csv", "w") as f:
        f.write('ID|NOMBREIPS\n1|"x\ny"\n')
    with open(f"{folder}/SAT.csv/b.csv", "w") as f:
        f.write("ID|NOMBREIPS\n" + "".join(f"{i}|name {i}\n" for i in range(2, 20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = D.scan(spark, f"{folder}/SAT.csv", S.OFFICIAL_SOURCE).rows
        assert rows.rdd.getNumPartitions() > 3 and rows.count() == 19_999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_load_refuses_oversized_files_and_reports_unexpected_ones(spark):
    folder, warehouse = tempfile.mkdtemp(), tempfile.mkdtemp()
    for name, text in (("SAT.csv", "ID|TIPODOCUMENTO\n1|3\n2|3\n"), ("XML.csv", "x" * 500), ("OTHER.csv", "x")):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    report = D.load_all(spark, folder, warehouse, 1, limit_bytes=100)
    states = {r["file"]: r["state"] for r in report.collect()}
    assert (states["SAT.csv"], states["XML.csv"], states["OTHER.csv"], states["DIGITAL.csv"]) == ("loaded", "oversized", "unexpected", "absent")
    assert tuple(D.load_total(report).first()) == (1, 2, 0)


def test_utf8_file_is_read_or_repaired(spark):
    folder = tempfile.mkdtemp()
    with open(f"{folder}/SAT.csv", "w", encoding="utf-8-sig") as f:
        f.write("ID|NOMBREIPS\n1|Clínica\n")
    path = f"{folder}/SAT.csv"
    names = [
        D.scan(spark, path, S.OFFICIAL_SOURCE, **o).rows.select("ID", "NOMBREIPS").first()
        for o in ({}, {"encoding": "UTF-8"}, {"repair_utf8": True})
    ]
    assert [n["ID"] for n in names] == ["1", "1", "1"]
    assert [n["NOMBREIPS"] for n in names] == ["ClÃ\xadnica", "Clínica", "Clínica"]


def test_encoding_is_decided_by_file(spark):
    folder, warehouse = tempfile.mkdtemp(), tempfile.mkdtemp()
    os.mkdir(f"{folder}/SAT.csv")
    texts = [("utf-8", "1|Clínica"), ("latin-1", "2|Clínica"), ("utf-8-sig", "3|Ñandú"), ("ascii", "4|plain"), ("utf-8", '5|"dos\nlíneas"'), ("latin-1", '6|"dos\nlíneas"')]
    for i, (encoding, line) in enumerate(texts):
        with open(f"{folder}/SAT.csv/{i}.csv", "w", encoding=encoding) as f:
            f.write("ID|NOMBREIPS\n" + line + "\n")
    report = D.load_source(spark, folder, warehouse, S.OFFICIAL_SOURCE, 1, encoding=D.BY_FILE)
    assert report[1:4] == ("loaded", 6, 0) and report[5] == "ISO-8859-1, UTF-8"
    got = {r["ID"]: r["NOMBREIPS"] for r in D.staged(spark, warehouse, S.OFFICIAL_SOURCE).collect()}
    assert got == {1: "Clínica", 2: "Clínica", 3: "Ñandú", 4: "plain", 5: "dos\nlíneas", 6: "dos\nlíneas"}


def test_folder_check_lists_missing_unexpected_and_oversized(spark, folders):
    folder = tempfile.mkdtemp()
    for name, text in (("SAT.csv", "x" * 50), ("OTHER.csv", "x")):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    present = D.listing(spark, folder)
    found = {(r["file"], r["problem"]) for r in D.completeness(present, D.expected_files(spark)).collect()}
    assert ("OTHER.csv", "unexpected") in found and ("XML.csv", "missing") in found and len(found) == 6
    assert [r["file"] for r in D.oversized(present, 40).collect()] == ["SAT.csv"]


def test_tables_without_tenant_get_tenant_zero(spark):
    df = spark.createDataFrame([(1,)], "a int")
    once = storage.ensure_tenant(df)
    assert once.first()["tenant"] == 0 and storage.ensure_tenant(once) is once


def test_several_tenants_are_replaced_in_one_write(spark):
    path = tempfile.mkdtemp(prefix="monofila-t-") + "/t"
    rows = spark.range(90).selectExpr("CAST(id % 3 AS int) AS tenant", "id")
    assert storage.replace_tenants(rows, path, [0, 1, 2]) == {0: 30, 1: 30, 2: 30}
    fewer = rows.filter("tenant <> 1 AND id < 30")
    assert storage.replace_tenants(fewer, path, [0, 1]) == {0: 10, 1: 0}
    left = {r["tenant"]: r["count"] for r in spark.read.parquet(path).groupBy("tenant").count().collect()}
    assert left == {0: 10, 2: 30}


def test_loads_of_different_tables_run_side_by_side(spark):
    from threading import Barrier

    from monofila.checks.registry import _side_by_side

    both, order = Barrier(2, timeout=30), []

    def load(name, meets):
        if meets:
            both.wait()
        order.append(name)
        return (name, spark.range(3).count())

    turns = [[lambda: load("a", True), lambda: load("b", False)], [lambda: load("c", True)]]
    assert _side_by_side(spark, turns) == [("a", 3), ("b", 3), ("c", 3)]
    assert order.index("a") < order.index("b")


def test_lines_without_quotes_leave_no_field_open(spark):
    from monofila.sources.records import keeps_open, leaves_open

    lines = [("",), ("a|b",), ('a|"b',), ('a|"b|c"|d',), ('x"|y',), ('x"|"y',)]
    rows = spark.createDataFrame(lines, "value string").select(leaves_open(F.col("value"), "|"), keeps_open(F.col("value"), "|"))
    assert [tuple(r) for r in rows.collect()] == [(False, True), (False, True), (True, True), (False, True), (False, False), (False, True)]
