"""Delimited sources as raw text: header binding, short rows, widths, load report."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monofila.functions.columns import strip_blank
from monofila.schemas import INTEGER, SOURCES, Source
from monofila.sources.records import leaves_open, quoted_field, records
from monofila.sources.storage import read_tenants, replace_shared, replace_tenants, route

DEFAULT_ENCODING = "ISO-8859-1"
#: In place of an encoding: every file is read by what its own bytes allow.
BY_FILE = "by file"
_MARKS = ("﻿", "ï»¿")
_RAW = "_raw"

REPORT_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("discarded", T.LongType()),
    T.StructField("ignored", T.ArrayType(T.StringType())),
    T.StructField("encoding", T.StringType()),
    T.StructField("refused", T.LongType()),
])


_PROBLEMS = T.ArrayType(T.StructType([
    T.StructField("column", T.StringType()), T.StructField("problem", T.StringType()),
    T.StructField("length", T.IntegerType()), T.StructField("value", T.StringType()),
]))

# ---- what is in the folder -------------------------------------------------


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files of a folder with their sizes; contents are not read.

    A scan passes over files without bytes, so names come from the file index.
    """
    found = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    names = [(f.rsplit("/", 1)[-1],) for f in found.inputFiles() if f.endswith(".csv")]
    listed = spark.createDataFrame(names, "file string")
    sizes = found.select(name.alias("file"), F.col("length").alias("_bytes"))
    return listed.join(sizes, "file", "left").select("file", F.coalesce("_bytes", F.lit(0)).alias("bytes"))


def completeness(present: DataFrame, expected: DataFrame, *scope: str) -> DataFrame:
    """Names missing from ``present`` and names nobody expected, per scope."""
    keys = [*scope, "file"]
    received = present.select(*keys).distinct()
    missing = expected.join(received, keys, "left_anti").select(*keys, F.lit("missing").alias("problem"))
    surplus = received.join(expected, keys, "left_anti").select(*keys, F.lit("unexpected").alias("problem"))
    return missing.unionByName(surplus)


def expected_files(spark: SparkSession, sources: Iterable[Source] = SOURCES) -> DataFrame:
    return spark.createDataFrame([(s.file,) for s in sources], "file string")


def oversized(present: DataFrame, limit_bytes: int) -> DataFrame:
    """Files above a size limit. The limit belongs to the deployment, not to the data."""
    return present.filter(F.col("bytes") > limit_bytes)


# ---- reading one source ----------------------------------------------------


@dataclass(frozen=True)
class Scan:
    """One source as text. ``rows`` carries ``_short`` for rows to discard."""

    rows: DataFrame
    ignored: list[str]
    blank_lines: int
    encodings: tuple[str, ...] = ()


def read_header(spark: SparkSession, path: str, source: Source, encoding: str = DEFAULT_ENCODING) -> list[str] | None:
    """Header names, stripped of blanks and byte-order mark; None for an empty file."""
    first = (
        spark.read.option("sep", source.separator).option("header", False).option("escape", '"')
        .option("encoding", encoding).csv(path).first()
    )
    if first is None:
        return None
    names = [(c or "").strip() for c in first]
    for mark in _MARKS:
        names[0] = names[0].removeprefix(mark)
    return names


def _text_probe(spark: SparkSession, path: str, separator: str) -> list[Row]:
    """Per file: its first line, whether any quoted field spans lines, empty lines, lines
    of blanks only, and whether its bytes are UTF-8 that says more than ASCII can. One pass, one
    row per file.

    A line that still starts a field with a quote once its complete quoted fields are
    gone leaves that field open. Lines are taken as bytes, which suits every encoding that
    keeps ASCII.
    """
    # The task that reads a file's first block sees its lines in order.
    head = F.first(F.when(F.col("_metadata.file_block_start") == 0, F.col("value")), ignorenulls=True)
    return spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(
        head.alias("head"),
        F.max(leaves_open(F.col("value"), separator)).alias("spans"),
        F.count(F.when(F.col("value") == "", 1)).alias("empty"),
        F.count(F.when((F.col("value") != "") & (F.trim("value") == ""), 1)).alias("blank"),
        (F.min(F.is_valid_utf8("value")) & F.max(F.length("value") < F.octet_length("value"))).alias("utf8"),
    ).orderBy("file").collect()


def scan(
    spark: SparkSession, path: str, source: Source, encoding: str = DEFAULT_ENCODING,
    multi_line: bool | None = None, repair_utf8: bool = False,
) -> Scan | None:
    """Read one source, a file or a folder of files; None when there is no line in it.

    Each file is bound by its own header: files with the same first line are read together.
    With ``BY_FILE`` for an encoding, a file that holds non-ASCII characters and is valid UTF-8
    throughout is read as UTF-8, every other one as Latin-1, which takes any byte; text in
    Latin-1 is hardly ever valid UTF-8 by chance.
    Quoted fields may contain line breaks. Unless told, the text pass that finds the headers
    also finds the files in which any field does. Those are put together from their byte
    ranges (``records``), so every file is read by as many tasks as its size asks for.
    """
    alike: dict[tuple[str, bool, str], list[Row]] = {}
    for row in _text_probe(spark, path, source.separator):
        own = encoding if encoding != BY_FILE else "UTF-8" if row["utf8"] else DEFAULT_ENCODING
        alike.setdefault((row["head"], row["spans"] if multi_line is None else multi_line, own), []).append(row)
    scans = [
        _scan_alike(spark, [unquote(r["file"]) for r in rows], source, own, spans, repair_utf8, sum(r["empty"] for r in rows), sum(r["blank"] for r in rows))
        for (_, spans, own), rows in alike.items()
    ]
    if not scans:
        return None
    ignored = list(dict.fromkeys(c for s in scans for c in s.ignored))
    encodings = tuple(sorted({own for *_, own in alike}))
    return Scan(reduce(DataFrame.unionByName, [s.rows for s in scans]), ignored, sum(s.blank_lines for s in scans), encodings)


def _scan_alike(
    spark: SparkSession, files: list[str], source: Source, encoding: str, multi_line: bool, repair_utf8: bool,
    empty: int, blank: int,
) -> Scan:
    """Files with one header.

    Spark marks short and long rows alike. Only short ones are discarded, found by
    counting separators outside quotes in the marked rows alone. Column pruning is off
    for the scan because the parser would otherwise judge a pruned row.
    """
    header = read_header(spark, files[0], source, encoding) or [""]
    common = [c for c in source.columns if c in header]
    ignored = [c for c in header if c not in source.columns]
    if not common:
        raise ValueError(f"none of these headings belongs to {source.file}: {', '.join(header)}")

    positions = [f"_{i}" for i in range(len(header))]
    schema = T.StructType([T.StructField(p, T.StringType()) for p in [*positions, _RAW]])
    options = {"sep": source.separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW}
    if multi_line:
        found = records(spark, files, source.separator)
        text = F.col("record") if encoding == DEFAULT_ENCODING else F.decode(F.encode("record", DEFAULT_ENCODING), encoding)
        # Every file begins with its header, and files read together have the same one.
        rows = found.rows.filter("NOT heading AND record != ''").select(text.alias("record"))
        raw = rows.select(F.from_csv("record", ", ".join(f"{p} STRING" for p in schema.names), {**options, "multiLine": "true"}).alias("r")).select("r.*")
        skipped = found.blank
    else:
        raw = spark.read.schema(schema).options(**options).option("header", True).option("encoding", encoding).option("columnPruning", False).csv(files)
        skipped = empty + blank
    unquoted = F.regexp_replace(_RAW, quoted_field(source.separator), "$1")
    fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(source.separator), F.lit(""))) + 1
    short = F.col(_RAW).isNotNull() & (fields < len(header))

    def value(name: str) -> Column:
        text = F.col(positions[header.index(name)])
        if repair_utf8:
            bytes_ = F.encode(text, "ISO-8859-1").cast("string")
            text = F.coalesce(F.try_validate_utf8(bytes_), text)
        return strip_blank(text)

    bound = [(value(c) if c in common else F.lit(None).cast("string")).alias(c) for c in source.columns]
    # Readers drop blank lines without marking them; they count as short rows too. Where fields
    # hold line breaks, empty lines inside those fields are no rows.
    return Scan(raw.select(*bound, F.coalesce(short, F.lit(False)).alias("_short")), ignored, skipped)


# ---- values that do not fit ------------------------------------------------


def _unfit(name: str, width: int) -> Column:
    """Whether a text value is too long or, for an integer column, no integer."""
    text = F.col(name).cast("string")
    wrong = text.try_cast("int").isNull() if width == INTEGER else F.length(text) > width
    return F.coalesce(F.col(name).isNotNull() & wrong, F.lit(False))


def problems(widths: dict[str, int]) -> Column:
    """The values of a row that do not fit: column, problem, length and first sixty characters."""
    checks = F.array(*[
        F.struct(
            F.lit(name).alias("column"),
            F.lit("not_integer" if width == INTEGER else "too_long").alias("problem"),
            F.length(F.col(name).cast("string")).alias("length"),
            F.left(F.col(name).cast("string"), F.lit(60)).alias("value"),
            _unfit(name, width).alias("unfit"),
        )
        for name, width in widths.items()
    ])
    return F.transform(F.filter(checks, lambda x: x["unfit"]), lambda x: x.dropFields("unfit"))


def violations(rows: DataFrame, widths: dict[str, int], *keys: str) -> DataFrame:
    """One row per value that does not fit. Map-only; clean rows produce nothing."""
    return rows.select(*keys, F.inline(problems(widths)))


def typed(rows: DataFrame, source: Source, strict: bool = False, *carried: str) -> DataFrame:
    """Columns in their staging types. Text that is no integer becomes NULL, or, when
    ``strict``, the first value that does not fit fails the job."""
    columns = []
    for name, width in source.columns.items():
        value = F.col(name).try_cast("int") if width == INTEGER else F.col(name)
        if strict:
            shown = F.left(F.col(name), F.lit(60))
            told = F.concat(F.lit(f"column {name} of {source.file} holds "), F.length(name), F.lit(" characters it cannot take, from: "), shown)
            value = F.when(_unfit(name, width), F.raise_error(told)).otherwise(value)
        columns.append(value.alias(name))
    return rows.select(*columns, *carried)


# ---- loading ---------------------------------------------------------------


def load_source(
    spark: SparkSession, folder: str, warehouse: str, source: Source, tenant: int,
    encoding: str = DEFAULT_ENCODING, strict: bool = True, quarantine: bool = False, **options,
) -> tuple:
    """Load one file into its staging table, replacing only this tenant's rows.

    With ``quarantine`` a row that holds a value that does not fit is refused, not the file: the
    same write puts it beside the staging table, with what is wrong in it (``refused``).

    Returns one row of the load report. ``strict`` refuses the file at the first value
    that does not fit; the write then fails before it publishes, so the old rows stay
    and no extra pass over the file is needed.
    """
    path = f"{folder}/{source.file}"
    try:
        found = scan(spark, path, source, encoding, **options)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return (source.file, "absent", 0, 0, [], None, 0)
    if found is None:
        return (source.file, "empty", 0, 0, [], encoding, 0)

    seen = Observation()
    bad = reduce(Column.__or__, [_unfit(c, w) for c, w in source.columns.items()]) if quarantine else F.lit(False)
    counted = found.rows.observe(
        seen, F.count(F.when(~F.col("_short"), 1)).alias("rows"), F.count(F.when(F.col("_short"), 1)).alias("short"),
        F.count(F.when(~F.col("_short") & bad, 1)).alias("refused"),
    )
    whole = counted.filter(~F.col("_short"))
    rows = typed(whole, source, strict)
    target = f"{warehouse}/{source.name}"
    if quarantine:
        wrong = problems(source.columns)
        judged = whole.withColumns({"problems": wrong, "verdict": F.when(F.size(wrong) > 0, "refused").otherwise("accepted")})
        own = "" if source.shared else f"/tenant={tenant}"
        route(typed(judged, source, False, "problems", "verdict"), "verdict", {"accepted": target + own, "refused": f"{target}_refused{own}"})
    elif source.shared:
        replace_shared(rows, target)
    else:
        replace_tenants(rows.withColumn("tenant", F.lit(tenant)), target, [tenant])
    count = seen.get
    loaded = count["rows"] - count["refused"]
    return (source.file, "loaded", loaded, count["short"] + found.blank_lines, found.ignored, ", ".join(found.encodings), count["refused"])


def load_all(
    spark: SparkSession, folder: str, warehouse: str, tenant: int, sources: Iterable[Source] = SOURCES,
    limit_bytes: int | None = None, **options,
) -> DataFrame:
    """Load every source of a folder and report what happened to each.

    Files above ``limit_bytes`` are not read, and files that belong to no source are named.
    """
    sources = list(sources)
    if not any(f.endswith(".csv") for f in spark.read.format("binaryFile").load(folder).inputFiles()):
        raise FileNotFoundError(f"no CSV files in {folder}")
    present = listing(spark, folder)
    large = set() if limit_bytes is None else {r["file"] for r in oversized(present, limit_bytes).collect()}
    report = [
        (s.file, "oversized", 0, 0, [], None, 0) if s.file in large else load_source(spark, folder, warehouse, s, tenant, **options)
        for s in sources
    ]
    surplus = completeness(present, expected_files(spark, sources)).filter("problem = 'unexpected'").orderBy("file").collect()
    report += [(r["file"], "unexpected", 0, 0, [], None, 0) for r in surplus]
    return spark.createDataFrame(report, REPORT_SCHEMA)


def load_total(report: DataFrame) -> DataFrame:
    """Sources loaded, rows written and rows discarded, over a whole load."""
    return report.agg(
        F.count(F.when(F.col("state") == "loaded", 1)).alias("sources"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("discarded"), F.lit(0)).alias("discarded"),
    )


def refused(spark: SparkSession, warehouse: str, source: Source, tenant: int | None = None) -> DataFrame:
    """Rows that loads with ``quarantine`` refused: the columns of the source, NULL where an
    integer was none, and ``problems``, one entry per value that does not fit."""
    schema = T.StructType([*source.schema().fields, T.StructField("problems", _PROBLEMS)])
    return _read(spark, f"{warehouse}/{source.name}_refused", schema, source.shared, tenant)


def staged(spark: SparkSession, warehouse: str, source: Source, tenant: int | None = None) -> DataFrame:
    """Staging table of a source, of one tenant or of all; empty when never loaded."""
    return _read(spark, f"{warehouse}/{source.name}", source.schema(), source.shared, tenant)


def _read(spark: SparkSession, path: str, schema: T.StructType, shared: bool, tenant: int | None) -> DataFrame:
    if not shared:
        return read_tenants(spark, path, schema, tenant)
    try:
        return spark.read.parquet(path).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
