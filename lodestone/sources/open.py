"""Opens a file as a table of text columns in source order."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import FIELDS, ROW, Dataset
from . import binary_tables, csv_table, detect, headers, json_table, xml_table

#: Formats that are parsed from the bytes of the whole file, in one task.
WHOLE: dict[str, Callable[[bytes], object]] = {
    "usn": binary_tables.usn,
    "arn": binary_tables.autoruns,
    "sqlite": binary_tables.sqlite,
    "registry": binary_tables.registry,
    "evtx": binary_tables.event_log,
    "hex": binary_tables.hex_dump,
    "binary": binary_tables.strings,
}
WARNINGS = {
    "registry": ["Registry hive snapshot; transaction logs and deleted keys are not replayed.", "Binary values show probable readable strings when present; Raw data retains the original hexadecimal bytes."],
    "evtx": ["Event contents are shown as readable text; damaged chunks and records are rows with a parse error."],
}
TEXT = ("text", *sorted(set(detect.CODE.values()) - {"text"}))


def head(spark: SparkSession, path: str, n: int = detect.SAMPLE) -> tuple[bytes, int]:
    """The first bytes and the size of a file in any store that Spark reads."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, size))), size
    finally:
        stream.close()


def lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """block, value: lines without their feeds, in order within blocks; invalid text is an error. Read by byte ranges if UTF-8."""
    if encoding == "utf-8":
        text = spark.read.option("lineSep", "\n").text(path)
        return text.select(F.col("_metadata.file_block_start").alias("block"), F.validate_utf8("value").alias("value"))
    codec = detect.ENCODINGS[encoding]

    def rows(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                parts = content.decode(codec, "strict").removeprefix("\ufeff").split("\n")
                parts = parts[:-1] if parts[-1] == "" else parts
                for i in range(0, len(parts), 5000):
                    part = parts[i : i + 5000]
                    yield pa.record_batch([pa.array([0] * len(part), pa.int64()), pa.array(part)], names=["block", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "block long, value string")


def numbered(rows: DataFrame) -> DataFrame:
    """rows (with block) with ROW instead of block: dense in the order of the blocks, whatever partition read which."""
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    starts, total = {}, 0
    for r in sorted(rows.groupBy("block").agg(F.min("_at").alias("first"), F.count("*").alias("n")).collect()):
        starts[r.block], total = total - r.first, total + r.n
    if not starts:
        return rows.select(F.lit(0).cast("long").alias(ROW), *(c for c in rows.columns if c not in ("block", "_at")))
    shift = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in starts.items() for x in kv)), F.col("block"))
    return rows.select((F.col("_at") + shift).cast("long").alias(ROW), *(c for c in rows.columns if c not in ("block", "_at")))


def _leaves(path_rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """ROW, names, values as columns, in the order in which the names first appear."""
    path_rows = path_rows.persist()
    first = path_rows.select(ROW, F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min(F.struct(ROW, "at")).alias("first"))
    names = [r.name for r in first.orderBy("first").limit(headers.MAX_COLUMNS + 1).collect()]
    if len(names) > headers.MAX_COLUMNS:
        raise ValueError(f"more than {headers.MAX_COLUMNS} columns")
    cells = F.map_from_arrays("names", "values")
    return path_rows.select(ROW, *(F.coalesce(F.try_element_at(cells, F.lit(n)), F.lit("")).alias(f"c{i}") for i, n in enumerate(names))), names


LEAVES = "names array<string>, values array<string>"


def _batch(rows: list[list[tuple[str, str]]]) -> pa.RecordBatch:
    kind = pa.list_(pa.string())
    return pa.record_batch([pa.array([[n for n, _ in r] for r in rows], kind), pa.array([[v for _, v in r] for r in rows], kind)], names=["names", "values"])


def _whole(spark: SparkSession, path: str, parse) -> DataFrame:
    def rows(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                out = []
                for r in parse(content):
                    out.append(r)
                    if len(out) == 2000:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    parsed = spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, LEAVES)
    return parsed.select(F.monotonically_increasing_id().alias(ROW), "names", "values")


def _json_lines(batches):
    for b in batches:
        out = [[(p, v) for x in json_table.documents(t, True) for p, v in json_table.flatten(x)] for t in b.column(1).to_pylist()]
        batch = _batch(out)
        yield pa.record_batch([b.column(0), *batch.columns], names=[ROW, "names", "values"])


def _json_parser(codec: str):
    return lambda data: (json_table.flatten(x) for x in json_table.documents(data.decode(codec).removeprefix("\ufeff")))


def _xml_parser(data: bytes):
    return (list(zip(("Path", "Value", "Kind"), r)) for r in xml_table.rows(data.decode("utf-8").removeprefix("\ufeff")))


def open_table(spark: SparkSession, path: str, kind: str | None = None, delimiter: str | None = None, header: bool = True, encoding: str | None = None, auto_text: bool = True, language: str = "en") -> Dataset:
    """kind: None to detect it, or one of csv, json, jsonl, xml, text, ruler, hex, binary, usn, arn, sqlite, registry, evtx."""
    sample, size = head(spark, path)
    whole = len(sample) == size
    found = kind or ("csv" if delimiter else detect.kind_of(path, sample, whole, None, auto_text))
    encoding = encoding or detect.encoding_of(sample)
    try:
        data = _opened(spark, path, found, sample, whole, delimiter, header, encoding, language)
    except Exception as e:
        low = path.lower()
        if kind or not (found in ("registry", "ese") or low.endswith((".dat", ".edb", ".bin"))):
            raise
        data = _opened(spark, path, "binary", sample, whole, None, header, encoding, language)
        data.warnings.insert(0, f"Could not fully parse the file: {str(e).splitlines()[0][:300]}")
    data.source = path
    return data


def _opened(spark, path, kind, sample, whole, delimiter, header, encoding, language) -> Dataset:
    label = f"{kind.upper()} · {encoding.upper()}"
    text_name = headers.GENERATED[language]["text"]
    if kind == "ese":
        raise ValueError("this database format has no reader")
    if kind in WHOLE:
        df, names = _leaves(_whole(spark, path, WHOLE[kind]))
        hidden = {i for i, n in enumerate(names) if n.startswith("$raw/") and kind == "sqlite" or n == "Raw data"}
        return Dataset(df, names, kind, kind.upper(), list(WARNINGS.get(kind, [])), hidden=hidden)
    if kind == "xml":
        df, names = _leaves(_whole(spark, path, _xml_parser))
        return Dataset(df, ["Path", "Value", "Kind"] if not names else names, kind, label, [xml_table.DTD_WARNING] if b"<!DOCTYPE" in sample else [])
    if kind == "json":
        df, names = _leaves(_whole(spark, path, _json_parser(detect.ENCODINGS[encoding])))
        return Dataset(df, names, kind, label)
    rows = lines(spark, path, encoding)
    if kind == "csv":
        text = sample.decode(detect.ENCODINGS[encoding], "ignore").removeprefix("\ufeff")
        mark = delimiter or detect.delimiter(text if whole else text[: text.rfind("\n") + 1]) or ("\t" if path.lower().endswith(".tsv") else "|" if path.lower().endswith(".psv") else ",")
        records = csv_table.records(rows, mark).persist()
        first = records.where("record = 0").first() if header else None
        widest = records.agg(F.max(F.size("fields"))).first()[0] or 0
        names, generated = headers.completed(first.fields if first else [], widest, language)
        body = records.where("record > 0") if first else records
        cells = [F.coalesce(F.get("fields", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(len(names))]
        return Dataset(body.select((F.col("record") - (1 if first else 0)).alias(ROW), *cells, F.size("fields").alias(FIELDS)), names, "table", f"CSV · {encoding.upper()}", generated=generated)
    rows = numbered(rows).withColumn("value", F.when(F.col(ROW) == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")))
    if kind == "jsonl":
        kept = rows.where(F.trim("value") != "")
        df, names = _leaves(kept.select(ROW, "value").mapInArrow(_json_lines, f"{ROW} long, {LEAVES}"))
        return Dataset(df, names, kind, label)
    rows = rows.withColumn("value", F.regexp_replace("value", "\\r\\z", ""))
    if kind == "ruler":
        names = sample.decode(detect.ENCODINGS[encoding], "ignore").removeprefix("\ufeff").split("\n")[0].split()
        body = rows.where((F.col(ROW) > 1) & (F.trim("value") != ""))
        parts = F.split(F.trim("value"), "\\s+", len(names))
        return Dataset(body.select((F.col(ROW) - 2).alias(ROW), *(F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(len(names)))), headers.unique(names), "table", label)
    return Dataset(rows.select(ROW, F.col("value").alias("c0")), [text_name], kind, label, generated={0: "text"})


def irregular(data: Dataset) -> int:
    """Records whose number of fields is not that of the headers."""
    return data.df.where(F.col(FIELDS) != len(data.headers)).count() if data.ragged else 0
