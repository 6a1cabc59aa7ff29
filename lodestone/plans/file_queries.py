"""Queries of the file sources: a given table is written as a file of one format, opened, and compared with SQL."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import ROW, Dataset, Query, Sort, from_frame
from ..operators.view import export_csv, run
from ..sources.open import irregular, open_table
from .queries import _table, query
from .storage import shared_dir


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestone/files-{uuid.uuid4().hex}"


def _file(df: DataFrame, key: str, value: Column, name: str, first: str | None = None, end: str = "\n") -> str:
    """One file of the rows' values in the order of key, after the lines in first; its path."""
    spark, folder = df.sparkSession, _folder(df.sparkSession)
    head = spark.createDataFrame([(-1, first)] if first is not None else [], "at long, value string")
    body = head.unionByName(df.select(F.col(key).cast("long").alias("at"), value.alias("value")))
    body.repartition(1).sortWithinPartitions("at").select("value").write.option("lineSep", end).text(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.rename(fs.globStatus(path(f"{folder}/part-*"))[0].getPath(), path(f"{folder}/{name}"))
    return f"{folder}/{name}"


def _cells(data: Dataset, *names: str) -> DataFrame:
    return data.df.select(F.col(ROW).cast("long").alias("row_id"), *(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


@query("""select row_number() over (order by c_custkey) - 1 as row_id, cast(c_custkey as varchar) as key, c_name || ' "' || c_mktsegment || '",' || chr(10) || 'x' as note from customer""")
def src_01_csv_quotes(spark, d):
    note = F.concat(F.lit('"'), "c_name", F.lit(' ""'), "c_mktsegment", F.lit('"",\nx"'))
    path = _file(_table(spark, d, "customer"), "c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit(","), note), "customer.csv", "key,note")
    return _cells(open_table(spark, path), "key", "note")


@query("select row_number() over (order by s_suppkey) - 1 as row_id, cast(s_suppkey as varchar) as key, s_name as name from supplier")
def src_01_csv_carriage_returns(spark, d):
    path = _file(_table(spark, d, "supplier"), "s_suppkey", F.concat_ws(",", "s_suppkey", "s_name"), "supplier.csv", "key,name", "\r")
    return _cells(open_table(spark, path), "key", "name")


@query("select row_number() over (order by p_partkey) - 1 as row_id, cast(p_partkey as varchar) as key, p_type as kind, p_brand as brand from part")
def src_20_delimiter(spark, d):
    path = _file(_table(spark, d, "part"), "p_partkey", F.concat_ws(";", "p_partkey", "p_type", "p_brand"), "part.csv", "key;kind;brand")
    return _cells(open_table(spark, path), "key", "kind", "brand")


@query("select row_number() over (order by o_orderkey) - 1 as row_id, cast(o_orderkey as varchar) as key, o_orderpriority as priority, cast(o_custkey as varchar) as customer from orders")
def src_03_jsonl(spark, d):
    record = F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderpriority").alias("priority"), F.array("o_custkey").alias("customers")).alias("of"))
    path = _file(_table(spark, d, "orders"), "o_orderkey", F.to_json(record), "orders.jsonl")
    data = open_table(spark, path)
    assert data.headers == ["/key", "/of/priority", "/of/customers"], data.headers
    return _cells(data, "key", "priority", "customer").withColumn("customer", F.regexp_extract("customer", r"^\[(.*)\]$", 1))


@query("select row_number() over (order by n_nationkey) - 1 as row_id, cast(n_nationkey as varchar) as key, n_name as name, cast(n_regionkey as varchar) as region from nation")
def src_02_json_document(spark, d):
    record = F.to_json(F.struct("n_nationkey", F.struct("n_name", "n_regionkey").alias("of")))
    rows = F.concat(F.when(F.col("n_nationkey") > 0, ",").otherwise("["), record)
    nations = _table(spark, d, "nation")
    path = _file(nations.select("n_nationkey", rows.alias("json")).unionByName(spark.createDataFrame([(10**9, "]")], "n_nationkey long, json string")), "n_nationkey", F.col("json"), "nation.json")
    return _cells(open_table(spark, path), "key", "name", "region")


@query("select row_number() over (order by p_partkey) - 1 as row_id, p_name || ',' as line from part")
def src_04_text(spark, d):
    path = _file(_table(spark, d, "part"), "p_partkey", F.concat("p_name", F.lit(",")), "part.txt", None, "\r\n")
    return _cells(open_table(spark, path, kind="text"), "line")


@query("select row_number() over (order by s_suppkey) - 1 as row_id, cast(s_suppkey as varchar) as key, s_name || '  of ' || s_nationkey as name from supplier")
def src_05_ruler(spark, d):
    value = F.concat_ws("", "s_suppkey", F.lit("   "), "s_name", F.lit("  of "), "s_nationkey")
    path = _file(_table(spark, d, "supplier"), "s_suppkey", value, "supplier.txt", "Key Name\n--- ----")
    return _cells(open_table(spark, path), "key", "name")


@query("""with n as (select row_number() over (order by n_nationkey) as i, n_name, n_regionkey from nation)
select '/r[1]' as path, '' as value, 'element' as kind union all select '/r[1]/n[' || i || ']', '', 'element' from n
union all select '/r[1]/n[' || i || ']/@of', n_regionkey || '"', 'attribute' from n union all select '/r[1]/n[' || i || ']', n_name || ' & <' || chr(228), 'text' from n""")
def src_09_xml(spark, d):
    value = F.concat(F.lit('<n of="'), F.col("n_regionkey").cast("string"), F.lit('&quot;">'), "n_name", F.lit(" &amp; <![CDATA[<]]>&#228;</n>"))
    nations = _table(spark, d, "nation").select("n_nationkey", value.alias("xml"))
    path = _file(nations.unionByName(spark.createDataFrame([(10**9, "</r>")], "n_nationkey long, xml string")), "n_nationkey", F.col("xml"), "nation.xml", "<r>")
    return _cells(open_table(spark, path), "path", "value", "kind").where("kind <> 'whitespace'").drop("row_id")


@query("with c as (select len(string_split(p_name, ' ')) as n from part) select count_if(n <> (select max(n) from c)) as irregular, max(n) as widest from c")
def imp_03_irregular(spark, d):
    path = _file(_table(spark, d, "part"), "p_partkey", F.translate("p_name", " ", ","), "part.csv")
    data = open_table(spark, path, kind="csv", delimiter=",", header=False)
    return spark.createDataFrame([(irregular(data), len(data.headers))], "irregular long, widest long")


@query("select row_number() over (order by c_name desc, c_custkey) - 1 as row_id, cast(c_custkey as varchar) as key, c_name as name, c_mktsegment || ',\"' as note from customer where contains(lower(c_mktsegment), 'build')")
def snk_01_export(spark, d):
    columns = ["c_custkey", "c_name", "note"]
    customers = _table(spark, d, "customer").withColumn("note", F.concat("c_mktsegment", F.lit(',"')))
    data = from_frame(customers.select(*columns), ["c_custkey"], columns)
    path = urlsplit(f"{_folder(spark)}.csv").path
    export_csv(run(data, Query("build", sort=Sort(1, True))), path)
    return _cells(open_table(spark, path, kind="csv", delimiter=","), "key", "name", "note")
