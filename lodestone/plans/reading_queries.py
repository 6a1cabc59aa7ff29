"""Queries of what is read from views, of scopes of search, and of files made byte by byte, compared with SQL."""

from __future__ import annotations

import os
import sqlite3
import struct
import uuid
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import occurrences, view
from ..operators.model import ROW, Filter, Kind, Query, Sort, from_frame
from ..operators.sort import order
from ..sources.headers import localised
from ..sources.open import open_table
from .file_queries import _cells, _file, _folder
from .queries import _keys, _parts, _ranked, _table, _texts, query
from .storage import shared_dir


def _local(spark, name: str) -> str:
    """A path in the shared folder that the driver writes itself."""
    folder = urlsplit(f"{shared_dir(spark)}/lodestone/files-{uuid.uuid4().hex}").path
    os.makedirs(folder)
    return f"{folder}/{name}"


def _nations(spark, d) -> list:
    """The fixed list of nations: its size does not grow with the data."""
    return _table(spark, d, "nation").orderBy("n_nationkey").collect()


def _customers(spark, d):
    return from_frame(_table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], ["c_custkey", "c_name"])


@query("""with r as (select row_number() over (order by c_custkey) - 1 as row_id, c_custkey, c_name from customer), s as (select *, row_number() over (order by c_name desc, c_custkey) - 1 as pos from r)
select row_id, cast(c_custkey as varchar) as key, c_name as name from s where pos >= 20 and pos < 276""")
def snk_04_viewport(spark, d):
    shown = view.viewport(view.run(_customers(spark, d), Query(sort=Sort(1, True))), 20, 300, [0, 1])
    return spark.createDataFrame([(r["row"], *r["values"]) for r in shown], "row_id long, key string, name string")


@query("with s as (select row_number() over (order by c_custkey) - 1 as pos, c_custkey from customer where contains(c_name, '7')) select pos, c_custkey from s where pos >= 5 and pos < 25")
def snk_05_slice(spark, d):
    found = view.run(_customers(spark, d), Query(filters=(Filter(1, "contains", "7"),))).slice(5, 20)
    return found.select(F.col(view.POS).alias("pos"), F.col("c0").cast("long").alias("c_custkey"))


@query("with s as (select row_number() over (order by p_partkey) - 1 as row_id, cast(p_partkey as varchar) as key, p_name as name from part) select * from s where row_id >= 10 and row_id < 138")
def snk_06_row_page(spark, d):
    rows = view.page(_parts(spark, d), 10, 128)
    return spark.createDataFrame([(r["row"], *r["values"][:2]) for r in rows], "row_id long, key string, name string")


@query("select p_name[:5] as value, length(p_name) > 5 as truncated from part order by p_partkey limit 1 offset 3")
def snk_07_cell(spark, d):
    found = view.cell(view.View(_parts(spark, d)), 3, 1, 5)
    return spark.createDataFrame([(found["value"], found["truncated"])], "value string, truncated boolean")


@query("select string_agg(n_nationkey || chr(9) || n_name, chr(13) || chr(10) order by n_nationkey) as text from nation where n_nationkey between 2 and 11")
def snk_08_copy(spark, d):
    data = from_frame(_table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], ["n_nationkey", "n_name"])
    return spark.createDataFrame([(view.copy_range(view.View(data), 2, 11, [0, 1]),)], "text string")


@query("select row_number() over (order by p_partkey) - 1 as row_id, cast(p_partkey as varchar) as key, p_name as name from part where contains(lower(p_name), 'gear') or contains(lower(p_type), 'gear') or contains(lower(p_brand), 'gear')")
def snk_02_export_by_mask(spark, d):
    parts = _parts(spark, d)
    path = urlsplit(f"{_folder(spark)}.csv").path
    view.export_csv(view.View(view.restricted(parts, view.matching(parts, Query("gear")))), path)
    return _cells(open_table(spark, path, kind="csv", delimiter=","), "key", "name")


@query("""with s as (select row_number() over (order by p_partkey) - 1 as row_id, p_name, p_type from part), h as (select row_id, 1 as place, len(regexp_extract_all(p_name, 'e', 0, 'i')) as hits from s union all select row_id, 3, len(regexp_extract_all(p_type, 'e', 0, 'i')) from s)
select row_id, place, hits from h where hits > 0""")
def occ_03_scope(spark, d):
    found = occurrences.hits(_parts(spark, d), "E", columns=[1, 3])
    return found.groupBy(F.col("row").alias("row_id"), F.col("column").alias("place")).agg(F.count("*").alias("hits"))


@query("select sum(len(regexp_extract_all(p_name, 'a', 0, 'i'))) as hits from part where contains(p_brand, '1')")
def occ_05_filter_only(spark, d):
    parts = _parts(spark, d)
    within = view.matching(parts, Query(filters=(Filter(2, "contains", "1"),)))
    return occurrences.hits(parts, "A", columns=[1], within=within).agg(F.count("*").alias("hits"))


@query(r"select row_number() over (order by p_partkey) - 1 as row_id, 2 * len(regexp_extract_all(p_name, '\w+')) as hits, 0 as width from part")
def occ_06_zero_width(spark, d):
    found = occurrences.hits(_parts(spark, d), r"\b", literal=False, columns=[1])
    return found.groupBy(F.col("row").alias("row_id")).agg(F.count("*").alias("hits"), F.sum(F.col("end") - F.col("start")).alias("width"))


@query("with s as (select row_number() over (order by doc_id) - 1 as row_id, 2 * len(regexp_extract_all(text, 'ê')) as width from documents) select row_id, width from s where width > 0")
def occ_01_byte_widths(spark, d):
    found = occurrences.hits(_texts(spark, d), "ê", case_sensitive=True)
    return found.groupBy(F.col("row").alias("row_id")).agg(F.sum(F.col("end") - F.col("start")).alias("width"))


@query(r"select p_partkey from part where regexp_matches(p_name, '^\S+ \S+$') or regexp_matches(p_brand, '^\S+ \S+$') or regexp_matches(p_type, '^\S+ \S+$')")
def srch_06_within_one_cell(spark, d):
    return _keys(view.matching(_parts(spark, d), Query(r"^\S+ \S+$", regex=True)), "p_partkey")


@query("select cast(c_custkey as varchar) as key from customer where c_custkey % 3 = 0")
def srch_08_physical_fields(spark, d):
    key = F.col("c_custkey")
    line = F.concat(key.cast("string"), F.when(key % 3 == 0, ",").when(key % 3 == 1, "").otherwise(",x"))
    data = open_table(spark, _file(_table(spark, d, "customer"), "c_custkey", line, "customer.csv", "key,note"), kind="csv", delimiter=",")
    return view.matching(data, Query("^$", regex=True)).select(F.col("c0").alias("key"))


@query("select c_custkey from customer where contains(lower(c_mktsegment), 'build')")
def srch_10_hidden_columns(spark, d):
    data = from_frame(_table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"], ["c_custkey", "c_mktsegment"])
    data.hidden = {1}
    return _keys(view.matching(data, Query("BUILD", mode="text")), "c_custkey")


@query("select doc_id from documents where contains(lower(text), 'ss')")
def rgx_01_repeated_repetition(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    return _keys(view.matching(from_frame(docs, ["doc_id"], ["doc_id", "text"]), Query("s{1}{2}", regex=True)), "doc_id")


@query("""with h as (select c_custkey, md5(c_name) as h from customer)
select c_custkey, h[7:8] || h[5:6] || h[3:4] || h[1:2] || '-' || h[11:12] || h[9:10] || '-' || h[15:16] || h[13:14] || '-' || h[17:20] || '-' || h[21:32] as guid from h""")
def bin_05_guid(spark, d):
    return _table(spark, d, "customer").select("c_custkey", scalars.guid(F.unhex(F.md5(F.col("c_name").cast("binary")))).alias("guid"))


@query("select c_custkey, row_number() over (order by c_custkey % 33, c_custkey) - 1 as pos from customer")
def srt_05_russian(spark, d):
    letters = F.array(*(F.lit(x) for x in "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"))
    letter = F.get(letters, (F.col("c_custkey") % 33).cast("int"))
    customers = _table(spark, d, "customer").withColumn("v", F.when(F.col("c_custkey") % 2 == 0, F.upper(letter)).otherwise(letter))
    return _ranked(customers, [*order(F.col("v"), Kind.TEXT), F.col("c_custkey")], ["c_custkey"])


@query("select * from (values (0, 'a'), (1, 'a (2)'), (2, 'a (2) (2)'), (3, 'b')) t(place, name)")
def str_03_header_names(spark, d):
    key = F.col("n_nationkey").cast("string")
    data = open_table(spark, _file(_table(spark, d, "nation"), "n_nationkey", F.concat_ws(",", key, key, key, key), "nation.csv", "a,a,a (2),b"))
    return spark.createDataFrame(list(enumerate(data.headers)), "place int, name string")


@query("select * from (values (0, 'Столбец 1'), (1, 'Столбец 2')) t(place, name)")
def str_04_localised_names(spark, d):
    path = _file(_table(spark, d, "nation"), "n_nationkey", F.concat_ws(",", "n_nationkey", "n_name"), "nation.csv")
    data = open_table(spark, path, kind="csv", delimiter=",", header=False)
    return spark.createDataFrame(list(enumerate(localised(data.headers, data.generated, "ru"))), "place int, name string")


@query("select row_number() over (order by p_partkey) - 1 as row_id, p_name as line, 'python' as kind from part")
def src_17_code(spark, d):
    data = open_table(spark, _file(_table(spark, d, "part"), "p_partkey", F.col("p_name"), "part.py"))
    return _cells(data, "line").withColumn("kind", F.lit(data.kind))


@query("""with n as (select row_number() over (order by n_nationkey) - 1 as row_id, cast(n_nationkey as varchar) as key, n_name || 'Ж' as name from nation)
select 'utf-16le' as encoding, * from n union all select 'utf-16be', * from n union all select 'windows-1251', * from n""")
def src_18_encodings(spark, d):
    text = "key,name\n" + "".join(f"{r.n_nationkey},{r.n_name}Ж\n" for r in _nations(spark, d))
    out = None
    for encoding, codec, mark in (("utf-16le", "utf-16-le", "﻿"), ("utf-16be", "utf-16-be", "﻿"), ("windows-1251", "cp1251", "")):
        path = _local(spark, "nation.csv")
        with open(path, "wb") as f:
            f.write((mark + text).encode(codec))
        data = open_table(spark, path, kind="csv", delimiter=",", encoding=None if mark else encoding)
        rows = _cells(data, "key", "name").withColumn("encoding", F.lit(encoding))
        out = rows if out is None else out.union(rows)
    return out


@query("""select 'nation' as table_name, cast(n_nationkey as varchar) as nation, n_name, '' as region, '' as r_name from nation
union all select 'region', '', '', cast(r_regionkey as varchar), r_name from region""")
def src_13_sqlite(spark, d):
    path = _local(spark, "tables.db")
    db = sqlite3.connect(path)
    db.execute("create table nation (n_nationkey integer, n_name text)")
    db.execute("create table region (r_regionkey integer, r_name text)")
    db.executemany("insert into nation values (?, ?)", [(r.n_nationkey, r.n_name) for r in _nations(spark, d)])
    db.executemany("insert into region values (?, ?)", [(r.r_regionkey, r.r_name) for r in _table(spark, d, "region").collect()])
    db.commit()
    db.close()
    return _cells(open_table(spark, path), "table_name", "nation", "n_name", "region", "r_name").drop("row_id")


@query("""with t as (select string_agg(n_name, chr(10) order by n_nationkey) || chr(10) as s from nation), p as (select unnest(range(0, length(s), 32)) as place, s from t), q as (select place, s[place + 1:place + 32] as s from p)
select printf('%016X', place) as address, rtrim(regexp_replace(hex(encode(s)), '(..)', '\\1 ', 'g')) as bytes, replace(s, chr(10), '.') as text from q""")
def src_06_hex(spark, d):
    path = _file(_table(spark, d, "nation"), "n_nationkey", F.col("n_name"), "nation.txt")
    return _cells(open_table(spark, path, kind="hex"), "address", "bytes", "text").drop("row_id")


@query("""select n_name as name, strftime(timestamp '2001-01-01' + to_days(cast(n_nationkey as integer)), '%Y-%m-%dT%H:%M:%S') || '+00:00' as written, cast(n_nationkey * 64 as varchar) as number, '0x80000100 FILE_CREATE | CLOSE' as reason, cast(n_nationkey + 7 as varchar) as file from nation""")
def src_14_change_journal(spark, d):
    path = _local(spark, "journal.usn")
    with open(path, "wb") as f:
        for r in _nations(spark, d):
            name = r.n_name.encode("utf-16-le")
            length = -(-(60 + len(name)) // 8) * 8
            ticks = (978307200 + 11644473600 + r.n_nationkey * 86400) * 10**7
            f.write(struct.pack("<IHHQQQqIIIIHH", length, 2, 0, r.n_nationkey + 7, 5, r.n_nationkey * 64, ticks, 0x80000100, 0, 0, 0, len(name), 60) + name.ljust(length - 60, b"\0") + bytes(8))
    return _cells(open_table(spark, path, kind="usn"), "name", "written", "number", "reason", "file").drop("row_id")
