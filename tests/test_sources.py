import sqlite3
import struct

import pytest

from lodestone.operators.model import ROW, Filter, Kind, Query, Sort
from lodestone.operators.view import copy_range, export_csv, run, viewport
from lodestone.plans.session import Session, StaleError
from lodestone.sources import binary_tables, csv_table, detect, headers, json_table, xml_table
from lodestone.sources.open import irregular, open_table


def opened(spark, tmp_path, name, body, **options):
    path = tmp_path / name
    path.write_bytes(body if isinstance(body, bytes) else body.encode())
    return open_table(spark, str(path), **options)


def table(data):
    return [list(r)[1 : 1 + len(data.headers)] for r in data.df.orderBy(ROW).collect()]


def test_csv_with_mark_quotes_and_line_ends(spark, tmp_path):
    data = opened(spark, tmp_path, "a.csv", '\ufeffID,Text,Last\r\n1,"a\r\nb ""q""",\r\n\r\n2,c,d,e\r\n3\r\n')
    assert data.headers == ["ID", "Text", "Last", "Column 4"] and data.kind == "table"
    assert table(data) == [["1", 'a\r\nb "q"', "", ""], ["2", "c", "d", "e"], ["3", "", "", ""]]
    assert irregular(data) == 2 and data.generated == {3: "column"}


def test_csv_over_many_blocks(spark, tmp_path):
    rows = [(i, f"line {i}\nsecond, part" + '"' * (i % 3)) for i in range(3000)]
    body = "id,text\n" + "".join(f'{i},"{t.replace(chr(34), chr(34) * 2)}"\n' for i, t in rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        data = opened(spark, tmp_path, "b.csv", body)
        assert data.df.rdd.getNumPartitions() > 3
        assert table(data) == [[str(i), t] for i, t in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("body", ['a,b\n1,"open\n', 'a,b\n"x"y,2\n'])
def test_broken_quotes_are_errors(spark, tmp_path, body):
    with pytest.raises(Exception, match="quote"):
        table(opened(spark, tmp_path, "c.csv", body))


def test_delimiters_and_headers():
    assert [detect.delimiter(x) for x in ("a;b;c\n1;2;3", "a\tb\n1\t2", "a|b\n1|2", "plain\ntext")] == [";", "\t", "|", None]
    assert headers.unique(["a", "a", "a (2)", "a"]) == ["a", "a (2)", "a (2) (2)", "a (3)"]
    assert headers.localised(["Text", "Column 2 (2)", "Column 2"], {1: "column"}, "ru") == ["Text", "Столбец 2", "Column 2"]
    assert next(csv_table.Parser(";").feed_all('a;"b;c";d"e')) == ["a", "b;c", 'd"e']


def test_json_keeps_numbers_and_arrays(spark, tmp_path):
    data = opened(spark, tmp_path, "a.json", '[{"user":{"name":"x"},"n":9007199254740993.1200,"a/b":[1, 1.50]},{"late":null,"e":{}}]')
    assert data.headers == ["/user/name", "/n", "/a~1b", "/late", "/e"]
    assert table(data) == [["x", "9007199254740993.1200", "[1,1.50]", "", ""], ["", "", "", "null", "{}"]]
    lines = opened(spark, tmp_path, "a.jsonl", '\ufeff{"a":1}\n[1,2]\ntrue\n')
    assert lines.headers == ["/a", "value"] and table(lines) == [["1", ""], ["", "[1,2]"], ["", "true"]]
    for bad in ('[{"a":1},]', "[1] 2", '{"a":NaN}'):
        with pytest.raises(ValueError):
            list(json_table.documents(bad))


def test_text_code_and_ruler(spark, tmp_path):
    assert table(opened(spark, tmp_path, "a.txt", "\ufeffone\r\n\n\ufefftwo\n")) == [["one"], [""], ["\ufefftwo"]]
    code = opened(spark, tmp_path, "a.py", "a,b\nc,d\n")
    assert code.kind == "python" and table(code) == [["a,b"], ["c,d"]]
    ruler = "PID Name Path\n--- ---- ----\n1 a C:\\x y\n\n2 b z\n"
    assert table(opened(spark, tmp_path, "r.txt", ruler)) == [["1", "a", "C:\\x y"], ["2", "b", "z"]]
    assert len(opened(spark, tmp_path, "r.txt", ruler, auto_text=False).headers) == 1


def test_encodings(spark, tmp_path):
    assert table(opened(spark, tmp_path, "u.csv", "\ufeffимя,n\nЯна,1\n".encode("utf-16-le"))) == [["Яна", "1"]]
    assert table(opened(spark, tmp_path, "w.csv", "имя,n\nЯна,1\n".encode("cp1251"), encoding="windows-1251", kind="csv")) == [["Яна", "1"]]
    with pytest.raises(Exception):
        table(opened(spark, tmp_path, "bad.txt", b"ok\nbad \xff\xfe\n", kind="text"))


def test_xml():
    text = '<?xml version="1.0"?><!DOCTYPE r [<!ENTITY own "x">]><r a="1 &amp; &own;"><!--c--><e/>t&lt;<![CDATA[<d>]]><e> </e><?go on?></r>'
    got = list(xml_table.rows(text))
    assert got == [
        ("/", 'xml version="1.0"', "declaration"),
        ("/", 'r [<!ENTITY own "x">]', "doctype"),
        ("/r[1]", "", "element"),
        ("/r[1]/@a", "1 & &own;", "attribute"),
        ("/r[1]", "c", "comment"),
        ("/r[1]/e[1]", "", "element"),
        ("/r[1]", "t<<d>", "text"),
        ("/r[1]/e[2]", "", "element"),
        ("/r[1]/e[2]", " ", "whitespace"),
        ("/r[1]", "go on", "processing instruction"),
    ]
    for bad in ("<a>", "<a></b>", "<a>&x;</a>", "<a>&#invalid;</a>", "<a <b/>"):
        with pytest.raises(ValueError):
            list(xml_table.rows(bad))


def usn_record(name, version=2, reason=0x80000100):
    body = name.encode("utf-16-le")
    head = 60 if version == 2 else 76
    length = -(-(head + len(body)) // 8) * 8
    r = bytearray(length)
    struct.pack_into("<IHH", r, 0, length, version, 0)
    if version == 2:
        struct.pack_into("<QQqQI12xHH", r, 8, 11, 5, 77, 132537600000000000, reason, len(body), head)
    else:
        struct.pack_into("<qQI12xHH", r, 40, 77, 132537600000000000, reason, len(body), head)
    r[head : head + len(body)] = body
    return bytes(r)


def test_usn(spark, tmp_path):
    data = bytes(16) + usn_record("пример.exe") + usn_record("b", 3) + usn_record("c", 9)
    got = table(opened(spark, tmp_path, "j.usn", data))
    assert got[0] == ["пример.exe", "2020-12-30T00:00:00+00:00", "77", "0x80000100 FILE_CREATE | CLOSE", "11", "5", "2", "16"]
    assert got[1][0] == "b" and got[1][4] == " ".join(["00"] * 16) and got[2][3].startswith("Unsupported record version")
    with pytest.raises(ValueError):
        list(binary_tables.usn(b"\x08" + bytes(20)))


def test_sqlite(spark, tmp_path):
    path = tmp_path / "t.db"
    db = sqlite3.connect(path)
    db.execute('create table "a""b" (id integer, payload blob, note text)')
    db.execute('insert into "a""b" values (9007199254740993, x\'00FF\', null), (1, ?, cast(x\'ff41\' as text))', (b"readable text",))
    db.execute("create table z (x/*c*/)")
    db.commit()
    db.close()
    data = open_table(spark, str(path))
    assert data.headers == ["Table", "/id", "/payload", "$raw/payload", "/note", "$raw/note"] and data.hidden == {3, 5}
    assert table(data) == [['a"b', "9007199254740993", "00 FF", "00 FF", "", ""], ['a"b', "1", "readable text", "72 65 61 64 61 62 6C 65 20 74 65 78 74", "FF 41", "FF 41"]]


def test_hex_strings_and_fallback(spark, tmp_path):
    data = opened(spark, tmp_path, "x.bin", bytes(range(256)), kind="hex")
    assert len(table(data)) == 8 and table(data)[-1][0] == "00000000000000E0"
    url = "https://example.com/path?q=1".encode("utf-16-le")
    found = opened(spark, tmp_path, "y.bin", bytes([0x80, 0x81] * 8) + url + b"\0\0")
    assert found.kind == "binary" and table(found)[0] == ["0x10", str(len(url)), "UTF-16LE", "https://example.com/path?q=1"]
    long_ = bytes(100) + b"word " * 300
    assert b"".join(dict(r)["Text"].encode() for r in binary_tables.strings(long_, 512, 64)).replace(b" ", b"") == b"word" * 300
    broken = opened(spark, tmp_path, "z.dat", b"regf" + bytes(5000))
    assert broken.warnings and table(broken) is not None


def test_event_log_damage():
    data = b"ElfFile\0".ljust(4096, b"\0") + bytes(65536) + b"\x5a" * 65536 + b"\x5a" * 100
    assert [dict(r)["Parse error"] for r in binary_tables.event_log(data)] == ["Chunk at 69632: no chunk header", "Chunk at 135168: no chunk header"]


def test_session_query_sort_copy_export(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('Name,Count,Created\nfirst,100,31.12.2025\nsecond,2,02.01.2026\nthird,-3,2026-01-01T23:00:00-02:00\nfourth,2,2026-01-02T00:30:00Z\nempty,,\n')
    session = Session(spark)
    state = session.open(str(path))
    assert state.kinds == [Kind.TEXT, Kind.NUMBER, Kind.DATE]
    ids = lambda s: [r["row"] for r in session.rows(s.revision, 0, 256, [0])]
    by = lambda c, down: ids(session.query(Query(sort=Sort(c, down)), state.file))
    assert by(1, False) == [2, 1, 3, 0, 4] and by(1, True) == [0, 1, 3, 2, 4]
    assert by(2, False) == [0, 1, 3, 2, 4] and by(2, True) == [2, 3, 1, 0, 4]
    now = session.query(Query("F", filters=(Filter(1, "notEmpty"),), sort=Sort(1, True)), state.file)
    assert session.copy_range(now.revision, 0, 1, [1, 0]) == "100\tfirst\r\n2\tfourth"
    assert session.copy_range(now.revision, 0, 0, [0]) == "first"
    with pytest.raises(StaleError):
        session.rows(now.revision - 1, 0, 1, [0])
    for bad in (Query("[", regex=True), Query(filters=(Filter(9, "equals"),)), Query(filters=(Filter(0, "nope"),))):
        with pytest.raises(ValueError):
            session.query(bad, state.file)
    assert session.state is now
    assert session.cell(now.revision, 0, 2)["value"] == "31.12.2025"
    assert session.export(now.revision, str(tmp_path / "out.csv")) == 2
    assert (tmp_path / "out.csv").read_text() == "Name,Count,Created\nfirst,100,31.12.2025\nfourth,2,2026-01-02T00:30:00Z\n"
    with pytest.raises(ValueError):
        session.export(now.revision, str(path))
    again = run(state.data, Query())
    assert viewport(again, 3, 9, [1, 0])[0] == {"row": 3, "values": ["2", "fourth"]} and copy_range(again, 4, 4, [1]) == ""
    assert export_csv(again, str(tmp_path / "all.csv")) == 5


def test_records_end_at_any_line_end(spark, tmp_path):
    assert table(opened(spark, tmp_path, "r.csv", "a,b\r1,2\r3,4\r5,6\r")) == [["1", "2"], ["3", "4"], ["5", "6"]]
    assert table(opened(spark, tmp_path, "m.csv", 'a,b\n1,2\r3,4\r\n\r"5\r",6\n"7\n8",9\r10,11')) == [["1", "2"], ["3", "4"], ["5\r", "6"], ["7\n8", "9"], ["10", "11"]]


def test_records_equal_a_parser_of_one_pass(spark):
    """Random texts of quotes, line ends and delimiters, in blocks of few lines."""
    import random

    rng = random.Random(1)
    for _ in range(12):
        field = lambda: rng.choice(["x", "yy", "", '"q,\r\n""z"', '"\n"', '"a\r"'])
        text = "".join(",".join(field() for _ in range(rng.randint(1, 3))) + rng.choice(["\n", "\r\n", "\r", "\n\n", "\r\r"]) for _ in range(30))
        want = list(csv_table.Parser(",").feed_all(text))
        lines = text.split("\n")
        cut = sorted(rng.sample(range(1, len(lines)), 4))
        blocks = [(i, x) for i, (a, z) in enumerate(zip([0, *cut], [*cut, len(lines)])) for x in lines[a:z]]
        frame = spark.createDataFrame(blocks, "block long, value string").coalesce(1)
        got = csv_table.records(frame).orderBy("record").collect()
        assert [r.fields for r in got] == want and [r.record for r in got] == list(range(len(want)))


def test_autoruns_items(monkeypatch):
    text = lambda s: struct.pack("<I", len(s)) + s.encode("utf-16-le")
    streams = {("Header",): text("Autoruns") + b"\0\0\0\x09"}

    def item(number, **fields):
        streams.update({("Items", number, *k.split("/")): v for k, v in fields.items()})

    item("10", Name=text("last"), Flags=struct.pack("<I", 1))
    item("2", Name=text("Logon"), Flags=struct.pack("<I", 0x100))
    item("3", Name=text("HKLM\\Run"), Flags=struct.pack("<I", 0x1000))
    item("4", Name=text("tool"), TimeStamp=(132537600000000000).to_bytes(8, "little"), Payload=b"\x01\x02\xff", Category=text("own"))
    monkeypatch.setattr(binary_tables, "compound_streams", lambda data: streams)
    rows = [dict(r) for r in binary_tables.autoruns(b"")]
    assert [(r["Item"], r["Name"], r["Category (inferred 1)"], r["Location"]) for r in rows] == [("2", "Logon", "Logon", ""), ("3", "HKLM\\Run", "Logon", "HKLM\\Run"), ("4", "tool", "Logon", "HKLM\\Run"), ("10", "last", "Logon", "HKLM\\Run")]
    assert rows[2] | {"TimeStamp": "2020-12-30T00:00:00+00:00", "$raw/Payload": "01 02 FF", "Payload": "01 02 FF", "Category": "own", "Flags": ""} == rows[2]
    assert rows[0]["Flags"] == "0x00000100"
    streams[("Header",)] = b"xx"
    with pytest.raises(ValueError):
        next(binary_tables.autoruns(b""))


def hive(*lists):
    """A hive of one key whose list of keys below it holds the given offsets."""
    key = bytearray(80)
    key[:2] = b"nk"
    struct.pack_into("<HQ", key, 2, 0x20, 132537600000000000)
    struct.pack_into("<II", key, 20, len(lists), 0)
    struct.pack_into("<I", key, 28, 0x20 + 84)
    struct.pack_into("<H4s", key, 72, 3, b"")
    key[76:79] = b"Top"
    below = b"li" + struct.pack("<H", len(lists)) + b"".join(struct.pack("<I", x) for x in lists)
    cell = lambda body: struct.pack("<i", -(len(body) + 4)) + bytes(body)
    return b"regf" + bytes(32) + struct.pack("<I", 0x20) + bytes(4096 - 40) + bytes(0x20) + cell(key) + cell(below)


def test_registry_keys_and_cycles():
    (one,) = binary_tables.registry(hive())
    assert dict(one) | {"Key": "\\Top", "Type": "Key", "Last write": "2020-12-30T00:00:00+00:00", "Parse warning": ""} == dict(one)
    rows = [dict(r) for r in binary_tables.registry(hive(0x20, 0x9000))]
    assert [r["Parse warning"] != "" for r in rows] == [False, True, True] and "twice" in rows[1]["Parse warning"]
