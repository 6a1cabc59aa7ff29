import decimal
import random
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F

from lodestone.functions import binary_text, regexes, scalars
from lodestone.operators import occurrences
from lodestone.operators.model import Kind, Query, from_frame
from lodestone.operators.search import QueryError, parsed
from lodestone.operators.sort import arranged, order
from lodestone.operators.view import matching


def column(spark, values, value):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(value(F.col("v"))).collect()]


def test_numbers(spark):
    given = ["1\u00a0234,50", " 12 ", "-0.002", "1.2e1", ".5", "5.", "1,2,3", "1,234.5", "1e400", "1d", "inf", "", "+7"]
    assert column(spark, given, scalars.number) == [1234.5, 12.0, -0.002, 12.0, 0.5, 5.0, None, None, None, None, None, None, 7.0]


def test_number_order_is_exact(spark):
    rng = random.Random(1)
    values = ["9007199254740993", "9007199254740992", "1.20001", "1.2", "-0.002", "-10", "1.2e1", "0", "-0", "00012", "12.0"]
    values += [f"{rng.choice(['', '-'])}{rng.randrange(10**rng.randint(1, 25))}e{rng.randint(-30, 30)}" for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = [r.i for r in arranged(rows, [*order(F.col("v"), Kind.NUMBER), F.col("i")]).collect()]
    assert got == sorted(range(len(values)), key=lambda i: (decimal.Decimal(values[i]), i))


def test_dates(spark):
    second = lambda c: scalars.date(c)["second"]
    given = ["31.02.2026", "03/04/2026", "2026-04-03", "2026-04-03 00:00:00 UTC", "2026-04-03T02:00:00+02:00", "2026-04-03 02:00:00 +0200", "Fri, 3 Apr 2026 02:00:00 +0200", "03-04-2026 00:00", "2026-04-03 24:00", "1601-01-01", "x"]
    day = 1775174400
    assert column(spark, given, second) == [None, day, day, day, day, day, day, None, None, -11644473600, None]
    stamps = column(spark, ["1700000000", "-5", "1700000000123", "1700000000123456", "1700000000123456789", "12345678901", "2026-04-03"], scalars.timestamp)
    assert [None if s is None else (s.second, s.nano) for s in stamps] == [(1700000000, 0), (-5, 0), (1700000000, 123000000), (1700000000, 123456000), (1700000000, 123456789), None, (day, 0)]
    nanos = column(spark, ["2020-01-01T00:00:00.000000002Z", "2020-01-01T00:00:00.5Z"], lambda c: scalars.date(c)["nano"])
    assert nanos == [2, 500000000]


def natural(a, b):
    """Byte by byte, but runs of digits by value."""
    import re

    shift = str.maketrans(scalars._RUSSIAN, scalars._SHIFTED)

    def items(s):
        for part in re.findall("[0-9]+|[^0-9]+", s.strip().lower().translate(shift)):
            if part[0] in "0123456789":
                yield (0x30, int(part))
            else:
                yield from ((c, 0) for c in part.encode())

    x, y = list(items(a)), list(items(b))
    return (x > y) - (x < y)


def test_text_order(spark):
    values = ["Яна", "Ёж", "Егор", "Аня", "борис", "файл10", "файл2", "еж"]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    assert [r.i for r in arranged(rows, [*order(F.col("v"), Kind.TEXT), F.col("i")]).collect()] == [3, 4, 2, 7, 1, 6, 5, 0]
    rng = random.Random(2)
    values = ["".join(rng.choices("aЕё10 2b🙂", k=rng.randint(1, 6))) for _ in range(300)]
    values = [v for v in values if v.strip()]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = [values[r.i] for r in arranged(rows, [*order(F.col("v"), Kind.TEXT), F.col("i")]).collect()]
    want = sorted(values, key=cmp_to_key(natural))
    assert [(a, b) for a, b in zip(got, want) if natural(a, b)] == []


@pytest.mark.parametrize(("pattern", "text", "hit"), [("процесс", "ПРОЦЕСС", True), ("c$", "abc\n", False), ("a.b", "a\rb", True), (r"\d", "٣", True), ("(?m)^b$", "a\nb\nc", True), ("(?-i)A", "a", False), (r"\bяб\b", "то яб вот", True), ("[a-z--[b]]", "b", False), (r"x{2,3}y", "xxy", True), (r"\.exe|\/z", "b/z", True), ("[[:digit:]]", "٣", False), (r"\p{Greek}", "λ", True)])
def test_regex_dialect(spark, pattern, text, hit):
    import regex

    assert spark.range(1).select(F.lit(text).rlike(regexes.java(pattern))).first()[0] is hit
    assert bool(regex.search(regexes.python(pattern), text)) is hit


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", r"(a)\1", "*a", "[a", "(a", "a)", r"\Qa", "(?U)a", "(?>a)"])
def test_refused_patterns(pattern):
    with pytest.raises(regexes.PatternError):
        regexes.java(pattern)


def test_search_language(spark):
    assert parsed(Query("ext:EXE;.jar regex:(?i)meteor")) == (["exe", "jar"], "(?i)meteor")
    assert parsed(Query(" a.b ")) == ([], r"a\.b") and parsed(Query("(?i)a")) == ([], "(?i)a")
    assert parsed(Query(" a.b ", mode="text")) == ([], r" a\.b ")
    for bad in ("ext:", "ext:a/b"):
        with pytest.raises(QueryError):
            parsed(Query(bad))
    data = from_frame(spark.createDataFrame([(0, "C:\\normal.exe", "meteor.txt"), (1, '"D:/x/METEOR.JAR:s"', ""), (2, "", "")], "i int, a string, b string"), ["i"])
    ids = lambda q: [r["__row_id"] for r in matching(data, Query(q)).orderBy("__row_id").collect()]
    assert ids("ext:exe;jar regex:(?i)meteor") == [1] and ids("ext:exe") == [0] and ids("METEOR") == [0, 1] and ids("") == [0, 1, 2]


def test_occurrences(spark):
    data = from_frame(spark.createDataFrame([(0, "ПРОЦЕСС", "Процесс процесс"), (1, "x.x", "xy")], "i int, a string, b string"), ["i"])
    found = lambda *a, **k: [tuple(r) for r in occurrences.hit_page(occurrences.hits(data, *a, **k), 0, 99).collect()]
    assert len(found("процесс")) == 3 and found("процесс", case_sensitive=True) == [(0, 1, 15, 29)]
    assert found("^процесс$", literal=False) == [(0, 0, 0, 14)]
    assert found(".") == [(1, 0, 1, 2)] and len(found("^", literal=False)) == 4
    assert occurrences.counts(occurrences.hits(data, "x")) == {"hits": 3, "rows": 1}
    aaa = from_frame(spark.createDataFrame([(0, "aaa")], "i int, a string"), ["i"])
    assert [tuple(r) for r in occurrences.hits(aaa, "a*", literal=False).collect()] == [(0, 0, 0, 3)]
    with pytest.raises(ValueError):
        occurrences.hits(data, "")


def test_strings_in_bytes():
    for encoding, name in (("utf-8", "UTF-8"), ("utf-16-le", "UTF-16LE"), ("utf-16-be", "UTF-16BE")):
        for offset in (0, 1, 6, 7):
            for text in ("Process started: 42", "Привет, мир снова"):
                body = text.encode(encoding)
                data = bytes([0x81, 0x1F] * 4)[:offset] + body + b"\x00\x00\x81\x1f"
                got = binary_text.spans(data)
                assert {"offset": offset, "len": len(body), "encoding": name, "text": text} in got
    assert binary_text.spans(bytes(range(128, 192)) * 4) == []
    assert binary_text.readable(b"\xef\xbb\xbfline one\r\nline two\0\0") == "line one\r\nline two"
    assert binary_text.readable(bytes(8)) is None


@pytest.mark.parametrize(("given", "want"), [("48 65 6C 6C 6F", "Hello"), ("0x48,0x65, 0x6c 0x6c", "Hell"), (r"\x48\x65\x6c\x6c", "Hell"), (r"\x48656c6c", "Hell"), ("X'48656c6c'", "Hell"), ("[48, 65, 6C, 6C]", "Hell"), ("48656c6c6f20776f726c64", "Hello world"), ("cafe", None), ("48656c6c", None), ("48 65 6", None), ("48 65 6c", None), ("48:65:6c:6c", None), ("48 65,, 6c 6c", None), ("0x48 65 6c 6c", None)])
def test_hexadecimal_spellings(given, want):
    assert binary_text.readable_hex(given) == want


def test_repetitions_of_repetitions(spark):
    import re

    import regex

    cases = {r"^a{2}{3}$": "^(?:a{2}){3}$", r"^a**$": "^(?:a*)*$", r"^ba++$": "^b(?:a+)+$", r"^(ab)?{2}$": "^(?:(ab)?){2}$", r"^[ab]{2}+c$": "^(?:[ab]{2})+c$", r"^(a(b)){1}{2}$": "^(?:(a(b)){1}){2}$"}
    texts = ["", "a", "aa", "aaaa", "aaaaaa", "ba", "baa", "ab", "abab", "ababab", "abc", "ababc", "abac"]
    for given, plain in cases.items():
        for text in texts:
            hit = re.search(plain, text) is not None
            assert (regex.search(regexes.python(given), text) is not None) is hit, (given, text)
        got = column(spark, texts, lambda v, p=regexes.java(given): v.rlike(p))
        assert got == [re.search(plain, t) is not None for t in texts], given


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/St_Johns"])
def test_times_do_not_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        ticks = [116444736000000000, 0, 132537600000000000 + 1234567, 1, 116444735999999990]
        rows = spark.createDataFrame(list(enumerate(ticks)), "i int, t long").orderBy("i")
        assert [r[0] for r in rows.select(scalars.filetime(F.col("t"))).collect()] == ["1970-01-01T00:00:00+00:00", "", "2020-12-30T00:00:00.123456700+00:00", "1601-01-01T00:00:00.000000100+00:00", "1969-12-31T23:59:59.999999+00:00"]
        days = [25569.0, 0.0, 2.5, -1.25, 36526.75]
        rows = spark.createDataFrame(list(enumerate(days)), "i int, t double").orderBy("i")
        assert [r[0] for r in rows.select(scalars.ole_date(F.col("t"))).collect()] == ["1970-01-01T00:00:00+00:00", "1899-12-30T00:00:00+00:00", "1900-01-01T12:00:00+00:00", "1899-12-29T06:00:00+00:00", "2000-01-01T18:00:00+00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_ole_dates_past_the_year_9999(spark, tmp_path):
    from lodestone.plans import queries

    days = [2958465.25, 2958466.25, 9000000.5, 95051805.0, 95051806.0, -96439723.0, -96439724.0, float("nan"), float("inf"), None]
    rows = spark.createDataFrame(list(enumerate(days)), "i int, t double").orderBy("i")
    assert [r[0] for r in rows.select(scalars.ole_date(F.col("t"))).collect()] == ["9999-12-31T06:00:00+00:00", "+10000-01-01T06:00:00+00:00", "+26541-02-27T12:00:00+00:00", "+262142-12-31T00:00:00+00:00", "9.5051806E7", "-262143-01-01T00:00:00+00:00", "-9.6439724E7", "NaN", "Infinity", None]
    keys = [0, 2958466, 8999999]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    found = {r["o_orderkey"]: r["at"] for r in queries.queries()["dat_04_ole_date"](spark, str(tmp_path)).collect()}
    assert found == {0: "1899-12-30T06:00:00+00:00", 2958466: "10000-01-01T06:00:00+00:00", 8999999: "26541-02-26T06:00:00+00:00"}
