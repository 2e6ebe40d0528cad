"""Filters, formats and path expressions on single values."""

import pytest
from pyspark.sql import functions as F

from tempora.functions import filters as C
from tempora.functions import formats as D
from tempora.functions import paths as P


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def keep(spark, values, kind, predicate):
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    return [r.c for r in df.where(predicate(F.col("c"))).collect()]


def test_id_filter(spark):
    ids = [1, 5, 7, 12, None]
    assert keep(spark, ids, "long", lambda c: C.id_filter(c, 1, (5, 7))) == [1, 5, 7]
    assert keep(spark, ids, "long", lambda c: C.id_filter(c, (7, 5))) == []
    assert keep(spark, ids, "long", lambda c: C.id_filter(c, "null", 12)) == [12, None]
    assert keep(spark, ids, "long", lambda c: C.id_filter(c, "NOT NULL")) == [1, 5, 7, 12]
    with pytest.raises(ValueError):
        C.id_filter(F.col("c"), "seven")


def test_date_bounds():
    assert C.date_bounds("1970-01-02") == (86400, 172799)
    assert C.date_bounds("1970-01-02 00:00:05") == (86405, 86405)
    assert C.date_bounds(("1970-01-01", 90000)) == (0, 90000)
    with pytest.raises(ValueError):
        C.date_bounds(("1970-01-03", "1970-01-02"))


def test_date_bounds_over_clock_changes():
    berlin = "Europe/Berlin"
    lo, hi = C.date_bounds("2024-10-27", berlin)
    assert hi - lo + 1 == 25 * 3600
    lo, hi = C.date_bounds("2024-03-31", berlin)
    assert hi - lo + 1 == 23 * 3600
    lo, hi = C.date_bounds(("2024-10-27 02:30:00", "2024-10-27 02:30:00"), berlin)
    assert hi - lo == 3600  # ambiguous: earliest start, latest end
    with pytest.raises(ValueError):
        C.date_bounds("2024-03-31 02:30:00", berlin)  # that time does not exist


def test_text_match_folds_ascii_only(spark):
    names = ["Résumé.PDF", "RESUME", "a%b", "a_b", "a\\b", None]
    assert keep(spark, names, "string", lambda c: C.string_filter(c, "résumé")) == ["Résumé.PDF"]
    assert keep(spark, names, "string", lambda c: C.string_filter(c, "RÉSUMÉ")) == []
    assert keep(spark, names, "string", lambda c: C.string_filter(c, "%")) == ["a%b"]
    assert keep(spark, names, "string", lambda c: C.string_filter(c, "A_B", wildcards=True)) == ["a%b", "a_b", "a\\b"]
    assert keep(spark, names, "string", lambda c: C.string_filter(c, "\\", wildcards=True)) == ["a\\b"]
    assert keep(spark, names, "string", lambda c: C.string_filter(c, "null")) == [None]


def test_enum_tokens():
    assert C.enum_code("item_type", " d ") == 1 and C.enum_code("scan_state", "analyzing scan") == 7
    assert C.enum_code("scan_state", "AnalyzingFiles") == 3 and C.enum_code("access", "readerror") == 2
    assert C.enum_code("hash_state", "V") == 1 and C.enum_code("val_state", "novalidator") == 3
    with pytest.raises(ValueError):
        C.enum_code("access", "good")


def test_hash_filter(spark):
    got = keep(spark, [bytes.fromhex("00ab12"), bytes.fromhex("ffff00"), None], "binary",
               lambda c: C.hash_filter(c, "aB1", "null"))
    assert got == [bytearray.fromhex("00ab12"), None]


@pytest.mark.parametrize("size,text", [
    (None, "N/A"), (0, "0 B"), (999, "999 B"), (1000, "1.0 KB (1000.00 B)"), (754451, "754.5 KB (736.77 KiB)"),
    (1250, "1.3 KB (1.22 KiB)"), (1150, "1.1 KB (1.12 KiB)"), (5 * 10**12, "5.0 TB (4.55 TiB)"),
    (1234567 * 10**10, "12345.7 TB (11228.32 TiB)"),
])
def test_size_format(spark, size, text):
    assert value(spark, D.format_size(F.lit(size).cast("long"))) == text


def test_small_formats(spark):
    assert value(spark, D.format_size_compact(F.lit(754451))) == "754.5 KB"
    assert value(spark, D.format_size_compact(F.lit(None).cast("long"))) == "—"
    assert [value(spark, D.format_elapsed(F.lit(s).cast("long"))) for s in (0, 59, 90, 3661)] == \
        ["0s", "59s", "1m 30s", "61m 1s"]
    assert value(spark, D.format_bool(F.lit(None).cast("boolean"))) == "-"
    assert value(spark, D.format_enum(F.lit(3), "scan_state")) == "AF"
    assert value(spark, D.format_enum(F.lit(None).cast("int"), "val_state", null="")) == ""
    assert value(spark, D.format_date(F.lit(86399).cast("long"), "full")) == "1970-01-01 23:59:59"
    assert value(spark, D.format_real(F.lit(2.0 / 3))) == "0.67"
    assert value(spark, D.format_real(F.lit(1234567.5))) == "1234567.50"


def test_task_state_json(spark):
    n = F.lit(None).cast("long")
    got = [value(spark, D.task_state_json(*p)) for p in (
        (F.lit(4), F.lit(9)), (F.lit(4), n), (n, F.lit(9)), (n, n))]
    assert got == ['{"scan_id":4,"high_water_mark":9}', '{"scan_id":4,"high_water_mark":0}', '{"high_water_mark":9}', None]
    assert value(spark, D.json_long(F.lit('{"scan_id": 12}'), "scan_id")) == 12


@pytest.mark.parametrize("path,name,parent", [
    ("/a/b/c.txt", "c.txt", "/a/b"), ("/a", "a", "/"), ("/", "/", "/"), ("/a/b/", "b", "/a"), ("..", "..", "/"),
])
def test_names_and_parents(spark, path, name, parent):
    assert value(spark, P.path_name(F.lit(path))) == name
    assert value(spark, P.parent_path(F.lit(path))) == parent


def test_extension(spark):
    got = [value(spark, P.file_extension(F.lit(n))) for n in ("a.JPG", ".hidden", "none", "x.tar.gz", "dot.", ".a.b")]
    assert got == ["jpg", None, None, "gz", "", "b"]
    assert value(spark, P.file_extension(F.lit("d.jpg"), F.lit(1))) is None
    assert value(spark, P.has_validator(F.lit(None).cast("string"))) is False


def test_tree_helpers(spark):
    assert value(spark, P.ancestor_chain(F.lit("/home"), F.lit("/home/a/b/c"))) == ["/home/a", "/home/a/b"]
    assert value(spark, P.ancestor_chain(F.lit("/home/"), F.lit("/home/a"))) == []
    assert value(spark, P.ancestor_chain(F.lit("/home"), F.lit("/home"))) == []
    child = [value(spark, P.is_immediate_child(F.lit(c), F.lit(p))) for c, p in (
        ("/a/b/c", "/a/b"), ("/a/b/c/d", "/a/b"), ("/a/b", "/a"), ("/x/y", "/a"))]
    assert child == [True, False, True, False]
    assert value(spark, P.short_path(F.lit("/abc/def/file.txt"))) == "/a/d/file.txt"


@pytest.mark.parametrize("ordered", [
    ["/a", "/a/b", "/a!/b"], ["/p/file2", "/p/file10", "/p/file100"], ["/proj", "/proj/a", "/proj-old"],
    ["/x/Apple", "/x/banana", "/x/Cherry"], ["/x/" + "9" * 31, "/x/1" + "0" * 31],
    ["/x/5", "/x/" + "7" * 50, "/x/1" + "0" * 50], ["/x/a007", "/x/a8", "/x/a08b"], ["/x/v1.2", "/x/v1.10", "/x/v2.1"], ["/x/cafe1", "/x/café2", "/x/cafe3"],
])
def test_natural_order(spark, ordered):
    df = spark.createDataFrame([(p,) for p in reversed(ordered)], "p string")
    assert [r.p for r in df.orderBy(P.natural_key(F.col("p"))).collect()] == ordered


def test_paths_are_cut_without_lambdas_and_line_ends_keep_their_meaning(spark):
    texts = ["/a/b.JPG", "a//b/", "/", "", "//x", "/a/..", "/.jpg", "/a/b.c.Txt", "/a/b.jpg\n", "/a/\n", "/a.b/c", None]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    p = F.col("p")
    out = df.select(P.parent_path(p).alias("up"), P.path_name(p).alias("name"), P.file_extension(P.path_name(p)).alias("ext"))
    assert [tuple(r) for r in out.collect()] == [
        ("/a", "b.JPG", "jpg"), ("/a", "b", None), ("/", "/", None), ("/", "", None), ("/", "x", None), ("/a", "/a/..", ""),
        ("/", ".jpg", None), ("/a", "b.c.Txt", "txt"), ("/a", "b.jpg\n", "jpg\n"), ("/a", "a\n", None), ("/a.b", "c", None), ("/", None, None)]
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
