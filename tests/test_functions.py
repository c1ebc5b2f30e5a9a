"""Scalar functions against literal expectations."""

import pytest
from pyspark.sql import functions as F

from quire.functions import dates, globs, ids, status, text
from quire.operators import filters
from quire.plans.queries import QUERIES


def apply(spark, f, *values, kind="string"):
    names = [f"c{i}" for i in range(len(values[0]))] if isinstance(values[0], tuple) else ["c0"]
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + ", ".join(f"{n} {kind}" for n in names))
    return [r[0] for r in df.orderBy("i").select(f(*map(F.col, names))).collect()]


@pytest.mark.parametrize("given,want", [
    ("Thu May  1 17:27:09 1997", "1997-05-01T17:27:09Z"), ("Tue Jan 27 17:03:21 2004", "2004-01-27T17:03:21Z"), ("1705133865", "2024-01-13T08:17:45Z"), ("1705133865000", "2024-01-13T08:17:45Z"),
    ("202312312359", "2023-12-31T23:59:00Z"), ("20231231235959", "2023-12-31T23:59:59Z"), ("20231231235959123", "2023-12-31T23:59:59.123Z"), ("20231231", "2023-12-31T00:00:00Z"), ("999999999999999", None), ("Thu May  0:00:00 17:37:52 1997", None),
    ("Tue, 3 Jun 2008 11:05:30 GMT", "2008-06-03T11:05:30Z"), ("3 Jun 2008 11:05:30 +0200", "2008-06-03T09:05:30Z"), ("", None), (None, None), ("20231340", None),
])
def test_fallback_dates(spark, given, want):
    assert apply(spark, lambda c: dates.format_instant(dates.parse_fallback(c)), given) == [want]


def test_strict_instants(spark):
    given = ["2023-05-30T13:35:06+01:00", "2015-06-03", "2015-06-03T10:00:00", "2015-06-03T10:00:00.5Z", "2015", "2015-06", "2015-6-3", "2015-06-03 10:00:00", None]
    assert apply(spark, lambda c: dates.format_instant(dates.parse_instant(c)), *given) == ["2023-05-30T12:35:06Z", "2015-06-03T00:00:00Z", "2015-06-03T10:00:00Z", "2015-06-03T10:00:00.500Z"] + [None] * 5


def test_single_dates_are_noon_and_far_years_count(spark):
    given = ["2011-12-03+01:00", "2015-06-03", "19106-06-07T08:00:00Z", "2015-06-03T08:00:00Z", "alpha"]
    assert apply(spark, dates.normalise_date, *given) == ["2011-12-03T12:00:00Z", "2015-06-03T12:00:00Z", "+19106-06-07T08:00:00Z", "2015-06-03T08:00:00Z", None]


def test_multi_dates(spark):
    df = spark.createDataFrame([(["2015-06-03", "2016-01-01"],), (["2015-06-03", "beta"],)], "v array<string>")
    assert [r[0] for r in df.select(dates.multi_date(F.col("v"))).collect()] == [["2015-06-03T00:00:00Z", "2016-01-01T00:00:00Z"], None]


def test_durations(spark):
    assert apply(spark, text.parse_duration, "500ms", "60s", "60m", "1h", "1d", "500", "ms", "500y", None) == [500, 60_000, 3_600_000, 3_600_000, 86_400_000, 500, None, None, None]
    assert apply(spark, text.format_duration, 500, 61_000, 3_600_000, 90_000_000, 0, kind="bigint") == ["500ms", "1m", "1h", "1d", "0ms"]


def test_durations_of_odd_texts_and_long_ones(spark):
    assert apply(spark, text.parse_duration, "", " 5m", "-5m", "5sm", "5d5", "05h", "5m\n", "9223372036854775808") == [None] * 5 + [18_000_000, 300_000, None]
    assert apply(spark, text.format_duration, 106_751_991_167 * 86_400_000 - 1, None, -5, kind="bigint") == ["106751991166d", None, "-5ms"]
    assert apply(spark, text.format_duration, 61_000.9, 86_400_000.0, kind="double") == ["1m", "1d"]


def test_the_query_of_durations_is_small_enough_to_be_compiled(spark, tmp_path):
    """HotSpot only interprets methods of more than 8000 bytes; each text is matched once for its number and once for its unit."""
    rows = [(1, 1, 17.0, "A"), (1, 2, 30.0, "N"), (1, 3, 23.0, "N"), (2, 1, 5.0, "R"), (2, 2, 0.0, "A"), (2, 3, None, "A")]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES["human_duration"](spark, str(tmp_path))
    assert [tuple(r)[2:] for r in df.orderBy("l_orderkey", "l_linenumber").collect()] == [(1_020_000, "17m"), (108_000_000, "1d"), (82_800_000, "23h"), (432_000_000, "5d"), (0, "0ms"), (None, None)]
    plan = df._jdf.queryExecution().executedPlan()
    assert plan.toString().lower().count("regexp_extract") + plan.toString().lower().count("rlike") == 2
    stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
    assert 0 < max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000


def test_booleans_and_statuses(spark):
    assert apply(spark, text.parse_boolean, "Yes", "on", "TRUE", "1", "no", "off", "false", "0", "perhaps") == [True] * 4 + [False] * 4 + [None]
    assert apply(spark, status.parse_status, "0", "10", "success", "FAILURE_TIMEOUT", "7", "x") == [0, 10, 0, 11, None, None]


@pytest.mark.parametrize("exception,cause,stage,code", [
    (None, None, "parse", 0), ("java.util.concurrent.TimeoutException", None, "parse", 11), ("InterruptedException", None, "parse", 8), ("java.io.IOException", None, "save", 9), ("java.io.IOException", None, "transform", 4),
    ("java.io.FileNotFoundException", None, "parse", 1), ("java.nio.file.NoSuchFileException", None, "parse", 1), ("IllegalStateException", None, "parse", 8), ("EncryptedDocumentException", None, "parse", 3), ("IOException", "EncryptedDocumentException", "parse", 3),
    ("TikaException", None, "parse", 4), ("java.io.IOException", None, "parse", 2), ("java.lang.OutOfMemoryError", None, "parse", 10),
    ("MemoryError", None, "parse", 10), ("ConnectionRefusedError", None, "save", 9), ("ValueError", None, "save", 9), ("RuntimeError", None, "parse", 8),
])
def test_classification(spark, exception, cause, stage, code):
    assert apply(spark, status.classify, (exception, cause, stage)) == [code]


def test_block_list_and_noise(spark):
    p = text.METADATA_PREFIX
    fields = ["unknown_tag_0x1", "custom_a", "mboxparser_status", "xmpmm_id", "message_raw_header_a_b", "message_raw_header_7x", "message_raw_header__", "message_raw_header_ab_c", "message_raw_header__x", "chroma_black", "xunknown_tag_1"]
    assert apply(spark, filters.blocked_field, *[p + f for f in fields]) == [True] * 7 + [False] * 4
    lines = [("org.apache.pdfbox.x", "WARN", f"a {n} b") for n in filters.NOISE] + [("org.apache.fontbox.y", "INFO", "No Unicode mapping"), ("my.org.apache.pdfbox", "WARN", "No current font"), ("org.apache.pdfbox", "ERROR", "No current font"), ("org.apache.pdfbox", "WARN", "Invalid ToUnicode CMap"), (None, "WARN", "No current font"), ("org.apache.pdfbox", "WARN", None)]
    assert apply(spark, filters.log_noise, *lines) == [True] * 5 + [False] * 5
    with pytest.raises(Exception, match="not a boolean"):
        apply(spark, lambda c: text.parse_boolean(c, True), "perhaps")
    assert apply(spark, lambda c: text.parse_boolean(c, True), "on", None) == [True, None]


def test_ids(spark):
    assert apply(spark, lambda d, p, r, n: ids.embed_id(d, p, r, n), ("d", "p", "0", "n"), ("d", "p", "1", "n"), (None, "p", "0", "n"))[:2] != [None, None]
    a, b, c = apply(spark, lambda d, p, r, n: ids.embed_id(d, p, r, n), ("1", "23", "0", None), ("123", None, "0", None), ("123", None, "1", None))
    assert a == b != c
    assert apply(spark, lambda c: ids.shorten(c, 2), "abcdef") == ["ab...ef"]
    assert apply(spark, ids.is_content_addressable, "abc", "abcd", "ABCD", "0123456789abcdef", "xyz1") == [False, True, False, True, False]
    assert apply(spark, ids.artifact_path, "abcdef") == ["ab/cd/abcdef/raw"]
    assert apply(spark, ids.digests_untranslated, "Parser 3.2.3", "3.2.4", "2.9", "4.0.0") == [True, False, True, False]
    with pytest.raises(ValueError):
        ids.digest(F.lit("x"), "CRC")


def test_paths_and_types(spark):
    assert apply(spark, text.parent_path, "test/file.txt", "/a", "file", "/", "/a/b/", "/a/b/c") == ["test", "/", "", "", "/a", "/a/b"]
    assert apply(spark, text.base_type, "text/plain; charset=UTF-8", "Text/HTML", "nonsense") == ["text/plain", "text/html", "nonsense"]
    assert apply(spark, text.field_name, "dcterms:created", "X-Y z") == ["tika_metadata_dcterms_created", "tika_metadata_x_y_z"]
    assert apply(spark, text.restore_ocr_type, "image/ocr-png") == ["image/png"]


def test_markup(spark):
    assert apply(spark, lambda c: text.html_escape(c, True), '<a & "b">') == ["&lt;a &amp; &quot;b&quot;&gt;"]
    assert apply(spark, lambda c: text.data_uri(F.lit("text/plain"), c), "a b*ü") == ["data:text/plain,a+b*%C3%BC"]
    assert apply(spark, lambda c: text.data_uri(F.lit("image/png"), c), "abc") == ["data:image/png;base64,YWJj"]
    tokens = lambda c: text.replace_tokens(c, "${", "}", F.create_map(F.lit("x"), F.lit("1")))
    assert apply(spark, tokens, "a ${x} ${y} ${x}", "none") == ["a 1 ${y} 1", "none"]


def test_previews(spark):
    assert apply(spark, lambda c: text.preview(c, 3), "abcdef", "abc", None) == ["abc… (3 other characters)", "abc", None]
    assert apply(spark, lambda e, x, u: text.progress_line(e.cast("bigint"), x.cast("bigint"), u.cast("bigint")), ("300", "4", "3"), ("5", None, "1"), ("5", "-1", "1")) == ["300/~400 embeds (~75%)", "5 embeds", "5 embeds"]


@pytest.mark.parametrize("pattern,yes,no", [
    ("*.txt", ["a.txt", ".txt"], ["d/a.txt", "a.txtx"]), ("**.txt", ["a.txt", "d/e/a.txt"], ["a.doc"]), ("/a/?/c", ["/a/b/c"], ["/a/bb/c", "/a//c"]), ("*.{txt,md}", ["x.md", "x.txt"], ["x.doc"]), ("[!a-c]x", ["dx"], ["ax", "/x"]),
    ("[a-c]x", ["bx"], ["dx"]), ("\\*x", ["*x"], ["ax"]), ("a.b", ["a.b"], ["aXb"]), ("tika_metadata_*unknown_tag*", ["tika_metadata_unknown_tag_0x1"], ["tika_metadata_dcterms_created"]),
])
def test_globs(spark, pattern, yes, no):
    assert apply(spark, lambda c: globs.matches(c, [pattern]), *yes, *no) == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize("bad", ["[a", "{a", "a\\", "{a{b}}"])
def test_bad_globs(bad):
    with pytest.raises(ValueError):
        globs.glob_regex(bad)


def test_path_filters(spark):
    paths = ["/a/b.txt", "/a/.h", "/.d/x", "/a/Thumbs.db", "/lost+found/t", "/a/._x", "/a/c/d.doc"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    left = lambda **o: {r.path for r in filters.wanted(df, **o).collect()}
    assert left() == {"/a/b.txt", "/a/.h", "/.d/x", "/a/c/d.doc"}
    assert left(ignore_hidden=True) == {"/a/b.txt", "/a/c/d.doc"}
    assert left(ignore_system=False, include_globs=["**.txt"]) == {"/a/b.txt"}
    assert left(exclude_globs=["/a/c"]) == {"/a/b.txt", "/a/.h", "/.d/x"}


def test_guards(spark):
    assert apply(spark, lambda c: filters.too_large(c, 100), "101", "100", " 101 ", "NaN", "1.5e9", None, "9" * 50, "-" + "9" * 50) == [True, False, True, False, False, False, True, False]
    assert apply(spark, lambda c: filters.too_large(c, 0), "101") == [False]
    assert apply(spark, lambda c: filters.too_deep(c, 2), 2, 3, kind="int") == [False, True]
    assert apply(spark, lambda t, r, n: filters.ocr_eligible(t, r, n, 10), ("image/png", None, "9"), ("image/png", None, None), ("image/png", "INLINE", "99"), ("text/plain", None, "99")) == [False, True, False, False]
