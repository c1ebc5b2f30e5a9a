"""Sources, parsers, sinks, streaming and commands on generated files."""

import base64
import gzip
import http.server
import io
import json
import os
import tarfile
import threading
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire import cli
from quire.plans import ingest as plans
from quire.plans.ingest import ingest
from quire.sinks import outputs
from quire.sources import dumps, parsers
from quire.sources.walk import count_files, walk
from quire.streaming import drain


@pytest.fixture
def files(tmp_path):
    for name, text in {"a.txt": "alpha", ".hidden": "h", "_under": "u", "empty": "", "Thumbs.db": "x", "lost+found/t": "t", "d/b.txt": "beta", "d/e/c.md": "gamma", "d/._x": "x", ".git/config": "g"}.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    os.symlink(tmp_path / "tree/a.txt", tmp_path / "tree/link")
    os.symlink(tmp_path / "tree/d", tmp_path / "tree/loop")
    os.symlink(tmp_path / "nowhere", tmp_path / "tree/dangling")
    return tmp_path / "tree"


def names(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.where("error is null").collect())


def test_walk(spark, files):
    root = [str(files)]
    assert names(walk(spark, root), files) == [".git/config", ".hidden", "_under", "a.txt", "d/b.txt", "d/e/c.md", "empty"]
    assert names(walk(spark, root, ignore_hidden=True), files) == ["_under", "a.txt", "d/b.txt", "d/e/c.md", "empty"]
    assert names(walk(spark, root, include=("**.txt",)), files) == ["a.txt", "d/b.txt"]
    assert names(walk(spark, root, exclude=(f"{files}/d",)), files) == [".git/config", ".hidden", "_under", "a.txt", "empty"]
    assert names(walk(spark, root, max_depth=1), files) == [".hidden", "_under", "a.txt", "empty"]
    assert names(walk(spark, root, max_depth=2, ignore_system=False), files) == [".git/config", ".hidden", "Thumbs.db", "_under", "a.txt", "d/._x", "d/b.txt", "empty", "lost+found/t"]
    linked = walk(spark, root, follow_links=True)
    assert {"link", "loop/b.txt"} <= set(names(linked, files)) and linked.where("error is not null").count() == 1
    assert names(walk(spark, [str(files / "a.txt"), str(files / "d/e")]), files) == ["a.txt", "d/e/c.md"]
    assert walk(spark, [str(files / "missing")]).where("error is not null").count() == 1
    assert count_files(spark, root) == 7
    assert {r.depth for r in walk(spark, root).collect()} == {1, 2, 3}


def test_dumps(spark, tmp_path):
    (tmp_path / "q.json").write_text('[\n "/a",\n "/b \\"q\\""\n]')
    assert sorted(r.path for r in dumps.queue_from_json(spark, str(tmp_path / "q.json")).collect()) == ["/a", '/b "q"']
    (tmp_path / "q.csv").write_text('id,where\n1,"/a,\nb"\n2,"say ""x"""\n')
    assert sorted(r.path for r in dumps.queue_from_csv(spark, str(tmp_path / "q.csv"), "where").collect()) == ["/a,\nb", 'say "x"']
    (tmp_path / "r.json").write_text('{"/a": 0, "/b": 11}')
    rep = dumps.report_from_json(spark, str(tmp_path / "r.json"))
    assert sorted(map(tuple, rep.collect())) == [("/a", 0), ("/b", 11)]


def test_dumps_are_written_and_read_line_by_line(spark, tmp_path):
    paths = ["/a", '/b "q"', "/c\nd", "/é\\,", "/[x]"]
    rep = spark.createDataFrame([(p, i) for i, p in enumerate(paths)] + [(None, 3)], "path string, code int").repartition(3)
    for lines, brackets, name in ((dumps.queue_lines(rep), "[]", "q"), (dumps.report_lines(rep), "{}", "r"), (dumps.report_lines(rep, 9), "{}", "none"), (dumps.report_lines(rep, 1), "{}", "one")):
        with open(tmp_path / name, "w", encoding="utf-8") as f:
            dumps.write_json(lines, f, brackets)
    assert json.loads((tmp_path / "q").read_text()) == sorted(paths) and json.loads((tmp_path / "r").read_text()) == {p: i for i, p in enumerate(paths)}
    assert json.loads((tmp_path / "none").read_text()) == {} and json.loads((tmp_path / "one").read_text()) == {'/b "q"': 1}
    assert sorted(r.path for r in dumps.queue_from_json(spark, str(tmp_path / "q")).collect()) == sorted(paths)
    assert sorted(map(tuple, dumps.report_from_json(spark, str(tmp_path / "r")).collect())) == sorted((p, i) for i, p in enumerate(paths))
    assert dumps.report_from_json(spark, str(tmp_path / "none")).count() == 0


def against_sql(spark, name, folder, table):
    import duckdb

    from quire.plans.queries import QUERIES, SQL

    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    out = QUERIES[name](spark, str(folder))
    (got,), (expected,) = out.collect(), con.sql(SQL[name]).fetchall()
    assert out.columns == ["json"] and tuple(got) == expected
    return expected[0]


def test_queue_dump_is_its_sql(spark, tmp_path):
    odd = ["b", "a", 'q"\\', "\x01\t\x7f\x1f\u2028/", "é", "\U0001f600", "\uffff", "", None, "b", "b", None]
    rows = [(i if s != "b" else 7, s, None if i == 4 else "en") for i, s in enumerate(odd)]
    for name, kept in (("odd", rows), ("none", [])):
        (tmp_path / name).mkdir()
        t = pa.table(dict(zip(("doc_id", "source", "lang"), map(list, zip(*kept))))) if kept else pa.table({"doc_id": pa.array([], "int64"), "source": pa.array([], "string"), "lang": pa.array([], "string")})
        pq.write_table(t, tmp_path / name / "documents.parquet")
    whole = json.loads(against_sql(spark, "queue_dump", tmp_path / "odd", "documents"))
    assert len(whole) == 12 and whole[-3:] == [None] * 3 and whole.count("/b/en/7.txt") == 3
    assert against_sql(spark, "queue_dump", tmp_path / "none", "documents") is None


def test_report_dump_is_its_sql(spark, tmp_path):
    rows = [(10, 1, 0), (2, 0, 0), (1, 1, 1), (None, 1, 0), (3, None, None), (2, 0, 0)]
    for name, kept in (("odd", rows), ("none", [(None, 1, 1)])):
        (tmp_path / name).mkdir()
        pq.write_table(pa.table({k: pa.array(v, "int64") for k, v in zip(("doc_id", "quality", "toxic"), map(list, zip(*kept)))}), tmp_path / name / "labels.parquet")
    assert against_sql(spark, "report_dump", tmp_path / "odd", "labels") == '{"1":11,"10":0,"2":4,"2":4,"3":4}'
    assert against_sql(spark, "report_dump", tmp_path / "none", "labels") is None


def zipped(**items):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in items.items():
            z.writestr(k.replace("__", "/"), v)
    return out.getvalue()


def mail(*attachments):
    parts = "".join(f'--x\r\nContent-Type: {t}\r\nContent-Disposition: attachment{f"; filename={n}" if n else ""}\r\nContent-Transfer-Encoding: base64\r\n\r\n{base64.b64encode(b).decode()}\r\n' for n, t, b in attachments)
    return f"From: a@b.c\r\nTo: d@e.f\r\nSubject: Hello\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=x\r\n\r\n--x\r\nContent-Type: text/plain\r\n\r\nBody text\r\n{parts}--x--\r\n".encode()


def unfold(data, name="/r", **options):
    return list(parsers.unfold(name, data, parsers.Options(**options), parsers.REGISTRY))


def test_detection():
    kinds = {b"%PDF-1.4": "application/pdf", b"\x89PNG\r\n": "image/png", b"{\\rtf1": "application/rtf", b"<!DOCTYPE html><html>": "text/html", mail(): "message/rfc822", b"From a@b Thu Jan 1 00:00:00 2015\nFrom: x\n\n": "application/mbox", zipped(a="1"): "application/zip", b"plain": "text/plain", b"\x00\x01\x02": "application/octet-stream"}
    for data, kind in kinds.items():
        assert parsers.detect(data) == kind
    assert parsers.detect(b"a,b", "x.csv") == "text/csv"


def test_html():
    p = parsers.parse_html('<html><head><title>T &amp; t</title><meta name="k" content="v"><meta http-equiv="x" content="y"></head><body onload="f()"><script>no()</script><p>One<br>two &lt; <input checked type="text"></p><div class="page"><p>p1</p></div><div class="page">p2</div></body></html>'.encode())
    assert p.metadata["title"] == ["T & t"] and p.metadata["k"] == ["v"]
    assert p.text == "One\ntwo <\np1\np2" and p.pages == ["p1", "p2"]
    html = parsers.serialize(p.metadata, "T & t", p.html)
    assert html.startswith('<!DOCTYPE html>\n<html><head><meta charset="UTF-8"><meta name="') and '<meta name="k" content="v">' in html and "<title>T &amp; t</title></head><body>" in html
    assert "script" not in html and "<br>" in html and "two &lt;" in html and "</br>" not in html and "http-equiv" not in html and html.endswith("</body></html>\n")
    assert "javascript" not in parsers.parse_html(b'<a href=" JavaScript:f()">x</a><img src="javascript:1"><a href="/javascript:ok">').html.replace("/javascript:ok", "")


def test_html_of_plain_text_as_a_serializer_gives_it():
    (row,) = unfold("This is a test.\n".encode("utf-16"), "/utf16.txt", output="html")
    assert row["content"] == '<!DOCTYPE html>\n<html><head><meta charset="UTF-8"><meta name="Content-Encoding" content="UTF-16"><title></title></head><body><p>This is a test.\n</p></body></html>\n'


def test_csv_rtf_text():
    p = parsers.parse_csv('ID,Nom,Email\n1,"Zoé, A",z@x\n2,B,b@x'.encode())
    assert p.metadata["Content-Type"] == ["text/csv; charset=UTF-8; delimiter=comma"] and p.text.count("\n") == 2
    assert parsers.parse_rtf(rb"{\rtf1\ansi{\fonttbl\f0 Arial;}\f0\pard RTF Text Document\par caf\'e9}").text == "RTF Text Document\ncafé"
    assert parsers.parse_text("x\fy".encode("utf-16")).pages == ["x", "y"]


def test_embedded_tree_ids_and_names():
    inner = zipped(deep__c="gamma")
    rows = unfold(mail((None, "text/plain", b"one"), ("n.txt", "text/plain", b"two"), (None, "text/plain", b"one"), ("i.zip", "application/zip", inner)))
    assert [r["level"] for r in rows] == [0, 1, 1, 1, 1, 2]
    root = rows[0]
    assert rows[0]["content"] == "Body text" and rows[0]["metadata"]["title"] == ["Hello"]
    assert [r["name"] for r in rows[1:4]] == [f"untitled_{root['id']}_0", "n.txt", f"untitled_{root['id']}_1"]
    assert len({r["id"] for r in rows}) == 6 and all(r["root_id"] == root["id"] for r in rows) and rows[5]["parent_id"] == rows[4]["id"]
    assert [r["ordinal"] for r in rows] == list(range(6))
    assert [r["id"] for r in unfold(mail((None, "text/plain", b"one")))] != [r["id"] for r in unfold(mail((None, "text/plain", b"one")), project="p")]


def test_guards_and_modes():
    data = b"end"
    for _ in range(22):
        data = zipped(z=data)
    assert len(unfold(data)) == 21 and unfold(data)[-1]["skipped_depth"] == 1
    assert len(unfold(data, max_depth=0)) == 23
    big = zipped(a="x" * 100, b="y")
    assert [r["name"] for r in unfold(big, max_bytes=50)] == ["r", "b"] and unfold(big, max_bytes=50)[0]["skipped_size"] == 1
    assert len(unfold(big, embeds="ignore")) == 1
    (one,) = unfold(mail(("a", "text/plain", b"inside")), embeds="concatenate")
    assert one["content"] == "Body text\ninside"


def test_failures_stay_with_their_item():
    rows = unfold(mail(("bad.zip", "application/zip", b"PK\x03\x04broken"), ("empty", "text/plain", b""), ("x.pdf", "application/pdf", b"%PDF-1.4 ..."), ("ok", "text/plain", b"fine")))
    assert [bool(r["error"]) for r in rows] == [False, True, False, False, False]
    assert [r["no_content_reason"] for r in rows] == [None, None, parsers.EMPTY, parsers.NO_CONTENT, None] and rows[4]["content"] == "fine"
    assert parsers.count_entries(zipped(a="1", b="2")) == 2 and parsers.count_entries(b"x") is None and parsers.count_entries(zipped(**{"word__document.xml": "<x/>"})) is None


def test_ocr_and_cleaner_hooks():
    png = b"\x89PNG\r\n\x1a\n" + b"0" * 50
    (r,) = unfold(png, ocr=lambda data, kind: (f"{kind} {len(data)}", 0.9))
    assert r["content"] == "image/png 58" and r["ocr_confidence"] == 0.9
    assert unfold(png)[0]["no_content_reason"] == parsers.NO_CONTENT
    assert unfold(png, ocr=lambda d, k: ("x", 1.0), ocr_least_bytes=100)[0]["no_content_reason"] == parsers.NO_CONTENT
    assert unfold(b"secret text", cleaner=lambda d, k: d.replace(b"secret ", b""))[0]["content"] == "text"


def test_strategies_selector_timeout_raw_and_transcoding():
    png, odd = b"\x89PNG\r\n\x1a\n" + b"0" * 50, b"II*\x00" + b"1" * 9
    read = lambda d, k: (k, 0.5)
    assert [parsers.Options(ocr=o, ocr_strategy=s).strategy() for o, s in ((read, "ocr_only"), (read, "whatever"), (None, "AUTO"))] == ["OCR_ONLY", "NO_OCR", "NO_OCR"] and parsers.Options(ocr=read).strategy() == "NO_OCR"
    assert unfold(png, ocr=read)[0]["metadata"]["ocr:confidence"] == ["0.5"]
    scan = lambda data: parsers.Parsed("layer", pages=["layer", ""], images=[(b"1", "image/png"), (b"22", "image/png")])
    seen = lambda d, k: (f"seen{len(d)}", 0.5)
    pages = lambda s: next(parsers.unfold("/x.pdf", b"%PDF-", parsers.Options(ocr=seen, ocr_strategy=s), {"application/pdf": scan}))["pages"]
    assert [pages(s) for s in parsers.STRATEGIES] == [["layer", ""], ["layer", "seen2"], ["layer\nseen1", "seen2"], ["seen1", "seen2"]]
    assert unfold(odd, ocr=read, ocr_types=("image/png",))[0]["no_content_reason"] == parsers.NO_CONTENT
    assert unfold(odd, ocr=read, ocr_types=("image/png",), transcode=lambda d, k: png)[0]["content"] == "image/png"
    html = b"<html><head><title>plain</title></head><body>x</body></html>"
    assert unfold(html, output="html", selector=lambda m: m["title"] != ["plain"])[0]["content"] == "x"
    (slow,) = unfold(b"text", timeout=1, cleaner=lambda d, k: __import__("time").sleep(5))
    assert slow["error"].startswith("TimeoutException")
    late: list = []
    thread = threading.Thread(target=lambda: late.extend(unfold(b"text", timeout=0.2, cleaner=lambda d, k: __import__("time").sleep(3))))
    thread.start()
    thread.join(2)
    assert late and late[0]["error"].startswith("TimeoutException") and parsers.Options().timeout == 86_400
    broken = unfold(b"PK\x03\x04broken", keep_raw=True)[0]
    assert broken["error"] and broken["raw"] == b"PK\x03\x04broken"
    office = zipped(**{"word__document.xml": "<x/>", "docProps__core.xml": "<author/>"})
    cleaned = parsers.clean_metadata(office, parsers.detect(office))
    assert zipfile.ZipFile(io.BytesIO(cleaned)).namelist() == ["word/document.xml"] and parsers.clean_metadata(b"x", "text/plain") == b"x"
    office = zipped(**{"word__document.xml": "<x/>", "docProps__core.xml": "<author/>", "_rels__.rels": '<Relationships><Relationship Id="1" Target="docProps/core.xml"/><Relationship Id="2" Target="word/document.xml"/></Relationships>', "[Content_Types].xml": '<Types><Override PartName="/docProps/core.xml" ContentType="c"/><Override PartName="/word/document.xml" ContentType="d"></Override></Types>'})
    with zipfile.ZipFile(io.BytesIO(parsers.clean_metadata(office, parsers.detect(office)))) as z:
        assert z.read("_rels/.rels") == b'<Relationships><Relationship Id="2" Target="word/document.xml"/></Relationships>' and z.read("[Content_Types].xml") == b'<Types><Override PartName="/word/document.xml" ContentType="d"></Override></Types>'


def test_blocks(spark):
    import zlib

    from quire.operators.blocks import reassemble

    packed, swap = zlib.compress(b"content" * 50), bytes(255 - i for i in range(256))
    rows = [("z", 1, packed[9:]), ("z", 0, packed[:9]), ("raw", 0, b"abc"), ("short", 0, b"ab")]
    df = spark.createDataFrame(rows, "id string, block int, data binary")
    length = spark.createDataFrame([("z", 350), ("raw", 3), ("short", 3)], "id string, length int")
    got = {r.id: r.content and bytes(r.content) for r in reassemble(df, length).collect()}
    assert got == {"z": b"content" * 50, "raw": b"abc", "short": None}
    turned = spark.createDataFrame([(i, n, d.translate(swap)) for i, n, d in rows], "id string, block int, data binary")
    assert {r.id: r.content and bytes(r.content) for r in reassemble(turned, length, permutation=swap).collect()} == got


def test_archive_entries_and_pages(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped(a="1", d__b="2"))
    (tmp_path / "p.html").write_text('<html><body><div class="page">one</div><div class="page">two</div></body></html>')
    files_ = walk(spark, [str(tmp_path)])
    assert {os.path.basename(r.path): r.entries for r in parsers.archive_entries(files_).collect()} == {"a.zip": 2, "p.html": None}
    from quire.operators.pages import of_parsed

    assert sorted((r.text, r.start, r.end) for r in of_parsed(parsers.parse(files_)).collect()) == [("one", 0, 3), ("two", 4, 7)]


def test_inline_embeds(spark):
    from quire.operators.tree import inline_embeds

    docs = spark.createDataFrame([("r", '<a href="embedded:x.png:">x</a> embedded:y:'), ("q", "embedded:x.png:")], "id string, content string")
    art = spark.createDataFrame([("r", "x.png", "image/png", bytearray(b"abc"))], "parent_id string, name string, content_type string, raw binary")
    assert {r.id: r.content for r in inline_embeds(docs, art).collect()} == {"r": '<a href="data:image/png;base64,YWJj">x</a> embedded:y:', "q": "embedded:x.png:"}


def test_other_containers(tmp_path):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n in ("a", "b"):
            info = tarfile.TarInfo(n)
            info.size = 4
            t.addfile(info, io.BytesIO(b"same"))
    rows = unfold(gzip.compress(out.getvalue()))
    assert [r["content_type"] for r in rows] == ["application/gzip", "application/x-tar", "text/plain", "text/plain"] and rows[2]["digest"] == rows[3]["digest"] and rows[2]["id"] != rows[3]["id"]
    box = b"From a@b Thu Jan  1 00:00:00 2015\n" + mail().replace(b"\r\n", b"\n") + b"\nFrom c@d Thu Jan  1 00:00:00 2015\nSubject: two\nFrom: q\n\n>From second\n"
    assert [r["content"] for r in unfold(box)] == ["", "Body text", "From second"]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    assert unfold(zipped(**{"word__document.xml": f"<w:document {w}><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:p><w:t>you</w:t></w:p></w:document>"}))[0]["content"] == "Hi\nyou"


def test_office_formats():
    ns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    core = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/"><dc:title>Sums</dc:title><dcterms:created>2015-06-03T10:00:00Z</dcterms:created></cp:coreProperties>'
    book = zipped(**{
        "xl__workbook.xml": f'<workbook {ns}><sheets><sheet name="One" r:id="a"/><sheet name="Two" r:id="b"/></sheets></workbook>', "xl___rels__workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl__sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>rich </t></r><r><t>text</t></r></si></sst>", "docProps__core.xml": core,
        "xl__worksheets__sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>1.5</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
        "xl__worksheets__sheet2.xml": "<worksheet><sheetData><row><c><v>7</v></c></row></sheetData></worksheet>",
    })
    (row,) = unfold(book)
    assert row["content"] == "One\nname\t\trich text\n1.5\tTRUE\tin\nTwo\n7" and row["metadata"]["title"] == ["Sums"] and row["metadata"]["dcterms:created"] == ["2015-06-03T10:00:00Z"] and row["content_type"].endswith("spreadsheetml.sheet")
    slide = lambda *t: "<p:sld xmlns:p='p' xmlns:a='a'>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in t) + "</p:sld>"
    show = zipped(**{
        "ppt__presentation.xml": f'<p:presentation xmlns:p="p" {ns}><p:sldIdLst><p:sldId id="1" r:id="y"/><p:sldId id="2" r:id="x"/></p:sldIdLst></p:presentation>', "ppt___rels__presentation.xml.rels": '<Relationships><Relationship Id="x" Target="slides/slide1.xml"/><Relationship Id="y" Target="slides/slide2.xml"/></Relationships>',
        "ppt__slides__slide1.xml": slide("last"), "ppt__slides__slide2.xml": slide("first", "line two"), "ppt__slides___rels__slide2.xml.rels": '<Relationships><Relationship Id="n" Target="../notesSlides/notesSlide1.xml"/></Relationships>', "ppt__notesSlides__notesSlide1.xml": slide("a note"), "ppt__media__i.png": b"\x89PNG",
    })
    (row,) = unfold(show)
    assert row["pages"] == ["first\nline two\na note", "last"] and row["content"] == "first\nline two\na note\nlast"
    office, text, tab = (f'xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{n}:1.0"' for p, n in (("o", "office"), ("t", "text"), ("b", "table")))
    sheet = f'<o:d {office} {text} {tab}><b:table b:name="S"><b:table-row><b:table-cell><t:p>a</t:p></b:table-cell><b:table-cell b:number-columns-repeated="2"><t:p>b</t:p></b:table-cell><b:table-cell b:number-columns-repeated="1000"/></b:table-row></b:table></o:d>'
    assert unfold(zipped(mimetype="application/vnd.oasis.opendocument.spreadsheet", **{"content.xml": sheet}))[0]["content"] == "S\na\tb\tb"
    draw = 'xmlns:d="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0"'
    talk = f"<o:d {office} {text} {draw}><d:page><d:frame><t:p>one</t:p></d:frame></d:page><d:page><t:p>two</t:p></d:page></o:d>"
    assert unfold(zipped(mimetype="application/vnd.oasis.opendocument.presentation", **{"content.xml": talk}))[0]["pages"] == ["one", "two"]
    paper = f"<o:d {office} {text}><t:h>Head</t:h><t:p>body <t:span>text</t:span></t:p></o:d>"
    assert unfold(zipped(mimetype="application/vnd.oasis.opendocument.text", **{"content.xml": paper}))[0]["content"] == "Head\nbody text"
    opf = '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title></metadata><manifest><item id="c2" href="b.xhtml"/><item id="c1" href="a%s.xhtml"/></manifest><spine><itemref idref="c1"/><itemref idref="c2"/></spine></package>' % ""
    book = zipped(mimetype="application/epub+zip", **{"META-INF__container.xml": '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>', "O__p.opf": opf, "O__a.xhtml": "<html><body><p>one</p></body></html>", "O__b.xhtml": "<html><body><p>two</p></body></html>"})
    (row,) = unfold(book)
    assert (row["content"], row["pages"], row["metadata"]["title"]) == ("one\ntwo", ["one", "two"], ["Book"])
    assert unfold(b'<?xml version="1.0"?><a x="no"><b>one</b><b>two <i>three</i></b><!-- c --></a>')[0]["content"] == "one\ntwo\nthree"
    assert unfold(b'{"a": 1}', "/x.json")[0]["content"] == '{"a": 1}'


def test_mail_and_mailboxes_are_told_by_their_first_bytes():
    for head in ("Delivered-To: x", "Status: RO", "X-Mozilla-Status2: 0", "X-Mozilla-Keys: ", "relay-version: 1", "#! rnews 1", "N#! rnews", "Forward to a", "Pipe to b", "RETURN-PATH: <>", "Received: by", "message-id: <x>", "Date: now", "User-Agent: m", "mime-version: 1.0", "X-Mailer: y", "X-Notes-Item: a\r\nMessage-ID: <b>"):
        assert parsers.detect(head.encode()) == "message/rfc822", head
    assert parsers.detect(b"date: lower") == parsers.detect(b"X-Notes-Item: a") == "text/plain"
    for line in ("From: ", "Date: ", "Subject: ", "Delivered-To: ", "Received: by ", "Received: via ", "Received: from ", "Mime-Version: "):
        assert parsers.detect(b"From someone@example.com Thu Jan  1 2015\n" + line.encode() + b"x\n") == "application/mbox", line
    assert [parsers.detect(b"a", f"x.{e}") for e in ("mime", "mht", "mhtml", "eml")] == ["message/rfc822"] * 4


def test_nothing_is_lost_for_its_size(monkeypatch):
    import hashlib

    monkeypatch.setattr(parsers, "MOST_BYTES", 50)
    rows = unfold(zipped(big="x" * 100, small="y"))
    assert (rows[1]["size"], rows[1]["error"], rows[1]["digest"], rows[1]["no_content_reason"]) == (100, "ParseException: TooLarge: 100 bytes", hashlib.sha256(b"x" * 100).hexdigest(), None) and rows[2]["content"] == "y"
    assert parsers.parse_csv(b"a,b\n" + b"c" * 300_000 + b",d\n").text.endswith("\td")
    assert parsers.parse_csv(b"x\n" * 3000 + b"a;b;c\n" * 4000).metadata["csv:delimiter"] == ["semicolon"]
    assert [parsers._too_large(t, 10) for t in ("+11", " 11 ", "-11", "١١", "1.1", None, "10")] == [True, True, False, False, False, False, False]


def test_an_embedded_document_is_found_by_its_id(spark, tmp_path):
    data = mail(("a.txt", "text/plain", b"one"), ("i.zip", "application/zip", zipped(deep="gamma")), ("z.txt", "text/plain", b"last"))
    path = tmp_path / "m.eml"
    path.write_bytes(data)
    rows = unfold(data, str(path))
    seen = []
    for r in rows:
        row, raw = parsers.find_embedded(str(path), data, r["id"])
        assert row["id"] == r["id"] and len(raw) == r["size"]
    parsers_ = parsers.REGISTRY | {"text/plain": lambda d: seen.append(d) or parsers.parse_text(d)}
    parsers.find_embedded(str(path), data, rows[3]["id"], parsers=parsers_)
    assert rows[3]["name"] == "deep" and seen == [b"one"]  # what comes later isn't parsed
    with pytest.raises(parsers.ContentNotFound):
        parsers.find_embedded(str(path), data, "none")
    asked = spark.createDataFrame([(str(path), rows[3]["id"]), (str(path), "none"), ("file://" + str(path), rows[1]["id"]), ("/nowhere", "x")], "path string, id string")
    got = {(r.path, r.id): (r.raw and bytes(r.raw), r.error and r.error.split(":")[0]) for r in parsers.embedded(asked).collect()}
    assert got == {(str(path), rows[3]["id"]): (b"gamma", None), (str(path), "none"): (None, "ContentNotFound"), ("file://" + str(path), rows[1]["id"]): (b"one", None), ("/nowhere", "x"): (None, "FileNotFoundError")}
    from quire.operators.tree import ContentNotFound, resolve

    art = spark.createDataFrame([("k", "v")], "id string, raw string")
    assert resolve(art, "k", None).first().raw == "v" and resolve(art, "m", lambda: art.withColumn("id", F.lit("m"))).count() == 1
    with pytest.raises(ContentNotFound):
        resolve(art, "q", lambda: art)


def test_batches_of_rows_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(parsers, "BATCH_BYTES", 10_000)
    rows = [r for i in range(30) for r in unfold(b"x" * 3000 + b"\xed\xa0\x80", f"/f{i}")]
    sizes = [b.num_rows for b in parsers._batches(iter(rows))]
    assert sum(sizes) == 30 and max(sizes) <= 3
    assert next(parsers._batches(iter([rows[0] | {"content": "a\ud800", "metadata": {"k": ["\ud800"]}}]))).column("content").to_pylist() == ["a?"]


@pytest.fixture
def mixed(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "m.eml").write_bytes(mail(("a.txt", "text/plain", b"attached")))
    (folder / "t.txt").write_text("plain")
    (folder / "bad.zip").write_bytes(b"PK\x03\x04broken")
    return folder


@pytest.mark.parametrize("partitions", [1, 4])
def test_ingest_resumes(spark, mixed, tmp_path, partitions):
    index, reports = str(tmp_path / "index"), str(tmp_path / "reports")
    paths = walk(spark, [str(mixed)]).select("path")
    assert ingest(spark, paths, index, reports, partitions=partitions) == {"roots": 3, "embedded": 1, "errors": 1}
    codes = {os.path.basename(r.path): r.code for r in spark.read.parquet(reports).collect()}
    assert codes == {"m.eml": 0, "t.txt": 0, "bad.zip": 4}
    before = sorted(r.id for r in outputs.IndexTable(spark, index).read().collect())
    assert ingest(spark, paths, index, reports)["roots"] == 1  # only what failed is tried again
    assert sorted(r.id for r in outputs.IndexTable(spark, index).read().collect()) == before and len(before) == 4


def test_equal_contents_are_one_row(spark, mixed, tmp_path):
    (mixed / "copy.eml").write_bytes((mixed / "m.eml").read_bytes())
    (mixed / "again.txt").write_text("plain")
    index, reports = f"file://{tmp_path}/index", f"file://{tmp_path}/reports"  # URLs, on the first run too
    paths = walk(spark, [str(mixed)]).select("path")
    first = paths.where("path not like '%again%'")
    assert ingest(spark, first, index, reports)["roots"] == 4
    assert ingest(spark, paths, index, reports)["roots"] == 2  # the new one, and the one that failed
    docs = outputs.IndexTable(spark, index).read()
    assert docs.count() == docs.select("id").distinct().count() == 4
    seen = plans.seen_at(spark, index)
    full = {r.path: r for r in plans.with_paths(docs, seen).where("level = 0").collect()}
    mails = full[str(mixed / "copy.eml")]
    assert [os.path.basename(p) for p in mails.paths] == ["copy.eml", "m.eml"] and mails.parent_paths == [str(mixed)] and mails.names == ["copy.eml", "m.eml"] and mails.n_paths == 2
    assert [os.path.basename(p) for p in full[str(mixed / "again.txt")].paths] == ["again.txt", "t.txt"]
    assert plans.ReportStore(spark, reports).latest().where("code = 0").count() == 4


def test_what_a_sink_fails_to_write_is_tried_again(spark, mixed, tmp_path, capsys):
    reports = str(tmp_path / "reports")
    argv = ["spew", str(mixed), "--reports", reports, "--sink", "rest", "--to", "http://127.0.0.1:1/x"]
    monkey = outputs.time.sleep
    outputs.time.sleep = lambda s: None
    try:
        assert cli.main(argv, spark) == 1 and "3 documents" in capsys.readouterr().err
    finally:
        outputs.time.sleep = monkey
    latest = {os.path.basename(r.path): (r.code, r.exception_class) for r in plans.ReportStore(spark, reports).latest().collect()}
    assert latest == {"m.eml": (9, "ConnectionRefusedError"), "t.txt": (9, "ConnectionRefusedError"), "bad.zip": (4, "ParseException")}
    out = str(tmp_path / "out")
    assert cli.main(["spew", str(mixed), "--reports", reports, "--sink", "file", "--to", out], spark) == 0
    assert {r.code for r in plans.ReportStore(spark, reports).latest().collect()} == {0, 4} and os.path.exists(out + str(mixed / "t.txt") + ".txt")
    (tmp_path / "blocked").write_text("a file where a folder should be")
    with pytest.raises(Exception):
        ingest(spark, walk(spark, [str(mixed)]).select("path"), str(tmp_path / "blocked"), str(tmp_path / "r2"))
    assert {r.code for r in plans.ReportStore(spark, str(tmp_path / "r2")).latest().collect()} == {9, 4}


def test_reports_that_cannot_be_written_go_to_the_journal(spark, tmp_path):
    (tmp_path / "reports").write_text("not a folder")
    store = plans.ReportStore(spark, str(tmp_path / "reports"), str(tmp_path / "journal"))
    one = spark.createDataFrame([("/a", 0, None, None, None)], plans.REPORTS)
    with pytest.raises(Exception):
        store.add(one)
    (tmp_path / "reports").unlink()
    store.add(spark.createDataFrame([("/b", 4, None, None, None)], plans.REPORTS))
    assert sorted((r.path, r.code) for r in store.read().collect()) == [("/a", 0), ("/b", 4)] and not (tmp_path / "journal").exists()


def test_streaming_ingest(spark, mixed, tmp_path):
    queue, index, reports, checkpoint = (str(tmp_path / x) for x in ("queue", "index", "reports", "cp"))
    drain.offer(walk(spark, [str(mixed)]).select("path"), queue)
    plans.streaming_ingest(spark, queue, index, reports, checkpoint).awaitTermination(120)
    assert outputs.IndexTable(spark, index).read().count() == 4 and plans.ReportStore(spark, reports).latest().count() == 3
    (mixed / "new.txt").write_text("new")
    drain.offer(spark.createDataFrame([(str(mixed / "new.txt"),)], "path string"), queue)
    plans.streaming_ingest(spark, queue, index, reports, checkpoint).awaitTermination(120)
    assert outputs.IndexTable(spark, index).read().count() == 5


def test_index_commits_write_touched_parts_only(spark, tmp_path):
    kind = "id string, root_id string, level int, v string"
    t = outputs.IndexTable(spark, str(tmp_path / "index"), parts=8)
    t.write_trees(spark.createDataFrame([(f"r{i}", f"r{i}", 0, "a") for i in range(40)] + [(f"c{i}", f"r{i}", 1, "a") for i in range(40)], kind))
    before = t._manifest(t.version())["places"]
    t.write_trees(spark.createDataFrame([("r3", "r3", 0, "b", 1)], kind + ", extra int"))
    after = t._manifest(t.version())["places"]
    assert sum(before[p] != after[p] for p in before) == 1 and len(before) == 8
    rows = {r.id: (r.v, r.extra) for r in t.read().collect()}
    assert len(rows) == 79 and rows["r3"] == ("b", 1) and rows["r4"] == ("a", None) and "c3" not in rows
    t.vacuum(1)
    assert outputs.IndexTable(spark, str(tmp_path / "index")).read().count() == 79
    t.replace(t.read().limit(0))
    assert t.read().count() == 0 and t.read().columns == ["id", "root_id", "level", "v", "extra"]


def test_page_places_are_kept(spark, tmp_path):
    docs = parsers.parse(spark.createDataFrame([("/a.html", '<html><body><div class="page">one</div><div class="page">two</div></body></html>'), ("/b.txt", "x\fyy")], "path string, content string"), content="content")
    store = str(tmp_path / "pages")
    for _ in range(2):
        assert sorted([list(map(list, r.pages)), r.extractor] for r in outputs.page_indices(docs, store).collect()) == [[[[0, 1], [2, 4]], "quire"], [[[0, 3], [4, 7]], "quire"]]
    assert spark.read.parquet(store).count() == 2


def test_pinned_certificates(spark, tmp_path):
    import shutil
    import ssl
    import subprocess

    if not shutil.which("openssl"):
        pytest.skip("no openssl")
    for n in ("mine", "other"):
        subprocess.run(["openssl", "req", "-x509", "-newkey", "rsa:2048", "-nodes", "-keyout", tmp_path / f"{n}.key", "-out", tmp_path / f"{n}.pem", "-days", "2", "-subj", "/CN=docs.example", "-addext", "subjectAltName=DNS:docs.example"], check=True, capture_output=True)

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_PUT(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(201)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    context = ssl.SSLContext(ssl.PROTOCOL_TLS_SERVER)
    context.load_cert_chain(tmp_path / "mine.pem", tmp_path / "mine.key")
    server.socket = context.wrap_socket(server.socket, server_side=True)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    docs = spark.createDataFrame([("a", "/a", 0, "t", {})], "id string, path string, level int, content string, metadata map<string,array<string>>")
    put = lambda c, h: outputs.write_http(docs, f"https://127.0.0.1:{server.server_port}", 0, certificate=str(tmp_path / f"{c}.pem"), verify_host=h).first().error
    assert put("mine", "docs.example") is None and "SSL" in put("mine", None) and "SSL" in put("other", "docs.example")
    server.shutdown()


def test_database_tables(spark, tmp_path):
    """The queue and report tables of a database, here the one that comes with Spark."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    reports = spark.createDataFrame([("/a", 0), ("/b", 9)], "path string, code int")
    dumps.to_jdbc(reports, url, "reports", **options)
    dumps.to_jdbc(reports.where("code = 9").selectExpr("path || 'c' AS path", "code"), url, "reports", **options)
    back = dumps.jdbc(spark, url, "reports", **options)
    assert sorted(map(tuple, back.collect())) == [("/a", 0), ("/b", 9), ("/bc", 9)]
    assert "PushedFilters: [*IsNotNull(CODE), *EqualTo(CODE,9)]" in back.where("code = 9")._jdf.queryExecution().executedPlan().toString().replace("code", "CODE")


def test_walks_spread_and_follow_links_as_often_as_they_lead(spark, tmp_path):
    deep = tmp_path / "one"
    for i in range(300):
        (deep / f"d{i:03d}").mkdir(parents=True)
        (deep / f"d{i:03d}" / "f").write_text("x")
    from quire.sources.walk import SPREAD, WalkReader

    reader = WalkReader({"roots": json.dumps([str(tmp_path)])})
    parts = reader.partitions()
    assert len(parts) > SPREAD / 2 and sum(len(list(reader.read(p))) for p in parts) == 300
    (tmp_path / "links" / "a").mkdir(parents=True)
    os.symlink(deep / "d000", tmp_path / "links" / "x")
    os.symlink(deep / "d000", tmp_path / "links" / "a" / "y")
    os.symlink(tmp_path / "links", tmp_path / "links" / "a" / "back")
    assert names(walk(spark, [str(tmp_path / "links")], follow_links=True), tmp_path) == ["links/a/y/f", "links/x/f"]


def test_drain_some_and_take(spark, tmp_path):
    queue, checkpoint, got = str(tmp_path / "queue"), str(tmp_path / "cp"), []
    drain.offer(spark.createDataFrame([(f"/{i}",) for i in range(7)], "path string").coalesce(1), queue, each=True)
    assert [r.path for r in drain.take(spark, queue, 1).collect()] == ["/0"] and drain.take(spark, queue).count() == 7
    for want in (3, 6, 7, 7):
        drain.drain_some(spark, queue, checkpoint, lambda df, n: got.extend(r.path for r in df.collect()), 3)
        assert len(got) == want
    assert sorted(got) == [f"/{i}" for i in range(7)]


def test_file_and_stdout_sinks(spark, mixed, tmp_path):
    docs = parsers.parse(walk(spark, [str(mixed)]))
    assert outputs.write_files(docs, str(tmp_path / "out")).where("error is not null").count() == 0
    written = sorted(os.path.basename(p) for _, _, fs in os.walk(tmp_path / "out") for p in fs)
    assert len(written) == 8 and "t.txt.txt" in written and "m.eml.txt" in written
    out = io.StringIO()
    outputs.write_stdout(docs, out)
    assert "title: Hello" in out.getvalue() and "attached" in out.getvalue()


def test_http_sink(spark, mixed):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_PUT(self):
            seen.append((self.path, self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(500 if b"plain" in seen[-1][1] else 200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    docs = parsers.parse(walk(spark, [str(mixed)]))
    got = outputs.write_http(docs, f"http://127.0.0.1:{server.server_port}/docs").collect()
    server.shutdown()
    assert len(seen) == 3 and len(got) == 3 and sum(r.error is not None for r in got) == 1


def test_index_table_commits_and_rolls_back(spark, tmp_path):
    t = outputs.IndexTable(spark, str(tmp_path / "index"))
    assert t.read() is None
    t.replace(spark.range(3))
    t.stage(spark.range(5))
    assert t.read().count() == 3
    t.rollback()
    t.stage(spark.range(7))
    t.commit()
    assert t.read().count() == 7
    t.replace(t.read().where("id < 2"))
    t.vacuum(1)
    assert t.read().count() == 2


def test_artifacts_and_dead_letters(spark, tmp_path):
    items = spark.createDataFrame([("abcd12", bytearray(b"x"), {"k": ["v"]}), ("Q", bytearray(b"y"), {})], "id string, raw binary, metadata map<string,array<string>>")
    outputs.write_artifacts(items, str(tmp_path / "store"))
    assert bytes(outputs.read_artifact(spark, str(tmp_path / "store"), "abcd12").first().raw) == b"x"
    assert bytes(outputs.read_artifact(spark, str(tmp_path / "store"), "Q").first().raw) == b"y"
    results = spark.createDataFrame([("Q", "p", "boom")], "id string, path string, error string")
    outputs.write_dead_letters(items.drop("raw"), results, str(tmp_path / "dead"))
    assert dumps.dead_letters(spark, str(tmp_path / "dead"), "id string, sink_error string").first().sink_error == "boom"


def test_drain(spark, tmp_path):
    queue, checkpoint, seen = str(tmp_path / "queue"), str(tmp_path / "cp"), []
    drain.offer(spark.createDataFrame([("/a",), ("/b",), ("/a",)], "path string"), queue)
    beat = drain.Heartbeat()
    spark.streams.addListener(beat)

    def go():
        drain.drain(drain.queue_stream(spark, queue, 1), lambda df, n: seen.extend(r.path for r in df.collect()), checkpoint).awaitTermination(60)

    go()
    assert sorted(set(seen)) == ["/a", "/b"]
    n = len(seen)
    go()
    assert len(seen) == n  # nothing new
    drain.offer(spark.createDataFrame([("/c",)], "path string"), queue)
    go()
    assert seen[n:] == ["/c"]
    spark.streams.removeListener(beat)


def test_drain_stops_at_the_sentinel(spark, tmp_path):
    queue, seen = str(tmp_path / "queue"), []
    drain.offer(spark.createDataFrame([("/a",), ("STOP",)], "path string"), queue)
    q = drain.drain(drain.queue_stream(spark, queue), lambda df, n: seen.extend(r.path for r in df.collect()), str(tmp_path / "cp"), once=False, interval="100 milliseconds", sentinel="STOP")
    assert q.awaitTermination(60) and seen == ["/a"]  # in the first batch


def test_stream_resumes_and_keeps_latest(spark, tmp_path):
    queue = str(tmp_path / "queue")
    drain.offer(spark.createDataFrame([("/a",), ("/b",)], "path string"), queue)
    done = spark.createDataFrame([("/a", 0), ("/b", 9)], "path string, code int")
    seen = []
    drain.drain(drain.resume_stream(drain.queue_stream(spark, queue), done), lambda df, n: seen.extend(r.path for r in df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert seen == ["/b"]
    events = str(tmp_path / "events")
    spark.createDataFrame([("/a", 9, 1), ("/a", 0, 2), ("/b", 4, 1)], "path string, code int, ts int").write.json(events)
    stream = drain.queue_stream(spark, events, schema="path string, code int, ts int")
    drain.latest_reports(stream, str(tmp_path / "cp2"), str(tmp_path / "latest")).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "latest/0")).select("path", "code").collect())) == [("/a", 0), ("/b", 4)]


def test_commands(spark, mixed, tmp_path, capsys):
    q, r, i = (str(tmp_path / x) for x in ("q", "r", "i"))

    def go(*argv):
        capsys.readouterr()
        code = cli.main(list(argv), spark)
        return code, capsys.readouterr().out.strip()

    assert go("queue", "--queue", q, str(mixed)) == (0, "3")
    assert len(json.loads(go("dump-queue", "--queue", q)[1])) == 3
    assert go("spew", "--queue", q, "--reports", r, "--sink", "index", "--to", i)[0] == 0
    assert sorted(json.loads(go("dump-report", "--reports", r)[1]).values()) == [0, 0, 4]
    assert list(json.loads(go("dump-report", "--reports", r, "--status", "failure_not_parsed")[1]).values()) == [4]
    assert "SUCCESS" in go("view-report", "--reports", r, str(mixed / "t.txt"))[1]
    assert go("tag", "--index", i, "case:7", "--filter", "level = 0")[0] == 0
    assert outputs.IndexTable(spark, i).read().where("case = '7'").count() == 3
    assert go("copy", "--index", i, "name:title")[0] == 0
    assert go("rehash", "--index", i, "^/", "/vol/")[0] == 0
    assert outputs.IndexTable(spark, i).read().where("path like '/vol/%'").count() == 4
    assert go("delete", "--index", i, "case:7")[0] == 0
    assert outputs.IndexTable(spark, i).read().count() == 1
    os.remove(mixed / "t.txt")
    assert go("clean-report", "--reports", r, str(mixed))[0] == 0
    assert go("wipe-report", "--reports", r) == (0, "2") and go("wipe-queue", "--queue", q) == (0, "3")
    assert go("version")[1] == cli.VERSION and go("nonsense")[0] == 2 and go("tag", "--index", str(tmp_path / "none"), "a:b")[0] == 1
    (tmp_path / "o").write_text(f"queue={q}\n")
    assert go("--options", str(tmp_path / "o"), "dump-queue")[1] == "[]"


def test_every_inline_text_of_a_mail_is_read():
    from email.message import EmailMessage

    from quire.sources.parsers import parse_mail

    mail = EmailMessage()
    mail.set_content("first")
    mail.add_alternative("<p>first again</p>", subtype="html")
    mail.add_attachment(b"data", maintype="application", subtype="pdf", filename="a.pdf")
    footer = EmailMessage()
    footer.set_content("second")
    mail.attach(footer)
    page = EmailMessage()
    page.set_content("<p>third</p>", subtype="html")
    mail.attach(page)
    got = parse_mail(mail.as_bytes())
    assert got.text == "first\nsecond\nthird" and [i.name for i in got.items] == ["a.pdf"]
