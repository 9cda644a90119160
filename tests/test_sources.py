import csv
import io
import json
import zipfile

from scriptorium.operators import places
from scriptorium.sources import readers, sinks
from scriptorium.streaming import ingest


def test_text_documents_and_lists(spark, tmp_path):
    (tmp_path / "spec-1967-10-06_djvu.txt").write_bytes(b"a\xffb\nc")
    (tmp_path / "other.txt").write_text("x")
    got = {r.filename: r.text for r in readers.issues(spark, str(tmp_path)).collect()}
    assert got == {"spec-1967-10-06_djvu.txt": "a\ufffdb\nc"}
    (tmp_path / "list").write_text("# no\n\n Clinton (N.Y.) \nUtica (N.Y.)\n")
    assert [r.heading for r in readers.authority_list(spark, str(tmp_path / "list")).orderBy("ord").collect()] == ["Clinton (N.Y.)", "Utica (N.Y.)"]


def test_gazetteer_in_a_zip(spark, tmp_path):
    lines = ["feature_id|feature_name|feature_class|state_name|prim_lat_dec|prim_long_dec", "1|Clinton|Populated Place|New York|43.05|-75.38", "2|CLINTON|Populated Place|New York|43.05|-75.38", "3|Far|Populated Place|Ohio|40|-84", "4|Bad|Lake|Guam||x", "5|Near|Airport|New York|43|-75"]
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("Text/g.txt", "\n".join(lines))
    rows = readers.gazetteer(spark, str(tmp_path / "g.zip"), "Text/g.txt")
    assert [r.heading for r in places.nearby(rows, 43.048852, -75.38025, 30).collect()] == ["Clinton (N.Y.)"]


def test_authority_records(spark, tmp_path):
    def line(k, pref, alt=None, kind=readers.GEOGRAPHIC):
        return json.dumps({"@graph": [{"@id": f"{readers.AUTHORITY}n{k}", "skos:prefLabel": pref, "skos:altLabel": alt or [], "skos:notation": {"@type": kind, "@value": "x"}}]})

    value = {"@language": "en", "@value": "Clinton (N.Y.)"}
    (tmp_path / "a.jsonld").write_text("\n".join([line(1, value, ["Clinton, N.Y.", {"@value": "Old Clinton"}]), line(2, "Utica (N.Y.)", "Utica, N.Y."), line(3, ["x", "y"]), line(4, "Smith, J\u00f6rg, 1964-", kind="other"), "{bad codes/gac"]))
    found = {(r.pref, r.label, r.is_pref) for r in readers.authority_labels(spark, str(tmp_path / "a.jsonld")).collect()}
    assert found == {("Clinton (N.Y.)", "Clinton (N.Y.)", True), ("Clinton (N.Y.)", "Clinton, N.Y.", False), ("Clinton (N.Y.)", "Old Clinton", False), ("Utica (N.Y.)", "Utica (N.Y.)", True), ("Utica (N.Y.)", "Utica, N.Y.", False)}
    assert [r.label for r in readers.personal_labels(spark, str(tmp_path / "a.jsonld")).collect()] == ["Smith, Jörg, 1964-"]


def test_extraction(spark, tmp_path):
    (tmp_path / "failed").mkdir()
    (tmp_path / "failed" / "x.txt").write_text("no")
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "a.html").write_text("<html><head><title>T</title><style>p{}</style></head><body><p>one</p><script>x()</script>two</body></html>")
    (tmp_path / "b.csv").write_text('h,k\n"a, b",c\n,\n')
    (tmp_path / "c.eml").write_text("From: a@b\nSubject: S\nContent-Type: text/plain\n\nhello\n")
    (tmp_path / "d.docx").write_bytes(b"broken")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:r><w:t>p1</w:t></w:r></w:p><w:p><w:r><w:t>p2</w:t></w:r></w:p></w:document>')
    (tmp_path / "e.docx").write_bytes(buffer.getvalue())
    got = {r.filename: r for r in readers.extract(readers.ingest_files(spark, str(tmp_path))).collect()}
    assert {k: r.text for k, r in got.items()} == {"a.html": "one\ntwo", "b.csv": "h | k\na, b | c", "c.eml": "hello", "d.docx": None, "e.docx": "p1\n\np2"}
    assert got["a.html"].metadata == {"title": "T"} and got["d.docx"].error and got["b.csv"].metadata["row_count"] == "2"


def test_checkpoints_and_identifiers(spark, tmp_path):
    (tmp_path / "chunk_1.json").write_text(json.dumps({"people": {"A B": {"dates": ["1967-10-06"], "files": ["f1", "f2"]}}}))
    assert {(r.kind, r.name, r.filename) for r in readers.checkpoints(spark, str(tmp_path)).collect()} == {("people", "A B", "f1"), ("people", "A B", "f2")}
    (tmp_path / "ids.csv").write_text('Identifier\n"one"\n two \n\n')
    assert [r.identifier for r in readers.identifiers(spark, str(tmp_path / "ids.csv")).collect()] == ["one", "two"]


def test_csv_goes_out_and_comes_back(spark, tmp_path):
    rows = spark.createDataFrame([('a "q", b\nc', ["x", "y"], None)], "name string, files array<string>, note string")
    sinks.write_csv(rows, str(tmp_path / "out"), quote_all=True)
    back = readers.strings_csv(spark, str(tmp_path / "out"), ["name", "files", "note"]).first()
    assert (back.name, back.files, back.note or "") == ('a "q", b\nc', "x;y", "")
    part = next((tmp_path / "out").glob("part-*")).read_text()
    assert next(csv.reader(io.StringIO(part))) == ["name", "files", "note"]


def test_stream_takes_each_content_once(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    stream = lambda: spark.readStream.schema("filename string, text string").json(str(source))
    run = lambda: ingest.ingest(stream(), f"{out}/manifest", f"{out}/pages", f"{out}/checkpoint").awaitTermination()
    source.mkdir()
    (source / "1.json").write_text('{"filename": "a", "text": "x"}\n{"filename": "b", "text": "x"}\n{"filename": "c", "text": null}\n')
    run()
    (source / "2.json").write_text('{"filename": "d", "text": "x"}\n{"filename": "e", "text": "y"}\n')
    run()
    got = spark.read.schema("md5 string, filename string, text string, batch long").parquet(f"{out}/pages")
    assert {r.filename for r in got.collect()} == {"a", "c", "e"}


def test_upsert(spark):
    state = spark.createDataFrame([(1, "h1"), (2, "h2")], "gid long, digest string")
    fresh = spark.createDataFrame([(1, "h1"), (2, "h9"), (3, "h3")], "gid long, digest string")
    assert {(r.gid, r.digest, r.action) for r in ingest.upsert(state, fresh, "gid", "digest").collect()} == {(1, "h1", "kept"), (2, "h9", "updated"), (3, "h3", "created")}


def test_pdf_text_layers(spark, tmp_path):
    from scriptorium.sources import pdf

    made = pdf.searchable_pdf([[("Hello (x) \\ y", 10, 10, 100, 20), ("second liné", 10, 40, 100, 20)], [("next page", 1, 1, 50, 0.5)]], {"title": "T (1)", "author": "A"})
    assert pdf.pdf_text(made) == ("Hello (x) \\ y\nsecond liné\n\fnext page\n\f", {"title": "T (1)", "author": "A"})
    assert pdf.font_size(0.5) == 1.0 and pdf.font_size(20) == 15.0
    plain = b"%PDF-1.1\n1 0 obj << /Length 60 >> stream\nBT /F1 12 Tf (a\\)b) Tj 0 -14 Td [(c) -20 <64>] TJ T* (e) Tj ET          \nendstream endobj"
    assert pdf.pdf_text(plain)[0] == "a)b\ncd\ne\n\f"
    (tmp_path / "scan.pdf").write_bytes(pdf.searchable_pdf([[]]))
    (tmp_path / "bad.pdf").write_bytes(b"no")
    (tmp_path / "locked.pdf").write_bytes(b"%PDF-1.4 /Encrypt 1 0 R")
    got = {r.filename: (r.is_scan, r.error is None) for r in readers.extract(readers.ingest_files(spark, str(tmp_path))).collect()}
    assert got == {"scan.pdf": (True, True), "bad.pdf": (True, False), "locked.pdf": (True, False)}


def test_bytes_that_are_no_utf8(spark, tmp_path):
    raw = [b"a\xffb", b"\xe2\x82", b"\xf0\x9f\x98\x80 ok", b"\xc3\x28", b"\xed\xa0\x80", b"\xe2\x82\xac\x80"]
    for k, data in enumerate(raw):
        (tmp_path / f"{k}.txt").write_bytes(data)
    got = {r.filename: r.text for r in readers.text_documents(spark, str(tmp_path)).collect()}
    assert got == {f"{k}.txt": data.decode("utf-8", "replace") for k, data in enumerate(raw)}


def test_files_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", "x"), ("sub/b.txt", None)], "filename string, text string")
    listed = sinks.write_files(rows, f"file://{tmp_path}/out")
    assert sorted((r.path.rpartition("/out/")[2], r.bytes) for r in listed.collect()) == [("a.txt", 1), ("sub/b.txt", 0)]
    assert (tmp_path / "out" / "sub" / "b.txt").read_text() == ""
    sinks.write_json_array(rows, str(tmp_path / "json"))
    assert (tmp_path / "json" / "report.json").read_text() == json.dumps([{"filename": "a.txt", "text": "x"}, {"filename": "sub/b.txt", "text": None}], indent=2)
    for _ in range(2):
        sinks.append_csv(spark.createDataFrame([(" x ", 1)], "a string, b int"), str(tmp_path / "log"))
    assert sorted(line for p in (tmp_path / "log").glob("part-*") for line in p.read_text().splitlines()) == [" x ,1", " x ,1", "a,b"]


def test_failures_are_put_aside_and_the_pace_is_set(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"filename": f"f{k}", "text": "x" * k, "error": "no" if k == 1 else None}))
    out = tmp_path / "out"

    def run(**more):
        files = ingest.file_stream(spark, str(tmp_path / "in"), "filename string, text string, error string", files_each=1)
        return ingest.ingest(files, f"{out}/manifest", f"{out}/pages", f"{out}/checkpoint", failed=f"{out}/failed", **more)

    run().awaitTermination()
    assert len(list((out / "pages").glob("batch=*"))) == 3  # one file a micro-batch
    (tmp_path / "in" / "3.json").write_text(json.dumps({"filename": "f1", "text": None, "error": "no"}))
    query = run(pace="1 second")
    query.processAllAvailable()
    query.stop()
    assert [r.filename for r in spark.read.schema("md5 string, filename string, error string, batch long").parquet(f"{out}/failed").collect()] == ["f1"]
    assert {r.filename for r in spark.read.schema("md5 string, filename string, text string, batch long").parquet(f"{out}/pages").collect()} == {"f0", "f2"}


def test_command_line(spark, tmp_path, capsys):
    from scriptorium.__main__ import main

    assert main(["schema"]) == 0 and "local_identifier (required)" in capsys.readouterr().out
    (tmp_path / "in.csv").write_text('local_identifier,title,personal_name\n1,"A, b",jan van dyck\n2,,\n')
    assert main(["process", str(tmp_path / "in.csv"), str(tmp_path / "out"), "--normalize-names"]) == 0
    done = next((tmp_path / "out").glob("part-*")).read_text()
    assert next(csv.reader(io.StringIO(done)))[:2] == ["local_identifier", "title"] and '"Jan van Dyck"' in done
    assert main(["validate", str(tmp_path / "in.csv"), "--strict", "--details", "1"]) == 1
    assert "total 2, valid 0, invalid 2" in capsys.readouterr().out
    assert main(["stats", str(tmp_path / "in.csv"), "--top", "1"]) == 0 and "local_identifier: 2 of 2" in capsys.readouterr().out
    assert main(["template", str(tmp_path / "blank")]) == 0


def test_services_in_pages(spark, tmp_path):
    from scriptorium.sources import paged

    def make():
        def fetch(key, offset, limit):
            if key == "broken" and offset:
                raise OSError("gone")
            if key == "circle":
                return [{"n": 0}], "1"
            at, n = int(offset or 0), {"none": 0, "few": 3, "exact": 6, "broken": 9}.get(key, 50)
            return [{"n": k} for k in range(at, min(n, at + limit))], str(at + limit) if at + limit < n else None

        return fetch

    keys = spark.createDataFrame([(x,) for x in ["none", "few", "exact", "many", "broken", "circle", None]], "gid string")
    rows = paged.paged(keys, make, "n int", page=2, cap=6).collect()
    of = lambda key: sorted((r.at, r.item.n, r.truncated) for r in rows if r.parent == key and r.error is None)
    assert of("none") == [] and of("few") == [(k, k, False) for k in range(3)] and of("exact") == [(k, k, False) for k in range(6)]
    assert of("many") == [(k, k, True) for k in range(6)] and len(of("broken")) == 2 and len(of("circle")) == 2
    assert {(r.parent, r.at, r.item, r.error) for r in rows if r.error} == {("broken", None, None, "OSError: gone"), ("circle", None, None, "ValueError: page 1 comes again")}

    meta = ['{"metadata": {"mediatype": "texts"}, "files": [{"name": "a_djvu.txt"}]}', '{"metadata": {"mediatype": "audio"}}', "{}", "no", None]
    items = spark.createDataFrame([(f"i{k}", m) for k, m in enumerate(meta)], "identifier string, meta string")
    got = {r.identifier: r.x and tuple(r.x) for r in items.select("identifier", paged.archive_item("identifier", "meta").alias("x")).collect()}
    assert got == {"i0": ("texts", True, "i0.pdf"), "i1": ("audio", False, "i1.pdf"), "i2": None, "i3": None, "i4": None}

    def client():
        return lambda identifier, name: {"a": b"x"}[identifier]

    files = spark.createDataFrame([("a", "f"), ("b", "g")], "identifier string, name string")
    got = {r.identifier: (r.content and bytes(r.content), r.error) for r in paged.downloads(files, client).collect()}
    assert got == {"a": (b"x", None), "b": (None, "KeyError: 'b'")}


def test_only_whole_references_are_spelt_out(spark):
    page = "<html><head><title>a&amp;&amp</title></head><body><h1>b&amp;&amp</h1>&copy; &quot &am &unknown; &copyx; <!-- &amp --><script>&amp</script>&</body></html>"
    assert readers.html_text(page) == ("b&&amp\n© &quot &am &unknown; &copyx;\n&", "a&&amp")
    rows = readers.html_texts(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string"))
    assert {r.page_id: r.html_title for r in rows.collect()} == {1: "a&&amp", 2: ""}


def test_pages_without_text_agree_with_sql(spark, tmp_path):
    from scriptorium.plans import catalogue

    from .helpers import agree

    rows = [(1, None), (2, ""), (3, "<html><head><title> T&amp </title></head><body><script>x</script></body></html>"), (4, "<p>a&amp</p>&middot;\n b")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    agree(spark, catalogue.QUERIES["html_text_stats"], catalogue.SQL["html_text_stats"], tmp_path)


def test_small_files_are_dealt_over_the_cores_and_found_as_spark_finds_them(spark, tmp_path):
    for name in [f"n{k}.txt" for k in range(400)] + ["_no.txt", ".no.txt", "a=b.txt", "sub/deep.txt", "_sub/no.txt", "sub/.no/no.txt", "sub/ä b%20.txt", "empty.txt"]:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "empty.txt" else name.encode() + b"\xff")
    for deep in (False, True):
        own = readers.contents(spark, str(tmp_path), "*.txt", deep)
        theirs = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", str(deep).lower()).load(str(tmp_path))
        assert own.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism < theirs.rdd.getNumPartitions()
        # Spark's reader leaves empty files out
        assert sorted(own.where("content <> X''").collect()) == sorted(theirs.select("path", "content").collect())
        assert [r.path for r in own.where("content = X''").collect()] == [f"file:{tmp_path}/empty.txt"]


def test_patterns_and_partitions_of_folders_are_left_as_they_were(spark, tmp_path):
    (tmp_path / "k=1").mkdir()
    (tmp_path / "k=1" / "x.txt").write_text("x")
    assert [r.filename for r in readers.text_documents(spark, str(tmp_path)).collect()] == ["x.txt"]
    assert [r.filename for r in readers.text_documents(spark, f"{tmp_path}/*").collect()] == ["x.txt"]
    assert [r.filename for r in readers.text_documents(spark, str(tmp_path / "k=1"), "{x,y}.txt").collect()] == ["x.txt"]


def test_issues_without_text_are_read_back(spark, tmp_path):
    from scriptorium.plans import catalogue

    from .helpers import agree

    rows = [(0, "a"), (1, ""), (3, None), (2, "no issue"), (4, "b\né")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    agree(spark, catalogue.QUERIES["issues_scan"], catalogue.SQL["issues_scan"], tmp_path)
