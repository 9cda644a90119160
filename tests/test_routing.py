import base64
import datetime

from pyspark.sql import functions as F

from scriptorium.operators import routing


def test_routes_of_files_and_pages(spark):
    files = spark.createDataFrame([("a-hw.pdf", True), ("a.pdf", True), ("a.pdf", False), ("b.TIF", False), ("c.txt", False)], "name string, scan boolean")
    assert [r[0] for r in files.select(routing.content_route("name", F.col("scan"))).collect()] == ["handwritten", "print", "native_pdf", "print", "native"]
    good, bad = "words " * 20, "x 1 "
    rows = [("a", 1, good, "s"), ("a", 2, bad, "s"), ("b", 1, bad, "s"), ("b", 2, good, "s"), ("c", 1, good, None)]
    routed = routing.page_routes(spark.createDataFrame(rows, "doc string, page int, quick string, slow string"))
    assert {(r.doc, r.page, r.engine) for r in routed.collect()} == {("a", 1, "quick"), ("a", 2, "slow"), ("b", 1, "slow"), ("b", 2, "slow"), ("c", 1, "quick")}
    assert {(r.doc, r.method) for r in routing.document_methods(routed).collect()} == {("a", "mixed"), ("b", "slow"), ("c", "quick")}
    assert [r.filename for r in routing.file_slice(spark.createDataFrame([(x,) for x in "dbca"], "filename string"), 1, 3).collect()] == ["b", "c"]


def test_projects_and_threads(spark):
    fields = "array<struct<name: string, display_value: string>>"
    rows = spark.createDataFrame([(1, [("W", "In Progress")]), (2, [("W", " done ")]), (3, [("W", None)]), (4, [])], f"gid int, custom_fields {fields}")
    kept, skipped = routing.active_projects(rows, "W", ["Done"])
    assert [r.gid for r in kept.collect()] == [1] and {tuple(r) for r in skipped.collect()} == {("done", 1), ("", 2)}
    at = lambda k: datetime.datetime(2024, 1, k)
    box = lambda *x: spark.createDataFrame(list(x), "thread_id int, sent_at timestamp, subject string")
    got = routing.mail_threads(box((1, at(5), "a"), (2, at(1), "old")), box((1, at(6), "b")), F.lit(at(2)))
    assert [(r.thread_id, r.subject) for r in got.collect()] == [(1, "b")]


def fake_model():
    """A model: the text's first words, in base64."""
    return lambda texts: [base64.b64encode(" ".join(t.split()[:3]).encode()).decode() for t in texts]


def test_pages_and_models(spark):
    rows = spark.createDataFrame([("my_file-1.txt", "a b c d\nx\ny"), ("z.txt", None)], "name string, text string")
    page = rows.select(routing.document_page("name", "text", F.lit("2024-01-02"), lines=2)).first()[0]
    assert page.startswith('---\ntitle: "My File 1"\n') and page.endswith("a b c d\nx\n\n*[Preview: first 2 of 3 lines shown.]*\n")
    assert [(r.answer, r.answer_error) for r in routing.apply_model(rows, fake_model).collect()] == [("YSBiIGM=", None), ("", None)]

    def broken():
        def model(texts):
            if any("a" in t for t in texts):
                raise ValueError("no")
            return texts

        return model

    assert [(r.answer, r.answer_error) for r in routing.apply_model(rows, broken).collect()] == [(None, "ValueError: no"), ("", None)]
    one = rows.limit(1).select(routing.bounding_box(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(0.5)).alias("b"), routing.data_url(F.lit("a.PNG"), F.lit(b"x")).alias("u"), routing.long_date(F.lit(datetime.date(2024, 3, 5))).alias("d"), routing.part_headers(F.array(F.lit("p"), F.lit("q"))).alias("h")).first()
    assert (one.b.bbox, one.b.font_size, one.u, one.d, one.h) == ([1.0, 2.0, 4.0, 2.5], 1.0, "data:image/png;base64,eA==", "March 5, 2024", "[Part 1]\np\n\n[Part 2]\nq")
