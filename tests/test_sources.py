"""Files, routing and streaming ingest."""

import zipfile

import pytest
from pyspark.sql import functions as F

from stratadoc.operators.upsert import PointTable
from stratadoc.plans import router
from stratadoc.sources import files, markup, office
from stratadoc.streaming import ingest

S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def write_xlsx(path, sheets):
    with zipfile.ZipFile(path, "w") as out:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        out.writestr("xl/workbook.xml", f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets>{names}</sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        shared = []
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for r, row in enumerate(rows, 1):
                cells = ""
                for c, v in enumerate(row):
                    if v is None:
                        continue
                    ref = f"{chr(65 + c)}{r}"
                    if isinstance(v, str):
                        shared.append(v)
                        cells += f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
                    else:
                        cells += f'<c r="{ref}"><v>{v}</v></c>'
                body += f'<row r="{r}">{cells}</row>'
            out.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{S}"><sheetData>{body}</sheetData></worksheet>')
        out.writestr("xl/sharedStrings.xml", f'<sst xmlns="{S}">' + "".join(f"<si><t>{v}</t></si>" for v in shared) + "</sst>")


def write_docx(path):
    p = lambda t, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = "<w:tbl>" + "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in (("Category", "Amount"), ("x", "1"), ("y", ""))) + "</w:tbl>"
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{p("Title here", "h1")}{p("Body text")}{table}{p("")}{p("An item", "lp")}</w:body></w:document>')
        out.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}"><w:style w:styleId="h1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="lp"><w:name w:val="List Paragraph"/></w:style></w:styles>')


@pytest.fixture
def folder(tmp_path):
    long = "a sentence that is well over forty characters long, so its column counts"
    write_xlsx(tmp_path / "b.xlsx", {"Data": [["only one", None, None], ["ref", "n", "body"], ["r1", 5, long], ["r2", None, None], ["r3", 7, long + " again"]], "_hidden": [["a", "b", long]]})
    write_docx(tmp_path / "a.docx")
    (tmp_path / "c.txt").write_text("x")
    return str(tmp_path)


def test_folder_scan(spark, folder):
    out = files.scan(spark, folder)
    assert [r.name for r in out.collect()] == ["a.docx", "b.xlsx"] and all(len(r.sha256) == 64 for r in out.collect())
    assert files.scan(spark, folder, only_supported=False).count() == 3
    with pytest.raises(ValueError, match="no parser"):
        files.parse(out, ".pdf")


def test_sheets(spark, folder):
    cells = files.parse(files.scan(spark, folder), ".xlsx")
    assert cells.where("sheet = 'Data'").count() == 11
    out = office.sheet_chunks(cells).orderBy("row").collect()
    assert [(r.sheet, r.row, r.ref) for r in out] == [("Data", 3, "r1"), ("Data", 5, "r3")] and out[0].text.startswith("body: a sentence") and out[0].lang == "en"


def test_documents(spark, folder):
    out = office.docx_blocks(files.parse(files.scan(spark, folder), ".docx")).orderBy("reading_order").collect()
    assert [(r.block_type, r.text) for r in out] == [("heading", "Title here"), ("paragraph", "Body text"), ("table", "Category: x | Amount: 1\nCategory: y"), ("list_item", "An item")]


def test_markup(spark):
    html = "<html><script>var t='<p>no</p>'</script><h1>A &amp; B</h1><!-- <p>no</p> --><p class='x'>one\n <b>two</b></p><ul><li>i</li></ul><p> </p><table><tr><td>1</td><td>2</td></tr></table></html>"
    out = markup.html_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).collect()
    assert [(r.block_type, r.text) for r in out] == [("heading", "A & B"), ("paragraph", "one two"), ("list_item", "i"), ("table", "1 2")]


class Fake(router.Extractor):
    def __init__(self, name, table, fails=False):
        self.name, self.table, self.fails, self.seen = name, table, fails, None

    def extract(self, documents, options):
        self.seen = sorted(r.document_id for r in documents.collect())
        if self.fails:
            raise router.Unavailable
        return documents.join(self.table, "document_id")


def test_router_stages(spark):
    attempts = lambda *rows: spark.createDataFrame(list(rows), "document_id string, outcome string, accepted_pages int, needs_review_pages int, score double")
    first = Fake("fast", attempts(("a", "ok", 2, 0, 90.0), ("b", "ok", 0, 0, 10.0), ("c", "failed", 0, 0, None), ("d", "failed", 0, 0, None)))
    gone = Fake("gone", None, fails=True)
    last = Fake("slow", attempts(("b", "ok", 0, 0, 30.0), ("c", "ok", 0, 1, 50.0), ("d", "failed", 0, 0, None)))
    docs = spark.createDataFrame([(x, ".pdf") for x in "abcd"], "document_id string, extension string")
    tried = router.staged(docs, [first, gone, last], router.Options("t"))
    out = {r.document_id: (r.extractor, r.outcome, r.warnings) for r in router.chosen(tried).collect()}
    assert last.seen == ["b", "c", "d"] and gone.seen == ["b", "c", "d"]
    assert out["a"] == ("fast", "ok", []) and out["c"] == ("slow", "ok", ["fast_failed", "gone_unavailable"])
    assert out["b"] == ("slow", "best_effort", ["fast_insufficient_output", "gone_unavailable", "slow_insufficient_output", "all_routes_insufficient"])
    assert out["d"] == (None, "failed", ["fast_failed", "gone_unavailable", "slow_failed"])


def test_streaming_ingest_replays_to_the_same_points(spark, tmp_path):
    landing, points, jobs = (str(tmp_path / n) for n in ("landing", "points", "jobs"))
    rows = lambda *names: spark.createDataFrame([(n, "src", "word " * (30 if n != "short" else 2)) for n in names], ingest.LANDING)
    rows("a", "b", "short").write.mode("append").parquet(landing)
    held = PointTable(spark, points)
    run = lambda checkpoint: ingest.start(spark, landing, held, jobs, str(tmp_path / checkpoint), tenant_id="t1", acl_groups=["g1"]).awaitTermination()
    run("one")
    want = {r.chunk_id: r.point_id for r in held.read().collect()}
    assert set(want) == {"t1:src-a_0", "t1:src-b_0"}
    assert {r.document_id: r.status for r in ingest.jobs(spark, jobs).collect()} == {"a": "indexed", "b": "indexed", "short": "failed"}
    run("one")  # nothing new
    run("two")  # everything again
    assert {r.chunk_id: r.point_id for r in held.read().collect()} == want
    rows("c").write.mode("append").parquet(landing)
    run("one")
    assert held.read().count() == 3 and held.read().where(F.array_contains("acl_groups", "g1")).count() == 3
    with pytest.raises(ValueError):
        ingest.start(spark, landing, held, jobs, str(tmp_path / "x"), tenant_id="t", acl_groups=[])


def test_union_of_tenants_needs_groups(spark):
    df = spark.createDataFrame([("1",)], "chunk_id string")
    with pytest.raises(ValueError):
        files.union_tenants([("a", ["g"], df), ("b", [], df)])
