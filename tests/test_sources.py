import json
import zipfile

from pyspark.sql import functions as F

from tessera.jobs import index
from tessera.sources import files, tables
from tessera.streaming import events, ingest

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def make_folder(folder):
    (folder / "sub").mkdir()
    (folder / "a.TXT").write_text("plain text here")
    (folder / "b.md").write_text("# Head\n\nbody")
    (folder / "sub" / "c.html").write_text("<p>para</p><script>x</script>")
    (folder / "d.csv").write_text("x,y\n1,\n,2\n,\n")
    (folder / "e.json").write_text('{"k": "é"}')
    (folder / "f.json").write_text("{broken")
    (folder / "g.docx").write_bytes(b"no archive")
    with zipfile.ZipFile(folder / "h.docx", "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (folder / "i.doc").write_text("old")
    (folder / "skip.exe").write_text("no")


def test_folder(spark, tmp_path):
    make_folder(tmp_path)
    listed = {r.source: r.suffix for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(listed) == {"a.TXT", "b.md", "sub/c.html", "d.csv", "e.json", "f.json", "g.docx", "h.docx", "i.doc"}
    read = {r.source: r.text for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert read["a.TXT"] == "plain text here" and read["b.md"] == "Head\nbody" and read["sub/c.html"] == "para"
    assert read["d.csv"] == "x: 1.0\ny: 2.0" and json.loads(read["e.json"]) == {"k": "é"} and read["h.docx"] == "One\nTwo"
    assert read["f.json"] is None and read["g.docx"] is None and read["i.doc"] is None


def test_parsers_for_paged_formats(spark, tmp_path):
    def fake_pages(content):
        """Pages at form feeds; a line with bars is a table's row."""
        if content.startswith(b"bad"):
            raise ValueError("no such format")
        pages = []
        for page in content.decode().split("\f"):
            lines = page.split("\n")
            cells = [[c or None for c in x.split("|")] for x in lines if "|" in x]
            pages.append({"text": "\n".join(x for x in lines if "|" not in x), "tables": [cells, []] if cells else None, "images": [{"width": 3, "height": 4}] if "pic" in page else []})
        return pages

    (tmp_path / "a.pdf").write_text("one pic\f\fthree\nh1|h2\n1|\n|2\n3|3\n4|4")
    (tmp_path / "b.pdf").write_text("bad")
    (tmp_path / "c.txt").write_text("plain")
    read = {r.source: (r.text, r.file_hash) for r in files.read_folder(spark, str(tmp_path), {".pdf": fake_pages}).collect()}
    assert read["a.pdf"][0] == "[Page 1]\none pic\n\n[Page 3]\nthree\n\n[Table on page 3]\nHeaders: h1 | h2\n1\n2\n3 | 3\n\n[Image on page 1: 3x4 pixels]"
    assert read["b.pdf"] == (None, None) and read["c.txt"][0] == "plain" and read["a.pdf"][1]
    assert {r.source: r.text for r in files.read_folder(spark, str(tmp_path)).collect()}["a.pdf"] is None
    content = spark.createDataFrame([("x", b"one\f\ftwo"), ("none", None)], "source string, content binary")
    assert [tuple(r) for r in files.pages_text(files.pages_of(content, fake_pages), plain=True).collect()] == [("x", "one\n\ntwo")]


def test_workbook(tmp_path):
    sheet = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    path = tmp_path / "x.xlsx"
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("xl/workbook.xml", f'<workbook xmlns="{sheet}" xmlns:r="{link}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        archive.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/one.xml"/></Relationships>')
        archive.writestr("xl/sharedStrings.xml", f'<sst xmlns="{sheet}"><si><t>name</t></si><si><t>n</t></si><si><t>Ann</t></si></sst>')
        cells = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>3</v></c></row><row><c r="B3"><v>4</v></c></row>'
        archive.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{sheet}"><sheetData>{cells}</sheetData></worksheet>')
    assert files.xlsx_text(path.read_bytes()) == "Sheet: S\nname: Ann, n: 3\nn: 4"


def test_page_parts(rows):
    pages = rows([("f", 2, "two"), ("f", 1, "one"), ("f", 3, " ")], "source string, page int, text string")
    assert files.page_text(pages).first().text == "[Page 1]\none\n\n[Page 2]\ntwo"
    shown = rows([(3, 10, 20)], "p int, w int, h int").select(files.image_text(F.col("p"), F.col("w"), F.col("h")).alias("t")).first()
    assert shown.t == "\n[Image on page 3: 10x20 pixels]"


def documents(rows, *entries):
    data = [(s, t, h) for s, t, h in entries]
    return rows(data, "source string, text string, file_hash string").withColumn("file_modified", F.lit("2024-01-01").cast("timestamp"))


def test_stream_of_documents(spark, rows, tmp_path):
    inbox, path = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "source string, text string, file_hash string, file_modified timestamp"
    for entry in (("a", "first", "1"), ("b", "second", "2")):
        documents(rows, entry).coalesce(1).write.mode("append").parquet(inbox)
        ingest.stream_into(spark.readStream.schema(schema).parquet(inbox), path, str(tmp_path / "state")).awaitTermination()
    assert {r.source for r in tables.chunks(spark, path).collect()} == {"a", "b"}


def test_late_events_are_left_out(spark, rows, tmp_path):
    inbox = str(tmp_path / "events")
    make = lambda *t: rows([(i, x, 1, "k", 1.0, "") for i, x in enumerate(t)], "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    make("2024-01-01 10:00:00", "2024-01-01 23:00:00").coalesce(1).write.parquet(inbox)
    counted = lambda: events.windowed_counts(events.read_events(spark, inbox, "*.parquet"))
    run = lambda: events.run_to_table(counted(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    make("2024-01-03 10:00:00").coalesce(1).write.mode("append").parquet(inbox)
    run()
    make("2024-01-01 11:00:00", "2024-01-05 00:00:00").coalesce(1).write.mode("append").parquet(inbox)
    run()
    found = {(str(r.window_start.date()), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("2024-01-01", 2) in found and ("2024-01-01", 1) not in found


def test_whole_index(rows):
    texts = [(f"s{i}", " ".join(f"word{(i * 7 + j) % 50}" for j in range(30)), str(i)) for i in range(8)]
    built, centroids = index.build_index(documents(rows, *texts, ("copy", texts[0][1], "x")), 16, 0.999)
    found = built.collect()
    assert len({r.chunk_hash for r in found}) == len(found) and centroids.count() >= 1
    assert all(len(r.vector) == 16 for r in found)


def test_pages_of_many_files_share_batches(spark, rows, monkeypatch):
    """No frame a file: pages of files of all kinds leave in Arrow batches, broken and empty files among them."""
    monkeypatch.setattr(files, "PAGES_ROWS", 7, raising=False)

    def parse(content):
        n = len(content)
        if n % 5 == 0:
            raise ValueError("broken")
        return [{"text": f"p{i}", "tables": [[["a", None], [str(n)]]], "images": [{"width": n, "height": None}]} if i % 2 else {} for i in range(n % 4)]

    frame = rows([(f"f{n}", bytes(n)) for n in range(60)] + [("none", None)], "source string, content binary").repartition(2)
    found = files.pages_of(frame, parse)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.source, r.page): (r.text, r.tables, [tuple(i) for i in r.images]) for r in found.collect()}
    assert got == {(f"f{n}", i + 1): (f"p{i}", [[["a", None], [str(n)]]], [(n, None)]) if i % 2 else ("", [], []) for n in range(60) if n % 5 for i in range(n % 4)}
