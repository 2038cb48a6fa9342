import hashlib
import io
import json
import time
import zipfile
import zlib
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from glyphmill import settings
from glyphmill.operators import hooks, translate
from glyphmill.sources import files, formats, sinks, store


def test_documents(spark, tmp_path):
    for name, data in {"a.txt": "héllo".encode(), "bom.txt": b"\xef\xbb\xbfhi", "wide.txt": "wide".encode("utf-16"), "bad.txt": b"ab\xff", "bell.txt": b"a\x07", "x.pdf": b"%PDF", "y.odt": b"z", "z.docx": b"PK", ".hidden.txt": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.title: (r.text, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a": ("héllo", None), "bom": ("hi", None), "wide": ("wide", None), "bad": (None, "undecodable"), "bell": (None, "control_characters"), "x": (None, "empty"), "y": (None, "unsupported"), "z": (None, "unreadable")}
    loose = {r.title: r.text for r in files.read_documents(spark, str(tmp_path), strict=False).collect()}
    assert loose["bad"] == "ab" and loose["x"] is None


def test_library_and_corpus(spark, tmp_path):
    for book, names in {"Ann Lee - The Sea": ["Chapter 10.txt", "Chapter 2.txt"], "Plain": ["1.txt", "book.json"], ".cache": ["no.txt"]}.items():
        (tmp_path / book).mkdir()
        for n in names:
            (tmp_path / book / n).write_text(json.dumps({"title": "Given", "author": " "}) if n == "book.json" else "text")
    got = sorted((r.title, r.author, r.place, r.chapter) for r in files.read_library(spark, str(tmp_path)).collect())
    assert got == [("Given", "unknown", 1, "1"), ("The Sea", "Ann Lee", 1, "Chapter 2"), ("The Sea", "Ann Lee", 2, "Chapter 10")]
    assert {r.lang for r in files.read_corpus(spark, str(tmp_path)).collect()} >= {"Plain"}
    paths = spark.createDataFrame([("a/b.txt",), ("../x",), ("/etc",), ("a/../../b",), ("",)], "p string")
    assert [r[0] for r in paths.select(files.safe_path(F.col("p"))).collect()] == [True, False, False, False, False]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", "<x>"), (2, "b", None)], "id int, lang string, t string")
    p = str(tmp_path / "t")
    sinks.replace_partitions(d, p, "lang")
    sinks.replace_partitions(d.filter("lang = 'a'").withColumn("id", F.lit(9)), p, "lang")
    assert {(r.id, r.lang) for r in spark.read.parquet(p).collect()} == {(9, "a"), (2, "b")}
    sinks.export_lines(d, ["id", "t"], str(tmp_path / "l"))
    back = translate.parse_lines(files.read_lines(spark, str(tmp_path / "l")), "line")
    assert [(r.source_word, r.target_word) for r in back.collect()] == [("1", "<x>")]
    sinks.export_csv(d, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert [r.row for r in sinks.html_table(d, ["t"]).collect()] == ["<tr><td>&lt;x&gt;</td></tr>", "<tr><td></td></tr>"]


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf(*pages, cmap=None):
    """A small file: a page per content stream, the first one compressed."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages))), len(pages))]
    numbered = dict(enumerate(objects, 1))
    numbered[3] = b"<< /Type /Font /Subtype /Type1" + (b" /ToUnicode 4 0 R" if cmap else b"") + b" >>"
    numbered[4] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap or b""), cmap or b"")
    for k, content in enumerate(pages):
        body = content if k else zlib.compress(content)
        numbered[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (11 + 2 * k)
        numbered[11 + 2 * k] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(body), b"" if k else b" /Filter /FlateDecode", body)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in numbered.items())


def test_formats():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('c')}{cell('d')}</w:tr></w:tbl>"
    assert formats.docx_text(docx(p("One") + "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r></w:p>" + table)) == "One\nx\ty\na\tb\nc\td"
    rtf = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\*\generator x;}Caf\'e9 \b bold\b0\par \u1044?\u1072?! \{a\}\tab z}"
    assert formats.rtf_text(rtf) == "Café bold\nДа! {a}\tz"
    with pytest.raises(ValueError):
        formats.rtf_text(b"plain")
    data = pdf(b"BT /F1 12 Tf (Hello \\(you\\)) Tj 0 -14 Td [(Wor) -10 (ld) -400 (again)] TJ ET", b"BT /F1 9 Tf (Page \\101) Tj ET")
    assert formats.pdf_text(data) == "Hello (you)\nWorld again\nPage A"
    mapped = pdf(b"BT /F1 12 Tf <00010002> Tj ET", cmap=b"2 beginbfchar <0001> <0414> <0002> <0430> endbfchar")
    assert formats.pdf_text(mapped) == "Да"
    with pytest.raises(ValueError):
        formats.pdf_text(b"%PDF-1.4 trailer << /Encrypt 9 0 R >>")


def test_formats_in_a_folder(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("<w:p><w:r><w:t>word</w:t></w:r></w:p>"))
    (tmp_path / "b.RTF").write_bytes(rb"{\rtf1 rich}")
    (tmp_path / "c.pdf").write_bytes(pdf(b"BT (portable) Tj ET"))
    (tmp_path / "d.txt").write_bytes(b"plain")
    got = {r.title: (r.extension, r.text, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a": ("docx", "word", None), "b": ("rtf", "rich", None), "c": ("pdf", "portable", None), "d": ("txt", "plain", None)}


def test_store_settings_and_profiles(spark, tmp_path):
    s = store.ObjectStore(spark, str(tmp_path / "objects"))
    s.put("a/b.bin", b"\x00\xffx")
    assert s.get("a/b.bin") == b"\x00\xffx" and s.get("no") is None and s.delete("a/b.bin") and not s.delete("a/b.bin")
    with pytest.raises(ValueError):
        s.get("../x")
    path = str(tmp_path / "weights.json")
    assert settings.load_weights(path) == settings.RankingWeights()
    settings.save_weights(path, settings.RankingWeights(0.5, 0.5))
    assert settings.load_weights(path) == settings.RankingWeights(0.5, 0.5)
    (tmp_path / "weights.json").write_text('{"sentence_extraction_weight": 0.5, "textrank_weight": 0.9}')
    assert settings.load_weights(path) == settings.RankingWeights()
    with pytest.raises(ValueError):
        settings.save_weights(path, settings.RankingWeights(0.5, 0.6))
    rows = {("en", "the", 3.0), ("en", "a", 1.0), ("ru", "и", 2.0)}
    assert sinks.save_profiles(spark.createDataFrame(list(rows), "lang string, word string, weight double"), s, "p.json") == {"en": 2, "ru": 1}
    assert {tuple(r) for r in files.read_profiles(spark, str(tmp_path / "objects/p.json")).collect()} == rows
    (tmp_path / "b.csv").write_text("file_name,file_path,language,token_count,summary_sentence_count,keyword_count,cumulative_token_count,extraction_seconds,cleaning_seconds,language_detection_seconds,summarization_seconds,total_seconds,cumulative_seconds\na,b,en,1,2,3,4,0.1,0.2,0.3,0.4,1.0,1.0\n")
    assert files.read_benchmark(spark, str(tmp_path / "b.csv")).first().total_seconds == 1.0


def test_hooks(spark):
    d = spark.createDataFrame([(1, "one two"), (2, None), (3, "x" * 300 + "\ufffd"), (4, "")], "doc_id bigint, text string")
    embed = hooks.embedder(lambda texts: [[len(t), 1.0] for t in texts])
    v = spark.createDataFrame([(1, [9.0, 9.0])], "vec_id bigint, embedding array<double>")
    got = {r.doc_id: (r.embedding, r.stored) for r in hooks.backfill(d, "doc_id", "text", v, "vec_id", "embedding", embed).collect()}
    assert got == {1: ([9.0, 9.0], True), 2: (None, False), 3: ([301.0, 1.0], False), 4: ([0.0, 1.0], False)}
    for model, want in ((lambda t: "clean " * 50, ("clean " * 50).strip()), (lambda t: "short", "x" * 300), (lambda t: 1 / 0, "x" * 300)):
        assert {r.doc_id: r.t for r in d.select("doc_id", hooks.cleaned_by(model)(F.col("text")).alias("t")).collect()}[3] == want
    parse = hooks.annotator(lambda s: [{"i": 0, "text": s, "head": 0}])
    assert d.select(parse(F.col("text")).alias("t")).first().t[0].text == "one two"
    assert store.vectors_to_json and d.select(store.vectors_from_json(store.vectors_to_json(F.array(F.lit(1.5)))).alias("v")).first().v == [1.5]


def test_hashed_embedding_reads_each_word_once(spark):
    d = spark.createDataFrame([(1, "Sea, sea sky"), (2, None), (3, "42"), (4, "word " * 300_000), (5, "sea")], "doc_id bigint, text string")
    v = spark.createDataFrame([(5, [0.5, -0.5]), (6, [1.0, 1.0]), (1, None)], "vec_id bigint, embedding array<double>")
    hooks.backfill(d.filter("doc_id < 4"), "doc_id", "text", v, "vec_id", "embedding").collect()  # starts what a first run waits for
    started = time.time()
    got = {r.doc_id: (r.embedding, r.stored) for r in hooks.backfill(d, "doc_id", "text", v, "vec_id", "embedding").collect()}
    assert time.time() - started < 20
    at = {w: (int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 64, 1.0 if hashlib.md5(w.encode()).hexdigest()[6] < "8" else -1.0) for w in ("sea", "sky", "word")}
    want = [[sum(at[w][1] * n for w, n in words.items() if at[w][0] == k) for k in range(64)] for words in ({"sea": 2, "sky": 1}, {"word": 300_000}, {})]
    assert got == {1: (want[0], False), 2: (None, False), 3: (want[2], False), 4: (want[1], False), 5: ([0.5, -0.5], True)}
    assert d.filter("doc_id = 3").select(hooks.hashed_embedding(F.col("text"), 3).alias("v")).first().v == [0.0] * 3


def test_xlsx(spark, tmp_path):
    path = str(tmp_path / "t.xlsx")
    sinks.export_xlsx(spark.createDataFrame([(1, "a<&>\x07"), (2, None), (3, "é")], "id int, t string").coalesce(1), path, 3)
    with zipfile.ZipFile(path) as z:
        sheets = [z.read(f"xl/worksheets/sheet{k}.xml").decode() for k in (1, 2)]
        assert "xl/worksheets/sheet3.xml" not in z.namelist() and all(ElementTree.fromstring(z.read(n)) is not None for n in z.namelist())
    assert "a&lt;&amp;&gt;<" in sheets[0] and sheets[0].count("<row>") == 3 and sheets[1].count("<row>") == 2 and "<v>3</v>" in sheets[1]
