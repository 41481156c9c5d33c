import io
import re
import tracemalloc
import wave
import weakref
import zipfile
from collections import Counter
from urllib.parse import quote

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import patterns, speech
from lectern.operators import chapters, jobs, timing
from lectern import settings, storage
from lectern.plans import catalog
from lectern.sources import archives, audio, epub, markup, pdf
from lectern.streaming import progress

LONG = "word " * 60


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_heading_lines(spark):
    good = ["Chapter 7", "Chapter 12.", "CHAPTER III", "Part Two: Logic", "Prologue"]
    bad = ["part of the path.", "book progresses.", "chapters like this one are long", "partly cloudy skies were seen"]
    got = spark.createDataFrame([(x,) for x in good + bad], "x string").select("x", F.col("x").rlike(patterns.HEADING_LINE).alias("h")).collect()
    assert {r.x for r in got if r.h} == set(good)


def test_html_sections(spark):
    page = f"<html><head><title> T &amp; U </title><meta name='Author' content='Ann'></head><body><p>{LONG}</p><h1>3</h1><p>One</p><div>two<script>x</script></div><h2> Real </h2><div><p>in</p></div><h1>Empty</h1></body></html>"
    pages = spark.createDataFrame([(1, page), (2, "<p>only</p><pre>code</pre>"), (3, ""), (4, None)], "id int, html string")
    got = rows(markup.html_chapters(pages, "id", "html"), "book", "chapter_index")
    assert got == [(1, 0, "Preface", LONG.strip()), (1, 1, "Chapter 2", "One\n\ntwo"), (1, 2, "Real", "in"), (2, 0, "book", "only")]
    assert rows(markup.html_books(pages, "id", "html"), "book")[:2] == [(1, "T & U", "Ann"), (2, "book", "Unknown")]


def test_titles_and_headings(spark):
    pages = [
        (1, "<title>\n   My Book\n</title>"),
        (2, "<title>\n</title>"),
        (3, "<title>My Page</title><svg><title>Icon</title></svg>"),
        (4, "<title>A B</title><meta name='author' content='\u00a0 Ann '>"),
        (5, "<meta name='author'>"),
    ]
    got = rows(markup.html_books(spark.createDataFrame(pages, "id int, html string"), "id", "html"), "book")
    assert got == [(1, "My Book", "Unknown"), (2, "book", "Unknown"), (3, "My Page", "Unknown"), (4, "A B", "Ann"), (5, "book", "Unknown")]
    page = "<body>out<h1>Chapter <b>One</b></h1><p>a <i>b</i></p><h2> <b>Chapter</b> IV </h2><p>c</p></body>"
    got = rows(markup.html_chapters(spark.createDataFrame([(1, page), (2, "x <b>y</b>\n\nz"), (3, "<head><title>T</title></head><body>u</body>v")], "id int, html string"), "id", "html"), "book", "chapter_index")
    assert got == [(1, 0, "ChapterOne", "a b"), (1, 1, "ChapterIV", "c"), (2, 0, "book", "x\n\ny\n\nz"), (3, 0, "T", "u")]


def told(page):
    found = markup.walked(page)
    return [" ".join(found["pieces"][b["start"] : b["stop"]]) for b in found["blocks"]]


def test_nested_paragraphs_repeat():
    assert told("<p>a<p>b</p>") == ["a b", "b"]
    assert [b["leaf"] for b in markup.walked("<div><h1><p>a</p></h1><p>b</p></div><p>c")["blocks"]] == [False, False, True, True, True]


def test_unclosed_tags_cost_no_more():
    import time

    start = time.monotonic()
    found = markup.walked("<p>word<b>" * 100_000 + "</i></div>" * 100_000)
    assert len(found["pieces"]) == 100_000 and [b["leaf"] for b in found["blocks"][-2:]] == [False, True]
    assert time.monotonic() - start < 20


def book_file(items, **extra):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", "<container xmlns='urn:oasis:names:tc:opendocument:xmlns:container'><rootfiles><rootfile full-path='o/p.opf'/></rootfiles></container>")
        listed = "".join(f"<item id='{i}' href='{quote(h)}' media-type='application/xhtml+xml'/>" for i, h, _ in items)
        spine = "".join(f"<itemref idref='{i}'/>" for i, _, _ in items)
        z.writestr("o/p.opf", f"<package xmlns:dc='http://purl.org/dc/elements/1.1/'><metadata><dc:title> My Book</dc:title><dc:language>en</dc:language></metadata><manifest>{listed}<item id='c' href='cover.jpg' media-type='image/jpeg'/></manifest><spine>{spine}</spine></package>")
        z.writestr("o/cover.jpg", b"jpg")
        for _, h, text in items:
            z.writestr(f"o/{h}", text)
        for name, text in extra.items():
            z.writestr(f"META-INF/{name}.xml", text)
    return out.getvalue()


def test_epub(spark):
    items = [
        ("i0", "titlepage.xhtml", "<h1>Title</h1><p>front</p>"),
        ("i1", "a.xhtml", f"<h1>Chapter One</h1><p>{LONG}</p>"),
        ("i2", "b.xhtml", f"<p>{LONG}</p>"),
        ("i3", "c.xhtml", "<p>short</p>"),
        ("i4", "d.xhtml", f"<h2>II.</h2><p>{LONG}</p><pre>code</pre>"),
        ("i5", "ch03.xhtml", f"<p>An Early Title</p><p>{LONG}</p>"),
        ("i6", "x.xhtml", "<h1>Contents</h1><p>list</p>"),
    ]
    files = [("f1", book_file(items)), ("f2", b"no zip"), ("f3", book_file(items, encryption="<x>http://other</x>")), ("f4", book_file(items, encryption="<x>http://www.idpf.org/2008/embedding</x>"))]
    read = epub.opened(archives.entries(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")))
    told = {r.book: r for r in read.books().collect()}
    assert (told["f1"].title, told["f1"].author, told["f1"].language, told["f1"].cover_name) == (" My Book", "Unknown", "en", "cover.jpg")
    assert {r.book: bytes(r.cover) for r in read.covers().collect()}["f1"] == b"jpg"
    assert told["f2"].error and told["f3"].protected and not told["f4"].protected
    got = rows(read.chapters().filter("book = 'f1'"), "chapter_index")
    assert [(r[1], r[2]) for r in got] == [(0, "Chapter One"), (1, "Chapter 2"), (2, "An Early Title")]
    assert got[0][3] == f"{LONG.strip()}\n\n{LONG.strip()}" and "code" not in got[1][3]


def test_pages(spark):
    pages = [("a", 0, "lost\nChapter 1\n one \n\nPrologue"), ("a", 1, "two"), *[("b", k, f"p{k}" if k % 2 else " ") for k in range(20)]]
    got = rows(chapters.page_chapters(spark.createDataFrame(pages, "book string, page_no int, text string")), "book", "chapter_index")
    assert got[:2] == [("a", 0, "Chapter 1", " one "), ("a", 1, "Prologue", "two")]
    assert [(r[2], r[3].count("p")) for r in got[2:]] == [("Chapter 1", 7), ("Chapter 2", 3)]


@pytest.mark.parametrize("text", ["\n\n".join(f"Paragraph number {k}." for k in range(300)), "line\n" * 900, "word " * 900, "x" * 3100, "  " * 20])
def test_cap(spark, text):
    c = spark.createDataFrame([("b", 0, "T", text), ("b", 1, "U", "short")], "book string, chapter_index int, title string, text string")
    got = rows(chapters.cap_chapters(c, 1000), "chapter_index")
    assert all(len(r[3]) <= 1000 for r in got) and [r[1] for r in got] == list(range(len(got)))
    assert got[-1][2:] == ("U", "short")
    if len(text) > 1000:
        assert len(got) > 2 and got[0][2] == "T (part 1)"
        assert "".join("".join(r[3].split()) for r in got[:-1]) == "".join(text.split())


def test_timings_and_metadata(spark):
    d = spark.createDataFrame([("b", 0, 1.0, "One"), ("b", 1, 2.0, "Two")], "book string, chapter_index int, seconds double, title string")
    t = timing.timings(d)
    assert [r[-4:] for r in rows(t, "chapter_index")] == [(0.0, 1.0, 0, 1000), (1.0, 3.0, 1000, 3000)]
    text = timing.metadata_text(t, spark.createDataFrame([("b", "B", "A")], "book string, title string, author string")).first().metadata
    assert text.startswith(";FFMETADATA1\ntitle=B\nartist=A\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=1000\ntitle=One\n[CHAPTER]")
    assert timing.checked(t).first().complete
    gaps = timing.chapter_durations(spark.createDataFrame([("b", 0, 1.0), ("b", 0, 1.0), ("b", 1, 2.0)], "book string, chapter_index int, seconds double"))
    assert [r[2] for r in rows(gaps, "chapter_index")] == [2.3, 2.0]


def test_wav(spark):
    samples = np.array([0.0, 0.5, -1.0, 2.0], "float32")
    back, rate = audio.from_wav(audio.to_wav(samples))
    assert rate == 24000 and np.allclose(back, [0, 0.5, -1, 1], atol=1e-4)
    files = audio.wav_files(spark.createDataFrame([("p", [0.0, 0.5, -1.0, 2.0]), ("e", [])], "path string, samples array<float>"))
    assert {r.path: len(r.samples) for r in audio.wav_samples(files).collect()} == {"p": 4, "e": 0}
    q = spark.createDataFrame([([0.0, 0.5, -1.0, 2.0],)], "a array<double>").select(speech.quantized(F.col("a"))).first()[0]
    assert q == [0, 16383, -32767, 32767]
    levels = spark.createDataFrame([("a", [0.5, 0.5]), ("a", [0.001, 0.0]), ("b", [0.1])], "voice string, samples array<float>")
    assert [(r.voice, r.verdict) for r in audio.voice_quality(levels).orderBy("voice").collect()] == [("a", "FLAG"), ("b", "OK")]


class Shy:
    """Silent at first; then as many samples as characters."""

    def __init__(self):
        self.asked = 0

    def synthesize(self, text, voice, speed):
        self.asked += 1
        return np.full(len(text), 0.5 if self.asked > 1 and "mute" not in text else 0.0)


def test_engine_plugs_in(spark):
    chunks = spark.createDataFrame([(1, "hello"), (2, "mute"), (3, "")], "k int, text string").coalesce(1)
    got = {r.k: r.samples for r in audio.synthesized(chunks, Shy, "v").collect()}
    assert got == {1: [0.5] * 5, 2: [0.0] * 4, 3: []}


def test_chapters_of_chunks(spark):
    chunks = spark.createDataFrame([("b", 0, 1, [3.0]), ("b", 0, 0, [1.0, 2.0]), ("b", 1, 0, [])], "book string, chapter_index int, chunk_index int, samples array<float>")
    assert rows(audio.assembled(chunks, 20, 100), "chapter_index") == [("b", 0, [1.0, 2.0, 0.0, 0.0, 3.0]), ("b", 1, [])]
    assert rows(audio.assembled(chunks, 0, 100), "chapter_index")[0][2] == [1.0, 2.0, 3.0]


def test_a_chunk_without_speech_is_empty(spark):
    df = spark.createDataFrame([("] ... !!",), ("One. Two",)], "t string").withColumn("plan", speech.plan(F.col("t")))
    parts = F.transform("plan", lambda s: F.array_repeat(F.lit(0.5).cast("float"), F.length(s["segment"])))
    got = df.select("t", speech.audio(parts, F.transform("plan", lambda s: s["pause"]), 10).alias("a")).collect()
    assert {r.t: [round(x, 1) for x in r.a] for r in got} == {"] ... !!": [], "One. Two": [0.5] * 4 + [0.0] * 4 + [0.5] * 3}


def test_jobs(spark):
    e = [(1, 1, "cleaning", 5.0), (1, 2, "synthesizing", None), (1, 3, "cancelled", None), (1, 4, "done", 100.0), (2, 5, None, 1.0)]
    events = spark.createDataFrame(e, "job int, event_id int, status string, pct double")
    got = rows(jobs.latest(jobs.absorbing(events, "job", ["event_id"]), "job", ["event_id"], ["status", "pct"]), "job")
    assert got == [(1, "cancelled", 5.0, 3), (2, None, 1.0, 1)]
    reason = lambda *v: spark.range(1).select(jobs.rejection(*[F.lit(x) for x in v])).first()[0]
    assert reason("a.EPUB", 10, 100, False, 1) is None
    assert reason("a.doc", 0, 100, False, 1) == "unsupported type"
    assert reason("a.pdf", 10, 20, False, 1) == "not enough disk space"
    assert reason("a.pdf", 10, 100, True, 1) == "protected"
    assert reason("a.pdf", 10, 100, None, None) == "cannot be parsed"


def test_odd_uploads_as_in_the_sql(spark, tmp_path):
    """Null and negative ids, documents without characters; the rule itself refuses what has no bytes."""
    ids = [None, *range(-40, 41), *range(2500, 2540)]
    docs = spark.createDataFrame([(i, n) for n in (None, 0, 1, 1000, 1001, 2097, 2098) for i in ids], "doc_id long, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["upload_admission"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["upload_admission"](spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(want) and len(got) == 7 * len(ids)
    assert spark.range(1).select(jobs.rejection(*map(F.lit, ("a.pdf", 0, 100, False, 1)))).first()[0] == "empty file"


def test_stream_equals_batch(spark, tmp_path):
    schema = "job_id int, event_id int, ts int, status string, progress_pct double, current_chapter string"
    e = [(k % 3, k, k // 2, None if k % 4 == 0 else f"s{k}", float(k) if k % 2 else None, None) for k in range(40)]
    events = spark.createDataFrame(e, schema)
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = progress.event_stream(spark, str(tmp_path / "e"), events.schema)
    assert rows(progress.fold_available(stream), "job_id") == rows(progress.fold(events), "job_id")


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    assert settings.load(path) == settings.Settings()
    path.write_text("{broken")
    assert settings.load(path).max_concurrent_jobs == 1
    path.write_text('{"max_concurrent_jobs": 0, "voice": "bm_x", "other": 1}')
    assert (settings.load(path).max_concurrent_jobs, settings.load(path).voice) == (1, "bm_x")
    settings.save(settings.load(path), path)
    assert settings.load(path).voice == "bm_x"


def test_pdf_inputs(spark):
    files = spark.createDataFrame([(1, bytearray(b"%PDF trailer << /Encrypt 5 0 R >>")), (2, bytearray(b"%PDF \xff")), (3, None), (4, bytearray(b"%PDF a book on /Encrypt and /EncryptMetadata"))], "id int, content binary")
    assert rows(files.select("id", pdf.encrypted(F.col("content"))), "id") == [(1, True), (2, False), (3, False), (4, False)]
    assert rows(pdf.pages(spark.createDataFrame([("a", 0, None)], "book string, page_no int, text string")), "page_no") == [("a", 0, "")]


def test_subscribe(spark, tmp_path):
    events = spark.createDataFrame([(k % 2, k, k, f"s{k}") for k in range(6)], "job_id int, event_id int, ts int, status string")
    events.write.parquet(str(tmp_path / "e"))
    got = []
    progress.subscribe(progress.event_stream(spark, str(tmp_path / "e"), events.schema), 1, got.extend, str(tmp_path / "c")).awaitTermination()
    assert [r.status for r in got] == ["s1", "s3", "s5"]


def test_fold_is_a_table_in_the_shared_folder(spark, tmp_path):
    events = spark.createDataFrame([(k % 3, k, k, f"s{k}", 1.0, None) for k in range(9)], "job_id int, event_id int, ts int, status string, progress_pct double, current_chapter string")
    events.write.parquet(str(tmp_path / "e"))
    got = progress.fold_available(progress.event_stream(spark, str(tmp_path / "e"), events.schema))
    assert got.inputFiles() and all(spark.conf.get("spark.checkpoint.dir") in f for f in got.inputFiles())
    assert rows(got, "job_id") == rows(progress.fold(events), "job_id")
    (tmp_path / "none").mkdir()
    assert progress.fold_available(progress.event_stream(spark, str(tmp_path / "none"), events.schema)).collect() == []


def test_subscribe_hands_on_no_list(spark, tmp_path):
    events = spark.createDataFrame([(1, k, k, f"s{k}") for k in range(6)], "job_id int, event_id int, ts int, status string")
    events.write.parquet(str(tmp_path / "e"))
    got = []
    progress.subscribe(progress.event_stream(spark, str(tmp_path / "e"), events.schema), 1, lambda taken: got.append((isinstance(taken, list), [r.status for r in taken])), str(tmp_path / "c")).awaitTermination()
    assert got == [(False, [f"s{k}" for k in range(6)])]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_large_book_is_numbered_in_cells(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages = spark.range(400).selectExpr("if(id % 4 = 0, 'b' || id % 8, 'a') book", "int(id) page_no", "if(id % 5 < 3, 'Chapter ' || id || '\n', '') || 'x' || id text")
        cells = {}
        for r in chapters.in_cells(pages, "page_no").select("book", "_cell").distinct().collect():
            cells.setdefault(r.book, set()).add(r[1])
        assert len(cells["a"]) > 1
        want = {}
        for r in pages.orderBy("page_no").collect():
            made = want.setdefault(r.book, [])
            head, _, body = r.text.rpartition("\n")
            made += [[head, body]] if head else []
            if not head and made:
                made[-1][1] += "\n" + body
        got = rows(chapters.page_headings(pages), "book", "chapter_index")
        assert got == [(b, k, *c) for b in sorted(want) for k, c in enumerate(want[b])]
        groups = rows(chapters.page_groups(pages, 5), "book", "chapter_index")
        assert [g[1] for g in groups if g[0] == "a"] == list(range(80)) and [g[2] for g in groups if g[0] == "b0"] == [f"Chapter {k + 1}" for k in range(50)]
        capped = chapters.cap_chapters(pages.withColumnRenamed("page_no", "chapter_index").withColumn("title", F.lit("T")), 8)
        assert [r[1] for r in rows(capped.filter("book = 'a'"), "chapter_index")] == list(range(capped.filter("book = 'a'").count()))
        for made in (chapters.page_headings(pages), chapters.page_groups(pages, 5), capped):
            assert set(re.findall(r"windowspecdefinition\(book#\w+, (\w+)#", plan(made))) <= {"_cell", "from"}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_headings_are_numbered_without_a_row_per_section(spark):
    pages = spark.createDataFrame([(b, k, "\n".join(f"Chapter {j}\nx{j}" for j in range(40))) for b in "ab" for k in range(3)] + [("a", 3, "on")], "book string, page_no int, text string")
    with storage.lifetime(spark) as made:
        got = rows(chapters.page_headings(pages), "book", "chapter_index")
        assert max(spark.read.parquet(path).count() for path in made) <= 7
    assert [r[1] for r in got if r[0] == "a"] == list(range(120)) and got[119][2:] == ("Chapter 39", "x39\non") and got[120] == ("b", 0, "Chapter 0", "x0")


def test_absorbing_splits_a_job_of_many_events(spark):
    e = [(1, 1, "cleaning"), (1, 2, "failed"), (1, 2, "failed"), (1, 3, "done"), (None, 1, "done"), (None, 2, "cleaning"), (2, None, "cleaning"), (2, 4, None)]
    events = spark.createDataFrame(e, "job int, event_id int, status string")
    got = jobs.absorbing(events, "job", ["event_id"])
    assert "Window" not in plan(got)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 1, "cleaning"), (1, 2, "failed"), (None, 1, "done"), (2, None, "cleaning"), (2, 4, None)], key=repr)


def test_follow_ends_with_the_job(spark, tmp_path):
    schema = "job_id int, event_id int, ts int, status string, progress_pct double, current_chapter string"
    put = lambda *e: spark.createDataFrame(e, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    put((1, 1, 1, "cleaning", 0.0, None), (1, 2, 2, None, 5.0, "A"), (2, 3, 3, "cleaning", 0.0, None))
    got = []

    def take(some):
        found = [(r["status"], r["progress_pct"]) for r in some]
        got.extend(found)
        if found == [("cleaning", 5.0)]:
            put((1, 4, 4, "synthesizing", 20.0, "B"))
        elif found == [("synthesizing", 20.0)]:
            put((1, 5, 5, "done", 100.0, None), (2, 6, 6, "failed", 0.0, None))

    kind = spark.createDataFrame([], schema).schema
    progress.follow(spark, str(tmp_path / "e"), kind, 1, take, str(tmp_path / "c"))
    assert got == [("cleaning", 5.0), ("synthesizing", 20.0), ("done", 100.0)]
    progress.follow(spark, str(tmp_path / "e"), kind, 1, take, str(tmp_path / "d"))
    assert got[3:] == [("done", 100.0)]


def test_appending(spark, tmp_path):
    path = str(tmp_path / "jobs")
    row = lambda *v: spark.createDataFrame([v], "id string, status string")
    jobs.appended(row("a", "queued"), path)
    assert sorted(map(tuple, jobs.appended(row("a", "later").unionAll(row("b", "queued")), path).collect())) == [("a", "queued"), ("b", "queued")]
    broken = row("c", "x").withColumn("status", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        jobs.appended(broken, path)
    assert jobs.Table(spark, path, broken.schema).read().count() == 2


def test_job_creation(spark):
    requests = spark.createDataFrame([("j1", "b1", "v", 1.0), ("j2", "b2", "v", 1.0), ("j3", "none", "v", 1.0)], "id string, book_id string, voice string, speed double")
    books = spark.createDataFrame([("b1", "T", 1000), ("b2", "U", 10_000)], "id string, title string, total_chars long")
    got = {r.id: (r.status, r.refused, r.estimated_seconds) for r in jobs.created(requests, books, 20_000, F.lit(True)).collect()}
    assert got == {"j1": ("queued", None, 10.5), "j2": (None, "not enough disk space", None), "j3": (None, "no such book", None)}
    assert {r.refused for r in jobs.created(requests, books, 20_000, F.lit(False)).collect()} == {"no engine"}


def test_written_tables_are_discarded(spark):
    from lectern import storage

    table = storage.written(spark.range(5))
    assert table.count() == 5
    storage.discard(table, spark.range(3))
    with pytest.raises(Exception):
        spark.read.schema(table.schema).parquet(*table.inputFiles()).count()


EVENT = "job_id int, event_id int, ts int, status string, progress_pct double, current_chapter string"


def test_follow_loses_nothing_between_state_and_tail(spark, tmp_path):
    """Events that are written while the state is handed out, the terminal one among them, come through the tail."""
    put = lambda *e: spark.createDataFrame(e, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    put((1, 1, 10, "cleaning", 0.0, None))
    got = []

    def take(some):
        got.append([(r["status"], r["progress_pct"]) for r in some])
        if len(got) == 1:
            put((1, 2, 11, "synthesizing", 20.0, "A"), (1, 3, 12, "done", 100.0, None), (1, 4, 13, "cleaning", 0.0, None))

    progress.follow(spark, str(tmp_path / "e"), spark.createDataFrame([], EVENT).schema, 1, take, str(tmp_path / "c"))
    assert got == [[("cleaning", 0.0)], [("synthesizing", 20.0), ("done", 100.0)]]


def test_follow_tells_late_and_repeated_events(spark, tmp_path):
    put = lambda *e: spark.createDataFrame(e, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    put((1, 5, 50, "synthesizing", 40.0, "B"))
    got = []

    def take(some):
        rows = [r.asDict() for r in some]
        got.extend(rows)
        if rows and rows[-1]["status"] == "synthesizing":
            # One that is late, one that is known, a later one.
            put((1, 2, 20, "cleaning", 10.0, "A"), (1, 5, 50, "synthesizing", 40.0, "B"), (1, 6, 60, None, 50.0, None))
        elif rows and rows[-1]["progress_pct"] == 50.0:
            put((1, 3, 30, "failed", None, None))

    progress.follow(spark, str(tmp_path / "e"), spark.createDataFrame([], EVENT).schema, 1, take, str(tmp_path / "c"))
    assert [(r["event_id"], r["late"], r["last"], r["status_now"], r["progress_pct_now"], r["current_chapter_now"]) for r in got[1:]] == [
        (2, True, False, "synthesizing", 40.0, "B"),
        (6, False, False, "synthesizing", 50.0, "B"),
        (3, True, True, "synthesizing", 50.0, "B"),
    ]


def test_tail_of_odd_events(spark, tmp_path):
    odd = [(None, 1, 1, "cleaning", None, None), (None, 2, 2, "done", None, None), (None, 3, 3, "cleaning", None, None), (1, None, None, None, None, None), (1, None, None, None, None, None), (1, 7, 7, "x", 1.0, "c"), (1, 7, 7, "x", 1.0, "c")]
    spark.createDataFrame(odd, EVENT).write.parquet(str(tmp_path / "e"))
    told = progress.tail_available(progress.event_stream(spark, str(tmp_path / "e"), spark.createDataFrame([], EVENT).schema))
    got = sorted(((r.job_id, r.event_id, r.n, r.last, r.status_now) for r in told.collect()), key=str)
    assert got == sorted([(None, 1, 1, False, "cleaning"), (None, 2, 2, True, "done"), (1, None, 1, False, None), (1, None, 2, False, None), (1, 7, 3, False, "x")], key=str)
    (tmp_path / "none").mkdir()
    assert progress.tail_available(progress.event_stream(spark, str(tmp_path / "none"), told.select("job_id", "event_id", "ts", "status", "progress_pct", "current_chapter").schema)).collect() == []


def test_times_as_numbers_and_back(spark):
    """Any kind of time keeps its order and comes back, before 1970 too."""
    for kind in ("timestamp", "timestamp_ntz", "int"):
        times = "5, -7, 0" if kind == "int" else "'2024-03-31 02:30:00.123456', '1969-12-31 23:59:59.999999', '1970-01-01 00:00:00'"
        df = spark.sql(f"SELECT CAST(t AS {kind}) AS t FROM (SELECT explode(array({times})) AS t)").select("t", progress._number(F.col("t"), kind).alias("n"))
        got = df.select("t", "n", progress._time(F.col("n"), kind).alias("back")).collect()
        assert all(r.t == r.back for r in got)
        assert [r.t for r in sorted(got, key=lambda r: r.n)] == sorted(r.t for r in got)


def test_archives_as_a_source(spark, tmp_path):
    """A large archive is read by several tasks, a damaged one gives an error row, and so does a damaged entry."""
    folder = tmp_path / "books"
    (folder / "more").mkdir(parents=True)
    items = [(f"i{k}", f"a b/{k}.xhtml", f"<h1>Part {k}</h1><p>{LONG}{k}</p>") for k in range(30)]
    whole = book_file(items)
    (folder / "large.epub").write_bytes(whole)
    (folder / "more" / "bad.epub").write_bytes(b"no zip")
    (folder / "empty.epub").write_bytes(b"")
    at = whole.index(b"a b/7.xhtml") + 40
    (folder / "torn.epub").write_bytes(whole[:at] + b"\xff" * 30 + whole[at + 30 :])
    rows_ = archives.zip_entries(spark, str(folder), split=1500)
    assert rows_.rdd.getNumPartitions() > 3
    wrong = {(r.path.rpartition("/")[2], r.entry) for r in rows_.filter("error IS NOT NULL").collect()}
    assert wrong == {("bad.epub", None), ("empty.epub", None), ("torn.epub", "o/a b/7.xhtml")}
    read = epub.opened(rows_)
    books = {r.book.rpartition("/")[2]: r for r in read.books().collect()}
    assert [k for k, r in sorted(books.items()) if r.error is None] == ["large.epub"]
    got = rows(read.chapters(), "chapter_index")
    assert [r[2] for r in got] == [f"Part {k}" for k in range(30)] and {r[0].rpartition("/")[2] for r in got} == {"large.epub"}
    names = archives.zip_entries(spark, str(folder / "large.epub"), entries=r"\.opf$").filter("content IS NOT NULL").collect()
    assert [r.entry.rpartition(".")[2] for r in names] == ["opf"]
    (tmp_path / "none").mkdir()
    assert archives.zip_entries(spark, str(tmp_path / "none")).collect() == []


def test_damaged_inputs_are_rows_with_errors(spark):
    page = spark.createDataFrame([(1, "<h1>A</h1><p>one</p>"), (2, "<![foo[x]]>"), (3, None), (4, "<!DOCTYPE [<!x ]>")], "id int, html string")
    told = {r.book: r.error for r in markup.html_errors(page, "id", "html").collect()}
    assert set(told) <= {2, 4} and told[2].startswith("AssertionError")
    assert {r.book for r in markup.html_chapters(page, "id", "html").collect()} <= {1, 4}
    wide = io.BytesIO()
    with wave.open(wide, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(b"abc")
    sounds = spark.createDataFrame([("a", bytearray(audio.to_wav([0.5]))), ("b", bytearray(b"RIFF")), ("c", None), ("d", bytearray(wide.getvalue()))], "path string, content binary")
    got = {r.path: (r.samples is None, r.error is None) for r in audio.wav_samples(sounds).collect()}
    assert got == {"a": (False, True), "b": (True, False), "c": (True, False), "d": (True, False)}


def test_walks_hold_few_documents_at_a_time(monkeypatch):
    monkeypatch.setattr("lectern.sources.batches.SLICE", 20_000)
    page = "<html><body>" + "".join(f"<h2>{k}</h2><div><p>some <b>text</b></p></div>" for k in range(20)) + "</body></html>"
    peaks, total = [], []
    for n in (100, 400):
        given = pa.record_batch({"id": list(range(n)), "markup": [page] * n})
        tracemalloc.start()
        total.append(sum(b.num_rows for b in markup.walks(iter([given]))))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert total == [100, 400] and peaks[1] < 1.5 * peaks[0]
    assert list(markup.walks(iter([]))) == []


def test_walks_let_go_of_what_is_walked():
    """Of the batches that a task gets, no more are alive than the last one, and none when it has ended."""
    made, most = [], []
    alive = lambda: sum(r() is not None for r in made)

    def given():
        for k in range(5):
            most.append(alive())
            batch = pa.record_batch({"id": [k], "markup": [f"<p>{k}</p>"]})
            made.append(weakref.ref(batch))
            yield batch
            del batch

    assert [r["pieces"] for b in markup.walks(given()) for r in b.to_pylist()] == [[str(k)] for k in range(5)]
    assert max(most) == 1 and not alive()


def test_chapters_are_made_in_the_row_of_the_walk(spark):
    """No exchange, and documents of one id or of none are not mixed."""
    pages = [(None, "<h1>A</h1><p>one</p>"), (None, f"<p>{LONG}</p><h1>B</h1><p>two</p>"), (7, "<h1>3</h1><p>x</p>"), (7, "<h1>Ca</h1><p>y</p><h1>Do</h1><p>z</p>")]
    made = markup.html_chapters(spark.createDataFrame(pages, "id int, html string"), "id", "html")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = sorted((tuple(r) for r in made.collect()), key=str)
    want = [(None, 0, "A", "one"), (None, 0, "Preface", LONG.strip()), (None, 1, "B", "two"), (7, 0, "Chapter 1", "x"), (7, 0, "Ca", "y"), (7, 1, "Do", "z")]
    assert got == sorted(want, key=str)


def test_a_heading_without_text_starts_a_chapter(spark):
    items = [("b", 0, "i", "x", "One", ["body"], "body"), ("b", 1, "i", "x", "", [], ""), ("b", 2, "i", "x", None, [LONG], LONG), ("b", 3, "i", "x", None, [], "")]
    df = spark.createDataFrame(items, "book string, pos int, item_id string, href string, heading string, paragraphs array<string>, text string")
    assert rows(chapters.spine_chapters(df), "chapter_index") == [("b", 0, "One", "body"), ("b", 1, "Chapter 2", f"\n\n{LONG}")]


def test_charsets(spark):
    """Byte order marks, declarations, neither, and what is wrong with them."""
    text = "<p>é “x” €</p>"
    cases = {
        "utf8": (text.encode(), "utf-8", text),
        "bom8": (b"\xef\xbb\xbf" + text.encode(), "utf-8", text),
        "bom16": (b"\xff\xfe" + text.encode("utf-16-le") + b"x", "utf-16le", text),
        "be": (b"\xfe\xff" + text.encode("utf-16-be"), "utf-16be", text),
        "said": (b"<meta charset='Latin1'>" + text.encode("cp1252"), "windows-1252", f"<meta charset='Latin1'>{text}"),
        "guessed": (text.encode("cp1252"), "windows-1252", text),
        "equiv": ("<META content='text/html; charset=\"KOI8-R\"'>да".encode("koi8-r"), "koi8-r", "<META content='text/html; charset=\"KOI8-R\"'>да"),
        "wrong16": (b"<meta charset=utf-16>a", "utf-8", "<meta charset=utf-16>a"),
        "comment": (b"<!-- <meta charset=koi8-r> -->a", "utf-8", "<!-- <meta charset=koi8-r> -->a"),
        "unknown": (b"<meta charset=what>a", "what", None),
        "broken": (b"<meta charset=utf-8>a\xffb", "utf-8", "<meta charset=utf-8>a�b"),
        "empty": (b"", "utf-8", ""),
    }
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in cases.items()] + [("null", None)], "id string, content binary")
    got = {r.id: (r.charset, r.markup) for r in markup.decoded(df).collect()}
    assert got.pop("null")[1] is None
    assert got == {k: v[1:] for k, v in cases.items()}


def test_parts_of_chapters_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    chunks, want = [], {}
    for book in range(3):
        for chapter in range(4):
            made = []
            for k in range(int(rng.integers(1, 6))):
                samples = [float(x) for x in rng.integers(1, 9, int(rng.integers(0, 25)))]
                chunks.append((book, chapter, k * 3, samples))
                made += ([0.0] * 12 if k else []) + samples
            want |= {(book, chapter, p // 10): made[p : p + 10] for p in range(0, len(made), 10)}
    df = spark.createDataFrame(chunks, "book int, chapter_index int, chunk_index int, samples array<float>")
    parts = audio.assembled_parts(df, 120, 100, 10)
    got = {(r.book, r.chapter_index, r.part): r.samples for r in parts.collect()}
    assert got == want
    whole = {(r.book, r.chapter_index): r.samples for r in audio.assembled(df, 120, 100).collect()}
    files = {}
    for r in audio.wav_parts(parts, 100).orderBy("part").collect():
        files[r.book, r.chapter_index] = files.get((r.book, r.chapter_index), b"") + bytes(r.content)
    for k, content in files.items():
        samples, rate = audio.from_wav(content)
        assert rate == 100 and content == audio.to_wav(np.array(whole[k]), 100)
        assert len(samples) == len(whole[k])
    assert "collect_list(samples" not in plan(parts)


def test_marks_do_not_depend_on_partitions(spark):
    chunks = spark.range(3000).selectExpr("int(id % 3) book", "int(id DIV 3 DIV 10) chapter_index", "int(id DIV 3 % 10) chunk_index", "id * 7919 % 5003 n_samples")
    marks = [sorted(map(tuple, timing.sample_marks(audio.sample_offsets(chunks.repartition(n), 300, 24_000), 24_000).collect())) for n in (1, 7)]
    assert marks[0] == marks[1]
    ends = {}
    for r in sorted(chunks.collect()):
        begun = ends.setdefault((r.book, r.chapter_index), [0, 0])
        begun[0] += r.n_samples + (7200 if begun[1] else 0)
        begun[1] += 1
    at = {}
    for (book, chapter), (n, _) in sorted(ends.items()):
        start = at.get(book, 0)
        at[book] = start + n
        assert (book, chapter, start, start + n, start * 1000 // 24_000, (start + n) * 1000 // 24_000) in marks[0]


class Mute:
    def synthesize(self, text, voice, speed):
        if text == "...":
            raise audio.Unspeakable(text)
        return np.full(4, 0.5)


def test_what_an_engine_cannot_say_is_silence(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "...")], "k int, text string")
    assert {r.k: r.samples for r in audio.synthesized(chunks, Mute, "v").collect()} == {1: [0.5] * 4, 2: []}


def test_resume_against_plain_sets(spark):
    """Repeated rows, null keys, clashing names, changed content and a filter that is full."""
    schema = "block string, id long, bit string, row int, perhaps string, bitmap string"
    rows = [(f"b{k % 5}", k % 4000 if k % 11 else None, f"c{k % 3}", k, None, "x") for k in range(6000)]
    chapters = spark.createDataFrame(rows, schema)
    built = {(k, f"c{k % 3}") for k in range(0, 4000, 2)} | {(k, "old") for k in range(1, 4000, 2)}
    done = spark.createDataFrame([*built, *list(built)[:50], (None, "c1"), (7, None)], "id long, bit string")
    want = [r for r in rows if (r[1], r[2]) not in built]
    for bits in (jobs.MOST_BITS, 1 << 15, 64):
        got = jobs.to_do(chapters, done, ["id", "bit"], bits)
        assert got.columns == chapters.columns and sorted(map(tuple, got.collect()), key=lambda r: r[3]) == want
    assert jobs.to_do(chapters, done.limit(0), ["id", "bit"]).count() == 6000 and jobs.to_do(chapters.limit(0), done, ["id", "bit"]).count() == 0
    # Types that differ are joined as they always were.
    assert jobs.to_do(chapters, done.withColumn("id", F.col("id").cast("int")), ["id", "bit"]).count() == len(want)


@pytest.mark.parametrize("share", [0, 10, 50, 100])
def test_resume_shuffles_what_may_be_done(spark, share):
    chapters = spark.range(20_000).withColumn("text", F.lit("words"))
    told = jobs.perhaps_done(chapters, chapters.filter(f"id % 100 < {share}").select("id"), ["id"])
    by = {r.perhaps: r["count"] for r in told.groupBy("perhaps").count().collect()}
    # All that are done, and of the others one in sixteen at most, by chance.
    assert 200 * share <= by.get(True, 0) <= 200 * share + (20_000 - 200 * share) / 12
