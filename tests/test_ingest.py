import io
import zipfile

import pytest
from pyspark.sql import functions as F

from glyphmill.config import BLOCK_TAGS, BREAK_TAGS
from glyphmill.functions import formatting
from glyphmill.functions.selection import choice_from_json
from glyphmill.operators import evaluate, ingest, limiter, models, pages
from glyphmill.sources import corpus, golden
from glyphmill.sources.commits import Conflict
from glyphmill.streaming import ingest as stream
from glyphmill.streaming.limiter import limit_stream


def test_plan_store_and_purge(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path))
    schema = "text string, chunk_index int, source string"

    def run(docs, force=False):
        found = spark.createDataFrame([(s, f, len(c)) for s, f, c in docs], "source string, fingerprint string, chunks long")
        planned = ingest.plan(found, store.registry(), "m1", force).cache()
        planned.collect()
        chunks = spark.createDataFrame([(t, i, s) for s, _, c in docs for i, t in enumerate(c)] or [], schema)
        store.upsert(planned, chunks, "m1")
        return {r.source: r.status for r in planned.collect()}

    held = lambda: sorted((r.source, r.text) for r in store.chunks(schema).collect())
    assert run([("a b", "1", ["x", "y"]), ("c", "1", ["z"])]) == {"a b": "added", "c": "added"}
    assert run([("a b", "1", ["NO"]), ("c", "2", ["w", "v"])]) == {"a b": "unchanged", "c": "updated"}
    assert held() == [("a b", "x"), ("a b", "y"), ("c", "v"), ("c", "w")]
    assert run([("c", "3", [])]) == {"c": "empty"} and held() == [("a b", "x"), ("a b", "y")]
    assert [r.source for r in store.registry().collect()] == ["a b"]
    assert run([("a b", "1", ["x"])], force=True) == {"a b": "updated"} and held() == [("a b", "x")]
    assert store.purge("a b", schema) == 1 and held() == [] and store.registry().count() == 0
    assert run([("a b", "1", ["x"])]) == {"a b": "added"}


def test_guards(spark):
    assert ingest.ensure_model(None, "m") == "m" == ingest.ensure_model("m", "m")
    with pytest.raises(ingest.ModelMismatch):
        ingest.ensure_model("other", "m")
    assert ingest.recipe_state({}, 0)[0] == "written" and ingest.recipe_state({}, 5)[0] == "doubtful" and ingest.recipe_state({}, 5, force=True)[0] == "written"
    assert ingest.recipe_state({"chunk_size": 600, "pipeline_version": "1"}, 5)[0] == "ok"
    chunks = spark.createDataFrame([("s", 1, 0, "t", "old"), ("s", 2, 0, "u", None)], "source string, page int, chunk_no int, text string, title string")
    made = ingest.prepare_chunks(chunks, meta=("page", "title")).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.extra) for r in made] == [("s::chunk_0", {"page": "1", "title": "old"}), ("s::chunk_1", {"page": "2"})]
    rich = ingest.enrich(chunks, spark.createDataFrame([("s", "new", "me")], "source string, title string, author string")).collect()
    assert {(r.title, r.author) for r in rich} == {("new", "me")}


def test_limiter_matches_a_log(spark):
    import random

    def plain(times, most, window):
        log, out = [], []
        for t in sorted(times):
            log = [x for x in log if t - x < window]
            ok = len(log) < most
            out.append((t, ok, None if ok else max(1, -(-(window - (t - log[0])) // 1))))
            if ok:
                log.append(t)
        return out

    rng = random.Random(1)
    rows = [(k, float(rng.randint(0, 300))) for k in range(5) for _ in range(40)] + [(9, 0.0), (9, 20.0), (9, 60.0)]
    frame = spark.createDataFrame(rows, "user_id int, ts double")
    got = {}
    for r in limiter.limit(frame, 1, 60).collect():
        got.setdefault(r.key, []).append((r.ts, r.accepted, r.retry_after))
    for key in {k for k, _ in rows}:
        expected = plain([t for k, t in rows if k == key], 1, 60)
        assert sorted(got[key], key=lambda x: (x[0], not x[1])) == sorted(expected, key=lambda x: (x[0], not x[1]))
    assert got[9] == [(0.0, True, None), (20.0, False, 40), (60.0, True, None)]
    with pytest.raises(ValueError):
        limiter.limit(frame, 0, 60)


def test_limiter_stream_equals_batch(spark, small_dir, tmp_path):
    events = spark.read.parquet(f"{small_dir}/events.parquet").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = limit_stream(stream, 2, 86400).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    key = lambda rows: sorted((r.key, r.ts, r.accepted, r.retry_after or 0) for r in rows)
    assert key(spark.table("limited").collect()) == key(limiter.limit(events, 2, 86400).collect())


def test_pages(spark):
    rows = [("s", 1, 81, "a", True), ("s", 2, 81, "b", True), ("s", 3, 4, "c", False), ("s", 4, 4, "d", True), ("s", 5, 4, "e", False), ("t", 1, 4, "f", True)]
    merged = pages.merge_pages(spark.createDataFrame(rows, "source string, ord int, number int, text string, labelled boolean")).orderBy("source", "ord").collect()
    assert [(r.number, r.text, r.parts, r.labelled) for r in merged] == [(81, "a\nb", 2, True), (4, "c\nd", 2, True), (4, "e", 1, False), (4, "f", 1, True)]
    numbers = spark.createDataFrame([("s", n) for n in (6, 30, 31, 32, 32, 137, 138)] + [("e", None)], "source string, n int")
    assert [tuple(r) for r in pages.ranges(numbers, "source", "n").collect()] == [("s", "6, 30-32, 137-138")]
    assert pages.missing_pages(numbers.where("n < 33"), "source", "n").count() == 23
    names = spark.createDataFrame([(f"b{i}",) for i in range(5)], "name string")
    assert sorted(r.name for r in pages.latest(names, 2).collect()) == ["b0", "b1", "b2"]


def test_html_lines_match_a_parser(spark, small_dir):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")
            self.out += ["\n"] * (tag in (*BLOCK_TAGS, *BREAK_TAGS))

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")
            self.out += ["\n"] * (tag in BLOCK_TAGS)

        def handle_data(self, data):
            if not self.skip:
                self.out.append(" ".join(("x" + data + "x").split())[1:-1])

    rows = spark.read.parquet(f"{small_dir}/pages.parquet").select("page_id", "html", pages.html_lines(F.col("html")).alias("lines")).collect()
    for r in rows:
        p = Plain()
        p.feed(r.html)
        assert r.lines == [x for x in (" ".join(line.split()) for line in "".join(p.out).split("\n")) if x]


def epub(items, spine=None, label=True, broken=None):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        names = [f"P{i}" for i in range(len(items))]
        manifest = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in names)
        refs = "".join(f'<itemref idref="{n}"/>' for n in (spine or names))
        z.writestr("OEBPS/p.opf", f'<package xmlns:dc="d"><metadata><dc:title> The  Book </dc:title><dc:creator></dc:creator></metadata><manifest>{manifest}</manifest><spine>{refs}</spine></package>')
        for n, (page, body) in reversed(list(zip(names, items))):
            tag = f'<div class="x center">الجزء: 1 - الصفحة: {page}</div>' if page else ""
            z.writestr(f"OEBPS/{n}.xhtml", broken or f"<html><body><div>{body}</div>{tag}</body></html>")
    return data.getvalue()


def test_epub(spark):
    good = epub([("81", "one&nbsp;two<br/>three<p>four</p>"), ("٨١", "five &amp; six"), ("", "no label"), ("", "   ")])
    files = [("good.epub", good), ("bad.epub", b"nope"), ("spine.epub", epub([("1", "x")], spine=["zz"])), ("xml.epub", epub([("1", "x")], broken="<html>"))]
    out = corpus.epub_pages(spark.createDataFrame(files, "source string, content binary")).collect()
    rows = [r for r in out if r.source == "good.epub"]
    assert [(r.ord, r.number, r.text, r.labelled) for r in rows] == [(1, 81, "one two\nthree\nfour", True), (2, 81, "five & six", True), (3, 3, "no label", False)]
    assert rows[0].title == "The Book" and rows[0].author is None
    assert all(r.error for r in out if r.source != "good.epub") and len(out) == 6
    merged = pages.merge_pages(corpus.epub_pages(spark.createDataFrame(files[:1], "source string, content binary"))).orderBy("ord").collect()
    assert [r.text for r in merged] == ["one two\nthree\nfour\nfive & six", "no label"]


def test_listing(spark, tmp_path):
    for name in ("b.EPUB", "a.pdf", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    got = corpus.list_files(spark, [str(tmp_path), str(tmp_path / "absent")]).orderBy("source").collect()
    assert [(r.source, bytes(r.content)) for r in got] == [("a.pdf", b"a.pdf"), ("b.EPUB", b"b.EPUB")]


def test_golden(spark, tmp_path):
    lines = ["# note", "", '{"question": " Q ", "expected": [{"source": " s ", "page": 2}, {"source": "t"}]}', '{"id": "x", "question": "R", "expected": [], "status": "validated"}',
             "[1]", '{"question": "a"}', '{"question": "a", "expected": [{"source": "s", "page": true}]}', '{"question": "a", "expected": [{"source": " "}]}', '{"id": "x", "question": "b", "expected": []}', '{"question": "", "expected": []}', '{"question": "a", "expected": [], "status": "odd"}']
    frame = spark.createDataFrame(list(enumerate(lines, 1)), "number int, value string")
    got = {r.number: r for r in golden.parse_golden(frame).collect()}
    assert sorted(got) == [*range(3, 12)] and [n for n, r in sorted(got.items()) if r.error is None] == [3, 4]
    assert got[3].id == "q003" and got[3].question == "Q" and [tuple(e) for e in got[3].expected] == [("s", 2), ("t", None)]
    path = str(tmp_path / "gold.jsonl")
    (tmp_path / "gold.jsonl").write_text("\n".join(lines[:4]), encoding="utf-8")
    assert sorted(r.id for r in golden.read_golden(spark, path).collect()) == ["q003", "x"]
    (tmp_path / "gold.jsonl").write_text("\n".join(lines), encoding="utf-8")
    with pytest.raises(Exception, match="line"):
        golden.read_golden(spark, path).collect()
    rows = spark.createDataFrame([("q", False, 1, 0.5, 12.0)], "query_id string, out_of_corpus boolean, rank int, min_distance double, latency_ms double")
    golden.write_report(rows, {"model": "m"}, "run", 10, str(tmp_path / "report"))
    back = golden.read_report(spark, str(tmp_path / "report")).first()
    assert (back.query_id, back["rank"], back.k, back.context) == ("q", 1, 10, {"model": "m"})
    import random

    ids = spark.createDataFrame([(i,) for i in range(50)], "i long")
    drawn = sorted(r.i for r in golden.seeded_sample(ids, "i", 7, 3).collect())
    assert drawn == sorted(random.Random(3).sample(range(50), 7))


class Scripted:
    def __init__(self, answers):
        self.answers = answers

    def generate(self, prompts):
        return [self.answers.get(p, "") for p in prompts]

    def chat(self, conversations):
        """A rewrite is asked for with the prompt, the answer before as the model's own, and an instruction."""
        roles = [[m["role"] for m in c] for c in conversations]
        assert all(r in (["user"], ["user", "assistant", "user"]) for r in roles)
        assert all("RÉPONSE" in c[2]["content"].upper() and c[1]["content"] == self.answers[c[0]["content"]] for c in conversations if len(c) > 1)
        return [self.answers.get(c[0]["content"] + ("#2" if len(c) > 1 else ""), "") for c in conversations]


def test_models(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "prompt string").orderBy("prompt")
    said = {"a": "bonjour", "b": "مرحبا", "b#2": "salut", "c": "مرحبا", "c#2": " ", "d": "12"}
    out = {r.prompt: r.answer for r in models.answer_in_language(rows, Scripted(said), "fr").collect()}
    assert out == {"a": "bonjour", "b": "salut", "c": "مرحبا", "d": "12"}
    e = models.HashingEmbedder(8)
    vectors = models.embed(rows, e, "prompt", batch=2).collect()
    assert all(len(r.embedding) == 8 and abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in vectors)
    from glyphmill.functions.selection import choice_from_digits

    asks = spark.createDataFrame([("no", "s1", 3), ("yes", "s2", 3), ("odd", "s3", 3)], "prompt string, select_prompt string, n int")
    drafts, picks = Scripted({"no": "لا جواب", "yes": "نعم", "odd": "نعم"}), Scripted({"s2": "2", "s3": "9"})
    got = {r.prompt: r.choice for r in models.refuse_then_select(asks, drafts, picks, choice_from_digits).collect()}
    assert got == {"no": 0, "yes": 2, "odd": None}
    assert models.repeat(rows, 3).count() == 12


def test_formats(spark):
    s = "struct<source:string,title:string,page:int,line_start:int,line_end:int>"
    rows = [([("f", " T ", 1, 1, 2), ("f", "T", 2, 3, 4), ("g", None, 5, 1, 1)], ["x" * 210, "two\nlines"])]
    frame = spark.createDataFrame(rows, f"s array<{s}>, p array<string>")
    got = frame.select(formatting.format_sources(F.col("s"), "fr").alias("fr"), formatting.format_sources(F.slice("s", 3, 1)).alias("ar"), formatting.format_excerpts(F.col("p"), F.slice("s", 2, 2), "fr").alias("x")).first()
    assert got.fr == "T — page 1 (lignes 1-2), page 2 (lignes 3-4), g — page 5 (lignes 1-1)" and got.ar == "g — صفحة 5 (الأسطر 1-1)"
    assert got.x == "📄 Extraits cités :\n1. « " + "x" * 200 + "… » — T — page 2 (lignes 3-4)\n2. « two lines » — g — page 5 (lignes 1-1)"
    n = spark.createDataFrame([(0, 26.5 * 60, ["a"] * 7)], "n int, s double, l array<string>")
    assert tuple(n.select(formatting.counted(F.col("n"), "question"), formatting.duration(F.col("s")), formatting.examples(F.col("l")), formatting.french_percent(F.lit(0.85))).first()) == ("0 question", "26 min", "a, a, a, a, a (+2)", "85,0 %")


def test_store_keeps_old_versions_until_compacted(spark, tmp_path):
    store, schema = ingest.Store(spark, str(tmp_path / "a")), "text string, source string"
    for fingerprint, words in (("1", ["x", "y"]), ("2", ["z"])):
        planned = spark.createDataFrame([("s", fingerprint, len(words), "updated")], "source string, fingerprint string, chunks long, status string")
        store.upsert(planned, spark.createDataFrame([(w, "s") for w in words], schema), "m")
    assert store.count(schema) == store.count(schema, "s") == 1 and store.registered("s").fingerprint == "2" and store.registered("t") is None
    assert spark.read.parquet(store.chunks_path).count() == 3
    other = store.compact(schema, str(tmp_path / "b"))
    assert [r.text for r in other.chunks(schema).collect()] == ["z"] and spark.read.parquet(other.chunks_path).count() == 1
    assert other.purge("s", schema) == 1 and other.count(schema) == 0 and other.registry().count() == 0


def test_streaming_ingestion(spark, tmp_path):
    folder = tmp_path / "corpus"
    folder.mkdir()
    (folder / "good.epub").write_bytes(epub([("81", "one"), ("81", "two"), ("82", "three")]))
    (folder / "bad.epub").write_bytes(b"nope")
    (folder / "blank.epub").write_bytes(epub([("1", "  ")]))
    store = ingest.Store(spark, str(tmp_path / "store"))

    def run():
        query = stream.ingest_stream(spark, str(folder), store, str(tmp_path / "checkpoint"), "m")
        assert query.awaitTermination(300) and query.exception() is None
        return sorted((r.source, r.page, r.chunk_id, r.text, r.title) for r in store.chunks(stream.CHUNK_SCHEMA).collect())

    first = [("good.epub", 81, "good.epub::chunk_0", "one\ntwo", "The Book"), ("good.epub", 82, "good.epub::chunk_1", "three", "The Book")]
    assert run() == first and [(r.source, r.chunk_count) for r in store.registry().collect()] == [("good.epub", 2)]
    assert {r.source for r in spark.read.parquet(store.errors_path).collect()} == {"bad.epub"}
    (folder / "more.epub").write_bytes(epub([("5", "five")]))
    assert run() == [*first, ("more.epub", 5, "more.epub::chunk_0", "five", "The Book")]
    again = spark.createDataFrame([("more.epub", epub([("6", "six")])), ("good.epub", b"nope"), ("x.txt", b"")], "source string, content binary")
    for _ in range(2):  # a batch done again changes nothing
        stream.ingest_batch(again, store, "m")
        assert [r.text for r in store.chunks(stream.CHUNK_SCHEMA).where("source = 'more.epub'").collect()] == ["six"]
    assert store.count(stream.CHUNK_SCHEMA, "good.epub") == 2  # what can't be read leaves what there is


def test_dispatch_and_manifest(spark, tmp_path):
    files = [("a.EPUB", epub([("1", "x")])), ("b.pdf", b"%PDF nothing"), ("c.txt", b"t")]
    out = {r.source: (r.text, r.error) for r in corpus.pages_of(spark.createDataFrame(files, "source string, content binary")).collect()}
    assert out["a.EPUB"] == ("x", None) and "PDF" in out["b.pdf"][1] and "neither" in out["c.txt"][1]
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "f.bin").write_bytes(b"abc")
    (tmp_path / "d" / "g").write_bytes(b"")
    made = corpus.build_manifest(spark, str(tmp_path / "d"))
    assert [(r.path, r.size, r.sha256[:6]) for r in made.collect()] == [("e/f.bin", 3, "ba7816"), ("g", 0, "e3b0c4")]
    assert ingest.verify_manifest(made, made).count() == 0


def test_requests_of_rows_that_fail(spark, tmp_path):
    folder = str(tmp_path)

    def ask(word):
        import os

        if word == "down":
            raise ConnectionError("no answer")
        if word == "never":
            raise KeyError("wrong for good")
        if word == "late" and not os.path.exists(f"{folder}/{word}"):
            open(f"{folder}/{word}", "w").close()
            raise TimeoutError("later")
        return word.upper()

    rows = spark.createDataFrame([(i, w) for i, w in enumerate(["a", "down", "b", None, "never", "late", ""])], "i int, word string")
    out = models.request(rows, ask, "word", "said", tries=3, pause=0.01, permanent=(KeyError,), in_flight=2).collect()
    out.sort(key=lambda r: r.i)  # not by Spark, which would ask once more to range them
    assert [r.said for r in out] == ["A", None, "B", None, None, "LATE", ""]
    assert [r.said_tries for r in out] == [1, 3, 1, 0, 1, 2, 1]
    assert [r.said_error for r in out] == [None, "ConnectionError: no answer", None, None, "KeyError: 'wrong for good'", None, None]
    vectors = models.request(rows.limit(2), lambda w: [0.5, len(w)], "word", "v", "array<double>").collect()
    assert [list(r.v) for r in vectors] == [[0.5, 1.0], [0.5, 4.0]]
    with pytest.raises(ValueError):
        models.request(rows, ask, "word", "said", tries=0)


def test_writers_crashes_and_versions(spark, tmp_path):
    schema, folder = "text string, source string", str(tmp_path)
    store = ingest.Store(spark, folder)
    one = lambda s, f, n=1: spark.createDataFrame([(s, f, n, "updated")], "source string, fingerprint string, chunks long, status string")
    text = lambda s, t: spark.createDataFrame([(t, s)], schema)
    held = lambda version=None: sorted((r.source, r.text) for r in store.chunks(schema, version).collect())
    assert store.upsert(one("a", "1"), text("a", "x"), "m") == 1

    # a crash after the chunks: nothing is seen, and what is left can be cleared
    class Crash(Exception):
        pass

    def fail(*_):
        raise Crash

    crashing = ingest.Store(spark, folder)
    crashing._publish = fail
    with pytest.raises(Crash):
        crashing.upsert(one("a", "2"), text("a", "LOST"), "m")
    assert held() == [("a", "x")] and store.registered("a").fingerprint == "1" and spark.read.parquet(store.chunks_path).count() == 2

    # two writers from the same version: other documents get through, the same one doesn't
    base = store.log.latest()
    assert ingest.Store(spark, folder).upsert(one("b", "1"), text("b", "y"), "m", base) == 2
    assert store.upsert(one("c", "1"), text("c", "z"), "m", base) == 3
    with pytest.raises(Conflict, match="b was written"):
        store.upsert(one("b", "9"), text("b", "SECOND"), "m", base)
    assert held() == [("a", "x"), ("b", "y"), ("c", "z")] and held(1) == [("a", "x")]
    store.forget(spark.createDataFrame([("a",)], "source string"))
    assert held() == [("b", "y"), ("c", "z")] and held(3) == [("a", "x"), ("b", "y"), ("c", "z")]
    store.compact(schema)
    assert held() == [("b", "y"), ("c", "z")] and len(store.clear()) == 6 and held() == [("b", "y"), ("c", "z")]
    assert spark.read.parquet(store.chunks_path).count() == 2


def test_fingerprint_of_versions(spark, tmp_path):
    """Kept up by what each version adds and takes away, it is that of all chunks."""
    schema = "source string, chunk_id string"
    store = ingest.Store(spark, str(tmp_path))
    full = lambda: evaluate.fingerprint(store.chunks(schema))

    def put(*docs):
        planned = spark.createDataFrame([(s, f, len(c), "updated" if c else "empty") for s, f, c in docs], "source string, fingerprint string, chunks long, status string")
        store.upsert(planned, spark.createDataFrame([(s, c) for s, _, cs in docs for c in cs], schema), "m")

    seen = [store.fingerprint()]
    assert seen == [full()]
    for docs in ([("a", "1", ["a0", "a1"]), ("b", "1", ["b0"])], [("a", "2", ["a0", "a7"])], [("b", "2", [])], [("c", "1", ["c0"]), ("b", "3", ["b0", "b1"])]):
        put(*docs)
        assert store.fingerprint() == full()
        seen.append(full())
    store.forget(spark.createDataFrame([("a",), ("none",)], "source string"))
    assert store.fingerprint() == full() and store.fingerprint(2) == seen[2] and len(set(seen)) == 5
    store.compact(schema)
    assert store.fingerprint() == full()
    plain = ingest.Store(spark, str(tmp_path / "plain"))
    plain.upsert(spark.createDataFrame([("a", "1", 1, "added")], "source string, fingerprint string, chunks long, status string"), spark.createDataFrame([("x", "a")], "text string, source string"), "m")
    assert plain.fingerprint() is None


def test_golden_files(spark, tmp_path):
    questions = spark.createDataFrame(
        [("q1", "Où ?", [("s é", 2)], "fr", "draft", "n"), ("q2", "لماذا؟", [], "ar", "validated", "")], "id string, question string, expected array<struct<source:string,page:int>>, lang string, status string, notes string"
    )
    for part in ("id = 'q1'", "id = 'q2'"):
        golden.append_golden(questions.where(part), str(tmp_path / "gold"))
    lines = spark.read.text(str(tmp_path / "gold")).collect()
    assert len(lines) == 2 and any("لماذا" in r.value for r in lines)
    back = golden.strict(golden.parse_golden(spark.createDataFrame([(i, r.value) for i, r in enumerate(lines)], "number int, value string")))
    assert sorted((r.id, r.question, [tuple(e) for e in r.expected], r.lang, r.status, r.notes) for r in back.collect()) == [("q1", "Où ?", [("s é", 2)], "fr", "draft", "n"), ("q2", "لماذا؟", [], "ar", "validated", "")]
    assert [r.id for r in golden.subset(questions, [" q1 ", "zz"]).collect()] == ["q1"] and [r.id for r in golden.subset(questions, out_of_corpus_only=True).collect()] == ["q2"]
    assert golden.subset(questions).count() == 2
    with pytest.raises(ValueError):
        golden.subset(questions, ["q1"], out_of_corpus_only=True)


def test_report_head(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        rows = spark.createDataFrame([("a", False, 1, 0.5, 10.0), ("b", False, None, 0.6, 20.0), ("c", True, None, 0.7, 30.0)], "query_id string, out_of_corpus boolean, rank int, min_distance double, latency_ms double")
        golden.write_report(rows, {}, "run", 5, str(tmp_path), ["x"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    head = spark.read.json(f"{tmp_path}/head").first()
    assert head.created_at.endswith("+00:00") and head.ignored_ids == ["x"]
    assert head.summary.asDict() == {"count": 3, "answerable": 2, "out_of_corpus": 1, "ignored": 1, "hit_at_k": 0.5, "mrr": 0.5, "mean_latency_ms": 20.0}
    back = golden.read_report(spark, str(tmp_path)).collect()
    assert len(back) == 3 and {(r.label, r.k, tuple(r.ignored_ids)) for r in back} == {("run", 5, ("x",))}


def test_selection_answers_and_samples(spark):
    source = "struct<source:string,title:string,page:int,line_start:int,line_end:int>"
    s = [("f.pdf", "Book", 3, 1, 2), ("g.pdf", None, 4, 5, 6)]
    rows = spark.createDataFrame([("q1", ["one", " two "], s), ("q2", ["one"], s[:1]), ("q3", ["one"], s[:1]), ("q4", [], [])], f"question string, passages array<string>, sources array<{source}>")

    class Picks:
        def generate(self, prompts):
            return [{"q1": '{"passage": 9, "passage": 2}', "q2": '{"passage": 0}'}.get(next(q for q in ("q1", "q2", "q3") if q in p), "?") for p in prompts]

    out = {r.question: (r.choice, r.answer, r.raw) for r in models.select_answer(rows, Picks(), choice_from_json, "fr").collect()}
    assert out["q1"][0] == 2 and "two" in out["q1"][1] and "g.pdf — page 4 (lignes 5-6)" in out["q1"][1]
    assert out["q2"][:2] == (0, "") and out["q3"] == (None, "", "?") and out["q4"] == (None, "", "")
    few = spark.createDataFrame([(2, "b"), (1, "a"), (0, ""), (3, None)], "chunk_id int, text string")
    assert models.timing_sample(few, 4, 50) == (["a", "b"], True) and models.timing_sample(few, 1, 50) == (["a"], True)
    texts, real = models.timing_sample(few.where("chunk_id = 0"), 3, 50)
    assert [len(t) for t in texts] == [50] * 3 and not real and models.embedding_seconds(500, 30) == 15
    moved = evaluate.moves(*(spark.createDataFrame([(i, False, r) for i, r in x], "query_id int, out_of_corpus boolean, rank int") for x in ([(1, 2), (2, None), (3, 1)], [(1, 1), (2, None), (4, 1)])))
    assert {r.query_id: r.move for r in moved.collect()} == {1: "progressed", 2: "stable", 3: "only_reference", 4: "only_candidate"}
    assert len(evaluate.warnings_of({"k": 5, "fingerprint": "a", "chunks": 1}, {"k": 10, "fingerprint": "b", "chunks": 2}, moved)) == 3
