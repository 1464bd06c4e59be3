import random

from pyspark.sql import functions as F

from glyphmill.functions import chunking, selection


def plain_split(line, size):
    if len(line) <= size:
        return [line]
    out = []
    while len(line) > size:
        at = line.rfind(" ", 0, size + 1)
        at = size if at <= 0 else at
        out.append(line[:at])
        line = line[at:].lstrip()
    return [*out, line] if line else out


def plain_chunks(text, size):
    pieces = [(n, p) for n, line in enumerate(text.split("\n"), 1) for p in plain_split(line, size)]
    out, held, length, first, last = [], [], 0, 1, 1
    for n, p in pieces:
        if held and length + len(p) >= size:
            out.append(("\n".join(held).strip(), first, last))
            held, length, first = [], 0, n
        held.append(p)
        length += len(p) + 1
        last = n
    if held and "\n".join(held).strip():
        out.append(("\n".join(held).strip(), first, last))
    return out


def texts():
    rng = random.Random(11)
    for _ in range(250):
        yield "".join(rng.choices(["a", "bc", " ", "  ", "def", "\n", "é"], k=rng.randint(0, 60)))


def test_lines_and_pages(spark):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame(rows, "page int, text string")
    for size in (5, 12):
        lines = frame.select("page", chunking.split_line(F.replace("text", F.lit("\n"), F.lit(" ")), size).alias("p")).orderBy("page").collect()
        assert [r.p for r in lines] == [plain_split(t.replace("\n", " "), size) for _, t in rows]
        got = chunking.chunk_pages(frame, size).orderBy("page", "chunk_no").collect()
        assert [(r.page, r.text, r.line_start, r.line_end) for r in got] == [(p, *c) for p, t in rows for c in plain_chunks(t, size)]


def test_an_empty_chunk_may_come_first(spark):
    got = chunking.chunk_pages(spark.createDataFrame([(1, "\nabcdefghi")], "page int, text string"), 10).collect()
    assert [(r.text, r.line_start, r.line_end) for r in got] == [("", 1, 1), ("abcdefghi", 2, 2)]


def test_driver_documents(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select(F.col("doc_id").alias("page"), "text")
    got = chunking.chunk_pages(docs).orderBy("page", "chunk_no").collect()
    expected = [(r.page, *c) for r in docs.orderBy("page").collect() for c in plain_chunks(r.text, 600)]
    assert [(r.page, r.text, r.line_start, r.line_end) for r in got] == expected


def read(spark, reader, rows):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, n int")
    return [r.c for r in frame.select("i", reader(F.col("a"), F.col("n")).alias("c")).orderBy("i").collect()]


def test_choices(spark):
    rows = [('{"passage": 2}', 3), ('{"passage": 0}', 3), ('{"passage": 4}', 3), ('{"passage": true}', 3), ('{"passage": 2.0}', 3), ('{"passage": "2"}', 3), ("[2]", 3), ("2", 3), (None, 3), (' {"passage": 1} ', 1), ("{}", 2)]
    assert read(spark, selection.choice_from_json, rows) == [2, 0, None, None, None, None, None, None, None, 1, None]
    rows = [("passage 2", 3), ("370 puis 1", 3), ("6", 5), ("-2", 3), ("−2", 3), ("-12", 3), ("aucun", 3), (None, 3), ("0", 3)]
    assert read(spark, selection.choice_from_digits, rows) == [2, 1, None, None, None, 2, None, None, 0]
    rows = [("B", 3), ("réponse c.", 3), ("aucun", 3), ("0", 3), ("A puis D", 3), ("D", 3), ("12", 3), (None, 3)]
    assert read(spark, selection.choice_from_letters, rows) == [2, 3, None, 0, 1, None, None, None]


def test_labels(spark):
    assert selection.labels(3) == ["1", "2", "3"] and selection.labels(2, True) == ["A", "B"] and len(selection.labels(12, True)) == 8
    row = spark.createDataFrame([(["x", "y"],)], "p array<string>").select(selection.numbered(F.col("p")).alias("n"), selection.numbered(F.col("p"), True).alias("l")).first()
    assert row.n == "[1] x\n\n[2] y" and row.l == "[A] x\n\n[B] y"
