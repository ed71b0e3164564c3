import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.operators import codec
from tessera.operators.postings import build_postings, ranked
from tessera.sources import binary, csv_text, generators
from tessera.streaming import ingest


@pytest.mark.parametrize(
    ("ids", "data"),
    [([], ""), ([100], "070164"), ([1, 3, 7, 15, 31, 63, 127], None), ([10, 1000, 100000, 10000000], "18040a0000de0300b88201e00f97")],
)
def test_known_bytes(ids, data):
    got = codec.encode(ids)
    assert codec.decode(got) == ids
    if data is not None:
        assert got.hex() == data


def test_sizes():
    assert len(codec.encode(list(range(1, 1001)))) == 141
    assert round(2000 / len(codec.encode(list(range(1, 501)))), 3) == 28.169


@pytest.mark.parametrize("data", ["00ffff", "040f", "03"])
def test_bad_bytes(data):
    with pytest.raises(ValueError):
        codec.decode(bytes.fromhex(data))


@pytest.mark.parametrize("ids", [[2, 1], [1, 1], [-1, 3], [2**31]])
def test_bad_ids(ids):
    with pytest.raises(ValueError):
        codec.encode(ids)


@given(st.sets(st.integers(0, 2**31 - 1), max_size=400).map(sorted))
def test_round_trip(ids):
    data = codec.encode(ids)
    assert codec.decode(data) == ids
    assert [d for d, _ in codec.skip_pointers_of(data)] == ids[::128]


def test_skip_pointers_of_bytes():
    assert codec.skip_pointers_of(bytes.fromhex("030211030223")) == [(1, 0), (6, 3)]
    assert codec.skip_pointers_of(b"") == []
    with pytest.raises(ValueError):
        codec.skip_pointers_of(bytes.fromhex("0302aa0228"))


def test_relational_sizes_equal_bytes(spark):
    docs = spark.createDataFrame([(i, "all " + ("odd" if i % 2 else "even") + (" rare" if i % 700 == 0 else "")) for i in range(2000)], "doc_id long, text string")
    posted = build_postings(docs).cache()
    lists = {}
    for r in posted.collect():
        lists.setdefault(r.term, []).append(r.doc_id)
    want = {t: codec.encode(sorted(x)) for t, x in lists.items()}
    assert {r.term: r.bytes for r in codec.sizes(ranked(posted)).collect()} == {t: len(b) for t, b in want.items()}
    skips = {}
    for r in codec.skip_pointers(ranked(posted)).orderBy("block").collect():
        skips.setdefault(r.term, []).append((r.first_doc, r.byte_offset))
    assert skips == {t: codec.skip_pointers_of(b) for t, b in want.items()}
    packed = codec.pack(ranked(posted))
    blocks = {}
    for r in packed.orderBy("block").collect():
        blocks[r.term] = blocks.get(r.term, b"") + bytes(r.bytes)
    assert blocks == want
    assert sorted(map(tuple, codec.unpack(packed).collect())) == sorted((i, t) for t, x in lists.items() for i in x)


def test_index_files(spark, tmp_path):
    posted = build_postings(spark.createDataFrame([(1, "a b"), (5, "b c")], "doc_id long, text string"))
    binary.export_index(posted, str(tmp_path / "x"))
    assert sorted(map(tuple, binary.import_index(spark, str(tmp_path / "x")).collect())) == [(1, "a"), (1, "b"), (5, "b"), (5, "c")]
    assert list(binary.read_index(binary.write_index([]))) == []
    with pytest.raises(ValueError):
        list(binary.read_index(b"BAD1" + bytes(8)))
    with pytest.raises(ValueError):
        list(binary.read_index(b"SAPJ" + struct.pack("<II", 2, 0)))
    with pytest.raises(ValueError):
        list(binary.read_index(b"SAPJ" + struct.pack("<II", 1, 3)))
    with pytest.raises(Exception):  # noqa: B017
        binary.import_index(spark, str(tmp_path / "missing")).collect()


def test_bucket_files(spark, tmp_path):
    binary.register(spark)
    data = binary.write_records([b"one", b"three"], 64)
    assert len(data) == 64 and list(binary.read_records(data)) == [b"one", b"three"]
    with pytest.raises(ValueError):
        binary.write_records([b"x" * 80], 64)
    (tmp_path / "bucket_0.dat").write_bytes(data)
    got = spark.read.format("bucket_file").load(str(tmp_path)).collect()
    assert [(r.file, r.position, bytes(r.record)) for r in got] == [("bucket_0.dat", 0, b"one"), ("bucket_0.dat", 1, b"three")]
    out = tmp_path / "out"
    spark.createDataFrame([("f", 0, bytearray(b"rec"))], "file string, position int, record binary").coalesce(1).write.format("bucket_file").option("size", 128).mode("append").save(str(out))
    assert [f.stat().st_size for f in out.iterdir()] == [128]


def test_questions(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a,b,text\n0,1,"What  is, a \\"dog\\" ?"\n\n1,2,plain\n')
    assert [tuple(r) for r in csv_text.read_questions(spark, str(path)).orderBy("doc_id").collect()] == [(1, 'What is, a "dog" ?'), (2, "plain")]
    assert csv_text.split_line('x,"a""b",c') == ["x", "ab", "c"]
    assert csv_text.squeeze(" a\t b  c ") == "a\tb c"
    path.write_text("a,b,text\n")
    with pytest.raises(ValueError):
        csv_text.read_questions(spark, str(path))
    path.write_text("a,b,text\n1,2\n")
    with pytest.raises(Exception):  # noqa: B017
        csv_text.read_questions(spark, str(path)).collect()


def test_pixels(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("label,p1,p2,p3\n1,255,0,51\n2,x,255,255\n3,1,2\n4,1,2,3,4\n")
    got = [[round(x, 3) for x in r.vec] for r in csv_text.read_pixels(spark, str(path), pixels=3).orderBy("id").collect()]
    assert got == [[1.0, 0.0, 0.2], [0.0, 1.0, 1.0]]


def test_generators(spark):
    q = generators.random_queries(spark, 20, 8).collect()
    assert len(q) == 20 and all(len(r.vec) == 8 and 0 <= min(r.vec) and max(r.vec) < 1 for r in q)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted(r.doc_id for r in generators.scaled_corpus(docs, 3).collect()) == [1, 2, 3, 4, 5, 6]


def test_streaming_ingest(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "hello world")], schema).write.mode("append").parquet(source)
    for _ in range(2):
        ingest.start(spark.readStream.schema(schema).parquet(source), path).awaitTermination()
    spark.createDataFrame([(2, "hello again"), (1, "hello more")], schema).write.mode("append").parquet(source)
    ingest.start(spark.readStream.schema(schema).parquet(source), path).awaitTermination()
    index = ingest.current(spark, path)
    assert sorted(r[0] for r in index.search("hello").collect()) == [1, 2]
    assert sorted(r[0] for r in index.search("NOT world").collect()) == [2]
    ingest.compact(spark, path, str(tmp_path / "packed"))


def test_file_writers_commit_once(spark, tmp_path):
    class Row(dict):
        pass

    rows = [Row(term="a", posting=codec.encode([1, 2]), skips=[])]
    writer = binary._Writer(str(tmp_path / "x"), True, 0, False)
    messages = [writer.write(iter(rows)) for _ in range(2)]  # a task that ran twice
    writer.commit(messages[:1])
    assert len(binary._files(str(tmp_path / "x"))) == 1 and len(list((tmp_path / "x").iterdir())) == 1
    again = binary._Writer(str(tmp_path / "x"), True, 0, True)
    again.write(iter(rows))
    again.abort([])
    assert len(list((tmp_path / "x").iterdir())) == 1
    again.commit([again.write(iter(rows))])
    assert len(list((tmp_path / "x").iterdir())) == 1
    assert sorted(map(tuple, binary.import_index(spark, str(tmp_path / "x")).collect())) == [(1, "a"), (2, "a")]


def test_questions_of_many_files(spark, tmp_path, monkeypatch):
    """Finding 9: no task reads the whole; ids go on over splits and files, with one header."""
    rows = [f'0,1,"text {i} {"x" * (i % 50)}"' for i in range(3000)]
    for k in range(5):
        part = ["a,b,text", ""] * (k == 0) + rows[600 * k : 600 * k + 600]
        (tmp_path / f"part-{k:05}.csv").write_text("\n".join(part) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = csv_text.read_questions(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 5
        assert {r.doc_id: r.text for r in got.collect()} == {i + 1: csv_text.squeeze(x[5:-1]) for i, x in enumerate(rows)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_runs_are_postings(spark, monkeypatch):
    """Findings 11, 13 to 21, 23 to 25: runs of a range of ids, in pieces and batches of any size, are the postings of the words."""
    from pyspark.sql import functions as F

    from tessera.functions.text import has_term, normalize, terms, words_of
    from tessera.operators import postings

    monkeypatch.setattr(postings, "SPAN", 50)
    monkeypatch.setattr(postings, "GATHERED", 40)
    odd = ["", " ?! ", None, "\v\fA  b\tC-d\r\nÜ É\u00a0x \x1c y", "".join(map(chr, range(1, 256)))]
    texts = odd + [" ".join(f"w{(i * j) % 37}" for j in range(1, 9)) + " all" for i in range(400)]
    docs = spark.createDataFrame([(i - 120 + (i > 300), t) for i, t in enumerate(texts)] + [(7, "all w1 again"), (None, "x")], "doc_id long, text string")
    for r in docs.where("text IS NOT NULL").select("text", terms(F.col("text")).alias("t"), normalize(F.col("text")).alias("n"), has_term(F.col("text")).alias("h")).collect():
        assert [x.decode() for x in words_of(r.text.encode())] == r.t and r.h == (r.n != "")
    want = {}
    for r in docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.explode(terms(F.col("text"))).alias("t")).collect():
        want.setdefault(r.t, set()).add(r.doc_id)
    flat = sorted((i, t) for t, x in want.items() for i in x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(tuple, build_postings(docs).collect())) == flat
        runs = postings.build_runs(docs)
        assert runs.count() == runs.select("term", "range").distinct().count()
        assert sorted(map(tuple, postings.spread(runs).collect())) == flat
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    for r in postings.spread_ranks(postings.ranked_runs(runs)).orderBy("term", "rank").collect():
        got.setdefault(r.term, []).append((r.doc_id, r["rank"], r.gap))
    assert got == {t: [(i, k, i - (sorted(x)[k - 1] if k else 0)) for k, i in enumerate(sorted(x))] for t, x in want.items()}
    lists = {t: sorted(i + 120 for i in x) for t, x in want.items()}
    ranked = postings.ranked_runs(postings.build_runs(docs.withColumn("doc_id", F.col("doc_id") + 120)))
    assert {r.term: r.bytes for r in codec.sizes(ranked).collect()} == {t: len(codec.encode(x)) for t, x in lists.items()}
    blocks = {}
    for r in codec.pack(ranked).orderBy("block").collect():
        blocks[r.term] = blocks.get(r.term, b"") + bytes(r.bytes)
    assert blocks == {t: codec.encode(x) for t, x in lists.items()}


@given(st.lists(st.sets(st.integers(0, 2**31 - 1), min_size=1, max_size=300).map(sorted), max_size=5))
def test_lists_together(lists):
    data, skips = codec.encode_lists(lists)
    assert data == [codec.encode(x) for x in lists] and skips == [codec.skip_pointers_of(b) for b in data]
    assert [x.tolist() for x in codec.decode_lists([*data, b""])] == [*lists, []]
    for bad in (b"\x00\xff\xff", b"\x04\x0f", b"\x03"):
        with pytest.raises(ValueError):
            codec.decode_lists([*data, bad])
