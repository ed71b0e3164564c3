import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import ann, hashindex, vector
from tessera.operators.index import Index
from tessera.operators.spatial import KDTreeIndex
from tessera.plans import catalogue

P6 = [(2, 3), (5, 4), (9, 6), (4, 7), (8, 1), (7, 2)]


def points(spark, rows, start=0):
    return spark.createDataFrame([(i + start, [float(x) for x in p]) for i, p in enumerate(rows)], "id long, vec array<float>")


def found(df, rows):
    return [rows[r.id] for r in df.collect()]


KINDS = [vector.FlatIndex, KDTreeIndex, lambda: KDTreeIndex(leaf_rows=1)]


@pytest.mark.parametrize("kind", KINDS)
def test_neighbours_and_radius(spark, kind):
    index = kind().build(points(spark, P6))
    assert isinstance(index, Index)
    assert found(index.nearest_neighbors([5, 5], 2), P6) == [(5, 4), (4, 7)]
    assert sorted(found(index.range_search([5, 5], 3.0), P6)) == [(4, 7), (5, 4)]
    assert found(index.nearest_neighbors([5, 5], 0), P6) == []
    assert len(found(index.nearest_neighbors([5, 5], 99), P6)) == 6
    assert found(index.range_search([5, 5], -1.0), P6) == []
    assert sorted(found(index.range_search([5, 5], 1.0), P6)) == [(5, 4)]
    with pytest.raises(ValueError):
        index.nearest_neighbors([5, 5, 5], 1)
    with pytest.raises(ValueError):
        index.insert(points(spark, [(1, 2, 3)]))


@pytest.mark.parametrize("kind", KINDS)
def test_insert_tie_far(spark, kind):
    rows = [(1, 2), (3, 4), (5, 6)]
    index = kind().build(points(spark, rows[:2])).insert(points(spark, rows[2:], 2))
    assert found(index.nearest_neighbors([5, 5], 3), rows) == [(5, 6), (3, 4), (1, 2)]
    tie = kind().build(points(spark, [(1, 1), (2, 2)]))
    assert [r.id for r in tie.nearest_neighbors([1.5, 1.5], 5).collect()] == [0, 1]
    far = kind().build(points(spark, [(10, 10), (20, 20), (30, 30)]))
    assert far.range_search([0, 0], 5.0).collect() == []


@pytest.mark.parametrize("kind", KINDS)
def test_bad_builds(spark, kind):
    for rows in ([(1, 2), (3, 4, 5)], []):
        with pytest.raises(ValueError):
            kind().build(points(spark, rows))


def test_unbuilt(spark):
    assert KDTreeIndex().nearest_neighbors([1, 1], 3, spark).collect() == []
    assert KDTreeIndex().range_search([1, 1], 10.0, spark).collect() == []
    for call in (lambda i: i.nearest_neighbors([1, 1], 3), lambda i: i.range_search([1, 1], 10.0), lambda i: i.insert(points(spark, P6))):
        with pytest.raises(RuntimeError):
            call(vector.FlatIndex())


def _random(spark, n=400, d=3, seed=0):
    rows = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    rows[n // 2 :: 7] = rows[3]  # repeated points
    return rows, points(spark, rows.tolist()).repartition(3)


def test_batches_equal_brute_force(spark):
    rows, df = _random(spark)
    queries = df.where("id < 5")
    want = {}
    for q in range(5):
        d = np.sqrt(((rows.astype(float) - rows[q].astype(float)) ** 2).sum(axis=1))
        want[q] = list(np.lexsort((np.arange(len(d)), d))[:6])
    tree = KDTreeIndex(leaf_rows=20).build(df)
    assert tree.leaves().agg(F.sum("n")).first()[0] == len(rows)
    for got in (vector.knn_batch(df, queries, 6), tree.knn_batch(queries, 6)):
        by = {}
        for r in sorted(got.collect(), key=lambda r: (r.qid, r.rank)):
            by.setdefault(r.qid, []).append(r.id)
        assert by == want
    near = {(r.qid, r.id) for r in vector.within_batch(df, queries, 0.8).collect()}
    assert near == {(q, i) for q in range(5) for i in range(len(rows)) if np.linalg.norm(rows[q].astype(float) - rows[i].astype(float)) <= 0.8}
    assert {r.id for r in tree.range_search(rows[2].tolist(), 0.8).collect()} == {i for q, i in near if q == 2}
    assert vector.knn_batch(df, queries, 0).count() == 0 and vector.knn_batch(df, queries.limit(0), 3).count() == 0


@pytest.mark.parametrize(
    "search",
    [
        lambda p, q: ann.IVFIndex.build(p, 16).search(q, 5, nprobe=8),
        lambda p, q: ann.PQIndex.build(p, m=4, bits=5).search(q, 5, rerank=20),
        lambda p, q: ann.HNSWIndex.build(p, m=8, shard_rows=200).search(q, 5),
        lambda p, q: ann.LSHIndex.build(p, tables=24, width=2.0, hashes=2).search(q, 5),
    ],
    ids=["ivf", "pq", "hnsw", "lsh"],
)
def test_recall(spark, search):
    rows, df = _random(spark, 600, 8, 4)
    queries = df.where("id < 20")
    exact = {(r.qid, round(r.dist, 5)) for r in vector.knn_batch(df, queries, 5).collect()}
    got = {(r.qid, round(r.dist, 5)) for r in search(df, queries).collect()}
    assert len(exact & got) >= 0.9 * len(exact)


@pytest.mark.parametrize("name", ["ann_ivf", "ann_pq", "ann_hnsw", "ann_lsh"])
def test_recall_of_registered_searches(spark, tmp_path, name):
    rows = np.random.default_rng(8).normal(size=(2000, 64))
    rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in catalogue.queries()[name](spark, str(tmp_path)).collect():
        got.setdefault(r.qid, set()).add(r.id)
    exact = {q: set(np.argsort(((rows - rows[q]) ** 2).sum(axis=1))[:5].tolist()) for q in got}
    assert set(got) == set(range(0, 2000, 100))
    assert sum(len(got[q] & exact[q]) for q in got) >= 0.9 * 5 * len(got)


def test_hash_table(spark):
    rows = spark.createDataFrame([(i,) for i in range(1, 2001)], "id int")
    t = hashindex.HashTable.create(rows, max_bytes=1024).upsert(rows.where("id = 1001"))
    assert t.rows.count() == 2000 and t.lookup(id=1001).count() == 1 and t.lookup(id=5000).count() == 0
    held = t.hashed().collect()
    leaves = t.directory().collect()
    assert sum(r.n for r in leaves) == 2000 and all(r.bytes <= 1024 for r in leaves)
    for r in held[:50]:
        assert sum((r.h & ((1 << x.depth) - 1)) == x.suffix for x in leaves) == 1
    assert sum(2.0 ** -x.depth for x in leaves) == 1.0
    one = held[0]
    assert one.id in {r.id for r in t.bucket_scan(one.h).collect()}
    stats = t.stats().first()
    assert stats.directory_slots == 2**stats.global_depth >= stats.leaf_buckets == len(leaves)
    assert t.contains(spark.createDataFrame([(7,), (9999,)], "id int")).count() == 1
    held = {(r.depth, r.suffix): r for r in t.fullness(6).collect()}
    assert len(held) == t.directory().count() and all(r.free == 1024 - r.bytes and r.full == (r.bytes >= 1024) and r.fits == (r.bytes + 10 <= 1024) for r in held.values())
    assert t.clear().rows.count() == 0 and t.clear().directory().count() == 2


def test_hash_upsert_replaces(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    t = hashindex.HashTable.create(a, keys=["k"]).upsert(spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, at int"), order_by="at")
    assert sorted((r.k, r.v) for r in t.rows.collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_hash_limits(spark):
    assert hashindex.capacity(1024) == 4096 and hashindex.capacity(4096) == 8192
    empty = hashindex.HashTable.create(spark.createDataFrame([], "id int"), initial_depth=3)
    assert empty.directory().count() == 8
    with pytest.raises(ValueError):
        hashindex.HashTable.create(spark.createDataFrame([("x" * 100,)], "id string"), max_bytes=64).directory()


@pytest.mark.parametrize(
    "build",
    [lambda p: ann.IVFIndex.build(p, 8), lambda p: ann.PQIndex.build(p, m=4, bits=4), lambda p: ann.HNSWIndex.build(p, m=8, shard_rows=100), lambda p: ann.LSHIndex.build(p, width=2.0)],
    ids=["ivf", "pq", "hnsw", "lsh"],
)
def test_saved_indexes_find_the_same(spark, tmp_path, build):
    _, df = _random(spark, 300, 8, 6)
    index = build(df)
    index.save(str(tmp_path))
    queries = df.where("id < 4")
    found = [sorted((r.qid, r.rank, round(r.dist, 9)) for r in i.search(queries, 3).collect()) for i in (index, type(index).load(spark, str(tmp_path)))]
    assert found[0] == found[1] and found[0] and index.search(queries.limit(0), 3).collect() == []


def test_hash_table_by_hash_and_order(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "d", 0)], "k int, v string, at int")
    t = hashindex.HashTable.create(rows, keys=["k"], order_by="at")
    assert sorted((r.k, r.v) for r in t.rows.collect()) == [(1, "b"), (2, "d")]
    h = t.hashed().where("k = 2").first().h
    assert [r.v for r in t.lookup_hash(h).collect()] == ["d"] and t.lookup_hash(-1).collect() == []
    assert {r.v for r in t.bucket_scan_of(k=2).collect()} == {r.v for r in t.bucket_scan(h).collect()} >= {"d"}
    t.save(str(tmp_path / "t"))
    again = hashindex.HashTable.load(spark, str(tmp_path / "t"), keys=["k"])
    assert sorted((r.k, r.v) for r in again.rows.collect()) == [(1, "b"), (2, "d")]


def test_batches_keep_the_best_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(vector, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    rows, df = _random(spark, 90, 3, 2)
    near = vector._near(df.coalesce(1), (np.array([0]), rows[:1].astype(np.float64)), "id", "vec", 4, None)
    assert near.count() == 4
    got = {(r.qid, r.rank): r.id for r in vector.knn_batch(df, df.where("id < 8"), 2).collect()}
    assert len(got) == 16
    for q in range(8):
        d = np.sqrt(((rows.astype(float) - rows[q].astype(float)) ** 2).sum(axis=1))
        assert [got[q, 1], got[q, 2]] == np.lexsort((np.arange(len(d)), d))[:2].tolist()


def test_directory_in_parts(spark, monkeypatch):
    """Finding 1: hashes aren't repeated for each depth; leaves above, at and below TOP_BITS are those of plain splitting."""
    hashes = [*np.random.default_rng(3).integers(0, 1 << 28, 900).tolist(), *[0b1101] * 30, *[(1 << 27) + 0b1101] * 5]
    want, open_ = set(), [(1, s, [h for h in hashes if h % 2 == s]) for s in (0, 1)]
    for depth, s, own in open_:
        if 10 * len(own) <= 100 or depth == 28:
            want.add((depth, s, 10 * len(own), len(own)))
        else:
            open_ += [(depth + 1, t, [h for h in own if h % (2 << depth) == t]) for t in (s, s + (1 << depth))]
    entries = spark.createDataFrame([(h, 10) for h in hashes], "h long, bytes long")
    for top in (1, 3, 12):
        monkeypatch.setattr(hashindex, "TOP_BITS", top)
        got = hashindex.directory(entries, 100)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_searches_keep_the_best_in_tasks(spark, monkeypatch):
    """Findings 6, 7, 8, 10 and 12: pairs of queries and rows aren't joined; what shares a bucket or list is ranked, no more and no less."""
    monkeypatch.setattr(vector, "ROWS_AT_ONCE", 50)
    rows, df = _random(spark, 300, 4, 12)
    wide = rows.astype(float)
    queries = df.where("id < 9")
    lsh = ann.LSHIndex.build(df, tables=3, width=0.8, hashes=2)
    keys = ann._cells(wide, lsh.planes, lsh.offsets, lsh.width)
    ivf = ann.IVFIndex.build(df, 8)
    lists = ann.nearest(wide, ivf.centres)
    probed = np.argsort(ann.squared(wide[:9], ivf.centres), axis=1)[:, :2]
    for found, held in ((lsh.search(queries, 7), lambda q: (keys == keys[q]).any(axis=1)), (ivf.search(queries, 7, nprobe=2), lambda q: np.isin(lists, probed[q]))):
        assert "Join" not in found._jdf.queryExecution().toString()
        got = {}
        for r in sorted(found.collect(), key=lambda r: r["rank"]):
            got.setdefault(r.qid, []).append(r.id)
        for q in range(9):
            d = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
            near = np.lexsort((np.arange(len(d)), d))
            assert got[q] == near[held(q)[near]][:7].tolist()
    with pytest.raises(ValueError):
        vector.matrix(pa.array([[1.0, 2.0], [3.0], [4.0, 5.0, 6.0]]))


@pytest.mark.parametrize("task_rows", [1, 40, 1 << 17])
def test_tree_splits_at_exact_medians(spark, monkeypatch, task_rows):
    """Findings 4 and 5: medians are exact at any depth, by counts or in a task; a batch search is no list of all queries and leaves."""
    from tessera.operators import spatial

    monkeypatch.setattr(spatial, "TASK_ROWS", task_rows)
    rng = np.random.default_rng(9)
    rows = np.round(rng.normal(size=(700, 3)), 1).astype(np.float32)
    rows[::5] = rows[0]
    rows[:20, 0] = [0.0, -0.0] * 10
    want, open_ = {}, [(1, 0, rows)]
    for node, level, own in open_:
        if level == 6 or not len(own):
            want |= {node: len(own)} if len(own) else {}
            continue
        x = own[:, level % 3]
        right = x > np.sort(x)[(len(x) + 1) // 2 - 1]
        open_ += [(2 * node, level + 1, own[~right]), (2 * node + 1, level + 1, own[right])]
    df = points(spark, rows.tolist()).repartition(3)
    tree = KDTreeIndex(leaf_rows=11).build(df)
    assert {r.leaf: r.n for r in tree.leaves().collect()} == want
    monkeypatch.setattr(type(spark), "createDataFrame", None)  # no pairs from the driver
    got = {(r.qid, r["rank"]): r.id for r in tree.knn_batch(df.where("id % 100 = 0"), 5).collect()}
    for q in range(0, 700, 100):
        d = np.sqrt(((rows.astype(float) - rows[q].astype(float)) ** 2).sum(axis=1))
        assert [got[q, i] for i in range(1, 6)] == np.lexsort((np.arange(700), d))[:5].tolist()
