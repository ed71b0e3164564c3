"""The registered queries over the core operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import LOWER, UPPER
from tessera.operators import ann, boolean, codec, hashindex, postings, spatial, vector
from tessera.session import fresh_path, table
from tessera.sources import binary, csv_text, generators
from tessera.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "(from OR with) AND NOT this"
#: name: (query, the same over sets of P, the postings, and U, the universe)
_t = lambda t: f"(SELECT doc_id FROM p WHERE term = '{t}')"
BOOLEAN = {
    "bool_term": ("from", _t("from")),
    "bool_and": ("from AND with", f"{_t('from')} INTERSECT {_t('with')}"),
    "bool_or": ("from OR with", f"{_t('from')} UNION {_t('with')}"),
    "bool_not": ("NOT the", f"(SELECT doc_id FROM u) EXCEPT {_t('the')}"),
    "bool_and_not": (FLAGSHIP, f"({_t('from')} UNION {_t('with')}) EXCEPT {_t('this')}"),
    "bool_nested": ("in AND (NOT (the OR from) OR (with AND this))", f"{_t('in')} INTERSECT (((SELECT doc_id FROM u) EXCEPT ({_t('the')} UNION {_t('from')})) UNION ({_t('with')} INTERSECT {_t('this')}))"),
    "bool_double_not": ("NOT NOT from", _t("from")),
    "bool_missing": ("from AND nosuchterm", f"{_t('from')} INTERSECT {_t('nosuchterm')}"),
    "bool_case": ("FROM aNd WITH or This", f"({_t('from')} INTERSECT {_t('with')}) UNION {_t('this')}"),
}
HASH_CAPACITY = 1024


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


def _points(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _flat(s: SparkSession, d: str) -> DataFrame:
    return _points(s, d).select("id", F.slice("vec", 1, 2).alias("vec"))


def _queries(points: DataFrame) -> DataFrame:
    """The stated set of a search's queries: every id that 100 divides."""
    return points.where("id % 100 = 0")


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("dist", F.round("dist", 6))


def _first(points: DataFrame, id_: int = 3) -> list[float]:
    r = points.where(F.col("id") == id_).first()
    return list(r["vec"]) if r else []


def flagship(s: SparkSession, d: str) -> DataFrame:
    return postings.InvertedIndex.build(_docs(s, d)).search(FLAGSHIP)


def _search(query: str) -> Query:
    return lambda s, d: postings.InvertedIndex.build(_docs(s, d)).search(query)


def _sets(query: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return boolean.search_by_sets(postings.build_postings(_docs(s, d)), postings.build_universe(_docs(s, d)), query)

    return run


def _knn(query_id: int, k: int) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        points = _points(s, d)
        return _rounded(vector.knn(points, _first(points, query_id), k))

    return run


def _tree(leaf_rows: int, points: DataFrame) -> spatial.KDTreeIndex:
    return spatial.KDTreeIndex(leaf_rows=leaf_rows).build(points)


def _tree_batch(points_of: Query, leaf_rows: int) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        points = points_of(s, d)
        return _rounded(_tree(leaf_rows, points).knn_batch(_queries(points), 5))

    return run


def _tree_range(points_of: Query, leaf_rows: int, radius: float) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        points = points_of(s, d)
        return _rounded(_tree(leaf_rows, points).range_search(_first(points), radius))

    return run


def kdtree_leaves(s: SparkSession, d: str) -> DataFrame:
    return _tree(64, _flat(s, d)).leaves().select(F.col("leaf").cast("long").alias("leaf"), "n")


def vec_insert_knn(s: SparkSession, d: str) -> DataFrame:
    points = _points(s, d)
    index = vector.FlatIndex().build(points.where("id % 2 = 0")).insert(points.where("id % 2 = 1"))
    return _rounded(index.nearest_neighbors(_first(points), 10))


def vec_distance(s: SparkSession, d: str) -> DataFrame:
    points = _points(s, d)
    return points.select("id", F.round(vector.distance(F.col("vec"), _first(points)), 6).alias("dist"))


def _ann(search: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        points = _points(s, d)
        return _rounded(search(points, _queries(points)))

    return run


def hash_upsert(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    held = hashindex.HashTable.create(orders, keys=["o_orderkey"])
    more = orders.where("o_orderkey % 10 = 3").withColumn("o_totalprice", F.lit(0.0))
    return held.upsert(more).rows


def hash_upsert_rows(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "customer").select("c_custkey", "c_nationkey")
    return hashindex.HashTable.create(rows).upsert(rows.where("c_custkey % 3 = 0")).rows


def _hash_of(s: SparkSession, key: str) -> int:
    return s.range(1).select(hashindex.key_hash(F.lit(key))).first()[0]


def _customers(s: SparkSession, d: str) -> hashindex.HashTable:
    rows = table(s, d, "customer").select("c_custkey", "c_nationkey")
    return hashindex.HashTable.create(rows, keys=["c_custkey"], max_bytes=HASH_CAPACITY)


def hash_lookup(s: SparkSession, d: str) -> DataFrame:
    return _customers(s, d).lookup(c_custkey=42)


def hash_contains(s: SparkSession, d: str) -> DataFrame:
    wanted = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return _customers(s, d).contains(wanted)


def hash_bucket_scan(s: SparkSession, d: str) -> DataFrame:
    return _customers(s, d).bucket_scan(12345)


def hash_directory(s: SparkSession, d: str) -> DataFrame:
    return _customers(s, d).directory().withColumn("depth", F.col("depth").cast("long"))


def hash_fullness(s: SparkSession, d: str) -> DataFrame:
    return _customers(s, d).fullness(40).withColumn("depth", F.col("depth").cast("long"))


def term_contains(s: SparkSession, d: str) -> DataFrame:
    wanted = ["from", "nosuchterm"]
    held = postings.InvertedIndex.build(_docs(s, d)).held_of(wanted)
    return s.createDataFrame([(t, t in held) for t in wanted], "term string, found boolean")


def index_put(s: SparkSession, d: str) -> DataFrame:
    """The lists of two terms, one of them new, are set; the lengths of all lists follow."""
    built = postings.InvertedIndex.build(_docs(s, d))
    put = built.universe.where("doc_id % 2 = 0").select("doc_id", F.explode(F.array(F.lit("the"), F.lit("even ids"))).alias("term"))
    return built.put(put).postings.groupBy("term").agg(F.count("*").alias("df"), F.max("doc_id").alias("last"))


def stream_postings(s: SparkSession, d: str) -> DataFrame:
    path = fresh_path(s, "stream")
    stream = s.readStream.schema(table(s, d, "documents").schema).option("pathGlobFilter", "*.parquet")
    source = stream.parquet(_stream_folder(s, d))
    ingest.start(source.select("doc_id", "text"), path).awaitTermination()
    return ingest.current(s, path).postings


def _stream_folder(s: SparkSession, d: str) -> str:
    """A folder of document files: the table itself, or, where the table is one file, its copy in a folder."""
    path = f"{d}/documents.parquet"
    hadoop = s.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    if at.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return path
    copy = fresh_path(s, "documents")
    s.read.parquet(path).write.parquet(copy)
    return copy


def index_save_load(s: SparkSession, d: str) -> DataFrame:
    path = fresh_path(s, "index")
    postings.InvertedIndex.build(_docs(s, d)).save(path)
    return postings.InvertedIndex.load(s, path).search("NOT the")


def pfor_roundtrip(s: SparkSession, d: str) -> DataFrame:
    return codec.unpack(postings.InvertedIndex.build(_docs(s, d)).packed())


def index_file_roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = fresh_path(s, "files").removeprefix("file:")
    binary.export_index(postings.build_runs(_docs(s, d)), path)
    return binary.import_index(s, path)


def _ranked(s: SparkSession, d: str) -> DataFrame:
    return postings.ranked_runs(postings.build_runs(_docs(s, d)))


def pfor_ratio(s: SparkSession, d: str) -> DataFrame:
    total = codec.sizes(_ranked(s, d)).agg(F.sum("df").alias("n"), F.sum("bytes").alias("bytes"))
    return total.select((F.col("n") * 4).alias("raw_bytes"), "bytes", F.round(F.col("n") * 4 / F.col("bytes"), 6).alias("ratio"))


ANN: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "ann_ivf": lambda p, q: ann.IVFIndex.build(p, 32).search(q, 5, nprobe=24),
    "ann_pq": lambda p, q: ann.PQIndex.build(p).search(q, 5),
    "ann_hnsw": lambda p, q: ann.HNSWIndex.build(p).search(q, 5),
    "ann_lsh": lambda p, q: ann.LSHIndex.build(p, width=2.4).search(q, 5),
}


def _recall(name: str) -> Query:
    """(queries, found, recall_reached): neighbours found of five for each query, at least 0.9 of the exact ones or not."""

    def run(s: SparkSession, d: str) -> DataFrame:
        points = _points(s, d)
        wanted = _queries(points)
        exact = vector.knn_batch(points, wanted, 5).select("qid", "id")
        near = ANN[name](points, wanted).select("qid", "id", F.lit(True).alias("hit"))
        joined = exact.join(near, ["qid", "id"], "left")
        return joined.agg(F.countDistinct("qid").alias("queries"), F.count("*").alias("exact"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))

    return run


def kdtree_insert(s: SparkSession, d: str) -> DataFrame:
    points = _flat(s, d)
    tree = _tree(32, points.where("id % 2 = 0")).insert(points.where("id % 2 = 1"))
    return _rounded(tree.knn_batch(_queries(points), 5))


def ann_save_load(s: SparkSession, d: str) -> DataFrame:
    """A saved and loaded inverted file, searched in all its lists: the exact neighbours."""
    points, path = _points(s, d), fresh_path(s, "ivf")
    ann.IVFIndex.build(points, 16).save(path)
    return _rounded(ann.IVFIndex.load(s, path).search(_queries(points), 5, nprobe=16))


def hash_save_load(s: SparkSession, d: str) -> DataFrame:
    path = fresh_path(s, "table")
    _customers(s, d).save(path)
    held = hashindex.HashTable.load(s, path, keys=["c_custkey"], max_bytes=HASH_CAPACITY)
    return held.rows.select("c_custkey", "c_nationkey")


def csv_questions(s: SparkSession, d: str) -> DataFrame:
    """Documents as labelled CSV files of ranges of ids, read again: ids from 1 in the files' order."""
    path = fresh_path(s, "questions")
    plain = F.translate("text", "\\\n\r", "   ")
    quoted = F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('\\"')), F.lit('"'))
    rows = table(s, d, "documents").where("text IS NOT NULL").select(F.lit(1).alias("part"), "doc_id", F.concat(F.lit("0,1,"), quoted).alias("value"))
    header = s.range(1).select(F.lit(0).alias("part"), F.lit(None).cast("long").alias("doc_id"), F.lit("label-coarse,label-fine,text").alias("value"))
    order = ["part", F.asc_nulls_last("doc_id")]
    header.unionByName(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)
    return csv_text.read_questions(s, path)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "text_normalize": lambda s, d: postings.documents_normalized(_docs(s, d)),
        "text_tokens": lambda s, d: postings.document_terms(_docs(s, d)),
        "postings": lambda s, d: postings.build_postings(_docs(s, d)),
        "term_df": lambda s, d: postings.document_frequency(postings.build_postings(_docs(s, d))),
        "term_lookup": lambda s, d: postings.InvertedIndex.build(_docs(s, d)).lookup("from"),
        "term_contains": term_contains,
        "corpus_size": lambda s, d: postings.build_universe(_docs(s, d)).agg(F.count("*").alias("n")),
        "universe_dense": lambda s, d: postings.dense_universe(_docs(s, d)),
        "index_save_load": index_save_load,
        "index_file_roundtrip": index_file_roundtrip,
        "posting_gaps": lambda s, d: postings.spread_ranks(_ranked(s, d)).select("term", "doc_id", "gap"),
        "pfor_block_stats": lambda s, d: codec.block_stats(_ranked(s, d)),
        "pfor_sizes": lambda s, d: codec.sizes(_ranked(s, d)),
        "pfor_ratio": pfor_ratio,
        "pfor_roundtrip": pfor_roundtrip,
        "skip_pointers": lambda s, d: codec.skip_pointers(_ranked(s, d)),
        "scaled_corpus": lambda s, d: generators.scaled_corpus(_docs(s, d), 3).select("doc_id", "copy"),
        "stream_postings": stream_postings,
        "knn_single": _knn(3, 10),
        "knn_k_gt_n": _knn(3, 1_000_000),
        "knn_zero_k": _knn(3, 0),
        "knn_batch": lambda s, d: _rounded(vector.knn_batch(_points(s, d), _queries(_points(s, d)), 5)),
        "range_single": lambda s, d: _rounded(vector.within(_points(s, d), _first(_points(s, d)), 1.2)),
        "range_batch": lambda s, d: _rounded(vector.within_batch(_points(s, d), _queries(_points(s, d)), 1.2)),
        "range_negative": lambda s, d: _rounded(vector.within(_points(s, d), _first(_points(s, d)), -1.0)),
        "vec_insert_knn": vec_insert_knn,
        "vec_distance": vec_distance,
        "kdtree_2d_knn": _tree_batch(_flat, 32),
        "kdtree_2d_range": _tree_range(_flat, 32, 0.1),
        "kdtree_knn": _tree_batch(_points, 128),
        "kdtree_range": _tree_range(_points, 128, 1.2),
        "kdtree_leaves": kdtree_leaves,
        "kdtree_insert": kdtree_insert,
        "ann_save_load": ann_save_load,
        "csv_questions": csv_questions,
        "hash_upsert": hash_upsert,
        "hash_upsert_rows": hash_upsert_rows,
        "hash_lookup": hash_lookup,
        "hash_contains": hash_contains,
        "hash_bucket_scan": hash_bucket_scan,
        "hash_directory": hash_directory,
        "hash_fullness": hash_fullness,
        "index_put": index_put,
        "hash_lookup_by_hash": lambda s, d: _customers(s, d).lookup_hash(_hash_of(s, "42")),
        "hash_bucket_scan_of": lambda s, d: _customers(s, d).bucket_scan_of(c_custkey=42),
        "hash_save_load": hash_save_load,
        "hash_stats": lambda s, d: _customers(s, d).stats(),
    }
    for name, search in ANN.items():
        out[name], out[f"{name}_recall"] = _ann(search), _recall(name)
    for name, (query, _) in BOOLEAN.items():
        out[name] = _search(query)
        out[name.replace("bool_", "bool_setform_")] = _sets(query)
    return out


N = f"""n AS (SELECT doc_id, trim(regexp_replace(translate(regexp_replace(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '[!-/:-@\\[-`{{-~]', '', 'g'), '{UPPER}', '{LOWER}'), ' +', ' ', 'g'), ' ') AS normalized FROM documents)"""
P = f"{N}, p AS (SELECT DISTINCT doc_id, unnest(string_split(normalized, ' ')) AS term FROM n WHERE normalized <> ''), u AS (SELECT DISTINCT doc_id FROM n WHERE normalized <> '')"
GAPS = f"{P}, g AS (SELECT term, doc_id, row_number() OVER w - 1 AS rank, doc_id - lag(doc_id, 1, 0) OVER w AS gap FROM p WINDOW w AS (PARTITION BY term ORDER BY doc_id))"
BLOCKS = f"{GAPS}, b AS (SELECT term, rank // 128 AS block, count(*) AS n, min(doc_id) AS first_doc, length(bin(max(gap)))::BIGINT AS width FROM g GROUP BY term, rank // 128), s AS (SELECT *, 2 + (width * n + 7) // 8 AS bytes FROM b)"
_POINTS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings)"
_FLAT = "v AS (SELECT vec_id AS id, embedding[1:2]::DOUBLE[] AS vec FROM embeddings)"
_ONE = "a AS (SELECT v.id, list_distance(v.vec, q.vec) AS d FROM v, (SELECT vec FROM v WHERE id = 3) q)"
_MANY = "a AS (SELECT q.id AS qid, v.id, list_distance(v.vec, q.vec) AS d FROM v, (SELECT * FROM v WHERE id % 100 = 0) q), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM a)"
_BATCH = "SELECT qid, id, round(d, 6) AS dist, rank FROM r WHERE rank <= 5"
_ENTRIES = "e AS (SELECT c_custkey, c_nationkey, ('0x' || right(md5(c_custkey::VARCHAR), 7))::BIGINT AS h, length(c_custkey::VARCHAR) + 4 AS bytes FROM customer)"
_DIRECTORY = f"""{_ENTRIES},
nodes AS (SELECT d AS depth, h & ((1::BIGINT << d) - 1) AS suffix, sum(bytes)::BIGINT AS bytes, count(*) AS n FROM e, (SELECT unnest(range(1, 29)) AS d) GROUP BY 1, 2),
over AS (SELECT depth, suffix FROM nodes WHERE bytes > {HASH_CAPACITY} AND depth < 28),
candidates AS (SELECT depth + 1 AS depth, suffix FROM over UNION ALL SELECT depth + 1, suffix + (1::BIGINT << depth) FROM over UNION ALL SELECT 1, 0 UNION ALL SELECT 1, 1),
leaves AS (SELECT c.depth, c.suffix, coalesce(n.bytes, 0)::BIGINT AS bytes, coalesce(n.n, 0)::BIGINT AS n FROM candidates c LEFT JOIN nodes n USING (depth, suffix) WHERE NOT EXISTS (FROM over o WHERE o.depth = c.depth AND o.suffix = c.suffix))"""


# Levels of median splits, by turns on the two coordinates; what is larger than the median goes right.
_LEAVES = f"""WITH RECURSIVE {_FLAT},
l AS (SELECT greatest(0, ceil(log2(count(*) / 64)))::BIGINT AS levels FROM v),
t AS (
  SELECT 0::BIGINT AS level, 1::BIGINT AS leaf, vec FROM v
  UNION ALL
  SELECT level + 1, 2 * leaf + (x > middle)::BIGINT, vec FROM (
    SELECT level, leaf, vec, x, quantile_disc(x, 0.5) OVER (PARTITION BY leaf) AS middle FROM (SELECT *, vec[1 + level % 2] AS x FROM t, l WHERE level < levels)
  )
)
SELECT leaf, count(*) AS n FROM t, l WHERE level = levels GROUP BY leaf"""


def oracle_sql() -> dict[str, str]:
    out = {
        "text_normalize": f"WITH {N} SELECT * FROM n",
        "text_tokens": f"WITH {N} SELECT doc_id, unnest(string_split(normalized, ' ')) AS term FROM n WHERE normalized <> ''",
        "postings": f"WITH {P} SELECT * FROM p",
        "term_df": f"WITH {P} SELECT term, count(*) AS df FROM p GROUP BY term",
        "term_lookup": f"WITH {P} SELECT doc_id FROM p WHERE term = 'from'",
        "term_contains": f"WITH {P} SELECT t AS term, t IN (SELECT term FROM p) AS found FROM (SELECT unnest(['from', 'nosuchterm']) AS t)",
        "corpus_size": f"WITH {P} SELECT count(*) AS n FROM u",
        "universe_dense": f"WITH {N} SELECT unnest(range(1, (SELECT count(*) FROM n WHERE normalized <> '') + 1)) AS doc_id",
        "index_save_load": f"WITH {P} {BOOLEAN['bool_not'][1]}",
        "index_file_roundtrip": f"WITH {P} SELECT * FROM p",
        "posting_gaps": f"WITH {GAPS} SELECT term, doc_id, gap FROM g",
        "pfor_block_stats": f"WITH {BLOCKS} SELECT * FROM s",
        "pfor_sizes": f"WITH {BLOCKS} SELECT term, sum(n)::BIGINT AS df, sum(bytes)::BIGINT AS bytes FROM s GROUP BY term",
        "pfor_ratio": f"WITH {BLOCKS} SELECT (sum(n) * 4)::BIGINT AS raw_bytes, sum(bytes)::BIGINT AS bytes, round(sum(n) * 4 / sum(bytes), 6) AS ratio FROM s",
        "pfor_roundtrip": f"WITH {P} SELECT * FROM p",
        "skip_pointers": f"WITH {BLOCKS} SELECT term, block, first_doc, coalesce(sum(bytes) OVER (PARTITION BY term ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM s",
        "scaled_corpus": "SELECT doc_id + c * (SELECT count(*) FROM documents) AS doc_id, c::INTEGER AS copy FROM documents, (SELECT unnest(range(3)) AS c)",
        "stream_postings": f"WITH {P} SELECT * FROM p",
        "knn_single": f"WITH {_POINTS}, {_ONE} SELECT id, round(d, 6) AS dist FROM a ORDER BY d, id LIMIT 10",
        "knn_k_gt_n": f"WITH {_POINTS}, {_ONE} SELECT id, round(d, 6) AS dist FROM a",
        "knn_zero_k": f"WITH {_POINTS}, {_ONE} SELECT id, round(d, 6) AS dist FROM a LIMIT 0",
        "knn_batch": f"WITH {_POINTS}, {_MANY} {_BATCH}",
        "range_single": f"WITH {_POINTS}, {_ONE} SELECT id, round(d, 6) AS dist FROM a WHERE d <= 1.2",
        "range_batch": f"WITH {_POINTS}, {_MANY} SELECT qid, id, round(d, 6) AS dist FROM a WHERE d <= 1.2",
        "range_negative": f"WITH {_POINTS}, {_ONE} SELECT id, round(d, 6) AS dist FROM a LIMIT 0",
        "vec_insert_knn": f"WITH {_POINTS}, {_ONE} SELECT id, round(d, 6) AS dist FROM a ORDER BY d, id LIMIT 10",
        "vec_distance": f"WITH {_POINTS}, {_ONE} SELECT id, round(d, 6) AS dist FROM a",
        "kdtree_2d_knn": f"WITH {_FLAT}, {_MANY} {_BATCH}",
        "kdtree_2d_range": f"WITH {_FLAT}, {_ONE} SELECT id, round(d, 6) AS dist FROM a WHERE d <= 0.1",
        "kdtree_knn": f"WITH {_POINTS}, {_MANY} {_BATCH}",
        "kdtree_range": f"WITH {_POINTS}, {_ONE} SELECT id, round(d, 6) AS dist FROM a WHERE d <= 1.2",
        "hash_upsert": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 3 THEN 0.0 ELSE o_totalprice::DOUBLE END AS o_totalprice FROM orders",
        "hash_upsert_rows": "SELECT DISTINCT c_custkey, c_nationkey FROM customer",
        "hash_lookup": "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey = 42",
        "hash_contains": "SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)",
        "hash_bucket_scan": f"WITH {_DIRECTORY} SELECT c_custkey, c_nationkey FROM e, leaves WHERE leaves.suffix = 12345 & ((1::BIGINT << depth) - 1) AND e.h & ((1::BIGINT << depth) - 1) = leaves.suffix",
        "hash_directory": f"WITH {_DIRECTORY} SELECT depth::BIGINT AS depth, suffix, bytes, n FROM leaves",
        "kdtree_insert": f"WITH {_FLAT}, {_MANY} {_BATCH}",
        "kdtree_leaves": _LEAVES,
        "ann_save_load": f"WITH {_POINTS}, {_MANY} {_BATCH}",
        "csv_questions": "SELECT row_number() OVER (ORDER BY doc_id) AS doc_id, trim(regexp_replace(translate(text, chr(92) || chr(10) || chr(13), '   '), '([ \t\x0B\f])[ \t\x0B\f]+', '\\1', 'g'), chr(32) || chr(9) || chr(11) || chr(12)) AS text FROM documents WHERE text IS NOT NULL",
        "hash_fullness": f"WITH {_DIRECTORY} SELECT depth::BIGINT AS depth, suffix, bytes, {HASH_CAPACITY} - bytes AS free, bytes >= {HASH_CAPACITY} AS \"full\", {HASH_CAPACITY} - bytes >= 44 AS fits FROM leaves",
        "index_put": f"WITH {P}, e AS (SELECT doc_id, unnest(['the', 'even ids']) AS term FROM u WHERE doc_id % 2 = 0) SELECT term, count(*) AS df, max(doc_id) AS last FROM (SELECT doc_id, term FROM p WHERE term NOT IN (SELECT term FROM e) UNION ALL SELECT doc_id, term FROM e) GROUP BY term",
        "hash_lookup_by_hash": f"WITH {_ENTRIES} SELECT c_custkey, c_nationkey FROM e WHERE h = (SELECT h FROM e WHERE c_custkey = 42)",
        "hash_bucket_scan_of": f"WITH {_DIRECTORY}, o AS (SELECT h AS wanted FROM e WHERE c_custkey = 42) SELECT c_custkey, c_nationkey FROM e, leaves, o WHERE leaves.suffix = wanted & ((1::BIGINT << depth) - 1) AND e.h & ((1::BIGINT << depth) - 1) = leaves.suffix",
        "hash_save_load": "SELECT c_custkey, c_nationkey FROM customer",
        "hash_stats": f"WITH {_DIRECTORY} SELECT max(depth)::BIGINT AS global_depth, 1::BIGINT << max(depth) AS directory_slots, count(*) AS leaf_buckets, sum(n)::BIGINT AS entries FROM leaves",
    }
    for name in ANN:
        out[f"{name}_recall"] = "SELECT count(*) AS queries, 5 * count(*) AS exact, true AS recall_reached FROM embeddings WHERE vec_id % 100 = 0"
    for name, (_, sql) in BOOLEAN.items():
        out[name] = out[name.replace("bool_", "bool_setform_")] = f"WITH {P} {sql}"
    return out
