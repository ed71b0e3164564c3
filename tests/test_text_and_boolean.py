import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.text import normalize
from tessera.operators import boolean
from tessera.operators.postings import InvertedIndex, build_postings, build_universe, dense_universe, ranked

CORPUS = [(1, "red kite over chalk hills"), (2, "grey heron below the weir"), (3, "kite shop"), (4, "heron and kite weir"), (5, "chalk dust")]
MIXED = [
    (1, "Rivers; rise early."),
    (2, "No river rises twice - the Severn (mostly) does!"),
    (3, "F# was tuned by ear."),
    (4, "The EARLY tide: rivers again"),
    (5, "tide tables"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.fixture(scope="module")
def index(spark):
    built = InvertedIndex.build(frame(spark, CORPUS))
    return InvertedIndex(built.postings.cache(), built.universe.cache())


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", ""),
        ("?;:--(...)", ""),
        ("Tide, TABLES! no. 7", "tide tables no 7"),
        ("already plain words", "already plain words"),
        ("  Gaps \n\t of   every--kind ;  ", "gaps of everykind"),
        # Fixed values that follow from the rules.
        ("e-coli Don't C++", "ecoli dont c"),
        ("\v Ünï\fÄ ", "Ünï Ä"),
        (None, None),
    ],
)
def test_normalize(spark, text, expected):
    df = frame(spark, [(1, text)])
    assert df.select(normalize(df.text)).first()[0] == expected


QUERIES = [
    "heron", "kite", "heron AND chalk", "hills OR dust", "shop OR heron OR dust", "NOT kite", "kite AND NOT weir", "(kite OR dust) AND chalk", "weir AND (the OR grey)",
    "swan AND heron", "kite AND swan", "NOT NOT heron", "kite AND NOT NOT chalk", "not KITE or shop", "NOT (kite OR chalk)", "kite AND (NOT chalk OR hills)",
]


@pytest.mark.parametrize("query", QUERIES)
def test_queries(index, query):
    expected = [i for i, t in CORPUS if boolean.parse(query).holds(frozenset(t.split()))]
    assert ids(index.search(query)) == expected
    assert ids(boolean.search_by_sets(index.postings, index.universe, query)) == expected


@pytest.mark.parametrize("query", ["OR kite", "kite AND", "kite OR (weir AND", "kite AND (weir OR )", "kite NOT OR weir", "", "()", "a b", "(a", "a)", "a (b)", "NOT", "a NOT b"])
def test_malformed(query):
    with pytest.raises(ValueError):
        boolean.parse(query)


def test_added_documents_show(spark, index):
    more = index.add(frame(spark, [(6, "dust on the heron")]))
    assert ids(more.search("heron AND dust")) == [6]
    assert more.total_documents() == 6
    assert more.contains("dust") and not more.contains("swan")


def test_same_id_merges_blank_and_null_vanish(spark):
    i = InvertedIndex.build(frame(spark, [(1, "Low, tide!"), (1, "low water"), (2, ""), (3, "?!"), (4, None), (None, "x")]))
    assert [ids(i.lookup(t)) for t in ("low", "tide", "water", "x")] == [[1], [1], [1], []]
    assert i.total_documents() == 1


def test_saved_index(spark, tmp_path):
    i = InvertedIndex.build(frame(spark, MIXED))
    put = i.put(spark.createDataFrame([(7, "new"), (7, "new"), (2, "new"), (None, "new"), (1, None)], "doc_id long, term string"))
    assert sorted(r[0] for r in put.lookup("new").collect()) == [2, 7]
    again = put.put(spark.createDataFrame([(3, "new")], "doc_id long, term string"))
    assert [r[0] for r in again.lookup("new").collect()] == [3] and again.postings.count() == i.postings.where("term <> 'new'").count() + 1
    assert again.total_documents() == i.total_documents()
    i.save(str(tmp_path))
    loaded = InvertedIndex.load(spark, str(tmp_path))
    for one in (i, loaded):
        assert [ids(one.lookup(t)) for t in ("rivers", "early", "tide", "the", "otter")] == [[1, 4], [1, 4], [4, 5], [2, 4], []]
    assert ids(loaded.search("tables OR (rivers AND NOT rise)")) == [4, 5]
    assert ids(loaded.search("F#")) == [] and ids(loaded.search("F#", normalize_terms=True)) == [3]


def test_universes(spark):
    docs = frame(spark, [(10, "a"), (10, "b"), (7, " ")])
    assert ids(build_universe(docs)) == [10]
    assert ids(dense_universe(docs)) == [1, 2]


def test_ranks_cross_ranges(spark):
    got = ranked(build_postings(frame(spark, [(i, "x") for i in (0, 65535, 65536, 200000)]))).orderBy("rank").collect()
    assert [(r.doc_id, r["rank"], r.gap) for r in got] == [(0, 0, 0), (65535, 1, 65535), (65536, 2, 1), (200000, 3, 134464)]


_terms = st.sampled_from(["the", "kite", "heron", "chalk", "none"])
_trees = st.recursive(_terms.map(boolean.Term), lambda c: st.one_of(c.map(boolean.Not), st.tuples(st.booleans(), c, c).map(lambda x: boolean.Pair(*x))), max_leaves=5)


def _text(node):
    if isinstance(node, boolean.Term):
        return node.text
    if isinstance(node, boolean.Not):
        return f"NOT ({_text(node.of)})"
    return f"({_text(node.left)}) {'AND' if node.both else 'OR'} ({_text(node.right)})"


@given(_trees)
@settings(max_examples=12, deadline=None)
def test_flags_equal_brute_force(index, node):
    words = {i: frozenset(t.split()) for i, t in CORPUS}
    assert ids(index.search(_text(node))) == [i for i, w in words.items() if node.holds(w)]
