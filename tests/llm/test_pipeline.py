"""The pipeline's stages, each against brute force or a known effect."""

import random
import re

import sentencepiece

import corpus_pipeline as pipeline
from tessera.llm.catalogue import PIECE_MODEL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = text(150), text(40)
    texts = [text(r.randint(60, 140)) for _ in range(60)]
    texts += [base] * 4 + [base.replace(base.split()[70], "edited", 1)]
    texts += [f"{text(60)} {passage} {text(20)}" for _ in range(6)]
    texts += [" ".join(w + "###$$" for w in text(90).split()) for _ in range(25)]
    texts += [None, "", "short text", "same words here " * 40]
    return [(i, t, "en", ["big", "small", None][0 if i % 3 else i % 2 + 1], len(t or "")) for i, t in enumerate(texts)]


def test_stages(spark, tmp_path):
    data = rows()
    text = {i: t for i, t, *_ in data}
    docs = spark.createDataFrame(data, SCHEMA)
    labels = [(i, 0 if "###" in (t or "") else 1, 0) for i, t, *_ in data]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name.replace(" ", "_"))
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    quality, near, cut, mixed, encoded = kept.values()
    assert {r.doc_id for r in quality} == {i for i in text if i < 71}
    assert {r.doc_id for r in near} == {r.doc_id for r in quality} - {61, 62, 63, 64}
    seen, want = set(), {}
    for i in sorted(r.doc_id for r in near):
        w = WORD.findall(text[i])
        gone = set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if key in seen else set()
            seen.add(key)
        want[i] = [x for k, x in enumerate(w) if k not in gone]
    assert {r.doc_id: WORD.findall(r.text) for r in cut} == want
    assert all(r.n_chars == len(r.text) for r in cut) and sum(len(want[i]) < len(WORD.findall(text[i])) for i in want) == 5
    assert {tuple(r) for r in mixed} == {tuple(r) for r in cut}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    final = {r.doc_id: r.text for r in cut}
    assert {r.doc_id: list(r.token_ids) for r in encoded} == {i: library.encode(t) for i, t in final.items()}
    run = pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, list(r.token_ids)) for r in run.collect()) == sorted((r.doc_id, list(r.token_ids)) for r in encoded)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []
