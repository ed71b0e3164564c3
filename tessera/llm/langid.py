"""Language ID by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word is
the sum, over all segmentations of it into pieces, of the products of their probabilities, by the forward
algorithm; that of a text is the product over its words. Probabilities are learned from labelled texts by
expectation-maximisation over the same lattices, and smoothed: in each round tasks give the expected counts
of their share of the sample's words, and the sums over all tasks make the next round's model. They are
sums of integers, so the model is the same however rows are dealt.

Learning uses a bounded sample of the labelled rows, ``TRAIN_ROWS`` different ones of each language at most
(those with the smallest hashes of id and text); scoring covers every word of every text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no labelled row all are
``und``; of languages of one score the first in alphabetical order wins; repeated rows each keep theirs, and
count once in the sample; rows of a null id are never held out; words and texts may be of any length;
columns of clashing names are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.lattice import UNIT, Vocabulary, expected, forward
from tessera.session import cut

TRAIN_ROWS = 400
ROUNDS = 2
SMOOTHING = 0.5
FLOOR = 1e-7
MARK = "▁"
CACHE_WORDS = 250_000
TEXTS_AT_ONCE = 2048
#: Words of one length that are scored together.
WORDS_AT_ONCE = 20_000


@dataclass(frozen=True)
class Model:
    languages: list[str]
    pieces: list[str]
    weights: np.ndarray
    floor: np.ndarray


def fixed_pieces(model_file: str) -> list[str]:
    """The vocabulary's ordinary pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]


def held_out(id_column: Column) -> Column:
    """True for the ids that learning must not see."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(lang, word, n) of the sample, stored: words of the labelled rows that aren't held out and have the smallest hashes."""
    able = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    able = able.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    # Some twice the different rows wanted have hashes below a language's bound; only these are ranked.
    sizes = able.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()
    bounds = [x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, 2 * (train_rows + 50) / max(1, r["n"]))))))]
    few = able.where(F.col("key") <= F.create_map(*bounds)[F.col("lang")]) if sizes else able
    ranked = few.select("lang", "key").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
    chosen = ranked.where(F.col("rank") <= train_rows).select("lang", "key")
    rows = few.join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "key").agg(F.first("text").alias("text")).select("lang", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in text.split():
                    seen[lang, w] = seen.get((lang, w), 0) + 1
            lang, word = zip(*seen, strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    return cut(rows.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))


def learn(docs: DataFrame, pieces: list[str], *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """A model of the languages of the labelled rows whose ids aren't held out."""
    words = training_words(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, train_rows=train_rows)
    languages = [r[0] for r in words.select("lang").distinct().orderBy("lang").collect()]
    weights = np.tile(np.array([64.0 ** -len(p) for p in pieces]), (len(languages), 1))
    for _ in range(ROUNDS if languages else 0):
        weights = _next_round(words, languages, pieces, weights)
    return Model(languages, pieces, weights, np.full(len(languages), FLOOR))


def _next_round(words: DataFrame, languages: list[str], pieces: list[str], weights: np.ndarray) -> np.ndarray:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(pieces)
        out = np.zeros((len(languages), len(pieces)), np.int64)
        for batch in batches:
            parts: dict[tuple[str, int], tuple[list[str], list[int]]] = {}
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = parts.setdefault((lang, len(word)), ([], []))
                own[0].append(MARK + word)
                own[1].append(n)
            for (lang, length), (own, n) in parts.items():
                at = languages.index(lang)
                for a in range(0, len(own), WORDS_AT_ONCE):
                    out[at] += expected(vocabulary, weights[at], FLOOR, own[a : a + WORDS_AT_ONCE], length + 1, np.array(n[a : a + WORDS_AT_ONCE], np.int64))
        at, piece = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(piece, pa.int32()), pa.array(out[at, piece], pa.int64())], names=["lang", "piece", "n"])

    found = words.mapInArrow(counted, "lang int, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(weights.shape)
    counts[found["lang"].to_numpy(), found["piece"].to_numpy()] = found["n"].to_numpy() * UNIT
    return (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * len(pieces))


class Scorer:
    """Log probabilities of words, kept for the words seen last."""

    def __init__(self, model: Model):
        self.model = model
        self.vocabulary = Vocabulary.of(model.pieces)
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.languages)))

    def learn_words(self, words: list[str]) -> None:
        """Adds words that aren't known."""
        parts: dict[int, tuple[list[str], list[int]]] = {}
        base = len(self.known)
        for k, w in enumerate(words):
            self.known[w] = base + k
            own = parts.setdefault(len(w) + 1, ([], []))
            own[0].append(MARK + w)
            own[1].append(k)
        logs = np.zeros((len(words), len(self.model.languages)))
        for length, (own, at) in parts.items():
            for a in range(0, len(own), WORDS_AT_ONCE):
                logs[at[a : a + WORDS_AT_ONCE]] = forward(self.vocabulary, self.model.weights, self.model.floor, own[a : a + WORDS_AT_ONCE], length)
        self.logs = np.concatenate([self.logs, logs])

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Log probabilities of the texts, by language."""
        out = np.zeros((len(texts), len(self.model.languages)))
        for a in range(0, len(texts), TEXTS_AT_ONCE):
            split = [(t or "").split() for t in texts[a : a + TEXTS_AT_ONCE]]
            new = list({w for words in split for w in words if w not in self.known})
            if len(new) + len(self.known) > CACHE_WORDS:
                new = list({w for words in split for w in words})
                self.known, self.logs = {}, self.logs[:0]
            if new:
                self.learn_words(new)
            for i, words in enumerate(split):
                if words:
                    out[a + i] = self.logs[[self.known[w] for w in words]].sum(axis=0)
        return out


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; the score is the language's share of the probability."""
    languages = model.languages
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            named: list[str] = ["und"] * len(texts)
            share = np.zeros(len(texts))
            if languages and texts:
                logs = scorer.score(texts)
                best = logs.argmax(axis=1)
                p = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                for i, t in enumerate(texts):
                    if t and (t.isalpha() or any(map(str.isalpha, t))):
                        named[i], share[i] = languages[best[i]], p[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(share)], names=[id_col, "lang_pred", "score"])

    picked = docs.select(id_col, text_col)
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
