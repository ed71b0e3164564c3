"""SentencePiece encoding and decoding over piece lattices.

Text becomes units: no piece has a mark (for a space) after another character, and none has a newline,
so a unit is a run of marks with the characters up to the next mark, or a newline, and units are encoded
apart. A unit's lattice has an edge for each bounded-length substring that is a piece.

``encode_words`` is the relational form: explode the substrings of distinct words, equi-join them to the
piece table, group edges by word, and fold them with ``aggregate``. The fold is Viterbi's (the best sum of
scores) for unigram models. A BPE model's scores are merge priorities, and the best sum is not what such a
model encodes to; its fold replays the merges on the lattice: of the edges over two neighbouring symbols the
best-scored, leftmost one joins them, until none is left. That equals the library's encoding.

``encode_documents`` works on whole documents with the same lattices and folds in Arrow batches (``Lattices``):
each task explodes, joins, groups and folds the distinct units of its own documents, all units of one length at
once, keeps a bounded number of results, and shuffles nothing. Shuffled, the words' ids would have to come back
to every document that has them (figures in the README).

Defined cases: a null or empty text has no token; characters that are no piece become byte pieces; a text with
the mark itself encodes as if it were a space, so its round trip is false; units and texts may be of any length;
repeated rows each keep theirs; other columns pass through, and those named like an output column are replaced
by it; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.lattice import Vocabulary, codes, edges, long_edges

MARK = "▁"
#: Units of which a task keeps the encoding.
KEPT_UNITS = 700_000
#: Documents, and units of one length, that are encoded together.
DOCUMENTS_AT_ONCE, UNITS_AT_ONCE = 1000, 20_000
#: Units of up to so many code points have their borders in one 64-bit word.
BORDERS = 62
_UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Below any piece's score: an edge for a character that is no piece.
UNKNOWN = -1e12


@dataclass(frozen=True)
class PieceModel:
    """Pieces with their ids and scores, ids of the 256 byte pieces, and the kind of fold."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes: list[int]
    size: int
    fold: str = "merge"

    @staticmethod
    def load(path: str, fold: str = "merge") -> PieceModel:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, raw = {}, {}, [0] * 256
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                raw[int(p[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                ids[p], scores[p] = i, m.get_score(i)
        return PieceModel(ids, scores, raw, m.get_piece_size(), fold)

    @property
    def widest(self) -> int:
        return max(map(len, self.ids))


def units_of(text: str) -> list[str]:
    """The text's units, with the mark that begins every text."""
    return _UNIT.findall(MARK + text.replace(" ", MARK)) if text else []


def fold_viterbi(unit: str, scores: dict[str, float], widest: int) -> list[str]:
    """Pieces of the path of the largest sum of scores, the longest last piece of equals."""
    n = len(unit)
    best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - widest), end):
            s = scores.get(unit[start:end], UNKNOWN if end - start == 1 else None)
            if s is not None and best[start] + s > best[end]:
                best[end], back[end] = best[start] + s, start
    out, end = [], n
    while end:
        out.append(unit[back[end] : end])
        end = back[end]
    return out[::-1]


def piece_ids(pieces: list[str], model: PieceModel) -> list[int]:
    out: list[int] = []
    for p in pieces:
        i = model.ids.get(p)
        out.extend([i] if i is not None else [model.bytes[b] for b in p.encode("utf-8", "surrogatepass")])
    return out


class Lattices:
    """Encodes units by lattices over a model's pieces, units of one length together.

    ``lattice.edges`` explodes the bounded-length substrings of the units and joins them to the pieces; the edges
    are grouped by unit and sorted; and the fold of each unit runs over its edges, in step with the other units.
    Borders of a unit's symbols are the bits of one word.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        pieces = list(model.ids)
        self.vocabulary = Vocabulary.of(pieces)
        self.ids = np.array([model.ids[p] for p in pieces], np.int32)
        self.scores = np.array([model.scores[p] for p in pieces])

    def encode(self, units: list[str]) -> list[bytes]:
        """The int32 ids of each unit."""
        out: list[bytes] = [b""] * len(units)
        by: dict[int, list[int]] = {}
        for k, u in enumerate(units):
            by.setdefault(len(u), []).append(k)
        for length, at in by.items():
            for a in range(0, len(at), UNITS_AT_ONCE):
                part = at[a : a + UNITS_AT_ONCE]
                words = [units[k] for k in part]
                found = self._short(words, length) if length <= BORDERS else map(self._long, words)
                for k, ids in zip(part, found, strict=True):
                    out[k] = ids
        return out

    def _short(self, words: list[str], length: int) -> list[bytes]:
        rows = codes(words, length)
        own = np.full((length, len(words)), -1, np.int32)  # the id of the symbol that begins here
        if self.model.fold == "merge":
            mask = self._merged(rows, own)
        else:
            mask = self._best_path(rows, own)
        begins = (mask[:, None] >> np.arange(length, dtype=np.uint64) & np.uint64(1)).astype(bool)
        ids = own.T[begins]
        cuts = np.concatenate([[0], np.cumsum(begins.sum(axis=1))]).tolist()
        raw = ids.tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for k in np.unique(np.nonzero(begins)[0][ids < 0]).tolist() if (ids < 0).any() else ():
            out[k] = self._with_bytes(words[k], np.flatnonzero(begins[k]), ids[cuts[k] : cuts[k + 1]])
        return out

    def _with_bytes(self, word: str, begins: np.ndarray, ids: np.ndarray) -> bytes:
        out: list[int] = []
        for at, i in zip(begins.tolist(), ids.tolist(), strict=True):
            out += [i] if i >= 0 else [self.model.bytes[b] for b in word[at].encode("utf-8", "surrogatepass")]
        return np.array(out, np.int32).tobytes()

    def _merged(self, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Borders after all merges: the best-scored, leftmost edge over two neighbouring symbols joins them, until none is left."""
        n, length = rows.shape
        found = [(np.zeros(0, np.int64),) * 4]
        for start, end, hit, number in edges(self.vocabulary, rows):
            if end - start == 1:
                own[start, hit] = self.ids[number]
            elif len(hit):
                found.append((hit, np.full(len(hit), start), np.full(len(hit), end), number))
        unit, start, end, number = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((start, -self.scores[number], unit))
        unit, start, end, number = (x[order] for x in (unit, start, end, number))
        one = np.uint64(1)
        ends = one << start.astype(np.uint64) | one << end.astype(np.uint64)
        inside = (one << end.astype(np.uint64)) - (one << (start + 1).astype(np.uint64))
        mask = np.full(n, (one << np.uint64(length + 1)) - one)
        while len(unit):
            now = mask[unit]
            ready = np.flatnonzero((now & ends == ends) & (np.bitwise_count(now & inside) == 1))
            if not len(ready):
                break
            of = unit[ready]
            first = ready[np.concatenate([[True], of[1:] != of[:-1]])]
            mask[unit[first]] &= ~inside[first]
            own[start[first], unit[first]] = self.ids[number[first]]
            now = mask[unit]
            left = (now & ends == ends) & (now & inside != 0)
            unit, start, number, ends, inside = (x[left] for x in (unit, start, number, ends, inside))
        return mask

    def _best_path(self, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Borders of the path of the largest sum of scores, the longest last piece of equals (Viterbi)."""
        n, length = rows.shape
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        back, ids = np.zeros((length + 1, n), np.int64), np.full((length + 1, n), -1, np.int32)
        every = np.arange(n)
        for start, end, hit, number in edges(self.vocabulary, rows):
            score, piece = np.full(n, UNKNOWN if end - start == 1 else -np.inf), np.full(n, -1, np.int32)
            score[hit], piece[hit] = self.scores[number], self.ids[number]
            total = best[start] + score
            better = total > best[end]
            best[end][better], back[end][better], ids[end][better] = total[better], start, piece[better]
        at, mask = np.full(n, length), np.full(n, np.uint64(1) << np.uint64(length))
        while at.any():
            going = every[at > 0]
            from_ = back[at[going], going]
            own[from_, going] = ids[at[going], going]
            mask[going] |= np.uint64(1) << from_.astype(np.uint64)
            at[going] = from_
        return mask

    def _long(self, word: str) -> bytes:
        """One unit of any length; merges are taken from a heap of its lattice's edges."""
        row = codes([word], len(word))[0]
        if self.model.fold != "merge":
            return np.array(piece_ids(fold_viterbi(word, self.model.scores, self.model.widest), self.model), np.int32).tobytes()
        n = len(word)
        held: dict[tuple[int, int], int] = {}
        for width, starts, numbers in long_edges(self.vocabulary, row):
            held.update(zip(zip(starts.tolist(), (starts + width).tolist(), strict=True), numbers.tolist(), strict=True))
        after, before = list(range(1, n + 2)), list(range(-1, n))  # of each border, the next and the last
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            if 0 <= a < n and after[a] < n and (k := held.get((a, after[after[a]]))) is not None:
                heapq.heappush(heap, (-self.scores[k], a, after[a], after[after[a]]))

        for a in range(n - 1):
            offer(a)
        gone = bytearray(n + 1)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if gone[a] or gone[b] or gone[c] or after[a] != b or after[b] != c:
                continue
            gone[b] = 1
            after[a], before[c] = c, a
            offer(before[a])
            offer(a)
        begins = np.flatnonzero(np.frombuffer(gone, np.uint8)[:n] == 0)
        numbers = [held.get((a, after[a]), -1) for a in begins.tolist()]
        ids = np.array([self.ids[k] if k >= 0 else -1 for k in numbers], np.int32)
        return self._with_bytes(word, begins, ids)


def encode_unit(unit: str, model: PieceModel) -> list[int]:
    return np.frombuffer(Lattices(model).encode([unit])[0], np.int32).tolist()


class Decoder:
    def __init__(self, model: PieceModel):
        self.bytes = [b""] * model.size
        for p, i in model.ids.items():
            self.bytes[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(model.bytes):
            self.bytes[i] = bytes([b])

    def decode(self, ids: list[int]) -> str:
        held = self.bytes
        text = b"".join([held[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode_documents(docs: DataFrame, model: PieceModel, *, text_col: str = "text") -> DataFrame:
    """The input without its text, with n_tokens, token_ids and round_trip (the ids decode to the very text)."""
    added = ("n_tokens", "token_ids", "round_trip")
    names = [c for c in docs.columns if c not in (text_col, *added)]
    picked = docs.select(*names, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, decoder, known = Lattices(model), Decoder(model), {}
        for whole in batches:
            for a in range(0, whole.num_rows, DOCUMENTS_AT_ONCE):
                batch = whole.slice(a, DOCUMENTS_AT_ONCE)
                texts = [t or "" for t in batch.column(len(names)).to_pylist()]
                split = [units_of(t) for t in texts]
                new = {u for units in split for u in units}.difference(known)
                if len(known) + len(new) > KEPT_UNITS:
                    known, new = {}, {u for units in split for u in units}
                fresh = list(new)
                known.update(zip(fresh, lattices.encode(fresh), strict=True))
                encoded = [b"".join([known[u] for u in units]) for units in split]
                same = [decoder.decode(np.frombuffer(ids, np.int32).tolist()) == t for ids, t in zip(encoded, texts, strict=True)]
                n = np.array([len(x) // 4 for x in encoded], np.int64)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [pa.array(n), lists, pa.array(same, pa.bool_())], names=[*names, *added])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.select(*names).schema)
    return picked.mapInArrow(run, fields + "n_tokens long, token_ids array<int>, round_trip boolean")


def distinct_units(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(word) with the units of all texts, as of ``units_of``; repeats go inside rows and tasks before the shuffle."""
    marked = F.concat(F.lit(MARK), F.replace(F.col(text_col), F.lit(" "), F.lit(MARK)))
    units = F.when(F.length(text_col) > 0, F.array_distinct(F.regexp_extract_all(marked, F.lit(_UNIT.pattern), F.lit(0))))
    return docs.select(F.explode(units).alias("word")).distinct()


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """(piece, id, score): as many rows as the model has pieces."""
    return spark.createDataFrame([(p, i, float(model.scores[p])) for p, i in model.ids.items()], "piece string, id int, score double")


def lattice_edges(words: DataFrame, model: PieceModel, *, word_col: str = "word") -> DataFrame:
    """(word, edges): distinct words, each with its edges (stop, start, id, score) in order.

    A character that is no piece has an edge of its own, without an id. Grouping needs no shuffle beyond
    that of ``distinct``, as the words stay dealt by word; the piece table is broadcast, being of fixed size.
    """
    distinct = words.select(F.col(word_col).alias("word")).where("word IS NOT NULL AND word <> ''").distinct()
    n = F.length("word")
    starts = distinct.select("word", F.explode(F.sequence(F.lit(1), n)).alias("start"))
    spans = starts.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.widest), n - F.col("start") + 1))).alias("width"))
    spans = spans.select("word", "start", "width", F.substr(F.col("word"), F.col("start"), F.col("width")).alias("part"))
    pieces = piece_table(words.sparkSession, model)
    found = spans.join(F.broadcast(pieces), F.col("part") == F.col("piece"), "left").where(F.col("id").isNotNull() | (F.col("width") == 1))
    edge = F.struct((F.col("start") + F.col("width") - 1).alias("stop"), (F.col("start") - 1).alias("start"), F.col("id").alias("id"), F.coalesce("score", F.lit(UNKNOWN)).alias("score"))
    return found.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def viterbi_borders(word: Column, edges: Column) -> Column:
    """The borders (from 0) of the pieces on the path of the largest sum of scores."""
    n = F.length(word)
    cell = lambda score, start: F.struct(score.alias("score"), start.alias("start"))
    begin = F.transform(F.sequence(F.lit(0), n), lambda i: cell(F.when(i == 0, F.lit(0.0)).otherwise(F.lit(float("-inf"))), F.lit(0)))

    def step(cells: Column, e: Column) -> Column:
        score = F.get(cells, e["start"])["score"] + e["score"]
        return F.transform(cells, lambda c, i: F.when((i == e["stop"]) & (score > c["score"]), cell(score, e["start"])).otherwise(c))

    cells = F.aggregate(edges, begin, step)

    def walk(table: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), n), F.array(n), lambda path, _: F.when(F.get(path, F.lit(0)) == 0, path).otherwise(F.array_prepend(path, F.get(table, F.get(path, F.lit(0)))["start"])))

    return F.element_at(F.transform(F.array(cells), walk), 1)


def merge_borders(word: Column, edges: Column) -> Column:
    """The borders (from 0) of the pieces after all merges; bits of one integer while they fit."""
    n = F.length(word)
    joining = F.array_sort(F.transform(F.filter(edges, lambda e: e["stop"] - e["start"] > 1), lambda e: F.struct((-e["score"]).alias("rank"), e["start"].alias("start"), e["stop"].alias("stop"))))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    with_bits = F.transform(joining, lambda e: F.struct(bit(e["start"]).bitwiseOR(bit(e["stop"])).alias("ends"), (bit(e["stop"]) - bit(e["start"] + 1)).alias("inside")))

    def by_bits(sorted_edges: Column) -> Column:
        def step(mask: Column, _: Column) -> Column:
            ready = F.filter(sorted_edges, lambda e: (mask.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(mask.bitwiseAND(e["inside"])) == 1))
            return mask - F.coalesce(mask.bitwiseAND(F.get(ready, F.lit(0))["inside"]), F.lit(0).cast("long"))

        mask = F.aggregate(F.sequence(F.lit(1), F.least(n, F.size(sorted_edges))), bit(n + 1) - 1, step)
        return F.element_at(F.transform(F.array(mask), lambda m: F.filter(F.sequence(F.lit(0), n), lambda i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1).cast("long")) == 1)), 1)

    def by_list(sorted_edges: Column) -> Column:
        def step(borders: Column, _: Column) -> Column:
            ready = F.filter(sorted_edges, lambda e: F.array_contains(borders, e["start"]) & (F.array_position(borders, e["stop"]) - F.array_position(borders, e["start"]) == 2))
            joined = lambda best: F.when(best.isNull(), borders).otherwise(F.filter(borders, lambda b: (b <= best["start"]) | (b >= best["stop"])))
            return F.element_at(F.transform(F.array(F.get(ready, F.lit(0))), joined), 1)

        return F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), step)

    whole = F.sequence(F.lit(0), n)
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    return F.when(F.size(joining) == 0, whole).when(n < BORDERS, let(with_bits, by_bits)).otherwise(let(joining, by_list))


def encode_words(words: DataFrame, model: PieceModel, *, word_col: str = "word") -> DataFrame:
    """(word, ids) of the distinct words, each a unit as of ``units_of``, by relational lattices alone."""
    edges = lattice_edges(words, model, word_col=word_col)
    borders = (merge_borders if model.fold == "merge" else viterbi_borders)(F.col("word"), F.col("edges"))
    raw = F.array(*[F.lit(i) for i in model.bytes])

    def ids(at: Column) -> Column:
        spans = F.arrays_zip(F.slice(at, 1, F.size(at) - 1).alias("a"), F.slice(at, 2, F.size(at) - 1).alias("b"))

        def one(s: Column) -> Column:
            a, b = s.getField("a"), s.getField("b")
            found = F.get(F.filter(F.col("edges"), lambda e: (e["start"] == a) & (e["stop"] == b)), F.lit(0))["id"]
            code = F.encode(F.substr(F.col("word"), a + 1, b - a), "UTF-8")
            values = F.transform(F.sequence(F.lit(1), F.length(code)), lambda i: F.get(raw, F.conv(F.hex(F.substring(code, i, F.lit(1))), 16, 10).cast("int")))
            return F.when(found.isNotNull(), F.array(found)).otherwise(values)

        return F.flatten(F.transform(spans, one))

    return edges.select("word", F.element_at(F.transform(F.array(borders), ids), 1).alias("ids"))
