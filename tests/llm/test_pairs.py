"""Substring dedup, SimHash, components and image copies against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import image_match, simhash, substring_dedup
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=0):
    """Copies, near copies, shared passages, odd white space, empty and null texts, a long text, out of order."""
    r = random.Random(seed)
    words = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = text(30), text(120)
    rows = [(i, text(r.randint(0, 90))) for i in range(60)]
    rows += [(100 + i, base) for i in range(8)]
    rows += [(200 + i, " ".join(w if r.random() > 0.02 else "edit" for w in base.split())) for i in range(20)]
    rows += [(300 + i, f"{text(15)}\n{passage}\t {text(10)}") for i in range(10)]
    rows += [(400, ""), (401, None), (402, " \n\t "), (403, "one"), (404, "a b c d"), (405, "x " * 200), (406, text(6000) + " " + passage), (407, "\u00a0\u2003 \x1c y\x85z")]
    r.shuffle(rows)
    return rows


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def brute_substrings(rows, window=20):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda x: (x[0], x[1] or "")):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.setdefault(i, []).append((len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize(("window", "block"), [(20, 4_000_000), (20, 2_000), (5, 3_000), (1, 5_000)])
def test_substrings_equal_brute_force(spark, monkeypatch, window, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_CHARS", block)
    monkeypatch.setattr(substring_dedup, "BUCKET_CHARS", 3 * block)
    rows = corpus()
    got = substring_dedup.dedup_substrings(frame(spark, rows), window=window).collect()
    want = brute_substrings(rows, window)
    assert len(got) == len(rows)
    for r in got:
        n, gone, digest, kept = want[r.doc_id][0]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, digest)
        assert WORD.findall(r.text or "") == kept
        if not gone:
            assert r.text == dict(rows)[r.doc_id]


def test_substrings_odd_rows(spark):
    same = " ".join(f"t{i}" for i in range(25))
    rows = [(5, same, 1, "x"), (5, same, 2, "y"), (5, "short", 3, None), (None, same, 4, "z"), (2, same + " more", 5, "q")]
    df = frame(spark, rows, "doc_id long, text string, n_words int, block string")
    got = sorted((r.doc_id is None, r.doc_id, r.text, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(df).collect())
    assert [(g[3], g[4]) for g in got] == [(26, 0), (25, 25), (25, 25), (1, 0), (25, 25)]
    assert substring_dedup.dedup_substrings(df.limit(0)).collect() == []
    assert substring_dedup.dedup_substrings(frame(spark, [(1, None)])).first().n_words == 0


def test_covers_hold_all_differences():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def brute_fingerprint(text, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, distance):
    to = dict(zip(ids, ids, strict=True))

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    for i, a in enumerate(ids):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                x, y = find(a), find(ids[j])
                to[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    rows = corpus(3)
    got = simhash.near_duplicates(frame(spark, rows), shingle=4, distance=4, similarity=None).select("id", simhash.fingerprint_hex("fp").alias("h"), "component_id").collect()
    fps = [brute_fingerprint(t, 4) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps, 4)
    assert {r.id: (r.h, r.component_id) for r in got} == {i: (f"{f:016x}", want[i]) for (i, _), f in zip(rows, fps, strict=True)}


@pytest.mark.parametrize("large", [4_000_000, 10])
def test_links_of_dense_clusters(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE_RUN", large)
    r = random.Random(1)
    centre, fps = r.getrandbits(64), set()
    for _ in range(150):
        fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))))
    while len(fps) < 400:
        fps.add(r.getrandbits(64))
    fps = sorted(fps)
    r.shuffle(fps)
    signed = [(i, f - (1 << 64) if f >> 63 else f, 0) for i, f in enumerate(fps)]
    classes = spark.createDataFrame(signed, "node long, fp long, fp2 long").cache()
    for distance in (4, 7) if large > 10 else (4,):
        probes = simhash.plan_probes(classes, len(fps), distance)
        found = components(simhash.links(classes, probes, len(fps), distance))
        got = {i: i for i in range(len(fps))} | {x.node: x.component for x in found.collect()}
        assert got == brute_components(list(range(len(fps))), fps, distance)


def test_pigeonhole_of_the_plan(spark):
    classes = spark.createDataFrame([(i, random.Random(i).getrandbits(63), 0) for i in range(300)], "node long, fp long, fp2 long")
    for distance in (1, 4, 7):
        probes = simhash.plan_probes(classes, 10_000_000, distance)
        reach = [max((f.bit_count() for f in p.flips), default=0) + 1 for p in probes]
        assert sum(reach) == distance + 1
        assert all(a.mask & b.mask == 0 for k, a in enumerate(probes) for b in probes[:k])


def test_simhash_odd_rows(spark):
    df = frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "A B c d e f"), (9, None), (8, ""), (7, "z")], "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(df, shingle=5)
    assert sorted((r.id or -1, r.component_id) for r in got.collect()) == [(-1, 3), (3, 3), (3, 3), (7, 7), (8, 8), (9, 8)]
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_second_fingerprint_keeps_real_copies_only(spark):
    rows = corpus(5)
    got = {r.id: r.component_id for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert all(got[i] == 100 for i in range(100, 108))
    assert all(got[i] == i for i in range(60) if len((dict(rows)[i] or "").split()) > 20)


def test_near_copies_link_by_exact_similarity(spark):
    r = random.Random(11)
    rows, want = [], {}
    for i in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(204)]  # 200 shingles
        edits = 4 if i % 2 else 5  # each replaces five: similarity 180 / 220 or 175 / 225
        copy = [f"e{w}" if k % 40 == 20 and k // 40 < edits else w for k, w in enumerate(words)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i if edits == 4 else 2 * i + 1}
    got = {x.id: x.component_id for x in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


def test_blocks_of_candidates(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    r = random.Random(3)
    rows = []
    for i in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randint(8, 90))]
        for c in range(4):
            rows.append((4 * i + c, " ".join(w if r.random() > 0.012 else "e" + w for w in words[: len(words) - c])))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for _, t in rows]
    to = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                low, high = sorted((to[x], to[y]))
                to = [low if v == high else v for v in to]
    got = {x.id: x.component_id for x in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == dict(enumerate(to))


def test_rows_of_one_id_keep_their_links_in_large_runs():
    fp = np.array([0, 0xFFFF, 1, 0xFFFE], np.uint64)  # node 1 twice
    a, b = simhash._reached(fp, np.zeros(4, np.uint64), np.array([1, 1, 2, 3]), 1, None)
    assert {(1, 2), (1, 3)} <= set(zip(a.tolist(), b.tolist(), strict=True))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_corners_of_stronger_edits_match():
    bits = np.zeros((2, 128), np.uint8)
    bits[1, 30:52] = 1  # 22 bits differ, none of them in the first band
    left, right = image_match._matches(np.zeros(2, np.uint32), np.array([5, 6]), np.packbits(bits, axis=1), np.full((2, image_match.NEIGHBOURS), image_match.NONE, np.uint16))
    assert (left.tolist(), right.tolist()) == ([0], [1])


def test_copies_meet_in_a_crowd_of_one_corner():
    rng = np.random.default_rng(5)
    n = 4000  # images that share a corner; the last 40 are copies of the 40 before, with four of six places left
    places = rng.integers(0, image_match.NONE, (n, image_match.NEIGHBOURS)).astype(np.uint16)
    places[-40:, :4] = places[-80:-40, :4]
    places[100:400] = places[100]  # a large group of copies
    places[0] = image_match.NONE
    bits = np.zeros((n, 16), np.uint8)
    left, right = image_match._matches(np.zeros(n, np.uint32), np.arange(n), bits, np.sort(places, axis=1))
    pairs = set(zip(left.tolist(), right.tolist(), strict=True))
    assert len(pairs) == len(left) < 3 * n
    assert {(n - 80 + i, n - 40 + i) for i in range(40)} <= pairs
    assert {(100, i) for i in range(101, 400)} <= pairs
    empty = image_match._matches(np.zeros(0, np.uint32), np.zeros(0, np.int64), bits[:0], places[:0])
    assert [len(x) for x in empty] == [0, 0]


def test_image_copies(spark):
    rng = np.random.default_rng(2)
    pictures = [image_match.scene(rng.normal(size=64)) for _ in range(40)]
    rows = [(i, image_match.write_image(p)) for i, p in enumerate(pictures)]
    rows += [(100 + i, image_match.write_image(image_match.edited(pictures[i]))) for i in range(20)]
    rows += [(200 + i, image_match.write_image(np.rot90(pictures[i]))) for i in range(10)]
    rows += [(300, rows[0][1]), (301, b""), (302, b"no image"), (303, b"P5 9 9"), (304, None), (305, image_match.write_image(np.full((80, 80), 9.0)))]
    got = {r.media_id: r for r in image_match.image_classes(spark.createDataFrame(rows, "media_id long, image binary")).collect()}
    assert len(got) == len(rows)
    assert sum(got[100 + i].class_id == i for i in range(20)) >= 18 and sum(got[200 + i].class_id == i for i in range(10)) >= 9
    assert all(got[i].class_id == i for i in range(40)) and got[300].class_id == 0
    assert all(got[i].class_id == i and got[i].n_links == 0 for i in range(301, 306))
    assert image_match.image_classes(spark.createDataFrame([], "media_id long, image binary")).collect() == []


def test_images_of_null_and_repeated_ids(spark):
    a, b, c = (image_match.write_image(image_match.scene(np.arange(64) + k)) for k in range(3))
    crop = image_match.write_image(image_match.edited(image_match.scene(np.arange(64) + 1)))
    rows = [(1, a), (1, b), (2, crop), (None, c), (None, a), (None, None), (4, c), (5, None)]
    got = image_match.image_classes(spark.createDataFrame(rows, "media_id long, image binary").withColumn("digest", F.lit("clash"))).collect()
    assert sorted((r.media_id or -1, r.class_id or -1) for r in got) == [(-1, -1), (-1, 1), (-1, 4), (1, 1), (1, 1), (2, 1), (4, 4), (5, 5)]


@pytest.mark.parametrize("edit", ["crop 0.9", "crop 0.7", "crop 0.5", "turn", "half", "paler"])
def test_recall_of_edited_copies(spark, edit):
    rng = np.random.default_rng(5)
    pictures = [image_match.scene(rng.normal(size=64), 160) for _ in range(40)]

    def changed(p):
        kind, _, much = edit.partition(" ")
        if kind == "crop":
            n = int(160 * float(much) ** 0.5)
            return p[:n, 160 - n :]
        return {"turn": np.rot90(p), "half": image_match.resized(p, 0.71), "paler": p * 0.6 + 60}[kind]

    rows = [(i, image_match.write_image(p)) for i, p in enumerate(pictures)] + [(100 + i, image_match.write_image(changed(p))) for i, p in enumerate(pictures)]
    got = {r.media_id: r.class_id for r in image_match.image_classes(spark.createDataFrame(rows, "media_id long, image binary")).collect()}
    # Brute force: all pairs of corners of the two pictures, by the descriptors alone.
    able = 0
    for p, q in zip(pictures, [changed(p) for p in pictures], strict=True):
        (a, x), (b, y) = image_match.describe(p), image_match.describe(image_match.read_image(image_match.write_image(q)))
        i, j = np.nonzero(np.bitwise_count(x[:, None].view(np.uint64) ^ y[None].view(np.uint64)).sum(axis=2) <= image_match.NEAR)
        able += image_match.consensus(a[i], b[j]) >= image_match.MATCHES
    found = sum(got[100 + i] == i for i in range(40))
    assert all(got[i] == i for i in range(40)) and found >= (0.7 if edit == "crop 0.5" else 0.9) * able and able >= 30, (found, able)


def test_group_of_image_copies_makes_few_links(spark):
    picture = image_match.scene(np.arange(64))
    rows = [(i, image_match.write_image(picture * (1 - i / 400) + i / 10)) for i in range(60)]
    df = spark.createDataFrame(rows, "media_id long, image binary")
    got = image_match.image_classes(df).collect()
    assert {r.class_id for r in got} == {0}
    assert image_match.image_links(df.select(F.col("media_id").alias("node"), "image")).count() < 10 * len(rows)


def test_no_link_is_lost_in_a_crowd(spark):
    rng = np.random.default_rng(1)

    def picture(large, small):  # oblongs, whose corners are all alike, and squares of little contrast
        out = np.full((140, 140), 60.0, np.float32)
        for y, x, h, w in large:
            out[y : y + h, x : x + w] = 190
        for y, x in small:
            out[y : y + 10, x : x + 10] += 40
        return image_match.write_image(out)

    rows = []
    for i in range(8):  # every second one has a copy, whose squares are elsewhere
        large = [(int(rng.integers(*y)), int(rng.integers(14, 80)), int(rng.integers(26, 36)), int(rng.integers(26, 45))) for y in ((14, 30), (78, 90))]
        for k in (i, 100 + i) if i % 2 else (i,):
            rows.append((k, picture(large, rng.integers(12, 118, (8, 2)).tolist())))
    pictures = {i: image_match.read_image(x) for i, x in rows}
    got = {r.media_id: r.class_id for r in image_match.image_classes(spark.createDataFrame(rows, "media_id long, image binary")).collect()}
    n_links = 0
    for m, n in itertools.combinations(sorted(pictures), 2):  # brute force: all corners of every two pictures that share a band
        (a, x), (b, y) = image_match.describe(pictures[m]), image_match.describe(pictures[n])
        near = np.bitwise_count(x[:, None].view(np.uint64) ^ y[None].view(np.uint64)).sum(axis=2) <= image_match.NEAR
        i, j = np.nonzero(near & (image_match._values(x)[:, None] == image_match._values(y)[None]).any(axis=2))
        inliers, *by = image_match.fitted(a[i], b[j])
        if inliers >= image_match.MATCHES and image_match.alikeness(pictures[m], pictures[n], *by) >= image_match.ALIKE:
            assert got[m] == got[n], (m, n)
            n_links += 1
    assert n_links >= 4


def test_png():
    import struct
    import zlib

    grey = (np.arange(12 * 10).reshape(12, 10) * 2).astype(np.uint8)
    lines = []
    for y in range(12):  # all five filters
        kind = y % 5
        line = grey[y].astype(int)
        left = np.concatenate([[0], line[:-1]])
        up = grey[y - 1].astype(int) if y else np.zeros(10, int)
        corner = np.concatenate([[0], up[:-1]])
        p = left + up - corner
        near = np.stack([abs(p - left), abs(p - up), abs(p - corner)]).argmin(axis=0)
        guess = [0 * line, left, up, (left + up) // 2, np.choose(near, [left, up, corner])][kind]
        lines.append(bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes())
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 10, 12, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (image_match.read_image(data) == grey).all()
    assert (image_match.read_image(b"P5\n# note\n10 12\n255\n" + grey.tobytes()) == grey).all()


def test_words_that_polynomials_confuse_stay(spark):
    morse = ["".join("ab"[bin(i).count("1") % 2 ^ k] for i in range(2048)) for k in (0, 1)]
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{morse[0]} {tail}"), (2, f"{morse[1]} {tail}"), (3, f"{morse[0]}\t\n{tail}")]
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_substrings_of_one_hot_id(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_CHARS", 500)
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(None if i % 2 else 7, f"own{i} {passage}") for i in range(60)]
    got = substring_dedup.dedup_substrings(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 0)] + [(False, 25)] * 29 + [(True, 25)] * 30


def test_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 9)
    monkeypatch.setattr(simhash, "BUCKET_ENTRIES", 40)
    r = random.Random(8)
    rows, words = [], [f"w{r.randrange(10**6)}" for _ in range(150)]
    for i in range(120):  # a text that drifts, so that only near ones are similar, and two breaks in it
        if i in (40, 80):
            words = [w + "x" if k % 30 == 0 else w for k, w in enumerate(words)]
        words[r.randrange(150)] = f"n{i}"
        rows.append((1000 - i, " ".join(words)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    to = [i for i, _ in rows]
    for x in range(len(rows)):
        for y in range(x):
            if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                low, high = sorted((to[x], to[y]))
                to = [low if v == high else v for v in to]
    got = {x.id: x.component_id for x in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert len(set(to)) > 1 and got == dict(zip([i for i, _ in rows], to, strict=True))


def test_candidates_of_all_bands_make_one_forest(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = [(i, " ".join(f"e{i}" if r.random() < 0.02 else w for w in words)) for i in range(300)]
    nodes = simhash.fingerprints(frame(spark, rows), shingle=5, wide=True).withColumnRenamed("id", "node")
    edges = [(x.a, x.b) for x in simhash.candidates(nodes, len(rows)).collect()]
    group = {x.node for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert 250 < len(group) and len(edges) < len(group)


@pytest.mark.parametrize("n", [10_000, 10_000_000, 10**10])
def test_recall_of_bands(n):
    r = np.random.default_rng(n % 97)
    bands = simhash.plan_bands(n)
    assert simhash.band_recall(bands.shape[1], len(bands)) >= 0.95
    hit = {0.8: 0, 0.9: 0}
    for s in hit:
        for _ in range(200):
            size = int(r.integers(40, 400))
            both = round(2 * size * s / (1 + s))
            h = r.integers(0, 2**63, 2 * size - both, dtype=np.int64).view(np.uint64)
            a, b = (np.unpackbits(simhash.wide_fingerprint(x).view(np.uint8), bitorder="little") for x in (h[:size], h[size - both :]))
            near = np.bitwise_count(simhash.wide_fingerprint(h[:size])[:2] ^ simhash.wide_fingerprint(h[size - both :])[:2])
            hit[s] += (a[bands] == b[bands]).all(axis=1).any() and near[0] <= simhash.WIDE_64 and near.sum() <= simhash.WIDE_128
    assert hit[0.8] >= 0.9 * 200 and hit[0.9] >= 0.99 * 200


def test_numbered_ranks_like_unique():
    r = np.random.default_rng(3)
    for n, top in ((1, 5), (2, 1), (1000, 50), (5000, 2**63)):
        values = r.integers(0, top, n).astype(np.uint64)
        assert np.array_equal(simhash._numbered(values), np.unique(values, return_inverse=True)[1])
