"""Edited and cropped copies of images by local descriptors.

Each image gives corners at several scales; each corner an orientation (of its intensity centroid) and 128
binary tests, rotated to it. Descriptors meet in Hamming tables: six bands of 21 bits, one equi-join key
each, so that descriptors of up to five differing bits share a band for certain. Entries that share a band and
differ in few bits match. Where ``ALL_PAIRS`` entries or fewer share a band, all pairs are compared. Larger
clusters, such as plain corners make, are split by the places of eight corners close by, as each corner sees them:
entries that agree in any two of them are compared in all pairs if so few agree, else those that agree in any
four. Images that agree in a corner and four more have what a link asks for, so in crowds of them each is matched
to the first and to its predecessor only: a group of n copies makes some n matches, not n squared. The same trees
run over the whole of a large cluster, for corners whose surroundings changed.
Image pairs with enough matches are verified: a similarity transform must explain them (geometric
consensus). Verified links make classes.

That is all there is for images whose corners all lie in small clusters. The others, which have a corner in a crowd,
are then compared each with each, by blocks of images, unless they already share a class: all matches of a pair that
share a band, whatever their cluster. Most pairs fall by what a link implies (see ``_may_link``), the rest are
verified. Corners of crowds agree by chance, too, so the grey values of such a pair must correlate where they overlap.
So no link between classes is lost to a crowd; the price grows with the square of the images in crowds.

Images of equal bytes form one class beforehand, and only its smallest id is described and matched.

The strongest ``CORNERS`` corners of each scale describe an image; that is the descriptor's definition, and
no cap on what matches. Links are found by chance beyond the bands' guarantee; tests measure the recall.

Entries meet in buckets of a bounded number, whatever the number of images.

Defined cases: null, empty or unreadable images have no corners and are their own class (equal bytes are one
class, nulls aren't equal); rows of one id are described each and share a class; rows of a null id stay, with the
class of equal bytes, else null; images of any size are read whole; no column but the id and the image is looked
at, so clashing names don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.tokens import mix
from tessera.session import cut

SCALES = (1.0, 0.71, 0.5)
CORNERS = (14, 10, 6)
MARGIN = 11
BITS, BANDS, BAND_BITS = 128, 6, 21
NEAR = 22
MATCHES = 5
ALL_PAIRS = 6
#: Corners close by whose places an entry carries, and the value of a place that is missing.
NEIGHBOURS, NONE = 8, 65535
ABSENT = 2**32 - 1
#: Entries, and matches, to a bucket.
BUCKET_ENTRIES = 500_000
IMAGES_AT_ONCE = 1000
PAIRS_AT_ONCE = 1_000_000
#: Images of crowds: to a group that meets another in one task, groups at least (of so many images), and to a block.
GROUP_IMAGES, GROUPS, FEW = 8192, 6, 200
BLOCK_IMAGES = (128, 1024)
#: Distances in pixels of a proposal and of a fit.
TOLERANCE, CLOSE = 4.0, 1.5
#: Grey values compared each way where pictures overlap.
SAMPLES, ALIKE = 64, 0.8
#: Radians between a match's turn and its fit's.
TURN = 0.35
#: Corners of one cell of so many pixels, as one corner gives at several scales, count once.
PLACE = 8
#: What a match needs to know of a corner: place in the full image, scale, angle (1/1000 radian).
POINT = np.dtype([("x", "<i2"), ("y", "<i2"), ("scale", "<i2"), ("angle", "<i2")])

_rng = np.random.default_rng(20)
_TESTS = np.clip(_rng.normal(0, 3.4, (BITS, 4)), -8, 8)
_disc = [(dy, dx) for dy in range(-7, 8) for dx in range(-7, 8) if dy * dy + dx * dx <= 49]
_DY, _DX = np.array([d[0] for d in _disc]), np.array([d[1] for d in _disc])


def read_image(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM, or of an 8-bit PNG without interlacing; None if unreadable."""
    try:
        if data and data[:2] in (b"P5", b"P6"):
            header = re.match(rb"P[56]" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 3 + rb"\s", data)
            if not header:
                return None
            w, h = int(header[1]), int(header[2])
            n = 1 if data[:2] == b"P5" else 3
            return np.frombuffer(data, np.uint8, w * h * n, header.end()).reshape(h, w, n).mean(axis=2, dtype=np.float32)
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _read_png(data)
    except (ValueError, IndexError, KeyError, struct.error, zlib.error):
        return None
    return None


def _read_png(data: bytes) -> np.ndarray:
    at, packed, w = 8, [], 0
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlaced:
                raise ValueError("only 8-bit PNGs without interlacing")
            n_channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * n_channels)
    out = np.zeros((h, w * n_channels), np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        above = out[y - 1].astype(np.int32) if y else np.zeros(w * n_channels, np.int32)
        if kind in (0, 2):
            out[y] = (line + (above if kind else 0)) & 255
            continue
        for x in range(w * n_channels):
            left = int(out[y, x - n_channels]) if x >= n_channels else 0
            corner = int(above[x - n_channels]) if x >= n_channels else 0
            up = int(above[x])
            if kind == 4:
                p = left + up - corner
                guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            else:
                guess = left if kind == 1 else (left + up) // 2
            out[y, x] = (line[x] + guess) & 255
    pixels = out.reshape(h, w, n_channels)
    return pixels[:, :, : 1 if n_channels < 3 else 3].mean(axis=2, dtype=np.float32)


def write_image(grey: np.ndarray) -> bytes:
    h, w = grey.shape
    return b"P5 %d %d 255\n" % (w, h) + np.clip(grey, 0, 255).astype(np.uint8).tobytes()


def _smooth(a: np.ndarray) -> np.ndarray:
    a = np.pad(a, 1, mode="edge")
    a = (a[:-2] + 2 * a[1:-1] + a[2:]) / 4
    return (a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:]) / 4


def resized(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return a
    h, w = max(1, round(a.shape[0] * scale)), max(1, round(a.shape[1] * scale))
    y, x = np.clip((np.arange(h) + 0.5) / scale - 0.5, 0, a.shape[0] - 1), np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, a.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    return (a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx) * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


def describe(image: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Points and their descriptors (16 bytes each), of at most ``CORNERS`` corners at each scale."""
    points, bits = [], []
    for scale, most in zip(SCALES, CORNERS, strict=True):
        if image is None:
            break
        a = _smooth(resized(image, scale).astype(np.float32)) if scale != 1.0 else _smooth(image.astype(np.float32))
        h, w = a.shape
        if min(h, w) < 2 * MARGIN + 3:
            continue
        gy, gx = np.zeros_like(a), np.zeros_like(a)
        gy[1:-1], gx[:, 1:-1] = a[2:] - a[:-2], a[:, 2:] - a[:, :-2]
        xx, yy, xy = _smooth(_smooth(gx * gx)), _smooth(_smooth(gy * gy)), _smooth(_smooth(gx * gy))
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        centre = r[MARGIN:-MARGIN, MARGIN:-MARGIN]
        top = centre > 1.0
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    top &= centre >= r[MARGIN + dy : h - MARGIN + dy, MARGIN + dx : w - MARGIN + dx]
        y, x = np.nonzero(top)
        best = np.argsort(-centre[y, x], kind="stable")[:most]
        y, x = y[best] + MARGIN, x[best] + MARGIN
        if not len(y):
            continue
        patch = a[y[:, None] + _DY, x[:, None] + _DX]
        angle = np.arctan2((patch * _DY).sum(axis=1), (patch * _DX).sum(axis=1))
        c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
        value = []
        for k in (0, 2):
            tx, ty = _TESTS[:, k], _TESTS[:, k + 1]
            px, py = np.clip(np.rint(c * tx - s * ty), -MARGIN, MARGIN).astype(int), np.clip(np.rint(s * tx + c * ty), -MARGIN, MARGIN).astype(int)
            value.append(a[np.clip(y[:, None] + py, 0, h - 1), np.clip(x[:, None] + px, 0, w - 1)])
        bits.append(np.packbits(value[0] < value[1], axis=1))
        p = np.zeros(len(y), POINT)
        p["x"], p["y"], p["scale"], p["angle"] = np.rint(x / scale), np.rint(y / scale), round(1000 / scale), np.rint(angle * 1000)
        points.append(p)
    if not points:
        return np.zeros(0, POINT), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(points), np.concatenate(bits)


def consensus(a: np.ndarray, b: np.ndarray) -> int:
    """Most matches that one similarity transform explains."""
    return fitted(a, b)[0]


def fitted(a: np.ndarray, b: np.ndarray) -> tuple[int, complex, complex]:
    """Most matches that one similarity transform explains, and its factor and offset in complex numbers.

    Each match proposes a transform by its corners' scales and angles; what that explains roughly is fitted by
    least squares, twice, and what the fit explains closely counts, each place once.
    """
    p, q = a["x"] + 1j * a["y"].astype(np.float64), b["x"] + 1j * b["y"].astype(np.float64)
    turn = (b["angle"].astype(np.float64) - a["angle"]) / 1000
    size = b["scale"] / a["scale"].astype(np.float64)
    by = np.exp(1j * turn) * size
    rough = (np.abs(by[:, None] * (p[None, :] - p[:, None]) + q[:, None] - q[None, :]) <= TOLERANCE * np.maximum(1.0, size)[:, None]) & (np.abs(np.angle(np.exp(1j * (turn[None, :] - turn[:, None])))) < 0.5)
    best, by_best = 0, (0j, 0j)
    for good in np.unique(rough, axis=0):
        if good.sum() <= best:
            continue
        factor = offset = 0j
        for _ in range(2):
            u, v = p[good], q[good]
            if len(np.unique(u)) < 2 or len(np.unique(v)) < 2:
                good = np.zeros(len(p), bool)
                break
            du, dv = u - u.mean(), v - v.mean()
            factor = (np.conj(du) * dv).sum() / (np.abs(du) ** 2).sum()
            offset = v.mean() - factor * u.mean()
            good = np.abs(factor * (p - u.mean()) + v.mean() - q) <= CLOSE * max(1.0, abs(factor))
            good &= np.abs(np.angle(np.exp(1j * turn) / factor)) < TURN if factor else False
        places = min(len(np.unique(np.round(p[good] / PLACE))), len(np.unique(np.round(q[good] / PLACE))))
        if places > best:
            best, by_best = places, (complex(factor), complex(offset))
    return best, *by_best


def alikeness(a: np.ndarray, b: np.ndarray, factor: complex, offset: complex) -> float:
    """Correlation of two pictures' grey values where a transform lays one on the other; 0 if nowhere."""
    a, b = _smooth(_smooth(a)), _smooth(_smooth(b))
    if abs(factor) < 1 and factor:
        a, b, factor, offset = b, a, 1 / factor, -offset / factor
    corners = (np.array([0, b.shape[1] - 1, 0, b.shape[1] - 1]) + 1j * np.array([0, 0, b.shape[0] - 1, b.shape[0] - 1]) - offset) / factor if factor else np.zeros(4, complex)
    x, y = (np.unique(np.rint(np.linspace(max(0, c.min()), min(n - 1, c.max()), SAMPLES)).astype(int)) for c, n in ((corners.real, a.shape[1]), (corners.imag, a.shape[0])))
    x, y = x[(x >= 0) & (x < a.shape[1])], y[(y >= 0) & (y < a.shape[0])]
    q = factor * (x[None, :] + 1j * y[:, None]) + offset
    qx, qy = np.rint(q.real).astype(int), np.rint(q.imag).astype(int)
    inside = (qx >= 0) & (qx < b.shape[1]) & (qy >= 0) & (qy < b.shape[0])
    u, v = a[y][:, x][inside].astype(np.float64), b[qy[inside], qx[inside]].astype(np.float64)
    if not len(u) or not u.std() or not v.std():
        return 0.0
    return float(((u - u.mean()) * (v - v.mean())).mean() / (u.std() * v.std()))


def _signatures(points: np.ndarray) -> np.ndarray:
    """For each corner of an image the places of those nearest to it, as it sees them, in ascending order.

    A place is the direction, distance, turn and scale of the other corner, relative to this one's, in steps;
    ``NONE`` where there are too few corners.
    """
    n = len(points)
    out = np.full((n, NEIGHBOURS), NONE, np.uint16)
    x, y, scale, angle = (points[c].astype(np.float64) for c in ("x", "y", "scale", "angle"))
    dx, dy = x[None, :] - x[:, None], y[None, :] - y[:, None]
    d = np.hypot(dx, dy)
    d[d <= 3] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :NEIGHBOURS]
    at = np.arange(n)[:, None]
    far = d[at, order]
    found = np.isfinite(far)
    far[~found] = 1
    turn = angle / 1000
    step = lambda r, steps: np.rint(r / (2 * np.pi) * steps).astype(np.int64) % steps
    place = step(np.arctan2(dy[at, order], dx[at, order]) - turn[:, None], 32)
    place = place * 64 + np.clip(np.rint(np.log(far * 1000 / scale[:, None]) / np.log(1.25)), 0, 63).astype(np.int64)
    place = place * 16 + step(turn[order] - turn[:, None], 16)
    place = place * 64 + np.rint(np.log2(scale[order] / scale[:, None]) * 2).astype(np.int64) + 32
    out[:, : order.shape[1]] = np.where(found, mix(place.astype(np.uint64)) % np.uint64(NONE), NONE)
    return np.sort(out, axis=1)


def _subsets(cluster: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each row's cluster with every k of its places, ``ABSENT`` where it has fewer."""
    chosen = list(combinations(range(places.shape[1]), k))
    out = np.empty((len(cluster), len(chosen)), np.uint32)
    cluster = mix(cluster.astype(np.uint64))
    for n, columns in enumerate(chosen):
        key = cluster
        for c in columns:
            key = mix(key ^ places[:, c].astype(np.uint64))
        out[:, n] = np.where(places[:, columns[-1]] == NONE, ABSENT, key % np.uint64(ABSENT))
    return out


def _split(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order, pairs of equal keys in runs of ``ALL_PAIRS`` or fewer, and the keys and rows of larger runs."""
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[: len(key)]
    size = np.diff(np.append(begin, len(key)))
    small = np.repeat(size <= ALL_PAIRS, size)
    k, r = key[small], row[small]
    same = [k[d:] == k[:-d] for d in range(1, ALL_PAIRS)]
    a = np.concatenate([r[:-d][x] for d, x in enumerate(same, 1)])
    b = np.concatenate([r[d:][x] for d, x in enumerate(same, 1)])
    return a, b, key[~small], row[~small]


def _trees(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of equal keys, which stand together, each with the first and with its predecessor."""
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    first = np.repeat(row[new], np.diff(np.append(np.flatnonzero(new), len(key))))
    later = np.flatnonzero(~new)
    return np.concatenate([first[later], row[later - 1]]), np.concatenate([row[later], row[later]])


def _matches(band: np.ndarray, image: np.ndarray, bits: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries of equal band values and different images that differ in few bits; see above for large clusters."""
    order = np.lexsort((image, band))
    band, image, places = band[order], image[order], places[order]
    words = bits[order].view(np.uint64).reshape(-1, BITS // 64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        for s in range(0, len(a), PAIRS_AT_ONCE):
            i, j = a[s : s + PAIRS_AT_ONCE], b[s : s + PAIRS_AT_ONCE]
            good = (image[i] != image[j]) & (np.bitwise_count(words[i] ^ words[j]).sum(axis=1) <= NEAR)
            left.append(i[good])
            right.append(j[good])

    a, b, _, crowd = _split(band, np.arange(len(band)))
    keep(a, b)
    keep(*_trees(band[crowd], crowd))
    for agree, last in ((2, False), (4, True)):
        again = []
        keys = _subsets(band[crowd], places[crowd], agree)
        passes = keys.size // PAIRS_AT_ONCE + 1
        for n in range(passes):
            i, j = np.nonzero((keys % np.uint32(passes) == n) & (keys != ABSENT))
            a, b, key, row = _split(keys[i, j], crowd[i])
            keep(a, b)
            if last:
                keep(*_trees(key, row))
            again.append(row)
        crowd = np.unique(np.concatenate(again))
    pairs = np.unique(np.concatenate(left) * len(order) + np.concatenate(right))
    return order[pairs // max(1, len(order))], order[pairs % max(1, len(order))]


def _values(bits: np.ndarray) -> np.ndarray:
    """Values of each descriptor's bands."""
    wide = np.unpackbits(bits, axis=1)[:, : BANDS * BAND_BITS].reshape(len(bits), BANDS, BAND_BITS).astype(np.uint32)
    return (wide << np.arange(BAND_BITS, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)


def _cells(number: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Of each corner one bit, that of its cell of ``PLACE`` pixels among its image's; rows of an image stand together."""
    cell = np.rint(points["x"] / PLACE).astype(np.int64) << 32 | np.rint(points["y"] / PLACE).astype(np.int64) & 0xFFFFFFFF
    order = np.lexsort((cell, number))
    fresh = np.concatenate([[True], number[order][1:] != number[order][:-1]])[: len(order)]
    new = np.cumsum(fresh | np.concatenate([[True], cell[order][1:] != cell[order][:-1]])[: len(order)])
    out = np.empty(len(order), np.uint32)
    out[order] = np.uint32(1) << (new - np.repeat(new[fresh], np.diff(np.append(np.flatnonzero(fresh), len(order))))).astype(np.uint32)
    return out


class Images:
    """Images in order, with their corners."""

    def __init__(self, nodes: np.ndarray, classes: np.ndarray, counts: np.ndarray, points: np.ndarray, bits: np.ndarray):
        self.nodes, self.classes, self.counts, self.points, self.bits = nodes, classes, counts, points, bits
        self.number = np.repeat(np.arange(len(nodes)), counts)
        self.values, self.cells = _values(bits), _cells(self.number, points)
        self.words = bits.reshape(-1, BITS // 8).view(np.uint64)
        self.begin = np.concatenate([[0], np.cumsum(counts)])


def _runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])


def _partners(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of one run, for runs of these sizes."""
    after = np.repeat(np.cumsum(size), size) - np.arange(size.sum()) - 1
    k = np.repeat(np.arange(len(after)), after)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(after) - after, after) + k + 1


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Radians between two directions."""
    d = a - b
    return np.abs(d - np.rint(d / (2 * np.pi)) * (2 * np.pi))


def _places(cells: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether runs of matches are of ``MATCHES`` cells or more; cells is one row for each of the two images."""
    return (np.bitwise_count(np.bitwise_or.reduceat(cells, begin, axis=1)) >= MATCHES).all(axis=0) if len(begin) else np.zeros(0, bool)


def _may_link(group: np.ndarray, p: np.ndarray, q: np.ndarray, turn: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Of image pairs, in runs of group, those that ``consensus`` may link by these matches; never drops one that it links.

    If a transform of factor f and offset t explains a set of matches, each errs by CLOSE * max(1, |f|) at most and
    turns by f's angle give or take TURN. So for any two of the set f takes p[l] - p[k] to q[l] - q[k] with at most
    twice that error, which bounds the angle between them; each match has partners, itself included, in ``MATCHES``
    cells of both images. The two farthest apart of the set give f, and so the places of all the others, with an error
    of four times CLOSE * max(1, |f|); as ``MATCHES`` cells span three in a row, they are ``PLACE`` apart at least.
    """
    begin = _runs(group)
    size = np.diff(np.append(begin, len(group)))
    k, l = _partners(size)  # noqa: E741
    good = _apart(turn[k], turn[l]) < 2 * TURN + 0.001
    k, l = k[good], l[good]  # noqa: E741
    u, v = p[l] - p[k], q[l] - q[k]
    short = np.minimum(np.abs(u), np.abs(v))
    slack = np.where(short > 2 * CLOSE, np.arcsin(2 * CLOSE / np.maximum(short, 2 * CLOSE)), 4.0) + TURN + 0.001
    along = np.angle(v * np.conj(u))
    good = (_apart(along, turn[k]) < slack) & (_apart(along, turn[l]) < slack)
    k, l = k[good], l[good]  # noqa: E741
    alive = np.zeros(len(group), bool)
    while len(k):
        first, second = np.concatenate([k, l]), np.concatenate([l, k])
        order = np.argsort(first, kind="stable")
        first, second = first[order], second[order]
        at = _runs(first)
        own = first[at]
        alive[:] = False
        alive[own] = (np.bitwise_count(np.bitwise_or.reduceat(cells[:, second], at, axis=1) | cells[:, own]) >= MATCHES).all(axis=0)
        good = alive[k] & alive[l]
        if good.all():
            break
        k, l = k[good], l[good]  # noqa: E741
    if not len(k):
        return np.zeros(0, group.dtype)
    # Runs of very many matches aren't worth the test of all their threes; they are verified at once.
    many = size > 100
    out = [np.unique(group[begin[many]][np.isin(group[begin[many]], group[alive])])]
    run = np.repeat(np.arange(len(size)), size)
    good = ~many[run[k]] & (np.abs(p[l] - p[k]) >= PLACE)
    k, l = k[good], l[good]  # noqa: E741
    part = np.cumsum(size[run[k]]) // PAIRS_AT_ONCE
    for n in range(int(part[-1]) + 1 if len(k) else 0):
        a, b = k[part == n], l[part == n]
        u = p[b] - p[a]
        far, factor = np.abs(u), (q[b] - q[a]) / u
        error = 4 * CLOSE * np.maximum(1.0, np.abs(factor) / (1 - 2 * CLOSE / far)) + 0.01
        many_of = size[run[a]]
        t = np.repeat(np.arange(len(a)), many_of)
        m = np.arange(len(t)) - np.repeat(np.cumsum(many_of) - many_of - begin[run[a]], many_of)
        good = alive[m] & (np.abs(q[m] - q[a[t]] - factor[t] * (p[m] - p[a[t]])) <= error[t])
        t, m = t[good], m[good]
        good = (np.maximum(np.abs(p[m] - p[a[t]]), np.abs(p[m] - p[b[t]])) <= far[t] + 0.001) & (np.maximum(_apart(turn[m], turn[a[t]]), _apart(turn[m], turn[b[t]])) < 2 * TURN + 0.001)
        t, m = t[good], m[good]
        at = _runs(t)
        out.append(group[a[t[at][_places(cells[:, m], at)]]])
    return np.unique(np.concatenate(out))


def _block_links(x: Images, y: Images, xs: slice, ys: slice) -> list[tuple]:
    """Proposed links between images of two ranges: smaller node, larger node, inliers, factor and offset of the fit."""
    n_x, n_y = xs.stop - xs.start, ys.stop - ys.start
    if not n_x or not n_y or (x is y and xs.start >= ys.stop):
        return []
    xa, ya, xb, yb = x.begin[xs.start], y.begin[ys.start], x.begin[xs.stop], y.begin[ys.stop]
    bands, total = [], 0
    for b in range(BANDS):
        left, right = np.argsort(x.values[xa:xb, b], kind="stable"), np.argsort(y.values[ya:yb, b], kind="stable")
        value, found = x.values[xa:xb, b][left], y.values[ya:yb, b][right]
        low = np.searchsorted(found, value)
        size = np.searchsorted(found, value, "right") - low
        bands.append((left[size > 0], right, low[size > 0], size[size > 0]))
        total += int(size.sum())
    if total > 6 * PAIRS_AT_ONCE and n_x * n_y > 1:
        halves = lambda r: (slice(r.start, (r.start + r.stop) // 2), slice((r.start + r.stop) // 2, r.stop))
        parts = [(h, ys) for h in halves(xs)] if n_x >= n_y else [(xs, h) for h in halves(ys)]
        return [link for p, q in parts for link in _block_links(x, y, p, q)]
    # A match is one number: the image pair, then its corner in x, then that in y.
    corner, other = max(1, int(xb - xa - 1).bit_length()), max(1, int(yb - ya - 1).bit_length())
    low_bits = corner + other
    of_x = ((x.number[xa:xb] - xs.start) * n_y << low_bits) + (np.arange(xb - xa) << other)
    of_y = (y.number[ya:yb] - ys.start << low_bits) + np.arange(yb - ya)
    matches = [np.zeros(0, np.int64)]
    for left, right, low, size in bands:
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - low, size)
        wx, wy = x.words[xa:xb][left], y.words[ya:yb][right]
        differ = sum(np.bitwise_count(np.repeat(wx[:, w], size) ^ np.ascontiguousarray(wy[:, w])[at]) for w in range(BITS // 64))
        good = np.flatnonzero(differ <= NEAR)
        matches.append(np.repeat(of_x[left], size)[good] + of_y[right][at[good]])
    matches = np.concatenate(matches)
    matches.sort()
    matches = matches[_runs(matches)]
    pair = matches >> low_bits
    a, b = np.divmod(np.arange(n_x * n_y), n_y)
    wanted = (np.bincount(pair, minlength=n_x * n_y) >= MATCHES) & (x.classes[xs][a] != y.classes[ys][b]) & (x.nodes[xs][a] != y.nodes[ys][b])
    if x is y:
        wanted &= a + xs.start < b + ys.start
    matches = matches[wanted[pair]]
    i, j = xa + (matches >> other & (1 << corner) - 1), ya + (matches & (1 << other) - 1)
    # A link's turns differ by less than twice TURN, so they lie in two neighbours of eight steps of the circle.
    turn = (y.points["angle"][j] - x.points["angle"][i].astype(np.float32)) / np.float32(1000)
    key = (matches >> low_bits) * 8 + (np.rint(turn * np.float32(8 / (2 * np.pi))).astype(np.int64) & 7)
    order = np.argsort(key, kind="stable")
    key, i, j, turn = key[order], i[order], j[order], turn[order]
    begin = _runs(key)
    ok = np.ones((n_x * n_y, 8), bool)
    for cells in (x.cells[i], y.cells[j]):
        step = np.zeros(n_x * n_y * 8, np.uint32)
        step[key[begin]] = np.bitwise_or.reduceat(cells, begin) if len(begin) else 0
        step = step.reshape(-1, 8)
        ok &= np.bitwise_count(step | np.roll(step, -1, axis=1)) >= MATCHES
    stays = (ok | np.roll(ok, 1, axis=1)).ravel()[key]
    group, i, j, turn = key[stays] >> 3, i[stays], j[stays], turn[stays]
    turned = x.nodes[xs][group // n_y] > y.nodes[ys][group % n_y]
    at = lambda points, rows: points["x"][rows] + 1j * points["y"][rows].astype(np.float64)
    p, q, cells = at(x.points, i), at(y.points, j), np.stack([x.cells[i], y.cells[j]])
    p, q, cells, turn = np.where(turned, q, p), np.where(turned, p, q), np.where(turned, cells[::-1], cells), np.where(turned, -turn, turn)
    size = np.diff(np.append(_runs(group), len(group)))
    part = np.repeat(np.cumsum(size * size) // PAIRS_AT_ONCE, size)
    edges = np.append(_runs(part), len(part))
    left = [_may_link(group[s], p[s], q[s], turn[s], cells[:, s]) for s in (slice(*e) for e in zip(edges[:-1], edges[1:], strict=True))]
    links, pair = [], matches >> low_bits
    for n in np.concatenate([np.zeros(0, np.int64), *left]).tolist():
        a, b = xs.start + n // n_y, ys.start + n % n_y
        own = matches[np.searchsorted(pair, n) : np.searchsorted(pair, n, "right")]
        sides = [(x.nodes[a], x.points[xa + (own >> other & (1 << corner) - 1)]), (y.nodes[b], y.points[ya + (own & (1 << other) - 1)])]
        (first, u), (second, v) = sorted(sides, key=lambda s: s[0])
        inliers, factor, offset = fitted(u, v)
        if inliers >= MATCHES:
            links.append((int(first), int(second), inliers, factor.real, factor.imag, offset.real, offset.imag))
    return links


def _crowd_links(images: DataFrame, n_images: int) -> DataFrame:
    """Proposed links between classes of (node, class, points, bits), by comparing every two images."""
    n = max(n_images // GROUP_IMAGES + 1, min(GROUPS, n_images // FEW + 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch["node"].to_numpy(zero_copy_only=False)
            group = (mix(node.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)
            for g in np.unique(group).tolist():
                own = batch.take(pa.array(np.flatnonzero(group == g)))
                points, bits = own["points"].to_pylist(), own["bits"].to_pylist()
                of = [own["node"].to_numpy().tobytes(), own["class"].to_numpy().tobytes(), np.array([len(x) // POINT.itemsize for x in points], np.int64).tobytes(), b"".join(points), b"".join(bits)]
                rows = [(min(g, h) * n + max(g, h), g) for h in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([x] * n, pa.binary()) for x in of)], names=["task", "side", "nodes", "classes", "counts", "points", "bits"])

    def compare(table: pa.Table) -> pa.Table:
        side = np.array(table["side"].to_pylist())
        sides = []
        for g in np.unique(side):
            own = table.take(np.flatnonzero(side == g))
            read = lambda name, kind: np.frombuffer(b"".join(own[name].to_pylist()), kind)  # noqa: E731, B023
            sides.append(Images(read("nodes", np.int64), read("classes", np.int64), read("counts", np.int64), read("points", POINT), read("bits", np.uint8).reshape(-1, BITS // 8)))
        task = table["task"][0].as_py()
        x, y = (sides[0], sides[-1])
        links = []
        if len(sides) == 2 or task // n == task % n:
            for s in range(0, len(x.nodes), BLOCK_IMAGES[0]):
                for t in range(0, len(y.nodes), BLOCK_IMAGES[1]):
                    links += _block_links(x, y, slice(s, min(s + BLOCK_IMAGES[0], len(x.nodes))), slice(t, min(t + BLOCK_IMAGES[1], len(y.nodes))))
        columns = list(zip(*links, strict=True)) or [()] * 7
        return pa.table({c: pa.array(list(v), pa.int64() if n < 3 else pa.float64()) for n, (c, v) in enumerate(zip(("a", "b", "inliers", "fx", "fy", "tx", "ty"), columns, strict=True))})

    dealt = images.mapInArrow(deal, "task long, side long, nodes binary, classes binary, counts binary, points binary, bits binary")
    return dealt.repartition(2 * n * (n + 1), "task").groupBy("task").applyInArrow(compare, "a long, b long, inliers long, fx double, fy double, tx double, ty double")


def _alike(links: DataFrame, images: DataFrame) -> DataFrame:
    """(a, b, inliers) of proposed links whose pictures agree where they overlap."""
    links = cut(links)
    wanted = links.select(F.explode(F.array("a", "b")).alias("wanted")).distinct()
    pictures = cut(images.join(wanted, F.col("node") == F.col("wanted")).select("node", "image"))
    one, other = (pictures.select(F.col("node").alias(f"{c}_node"), F.col("image").alias(f"{c}_image")) for c in "ab")
    both = links.join(one, F.col("a") == F.col("a_node")).join(other, F.col("b") == F.col("b_node")).select("a", "b", "inliers", "fx", "fy", "tx", "ty", "a_image", "b_image")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = []
            for n in range(batch.num_rows):
                fx, fy, tx, ty, u, v = (batch.column(c)[n].as_py() for c in range(3, 9))
                u, v = read_image(u), read_image(v)
                stays.append(u is not None and v is not None and alikeness(u, v, complex(fx, fy), complex(tx, ty)) >= ALIKE)
            yield batch.select(["a", "b", "inliers"]).filter(pa.array(stays, pa.bool_()))

    return both.mapInArrow(compare, "a long, b long, inliers long").distinct()


def image_links(images: DataFrame) -> DataFrame:
    """(a, b, inliers) of (node, image): verified links that connect all images of a class, some of each image to smaller ids."""

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [describe(read_image(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k].tobytes() for x in found], pa.binary()) for k in range(2))], names=["node", "points", "bits"])

    described = cut(images.select("node", "image").mapInArrow(corners, "node long, points binary, bits binary").where("length(points) > 0"))
    entries = described.count() * sum(CORNERS) * BANDS
    width = max(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries // BUCKET_ENTRIES + 1)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, IMAGES_AT_ONCE) for whole in batches for a in range(0, whole.num_rows, IMAGES_AT_ONCE)):
            ids = batch.column(0).to_numpy()
            found = [np.frombuffer(x, POINT) for x in batch.column(1).to_pylist()]
            number = np.repeat(np.arange(len(found)), [len(p) for p in found])
            points, bits = np.concatenate(found), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, BITS // 8)
            values = _values(bits).astype(np.uint64)
            places = np.concatenate([_signatures(p) for p in found])
            # A bucket compares 32 bits of a band's hash; two that agree in them by chance only cost comparisons.
            keys = mix(values | np.arange(BANDS, dtype=np.uint64) << np.uint64(BAND_BITS))
            per = keys.shape[1]
            keys = keys.ravel()
            bucket = (mix(keys) % np.uint64(width)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(width + 1))
            full = [j for j in range(width) if edges[j] < edges[j + 1]]
            row = order // per
            cell = lambda x: pa.array([x[edges[j] : edges[j + 1]].tobytes() for j in full], pa.binary())  # noqa: E731, B023
            own = [np.unique(number[row[edges[j] : edges[j + 1]]], return_counts=True) for j in full]
            named, many = pa.array([ids[n].tobytes() for n, _ in own], pa.binary()), pa.array([c.astype(np.uint16).tobytes() for _, c in own], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), cell((keys[order] >> np.uint64(32) ^ keys[order]).astype(np.uint32)), named, many, cell(points[row]), cell(places[row]), cell(bits[row])], names=["bucket", "keys", "nodes", "counts", "points", "places", "bits"])

    def meet(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        image, packed = np.repeat(read("nodes", np.int64), read("counts", np.uint16)), read("points", np.int64)
        keys = read("keys", np.uint32)
        _, at, size = np.unique(keys, return_inverse=True, return_counts=True)
        crowd = np.unique(image[size[at] > ALL_PAIRS])
        i, j = _matches(keys, image, read("bits", np.uint8).reshape(-1, BITS // 8), read("places", np.uint16).reshape(-1, NEIGHBOURS))
        rows = np.stack([image[i], image[j], packed[i], packed[j]], axis=1)
        part = (mix(mix(rows[:, 0].astype(np.uint64)) ^ rows[:, 1].astype(np.uint64)) % np.uint64(width)).astype(np.int64)
        order = np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0], part))
        new = np.ones(len(order), bool)
        new[1:] = (rows[order][1:] != rows[order][:-1]).any(axis=1)
        order = order[new]
        edges = np.searchsorted(part[order], np.arange(width + 1))
        whose = (mix(crowd.astype(np.uint64)) % np.uint64(width)).astype(np.int64)
        crowd, whose = crowd[np.argsort(whose, kind="stable")], np.sort(whose)
        ends = np.searchsorted(whose, np.arange(width + 1))
        full = [k for k in range(width) if edges[k] < edges[k + 1] or ends[k] < ends[k + 1]]
        cell = lambda x, e: pa.array([x[e[k] : e[k + 1]].tobytes() for k in full], pa.binary())
        return pa.table({"part": pa.array(full, pa.int32()), "matches": cell(rows[order], edges), "crowd": cell(crowd, ends)})

    def verify(table: pa.Table) -> pa.Table:
        rows = np.unique(np.frombuffer(b"".join(table["matches"].to_pylist()), np.int64).reshape(-1, 4), axis=0)
        a, b = rows[:, 0], rows[:, 1]
        p, q = (np.ascontiguousarray(rows[:, c]).view(POINT) for c in (2, 3))
        begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        size = np.diff(np.append(begin, len(a)))
        found = []
        for s, n in zip(begin[size >= MATCHES], size[size >= MATCHES], strict=True):
            inliers = consensus(p[s : s + n], q[s : s + n])
            if inliers >= MATCHES:
                found.append((a[s], b[s], inliers))
        # Images of crowds are passed on as links to nothing.
        found += [(i, None, 0) for i in np.unique(np.frombuffer(b"".join(table["crowd"].to_pylist()), np.int64)).tolist()]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(("a", "b", "inliers"), columns, strict=True)})

    entries = described.mapInArrow(enter, "bucket int, keys binary, nodes binary, counts binary, points binary, places binary, bits binary")
    matches = entries.groupBy("bucket").applyInArrow(meet, "part int, matches binary, crowd binary")
    found = cut(matches.groupBy("part").applyInArrow(verify, "a long, b long, inliers long"))
    links, crowd = found.where("b IS NOT NULL"), found.where("b IS NULL").select(F.col("a").alias("crowded"))
    n_images = crowd.count()
    if not n_images:
        return links
    classes = components(links.select("a", "b")).select(F.col("node").alias("member"), "component")
    rest = described.join(crowd, F.col("node") == F.col("crowded")).join(classes, F.col("node") == F.col("member"), "left")
    rest = rest.select("node", F.coalesce("component", "node").alias("class"), "points", "bits")
    return links.unionByName(_alike(_crowd_links(rest, n_images), images))


def image_classes(images: DataFrame, *, id_col: str = "media_id", image_col: str = "image") -> DataFrame:
    """(id, class_id, n_links): class_id is the smallest id of the copies; n_links counts the verified links kept of its bytes, which connect its class."""
    rows = images.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).alias("image"), F.sha2(F.col(image_col), 256).alias("digest"))
    named = cut(rows.select("id", "digest"))
    nodes = cut(named.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("node")))
    wanted = nodes.where("node IS NOT NULL").select("node", F.col("digest").alias("__digest"))
    reps = rows.join(wanted, (F.col("id") == F.col("node")) & (F.col("digest") == F.col("__digest"))).dropDuplicates(["node", "digest"])
    links = cut(image_links(reps.select("node", "image")))
    counts = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count().select(F.col("node").alias("counted"), "count")
    found = components(links.select("a", "b")).select(F.col("node").alias("member"), "component")
    classes = nodes.join(found, F.col("node") == F.col("member"), "left").join(counts, F.col("node") == F.col("counted"), "left")
    classes = classes.select(F.col("digest").alias("__digest"), F.coalesce("component", "node").alias("class_id"), F.coalesce("count", F.lit(0)).alias("n_links"))
    return named.join(classes, F.col("digest") == F.col("__digest"), "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def scene(vector: np.ndarray, size: int = 80) -> np.ndarray:
    """A picture of shapes drawn from a vector's bytes; a stand-in where a table has no media of its own."""
    r = np.random.default_rng(xxhash.xxh64_intdigest(np.ascontiguousarray(vector, np.float32).tobytes()))
    out = np.full((size, size), r.uniform(60, 200), np.float32)
    for _ in range(14):
        y, x = r.integers(0, size - 8, 2)
        h, w = r.integers(8, size // 2, 2)
        out[y : y + h, x : x + w] = r.uniform(0, 255)
    return out


def edited(image: np.ndarray) -> np.ndarray:
    """A crop of nine tenths each way, with less contrast."""
    h, w = image.shape
    return image[h // 20 : h - h // 20, w // 20 : w - w // 20] * 0.8 + 20


def rendered(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(media_id, image): a picture of each vector, and for ids that 10 divides an edited copy of id -1 - id."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                ids, images = [], []
                batch = whole.slice(a, 512)
                for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    picture = None if v is None else scene(np.array(v, np.float32))
                    ids.append(i)
                    images.append(None if picture is None else write_image(picture))
                    if i is not None and i % 10 == 0 and picture is not None:
                        ids.append(-1 - i)
                        images.append(write_image(edited(picture)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["media_id", "image"])

    return embeddings.select(id_col, vector_col).mapInArrow(draw, "media_id long, image binary")
