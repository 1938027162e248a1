"""Copied images by local descriptors: cropped, resized, turned or edited copies found without comparing all pairs.

1. Decode (binary PGM, PPM, or 8-bit PNG without interlace) to grey.
2. At each scale of a smoothed pyramid, from the full size down by 1.2 a level as long as a patch fits, every corner is
   taken that has the greatest Harris response within 3 pixels, so corners grow with the area and depend neither on what
   a crop left out nor on its size.
3. Turn each corner's patch by its intensity centroid and make 256 binary brightness tests.
4. Hamming tables: an equal 64-bit word, of the four that a descriptor has, puts two images in one bucket; equal
   contents are one vertex, and buckets are linked without emitting all their pairs (see linking). What is still to
   compare across the components of one bucket must have descriptors there that differ in at most ``max_bits`` bits.
5. A pair of images is confirmed by geometric consensus: corners whose descriptors differ in at most
   ``max_bits`` bits vote for a similarity transform, and enough of them must agree with one in place, scale and turn. Of the
   corners of the image with fewer that is 3 %, but at least 12, or 35 % where that is less than 12, and never less than
   ``min_votes``: unrelated pictures reach 8 or so by chance however few corners they have.

A task holds the pyramid of one image at a time, or of as many small ones as have PIECE pixels together, some 60 bytes a
pixel, and compares descriptors of two images in pieces, so its memory is that of one image.

Defined cases: null, empty or undecodable content (also one that claims more than MAX_PIXELS) has no corners: with null or empty content an image is linked with
nothing, equal undecodable contents are one class; an image with too few corners links only to equal
contents; rows that share an id are one vertex, which shows the content of smallest SHA-256; an image without id keeps
the null id as its class. Only the id and the content of the input are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.linking import link_in_buckets
from fieldbook.llm.scratch import quoted, written

#: a patch's radius; the pyramid's step; how far a corner is the strongest
RADIUS, STEP, APART = 12, 1.2, 3
#: pixels described at once; the most an image may have; distances of descriptors held at once
PIECE, MAX_PIXELS, HELD = 1 << 20, 1 << 28, 1 << 22
MAX_BITS, MIN_VOTES = 40, 5
#: how many of the smaller image's corners must agree: a share, but at least so many, or so large a share of few corners
VOTE_SHARE, VOTES, FEW_SHARE = 0.03, 12, 0.35
TABLES = 4
_PNM = re.compile(rb"P([56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+255\s")
_rng = np.random.default_rng(4)
#: where the binary tests compare: 256 pairs of points within a disc around the corner
PATTERN = np.clip(_rng.normal(0, RADIUS / 2.5, (256, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7).astype(np.float32)


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of an image, or None."""
    try:
        if not data:
            return None
        if m := _PNM.match(data):
            depth, w, h = (1, 3)[m[1] == b"6"], int(m[2]), int(m[3])
            if h * w > MAX_PIXELS:
                return None
            flat = np.frombuffer(data, np.uint8, h * w * depth, m.end())
            return flat.reshape(h, w, depth).mean(axis=2).astype(np.float32) if h and w else None
        return _png(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else None
    except (ValueError, IndexError, KeyError, zlib.error):
        return None


def _png(data: bytes) -> np.ndarray:
    at, body, head, palette = 8, [], b"", b""
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if kind == b"IDAT":
            body.append(part)
        head, palette = (part if kind == b"IHDR" else head), (part if kind == b"PLTE" else palette)
        at += 12 + size
    w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    if head[8] != 8 or head[12] or not 0 < h * w <= MAX_PIXELS:
        raise ValueError("only 8-bit PNG without interlace, of at most MAX_PIXELS")
    depth = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[9]]
    size = h * (1 + w * depth)
    # no more is unpacked than the header announces
    rows = np.frombuffer(zlib.decompressobj().decompress(b"".join(body), size), np.uint8, size).reshape(h, 1 + w * depth)
    out = np.zeros((h + 1, w + 1, depth), np.uint8)  # one row above and one pixel to the left are zero
    for y in range(h):
        _unfilter(int(rows[y, 0]), rows[y, 1:].reshape(w, depth), out[y], out[y + 1])
    pixels = out[1:, 1:]
    if head[9] == 3:
        return np.frombuffer(palette, np.uint8).reshape(-1, 3).mean(axis=1).astype(np.float32)[pixels[:, :, 0]]
    return pixels[:, :, : 3 if depth > 2 else 1].mean(axis=2).astype(np.float32)


def _unfilter(kind: int, line: np.ndarray, up: np.ndarray, out: np.ndarray) -> None:
    """One row of pixels from its differences; up and out begin with the zero pixel to the left."""
    if kind == 0:
        out[1:] = line
    elif kind == 1:
        np.cumsum(line, axis=0, dtype=np.uint8, out=out[1:])
    elif kind == 2:
        out[1:] = line + up[1:]
    elif kind in (3, 4):
        # each pixel needs the one before it: a loop over plain numbers, a channel at a time
        for c in range(line.shape[1]):
            above, left, made = up[:, c].tolist(), 0, []
            for x, v in enumerate(line[:, c].tolist(), 1):
                if kind == 3:
                    guess = (left + above[x]) >> 1
                else:
                    corner = above[x - 1]
                    p = left + above[x] - corner
                    to_left, to_above, to_corner = abs(p - left), abs(p - above[x]), abs(p - corner)
                    guess = left if to_left <= to_above and to_left <= to_corner else above[x] if to_above <= to_corner else corner
                left = (v + guess) & 255
                made.append(left)
            out[1:, c] = made
    else:
        raise ValueError("an unknown filter")


def _resize(stack: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear resize of images (n, height, width)."""
    high, wide = stack.shape[1:]
    if (h, w) == (high, wide):
        return stack
    y = np.clip((np.arange(h) + 0.5) * high / h - 0.5, 0, high - 1)
    x = np.clip((np.arange(w) + 0.5) * wide / w - 0.5, 0, wide - 1)
    y0, x0 = np.minimum(y.astype(int), max(high - 2, 0)), np.minimum(x.astype(int), max(wide - 2, 0))
    y1, x1 = np.minimum(y0 + 1, high - 1), np.minimum(x0 + 1, wide - 1)
    fy, fx = (y - y0).astype(np.float32)[:, None], (x - x0).astype(np.float32)
    rows = stack[:, y0] * (1 - fy) + stack[:, y1] * fy
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx


def _near(a: np.ndarray, r: int, op: np.ufunc) -> np.ndarray:
    """op over (2r + 1)-squares, with edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        wide, n = np.pad(a, pad, mode="edge"), a.shape[axis]
        cut = (lambda k: wide[:, k : k + n]) if axis == 1 else (lambda k: wide[:, :, k : k + n])  # noqa: B023
        a = cut(0).copy()
        for k in range(1, 2 * r + 1):
            op(a, cut(k), out=a)
    return a


def _smooth(a: np.ndarray) -> np.ndarray:
    """The binomial filter 1 2 1 along both axes."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (1, 1)
        wide = np.pad(a, pad, mode="edge")
        a = (wide[:, :-2] + wide[:, 2:] if axis == 1 else wide[:, :, :-2] + wide[:, :, 2:]) * np.float32(0.25) + a * np.float32(0.5)
    return a


_disc = [(y, x) for y in range(-RADIUS + 2, RADIUS - 1) for x in range(-RADIUS + 2, RADIUS - 1) if y * y + x * x <= (RADIUS - 2) ** 2]
DISC_Y, DISC_X = (np.array(side) for side in zip(*_disc))


def describe_stack(stack: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each image of one shape: corners (x, y, scale, angle) and descriptors (corner, 4 words of 64 bits)."""
    points: list[list[np.ndarray]] = [[] for _ in stack]
    words: list[list[np.ndarray]] = [[] for _ in stack]
    edge, (high, wide) = RADIUS + 1, stack.shape[1:]
    level, k = _smooth(_smooth(stack.astype(np.float32))), -1
    while True:
        k += 1
        if k:
            level = _resize(_smooth(level), max(1, round(high / STEP**k)), max(1, round(wide / STEP**k)))
        n, h, w = level.shape
        if h <= 2 * edge or w <= 2 * edge:
            break
        gy, gx = np.gradient(level, axis=(1, 2))
        xx, yy, xy = (_near(g, 2, np.add) for g in (gx * gx, gy * gy, gx * gy))
        score = xx * yy - xy * xy - np.float32(0.05) * (xx + yy) ** 2
        peak = (score > 1.0) & (score == _near(score, APART, np.maximum))
        image, y, x = np.nonzero(peak[:, edge : h - edge, edge : w - edge])
        if not len(image):
            continue
        y, x = y + edge, x + edge
        at = (image * h + y) * w + x
        patch = level.ravel()[at[:, None] + (DISC_Y * w + DISC_X)]
        angle = np.arctan2(patch @ DISC_Y.astype(np.float32), patch @ DISC_X.astype(np.float32))
        c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
        flat, value = _near(level, 2, np.add).ravel(), []
        for end in (0, 1):
            px, py = PATTERN[:, end, 0], PATTERN[:, end, 1]
            value.append(flat[at[:, None] + np.rint(s * px + c * py).astype(int) * w + np.rint(c * px - s * py).astype(int)])
        bits = np.packbits(value[0] < value[1], axis=1).view(np.int64).reshape(len(image), 4)
        zoom = np.sqrt(high * wide / (h * w))
        place = np.stack([(x + 0.5) * wide / w, (y + 0.5) * high / h, np.full(len(x), zoom), angle], axis=1).astype(np.float32)
        bounds = np.searchsorted(image, np.arange(n + 1))
        for i in range(n):
            points[i].append(place[bounds[i] : bounds[i + 1]])
            words[i].append(bits[bounds[i] : bounds[i + 1]])
    none = (np.zeros((0, 4), np.float32), np.zeros((0, 4), np.int64))
    return [(np.concatenate(p), np.concatenate(d)) if p else none for p, d in zip(points, words)]


def _parts(batch: pa.RecordBatch):
    """A batch in slices of at most 64 images, fewer if they are large."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(2)]
    at = 0
    while at < batch.num_rows:
        end, held = at + 1, sizes[at]
        while end < min(at + 64, batch.num_rows) and held + sizes[end] <= 4 * PIECE:
            held, end = held + sizes[end], end + 1
        yield batch.slice(at, end - at)
        at = end


def _lists(rows: list[np.ndarray | None], kind) -> pa.Array:
    """An array column of these rows, an empty list for None."""
    full = [np.zeros(0, kind) if r is None else r for r in rows]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in full])]), pa.int32()), pa.array(np.concatenate(full)))


def _describe_batches(batches):
    """(v, print, content) to (v, print, points, words): points and words as flat arrays."""
    for batch in batches:
        for part in _parts(batch):
            images = [decode(x.as_py()) for x in part.column(2)]
            points, words = [None] * len(images), [None] * len(images)
            shapes: dict[tuple, list[int]] = {}
            for i, image in enumerate(images):
                if image is not None:
                    shapes.setdefault(image.shape, []).append(i)
            for (h, w), same in shapes.items():
                many = max(1, PIECE // max(h * w, 1))
                for rows in (same[k : k + many] for k in range(0, len(same), many)):
                    for i, (p, d) in zip(rows, describe_stack(np.stack([images[i] for i in rows]))):
                        points[i], words[i] = p.ravel(), d.ravel()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(points, np.float32), _lists(words, np.int64)], names=["v", "print", "points", "words"])


def consensus(p: np.ndarray, d: np.ndarray, q: np.ndarray, e: np.ndarray, max_bits: int = MAX_BITS, enough: int | None = None) -> int:
    """How many corners of the first image agree with one similarity transform into the second; stops at enough."""
    if not len(p) or not len(q):
        return 0
    near, bits, many = np.empty(len(p), np.int64), np.empty(len(p), np.int32), max(1, HELD // len(q))
    mine, other = d.view(np.uint64), np.ascontiguousarray(e.view(np.uint64).T)
    for k in range(0, len(p), many):
        far = np.zeros((len(mine[k : k + many]), len(q)), np.uint16)
        for j in range(4):
            far += np.bitwise_count(mine[k : k + many, j, None] ^ other[j])
        near[k : k + many] = far.argmin(axis=1)
        bits[k : k + many] = far[np.arange(len(far)), near[k : k + many]]
    i = np.flatnonzero(bits <= max_bits)
    if len(i) < (enough or 1):
        return 0
    i = i[np.argsort(bits[i], kind="stable")]
    a, b = p[i], q[near[i]]
    most = 0
    zooms, turns = b[:, 2] / a[:, 2], b[:, 3] - a[:, 3]
    # each match fixes scale, turn and shift on its own; the best matches come first
    for k in range(len(i)):
        c, s = zooms[k] * np.cos(turns[k]), zooms[k] * np.sin(turns[k])
        x, y = a[:, 0] - a[k, 0], a[:, 1] - a[k, 1]
        off = np.hypot(c * x - s * y + b[k, 0] - b[:, 0], s * x + c * y + b[k, 1] - b[:, 1])
        turned = np.abs((turns - turns[k] + np.pi) % (2 * np.pi) - np.pi)
        scaled = np.abs(np.log(zooms / zooms[k]))
        # a corner may be off by 3 pixels of its level, and by what an angle of 7 degrees or a scale 7 % off moves it
        good = (off <= 3 * b[:, 2] + 0.12 * zooms[k] * np.hypot(x, y)) & (turned <= 0.5) & (scaled <= 0.3)
        if good.sum() >= max(most + 1, enough or 1):
            # corners at one place of either image count once
            most = max(most, min(len(np.unique(np.rint(side[good, :2] / 3), axis=0)) for side in (a, b)))
            if enough and most >= enough:
                break
    return most


def agree(p: np.ndarray, d: np.ndarray, q: np.ndarray, e: np.ndarray, max_bits: int = MAX_BITS, min_votes: int = MIN_VOTES) -> bool:
    """Whether enough corners agree, by how many the image with fewer has."""
    fewer = min(len(p), len(q))
    enough = max(min_votes, min(VOTES, int(np.ceil(FEW_SHARE * fewer))), int(np.ceil(VOTE_SHARE * fewer)))
    return consensus(p, d, q, e, max_bits, enough) >= enough


def _confirm_batches(max_bits: int, min_votes: int):
    def rows(column, kind):
        """The rows of an array column, each as a matrix of four columns."""
        flat, at = np.asarray(column.flatten()).astype(kind, copy=False), column.offsets.to_numpy()
        at = at - at[0]
        return [flat[x:y].reshape(-1, 4) for x, y in zip(at[:-1], at[1:])]

    def run(batches):
        for batch in batches:
            pa_, wa, pb, wb = (rows(batch.column(k), t) for k, t in ((2, np.float32), (3, np.int64), (4, np.float32), (5, np.int64)))
            mask = pa.array([agree(*x, max_bits, min_votes) for x in zip(pa_, wa, pb, wb)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def find_copies(images: DataFrame, id_col: str = "image_id", content_col: str = "content", max_bits: int = MAX_BITS, min_votes: int = MIN_VOTES) -> DataFrame:
    """(image_id, n_corners, class_id, n_links), a row for each row of images.

    class_id is the smallest id of the image's class; n_links counts the confirmed pairs of its content, of which
    there are enough to hold each class together: pairs inside a class are not all compared.
    """
    rows = images.select(quoted(id_col).cast("long").alias("image_id"), F.sha2(quoted(content_col), 256).alias("print"), quoted(content_col).alias("content"))
    ids = written(rows.select("image_id", "print", (F.octet_length("content") > 0).alias("some")))
    prints = written(ids.where("some and image_id is not null").groupBy("print").agg(F.min("image_id").alias("v")))
    # each vertex shows one content; images are described where they are read, and only descriptors are shuffled
    shown = prints.groupBy("v").agg(F.min("print").alias("print"))
    described = rows.mapInArrow(_describe_batches, "v long, print string, points array<float>, words array<long>")
    known = written(described.join(shown.hint("merge"), ["v", "print"]).dropDuplicates(["v", "print"]).drop("print"))
    # the keys of an image once each: an equal word in the same table
    keys = F.array_distinct(F.transform("words", lambda w, k: F.xxhash64(k % TABLES, w)))
    one = known.select("v", F.explode(keys).alias("bucket"))
    vertices = one.select("bucket", "v", F.lit(0).cast("long").alias("tv"), F.lit(0).cast("long").alias("s"))

    def prepare(_: DataFrame):
        def confirm(pairs: DataFrame) -> DataFrame:
            left = pairs.join(known.select(F.col("v").alias("a"), F.col("points").alias("pa"), F.col("words").alias("wa")), "a")
            both = left.join(known.select(F.col("v").alias("b"), F.col("points").alias("pb"), F.col("words").alias("wb")), "b")
            return both.select("a", "b", "pa", "wa", "pb", "wb").mapInArrow(_confirm_batches(max_bits, min_votes), "a long, b long")

        return known.select("v", F.lit(0).cast("long").alias("tv"), F.col("words").alias("f")), confirm

    # the descriptors that an image has in its open buckets, and whether two of one bucket are close
    there = f"struct(xxhash64(k % {TABLES}, f[k]) as bucket, slice(f, k - k % {TABLES} + 1, {TABLES}) as part)"
    there = f"filter(transform(sequence(0, size(f) - 1), k -> {there}), e -> array_contains(own, e.bucket))"
    differ = " + ".join(f"bit_count(x[{k}] ^ y[{k}])" for k in range(TABLES))
    edges, labels = link_in_buckets(vertices, prepare, close=f"exists(f, x -> exists(fb, y -> {differ} <= {max_bits}))", parts=there)
    links = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("n_links"))
    facts = known.select("v", (F.size("words") / 4).cast("long").alias("n_corners")).join(labels, "v", "left").join(links, "v", "left")
    # the content's vertex by its print; a content that repeats is looked up by all its rows
    facts = written(prints.join(facts, "v"))
    out = ids.join(facts, "print", "left")
    usable = F.col("some") & F.col("image_id").isNotNull()
    return out.select(
        "image_id",
        F.coalesce(F.when(usable, F.col("n_corners")), F.lit(0)).cast("long").alias("n_corners"),
        F.when(usable, F.coalesce("c", "v")).otherwise(F.col("image_id")).alias("class_id"),
        F.coalesce(F.when(usable, F.col("n_links")), F.lit(0)).cast("long").alias("n_links"),
    )


SIDE = 72


def _draw_batches(batches):
    """Two images a vector: drawn from its values, and a cropped, brightened copy."""
    rng = np.random.default_rng(44)
    basis = _near(_near(rng.normal(0, 1, (64, SIDE, SIDE)).astype(np.float32), 1, np.add), 1, np.add).reshape(64, -1)
    head = f"P5 {SIDE} {SIDE} 255\n".encode()
    small = f"P5 {SIDE - 8} {SIDE - 6} 255\n".encode()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        ids2, out = [], []
        for i, vec in zip(ids, batch.column(1).to_pylist()):
            v = np.resize(np.array([x or 0.0 for x in vec or []] or [0.0], np.float32), 64)
            picture = v @ basis
            grey = np.clip(128 + 60 * picture / (picture.std() + 1e-6), 0, 255).reshape(SIDE, SIDE)
            copy = np.clip(grey[4 : SIDE - 2, 3 : SIDE - 5] * 0.9 + 14, 0, 255)
            ids2 += [None, None] if i is None else [2 * i, 2 * i + 1]
            out += [head + grey.astype(np.uint8).tobytes(), small + copy.astype(np.uint8).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(ids2, pa.int64()), pa.array(out, pa.binary())], names=["image_id", "content"])


def drawn_images(embeddings: DataFrame) -> DataFrame:
    """(image_id, content): the test tables hold no media, so each vector is drawn as a picture with an edited copy."""
    return embeddings.select("vec_id", "embedding").mapInArrow(_draw_batches, "image_id long, content binary")


def op4_image_copies(spark, sf_dir: str) -> DataFrame:
    """Every drawn picture with its class; a null vector is a flat picture without corners."""
    return find_copies(drawn_images(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
