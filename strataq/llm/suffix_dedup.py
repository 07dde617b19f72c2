"""Suffix-array dedup: blockwise suffix sorting with a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, map_arrow, parallelism, ship_package, trimmed

# A perfect difference set: every difference modulo 31 is that of two of its members.
PERIOD = 31
COVER = np.array([0, 1, 3, 8, 12, 18])
# Windows of a bucket segment; longer runs of one bucket are cut.
MOST_WINDOWS = 4096
# Values up to which a sorted array of 64-bit bucket names is broadcast; beyond, the same filter is a join.
BROADCAST_NAMES = 2_000_000


def cover_shifts() -> np.ndarray:
    """shift[a, b]: the least d with (a + d) and (b + d) modulo PERIOD both in COVER."""
    inside = np.isin(np.arange(PERIOD), COVER)
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = next(d for d in range(PERIOD) if inside[(a + d) % PERIOD] and inside[(b + d) % PERIOD])
    return out


SHIFT = cover_shifts()
BYTE_VALUES = np.random.default_rng(11).integers(0, 2**64, 256, np.uint64)


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes (a power of two) from each position, by doubling."""
    h, step, factor = BYTE_VALUES[raw], 1, 0x9E3779B97F4A7C15
    while step < size:
        h = h[:-step] * np.uint64(factor) + h[step:] if len(h) > step else h[:0]
        h ^= h >> np.uint64(31)
        factor = (factor * 0xD1342543DE82EF95 + 2) & (2**64 - 1) | 1
        step *= 2
    return h * np.uint64(0xD6E8FEB86659FD93)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    rows = -(-len(h) // width)
    pad = np.full(rows * width, np.iinfo(np.uint64).max)
    pad[:len(h)] = h
    pad = pad.reshape(rows, width)
    ahead = np.minimum.accumulate(pad, 1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


class Segments:
    """The windows of `length` bytes of some texts, cut into runs whose smallest `gram`-byte hash is the same.

    That hash names the suffix bucket. Equal windows have equal names, so a bucket holds all windows that can be equal to
    one of its own, with their text.
    """

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.length = length
        self.which = np.array([i for i, t in enumerate(texts) if len(t) >= length], np.int64)
        self.buffer = b"".join(texts[i] for i in self.which)
        sizes = np.array([len(texts[i]) for i in self.which], np.int64)
        starts = np.cumsum(sizes) - sizes
        raw = np.frombuffer(self.buffer, np.uint8)
        self.hashes = gram_hashes(raw, gram)
        self.width = length - gram + 1
        low = sliding_min(self.hashes, self.width)
        new = np.zeros(len(low) + 1, bool)
        new[1:-1] = low[1:] != low[:-1]
        inside = np.zeros(len(low) + 1, np.int8)
        valid_end = starts + sizes - length + 1
        if len(sizes):
            np.add.at(inside, starts, 1)
            np.add.at(inside, np.minimum(valid_end, len(low)), -1)
            new[starts] = True
        inside = np.cumsum(inside[:-1]).astype(bool)
        new = new[:-1]
        first = np.flatnonzero(new & inside)
        doc = np.searchsorted(starts, first, "right") - 1
        end = np.minimum(np.r_[first[1:], len(low)], valid_end[doc]) if len(first) else first
        count = end - first
        pieces = -(-count // MOST_WINDOWS)
        if (pieces > 1).any():
            step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            doc, end = np.repeat(doc, pieces), np.repeat(end, pieces)
            first = np.repeat(first, pieces) + step * MOST_WINDOWS
            count = np.minimum(end - first, MOST_WINDOWS)
        self.first, self.count = first, count
        self.name = low[first].view(np.int64) if len(first) else np.zeros(0, np.int64)
        self.doc = self.which[doc] if len(first) else doc
        self.place = first - starts[doc] if len(first) else first

    def uses(self, rows: np.ndarray) -> np.ndarray:
        """How often the bucket's gram stands in each of some segments."""
        h, name = self.hashes, self.name.view(np.uint64)
        spans = zip(rows.tolist(), self.first[rows].tolist(), (self.first[rows] + self.count[rows] - 1 + self.width).tolist())
        return np.fromiter((np.count_nonzero(h[a:b] == name[r]) for r, a, b in spans), np.int64, len(rows))

    def text(self, row: int) -> bytes:
        a = int(self.first[row])
        return self.buffer[a:a + int(self.count[row]) + self.length - 1]


def cover_ranks(raw: np.ndarray, start: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the cover sample of a block of segments, -1 elsewhere; bytes past a segment count as zeros.

    Samples are sorted by their first PERIOD bytes, then ranks are doubled: a sample's place PERIOD further on is a
    sample too. Ranks agree with the order of texts to `depth` bytes.
    """
    total = len(raw) + 1
    place = np.arange(len(raw)) - np.repeat(start, size)
    end = np.repeat(start + size, size)
    at = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[place % PERIOD])
    padded = np.concatenate([raw, np.zeros(64, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", padded.tobytes(), 0, (1,))
    left = (end[at] - at)
    keys = []
    for k in range(4):
        room = np.clip(np.minimum(left, PERIOD) - 8 * k, 0, 8)
        w = words[at + 8 * k].astype(np.uint64)
        shift = ((8 - room) * 8).astype(np.uint64)
        keys.append(np.where(room == 0, 0, (w >> np.minimum(shift, 63)) << np.minimum(shift, 63)).astype(np.uint64))
    order = np.lexsort(keys[::-1])
    differs = np.zeros(len(order), bool)
    for w in keys:
        s = w[order]
        differs[1:] |= s[1:] != s[:-1]
    rank = np.full(total, -1, np.int64)
    rank[at[order]] = np.cumsum(differs)
    reach = PERIOD
    while reach < depth:
        there = np.where(at + reach < end[at], at + reach, total - 1)
        key = rank[at] * (len(at) + 1) + rank[there] + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank[at[order]] = np.cumsum(np.r_[False, s[1:] != s[:-1]])
        reach *= 2
    return rank


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, which of its windows of `length` bytes stand more than once in the block.

    Suffixes are bucketed by their first PERIOD bytes. Ties are sorted by three-way partition, all buckets at once: two
    suffixes compare by the ranks of the cover samples at their common shift. Neighbours in this order are then compared
    byte by byte to `length`.
    """
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(texts), np.uint8)
    count = size - length + 1
    base = np.repeat(start, count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = base + place
    head = gram_hashes(np.concatenate([raw, np.zeros(32, np.uint8)]), 16)
    head = (head[:-15] * np.uint64(0x9E3779B97F4A7C15) ^ head[15:])[at]  # two overlapping halves: PERIOD bytes
    order = np.argsort(head, kind="stable")
    head = head[order]
    group = np.cumsum(np.r_[False, head[1:] != head[:-1]])
    bucket = group.copy()
    rank = None
    open_ = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
    tied = open_
    while len(open_):
        if rank is None:
            rank = cover_ranks(raw, start, size, length)
            residue = (place % PERIOD).astype(np.int64)
        g = group[open_]
        begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        n = np.diff(np.r_[begin, len(g)])
        pivot = np.repeat(open_[begin + n // 2], n)
        i, p = order[open_], order[pivot]
        d = SHIFT[residue[i], residue[p]]
        side = np.sign(rank[at[i] + d] - rank[at[p] + d])
        key = np.repeat(np.arange(len(n)), n) * 3 + side + 1
        turn = np.argsort(key, kind="stable")
        order[open_], key = i[turn], key[turn]
        fresh = np.r_[True, key[1:] != key[:-1]]
        part = np.cumsum(fresh) - 1
        many = np.bincount(part)[part]
        group[open_] = part + (group.max() + 1)
        open_ = open_[(many > 1) & (key % 3 != 1)]
    words = np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), 0, (1,)) if len(raw) >= 8 else np.zeros(0, np.uint64)
    near = tied[1:][(bucket[tied[1:]] == bucket[tied[:-1]]) & (tied[1:] == tied[:-1] + 1)] if len(tied) else tied
    a, b = at[order[near - 1]], at[order[near]]
    for k in [*range(0, length - 7, 8), length - 8]:
        same = words[a + k] == words[b + k]
        if not same.all():
            near, a, b = near[same], a[same], b[same]
    hit = np.zeros(len(at), bool)
    hit[order[near]] = True
    hit[order[near - 1]] = True
    return np.split(hit, np.cumsum(count)[:-1]) if len(texts) else []


def runs_of(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    yield from zip(edge[::2].tolist(), edge[1::2].tolist())


def encoded(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column(batch, "text").to_pylist()]


def wanted(names: DataFrame, many: int):
    """The sorted names as a broadcast array where they are few enough, else None."""
    spark = names.sparkSession
    if many > BROADCAST_NAMES:
        return None
    return spark.sparkContext.broadcast(np.sort(names.toArrow().column("name").to_numpy()))


def among(values: np.ndarray, known) -> np.ndarray:
    if known is None:
        return np.arange(len(values))
    k = known.value
    if not len(k):
        return np.zeros(0, np.int64)
    return np.flatnonzero(k[np.minimum(np.searchsorted(k, values), len(k) - 1)] == values)


def repeated_spans(rows: DataFrame, length: int, gram: int, block_bytes: int, hot_segments: int) -> DataFrame:
    """(row, start, end) byte spans of windows that stand more than once; rows has row (binary) and text."""
    slice_rows = 256

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = Segments(encoded(batch), length, gram)
        return pa.RecordBatch.from_arrays([pa.array(s.name), pa.array(s.uses(np.arange(len(s.name))))], ["name", "n"])

    names = map_arrow(rows.select("text"), count, "name long, n long", rows=slice_rows)
    names = cut(names.groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name"))
    many = names.count()
    known = wanted(names, many)

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = Segments(encoded(batch), length, gram)
        keep = among(s.name, known)
        digests = [xxhash.xxh3_128_digest(s.text(r)) for r in keep.tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array(s.name[keep]), pa.array(digests, pa.binary()), column(batch, "row").take(pa.array(s.doc[keep])),
             pa.array(s.place[keep]), pa.array(s.count[keep].astype(np.int32)), pa.array(s.uses(keep) > 1)],
            ["name", "digest", "row", "place", "windows", "inner"])

    fields = "name long, digest binary, row binary, place long, windows int, inner boolean"
    segments = map_arrow(rows, describe, fields, rows=slice_rows)
    segments = cut(segments if known is not None else segments.join(names, "name", "left_semi"))
    alike = cut(segments.groupBy("name", "digest").agg(F.count("*").alias("n"), F.max("inner").alias("inner")))
    # Segments that stand twice are repeated throughout.
    twice = alike.where("n > 1").select("name", "digest")
    whole = segments.join(twice, ["name", "digest"], "left_semi").select(
        "row", F.col("place").alias("start"), (F.col("place") + F.col("windows") + (length - 1)).alias("end"))
    # Buckets with different segments, or with a gram that stands twice in one, are sorted.
    mixed = alike.groupBy("name").agg(F.count("*").alias("kinds"), F.max("inner").alias("inner"), F.min("n").alias("low"))
    mixed = cut(mixed.where("(kinds > 1 OR inner) AND low = 1").select("name", "kinds"))
    hot = mixed.where(F.col("kinds") > hot_segments).select("name")
    cool = mixed.where(F.col("kinds") <= hot_segments).select("name")
    spans = whole
    many_cool = cool.count()
    if many_cool:
        spans = spans.unionByName(sorted_spans(rows, segments, cool, many_cool, length, gram, block_bytes, slice_rows))
    many_hot = hot.count()
    if many_hot:
        spans = spans.unionByName(hot_spans(rows, segments, hot, many_hot, length, gram, slice_rows))
    return spans


def bytes_of(batch: pa.RecordBatch, known, length: int, gram: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, number of the row in the batch, place, bytes) of the segments of some buckets.

    With a broadcast array of buckets the segments are found again; without one the rows bring a list of them.
    """
    texts = encoded(batch)
    if known is not None:
        s = Segments(texts, length, gram)
        for r in among(s.name, known).tolist():
            yield int(s.name[r]), int(s.doc[r]), int(s.place[r]), s.text(r)
    else:
        for i, (t, todo) in enumerate(zip(texts, column(batch, "todo").to_pylist())):
            for x in todo:
                yield x["name"], i, x["place"], t[x["place"]:x["place"] + x["windows"] + length - 1]


def with_bytes(rows: DataFrame, segments: DataFrame, names: DataFrame, many: int) -> tuple[DataFrame, object]:
    """Rows to read the bytes of some buckets' segments from: all with a broadcast array of names where those are few.

    Else the rows that hold such a segment are joined with its places: bytes are only made where they are asked for.
    """
    known = wanted(names, many)
    if known is not None:
        return rows, known
    todo = segments.join(names, "name", "left_semi").groupBy("row").agg(F.collect_list(F.struct("name", "place", "windows")).alias("todo"))
    return rows.join(todo, "row").select("row", "text", "todo"), None


def sorted_spans(rows: DataFrame, segments: DataFrame, names: DataFrame, many: int, length: int, gram: int, block_bytes: int,
                 slice_rows: int) -> DataFrame:
    rows, known = with_bytes(rows, segments, names, many)

    def fetch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = bytes_of(batch, known, length, gram)
        while part := list(islice(found, 1024)):
            name, doc, place, texts = zip(*part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name, pa.int64()), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
                 column(batch, "row").take(pa.array(doc)), pa.array(place, pa.int64()), pa.array(texts, pa.binary())],
                ["name", "digest", "row", "place", "bytes"])

    fetched = map_arrow(rows, fetch, "name long, digest binary, row binary, place long, bytes binary", rows=slice_rows)
    one = fetched.groupBy("name", "digest").agg(
        F.min_by(F.struct("row", "place"), F.struct("row", "place")).alias("at"), F.first("bytes").alias("bytes"), F.count("*").alias("n"))
    dealt = one.select("name", "at.row", "at.place", "bytes", "n").repartition(parallelism(rows.sparkSession), "name")
    ship_package(rows.sparkSession)

    def solve(held: list[tuple[int, bytes, int, bytes, int]]) -> pa.RecordBatch:
        flags = repeated_windows([h[3] for h in held], length)
        out = [(r, p + a, p + b + length - 1) for (_, r, p, _, n), f in zip(held, flags) if n == 1 for a, b in runs_of(f)]
        cols = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64()))], ["row", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, bytes, int]] = []
        size = 0
        for batch in batches:
            for x in zip(*(column(batch, c).to_pylist() for c in ("name", "row", "place", "bytes", "n"))):
                if size >= block_bytes and held and held[-1][0] != x[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(x)
                size += len(x[3])
        if held:
            yield solve(held)

    return dealt.sortWithinPartitions("name").mapInArrow(trimmed(run), "row binary, start long, end long")


def hot_spans(rows: DataFrame, segments: DataFrame, names: DataFrame, many: int, length: int, gram: int, slice_rows: int) -> DataFrame:
    """The exact way for buckets of too many different segments: digests of single windows, counted with partial sums."""
    rows, known = with_bytes(rows, segments, names, many)

    def fetch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = column(batch, "row")
        for _, doc, place, t in bytes_of(batch, known, length, gram):
            n = len(t) - length + 1
            digests = [xxhash.xxh3_128_digest(t[p:p + length]) for p in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), ids.take(pa.array(np.full(n, doc))), pa.array(np.arange(n) + place)],
                ["digest", "row", "start"])

    windows = map_arrow(rows, fetch, "digest binary, row binary, start long", rows=slice_rows)
    twice = windows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    return windows.join(twice, "digest", "left_semi").select("row", "start", (F.col("start") + length).alias("end"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 64,
                   block_bytes: int = 3_000_000, hot_segments: int = 12_000) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that starts somewhere else too, in any text.

    Returns id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (the bytes that stay,
    binary). Texts are UTF-8 bytes; null is empty; matches never cross texts; strings are judged on the input. Texts
    shorter than `length` stay whole; a repeated row is a copy of the other, so both lose all of their long strings; an
    empty table gives an empty result; other columns are not read.

    Buckets of suffixes are named by the smallest hash of a `gram`-byte string in their first `length` bytes, and only
    names that stand twice are followed. A bucket is sorted in a block of about `block_bytes`; one of more than
    `hot_segments` different segments is counted window by window instead, which no group can make uneven.
    """
    assert gram & (gram - 1) == 0 and length > gram >= 16
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    base = base.withColumn("row", F.unhex(F.md5(F.concat_ws(":", F.length(name), name, "text"))))
    spans = repeated_spans(base.select("row", "text"), length, gram, block_bytes, hot_segments)
    spans = cut(spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    joined = base.join(spans, "row", "left").select("id", "text", "spans")

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, spans in zip(encoded(batch), column(batch, "spans").to_pylist()):
            kept, at, runs, removed = [], 0, 0, 0
            low = high = -1
            for a, b in [*sorted((s["start"], s["end"]) for s in spans or []), (len(t) + 1, 0)]:
                if a <= high:
                    high = max(high, b)
                    continue
                if high > low:
                    kept.append(t[at:low])
                    at, runs, removed = high, runs + 1, removed + high - low
                low, high = a, b
            kept.append(t[at:])
            rest = b"".join(kept)
            out.append((len(t), removed, runs, hashlib.sha256(rest).hexdigest(), rest))
        size, removed, runs, digest, rest = zip(*out) if out else ((),) * 5
        return pa.RecordBatch.from_arrays(
            [column(batch, "id"), *(pa.array(x, pa.int64()) for x in (size, removed, runs)), pa.array(digest, pa.string()),
             pa.array(rest, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    key = base.schema["id"].dataType.simpleString()
    fields = f"id {key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return map_arrow(joined, apply, fields).withColumnRenamed("id", id_col)


def brute_force(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 by a table of all strings; for tests."""
    raw, seen = [(t or "").encode() for t in texts], {}
    for i, t in enumerate(raw):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p:p + length], []).append((i, p))
    gone = [bytearray(len(t)) for t in raw]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p:p + length] = b"\1" * length
    out = []
    for t, g in zip(raw, gone):
        rest = bytes(c for c, x in zip(t, g) if not x)
        out.append((len(t), sum(g), len(bytes(g).replace(b"\1", b"1").replace(b"\0", b" ").split()), hashlib.sha256(rest).hexdigest()))
    return out
