"""Best-fit packing of tokenised documents, large items first."""

from __future__ import annotations

import bisect
import gc
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, cut, map_arrow, texts_of

# The word pattern of the tokenizer file, and how byte-level vocabularies write bytes.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SIMPLE = regex.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xffĀ-įı-ž]+")
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
LONGEST = 32
# Rows up to which the counts by task are broadcast; beyond, they are joined by the keys by which pieces are dealt anyway.
BROADCAST_ROWS = 1_000_000
# Texts of these characters alone are lower-cased whole, and a mark that ends a word of letters is cut off there.
PLAIN_TEXT = re.compile(r"[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xffĀ-įı-ž]*")
END_MARK = re.compile(r"([.,!?;:])(?<=[a-zà-öø-ÿā-ž][.,!?;:])(?=[\t-\r ]|\Z)")
# A worker keeps its tokenizer for as long as it lives, through the stages of a pipeline too; beyond so many words it forgets all
# but those of the slice at hand, in which the frequent ones are.
WORDS_KEPT = 150_000


class WordTokenizer:
    """The ids of a BPE with word ends: distinct words are merged in bulk, and the tokenizers library does the rest.

    White space never joins a token there, so a text's ids are those of its white-space words in order. Words of ASCII
    and accented Latin letters take the bulk path; any other word, and any text with the literal of an added token, is
    encoded by the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        spare = iter(range(0x100, 0x200))
        names = {b: chr(b) if b in set(PLAIN_BYTES) else None for b in range(256)}
        names = {b: n or chr(next(spare)) for b, n in names.items()}
        self.inner = np.array([vocab[names[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[names[b] + "</w>"] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 16) | vocab[b] for a, b in merges], np.int64)
        self.new = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.none = len(merges)
        self.bits = 20
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, self.none, np.int64)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self.place(keys).tolist())):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ranks[at] = key, rank
        self.known: dict[str, bytes] = {}

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 16) | b
        at = self.place(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.ranks[at], self.none)
        open_ = np.flatnonzero((got != keys) & (got >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def merge(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts of at most LONGEST bytes: in each round every part merges its first best pair."""
        out: list[bytes] = [b""] * len(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        for low, high in ((1, 4), (5, 7), (8, 10), (11, 14), (15, 20), (21, LONGEST)):
            rows = np.flatnonzero((sizes >= low) & (sizes <= high))
            if not len(rows):
                continue
            raw = np.frombuffer(b"".join(parts[i].ljust(high, b"\0") for i in rows), np.uint8).reshape(-1, high)
            n = sizes[rows]
            sym = self.inner[raw]
            sym[np.arange(len(rows)), n - 1] = self.last[raw[np.arange(len(rows)), n - 1]]
            cols = np.arange(high)
            best = np.full(sym.shape, self.none)
            inside = cols[None, :-1] < (n - 1)[:, None]
            best[:, :-1][inside] = self.rank(sym[:, :-1][inside], sym[:, 1:][inside])
            live = np.arange(len(rows))
            while len(live):
                b = best[live]
                j = b.argmin(1)
                r = b[np.arange(len(live)), j]
                go = r < self.none
                live, j, r, b = live[go], j[go], r[go], b[go]
                if not len(live):
                    break
                s = sym[live]
                at = np.arange(len(live))
                src = np.minimum(cols[None, :] + (cols[None, :] > j[:, None]), high - 1)
                s, b = np.take_along_axis(s, src, 1), np.take_along_axis(b, src, 1)
                b[:, -1] = self.none
                s[at, j] = self.new[r]
                n[live] -= 1
                m = n[live]
                b[at, j] = self.none
                k = np.flatnonzero(j + 1 < m)
                b[k, j[k]] = self.rank(s[k, j[k]], s[k, j[k] + 1])
                k = np.flatnonzero(j > 0)
                b[k, j[k] - 1] = self.rank(s[k, j[k] - 1], s[k, j[k]])
                sym[live], best[live] = s, b
            keep = cols[None, :] < n[:, None]
            flat, ends = sym[keep].astype("<u4").tobytes(), (4 * n.cumsum()).tolist()
            at = 0
            for i, end in zip(rows.tolist(), ends):
                out[i] = flat[at:end]
                at = end
        return out

    def learn(self, words: list[str]) -> None:
        """Put the ids of some words into `known`, and those of the lower-case parts that they are made of."""
        known = self.known
        easy = {w for w in words if w.isascii() and w.isalpha() and w.islower()}
        need = set(easy)
        several: list[tuple[str, list[str]]] = []
        for w in words:
            if w in easy:
                continue
            if w.isascii() or (SIMPLE.fullmatch(w) and len(w) <= 200):
                low = w.lower()
                if low.isalpha():
                    found = [low]
                else:
                    found = [low[:-1], low[-1]] if low[-1] in ".,!?" and low[:-1].isalpha() else PIECES.findall(low)
                if len(found) != 1 or found[0] != w:
                    several.append((w, found))
                need.update(found)
            else:
                known[w] = self.by_library(w)
        need = list(need.difference(known))
        raw = [p.encode() for p in need]
        short = [i for i, b in enumerate(raw) if len(b) <= LONGEST]
        known.update(zip([need[i] for i in short], self.merge([raw[i] for i in short])))
        if len(short) < len(need):
            known.update((p, self.by_library(p)) for p, b in zip(need, raw) if len(b) > LONGEST)
        for w, found in several:
            known[w] = b"".join([known[p] for p in found])

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        whole = {}
        words = []
        for i, t in enumerate(texts):
            if "<" in t and any(x in t for x in self.added):
                whole[i] = self.by_library(t)
                words.append([])
            elif PLAIN_TEXT.fullmatch(t):
                words.append(END_MARK.sub(r" \1", t.lower()).split())
            elif regex.search("[\x1c-\x1f]", t):  # str.split breaks at these, which the pattern takes as signs
                words.append(regex.split(r"[^\S\x1c-\x1f]+", t.strip(" \t\n\v\f\r")))
            else:
                words.append(t.split())
        here = set().union(*words)
        if len(self.known) > WORDS_KEPT:
            self.known = {w: self.known[w] for w in here if w in self.known}
        new = here.difference(self.known)
        new.discard("")
        collecting = gc.isenabled()
        gc.disable()  # nothing below makes cycles, and the walk over all kept words is slow
        try:
            self.learn(list(new))
        finally:
            if collecting:
                gc.enable()
        self.known[""] = b""
        get = self.known.__getitem__
        return [whole[i] if i in whole else b"".join(map(get, w)) for i, w in enumerate(words)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's ids, the closing 0 included."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple[int, int, int, int, int]] = []
        for i, ids in enumerate(tokenizer(vocabulary).encode(texts_of(batch))):
            ids += b"\0\0\0\0"
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at:at + 4 * capacity]
                rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
        at, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
        return pa.RecordBatch.from_arrays(
            [column(batch, "id").take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
             pa.array(crc)], ["id", "piece", "start", "length", "ids_crc32"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = picked.schema["id"].dataType.simpleString()
    return map_arrow(picked, run, f"id {key}, piece int, start bigint, length bigint, ids_crc32 bigint", rows=512)


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where items of each length go, for counts of items by length.

    Items of one length are alike, so the plan works on lengths: (length, first, last, bin, offset) sends the items of
    that length ranked first..last to the bins bin, bin+1, ... at that offset. Lengths above a third of the capacity fit
    twice in a bin at most: each, longest first, is matched with the longest such item that fits beside it. All others,
    longest first, go to the fullest bin that takes them, or open bins, which they fill by themselves. The work depends
    on the number of lengths, never on the number of items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[list[int]]] = {}  # room left: runs [first bin, bins]
    rooms: list[int] = []
    bins = 0

    def place(length: int, count: int, bin_: int, offset: int) -> None:
        plan.append((length, taken[length], taken[length] + count - 1, bin_, offset))
        taken[length] += count
        left[length] -= count

    def free(room: int, bin_: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in gaps:
                gaps[room] = []
                bisect.insort(rooms, room)
            gaps[room].append([bin_, count])

    def open_(length: int, count: int) -> int:
        nonlocal bins
        place(length, count, bins, 0)
        bins += count
        return bins - count

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            k = bisect.bisect_right(large, min(n, capacity - n)) - 1
            while k >= 0 and not left[large[k]]:
                k -= 1
            if k < 0:
                free(capacity - n, open_(n, c := left[n]), c)
                break
            m = large[k]
            count = left[n] // 2 if m == n else min(left[n], left[m])
            if not count:  # one item is left of this length: its partner is a shorter one
                k -= 1
                while k >= 0 and not left[large[k]]:
                    k -= 1
                if k < 0:
                    free(capacity - n, open_(n, 1), 1)
                    break
                m, count = large[k], 1
            at = open_(n, count)
            place(m, count, at, n)
            free(capacity - n - m, at, count)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect.bisect_left(rooms, n)
            if k == len(rooms):
                each = capacity // n
                count = left[n] // each
                if count:
                    at = bins
                    bins += count
                    for j in range(each):
                        place(n, count, at, j * n)
                    free(capacity - each * n, at, count)
                else:
                    free(capacity - n, open_(n, 1), 1)
                continue
            room = rooms[k]
            run = gaps[room][-1]
            count = min(left[n], run[1])
            place(n, count, run[0], capacity - room)
            free(room - n, run[0], count)
            run[0] += count
            run[1] -= count
            if not run[1]:
                gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                rooms.remove(room)
    return plan, bins


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one id; only longer documents are cut; repeated rows are packed each for
    itself; an empty table gives an empty result; other columns are not read. The literal of an added token, such as
    <|endoftext|>, gets that token's id, as the library gives it.

    The driver sees the number of pieces by length only (at most `capacity` numbers) and plans on these. Pieces are
    ranked within (length, task that made them), so no length gathers in one task however many pieces it has; a running
    sum over the tasks of a length turns that into a rank among all. They look up their place in the plan, whose size
    depends on the capacity alone; it is broadcast.
    """
    spark: SparkSession = docs.sparkSession
    pieces = token_pieces(docs, vocabulary, capacity, id_col, text_col)
    pieces = cut(pieces.withColumn("task", F.spark_partition_id()))  # written, so it stays what it is
    sums = cut(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = plan_bins(counts, capacity)
    places = spark.createDataFrame(plan or [(0, 0, -1, 0, 0)], "length long, first long, last long, bin long, offset long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    shift = cut(sums.select("length", "task", F.coalesce(before, F.lit(0)).alias("shift")))
    shift = F.broadcast(shift) if shift.count() <= BROADCAST_ROWS else shift
    order = Window.partitionBy("length", "task").orderBy("id", "piece", "ids_crc32")
    ranked = pieces.withColumn("row", F.row_number().over(order) - 1)
    ranked = ranked.join(shift, ["length", "task"]).withColumn("rank", F.col("row") + F.col("shift"))
    a, b = ranked.alias("a"), F.broadcast(places).alias("b")
    here = (F.col("a.length") == F.col("b.length")) & F.col("rank").between(F.col("first"), F.col("last"))
    return a.join(b, here).select(
        F.col("id").alias(id_col), "piece", "start", F.col("a.length").alias("length"), "ids_crc32",
        (F.col("bin") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
