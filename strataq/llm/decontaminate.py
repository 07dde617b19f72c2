"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, map_arrow, texts_of

WORD = re.compile(r"\w+")
MATCH, MISMATCH, GAP = 2, -1, -1
# Rows up to which the keys of leaks are broadcast; beyond, the same join shuffles.
BROADCAST_ROWS = 1_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Items:
    """Test items as word numbers, and where each of their n-grams stands."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.n = n
        self.vocab: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for key, text in rows:
            found = words_of(text)
            if len(found) >= n:
                self.items.append((key, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in found], np.int64)))
        codes, owner, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, (_, ids) in enumerate(self.items):
            c = self.codes(ids)
            codes.append(c)
            owner.append(np.full(len(c), i))
            place.append(np.arange(len(c)))
        code, owner, place = (np.concatenate(x) for x in (codes, owner, place))
        order = np.argsort(code, kind="stable")
        self.code, self.owner, self.place = code[order], owner[order], place[order]
        self.grams = np.unique(self.code)

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams: 64-bit mixes of word numbers, 0 where a word is in no item."""
        m = len(ids) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        h, known = np.zeros(m, np.uint64), np.ones(m, bool)
        for j in range(self.n):
            part = ids[j:j + m]
            h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            known &= part > 0
        h |= np.uint64(1)
        return np.where(known, h.view(np.int64), 0)

    def numbers(self, found: list[str]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(w, 0) for w in found), np.int64, len(found))

    def keep(self, rare: np.ndarray) -> None:
        """Index the seeds alone: `rare` tells it for each (item, n-gram) in the order of code."""
        self.code, self.owner, self.place = self.code[rare], self.owner[rare], self.place[rare]


def align(item: np.ndarray, part: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman by rows: the best local score over its greatest possible value, and the span in part."""
    m = len(part)
    steps = np.arange(m + 1)
    prev, prev_from = np.zeros(m + 1), steps.copy()
    best, span = 0.0, (0, 0)
    for w in item:
        diag = prev[:-1] + np.where(part == w, MATCH, MISMATCH)
        up = prev[1:] + GAP
        cur = np.zeros(m + 1)
        take = diag >= up
        cur[1:] = np.maximum(np.where(take, diag, up), 0)
        start = steps.copy()
        start[1:] = np.where(cur[1:] > 0, np.where(take, prev_from[:-1], prev_from[1:]), steps[1:])
        shifted = cur - GAP * steps
        run = np.maximum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == run, steps, 0))
        cur, start = run + GAP * steps, start[source]
        j = int(cur.argmax())
        if cur[j] > best:
            best, span = float(cur[j]), (int(start[j]), j)
        prev, prev_from = cur, start
    return best / (MATCH * len(item)), *span


def medians(owner: np.ndarray, values: np.ndarray, owners: int) -> np.ndarray:
    """The median of each owner's values, by one sort; 0 for an owner without any."""
    order = np.lexsort((values, owner))
    n = np.bincount(owner, minlength=owners)
    first = np.cumsum(n) - n
    values = np.append(values[order], 0.0)
    low, high = (np.where(n > 0, first + k, len(values) - 1) for k in ((n - 1) // 2, n // 2))
    return (values[low] + values[high]) / 2


def seed_windows(items: Items, ids: np.ndarray, slack: float) -> Iterator[tuple[int, int, int, int]]:
    """(item, first word, end word, seeds) of the passages around seeds; passages of an item that touch are one."""
    codes = items.codes(ids)
    at = np.flatnonzero(codes)
    if not len(at) or not len(items.code):
        return
    low = np.searchsorted(items.code, codes[at], "left")
    n = np.searchsorted(items.code, codes[at], "right") - low
    hit = np.flatnonzero(n)
    if not len(hit):
        return
    place = np.repeat(at[hit], n[hit])
    entry = np.repeat(low[hit], n[hit]) + np.arange(n[hit].sum()) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
    owner, start = items.owner[entry], place - items.place[entry]
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    sizes = np.array([len(x) for _, x in items.items])[owner]
    extra = np.ceil(slack * sizes).astype(np.int64) + items.n
    low, high = np.maximum(0, start - extra), np.minimum(len(ids), start + sizes + extra)
    i = 0
    while i < len(owner):
        j, end = i + 1, high[i]
        while j < len(owner) and owner[j] == owner[i] and low[j] <= end:
            end = max(end, high[j])
            j += 1
        yield int(owner[i]), int(low[i]), int(end), j - i
        i = j


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", n: int = 3, rare_times: float = 3.0, rare_floor: int = 3, slack: float = 0.5,
               least: float = 0.5, words_at_once: int = 1_000_000) -> DataFrame:
    """Pairs of a document and a test item that it holds, whole or edited: id_col, item_col, score, first_word,
    end_word, n_seeds; one row for each pair of rows, with the best passage.

    score is the Smith-Waterman score over that of a perfect copy; `least` and above is a leak. Words are lower-case runs
    of word characters. Null and empty texts, and items of fewer than n words, match nothing; equal items are found each;
    repeated documents give repeated rows; an empty table on either side gives an empty result.

    Seeds are n-grams of an item that are rare among the documents: held by no more than `rare_times` the median of that
    item's n-grams or `rare_floor` documents. The rule is relative, so an item that leaked everywhere keeps its seeds.
    Items are taken `words_at_once` words at a time, which bounds what is broadcast; each lot is one more scan.
    """
    given = items.select(F.col(item_col).alias("k"), F.col(item_text_col).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    sizes = given.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    lots = max(1, -(-int(sizes) // (4 * words_at_once)))
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type, item_type = (x.dataType.simpleString() for x in (picked.schema["id"], given.schema["k"]))
    found = None
    for lot in range(lots):
        rows = given.where(F.pmod(F.xxhash64("k", "t"), F.lit(lots)) == lot).orderBy("k", "t").collect()
        index = Items([(r["k"], r["t"]) for r in rows], n)
        one = leaks_of(picked, index, rare_times, rare_floor, slack, least, id_type, item_type)
        found = one if found is None else found.unionByName(one)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def leaks_of(docs: DataFrame, index: Items, rare_times: float, rare_floor: int, slack: float, least: float, id_type: str,
             item_type: str) -> DataFrame:
    context = docs.sparkSession.sparkContext
    all_grams = context.broadcast(index)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = all_grams.value
        seen = [np.unique(items.codes(items.numbers(words_of(t)))) for t in texts_of(batch)]
        gram, times = np.unique(np.concatenate([np.zeros(0, np.int64), *seen]), return_counts=True)
        known = np.isin(gram, items.grams)
        return pa.RecordBatch.from_arrays([pa.array(gram[known]), pa.array(times[known].astype(np.int64))], ["gram", "n"])

    totals = map_arrow(docs.select("text"), count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    totals = totals.sort_values("gram")
    gram, times = np.append(totals["gram"].to_numpy(np.int64), 0), np.append(totals["n"].to_numpy(np.float64), 0.0)
    at = np.searchsorted(gram[:-1], index.code)
    df = np.where(gram[at] == index.code, times[at], 0.0)
    index.keep(df <= np.maximum(rare_floor, rare_times * medians(index.owner, df, len(index.items))[index.owner]))
    seeds = context.broadcast(index)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = seeds.value
        out = []
        for i, text in enumerate(texts_of(batch)):
            ids = items.numbers(words_of(text))
            best: dict[int, tuple] = {}
            for item, low, high, n in seed_windows(items, ids, slack):
                words = items.items[item][1]
                if MATCH * np.isin(words, ids[low:high]).sum() < least * MATCH * len(words):
                    continue  # even all its words in order would score too little
                score, a, b = align(words, ids[low:high])
                if score >= least and (item not in best or score > best[item][0]):
                    best[item] = (score, low + a, low + b, n)
            out += [(i, items.items[item][0], *x) for item, x in sorted(best.items())]
        at, item, score, a, b, n = zip(*out) if out else ((),) * 6
        names = ["id", "item", "score", "first_word", "end_word", "n_seeds"]
        return pa.RecordBatch.from_arrays(
            [column(batch, "id").take(pa.array(at, pa.int64())), pa.array(item, pa.string() if item_type == "string" else pa.int64()),
             pa.array(score, pa.float64()), *(pa.array(x, pa.int64()) for x in (a, b, n))], names)

    item = item_type if item_type in ("string", "bigint") else "bigint"
    return map_arrow(docs, run, f"id {id_type}, item {item}, score double, first_word long, end_word long, n_seeds long")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, all columns, without the rows whose text holds a test item.

    Rows are judged by their text, not by id: of rows with one id only those that hold an item go, each of several
    repeated rows alike, and a null id is an id like any other. Null and empty texts stay; an empty table gives an empty
    result, no items leave docs as it is, and extra columns are carried along.
    """
    names = set(docs.columns)
    key = next(k for k in (f"_row{i}" for i in range(len(names) + 1)) if k not in names)
    # Row keys are 128 bits of id and text; the texts are joined by broadcast where leaks are counted to be few.
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    keyed = docs.withColumn(key, F.unhex(F.md5(F.concat_ws(":", F.length(name), name, F.col(text_col)))))
    bad = cut(find_leaks(keyed, items, id_col=key, text_col=text_col, **how).select(F.col(key)).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return keyed.join(bad, key, "left_anti").select(*docs.columns)
