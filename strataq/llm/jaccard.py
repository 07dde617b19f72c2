"""N-gram Jaccard join with set-relation skipping, and its connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, cuts_so_far, drop_cuts, map_arrow, parallelism, ship_package, trimmed
from .shingles import shingle_sets

# Rows up to which a table of fixed-width rows is broadcast; beyond, the same join shuffles.
BROADCAST_ROWS = 1_000_000
# Sets of an index list beyond which no task takes it whole.
LONG_LIST = 4096


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of sets of a and b elements that link: 100 * i >= 80 * (a + b - i)."""
    return (4 * (a + b) + 8) // 9


def prefix_size(n: int) -> int:
    """Linked sets share one of so many first elements, in any order that is the same for all sets."""
    return n - (4 * n + 4) // 5 + 1


def held_in(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def sign(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def frequent(docs: DataFrame, sample_one_in: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Shingles that `least` of the sampled documents hold, and the hot ones among them: sorted, `most` at most; and
    whether hot ones may be missing for that bound.

    They go last in the order of elements. Any order gives the same links; this one keeps passages that many documents
    share out of the prefixes. So neither the sample nor the bound loses anything.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(column(batch, "text").to_pylist())
        gram, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(sign(gram)), pa.array(n.astype(np.int32))], ["gram", "n"])

    sample = docs.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(sample_one_in)) == 0).select("text")
    counts = cut(map_arrow(sample, run, "gram long, n int", rows=256).groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    sizes = counts.groupBy(F.least("n", F.lit(1_000_000)).alias("n")).agg(F.count("*").alias("many")).orderBy(F.desc("n"))
    total, floor = 0, 1_000_001
    for r in sizes.toLocalIterator():
        total += r["many"]
        if total > most:
            break
        floor = r["n"]
    got = counts.where(F.col("n") >= floor).toArrow() if floor <= 1_000_000 else counts.limit(0).toArrow()
    gram = got.column("gram").to_numpy().view(np.uint64)
    n = got.column("n").to_numpy()
    return np.sort(gram), np.sort(gram[n * sample_one_in > LONG_LIST]), floor * sample_one_in > LONG_LIST


def signatures(docs: DataFrame, heavy: np.ndarray, hot: np.ndarray) -> DataFrame:
    """id, k, n (set size), digest of the set, tokens (its prefix), n_cool (tokens before the hot ones) and share (of
    frequent tokens in the set, in thousandths)."""
    known = docs.sparkSession.sparkContext.broadcast((heavy, hot))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        heavy, hot = known.value
        sizes, digests, tokens, cool, share = [], [], [], [], []
        for s in shingle_sets(column(batch, "text").to_pylist()):
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            if not len(s):
                tokens.append(s.view(np.int64))
                cool.append(0)
                share.append(0)
                continue
            late = held_in(s, heavy)
            late_hot = late & held_in(s, hot)
            order = np.concatenate([s[~late], s[late & ~late_hot], s[late_hot]])[:prefix_size(len(s))]
            tokens.append(order.view(np.int64))
            cool.append(min(len(order), int((~late_hot).sum())))
            share.append(1000 * int(late.sum()) // len(s))
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *tokens])))
        return pa.RecordBatch.from_arrays(
            [column(batch, "id"), column(batch, "k"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists,
             pa.array(cool, pa.int32()), pa.array(share, pa.int32())], ["id", "k", "n", "digest", "tokens", "n_cool", "share"])

    return map_arrow(docs, run, "id long, k long, n long, digest binary, tokens array<long>, n_cool int, share int", rows=256)


def list_pairs(tok: np.ndarray, n: np.ndarray, rep: np.ndarray, pos: np.ndarray, share: np.ndarray, short: int):
    """Candidate pairs of whole index lists, sorted by (tok, n, rep), and (set, centre) for the rows of long lists.

    A list is skipped in blocks: entries are in order of set size, so the partners of a set end where sizes get too
    large, and a pair is passed over where the positions leave too few elements to share. Lists of up to `short` sets
    give all their pairs. A longer list gives each set with the list's centre: the set with the largest share of frequent
    tokens, which has the least of its own. What else links in it is decided by centre, in open_groups.
    """
    start = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
    size = np.diff(np.r_[start, len(tok)])
    of = np.repeat(np.arange(len(start)), size)
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left = np.flatnonzero(((size > 1) & (size <= short))[of])
    for step in range(1, int(size[size <= short].max(initial=1))):
        left = left[left + step < len(tok)]
        left = left[of[left] == of[np.minimum(left + step, len(tok) - 1)]]
        left = left[5 * n[left] >= 4 * n[left + step]]
        one.append(left)
        two.append(left + step)
    a, b = np.concatenate(one), np.concatenate(two)
    fits = np.minimum(n[a] - pos[a], n[b] - pos[b]) >= needed(n[a], n[b])
    member, centre = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.flatnonzero(size > short):
        rows = np.arange(start[k], start[k] + size[k])
        best = rows[np.lexsort((rep[rows], -share[rows]))[0]]
        member.append(rep[rows])
        centre.append(np.full(len(rows), rep[best]))
    return rep[a[fits]], rep[b[fits]], np.concatenate(member), np.concatenate(centre)


def candidates(index: DataFrame, short: int) -> DataFrame:
    """From index rows (tok, n, rep, pos, share): (a, b, of_centre), where a is a centre if of_centre."""
    ship_package(index.sparkSession)
    names = ("tok", "n", "rep", "pos", "share")

    def emit(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        a, b, member, centre = list_pairs(*cols, short)
        rows = np.concatenate([np.stack([a, b, np.zeros_like(a)], 1), np.stack([centre, member, np.ones_like(member)], 1)])
        if not len(rows):
            return None
        rows = np.unique(rows, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2] > 0)], ["a", "b", "of_centre"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in names]
        for batch in batches:
            cols = [np.concatenate([h, column(batch, c).to_numpy()]) for h, c in zip(held, names)]
            key = cols[0]
            last = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1] if len(key) else 0
            if last and (out := emit([c[:last] for c in cols])) is not None:
                yield out
            held = [c[last:] for c in cols]
        if len(held[0]) and (out := emit(held)) is not None:
            yield out

    return index.mapInArrow(trimmed(run), "a long, b long, of_centre boolean")


def hot_candidates(index: DataFrame) -> DataFrame:
    """The same for lists of hot tokens, which no task takes whole: their centres are found by partial maxima."""
    best = index.groupBy("tok").agg(F.max(F.struct("share", (-F.col("rep")).alias("least"))).alias("best"))
    best = cut(best.select("tok", (-F.col("best.least")).alias("centre")))
    small = best.count() <= BROADCAST_ROWS
    rows = index.select("tok", "rep").join(F.broadcast(best) if small else best, "tok")
    return rows.select(F.col("centre").alias("a"), F.col("rep").alias("b"), F.lit(True).alias("of_centre")).distinct()


def sets_of(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list]]:
    """id, set and todo of each row, a few texts at a time."""
    for at in range(0, batch.num_rows, 16):
        part = batch.slice(at, 16)
        found = shingle_sets(column(part, "text").to_pylist())
        for i, s, todo in zip(column(part, "id").to_pylist(), found, column(part, "todo").to_pylist()):
            yield i, s.tobytes(), todo


def in_lots(rows: Iterator[tuple], names: list[str], kinds: tuple[pa.DataType, ...], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of rows that end with bytes, each of about `most` bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 64
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def overlaps(docs: DataFrame, pairs: DataFrame, per_task: int = 256) -> DataFrame:
    """(a, b, shared, n_a, n_b) of pairs of document ids: exact intersections of their whole sets.

    Set a is sent once to each lot of `per_task` partners, set b once for each pair.
    """
    pairs = pairs.select("a", "b").distinct()
    lots = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_task).cast("int").alias("lots"))
    dealt = cut(pairs.join(lots, "a").withColumn("lot", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int")).select("a", "b", "lot"))
    tasks = dealt.select(F.col("b").alias("id"), "a", "lot").unionByName(
        dealt.select(F.col("a").alias("id"), "a", "lot").distinct())
    tasks = tasks.groupBy("id").agg(F.collect_list(F.struct("a", "lot")).alias("todo"))
    small = 2 * dealt.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(tasks) if small else tasks, "id").select("id", "text", "todo")

    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = ((t["a"], t["lot"], int(t["a"] != i), i, s) for i, s, todo in sets_of(batch) for t in todo)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        yield from in_lots(rows, ["a", "lot", "role", "b", "set"], kinds)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, one = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, lot, role, b, raw in zip(*(column(batch, c) for c in ("a", "lot", "role", "b", "set"))):
                a, lot, s = a.as_py(), lot.as_py(), np.frombuffer(raw.as_buffer(), np.uint64)
                if not role.as_py():
                    key, one = (a, lot), s.copy()
                elif key == (a, lot):
                    less, more = (one, s) if len(one) < len(s) else (s, one)
                    out.append((a, b.as_py(), int(held_in(less, more).sum()), len(one), len(s)))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "shared", "n_a", "n_b"])

    rows = map_arrow(texts, sets, "a long, lot int, role int, b long, set binary", rows=128)
    rows = rows.repartition(parallelism(docs.sparkSession), "a", "lot").sortWithinPartitions("a", "lot", "role")
    return cut(rows.mapInArrow(trimmed(meet), "a long, b long, shared long, n_a long, n_b long"))


def links(found: DataFrame) -> DataFrame:
    return found.where("100 * shared >= 80 * (n_a + n_b - shared)").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component: minimum labels, halving paths in every round."""
    spark = edges.sparkSession
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    small = both.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(hint(labels), both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = cut(low.join(hint(jump), F.col("low") == F.col("at"), "left").select(
            "node", F.least("low", "further").alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        done = cuts_so_far(spark)
        drop_cuts(spark, done - 2, done - 1)  # the labels of the round before: nothing reads them any more
        if not changed:
            return labels


def open_groups(docs: DataFrame, members: DataFrame, labels: DataFrame, found: DataFrame, block_bytes: int) -> DataFrame:
    """Links that long lists leave open: edges (a, b), no more of them than join components.

    members holds (centre, rep, n); two sets of one long list have its centre in common. Only sets that are not in the
    centre's component are looked up, among all sets of that centre, and links are found from postings of whole sets. A
    set is skipped if the answers of the centre rule its links out: x and y share at most
    min(x & c, y & c) + min(x - c, y - c) elements. The sets of a centre are dealt in blocks of about `block_bytes`, and
    those to look up in lots of the same size: a task holds one of each, and what is sent grows with the sets to look up
    and not with all pairs of blocks.
    """
    lab = labels.select(F.col("node").alias("rep"), "label")
    rows = members.join(lab, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    own = labels.select(F.col("node").alias("centre"), F.col("label").alias("own"))
    rows = rows.join(own, "centre", "left").withColumn("own", F.coalesce("own", "centre"))
    known = found.select(F.col("a").alias("centre"), F.col("b").alias("rep"), "shared")
    rows = rows.join(known, ["centre", "rep"], "left").withColumn("outside", F.col("label") != F.col("own"))
    rows = cut(rows.select("centre", "rep", "n", "label", "outside", F.coalesce("shared", F.lit(-1)).cast("long").alias("shared")))
    parts = lambda n: F.ceil(8 * F.sum(n) / block_bytes).cast("int")
    size = rows.groupBy("centre").agg(F.bool_or("outside").alias("open"), parts("n").alias("blocks"),
                                      parts(F.when(F.col("outside"), F.col("n"))).alias("lots"))
    rows = rows.join(size.where("open").select("centre", "blocks", "lots"), "centre")
    deal = lambda n: F.pmod(F.xxhash64("rep", F.lit(n)), F.col(n)).cast("int")
    rows = rows.withColumns({"block": deal("blocks"), "lot": deal("lots")})
    fields = ("centre", "label", "outside", "shared", "block", "lot", "blocks", "lots")
    tasks = cut(rows.groupBy("rep").agg(F.collect_list(F.struct(*fields)).alias("todo")))
    small = tasks.count() <= BROADCAST_ROWS
    tasks = tasks.withColumnRenamed("rep", "id")
    texts = docs.join(F.broadcast(tasks) if small else tasks, "id").select("id", "text", "todo")

    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = ((t["centre"], i, j, asked, rep, t["label"], t["shared"], s)
                for rep, s, todo in sets_of(batch) for t in todo
                for i, j, asked in [*((t["block"], j, False) for j in range(t["lots"])),
                                    *((i, t["lot"], True) for i in range(t["blocks"] if t["outside"] else 0))])
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield from in_lots(rows, ["centre", "i", "j", "asked", "rep", "label", "shared", "set"], kinds)

    dealt = map_arrow(texts, sets, "centre long, i int, j int, asked boolean, rep long, label long, shared long, set binary", rows=128)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        rep, label, shared, asked = (t.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "label", "shared", "asked"))
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
        edges = group_links(raw, rep, label, shared, asked)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return dealt.groupBy("centre", "i", "j").applyInArrow(run, "a long, b long")


def group_links(sets: list[np.ndarray], rep: np.ndarray, label: np.ndarray, shared: np.ndarray, asked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the components of linked sets, for every link of an asked set with one that isn't asked; each
    edge joins two components."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    held = np.flatnonzero(~asked)
    flat = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in held)])
    owner = np.repeat(held, n[held])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for x in np.flatnonzero(asked):
        least = needed(n[x], n)
        fits = (5 * np.minimum(n[x], n) >= 4 * np.maximum(n[x], n)) & (label != label[x]) & ~asked
        if shared[x] >= 0:
            bound = np.minimum(shared[x], shared) + np.minimum(n[x] - shared[x], n - shared)
            fits &= (shared < 0) | (bound >= least)
        if not fits.any():
            continue
        low, high = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
        size = high - low
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        count = np.bincount(owner[at], minlength=len(sets))
        for y in np.flatnonzero(fits & (count >= least)).tolist():
            a, b = root(int(label[x])), root(int(label[y]))
            if a != b:
                parent[a] = b
                edges.append((int(min(rep[x], rep[y])), int(max(rep[x], rep[y]))))
    return edges


def grouped(docs: DataFrame, sample_one_in: int = 4, least: int = 3, most_frequent: int = 1_000_000, short: int = 32,
            block_bytes: int = 2_000_000) -> DataFrame:
    """id, k, n, g (a name of the group) and component of docs' rows (id, text, k = a hash of both); see similar_groups."""
    heavy, hot, unsure = frequent(docs, sample_one_in, least, most_frequent)
    signed = cut(signatures(docs, heavy, hot))
    # Sets are known by their id, or by k where rows of one id have different sets.
    mixed = signed.where("id IS NOT NULL").groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    mixed = cut(mixed.where("low <> high").select("id", F.lit(True).alias("mixed")))
    several = mixed.limit(1).count() > 0

    def keyed(df: DataFrame) -> DataFrame:
        if not several:
            return df.withColumn("key", F.col("id"))
        return df.join(mixed, "id", "left").withColumn("key", F.when(F.col("mixed"), F.col("k")).otherwise(F.col("id"))).drop("mixed")

    texts = keyed(docs).select(F.col("key").alias("id"), "text")
    some = keyed(signed.where("n > 0"))
    reps = some.groupBy("digest").agg(F.min("key").alias("rep"), *(F.first(c).alias(c) for c in ("n", "tokens", "n_cool", "share")))
    index = reps.where("rep IS NOT NULL").select("rep", "n", "n_cool", F.col("share").cast("long").alias("share"), F.posexplode("tokens").alias("pos", "tok"))
    lists = index.where("pos < n_cool").select("tok", "n", "rep", F.col("pos").cast("long").alias("pos"), "share")
    hot_rows = index.where("pos >= n_cool").select("tok", "rep", "share") if len(hot) else None
    if unsure:  # more hot shingles than are known to all: lists are counted, and the long ones go the same way
        long = cut(lists.groupBy("tok").agg(F.count("*").alias("rows")).where(F.col("rows") > LONG_LIST).select("tok"))
        few = long.count() <= BROADCAST_ROWS
        moved = lists.join(F.broadcast(long) if few else long, "tok").select("tok", "rep", "share")
        lists = lists.join(F.broadcast(long) if few else long, "tok", "left_anti")
        hot_rows = moved if hot_rows is None else hot_rows.unionByName(moved)
    lists = lists.repartition(parallelism(docs.sparkSession), "tok").sortWithinPartitions("tok", "n", "rep")
    made = candidates(lists, short)
    if hot_rows is not None:
        made = made.unionByName(hot_candidates(hot_rows))
    made = cut(made)
    first = overlaps(texts, made.where("a <> b").select("a", "b"))
    edges = links(first)
    labels = components(edges)
    members = made.where("of_centre").select(F.col("a").alias("centre"), F.col("b").alias("rep")).distinct()
    members = members.join(some.groupBy("digest").agg(F.min("key").alias("rep"), F.first("n").alias("n")).select("rep", "n"), "rep")
    more = cut(open_groups(texts, members, labels, first, block_bytes))
    if more.limit(1).count():
        labels = components(edges.unionByName(more))
    names = cut(some.groupBy("digest").agg(F.min("key").alias("rep"))).join(
        labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component"))
    if several:  # labels are keys then: the smallest id of each
        names = cut(names)
        low = some.join(names, "digest").groupBy("component").agg(F.min("id").alias("low"))
        names = names.join(low, "component")
    else:
        names = names.withColumn("low", F.col("component"))
    full = F.col("n") > 0
    return signed.select("id", "k", "n", "digest").join(names, "digest", "left").select(
        "id", "k", "n", F.when(full, F.col("component")).otherwise(F.col("k")).alias("g"), F.when(full, F.col("low")).otherwise(F.col("id")).alias("component"))


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    whole = F.col(id_col).try_cast("long")
    kind = docs.schema[id_col].dataType.simpleString()
    assert kind in ("tinyint", "smallint", "int", "bigint"), f"ids are whole numbers, not {kind}"
    return docs.select(whole.alias("id"), F.col(text_col).alias("text"), F.xxhash64(whole, text_col).alias("k"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """id_col, n_shingles and component_id: the smallest id that links of Jaccard similarity 0.8 and more reach.

    Sets are all distinct 5-word shingles of the whole text, as 64-bit hashes: among m shingles some two share a hash
    with a chance of m * m / 2^65, and a link changes only if that befalls the sets of one pair next to the threshold.
    Equal sets are taken together first by 128 bits, and only one of them is joined on. Null and empty texts have no
    shingles, link with nothing and are components of their own; a row with a null id takes its component from others or
    has none; repeated rows share a component, and rows of one id with different texts are judged each by its text; an
    empty table gives an empty result; other columns are not read. Ids are whole numbers.

    Every pair of linked sets of different content meets in a list of their prefixes (see prefix_size). In a short list
    (`short` sets) all pairs are compared. In a long one each set is compared with the list's centre, and those that
    don't end up in its component are looked up among all sets of that centre: no link is lost to the size of a list.
    """
    found = grouped(rows_of(docs, id_col, text_col), **how)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, all columns, with one row of each group of near duplicates: that with the smallest id.

    Rows are judged one by one: of rows with one id and different texts each goes or stays by its own text, and where
    several of a group have its smallest id, that with the smallest hash of the text stays. Rows that repeat both id and
    text are one row, empty texts included. Null and empty texts else link with nothing and stay, and so does every row
    with a null id. An empty table gives an empty result; columns may have any names.
    """
    names = docs.columns
    id_, k = (next(c for c in (f"{x}{i}" for i in range(len(names) + 1)) if c not in names) for x in ("_id", "_k"))
    found = cut(grouped(rows_of(docs, id_col, text_col), **how).where("id IS NOT NULL").select("id", "k", "g", "component"))
    heads = found.where("id = component").groupBy("id", "g").agg(F.min("k").alias("least"), F.count("*").alias("rows"))
    heads = cut(heads.where("rows > 1"))  # the group's smallest id stands in more than one row
    other = found.join(heads, ["id", "g"]).where("id = component AND k <> least").select("id", "k")
    gone = found.where("id <> component").select("id", "k").unionByName(other).distinct()
    whole = F.col(id_col).cast("long")
    keyed = docs.withColumns({id_: whole, k: F.xxhash64(whole, text_col)})
    kept = keyed.join(gone.toDF(id_, k), [id_, k], "left_anti")
    if heads.limit(1).count():
        again = heads.select("id", F.col("least").alias("k")).toDF(id_, k)
        kept = kept.join(again, [id_, k], "left_anti").unionByName(kept.join(again, [id_, k], "left_semi").dropDuplicates([id_, k]))
    return kept.select(*names)


def brute_force(ids: list[int], texts: list[str | None]) -> dict[int, tuple[int, int]]:
    """id -> (n_shingles, component_id), by all pairs of literal word tuples; for tests."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(ids)
    changed = True
    linked = [(i, j) for i in range(len(ids)) for j in range(i)
              if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return {d: (len(s), c) for d, s, c in zip(ids, sets, label)}
