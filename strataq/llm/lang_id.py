"""Language ID: segmentation-marginalised unigrams over the pieces of a public vocabulary."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, map_arrow, release_memory, ship_package, texts_of

WORD = re.compile(r"[^\W\d_]+")
LATTICE_WORD = 40  # longer words are summed letter by letter, not in lattices
LOT = 64  # languages scored at a time
FIT_WORDS = 4096  # words in a lattice at a time when a language is learned
PRIME = np.uint64(0x9E3779B97F4A7C15)
SCALE = 64.0  # a character's share, so that products of probabilities stay in a double's range


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters, of any length."""
    return WORD.findall(text.lower())


def code_points(words: list[str], width: int) -> np.ndarray:
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


class Vocabulary:
    """Pieces of letters only, found by a hash of their code points; '^' stands for the start of a word."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {sp.id_to_piece(i).lower().replace("▁", "^") for i in range(sp.get_piece_size())}
        names = {p for p in names if p.lstrip("^").isalpha() and p.count("^") <= 1}
        self.pieces = sorted(names)
        self.longest = max(map(len, names), default=1)
        hashes = [self.hash(code_points([p], len(p)))[0] for p in self.pieces]
        order = np.argsort(np.array(hashes, np.uint64))
        self.keys, self.ids = np.array(hashes, np.uint64)[order], order.astype(np.int32)
        self.bits = 20
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.slots[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = np.arange(len(self.keys), dtype=np.int32)

    @staticmethod
    def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h ^ c.astype(np.uint64)) * PRIME
        return h ^ (h >> np.uint64(29))

    @classmethod
    def hash(cls, codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            h = cls.step(h, codes[:, j])
        return cls.final(h)

    @staticmethod
    def final(h: np.ndarray) -> np.ndarray:
        return h * np.uint64(0xD6E8FEB86659FD93)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers for hashes, -1 where there is none. Two pieces in one slot leave the second to a search."""
        h = self.final(h)
        at = self.slots[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        hit = np.flatnonzero(at >= 0)
        got = np.full(len(h), -1, np.int32)
        k = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
        same = self.keys[k] == h[hit]
        got[hit[same]] = self.ids[k[same]]
        return got


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """All segmentations of some words: for each length of word, the piece number of every (start, size)."""

    def __init__(self, vocab: Vocabulary, words: list[str]):
        self.n, self.longest, self.groups = len(words), vocab.longest, []
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for rows in np.split(order, cuts) if len(words) else []:
            width = int(sizes[rows[0]])
            codes = code_points(["^" + words[i] for i in rows], width)
            arcs = {}
            for size in range(1, min(width, self.longest) + 1):
                for start in range(width - size + 1):
                    h = prefix[start] if size > 1 else np.zeros(len(rows), np.uint64)  # noqa: F821
                    if size == 1:
                        if start == 0:
                            prefix = {}
                        prefix[start] = h
                    prefix[start] = vocab.step(prefix[start], codes[:, start + size - 1])
                    ids = vocab.find(prefix[start])
                    if size == 1 or (ids >= 0).any():
                        arcs[start, size] = ids
            self.groups.append((rows, width, arcs))

    def forward(self, probs: np.ndarray, floor: float, keep: bool = False):
        """Log of the summed probability of all segmentations, a column for each language.

        A character that is no piece counts as one of probability `floor`.
        """
        out = np.zeros((self.n, probs.shape[1]))
        table = np.concatenate([probs, np.zeros((1, probs.shape[1]))])  # -1 finds the last row
        alphas = []
        for rows, width, arcs in self.groups:
            alpha = np.zeros((width + 1, len(rows), probs.shape[1]))
            alpha[0] = 1
            for end in range(1, width + 1):
                for size in range(1, min(end, self.longest) + 1):
                    ids = arcs.get((end - size, size))
                    if ids is not None:
                        p = table[ids] * SCALE ** size
                        if size == 1:
                            p = np.maximum(p, floor * SCALE)
                        alpha[end] += alpha[end - size] * p
            out[rows] = np.log(alpha[width]) - width * np.log(SCALE)
            if keep:
                alphas.append(alpha)
        return (out, alphas) if keep else out

    def expected(self, probs: np.ndarray, floor: float, weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language, words weighted by `weights` (words x languages)."""
        _, alphas = self.forward(probs, floor, keep=True)
        table = np.concatenate([probs, np.zeros((1, probs.shape[1]))])
        uses = np.zeros_like(table)
        for (rows, width, arcs), alpha in zip(self.groups, alphas):
            beta = np.zeros_like(alpha)
            beta[width] = 1
            for start in range(width - 1, -1, -1):
                for size in range(1, min(width - start, self.longest) + 1):
                    ids = arcs.get((start, size))
                    if ids is None:
                        continue
                    p = table[ids] * SCALE ** size
                    used = alpha[start] * p * beta[start + size] / alpha[width] * weights[rows]
                    for k in range(probs.shape[1]):
                        uses[:, k] += np.bincount(np.where(ids < 0, len(probs), ids), used[:, k], len(table))
                    if size == 1:
                        p = np.maximum(p, floor * SCALE)
                    beta[start] += p * beta[start + size]
        return uses[:-1]


def long_word(vocab: Vocabulary, word: str, probs: np.ndarray, floor: float, block: int = 512) -> np.ndarray:
    """What Lattice.forward gives for one word of any length, with a window of sums as long as the longest piece.

    Pieces are looked up for `block` places at a time, and the window is scaled anew before it leaves a double's range.
    """
    reach, kinds = vocab.longest, probs.shape[1]
    codes = code_points(["^" + word], len(word) + 1)[0]
    table = np.concatenate([probs, np.zeros((1, kinds))])
    scales = SCALE ** np.arange(1, reach + 1)[:, None]
    sums, log = np.zeros((reach, kinds)), np.zeros(kinds)  # the last `reach` sums, the latest first
    sums[0] = 1
    for low in range(0, len(codes), block):
        high = min(low + block, len(codes))
        first = max(0, low - reach + 1)
        ids = np.full((high - low, reach), -1, np.int32)  # of pieces by last letter and size
        h = np.zeros(high - first, np.uint64)
        for size in range(1, reach + 1):
            h = vocab.step(h[:high - first - size + 1], codes[first + size - 1:high])
            last = np.arange(first + size - 1, high) - low
            ids[last[last >= 0], size - 1] = vocab.find(h)[last >= 0]
        p = table[ids] * scales
        p[:, 0] = np.maximum(p[:, 0], floor * SCALE)
        for k, row in enumerate(p):
            total = (sums * row).sum(0)
            sums[1:] = sums[:-1]
            sums[0] = total
            if k % 16 == 15:
                top = sums.max(0)
                sums /= top
                log += np.log(top)
    return np.log(sums[0]) + log - len(codes) * np.log(SCALE)


@dataclass
class Model:
    """Languages in order, and of each the pieces that its texts use; any other piece has the probability `rest`."""

    languages: list[str]
    rest: list[float]
    ids: list[np.ndarray]
    probs: list[np.ndarray]
    path: str
    floor: float = 1e-7

    def lots(self, words: list[str], most: int = LOT):
        """Log probabilities of the words, a column for each language, `most` languages at a time."""
        vocab = vocabulary(self.path)
        long = [i for i, w in enumerate(words) if len(w) > LATTICE_WORD]
        lattice = Lattice(vocab, [w for w in words if len(w) <= LATTICE_WORD])
        short = np.setdiff1d(np.arange(len(words)), long)
        for at in range(0, len(self.languages), most):
            own = range(at, min(at + most, len(self.languages)))
            probs = np.empty((len(vocab.pieces), len(own)))
            for k, i in enumerate(own):
                probs[:, k] = self.rest[i]
                probs[self.ids[i], k] = self.probs[i]
            out = np.empty((len(words), len(own)))
            out[short] = lattice.forward(probs, self.floor)
            for i in long:
                out[i] = long_word(vocab, words[i], probs, self.floor)
            yield out


def count_words(texts: list[str]) -> dict[str, int]:
    """How often each word stands in some texts; one of over LATTICE_WORD letters in parts of that length."""
    counts: dict[str, int] = {}
    for text in texts:
        for w in words_of(text):
            for at in range(0, len(w), LATTICE_WORD):
                part = w[at:at + LATTICE_WORD]
                counts[part] = counts.get(part, 0) + 1
    return counts


def fit_one(counts: dict[str, int], path: str, rounds: int = 4, prior: float = 0.05, floor: float = 1e-7):
    """Piece probabilities of one language: expectation maximisation over all segmentations of its words.

    Gives the probability of pieces not in use, the pieces in use and their probabilities. A word of over LATTICE_WORD
    letters is learned from in parts of that length; it is scored whole.
    """
    vocab = vocabulary(path)
    size = max(1, len(vocab.pieces))
    probs, uses, total = np.full((len(vocab.pieces), 1), 1 / size), np.zeros((len(vocab.pieces), 1)), float(size)
    if counts:
        words, weights = list(counts), np.array(list(counts.values()), np.float64)[:, None]
        for _ in range(rounds):
            uses = np.zeros_like(probs)
            for at in range(0, len(words), FIT_WORDS):  # lattices are built anew, so that one is held at a time
                uses += Lattice(vocab, words[at:at + FIT_WORDS]).expected(probs, floor, weights[at:at + FIT_WORDS])
            total = (uses + prior).sum()
            probs = (uses + prior) / total
    ids = np.flatnonzero(uses[:, 0]).astype(np.int32)
    return (prior / total if counts else 1 / size), ids, probs[ids, 0]


def fit(sample: DataFrame, path: str) -> Model:
    """A model of every language in the sample (text, lang): each is learned by itself, in a task's memory.

    Words are counted where the texts are, with partial sums; a language's task gets its different words and their counts.
    A language without any word has one row of an empty word.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple[str, str, int]] = []
        langs, texts = column(batch, "lang").to_pylist(), texts_of(batch)
        for lang in sorted(set(langs)):
            counts = count_words([t for t, of in zip(texts, langs) if of == lang])
            rows += [(lang, w, n) for w, n in counts.items()] + [(lang, "", 0)]
        lang, word, n = zip(*rows) if rows else ((),) * 3
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    def learn(table: pa.Table) -> pa.Table:
        try:
            counts = dict(sorted((w, n) for w, n in zip(table["word"].to_pylist(), table["n"].to_pylist()) if w))
            rest, ids, probs = fit_one(counts, path)
        finally:
            release_memory()
        return pa.table({"lang": table["lang"].cast(pa.string())[:1], "rest": pa.array([rest], pa.float64()),
                         "ids": pa.array([ids.tobytes()], pa.binary()), "probs": pa.array([probs.tobytes()], pa.binary())})

    ship_package(sample.sparkSession)
    counted = map_arrow(sample.select("text", "lang"), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = counted.groupBy("lang").applyInArrow(learn, "lang string, rest double, ids binary, probs binary")
    rows = sorted(found.collect(), key=lambda r: r["lang"])
    return Model([r["lang"] for r in rows], [r["rest"] for r in rows], [np.frombuffer(r["ids"], np.int32) for r in rows],
                 [np.frombuffer(r["probs"], np.float64) for r in rows], path)


def sample_by_language(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held: int, most: int):
    """At most `most` labelled documents of each language, by hash of the id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("fold", F.pmod(F.crc32(F.col("id").cast("string")), F.lit(folds)))
    rows = rows.where((F.coalesce("fold", F.lit(-1)) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    names = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # Hashes are even, so the smallest `most` are among those below four times their share: a sort of a bounded table.
    ids = rows.select("id", "lang", F.pmod(F.xxhash64("id"), F.lit(1 << 32)).alias("mix")).join(F.broadcast(names), "lang")
    ids = ids.where(F.col("mix").cast("double") * F.col("n") < F.lit(4.0 * most * (1 << 32)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mix", "id"))
    ids = ids.withColumn("rank", rank).where(F.col("rank") <= most).select("id", "lang").distinct()
    return rows.select("id", "text", "lang").join(F.broadcast(ids), ["id", "lang"], "left_semi")


def identify_language(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                      lang_col: str = "lang", folds: int = 4, held_fold: int = 2, fit_rows: int = 400,
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, held_out, lang_pred and score (0 to 1: the share of the likeliest language) for every whole text.

    Piece probabilities of every language are learned from at most `fit_rows` of its documents (those with the smallest
    hash of the id) outside the held-out fold. A text that is null or has no letter, or a table without labelled texts, gives 'und'
    and 0; ties go to the language that sorts first; repeated rows are kept, and one that is drawn teaches by each copy; an empty table gives an
    empty result. `keep` names columns to carry along, in any order of names; none that the result has already.
    """
    spark = docs.sparkSession
    known = sample_by_language(docs, id_col, text_col, lang_col, folds, held_fold, fit_rows)
    model = spark.sparkContext.broadcast(fit(known, vocabulary_path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model.value
        index: dict[str, int] = {}
        texts = [[index.setdefault(w, len(index)) for w in words_of(t)] for t in texts_of(batch, "_text")]
        rows = [k for k, at in enumerate(texts) if at and m.languages]
        totals = np.zeros((len(rows), len(m.languages)))
        done = 0
        for table in m.lots(list(index)) if rows else ():
            for i, k in enumerate(rows):
                totals[i, done:done + table.shape[1]] = table[np.array(texts[k])].sum(0)
            done += table.shape[1]
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        for total, at in zip(totals, rows):
            k = int(total.argmax())
            pred[at] = m.languages[k]
            score[at] = float(1 / np.exp(np.clip(total - total[k], -700, 0)).sum())
        carried = [column(batch, n) for n in batch.schema.names if n != "_text"]
        names = [n for n in batch.schema.names if n != "_text"]
        return pa.RecordBatch.from_arrays([*carried, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                          [*names, "lang_pred", "score"])

    rest = [c for c in keep if c not in (id_col, "held_out", "lang_pred", "score")]
    picked = docs.select(F.col(id_col), *rest, F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "_text")
    out = map_arrow(picked, run, f"{fields}, lang_pred string, score double", rows=512)
    fold = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))
    return out.select(id_col, F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"), "lang_pred", "score", *rest)
