"""Secret scans: fixed patterns, and a token-efficiency test for random strings."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, texts_of

# The base patterns, in the order in which their kinds are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
# What a random-looking run is not.
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
IDENTIFIER = re.compile(r"[A-Za-z]+(?:[_.\-/][A-Za-z]+)*[_.\-]?\d{0,4}")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns; leftmost, non-overlapping for each kind; short ones go."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found)


def excluded(run: str) -> bool:
    """Known digests: they look random and are no secrets."""
    if UUID.fullmatch(run):
        return True
    return bool(HEX_ONLY.fullmatch(run)) and (len(run) in DIGEST_LENGTHS or run.isdigit())


def identifier(run: str, enc) -> bool:
    """Names of words: of their letters, half stand in parts of 4 letters or more that cost at most a token for each 3.

    Parts are taken in lower case and after a space, as words are in the vocabulary.
    """
    if not IDENTIFIER.fullmatch(run):
        return False
    parts = PART.findall(run)
    words = sum(len(p) for p in parts if len(p) >= 4 and len(p) >= 3 * len(enc.encode_ordinary(" " + p.lower())))
    return 2 * words >= sum(map(len, parts)) >= 0.75 * len(run)


def random_spans(text: str, enc, most: float) -> list[tuple[int, int]]:
    """Runs with a letter or digit whose characters per token fall below `most`, but digests and names of words."""
    spans = []
    for m in RUN.finditer(text):
        run = m.group().strip("-/_")
        if len(run) < 16 or not any(c.isalnum() for c in run) or excluded(run):
            continue
        if len(run) < most * len(enc.encode_ordinary(run)) and not identifier(run, enc):
            at = m.start() + m.group().index(run)
            spans.append((at, at + len(run)))
    return spans


def scan_secrets(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 chars_per_token: float = 2.0) -> DataFrame:
    """Secrets of every whole text.

    Returns id_col, spans array<struct<start, end, kind>> in code points, end exclusive, ordered by start and then by
    kind: assign, access, hex, random. Null and empty texts give an empty array; repeated rows give repeated rows; an
    empty table gives an empty result; other columns are not read, so their names can't clash.
    A long run is tested whole; only its ends lose punctuation.
    """

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(vocabulary)
        out = []
        for text in texts_of(batch):
            spans = base_spans(text)
            taken = {(s, e) for s, _, e in spans}
            spans += [(s, 3, e) for s, e in random_spans(text, enc, chars_per_token) if (s, e) not in taken]
            out.append([{"start": s, "end": e, "kind": (*KINDS, "random")[k]} for s, k, e in sorted(spans)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        return pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(out, kind)], ["id", "spans"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = picked.schema["id"].dataType.simpleString()
    found = map_arrow(picked, scan, f"id {key}, spans array<struct<start:bigint,end:bigint,kind:string>>")
    return found.withColumnRenamed("id", id_col)


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as one string."""
    base = F.filter("spans", lambda s: s["kind"] != "random")
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col, *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(F.concat_ws(",", F.transform(base, one)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", one)).alias("spans"),
        count("random").alias("n_random"),
    )


def brute_base(text: str | None) -> tuple[int, int, int, str]:
    """The contract read literally, for tests."""
    text, spans = text or "", []
    for kind, pattern in enumerate((ASSIGN, ACCESS, HEX)):
        for m in pattern.finditer(text):
            size, least = ((len(m.group(min(2, m.re.groups))), 6), (len(m.group()), 20), (len(m.group()), 24))[kind]
            if size >= least:
                spans.append((m.start(), kind, m.end()))
    spans.sort()
    joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
    n = [sum(k == x for _, k, _ in spans) for x in range(3)]
    return (*n, hashlib.sha256(joined.encode()).hexdigest())
