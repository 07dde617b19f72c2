"""Hash functions. All but the canonical JSON digest are column expressions that stay in code generation."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PARTITIONS = 16
HEX_DIGEST = "^[0-9a-f]{64}$"


def partition_of(key: Column) -> Column:
    """Stable partition of a key: the first 8 bytes of SHA-256, big-endian, modulo 16; the last nibble of those bytes."""
    nibble = F.substring(F.sha2(key, 256), 16, 1)
    return F.when(F.length(key) > 0, F.conv(nibble, 16, 10).cast("int"))


def joined_digest(*parts: Column, separator: str = "\0") -> Column:
    """SHA-256 of parts joined by a separator; a null part counts as empty."""
    return F.sha2(F.concat_ws(separator, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def proposal_digest(target: Column, argument_hash: Column, revision: Column) -> Column:
    return joined_digest(target, argument_hash, revision)


def scope_digest(token: Column, intent: Column, target: Column, arguments: Column) -> Column:
    return joined_digest(token, intent, target, arguments)


def pipe_frame(*parts: Column) -> Column:
    """Columns as one line, joined by '|'."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def is_hex_digest(value: Column) -> Column:
    return F.coalesce(value.rlike(HEX_DIGEST), F.lit(False))


def content_digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def fingerprint(config: dict) -> str:
    """Digest of a configuration: sorted, compact JSON."""
    return "sha256:" + hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class DuplicateKey(ValueError):
    """A JSON object holds one key twice."""


class _Number(str):
    """A number as written; JSON text keeps 1.0 and 1 apart."""


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise DuplicateKey("object holds a key twice")
    return out


def _write(value: object) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_write(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_write, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def canonical_json(text: str | None) -> str | None:
    """Keys sorted, white space gone, numbers as written; None for null, malformed text or duplicate keys."""
    if text is None:
        return None
    try:
        return _write(json.loads(text, object_pairs_hook=_pairs, parse_int=_Number, parse_float=_Number))
    except ValueError:
        return None


def canonical_digest(text: str | None) -> str | None:
    found = canonical_json(text)
    return None if found is None else hashlib.sha256(found.encode()).hexdigest()


def canonical_digest_udf():
    """The canonical digest of a column of JSON text, in Arrow batches."""
    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(canonical_digest, na_action="ignore")

    return digest


def plain_arguments(text: str | None) -> bool:
    """Is this JSON whose numbers are whole, within 2^53 and not written -0, and whose objects hold no key twice?"""
    def whole(number: str) -> int:
        value = int(number)
        if number == "-0" or abs(value) >= 2**53:
            raise ValueError(number)
        return value

    def never(number: str) -> None:
        raise ValueError(number)

    try:
        json.loads(text, object_pairs_hook=_pairs, parse_int=whole, parse_float=never, parse_constant=never)
    except (TypeError, ValueError):
        return False
    return True


def plain_arguments_udf():
    """plain_arguments of a column of JSON text, in Arrow batches: number lexemes are lost in the engine's own parser."""
    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        return values.map(plain_arguments)

    return test


def submission_digest(canonical: Column) -> Column:
    return F.concat(F.lit("sub-v1:"), canonical)


def json_equal(a: Column, b: Column) -> Column:
    """Equality of decoded documents; here 1.0 equals 1."""
    return F.to_json(F.try_parse_json(a)) == F.to_json(F.try_parse_json(b))


def traceparent(seed: Column) -> Column:
    """A trace header whose ids derive from a seed."""
    h = F.sha2(seed.cast("string"), 256)
    return F.concat(F.lit("00-"), F.substring(h, 1, 32), F.lit("-"), F.substring(h, 33, 16), F.lit("-01"))


def derived_uuid(seed: Column) -> Column:
    """A repeatable identifier in place of a random one."""
    h = F.sha2(seed.cast("string"), 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def signature(proposal: Column) -> Column:
    """A proposal struct as text, or NO_PROPOSAL."""
    return F.coalesce(F.when(proposal.isNotNull(), F.to_json(proposal)), F.lit("NO_PROPOSAL"))


def version_number(version: Column) -> Column:
    return F.regexp_extract(version, r"^v(\d+)$", 1).try_cast("int")


def is_uuid_text(value: str) -> bool:
    return bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", value))
