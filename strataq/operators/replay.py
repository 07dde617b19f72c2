"""Ordered folds over histories: what state-changing operators would have done.

A fold runs in Arrow groups by key, rows in order. A group is one entity's history, which the model keeps bounded; the
streaming twin in strataq.streaming keeps the same state between batches.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .invariants import PRODUCER_LEGAL, TERMINAL

Step = Callable[[dict, dict], tuple[dict, str]]


def fold(df: DataFrame, key: Sequence[str], order: Sequence[str], step: Step, start: dict, outcome: str = "outcome") -> DataFrame:
    """Every row with the outcome that `step` gives it: step(state, row) returns the next state and the outcome."""
    names, schema = df.columns, df.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(o, "ascending") for o in order])
        state, out = copy.deepcopy(start), []
        for row in t.to_pylist():
            state, result = step(state, row)
            out.append(result)
        return t.select(names).append_column(outcome, pa.array(out, pa.string()))

    return df.groupBy(*key).applyInArrow(run, f"{fields}, {outcome} string")


def machine_step(legal: dict[str, str] = PRODUCER_LEGAL, terminal: Iterable[str] = TERMINAL) -> Step:
    """A revision-checked state machine: rows hold expected (revision) and target (state)."""
    allowed = {a: set(to.split()) for a, to in legal.items()}
    ended = set(terminal)

    def step(state: dict, row: dict) -> tuple[dict, str]:
        if state["state"] in ended:
            return state, "TERMINAL"
        if row["expected"] != state["revision"]:
            return state, "STALE"
        if row["target"] not in allowed.get(state["state"], ()):
            return state, "ILLEGAL"
        return {"state": row["target"], "revision": state["revision"] + 1}, "APPLIED"

    return step


def replay_machine(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return fold(df, key, order, machine_step(), {"state": "RUNNABLE", "revision": 0})


def effect_step(state: dict, row: dict) -> tuple[dict, str]:
    """An effect on a resource: rows hold effect_key, argument_hash, fence and revision.

    A known key is a DUPLICATE with the same arguments and a CONFLICT with others; a fence below the highest is FENCED; a
    revision that isn't the resource's is REJECTED; else it is APPLIED and the revision goes up.
    """
    known, key = state["known"], row["effect_key"]
    if key in known:
        return state, "DUPLICATE" if known[key] == row["argument_hash"] else "CONFLICT"
    if row["fence"] < state["fence"]:
        return state, "FENCED"
    state["fence"] = row["fence"]
    if row["revision"] != state["revision"]:
        return state, "REJECTED"
    known[key] = row["argument_hash"]
    state["revision"] += 1
    return state, "APPLIED"


def replay_effects(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return fold(df, key, order, effect_step, {"known": {}, "fence": 0, "revision": 0})


def lease_step(state: dict, row: dict) -> tuple[dict, str]:
    """A lease with a fencing epoch: rows hold action (acquire, renew, release), owner, at and ttl."""
    held = state["owner"] is not None and row["at"] < state["expiry"]
    mine = state["owner"] == row["owner"]
    if row["action"] == "acquire":
        if held and not mine:
            return state, "HELD"
        epoch = state["epoch"] + (0 if held and mine else 1)
        return {"owner": row["owner"], "expiry": row["at"] + row["ttl"], "epoch": epoch}, f"EPOCH_{epoch}"
    if not (held and mine):
        return state, "LOST"
    if row["action"] == "renew":
        return {**state, "expiry": row["at"] + row["ttl"]}, "RENEWED"
    return {**state, "owner": None, "expiry": 0}, "RELEASED"


def replay_leases(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return fold(df, key, order, lease_step, {"owner": None, "expiry": 0, "epoch": 0})


def attempt_step(budget: int) -> Step:
    """Attempts of a node: rows hold action (create, claim, heartbeat, result, timeout) and request_id."""

    def step(state: dict, row: dict) -> tuple[dict, str]:
        action, request = row["action"], row["request_id"]
        if state["done"]:
            return state, "LATE_EVIDENCE" if action == "result" else "TERMINAL"
        if action == "create":
            if state["current"]:
                return state, "CURRENT_EXISTS"
            if state["number"] > budget:
                return state, "BUDGET_SPENT"
            return {**state, "current": True, "owner": None, "number": state["number"] + 1}, f"ATTEMPT_{state['number'] + 1}"
        if not state["current"]:
            return state, "NO_ATTEMPT"
        if action == "claim":
            if state["owner"] in (None, request):
                again = state["owner"] == request
                return {**state, "owner": request}, "CLAIM_REPEATED" if again else "CLAIMED"
            return state, "CLAIM_CONFLICT"
        if action == "timeout":
            return {**state, "current": False, "owner": None}, "TIMED_OUT"
        if state["owner"] != request:
            return state, "NOT_OWNER"
        if action == "heartbeat":
            return state, "EXTENDED"
        return {**state, "current": False, "done": True}, "SUCCEEDED"

    return step


def replay_attempts(df: DataFrame, key: Sequence[str], order: Sequence[str], budget: int = 3) -> DataFrame:
    return fold(df, key, order, attempt_step(budget), {"current": False, "owner": None, "number": 0, "done": False})


def timeout_class(state: str = "state", effect: str = "effect_class", retries: str = "retries_used", budget: str = "budget"):
    """What a missed deadline leads to: redispatch if unclaimed, reconcile if an effect may have happened, else replace."""
    return (F.when(F.col(state) == "DISPATCHABLE", "REDISPATCH")
            .when((F.col(state) == "CLAIMED") & (F.col(effect) == "EXTERNAL"), "RECONCILE")
            .when((F.col(state) == "CLAIMED") & (F.col(retries) < F.col(budget)), "REPLACE")
            .when(F.col(state) == "CLAIMED", "FAIL").otherwise("IGNORE"))


def consume(outcome, retries, budget, at, deadline, ok: str, retryable: str):
    """What a recorded result leads to: success, another try while budget and deadline last, failure, or reconciliation."""
    return (F.when(outcome == ok, "SUCCEEDED").when((outcome == retryable) & (retries <= budget) & (at <= deadline), "RETRY")
            .when(outcome == retryable, "FAILED").otherwise("RECONCILE"))


def submit_once(df: DataFrame, key: Sequence[str], order: Sequence[str], digest: str) -> DataFrame:
    """ACCEPTED for the first row of a key; REPEATED for the same digest later on, CONFLICT for another one."""
    from .sequence import by

    w = by(key, *order)
    first = F.first(digest).over(w)
    k = F.row_number().over(w)
    return df.withColumn("outcome", F.when(k == 1, "ACCEPTED").when(F.col(digest) == first, "REPEATED").otherwise("CONFLICT"))
