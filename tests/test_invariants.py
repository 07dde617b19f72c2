"""A valid trace has no violation; one change a rule makes exactly that rule speak."""

import copy
import hashlib

import pytest

from strataq.operators import invariants as I
from strataq.sources.schemas import trace_of


def digest(*parts):
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


EVENTS, TASKS = "durable-agent.events.v1", "durable-agent.tasks.v1"  # the contract's, as text
PROPOSAL = digest("res", "args", "7")
SCOPE = digest(PROPOSAL, "7", "effect", "res")
VALID = {
    "history": [
        dict(workflow_id="w", revision=1, actor_kind="user", old_state="", new_state="RUNNABLE", reason="WORKFLOW_CREATED"),
        dict(workflow_id="w", revision=2, actor_kind="scheduler", scheduler_epoch=3, old_state="RUNNABLE", new_state="WAITING_ACTIVITY", reason="ATTEMPT_CREATED"),
        dict(workflow_id="w", revision=3, actor_kind="scheduler", scheduler_epoch=4, old_state="WAITING_ACTIVITY", new_state="RUNNABLE", reason="RESULT_CONSUMED"),
        dict(workflow_id="w", revision=4, actor_kind="scheduler", scheduler_epoch=4, old_state="RUNNABLE", new_state="SUCCEEDED", reason="DONE"),
    ],
    "results": [dict(workflow_id="w", node_id="n", iteration=0, accepted=True)],
    "submissions": [dict(namespace="a", key="k", hash="h", workflow_id="w")],
    "attempts": [
        dict(workflow_id="w", node_id="n", iteration=0, attempt_number=1, state="TIMED_OUT", is_current=False, result_recorded=False),
        dict(workflow_id="w", node_id="n", iteration=0, attempt_number=2, state="CLAIMED", claim_token="t", worker_id="x", worker_request_id="r", is_current=True, result_recorded=False),
    ],
    "outbox": [
        dict(workflow_id="w", event_id="e1", aggregate_revision=1, event_type="workflow.created", topic=EVENTS, publish_state="PUBLISHED", payload_valid=True),
        dict(workflow_id="w", event_id="e3", aggregate_revision=3, event_type="workflow.result_consumed", topic=EVENTS, publish_state="QUARANTINED", payload_valid=True),
    ],
    "inbox": [dict(consumer_id="c", event_id="e1", topic=EVENTS, partition=0, offset=5, disposition="ACCEPTED")],
    "wakeups": [dict(workflow_id="w", event_id="e1", partition_id=3, state="CONSUMED")],
    "reconciliation": [dict(workflow_id="w", kind="POISON_RECORD", reference="outbox/e3", status="OPEN"),
                       dict(workflow_id="w", kind="PENDING_OUTBOX", reference="outbox/e1", status="RESOLVED")],
    "checkpoints": [dict(workflow_id="w", node_id="n", iteration=0, sequence=i, schema_version=1, source_attempt=1, payload_valid=True, payload_hash="p") for i in range(3)],
    "effects": [dict(workflow_id="w", intent_id="i", logical_effect_key="effect", argument_hash="args", attempt_number=1, grant_scope_hash=SCOPE, resource_id="res", outcome="APPLIED", receipt_present=True)],
    "effect_calls": [dict(workflow_id="w", logical_effect_key="effect", argument_hash="args", attempt_number=1, request_id="q", outcome="APPLIED")],
    "approvals": [dict(intent_id="i", workflow_id="w", node_id="n", iteration=0, proposal_hash=PROPOSAL, target="res", arguments_valid=True, canonical_argument_hash="args",
                       expected_resource_revision="7", decision="APPROVED", dispatch_status="DISPATCHED", grant_scope_hash=SCOPE, grant_token="g")],
}

CHANGES = [
    ("history start", "history", 0, dict(new_state="WAITING_TIMER")),
    ("history contiguity", "history", 3, dict(revision=9)),
    ("history chain", "history", 2, dict(old_state="WAITING_TIMER")),
    ("illegal transition", "history", 3, dict(new_state="REJECTED")),
    ("scheduler without epoch", "history", 1, dict(scheduler_epoch=None)),
    ("epoch without scheduler", "history", 0, dict(scheduler_epoch=1)),
    ("epoch backwards", "history", 3, dict(scheduler_epoch=2)),
    ("result identity", "results", 0, dict(node_id="")),
    ("submission identity", "submissions", 0, dict(hash="")),
    ("attempt identity", "attempts", 0, dict(node_id="")),
    ("terminal attempt current", "attempts", 0, dict(is_current=True)),
    ("claim without owner", "attempts", 1, dict(worker_id="")),
    ("result on settled attempt", "attempts", 0, dict(result_recorded=True)),
    ("attempt contiguity", "attempts", 1, dict(attempt_number=4)),
    ("several current attempts", "attempts", 0, dict(is_current=True, state="DISPATCHABLE")),
    ("checkpoint evidence", "checkpoints", 1, dict(payload_valid=False)),
    ("checkpoint contiguity", "checkpoints", 2, dict(sequence=7)),
    ("checkpoint schema change", "checkpoints", 1, dict(schema_version=2)),
    ("effect without receipt", "effects", 0, dict(receipt_present=False)),
    ("effect outcome", "effects", 0, dict(outcome="MAYBE")),
    ("effect without intent", "effects", 0, dict(intent_id="other")),
    ("effect resource", "effects", 0, dict(resource_id="elsewhere")),
    ("effect arguments", "effects", 0, dict(argument_hash="others")),
    ("effect scope", "effects", 0, dict(grant_scope_hash="x")),
    ("call identity", "effect_calls", 0, dict(request_id="")),
    ("call outcome", "effect_calls", 0, dict(outcome="?")),
    ("approval decision", "approvals", 0, dict(decision="PERHAPS")),
    ("approval dispatch", "approvals", 0, dict(dispatch_status="LOST")),
    ("grant without approval", "approvals", 0, dict(grant_token="")),
    ("proposal digest", "approvals", 0, dict(proposal_hash="x")),
    ("effect not dispatched", "approvals", 0, dict(dispatch_status="GRANTED")),
    ("event type", "outbox", 0, dict(event_type="unheard.of")),
    ("event topic", "outbox", 0, dict(topic="elsewhere")),
    ("event of unknown workflow", "outbox", 0, dict(workflow_id="x")),
    ("publication state", "outbox", 0, dict(publish_state="LOST")),
    ("missing event", "outbox", 0, dict(aggregate_revision=2)),
    ("message of unknown event", "inbox", 0, dict(event_id="nothing")),
    ("message topic", "inbox", 0, dict(topic="elsewhere")),
    ("message disposition", "inbox", 0, dict(disposition="?")),
    ("wakeup identity", "wakeups", 0, dict(partition_id=16)),
    ("wakeup of unknown event", "wakeups", 0, dict(event_id="nothing")),
    ("wakeup state", "wakeups", 0, dict(state="?")),
    ("item of unknown workflow", "reconciliation", 1, dict(workflow_id="x")),
    ("item kind", "reconciliation", 1, dict(kind="?")),
    ("item status", "reconciliation", 1, dict(status="?")),
    ("item of unknown event", "reconciliation", 1, dict(reference="outbox/none")),
    ("published but open", "reconciliation", 1, dict(status="OPEN")),
    ("quarantine without item", "reconciliation", 0, dict(reference="outbox/e9")),
]
TWICE = [("result uniqueness", "results"), ("effect uniqueness", "effects"), ("call uniqueness", "effect_calls"), ("event uniqueness", "outbox"), ("wakeup uniqueness", "wakeups")]


def rules_of(spark, rows):
    return {r["rule"] for r in I.check(trace_of(spark, rows)).collect()}


@pytest.fixture(scope="module")
def many(spark):
    """All changed traces at once: ids carry the number of the change, so one job checks them all."""
    def renamed(rows, i):
        out = copy.deepcopy(rows)
        for view in out.values():
            for r in view:
                for c in ("workflow_id", "event_id", "intent_id", "key", "request_id"):
                    if r.get(c):
                        r[c] = f"{i}:{r[c]}"
                if r.get("reference", "").startswith("outbox/"):
                    r["reference"] = "outbox/" + f"{i}:" + r["reference"][7:]
        return out

    total = {v: [] for v in VALID}
    cases = [("valid", None, 0, {})] + CHANGES + [(rule, view, None, None) for rule, view in TWICE]
    for i, (_, view, row, change) in enumerate(cases):
        rows = copy.deepcopy(VALID)
        if change is None:
            rows[view].append(copy.deepcopy(rows[view][0]))
        elif view:
            rows[view][row].update(change)
        for v, rs in renamed(rows, i).items():
            for k, r in enumerate(rs):
                if v == "inbox":
                    r["offset"] = 100 * i + k
            total[v] += rs
    found = {}
    for r in I.check(trace_of(spark, total)).collect():
        found.setdefault(r["key"], set()).add(r["rule"])
    return cases, found


def test_valid_trace(spark):
    assert rules_of(spark, VALID) == set()


def test_each_change_is_found(many):
    cases, found = many
    for i, (rule, *_rest) in enumerate(cases):
        rules = {r for key, rs in found.items() if key.startswith(f"{i}:") or key.startswith(f"outbox/{i}:") or f"/{i}:" in key for r in rs}
        if rule == "valid":
            assert not rules
        else:
            assert rule in rules, (rule, rules)


def test_after_terminal_and_conflicts(spark):
    rows = copy.deepcopy(VALID)
    rows["history"].append(dict(workflow_id="w", revision=5, actor_kind="user", old_state="SUCCEEDED", new_state="RUNNABLE", reason="X"))
    rows["submissions"].append(dict(namespace="a", key="k", hash="other", workflow_id="v"))
    rows["inbox"].append(dict(consumer_id="c", event_id="e3", topic=EVENTS, partition=0, offset=5, disposition="STALE"))
    assert {"history after terminal", "illegal transition", "submission key conflict", "offset conflict"} <= rules_of(spark, rows)


def test_transport_is_opt_in(spark):
    rows = {v: r for v, r in VALID.items() if v not in ("outbox", "inbox", "wakeups", "reconciliation")}
    assert "missing event" not in rules_of(spark, rows)


def test_topics_are_arguments(spark):
    rows = copy.deepcopy(VALID)
    rows["outbox"][0].update(event_type="attempt.dispatch", topic=TASKS)
    rows["inbox"][0].update(topic=TASKS)
    assert I.check(trace_of(spark, rows), ["transport"]).count() == 0
    assert {r["rule"] for r in I.check(trace_of(spark, VALID), ["transport"], topics=("events", "tasks")).collect()} == {"event topic"}
    for name in ("outbox", "inbox"):
        for row in rows[name]:
            row["topic"] = {EVENTS: "events", TASKS: "tasks"}[row["topic"]]
    assert I.check(trace_of(spark, rows), ["transport"], topics=("events", "tasks")).count() == 0
