"""Invariant rules over workflow traces: each rule is a lazy DataFrame of (rule, key), and a check is their union.

A trace is a dict of DataFrames by view name (see strataq.sources.schemas). A rule that needs several views joins them by
key; rows of one history are only ever ordered within their workflow.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import joined_digest
from . import sequence as S

Trace = dict[str, DataFrame]

# The state domains and registries of the workflow contract.
TERMINAL = ("SUCCEEDED", "FAILED", "REJECTED", "CANCELED", "ABANDONED")
TERMINAL_ATTEMPT = ("SUCCEEDED", "FAILED_RETRYABLE", "FAILED_FINAL", "TIMED_OUT", "REPLACED", "OUTCOME_UNKNOWN", "CANCELED")
SETTLED_ATTEMPT = ("TIMED_OUT", "REPLACED", "CANCELED", "OUTCOME_UNKNOWN")
LEGAL = {
    "RUNNABLE": "RUNNABLE WAITING_ACTIVITY WAITING_APPROVAL WAITING_TIMER PAUSED_UNSUPPORTED_VERSION SUCCEEDED FAILED CANCELED",
    "WAITING_ACTIVITY": "WAITING_ACTIVITY RUNNABLE WAITING_TIMER RECONCILIATION_REQUIRED FAILED CANCELED",
    "WAITING_TIMER": "WAITING_TIMER RUNNABLE CANCELED",
    "WAITING_APPROVAL": "WAITING_APPROVAL RUNNABLE REJECTED CANCELED",
    "PAUSED_UNSUPPORTED_VERSION": "PAUSED_UNSUPPORTED_VERSION RUNNABLE CANCELED ABANDONED",
    "RECONCILIATION_REQUIRED": "RECONCILIATION_REQUIRED RUNNABLE CANCELED ABANDONED",
}
STEPS = [(a, b) for a, to in LEGAL.items() for b in to.split()]
# What the producer itself may do is narrower.
PRODUCER_LEGAL = {
    "RUNNABLE": LEGAL["RUNNABLE"],
    "WAITING_ACTIVITY": "WAITING_ACTIVITY RECONCILIATION_REQUIRED CANCELED",
    "WAITING_TIMER": "RUNNABLE CANCELED",
    "WAITING_APPROVAL": "RUNNABLE REJECTED CANCELED",
    "PAUSED_UNSUPPORTED_VERSION": "RUNNABLE CANCELED ABANDONED",
    "RECONCILIATION_REQUIRED": "RUNNABLE CANCELED ABANDONED",
}
OBLIGING = ("WORKFLOW_CREATED", "ATTEMPT_RESULT_RECORDED", "RESULT_CONSUMED", "GRAPH_ADVANCED", "TIMER_SCHEDULED",
            "CANCELED_ALL_ACTIVE_NODES", "REDISPATCH_UNCLAIMED", "TIMEOUT_REPLACEMENT", "TIMEOUT_RECONCILIATION_REQUIRED")
TASK_EVENTS = ("attempt.dispatch", "attempt.redispatch")
EVENT_TYPES = ("workflow.created", *TASK_EVENTS, "activity.result", "workflow.result_consumed", "graph.advanced",
               "timer.scheduled", "workflow.canceled", "approval.requested", "approval.decided", "approval.granted",
               "approval.rejected", "cancellation.requested", "effect.applied", "reconciliation.required",
               "reconciliation.resolved")
EVENT_TOPIC, TASK_TOPIC = "durable-agent.events.v1", "durable-agent.tasks.v1"
DOMAINS = {
    "publish_state": ("PENDING", "CLAIMED", "PUBLISHED", "QUARANTINED"),
    "disposition": ("ACCEPTED", "ALREADY_HANDLED", "STALE", "QUARANTINED"),
    "wakeup": ("PENDING", "CLAIMED", "CONSUMED"),
    "item_kind": ("EXPIRED_ATTEMPT", "PENDING_OUTBOX", "LOST_WAKEUP", "DUE_TIMER", "POISON_RECORD"),
    "item_status": ("OPEN", "RESOLVED", "ABANDONED"),
    "effect": ("APPLIED", "OUTCOME_UNKNOWN"),
    "call": ("APPLIED", "DUPLICATE", "CONFLICT", "REJECTED", "UNKNOWN"),
    "decision": ("PENDING", "APPROVED", "REJECTED"),
    "dispatch": ("NOT_GRANTED", "GRANTED", "DISPATCHED", "CANCELED"),
}
NODE = ("workflow_id", "node_id", "iteration")


def empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def any_empty(*names: str) -> Column:
    return reduce(lambda a, b: a | b, (empty(n) for n in names))


def below(c: str, least: int) -> Column:
    return F.coalesce(F.col(c) < least, F.lit(True))


def untrue(c: str) -> Column:
    return ~F.coalesce(F.col(c), F.lit(False))


def key_of(*names: str) -> Column:
    return F.concat_ws("/", *(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names))


def named(df: DataFrame, rule: str, *key: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key_of(*key).alias("key"))


def topic_of(event_type: Column, topics: tuple[str, str] = (EVENT_TOPIC, TASK_TOPIC)) -> Column:
    """The topic of a known event type, of those of events and of tasks, else null."""
    return F.when(event_type.isin(*TASK_EVENTS), topics[1]).when(event_type.isin(*EVENT_TYPES), topics[0])


def repeated(df: DataFrame, rule: str, *key: str) -> DataFrame:
    return named(df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1"), rule, *key)


def outside(df: DataFrame, column: str, domain: Sequence[str], rule: str, *key: str) -> DataFrame:
    return named(df.where(~F.coalesce(F.col(column).isin(*domain), F.lit(False))), rule, *key)


def missing(df: DataFrame, parent: DataFrame, on: Sequence[str], rule: str, *key: str) -> DataFrame:
    return named(df.join(parent.select(*on).distinct(), list(on), "left_anti"), rule, *key)


def history_rules(t: Trace) -> list[DataFrame]:
    h = t["history"].where(~empty("workflow_id"))
    w = S.by(["workflow_id"], "revision")
    first = h.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    later = h.withColumn("_prev", F.lag("revision").over(w)).where("_prev IS NOT NULL")
    scheduler = F.col("actor_kind") == "scheduler"
    epoch = F.col("scheduler_epoch")
    timed = h.where(scheduler & (epoch > 0))
    return [
        named(t["history"].where(empty("workflow_id")), "history without workflow", "revision"),
        named(first.where((F.col("revision") != 1) | ~empty("old_state") | (F.col("new_state") != "RUNNABLE")), "history start", "workflow_id"),
        named(h.where("revision <= 0").select("workflow_id", "revision").unionByName(
            later.where("revision > 0 AND revision <> _prev + 1").select("workflow_id", "revision")), "history contiguity", "workflow_id", "revision"),
        named(S.chain_breaks(h, ["workflow_id"], "revision", "old_state", "new_state").join(
            first.select("workflow_id", "revision"), ["workflow_id", "revision"], "left_anti"), "history chain", "workflow_id", "revision"),
        named(S.illegal_steps(later, "old_state", "new_state", STEPS), "illegal transition", "workflow_id", "revision"),
        named(S.after_terminal(h, ["workflow_id"], ["revision"], F.col("new_state").isin(*TERMINAL)), "history after terminal", "workflow_id", "revision"),
        named(h.where(scheduler & F.coalesce(epoch <= 0, F.lit(True))), "scheduler without epoch", "workflow_id", "revision"),
        named(h.where(~scheduler & epoch.isNotNull()), "epoch without scheduler", "workflow_id", "revision"),
        named(S.epoch_regressions(timed, ["workflow_id"], ["revision"], "scheduler_epoch"), "epoch backwards", "workflow_id", "revision"),
    ]


def result_rules(t: Trace) -> list[DataFrame]:
    r = t["results"]
    return [named(r.where(any_empty("workflow_id", "node_id") | below("iteration", 0)), "result identity", *NODE),
            repeated(r.where("accepted"), "result uniqueness", *NODE)]


def submission_rules(t: Trace) -> list[DataFrame]:
    names = ("namespace", "key", "hash", "workflow_id")
    whole = t["submissions"].where(~any_empty(*names))
    many = lambda by, what, rule: named(
        whole.groupBy(*by).agg(F.count_distinct(F.struct(*what)).alias("_n")).where("_n > 1"), rule, *by)
    return [named(t["submissions"].where(any_empty(*names)), "submission identity", "namespace", "key"),
            many(("namespace", "key"), ("hash", "workflow_id"), "submission key conflict"),
            many(("workflow_id",), ("namespace", "key"), "workflow of several submissions")]


def attempt_rules(t: Trace) -> list[DataFrame]:
    bad = any_empty("workflow_id", "node_id") | below("iteration", 0) | below("attempt_number", 1)
    a = t["attempts"].where(~bad)
    at = (*NODE, "attempt_number")
    breaks = S.contiguity(a, list(NODE), "attempt_number", 1)
    current = S.valid_prefix(a, list(NODE), "attempt_number", 1).where("is_current")
    return [
        named(t["attempts"].where(bad), "attempt identity", *at),
        named(a.where(F.col("is_current") & F.col("state").isin(*TERMINAL_ATTEMPT)), "terminal attempt current", *at),
        named(a.where((F.col("state") == "CLAIMED") & any_empty("claim_token", "worker_id", "worker_request_id")), "claim without owner", *at),
        named(a.where(F.col("result_recorded") & F.col("state").isin(*SETTLED_ATTEMPT)), "result on settled attempt", *at),
        named(breaks.select(*NODE).distinct(), "attempt contiguity", *NODE),
        repeated(current, "several current attempts", *NODE),
    ]


def checkpoint_rules(t: Trace) -> list[DataFrame]:
    c = t["checkpoints"]
    bad = (any_empty("workflow_id", "node_id", "payload_hash") | below("iteration", 0) | below("sequence", 0) |
           below("schema_version", 1) | below("source_attempt", 1) | untrue("payload_valid"))
    held = S.valid_prefix(c, list(NODE), "sequence", 0)
    other = held.withColumn("_v", F.lag("schema_version").over(S.by(list(NODE), "sequence"))).where("_v <> schema_version")
    return [named(c.where(bad), "checkpoint evidence", *NODE, "sequence"),
            named(S.contiguity(c, list(NODE), "sequence", 0).select(*NODE).distinct(), "checkpoint contiguity", *NODE),
            named(other.select(*NODE).distinct(), "checkpoint schema change", *NODE)]


def effect_rules(t: Trace) -> list[DataFrame]:
    e, c, a = t["effects"], t["effect_calls"], t["approvals"]
    applied = e.where("outcome = 'APPLIED'").alias("e")
    ap = a.dropDuplicates(["intent_id"]).alias("a")
    both = applied.join(ap, (F.col("e.intent_id") == F.col("a.intent_id")) & (F.coalesce("e.intent_id", F.lit("")) != ""))
    name = lambda df, rule: df.select(F.lit(rule).alias("rule"), key_of("e.workflow_id", "e.logical_effect_key").alias("key"))
    differs = lambda x, y: (F.coalesce(F.col(x), F.lit("")) == "") | ~F.col(x).eqNullSafe(F.col(y))
    scope = joined_digest(F.col("a.proposal_hash"), F.col("a.expected_resource_revision"), F.col("e.logical_effect_key"), F.col("a.target"))
    granted = F.col("dispatch_status").isin("GRANTED", "DISPATCHED")
    proposal = joined_digest(F.col("target"), F.col("canonical_argument_hash"), F.col("expected_resource_revision"))
    lost = applied.join(ap, F.col("e.intent_id") == F.col("a.intent_id"), "left_anti")
    return [
        named(e.where(any_empty("workflow_id", "logical_effect_key", "argument_hash") | below("attempt_number", 1)), "effect identity", "workflow_id", "logical_effect_key"),
        repeated(e, "effect uniqueness", "workflow_id", "logical_effect_key"),
        named(e.where((F.col("outcome") == "APPLIED") & untrue("receipt_present")), "effect without receipt", "workflow_id", "logical_effect_key"),
        outside(e, "outcome", DOMAINS["effect"], "effect outcome", "workflow_id", "logical_effect_key"),
        named(c.where(any_empty("workflow_id", "logical_effect_key", "argument_hash", "request_id") | below("attempt_number", 1)), "call identity", "workflow_id", "request_id"),
        repeated(c, "call uniqueness", "workflow_id", "request_id"),
        outside(c, "outcome", DOMAINS["call"], "call outcome", "workflow_id", "request_id"),
        named(a.where(any_empty("intent_id", "workflow_id", "node_id", "proposal_hash", "target") | below("iteration", 0) | untrue("arguments_valid")), "approval identity", "intent_id"),
        outside(a, "decision", DOMAINS["decision"], "approval decision", "intent_id"),
        outside(a, "dispatch_status", DOMAINS["dispatch"], "approval dispatch", "intent_id"),
        named(a.where(granted & ((F.col("decision") != "APPROVED") | any_empty("grant_scope_hash", "grant_token"))), "grant without approval", "intent_id"),
        named(a.where(F.col("arguments_valid") & ~empty("canonical_argument_hash") & (F.col("proposal_hash") != proposal)), "proposal digest", "intent_id"),
        name(lost, "effect without intent"),
        name(both.where((F.col("a.decision") != "APPROVED") | (F.col("a.dispatch_status") != "DISPATCHED")), "effect not dispatched"),
        name(both.where(differs("e.resource_id", "a.target")), "effect resource"),
        name(both.where(differs("a.canonical_argument_hash", "e.argument_hash")), "effect arguments"),
        name(both.where(differs("e.grant_scope_hash", "a.grant_scope_hash") | (F.col("e.grant_scope_hash") != scope)), "effect scope"),
    ]


def transport_rules(t: Trace, topics: tuple[str, str] = (EVENT_TOPIC, TASK_TOPIC)) -> list[DataFrame]:
    """They hold for a trace with any transport row; a trace without one has nothing for them to look at but history."""
    o, i, w, r = (t[n] for n in ("outbox", "inbox", "wakeups", "reconciliation"))
    known = t["submissions"].select("workflow_id").distinct()
    any_row = reduce(lambda a, b: a.unionByName(b), (x.select(F.lit(1).alias("_x")).limit(1) for x in (o, i, w, r))).limit(1)
    topic = topic_of(F.col("event_type"), topics)
    events = o.select("event_id", F.col("topic").alias("_topic"), F.col("publish_state").alias("_state")).dropDuplicates(["event_id"])
    obliged = t["history"].where(F.col("reason").isin(*OBLIGING)).join(F.broadcast(any_row)).drop("_x")
    poison = empty("workflow_id") & (F.col("kind") == "POISON_RECORD") & F.col("reference").startswith("transport/")
    pending = r.where((F.col("kind") == "PENDING_OUTBOX") & F.col("reference").startswith("outbox/")).withColumn(
        "event_id", F.regexp_replace("reference", "^outbox/", ""))
    poisoned = r.where("kind = 'POISON_RECORD'").select("reference").distinct()
    return [
        named(o.where(any_empty("event_id", "workflow_id", "event_type", "topic") | below("aggregate_revision", 1) | untrue("payload_valid")), "event identity", "event_id"),
        named(o.where(topic.isNull() & (F.col("publish_state") != "QUARANTINED")), "event type", "event_id"),
        named(o.where(topic != F.col("topic")), "event topic", "event_id"),
        repeated(o, "event uniqueness", "event_id"),
        missing(o, known, ["workflow_id"], "event of unknown workflow", "event_id"),
        outside(o, "publish_state", DOMAINS["publish_state"], "publication state", "event_id"),
        missing(obliged, o.select("workflow_id", F.col("aggregate_revision").alias("revision")), ["workflow_id", "revision"], "missing event", "workflow_id", "revision"),
        named(i.where(any_empty("consumer_id", "event_id", "topic") | below("partition", 0) | below("offset", 0)), "message identity", "consumer_id", "event_id"),
        missing(i, events, ["event_id"], "message of unknown event", "event_id"),
        named(i.join(events, "event_id").where("topic <> _topic"), "message topic", "event_id"),
        named(i.groupBy("consumer_id", "topic", "partition", "offset").agg(F.count_distinct("event_id").alias("_n")).where("_n > 1"), "offset conflict", "consumer_id", "topic", "partition", "offset"),
        outside(i, "disposition", DOMAINS["disposition"], "message disposition", "event_id"),
        named(w.where(any_empty("workflow_id", "event_id") | ~F.coalesce(F.col("partition_id").between(0, 15), F.lit(False))), "wakeup identity", "event_id"),
        missing(w, events, ["event_id"], "wakeup of unknown event", "event_id"),
        repeated(w, "wakeup uniqueness", "event_id"),
        outside(w, "state", DOMAINS["wakeup"], "wakeup state", "event_id"),
        named(r.where((empty("workflow_id") & ~poison) | any_empty("kind", "reference")), "item identity", "reference"),
        named(r.where(empty("workflow_id") & ~poison).select("reference").unionByName(
            r.where(~empty("workflow_id")).join(known, "workflow_id", "left_anti").select("reference")), "item of unknown workflow", "reference"),
        outside(r, "kind", DOMAINS["item_kind"], "item kind", "reference"),
        outside(r, "status", DOMAINS["item_status"], "item status", "reference"),
        missing(pending, events, ["event_id"], "item of unknown event", "reference"),
        named(pending.where("status = 'OPEN'").join(events.where("_state = 'PUBLISHED'"), "event_id"), "published but open", "event_id"),
        named(o.where("publish_state = 'QUARANTINED'").select("event_id", F.concat(F.lit("outbox/"), "event_id").alias("reference")).join(
            poisoned, "reference", "left_anti"), "quarantine without item", "event_id"),
    ]


RULES: dict[str, Callable[..., list[DataFrame]]] = {
    "history": history_rules, "results": result_rules, "submissions": submission_rules, "attempts": attempt_rules,
    "checkpoints": checkpoint_rules, "effects": effect_rules, "transport": transport_rules,
}


def check(trace: Trace, groups: Sequence[str] = tuple(RULES), topics: tuple[str, str] = (EVENT_TOPIC, TASK_TOPIC)) -> DataFrame:
    """All violations as (rule, key); one lazy plan. No row means that the trace is valid. topics: of events and of tasks."""
    found = [v for g in groups for v in (RULES[g](trace, topics) if g == "transport" else RULES[g](trace))]
    return reduce(lambda a, b: a.unionByName(b), found)


def open_work(workflows: DataFrame) -> DataFrame:
    """Workflows that haven't ended: pending work, no violation."""
    return workflows.where(~F.col("state").isin(*TERMINAL)).select("workflow_id", "state", "revision")


def reconcile(submissions: DataFrame, history: DataFrame, workflows: DataFrame) -> DataFrame:
    """Accepted work has history; the last history row agrees with the stored state and revision."""
    last = history.groupBy("workflow_id").agg(F.max_by("new_state", "revision").alias("_state"), F.max("revision").alias("_revision"))
    none = missing(submissions, history, ["workflow_id"], "accepted without history", "workflow_id")
    differs = workflows.join(last, "workflow_id").where("state <> _state OR revision <> _revision")
    return none.unionByName(named(differs, "final state", "workflow_id"))


def one_terminal(accepted: DataFrame, outcomes: DataFrame, key: str, terminal: Column, lost: Column) -> DataFrame:
    """Accepted ids without exactly one terminal row, or with a lost one: (key, terminals, lost)."""
    n = outcomes.groupBy(key).agg(F.count_if(terminal).alias("terminals"), F.count_if(lost).alias("lost"))
    out = accepted.select(key).distinct().join(n, key, "left").fillna(0, ["terminals", "lost"])
    return out.where("terminals <> 1 OR lost > 0")


def witness(starts: DataFrame, ends: DataFrame, attempts: DataFrame, invocation: str, attempt_key: Sequence[str]) -> DataFrame:
    """Invocations without an end, ends without a start, starts without an attempt."""
    return reduce(lambda a, b: a.unionByName(b), [
        missing(starts, ends, [invocation], "start without end", invocation),
        missing(ends, starts, [invocation], "end without start", invocation),
        missing(starts, attempts, attempt_key, "start without attempt", invocation),
        repeated(starts, "start uniqueness", invocation), repeated(ends, "end uniqueness", invocation)])


def stale_writes(writes: DataFrame, order: str, takeover: int, epoch: str, current: int) -> DataFrame:
    """Writes after the takeover with an older epoch; there must be none."""
    return writes.where((F.col(order) > takeover) & (F.col(epoch) < current))


def coverage(spark, covered: dict[str, bool]) -> DataFrame:
    return spark.createDataFrame(sorted(covered.items()), "item string, covered boolean")


def first_reason(reasons: Sequence[tuple[str, Column]]) -> Column:
    """The first reason that holds, in order; null where none does."""
    out = F.lit(None).cast("string")
    for name, test in reversed(reasons):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def same_result(frozen: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows that only one of two results has, with their side; equal results give none."""
    a = frozen.exceptAll(derived.select(*frozen.columns)).withColumn("side", F.lit("frozen"))
    return a.unionByName(derived.select(*frozen.columns).exceptAll(frozen).withColumn("side", F.lit("derived")))
