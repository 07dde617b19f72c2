"""Evidence joins: what independent records must agree on. Each function gives violations as (rule, key), none if all agree."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import joined_digest
from . import sequence as S
from .invariants import missing, named


def all_of(*found: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), found)


def not_one(rows: DataFrame, owners: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    """Owners that have no row or several."""
    n = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    both = owners.select(*key).distinct().join(n, list(key), "left")
    return named(both.where(F.coalesce("_n", F.lit(0)) != 1), rule, *key)


def exchanges(rows: DataFrame, session: str, number: str, delivery: str, event: str, digest: str, sealed: DataFrame,
              expected: Sequence[str]) -> DataFrame:
    """A session's records are numbered without gaps up to its sealed high water; a delivery's events are exactly the
    expected ones in order, and all its bytes have one digest. sealed: session, high_water."""
    numbered = S.contiguity(rows, [session], number, 0)
    top = rows.groupBy(session).agg(F.max(number).alias("_top")).join(sealed, session, "full")
    return all_of(
        named(numbered.select(session).distinct(), "sequence gap", session),
        named(top.where(~(F.col("_top") + 1).eqNullSafe(F.col("high_water"))), "high water", session),
        named(S.exact_sequence(rows, [delivery], [number], event, expected), "event order", delivery),
        named(rows.groupBy(delivery).agg(F.count_distinct(digest).alias("_n")).where("_n > 1"), "forwarded bytes", delivery))


def mutations(calls: DataFrame, journal: DataFrame, receipts: DataFrame, key: str, outcome: Column) -> DataFrame:
    """Applied calls, journal entries and receipts stand one for one by key; calls that weren't applied have no entry."""
    applied = calls.where(outcome).select(key)
    other = calls.where(~outcome).select(key).distinct().join(applied, key, "left_anti")
    return all_of(
        missing(applied.distinct(), journal, [key], "applied without entry", key),
        missing(journal.select(key).distinct(), applied, [key], "entry without applied call", key),
        named(applied.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"), "applied twice", key),
        missing(applied.distinct(), receipts, [key], "applied without receipt", key),
        named(other.join(receipts.select(key).distinct(), key, "left_semi"), "receipt without applied call", key))


def fault_boundaries(faults: DataFrame, boundaries: dict[str, DataFrame], key: str) -> DataFrame:
    """faults: boundary and key. Each boundary names the rows that a fault there must have left; one without is unknown."""
    known = list(boundaries)
    found = [missing(faults.where(F.col("boundary") == b), rows, [key], f"no evidence at {b}", key) for b, rows in boundaries.items()]
    return all_of(named(faults.where(~F.col("boundary").isin(known)), "unknown boundary", key), *found)


# What a trace may hold at a fault's boundary: name -> view and condition.
BOUNDARIES = {
    "created event": ("outbox", "event_type = 'workflow.created'"), "dispatch event": ("outbox", "event_type IN ('attempt.dispatch', 'attempt.redispatch')"),
    "published event": ("outbox", "publish_state = 'PUBLISHED'"), "pending event": ("outbox", "publish_state = 'PENDING'"),
    "quarantined event": ("outbox", "publish_state = 'QUARANTINED'"), "claimed attempt": ("attempts", "state = 'CLAIMED'"),
    "timed out attempt": ("attempts", "state = 'TIMED_OUT'"), "succeeded attempt": ("attempts", "state = 'SUCCEEDED'"),
    "current attempt": ("attempts", "is_current"), "recorded result": ("attempts", "result_recorded"),
    "replacement attempt": ("attempts", "attempt_number > 1"), "consumed result": ("history", "reason = 'RESULT_CONSUMED'"),
    "scheduler transition": ("history", "actor_kind = 'scheduler'"), "terminal state": ("history", "new_state IN ('SUCCEEDED', 'FAILED', 'REJECTED', 'CANCELED', 'ABANDONED')"),
    "open item": ("reconciliation", "status = 'OPEN'"), "consumed wakeup": ("wakeups", "state = 'CONSUMED'"),
}


def boundary_rows(trace: dict[str, DataFrame], names: Sequence[str] = tuple(BOUNDARIES)) -> DataFrame:
    """(boundary, workflow_id) of the workflows that have what a boundary asks for: the right side of a semi or anti join."""
    return all_of(*(trace[BOUNDARIES[n][0]].where(BOUNDARIES[n][1]).select(F.lit(n).alias("boundary"), "workflow_id").distinct() for n in names))


def ingress_and_sink(ingress: DataFrame, calls: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Requests seen at the door and calls exported by the sink: none on one side alone, and equal columns on both."""
    a, b = ingress.alias("a"), calls.alias("b")
    differs = reduce(lambda x, y: x | y, (~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns))
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).where(differs).select(F.col(f"a.{key}").alias(key))
    return all_of(missing(ingress, calls, [key], "request without call", key), missing(calls, ingress, [key], "call without request", key),
                  named(both.distinct(), "columns differ", key))


def witness_ledger(starts: DataFrame, ends: DataFrame, attempts: DataFrame, receipts: DataFrame, invocation: str, attempt: Sequence[str]) -> DataFrame:
    """An invocation ledger against attempts and receipts: each start has one end and an attempt, no end stands alone,
    and an attempt with a receipt has been started."""
    return all_of(
        missing(starts, ends, [invocation], "start without end", invocation),
        missing(ends, starts, [invocation], "end without start", invocation),
        named(ends.groupBy(invocation).agg(F.count("*").alias("_n")).where("_n > 1"), "several ends", invocation),
        missing(starts, attempts, list(attempt), "start without attempt", invocation),
        missing(receipts, starts, list(attempt), "receipt without start", *attempt))


def offsets(broker: DataFrame, inbox: DataFrame, position: DataFrame, partition: str, offset: str, event: str) -> DataFrame:
    """Records below a partition's next offset are without gaps and each has its disposition with the same event.

    position: partition and next_offset; inbox: partition, offset, event and disposition, ACCEPTED for the last one.
    """
    key = [partition, offset]
    low = broker.join(position, partition).where(F.col(offset) < F.col("next_offset"))
    held = inbox.select(*key, F.col(event).alias("_event"), "disposition")
    joined = low.join(held, key, "left")
    n = low.groupBy(partition).agg(F.count_distinct(offset).alias("_n"))
    short = position.join(n, partition, "left").where(F.coalesce("_n", F.lit(0)) != F.col("next_offset"))
    return all_of(
        named(short, "low range", partition),
        named(joined.where("_event IS NULL"), "no disposition", *key),
        named(joined.where(F.col("_event") != F.col(event)), "other event", *key),
        named(joined.where((F.col(offset) == F.col("next_offset") - 1) & (F.col("disposition") != "ACCEPTED")), "last not accepted", *key))


def relay(publications: DataFrame, broker: DataFrame, event: str, key: str) -> DataFrame:
    """What the relay has marked as published is in the broker, under its own key, and nothing else is."""
    there = broker.select(event, F.col(key).alias("_key")).distinct()
    return all_of(
        missing(publications, there, [event], "published without record", event),
        missing(there, publications, [event], "record without publication", event),
        named(publications.join(there, event).where(~F.col("_key").eqNullSafe(F.col(key))).select(event).distinct(), "record key", event))


def claims_at_hold(attempts: DataFrame, audits: DataFrame, results: DataFrame, starts: DataFrame, key: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """A held attempt is claimed, current and without a result; it equals its one claim audit; nothing was recorded or started."""
    held = attempts.where("held")
    other = audits.select(*key, *(F.col(c).alias(f"_{c}") for c in identity))
    differs = reduce(lambda x, y: x | y, (~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in identity))
    return all_of(
        not_one(audits.join(held.select(*key), list(key), "left_semi"), held, key, "claim audit"),
        named(held.join(other, list(key)).where(differs).select(*key).distinct(), "claim identity", *key),
        named(held.where((F.col("state") != "CLAIMED") | ~F.col("is_current")), "claim state", *key),
        named(held.select(*key).join(results.select(*key).distinct(), list(key)), "result at hold", *key),
        named(held.select(*key).join(starts.select(*key).distinct(), list(key)), "invocation at hold", *key))


def claims_after(attempts: DataFrame, starts: DataFrame, key: Sequence[str], number: str, deadline: str, replaced: str) -> DataFrame:
    """After the lease ran out: attempt 1 timed out and never started, attempt 2 succeeded, and it was made no earlier
    than attempt 1's deadline; only attempt 2 started."""
    one = attempts.where(F.col(number) == 1)
    two = attempts.where(F.col(number) == 2).select(*key, F.col("state").alias("_state"), F.col(replaced).alias("_at"))
    both = one.join(two, list(key), "left")
    return all_of(
        named(one.where("state <> 'TIMED_OUT'"), "expired claim", *key),
        named(both.where("_state IS NULL OR _state <> 'SUCCEEDED'"), "replacement", *key),
        named(both.where(F.col("_at") < F.col(deadline)), "replaced before the deadline", *key),
        named(starts.where(F.col(number) == 1).select(*key).distinct(), "expired attempt started", *key),
        missing(one, starts.where(F.col(number) == 2), key, "replacement not started", *key))


def receipts_at_hold(receipts: DataFrame, history: DataFrame, key: str, revision: str) -> DataFrame:
    """A recorded result is the workflow's last revision, by its own revision number, and not yet consumed."""
    last = history.groupBy(key).agg(F.max(revision).alias("_last"), F.count_if(F.col("reason") == "RESULT_CONSUMED").alias("_consumed"),
                                    F.max(F.when(F.col("reason") == "ATTEMPT_RESULT_RECORDED", F.col(revision))).alias("_recorded"))
    both = receipts.select(key).distinct().join(last, key, "left")
    return all_of(named(both.where("_recorded IS NULL"), "no result record", key),
                  named(both.where("_recorded <> _last"), "not the last revision", key),
                  named(both.where("_consumed > 0"), "consumed at hold", key))


def receipts_after(before: DataFrame, after: DataFrame, history: DataFrame, key: str, revision: str, identity: Sequence[str]) -> DataFrame:
    """The receipt stays what it was, and is consumed at the next revision, by another owner with a higher epoch."""
    same = after.select(key, *(F.col(c).alias(f"_{c}") for c in identity))
    differs = reduce(lambda x, y: x | y, (~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in identity))
    used = history.where("reason = 'RESULT_CONSUMED'").select(key, F.col(revision).alias("_revision"), F.col("owner").alias("_owner"), F.col("epoch").alias("_epoch"))
    both = before.join(used, key, "left")
    return all_of(
        named(before.join(same, key, "left").where(differs), "receipt changed", key),
        not_one(used.join(before.select(key), key, "left_semi"), before, [key], "consumption"),
        named(both.where(F.col("_revision") != F.col(revision) + 1), "not the next revision", key),
        named(both.where(F.col("_epoch") <= F.col("epoch")), "epoch not advanced", key),
        named(both.where(F.col("_owner") == F.col("owner")), "owner unchanged", key))


def stale_writes_rejected(writes: DataFrame, takeovers: DataFrame, key: str, order: str) -> DataFrame:
    """No write after a takeover's commit carries the epoch or the session before it. takeovers: key, taken_at, old_epoch,
    old_session."""
    late = writes.join(takeovers, key).where(F.col(order) > F.col("taken_at"))
    return all_of(named(late.where("epoch <= old_epoch"), "old epoch", key, order), named(late.where("session = old_session"), "old session", key, order))


def lease_commits(leases: DataFrame, audits: DataFrame, calls: DataFrame, transaction: str, columns: Sequence[str]) -> DataFrame:
    """Every lease write has an audit of its transaction with the same columns; a call with a stale epoch ends in STALE_EPOCH
    and nothing else, a call with the live one never does."""
    other = audits.select(transaction, *(F.col(c).alias(f"_{c}") for c in columns))
    differs = reduce(lambda x, y: x | y, (~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns))
    stale = F.col("epoch") < F.col("live_epoch")
    return all_of(
        missing(leases, audits, [transaction], "write without audit", transaction),
        named(leases.join(other, transaction).where(differs), "audit differs", transaction),
        named(calls.where(stale & (F.col("outcome") != "STALE_EPOCH")), "stale call not rejected", "call_id"),
        named(calls.where(~stale & (F.col("outcome") == "STALE_EPOCH")), "live call rejected", "call_id"))


def backlog(pending: DataFrame, published: DataFrame, arrivals: DataFrame, retained: DataFrame, restarted: DataFrame, key: str) -> DataFrame:
    """Over a restart: no id is pending and published, each arrival has one created event, and the retained set is the same."""
    created = pending.where("event_type = 'workflow.created'").select(key).unionByName(published.where("event_type = 'workflow.created'").select(key))
    return all_of(
        named(pending.select(key).distinct().join(published.select(key).distinct(), key), "pending and published", key),
        not_one(created.join(arrivals.select(key), key, "left_semi"), arrivals, [key], "created event"),
        missing(retained, restarted, [key], "lost over the restart", key), missing(restarted, retained, [key], "new over the restart", key))


def restart_cell(offers: DataFrame, accepted: DataFrame, census: DataFrame, publications: DataFrame, key: str, clock: str, start: int, end: int) -> DataFrame:
    """Offers lie in the fault window [start, end), the accepted ids are those of the census, and nothing of the backlog is
    published before the boundary, or left unpublished."""
    return all_of(
        named(offers.where((F.col(clock) < start) | (F.col(clock) >= end)), "offer outside the window", key),
        missing(accepted, census, [key], "accepted but not counted", key), missing(census, accepted, [key], "counted but not accepted", key),
        named(publications.where(F.col("published_at") < end), "published before the boundary", key),
        named(publications.where("published_at IS NULL"), "not drained", key))


def stop_schedule(stops: DataFrame, plan: DataFrame, key: str, late: int) -> DataFrame:
    """Every planned stop has one record, no earlier than planned and at most `late` after. plan: key, due; stops: key, at."""
    both = plan.join(stops, key, "left")
    return all_of(not_one(stops, plan, [key], "stop record"), missing(stops, plan, [key], "unplanned stop", key),
                  named(both.where("at < due"), "early stop", key), named(both.where(F.col("at") > F.col("due") + late), "late stop", key))


def single_session(events: DataFrame, sessions: DataFrame, key: str, event: str, clock: str) -> DataFrame:
    """event, sessions: how many sessions of the same key hold each event, as [began, ended); one is right.

    Both sides are steps on one line by key, so no pair of event and session is formed.
    """
    none = F.lit(None).cast(events.schema[event].dataType)
    step = lambda c, d: sessions.select(key, F.col(c).alias("_at"), F.lit(0).alias("_turn"), F.lit(d).alias("_d"), none.alias(event))
    rows = all_of(step("began", 1), step("ended", -1), events.select(key, F.col(clock).alias("_at"), F.lit(1).alias("_turn"), F.lit(0).alias("_d"), event))
    run = F.sum("_d").over(S.by([key], "_at", "_turn").rowsBetween(-(2**63), 0))
    return rows.withColumn("sessions", run).where(F.col(event).isNotNull()).select(event, "sessions")


def seals(prefixes: DataFrame, sealed: DataFrame, key: str) -> DataFrame:
    """The length, digest and rows of each sealed prefix. prefixes: key, content, rows; sealed: key, size, digest, lines."""
    both = sealed.join(prefixes.select(key, F.length("content").alias("_size"), F.sha2("content", 256).alias("_digest"), F.col("rows").alias("_rows")), key, "left")
    return all_of(named(both.where("_size IS NULL"), "no prefix", key), named(both.where("_size <> size"), "length", key),
                  named(both.where("_size = size AND _digest <> digest"), "digest", key), named(both.where("_rows <> lines"), "rows", key))


def mutual_exclusion(leases: DataFrame, transitions: DataFrame, key: str, checked: Column) -> DataFrame:
    """Owner transitions against the lease row: epoch as in the lease, and, where the expiry was checked, not before it.
    leases: key, expires, epoch; transitions: key, at, new_epoch."""
    both = transitions.join(leases, key, "left")
    return all_of(named(both.where("epoch IS NULL"), "no lease", key), named(both.where("new_epoch <> epoch + 1"), "epoch step", key),
                  named(both.where(checked & (F.col("at") < F.col("expires"))), "taken before expiry", key))


def grant_scope(token: Column, intent: Column, target: Column, arguments: Column) -> Column:
    return joined_digest(token, intent, target, arguments)


def exact_grants(grants: DataFrame, asked: dict[str, object], scope: Column, as_of: Column) -> DataFrame:
    """Grants that equal what is asked for in every column, whose stored scope is the digest of their parts, and live."""
    out = grants
    for name, value in asked.items():
        out = out.where(F.col(name).eqNullSafe(F.lit(value)))
    return out.where((F.col("scope_hash") == scope) & (as_of < F.col("expires_at")))


def grant_problem(state: Column, scope: Column, stored: Column, expires: Column, target: Column, wanted: Column, as_of: Column) -> Column:
    """The first thing that makes a grant invalid, or null."""
    from .invariants import first_reason

    return first_reason([("state", state != "GRANTED"), ("scope", ~scope.eqNullSafe(stored)), ("expired", ~F.coalesce(as_of < expires, F.lit(False))),
                         ("target", ~target.eqNullSafe(wanted))])


