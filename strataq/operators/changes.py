"""State changes over tables: each takes the state and a batch of requests, and gives the next state or the outcomes.

They are relational, so a batch of any size is one plan. A batch holds one request a key unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import json_equal, joined_digest
from . import sequence as S


def joined(state: DataFrame, requests: DataFrame, key: Sequence[str]) -> DataFrame:
    """state with the columns of its request, named _r_..., and _asked."""
    rest = [c for c in requests.columns if c not in key]
    r = requests.select(*key, *(F.col(c).alias(f"_r_{c}") for c in rest), F.lit(True).alias("_asked"))
    return state.join(r, list(key), "left").withColumn("_asked", F.coalesce("_asked", F.lit(False)))


def changed(df: DataFrame, columns: Sequence[str], **new: Column) -> DataFrame:
    return df.select(*(new[c].alias(c) if c in new else F.col(c) for c in columns))


def insert_once(state: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """state and those rows of the batch whose key is not there yet; of several with one key the smallest row goes in."""
    rest = [c for c in state.columns if c not in key]
    fresh = batch.join(state.select(*key), list(key), "left_anti").groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, "_row.*")
    return state.unionByName(fresh)


def submit(state: DataFrame, batch: DataFrame, key: Sequence[str], order: str, digest: str) -> DataFrame:
    """The batch with its outcome: ACCEPTED for the first of a key, else REPEATED or CONFLICT with what is held already."""
    held = state.select(*key, F.col(digest).alias("_held"))
    w = S.by(key, order)
    rows = batch.join(held, list(key), "left")
    first = F.coalesce("_held", F.first(digest).over(w))
    new = F.col("_held").isNull() & (F.row_number().over(w) == 1)
    return rows.withColumn("outcome", F.when(new, "ACCEPTED").when(F.col(digest) == first, "REPEATED").otherwise("CONFLICT")).drop("_held")


def create_attempts(state: DataFrame, requests: DataFrame, key: Sequence[str], number: str = "number", current: str = "is_current") -> DataFrame:
    """A new current attempt for each requested key, numbered one above its greatest; the old ones are no longer current."""
    asked = requests.select(*key).distinct()
    old = joined(state, asked, key)
    old = changed(old, state.columns, **{current: F.col(current) & ~F.col("_asked")})
    top = asked.join(state.groupBy(*key).agg(F.max(number).alias("_top")), list(key), "left")
    new = top.select(*key, (F.coalesce("_top", F.lit(0)) + 1).alias(number), F.lit(True).alias(current))
    return old.unionByName(new, allowMissingColumns=True)


def claim(state: DataFrame, requests: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """requests (key, order, request_id, owner) with an outcome; the first by order gets an unclaimed key.

    state: key, request_id (null if unclaimed). The same request again is REPEATED, any other CONFLICT, no key NO_ATTEMPT.
    """
    held = state.select(*key, F.col("request_id").alias("_held"), F.lit(True).alias("_there"))
    w = S.by(key, order)
    rows = requests.join(held, list(key), "left")
    first = F.coalesce("_held", F.first("request_id").over(w))
    won = F.col("_held").isNull() & (F.row_number().over(w) == 1)
    return rows.withColumn("outcome", F.when(F.col("_there").isNull(), "NO_ATTEMPT").when(won, "CLAIMED").when(
        F.col("request_id") == first, "REPEATED").otherwise("CONFLICT")).drop("_held", "_there")


def heartbeat(state: DataFrame, beats: DataFrame, key: Sequence[str], ttl: int) -> DataFrame:
    """The deadline of current attempts moves to `ttl` after the last beat of their own owner that came in time."""
    own = beats.join(state.select(*key, F.col("owner").alias("_owner"), "deadline", "is_current"), list(key))
    good = own.where(F.col("is_current") & (F.col("owner") == F.col("_owner")) & (F.col("at") < F.col("deadline")))
    last = good.groupBy(*key).agg(F.max("at").alias("_at"))
    return changed(state.join(last, list(key), "left"), state.columns, deadline=F.greatest("deadline", F.col("_at") + ttl))


def record_results(state: DataFrame, results: DataFrame, key: Sequence[str], order: str, body: str) -> DataFrame:
    """results with an outcome: RECORDED, or against the held or first result of the key REPEATED (equal JSON) or CONFLICT."""
    held = state.select(*key, F.col(body).alias("_held"))
    w = S.by(key, order)
    rows = results.join(held, list(key), "left")
    first = F.coalesce("_held", F.first(body).over(w))
    new = F.col("_held").isNull() & (F.row_number().over(w) == 1)
    return rows.withColumn("_first", first).withColumn("outcome", F.when(new, "RECORDED").when(
        json_equal(F.col(body), F.col("_first")), "REPEATED").otherwise("CONFLICT")).drop("_held", "_first")


def finalize(state: DataFrame, deliveries: DataFrame, key: Sequence[str]) -> DataFrame:
    """Claimed publications are PUBLISHED where delivered, else PENDING again with one more try; others stay."""
    mine = F.col("_asked") & (F.col("publish_state") == "CLAIMED")
    new = F.when(mine & F.col("_r_delivered"), "PUBLISHED").when(mine, "PENDING").otherwise(F.col("publish_state"))
    return changed(joined(state, deliveries, key), state.columns, publish_state=new, tries=F.col("tries") + (mine & ~F.coalesce("_r_delivered", F.lit(False))).cast("int"))


def quarantine(state: DataFrame, poison: DataFrame, key: Sequence[str], items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unpublished poison is QUARANTINED, and an OPEN item (kind, reference) stands for it, once."""
    hit = F.col("_asked") & (F.col("publish_state") != "PUBLISHED")
    both = joined(state, poison, key)
    new = both.where(hit).select(F.lit("POISON_RECORD").alias("kind"), F.concat(F.lit("outbox/"), F.concat_ws("/", *key)).alias("reference"), F.lit("OPEN").alias("status"))
    return changed(both, state.columns, publish_state=F.when(hit, "QUARANTINED").otherwise(F.col("publish_state"))), insert_once(items, new, ["kind", "reference"])


def resolve(items: DataFrame, decisions: DataFrame, key: Sequence[str]) -> DataFrame:
    """OPEN items become RESOLVED or ABANDONED as decided; a decided item stays as it is."""
    fits = F.col("_asked") & (F.col("status") == "OPEN") & F.col("_r_decision").isin("RESOLVED", "ABANDONED")
    return changed(joined(items, decisions, key), items.columns, status=F.when(fits, F.col("_r_decision")).otherwise(F.col("status")))


def decide(intents: DataFrame, decisions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Decisions bound to a proposal: one applies to a PENDING intent whose proposal digest it names. An approval grants
    the scope digest, anything else gives none."""
    digest = joined_digest(F.col("target"), F.col("arguments"), F.col("revision"))
    fits = F.col("_asked") & (F.col("decision") == "PENDING") & (F.col("_r_proposal") == digest)
    new = F.when(fits, F.col("_r_decision")).otherwise(F.col("decision"))
    grant = F.when(fits & (F.col("_r_decision") == "APPROVED"), joined_digest(digest, F.col("revision"), F.col("target"))).otherwise(F.col("grant_scope"))
    return changed(joined(intents, decisions, key), intents.columns, decision=new, grant_scope=grant,
                   dispatch=F.when(fits & (F.col("_r_decision") == "APPROVED"), "GRANTED").otherwise(F.col("dispatch")))


def cancel(parents: DataFrame, children: DataFrame, requests: DataFrame, key: str, terminal: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Requested parents that haven't ended are CANCELED, and with them their children that haven't."""
    live = lambda: ~F.col("state").isin(*terminal)
    hit = joined(parents, requests, [key])
    gone = hit.where(F.col("_asked") & live()).select(key)
    one = changed(hit, parents.columns, state=F.when(F.col("_asked") & live(), "CANCELED").otherwise(F.col("state")))
    two = joined(children, gone, [key])
    return one, changed(two, children.columns, state=F.when(F.col("_asked") & live(), "CANCELED").otherwise(F.col("state")))


def resolve_unknown(effects: DataFrame, findings: DataFrame, key: Sequence[str], audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Effects of unknown outcome are APPLIED where a receipt was found and ABANDONED where it is certain that there is none;
    each change leaves an audit row (key, old, new)."""
    open_ = F.col("_asked") & (F.col("outcome") == "OUTCOME_UNKNOWN") & F.col("_r_found").isNotNull()
    new = F.when(open_ & F.col("_r_found"), "APPLIED").when(open_, "ABANDONED").otherwise(F.col("outcome"))
    both = joined(effects, findings, key)
    trail = both.where(open_).select(*key, F.col("outcome").alias("old"), new.alias("new"))
    return changed(both, effects.columns, outcome=new), audit.unionByName(trail)


def allocate(state: DataFrame, requests: DataFrame, key: str, resource: str, order: str) -> DataFrame:
    """Fences for new keys: above the resource's greatest, in order. A known key keeps its fence; state: key, resource, fence."""
    new = requests.join(state.select(key), key, "left_anti").groupBy(key, resource).agg(F.min(order).alias("_o"))
    top = state.groupBy(resource).agg(F.max("fence").alias("_top"))
    k = F.row_number().over(S.by([resource], "_o", key))
    made = new.join(top, resource, "left").withColumn("fence", F.coalesce("_top", F.lit(0)) + k)
    return state.unionByName(made.select(key, resource, F.col("fence").cast(state.schema["fence"].dataType)))


def staged(rows: DataFrame, key: Sequence[str], order: Sequence[str], step: str, steps: Sequence[str], allowed: Column) -> DataFrame:
    """How far each key has got through `steps`, taken one by one: a step counts if it is allowed and all before it were
    taken earlier. Gives key and reached (the name of the last step, or null)."""
    place = F.array_position(F.array(*map(F.lit, steps)), F.col(step))
    good = rows.where(allowed & (place > 0)).withColumn("_p", place)
    # First times of the steps decide, one step after the other: a step's time is its first after the step before.
    at = good.select(*key, F.struct(*order).alias("_at"), "_p")
    reached = None
    for i in range(1, len(steps) + 1):
        own = at.where(F.col("_p") == i)
        if reached is None:
            reached = own.groupBy(*key).agg(F.min("_at").alias("_t")).withColumn("_n", F.lit(1))
        else:
            nxt = own.join(reached.where(F.col("_n") == i - 1).select(*key, "_t"), list(key)).where(F.col("_at") > F.col("_t")).groupBy(*key).agg(F.min("_at").alias("_u"))
            reached = reached.join(nxt, list(key), "left").select(*key, F.coalesce("_u", "_t").alias("_t"), F.when(F.col("_u").isNotNull(), i).otherwise(F.col("_n")).alias("_n"))
    names = F.array(*map(F.lit, steps))
    return rows.select(*key).distinct().join(reached, list(key), "left").select(*key, F.when(F.col("_n").isNotNull(), F.element_at(names, F.col("_n").cast("int"))).alias("reached"))
