"""Schemas of the trace views. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "history": "workflow_id string, revision long, actor_kind string, scheduler_epoch long, old_state string, new_state string, reason string",
    "results": "workflow_id string, node_id string, iteration int, accepted boolean",
    "submissions": "namespace string, key string, hash string, workflow_id string",
    "attempts": "workflow_id string, node_id string, iteration int, attempt_number long, state string, claim_token string, "
                "worker_id string, worker_request_id string, outcome string, is_current boolean, result_recorded boolean",
    "outbox": "workflow_id string, event_id string, aggregate_revision long, event_type string, topic string, "
              "publish_state string, payload_valid boolean",
    "inbox": "consumer_id string, event_id string, topic string, partition int, offset long, disposition string",
    "wakeups": "workflow_id string, event_id string, partition_id short, state string",
    "reconciliation": "workflow_id string, kind string, reference string, status string",
    "checkpoints": "workflow_id string, node_id string, iteration int, sequence long, schema_version int, source_attempt long, "
                   "payload_valid boolean, payload_hash string",
    "effects": "workflow_id string, intent_id string, logical_effect_key string, argument_hash string, attempt_number long, "
               "grant_scope_hash string, resource_id string, outcome string, receipt_present boolean",
    "effect_calls": "workflow_id string, logical_effect_key string, argument_hash string, attempt_number long, request_id string, "
                    "outcome string",
    "approvals": "intent_id string, workflow_id string, node_id string, iteration int, proposal_hash string, target string, "
                 "arguments_valid boolean, canonical_argument_hash string, expected_resource_revision string, decision string, "
                 "dispatch_status string, grant_scope_hash string, grant_token string",
    "timers": "workflow_id string, node_id string, iteration int, purpose string, consumed boolean",
    "consumer_offsets": "consumer_id string, topic string, partition int, next_offset long",
    "workflows": "workflow_id string, state string, revision long",
}


def trace_of(spark: SparkSession, rows: dict[str, list[dict]]) -> dict[str, DataFrame]:
    """A trace from rows by view; a view without rows is empty."""
    from pyspark.sql.types import _parse_datatype_string

    out = {}
    for name, ddl in VIEWS.items():
        schema = _parse_datatype_string(ddl)
        data = [tuple(r.get(f.name) for f in schema) for r in rows.get(name, [])]
        out[name] = spark.createDataFrame(data, schema)
    return out


def read_trace(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A trace from an immutable directory of parquet files, one a view."""
    return {name: spark.read.schema(ddl).parquet(f"{path}/{name}.parquet") for name, ddl in VIEWS.items()}


FAULT_TRACE = ("schema_version string, run_id string, sequence int, seed int, event string, boundary string, command string, "
               "action string, return_code int, bounded boolean, fields map<string,string>")
LOADGEN = ("run_id string, family string, workflow_id string, block_id string, scheduled_ns long, send_ns long, finished_ns long, "
           "http_status int, outcome string, observed_latency_ms double")
