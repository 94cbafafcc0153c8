"""Per-record decisions as Column functions, all within whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses by what is done with the message.
STORE = ["NOT_FOUND", "INVALID_ARGUMENT", "FAILED_PRECONDITION", "ABORTED", "OUT_OF_RANGE", "DATA_LOSS"]
OUTCOMES = ["DLQ", "RETRY", "RESQ", "BACKOFF", "DROPPED", "INVALID", "SKIP", "COMMIT"]
MIN_TIMEOUT_MS, MAX_TIMEOUT_MS = 1, 1_800_000


def action_code(action: Column) -> Column:
    return F.when(action == "Retry", "RETRY").when(action == "Stash", "DLQ").when(action == "Skip", "SKIP").when(action.isNotNull(), "INVALID")


def status_code(status: Column, overdue: Column) -> Column:
    late = F.when(overdue, "BACKOFF").otherwise("INVALID")
    return (
        F.when(status == "OK", "COMMIT")
        .when(status == "ALREADY_EXISTS", "SKIP")
        .when(status == "RESOURCE_EXHAUSTED", "RETRY")
        .when(status.isin(STORE), "DLQ")
        .when(status == "UNAVAILABLE", late)
        .when(status == "DEADLINE_EXCEEDED", "BACKOFF")
        .otherwise("INVALID")
    )


def outcome(action: Column, status: Column, overdue: Column) -> Column:
    """An explicit action goes before the status."""
    return F.coalesce(action_code(action), status_code(status, overdue))


def health_issue(action: Column, status: Column) -> Column:
    """Issue that a response points to, without the latency check; null for none."""
    return F.when(action.isNotNull(), None).when(status.isin("UNAVAILABLE", "UNKNOWN", "UNIMPLEMENTED", "INTERNAL"), "invalid-response").when(status.isin("PERMISSION_DENIED", "UNAUTHENTICATED"), "permission-denied")


def topic_role(physical: Column) -> Column:
    """Which reader a topic takes."""
    return F.when(physical.endswith("__retry"), "RETRY").when(physical.endswith("__dlq"), "DLQ").when(physical.endswith("__resq"), "RESQ").otherwise("ORIGINAL")


def seek_original(start: Column, earliest: Column, latest: Column, policy: Column) -> Column:
    """Start offset: as specified inside the bounds, or outside them when no policy says otherwise."""
    outside = F.coalesce(start < earliest, F.lit(False)) | F.coalesce(start > latest, F.lit(False))
    return F.when(outside & (policy == "EARLIEST"), earliest).when(outside & (policy == "LATEST"), latest).otherwise(start)


def seek_dead_letter(start: Column, earliest: Column, latest: Column) -> Column:
    """Start offset moved into the bounds; null: don't seek."""
    return F.when(start < earliest, earliest).when(start > latest, latest)


def rpc_timeout(base_ms: Column, timeouts: Column, low: int = MIN_TIMEOUT_MS, high: int = MAX_TIMEOUT_MS) -> Column:
    clamped = F.least(F.lit(high), F.greatest(F.lit(low), base_ms))
    return F.least(F.lit(float(high)), clamped * F.pow(F.lit(2.0), F.least(timeouts, F.lit(40)))).cast("long")


def offset_to_commit(offset: Column, committed: Column) -> Column:
    """Null: nothing to commit."""
    return F.when((offset > 0) & (offset >= committed), offset)


def commit_eligible(offset: Column, previous: Column, since_ms: Column, keep_alive_ms: int = 60_000) -> Column:
    return (offset > 0) & ((offset != F.coalesce(previous, F.lit(-1))) | (since_ms > keep_alive_ms))


def timeout_escalation(code: Column, role: Column, timeouts: Column, most: int, has_token: Column) -> Column:
    """What becomes of a BACKOFF; other codes stay."""
    spent = F.lit(most > 0) & (timeouts >= most) & has_token
    return F.when(code != "BACKOFF", code).when(role == "DLQ", "DLQ").when(role == "RESQ", "INVALID").when(spent, "DLQ").otherwise("RETRY")


def settled_code(code: Column) -> Column:
    return F.when(code.isin("SKIP", "COMMIT"), "COMMIT").when(code.isin("RETRY", "RESQ", "DLQ"), code).otherwise("INVALID")


def stops_in_place(code: Column, dlq: Column, retry: Column, resq: Column) -> Column:
    """Whether retries in the process end; without its own topic DLQ falls through to RETRY."""
    return F.when(code.isin("SKIP", "COMMIT"), True).when(code == "DLQ", (dlq != "") | (retry != "")).when(code == "RETRY", retry != "").when(code == "RESQ", resq != "").otherwise(False)


def permit_result(code: Column, failed: Column) -> Column:
    return F.when(failed, "COMPLETED").when(code.isin("INVALID", "BACKOFF"), "FAILED").when(code == "DROPPED", "DROPPED").otherwise("SUCCEEDED")


def cancel_rule(role: Column, retry: Column, resq: Column) -> Column:
    """(code, cost, reasons) of the first rule that applies; null for none."""
    first = F.struct(F.lit("RESQ").alias("code"), F.lit(2).alias("cost"), F.lit("BLOCKING,SATURATION").alias("reasons"))
    second = F.struct(F.lit("RETRY").alias("code"), F.lit(50).alias("cost"), F.lit("BLOCKING").alias("reasons"))
    return F.when(role == "DLQ", None).when((role != "RESQ") & (resq != ""), first).when(~role.isin("RETRY", "RESQ") & (retry != ""), second)


def response_status(code: Column) -> Column:
    """The status that a consumer sends for an outcome: the inverse of status_code."""
    return F.when(code == "COMMIT", "OK").when(code == "RETRY", "RESOURCE_EXHAUSTED").when(code == "DLQ", "FAILED_PRECONDITION").when(code == "SKIP", "ALREADY_EXISTS").otherwise("UNKNOWN")


def address_of(uri: Column) -> Column:
    """The part after the scheme's slashes, cut at the first character no address has; `unknown` without one."""
    head = F.regexp_extract(uri, r"^([A-Za-z0-9:/._\-@%]*)", 1)
    mark = F.when(head.contains("///"), "///").otherwise("//")
    part = F.when(mark == "///", F.get(F.split(head, "///"), F.lit(1))).otherwise(F.get(F.split(head, "//"), F.lit(1)))
    return F.coalesce(F.when(part != "", part), F.lit("unknown"))


def string_hash(text: Column) -> Column:
    """The 31-based 32-bit string hash: h = 31 h + c, wrapped, over the characters of the basic plane."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    raw = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    return F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw)


def uri_bucket(uri: Column, buckets: int = 10_000) -> Column:
    """Bucket of the hash of a one-element list that holds the URI: 31 + its string hash, wrapped to 32 bits."""
    raw = F.pmod(string_hash(uri) + 31, F.lit(1 << 32))
    return F.pmod(F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw), F.lit(buckets))


def virtual_partition(name: Column, partitions: Column, buckets: int = 10_000) -> Column:
    h = string_hash(name)
    return F.abs(F.when(h < 0, -F.pmod(-h, F.lit(buckets))).otherwise(F.pmod(h, F.lit(buckets)))) % partitions


def pod_of(name: Column) -> Column:
    """What stands before the last `::`, else the empty string."""
    return F.coalesce(F.regexp_extract(name, r"^(.*)::(.*)$", 1), F.lit(""))


def throughput_scale(msgs: Column, bytes_: Column, per_msgs: float = 4000.0, per_bytes: float = 16777216.0) -> Column:
    return F.greatest(msgs / per_msgs, bytes_ / per_bytes)


def cpu_scale(msgs: Column, cpu: Column, per_cpu: float = 3.0) -> Column:
    return F.when(msgs == 0, F.lit(0.0)).otherwise(cpu / per_cpu)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))
