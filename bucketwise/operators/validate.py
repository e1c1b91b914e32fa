"""Row-wise validation of raw JSON entries with partial acceptance.

All of it is column expressions over the entry's JSON text: types are checked
on the VARIANT, so nothing is coerced, and every entry gets its first failing
field's reason, or null if it is accepted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketwise.functions.text import trimmed, variant_text
from bucketwise.functions.time import instant_column
from bucketwise.model import LEVELS

FIELDS = ("timestamp", "level", "service", "message", "attributes")
FUTURE = "timestamp is more than 5 minutes in the future"
NOT_FLAT = "attributes must be a flat object with string, number, or boolean values"
_SCALAR = r"^(STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


@dataclass(frozen=True)
class Envelope:
    """The entries of a request body, or the reason why it has none."""

    logs: list | None
    error: str | None = None


def open_envelope(body: object) -> Envelope:
    """``{"logs": [at least one entry]}`` and nothing else."""
    if not isinstance(body, dict):
        return Envelope(None, "invalid request body")
    logs = body.get("logs")
    if not isinstance(logs, list):
        return Envelope(None, "logs must be a non-empty array")
    if not logs:
        return Envelope(None, "logs array must not be empty")
    if set(body) != {"logs"}:
        return Envelope(None, "invalid request body")
    return Envelope(logs)


def _string(name: str) -> Column:
    value = F.col("entry_fields")[name]
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def validated(entries: DataFrame, now: Column | None = None, raw: str = "raw") -> DataFrame:
    """``entries`` with ``reason`` (null if accepted) and the parsed fields.

    ``raw`` is a column of JSON text.  A future limit of five minutes holds
    from ``now``, by default the start of the query.  Entries that are not
    objects or have unknown keys are ``invalid log entry``.  Of a repeated key the
    last value counts in sessions with ``session.REPEATED_KEYS``, as a store sets it.
    """
    now = F.current_timestamp() if now is None else now
    # the text is parsed once and taken apart once; all fields are looked up in the map
    df = entries.withColumn("entry_fields", F.try_variant_get(F.try_parse_json(F.col(raw)), "$", "map<string,variant>"))
    fields = F.col("entry_fields")
    is_object = fields.isNotNull()
    df = df.withColumn("timestamp", instant_column(_string("timestamp")))
    df = df.withColumn("level_text", _string("level"))
    df = df.withColumn("service", trimmed(_string("service"))).withColumn("message", trimmed(_string("message")))
    given = F.coalesce(F.map_contains_key(fields, F.lit("attributes")), F.lit(False))
    df = df.withColumn("members", F.when(given, F.try_variant_get(fields["attributes"], "$", "map<string,variant>")))
    flat = ~given | F.coalesce(
        F.forall(F.map_values("members"), lambda v: F.coalesce(F.schema_of_variant(v).rlike(_SCALAR), F.lit(False))), F.lit(False)
    )
    known = F.forall(F.map_keys(fields), lambda k: k.isin(*FIELDS))
    blank = F.lit("")
    reason = (
        F.when(~is_object, "invalid log entry")
        .when(F.col("timestamp").isNull(), "invalid timestamp")
        .when(F.col("level_text").isNull(), "invalid level")
        .when(~F.col("level_text").isin(*LEVELS), F.concat(F.lit("invalid level: '"), "level_text", F.lit("'")))
        .when(F.coalesce("service", blank) == "", "service must be a non-empty string")
        .when(F.coalesce("message", blank) == "", "message must be a non-empty string")
        .when(~flat, NOT_FLAT)
        .when(~known, "invalid log entry")
        .when(F.col("timestamp") > now + F.expr("INTERVAL 5 MINUTES"), FUTURE)
    )
    df = df.withColumn("reason", reason)
    accepted = F.col("reason").isNull()
    text = F.transform_values("members", lambda k, v: variant_text(v))
    empty = F.create_map().cast("map<string,string>")
    return (
        df.withColumn("level", F.col("level_text"))
        .withColumn("attributes_text", F.when(accepted, F.coalesce(text, empty)))
        .withColumn("attributes", F.when(accepted, F.coalesce(F.to_json(F.col("entry_fields")["attributes"]), F.lit("{}"))))
        .drop("entry_fields", "level_text", "members")
    )


def split(entries: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows in the log's columns, rejected ones with their reason),
    each with the columns in ``keep``."""
    valid = entries.where("reason IS NULL").select(
        *keep, "timestamp", "level", "service", "message", "attributes", "attributes_text"
    )
    return valid, entries.where("reason IS NOT NULL").select(*keep, "reason")
