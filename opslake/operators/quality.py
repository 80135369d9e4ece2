"""Data-quality rules: row rules, event contracts, keys and references."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake import schemas
from opslake.functions.skew import salted_join
from opslake.functions.text import is_blank


@dataclass(frozen=True)
class Rule:
    """A named test; ``broken`` is true for rows that violate it."""

    message: str
    broken: Callable[[], Column]


def not_blank(column: str, message: str) -> Rule:
    return Rule(message, lambda: is_blank(F.col(column)))


def not_null(column: str, message: str) -> Rule:
    return Rule(message, lambda: F.col(column).isNull())


def max_length(column: str, length: int, message: str) -> Rule:
    return Rule(message, lambda: F.coalesce(F.length(column) > length, F.lit(False)))


def positive(column: str, message: str) -> Rule:
    return Rule(message, lambda: F.coalesce(F.col(column) <= 0, F.lit(False)))


def between(column: str, low: int, high: int, message: str) -> Rule:
    return Rule(message, lambda: F.coalesce(~F.col(column).between(low, high), F.lit(False)))


def one_of(column: str, values: tuple[str, ...], message: str) -> Rule:
    return Rule(message, lambda: F.coalesce(~F.col(column).isin(*values), F.lit(True)))


# Limits and messages of the request rules.
JOB_RULES = [
    not_blank("name", "Job name is required"),
    max_length("name", 255, "Job name must not exceed 255 characters"),
    max_length("cron_expression", 100, "Cron expression must not exceed 100 characters"),
    positive("sla_seconds", "SLA seconds must be positive"),
    positive("grace_period_seconds", "Grace period must be positive"),
    positive("expected_runtime_seconds", "Expected runtime must be positive"),
    positive("timeout_seconds", "Timeout must be positive"),
    positive("max_retries", "Max retries must be positive"),
]
ALERT_RULE_RULES = [
    not_blank("name", "Alert rule name is required"),
    max_length("name", 255, "Name must not exceed 255 characters"),
    max_length("description", 2000, "Description must not exceed 2000 characters"),
    not_blank("rule_type", "Rule type is required"),
    max_length("rule_type", 50, "Rule type must not exceed 50 characters"),
    not_null("condition_json", "Condition JSON is required"),
    positive("cooldown_seconds", "Cooldown seconds must be positive"),
]
NOTIFICATION_RULES = [
    not_blank("channel", "Channel is required"),
    not_blank("recipient", "Recipient is required"),
    max_length("recipient", 500, "Recipient must not exceed 500 characters"),
    max_length("subject", 500, "Subject must not exceed 500 characters"),
    positive("priority", "Priority must be positive"),
]
QUEUE_RULES = [
    not_blank("job_type", "Job type is required"),
    between("priority", 1, 10, "Priority must be between 1 and 10"),
]
USER_RULES = [
    not_blank("username", "Username is required"),
    max_length("username", 100, "Username must not exceed 100 characters"),
    not_blank("email", "Email is required"),
    one_of("role", schemas.ROLES, "Role must be one of ADMIN, OPERATOR, VIEWER"),
]
INGEST_RULES = [
    not_blank("job_name", "Job name is required"),
    not_blank("event_type", "Event type is required"),
]


def row_violations(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add the messages of the rules each row breaks."""
    return rows.withColumn(
        "violations", F.array_compact(F.array(*(F.when(r.broken(), F.lit(r.message)) for r in rules)))
    )


def split_valid(rows: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    checked = row_violations(rows, rules)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def _contract_checks(fields: Column) -> Column:
    """Contract violations of an event given as a map from field name to text."""

    def field(name: str) -> Column:
        return F.element_at(fields, name)

    kind = field("eventType")
    always: list[Column] = [
        F.when(fields.isNull(), F.lit("not a JSON object")),
        F.when(~F.coalesce(kind.isin(*schemas.CONTRACTS), F.lit(False)), F.lit("eventType")),
    ]
    for name in schemas.ENVELOPE_FIELDS[:5]:
        if name != "eventType":
            always.append(F.when(field(name).isNull(), F.lit(f"missing {name}")))

    # Only the branch of the event's own type is evaluated.
    own = F.array().cast("array<string>")
    for event_type, contract in schemas.CONTRACTS.items():
        checks = [F.when(field("source") != contract["source"], F.lit("source"))]
        checks += [F.when(field(n).isNull(), F.lit(f"missing {n}")) for n in contract["required"]]
        checks += [F.when(~field(n).isin(*v), F.lit(f"bad {n}")) for n, v in contract["enums"].items()]
        own_fields = [*schemas.ENVELOPE_FIELDS, *contract["required"], *contract["optional"]]
        for name in own_fields:
            if kind_of := schemas.FIELD_FORMATS.get(name):
                checks.append(F.when(~field(name).rlike(schemas.FORMATS[kind_of]), F.lit(f"bad {name}")))
            if name in schemas.WHOLE_NUMBERS:
                low, high = schemas.WHOLE_NUMBERS[name], 10 if name == "priority" else 2**31 - 1
                number = F.when(field(name).rlike(r"^-?[0-9]+\z"), field(name).try_cast("bigint"))
                fits = F.coalesce(number.between(-(2**31) if low is None else low, high), F.lit(False))
                checks.append(F.when(field(name).isNotNull() & ~fits, F.lit(f"bad {name}")))
        known = [*schemas.ENVELOPE_FIELDS, *contract["required"], *contract["optional"]]
        unknown = F.array_except(F.map_keys(fields), F.array(*(F.lit(k) for k in known)))
        listed = F.concat(
            F.array_compact(F.array(*checks)), F.transform(unknown, lambda k: F.concat(F.lit("unknown "), k))
        )
        own = F.when(kind == event_type, listed).otherwise(own)
    return F.array_sort(F.concat(F.array_compact(F.array(*always)), own))


def event_contract(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Add what each JSON event text violates: missing fields, bad values, unknown keys.  The text is parsed once."""
    parsed = events.withColumn("_fields", F.from_json(F.col(payload), "map<string,string>"))
    return parsed.withColumn("violations", _contract_checks(F.col("_fields"))).drop("_fields")


def duplicate_names(candidates: DataFrame, existing: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """Candidates whose key is already taken by a row with another id.

    Per key it is enough to know the smallest and largest id, so the existing
    side is one row per key whatever its size.
    """
    taken = existing.groupBy(*keys).agg(F.min(identity).alias("_low"), F.max(identity).alias("_high"))
    other = (F.col("_low") != F.col(identity)) | (F.col("_high") != F.col(identity))
    return salted_join(candidates, taken, keys, identity).filter(other).drop("_low", "_high")


def orphan_rows(rows: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Keys without a parent and how many rows carry them.  Rows collapse per key before the join."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    return counted.join(parents.select(*keys).distinct(), keys, "left_anti")


def constraint_report(
    table: DataFrame, name: str, unique: dict[str, list[str]], required: list[str], allowed: dict[str, tuple[str, ...]]
) -> DataFrame:
    """Violations per constraint of a table: duplicate keys, nulls, values outside the list."""
    simple = [F.count_if(F.col(c).isNull()).alias(f"not_null:{c}") for c in required]
    simple += [
        F.count_if(F.coalesce(~F.col(c).isin(*values), F.lit(False))).alias(f"allowed:{c}")
        for c, values in allowed.items()
    ]
    parts = []
    if simple:
        wide = table.agg(*simple)
        pairs = [F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("violations")) for c in wide.columns]
        parts.append(wide.select(F.explode(F.array(*pairs)).alias("p")).select("p.rule", "p.violations"))
    for label, keys in unique.items():
        keyed = table.dropna(subset=keys)  # a key with a null part equals no other
        repeated = keyed.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
        parts.append(
            repeated.agg(F.count("*").alias("violations")).select(F.lit(f"unique:{label}").alias("rule"), "violations")
        )
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report.select(F.lit(name).alias("table_name"), "rule", "violations")
