"""Text expressions: templates, query normal form, thresholds, outbound payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and formats results must agree on.
TEMPLATE_VARIABLE = r"\{\{(\w+)\}\}"
TABLE_PATTERN = r"(?i)(?:FROM|JOIN|UPDATE|INTO)\s+(\w+)"
PREDICATE_COLUMN_PATTERN = (
    r"(?i)(?:WHERE|AND|OR|JOIN\s+\w+\s+ON)\s+(?:\w+\.)?([a-zA-Z_]\w*)\s*(?:=|<|>|IN|LIKE|BETWEEN)"
)
INDEX_COLUMNS_PATTERN = r"\(([^)]+)\)"
LOG_PREVIEW = 200
SMS_LENGTH = 160
TOKEN_PREVIEW = 12


def render_template(template: Column, variables: Column) -> Column:
    """Fill ``{{name}}`` from a string map in one pass; unknown names stay, values are not rescanned."""
    texts = F.split(template, TEMPLATE_VARIABLE, -1)
    names = F.regexp_extract_all(template, F.lit(TEMPLATE_VARIABLE), F.lit(1))
    values = F.transform(
        names, lambda name: F.coalesce(F.element_at(variables, name), F.concat(F.lit("{{"), name, F.lit("}}")))
    )
    pairs = F.zip_with(texts, values, lambda text, value: F.concat(text, F.coalesce(value, F.lit(""))))
    return F.array_join(pairs, "")


def query_normal_form(query: Column) -> Column:
    """Query text without literals, in one spacing and lower case."""
    spaced = F.regexp_replace(query, r"\s+", " ")
    unquoted = F.regexp_replace(spaced, r"'[^']*'", "?")
    return F.lower(F.trim(F.regexp_replace(unquoted, r"\b\d+\b", "?")))


def query_fingerprint(query: Column) -> Column:
    return F.substring(F.sha2(query_normal_form(query), 256), 1, 32)


def query_tables(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(TABLE_PATTERN), F.lit(1))


def query_predicate_columns(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(PREDICATE_COLUMN_PATTERN), F.lit(1))


def plain_trim(text: Column) -> Column:
    """The text without leading and trailing characters up to the space, tabs and line breaks among them."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")


def is_blank(text: Column) -> Column:
    """Null, empty, or nothing but spaces, tabs and line breaks."""
    return F.coalesce(plain_trim(text) == "", F.lit(True))


def whole_number(text: Column) -> Column:
    """The text as a bigint when it is a whole number, else null."""
    trimmed = plain_trim(text)
    return F.when(trimmed.rlike(r"^[+-]?[0-9]+$"), trimmed.try_cast("bigint"))


def condition_threshold(condition_json: Column) -> Column:
    """Whole number after the first ``threshold`` key; anything else is null."""
    return whole_number(F.regexp_extract(condition_json, r"threshold[^:]*:([^,}]*)[,}]", 1))


def truncated(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def json_escaped(text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.coalesce(escaped, F.lit(""))


def sms_text(subject: Column, body: Column) -> Column:
    full = F.concat(F.when(subject.isNotNull(), F.concat(subject, F.lit(": "))).otherwise(F.lit("")), body)
    short = F.concat(F.substring(full, 1, SMS_LENGTH - 3), F.lit("..."))
    return F.when(F.length(full) > SMS_LENGTH, short).otherwise(full)


def slack_channel(recipient: Column) -> Column:
    return F.when(recipient.startswith("#"), recipient).otherwise(F.concat(F.lit("#"), recipient))


def slack_payload(recipient: Column, subject: Column, body: Column, sender: str) -> Column:
    return F.concat(
        F.lit('{"channel":"'),
        slack_channel(recipient),
        F.lit(f'","username":"{sender}","text":"*'),
        json_escaped(subject),
        F.lit("*\\n"),
        json_escaped(body),
        F.lit('","icon_emoji":":warning:"}'),
    )


def push_payload(recipient: Column, subject: Column, body: Column, source: str) -> Column:
    return F.concat(
        F.lit('{"to":"'),
        json_escaped(recipient),
        F.lit('","notification":{"title":"'),
        json_escaped(subject),
        F.lit('","body":"'),
        json_escaped(body),
        F.lit(f'","sound":"default"}},"data":{{"source":"{source}"}},"priority":"high"}}'),
    )


def webhook_payload(subject: Column, body: Column, sent_at: str, source: str) -> Column:
    return F.concat(
        F.lit('{"subject":"'),
        json_escaped(subject),
        F.lit('","body":"'),
        json_escaped(body),
        F.lit(f'","timestamp":"{sent_at}","source":"{source}"}}'),
    )
