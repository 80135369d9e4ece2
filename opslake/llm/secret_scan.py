"""Secrets by pattern and by windowed entropy, in DataFrame functions only.

A row's matches are found and measured inside the row: the pieces between
matches and the matches themselves add up to positions, so nothing is shuffled
and no text leaves the engine.

Entropy: each candidate string is read character by character.  Counts of the
last ``WINDOW`` characters are kept per symbol of the candidate's class, and
the sum of c*log2(c) changes only by the symbol that enters and the one that
leaves.  A candidate whose best window reaches the threshold of its class is a
finding unless the allow-list knows it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in the order results list them, with their patterns.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy")
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGNED_CHARS = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
# Runs are taken whole, so a run that is too short is not tried again from its middle.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
WINDOW = 20
# Bits a character that the best window must reach, for each class with its symbols.
CLASSES = {
    "hex": ("0123456789abcdef", 2.8),
    "alphanumeric": ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.6),
    "base64": ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-", 3.8),
    "letters": ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 4.0),
    "one case": ("abcdefghijklmnopqrstuvwxyz", 3.8),
}
#: Classes that are measured without regard to case.
FOLDED = ("hex", "one case")
#: Letters that read as a name made of capitalised words.
NAME = r"^[A-Z]?[a-z]+([A-Z][a-z]+)+$"
#: Dates that a candidate begins with; what follows them is judged without them.
DATES = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[T/_+-]?)+"
#: Strings that look random and are no secrets: identifiers, counting rows, marked examples, paths and slugs of words.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)(example|sample|dummy|placeholder|changeme|xxxx)",
    r"(?i)(0123456789|abcdefghij|1234567890)",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"^/?[a-z]+([/_-][a-z]+|[/_-][0-9]{1,4})+/?$",
)

_BLOCK = 256


def running(values: Column, step: Callable[[Column, Column], Column], start: Column) -> Column:
    """``start`` and then the running result of ``step`` over an array; one entry more than the array has.

    One pass.  As a growing array is copied at each step, entries gather in blocks.
    """

    def add(state: Column, x: Column) -> Column:
        now, block = step(state["last"], x), state["block"]
        full = F.size(block) >= _BLOCK
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(block))).otherwise(state["done"]).alias("done"),
            F.when(full, F.array(now)).otherwise(F.concat(block, F.array(now))).alias("block"),
            now.alias("last"),
        )

    first = F.array(start)
    none = F.filter(F.array(first), lambda b: F.lit(False))
    begin = F.struct(none.alias("done"), first.alias("block"), start.alias("last"))
    return F.aggregate(values, begin, add, lambda state: F.flatten(F.concat(state["done"], F.array(state["block"]))))


def _class_of(text: Column) -> Column:
    """The narrowest class that a candidate fits; null without letters, and for other signs without digits."""
    return (
        F.when(~text.rlike("[A-Za-z]"), F.lit(None))
        .when(text.rlike("^([a-z]+|[A-Z]+)$"), F.lit("one case"))
        .when(text.rlike("^[A-Za-z]+$"), F.when(~text.rlike(NAME), F.lit("letters")))
        .when(~text.rlike("[0-9]"), F.lit(None))
        .when(text.rlike("^[0-9a-fA-F]+$"), F.lit("hex"))
        .when(text.rlike("^[0-9A-Za-z]+$"), F.lit("alphanumeric"))
        .otherwise(F.lit("base64"))
    )


def best_window(text: Column, symbols: str) -> Column:
    """The highest entropy, in bits a character, of any ``WINDOW`` neighbouring characters of ``text``."""
    clog = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    def place(at: Column) -> Column:
        return F.instr(F.lit(symbols), F.substring(text, at, F.lit(1))) - 1

    def take(state: Column, at: Column) -> Column:
        into = place(at)
        out = F.when(at > WINDOW, place(at - WINDOW)).otherwise(F.lit(-1))
        came = state["counts"][into]
        mid = state["sum"] + clog(came + 1) - clog(came)
        left = F.when(out < 0, F.lit(0)).otherwise(F.get(state["counts"], out) + F.when(out == into, 1).otherwise(0))
        total = mid - F.when(out < 0, F.lit(0.0)).otherwise(clog(left) - clog(left - 1))
        counts = F.transform(
            state["counts"], lambda n, k: n + F.when(k == into, 1).otherwise(0) - F.when(k == out, 1).otherwise(0)
        )
        bits = F.when(at >= WINDOW, F.log2(F.lit(float(WINDOW))) - total / WINDOW).otherwise(F.lit(0.0))
        return F.struct(counts.alias("counts"), total.alias("sum"), F.greatest(state["best"], bits).alias("best"))

    begin = F.struct(
        F.array_repeat(F.lit(0), len(symbols)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best")
    )
    return F.aggregate(F.sequence(F.lit(1), F.length(text)), begin, take)["best"]


def looks_random(text: Column, allowed: Sequence[str] = ALLOWED) -> Column:
    kind = F.when(F.lit(False), F.lit(False))
    bare = F.regexp_replace(text, DATES, "")
    for pattern in allowed:
        kind = kind.when(bare.rlike(pattern), F.lit(False))
    for name, (symbols, bits) in CLASSES.items():
        measured = F.lower(bare) if name in FOLDED else bare
        kind = kind.when(_class_of(bare) == name, best_window(measured, symbols) >= bits)
    return kind.otherwise(F.lit(False))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: Sequence[str] = ALLOWED
) -> DataFrame:
    """One row per input row: the id and ``spans``, an array of (kind, start, end) in code points.

    Spans go by start, then kind as listed.  Null and empty texts have none.
    Repeated rows repeat; a null id stays null; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_spans(source, allowed).select("doc_id", "_spans").withColumnRenamed("_spans", "spans")


def with_spans(source: DataFrame, allowed: Sequence[str] = ALLOWED, text_col: str = "text") -> DataFrame:
    """``source`` with ``_spans``; its text column must not be null."""
    kept = source.columns
    text = F.col(text_col)
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    passes: dict[str, Callable[[Column], Column]] = {
        "assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGNED_CHARS,
        "access": lambda m: F.lit(True),
        "hex": lambda m: F.lit(True),
        "entropy": lambda m: looks_random(m, allowed),
    }
    # What every match of a kind holds, so that most rows need no pass with its pattern.
    needs = {
        "assign": F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": F.lit(True),
        "entropy": text.rlike(f"[0-9]|[A-Za-z]{{{WINDOW}}}"),
    }

    def matches_of(kind: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(patterns[kind]), 0)
        return F.when(needs[kind], found).otherwise(F.array().cast("array<string>")).alias(f"_m_{kind}")

    # One pass finds the matches of a kind; a row that has any is split at them by a second one.
    found = source.select(*kept, *(matches_of(k) for k in KINDS))

    def apart(kind: str) -> Column:
        matches = F.col(f"_m_{kind}")
        pieces = F.split(text, patterns[kind], -1)
        return F.when(F.size(matches) > 0, F.transform(pieces, F.length)).alias(f"_g_{kind}")

    measured = found.select(*kept, *(f"_m_{k}" for k in KINDS), *(apart(k) for k in KINDS))

    def starts(kind: str) -> Column:
        """Where match i begins: all pieces up to it and all matches before it."""
        matches, gaps = F.col(f"_m_{kind}"), F.col(f"_g_{kind}")
        moves = F.transform(gaps, lambda gap, i: gap + F.coalesce(F.length(F.get(matches, i - 1)), F.lit(0)))
        return F.when(F.size(matches) > 0, running(moves, lambda a, b: a + b, F.lit(0))).alias(f"_s_{kind}")

    placed = measured.select(*kept, *(f"_m_{k}" for k in KINDS), *(starts(k) for k in KINDS))

    def spans(kind: str) -> Column:
        matches, at = F.col(f"_m_{kind}"), F.col(f"_s_{kind}")
        every = F.transform(
            matches,
            lambda m, i: F.struct(
                at[i + 1].alias("start"),
                F.lit(KINDS.index(kind)).alias("order"),
                (at[i + 1] + F.length(m)).alias("end"),
                passes[kind](m).alias("ok"),
            ),
        )
        none = F.array().cast("array<struct<start:int,order:int,end:int,ok:boolean>>")
        return F.when(F.size(matches) > 0, F.filter(every, lambda s: s["ok"])).otherwise(none)

    names = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.array_sort(F.concat(*(spans(k) for k in KINDS)))
    plain = F.transform(
        ordered, lambda s: F.struct(names[s["order"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )
    return placed.select(*kept, plain.alias("_spans"))


#: Code points of a block that a masked text is cut from.
_CUT = 16_384


def masked(rows: DataFrame, text_col: str, spans_col: str, sign: str) -> DataFrame:
    """``rows`` with each stretch of the text that spans cover replaced by ``sign``; spans go by start, texts are not null.

    The text is cut into blocks once and the running ends of the spans are found
    once, each in a generator, so that the lambda that joins the pieces only
    looks them up.
    """
    kept = [f"`{c}`" for c in rows.columns]
    text, spans = F.col(text_col), F.col(spans_col)
    reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CUT}}}"), 0)
    hit = F.size(spans) > 0
    side = F.struct(F.when(hit, reach).alias("_reach"), F.when(hit, blocks).alias("_blocks"))
    staged = rows.select(*kept, F.inline(F.array(side)))
    reach, blocks = F.col("_reach"), F.col("_blocks")

    def part(block: Column, start: Column, size: Column) -> Column:
        return F.substr(F.coalesce(F.get(blocks, block), F.lit("")), start + 1, size)

    def between(low: Column, high: Column) -> Column:
        """The code points from ``low`` up to ``high``."""
        first, last = F.floor(low / _CUT).cast("int"), F.floor(high / _CUT).cast("int")
        whole = F.array_join(F.slice(blocks, first + 2, last - first - 1), "")
        far = F.concat(part(first, low - first * _CUT, F.lit(_CUT)), whole, part(last, F.lit(0), high - last * _CUT))
        return F.when(first == last, part(first, low - first * _CUT, high - low)).otherwise(far)

    pieces = F.transform(
        spans,
        lambda s, i: F.when(s["start"] >= reach[i], F.concat(between(reach[i], s["start"]), F.lit(sign))).otherwise(F.lit("")),
    )
    tail = between(F.element_at(reach, -1), F.char_length(text))
    joined = F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)
    return staged.select(*(joined.alias(c) if c == text_col else F.col(f"`{c}`") for c in rows.columns))
