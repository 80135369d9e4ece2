"""Personal data by anchor expansion.

One Aho-Corasick pass over the text finds anchors: at-signs, scheme marks,
digit pairs that numbers and addresses start from, plus signs before a digit,
and identifier cues such as "IBAN".  From each anchor a local parser expands to
the boundaries of the value and validates it.  Every parser reads its stretch
of text once, so very long texts cost time in proportion to their length.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.llm.batches import map_slices, share, texts

# Kinds in the order results are listed; the first four are the base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "iban", "account", "ssn")

DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
NUMBER = re.compile(r"[0-9]+")
SPACED = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIALLED = re.compile(r"[ ().0-9-]+")
LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+(?=@)")
CUE_GAP = re.compile(r"(?: ?(?:no|number|nr|#))?[.:=]? {0,2}", re.I)
PLAIN_GAP = re.compile(r"[.:=]? {0,2}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
# Characters of an IBAN by its country.
IBAN_CHARS = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
ACCOUNT = re.compile(r"[0-9](?:-?[0-9]){5,16}(?![0-9])")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9])")
CUES = {"iban": "iban", "account": "account", "acct": "account", "konto": "account", "ssn": "ssn", "social security": "ssn"}


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        twice = digit * 2 if place % 2 else digit
        total += twice - 9 if twice > 9 else twice
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    turned = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """The IBAN that starts here: as long as its country has it, or the longest whole groups that are valid."""
    run = IBAN.match(text, at)
    if run is None:
        return None
    ends = [i + 1 for i in range(at, run.end()) if text[i] != " "]
    known = IBAN_CHARS.get(text[at : at + 2])
    for size in (known,) if known else range(len(ends), 14, -1):
        if size > len(ends):
            break
        end = ends[size - 1]
        follows = text[end : end + 1]
        if not (follows.isascii() and follows.isalnum()) and iban_valid(text[at:end]):
            return at, end
    return None


def anchors() -> ahocorasick.Automaton:
    """Each anchor with the parser that starts there."""
    found: dict[str, set[str]] = {"@": {"email"}, "://": {"login"}}
    for a in DIGITS:
        found[f"+{a}"] = {"phone"}
        for b in DIGITS:
            found[f"{a}.{b}"] = {"ip"}
            for gap in ("", " ", "-"):
                found[f"{a}{gap}{b}"] = {"card"}
    for cue, kind in CUES.items():
        for form in (cue, cue.upper(), cue.title()):
            found[form] = {kind}
    automaton = ahocorasick.Automaton()
    for text, kinds in found.items():
        automaton.add_word(text, (len(text), *kinds))
    automaton.make_automaton()
    return automaton


def _emails(text: str, at: int, after: int):
    """The local part runs left from the sign as far as the last match lets it."""
    start = at
    while start > after and text[start - 1] in LOCAL:
        start -= 1
    if start < at and (domain := DOMAIN.match(text, at + 1)):
        yield start, domain.end()


def _run_around(text: str, at: int, after: int, chars: str) -> tuple[int, int]:
    start, end, size = at, at, len(text)
    while start > after and text[start - 1] in chars:
        start -= 1
    while end < size and text[end] in chars:
        end += 1
    return start, end


def _addresses(text: str, start: int, end: int):
    """Four numbers at a time of each dotted run."""
    for run in DOTTED.finditer(text, start, end):
        parts = [m.span() for m in NUMBER.finditer(text, *run.span())]
        for k in range(0, len(parts) - 3, 4):
            values = [text[a:b].lstrip("0") for a, b in parts[k : k + 4]]
            if all(len(v) <= 3 and int(v or 0) <= 255 for v in values):
                yield parts[k][0], parts[k + 3][1]


def _cards(text: str, start: int, end: int):
    for run in SPACED.finditer(text, start, end):
        digits = run.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield run.span()


def _phone(text: str, plus: int):
    run = DIALLED.match(text, plus + 2)
    if run:
        end = run.end()
        while end > plus + 2 and text[end - 1] not in DIGITS:
            end -= 1
        if end > plus + 3 and 8 <= sum(c in DIGITS for c in text[plus:end]) <= 15:
            yield plus, end
            return
        yield None, end


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by kind as listed, then start; ends are exclusive."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys(KINDS, 0)  # up to where each kind has read
    for last, (size, *kinds) in automaton.iter(text):
        at = last - size + 1
        for kind in kinds:
            if at < done[kind]:
                continue
            spans = found[kind]
            if kind == "email":
                for span in _emails(text, at, done[kind]):
                    spans.append(span)
                    done[kind] = span[1]
            elif kind == "ip":
                start, end = _run_around(text, at, done[kind], "0123456789.")
                spans += _addresses(text, start, end)
                done[kind] = end
            elif kind == "card":
                start, end = _run_around(text, at, done[kind], "0123456789 -")
                spans += _cards(text, start, end)
                done[kind] = end
            elif kind == "phone":
                for start, end in _phone(text, at):
                    if start is not None:
                        spans.append((start, end))
                    done[kind] = end
            elif kind == "login":
                if login := LOGIN.match(text, last + 1):
                    spans.append(login.span())
                    done[kind] = login.end()
            else:
                value_at = CUE_GAP.match(text, last + 1).end()
                if kind == "iban":
                    span = _iban(text, value_at) or _iban(text, PLAIN_GAP.match(text, last + 1).end())  # "NO" is a country too
                else:
                    value = {"account": ACCOUNT, "ssn": SSN}[kind].match(text, value_at)
                    span = value.span() if value else None
                if span:
                    spans.append(span)
                    done[kind] = span[1]
    return [(kind, start, end) for kind in KINDS for start, end in found[kind]]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``spans``, an array of (kind, start, end) in code points.

    Null and empty texts have no spans.  Repeated rows repeat; a null id stays
    null; other columns are ignored.
    """
    held = share(docs.sparkSession, [])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held.value:
            held.value.append(anchors())
        automaton = held.value[0]
        rows = [
            [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(text, automaton)] for text in texts(batch, "text")
        ]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "spans": pa.array(rows, kind)})

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(source, run, "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>")
