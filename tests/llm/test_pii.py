import hashlib
import random
import re

from opslake.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def keep(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and pii.luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if keep(k, m.group())]


def base(spans):
    return [s for s in spans if s[0] in pii.BASE_KINDS]


def test_random_texts_as_the_patterns():
    rng, automaton = random.Random(3), pii.anchors()
    card = "4539 1488 0343 6467"
    for _ in range(30_000):
        parts = ("@", ".", "1", "25", "7.8.", "+4", " ", "-", "(", ")", "a", "b.c", "255", card, "é", "9.9.9.9", "+1 (988) 555-2485", "x@y.z")
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert base(pii.find_spans(text, automaton)) == brute(text), text


def test_added_kinds():
    text = "ftp://jo:pw@host/ IBAN: DE89 3704 0044 0532 0130 00, IBAN DE00370400440532013000; Acct no: 12-345678. SSN 123-45-6789 ssn 000-45-6789"
    found = [(k, text[s:e]) for k, s, e in pii.find_spans(text, pii.anchors())]
    assert [f for f in found if f[0] not in pii.BASE_KINDS] == [
        ("login", "jo:pw"),
        ("iban", "DE89 3704 0044 0532 0130 00"),
        ("account", "12-345678"),
        ("ssn", "123-45-6789"),
    ]


def test_iban_ends_before_what_follows_it():
    automaton = pii.anchors()
    found = lambda text: [text[s:e] for k, s, e in pii.find_spans(text, automaton) if k == "iban"]
    made = lambda country, rest: f"{country}{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}{rest}"
    for iban in ("DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO9386011117947", "FR14 2004 1010 0505 0001 3M02 606", made("ZZ", "A1B2C3D4E5F6G7")):
        for after in ("", " BIC COBADEFFXXX", " 2024", " BIC", " Bic X", ", BIC", " A", " AND 17 MORE WORDS IN CAPITALS FOLLOW", "\nBIC", " é"):
            assert found(f"IBAN: {iban}{after}") == [iban], (iban, after)
        assert found(f"IBAN {iban} IBAN {iban}") == [iban, iban]
    assert found("IBAN DE88 3704 0044 0532 0130 00 BIC COBADEFFXXX") == []
    assert found("IBAN DE89 3704 0044 0532 0130 00X") == [] == found("IBAN DE89 3704")


def test_long_texts_take_time_in_proportion():
    automaton = pii.anchors()
    for unit in ("1", "1.", "1 ", "a@", "+1", "a", "1.1.1.1", "+1("):
        pii.find_spans(unit * 200_000, automaton)


def test_odd_rows(spark):
    rows = [(1, "a@b.cc", "x"), (None, "1.2.3.4", None), (3, None, "y"), (4, "", "z"), (1, "a@b.cc", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in pii.find_personal_data(docs).collect()]
    assert got == [(1, [("email", 0, 6)]), (None, [("ip", 0, 7)]), (3, []), (4, []), (1, [("email", 0, 6)])]
    assert pii.find_personal_data(docs.limit(0)).collect() == []


def test_query_as_the_patterns(spark):
    directory = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op9_pii(spark, directory).collect()}
    some = 0
    for r in queries.table(spark, directory, "documents").collect():
        spans, row = brute(r.text or ""), got[r.doc_id]
        some += len(spans)
        assert [getattr(row, f"n_{k}") for k in pii.BASE_KINDS] == [sum(s[0] == k for s in spans) for k in pii.BASE_KINDS]
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert set(f"{k}:{s}:{e}" for k, s, e in spans) <= set(row.spans.split(",")) | {""}
    assert some > 10
