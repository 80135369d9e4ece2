import random
import re
from collections import Counter

import pytest

from opslake.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            counts.update((lang, tuple(words[i : i + m])) for m in range(1, 6) for i in range(len(words) - m + 1))
    frequent = {k: n for k, n in counts.items() if n >= least}
    covered = {
        (lang, w[i : i + m])
        for (lang, w), n in frequent.items()
        for m in range(2, len(w))
        for i in range(len(w) - m + 1)
        if n >= frequent[lang, w[i : i + m]]
    }
    found = []
    for (lang, w), a in frequent.items():
        if len(w) > 1 and (lang, w) not in covered:
            cuts = [(frequent[lang, w[:k]], frequent[lang, w[k:]]) for k in range(1, len(w))]
            score, k = min((1000 * a * total[lang] // (x * y), k) for k, (x, y) in enumerate(cuts))
            found.append((lang, " ".join(w), a, *cuts[k], total[lang], score))
    found.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks, out = Counter(), []
    for lang, *rest in found:
        ranks[lang] += 1
        if ranks[lang] <= top:
            out.append((lang, ranks[lang], *rest))
    return sorted(out)


def corpus(seed, documents=300):
    rng = random.Random(seed)
    words = ["The", "of", "ÉTÉ", "été", "a-b", "x_1", "日本", "und", "in", "Zebra's", "to", "(it)"]
    stops = [" ", "  ", "\t", ", ", ". ", "\n", "\r\n", "!", ";", " : ", "\x0b", " "]
    rows = []
    for _ in range(documents):
        text = "".join(rng.choice(words[: rng.randint(2, 12)]) + rng.choices(stops, [60, 5, 5, 2, 2, 1, 1, 1, 1, 1, 1, 1])[0] for _ in range(rng.randint(0, 40)))
        rows.append((text if rng.random() > 0.03 else None, rng.choice(["en", "en", "fr", None, "und", "xx"])))
    rows += [(rows[0][0], "en")] * 30 + [("only here twice now", "rare")] * 2
    return rows


def frame(spark, rows):
    df = spark.createDataFrame([(t, x, "c", i) for i, (t, x) in enumerate(rows)], "text string, lang string, `a.b` string, n long")
    return df.repartition(4)


@pytest.mark.parametrize(("seed", "bits"), [(1, 64), (2, 64), (3, 9)])
def test_like_counting_every_run(spark, monkeypatch, seed, bits):
    monkeypatch.setattr(phrases, "OCCURRENCES", 12)
    # With nine bits nearly every fingerprint stands for several runs.
    monkeypatch.setattr(phrases, "FINGERPRINT_BITS", bits)
    rows = corpus(seed)
    want = brute(rows, 12)
    assert len(want) > 100
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows)).collect())) == want


def test_top_and_ties(spark, monkeypatch):
    monkeypatch.setattr(phrases, "OCCURRENCES", 5)
    rows = [("a b. b a. c d. d c. é f", "en")] * 6
    got = sorted(map(tuple, phrases.collocations(frame(spark, rows), top=3).collect()))
    assert got == brute(rows, 5, top=3)
    assert [r[2] for r in got] == ["é f", "a b", "b a"] or len(got) == 3


def test_long_text_in_stretches_and_long_words(spark, monkeypatch):
    monkeypatch.setattr(phrases, "OCCURRENCES", 5)
    monkeypatch.setattr(phrases, "PIECE", 512)
    rng = random.Random(8)
    text = "".join(rng.choice(["one", "two", "three", "y" * 3000]) + rng.choice([" ", " ", " ", " ", ". ", "   ", "\n\n"]) for _ in range(4000))
    rows = [(text, "en"), ("one two three", "en")]
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows)).collect())) == brute(rows, 5)


def test_scores_beyond_64_bits(spark):
    # 1000 * a * n alone passes 64 bits; the division is exact all the same.
    a, left, right, total = 9_007_199_254_740_993, 9_007_199_254_740_995, 9_007_199_254_740_997, 90_071_992_547_409_931
    row = spark.range(1).selectExpr(f"{a}L as a", f"{left}L as l", f"{right}L as r", f"{total}L as total")
    assert row.select(phrases.score("a", "l", "r", "total").alias("s")).first().s == 1000 * a * total // (left * right)


def test_empty_tables(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [(None, None), ("", "en"), (" \t\n", "en")])).collect() == []
