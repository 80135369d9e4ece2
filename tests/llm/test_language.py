import tracemalloc
import zlib
from collections import Counter

import numpy as np

from opslake.llm import language, queries

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in queries.table(spark, DATA, "documents").select("doc_id", "lang").collect()}
    got = queries.op7_language(spark, DATA).collect()
    assert len(got) == len(langs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    judged = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out and langs[r.doc_id] is not None]
    assert sum(judged) / len(judged) > 0.95


def test_bundles_against_letter_by_letter():
    letters = language.Letters()
    batch = ["Then é, x", "", "123", "日本語 ab"]
    bundle, lettered = letters.bundles(batch)
    for text, row in zip(batch, bundle, strict=True):
        want = np.zeros(language.DIMENSIONS)
        signs = [0, *(int(letters.sign[ord(c)]) for c in text.lower()), 0]
        for a, b, c in zip(signs, signs[1:], signs[2:], strict=False):
            if b:
                want += np.roll(letters.shifted[2][a], 2).astype(int) * np.roll(letters.shifted[2][b], 1) * letters.shifted[2][c]
        assert np.array_equal(row, want)
    assert list(lettered) == [True, False, False, True]


def test_odd_rows(spark):
    train = [(i, f"the and of {i} with that this" if i % 2 else "der die und das nicht ein", "en" if i % 2 else "de", "x") for i in range(40)]
    odd = [(None, "the and of", None, "x"), (100, None, "en", "x"), (101, "", None, "y"), (101, "12 34", None, "y"), (102, "der und die " * 50_000, None, "z")]
    docs = spark.createDataFrame(train + odd, "doc_id long, text string, lang string, lang_pred string")
    profiles = language.fit(docs)
    assert list(profiles) == ["de", "en"]
    got = [(r.doc_id, r.lang_pred) for r in language.identify(docs, profiles).collect()]
    assert got[40:] == [(None, "en"), (100, "und"), (101, "und"), (101, "und"), (102, "de")]
    assert language.identify(docs.limit(0), profiles).collect() == []
    none = language.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in language.identify(docs, none).collect()} == {("und", 0.0)}


def test_two_million_letters_of_many_kinds_in_bounded_memory():
    letters = language.Letters()
    text = "".join(map(chr, np.random.default_rng(3).integers(0x4E00, 0x9FA5, 2_000_000)))
    tracemalloc.start()
    bundle, lettered = letters.bundles([text])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert lettered[0] and bundle.any() and peak < 500 << 20
    # Blocks of kinds add up to what one block gives.
    some = [text[:3000], "the and of", text[500:9000]]
    whole = letters.bundles(some)[0]
    before, language.KINDS = language.KINDS, 100
    try:
        assert np.array_equal(letters.bundles(some)[0], whole)
    finally:
        language.KINDS = before


def test_a_rare_language_is_learned(spark):
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5][:4]
    many = spark.range(100, 60_100).selectExpr("id as doc_id", "concat('the and of with that ', id % 10) as text", "'en' as lang")
    rare = spark.createDataFrame([(i, "zwei grüne äpfel für übermut", "de") for i in ids], "doc_id long, text string, lang string")
    docs = many.union(rare)
    profiles = language.fit(docs)
    assert list(profiles) == ["de", "en"]
    assert {r.lang_pred for r in language.identify(rare, profiles).collect()} == {"de"}


def test_whole_table_against_plain_counts(spark):
    """Profiles and cosines from counted runs of three letters, one text after the other."""
    directory = "/root/testdata/sf0.001"
    rows = queries.table(spark, directory, "documents").collect()
    letters = language.Letters()

    def bundle(text):
        signs = [0, *(int(letters.sign[ord(c)]) for c in text.lower()), 0]
        runs = Counter(run for run in zip(signs, signs[1:], signs[2:], strict=False) if run[1])
        return sum(
            (n * (letters.shifted[0][a].astype(float) * letters.shifted[1][b] * letters.shifted[2][c]) for (a, b, c), n in runs.items()),
            np.zeros(language.DIMENSIONS),
        )

    def unit(v):
        return v / (np.linalg.norm(v) or 1)

    units = {r.doc_id: unit(bundle(r.text or "")) for r in rows}
    profiles = {}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            profiles[r.lang] = profiles.get(r.lang, 0) + units[r.doc_id]
    names = sorted(profiles)
    for r in queries.op7_language(spark, directory).collect():
        cosines = [units[r.doc_id] @ unit(profiles[n]) for n in names]
        assert abs(max(0, max(cosines)) - r.score) < 1e-4
        assert r.lang_pred == names[int(np.argmax(cosines))] or not units[r.doc_id].any()
