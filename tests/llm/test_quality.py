import math
import random
import zlib

import pytest

from opslake.llm import quality, queries

DATA = "/root/testdata/sf0.1"


def tables(spark, rows, labels):
    return (
        spark.createDataFrame(rows, "doc_id long, text string, score string"),
        spark.createDataFrame(labels, "doc_id long, quality int, text string"),
    )


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in queries.table(spark, DATA, "labels").collect()}
    got = queries.op8_quality(spark, DATA).collect()
    assert len(got) == queries.table(spark, DATA, "documents").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    judged = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in judged) / len(judged) > 0.96
    good = [p for p, y in judged if y == 1]
    assert sum(good) / len(good) > 0.97


def test_size_difference_packs_every_piece_whole():
    packers = quality.Model(b"the good words of a text ", b"@@@@ #### ", True, True, 1.0, 0.0).packers()
    text = "the good words of a text é " * 500
    data = text.encode()
    pieces = [data[i : i + quality.PIECE_BYTES] for i in range(0, len(data), quality.PIECE_BYTES)]
    want = sum(len(packers[1].compress(p)) - len(packers[0].compress(p)) for p in pieces) / len(data)
    assert quality.size_difference(text, packers) == want
    assert quality.size_difference("", packers) == 0


@pytest.mark.parametrize("labels, expected", [([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (4, 0)], 0.0)])
def test_missing_classes(spark, labels, expected):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs, marks = tables(spark, [(i, "some text", "x") for i in ids[:5]], [(ids[i], q, "x") for i, q in labels])
    model = quality.fit(docs, marks)
    assert {round(r.score, 6) for r in quality.score(docs, model).collect()} == {expected}


def test_odd_rows(spark):
    rows = [(i, "the good one of them all " * 4 if i % 2 else "@@ ## && !! " * 8, "x") for i in range(60)]
    odd = [(None, "the good", "x"), (100, None, None), (101, "", "y"), (101, "", "y"), (102, "the good one " * 50_000, "z")]
    marks = [(i, i % 2, "t") for i in range(60)] + [(None, 1, "t"), (2, None, "t"), (3, 5, "t"), (4, 1, "t")]
    docs, labels = tables(spark, rows + odd, marks)
    model = quality.fit(docs, labels)
    got = [r for r in quality.score(docs, model).collect() if r.doc_id is None or r.doc_id >= 100]
    assert len(got) == 5 and all(not math.isnan(r.score) for r in got)
    empty = [r.score for r in got if r.doc_id in (100, 101)]
    assert empty == pytest.approx([float(model.score(0.0))] * 3)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 60} == set(range(1, 60, 2))
    assert quality.score(docs.limit(0), model).collect() == []


def test_whole_table_against_sizes_one_by_one(spark):
    directory = "/root/testdata/sf0.01"
    docs = queries.table(spark, directory, "documents")
    model = quality.fit(docs, queries.table(spark, directory, "labels"))
    packers = model.packers()
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        data = (r.text or "").encode()
        pieces = [data[i : i + quality.PIECE_BYTES] for i in range(0, len(data), quality.PIECE_BYTES)]
        saved = sum(len(packers[1].compress(p)) - len(packers[0].compress(p)) for p in pieces) / max(1, len(data))
        want = 1 / (1 + math.exp(-max(-500, min(500, model.slope * saved + model.middle))))
        assert abs(got[r.doc_id].score - want) < 1e-9 and got[r.doc_id].predicted == (want >= 0.5)


def test_all_of_a_long_text_teaches(spark):
    """What tells the classes apart lies behind the first pieces of long texts."""
    rng = random.Random(4)
    common = " ".join(rng.choice(("one", "two", "three", "four")) for _ in range(3000))
    own = {1: "the good words of all of them ", 0: "@@ ## && !! %% ++ ~~ "}
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1][:80]
    rows = [(i, common + own[i % 2] * 200 + common, "x") for i in ids]
    docs, labels = tables(spark, rows, [(i, i % 2, "x") for i in ids])
    model = quality.fit(docs, labels)
    judged = spark.createDataFrame([(1, own[1] * 20, "x"), (0, own[0] * 20, "x")], "doc_id long, text string, score string")
    assert {r.doc_id: r.predicted for r in quality.score(judged, model).collect()} == {1: 1, 0: 0}


def test_the_sample_is_bounded_in_bytes(spark):
    rows = spark.range(100).selectExpr("cast(id % 2 as int) as label", "id as order", "1000 as bytes")
    upto = {r.label: r.upto for r in quality._within(rows, 10_000).collect()}
    assert upto == {0: 18, 1: 19}
    one = spark.createDataFrame([(1, 5, 10**9)], "label int, order long, bytes int")
    assert [r.upto for r in quality._within(one, 10_000).collect()] == [5]
