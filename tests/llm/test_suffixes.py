import hashlib
import random

import numpy as np
import pytest

from opslake.llm import queries, suffixes


def brute(rows):
    """Bytes, bytes removed, stretches and hash of the rest of every text; ``rows`` in the order of places."""
    seen, out = set(), []
    for text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - suffixes.LENGTH + 1):
            string = data[p : p + suffixes.LENGTH]
            if string in seen:
                gone[p : p + suffixes.LENGTH] = b"\1" * suffixes.LENGTH
            seen.add(string)
        stretches = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((len(data), sum(gone), stretches, hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    return {r[0]: tuple(r)[1:] for r in suffixes.digest(suffixes.repeated(df)).collect()}


def mixed_texts(seed):
    rng, texts = random.Random(seed), []
    pool = ["".join(rng.choice("abéc ") for _ in range(rng.randint(90, 400))) for _ in range(20)]
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            passage = rng.choice(pool)
            if kind < 0.4:
                parts.append(passage)
            elif kind < 0.6:
                at = rng.randrange(len(passage))
                parts.append(passage[at : at + rng.randint(1, 200)])
            elif kind < 0.7:
                parts.append("x" * rng.randint(1, 500))
            elif kind < 0.8:
                parts.append("ab" * rng.randint(1, 300))
            else:
                parts.append("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 300))))
        texts.append("".join(parts) or None)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_parts_of_them_and_periods(spark, seed):
    texts = mixed_texts(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert found(df) == dict(enumerate(brute(texts)))


def test_one_run_in_most_texts_lies_on_several_buckets(spark):
    rng = random.Random(5)
    common = "".join(rng.choice("qwertyuiop") for _ in range(99))
    texts = [
        "".join(rng.choice("as") for _ in range(rng.randint(0, 30))) + common + "".join(rng.choice("zx") for _ in range(rng.randint(0, 30)))
        for _ in range(1500)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    ordered = suffixes._text_order("doc_id", "text", df)
    splitters = suffixes._splitters(ordered)
    leads = [r.lead for r in suffixes._sparse_suffixes(ordered, splitters).select("lead").collect()]
    _, shared = suffixes._dealt(np.array(leads).view(np.uint64), np.zeros(len(leads), np.uint64), splitters)
    assert shared.mean() > 0.3
    assert found(df) == dict(enumerate(brute(texts)))


def test_a_text_of_many_pieces(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefghijklmnop") for _ in range(700))
    filler = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(40_000, 400_000))) for _ in range(14)]
    long = "".join(f + passage[rng.randrange(300) :] for f in filler)
    texts = [passage, long, None, "", "short", long[1_048_576 - 60 : 1_048_576 + 90]]
    assert len(long) > 2 * suffixes.PIECE
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert found(df) == dict(enumerate(brute(texts)))


def test_repeated_and_missing_ids_and_other_columns(spark):
    a, b = "".join(map(str, range(60))), "".join(map(str, range(100, 160)))
    rows = [(1, a, "x", 1), (1, a, "y", 2), (1, b, "z", 3), (2, b, None, 4), (None, b, "n", 5), (None, None, "n", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, start int").withColumn("bucket", suffixes.F.lit(1))
    got = [(r.doc_id, r.n_removed) for r in suffixes.digest(suffixes.repeated(df)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    # Rows equal in id and text are one document; a row without id comes last, so its text is a repeat.
    assert sorted(got, key=key) == sorted([(1, 0), (1, 0), (1, 0), (2, len(b)), (None, len(b)), (None, 0)], key=key)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == {}


def test_multikey_order_sorts_by_all_tokens():
    rng = np.random.default_rng(4)
    columns = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(4)]
    order, runs = suffixes.multikey_order(columns, np.arange(500), np.zeros(500, np.int64))
    keys = [tuple(int(c[i]) for c in columns) for i in order]
    assert keys == sorted(keys)
    assert [keys[i] == keys[i - 1] for i in range(1, 500)] == [runs[i] == runs[i - 1] for i in range(1, 500)]


def test_whole_table(spark):
    df = queries.op13_suffixes(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip([r.doc_id for r in docs], brute([r.text for r in docs]), strict=True))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()} == want
