import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from opslake.llm import queries, toxicity

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    # Junk of quality 0 is marked toxic at random, so only the others can be judged.
    labels = {r.doc_id: r.toxic for r in queries.table(spark, DATA, "labels").where("quality = 1").collect()}
    got = queries.op5_toxicity(spark, DATA).collect()
    assert len(got) == queries.table(spark, DATA, "documents").count()
    assert all(0 <= r.severity <= 3 and r.toxic == (r.grade >= 1) for r in got)
    judged = [(r, labels[r.doc_id]) for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.doc_id in labels]
    toxic = [r.toxic for r, y in judged if y == 1]
    clean = [r.toxic for r, y in judged if y == 0]
    assert sum(toxic) / len(toxic) > 0.95 and sum(clean) / len(clean) < 0.03


def test_thresholds_rise_and_weights_are_shared():
    rng = np.random.default_rng(1)
    rows = [sorted(rng.choice(6, rng.integers(0, 6), replace=False).tolist()) for _ in range(2000)]
    truth = np.array([3.0, 2.0, 1.0, 0.0, -1.0, -2.0])
    z = np.array([truth[r].sum() for r in rows]) + rng.logistic(size=2000)
    grades = (z[:, None] >= np.array([0.0, 2.0, 4.0])).sum(axis=1)
    weights, thresholds = toxicity.fit_ordinal(rows, grades, 6, steps=1500)
    assert list(np.argsort(-weights)) == [0, 1, 2, 3, 4, 5]
    assert (np.diff(thresholds) > 0.5).all()
    chances = toxicity.Model(["a"], weights, thresholds).grades_from([0, 1])
    assert chances[0] > chances[1] > chances[2]


def test_odd_rows(spark):
    rng = random.Random(2)
    clean = [" ".join(rng.choice(("one", "two", "three", "four", "five")) for _ in range(30)) for _ in range(60)]
    rows = [(i, f"{t} villain {t}" if i % 3 == 0 else t, "x") for i, t in enumerate(clean)]
    rows += [(None, "villain", "x"), (100, None, None), (101, "", "y"), (101, "", "y"), (102, "one " * 100_000 + "villain", "z")]
    marks = [(i, int(i % 3 == 0), "t") for i in range(60)] + [(None, 1, "t"), (5, None, "t"), (7, 9, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    got = [(r.doc_id, r.toxic) for r in toxicity.grade(docs, model).collect()]
    assert got[60:] == [(None, True), (100, False), (101, False), (101, False), (102, True)]
    assert [t for _, t in got[:60]] == [i % 3 == 0 for i in range(60)]
    nothing = toxicity.fit(docs, labels.limit(0))
    assert not any(r.toxic for r in toxicity.grade(docs, nothing).collect())
    assert toxicity.grade(docs.limit(0), model).collect() == []


def test_whole_table_against_plain_python(spark):
    """The learned model applied word by word, without the module's memory, slices and arrays."""
    directory = "/root/testdata/sf0.01"
    docs = queries.table(spark, directory, "documents")
    model = toxicity.fit(docs, queries.table(spark, directory, "labels"))
    weight = dict(zip(model.terms, model.weights, strict=False))
    steps = model.weights[len(model.terms) :]
    got = {r.doc_id: r for r in toxicity.grade(docs, model).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    some = 0
    for r in rows:
        words = re.findall(r"\w+", (r.text or "").lower())
        terms = [{w} | {w[:n] + "*" for n in (4, 5, 6, 7) if len(w) > n} for w in words]
        telling = [t & weight.keys() for t in terms if t & weight.keys()]
        density = 100 * len(telling) / max(1, len(words))
        score = sum(weight[t] for t in set().union(*telling))
        score += sum(s for s, least in zip(steps, toxicity.STEPS, strict=True) if telling and density >= least)
        chances = [1 / (1 + math.exp(-min(30, max(-30, score - t)))) for t in model.thresholds]
        assert abs(got[r.doc_id].severity - sum(chances)) < 1e-9
        assert got[r.doc_id].grade == sum(c >= 0.5 for c in chances) and got[r.doc_id].toxic == (chances[0] >= 0.5)
        some += got[r.doc_id].toxic
    assert some > 10


def test_telling_terms_against_plain_counts(spark):
    directory = "/root/testdata/sf0.01"
    docs = queries.table(spark, directory, "documents")
    labels = queries.table(spark, directory, "labels")
    model = toxicity.fit(docs, labels)
    sure = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in sure}
    number = Counter(sure[i] for i in texts)
    held = {0: Counter(), 1: Counter()}
    for i, text in texts.items():
        held[sure[i]].update({t for w in set(re.findall(r"\w+", text.lower())) for t in toxicity.terms_of(w)})
    gains = []
    for term, toxic in held[1].items():
        odds = math.log((toxic + 0.5) / number[1]) - math.log((held[0][term] + 0.5) / number[0])
        if toxic >= toxicity.LEAST_DOCUMENTS and odds > 1.5 and toxic * odds >= toxicity.LEAST_GAIN:
            gains.append((-toxic * odds, term))
    assert set(model.terms) == {t for _, t in sorted(gains)[: toxicity.TERMS]} and model.terms
