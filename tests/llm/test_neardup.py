import random
from collections import Counter, defaultdict

import numpy as np

from opslake.llm import neardup, queries
from opslake.llm.graph import components


def runs(text):
    words = text.lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute(texts):
    """Smallest reachable id of every document, by all pairs that share a run."""
    sets = {i: runs(t or "") for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for r in s:
            holders[r].append(i)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    pairs = {(a, b) for h in holders.values() if len(h) > 1 for k, a in enumerate(h) for b in h[k + 1 :]}
    for a, b in pairs:
        if find(a) != find(b):
            both = sum((sets[a] & sets[b]).values())
            if both / (sum(sets[a].values()) + sum(sets[b].values()) - both) >= 0.8:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in texts}


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, class_id string")


def test_copies_chains_and_decoys(spark):
    rng, texts = random.Random(2), {}
    for group in range(25):
        now = words(rng, 120)
        for _ in range(rng.randint(1, 12)):
            texts[len(texts)] = " ".join(now)
            now = list(now)
            for _ in range(rng.randint(0, 3)):
                now[rng.randrange(len(now))] = f"x{rng.randrange(9999)}"
    ids = list(texts)
    rng.shuffle(ids)
    texts = dict(zip(ids, texts.values(), strict=True))
    want = brute(texts)
    got = {r.doc_id: r for r in neardup.classes(docs(spark, [(i, t, None) for i, t in texts.items()])).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (r.class_id == i) for i, r in got.items())


def test_members_that_no_leader_joins(spark, monkeypatch):
    """Pairs that only the second stage compares, in blocks of their bucket."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(8)
    pairs = [words(rng, rng.choice((20, 25, 31, 60, 75, 400))) for _ in range(40)]
    texts = {}
    for k, w in enumerate(pairs):
        texts[2 * k], texts[2 * k + 1] = " ".join(w), " ".join([*w, "tail"])
    base = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = [(7, i, sum(runs(t).values()), i % 3 > 0, i) for i, t in texts.items()]
    members = spark.createDataFrame(rows, "key long, doc_id long, size int, far boolean, part long")
    links = {tuple(sorted(r)) for r in neardup._leftover_links(members, base).collect()}
    assert links == {(2 * k, 2 * k + 1) for k in range(40)}


def test_leftovers_at_the_border_of_their_size_classes(spark):
    # Texts of 4 n and 5 n runs of which the shorter one begins the longer: similarity 0.8 to the last bit.
    rng = random.Random(10)
    texts = {}
    for k, n in enumerate((1, 2, 3, 5, 10, 25, 100, 256)):
        w = words(rng, 5 * n + 4)
        texts[2 * k], texts[2 * k + 1] = " ".join(w), " ".join(w[: 4 * n + 4])
    base = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = [(7, i, sum(runs(t).values()), True, i) for i, t in texts.items()]
    members = spark.createDataFrame(rows, "key long, doc_id long, size int, far boolean, part long")
    links = {tuple(sorted(r)) for r in neardup._leftover_links(members, base).collect()}
    assert links == {(2 * k, 2 * k + 1) for k in range(8)}


def test_odd_rows(spark):
    rows = [(5, "one two", "x"), (3, "ONE  two", None), (1, "", "x"), (2, None, "x"), (4, "   ", "x"), (None, "one two", "y"), (5, "one two", "z"), (9, "one", "x")]
    got = sorted(((r.doc_id or -1, r.class_id, r.kept) for r in neardup.classes(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (1, 1, True), (2, 2, True), (4, 4, True), (-1, None, True), (9, 9, True)], key=str)
    assert neardup.classes(docs(spark, [])).collect() == []
    stay = neardup.keep_one(docs(spark, rows))
    assert stay.columns == ["doc_id", "text", "class_id"]
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(["3", "1", "2", "4", "None", "9"])
    twice = docs(spark, [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "y"), (2, None, "y")])
    assert sorted(tuple(r) for r in neardup.keep_one(twice).collect()) == [(1, "a b c", "x"), (2, None, "y")]


def test_ids_that_repeat_with_other_texts(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "y"), (2, c, "z"), (2, a, "z"), (3, b, "w"), (3, b, "w")]
    got = sorted((r.doc_id, r.class_id, r.kept) for r in neardup.classes(docs(spark, rows)).collect())
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 2, True), (2, 1, False), (3, 1, False), (3, 1, False)])
    stay = neardup.keep_one(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in stay) == sorted([(1, a), (1, b), (2, c)])


def test_long_text_and_signature():
    text = " ".join(words(random.Random(1), 200_000))
    memory = neardup.WordHashes()
    cells = neardup.cells_of(text, memory)
    assert len(cells) == 200_000 - 4 and neardup.similarity(cells, cells) == 1
    signature = neardup.dart_signature(cells, np.zeros(len(cells), int), 1)
    assert signature.all()
    rng = np.random.default_rng(4)
    agreed = []
    for _ in range(40):
        a = rng.integers(0, 2**63, 300).astype(np.uint64)
        b = np.concatenate((a[:250], rng.integers(0, 2**63, 50).astype(np.uint64)))
        one, two = neardup.dart_signature(np.concatenate((a, b)), np.repeat([0, 1], 300), 2)
        agreed.append((one == two).mean())
    assert abs(np.mean(agreed) - 250 / 350) < 0.02


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (200, 150), (200, 151)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {v: find(v) for v in root}
    assert components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_query_against_all_pairs(spark):
    directory = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in queries.table(spark, directory, "documents").collect()}
    want = brute(texts)
    got = {r.doc_id: r.class_id for r in queries.op2_neardup(spark, directory).collect()}
    assert got == want and len(set(want.values())) < len(want)
