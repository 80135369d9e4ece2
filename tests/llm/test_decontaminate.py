import random
import re

import numpy as np

from opslake.llm import decontaminate, queries


def brute_tiles(item, text, least=5):
    """The longest shared run free of earlier tiles, over and over, by comparing words at all places."""
    a, b, found = [True] * len(item), [True] * len(text), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and a[i + k] and b[j + k] and item[i + k] == text[j + k] != 0:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (i, j, k)
        if best is None:
            return found
        i, j, k = best
        a[i : i + k] = [False] * k
        b[j : j + k] = [False] * k
        found.append(best)


def test_tiles_as_by_all_places():
    rng = random.Random(1)
    for _ in range(300):
        item = [rng.randint(1, 4) for _ in range(rng.randint(0, 30))]
        text = [rng.randint(0, 4) for _ in range(rng.randint(0, 40))] + item[10:] + item[:10]
        got = decontaminate.tiles(np.array(item, np.uint64), np.array(text, np.uint64))
        assert got == brute_tiles(item, text)


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def brute(docs, items):
    found = {}
    for d, text in docs:
        mine = words(text)
        grams = {tuple(mine[k : k + 5]) for k in range(len(mine) - 4)}
        for i, item in items:
            sought = words(item)
            if len(sought) >= 5 and any(tuple(sought[k : k + 5]) in grams for k in range(len(sought) - 4)):
                got = brute_tiles(sought, mine)
                share = sum(t[2] for t in got) / len(sought)
                if share >= decontaminate.COVERAGE:
                    found[d, i] = max(found.get((d, i), 0), round(share, 9))
    return found


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as coverage")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as doc_id")
    return {(r.doc_id, r.item_id): round(r.coverage, 9) for r in decontaminate.contaminated(d, b).collect()}


def test_leaks_reordered_passages_and_odd_rows(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, make(rng.randint(6, 40))) for i in range(30)]
    docs = []
    for d in range(120):
        item = rng.choice(items)[1]
        cut = rng.randint(0, len(item))
        part = [item, item[cut:] + item[:cut], item[: len(item) // 2], item[cut:], [w for w in item if rng.random() > 0.1], []][d % 6]
        docs.append((d, " ".join([*make(30), *part, *make(30)]).title()))
    texts = [(i, ", ".join(w)) for i, w in items]
    docs += [(None, texts[0][1]), (500, None), (501, ""), (502, "short one"), (503, texts[1][1]), (503, texts[1][1]), (503, "clean"), (504, "w " * 100_000 + texts[2][1])]
    odd = [*texts, (77, None), (78, ""), (79, "two words"), (0, texts[0][1]), (0, texts[5][1])]
    got = found(spark, docs, odd)
    assert got == brute(docs, odd) and len(got) > 60
    assert (None, 0) in got and (503, 1) in got and (504, 2) in got
    assert found(spark, [], odd) == {} and found(spark, docs, []) == {}


def test_items_that_repeat_their_runs(spark):
    equal = ["no"] * 12
    grid = ["0"] * 64
    grid[30] = "1"
    lines = "one two three four five six".split() * 12
    numbers = [str(k % 3) for k in range(40)]
    items = [(i, " ".join(w)) for i, w in enumerate((equal, grid, lines, numbers))]
    docs = [(i, f"before it {text} after it") for i, text in items]
    docs += [(10, " ".join(equal[:5])), (11, " ".join(equal[:6])), (12, " ".join(grid[:25])), (13, " ".join(lines[:35])), (14, " ".join(lines[:36]))]
    got = found(spark, docs, items)
    assert got == brute(docs, items)
    assert all((i, i) in got for i, _ in items)


def test_words_that_the_places_of_a_seed_cover():
    rng = random.Random(3)
    for _ in range(200):
        item = np.array([rng.randint(1, 2) for _ in range(rng.randint(0, 30))], np.uint64)
        places = {}
        for k in range(len(item) - 4):
            places.setdefault(tuple(item[k : k + 5]), set()).update(range(k, k + 5))
        seeds, covers = decontaminate._seeds(item)
        assert len(seeds) == len(places) and sorted(covers) == sorted(map(len, places.values()))


def test_stage_keeps_clean_rows_whole(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(1, f"a b {item} c", "x"), (2, "clean text", "y"), (None, item, "z"), (2, "clean text", "y")], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.remove(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id is null or doc_id = 2").collect()))


def test_rows_of_an_id_are_judged_one_by_one(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(1, item, 1), (1, "clean text", 2), (2, item, 3)], "doc_id long, text string, _held int")
    kept = decontaminate.remove(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [tuple(r) for r in kept.collect()] == [(1, "clean text", 2)]


def test_query_against_all_pairs(spark):
    directory = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in queries.table(spark, directory, "documents").collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, directory, "benchmark").collect()]
    got = {(r.doc_id, r.item_id): round(r.coverage, 9) for r in queries.op1_decontaminate(spark, directory).collect()}
    assert got == brute(docs, items) and got
