import random
import re
import zlib
from collections import Counter, defaultdict

from opslake.llm import spelling


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def brute(rows):
    known = counted(rows)
    near, without = defaultdict(set), defaultdict(list)
    for word in known:
        for i in range(len(word)):
            rest = word[:i] + word[i + 1 :]
            if rest in known:
                near[word].add(rest)
                near[rest].add(word)
            without[i, rest].append(word)
    for group in without.values():
        for word in group:
            near[word].update(w for w in group if w != word)
    form = {}
    for word in known:
        best = min(near[word], key=lambda w: (-known[w], w), default=None)
        if best is not None and known[best] >= 10 * known[word]:
            form[word] = best

    def root(word):
        while word in form:
            word = form[word]
        return word

    return {w: (form.get(w), root(w), n, len(near[w]), known[form[w]] if w in form else None) for w, n in known.items()}


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in rows], "doc_id long, text string, `a.b` string, word int").repartition(3)
    got = spelling.variants(df).collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: tuple(r)[1:] for r in got}


def edited(rng, word, letters="abcéÿÀ×z"):
    at = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    if kind == 0:
        return word[:at] + rng.choice(letters) + word[at:]
    return word[:at] + ("" if kind == 1 else rng.choice(letters)) + word[at + 1 :]


def test_families_of_variants(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcéÿÀ") for _ in range(rng.randint(7, 14))) for _ in range(60)]
    words += ["a" * n for n in range(7, 20)] + ["ab" * n for n in range(4, 9)]
    words += [edited(rng, w) for w in words for _ in range(6)]
    weights = [rng.choice([1, 1, 2, 30, 600]) for _ in words]
    text = [w for w, n in zip(words, weights, strict=True) for _ in range(n)]
    rng.shuffle(text)
    rows = [(i, " ".join(text[i * 40 : i * 40 + 40])) for i in range(len(text) // 40 + 1)]
    rows += [(None, "Éléphants Éléphants ÉLÉPHANTS"), (None, None), (5, ""), (5, "Éléphants éléphants"), (5, "Éléphants éléphants")]
    want = brute(rows)
    assert sum(1 for r in want.values() if r[0]) > 50
    assert any(r[0] and r[0] != r[1] for r in want.values())  # chains
    assert found(spark, rows) == want


def test_long_words_and_the_border(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcd") for _ in range(n)) for n in (38, 39, 40, 41, 42, 43, 300, 5000)]
    base += ["x" * n for n in (39, 40, 41, 42, 43)]
    words = base + [edited(rng, w, "abcdx") for w in base for _ in range(8)]
    rows = [(i, w) for i, w in enumerate(words * 3)] + [(900 + i, w) for i, w in enumerate(base * 30)]
    want = brute(rows)
    assert sum(r[3] for w, r in want.items() if len(w) > 41) > 40
    assert found(spark, rows) == want


def test_empty_tables(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, None), (None, "short words only"), (2, "")]) == {}


def test_words_of_a_shared_beginning_do_not_repeat_the_frontier(spark):
    # One beginning holds all words; a state branches only beyond the middle of its word.
    rng = random.Random(5)
    words = sorted({"the" + "".join(rng.choice("ab") for _ in range(9)) for _ in range(400)})
    rows = [(i, " ".join(words)) for i in range(4)]
    assert found(spark, rows) == brute(rows)
