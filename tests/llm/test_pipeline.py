import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from opslake.llm import bpe, quality, queries
from test_decontaminate import brute as brute_leaks
from test_neardup import brute as brute_classes
from test_secret_scan import brute as brute_secrets

DATA = "/root/testdata/sf0.01"


def masked(text):
    out, reach = [], 0
    for _, start, end in sorted(brute_secrets(text), key=lambda s: s[1:]):
        if start >= reach:
            out += [text[reach:start], corpus_pipeline.MASK]
        reach = max(reach, end)
    return "".join([*out, text[reach:]])


def test_run_against_stage_by_stage_brute_force(spark):
    docs = queries.table(spark, DATA, "documents")
    model = quality.fit(docs, queries.table(spark, DATA, "labels"))
    packers = model.packers()
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts = {i: t for i, t in texts.items() if model.score(np.array(quality.size_difference(t or "", packers))) >= 0.5}
    assert 500 < len(texts) < 1000
    classes = brute_classes(texts)
    texts = {i: t for i, t in texts.items() if classes[i] == i}
    items = [(r.item_id, r.text) for r in queries.table(spark, DATA, "benchmark").collect()]
    held = {d for d, _ in brute_leaks(list(texts.items()), items)}
    texts = {i: masked(t) for i, t in texts.items() if i not in held}
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN)
    peer = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = peer.encode_ordinary(text)
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_on_odd_rows(spark):
    rows = [
        (1, "the quick one of them and it was with that", "en", "s", 10, "x"),
        (1, "the quick one of them and it was with that", "en", "s", 10, "x"),
        (None, None, None, None, None, None),
        (2, "", None, "s", 0, "y"),
        (3, 'a password="abcdef123" here', "en", None, None, "z"),
        (4, "word " * 60_000, "en", "s", 1, "z"),
    ]
    kind = "doc_id long, text string, lang string, source string, n_chars long, spans string"
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            if name == "byte_level_bpe":
                assert out.count() == docs.count()
                continue
            assert out.schema.simpleString() == docs.schema.simpleString(), name
            got = out.collect()
            if name == "secret_scans" and got:
                assert {(r.doc_id, r.text, r.n_chars) for r in got if r.doc_id == 3} == {(3, "a [secret]\" here", 16)}
                assert len(got) == 6
            if name == "minhash_near_dedup":
                assert sorted(str(r.doc_id) for r in got) == (["1", "2", "3", "4", "None"] if docs.count() else [])


def test_stages_keep_columns_of_clashing_and_dotted_names(spark):
    names = ["_spans", "a.b", "_text", "_row", "_gone", "_held", "_m_hex", "_reach", "name", "label", "tag", "_id", "_gone_id", "hash"]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    own = [f"own {n}" for n in names]
    rows = [(1, "the quick one of them and it was with that", "en", "s", 10, *own), (2, 'a token="abcdef123" here', "en", "s", 9, *own)]
    docs = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        got = out.collect()
        assert name == "quality_classifier" or len(got) == 2, name
        assert all(list(r)[5:] == own for r in got), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == 2


def test_every_stage_is_named_and_order_holds():
    assert [re.sub("_.*", "", n) for n, _ in corpus_pipeline.STAGES] == ["quality", "minhash", "benchmark", "secret", "byte"]
