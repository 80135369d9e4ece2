import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from opslake.llm import bpe, queries


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def peer(vocabulary):
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


def digests(text, peer):
    ids = peer.encode_ordinary(text)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_every_row_as_the_library_encodes_it(spark, vocabulary, peer):
    long = "ab" * 30_000 + " then " * 5_000
    rows = [(1, "The cat's  hat\n\n 12,345 é日本", "x"), (None, "", "y"), (2, None, None), (2, None, None), (3, long, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_documents(docs, vocabulary, keep_ids=True).collect()
    assert len(got) == len(rows)
    want = {(i, *digests(t or "", peer)) for i, t, _ in rows}
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.encode_documents(docs.limit(0), vocabulary).collect() == []


def test_query_as_the_library_on_all_documents(spark, peer):
    directory = "/root/testdata/sf0.001"
    texts = queries.table(spark, directory, "documents").select("doc_id", "text").collect()
    want = {(r.doc_id, *digests(r.text or "", peer)) for r in texts}
    assert {tuple(r) for r in queries.op3_bpe(spark, directory).collect()} == want


def test_random_pieces_and_texts(vocabulary, peer):
    rng = random.Random(5)
    encoder = bpe.Encoder(vocabulary)
    for _ in range(3000):
        text = "".join(rng.choice("aebht inrs\n'é日9.!") for _ in range(rng.randint(0, 50)))
        assert list(encoder.encode(text)) == peer.encode_ordinary(text)
        piece = bytes(rng.randrange(256) for _ in range(rng.randint(1, 20)))
        assert vocabulary.decode(vocabulary.encode_piece(piece)) == piece


def test_appends_and_edits_are_exact_and_local(vocabulary):
    rng = random.Random(6)
    for _ in range(200):
        piece = bytes(rng.choice(b"thern ias") for _ in range(400))
        start = rng.randint(0, 380)
        end, new = start + rng.randint(0, 9), bytes(rng.choice(b"ethn") for _ in range(rng.randint(0, 9)))
        table = bpe.PrefixTable(vocabulary, piece)
        assert table.replace(start, end, new) < 200
        table.append(b"ation")
        assert table.last == vocabulary.last_tokens(piece[:start] + new + piece[end:] + b"ation")


def test_a_growing_document(vocabulary, peer):
    whole = "It's  a  test\n \n with 12 spaces   and don't stop   "
    document = bpe.Document(vocabulary)
    for at in range(0, len(whole), 3):
        document.append(whole[at : at + 3])
        assert document.ids() == peer.encode_ordinary(whole[: at + 3])
