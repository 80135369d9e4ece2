"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of bytes there is exactly one token that ends its
encoding: the token t that is a suffix of the prefix and fits behind the last
token of what is left of it.  Storing that token for every prefix gives the
encoding by walking back, lets bytes be appended without touching earlier
entries, and limits the work after an edit to the bytes near it.

Texts are split by the tokenizer's pattern first; each match is encoded alone.
A null text counts as empty; an empty text has no tokens.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.llm.batches import map_slices, share, texts

#: Distinct pieces, and token pairs, that a worker remembers; older ones go when there are twice as many.
REMEMBERED = 200_000
#: Longer pieces are encoded without being remembered.
REMEMBERED_BYTES = 48


class Vocabulary:
    """Tokens by rank, with the merge that made each of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = pattern
        size = max(ranks.values(), default=-1) + 1
        self.token = [b""] * size
        for text, rank in ranks.items():
            self.token[rank] = text
        self.longest = max(map(len, ranks), default=1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.unreachable: set[int] = set()
        self._find_parts()
        self.fitting: dict[tuple[int, int], bool] = {}
        self.ending = ahocorasick.Automaton()  # one character for each byte
        for text, rank in ranks.items():
            if rank not in self.unreachable:
                self.ending.add_word(text.decode("latin-1"), (rank, len(text)))
        if ranks:
            self.ending.make_automaton()

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as file:
            pairs = (line.split() for line in file if line.strip())
            return cls({base64.b64decode(text): int(rank) for text, rank in pairs}, pattern)

    def __getstate__(self):
        return self.ranks, self.pattern

    def __setstate__(self, state):
        self.__init__(*state)

    def _find_parts(self) -> None:
        """The last merge of every token, from low ranks to high: parts have lower ranks than the whole."""
        for rank, text in enumerate(self.token):
            for cut in range(len(text) - 1, 0, -1):
                left, right = self.ranks.get(text[:cut]), self.ranks.get(text[cut:])
                if left is None or right is None or left >= rank or right >= rank:
                    continue
                if self._whole(left) and self._whole(right) and self.fits(left, right):
                    self.parts[rank] = (left, right)
                    self.merged[left, right] = rank
                    break
            else:
                if len(text) > 1:
                    self.unreachable.add(rank)

    def _whole(self, rank: int) -> bool:
        return rank not in self.unreachable

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves exactly these two.

        Undoes merges at the seam, latest first.  A merge across the seam that
        comes before the latest one undone would have happened instead.
        """
        ceiling = len(self.token) * 2 + 2  # merges below this come earlier than what has been undone
        while True:
            across = self.merged.get((left, right))
            if across is not None and across * 2 < ceiling:
                return False
            open_left, open_right = self.parts.get(left), self.parts.get(right)
            if open_left is None and open_right is None:
                return True
            # Of equal merges the left one comes first, so a right one at the same rank is undone before it.
            if open_right is None or (open_left is not None and left > right):
                ceiling, left = left * 2, open_left[1]
            else:
                ceiling, right = right * 2 + 1, open_right[0]

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of every prefix of ``piece``; ``known`` holds those of the first prefixes."""
        last = known if known is not None else []
        done = len(last)
        if len(piece) == done:
            return last
        fitting = self.fitting
        if len(fitting) > 4 * REMEMBERED:
            fitting.clear()
        # Tokens that end at a byte come longest first.
        for end, (rank, size) in self.ending.iter(piece.decode("latin-1"), max(0, done - self.longest)):
            if end < done:
                continue
            if end > done:
                break
            if size <= end:
                pair = (last[end - size], rank)
                fits = fitting.get(pair)
                if fits is None:
                    fits = fitting[pair] = self.fits(*pair)
                if not fits:
                    continue
            last.append(rank)
            done += 1
        if done < len(piece):
            raise ValueError(f"the vocabulary has no token for byte {piece[done]}")
        return last

    def walk_back(self, last: list[int]) -> list[int]:
        found, at = [], len(last)
        while at:
            rank = last[at - 1]
            found.append(rank)
            at -= len(self.token[rank])
        return found[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk_back(self.last_tokens(piece))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class PrefixTable:
    """A piece of bytes with the last token of every prefix, open to appends and edits."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary = vocabulary
        self.piece = piece
        self.last = vocabulary.last_tokens(piece)

    def append(self, more: bytes) -> None:
        """Exact: entries of earlier prefixes stay as they are."""
        self.piece += more
        self.vocabulary.last_tokens(self.piece, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of ``piece[start:end]``; returns how many entries were computed anew.

        An entry depends on the bytes of its token and on the entry before that
        token.  Once a full token length of entries behind the edit agrees with
        the old ones, all later ones do.
        """
        old_tail, longest = self.last[end:], self.vocabulary.longest
        self.piece = self.piece[:start] + new + self.piece[end:]
        last = self.last[:start]
        while len(last) < len(self.piece):
            self.vocabulary.last_tokens(self.piece[: len(last) + longest], last)
            behind = len(last) - start - len(new)
            if behind >= longest and last[-longest:] == old_tail[behind - longest : behind]:
                computed, last = len(last) - start, last + old_tail[behind:]
                break
        else:
            computed = len(last) - start
        self.last = last
        return computed

    def ids(self) -> list[int]:
        return self.vocabulary.walk_back(self.last)


class _Memory(dict):
    """Packed ids of pieces, in two generations."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            data = piece.encode("utf-8", "replace")
            packed = np.array(self.vocabulary.encode_piece(data), dtype="<u4").tobytes()
            if len(data) > REMEMBERED_BYTES:
                return packed
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = packed
        return packed


class Encoder:
    """Whole texts to ids, with a bounded memory of pieces already encoded."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(vocabulary.pattern).findall
        self.packed = _Memory(vocabulary)

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text`` as unsigned 32-bit integers, low byte first."""
        return np.frombuffer(b"".join(map(self.packed.__getitem__, self.split(text))), dtype="<u4")


def encode_documents(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Encode every text, decode the ids again, and give both as digests.

    One row per input row: the id, ``n_tokens``, ``ids_sha256`` (ids as
    little-endian unsigned 32-bit integers), ``decoded_sha256``, and with
    ``keep_ids`` the ids themselves.  Repeated rows repeat; a null id stays
    null; other columns are ignored.
    """
    held = share(docs.sparkSession, [vocabulary])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kit = held.value
        if len(kit) == 1:
            kit.append(Encoder(kit[0]))
        encoder = kit[1]
        token = encoder.vocabulary.token
        counts, ids_digest, text_digest, lists = [], [], [], []
        for text in texts(batch, "text"):
            ids = encoder.encode(text)
            counts.append(len(ids))
            ids_digest.append(hashlib.sha256(ids).hexdigest())
            text_digest.append(hashlib.sha256(b"".join(map(token.__getitem__, ids.tolist()))).hexdigest())
            if keep_ids:
                lists.append(ids.astype(np.int32))
        out = {
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array(counts, pa.int64()),
            "ids_sha256": pa.array(ids_digest, pa.string()),
            "decoded_sha256": pa.array(text_digest, pa.string()),
        }
        if keep_ids:
            ends = np.cumsum([0, *counts]).astype(np.int32)
            values = np.concatenate(lists) if lists else np.empty(0, np.int32)
            out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        return pa.RecordBatch.from_pydict(out)

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_slices(source, run, schema + (", ids array<int>" if keep_ids else ""))


class Document:
    """A text kept encoded while it grows or is edited."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.encoder = Encoder(vocabulary)
        self.text = text
        self.pieces = self.encoder.split(text)

    def append(self, more: str) -> None:
        """Only the last piece can change: every earlier one ended before the old end of the text."""
        tail = self.pieces.pop() if self.pieces else ""
        self.pieces += self.encoder.split(tail + more)
        self.text += more

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.encoder.vocabulary.encode_piece(p.encode("utf-8", "replace")) for p in self.pieces))
