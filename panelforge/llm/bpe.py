"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

Each word (a match of the public split pattern) is a row of byte tokens.  Leaf i of
the tree holds (rank, i) of the pair that starts at token i; the root is the leftmost
pair of the lowest rank.  A merge changes at most three leaves, each a logarithmic
update, until no mergeable pair remains.

Encoded words are kept per Python worker in a dictionary that is emptied at
``KEEP_WORDS`` entries, so memory is bounded and results never depend on it.

Defined cases: a null text counts as empty and has no ids; special-token strings of
the vocabulary file inside a text become their special id, as that library does;
repeated rows give repeated results; only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelforge.llm.store import small_batches, vocabulary

#: The split pattern of this public vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEEP_WORDS = 400_000
_NONE = 1 << 60


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return letters


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        of_letter = {c: b for b, c in byte_letters().items()}
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(of_letter[c] for c in token) for token, i in vocab.items() if all(c in of_letter for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})
        self.first = [vocab[byte_letters()[b]] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.kept: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word by segment-tree merging."""
        tokens = [self.first[b] for b in word]
        n = len(tokens)
        if n < 2:
            return tokens
        merges = self.merges
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [_NONE] * (2 * size)
        # A key is rank * 2**32 + position: the minimum is the leftmost lowest rank.
        for i in range(n - 1):
            found = merges.get((tokens[i], tokens[i + 1]))
            if found:
                tree[size + i] = (found[0] << 32) | i
        for i in range(size - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right

        def put(i: int, key: int) -> None:
            i += size
            tree[i] = key
            i >>= 1
            while i:
                left, right = tree[2 * i], tree[2 * i + 1]
                least = left if left < right else right
                if tree[i] == least:
                    break
                tree[i] = least
                i >>= 1

        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while tree[1] != _NONE:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            tokens[i] = merges[tokens[i], tokens[j]][1]
            tokens[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                put(j, _NONE)
            if k < n:
                before[k] = i
                found = merges.get((tokens[i], tokens[k]))
                put(i, (found[0] << 32) | i if found else _NONE)
            else:
                put(i, _NONE)
            h = before[i]
            if h >= 0:
                found = merges.get((tokens[h], tokens[i]))
                put(h, (found[0] << 32) | h if found else _NONE)
        return [t for t in tokens if t >= 0]

    def _encode_word(self, word: str) -> bytes:
        out = np.array(self.merge(word.encode()), dtype="<u4").tobytes()
        if len(word) <= 64:
            if len(self.kept) >= KEEP_WORDS:
                self.kept.clear()
            self.kept[word] = out
        return out

    def _encode_plain(self, text: str, out: list[bytes]) -> None:
        kept = self.kept
        for word in self.words.findall(text):
            ids = kept.get(word)
            out.append(self._encode_word(word) if ids is None else ids)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        if self.cut is not None:
            for m in self.cut.finditer(text):
                self._encode_plain(text[at : m.start()], out)
                out.append(self.special[m[0]].to_bytes(4, "little"))
                at = m.end()
        self._encode_plain(text[at:] if at else text, out)
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker and file, so encoded words are reused between tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(vocabulary(path))
    return _codecs[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode the ids again, and digest both.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds the real
    outputs, ``ids array<bigint>`` and ``decoded string``.  A map over rows: no shuffle,
    one text of an Arrow batch at a time.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<bigint>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            counts, hashes, decoded, ids_out, texts_out = [], [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                back = bpe.decode(ids)
                counts.append(len(ids))
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    ids_out.append(ids.astype(np.int64))
                    texts_out.append(back)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids_out, pa.list_(pa.int64())), pa.array(texts_out, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
