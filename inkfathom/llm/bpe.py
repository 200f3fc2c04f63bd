"""Exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a word one token alone can end the word's encoding. Going
along the bytes, an automaton over the vocabulary (trie with suffix links) gives
the tokens that are suffixes of the prefix. Such a token ends the encoding just
when the token stored for the prefix before it is compatible: the merges never
join a piece on the right edge of the one to a piece on the left edge of the
other. Back-pointers from the last byte give the ids. This takes time linear in
the length of the word, however long it is.

Two edge pieces x, y are joined by the merge (x, y) of rank r if x is not yet
taken up into its parent (of rank > r: at equal rank the one further left goes
first) and y is not either (of rank >= r).

Encodings of words and of blank-separated pieces are kept in bounded caches.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import map_batches

#: Fixed value: how byte-level BPE of this family cuts a text into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A blank inside a run of white space that is one word; else each blank begins a word.
_INNER_BLANK = re.compile(r"(?<=\s) (?=\s|\Z)")
_CACHED_PIECES, _CACHED_WORDS = 500_000, 250_000
_CACHED_PAIRS = 1_000_000
_LONGEST_CACHED = 48
_NEVER = 1 << 60


def default_path() -> str:
    """Where the installed public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = {t: i for t, i in vocab.items() if t not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * size
        for t, i in plain.items():
            self.token[i] = bytes(alphabet[c] for c in t)
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            pair = vocab[left], vocab[right]
            self.rank[pair] = r
            self.parts[vocab[left + right]] = (*pair, r)
        self.decimal = [b"%d" % i for i in range(size)]
        self._split = regex.compile(WORD)
        self._special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self._build(plain)
        self._moves: dict[int, int] = {}
        self._endings: list[tuple[tuple[int, int], ...] | None] = [None] * len(self._goto)
        self._fit: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    # -- automaton ---------------------------------------------------------
    def _build(self, plain: dict[str, int]) -> None:
        self._goto: list[dict[int, int]] = [{}]
        ends = [-1]
        for i in plain.values():
            at = 0
            for byte in self.token[i]:
                nxt = self._goto[at].get(byte)
                if nxt is None:
                    nxt = self._goto[at][byte] = len(ends)
                    self._goto.append({})
                    ends.append(-1)
                at = nxt
            ends[at] = i
        self._link = [0] * len(ends)
        self._suffixes: list[tuple[int, ...]] = [()] * len(ends)
        todo = deque([0])
        while todo:
            at = todo.popleft()
            for byte, child in self._goto[at].items():
                if at:
                    back = self._link[at]
                    while back and byte not in self._goto[back]:
                        back = self._link[back]
                    self._link[child] = self._goto[back].get(byte, 0)
                own = (ends[child],) if ends[child] >= 0 else ()
                self._suffixes[child] = own + self._suffixes[self._link[child]]
                todo.append(child)

    def _step(self, at: int, byte: int) -> int:
        goto, link = self._goto, self._link
        while at and byte not in goto[at]:
            at = link[at]
        return goto[at].get(byte, 0)

    # -- compatibility -----------------------------------------------------
    def _edge(self, token: int, side: int) -> Iterator[tuple[int, int]]:
        """Pieces on one edge of a token and the rank at which each is taken up."""
        taken = _NEVER
        while True:
            yield token, taken
            if token not in self.parts:
                return
            *pair, taken = self.parts[token]
            token = pair[side]

    def _joined(self, left: int, right: int, before: int) -> bool:
        """Whether a merge of rank below ``before`` joins pieces across the border."""
        for x, x_taken in self._edge(left, 1):
            for y, y_taken in self._edge(right, 0):
                r = self.rank.get((x, y), _NEVER)
                if r < before and r < x_taken and r <= y_taken:
                    return True
        return False

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        fit = self._fit.get(key)
        if fit is None:
            if len(self._fit) >= _CACHED_PAIRS:
                self._fit.clear()
            fit = self._fit[key] = not self._joined(left, right, _NEVER)
        return fit

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as that token."""
        known = self._whole.get(token)
        if known is None:
            if token in self.parts:
                left, right, r = self.parts[token]
                known = self.whole(left) and self.whole(right) and not self._joined(left, right, r)
            else:
                known = len(self.token[token]) == 1
            self._whole[token] = known
        return known

    # -- encoding ----------------------------------------------------------
    def encode_word(self, word: bytes) -> list[int]:
        moves, endings, fit, last, lengths, at = self._moves, self._endings, self._fit, [], [], 0
        for n, byte in enumerate(word):
            key = at << 8 | byte
            at = moves.get(key)
            if at is None:
                at = moves[key] = self._step(key >> 8, byte)
            ends = endings[at]
            if ends is None:
                ends = endings[at] = tuple((t, len(self.token[t])) for t in self._suffixes[at] if self.whole(t))
            for t, size in ends:
                before = n - size
                if before < 0:
                    break
                pair = last[before] << 32 | t
                ok = fit.get(pair)
                if ok or (ok is None and self.compatible(last[before], t)):
                    break
            else:
                raise ValueError(f"no token ends {word[: n + 1]!r}")
            last.append(t)
            lengths.append(size)
        ids, n = [], len(word) - 1
        while n >= 0:
            ids.append(last[n])
            n -= lengths[n]
        ids.reverse()
        return ids

    def _words_of(self, text: str) -> bytes:
        out, kept = [], self._words
        for w in (text,) if text[1:].isalpha() and text[0] in " " else self._split.findall(text):
            got = kept.get(w)
            if got is None:
                got = packed(self.encode_word(w.encode()))
                if len(w) <= _LONGEST_CACHED:
                    if len(kept) >= _CACHED_WORDS:
                        kept.clear()
                    kept[w] = got
            out.append(got)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if _INNER_BLANK.search(text):
            return self._words_of(text)
        first, *rest = text.split(" ")
        kept = self._pieces
        found = list(map(kept.get, rest))
        if None in found:
            for i, got in enumerate(found):
                if got is None:
                    piece = rest[i]
                    got = found[i] = self._words_of(" " + piece)
                    if len(piece) <= _LONGEST_CACHED:
                        if len(kept) >= _CACHED_PIECES:
                            kept.clear()
                        kept[piece] = got
        return self._words_of(first) + b"".join(found)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        out, at = [], 0
        for m in self._special.finditer(text):
            out += self._plain(text[at : m.start()]), np.array([self.special[m.group()]], "<u4").tobytes()
            at = m.end()
        if not out:
            return self._plain(text)
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: list[int]) -> bytes:
        """The decoded text in UTF-8, broken sequences replaced."""
        raw = b"".join(map(self.token.__getitem__, ids))
        return raw.decode("utf-8", "replace").encode("utf-8")


@lru_cache(2)
def codec(path: str) -> Codec:
    """One codec for each file and process."""
    return Codec(path)


def encode_documents(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    Defined cases: null and empty texts have no ids; the strings of special
    tokens are those tokens; repeated rows give repeated results; only the
    named columns are read. A text of any length is encoded whole.
    """
    path = path or default_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, said, back, kept = [], [], [], []
            for t in b.column("text"):
                raw = np.frombuffer(c.encode(t.as_py()), "<u4")
                ids = raw.tolist()
                n.append(len(ids))
                said.append(hashlib.sha256(b",".join(map(c.decimal.__getitem__, ids))).hexdigest())
                back.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(raw.astype(np.int32))
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_batches(rows, run, schema + ", ids array<int>" * with_ids)
