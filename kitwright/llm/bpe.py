"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A sequence of tokens is the result of the merges exactly if every two
neighbours are: no merge of lower rank would ever have joined bytes across
their border. So a piece can be encoded from left to right: take the longest
token that matches, keep it if it is compatible with the token before, else
try its longest proper prefix, and step back one token when no prefix fits.
Positions from which the rest is known not to work are marked, so each is
tried once and the work is linear in the piece.

Longest matches come from the token trie of a pyahocorasick automaton over the
bytes read as Latin-1 characters, asked only where a token starts. Whether two tokens may be neighbours is
memoised. Pieces repeat, so their ids are memoised as well, in a bounded map
of each Python worker.

Defined results: a null text encodes as the empty text, which has no tokens;
texts of any length are encoded whole; special tokens are ordinary text;
repeated rows are encoded one by one; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kitwright.llm.common import batch

#: Entries of a worker's memos of space-delimited parts and of pieces (the memo of token pairs
#: is emptied with the former), and the longest part or piece in them.
PART_MEMO, PIECE_MEMO, MEMO_LENGTH = 250_000, 100_000, 64


class Tokenizer:
    """Exact BPE over a rank file of lines ``base64-token rank``."""

    def __init__(self, rank_path: str, pattern: str):
        import ahocorasick
        import regex

        with open(rank_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        if len(self.tokens) >= 1 << 20 or any(len(t) > 1 for t in self.tokens[:256]) or len(self.ranks) < 256:
            raise ValueError("the 256 bytes must have the ranks 0 to 255, and all ranks fit in 20 bits")
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in self.ranks.items():
            if len(token) > 1 and (halves := self._last_merge(token, rank)):
                self.split[rank] = halves
                self.merged[halves] = rank
        self.automaton = ahocorasick.Automaton()
        reachable = {t: r for t, r in self.ranks.items() if len(t) == 1 or r in self.split}
        for token, rank in reachable.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        # For every stretch that begins a token: the longest token that begins it.
        self.best, self.most = {"": -1}, max(map(len, reachable))
        for token in reachable:
            for n in range(1, len(token) + 1):
                if token[:n].decode("latin-1") not in self.best:
                    self.best[token[:n].decode("latin-1")] = next(reachable[token[:m]] for m in range(n, 0, -1) if token[:m] in reachable)
        self.shorter = [-1] * len(self.tokens)  # the longest proper prefix that is a token
        for token, rank in reachable.items():
            self.shorter[rank] = next((reachable[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in reachable), -1)
        self.sizes = [len(t) for t in self.tokens]
        self.length_of = np.array(self.sizes)
        self.start_of = np.cumsum(self.length_of) - self.length_of
        self.all_bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.words_are_pieces = r"| ?\p{L}+|" in pattern
        self.find = regex.compile(pattern).findall
        self.odd_space = re.compile(r" \s| $").search
        self.cut = re.compile(r"(?= \S)").split
        self.pairs: list[dict[int, bool]] = [{} for _ in self.tokens]
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``, or None if the merges never make it."""
        ranks, parts = self.ranks, [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` can be neighbours in an encoding."""
        # Undo the merges of both sides, latest first; whenever the tokens then
        # at the border would merge before the last merge undone, they'd have merged.
        limit = len(self.tokens)
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            halves = self.split.get(max(left, right))
            if halves is None:  # both are bytes, whose ranks are below all merges
                return True
            if left > right:
                limit, left = left, halves[1]
            else:
                limit, right = right + 1, halves[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, text = len(piece), piece.decode("latin-1")
        reach, best = self.automaton.longest_prefix, self.best
        sizes, shorter, pairs, open_at = self.sizes, self.shorter, self.pairs, bytearray(b"\1") * (size + 1)
        out: list[int] = []
        at, token, before, row = 0, best[text[: reach(text)]], -1, None
        while True:
            while token >= 0:
                end = at + sizes[token]
                if open_at[end]:
                    if row is None:
                        break
                    fits = row.get(token)
                    if fits is None:
                        fits = row[token] = self.compatible(before, token)
                    if fits:
                        break
                token = shorter[token]
            if token < 0:  # nothing fits here: shorten the token before
                open_at[at] = 0
                last = out.pop()
                at -= sizes[last]
                token = shorter[last]
                row = pairs[out[-1]] if out else None
                before = out[-1] if out else -1
            elif end == size:
                out.append(token)
                return out
            else:
                out.append(token)
                row = pairs[token]
                at, before = end, token
                rest = text[at : at + self.most]
                token = best[rest[: reach(rest)]]

    def _encode_word(self, word: str) -> bytes:
        """The ids of a space and ``word``, which is one piece."""
        parts = self.parts
        ids = parts.get(word)
        if ids is None:
            found = self.encode_piece(b" " + word.encode("utf-8"))
            ids = pack(f"<{len(found)}I", *found)
            if len(word) <= MEMO_LENGTH:
                if len(parts) >= PART_MEMO:
                    parts.clear()
                    self.pairs = [{} for _ in self.tokens]
                parts[word] = ids
        return ids

    def _encode_part(self, part: str) -> bytes:
        pieces, out = self.pieces, []
        for piece in self.find(part):
            ids = pieces.get(piece)
            if ids is None:
                found = self.encode_piece(piece.encode("utf-8"))
                ids = pack(f"<{len(found)}I", *found)
                if len(piece) <= MEMO_LENGTH:
                    if len(pieces) >= PIECE_MEMO:
                        pieces.clear()
                    pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers.

        A piece of the pattern takes at most one space, at its start, unless it
        is white space only; so a space before anything but white space always
        starts a piece, and the text can be cut there. ``parts`` memoises what
        stands between such spaces.
        """
        if " " not in text or self.odd_space(text):
            return b"".join(map(self._encode_part, self.cut(text)))
        parts, (first, *rest) = self.parts, text.split(" ")
        try:
            return self._encode_part(first) + b"".join(map(parts.__getitem__, rest))
        except KeyError:
            pass
        out = [self._encode_part(first)]
        for part in rest:
            ids = parts.get(part)
            if ids is None:
                if self.words_are_pieces and part.isalpha():
                    ids = self._encode_word(part)
                elif self.words_are_pieces and part[:-1].isalpha():  # what follows letters is a piece of its own
                    ids = self._encode_word(part[:-1]) + self._encode_part(part[-1])
                else:
                    ids = self._encode_part(" " + part)
                    if len(part) <= MEMO_LENGTH:
                        if len(parts) >= PART_MEMO:
                            parts.clear()
                        parts[part] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        found = np.frombuffer(ids, dtype="<u4")
        lengths = self.length_of[found]
        ends = np.cumsum(lengths)
        from_start = np.repeat(self.start_of[found] - (ends - lengths), lengths)
        return self.all_bytes[from_start + np.arange(len(from_start))].tobytes()


@lru_cache(maxsize=2)
def tokenizer(rank_path: str, pattern: str) -> Tokenizer:
    """One tokenizer for each Python worker and vocabulary."""
    return Tokenizer(rank_path, pattern)


def _mapper(rank_path: str, pattern: str, schema: pa.Schema, row: Callable[[Tokenizer, str], tuple]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(rank_path, pattern)
        for b in batches:
            rows = [row(t, text or "") for text in b.column(1).to_pylist()]
            made = zip(*rows, strict=True) if rows else [[] for _ in schema.names[1:]]
            yield batch(schema, [b.column(0), *map(list, made)])

    return run


def encode(docs: DataFrame, rank_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each text: ``doc_id``, ``token_ids`` (array of int), ``decoded`` (binary)."""

    def row(t: Tokenizer, text: str) -> tuple:
        ids = t.encode(text)
        return np.frombuffer(ids, dtype="<u4").astype(np.int32), t.decode(ids)

    schema = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
    picked = docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"`{text_column}` as text")
    return picked.mapInArrow(_mapper(rank_path, pattern, schema, row), "doc_id long, token_ids array<int>, decoded binary")


def digests(docs: DataFrame, rank_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The round trip of every text as counts and digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def row(t: Tokenizer, text: str) -> tuple:
        ids = t.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.decode(ids)).hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    picked = docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"`{text_column}` as text")
    return picked.mapInArrow(_mapper(rank_path, pattern, schema, row), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
