"""Byte-level BPE by prefix dynamic programming.

The merge procedure gives every prefix of a piece exactly one last token. A token t that ends
at byte i belongs to prefix i if and only if t follows the last token of the prefix before it
as a *compatible* pair: merging the two tokens' bytes from scratch gives the same two tokens.
Storing the last token of every prefix therefore encodes a piece from left to right, appends
bytes without looking back, and re-encodes after an edit only until the stored tokens agree
again.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from accord.llm.common import documents

#: Pieces whose ids one generation of a worker's memory holds, and code points of the longest that it holds.
MOST_PIECES, LONGEST_KEPT = 300_000, 64
#: Rows of a result batch.
ROWS = 500


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines 'base64 rank'."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixEncoder:
    """Encodes pieces (pre-tokens) by the last token of each byte prefix."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.found = ahocorasick.Automaton()  # gives the tokens that end at each byte, the longest first
        for token, rank in ranks.items():
            self.found.add_word(token.decode("latin-1"), (rank, len(token)))
        self.found.make_automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes, stop: int = 1) -> list[int]:
        """The defining procedure: join the adjacent pair of lowest rank, leftmost first. For short data."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; null for single bytes and for what no merge makes."""
        if token not in self._halves:
            data = self.tokens[token]
            parts = self.merge(data, 2) if len(data) > 1 else []
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging both tokens' bytes gives the two tokens: no merge across their border comes before theirs.

        Of the two parts that face each other at the border, the one that is made later is taken apart
        again and again; a merge of the two counts if it comes before the part's own next merge. Of
        equal ranks the leftmost merge is the first.
        """
        if (known := self._pairs.get((left, right))) is not None:
            return known
        if len(self._pairs) > 1_000_000:
            self._pairs.clear()
        tokens, ranks, limit, a, b = self.tokens, self.ranks, 1 << 60, left, right
        known = self.reachable(left) and self.reachable(right)
        while known:
            rank = ranks.get(tokens[a] + tokens[b])
            if rank is not None and rank < limit:
                known = False
                break
            made_a, made_b = a if self.halves(a) else -1, b if self.halves(b) else -1
            if made_a < 0 and made_b < 0:
                break
            if made_a > made_b:
                limit, a = a, self.halves(a)[1]
            else:
                limit, b = b + 1, self.halves(b)[0]
        self._pairs[left, right] = known
        return known

    def extend(self, data: bytes, last: list[int], start: int | None = None, stop: int | None = None) -> list[int]:
        """Fills last[i], the last token of data[:i+1], from prefix `start` on; earlier entries hold already."""
        at = len(last) if start is None else start
        stop, pairs, compatible = len(data) if stop is None else stop, self._pairs, self.compatible
        del last[at:]
        for end, (token, size) in self.found.iter(data.decode("latin-1"), max(0, at - self.longest + 1), stop):
            if end < at:
                continue
            if end > at:
                break
            if end < size:
                fits = self.reachable(token)
            elif (fits := pairs.get((last[end - size], token))) is None:
                fits = compatible(last[end - size], token)
            if fits:
                last.append(token)
                at += 1
        if at < stop:
            raise ValueError("the vocabulary lacks single bytes")
        return last

    def replace(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int], int]:
        """data with [start:end) replaced, its last tokens, and how many of them were computed anew.

        The tokens after the edit are recomputed, as many at a time as the longest token has bytes,
        until a whole such run equals the former ones: from there nothing can differ.
        """
        out, tail = data[:start] + new + data[end:], last[end:]
        fresh, i = last[:start], start
        while i < len(out):
            stop = min(len(out), i + self.longest)
            self.extend(out, fresh, i, stop)
            k, i = i - start - len(new), stop
            if k >= 0 and stop < len(out) and fresh[-self.longest :] == tail[k : k + self.longest]:
                fresh += tail[k + self.longest :]
                break
        return out, fresh, i - start

    def walk(self, last: list[int]) -> list[int]:
        """The tokens of the whole piece, read from its end."""
        out, i = [], len(last)
        while i > 0:
            out.append(last[i - 1])
            i -= len(self.tokens[last[i - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """A piece that is itself a token stays whole, as the tiktoken library has it."""
        if not piece:
            return []
        if (token := self.ranks.get(piece)) is not None:
            return [token]
        return self.walk(self.extend(piece, []))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _class(kind: str, highest: int) -> str:
    """The code points up to `highest` of a class of the regex module, as ranges for a set of the re module."""
    points = "".join(map(chr, range(highest + 1)))
    runs = ((points[m.start()], points[m.end() - 1]) for m in regex.finditer(f"{kind}+", points))
    return "".join(f"\\U{ord(a):08x}-\\U{ord(b):08x}" for a, b in runs)


class Splitter:
    """Cuts texts into pieces by the pattern; texts within Latin-1 by an equal pattern of the quicker re module."""

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern)
        letters, digits, spaces = (_class(kind, 255) for kind in (r"\p{L}", r"\p{N}", r"\s"))
        narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{digits}]").replace(r"\p{L}", f"[{letters}]")
        narrow = narrow.replace(r"\p{N}", f"[{digits}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")
        self.latin = None if "\\p" in narrow else re.compile(narrow)

    def __call__(self, text: str) -> list[str]:
        if self.latin is not None:
            try:
                text.encode("latin-1")
                return self.latin.findall(text)
            except UnicodeEncodeError:
                pass
        return self.full.findall(text)


class Text:
    """A document under edit: pieces with their prefix tables. Appends redo the last two pieces at most."""

    def __init__(self, encoder: PrefixEncoder, splitter: Splitter, text: str = ""):
        self.encoder, self.splitter, self.pieces, self.redone = encoder, splitter, [], 0
        self.append(text)

    def append(self, text: str) -> None:
        back, self.pieces = self.pieces[-2:], self.pieces[:-2]
        known = {piece: last for piece, last in back}
        self.redone = 0
        for piece in self.splitter("".join(p for p, _ in back) + text):
            data, last = piece.encode(), known.get(piece)
            if last is None:
                grown = next((p for p in known if piece.startswith(p)), "")
                last = self.encoder.extend(data, list(known.get(grown, [])))
                self.redone += 1
            self.pieces.append((piece, last))

    def ids(self) -> list[int]:
        out: list[int] = []
        for piece, last in self.pieces:
            token = self.encoder.ranks.get(piece.encode())
            out += [token] if token is not None else self.encoder.walk(last)
        return out


class Packed(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers, computed when first asked for.

    Two generations of MOST_PIECES at most: when the young one is full it becomes the old one, and
    what is asked for again moves back, so frequent pieces stay and memory is bounded.
    """

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.pop(piece, None) or array("I", self.encode(piece)).tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= MOST_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


@lru_cache(maxsize=2)
def library(path: str, pattern: str) -> tiktoken.Encoding:
    """The tiktoken library's encoder, for operators that need ids but no prefix tables; the ids are equal."""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


_KEPT: dict[tuple[str, str], tuple[PrefixEncoder, Splitter, Packed]] = {}


def tools(path: str, pattern: str) -> tuple[PrefixEncoder, Splitter, Packed]:
    """One encoder a worker process and vocabulary."""
    if (path, pattern) not in _KEPT:
        encoder = PrefixEncoder(load_ranks(path))
        _KEPT[path, pattern] = encoder, Splitter(pattern), Packed(lambda piece: encoder.encode(piece.encode("utf-8", "surrogatepass")))
    return _KEPT[path, pattern]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, decode: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian uint32) and, if asked for, decoded (the ids' bytes).

    One row for each input row, repeated ids included. Null and empty texts have no tokens. Other
    columns of `docs` are not read. No shuffle: each task encodes its own rows; a piece's ids are
    remembered within a bounded table of the worker.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split, packed = tools(vocabulary, pattern)
        get = packed.__getitem__
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                ids = [b"".join(map(get, split(text))) for text in batch.column(1).to_pylist()]
                columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([encoder.decode(array("I", x)) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids", *["decoded"] * decode]
    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decode
    return documents(docs).mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, text_bytes of rows with doc_id and ids as encode_documents has them; null ids give no bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tools(vocabulary, pattern)[0]
        for batch in batches:
            out = [encoder.decode(array("I", x or b"")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "text_bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text_bytes binary")
