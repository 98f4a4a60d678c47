"""Byte-level BPE by a lazily determinised finite-state transducer.

The ranks of a vocabulary are compiled into a transducer that reads the bytes
of one pattern match from left to right.  After each byte the encoding of the
prefix read so far has exactly one last token; which one follows from the
states before and from whether two neighbouring tokens may stand side by side.
A state is what the future can still depend on: the last token whose place is
settled and the bytes after it.  Tokens leave the transducer as soon as every
position from which a token could still grow has them in common, which is
after at most the longest token's bytes of lookahead.  States and transitions
are made when first met; when there are too many, those that went on in one
way only are dropped, and made again if they are met again.

Decoding is a stream: token bytes pass through an incremental UTF-8 state
machine that holds an unfinished character back until its bytes have come.

Defined results: null and empty texts have no token; texts of any length are
encoded whole, match by match; repeated rows get equal results; an empty table
gives an empty table; a match that is a vocabulary entry itself is one token.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textcontrols.llm.work import require, ship, text_udf

#: Bounds of what a worker keeps: states with their transitions, encoded matches in each of two generations, tested pairs of tokens.
MAX_STATES = 400_000
MAX_MATCHES = 200_000
MAX_PAIRS = 500_000
NEVER = 1 << 60


class Merges:
    """Rank lookups and the side-by-side test."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.prefixes = {k[:i] for k in ranks for i in range(1, len(k) + 1)}
        self._beside: dict[int, bool] = {}
        self.edges: dict[bytes, tuple[list, list] | None] = {}

    def merge(self, piece: bytes, until: int = 1) -> list[bytes]:
        """The tokens of a short piece: join the neighbours of least rank, the leftmost first, while any join."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > until:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            joined = parts[best] + parts[best + 1]
            if joined not in self.ranks:
                break
            parts[best:best + 2] = [joined]
        return parts

    def _edges(self, token: bytes) -> tuple[list, list] | None:
        """The pieces at the left and at the right edge over time, each with the rank at which it grows.

        None if merging the bytes of the token doesn't end in it.
        """
        if token in self.edges:
            return self.edges[token]
        found = None
        if len(token) == 1:
            found = ([(token, NEVER)], [(token, NEVER)])
        else:
            parts = self.merge(token, until=2)
            halves = [self._edges(p) if p in self.ranks else None for p in parts]
            if len(parts) == 2 and all(halves):
                rank = self.ranks[token]
                found = tuple([*half[side][:-1], (half[side][-1][0], rank), (token, NEVER)] for side, half in enumerate(halves))
        self.edges[token] = found
        return found

    def beside(self, left: bytes | None, right: bytes) -> bool:
        """Whether the two tokens stay apart when their bytes meet.

        The piece at the right edge of the left token and the one at the left
        edge of the right token join if their rank comes before both grow; at
        equal ranks the leftmost merge goes first.
        """
        if left is None:
            return True
        pair = self.ranks[left] << 32 | self.ranks[right]
        known = self._beside.get(pair)
        if known is not None:
            return known
        if len(self._beside) > MAX_PAIRS:
            self._beside.clear()
        a, b, i, j, known = self._edges(left)[1], self._edges(right)[0], 0, 0, None
        while known is None:
            (x, grows_x), (y, grows_y) = a[i], b[j]
            rank = self.ranks.get(x + y, NEVER)
            if rank < grows_x and rank <= grows_y and rank < NEVER:
                known = False
            elif grows_x == grows_y == NEVER:
                known = True
            elif grows_x <= grows_y:
                i += 1
            else:
                j += 1
        self._beside[pair] = known
        return known


class Transducer:
    """State: (settled token before, pending bytes, size of the last token at each pending position, positions that may grow)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.start = (None, b"", (), ())
        self.number = {self.start: 0}
        self.states = [self.start]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.same: dict[tuple[int, ...], tuple[int, ...]] = {}  # sizes and output that many states share, held once

    def _thin(self, at: int) -> int:
        """Half of the states at most stay: those that went on in most ways (two at least), the start, and ``at``, whose new number it returns."""
        ways = sorted(map(len, self.moves), reverse=True)
        least = max(2, ways[min(MAX_STATES // 2, len(ways) - 1)] + 1)
        stay = [i for i, moves in enumerate(self.moves) if len(moves) >= least or i in (0, at)]
        number = {i: k for k, i in enumerate(stay)}
        self.moves = [{byte: (number[to], out) for byte, (to, out) in self.moves[i].items() if to in number} for i in stay]
        self.states = [self.states[i] for i in stay]
        self.number = {state: k for k, state in enumerate(self.states)}
        self.same.clear()
        return number[at]

    def _tokens(self, pending: bytes, sizes: tuple[int, ...]) -> list[bytes]:
        """Tokens of the pending bytes, by going back from token to token."""
        found, end = [], len(sizes)
        while end > 0:
            found.append(pending[end - sizes[end - 1]:end])
            end -= sizes[end - 1]
        return found[::-1]

    @staticmethod
    def _first(sizes: tuple[int, ...], end: int) -> int:
        """Where the first token on the way to a position ends; 0 if none begins the pending bytes."""
        while (start := end - sizes[end - 1]) > 0:
            end = start
        return 0 if start else end

    def _move(self, at: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, pending, sizes, may_grow = self.states[at]
        pending += bytes((byte,))
        n, merges = len(pending), self.merges
        edges, beside, prefixes, ranks = merges.edges, merges.beside, merges.prefixes, merges.ranks
        open_from: list[int] = []  # positions that a token can still grow from: none that could not a byte ago, but the newest
        size = 0
        for start in chain(may_grow, (n - 1,)):
            piece = pending[start:]
            if piece not in prefixes:
                continue
            open_from.append(start)
            if not size and piece in ranks and (edges[piece] if piece in edges else merges._edges(piece)) is not None:
                left = before if start == 0 else pending[start - sizes[start - 1]:start]
                if left is None or beside(left, piece):  # exactly one last token fits
                    size = n - start
        if size:
            sizes += (size,)
        # those positions, and the end: what they have in common is settled
        out: list[bytes] = []
        open_from.append(n)
        while open_from[0] > 0:
            cut = self._first(sizes, open_from[0])
            if cut == 0 or any([self._first(sizes, p) != cut for p in open_from[1:]]):
                break
            out.append(pending[:cut])
            pending, sizes = pending[cut:], sizes[cut:]
            open_from = [p - cut for p in open_from]
        if out:
            before = merges.bytes_of[ranks[out[-1]]]
        if pending and open_from[0] > 0:
            before = None  # no token starts there any more
        open_from.pop()
        may_grow = tuple(open_from)
        state = (before, pending, self.same.setdefault(sizes, sizes), self.same.setdefault(may_grow, may_grow))
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        said = tuple([ranks[t] for t in out])
        move = self.moves[at][byte] = (to, self.same.setdefault(said, said))
        return move

    def encode(self, piece: bytes) -> list[int]:
        ranks = self.merges.ranks
        if piece in ranks:
            return [ranks[piece]]
        at, ids, moves = 0, [], self.moves
        for byte in piece:
            move = moves[at].get(byte)
            if move is None:
                if len(self.states) >= MAX_STATES:
                    at = self._thin(at)
                    moves = self.moves
                move = self._move(at, byte)
            at, out = move
            if out:
                ids.extend(out)
        _, pending, sizes, _ = self.states[at]
        ids.extend([ranks[t] for t in self._tokens(pending, sizes)])
        return ids


class Codec:
    """Texts to ids by pattern and transducer, and ids back to bytes or text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.finditer = regex.compile(pattern).finditer
        self.transducer = Transducer(ranks)
        self.bytes_of = self.transducer.merges.bytes_of
        self.name_of = {i: str(i) for i in self.bytes_of}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def matches(self, text: str) -> list[tuple[int, ...]]:
        """For each match of the pattern its ids."""
        found, known = self.find(text), self.known
        fresh = set(found).difference(known)
        if len(known) > MAX_MATCHES:  # the last generation stays at hand
            self.older, self.known = known, {}
            known, fresh = self.known, set(found)
        for m in fresh:
            ids = self.older.get(m)
            if ids is None:
                ids = tuple(self.transducer.encode(m.encode("utf-8", "surrogatepass")))
            known[m] = ids
        said = [known[m] for m in found]
        for m in fresh:
            if len(m) > 64:
                del known[m]
        return said

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.matches(text)))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its characters are whole; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            said = machine.decode(self.bytes_of[i])
            if said:
                yield said
        said = machine.decode(b"", True)
        if said:
            yield said


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Codec(ranks, pattern)


#: Ids that are decoded at once, so that a huge text is not held three times.
DECODE_STEP = 1 << 16


def _start(path: str, pattern: str):
    c = codec(path, pattern)

    def step(text: str) -> tuple:
        gc.disable()  # the caches are large and hold no cycles
        try:
            return whole(text)
        finally:
            gc.enable()

    token_bytes, token_name = c.bytes_of.__getitem__, c.name_of.__getitem__

    def whole(text: str) -> tuple:
        ids = chain.from_iterable(c.matches(text))
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        names, back, n = hashlib.sha256(), hashlib.sha256(), 0
        while part := list(islice(ids, DECODE_STEP)):
            names.update(((" " if n else "") + " ".join(map(token_name, part))).encode())
            n += len(part)
            back.update(machine.decode(b"".join(map(token_bytes, part))).encode("utf-8"))
        back.update(machine.decode(b"", True).encode("utf-8"))
        return n, names.hexdigest(), back.hexdigest()

    return step


def round_trip(docs: DataFrame, ranks: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded whole."""
    require(docs, text, *keep)
    call = text_udf(lambda: _start(ranks, pattern), "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(F.struct(*keep).alias("k"), call(F.col(text)).alias("r")).select("k.*", "r.*")


def encoded(text, ranks: str, pattern: str):
    """Column of ids (array of int) of a text column."""
    return text_udf(lambda: lambda t: (codec(ranks, pattern).encode(t),), "ids array<int>")(text)["ids"]


def decoded(ids, ranks: str, pattern: str):
    """Column of texts of a column of ids; null ids are null."""
    ship()

    @F.arrow_udf(StringType())
    def call(values: pa.Array) -> pa.Array:
        c = codec(ranks, pattern)
        return pa.array([None if v is None else "".join(c.decode_stream(v)) for v in values.to_pylist()], pa.string())

    return call(ids)
