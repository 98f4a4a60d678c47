"""Order-preserving packing by dynamic programming.

Token streams of the documents, in table order, are cut into windows of at
most ``length`` tokens.  Cuts may lie at the end of a document (free), at the
end of a sentence (small penalty) or, where neither comes within a window, in
between (large penalty).  The cost of a window is its padding; the least total
is found from left to right: with ``best[j]`` the least cost of the stream up to
cut j, the window before j starts at the cut i that minimises
``best[i] + position[i]`` among those at most ``length`` back, which a monotone
queue gives in constant time.  A window whose size is a power of two needs no
padding; those starts are looked up by position.

Each input partition is a stream of its own, worked off in blocks, so nothing
is shuffled and a lost task repeats alone; the padding of its last window is
the price.  Sequences are numbered by partition and place.

Defined results: a null or empty text is one piece with the end token alone; a
text of any length is cut and every token lies in one piece; repeated rows are
packed each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcontrols.llm.work import SLICE_ROWS, arrow_schema, require

LENGTH = 2048
END_TOKEN = 1
#: Cost of a cut in tokens of padding: after a sentence, and inside one.
SENTENCE_CUT, HARD_CUT = 2.0, 64.0
#: Tokens that are cut at once; what the last windows hold goes on to the next block.
BLOCK_TOKENS = 1 << 19
#: Sequence numbers of a partition start at its index times this.
PARTITION_STEP = 1 << 33

SCHEMA = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
#: Characters that both libraries class alike; a text with any other goes to the tokenizers library.
_OTHER = re.compile("[^\t\n\r -~\u00a1-\u024f\u2013\u2014\u2018\u2019\u201c-\u201e\u2026\u20ac]")
#: The byte-level alphabet of such vocabularies: printable bytes stand for themselves, the others follow from U+0100.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Encoder:
    """Ids of a text by the vocabulary file of the tokenizers library.

    The ids are those of that library.  It needs 0.4 CPU seconds a MB, so plain
    texts take the same vocabulary, read from the same file as ranks, through
    tiktoken; this is used only if the file's merges make one token each, in the
    order of the ids, where both give the same.  Other texts, and other files,
    go to the tokenizers library itself.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        others = [b for b in range(256) if b not in set(_PRINTABLE)]
        byte_of = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}
        vocab = {t: i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        made = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        joined = ["".join(m) for m in made]
        plain = sorted(vocab.values()) == list(range(len(vocab))) and len(joined) == len(set(joined))
        plain = plain and all(vocab.get(t) == len(byte_of) + i for i, t in enumerate(joined))
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
        self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if plain and pattern else None
        ends = re.compile(r"[.!?\u2026][\"')\]]*$|\n").search
        size = self.tokenizer.get_vocab_size()
        self.ends_sentence = np.array([bool(ends(self.tokenizer.decode([i]))) for i in range(size)], bool)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not _OTHER.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = "") -> Encoder:
    """One encoder for each worker process and vocabulary; ``pattern`` is what the vocabulary splits text by."""
    return Encoder(path, pattern)


def cut_points(ends: np.ndarray, sentence: np.ndarray, total: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) of the allowed cuts of a stream, without its start; gaps over ``length`` get hard cuts."""
    pay = np.full(total + 1, np.inf)
    pay[sentence] = SENTENCE_CUT
    pay[ends] = pay[total] = 0.0
    pay[0] = 0.0
    position = np.flatnonzero(pay < np.inf)
    gaps = np.diff(position)
    for k in np.flatnonzero(gaps > length):
        pay[position[k] + length:position[k + 1]:length] = HARD_CUT
    position = np.flatnonzero(pay < np.inf)[1:]
    return position, pay[position]


def best_cuts(position: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """Positions of the chosen cuts, in order; the last is the end of the stream."""
    at = [0, *position.tolist()]
    pay = [0.0, *cost.tolist()]
    best, source = [0.0] * len(at), [0] * len(at)
    place = {p: i for i, p in enumerate(at)}
    queue = deque([0])
    powers = [size for size in (length >> 1, length >> 2, length >> 3) if size and size & (size - 1) == 0]
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        least = best[i] + at[i] + length - here
        for size in powers:  # no padding at a power of two
            k = place.get(here - size)
            if k is not None and best[k] < least:
                least, i = best[k], k
        best[j], source[j] = least + pay[j], i
        key = best[j] + here
        while queue and best[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = source[j]
    return cuts[::-1]


class Packer:
    """Documents of one partition in; pieces out, block by block."""

    def __init__(self, encode: Encoder, length: int, partition: int, block: int):
        self.encode, self.length, self.block = encode, length, block
        self.sequence = partition * PARTITION_STEP
        self.open: list[list] = []  # [key, ids, tokens before, tokens of the document]
        self.tokens = 0

    def add(self, key, text: str) -> Iterator[tuple]:
        ids = np.append(self.encode(text), np.uint32(END_TOKEN))
        self.open.append([key, ids, 0, len(ids)])
        self.tokens += len(ids)
        if self.tokens >= self.block:
            yield from self.flush(False)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        """Cut what is there; unless it is the last block, the tokens of the final windows stay."""
        if not self.open:
            return
        stream = np.concatenate([ids for _, ids, _, _ in self.open])
        ends = np.cumsum([len(ids) for _, ids, _, _ in self.open])
        sentence = np.flatnonzero(self.encode.ends_sentence[np.minimum(stream, len(self.encode.ends_sentence) - 1)]) + 1
        cuts = best_cuts(*cut_points(ends, sentence, len(stream), self.length), self.length)
        if not last:
            cuts = [c for c in cuts if c <= len(stream) - 2 * self.length]
        done, which, inside = 0, 0, 0
        for cut in cuts:
            offset = 0
            while done < cut:
                key, ids, before, whole = self.open[which]
                n = min(cut - done, len(ids) - inside)
                piece = ids[inside:inside + n]
                yield key, before + inside, n, zlib.crc32(piece.astype("<u4").tobytes()), whole, self.sequence, offset
                done, inside, offset = done + n, inside + n, offset + n
                if inside == len(ids):
                    which, inside = which + 1, 0
            self.sequence += 1
        rest = self.open[which:]
        if rest and inside:
            key, ids, before, whole = rest[0]
            rest[0] = [key, ids[inside:], before + inside, whole]
        self.open, self.tokens = rest, len(stream) - done


def pack(docs: DataFrame, tokenizer: str, pattern: str = "", doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
         block: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each piece: doc_id and the columns of SCHEMA."""
    require(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}"
    target = arrow_schema(schema)

    def batch(pieces: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*pieces), target)], schema=target)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(encoder(tokenizer, pattern), length, TaskContext.get().partitionId(), block)
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(at, SLICE_ROWS)
                pieces = [p for key, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                          for p in packer.add(key, t or "")]
                if pieces:
                    yield batch(pieces)
        pieces = list(packer.flush())
        if pieces:
            yield batch(pieces)

    return rows.mapInArrow(run, schema)
