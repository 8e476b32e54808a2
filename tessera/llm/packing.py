"""Order-preserving packing of documents into sequences of bounded length by dynamic programming.

The documents of a task form one stream of tokens in their order, which blocks of bounded length pass through. A block's
windows are cut at document or sentence boundaries, or at a higher penalty every few tokens of a sentence, minimising
padding plus the penalties. With f(j) the least cost of the stream's first c_j
tokens, f(j) = penalty(j) + size - c_j + min(f(i) + c_i) over the i with c_j - c_i <= size, and the minimum over that
sliding window is kept by a monotone queue. A block ends where
its cost a token is least; what follows is left to the next block. What a task's last window
leaves over is dealt into sequences whose lengths are powers of two, which need no padding.

Null texts are empty documents: they hold the end id alone. Texts of any length are packed whole. Empty tables give no
rows; repeated rows are packed each; among equally cheap cuts the first is taken. Keys may be of any type, null too. Columns
other than the key and the text are not read, so their names do no harm. No shuffle: a task packs its own input, and the
sequence's number holds the task's. A task ends in at most 13 sequences that are powers of two, whatever its length.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import quoted, slices, small_batches, table
from tessera.llm.tokenizing import WordIds, tokenizer_path

TOKENIZER, SIZE, END = "word_bpe_49k.json", 4096, 2
#: Costs in tokens of padding.
SENTENCE_CUT, HARD_CUT = 4, 24
#: Tokens between the places where a sentence may be cut.
STEP = 32
#: Windows of a block, and those of its end among which it is cut.
BLOCK, LEFT = 64, 2
DDL = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(positions: np.ndarray, penalties: np.ndarray, size: int, left: int = 0) -> list[int]:
    """Indices into positions (ascending from 0, gaps of size at most) of the cheapest cuts, the first and last among them.

    With left, the end is where the cost a token is least within the last ``left`` positions' tokens.
    """
    at, pen = positions.tolist(), penalties.tolist()
    cost, back = [0.0] * len(at), [0] * len(at)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (f(i) + c_i, i), values ascending
    for j in range(1, len(at)):
        c = at[j]
        while at[queue[0][1]] < c - size:
            queue.popleft()
        best, i = queue[0]
        cost[j], back[j] = pen[j] + size - c + best, i
        value = cost[j] + c
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    found, j = [], len(at) - 1
    if left:
        j = min((k for k in range(1, len(at)) if at[k] >= at[-1] - left), key=lambda k: cost[k] / at[k])
    while j > 0:
        found.append(j)
        j = back[j]
    return [0, *reversed(found)]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which the stream may be cut, at most size apart, and their penalties."""
    n = len(ids)
    penalty = np.full(n + 1, -1.0)
    penalty[1:][sentence_ends[ids]] = SENTENCE_CUT
    penalty[doc_ends] = 0.0
    penalty[0] = penalty[n] = 0.0
    at = np.flatnonzero(penalty >= 0)
    step = min(STEP, size)
    starts = np.repeat(at[:-1], np.diff(at))  # of each position's sentence
    inside = np.flatnonzero((np.arange(n) - starts) % step == 0)
    penalty[inside] = np.where(penalty[inside] < 0, HARD_CUT, penalty[inside])
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


class Packer:
    """Takes documents in order and gives pieces; ``finish`` gives the rest."""

    def __init__(self, sentence_ends: np.ndarray, size: int, first: int):
        self.sentence_ends, self.size, self.sequence = sentence_ends, size, first
        self.docs: list[tuple[int, np.ndarray, int]] = []  # key, ids, ids of it that are packed
        self.held = 0
        self.out: list[tuple] = []

    def add(self, key: int, ids: np.ndarray) -> None:
        self.docs.append((key, ids, 0))
        self.held += len(ids)
        if self.held >= BLOCK * self.size:
            self.pack(last=False)

    def pack(self, last: bool) -> None:
        if not self.docs:
            return
        lengths = np.array([len(ids) - done for _, ids, done in self.docs])
        stream = np.concatenate([ids[done:] for _, ids, done in self.docs])
        at, penalties = candidates(stream, np.cumsum(lengths), self.sentence_ends, self.size)
        bounds = at[cuts(at, penalties, self.size, 0 if last else LEFT * self.size)].tolist()
        if last:
            rest = bounds[-1] - bounds[-2]
            for bit in reversed(range(rest.bit_length())):  # the last window by powers of two
                if rest >> bit & 1 and rest != 1 << bit:
                    bounds.insert(-1, bounds[-2] + (1 << bit))
                    rest -= 1 << bit
        self.emit(bounds)

    def emit(self, bounds: list[int]) -> None:
        d = 0
        for a, b in zip(bounds, bounds[1:], strict=False):
            left, offset = b - a, 0
            while left:
                key, ids, done = self.docs[d]
                take = min(left, len(ids) - done)
                self.out.append((key, done, take, zlib.crc32(ids[done : done + take].tobytes()), len(ids), self.sequence, offset))
                self.docs[d] = (key, ids, done + take)
                left, offset = left - take, offset + take
                d += done + take == len(ids)
            self.sequence += 1
        self.docs = self.docs[d:]
        self.held -= bounds[-1]

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, tokenizer: str | None = None, text: str = "text", key: str = "doc_id", size: int = SIZE, end: int = END) -> DataFrame:
    """One row for each piece of a document in a sequence."""
    path = tokenizer or tokenizer_path(TOKENIZER)
    rows = docs.select(F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("_text"))
    names = ["_key", *[c.split()[0] for c in DDL.split(", ")]]

    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        words = WordIds(path)
        ends = np.zeros(max(len(e := words.sentence_ends()), end + 1), bool)
        ends[: len(e)] = e
        last = np.array([end], "<u4")
        packer = Packer(ends, size, TaskContext.get().partitionId() << 40)

        kind = None

        def rows():
            found = packer.take()
            if not found:
                return None
            keys, *numbers = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *[pa.array(c, pa.int64()) for c in numbers]], names=names)

        for batch in batches:
            kind = batch.schema.field("_key").type
            for part in slices(batch, "_text"):
                ids = words.encode([t or "" for t in part.column("_text").to_pylist()])
                for k, data in zip(part.column("_key").to_pylist(), ids, strict=True):
                    packer.add(k, np.concatenate([np.frombuffer(data, "<u4"), last]))
                if (out := rows()) is not None:
                    yield out
        packer.pack(last=True)
        if (out := rows()) is not None:
            yield out

    return rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, {DDL}").withColumnRenamed("_key", key)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
