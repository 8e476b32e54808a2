"""Benchmark decontamination by suffix arrays over the training words.

Training documents pass in shards of bounded size. A shard's words are numbered and all its suffixes are sorted into a
suffix array, to the depth of the longest test item. Every test suffix that begins a window (ten words, or a whole shorter
item) is binary-searched in it, word by word, until its interval is empty: the interval at the window's depth holds the
occurrences, the last one the longest verbatim matches. Lengths of the longest matches of all other places follow from
the common prefixes of neighbours in the array. Documents with occurrences can be removed.

The benchmark is read in blocks of bounded size. Each is a broadcast, and a task holds one at a time. Equal windows have
equal intervals, which are read once, however many items share them. Documents are neither shuffled nor collected. Null
texts and texts without words have no hits, items without words never occur. Texts of any length are read whole, in a shard
of their own if need be. Repeated documents are judged each, rows of one item_id count as one item; of several longest
matches of a document the first place, then the least item and place in it, is told. Empty tables give no rows or no hits.
``matches`` returns the key and columns of its own, ``remove`` all columns as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import alnum_words, ddl_of, map_rows, quoted, table

WINDOW = 10
#: Words of a block of the benchmark.
BLOCK_WORDS = 200_000
#: Documents of a shard, whose bytes are bounded too.
SHARD_ROWS = 1024


class Block:
    """Test items as one row of words, and the places in it where windows begin."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.names = [n for n, _ in items]
        self.words, starts, needs, owners, offsets, ends = [], [], [], [], [], []
        for k, (_, words) in enumerate(items):
            need = min(window, len(words))
            for o in range(len(words) - need + 1 if need else 0):
                starts.append(len(self.words) + o)
                needs.append(need)
                owners.append(k)
                offsets.append(o)
                ends.append(len(self.words) + len(words))
            self.words += words
        self.starts, self.needs, self.owners, self.offsets, self.ends = (np.array(x, np.int64) for x in (starts, needs, owners, offsets, ends))
        self.longest = max((len(w) for _, w in items), default=0)


class _Numbers(dict):
    """Numbers of words from 1, in the order of their first places."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


class SuffixArray:
    """The suffixes of a row of numbers, sorted by their first ``depth`` numbers; 0 stands behind each document."""

    def __init__(self, ids: np.ndarray, depth: int):
        n, base = len(ids), int(ids.max(initial=0)) + 1
        self.ids = np.concatenate([ids, np.zeros(depth + 1, ids.dtype)])
        first = 3 if base**3 < 1 << 62 else 2 if base**2 < 1 << 62 else 1
        key = self.ids[:n].astype(np.int64)
        for k in range(1, first):
            key = key * base + self.ids[k : n + k]
        order = np.argsort(key)
        new = np.append(True, (sorted_ := key[order])[1:] != sorted_[:-1])[:n]
        rank, h = np.empty(n + 1, np.int64), first
        slots = np.arange(n)
        rank[order], rank[n] = np.maximum.accumulate(np.where(new, slots, 0)), -1
        # suffixes of one rank are told apart by the ranks of what follows, twice as deep each time
        while h < depth:
            alone = new & np.append(new[1:], True)
            tied = np.flatnonzero(~alone & (self.ids[order] > 0))
            if not len(tied):
                break
            at = order[tied]
            key = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            begins = np.append(True, key[1:] != key[:-1])
            order[tied], new[tied] = at, begins
            rank[at] = np.maximum.accumulate(np.where(begins, tied, 0))
            h *= 2
        self.order = order

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray, right: bool) -> np.ndarray:
        """In each interval, the first suffix whose number at the depth is not below the word (right: is above it)."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            v = self.ids[self.order[np.minimum(mid, len(self.order) - 1)] + depth]
            below = open_ & ((v <= word) if right else (v < word))
            lo, hi = np.where(below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
        return lo

    def search(self, test: np.ndarray, starts: np.ndarray, ends: np.ndarray, needs: np.ndarray):
        """Of each test suffix: its interval at the needed depth, its last interval that is not empty, and the depth of that."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order), np.int64)
        at_need, depth = np.zeros((2, len(starts)), np.int64), np.zeros(len(starts), np.int64)
        live, d = np.arange(len(starts)), 0
        while len(live):
            live = live[starts[live] + d < ends[live]]
            word = test[starts[live] + d]
            live, word = live[word > 0], word[word > 0]
            a = self._bound(lo[live], hi[live], d, word, right=False)
            b = self._bound(a, hi[live], d, word, right=True)
            found = a < b
            live, a, b = live[found], a[found], b[found]
            lo[live], hi[live], d = a, b, d + 1
            depth[live] = d
            at_need[:, live] = np.where(needs[live] == d, [a, b], at_need[:, live])
        return at_need, np.stack([lo, hi]), depth

    def common(self, ranks: np.ndarray, most: int) -> np.ndarray:
        """Common prefixes of suffixes and those before them in the array, up to ``most``."""
        x, y = self.order[np.maximum(ranks - 1, 0)], self.order[ranks]
        out = np.zeros(len(ranks), np.int64)
        live = np.flatnonzero(ranks > 0)
        for d in range(most):
            v = self.ids[x[live] + d]
            live = live[(v > 0) & (v == self.ids[y[live] + d])]
            if not len(live):
                break
            out[live] = d + 1
        return out


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(interval, rank) of all ranks of intervals."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def longest(array: SuffixArray, last: np.ndarray, depth: np.ndarray, needs: np.ndarray, ranks: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Of each of the ranks (ascending): the longest match with any test suffix, and that suffix.

    A test suffix matches the ranks of its last interval in all its depth, and others by the least common prefix on the way.
    """
    seed = {}
    which, seeded = spread(*last)
    for r, t in zip(seeded.tolist(), which.tolist(), strict=True):
        if r not in seed or depth[t] > depth[seed[r]]:
            seed[r] = t
    shared, at = array.common(ranks, most).tolist(), ranks.tolist()
    best, whose = [0] * len(at), [-1] * len(at)
    for backwards in (False, True):
        carry, t, before = 0, -1, None
        for k in range(len(at) - 1, -1, -1) if backwards else range(len(at)):
            r = at[k]
            near = before is not None and abs(r - before) == 1
            carry = min(carry, shared[k + 1] if backwards else shared[k]) if near else 0
            if t >= 0 and carry < needs[t]:  # no window of that item
                carry = 0
            own = seed.get(r, -1)
            if own >= 0 and depth[own] >= carry:
                carry, t = int(depth[own]), own
            if carry > best[k]:
                best[k], whose[k] = carry, t
            before = r
    return best, whose


RESULT = "n_words long, n_hit long, items array<string>, longest_match long, match_start long, match_item string, match_item_start long"


def scan(texts: list[str | None], blocks: list[Callable[[], Block]], depth: int) -> dict[str, list]:
    """RESULT of each text. blocks: callables that give a Block, one at a time in memory; depth: the longest item's words."""
    words = [alnum_words(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    total = int((lengths + 1).sum())
    vocabulary, ids = _Numbers(), np.zeros(total, np.int64)
    for k, s in enumerate(starts.tolist()):
        ws, words[k] = words[k], None  # the numbers stand for the words from here on
        ids[s : s + len(ws)] = np.fromiter(map(vocabulary.__getitem__, ws), np.int64, len(ws))
    array = SuffixArray(ids, depth)
    edge, items, best = np.zeros(total + 1, np.int64), [set() for _ in texts], [(0, None, None, None)] * len(texts)
    for give in blocks:
        block = give()
        get = vocabulary.get
        test = np.array([get(w, 0) for w in block.words], np.int64)
        (lo, hi), last, deep = array.search(test, block.starts, block.ends, block.needs)
        found = np.flatnonzero(lo < hi)
        if not len(found):
            continue
        lo, hi, last, deep = lo[found], hi[found], last[:, found], deep[found]
        windows, own = np.unique(np.stack([lo, hi, block.needs[found]]), axis=1, return_inverse=True)
        own = own.reshape(-1)
        which, ranks = spread(windows[0], windows[1])
        place = array.order[ranks]
        np.add.at(edge, place, 1)
        np.add.at(edge, place + windows[2][which], -1)
        # items of a text: those of the distinct windows in it
        owners: list[set[str]] = [set() for _ in range(windows.shape[1])]
        for w, k in zip(own.tolist(), block.owners[found].tolist(), strict=True):
            owners[w].add(block.names[k])
        doc = np.searchsorted(starts, place, "right") - 1
        in_doc: dict[int, list[int]] = {}
        for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
            in_doc.setdefault(d, []).append(w)
        unions: dict[tuple[int, ...], set[str]] = {}
        for d, ws in in_doc.items():
            if (key := tuple(ws)) not in unions:
                unions[key] = set().union(*(owners[w] for w in ws))
            items[d] = items[d] | unions[key] if items[d] else unions[key]
        ranks = np.unique(ranks)
        length, whose = longest(array, last, deep, block.needs[found], ranks, depth)
        for r, n, t in zip(array.order[ranks].tolist(), length, whose, strict=True):
            d = int(np.searchsorted(starts, r, "right")) - 1
            k = int(found[t])
            new = (n, r - int(starts[d]), block.names[block.owners[k]], int(block.offsets[k]))
            if best[d][1] is None or (-new[0], *new[1:]) < (-best[d][0], *best[d][1:]):
                best[d] = new
    hit = np.cumsum(edge)[:-1] > 0
    n_hit = np.add.reduceat(hit, starts).tolist() if len(texts) else []
    return {
        "n_words": lengths.tolist(),
        "n_hit": [int(n) if w else 0 for n, w in zip(n_hit, lengths.tolist(), strict=True)],
        "items": [sorted(s) for s in items],
        "longest_match": [b[0] for b in best],
        "match_start": [b[1] for b in best],
        "match_item": [b[2] for b in best],
        "match_item_start": [b[3] for b in best],
    }


class Benchmark:
    """Blocks of test items as broadcasts; the driver and a task hold one block at a time."""

    def __init__(self, benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS):
        sc, held, size = benchmark.sparkSession.sparkContext, [], 0
        self.blocks, self.depth = [], 1

        def close():
            block = Block(held, window)
            self.depth = max(self.depth, block.longest)
            self.blocks.append(sc.broadcast(block))

        for row in benchmark.select(F.col(quoted(item)).cast("string"), F.col(quoted(text))).toLocalIterator():
            words = alnum_words(row[1])
            held.append((row[0] or "", words))
            size += len(words) + 1
            if size >= block_words:
                close()
                held, size = [], 0
        if held:
            close()

    def givers(self) -> list[Callable[[], Block]]:
        """In a task: functions that read a block, and forget the one before."""
        blocks, held = self.blocks, []

        def give(b) -> Block:
            for other in held:
                if other is not b:
                    other.__dict__.pop("_value", None)  # it is read again from the executor's disk
            held[:] = [b]
            return b.value

        return [lambda b=b: give(b) for b in blocks]


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and RESULT of each document: hit words, items, and the longest verbatim match with its places."""
    tests = Benchmark(benchmark)

    def make():
        givers = tests.givers()

        def run(batch: pa.RecordBatch) -> dict:
            return {"_key": batch.column("_key")} | scan(batch.column("_text").to_pylist(), givers, tests.depth)

        return run

    rows = docs.select(F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("_text"))
    return map_rows(rows, make, f"_key {rows.schema['_key'].dataType.simpleString()}, {RESULT}", sized="_text", rows=SHARD_ROWS).withColumnRenamed("_key", key)


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without a hit, as they are."""
    tests, name = Benchmark(benchmark), text

    def make():
        givers = tests.givers()

        def run(batch: pa.RecordBatch) -> dict | None:
            clean = [n == 0 for n in scan(batch.column(name).to_pylist(), givers, tests.depth)["n_hit"]]
            kept = batch.filter(pa.array(clean))
            return dict(zip(kept.schema.names, kept.columns, strict=True)) if kept.num_rows else None

        return run

    return map_rows(docs, make, ddl_of(docs), sized=text, rows=SHARD_ROWS)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest_match", "match_start", "match_item")
