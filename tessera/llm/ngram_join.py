"""Similarity self-join of documents on word n-grams: all pairs of Jaccard similarity from a threshold, as components.

Each document is the set of its distinct n-grams, hashed to 64 bits; equal sets are one node, so copies cost nothing.
The join is size-aware. Sets are listed under their first n-grams in the order of hashes (their prefix): q of the n-grams
of a set stay behind, so two linked sets share at least the overlap that a link needs less the larger q. The prefix is a
little longer than a link needs, so linked sets share at least 1 + extra n-grams, and a set that shares less with all others
together is out. Of what it shares, each set keeps the rarest, so that any two linked sets still share 1 + extra/2 of them,
and the n-grams that most documents have are scanned by those only that have little else. Small sets leave the lists and
enumerate subsets of fixed sizes instead: two linked sets share their overlap as a subset, and a key is a subset's hash. The
boundary is the size up to which enumerating is cheaper than scanning, by the mean length of the lists that sets have kept.

Lists are scanned in rounds. Each node is held against neighbours in random orders of its lists, those first with which it
shares most; linked nodes are merged into components. At last all pairs of a list that are still in different components
are compared: in short lists one by one, in long ones in blocks, where one of a pair is an outsider to the list's largest
component. Before that, nodes of long lists whose whole sets share less with all other components together than a link needs
are out, and the others are held against the hub of each of their lists. So a group of near copies costs little more than its
size, a common passage costs the sizes of its documents, no pair within a component needs a comparison, and no link between
components is lost. Sets travel once to each pair of blocks of nodes, not to each pair of nodes.

No task holds a whole list or a group of copies: counts are combined before shuffles, joins on keys are split by adaptive
execution, long lists are dealt out by salts or blocks. Nothing of the documents passes the driver but the bits of a filter
of at most MAX_BITS. Documents without words are linked with nothing; those with fewer words than n are one n-gram. Null
texts have no words. Texts of any length are read whole. Keys may be of any ordered type; rows of a null key come back with
a null component and link nothing. Repeated rows and ties are one node; empty tables give no rows. Only key, n_shingles and
component_id are returned; ``deduplicate`` keeps all columns, whatever their names. Every stage is written to the shared
folder. Two different sets are taken for equal with a chance of one in 2**64 a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._shared import ARROW_ROWS, BLOCK_BITS, LOWER_TABLE, Stages, bits_for, broadcast_blocks, filter_of, is_set, join_back, map_rows, mark, quoted, space_words, table, unused, with_plain_names

SHINGLE, PERCENT = 4, 85
#: n-grams listed beyond the prefix that a link needs, in hundredths of the size.
EXTRA_PERCENT = 4
#: Parts of the keys that are shuffled one after the other when all prefixes are listed.
KEY_PARTS = 4
#: Times that sets which share too little are taken out of the lists.
PRUNINGS = 2
#: Rounds over random orders, the neighbours that a node is held against in each list, and the best of them that are compared.
ROUNDS, LAGS, PARTNERS = 2, 2, 2
#: Rows of a list that are put into one order; longer lists are dealt out by hash.
LIST_ROWS = 1000
#: Nodes that have a key from which it can be their home; chance keys have fewer.
HOME_FROM = 8
#: Lists of more nodes are not enumerated by pairs but compared in blocks.
LONG_LIST = 64
#: Ranges of hashes, in quarters of all, by which sets of long lists are pruned one after the other; prefixes come from the first.
QUARTERS = ((3, 4), (2, 3), (0, 2))
#: An n-gram of several sets: the least and the largest component, whether an outsider has it, and how many sets do.
_HELD = np.dtype([("gram", "<i8"), ("x", "<i8"), ("y", "<i8"), ("outside", "?"), ("n", "<i4")])
#: Bytes of n-grams of a block of nodes; two blocks meet in a task.
BLOCK_BYTES = 3_000_000
#: Components of up to so many links are found in one task, of more by stars.
ONE_TASK_LINKS = 500_000
#: Partners from which a set is counted against an index of the others rather than pair by pair.
INDEX_FROM = 16
_WORDS_KEPT = 100_000

_U = np.uint64
_MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Distinct n-gram hashes of texts, ascending; word hashes are kept in a bounded memo."""

    def __init__(self, n: int = SHINGLE):
        self.n, self.memo = n, _WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = space_words((text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE))
        if not words:
            return np.empty(0, _U)
        if len(self.memo) > _WORDS_KEPT:
            self.memo.clear()
        h = np.fromiter(map(self.memo.__getitem__, words), _U, len(words))
        k = min(self.n, len(h))
        total = np.full(len(h) - k + 1, k, _U)
        for i in range(k):
            m = _MULTIPLIERS[i % len(_MULTIPLIERS)] + 2 * (i // len(_MULTIPLIERS))
            total += h[i : len(h) - k + 1 + i] * _U(m)
        total = np.sort(mix(total))
        return total[np.concatenate([[True], total[1:] != total[:-1]])]


def node_of(s: np.ndarray) -> int:
    """The set's own hash, as a signed number."""
    return int(mix(np.array([mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) + _U(len(s))], _U)).view(np.int64)[0])


def least(n, percent: int = PERCENT):
    """n-grams of overlap that a set of n needs with any partner."""
    return -(-percent * n // 100)


def extra(n: int, percent: int = PERCENT) -> int:
    """n-grams that are listed beyond the prefix; never falls with n."""
    return min(n * EXTRA_PERCENT // 100, least(n, percent) - 1)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """All but least - 1 - extra n-grams: so linked sets share 1 + extra of them at least."""
    return n - least(n, percent) + 1 + extra(n, percent)


def _extra(size: Column, percent: int) -> Column:
    size = size.cast("long")
    return F.least(F.floor(size * EXTRA_PERCENT / 100), F.floor((size * percent + 99) / 100) - 1).cast("int")


def _fits(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b).cast("long") * 100 >= F.greatest(a, b).cast("long") * percent


def subset_count(n: int, percent: int = PERCENT) -> int:
    return sum(math.comb(n, k) for k in range(least(n, percent), n + 1))


def boundary(mean_list: float, percent: int = PERCENT) -> int:
    """The size up to which enumerating subsets is no dearer than scanning a prefix's lists."""
    b = 0
    while subset_count(b + 1, percent) <= max(1.0, prefix_length(b + 1, percent) * mean_list):
        b += 1
    return b


def subsets(s: np.ndarray, percent: int = PERCENT) -> Iterator[np.ndarray]:
    """Hashes of the subsets of least(n) to n n-grams, in parts of bounded size."""
    parts = mix(s ^ _U(0x2545F4914F6CDD1D))
    total, step = parts.sum(dtype=_U), 50_000
    for left_out in range(len(s) - least(len(s), percent) + 1):
        found, size = combinations(range(len(s)), left_out), _U(len(s) - left_out)
        while chosen := list(islice(found, step)):
            sums = parts[np.array(chosen, np.int64)].sum(axis=1, dtype=_U) if left_out else np.zeros(1, _U)
            yield mix((total - sums + size) * _U(0x9E3779B97F4A7C15))


def _lists(parts: list[np.ndarray | None]) -> pa.Array:
    """A list column of signed numbers; None is null."""
    counts = [0 if p is None else len(p) for p in parts]
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.int32())
    values = pa.array(np.concatenate([np.empty(0, _U), *[p for p in parts if p is not None]]).view(np.int64), pa.int64())
    mask = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(offsets, values, mask=mask) if parts else pa.array([], pa.list_(pa.int64()))


def _first_pass(n: int, percent: int, whole_to: int):
    """Of each row: size and node; and, where the task has not just given them, the node's prefix, and its whole set if small."""

    def make():
        shingler, seen = Shingler(n), set()

        def run(batch: pa.RecordBatch) -> dict:
            sizes, nodes, prefixes, wholes = [], [], [], []
            known = batch.column("_key").is_valid().to_pylist()
            for text, keyed in zip(batch.column("_text").to_pylist(), known, strict=True):
                s = shingler(text)
                node = node_of(s) if len(s) else None
                sizes.append(len(s))
                nodes.append(node)
                new = keyed and node is not None and node not in seen
                if new:
                    if len(seen) >= _WORDS_KEPT:
                        seen.clear()
                    seen.add(node)
                prefixes.append(s[: prefix_length(len(s), percent)] if new else None)
                wholes.append(s if new and len(s) <= whole_to else None)
            return {"_key": batch.column("_key"), "n_shingles": sizes, "node": nodes, "prefix": _lists(prefixes), "whole": _lists(wholes)}

        return run

    return make


def _shared_keys(postings: DataFrame, stages: Stages, percent: int, name: str, parts: int = 1) -> DataFrame:
    """node, size and ks: (n, key) of the keys that other nodes have too, rarest first, of nodes that share enough.

    postings: node, size, key, perhaps repeated. n orders keys; repeated postings may raise it. Keys are shuffled in so many
    parts, one after the other, so that the disk holds the shuffles of one part only.
    """
    found = None
    for part in range(parts):
        mine = postings.filter(F.pmod("key", F.lit(parts)) == part) if parts > 1 else postings
        counts = mine.groupBy("key").agg(F.count("*").cast("int").alias("n"), F.min("node").alias("x"), F.max("node").alias("y"))
        counts = stages.write(counts.filter("x <> y").select("key", "n"), "shared")
        stages.free()
        hits = mine.join(counts, "key").select("node", "size", "n", "key")
        if parts > 1:
            hits = stages.write(hits, "hits")
            stages.free()
        found = hits if found is None else found.union(hits)
    found = found.groupBy("node").agg(F.max("size").alias("size"), F.sort_array(F.collect_set(F.struct("n", "key"))).alias("ks"))
    found = stages.write(found.filter(F.size("ks") > _extra(F.col("size"), percent)), name)
    stages.drop("shared", "hits")
    return found


def _kept(arrays: DataFrame, percent: int) -> DataFrame:
    """node, size, f, n, key: of each node its rarest keys, so that linked nodes share 1 + f of them."""
    e = _extra(F.col("size"), percent)
    f = F.floor(e / 2).cast("int")
    ks = F.slice("ks", 1, F.size("ks") - e + f)
    return arrays.select("node", "size", f.alias("f"), F.explode(ks).alias("k")).select("node", "size", "f", "k.n", "k.key")


def _subset_keys(percent: int):
    def make():
        def run(batch: pa.RecordBatch) -> dict | None:
            keys, nodes, sizes = [], [], []
            for node, size, whole in zip(*(batch.column(c).to_pylist() for c in ("node", "size", "whole")), strict=True):
                for part in subsets(np.array(whole, np.int64).view(_U), percent):
                    keys.append(part)
                    nodes.append(np.full(len(part), node, np.int64))
                    sizes.append(np.full(len(part), size, np.int32))
            return {"node": pa.array(np.concatenate(nodes)), "size": pa.array(np.concatenate(sizes)), "key": pa.array(np.concatenate(keys).view(np.int64))} if keys else None

        return run

    return make


def _with_subsets(lists: DataFrame, arrays: DataFrame, wholes: DataFrame, small: int, stages: Stages, percent: int) -> DataFrame:
    """lists, but sets up to the boundary stand under their subsets, and sets that may be linked with such under both."""
    to = small * 100 // percent
    few = wholes.join(arrays.filter(F.col("size") <= to).select("node", "size"), "node").dropDuplicates(["node"])
    found = map_rows(few.select("node", "size", "whole"), _subset_keys(percent), "node long, size int, key long")
    found = stages.write(found, "subsets")
    counts = found.groupBy("key").agg(F.count("*").cast("int").alias("n")).filter("n > 1")
    found = found.join(counts, "key").select("node", "size", F.lit(0).alias("f"), "n", "key")
    return lists.filter(F.col("size") > small).withColumn("f", F.when(F.col("size") <= to, 0).otherwise(F.col("f"))).unionByName(found)


def _neighbours(lists: DataFrame, seed: int, percent: int) -> DataFrame:
    """Pairs of neighbours in a random order of each list, in different components; of each node the best by shared keys."""
    place = F.xxhash64("node", F.lit(seed))
    dealt = lists.select("key", "node", "size", "comp", place.alias("at"), F.pmod(F.col("at"), F.ceil(F.col("n") / LIST_ROWS)).alias("salt"))
    order = Window.partitionBy("key", "salt").orderBy("at")
    other = F.struct("node", "size", "comp")
    near = dealt.select("node", "size", "comp", F.array(*[F.lead(other, k).over(order) for k in range(1, LAGS + 1)]).alias("os"))
    near = near.select("node", "size", "comp", F.explode("os").alias("o"))
    near = near.filter((F.col("comp") != F.col("o.comp")) & _fits(F.col("size"), F.col("o.size"), percent))
    pairs = near.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    ends = pairs.select("a", "b", "n", F.explode(F.array("a", "b")).alias("end"))
    best = Window.partitionBy("end").orderBy(F.desc("n"), F.xxhash64("a", "b"))
    return ends.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= PARTNERS).select("a", "b").distinct()


def _places(arrays: DataFrame, stages: Stages) -> DataFrame:
    """node and block: nodes of the same least key (of those that several have) stand together, in blocks of about BLOCK_BYTES.

    Keys are hashes, so similar sets mostly have the same least one.
    """
    least_of = lambda ks: F.array_min(F.transform(ks, lambda k: k["key"]))
    home = F.coalesce(least_of(F.filter("ks", lambda k: k["n"] >= HOME_FROM)), least_of(F.col("ks")))
    own = stages.write(arrays.select("node", "size", home.alias("home")), "homes")
    total = own.groupBy("home").agg(F.count("*").alias("rows"), F.sum(F.col("size").cast("long") * 8).alias("bytes"))
    placed = join_back(own, stages.keyed(total, "totals", "home", "rows"), "home", "rows", "bytes")
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("bytes") / BLOCK_BYTES))
    return stages.write(placed.select("node", F.xxhash64("home", chunk).alias("block")), "places")


class Overlaps:
    """Counts the n-grams that sets share with indexed ones: frequent ones by products of matrices, the others by lists.

    An n-gram is frequent where an eighth of the indexed sets have it, so the matrix takes at most eight times their n-grams.
    """

    def __init__(self, sets: list[np.ndarray]):
        values, self.n = np.concatenate([np.empty(0, _U), *sets]), len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owners = np.repeat(np.arange(self.n), self.sizes)
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        grams, place, counts = np.unique(values, return_inverse=True, return_counts=True)
        often = counts > max(8, self.n // 8)
        self.frequent, self.column = grams[often], np.cumsum(often) - 1
        at = often[place]
        self.matrix = np.zeros((len(self.frequent), self.n), np.float32)
        self.matrix[self.column[place[at]], owners[at]] = 1
        self.values, self.owners = values[~at], owners[~at]

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, indexed sets): n-grams in common."""
        grams = np.concatenate([np.empty(0, _U), *sets])
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        lo, hi = np.searchsorted(self.values, grams, "left"), np.searchsorted(self.values, grams, "right")
        counts = hi - lo
        at = np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        out = np.bincount(np.repeat(rows, counts) * self.n + self.owners[at], minlength=len(sets) * self.n).reshape(len(sets), self.n)
        if len(self.frequent):
            place = np.minimum(np.searchsorted(self.frequent, grams), len(self.frequent) - 1)
            hit = self.frequent[place] == grams
            dense = np.zeros((len(sets), len(self.frequent)), np.float32)
            dense[rows[hit], place[hit]] = 1
            out += (dense @ self.matrix).astype(np.int64)
        return out

    def linked(self, sets: list[np.ndarray], percent: int) -> np.ndarray:
        shared = self.of(sets)
        own = np.array([len(s) for s in sets], np.int64)
        return 100 * shared >= percent * (own[:, None] + self.sizes - shared)


def parts_of(sets: list[np.ndarray], n: int = 200_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of sets with about so many n-grams in all."""
    at, held = 0, 0
    for k, s in enumerate(sets):
        held += len(s)
        if held >= n:
            yield at, k + 1
            at, held = k + 1, 0
    if at < len(sets):
        yield at, len(sets)


def _similar(sets: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray, percent: int, index: list) -> np.ndarray:
    """Which pairs are linked. a is ascending; index: keeps the index of all sets once it is made."""
    out = np.zeros(len(a), bool)
    starts = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a))
    for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        s = sets[int(a[x])]
        if y - x >= INDEX_FROM:
            if not index:
                names = np.array(sorted(sets), np.int64)
                index += [names, Overlaps([sets[k] for k in names.tolist()])]
            out[x:y] = index[1].linked([s], percent)[0][np.searchsorted(index[0], b[x:y])]
        else:
            for k in range(x, y):
                both = np.sort(np.concatenate([s, sets[int(b[k])]]))
                shared = int((both[1:] == both[:-1]).sum())
                out[k] = 100 * shared >= percent * (len(both) - shared)
    return out


def _by_group(batches, names: tuple[str, ...], group: str):
    """(new, columns): pieces of rows of one group each, as rows are sorted by it; new: whether a group begins."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(group).to_numpy(zero_copy_only=False)
        starts = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
        for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            part = batch.slice(x, y - x)
            yield g[x] != last if last is not None else True, [part.column(n) for n in names]
            last = g[x]


def _links(pairs: DataFrame, sets: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar enough. A set goes once to each pair of blocks that has a pair of its node."""
    x, y = places.select(F.col("node").alias("a"), F.col("block").alias("x")), places.select(F.col("node").alias("b"), F.col("block").alias("y"))
    met = pairs.select("a", "b").join(x, "a").join(y, "b").select(F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("met"), "a", "b")
    asked = met.select("met", F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = asked.join(sets, "node").select("met", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), "grams")
    rows = rows.union(met.select("met", F.lit(1), "a", "b", F.lit(None).cast("binary")))

    def run(batches):
        held: dict[int, np.ndarray] = {}
        index: list = []
        for new, (kind, a, b, grams) in _by_group(batches, ("kind", "a", "b", "grams"), "met"):
            if new:
                held, index = {}, []
            kind, a, b = (c.to_numpy(zero_copy_only=False) for c in (kind, a, b))
            n = int((kind == 0).sum())
            held.update((k, np.frombuffer(g.as_py(), _U)) for k, g in zip(a[:n].tolist(), grams[:n], strict=True))
            if n < len(a):
                ok = _similar(held, a[n:], b[n:], percent, index)
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[n:][ok]), pa.array(b[n:][ok])], names=["a", "b"])

    return rows.repartition("met").sortWithinPartitions("met", "kind", "a").mapInArrow(run, "a long, b long")


def _between(links: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs of different components that links join."""
    found = links.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    return found.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b").distinct()


def _short_pairs(lists: DataFrame, far: DataFrame, percent: int) -> DataFrame:
    """Pairs of short lists that are in different components and share enough keys.

    A pair that also shares a long list has an outsider among two far nodes. Its keys here are not all, so any one is enough.
    """
    flagged = lists.join(far.select("node", "outside"), "node", "left").select("key", F.struct("node", "size", "comp", "f", F.col("outside").isNotNull().alias("far"), F.coalesce("outside", F.lit(False)).alias("outside")).alias("v"))
    held = flagged.groupBy("key").agg(F.collect_list("v").alias("vs"))
    ones = held.select("vs", F.explode("vs").alias("v"))
    both = ones.select("v", F.explode(F.filter("vs", lambda w: (w["node"] > F.col("v.node")) & (w["comp"] != F.col("v.comp")) & _fits(w["size"], F.col("v.size"), percent))).alias("w"))
    any_one = F.col("v.far") & F.col("w.far") & (F.col("v.outside") | F.col("w.outside"))
    least_n = F.when(any_one, 1).otherwise(1 + F.least("v.f", "w.f"))
    pairs = both.select(F.col("v.node").alias("a"), F.col("w.node").alias("b"), least_n.alias("least")).groupBy("a", "b").agg(F.count("*").alias("n"), F.max("least").alias("least"))
    return pairs.filter("n >= least").select("a", "b")


def _merged_grams(held: np.ndarray) -> np.ndarray:
    """One entry of each n-gram: the least and the largest component, whether an outsider has it, and the sets that do."""
    held = held[np.argsort(held["gram"], kind="stable")]
    starts = np.flatnonzero(np.append(True, held["gram"][1:] != held["gram"][:-1])) if len(held) else np.empty(0, np.int64)
    out = held[starts]
    for name, of in (("x", np.minimum), ("y", np.maximum), ("outside", np.maximum), ("n", np.add)):
        out[name] = of.reduceat(held[name], starts) if len(held) else held[name]
    return out


def _in_range(grams: bytes, lo: int, hi: int) -> np.ndarray:
    """The set's n-grams in these of the QUARTERS of all hashes; sets are ascending."""
    s = np.frombuffer(grams, _U)
    at, to = np.searchsorted(s, _U(lo << 62)), len(s) if hi == 4 else np.searchsorted(s, _U(hi << 62))
    return s[at:to].view(np.int64)


def _grams_of(lo: int, hi: int, bits: int):
    """The n-grams of a slice of sets, one entry each, by the block of the bitmap that they stand in."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            grams = [_in_range(g, lo, hi) for g in batch.column("grams").to_pylist()]
            each = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            held = np.empty(len(each), _HELD)
            held["gram"], held["n"] = np.concatenate(grams), 1
            held["x"] = held["y"] = batch.column("comp").to_numpy(zero_copy_only=False)[each]
            held["outside"] = batch.column("outside").to_numpy(zero_copy_only=False)[each]
            held = _merged_grams(held)
            block = (held["gram"] & np.int64(bits - 1)) >> BLOCK_BITS
            order = np.argsort(block, kind="stable")
            held, block = held[order], block[order]
            starts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else np.zeros(1, np.int64)
            parts = [held[x:y].tobytes() for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            return {"block": pa.array(block[starts[:-1]], pa.int64()), "held": pa.array(parts, pa.binary())}

        return run

    return make


def _marks(far: DataFrame, lo: int, hi: int, n: int, often: bool):
    """Broadcast bitmaps of the n-grams that two components and an outsider have and, if asked, of those of many sets; bits.

    far holds about n n-grams of the range. A task sends one row to each block of the bitmap, so their number grows with the
    n-grams by tasks and blocks, not one by one. A block holds about as many n-grams whatever n is, up to MAX_BITS.
    """
    bits = bits_for(n)

    def run(batches):
        def marked(held: list[bytes], block: int):
            found = _merged_grams(np.frombuffer(b"".join(held), _HELD))
            at = found["gram"] & np.int64((1 << BLOCK_BITS) - 1)
            shared = mark(None, at[(found["x"] != found["y"]) & found["outside"]]).tobytes()
            many = mark(None, at[found["n"] >= HOME_FROM]).tobytes() if often else None
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shared], pa.binary()), pa.array([many], pa.binary())], names=["block", "shared", "many"])

        held, block = [], 0
        for new, (blocks, parts) in _by_group(batches, ("block", "held"), "block"):
            if new and held:
                yield marked(held, block)
                held = []
            block = blocks[0].as_py()
            held += parts.to_pylist()
        if held:
            yield marked(held, block)

    sent = map_rows(far.select("comp", "outside", "grams"), _grams_of(lo, hi, bits), "block long, held binary", sized="grams", rows=ARROW_ROWS)
    rows = sent.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, shared binary, many binary")
    return broadcast_blocks(rows, bits, *["shared", "many"][: 1 + often]), bits


def _marked(marks, scored: bool, lo: int, hi: int, bits: int, names: list[str], percent: int):
    """The rows that lack no more n-grams than a link allows. missing, score: with what this range adds to them."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            sets = batch.column("grams").to_pylist()
            sizes, grams = np.array([len(g) // 8 for g in sets], np.int64), [_in_range(g, lo, hi) & np.int64(bits - 1) for g in sets]
            own = np.array([len(g) for g in grams], np.int64)
            found = [np.array([is_set(m, g).sum() for g in grams], np.int64) for m in (marks.value if scored else [marks.value])]
            missing = batch.column("missing").to_numpy(zero_copy_only=False) + own - found[0]
            score = batch.column("score").to_numpy(zero_copy_only=False) + 2 * found[-1] - own
            asked = pa.array(missing <= sizes - least(sizes, percent))
            return {n: batch.column(n).filter(asked) for n in names} | {"missing": pa.array(missing).filter(asked), "score": pa.array(score).filter(asked)}

        return run

    return make


def _possible(far: DataFrame, stages: Stages, percent: int, scored: bool = False) -> tuple[DataFrame, int]:
    """The far nodes whose whole sets may share what a link needs with other components, and their number.

    far: node, comp, outside, block, grams. A link has an outsider at one end, so each n-gram that it shares is held by two
    components and an outsider. Both ends have least(size) of them; a filter of bounded size says which are held so, which may
    keep some nodes too many. The n-grams are counted by ranges of their hashes, and a node is out as soon as it lacks more
    than a link allows, so most sets of a common passage are held by a part of their n-grams only. scored, score: n-grams that
    many of the nodes have less the others, most in an original of near copies.
    """
    names = ["node", "comp", "outside", "block", "grams"]
    total = F.coalesce(F.sum(F.length("grams") / 8), F.lit(0.0))
    zero = F.lit(0).cast("long")
    far, size = stages.measured(far.select(*names, zero.alias("missing"), zero.alias("score")), "far", grams=total)
    ddl = ", ".join(f"{n} {far.schema[n].dataType.simpleString()}" for n in far.columns)
    for lo, hi in QUARTERS:
        if not size["n"]:
            break
        # an n-gram that counts is held twice
        marks, bits = _marks(far, lo, hi, int(size["grams"]) * (hi - lo) // 8, scored)
        far, size = stages.measured(map_rows(far, _marked(marks, scored, lo, hi, bits, names, percent), ddl, sized="grams"), "far", grams=total)
        marks.destroy()
    return far, size["n"]


def _hub_links(rows: DataFrame, far: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """Links of nodes to the hubs of their long lists, the nodes of the best score; of each node those it has most lists with.

    Near copies of an original that are linked to it alone do not find it by chance.
    """
    rows = rows.select("key", "node").join(far.select("node", "comp", "score"), "node")
    hubs = rows.groupBy("key").agg(F.max_by(F.struct("node", "comp"), F.struct("score", "node")).alias("hub"))
    met = rows.join(hubs, "key").filter("comp <> hub.comp").groupBy("node", F.col("hub.node").alias("hub")).agg(F.count("*").alias("n"))
    best = Window.partitionBy("node").orderBy(F.desc("n"), "hub")
    pairs = met.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= PARTNERS)
    return _links(pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), far.select("node", "grams"), places, percent)


def _long_links(rows: DataFrame, far: DataFrame, percent: int) -> DataFrame:
    """Pairs of components that are linked by an outsider and another node of a long list. rows: key, node, block, outside."""
    per = rows.join(far.select("node"), "node", "left_semi").groupBy("key", "block").agg(F.max("outside").alias("o"))
    met = per.alias("x").join(per.alias("y"), "key").filter("x.block <= y.block AND (x.o OR y.o)").select(F.col("x.block").alias("x"), F.col("y.block").alias("y")).distinct()
    met = met.select(F.xxhash64("x", "y").alias("met"), F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    held = far.select("block", "comp", "outside", "grams")
    sent = met.join(held, "block").repartition("met").sortWithinPartitions("met", "block")

    def compare(comps: list[int], outside: list[bool], blocks: list[int], sets: list[np.ndarray]) -> set[tuple[int, int]]:
        names, where = np.array(comps, np.int64), np.array(blocks, np.int64)
        out = np.flatnonzero(np.array(outside, bool))
        pairs: set[tuple[int, int]] = set()
        if not len(out):
            return pairs
        index, two = Overlaps([sets[k] for k in out.tolist()]), blocks[0] != blocks[-1]
        for x, y in parts_of(sets):
            ok = index.linked(sets[x:y], percent) & (names[x:y, None] != names[out])
            if two:  # pairs within a block meet in a task of its own
                ok &= where[x:y, None] != where[out]
            i, j = np.nonzero(ok)
            found = np.unique(np.sort(np.stack([names[x + i], names[out[j]]], 1), axis=1), axis=0)
            pairs.update(map(tuple, found.tolist()))
        return pairs

    def run(batches):
        held: tuple[list, list, list, list] = ([], [], [], [])

        def finish():
            found = compare(*held) if held[0] else set()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for new, columns in _by_group(batches, ("comp", "outside", "block", "grams"), "met"):
            if new:
                yield finish()
                held = ([], [], [], [])
            for into, c in zip(held, columns, strict=True):
                into += c.to_pylist() if into is not held[3] else [np.frombuffer(g, _U) for g in c.to_pylist()]
        yield finish()

    return sent.mapInArrow(run, "a long, b long").distinct()


def _main(rows: DataFrame) -> DataFrame:
    """key, n, comps and main (the largest component) of each list."""
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key")
    return per.agg(F.sum("n").alias("n"), F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("main"))


def _far(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.max("outside").alias("outside"), F.first("comp").alias("comp"), F.first("block").alias("block"))


def _last_links(lists: DataFrame, sets: DataFrame, places: DataFrame, comp: DataFrame, stages: Stages, percent: int) -> DataFrame:
    """Pairs of components that any link joins. lists: key, node, size, f, comp of the lists with several components."""
    long = stages.write(_main(lists).filter(F.col("n") > LONG_LIST).select("key", "main"), "long")
    rows = lists.join(long, "key").join(places, "node").select("key", "node", "comp", "block", (F.col("comp") != F.col("main")).alias("outside"))
    rows = stages.write(rows, "rows")
    far, n = _possible(_far(rows).join(sets, "node"), stages, percent, scored=True)
    pairs = stages.write(_short_pairs(lists.join(long, "key", "left_anti"), far, percent), "pairs")
    found = _between(_links(pairs, sets, places, percent), comp)
    if n:
        hubs = stages.write(_between(_hub_links(rows, far, places, percent), comp), "hubs")
        merged = components(hubs, stages).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        own = far.select("node", "comp", "block").join(merged, "comp", "left").select("node", "block", F.coalesce("to", "comp").alias("comp"))
        rows = rows.select("key", "node").join(own, "node")
        rows = rows.join(_main(rows).filter("comps > 1").select("key", "main"), "key").withColumn("outside", F.col("comp") != F.col("main"))
        rows = stages.write(rows.select("key", "node", "comp", "block", "outside"), "rows")
        far, n = _possible(_far(rows).join(far.select("node", "grams"), "node"), stages, percent)
        found = found.union(hubs)
    if n:
        found = found.union(_long_links(rows, far, percent))
    return stages.write(found.distinct(), "links")


def _merged(batches):
    """node and comp of a bounded number of edges: least labels go along the edges and up until nothing changes."""
    found = [(b.column("u").to_numpy(zero_copy_only=False), b.column("v").to_numpy(zero_copy_only=False)) for b in batches]
    u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, label = place[: len(u)], place[len(u) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "comp"])


def components(edges: DataFrame, stages: Stages, a: str = "a", b: str = "b") -> DataFrame:
    """node and comp (its component's least node) of every node of the edges, by alternating large and small stars.

    A star's centre may have any number of edges: its least neighbour is found by partial sums and joined back to them.
    """
    edges, size = stages.measured(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "stars")
    if size["n"] <= ONE_TASK_LINKS:
        return edges.coalesce(1).mapInArrow(_merged, "node long, comp long")
    less, more = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("k"), ((less > 1) | (less == 1) & (more > 0)).alias("inner"))
        near, size = stages.measured(near, "near", chars=F.lit(20) * F.count(F.lit(1)), rows=F.coalesce(F.sum("k"), F.lit(0)), inner=F.count_if("inner"))
        if not size["inner"]:  # every node has one least neighbour, which has no lesser one itself: stars
            break
        large = join_back(both, (near, size), "u", "k", "m").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stages.write(large, "stars")
        near = stages.keyed(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")), "near", "u", "k")
        small = join_back(large, near, "u", "k", "m").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = stages.write(small.filter("u <> v").distinct(), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _needed_sets(n: int, bits):
    def make():
        shingler = Shingler(n)

        def run(batch: pa.RecordBatch) -> dict | None:
            asked = is_set(bits.value, batch.column("_bit").to_numpy(zero_copy_only=False))
            sets = [s for t in batch.column("_text").filter(pa.array(asked)).to_pylist() if len(s := shingler(t))]
            return {"node": [node_of(s) for s in sets], "grams": [s.tobytes() for s in sets]} if sets else None

        return run

    return make


def ngram_join(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = SHINGLE, percent: int = PERCENT, small: int | None = None) -> DataFrame:
    """key, n_shingles and component_id (the least key of the component) of every row. small: the boundary, else by cost."""
    stages = Stages(docs.sparkSession, "ngram")
    rows = docs.select(F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    # longer lists are not scanned by each node, so no mean is above LONG_LIST; sets that could be worth enumerating are kept whole
    largest = boundary(float(LONG_LIST), percent) if small is None else small
    first = map_rows(rows, _first_pass(n, percent, largest * 100 // percent), f"_key {kind}, n_shingles long, node long, prefix array<long>, whole array<long>", sized="_text")
    first = stages.write(first, "first")
    headers = first.select("_key", "n_shingles", "node")
    nodes = headers.filter("node IS NOT NULL AND _key IS NOT NULL").groupBy("node").agg(F.min("_key").alias("rep"), F.count("*").alias("rows"))
    nodes = stages.write(nodes, "nodes")

    postings = first.filter("prefix IS NOT NULL").select("node", F.col("n_shingles").cast("int").alias("size"), F.explode("prefix").alias("key"))
    arrays = _shared_keys(postings, stages, percent, "arrays0", KEY_PARTS)
    for k in range(1, PRUNINGS):
        stages.free()
        arrays = _shared_keys(arrays.select("node", "size", F.explode("ks.key").alias("key")), stages, percent, f"arrays{k}")
        stages.drop(f"arrays{k - 1}")
    lists = _kept(arrays, percent)
    if small is None:
        small = boundary(lists.agg(F.coalesce(F.avg(F.least("n", F.lit(LONG_LIST))), F.lit(1.0))).first()[0], percent)
    if small:
        wholes = first.filter("whole IS NOT NULL").select("node", "whole")
        lists = _with_subsets(lists, arrays, wholes, small, stages, percent)
    lists = stages.write(lists, "lists")
    headers = stages.write(headers, "headers")
    stages.drop("first")
    places = _places(arrays, stages)
    stages.free()

    needed, size = stages.measured(arrays.select("node").join(nodes, "node").select("rep"), "needed")
    bits, size = filter_of(needed, "rep", size["n"])
    # rows that the filter lets through by chance give sets that no pair asks for, or a second copy of one
    asked = rows.filter("_key IS NOT NULL").select("_text", F.pmod(F.xxhash64("_key"), F.lit(size)).alias("_bit"))
    sets = stages.write(map_rows(asked, _needed_sets(n, bits), "node long, grams binary", sized="_text"), "copies")
    sets = stages.write(sets.join(arrays.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    bits.destroy()
    stages.drop("copies", "arrays*", "homes", "totals", "subsets")

    comp = docs.sparkSession.createDataFrame([], "node long, comp long")
    for turn in range(ROUNDS + 1):
        stages.free()
        open_lists = lists.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        several = open_lists.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
        open_lists, left = stages.measured(open_lists.join(several, "key", "left_semi"), f"open{turn}")
        if not left["n"]:
            break
        if turn == ROUNDS:
            found = _last_links(open_lists, sets, places, comp, stages, percent)
        else:
            pairs = stages.write(_neighbours(open_lists, turn, percent), "pairs")
            found = stages.write(_between(_links(pairs, sets, places, percent), comp), "links")
        merged = components(found, stages).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        old = comp.join(merged, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        fresh = merged.join(comp, F.col("node") == merged["comp"], "left_anti").select(F.col("comp").alias("node"), F.col("to").alias("comp"))
        comp = stages.write(old.union(fresh), f"components{turn}")

    # nodes that are alone in every way keep their own key
    labels = nodes.join(comp, "node", "left").filter("comp IS NOT NULL OR rows > 1")
    own = stages.write(labels.withColumn("comp", F.coalesce("comp", "node")), "own")
    least_key = stages.keyed(own.groupBy("comp").agg(F.count("*").alias("k"), F.min("rep").alias("component_id")), "least", "comp", "k")
    labels = stages.keyed(join_back(own, least_key, "comp", "k", "component_id").select("node", "rows", "component_id"), "labels", "node", "rows")
    stages.drop("lists", "sets", "pairs", "links", "stars", "near", "components*", "open*", "long", "rows", "far", "hubs", "own", "least", "places", "nodes", "needed")
    stages.free()
    found = join_back(headers, labels, "node", "rows", "component_id")
    own_key = F.when(F.col("_key").isNotNull(), F.coalesce("component_id", "_key")).alias("component_id")
    return found.select(F.col("_key").alias(key), "n_shingles", own_key)


def deduplicate(docs: DataFrame, key: str = "doc_id", n: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """One document of each component (that of the least key), as it is, and all documents without words.

    Rows of one key are kept or go together.
    """
    found = ngram_join(docs, text=text, key=key, n=n, percent=percent)
    stages = Stages(docs.sparkSession, "duplicates")
    name, bit = unused(docs, "_gone", "_bit")
    gone, size = stages.measured(found.filter(F.col("component_id") != F.col(quoted(key))).select(F.col(quoted(key)).alias(name)).distinct(), "gone")
    bits, size = filter_of(gone, name, size["n"])

    def passed(inside: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                found = is_set(bits.value, batch.column(bit).to_numpy(zero_copy_only=False))
                yield batch.filter(pa.array(found == inside)).drop_columns([bit])

        plain, run_plain = with_plain_names(docs.withColumn(bit, F.pmod(F.xxhash64(F.col(quoted(key))), F.lit(size))), run)
        return plain.mapInArrow(run_plain, docs.schema)

    # most documents pass by the filter alone; only the rest are shuffled for the exact answer
    rest = passed(inside=True)
    return passed(inside=False).union(rest.join(gone, rest[quoted(key)] == gone[name], "left_anti"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
