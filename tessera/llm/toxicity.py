"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the mean of its character n-gram embeddings beside its own embedding (both hashed). The network reads
overlapping windows of words both ways, pools them by attention and gives a logit; a text's score is its highest
window's probability. All windows of whole texts are scored. Labels are of texts, so training picks windows: at first,
those with the words that most tell the classes apart, then those that the network itself scores highest.

Labels are learnt from a bounded sample (``TRAIN_ROWS`` of each class, texts of up to ``TRAIN_CHARS``), chosen by a hash
of the key; held-out rows are never in it. Null and empty texts have no window and get the score of an empty one. Without
labels of both classes every score is 0. Repeated rows and ties score alike; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._shared import alnum_words, map_rows, quoted, table

#: Labelled texts of each class that are learned from, in the order of their keys' hashes, and their characters in all.
TRAIN_ROWS, TRAIN_TOTAL = 1500, 20_000_000
WINDOW, STRIDE = 48, 32
HIDDEN, WIDTH, ROWS = 8, 12, 1 << 14
GRAMS = (3, 4, 5)
EPOCHS, BATCH, RATE = 9, 128, 0.01
_KEPT_WORDS, _CHUNK = 250_000, 2048
_P = np.uint64(0x9E3779B97F4A7C15)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram buckets of all words in a row, the words' starts in them, and each word's own bucket."""
    data = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(data))  # bytes to the word's end
    buckets, owners = [], []
    for g in GRAMS:
        h = np.full(max(0, len(data) - g + 1), g, np.uint64)
        for k in range(g):
            h = (h ^ data[k : len(data) - g + 1 + k]) * _P
            h ^= h >> np.uint64(29)
        ok = left[: len(h)] >= g
        buckets.append((h[ok] % np.uint64(ROWS)).astype(np.int64))
        owners.append(owner[: len(h)][ok])
    bucket, who = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    counts = np.bincount(who, minlength=len(words))
    whole = np.ones(len(words), np.uint64)
    weights = data * (np.arange(len(data)).astype(np.uint64) - np.repeat(starts, lengths).astype(np.uint64) + np.uint64(1)) * _P
    weights ^= weights >> np.uint64(31)
    weights *= _P
    if len(words):
        whole = np.add.reduceat(weights, starts)
        whole ^= whole >> np.uint64(32)
        whole *= _P
        whole ^= whole >> np.uint64(32)
    return bucket[order], counts, (whole % np.uint64(ROWS)).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters: char, word (embeddings), and for each direction d: Wd (input), Ud (state), bd; Wa, va (attention); w, b."""

    def __init__(self, seed: int = 7):
        r, h, e = np.random.default_rng(seed), HIDDEN, 2 * WIDTH
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"char": np.zeros((ROWS, WIDTH), np.float32), "word": np.zeros((ROWS, WIDTH), np.float32), "Wa": f(2 * h, h), "va": f(h), "w": f(2 * h), "b": np.full(1, -1.0, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": f(e, 3 * h), f"U{d}": f(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}

    def embed(self, grams: np.ndarray, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
        ends = np.cumsum(counts)
        x = np.zeros((len(counts), 2 * WIDTH), np.float32)
        full = counts > 0
        if full.any():
            x[full, :WIDTH] = np.add.reduceat(self.p["char"][grams], (ends - counts)[full]) / np.sqrt(counts[full, None].astype(np.float32))
        x[:, WIDTH:] = self.p["word"][own]
        return x

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Both directions' gate inputs of words."""
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], 1)

    def states(self, g: np.ndarray, ids: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (time, window, hidden) of one direction. g: gate inputs by word; ids: (window, time), -1 past the end."""
        h, u = HIDDEN, self.p[f"U{d}"]
        n, steps = ids.shape
        off = 0 if d == "f" else 3 * h
        state, out = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = g[ids[:, t], off : off + 3 * h]
            zr = sigmoid(x[:, : 2 * h] + state @ u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            rs = r * state
            c = np.tanh(x[:, 2 * h :] + rs @ u[:, 2 * h :])
            live = (ids[:, t] >= 0)[:, None]
            new = np.where(live, state + z * (c - state), state)
            if keep is not None:
                keep.append((t, state, z, r, c, live))
            state = out[t] = new
        return out

    def forward(self, g: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows."""
        kf, kb = ([], []) if keep is not None else (None, None)
        s = np.concatenate([self.states(g, ids, "f", kf), self.states(g, ids, "b", kb)], 2)
        a = np.tanh(s @ self.p["Wa"])
        e = np.where((ids >= 0).T, a @ self.p["va"], np.float32(-30))
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = (alpha[:, :, None] * s).sum(0)
        if keep is not None:
            keep |= {"f": kf, "b": kb, "s": s, "a": a, "alpha": alpha, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"]

    def gradients(self, x: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the weighted log loss; the second is the words' inputs' gradient."""
        p, h, k = self.p, HIDDEN, {}
        g = self.inputs(x)
        logit = self.forward(g, ids, k)
        d = ((sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        s, a, alpha = k["s"], k["a"], k["alpha"]
        out = {"w": k["pooled"].T @ d, "b": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * p["w"]
        dalpha = (s * dpool).sum(2)
        de = alpha * (dalpha - (alpha * dalpha).sum(0))
        out["va"] = np.einsum("tn,tnh->h", de, a)
        da = de[:, :, None] * p["va"] * (1 - a * a)
        out["Wa"] = np.einsum("tnk,tnh->kh", s, da)
        ds = alpha[:, :, None] * dpool + da @ p["Wa"].T
        dg = np.zeros((len(x) + 1, 6 * h), np.float32)
        for d_, at in (("f", 0), ("b", h)):
            u, off, carry = p[f"U{d_}"], 0 if d_ == "f" else 3 * h, np.zeros((ids.shape[0], h), np.float32)
            du = np.zeros_like(u)
            steps = []
            for t, before, z, r, c, live in reversed(k[d_]):
                dh = carry + ds[t, :, at : at + h]
                dl = dh * live
                dc = dl * z * (1 - c * c)
                dz = dl * (c - before) * z * (1 - z)
                drs = dc @ u[:, 2 * h :].T
                dr = drs * before * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                du[:, : 2 * h] += before.T @ dzr
                du[:, 2 * h :] += (r * before).T @ dc
                carry = np.where(live, dh * (1 - z), dh) + drs * r + dzr @ u[:, : 2 * h].T
                steps.append((t, np.concatenate([dzr, dc], 1)))
            out[f"U{d_}"] = du
            order = np.concatenate([ids[:, t] for t, _ in steps])
            rows = np.concatenate([v for _, v in steps])
            for c_ in range(3 * h):
                dg[:, off + c_] = np.bincount(np.where(order < 0, len(x), order), rows[:, c_], minlength=len(x) + 1)
        dg = dg[:-1]
        dx = np.zeros_like(x)
        for d_, off in (("f", 0), ("b", 3 * h)):
            part = dg[:, off : off + 3 * h]
            out[f"W{d_}"], out[f"b{d_}"] = x.T @ part, part.sum(0)
            dx += part @ p[f"W{d_}"].T
        return out, dx

    def embedding_gradients(self, dx: np.ndarray, grams: np.ndarray, counts: np.ndarray, own: np.ndarray) -> dict:
        by_gram = np.repeat(dx[:, :WIDTH] / np.sqrt(np.maximum(counts, 1))[:, None], counts, 0)
        char, word = np.zeros((ROWS, WIDTH), np.float32), np.zeros((ROWS, WIDTH), np.float32)
        for c in range(WIDTH):
            char[:, c] = np.bincount(grams, by_gram[:, c], minlength=ROWS)
            word[:, c] = np.bincount(own, dx[:, WIDTH + c], minlength=ROWS)
        return {"char": char, "word": word}


def windows_of(n: int) -> list[int]:
    """Starts of the windows that cover n words; neighbours overlap."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE)) if n else []


class Scorer:
    """Scores texts; gate inputs of words are kept in a bounded table."""

    def __init__(self, network: Network):
        self.network, self.ids, self.empty = network, {}, float(sigmoid(network.p["b"].astype(np.float64))[0])
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)

    def _learn(self, words: set[bytes]) -> None:
        if len(self.ids) + len(words) > _KEPT_WORDS:
            self.ids.clear()
        new = [w for w in words if w not in self.ids]
        first = len(self.ids)
        while len(self.gates) < first + len(new):
            self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.gates[first + at : first + at + len(part)] = self.network.inputs(self.network.embed(*features(part)))
        self.ids.update((w, first + k) for k, w in enumerate(new))

    def logits(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """Of every window of every text."""
        if missing := {w for d in docs for w in d}.difference(self.ids):
            held = self.ids
            size = len(held)
            self._learn(missing)
            if len(held) < size + len(missing):  # the table was emptied
                self._learn({w for d in docs for w in d})
        ids = np.fromiter(map(self.ids.__getitem__, (w for d in docs for w in d)), np.int64, sum(map(len, docs)))
        starts, owners, ends, base = [], [], [], 0
        for k, d in enumerate(docs):
            s = windows_of(len(d))
            starts += [base + x for x in s]
            ends += [base + len(d)] * len(s)
            owners += [k] * len(s)
            base += len(d)
        padded = np.append(ids, np.full(WINDOW, -1))
        starts_, ends_ = np.array(starts, np.int64), np.array(ends, np.int64)
        out = np.empty(len(starts), np.float32)
        for at in range(0, len(starts), _CHUNK):
            place = starts_[at : at + _CHUNK, None] + np.arange(WINDOW)
            part = np.where(place < ends_[at : at + _CHUNK, None], padded[np.minimum(place, len(padded) - 1)], -1)
            out[at : at + _CHUNK] = self.network.forward(self.gates, part)
        return np.split(out, np.searchsorted(np.array(owners, np.int64), np.arange(1, len(docs)))) if docs else []

    def scores(self, docs: list[list[bytes]]) -> list[float]:
        return [float(sigmoid(x.max().astype(np.float64))) if len(x) else self.empty for x in self.logits(docs)]


def _suspicion(docs: list[list[bytes]], y: np.ndarray) -> np.ndarray:
    """Of each n-gram bucket: log odds of standing in a text of class 1."""
    counts = np.ones((2, ROWS))
    for d, label in zip(docs, y, strict=True):
        if d:
            counts[int(label)][np.unique(features(list(set(d)))[0])] += 1
    rates = counts / (np.bincount(y.astype(int), minlength=2)[:, None] + 2)
    return np.log(rates[1]) - np.log(rates[0])


def train(docs: list[list[bytes]], labels: list[int], seed: int = 7) -> Network:
    """A network from texts' words and labels."""
    rng, network = np.random.default_rng(seed), Network(seed)
    y = np.array(labels, np.float32)
    odds = _suspicion(docs, y)
    vocabulary: dict[bytes, int] = {}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in d], np.int64) for d in docs]
    grams, counts, own = features(list(vocabulary))
    ends = np.cumsum(counts)
    # a word is as telling as its most telling n-gram
    word_odds = np.maximum.reduceat(np.append(odds[grams], -9.0), np.minimum(ends - counts, len(grams))) if len(counts) else np.empty(0)
    starts = [windows_of(len(d)) for d in docs]
    chosen = [max(s, key=lambda a, c=c: word_odds[c[a : a + WINDOW]].max()) if s else 0 for s, c in zip(starts, coded, strict=True)]
    moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in network.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        if epoch in (EPOCHS // 3, 2 * EPOCHS // 3):
            best = Scorer(network).logits(docs)
            chosen = [s[int(b.argmax())] if len(b) else 0 for s, b in zip(starts, best, strict=True)]
        # each text's chosen window, and a random one of each text of class 0
        pairs = [(k, chosen[k]) for k in range(len(docs)) if starts[k]] + [(k, int(rng.choice(starts[k]))) for k in range(len(docs)) if starts[k] and y[k] == 0]
        order = rng.permutation(len(pairs))
        for at in range(0, len(order), BATCH):
            part = [pairs[i] for i in order[at : at + BATCH]]
            ids = np.full((len(part), WINDOW), -1, np.int64)
            for row, (k, a) in enumerate(part):
                c = coded[k][a : a + WINDOW]
                ids[row, : len(c)] = c
            used, where = np.unique(ids, return_inverse=True)
            where = where.reshape(ids.shape)
            if used[0] == -1:
                used, where = used[1:], where - 1
            n = counts[used]
            spans = np.repeat(ends[used] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
            g, o = grams[spans], own[used]
            x = network.embed(g, n, o)
            grad, dx = network.gradients(x, where, y[[k for k, _ in part]], np.ones(len(part), np.float32))
            grad |= network.embedding_gradients(dx, g, n, o)
            step += 1
            rate = RATE * min(1.0, 2.0 * (1 - epoch / EPOCHS))
            for name, d in grad.items():
                m, v = moments[name]
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                network.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return network


def held_out(key: str) -> Column:
    """Whether crc32 of the key as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(quoted(key)).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int = TRAIN_ROWS) -> tuple[list, list]:
    """A bounded sample of labelled texts that are not held out, some of each class."""
    known = labels.filter(~held_out(key) & F.col(quoted(label)).isin(0, 1)).select(F.col(quoted(key)).alias("_k"), F.col(quoted(label)).cast("int").alias("y")).groupBy("_k").agg(F.max("y").alias("y"))
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("_k"), "_k").limit(rows)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(quoted(key)).alias("_k"), F.col(quoted(text)).alias("_t")).filter("_t IS NOT NULL").join(F.broadcast(chosen), "_k")
    # of a repeated key, the least text; the sample ends where its texts are too long in all
    found = texts.groupBy("_k").agg(F.min("_t").alias("_t"), F.first("y").alias("y"))
    before = F.sum(F.length("_t")).over(Window.orderBy(F.xxhash64("_k"), "_k").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") <= TRAIN_TOTAL).select("_k", "_t", "y").toPandas().sort_values("_k")
    return [alnum_words(t) for t in found["_t"]], found["y"].astype(int).tolist()


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """key, held_out, score and predicted of every document."""
    words, y = sample(docs, labels, key, text, label)
    model = docs.sparkSession.sparkContext.broadcast(train(words, y).p if len(set(y)) == 2 else None)
    kind = docs.schema[key].dataType.simpleString()

    def make():
        network = Network()
        if model.value is not None:
            network.p = model.value
        scorer = Scorer(network)

        def run(batch: pa.RecordBatch) -> dict:
            texts = [alnum_words(t) for t in batch.column("_text").to_pylist()]
            scores = [0.0] * len(texts) if model.value is None else scorer.scores(texts)
            return {"_key": batch.column("_key"), "score": scores}

        return run

    scored = map_rows(docs.select(F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("_text")), make, f"_key {kind}, score double", sized="_text").withColumnRenamed("_key", key)
    return scored.select(quoted(key), held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
