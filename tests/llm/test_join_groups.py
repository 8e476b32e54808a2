"""Large groups in the n-gram join: what is compared in blocks, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, docs_of, joined

from tessera.llm import ngram_join


def passages(r):
    """Documents of one common passage and words of their own; every tenth has a near copy."""
    passage, texts = [f"p{k}" for k in range(60)], []
    for i in range(150):
        own = [f"w{k}" for k in r.integers(0, 10**6, 80)]
        texts.append(" ".join([*own[:30], *passage, *own[30:]]))
        if i % 10 == 0:
            texts.append(f"{texts[-1]} more")
    return texts


def star(r):
    """An original and copies that are linked to it alone, as each pair of copies differs in twice as many words."""
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base)]
    for i in range(150):
        t = list(base)
        for k in r.choice(np.arange(2, 148), 2, replace=False):
            t[k] = f"x{i}_{k}"
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize(("make", "most"), [(passages, 40), (star, 40)])
def test_large_groups_are_not_compared_in_blocks(spark, make, most, monkeypatch):
    compared, old = [], ngram_join._long_links

    def seen(rows, far, *more):
        compared.append(far.count())
        return old(rows, far, *more)

    monkeypatch.setattr(ngram_join, "_long_links", seen)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    texts = make(np.random.default_rng(3))
    assert joined(ngram_join.ngram_join(docs_of(spark, texts))) == brute_components(dict(enumerate(texts)), 4, 85)
    assert sum(compared) <= most


@pytest.mark.parametrize("long_list", [3, 20])
def test_pruned_sets_lose_no_link(spark, long_list, monkeypatch):
    """Families within a passage's group, all of whose pairs are left to the blocks."""
    monkeypatch.setattr(ngram_join, "LONG_LIST", long_list)
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 20_000)
    r = np.random.default_rng(4)
    texts = [*passages(r), *star(r)[:40]]
    assert joined(ngram_join.ngram_join(docs_of(spark, texts))) == brute_components(dict(enumerate(texts)), 4, 85)


def test_prefixes_are_shuffled_in_parts(spark, monkeypatch):
    """No part of the keys is much more than its share, and none is lost."""
    held, old = [], ngram_join.Stages.write

    def write(self, df, name="t"):
        out = old(self, df, name)
        held.extend([out.count()] if name == "hits" else [])
        return out

    monkeypatch.setattr(ngram_join.Stages, "write", write)
    texts = star(np.random.default_rng(6))[:30] + [f"{k} {' '.join(f'a{k}_{i}' for i in range(60))}{' x' * j}" for k in range(60) for j in range(2)]
    assert {r.doc_id for r in ngram_join.deduplicate(docs_of(spark, texts)).collect()} == {k for k, v in brute_components(dict(enumerate(texts)), 5, 80).items() if v[1] == k}
    assert len(held) == ngram_join.KEY_PARTS > 1 and max(held) < 0.5 * sum(held)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngrams_of_a_group_are_counted_in_parts(spark, n, percent, monkeypatch):
    """A passage's sets are out before most of their n-grams are counted, and n-grams travel by blocks, not one by one."""
    held, rows, counted, old = [], [], [], ngram_join.map_rows

    def seen(df, make, ddl, **more):
        out = old(df, make, ddl, **more)
        if df.columns == ["comp", "outside", "grams"]:
            one = out.select(F.length("held") / ngram_join._HELD.itemsize) if "held" in out.columns else out.select(F.lit(1))
            sent = one.toDF("n").agg(F.count("*"), F.sum("n")).first()
            held.append(df.agg(F.sum(F.length("grams") / 8)).first()[0])
            rows.append(sent[0])
            counted.append(sent[1])
        return out

    monkeypatch.setattr(ngram_join, "map_rows", seen)
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    texts = passages(np.random.default_rng(7))
    assert joined(ngram_join.ngram_join(docs_of(spark, texts), n=n, percent=percent)) == brute_components(dict(enumerate(texts)), n, percent)
    assert held and sum(rows) < held[0] / 20 and sum(counted) < held[0] / 2
