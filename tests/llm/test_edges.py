"""Odd tables through every operator and stage: clashing names, string keys, nulls, empty tables, repeated rows."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import _shared, decontaminate, html_extract, license_scan, ngram_join, packing, pii, quality_rules, token_counts, toxicity, url_filters
from tessera.llm._shared import Stages

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return.
CLASHES = ["_t", "_w", "_l", "_g", "_d", "_h", "_key", "_text", "_bit", "_gone", "_salt", "_base", "_soft", "_verdict", "_found", "_heavy", "_small", "_spread", "key", "node", "comp", "rep", "size", "grams", "digest", "mark", "k", "n", "host", "path", "rule", "n_words", "n_lines", "base_failed", "failed", "kept", "items", "spans", "score", "labels", "a.b", "with `tick`"]
LONG = " ".join(f"w{i}" for i in range(30_000))
TEXTS = [None, "", " ", "one", "same words here", "same words here", LONG, LONG + " end", " ".join(f"v{i % 70}" for i in range(60)), "mail a.b@c.org or MIT License", " ".join(f"b{i}" for i in range(12))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else "en", None if i % 3 == 0 else f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(11))), (2, None), (3, ""), (1, "short")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")


def clashing(docs, values=True):
    return docs.select("*", *[(F.concat(F.lit(c), F.col("doc_id").cast("string")) if values else F.lit(1)).alias(c) for c in CLASHES])


def operators(spark, bench, labels):
    cache = Stages(spark, "edges").folder + "/cache"
    return {
        "quality_rules": quality_rules.quality_rules,
        "ngram_join": ngram_join.ngram_join,
        "decontamination": lambda d: decontaminate.matches(d, bench),
        "packing": lambda d: packing.pack(d).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"),
        "token_counts": lambda d: token_counts.token_counts(d, cache),
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "license_scan": license_scan.license_scan,
        "pii": pii.pii_spans,
    }


NAMES = ["quality_rules", "ngram_join", "decontamination", "packing", "token_counts", "toxicity", "license_scan", "pii"]


def as_sets(df):
    if "doc_tokens" in df.columns:  # pieces may be cut elsewhere
        df = df.groupBy("doc_id").agg(F.sum("length").alias("length"), F.max("doc_tokens").alias("doc_tokens"))
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", NAMES)
def test_operators_with_clashing_names_and_string_keys(spark, docs, bench, labels, name):
    op = operators(spark, bench, labels)[name]
    plain = op(docs)
    found = as_sets(plain)
    assert as_sets(op(clashing(docs))) == found
    assert op(docs.limit(0)).collect() == []
    if name in ("ngram_join", "toxicity"):
        return  # string keys of the join are tested beside it, labels have keys of their own
    strings = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("string")))
    assert len(as_sets(op(strings))) == len(found) + 1


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "benchmark_passages", "personal_data"])
def test_stages_with_clashing_names(spark, docs, bench, stage, tmp_path):
    import corpus_pipeline

    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    f = getattr(corpus_pipeline, stage)
    want = sorted(map(str, f(spark, docs, str(tmp_path)).collect()))
    wide = clashing(docs)
    got = f(spark, wide, str(tmp_path))
    assert got.columns == wide.columns
    rows = got.collect()
    assert sorted(str(r) for r in got.select(*docs.columns).collect()) == want
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHES)
    assert f(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_pages_with_clashing_names(spark):
    rows = [(f"p{i}", u, h) for i, (u, h) in enumerate([(None, None), ("", ""), ("http://a.net/", "<p>x"), ("http://a.net/", "<p>x"), ("http://b.casino.com/", "<p>" + LONG)])]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    wide = pages.select("*", *[F.lit(1).alias(c) for c in CLASHES])
    a, b = url_filters.url_filter(pages, html="html"), url_filters.url_filter(wide, html="html")
    own = ["page_id", "host", "path", "rule", "verdict", "host_bound"]
    assert sorted(map(str, a.select(own).collect())) == sorted(map(str, b.select(own).collect()))
    assert url_filters.url_filter(wide.limit(0), html="html").count() == 0
    a, b = html_extract.html_extract(pages), html_extract.html_extract(wide)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and {r.page_id: r.n_chars for r in a.collect()}["p4"] == len(LONG)
    assert html_extract.html_extract(wide.limit(0)).count() == 0


def test_empty_benchmark_and_labels(spark, docs, bench, labels):
    assert decontaminate.remove(docs, bench.limit(0)).count() == len(TEXTS)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_join_back_spreads_heavy_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i < 600 else None if i < 800 else f"k{i}") for i in range(1000)], "id long, h string")
    counts = rows.groupBy("h").agg(F.count("*").alias("n"), F.concat(F.lit("v-"), F.coalesce("h", F.lit("null"))).alias("v"))
    want = sorted(map(str, _shared.join_back(rows, Stages(spark, "t").keyed(counts, "a", "h", "n"), "h", "n", "v").collect()))
    monkeypatch.setattr(_shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(_shared, "HEAVY_SHARE", 0.01)
    got = _shared.join_back(rows, Stages(spark, "t").keyed(counts, "a", "h", "n"), "h", "n", "v")
    assert sorted(map(str, got.collect())) == want and "v='v-null'" in " ".join(want)


def test_shared_folder_is_asked_for(spark, monkeypatch):
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="checkpoint"):
        _shared.shared_folder(Session())


def test_hosts_judged_both_ways(spark):
    """A bad host takes harmless pages with it, a good one keeps a bad page; a host of one page is not judged."""
    rows = [(i, f"http://www.{'pills' if i % 10 else 'x'}.bad{i % 3}.net/p{i}/{'casino' if i % 4 else 'a'}") for i in range(300)]
    rows += [(1000 + i, f"http://good.net/{'casino' if i == 0 else 'p'}/{i}") for i in range(300)] + [(2000, "http://single.net/casino"), (2001, "http://www.example.org/es/1"), (2002, "http://u:p@good.net:8080/x")]
    got = {r.page_id: r for r in url_filters.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    harmless_on_bad = [i for i in range(300) if i % 10 and i % 4 == 0]
    assert all(got[i].verdict == "block" for i in harmless_on_bad) and len(harmless_on_bad) > 50
    assert got[1000].verdict == "allow" and got[2000].verdict == "allow" and got[2001].verdict == "block" and got[2002].host == "u:p@good.net:8080"


def test_suffix_rules(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.com", "com", "", "a.b.c.ck", "c.ck", "www.ck", "a.www.ck", "city.kawasaki.jp", "x.foo.kawasaki.jp", "1.2.3.4", "1.2.3.4:80", "[::1]:80", "u@a.com:8080", "me.blogspot.com", "s.s3.amazonaws.com"]
    d, s = url_filters.domain_and_suffix(F.col("h"))
    got = {r.h: (r.d, r.s) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", d.alias("d"), s.alias("s")).collect()}
    assert got["a.b.co.uk"] == got["b.co.uk"] == ("b.co.uk", "co.uk") and got["x.y.com"] == ("y.com", "com") and got["u@a.com:8080"] == ("a.com", "com")
    assert got["a.b.c.ck"] == ("b.c.ck", "c.ck") and got["www.ck"] == got["a.www.ck"] == ("www.ck", "ck")
    assert got["city.kawasaki.jp"] == ("city.kawasaki.jp", "kawasaki.jp") and got["x.foo.kawasaki.jp"] == ("x.foo.kawasaki.jp", "foo.kawasaki.jp")
    assert got["1.2.3.4"] == got["1.2.3.4:80"] == ("1.2.3.4", "") and got["[::1]:80"] == ("[::1]", "")
    assert got["me.blogspot.com"] == ("me.blogspot.com", "blogspot.com") and got["s.s3.amazonaws.com"][1] == "s3.amazonaws.com"
    with pytest.raises(ValueError, match="suffix"):
        url_filters.suffix_lists(["a..b"])


def test_host_verdicts_decide_rules(spark):
    """Bad hosts lose all documents, doubtful ones those that fail a soft rule, good ones neither."""
    good = " ".join(f"word{i}" for i in range(60))
    soft, short = " ".join(f"word{i}##" for i in range(60)), "too short"
    rows, i = [], 0
    for host, parts in {"bad": [(short, 95), (good, 5)], "doubtful": [(short, 40), (soft, 20), (good, 40)], **{f"good{k}": [(soft, 3), (short, 2), (good, 95)] for k in range(8)}}.items():
        for text, n in parts:
            for _ in range(n):
                rows.append((i, text, host))
                i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules.quality_rules(docs).collect()
    verdict = {r.source: r.host_verdict for r in got}
    assert (verdict["bad"], verdict["doubtful"], verdict["good0"]) == ("bad", "doubtful", "good")
    kept = lambda host, text: {r.kept for r in got if r.source == host and rows[r.doc_id][1] == text}
    assert kept("bad", good) == {False} and kept("doubtful", soft) == {False} and kept("doubtful", good) == {True}
    assert kept("good0", soft) == {True} and kept("good0", short) == {False}
    assert {r.doc_id for r in quality_rules.keep(docs).collect()} == {r.doc_id for r in got if r.kept}


def test_scorer_equals_plain_windows():
    r, network = np.random.default_rng(4), toxicity.Network(3)
    network.p["char"][:] = r.normal(0, 0.3, network.p["char"].shape)
    network.p["word"][:] = r.normal(0, 0.3, network.p["word"].shape)
    texts = [[f"w{k}".encode() for k in r.integers(0, 50, n)] for n in (0, 1, 5, 47, 48, 49, 80, 81, 200)]
    got = toxicity.Scorer(network).scores(texts)
    for words, score in zip(texts, got, strict=True):
        best = []
        for start in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE) if words else []:
            part, states = words[start : start + toxicity.WINDOW], {}
            g = network.inputs(network.embed(*toxicity.features(part)))
            for d, off, order in (("f", 0, range(len(part))), ("b", 3 * toxicity.HIDDEN, range(len(part) - 1, -1, -1))):
                h, u, out = np.zeros(toxicity.HIDDEN, np.float32), network.p[f"U{d}"], {}
                for t in order:
                    x, w = g[t, off : off + 3 * toxicity.HIDDEN], toxicity.HIDDEN
                    z, gate = np.split(1 / (1 + np.exp(-(x[: 2 * w] + h @ u[:, : 2 * w]))), 2)
                    h = h + z * (np.tanh(x[2 * w :] + (gate * h) @ u[:, 2 * w :]) - h)
                    out[t] = h
                states[d] = np.array([out[t] for t in range(len(part))])
            s = np.concatenate([states["f"], states["b"]], 1)
            e = np.tanh(s @ network.p["Wa"]) @ network.p["va"]
            alpha = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            best.append(float((alpha @ s) @ network.p["w"] + network.p["b"][0]))
        want = 1 / (1 + np.exp(-(max(best) if best else network.p["b"][0])))
        assert score == pytest.approx(want, abs=1e-4)


def test_licences_against_brute_force(spark):
    """Base columns and notice labels by plain searches over words, on hand-made and random texts."""
    import random
    import re

    rng = random.Random(5)
    vocabulary = "mit apache general public license version 2 3 0 the lesser bsd , . - \n MIT License É licensé".split(" ")
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    machine = license_scan.automaton()
    for text in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        at = lambda phrase: [i for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]  # noqa: B023, E731
        places = sorted(i for p in license_scan.BASE for i in at(p))
        base = {label for p, label in license_scan.BASE.items() if at(p)}
        more = {label for p, label, _ in license_scan.NOTICES if at(p)} - {"notice"}
        got = license_scan.scan(text, machine)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (len(w), len(places), places[0] if places else None, places[-1] if places else None)
        assert got["base_labels"] == ",".join(sorted(base)) and got["labels"] == ",".join(sorted(base | more))


def test_licence_expressions_by_truth_tables():
    """Required licences are those without which no choice satisfies the expression."""
    import itertools
    import random

    rng = random.Random(6)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice("abcde")
        return f"({make(depth - 1)} {rng.choice(['AND', 'OR'])} {make(depth - 1)})"

    for _ in range(200):
        text = make(3)
        names = sorted(set(c for c in text if c in "abcde"))
        sound = [set(s) for n in range(len(names) + 1) for s in itertools.combinations(names, n) if eval(text.replace("AND", "and").replace("OR", "or"), {c: c in s for c in names})]  # noqa: S307
        licences, required = license_scan.evaluate(license_scan.to_postfix(text))
        assert licences == set(names) and required == set.intersection(*sound)
    tag = license_scan.scan("SPDX-License-Identifier: " + " AND ".join(f"(A{i} OR B{i})" for i in range(100)), license_scan.automaton())
    assert len(tag["labels"].split(",")) == 200 and tag["required"] == ""
    assert license_scan.scan("SPDXélicense identifier: MIT", license_scan.automaton())["labels"] == ""


def test_secrets_and_scores(spark):
    text = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" but token = "aaaaaaaaaaaaaaaaaaaaaaa1" and test key: api_key=04dbebab91ab85687d33eeaaf9ac699e1188f963'
    assert [(s.kind, text[s.start : s.end][-3:], round(s.score, 1)) for s in pii.find(text)] == [("secret", "962", 0.7), ("secret", "963", 0.5)]
    near, far = "my ssn is 987-65-4321", "part 987-65-4321 fits"
    assert [s.kind for s in pii.find(near)] == ["ssn"] and pii.find(far) == []


def test_op9_digest(spark, tmp_path):
    import hashlib

    texts = ["Call +49 170 1234567 or a@b.co, 10.0.0.1 and 4111 1111 1111 1111", None, "none"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op9_pii(spark, str(tmp_path)).collect()}
    t = texts[0]
    spans = [("phone", "+49 170 1234567"), ("email", "a@b.co"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111")]
    base = ",".join(f"{k}:{t.index(v)}:{t.index(v) + len(v)}" for k, v in spans)
    assert (got[0].n_email, got[0].n_ip, got[0].n_card, got[0].n_phone, got[0].spans) == (1, 1, 1, 1, base)
    assert got[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_cache_is_warm_and_survives_double_appends(spark, docs):
    cache = Stages(spark, "edges").folder + "/cache"
    want = sorted(map(str, token_counts.token_counts(docs, cache).collect()))
    stored = spark.read.parquet(cache)
    n = stored.count()
    stored.write.mode("append").parquet(cache)  # as another job that ran at the same time
    assert sorted(map(str, token_counts.token_counts(docs, cache).collect())) == want
    assert spark.read.parquet(cache).count() == 2 * n


def test_cuts_inside_sentences_save_padding():
    """Padding with cuts inside sentences and without, on texts of long sentences."""
    rng = np.random.default_rng(3)

    def padding(step):
        was, packing.STEP = packing.STEP, step
        try:
            p = packing.Packer(np.array([False, False, False, True]), 256, 0)
            for k in range(300):
                ids = np.ones(int(rng.integers(20, 600)), "<u4")
                ids[199::200] = 3
                p.add(k, ids)
            p.pack(last=True)
        finally:
            packing.STEP = was
        rows = p.take()
        used = {}
        for *_, length, _, _, sequence, _ in rows:
            used[sequence] = used.get(sequence, 0) + length
        assert max(used.values()) <= 256
        return sum(256 - n for n in used.values() if n & (n - 1)) / (256 * len(used))

    assert padding(32) < 0.02 < padding(256)
