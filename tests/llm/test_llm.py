"""Training-data operators against brute force, exact round trips and held-out accuracy; and on odd rows."""

import collections
import hashlib
import inspect
import itertools
import random
import re
import textwrap
import tracemalloc
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, common, decontaminate, lang_id, licenses, lm_score, ngram_join, quality, queries, repeats, shards, telephony

SMALL = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "One two three four five six seven."), (4, "One two three four five six seven."), (None, "One two three four five six seven."), (None, None), (5, "é日本 ß" * 200), (6, "12 34"), (7, "ab" * 60_000)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names that operators use inside."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("*", *(F.lit("x").alias(c) for c in ("r", "n", "f1", "key", "keys", "node", "w", "gid", "slot", "score", "ids", "starts")), F.lit(None).cast("string").alias("lang"))


def texts(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.mark.parametrize("n, num, more", [(3, 90, {}), (5, 80, {"tile_rows": 2}), (2, 50, {"tile_hashes": 300, "broadcast_rows": 1})])
def test_ngram_join(docs, odd, n, num, more):
    rows = [*texts(docs), *((-k - 1, t) for k, (_, t) in enumerate(ODD))]
    sets = {d: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if (w := words(t)) else set() for d, t in rows}
    first = grouped(sets, num)
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_classes(df, n, num, 100, **more).collect()}
    assert got == {d: (len(s), first[d]) for d, s in sets.items()}
    out = ngram_join.near_classes(odd).collect()
    assert len(out) == len(ODD) and all(r["component_id"] == 4 for r in out if r["n_shingles"] == 5)
    assert ngram_join.near_classes(odd.limit(0)).count() == 0


def test_word_hashes():
    """Chunks don't change hashes; words that differ in a pattern which polynomials lose have different ones."""
    text = ("One  tWo\nthree " * 30 + "x" * 5000 + " é end").encode()
    data = np.frombuffer(text, np.uint8)
    want = ngram_join.word_hashes(data)
    assert len(want) == 93 and len(set(want.tolist())) == 6 and want[0] == ngram_join.word_hashes(np.frombuffer(b"oNE", np.uint8))[0]
    for chunk in (1, 2, 3, 7, 64, 4999):
        assert (ngram_join.word_hashes(data, chunk) == want).all()
    morse = "a"
    while len(morse) < 2048:
        morse += morse.translate({97: 98, 98: 97})
    assert len(set(ngram_join.word_hashes(np.frombuffer((morse + " " + morse.translate({97: 98, 98: 97})).encode(), np.uint8)).tolist())) == 2


def test_bpe(docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).union(docs.sparkSession.createDataFrame([(9, "a<|endoftext|>b  <|end \n x")], "doc_id long, text string"))
    out = bpe.round_trip(df, slice_bytes=3000)
    want = collections.Counter((d, tuple(t.encode(x or "", add_special_tokens=False).ids), x or "") for d, x in texts(df))
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in out.collect()) == want
    assert bpe.round_trip(odd.limit(0)).count() == 0


def test_bpe_words_and_buckets(spark):
    """Words of odd white space and long texts in pieces give the tokenizer's ids; buckets are those of Spark."""
    from tokenizers import Tokenizer

    rng = random.Random(1)
    some = [*"ab'<|>\n\t   \u0085é日😀12.,", "<|endoftext|>", "  ", "\r\n", "don't", " <|"]
    rows = [(k, "".join(rng.choice(some) for _ in range(rng.randrange(40)))) for k in range(2000)] + [(5000, "ab cd  " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    t = Tokenizer.from_file(bpe.default_path())
    want = {d: (t.encode(x, add_special_tokens=False).ids, x) for d, x in rows}
    assert {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.round_trip(df, slice_bytes=20_000).collect()} == want
    parts = sorted({w for _, x in rows for w in x.split(" ")})
    assert [r[0] for r in spark.createDataFrame([(w,) for w in parts], "w string").select(F.hash("w")).collect()] == bpe.spark_hash(pa.array(parts)).tolist()


def test_licenses(odd, spark):
    text = "Header.\nPermission to use.\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nReleased under the MIT License. Released under the MIT License!"
    df = spark.createDataFrame([(1, text), (2, "All rights reserved"), (2, "All rights reserved"), (None, "licensed under CC BY 4.0."), (3, "MIT License")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["license_id"], r["n_matches"], r["first_sentence"]) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([(1, "Apache-2.0", 1, 2), (1, "MIT", 2, 5), (2, "all-rights-reserved", 1, 0), (None, "CC-BY-4.0", 1, 0)], key=str)
    assert licenses.scan(odd).count() == 0


def test_licenses_wrapped(spark):
    """Published texts, wrapped at 72 columns with comment marks; a blank line or a sentence's end is not crossed."""
    known = licenses.SENTENCES

    def wrapped(codes, mark):
        return f"\n{mark}\n".join("\n".join(mark + line for line in textwrap.wrap(known[c].capitalize() + ".", 72)) for c in codes.split())

    texts = {k: "Copyright 2020\n\n" + wrapped(codes, mark) for k, (codes, mark) in enumerate([("D E", ""), ("R S T U", "# "), ("R S T", " * "), ("K M N", "// "), ("L", "  "), ("X", ""), ("ASIS NOEVENT ANYONE", "# "), ("LGPL21 LIBRARY LESSER", " * "), ("AGPL3 M AFFERO", "// ")])}
    texts[16] = "Licensed under the Apache License,\nVersion 2.0\n(the License)"
    texts[17] = "Released under\n\nthe MIT License. Licensed. Under the MIT License"
    texts[18] = "Released under\r\nthe MIT License.\nAll rights reserved."
    got = {(r["doc_id"], r["license_id"], r["rule_no"], r["first_sentence"]) for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {g[:2] + g[3:] for g in got} == {(0, "MIT", 2), (1, "BSD-3-Clause", 2), (2, "BSD-2-Clause", 2), (3, "GPL-3.0-or-later", 2), (4, "GPL-2.0-or-later", 2), (5, "ISC", 2), (6, "Zlib", 2), (7, "LGPL-2.1-or-later", 2), (8, "AGPL-3.0-or-later", 2), (16, "Apache-2.0", 0), (18, "MIT", 0), (18, "all-rights-reserved", 2)}
    for known, rules in (({"A": "Not normal"}, [("x", "A")]), ({"A b": "x"}, []), ({"A": "x"}, [("y", "A B")])):
        with pytest.raises(ValueError):
            licenses.scan(spark.createDataFrame([], "doc_id long, text string"), known=known, rules=rules)
    own = licenses.scan(spark.createDataFrame([(1, "One two. Three!\nOne two.\nThree")], "doc_id long, text string"), known={"first": "one two", "second": "three"}, rules=[("own", "first second")])
    assert [(r["license_id"], r["n_matches"], r["first_sentence"]) for r in own.collect()] == [("own", 2, 0)]


def test_decontaminate(spark, docs, odd):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    first = items.orderBy("item_id").first()
    planted = spark.createDataFrame([(900, "Some words. " + first["text"].upper() + " and more"), (901, " ".join(first["text"].split()[:20])), (None, first["text"])], "doc_id long, text string")
    hits = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(planted.unionByName(odd.select("doc_id", "text")), items).collect()}
    assert hits == {(900, first["item_id"]): 1.0, (None, first["item_id"]): 1.0}
    short = spark.createDataFrame([(1, "two words"), (2, None), (3, "")], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame([(1, "here are two words"), (2, "nothing")], "doc_id long, text string"), short).collect()
    assert [(r["doc_id"], r["item_id"], r["start_word"]) for r in got] == [(1, 1, 2)]
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0


def test_decontaminate_finds_reordered_items(spark):
    """Items with their parts swapped inside longer documents, against brute force over all windows."""
    r = np.random.default_rng(4)
    items = {k: [f"i{k}x{j}" for j in range(n)] for k, n in enumerate((60, 60, 80, 41, 12))}
    held = {}
    for d in range(15):
        w, cut = items[d % 5], int(r.integers(1, len(items[d % 5])))
        parts = [w[cut:] + w[:cut], w[:cut] + ["zz"] + w[cut:], w[: len(w) - 1] + ["yy"]][d % 3]
        held[d] = [f"a{d}y{j}" for j in range(100)] + parts + [f"b{d}y{j}" for j in range(int(r.integers(0, 99)))]
    held[15] = [f"f{j}" for j in range(100)] + items[0][30:] + items[0][:30] + [f"g{j}" for j in range(100)]

    def bag(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    want = {}
    for d, w in held.items():
        for k, item in items.items():
            b, best = bag(item), 0
            for s in range(max(len(w) - len(item), 0) + 1):
                a = bag(w[s : s + len(item)])
                best = max(best, (a & b).total() / (a | b).total())
            if best >= 0.8:
                want[d, k] = pytest.approx(best)
    docs, bench = (spark.createDataFrame([(k, " ".join(w)) for k, w in x.items()], f"{c} long, text string") for x, c in ((held, "doc_id"), (items, "item_id")))
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(docs, bench).collect()} == want and (15, 0) in want


def test_radius_loses_no_pair(spark):
    """Distances of windows and items of similarity just over 0.8, at several lengths: none above the radius."""
    rng, rows = np.random.default_rng(8), []
    for k in range(1500):
        n = int(rng.choice([9, 20, 60, 200]))
        most = int(0.2 / 1.8 * n)  # of each side's own shingles
        ids = rng.integers(0, 1 << 62, n + most)
        rows += [(k, side, int(h), 1) for side, hs in (("a", ids[:n]), ("b", ids[most:])) for h in hs]
    prints = decontaminate.fingerprint(spark.createDataFrame(rows, "k long, side string, v long, c long").withColumn("h", F.xxhash64("v")), ["k", "side"])
    far = prints.where("side = 'a'").select("k", F.col("print").alias("p")).join(prints.where("side = 'b'"), "k").select(F.max(F.bit_count(F.col("p").bitwiseXOR(F.col("print"))))).first()[0]
    assert 12 < far <= 27


def test_learnt_scores(spark, docs, odd):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = lang_id.identify(big).join(big, "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() / out.count() > 0.97
    out = quality.classify(big, labels).join(labels, "doc_id").where("held_out")
    assert out.where("quality = predicted").count() / out.count() > 0.9
    und = {r["doc_id"]: r["lang_pred"] for r in lang_id.identify(odd).collect()}
    assert set(und.values()) == {"und"}
    net = lang_id.train(big)
    named = {r["doc_id"]: r["lang_pred"] for r in lang_id.identify(odd, net=net).collect()}
    assert named[1] == named[2] == named[6] == "und" and named[4] in net.labels
    assert all(r["score"] == 0.5 for r in quality.classify(odd, labels.limit(0)).collect())


def test_lm_score(spark, docs, odd):
    """Scores against plain sums: every word's probability from the network's softmaxes over all classes and from counts."""
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, "zx qv " * 50), (-2, "zx qv " * 50)], "doc_id long, text string")).coalesce(1)
    seen = {}
    real = lm_score.learnt

    def learnt(*args):
        seen["v"], seen["net"], *rest = real(*args)
        return seen["v"], seen["net"], *rest

    lm_score.learnt = learnt
    try:
        out = {r["doc_id"]: r for r in lm_score.score(df, most_head=500).collect()}
    finally:
        lm_score.learnt = real
    rows = {d: [int(h) for h in ngram_join.word_hashes(np.frombuffer((t or "").encode(), np.uint8)).view(np.int64)] for d, t in texts(df)}
    n = collections.Counter(w for ws in rows.values() for w in ws)
    total, head, net = sum(n.values()), {}, seen["net"].p
    for w in sorted((w for w in n if n[w] >= max(2, -(-total // 500))), key=lambda w: (-n[w], w)):
        head[w] = len(head)
    klass = {w: head[w] if w in head and head[w] < lm_score.NAMED else lm_score.NAMED + int(lm_score.bucket(np.array([w]))[0]) for w in n}
    mass = collections.Counter()
    for w, c in n.items():
        mass[klass[w]] += c

    def softmax(z):
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    for d in (-1, *list(rows)[:12]):
        want, ks = 0.0, [klass[w] for w in rows[d]]
        for i, w in enumerate(rows[d]):
            side = [ks[i + k] if 0 <= i + k < len(ks) else lm_score.EDGE for k in lm_score.SIDES]
            h = np.tanh(sum(net["emb"][k][c] for k, c in enumerate(side)) + net["h"])
            g, m = divmod(ks[i], lm_score.WIDTH)
            want += np.log(softmax(h @ net["top"] + net["top0"])[g] * softmax(h @ net["low"][g] + net["low0"][g])[m]) + np.log(n[w] / mass[ks[i]])
        assert out[d]["n_tokens"] == len(ks) and out[d]["log_prob"] == pytest.approx(want, rel=1e-4)
        assert out[d]["mean_log_prob"] == (pytest.approx(want / len(ks), rel=1e-4) if ks else None)
    klass = np.array([3, 1, 2, 5])
    e = lm_score.EDGE
    assert lm_score.contexts(klass, np.array([3, 1])).tolist() == [[e, e, 1, 2], [e, 3, 2, e], [3, 1, e, e], [e] * 4]
    none = {r["doc_id"]: r for r in lm_score.score(odd).collect()}
    assert none[1]["n_tokens"] == 0 and none[1]["log_prob"] == 0 and none[1]["mean_log_prob"] is None
    assert lm_score.score(odd.limit(0)).count() == 0 and lm_score.score(odd.where("text is null")).count() == 2


def test_class_prior():
    """The share of positives among unlabelled rows, found without a negative label."""
    rng = np.random.default_rng(6)
    for share in (0.2, 0.5, 0.85):
        pos = rng.normal(1.0, 1, (1500, quality.WIDTH)) * 0.4
        un = np.concatenate((rng.normal(1.0, 1, (int(1500 * share), quality.WIDTH)) * 0.4, rng.normal(-1.0, 1, (1500 - int(1500 * share), quality.WIDTH)) * 0.4))
        rng.shuffle(un)
        assert abs(quality.class_prior(pos, un) - share) < 0.08
        net = quality.fit_nnpu(pos, un, share)
        assert (net.score(pos) > 0.5).mean() > 0.95 and abs((net.score(un) > 0.5).mean() - share) < 0.08


def test_nnpu_slopes():
    """The scorer's slopes against differences; its risk never falls below zero by forgetting the negatives."""
    rng = np.random.default_rng(7)
    x, dz = rng.normal(size=(9, quality.WIDTH)), rng.normal(size=9)
    net = quality.Scorer(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), hidden=4)
    grads = net.backward(x, net.hidden(x), dz)
    for name, at in (("w", (3, 1)), ("b", (2,)), ("v", (1,)), ("c", (0,))):
        value = []
        for step in (1e-5, -2e-5):
            net.p[name][at] += step
            value.append(dz @ (net.hidden(x) @ net.p["v"] + net.p["c"]))
        net.p[name][at] += 1e-5
        assert grads[name][at] == pytest.approx((value[0] - value[1]) / 2e-5, rel=1e-5)


def test_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "some words of an item that nobody has")], "item_id long, text string")
    none, labels = odd.limit(0), spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(none, labels).count() == lang_id.identify(none).count() == telephony.audio_columns(none).count() == licenses.scan(none).count() == 0
    assert decontaminate.contaminated(none, items).count() == 0 and bpe.round_trip(none).columns == ["doc_id", "ids", "decoded"]


def test_places():
    rng = np.random.default_rng(3)
    known = np.unique(rng.integers(-(1 << 62), 1 << 62, 5000))
    asked = np.concatenate((known[::3], rng.integers(-(1 << 62), 1 << 62, 3000)))
    at = {int(w): k for k, w in enumerate(known)}
    assert lm_score.Places(known).of(asked).tolist() == [at.get(int(w), -1) for w in asked]
    assert lm_score.Places(known[:0]).of(asked[:3]).tolist() == [-1] * 3


def test_gradient():
    """The network's slopes against differences of its own loss."""
    rng = np.random.default_rng(2)
    net = lm_score.WindowNet(hidden=5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    c, y = rng.integers(0, lm_score.CLASSES + 1, (40, 4)).astype(np.int16), rng.integers(0, lm_score.CLASSES, 40)
    grads = net.gradient(c, y)
    for name, at in (("top", (2, y[0] // lm_score.WIDTH)), ("low", (y[1] // lm_score.WIDTH, 1, 4)), ("emb", (1, c[3, 1], 2)), ("h", (3,)), ("low0", (y[2] // lm_score.WIDTH, y[2] % lm_score.WIDTH))):
        loss = []
        for step in (1e-3, -2e-3):
            net.p[name][at] += step
            loss.append(-net.log_probs(c, y).mean())
        net.p[name][at] += 1e-3
        assert grads[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, abs=2e-4)


def test_lm_score_learns_from_all(spark):
    """The documents teach the network which word stands between which."""
    df = spark.createDataFrame([(k, "one two three four " * 3000) for k in range(40)], "doc_id long, text string").coalesce(1)
    assert all(r["mean_log_prob"] > -0.5 for r in lm_score.score(df, size=1024).collect())


def test_lm_score_counts_rare_words(spark):
    """Two words outside the head, of one bucket and in one context, differ by their counts; repeated rows get the same."""
    names = [f"w{k}" for k in range(900)]
    by = collections.defaultdict(list)
    for name in names:
        w = lm_score.words_of(np.frombuffer(name.encode(), np.uint8), np.array([0, len(name)]))[0]
        by[int(lm_score.bucket(w)[0])].append(name)
    often, once = max(by.values(), key=len)[:2]
    rows = [(0, "the " * 5000), (1, often), (1, often), (2, once), *((k, often) for k in range(3, 31))]
    out = {r["doc_id"]: r["log_prob"] for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), most_head=64).collect()}
    assert out[1] == pytest.approx(out[2] + np.log(30)) == out[3]


@pytest.mark.parametrize("more", [{}, {"slice_rows": 2, "bucket_groups": 10, "together": 3, "broadcast_rows": 1}])
def test_shards(docs, odd, more):
    for df, k in ((docs, 24), (odd, 3)):
        out = shards.shard(df, k, **more).toPandas()
        rows = texts(df)
        assert len(out) == len(rows) and all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
        assert all(len(set(g["shard"])) == 1 for _, g in out.groupby("text_crc32")) and set(out["law"]) == {"bytes"} and out["grown_shard"].isna().all()
        want = collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
        assert collections.Counter((None if d != d else d, s, c) for d, s, c in zip(out["doc_id"], out["size"], out["text_crc32"])) == want
        if df is docs:  # shares differ by no more than the largest text, which nothing can split
            sums = out.groupby("shard")["size"].sum().reindex(range(k), fill_value=0)
            assert sums.max() - sums.min() <= max(out["size"].max(), 16)
    sizes = np.random.default_rng(1).integers(1, 1000, 400)
    part = shards.differencing(np.stack([sizes, *[np.zeros(400, np.int64)] * 3], 1))[:, 0]
    sums = np.bincount(part, sizes, 4)
    assert sums.max() - sums.min() <= 3
    assert shards.shard(odd.limit(0)).count() == 0


def test_repeats(docs, odd, spark):
    df = docs.select("doc_id", "text").limit(60).unionByName(odd.select("doc_id", "text").where("doc_id is null or doc_id < 7")).unionByName(spark.createDataFrame([(50, "q" * 700), (51, "z" * 200), (52, "é" * 150 + "x" * 90)], "doc_id long, text string"))
    rows = [(d, (t or "").encode()) for d, t in texts(df)]
    seen = collections.Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    want = collections.Counter()
    for d, b in rows:
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                mask[i : i + 200] = True
        want[d, bytes(np.frombuffer(b, np.uint8)[~mask])] += 1
    for kw in ({}, {"hot": 1}, {"lookup_rows": 3}):
        got = repeats.without_repeats(df, **kw).collect()
        assert collections.Counter((r["doc_id"], bytes(r["kept"])) for r in got) == want
    real = queries.table
    queries.table = lambda *_: df
    try:
        got = queries.op8_repeats(spark, "").collect()
    finally:
        queries.table = real
    digests = collections.Counter((d, hashlib.sha256(kept).hexdigest()) for (d, kept), n in want.items() for _ in range(n))
    assert collections.Counter((r["doc_id"], r["kept_sha256"]) for r in got) == digests
    size = collections.Counter((d, len(b)) for d, b in rows)
    assert collections.Counter((r["doc_id"], r["n_bytes"]) for r in got) == size and all(0 <= r["n_removed"] <= r["n_bytes"] and (r["n_spans"] > 0) == (r["n_removed"] > 0) for r in got)
    assert sum(r["n_bytes"] - r["n_removed"] for r in got) == sum(len(kept) * n for (_, kept), n in want.items())
    assert repeats.without_repeats(odd.limit(0)).count() == 0
    assert all(r["kept"] is not None for r in repeats.without_repeats(df, as_text=True).collect())


def test_repeats_beyond_lookup_tables(docs, monkeypatch):
    """Without look-up tables the steps take in no more rows than with them, and find the same."""
    real, seen = repeats.written, []

    def counted(df, name):
        out = real(df, name)
        seen[-1][name] = out[0].count()
        return out

    monkeypatch.setattr(repeats, "written", counted)
    got = []
    for most in (1 << 22, 3):
        seen.append({})
        got.append(sorted((r["doc_id"], bytes(r["kept"])) for r in repeats.without_repeats(docs, lookup_rows=most).collect()))
    assert got[0] == got[1]
    assert "repeats-spans" in seen[1] and all(seen[1][k] == n for k, n in seen[0].items())
    every = sum(len(np.unique(repeats.runs_of(np.frombuffer((t or "").encode(), np.uint8), 200)[3])) for _, t in texts(docs))
    assert seen[1]["repeats-runs"] < every / 2


@pytest.mark.parametrize("n, words", [(0, 24), (5, 24), (70_000, 24), (70_000, 11)])
def test_sieve(spark, n, words):
    """A sieve passes all it was made of, and few others unless it is too small."""
    x = np.random.default_rng(n).integers(0, 1 << 64, n + 50_000, np.uint64)
    df = spark.createDataFrame(pa.table({"v": x[:n].view(np.int64)}))
    sieve = repeats.sieve_of(df, "v", words).value
    assert len(sieve) <= 1 << words and repeats.passed(sieve, x[:n]).all()
    assert words < 24 or repeats.passed(sieve, x[n:]).mean() < 0.05


@pytest.mark.parametrize("length", [40, 60, 200])
def test_merged_transforms(length):
    """Merged transforms against plain sorting: the order, the common prefixes, and which strings start elsewhere too."""
    rng = random.Random(length)
    for _ in range(12):
        base = ["".join(rng.choice("ab") for _ in range(rng.randrange(length, 3 * length))).encode() for _ in range(3)] + [b"a" * 2 * length]
        some = []
        for _ in range(rng.randrange(1, 12)):
            b = rng.choice(base)
            x = bytearray(b[rng.randrange(len(b) - length + 1) :])
            x[rng.randrange(len(x))] ^= rng.random() < 0.5
            some.append(bytes(x))
        cuts = sorted({0, len(some), *(rng.randrange(len(some)) for _ in range(rng.randrange(4)))})
        shards = repeats.transforms(some, cuts, length)
        seen = collections.Counter(s[i : i + length] for s in some for i in range(len(s) - length + 1))
        for a, b, s, mask in zip(cuts, cuts[1:], shards, repeats.repeated(shards, length)):
            for x, at in zip(some[a:b], s.base):
                assert mask[at : at + len(x) + 1].tolist() == [seen[x[i : i + length]] > 1 for i in range(len(x) - length + 1)] + [False] * length
        which, common = repeats.merged_transform(shards, length // repeats.SYMBOL)
        used, line = [0] * len(shards), []
        for j in which:
            s, k = shards[j], shards[j].order[used[j]]
            i = int(np.searchsorted(s.base, k, "right")) - 1
            line.append(some[cuts[j] + i][k - s.base[i] :][:length])
            used[j] += 1
        ends, size = sum(len(x) < repeats.SYMBOL for x in line), repeats.SYMBOL
        assert all(x >= y or len(x) < length or len(y) < length for x, y in zip(line[ends + 1 :], line[ends:]))
        for x, y, c in zip(line[ends:], line[ends + 1 :], common[ends + 1 :]):
            if len(x) == len(y) == length:
                assert c == next((k for k in range(length // size) if x[size * k : size * k + size] != y[size * k : size * k + size]), length // size)


def plain_adpcm(block):
    """One block, sample by sample."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step, move = int(telephony.STEPS[index]), 0
            move = (2 * (code & 7) + 1) * step >> 3
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + int(telephony.INDEX_STEP[code & 7])))
            out.append(value)
    return out


def plain_law(code, a_law):
    """One code, by the segments of the recommendation."""
    if a_law:
        code ^= 0x55
        segment, value = code >> 4 & 7, (code & 15) << 4
        value = value + 8 if segment == 0 else (value + 264) << (segment - 1)
        return value if code & 0x80 else -value
    code = ~code & 255
    value = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return -value if code & 0x80 else value


def test_telephony(odd, spark):
    assert telephony.MU_LAW[[0xFF, 0x7F, 0x80, 0x00]].tolist() == [0, 0, 32124, -32124]
    assert telephony.A_LAW[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    assert telephony.MU_LAW.tolist() == [plain_law(c, False) for c in range(256)] and telephony.A_LAW.tolist() == [plain_law(c, True) for c in range(256)]
    blocks = np.random.default_rng(5).integers(0, 256, (40, telephony.BLOCK)).astype(np.uint8)
    blocks[0], blocks[1] = 0xFF, 0x77
    assert telephony.adpcm(blocks).tolist() == [plain_adpcm(b.tolist()) for b in blocks]
    for r in telephony.audio_columns(odd).collect():
        tag, rate, data = telephony.unwav(bytes(r["media"]))
        assert (tag, rate) == (7, 8000) and len(data) % 192 == 0 and data[r["n_bytes"] :].strip(b" ") == b""
        tag, rate, pcm = telephony.unwav(bytes(r["pcm"]))
        assert (tag, rate, len(pcm)) == (1, 16000, 4 * len(data))
    with pytest.raises(ValueError):
        telephony.unwav(b"RIFX")
    real = queries.table
    queries.table = lambda *_: odd
    try:
        got = queries.op9_telephony(spark, "").collect()
    finally:
        queries.table = real
    want = collections.Counter()
    for d, t in texts(odd):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        want[d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert all(r["media_bytes"] > r["payload_bytes"] for r in got) and len({r["payload_sha256"] for r in got}) == len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got})


def test_resampling_keeps_tones():
    """A tone below the old limit comes through at twice the rate; what the doubling adds above it is weak."""
    t = np.arange(4000)
    pcm = (8000 * np.sin(2 * np.pi * 1000 / 8000 * t)).astype(np.int16)
    out = telephony.doubled(pcm)
    assert len(out) == 8000 and out.dtype == np.int16
    want = 8000 * np.sin(2 * np.pi * 1000 / 16000 * np.arange(8000))
    assert np.abs(out[100:-100] - want[100:-100]).max() < 80
    assert telephony.doubled(np.full(50, 32767, np.int16)).max() == 32767 and (telephony.doubled(pcm)[::2] == pcm).all()


def test_pipeline(spark, docs, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "repeated_passages", "leaks", "tokens"]
    stage = dict(corpus_pipeline.STAGES)
    copy = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 10_000)
    noise = spark.createDataFrame([(20_000, "123 456", "en", "s", 7)], docs.schema)
    all_ = docs.unionByName(copy).unionByName(noise)
    kept = stage["language"](spark, all_, SMALL)
    assert kept.columns == docs.columns and kept.where("doc_id = 20000").count() == 0 and kept.count() >= 0.97 * all_.count()
    kept = stage["near_copies"](spark, all_, SMALL)
    assert kept.where("doc_id >= 10000").count() == 1 and kept.schema.names == docs.schema.names
    cut = stage["repeated_passages"](spark, all_, SMALL)
    assert cut.count() == all_.count() and cut.where("n_chars <> length(text)").count() == 0
    clean = stage["leaks"](spark, docs, SMALL)
    hits = {r[0] for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).select("doc_id").collect()}
    assert {r[0] for r in clean.select("doc_id").collect()} == {d for d, _ in texts(docs)} - hits
    # rows without an id, repeated rows, and columns with names that stages use inside
    names = ("kept", "starts", "ends", "n_bytes", "r1", "r2", "stays", "__r1", "c0", "words")
    first = docs.join(decontaminate.contaminated(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")), "doc_id", "left_anti").where("n_chars > 400").select(docs.columns).limit(3)
    leak = docs.where(F.col("doc_id") == min(hits)).withColumn("doc_id", F.lit(None).cast("long"))
    none = first.withColumn("doc_id", F.lit(None).cast("long"))
    edge = first.union(first).union(none).union(leak).union(spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0)], docs.schema))
    edge = edge.select("*", *(F.lit(5).alias(c) for c in names))
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, edge, SMALL).columns == edge.columns and f(spark, edge.limit(0), SMALL).count() == 0, name
    kept = stage["near_copies"](spark, edge, SMALL)
    ids = sorted(r[0] for r in kept.where("n_chars > 0").collect() if r[0] is not None)
    assert len(ids) == len(set(ids)) >= 1 and kept.where("coalesce(text, '') = ''").count() == 2 and kept.where("doc_id is null and text is not null").count() == 1
    assert stage["repeated_passages"](spark, edge, SMALL).count() == edge.count()
    clean = stage["leaks"](spark, edge, SMALL)
    assert clean.count() == edge.count() - 1
    assert stage["tokens"](spark, edge, SMALL).count() == edge.count()
    last = corpus_pipeline.run(spark, SMALL)
    assert set(last.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and 0 < last.count() <= docs.count()


def grouped(sets, num):
    """The least member of each one's class, by comparing all pairs."""
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= num * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            comp[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def test_pipeline_against_brute_force(spark):
    """What run() returns, from what the first stage keeps, by plain Python."""
    import regex
    from tokenizers import Tokenizer

    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SMALL).collect()}
    kept = {d: t for d, t in texts(corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL))}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for d, t in kept.items()}
    first = grouped(sets, 80)
    kept = {d: t for d, t in kept.items() if first[d] == d}
    raw = {d: (t or "").encode() for d, t in kept.items()}
    seen = collections.Counter(b[i : i + 200] for b in raw.values() for i in range(len(b) - 199))
    for d, b in raw.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        at, out = 0, []
        for c in kept[d] or "":
            size = len(c.encode())
            if not gone[at : at + size].all():
                out.append(c)
            at += size
        kept[d] = "".join(out)

    def cut(text):
        return [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]

    def bag(w, size):
        return collections.Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))

    items = [w for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if (w := cut(r["text"] or ""))]
    leaking = set()
    for d, t in kept.items():
        w = cut(t)
        for item in items:
            size = min(5, len(item))
            own = bag(item, size)
            if not own.keys() & bag(w, size).keys():
                continue
            for s in range(max(len(w) - len(item), 0) + 1):
                part = bag(w[s : s + len(item)], size)
                if 100 * (part & own).total() >= 80 * (part | own).total():
                    leaking.add(d)
                    break
    t = Tokenizer.from_file(bpe.default_path())
    want = {}
    for d, x in kept.items():
        if d not in leaking:
            ids = t.encode(x, add_special_tokens=False).ids
            want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())
    assert leaking and got == want


def test_many_keys_are_not_broadcast(spark, monkeypatch):
    """Keys to drop, and representatives whose texts are read, reach the driver only while they are few."""
    sent, few = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.count()) or few(df))
    docs = spark.range(70_000).selectExpr("id as doc_id", "concat('t', id) as text", "id as more").union(spark.sql("select null, null, 7L"))
    keys = docs.where("more % 70 <> 1").select(*common.row_key())
    left = corpus_pipeline.dropped(docs, keys)
    assert left.columns == docs.columns and {tuple(r) for r in left.collect()} == {(k, f"t{k}", k) for k in range(1, 70_000, 70)}
    assert not sent
    assert corpus_pipeline.dropped(docs, keys.limit(9)).count() == 69_992 and sent == [9]
    assert inspect.signature(ngram_join.near_classes).parameters["broadcast_rows"].default <= 1 << 16


def test_queries(spark, docs):
    from tokenizers import Tokenizer

    assert len(queries.QUERIES) == 10 and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    t, want = Tokenizer.from_file(bpe.default_path()), {}
    for d, x in texts(docs):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op2_bpe(spark, SMALL).collect()} == want


def test_slices_hold_words_once_a_batch(monkeypatch):
    """A slice of few distinct words holds less than half of its words' bytes and offsets between batches."""
    monkeypatch.setattr(bpe, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    text = [f" word{k % 500}" for k in range(20_000)]
    held = []

    def fed():
        for _ in range(8):
            words = pa.array([text] * 10)
            yield pa.record_batch({"doc_id": pa.array(range(10)), "part": pa.array([0] * 10, pa.int32()), "octets": pa.array([sum(map(len, text))] * 10, pa.int32()), "words": words})
            size = words.nbytes
            del words
            held.append((pa.total_allocated_bytes(), size))

    out = pa.Table.from_batches(bpe.sliced(pa.int64(), 1 << 30, 4)(fed()))
    docs = out.filter(pa.compute.equal(out["what"], "doc"))
    found = pa.Table.from_batches(bpe.unpacked(out.filter(pa.compute.equal(out["what"], "words")).to_batches()))
    word = dict(zip(found["code"].to_pylist(), found["word"].to_pylist()))
    assert docs["at"].to_pylist() == list(range(80)) and all([word[c] for c in bpe.from_planes(b)] == text for b in docs["codes"].to_pylist()[::9])
    assert held[-1][0] - held[0][0] < 7 * held[0][1] / 2


@pytest.mark.parametrize("mixed", [False, True])
def test_assembling_takes_few_bytes_a_word(mixed):
    """A slice's texts come out whole, whatever the order of their pieces; with its ids a word takes less than 64 bytes on the way (99 before)."""
    t, rng = bpe.tokenizer(bpe.default_path()), random.Random(5)
    some = [f" word{k} é" for k in range(500)]
    ids = [e.ids for e in t.encode_batch_fast(some, add_special_tokens=False)]
    parts = [(k // 2, k % 2, np.array(rng.choices(range(500), k=4096))) for k in range(128)]
    rows = rng.sample(parts, len(parts)) if mixed else parts
    texts = pa.table({"at": [r[0] for r in rows], "part": pa.array([r[1] for r in rows], pa.int32()), "doc_id": [100 + r[0] for r in rows], "codes": pa.array([bpe.planes(r[2]) for r in rows], pa.binary())})
    texts = pa.Table.from_batches(texts.to_batches(max_chunksize=30))
    codes = rng.sample(range(500), 500)
    blobs = [[bpe.planes(np.array(x)) for x in (c, [len(ids[k]) for k in c], [i for k in c for i in ids[k]])] for c in (codes[:100], codes[100:])]
    found = pa.table({n: pa.array([b[k] for b in blobs], pa.binary()) for k, n in enumerate(("code", "length", "ids"))})
    shape = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    run = bpe.assembled(bpe.default_path(), shape, None)
    run(texts.slice(0, 1), found)  # the vocabulary's pieces
    tracemalloc.start()
    try:
        out = run(texts, found)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out["doc_id"].to_pylist() == list(range(100, 164))
    for k, (i, x) in enumerate(zip(out["ids"].to_pylist(), out["decoded"].to_pylist())):
        want = [int(c) for r in parts[2 * k : 2 * k + 2] for c in r[2]]
        assert i == [j for c in want for j in ids[c]] and x == "".join(some[c] for c in want)
    assert peak < 64 * 128 * 4096, peak


def test_windows():
    """All windows of a text and what they hold, against plain slices."""
    rows = [b"", b"ab", b"x" * 256, b"y" * 257, bytes(range(256)) * 5, "é".encode() * 300]
    data, off = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    owner, begin, real = lang_id.windows(off, 256)
    got = [(int(o), bytes(x)) for o, x in zip(owner, lang_id.cut(data, begin, real, 256))]
    step = 256 - lang_id.OVER
    want = [(k, b[i : i + 256].ljust(256)) for k, b in enumerate(rows) for i in range(0, max(1, len(b) - lang_id.OVER), step)]
    assert got == want


def test_long_texts_in_chunks(spark, monkeypatch):
    """Runs that chunks cut are found all the same."""
    rng = np.random.default_rng(9)
    a, b = ("".join(map(chr, rng.integers(97, 123, n))) for n in (3000, 900))
    df = spark.createDataFrame([(1, a + b), (2, b[3:] + a[:500]), (3, "q" * 2500)], "doc_id long, text string").coalesce(1)
    want = {r["doc_id"]: bytes(r["kept"]) for r in repeats.without_repeats(df).collect()}
    text = np.frombuffer((a + b).encode(), np.uint8)
    whole = repeats.runs_of(text, 200)
    monkeypatch.setattr(repeats, "CHUNK", 512)
    cut = repeats.runs_of(text, 200)
    assert cut[1].sum() == whole[1].sum() == len(text) - 199 and len(cut[0]) > len(whole[0])
    assert want[1] == a[500:].encode() + b[:3].encode() and want[2] == want[3] == b""
    assert {r["doc_id"]: bytes(r["kept"]) for r in repeats.without_repeats(df).collect()} == want


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100)])
def test_bands_share_a_key(num, den):
    """Linked sets share a tile key at every size, also where groups are empty; unlinked ones of few hashes seldom do."""
    rng, bands, met = np.random.default_rng(5), ngram_join.Bands(num, den), 0
    for size in [*range(5, 60), 100, 400, 1000, 3000]:
        for _ in range(8):
            pool = np.unique(rng.integers(0, 1 << 64, 3 * size, np.uint64, endpoint=False))
            rng.shuffle(pool)
            most = size * (den - num) // (den + num)  # of each side's own hashes
            a, b, c = np.sort(pool[:size]), np.sort(pool[most : size + most]), np.sort(pool[2 * size :])
            both = ngram_join.overlap(a, b)
            if den * both >= num * (2 * size - both) and most:
                assert np.intersect1d(bands.keys(a), bands.keys(b)).size
            less = np.sort(pool[: size * num // den + 1])  # a part of a, as large as a link needs
            if len(less) < size:
                assert np.intersect1d(bands.keys(a), bands.keys(less)).size
            met += size >= 100 and np.intersect1d(bands.keys(a), bands.keys(c)).size > 0
    assert met <= 1
