"""Sharding, mixing, search, classifiers and the pipeline: laws, brute force and held-out accuracy."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from ledgerlens.llm import catalog, hash_forest, mixing, quality_cnn, sharding, toxicity
from ledgerlens.llm.registry import table

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n long, rate double, row string, size int, taken int, "
          "shard int, label int")


def frame(spark, rows):
    """``(doc_id, text, source)`` rows with extra columns whose names clash with what the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, 1, 2.0, "x", 3, 4, 5, 6) for i, t, s in rows], SCHEMA).repartition(3)


def corpus(seed=1, docs=300):
    r = random.Random(seed)
    lines = [" ".join(r.choice(["alpha", "beta", "gamma", "déjà"]) for _ in range(12)) + str(i) for i in range(80)]
    rows = []
    for i in range(docs):
        t = None if i % 50 == 7 else "" if i % 50 == 8 else "\n".join(r.sample(lines, r.randint(1, 6)))
        rows.append((i, t, r.choice(["b", "b", "b", "a", "é", None])))
    rows += [(900 + i, rows[0][1], "b") for i in range(100)]
    return rows + [(None, "x y", "a"), (0, rows[0][1], "b"), (0, rows[0][1], "b"), (901, "long " * 20000, "c")]


@pytest.mark.parametrize("docs", [0, 300])
def test_sharding_law_and_slots(spark, docs):
    rows = corpus(docs=300)[:docs] if docs < 300 else corpus()
    got = sharding.shard(frame(spark, rows).where(f"{docs} > 0"), shards=24).collect()
    assert len(got) == len(rows)
    per = Counter(r.shard for r in got)
    sizes = [per.get(s, 0) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(0 <= r.shard < 24 for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_sharding_keeps_linked_documents_together(spark):
    r = random.Random(4)
    rows = []
    for g in range(48):          # 48 clusters of 10 documents that share lines
        lines = [f"cluster {g} line {j} " + "x" * 40 for j in range(6)]
        rows += [(g * 10 + d, "\n".join(r.sample(lines, 4) + [f"own line {g} {d} " + "y" * 40]), "s") for d in range(10)]
    where = {x.doc_id: x.shard for x in sharding.shard(frame(spark, rows)).collect()}
    pairs = [(g * 10 + a, g * 10 + b) for g in range(48) for a in range(10) for b in range(a)]
    cut = sum(where[a] != where[b] for a, b in pairs) / len(pairs)
    assert cut < 0.45            # 0.96 if dealt at random


def water(sizes, weights, total):
    target = {s: 0.0 for s in sizes}
    capped = set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        target = {s: 2.0 * sizes[s] if s in capped else left * weights[s] / w for s in sizes}
        more = {s for s in sizes if s not in capped and target[s] > 2 * sizes[s]}
        if not more:
            return target
        capped |= more


def test_mix_meets_targets(spark):
    rows = corpus()
    got = mixing.mix(frame(spark, rows)).select("row", "doc_id", "size", "source_size", "target", "taken", "copies").collect()
    assert len(got) == len(rows)
    sizes, taken, target, ssize = Counter(), Counter(), {}, {}
    for r in got:
        s = r.row.source
        assert r.size == len((r.row.text or "").split()) and 0 <= r.taken <= 2 * r.size
        assert r.taken == r.copies * r.size
        sizes[s] += r.size
        taken[s] += r.taken
        target[s], ssize[s] = r.target, r.source_size
    order = sorted([s for s in sizes if s is not None]) + [None]
    want = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for s in sizes:
        assert ssize[s] == sizes[s] and target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - want[s]) <= max(r.size for r in got if r.row.source == s) / 2 + 1
    again = mixing.mix(frame(spark, rows)).select("doc_id", "size", "taken").collect()
    assert Counter(map(tuple, again)) == Counter((r.doc_id, r.size, r.taken) for r in got)
    mixed = mixing.apply(frame(spark, rows))
    assert mixed.columns == frame(spark, rows).columns
    words, texts = Counter(), {r[1] for r in frame(spark, rows).select("doc_id", "text").collect()}
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
        assert r.text in texts                    # no document is cut
    assert words == Counter({s: n for s, n in taken.items() if n})
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0


def test_mix_by_whole_copies_round_a_long_document(spark):
    """Sources in which one document holds a seventh of the words, one with a single document, one with repeated rows.
    Where nearly all is drawn too little may follow the long document to fill its gap."""
    rows = []
    for i in range(900):
        rows.append({"doc_id": i, "text": " ".join(["w"] * (20 + i % 17)), "source": f"s{i % 3}"})
    for i in range(3):
        rows.append({"doc_id": 1000 + i, "text": " ".join(["v"] * 1500), "source": f"s{i}"})
    rows += [{"doc_id": 2000, "text": "a b c d e f g", "source": "t"}]
    rows += [{"doc_id": 3000, "text": "x y z", "source": "u"}] * 40
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, source string")
    for share in (0.3, 0.55, 0.8, 1.1, 1.5, 1.9):
        taken, target = Counter(), {}
        for r in mixing.mix(docs, share=share).select("row.source", "taken", "target", "size", "copies").collect():
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert r.taken == r.copies * r.size <= 2 * r.size
        for s in ("s0", "s1", "s2"):
            assert abs(taken[s] - target[s]) <= (40 if share < 1.9 else 750), (share, s, taken[s], target[s])
        assert abs(taken["t"] - target["t"]) <= 4
        assert abs(taken["u"] - target["u"]) <= 2


def nearest(rows, k=5):
    """Brute force over (id, vector) rows that take part."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_forest_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    want = nearest(rows)
    got = defaultdict(dict)
    for r in catalog.queries()["op6_hash_prefix_forest"](spark, SF).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want)
    hits = 0
    for q, w in want.items():
        assert sorted(got[q]) == list(range(1, len(w) + 1))
        scores = [got[q][i][1] for i in sorted(got[q])]
        assert scores == sorted(scores, reverse=True)
        hits += len({v for v, _ in w} & {v for v, _ in got[q].values()})
    assert hits >= 0.95 * 5 * len(want)


def test_forest_recall_beyond_one_window(spark, monkeypatch):
    r = np.random.default_rng(0)
    monkeypatch.setattr(hash_forest, "WINDOW", 64)
    centre = r.standard_normal((40, 32))
    x = centre[r.integers(0, 40, 4000)] + 0.6 * r.standard_normal((4000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for y in hash_forest.search(df).collect():
        got[y.query_id].add(y.vec_id)
    want = nearest(rows)
    assert sum(len({v for v, _ in w} & got[q]) for q, w in want.items()) >= 0.9 * 5 * len(want)


@pytest.mark.parametrize("n", [3000, 9000])
def test_forest_recall_in_a_dense_cluster(spark, monkeypatch, n):
    r = np.random.default_rng(n)
    monkeypatch.setattr(hash_forest, "WINDOW", 16)
    x = r.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    dense = r.permutation(n)[: n // 3]          # a third of the rows at cosine .96
    x[dense] = r.standard_normal(64) / 8 + 0.2 * x[dense]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = defaultdict(set)
    for y in hash_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[y.query_id].add(y.vec_id)
    want = {q: w for q, w in nearest(rows).items() if q in set(dense.tolist())}
    assert sum(len({v for v, _ in w} & got[q]) for q, w in want.items()) >= 0.97 * 5 * len(want)


def test_forest_edge_cases(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (50, [1.0, 0.0, 0.0]), (7, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [2.0, 0.0, 0.0]),
            (5, None), (6, [0.0, 0.0, 0.0]), (8, [1.0, None, 0.0]), (9, [1.0, float("nan"), 0.0]), (10, [1.0, 2.0]),
            (None, [1.0, 1.0, 1.0]), (100, None), (3, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "a", 2) for i, v in rows], "vec_id long, embedding array<double>, q int, ids string, d int")
    got = defaultdict(list)
    for r in hash_forest.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, round(r.score, 9)))
    assert got == {0: [(1, 4, 1.0), (2, 7, 1.0), (3, 50, 1.0), (4, 3, 0.0)], 50: [(1, 0, 1.0), (2, 4, 1.0), (3, 7, 1.0), (4, 3, 0.0)]}
    assert hash_forest.search(df.limit(0)).count() == 0


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    y = np.asarray(labels) == 1
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def toxic_corpus(seed, n):
    r = random.Random(seed)
    v = ["".join(r.choice(["an", "er", "th", "on", "re", "sh"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    bad, docs, labels = ["stupid", "trash", "clown"], [], []
    for i in range(n):
        w = [r.choice(v) for _ in range(r.randint(20, 200))]
        toxic = int(r.random() < 0.25)
        if toxic:
            for _ in range(max(1, len(w) // 50)):
                w[r.randrange(len(w))] = r.choice(bad)
        docs.append((i, " ".join(w), "s"))
        labels.append((i, int(r.random() < 0.5), toxic, "z"))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_corpus(1, 900)
    extra = [(None, "stupid trash clown stupid", "s"), (5000, None, "s"), (5001, "", "s"), (5002, "an er " * 20000, "s"), (5002, "an er " * 20000, "s")]
    known = spark.createDataFrame([*labels, (None, 1, 1, "z"), (7000, None, None, "z"), (0, 1, labels[0][2], "z")],
                                  "doc_id long, quality int, toxic int, text string")
    got = toxicity.score(frame(spark, docs + extra), known).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: t for i, _, t, _ in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert auc([r.score for r in held], [truth[r.doc_id] for r in held]) > 0.97
    assert len({r.score for r in got if r.doc_id == 5002}) == 1
    kept = toxicity.reject(frame(spark, docs), known)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted == 0 and r.doc_id in truth}
    none = toxicity.score(frame(spark, docs[:5]), known.limit(0)).collect()
    assert [r.score for r in none] == [0.0] * 5
    assert toxicity.score(frame(spark, docs).limit(0), known).count() == 0


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = toxic_corpus(2, 300)
    schema = "doc_id long, quality int, toxic int, text string"
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, z) for i, q, t, z in labels]
    a, b = (toxicity.score(frame(spark, docs), spark.createDataFrame(x, schema)).collect() for x in (labels, flipped))
    assert {(r.doc_id, r.score) for r in a} == {(r.doc_id, r.score) for r in b}


def test_expressions_of_the_calibration_fold_are_learnt(spark):
    docs, labels = toxic_corpus(3, 400)
    fold = (lambda i: zlib.crc32(str(i).encode()) % 5)
    docs = [(i, t + " qzxvkj qzxvkj qzxvkj" if fold(i) == 1 and toxic else t, s)
            for (i, t, s), (_, _, toxic, _) in zip(docs, labels)]
    new = next(i for i in range(9000, 9100) if fold(i) == 0)
    asked = docs + [(new, "an er th qzxvkj qzxvkj", "s")]
    got = toxicity.score(frame(spark, asked), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))
    assert got.where(f"doc_id = {new}").first().llr_stretch > 0.5


def test_every_counted_ngram_keeps_its_ratio(spark):
    r = random.Random(6)
    grams = sorted({r.randrange(1 << 40) for _ in range(200_000)})
    rows = [(g, n, 0) if r.random() < 0.3 else (g, 0, n) for g in grams for n in [r.randint(1, 3)]]
    rated = toxicity.model(spark.createDataFrame(rows, "gram long, t long, o long")).toArrow()
    table_, back = toxicity.tables(rated["key"].to_numpy(), rated["llr"].to_numpy())
    some = np.array(grams)
    have = table_[some]
    assert not np.isnan(have).any() and len(back[some >> 8]) == len(some)
    unseen = np.array(sorted({r.randrange(1 << 40) for _ in range(100_000)} - set(grams)))
    assert np.isnan(table_[unseen]).all()               # backs off
    toxic = np.array([t > 0 for _, t, _ in rows])
    assert have[toxic].min() > 0 > have[~toxic].max()   # no ratio mixed with another's


@pytest.mark.parametrize("unit", [1, 32 << 20])
def test_units_find_the_ratios_of_their_texts(spark, monkeypatch, unit):
    import pyarrow as pa
    monkeypatch.setattr(toxicity, "UNIT", unit)         # units of one batch, and of several
    r = random.Random(8)
    texts = [None, "", "a"] + ["".join(r.choice("abc ") for _ in range(r.randint(1, 60))) for _ in range(2400)]
    grams = sorted({int.from_bytes(bytes(r.choice(b"abc ") for _ in range(5)), "big") for _ in range(300)})
    back = sorted({-1 - (g >> 8) for g in grams})
    rows = [(k, r.random() - 0.5) for k in grams + back] + [(toxicity.SEAL, 0.0)]
    model = spark.createDataFrame(rows, "key long, llr float")
    docs = spark.createDataFrame(list(enumerate(texts)), "unit int, text string").coalesce(1)
    got = toxicity.lookup(docs, "text", model, lambda b, x: [b.column(0), *x.T], "unit int, a double, b double, c double").collect()
    keys, llr = np.array([k for k, _ in rows]), np.array([v for _, v in rows], np.float32)
    want = toxicity.features(pa.array(texts, pa.large_string()), *toxicity.tables(keys, llr))
    assert sorted(x.unit for x in got) == list(range(len(texts)))
    assert np.allclose([x[1:] for x in sorted(got)], want)


def test_python_steps_are_parted_by_a_shuffle(spark):
    """A task with two Python steps takes two workers, which share an executor's memory for as long as it lives."""
    from pyspark.sql import functions as F

    from ledgerlens.llm import ngram_join
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 40, 3)], "doc_id long, toxic int")
    known = toxicity.labelled(docs, labels, "toxic", "doc_id", "text")
    counted = toxicity.count(known.withColumn("held", F.lit(False)))
    found = spark.createDataFrame([(i, [1, 2, 3 + i]) for i in range(40)], "k long, elements array<long>")
    pairs = spark.createDataFrame([(i, i + 1, 3, 3) for i in range(0, 38, 2)], "a long, b long, an long, bn long")
    met = ngram_join._meet(pairs, found, "elements", lambda m, n: 2, bounded=True)
    assert sorted(map(tuple, met.collect())) == [(i, i + 1, 3, 3) for i in range(0, 38, 2)]
    assert counted.count() and counted.collect()
    for df, joins in ((counted, 1), (met, 2)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("SortMergeJoin") == joins and "BroadcastHashJoin" not in plan


def test_cnn_gradients_match_differences():
    import pyarrow as pa
    from ledgerlens.llm import _words as W
    d = random.Random(7)
    texts = pa.array(["".join(d.choice("abcdefgh ") for _ in range(n)) for n in (700, 1500, 5)] + ["xyz " * 200], pa.large_string())
    y = np.array([1, 0, 1, 0], np.float32)
    net = {k: v.astype(np.float64) for k, v in quality_cnn.initial(3).items()}
    raw, hops = quality_cnn.layout(*W.text_buffers(texts))

    def loss(n):
        p = quality_cnn.forward(n, raw, hops)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = quality_cnn.gradients(net, raw, hops, y)
    r = np.random.default_rng(0)
    for k in net:
        for _ in range(5):
            at = tuple(r.integers(0, s) for s in net[k].shape)
            at = (int(raw[r.integers(0, 100)]), *at[1:]) if k == "embed" else at
            up, down = ({n: v.copy() for n, v in net.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert g[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=2e-4)


def test_cnn_score_does_not_depend_on_the_batch():
    import pyarrow as pa
    net = quality_cnn.initial(1)
    texts = ["a" * 1000, "", None, "hello world " * 300, "b" * 255, "c" * 256, "d" * 257]
    whole = quality_cnn.predict(net, pa.array(texts, pa.string()))
    for t, p in zip(texts, whole):
        assert quality_cnn.predict(net, pa.array([t], pa.string()))[0] == pytest.approx(p, abs=1e-5)
    assert whole[1] == whole[2]


def test_quality_on_held_out_rows(spark):
    r = random.Random(3)
    v = ["".join(r.choice(["an", "er", "th", "on", "re", "sh"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(700):
        good = int(r.random() < 0.7)
        w = [r.choice(v) for _ in range(r.randint(40, 150))]
        docs.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), "s"))
        labels.append((i, good, 0))
    docs += [(None, "an er th", "s"), (5000, None, "s"), (5001, "", "s"), (5002, "an er " * 30000, "s")]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_cnn.score(frame(spark, docs), known).collect()
    assert len(got) == len(docs) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    truth = {i: q for i, q, _ in labels}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert auc([x.score for x in held], [truth[x.doc_id] for x in held]) > 0.97
    assert [x.score for x in quality_cnn.score(frame(spark, docs[:3]), known.limit(0)).collect()] == [1.0] * 3


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    rows = [r.asDict() for r in docs.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "sharding"]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.stored(stage(spark, frames[-1], SF), name))
    for f in frames[:-1]:
        assert f.columns == docs.columns
    ids = [Counter(r.doc_id for r in f.select("doc_id").collect()) for f in frames]
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:]))
    toxic = {r.doc_id for r in toxicity.score(docs, table(spark, SF, "labels")).collect() if r.predicted}
    assert set(ids[1]) == {r["doc_id"] for r in rows} - toxic
    assert max(ids[4].values()) <= 2 and ids[4] == ids[5]
    size = Counter(r.shard for r in frames[-1].collect())
    assert max(size.values()) - min(size.values()) <= 1


def test_ngrams_are_cut_from_small_chunks():
    """A Python worker's peak stays its size while it waits: megabyte chunks took 38 and 81 MB here."""
    import tracemalloc
    import pyarrow as pa
    r = random.Random(5)
    texts = pa.array([None, ""] + ["".join(r.choice("abcdefgh ") for _ in range(4000)) for _ in range(1000)])
    kind = np.arange(len(texts)) % 4
    peaks = []
    for run in (lambda: toxicity._distinct([texts, texts]), lambda: [len(u) for u, _ in toxicity._counted(texts, kind)]):
        tracemalloc.start()
        run()
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert peaks[0] < 20 and peaks[1] < 40
    small = pa.array([None, "", "ab", "Abc abc", "abc abcd"])
    want = {}
    for i, t in enumerate(small.to_pylist()):
        p = f" {(t or '').lower()} ".encode()
        for j in range(len(p) - 4):
            want.setdefault(int.from_bytes(p[j:j + 5], "big"), [0] * 4)[kind[i]] += 1
    (u, n), = toxicity._counted(small, kind[:5])
    assert dict(zip(u.tolist(), n.tolist())) == want
    assert sorted(toxicity._distinct([small, small]).to_pylist()) == sorted(want)
