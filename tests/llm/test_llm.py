"""The corpus operators against brute force, and on nulls, empty texts, repeated rows, empty tables and clashing columns."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltspark.llm import decontaminate, langid, lm, neardup, packing, passages, secrets, topk, toxicity, urls
from siltspark.llm.components import components, spanning
from siltspark.llm.words import hash_words, packed, unpacked

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, score double, secrets string"
RNG = random.Random(5)
WORDS = ["w%d" % i for i in range(400)]
PASSAGE = " ".join(RNG.choice(WORDS) for _ in range(70))


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


BASE = text(300)
ROWS = [
    (1, BASE, "en", 1.0, "x"), (2, BASE, "en", 1.0, "x"), (3, BASE + " extra", "de", 1.0, "x"), (4, None, "en", None, None), (5, "", None, None, None), (6, " \t\n", "en", 0.0, ""),
    (7, "Hi", "fr", 0.0, ""), (8, text(120) + " " + PASSAGE + " " + text(90), "en", 0.0, ""), (9, text(60) + " " + PASSAGE + " " + text(30), "de", 0.0, ""),
    (None, text(80), "en", 0.0, ""), (10, text(30), None, 0.0, ""), (10, None, None, 0.0, ""), (11, text(20_000), "en", 0.0, ""), (7, "Hi", "fr", 0.0, ""), (12, "12 34 !!", "es", 0.0, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_hash_words_is_of_the_words():
    texts = ["Ab c  ab\tC", None, "", "é É x\x0by", "a" * 200_000 + " b"]
    h, o = hash_words(pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert list(np.diff(o)) == [len(w) for w in want]
    seen = {}
    for words, lo in zip(want, o):
        for w, x in zip(words, h[lo:]):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    a = np.arange(1000, dtype=np.uint64) ** 3
    assert (unpacked(packed(a), np.uint64, 1000) == a).all()


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "ITEMS", 128)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (600, 8))  # many ties
    rows = [(i, [int(v) for v in r]) for i, r in enumerate(x)] + [(20, [int(v) for v in x[20]]), (7, [3] * 8), (7, [3] * 8), (None, [1] * 8), (900, None), (901, [None] * 8), (902, [1]), (20, [1]), (40, []), (903, []), (904, [])]
    items = spark.createDataFrame(rows, "id long, vec array<long>").repartition(3)
    got = {}
    for r in topk.topk_inner_product(items.where("id % 20 = 0"), items, 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    everyone = [(i, v) for i, v in rows if i is not None and v is not None and None not in v]
    for q in range(0, 600, 20):
        want = []
        for vec in {tuple(v) for i, v in everyone if i == q}:
            scored = sorted((-sum(a * b for a, b in zip(vec, v)), i) for i, v in everyone if i != q and len(v) == len(vec))[:7]
            want += [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
        assert sorted(got[q]) == sorted(want)
    assert topk.topk_inner_product(items.limit(0), items, 3).count() == topk.topk_inner_product(items, items.limit(0), 3).count() == 0


def test_nra_stops_early_and_is_exact():
    rng = np.random.default_rng(4)
    x = np.floor(rng.standard_normal((1500, 4)) ** 5 * 50).astype(np.int64)  # few items lead their lists
    q, ids = x[:70], np.arange(1500)[::-1].copy()
    rows, found, scores, read = topk.nra(ids[:70], q, ids, x, 5)
    full = q @ x.T
    for i in range(70):
        want = sorted((-x, j) for x, j in zip(full[i], ids) if j != ids[i])[:5]
        assert list(zip(-scores[rows == i], found[rows == i])) == want
    assert read.min() <= 0.2 and (read < 1).mean() >= 0.3
    big = np.full((3, 2), 2**29)
    assert topk.nra(np.array([9]), big[:1], np.arange(3), big, 2)[2].tolist() == [2**59, 2**59]
    with pytest.raises(ValueError):
        topk.nra(np.array([9]), big[:1] * 4, np.arange(3), big, 2)


def test_op1_leaves_out_what_is_not_finite(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [0.25, 1.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [None, 1.0]), (20, [-1.0, 2.0]), (40, [nan, 1.0]), (6, [0.25, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, topk.op1_exact_topk(spark, str(tmp_path)).collect()))
    v = {i: [int(np.floor(64 * a)) for a in e] for i, e in rows if i in (0, 1, 6, 20)}
    want = []
    for q in (0, 20):
        s = sorted((-(v[q][0] * v[i][0] + v[q][1] * v[i][1]), i) for i in v if i != q)
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert got == want


def test_language(spark, docs, none):
    import re as _re

    train = spark.createDataFrame([(i, w * 20, lang) for i, (w, lang) in enumerate([("the and of ", "en"), ("der und die ", "de"), ("les des une ", "fr"), ("los del una ", "es")] * 6)], "key long, text string, lang string")
    model = langid.fit(train)
    got = langid.identify(spark.createDataFrame([("und die der",), ("una los del",), (None,), ("12 !",)], "text string"), model).collect()
    assert [r.lang_pred for r in got] == ["de", "es", "und", "und"] and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(docs, model).count() == len(ROWS) and langid.identify(none, model).count() == 0
    empty = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert _re.match("und", "und")


def test_toxicity_held_out(spark, docs, none):
    rng = random.Random(8)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "un", "er")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    clean = lambda n: [word() for _ in range(n)]
    insults = ["blorgish", "snargling", "wretchy", "grumpwort"]

    def bad():
        x = clean(rng.randint(60, 150))
        for _ in range(6):
            x.insert(rng.randrange(len(x)), rng.choice(insults))
        return x

    rows = [(i, " ".join(bad() if i % 3 == 0 else clean(rng.randint(60, 150))), int(i % 3 == 0)) for i in range(600)]
    model = toxicity.fit(spark.createDataFrame(rows[:400], "key long, text string, toxic int"))
    got, want = model.score([t.encode() for _, t, _ in rows[400:]]), np.array([y for _, _, y in rows[400:]])
    assert ((got >= 0.7) & (want == 1)).sum() >= 0.8 * want.sum() and ((got >= 0.7) & (want == 0)).sum() <= 0.03 * (want == 0).sum()
    scored = {(r.doc_id, r.text): r.score for r in toxicity.score(docs, model).collect()}
    assert len(toxicity.score(docs, model).collect()) == len(ROWS) and toxicity.score(none, model).count() == 0
    assert scored[(4, None)] == scored[(5, "")] == scored[(6, " \t\n")] < 0.7 and all(0 <= x <= 1 for x in scored.values())
    learned_nothing = toxicity.fit(spark.createDataFrame([(1, "x", 1)], "key long, text string, toxic int"))
    assert set(learned_nothing.score([b"", b"x"])) == {0.5}  # below the 0.7 of a rejection
    assert set(toxicity.fit(spark.createDataFrame([], "key long, text string, toxic int")).score([b"", b"x"])) == {0.0}


def test_toxicity_windows():
    assert toxicity.windows(b"") == [] and toxicity.windows(b" a  b ") == [b" a b "]
    assert toxicity.windows(b"a b c d e") == [b" a b c d ", b" e "] and toxicity.windows(b"a b c d e", 1) == [b" a b c d ", b" b c d e "]
    a, b = (toxicity.trained([b"%s %d" % (w, i * 7919) for i in range(500)], 600, 10) for w in (b"snargling", b"gentle"))
    w = [b" snargling ", b" gentle ", b" x "]
    assert len(a) == len(b) == 600 and list(toxicity.Distance(a, b)(w)) == list(-toxicity.Distance(b, a)(w))


def brute_contamination(docs, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out = []
    for doc_id, t in docs:
        w, hit, found = find(lower(t)), set(), set()
        for item, x in items:
            v = find(lower(x))
            for win in [v[s : s + 13] for s in range(max(1, len(v) - 12))] if v else []:
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit.update(range(s, s + len(win)))
                        found |= set() if item is None else {str(item)}
        out.append((doc_id, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_copies_do_not_fill_the_samples(spark, monkeypatch):
    texts = ["alpha beta %s" % i for i in range(20)]
    rows = [(i, t, lang) for lang, o in (("en", 0), ("de", 100)) for i, t in enumerate(texts, o)] + [(1, texts[1], "en")] * 300
    seen = {}
    monkeypatch.setattr(langid, "Model", lambda x, labels: seen.update(lang=sorted(labels)))
    langid.fit(spark.createDataFrame(rows, "key long, text string, lang string").repartition(4), 10)
    assert seen["lang"] == ["de"] * 10 + ["en"] * 10
    monkeypatch.setattr(toxicity, "Model", lambda toxic, ordinary: seen.update(toxic=toxic, ordinary=ordinary))
    rows = [(k, t, int(lang == "en")) for k, t, lang in rows]
    toxicity.fit(spark.createDataFrame(rows, "key long, text string, toxic int").repartition(4), 10)
    assert len(set(seen["toxic"])) == 10 and len(seen["ordinary"]) == 10
    d = spark.createDataFrame([(i, "text %d" % i) for i in range(40)] + [(2, "text 2")] * 300, "doc_id long, text string").repartition(4)
    got = toxicity.labelled_rows(d, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"), 10).collect()
    assert len(got) == len({r.key for r in got}) <= 20


def test_contamination(spark, docs, none):
    items = [(1, PASSAGE), (2, "w1 W2"), (3, None), (4, ""), (5, " ".join(BASE.split()[50:70]).upper()), (None, " ".join(BASE.split()[100:120]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, sorted(r.hit_items), r.contaminated) for r in decontaminate.contamination(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(brute_contamination([(r[0], r[1]) for r in ROWS], items), key=str)
    assert decontaminate.contamination(none, bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}
    bad = sum(r[4] for r in got)
    assert decontaminate.clean_documents(docs, bench).count() == len(ROWS) - bad and 0 < bad < len(ROWS)


def test_contamination_past_the_broadcast_bound(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    test_contamination.__wrapped__(spark, docs, docs.limit(0)) if hasattr(test_contamination, "__wrapped__") else test_contamination(spark, docs, docs.limit(0))


@pytest.mark.parametrize(("rows", "hot_parts", "most_bytes"), [(0, 10_000, 1 << 20), (0, 0, 1 << 20), (0, 0, -1), (100_000, 10_000, -1)])
def test_contamination_with_one_word_in_every_window(spark, monkeypatch, rows, hot_parts, most_bytes):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(decontaminate, "HOT_PARTS", hot_parts)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most_bytes)
    docs = [(i, "rare the " + "of " * 12 + "the rare" if i % 3 else "the " * (i % 40)) for i in range(60)] + [(None, "the " * 20), (7, None), (8, "")]
    items = [(1, "the " + "of " * 12), (2, "the " * 15), (3, "of the"), (4, "rare")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, sorted(r.hit_items), r.contaminated) for r in decontaminate.contamination(d, b).collect()]
    assert sorted(got, key=str) == sorted(brute_contamination(docs, items), key=str)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [r.asDict() for r in packing.pack(docs, path).collect()]
    want = {}
    for r in ROWS:
        want.setdefault(r[0], []).append(t.encode(r[1] or "", add_special_tokens=False).ids + [1])
    used = {}
    for r in rows:
        ids = [x for x in want[r["doc_id"]] if len(x) == r["doc_tokens"]][0]
        assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in used.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048 and (at & (at - 1)) == 0
    assert sum(r["length"] for r in rows) == sum(len(x) for v in want.values() for x in v)
    assert packing.pack(none, path).count() == 0


def brute_lm(rows):
    """base_score and score of ``(id, text, train, fold)`` rows by plain counting."""
    words = {i: (t or "").lower().split() + ["</s>"] for i, t, _, _ in rows}
    one, two = {}, {}
    for i, _, train, _ in rows:
        for h, w in zip(["<s>", *words[i]], words[i]) if train else []:
            one[w], two[(h, w)] = one.get(w, 0) + 1, two.get((h, w), 0) + 1
    n, v = sum(one.values()), len(one)
    seen = lambda h: one.get("</s>" if h == "<s>" else h, 0)
    bucket = lambda c: int(np.floor(np.log2(c))) + 1 if c > 0 else 0
    share = lambda c, of: int(np.round(4 * np.log2(c / of))) if c > 0 and of > 0 else -1000
    cells = {}
    for i, _, train, fold in rows:
        for h, w in zip(["<s>", *words[i]], words[i]) if train and fold else []:
            x = (bucket(seen(h) - 1), share(two[(h, w)] - 1, seen(h) - 1), share(one[w] - 1, max(1, n - 1)))
            cells[x] = cells.get(x, 0) + 1
    weights = lm.learn_weights([(*x, k) for x, k in cells.items()], v)
    base, score = {}, {}
    for i in words:
        base[i] = sum(np.log10((one.get(w, 0) + 1) / (n + v + 1)) for w in words[i])
        p = 0.0
        for h, w in zip(["<s>", *words[i]], words[i]):
            a, b, c = weights[bucket(seen(h))]
            p += np.log10(a * two.get((h, w), 0) / max(1, seen(h)) + b * one.get(w, 0) / max(1, n) + c / (v + 1))
        score[i] = p
    return one, n, base, score


def test_lm(spark, none, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 3000)  # several chunks, groups and ranges
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(WORDS[: 5 + i]) for _ in range(rng.randrange(1, 60))) if i % 9 else None, i % 3 != 2, i % 3 == 1) for i in range(150)]
    docs = spark.createDataFrame([(*r, not r[2]) for r in rows], "doc_id long, text string, train boolean, fold boolean, held_out boolean").repartition(5)
    count, n, base, score = brute_lm(rows)
    got = {r.doc_id: r for r in lm.lm_scores(docs).collect()}
    assert len(got) == len(rows)
    for i, t, _, _ in rows:
        tokens = [*(t or "").lower().split(), "</s>"]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(w in count for w in tokens), n)
        assert abs(got[i].base_score - base[i]) < 1e-6 and abs(got[i].score - score[i]) < 1e-6
    empty = docs.limit(0)
    assert lm.lm_scores(empty).count() == 0 and lm.lm_scores(docs.withColumn("train", F.lit(None).cast("boolean"))).count() == 150


def test_counts_beyond_32_bits():
    keys = np.array([5, 9], np.uint64)
    row = {"range": 0, "coarse": 0, "grp": 0, "kind": 0, "n": 2, "keys": packed(np.diff(keys, prepend=np.uint64(0))), "counts": packed(np.array([2**40, 1], np.int64))}
    t = pa.Table.from_pylist([row, row | {"grp": 1}], lm._ASKED)
    got = lm._totals(t).to_pylist()
    assert [unpacked(x["counts"], np.int64, 2).tolist() for x in got] == [[2**41, 2]] * 2 and got[0]["tokens"] == 2**41 + 2


def test_near_duplicates(spark, docs, none):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    n = len(set(zip(*[BASE.split()[k:] for k in range(3)])))
    assert got[(1, n)] == (1, True) and got[(2, n)] == (1, False) and got[(3, n + 1)] == (1, False)
    assert got[(4, 0)] == (4, True) and got[(7, 1)] == (7, True)
    assert neardup.near_duplicates(none).count() == 0
    rows = []
    for g in range(3):
        base = text(100).split()
        for k in range(60):
            w = list(base)
            for _ in range(k % 5):
                w[RNG.randrange(100)] = RNG.choice(WORDS)
            rows.append((g * 100 + k, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(98)} for i, t in rows}
    label = {i: i for i in sets}
    for _ in range(6):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == label
    assert neardup.keep_one(docs).columns == docs.columns


def test_blocks_of_a_large_group_meet(monkeypatch):
    sets = [np.unique(np.array([*range(40), 1000 + i], np.uint64)) for i in range(9)]
    u, v = neardup.links(sets, 85)
    assert len(u) == 36 and len(neardup.links(sets, 85, 4)[0]) == 6 + 20


def test_large_groups_meet_their_pivots_first(spark, tmp_path, monkeypatch):
    """Groups of near copies, of several clusters, of chains and of strangers: the same components as all pairs, few rows sent."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    rng = np.random.default_rng(5)
    copies = [[*range(100), 1000 + i] for i in range(200)]
    clusters = [[*range(2000 + 200 * (i % 3), 2100 + 200 * (i % 3)), 5000 + i] for i in range(90)]
    chain = [list(range(7000 + 4 * i, 7100 + 4 * i)) for i in range(60)]
    strangers = [[int(x) for x in rng.integers(10**6, 10**7, 30)] for _ in range(40)]
    near = [[x if rng.random() > 0.07 else int(rng.integers(10**7, 10**8)) for x in range(9000, 9060)] for _ in range(60)]
    groups = [copies, clusters, chain, strangers, near, copies[:1], clusters[:8]]
    rows, want = [], {}
    for g, members in enumerate(groups):
        sets = [np.unique(np.array(m, np.uint64)) for m in members]
        first = len(rows)
        rows += [(first + i, g, len(sets), x.tobytes()) for i, x in enumerate(sets)]
        u, v = neardup.links(sets, 85)
        u, v = spanning(u, v)
        want |= {first + i: first + i for i in range(len(sets))} | dict(zip((u + first).tolist(), (v + first).tolist()))
    frame = spark.createDataFrame(rows, "node long, grp long, size long, shingles binary").repartition(3)
    stars, fate = neardup.star_links(frame, 85, str(tmp_path))
    met = neardup.meetings(frame, fate)
    sent = dict(met.groupBy("grp").count().collect())
    assert 0 not in sent and sent[5] == 1 and sent[6] == 8 and sent[3] == 40 * 5
    edges = met.groupBy("grp", "low", "high").applyInArrow(neardup._confirmed(85), "u long, v long").union(stars)
    got = dict(components(edges, str(tmp_path / "c")).collect())
    assert {n: got.get(n, n) for n in want} == want
    empty = frame.where("node < 0")
    stars, fate = neardup.star_links(empty, 85, str(tmp_path / "e"))
    assert stars.count() == 0 and neardup.meetings(empty, fate).count() == 0


def forest_of(spark, sigs):
    rows = [(n, np.asarray(x, np.uint16).tobytes()) for n, x in sigs]
    return spark.createDataFrame(rows, "node long, sig binary").mapInArrow(neardup._trees, "tree int, key binary, node long")


def linked(spark, forest, parts, folder):
    out = components(neardup.neighbours(forest, 0.65, parts, str(folder)), str(folder) + "/c").collect()
    return {r.node: r.component for r in out}


def test_forest_sorts_by_the_whole_signature(spark, tmp_path):
    # 400 classes share the first 8 values of a tree and little else; the two that agree in 52 values have distant nodes
    rng = np.random.default_rng(1)
    first = neardup._ORDERS[0][:8]
    sigs = rng.integers(0, 1 << 16, (400, 64))
    sigs[399] = sigs[0]
    sigs[399, neardup._ORDERS[0][52:]] += 1
    sigs[:, first] = 7
    forest = forest_of(spark, enumerate(sigs)).where("tree = 0")
    assert linked(spark, forest, 1, tmp_path) == {0: 0, 399: 0}


def test_forest_rows_meet_over_partition_borders(spark, tmp_path):
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 1 << 15, 64)
    sigs = []
    for n in range(12):
        x = sig.copy()
        x[neardup._ORDERS[0][1]] = n
        sigs.append((n, x))
    forest = forest_of(spark, sigs).where("tree = 0")
    assert set(linked(spark, forest, 12, tmp_path)) == set(range(12)) and set(linked(spark, forest, 12, tmp_path / "b").values()) == {0}


def test_regions_are_as_deep_as_they_are_dense():
    rng = np.random.default_rng(6)
    dense = rng.integers(0, 3, (200, 64))
    dense[:, 0] = 9
    rows = np.vstack([rng.integers(10, 1 << 16, (50, 64)), dense, np.tile(dense[:1], (40, 1))]).astype(np.uint16)
    rows = rows[np.lexsort(rows.T[::-1])]
    got = neardup.regions(np.zeros(len(rows), int), rows, 16)
    depth = {r: next(d for d in range(1, 65) if d == 64 or len({tuple(x) for x in rows[:, :d]}) and (rows[:, :d] == rows[np.flatnonzero(got == r)[0], :d]).all(1).sum() <= 16) for r in set(got)}
    for r, d in depth.items():
        mine = np.flatnonzero(got == r)
        assert (rows[mine, :d] == rows[mine[0], :d]).all() and (len(mine) <= 16 or d == 64)
    assert min(depth.values()) == 1 and max(depth.values()) == 64 and len(set(depth.values())) > 2


def test_a_region_meets_whole(spark, tmp_path):
    # 12 rows share a tree's first value; the first and the last, eleven rows apart, agree in most of the others
    rng = np.random.default_rng(9)
    order = neardup._ORDERS[0]
    sigs = rng.integers(0, 1 << 15, (12, 64))
    sigs[:, order[1]] = np.arange(12)
    sigs[11, order[2:]] = sigs[0, order[2:]]
    sigs[:, order[0]] = 7
    assert linked(spark, forest_of(spark, enumerate(sigs)).where("tree = 0"), 1, tmp_path) == {0: 0, 11: 0}


def test_components(spark, tmp_path):
    u, v = spanning(np.array([5, 3, 9, 1]), np.array([3, 4, 8, 1]))
    assert sorted(zip(u, v)) == [(4, 3), (5, 3), (9, 8)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "u long, v long").repartition(6)
    got = dict(components(chain, str(tmp_path)).collect())
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_secrets(docs, none):
    assert secrets.find_spans('password="abc12" token: abcdefgh AKIA' + "A" * 16) == [(17, 0, 32), (33, 1, 53)]
    assert secrets.find_spans("0" * 24 + " " + "f" * 23) == [(0, 2, 24)]
    assert [k for _, k, _ in secrets.find_spans("x aB3dE6gH9jK2mN5pQ8sT1vW4 y")] == [3]
    assert secrets.find_spans("123e4567-e89b-12d3-a456-426614174000 some-long-hyphenated-word-list 2024-01-02T03:04:05") == []
    assert secrets.redact("a token: abcdefgh b", secrets.find_spans("a token: abcdefgh b")) == "a <secret> b"
    s = "a1b2c3d4e5f6g7h8i9j0k1l2"
    best = max(-sum(p * np.log2(p) for p in np.unique(list(s[i : i + 20]), return_counts=True)[1] / 20) for i in range(len(s) - 19))
    assert abs(secrets.highest_entropy(s) - best) < 1e-9
    assert secrets.scan(docs).count() == len(ROWS) and secrets.scan(none).count() == 0


def brute_spans(text):
    """Base spans by trying every place, and entropy spans of what they leave of candidates, by whole windows."""
    token, value = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")

    def assign(i):
        for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if text[i : i + len(word)].lower() == word:
                j = i + len(word)
                j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] in (":", "="):
                    j += 1
                    while text[j : j + 1] == " ":
                        j += 1
                    k = j + (text[j : j + 1] in ("'", '"') and text[j : j + 1] != "")
                    end = k
                    while end < len(text) and text[end] in value:
                        end += 1
                    if end > k:
                        return end, end - k >= 6
        return None

    def run(i, head, letters, least):
        if not text.startswith(head, i) or not text[i + len(head) : i + len(head) + 1] or text[i + len(head)] not in letters:
            return None
        end = i + len(head)
        while end < len(text) and text[end] in letters:
            end += 1
        return end, end - i >= least

    out = []
    for kind, at in enumerate((assign, lambda i: run(i, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), lambda i: run(i, "", "0123456789abcdef", 24))):
        i = 0
        while i < len(text):
            found = at(i)
            if found and found[1]:
                out.append((i, kind, found[0]))
            i = found[0] if found else i + 1
    covered = {p for lo, _, hi in out for p in range(lo, hi)}
    i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in token:
            j += 1
        pieces, lo = [], None
        for p in range(i, j + 1) if j - i >= 20 else ():
            if p < j and p not in covered:
                lo = p if lo is None else lo
            elif lo is not None:
                pieces.append((lo, p))
                lo = None
        for a, b in pieces:
            s = text[a:b]
            bits = lambda w: -sum(w.count(c) / len(w) * np.log2(w.count(c) / len(w)) for c in set(w))
            if b - a >= 20 and not s.isalpha() and not secrets.ALLOW.fullmatch(s) and max(bits(s[k : k + 20]) for k in range(b - a - 19)) >= secrets.LEAST_BITS[secrets.char_class(s)] - 1e-9:
                out.append((a, 3, b))
        i = max(j, i + 1)
    return sorted(out)


def test_secrets_against_brute_force():
    rng = random.Random(77)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "AKIA", "AKIAAKIA", "=", ": ", " = ", '"', "'", " ", "\n", "é", ".", "deadbeef", "0123456789", "hunter", "-", "_", "/"]
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(1500):
        t = "".join(rng.choice(parts) if rng.random() < 0.7 else pick(rng.choice(["ABCXYZ0189", "0123456789abcdef", "abcXYZ019+/=", "xyz"]), rng.randrange(1, 40)) for _ in range(rng.randrange(1, 14)))
        assert secrets.find_spans(t) == brute_spans(t), t


def test_language_on_held_out_texts(spark):
    """Two families of two close languages each, told apart on texts that were not learned from."""
    rng = random.Random(15)
    stems = {"en": ["the", "thing", "wash", "tion"], "de": ["der", "schaft", "ung", "eich"], "fr": ["eau", "eux", "ique", "ette"], "es": ["ción", "ado", "ero", "illa"]}
    shared = ["ma", "ri", "lo", "te", "ka"]
    word = lambda lang: "".join(rng.choice(stems[lang] if rng.random() < 0.4 else shared) for _ in range(rng.randint(2, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(25)), lang) for i in range(300) for lang in [("en", "de", "fr", "es")[i % 4]]]
    model = langid.fit(spark.createDataFrame(rows[:160], "key long, text string, lang string"))
    got, score = model.predict([t.encode() for _, t, _ in rows[160:]])
    assert np.mean([a == r[2] for a, r in zip(got, rows[160:])]) >= 0.95 and ((score >= 0) & (score <= 1)).all()


def brute_windows(v, least):
    out = set()
    for c in range(len(v)):
        l = r = c
        while l > 0 and v[l - 1] >= v[c]:
            l -= 1
        while r + 1 < len(v) and v[r + 1] >= v[c]:
            r += 1
        if r - l + 1 >= least:
            out.add((l, c, r))
    return out


def test_secrets_beside_found_ones():
    access, key = "AKIA" + "Q7ZX" * 4, "wJalrXUtnFEMI/K7MDENG+bPxRfiCYzq3vTgKd9s"
    for joint in "/=_":
        t = "see " + access + joint + key + " there"
        assert secrets.redact(t, secrets.find_spans(t)) == "see <secret><secret> there"
    t = key[:30] + "0123abcd" * 3 + key[:30]
    assert [k for _, k, _ in secrets.find_spans(t)] == [3, 2, 3]
    assert [k for _, k, _ in secrets.find_spans("qWzRtY+pLmKjHgFdSaXcVbNe")] == [3]  # no digit
    assert secrets.find_spans("some/path/of/words-and-more") == []


def test_compact_windows():
    rng = np.random.default_rng(1)
    rows = [rng.integers(1, 40 if i % 2 else 10**6, n).astype(np.uint64) for i, n in enumerate((0, 3, 7, 30, 100, 0, 57))]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    row, left, c, right = passages.compact_windows(np.concatenate(rows), offsets, 7)
    for i, v in enumerate(rows):
        assert {(a, b, d) for j, a, b, d in zip(row, left, c, right) if j == i} == brute_windows(v, 7)


def test_repeated_passages(docs, none):
    keyed = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("row_key"), "text")
    got = {(r.row_key, r.start, r.end): r.passage_id for r in passages.repeated_passages(keyed).collect()}
    assert (8, 120, 190) in got and (9, 60, 130) in got and got[(8, 120, 190)] == got[(9, 60, 130)]
    assert {k[0] for k in got} == {1, 2, 3, 8, 9}
    assert passages.repeated_passages(none.select(F.col("doc_id").alias("row_key"), "text")).count() == 0


def variant_first():
    """A 70 % variant of a passage in the first document, and the passage itself in two more; all three minima are shared."""
    rng = random.Random(9)
    w = lambda n: ["w%d" % rng.randrange(10**6) for _ in range(n)]
    passage = w(60)
    variant = ["x" if i in (14, 44) else x for i, x in enumerate(passage)]
    return [(k, " ".join(w(40) + p + w(40))) for k, p in enumerate((variant, passage, passage), 1)]


def test_passages_meet_beside_a_variant(spark, monkeypatch):
    docs = variant_first()
    got = {r.row_key for r in passages.repeated_passages(spark.createDataFrame(docs, "row_key long, text string").repartition(3)).collect()}
    assert {2, 3} <= got
    # and where windows of one hash are too many to compare all
    monkeypatch.setattr(passages, "PAIRS", 1)
    got = {r.row_key for r in passages.repeated_passages(spark.createDataFrame(docs, "row_key long, text string").repartition(3)).collect()}
    assert {2, 3} <= got


def test_every_exact_repeat_is_covered(spark):
    """Against brute force: every word inside a 50-word stretch that another document has is inside a passage."""
    rng = random.Random(31)
    w = lambda n: ["v%d" % rng.randrange(60) for _ in range(n)]
    blocks, line = [w(n) for n in (46, 50, 51, 58, 75, 140)], w(30)
    rows = []
    for k in range(40):
        parts = [x for _ in range(rng.randrange(1, 4)) for x in (w(rng.randrange(0, 60)), rng.choice(blocks), line if rng.random() < 0.5 else [])]
        rows.append((k, " ".join(x for p in parts for x in p)))
    rows += [(40, rows[3][1]), (41, rows[3][1].upper()), (41, rows[3][1].upper()), (42, None), (43, ""), (44, " ".join(w(49)))]
    words = {k: (t or "").lower().split() for k, t in rows}
    having = {}
    for k, x in words.items():
        for i in range(len(x) - 49):
            having.setdefault(tuple(x[i : i + 50]), set()).add(k)
    spans, ids = {k: set() for k in words}, {}
    for r in passages.repeated_passages(spark.createDataFrame(rows, "row_key long, text string").repartition(5)).collect():
        assert 0 <= r.start and r.end <= len(words[r.row_key]) and r.end - r.start >= 50 and not spans[r.row_key] & set(range(r.start, r.end))
        spans[r.row_key] |= set(range(r.start, r.end))
        ids |= {(r.row_key, i): r.passage_id for i in range(r.start, r.end)}
    for k, x in words.items():
        for i in range(len(x) - 49):
            same = having[tuple(x[i : i + 50])]
            if len(same) > 1:
                assert spans[k] >= set(range(i, i + 50))
                for j in same:
                    at = next(m for m in range(len(words[j]) - 49) if words[j][m : m + 50] == x[i : i + 50])
                    assert ids[(j, at)] == ids[(k, i)]


def test_similar_stretches():
    a = np.arange(70, dtype=np.uint32)
    b = a.copy()
    b[10:15] = 900 + np.arange(5)
    assert passages.passages(a, b) == [(0, 69, 0, 69)]
    assert passages.passages(a[:60], np.concatenate([a[:30], [999] * 5, a[34:60]]).astype(np.uint32))  # words put in between
    assert passages.passages(a[:56], np.concatenate([a[:8], [999] * 5, a[13:56]]).astype(np.uint32)) == [(0, 55, 0, 55)]  # an edit near an end
    assert not passages.passages(a, np.where(a % 4 == 0, 999, a).astype(np.uint32)) and not passages.passages(a[:45], a[:45]) and not passages.passages(a[:0], a)


def test_urls(spark):
    page = lambda i, u, to=None: (i, u, f'<link rel="canonical" href="{to}">' if to else "<p>", "x", "y")
    rows = [
        page(1, "http://a.net/es/1"), page(2, "http://b.org/x", "http://a.net/es/1"), page(3, "http://c.org/y", "http://b.org/x#f"), page(4, "http://d.com/z", "http://b.org/x"),
        page(5, None), page(6, "no url"), page(7, "http://WWW.example.com/en/?a"), page(8, "http://e.org/"),
    ]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, host string, verdict string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got[1] == ("a.net", "net/es/", "block") and got[7] == ("www.example.com", "www.example.com/en/", "allow")
    assert got[5][:2] == ("", None) and got[8][2] == "allow"
    assert got[2][2] == got[3][2] == "allow" and got[4][2] == "allow"  # d.com is allowed, so its aliases are
    alone = {r.page_id: r.verdict for r in urls.judge(pages.where("page_id <> 4")).collect()}
    assert alone[2] == alone[3] == "block"
    assert urls.judge(pages.limit(0)).count() == 0
    # targets beside the page, by its query, and those that lead nowhere
    near = [page(1, "http://a.net/es/x/1?p"), page(2, "http://b.org/d/e/f", "../g?h"), page(3, "http://b.org/d/g?h", "http://a.net/es/x/1?p"), page(4, "http://b.org/i", "?j"), page(5, "http://b.org/i?j", "../../d/g?h")]
    near += [page(6, "http://c.org/k", "mailto:x"), page(7, "http://c.org/l", "#m"), page(8, "http://c.org/n", "javascript:void"), page(9, "http://b.org", "d/./g?h")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(near, pages.schema)).collect()}
    assert got == {k: "block" if k in (1, 2, 3, 4, 5, 9) else "allow" for k in range(1, 10)}
