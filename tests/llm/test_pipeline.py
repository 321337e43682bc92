"""Each stage of the pipeline against brute force, and the pipeline as a whole."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from siltspark.llm import secrets, toxicity  # noqa: E402

RNG = random.Random(41)
SYLLABLES = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "un", "er")]
INSULTS = ["blorgish", "snargling", "wretchy"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, score double, _score double, _key string, _row int, _id int, secrets string, k long"


def words(n):
    return ["".join(RNG.choice(SYLLABLES) for _ in range(RNG.randint(1, 4))) for _ in range(n)]


def document(n, extra=()):
    w = words(n)
    for x in extra:
        w.insert(RNG.randrange(len(w)), x)
    return " ".join(w)


ITEM = words(30)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts, toxic = [], []
    for i in range(240):
        bad = i % 4 == 0
        texts.append(document(RNG.randint(60, 120), [RNG.choice(INSULTS) for _ in range(6)] if bad else ()))
        toxic.append(int(bad))
    base = document(150)
    texts += [base, base, base + " more", " ".join(words(2) + base.split()[2:]), " ".join(words(20) + ITEM + words(20)), " ".join(words(900) + ITEM[:14] + words(900))]
    texts += [document(60, ["password=hunter22x", "AKIA" + "Q7ZX" * 4]), document(60, ["é" * 3, "f00dfeedf00dfeedf00dfeed"]), None, "", " ", document(5000)]
    rows = [(i, t, "en", "s", len(t or ""), 0.25, 0.5, "key", 7, 8, "mine", 9) for i, t in enumerate(texts)]
    rows += [rows[3], (None, document(70), None, None, None, None, None, None, None, None, None, None), (None, None, "en", "s", None, 1.0, None, None, None, None, None, None)]
    to = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(i, x, x) for i, x in enumerate(toxic)] + [(3, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int").write.parquet(f"{to}/labels.parquet")
    spark.createDataFrame([(1, " ".join(ITEM)), (2, None), (None, "x y")], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return to


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], folder).write.parquet(f"{folder}/stage{k}")
        out.append(spark.read.parquet(f"{folder}/stage{k}"))
        assert name == "packing" or out[-1].columns == docs.columns
    return [sorted(map(tuple, x.collect()), key=str) for x in out]


def test_toxic_documents_go(spark, folder, stages):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(toxicity.labelled_rows(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    score = dict(zip([r[1] for r in stages[0]], model.score([(r[1] or "").lower().encode() for r in stages[0]])))
    assert stages[1] == [r for r in stages[0] if score[r[1]] < 0.7]
    bad = {r[1] for r in stages[0] if r[1] and any(x in r[1] for x in INSULTS)}
    gone = {r[1] for r in stages[0]} - {r[1] for r in stages[1]}
    assert len(gone & bad) >= 0.8 * len(bad) and len(gone - bad) <= 0.03 * len(stages[0])


def test_one_of_each_group_stays(stages):
    sets = []
    for r in stages[1]:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    ids = {}
    for x, r in zip(label, stages[1]):
        ids.setdefault(x, []).append(r[0])
    least = {x: min((i for i in v if i is not None), default=None) for x, v in ids.items()}
    assert stages[2] == [r for x, r in zip(label, stages[1]) if r[0] == least[x]]


def test_contaminated_documents_go(stages):
    find, windows = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall, {tuple(ITEM[i : i + 13]) for i in range(18)} | {("x", "y")}
    keep = []
    for r in stages[2]:
        w = find((r[1] or "").lower())
        hit = {p for i in range(len(w)) for n in (2, 13) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            keep.append(r)
    assert stages[3] == keep and len(keep) == len(stages[2]) - 1


def test_secrets_are_replaced(stages):
    assert len(stages[4]) == len(stages[3])
    want = []
    for r in stages[3]:
        text = r[1] and secrets.redact(r[1], secrets.find_spans(r[1]))
        want.append((r[0], text, *r[2:4], len(text) if text != r[1] else r[4], *r[5:]))
    assert stages[4] == sorted(want, key=str) and sum(a[1] != b[1] for a, b in zip(stages[3], want)) == 2
    assert not [r for r in stages[4] if r[1] and re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|password *=", r[1])]
    assert all(r[10] in ("mine", None) for r in stages[4])


def test_packed_pieces_are_the_texts(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in stages[4]:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.setdefault((r[0], len(ids)), []).append(ids)
    total = 0
    for doc_id, start, length, crc, doc_tokens, _, _ in stages[5]:
        assert any(zlib.crc32(np.array(x[start : start + length], "<u4").tobytes()) == crc for x in want[(doc_id, doc_tokens)])
        total += length
    assert total == sum(len(x) for v in want.values() for x in v)


def test_the_whole_pipeline_and_empty_tables(spark, folder, stages, tmp_path):
    digest = lambda rows: sorted((str(r[0]), r[1], r[4]) for r in rows if r[1] == 0)
    assert digest(map(tuple, corpus_pipeline.run(spark, folder).collect())) == digest(stages[5])
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
