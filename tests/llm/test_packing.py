"""Token ids as tokenizers gives them, added tokens and very long texts included."""

import random

import numpy as np
import pytest

from siltspark.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: plain.encode(text, add_special_tokens=False).ids


END = "<|endoftext|>"


@pytest.mark.parametrize("text", ["", END, f"{END}a", f"a{END}", f"a {END} b", f" {END}{END} \n{END}\t", "<|endoftext|", END.upper(), f"it's{END}'s", f"é{END}漢字", "<|pad|> <|im_start|>"])
def test_added_tokens(encoder, ids, text):
    assert encoder.encode(text).tolist() == ids(text)


def test_mixed_texts(encoder, ids):
    assert encoder.encode is not encoder.slow
    rng = random.Random(7)
    parts = [END, " ", "\n\n", "word", "Wörter", "12345", "'ll", "!!", "漢", "😀", " ", "\r\n\t", "<|", "|>", "\x00"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 20)))
        assert encoder.encode(text).tolist() == ids(text)


def test_a_text_of_a_megabyte(encoder, ids):
    text = ("the quick brown fox " * 40 + END) * 1300
    assert len(text) > 10**6 and encoder.encode(text).tolist() == ids(text)


def test_added_tokens_in_documents(spark, ids):
    rows = [(1, f"a{END}b"), (2, END * 5000), (3, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.doc_tokens for r in got.collect()} == {i: len(ids(t or "")) + 1 for i, t in rows}
    assert np.array_equal(ids(END * 3), [50256] * 3)
