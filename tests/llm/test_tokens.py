"""Token ids against the public library, appends and edits against encoding anew."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import tokens as T

tokenizers = pytest.importorskip("tokenizers")
PATH = f"{T.FOLDER}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
SIGNS = "aaaabbccdeehiilnoorst   '''\n\t\r   \u0085\x1c\x1f​09²½éßÆ中日한🙂_-=.,!<|>"


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_same_as_the_public_library(public):
    rng, e = random.Random(3), T.encoder()
    for _ in range(3_000):
        s = "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) if rng.random() < 0.8 else "".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(20))
        assert e.encode(s) == public(s), repr(s)
    for s in ("<|endoftext|> x", "a" * 5_000, "=-" * 3_000, " " * 999, "it's they'll I'VE"):
        assert e.encode(s) == public(s)


def test_prefixes_hold_the_encoding_of_every_prefix(public):
    e = T.encoder()
    data = b"internationalisation's"
    p = T.Prefixes(e.v, data)
    for n in range(1, len(data)):
        assert T.Prefixes(e.v, data[:n]).last == p.last[:n]
    p.replace(3, 5, b"XYZ")
    assert p.ids() == T.Prefixes(e.v, data[:3] + b"XYZ" + data[5:]).ids()
    assert T.Prefixes(e.v).ids() == []


def test_edits_of_a_text(public):
    rng, e = random.Random(5), T.encoder()
    for _ in range(300):
        t = T.TextPrefixes(e, "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))))
        for _ in range(4):
            a = rng.randint(0, len(t.text))
            t.replace(a, rng.randint(a, min(len(t.text), a + 5)), "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 6))))
            assert t.ids() == public(t.text)
        t.append("n't end")
        assert t.ids() == public(t.text)


def test_frames(spark, public):
    df = spark.createDataFrame([(1, "hello wörld"), (2, None), (3, ""), (4, " ")], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in df.select("doc_id", T.token_ids(F.col("text")).alias("ids")).collect()}
    assert got == {1: public("hello wörld"), 2: [], 3: [], 4: public(" ")}
    assert df.limit(0).select(T.token_ids(F.col("text"))).count() == 0
