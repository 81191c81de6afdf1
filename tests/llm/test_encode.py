"""Token ids: exact against the tokenizer itself, at every cut, for long unsplit texts and dirty rows."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from geolathe.llm.encode import Codec, encode_tree, join_ids, token_ids

C = Codec()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 1é中\n'sZ.,\t😀", max_size=120), st.integers(1, 60))
def test_tree_equals_whole(text, size):
    parts = [C.encode(text[i : i + size]) for i in range(0, len(text), size)]
    assert encode_tree(C, parts) == C.encode(text)


def test_unsplit_runs():
    rng = random.Random(1)
    for unit in ("a", "ab", " ", "\n", "é1", "xyzzy", "中"):
        text = unit * 4000
        cut = rng.randrange(1, len(text))
        assert join_ids(C, C.encode(text[:cut]), C.encode(text[cut:])) == C.encode(text)


def test_equals_the_other_library():
    import os

    import public_tokenizers as P
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for s in ("Hello  world\n\n x", "<|endoftext|> a", "Zürich 中文 12345", "it's We'LL", "​﻿"):
        assert t.encode(s, add_special_tokens=False).ids == C.encode(s)


def test_rows(spark):
    rng = random.Random(2)
    long = "".join(rng.choice(["word ", "x" * 50, "12 ", "\n", "中文"]) for _ in range(3000))
    texts = [None, "", "  \n", "plain text", "plain text", long, long[:4000] + "a" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, "plain text")], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["ids"]) for r in token_ids(df, piece=500).collect())
    want = sorted((i, C.encode(t) if t else []) for i, t in [*enumerate(texts), (3, "plain text")])
    assert got == want
    assert sorted((r["doc_id"], r["ids"]) for r in token_ids(df).collect()) == want
    assert token_ids(df.limit(0)).collect() == []


def test_every_number_of_pieces(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["word ", "x" * 9, "12 ", "\n", "中文", "é "]) for _ in range(200))[: 7 * n + n % 3] for n in range(40)]
    df = spark.createDataFrame([(str(i), t, "clash", 0) for i, t in enumerate(texts)], "doc_id string, text string, ids string, k int").repartition(3)
    assert {r["doc_id"]: r["ids"] for r in token_ids(df, piece=7).collect()} == {str(i): C.encode(t) for i, t in enumerate(texts)}
