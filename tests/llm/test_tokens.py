import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import tokens as T

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(T.piece_model(T.load_ranks(f"{T.VOCABULARIES}/{T.VOCABULARY}")))


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


TEXTS = ["", " ", "Hello  world\n\n", "it's we'll I'M", "<|endoftext|>", "naïve café é", "日本語のテキスト", "​ 　x", "🙂👩🏽‍💻", "a" * 5000, " " * 3000, "\x00\x1c\x1f", "1234 5.6%", "don't\r\n\tstop"]


def test_known_texts(encoder, reference):
    assert encoder.encode(TEXTS) == reference(TEXTS)
    assert encoder.encode([None]) == [[]]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(encoder, reference, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert encoder.encode([text]) == reference([text])


def test_other_vocabulary():
    import tiktoken

    path = f"{T.VOCABULARIES}/byte_bpe_multi_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = T.Encoder(T.piece_model(T.load_ranks(path)))
    texts = [t for t in TEXTS if t]
    assert mine.encode(texts) == [other.encode_ordinary(t) for t in texts]


def test_operator_round_trip_and_nulls(spark, encoder):
    rows = [(k, t, k) for k, t in enumerate([*TEXTS, None, TEXTS[2]])]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids INT").repartition(3)
    got = {r.doc_id: r.ids for r in T.encode_texts(df).collect()}
    assert got[len(TEXTS)] == [] and got[0] == [] and len(got) == len(rows)
    vocabulary = T.load_ranks(f"{T.VOCABULARIES}/{T.VOCABULARY}")
    back = {r.doc_id: r.t for r in T.encode_texts(df).select("doc_id", T.decode_ids("ids", vocabulary).alias("t")).collect()}
    assert back == {k: t or "" for k, t, _ in rows}
    assert {r.doc_id: r.n_tokens for r in T.count_tokens(df).collect()} == {k: len(v) for k, v in got.items()}
    assert T.encode_texts(df.limit(0)).collect() == []


def test_cache_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(T, "CACHE_ENTRIES", 3)
    first = encoder.encode(["one two three four five"])
    assert not encoder.known and encoder.encode(["one two three four five"]) == first
