import hashlib
import random
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from quernstone.llm import bpe_heap

from .helpers import awkward, empty
from .test_tokens import odd_texts

JSON = tokenizer_path("byte_bpe_50k.json")
library = Tokenizer.from_file(JSON)


def ids_of(texts):
    ids, ends = bpe_heap._encoder(JSON).all_ids(pa.array(texts, pa.string()))
    starts = [0, *ends.tolist()]
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]


def test_equals_library():
    texts = [*odd_texts(), "a<|endoftext|><|endoftext|>b <|endoftext|", "<|endoftext|>" * 3]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(texts) == want
    codec = bpe_heap.load(JSON)
    assert [codec.encode(t) for t in texts] == want
    assert [codec.decode(ids) for ids in want] == [library.decode(ids, skip_special_tokens=False) for ids in want] == texts


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    assert ids_of([text]) == [library.encode(text, add_special_tokens=False).ids]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=40))
def test_any_ids(ids):
    assert bpe_heap.load(JSON).decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_merges_against_repeated_search():
    """Small random vocabularies, in which merges undercut and overlap, against a search for the least rank after every merge."""
    alphabet = bpe_heap.byte_alphabet()
    rnd = random.Random(5)
    for _ in range(40):
        vocab = {c: i for i, c in enumerate(alphabet)}
        merges, known = [], list("abc")
        for _ in range(12):
            a, b = rnd.choice(known), rnd.choice(known)
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
                known.append(a + b)
        codec = bpe_heap.HeapBpe(vocab, merges)
        rank = {m: i for i, m in enumerate(merges)}
        for _ in range(30):
            word = "".join(rnd.choice("abc") for _ in range(rnd.randrange(25)))
            parts = list(word)
            while found := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]:
                _, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert codec.encode_word(word.encode()) == [vocab[p] for p in parts]


def test_very_long_word():
    rnd = random.Random(6)
    word = "".join(rnd.choice("abcde") for _ in range(300_000))
    start = time.perf_counter()
    got = bpe_heap.load(JSON).encode(word)
    assert time.perf_counter() - start < 20
    assert got == library.encode(word, add_special_tokens=False).ids


def test_awkward(spark):
    df = awkward(spark)
    rows = bpe_heap.encode(df, JSON, with_ids=True)
    want = []
    for r in df.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows.collect()), key=repr) == sorted(want, key=repr)
    back = {r.doc_id: r.text for r in bpe_heap.decode(rows, JSON).collect()}
    assert back[8] == "Straße  größer <|endoftext|> 漢字 \U0001f600" and back[3] == ""
    odd = spark.createDataFrame([(1, None), (2, [None, 464, -1, 99_999, 3290])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.text for r in bpe_heap.decode(odd, JSON).collect()} == {1: None, 2: library.decode([464, 3290])}
    assert bpe_heap.encode(empty(spark), JSON).count() == 0
    assert bpe_heap.decode(odd.limit(0), JSON).count() == 0


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        bpe_heap.load(tokenizer_path("word_bpe_49k.json"))


def test_query(spark, sf_dir):
    from quernstone.llm import registry

    rows = registry.QUERIES["op13_bpe"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
