import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from quernstone.llm import bpe, bpe_codec, piece_table, rans, token_counts, token_files

from .helpers import awkward, empty

JSON, RANKS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(2)
    fixed = ["", " ", "a" * 3000, "ab" * 2000, "  foo   bar \n\n baz\t\tq \0 x\n", " lead", "trail ", "a.b,c..d,,e 1.2,3 it's", "<|endoftext|> x  <|endoftext|>", "a\x85 b", "é!?" * 300]
    noise = ["".join(rnd.choice("aein st \n.'sd1,\t\x1f\xa0²漢") for _ in range(rnd.randrange(60))) for _ in range(400)]
    return fixed + noise


def ids_of(table, texts):
    ids, ends = table.all_ids(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, ends[:-1])]


def test_pieces_equal_library(library):
    texts = odd_texts()
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(token_files._encoder(JSON), texts) == want
    assert list(token_counts._counter(JSON)(pa.array(texts))) == [len(x) for x in want]


def test_rank_queue_equals_library(reference):
    texts = odd_texts()
    got = ids_of(bpe_codec._encoder(RANKS, PATTERN), texts)
    assert got == [reference.encode_ordinary(t) for t in texts]
    codec = bpe.load(RANKS)
    assert [codec.decode(np.array(x, dtype=np.uint32)) for x in got] == [t.encode() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_any_text(reference, text):
    assert ids_of(bpe_codec._encoder(RANKS, PATTERN), [text]) == [reference.encode_ordinary(text)]


def test_ranks_that_undercut():
    """A merge that makes a pair of lower rank than its own comes before the next of its rank."""
    tokens = {bytes([i]): i for i in range(256)} | {b"aab": 256, b"ab": 257, b"aa": 258, b"abab": 259}
    codec = bpe.RankBpe(tokens)
    rnd = random.Random(4)

    def slow(word):
        parts = [bytes([b]) for b in word]
        while True:
            found = [(tokens[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in tokens]
            if not found:
                return [tokens[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    words = ["".join(rnd.choice("aab") for _ in range(rnd.randrange(30))).encode() for _ in range(500)]
    assert [x.tolist() for x in codec.encode(words)] == [slow(w) for w in words]


def test_bitmap():
    bits = bpe.RankBitmap(60_000)
    for r in (59_999, 4096, 63, 64):
        bits.add(r)
    order = []
    while (r := bits.first()) >= 0:
        order.append(r)
        bits.discard(r)
    assert order == [63, 64, 4096, 59_999]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 70_001, 300_000])
def test_rans_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, size=n) % 5000
    table = rans.Frequencies.of_counts(np.bincount(ids, minlength=5000))
    assert (rans.decode_block(rans.encode_block(ids, table), table) == ids).all()


def test_rans_checksum_and_rare_symbols():
    counts = np.ones(5000, dtype=np.int64)
    counts[0] = 10**12
    table = rans.Frequencies.of_counts(counts)
    assert int(table.freq.sum()) == 1 << table.bits and (table.freq > 0).all()
    ids = np.arange(5000)
    block = rans.encode_block(ids, table)
    assert (rans.decode_block(block, table) == ids).all()
    block.words = block.words[:-8] + bytes(8)
    with pytest.raises((ValueError, IndexError)):
        rans.decode_block(block, table)


def test_token_files(spark, library, tmp_path):
    df = awkward(spark)
    token_files.write(df, JSON, f"file://{tmp_path}/f", block_ids=50_000)
    got = token_files.read(spark, f"file://{tmp_path}/f", with_ids=True).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for doc, text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got), key=lambda r: r[1]) == want
    assert token_files.write_and_read(empty(spark), JSON).count() == 0


def test_encode_awkward(spark, reference):
    df = awkward(spark)
    rows = bpe_codec.encode(df, RANKS, PATTERN, with_ids=True)
    want = []
    for r in df.collect():
        ids = np.array(reference.encode_ordinary(r.text or ""), dtype="<u4").tobytes()
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    back = {r.doc_id: r.text for r in bpe_codec.decode(rows, RANKS).collect()}
    assert back[8] == "Straße  größer <|endoftext|> 漢字 \U0001f600" and back[3] == ""
    assert bpe_codec.encode(empty(spark), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = tokenizer_path(name)
    if name.endswith(".json"):
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    df = awkward(spark)
    want = sorted(((r.doc_id, len((r.text or "").encode()), count(r.text or "")) for r in df.collect()), key=repr)
    got = token_counts.token_counts(df, path, limit=100).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.token_counts(empty(spark), path).count() == 0


def test_slices():
    column = pa.array(["a" * 10, None, "b" * 100, "", "c"])
    parts = list(piece_table.slices(column, 20))
    assert [x for a, b in parts for x in range(a, b)] == list(range(5))
