import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quernstone.llm import collocations, registry

from .helpers import LONG, awkward, empty

SCHEMA = "lang string, text string"


def brute(rows, min_count, top):
    counts = defaultdict(Counter)
    n = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        best = []
        for p, a in candidates.items():
            if any(100 * b >= 80 * a for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def random_rows(seed, count=400):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Ä", "B", "b", "\x00", "\xa0x", "漢字", "x\x1cy"]
    gaps = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "!?", " ; "]
    out = []
    for _ in range(count):
        text = "".join(rnd.choice(words[: rnd.choice((3, 8, 37))]) + rnd.choice(gaps) for _ in range(rnd.randrange(40)))
        out.append((rnd.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return out


@pytest.mark.parametrize("seed,min_count,top", [(1, 5, 2000), (2, 2, 40), (3, 30, 2000), (4, 1, 7)])
def test_equals_brute_force(spark, seed, min_count, top):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(collocations.collocations(df, min_count=min_count, top=top)) == brute(rows, min_count, top)


def test_any_order_of_words_gives_the_same(spark, monkeypatch):
    """Few counters, so that most words share one; every word hot; tiny batches that cut pivots."""
    rows = random_rows(7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, 4, 2000)
    monkeypatch.setattr(collocations, "COUNTERS", 2)
    assert rows_of(collocations.collocations(df, min_count=4)) == want
    monkeypatch.setattr(collocations, "HOT", 1_000_000)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 200)
    assert rows_of(collocations.collocations(df, min_count=4)) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert rows_of(collocations.collocations(df, min_count=4)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fragments_hold_every_phrase_once():
    rnd = random.Random(3)
    for _ in range(200):
        rank = np.array([rnd.choice([0, 1, 2, 3, 4, collocations._blank]) for _ in range(rnd.randrange(1, 25))], dtype=np.int32)
        want = Counter()
        for i in range(len(rank)):
            for m in range(2, 5):
                part = rank[i : i + m]
                if len(part) == m and collocations._blank not in part:
                    want[tuple(range(i, i + m))] += 1
        got = Counter()
        for f in collocations.fragments(rank).tolist():
            for a in range(4):
                for b in range(3, 7):
                    if 1 <= b - a <= 3 and min(f[a : b + 1]) >= 0:
                        got[tuple(f[a : b + 1])] += 1
        assert got == want


def test_grouped_with_shared_hashes(monkeypatch):
    rng = np.random.default_rng(4)
    codes = rng.integers(-1, 3, (500, 7)).astype(np.int32)
    weights = rng.integers(1, 9, 500)
    want = Counter()
    for c, w in zip(map(tuple, codes.tolist()), weights.tolist()):
        want[c] += w
    for sort in (np.argsort, lambda x, kind: np.arange(len(x))):
        # in the second round rows of one group lie apart, as if hashes were all equal
        first, sums = collocations.grouped(codes, weights) if sort is np.argsort else _with_equal_hashes(codes, weights, monkeypatch)
        assert dict(zip(map(tuple, codes[first].tolist()), sums.tolist())) == want


def _with_equal_hashes(codes, weights, monkeypatch):
    class Flat(np.ndarray):
        def astype(self, kind, **more):
            return np.zeros(len(self), dtype=kind) if kind is np.uint64 else super().astype(kind, **more)

    return collocations.grouped(codes.view(Flat), weights)


def test_tokens():
    words, numbers, of = collocations.tokens(pa.array(["A b.c", None, "", "x\t\ty"]))
    assert [words[i].as_py() for i in numbers.tolist()] == ["a", "b", ".", "c", ".", ".", ".", "x", "y", "."]
    assert of.tolist() == [0] * 5 + [1, 2] + [3] * 3


def test_awkward(spark):
    df = awkward(spark)
    rows = [(r.lang, r.text) for r in df.collect()]
    got = rows_of(collocations.collocations(df, min_count=2))
    assert got == brute(rows, 2, 2000)
    assert any(r[2] == "the quick brown fox" for r in got) and any("thing" in r[2] for r in got if r[0] == "en")
    assert collocations.collocations(empty(spark)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", " . ")], SCHEMA)).collect() == []
    assert len(LONG) > 200_000


def test_large_counts(spark):
    """Products beyond 64 bits."""
    big = 9_000_000_000_000
    candidates = spark.createDataFrame([("en", "a b", 2, big)], "lang string, phrase string, size int, a bigint")
    frequent = spark.createDataFrame([("en", "a", big), ("en", "b", big + 1)], "lang string, word string, f bigint")
    row = collocations.scored(candidates, frequent).first()
    assert row.score == 2_000_000 * big // (2 * big + 1)


def test_query(spark, sf_dir):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(registry.QUERIES["op12_collocations"](spark, sf_dir)) == brute(rows, 30, 2000)
