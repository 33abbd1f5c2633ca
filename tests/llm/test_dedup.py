import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import components, exact_dedup, golay, near_dedup, simhash

from .helpers import awkward, empty


def brute_exact(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault(text or "", []).append(doc)
    out = []
    for doc, text in rows:
        ids = groups[text or ""]
        known = [x for x in ids if x is not None]
        out.append((doc, max(known) if known else None, len(ids), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [3, 64, 4096])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, block, weak):
    df = awkward(spark)
    # a route of four values makes different blocks share routes
    options = {"route": lambda b: F.pmod(F.xxhash64(b), F.lit(4))} if weak else {}
    got = exact_dedup.exact_dedup(df, block_bytes=block if block > 3 else 7, **options).collect()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute_exact(rows)
    assert sum(r.kept for r in got) == len({t or "" for _, t in rows})


def test_exact_dedup_random(spark):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randrange(12)))) for i in range(300)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), block_bytes=2).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute_exact(rows)


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    assert exact_dedup.drop_exact_copies(empty(spark)).count() == 0


def test_golay_keys_find_all_within_four_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, size=400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, size=int(rng.integers(0, 5)), replace=False):
            b[i] ^= np.uint64(1 << int(bit))

    def keys(v):
        found = {}
        for at, key in zip(*(x.tolist() for x in golay.keys(v))):
            found.setdefault(at, set()).add(key)
        return found

    x, y = keys(a), keys(b)
    assert all(x[i] & y[i] for i in range(len(a)))
    words = rng.integers(0, 1 << 23, size=200)
    assert (golay.codewords(words)[:, 0] >= 0).all()


def brute_components(prints, bits):
    label = {}
    for i, (_, p) in enumerate(prints):
        label[i] = i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
                a, b = label[i], label[j]
                for k in label:
                    if label[k] == a:
                        label[k] = b
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[label[i]] = min(doc, least.get(label[i], doc))
    return sorted(((d, f"{p:016x}", least.get(label[i])) for i, (d, p) in enumerate(prints)), key=repr)


def print_of(text, words=4):
    import re

    import xxhash

    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_awkward(spark):
    df = awkward(spark).filter("doc_id is null or doc_id not in (6, 7)")
    got = sorted([(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()], key=repr)
    assert got == brute_components([(r.doc_id, print_of(r.text)) for r in df.collect()], 4)
    assert simhash.simhash_components(empty(spark)).count() == 0
    long = simhash.simhash_components(awkward(spark).filter("doc_id in (6, 7)")).collect()
    assert {r.component_id for r in long} == {6}


@pytest.mark.parametrize("small, cap", [(16, 4096), (2, 4), (2, 60)])
def test_link_fingerprints(spark, monkeypatch, small, cap):
    """Near fingerprints in chains and crowds, with buckets of any size split."""
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(simhash, "BUCKET_ROWS", cap)
    # small batches, so that buckets go on over several
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if cap == 4 else "10000")
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        seed = rng.getrandbits(64)
        for _ in range(40):
            p = seed
            for _ in range(rng.randrange(5)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    fps = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in fps]
    edges = simhash.link_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp bigint"))
    roots = {r.a: r.root for r in components.connected_components(edges).collect()}
    got = brute_groups({p: roots.get(p, p) for p in signed})
    want = brute_groups({s: c for s, (_, _, c) in zip(signed, sorted(brute_components([(i, p) for i, p in enumerate(fps)], 4)))})
    assert got == want


def brute_groups(label):
    groups = {}
    for k, v in label.items():
        groups.setdefault(v, set()).add(k)
    return sorted(map(sorted, groups.values()))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.a: r.root for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.connected_components(edges.limit(0)).count() == 0


def near_copies():
    rng = random.Random(11)
    rows, n = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 300))]
        for _ in range(rng.choice([1, 2, 40])):
            words = list(base)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
            rows.append((n, " ".join(words)))
            n += 1
    return rows


@pytest.mark.parametrize("pair, block", [(24, 256), (3, 8)])
def test_near_dedup(spark, monkeypatch, pair, block):
    monkeypatch.setattr(near_dedup, "PAIR_BUCKET", pair)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = near_copies()
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r.doc_id: r.keep_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == dict(enumerate(label))


def test_near_dedup_awkward(spark):
    got = near_dedup.near_dedup(awkward(spark)).collect()
    keep = {r.doc_id: r.keep_id for r in got}
    assert len(got) == 11
    assert (keep[1], keep[2], keep[3], keep[4], keep[5], keep[6], keep[7]) == (1, 1, 3, 3, 3, 6, 6)
    assert near_dedup.near_dedup(empty(spark)).count() == 0
    assert near_dedup.drop_near_copies(empty(spark)).count() == 0


def test_stages_keep_one_row_of_each_group(spark):
    """Repeated rows, ids that several texts share, and null ids."""
    rnd = random.Random(5)
    long = [" ".join(rnd.choice("abcdefghijkl") + str(rnd.randrange(99)) for _ in range(60)) for _ in range(6)]
    near = [t + " end" for t in long]
    rows = [
        (1, long[0], "a"), (1, long[0], "b"), (None, long[0], "c"), (None, long[0], "c"),  # one group
        (7, long[1], "a"), (7, long[2], "b"), (7, near[2], "b"),  # one id, two groups
        (None, long[3], "a"), (None, long[3], "a"), (None, near[3], "b"),  # null ids only
        (2, near[4], "a"), (None, long[4], "b"), (2, long[5], "c"),
        (5, None, "n"), (5, "", "n"), (5, None, "n"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n string").repartition(3)
    exact = exact_dedup.drop_exact_copies(df)
    assert exact.columns == df.columns
    got = sorted(((r.doc_id, r.text or "") for r in exact.collect()), key=repr)
    want = [(1, long[0]), (7, long[1]), (7, long[2]), (7, near[2]), (None, long[3]), (None, near[3]), (2, near[4]), (None, long[4]), (2, long[5]), (5, "")]
    assert got == sorted(want, key=repr)
    for docs in (exact, df):
        got = [(r.doc_id, next((i for i in range(6) if r.text in (long[i], near[i])), None)) for r in near_dedup.drop_near_copies(docs).collect()]
        assert sorted(got, key=repr) == sorted([(1, 0), (7, 1), (7, 2), (None, 3), (2, 4), (2, 5), (5, None)], key=repr)
    assert [len(exact_dedup.drop_exact_copies(awkward(spark)).collect()), len(near_dedup.drop_near_copies(awkward(spark)).collect())] == [7, 6]
