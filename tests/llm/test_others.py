import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import chat_format, language_id, license_scan, mixing, pivot_search, registry

from ..oracle import connect, same_rows
from .helpers import awkward, empty


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    same_rows(registry.QUERIES[name](spark, sf_dir), connect(sf_dir).sql(registry.ORACLE_SQL[name]))


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.fit_and_identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    row = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.avg(F.col("rejected").cast("double")).alias("out")).first()
    assert row.right >= 0.95 and row.out <= 0.03


def test_language_awkward(spark):
    got = language_id.fit_and_identify(awkward(spark)).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0.0 for i in (3, 4, 5, 9))
    assert all(0.0 <= r.score <= 1.0 for r in got)
    assert not by[None].held_out
    assert language_id.fit_and_identify(empty(spark)).count() == 0
    unlabelled = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.fit_and_identify(unlabelled).collect()} == {"und"}


def test_known_languages_keep_their_rows(spark):
    docs = awkward(spark).withColumns({c: F.lit(c) for c in ("score", "lang_pred", "rejected", "held_out", "__lang0", "__SCORE0")})
    got = language_id.keep_known(docs, min_margin=0.0)
    assert got.columns == docs.columns
    rows = got.collect()
    # the two texts without a letter, the null and the empty one go
    assert sorted(((r.doc_id, r.name) for r in rows), key=repr) == sorted([(1, "x"), (2, None), (2, None), (6, "y"), (7, "y"), (8, "z"), (None, "z")], key=repr)
    assert {r.score for r in rows} == {"score"} and {r.lang for r in rows} <= {"en", "de"}
    assert language_id.keep_known(empty(spark)).count() == 0


def naive_sizes(data, dictionaries):
    """Compressed bytes by the library alone: stretches of all but the tail, and the tail's average."""
    import zstandard

    def size(content, level, match, part):
        params = zstandard.ZstdCompressionParameters.from_level(
            level, dict_size=len(content), source_size=2048, min_match=match, write_checksum=0, write_content_size=0, write_dict_id=0
        )
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=1), compression_params=params).compress(part))

    at = max(0, len(data) - 256)
    if at and b" " in data[at:-1]:
        at = data.index(b" ", at) + 1
    words = data[at:].split(b" ")
    step = -(-len(words) // 2)
    ends = [b" ".join(words[i:]) for i in range(0, len(words), step)]
    out = []
    for d in dictionaries:
        third = -(-len(d) // 3)
        bank = [(d, 7, 4), (d, 12, 3), *((d[i : i + third].ljust(8), 12, 3) for i in range(0, len(d), third))]
        fine = [size(*b, e) / len(e) for b in bank for e in ends]
        weight = [len(e) for _ in bank for e in ends]
        tail = sum(f * w for f, w in zip(fine, weight)) / sum(weight) * (len(data) - at)
        out.append(sum(size(d, 7, 4, data[:at][i : i + 2048]) for i in range(0, at, 2048)) + tail)
    return out


def test_language_equals_naive_compression():
    rnd = random.Random(4)
    makes = {x: ["".join(rnd.choice(a) for _ in range(rnd.randrange(2, 9))) for _ in range(400)] for x, a in (("xx", "abcdefgh"), ("yy", "ijklmnop"), ("zz", "aeioubcd"))}
    prose = lambda x, n: " ".join(rnd.choice(makes[x]) for _ in range(n))
    dictionaries = tuple((x, prose(x, 3000).encode()) for x in makes)
    model = language_id.Classifier(dictionaries)
    texts = [prose(x, n) for x in makes for n in (1, 2, 5, 30, 400, 3000)]
    texts += [t[:n].strip() for t in (prose("xx", 200), prose("yy", 200)) for n in (254, 255, 256, 257, 258)] + ["abc" * 400, "é" * 300]
    for text in texts:
        sizes = naive_sizes(language_id.normalised(text).encode(), [d for _, d in dictionaries])
        order = sorted(range(3), key=lambda i: sizes[i])
        lang, score = model.predict(text)
        assert score == pytest.approx((sizes[order[1]] - sizes[order[0]]) / sizes[order[1]], abs=1e-9)
        assert lang == dictionaries[order[0]][0] or sizes[order[0]] == pytest.approx(sizes[order[1]])
    for five in (texts[18:23], texts[23:28]):
        scores = [model.predict(t)[1] for t in five]
        assert max(scores) - min(scores) < 0.03  # alike on both sides of a tail's length
    # equal sizes go to the first; a dictionary may be tiny
    twins = language_id.Classifier((("b", b"same words"), ("a", b"same words"), ("c", b"x")))
    assert twins.predict("same words") == ("b", 0.0)


def test_stretches_of_whole_texts_are_learned(spark):
    text = "anfang " * 600 + "mitte " * 600 + "ende " * 600
    rows = [(i, t, "de") for i, t in enumerate([text] * 3 + [None, ""])] + [(i, "rare words of one text", "xx") for i in range(10, 40)]
    learned = dict(language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")))
    assert all(w in learned["de"] for w in (b"anfang", b"mitte", b"ende")) and len(learned["de"]) < 1.1 * len(text)
    assert learned["xx"].count(b"rare") == 1  # copies are drawn once


def test_learns_nothing_from_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a = {r.doc_id: r.lang_pred for r in language_id.fit_and_identify(docs).collect()}
    assert a == {r.doc_id: r.lang_pred for r in language_id.fit_and_identify(spoiled).collect()}


def brute_top(rows, k):
    from fractions import Fraction
    from math import floor

    good = [(i, [floor(256 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q)[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 16])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_search, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK", 2 if block == 16 else block)
    monkeypatch.setattr(pivot_search, "SAMPLE", 20 if block == 16 else 1024)
    rnd = random.Random(6)
    same = [0.25, -0.5, 0.125]
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(160)] + [(i, same) for i in range(200, 260)]
    rows += [(300, None), (350, [1.0, None, 2.0]), (400, [float("nan"), 1.0, 1.0]), (450, [float("inf"), 0.0, 0.0]), (None, same), (500, [0.5, 0.5]), (550, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("id", F.lit(1)).withColumn("score", F.lit(2))
    got = pivot_search.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows, 5)
    assert pivot_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert sorted(r["rank"] for r in pivot_search.top_k(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()) == [1, 2]


@pytest.mark.parametrize("scale", [2.0**12, 2.0**20, 2.0**30, 2.0**40, 1e300])
def test_top_k_of_large_components(spark, monkeypatch, scale):
    """Beyond floats and beyond 64 bits, beside vectors of ordinary size."""
    monkeypatch.setattr(pivot_search, "CANDIDATE_BLOCK", 32)
    rnd = random.Random(7)
    rows = [(i, [rnd.uniform(-scale, scale) for _ in range(4)]) for i in range(60)] + [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(60, 120)]
    rows += [(1000, [1.0, 2.0]), (1001, [2.0**33, 0.0]), (1002, [1.0, 1.0]), (1003, [1.7e308, -1.7e308])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = pivot_search.top_k(df, F.col("vec_id") % 50 == 0).collect()
    want = [(q, n, c, max(-(2**63), min(2**63 - 1, s))) for q, n, c, s in brute_top(rows, 5)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want


def test_blocks_that_cannot_reach_a_score_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK", 2)
    met = []
    whole = pivot_search._meetings
    monkeypatch.setattr(pivot_search, "_meetings", lambda q, c, n: met.append((whole(q, c, n).count(), q.select("block").distinct().count() * c.select("block").distinct().count())) or whole(q, c, n))
    rnd = random.Random(8)
    at = lambda c: [(9.0 if d == c else 0.0) + rnd.gauss(0, 0.01) for d in range(6)]
    rows = [(i, at(i % 6)) for i in range(600)]
    got = pivot_search.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows, 5)
    assert met[0][0] < 0.5 * met[0][1]


def brute_rotation(rows):
    """(conv, speaker): the whole rendering and its masks, for (conv, turn, speaker, text)."""
    out = {}
    first = lambda x: (x is not None, x or 0)
    clean = [(c, t, s or "unknown", x or "") for c, t, s, x in rows]
    for conv in {c for c, *_ in clean}:
        turns = sorted((r for r in clean if r[0] == conv), key=lambda r: (first(r[1]), r[2], r[3]))
        for me in {s for _, _, s, _ in turns} - {"system"}:
            text, masks = "", []
            for _, _, s, x in turns:
                name = s.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C").replace(">", "%3E").replace("|", "%7C")
                text += "<|im_start|>" + ("system" if s == "system" else "assistant" if s == me else f"user name={name}") + "\n"
                body = x.replace("<|", "< |") + "<|im_end|>"
                if s == me:
                    masks.append((len(text), len(text) + len(body)))
                text += body + "\n"
            out[conv, me] = text, masks
    return out


@pytest.mark.parametrize("part_turns, slice_", [(4, 3), (128, 64), (7, 1)])
def test_chat_parts(spark, monkeypatch, part_turns, slice_):
    """Parts in order are the whole rendering for every speaker, whatever their size."""
    monkeypatch.setattr(chat_format, "SLICE", slice_)
    rows = [(1, t, f"s{t % 3}", f"t{t} <|im_end|>") for t in range(10)] + [(None, 0, None, None), (2, 0, "system", "rules"), (3, 1, "a", "x"), (3, 1, "a", "x"), (3, 0, "system", "s"), (3, 2, "b\n<|", "y")]
    rows += [(4, 1, "a<b", "1"), (4, 2, "a_b", "2"), (4, 3, "a%3Cb", "3"), (4, None, "", None), (5, 0, "a", "word " * 100_000), (5, 1, "b", "w")]
    rows += [(6, t, "late" if t == 900 else "system" if t == 0 else f"p{t % 5}", f"turn {t}") for t in range(1000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit(9)).repartition(5)
    got = chat_format.rotate(df, part_turns=part_turns).collect()
    whole = {}
    for r in sorted(got, key=lambda r: r.part):
        assert r.first_turn == r.part * part_turns and 0 < r.n_turns <= part_turns
        text, masks = whole.setdefault((r.conv_id, r.speaker), ("", []))
        whole[r.conv_id, r.speaker] = text + r.rendered, masks + [(len(text) + m.start, len(text) + m.end) for m in r.masks]
    assert whole == brute_rotation(rows)
    assert (2, "system") not in whole and len([k for k in whole if k[0] == 6]) == 6
    assert len({name for t, _ in [whole[4, "unknown"]] for name in t.split("name=")}) == 4
    assert chat_format.rotate(df.limit(0)).count() == 0


def brute_mix(rows, share=1.5, most=2):
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, total = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(full.values())
        target = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if target[s] > most * sizes[s]]
        if not over:
            return {**full, **target}
        full |= {s: most * sizes[s] for s in over}


def mixed_rows():
    rnd = random.Random(8)
    rows = [(i, " ".join(f"w{j}" for j in range(rnd.randrange(1, 400))), rnd.choice(["a", "b", "c", "Z", None, "é"])) for i in range(500)]
    return [(i, t, "hot" if i % 3 == 0 else s) for i, t, s in rows] + [(900, None, "a"), (901, "", "void"), (902, "x y", "tiny"), (7, rows[7][1], "b"), (7, rows[7][1], "b")]


def test_mix(spark):
    rows = mixed_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit(1)).withColumn("n_chars", F.length("text").cast("bigint"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    want, taken, size = brute_mix(rows), collections.Counter(), collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
        size[r.source] += r["size"]
    for s in want:
        assert abs(taken[s] - want[s]) <= max(150, 0.02 * want[s])
    again = mixing.mix(df.repartition(5)).collect()
    key = lambda r: (r.doc_id, r["size"], r.source or "", r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    out = mixing.apply_mix(df)
    words = {r.source: r.n for r in out.withColumn("w", mixing.word_count(F.col("text"))).groupBy("source").agg(F.sum("w").alias("n")).collect()}
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}
    assert out.columns == df.columns
    whole = {r.doc_id: r.text for r in df.collect()}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        assert set(r.text.split()) <= set(whole[r.doc_id].split())


def test_mix_awkward(spark):
    assert len(mixing.mix(awkward(spark)).collect()) == 11
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.apply_mix(empty(spark)).count() == 0
    silent = awkward(spark).filter("doc_id in (3, 4, 5)")
    assert {(r.taken, r.target) for r in mixing.mix(silent).collect()} == {(0, 0.0)}


def test_apportion_equals_highest_quotients(spark):
    rnd = random.Random(9)
    for _ in range(4):
        parties = [(i, rnd.choice([0.0, rnd.uniform(0, 3), rnd.uniform(0, 300)])) for i in range(30)]
        seats = round(sum(w for _, w in parties))
        rows = [(0, i, w, int(w * 1.2) + 2, seats) for i, w in parties]
        df = spark.createDataFrame(rows, "g int, i int, w double, cap bigint, seats bigint")
        got = {r.i: r.quota for r in mixing.apportion(df, ["g"], "w", "cap", "seats", "i").collect()}
        quotients = sorted((-w / (2 * k - 1), i) for _, i, w, cap, _ in rows for k in range(1, cap + 1))[:seats]
        want = collections.Counter(i for _, i in quotients)
        assert got == {i: want[i] for i, _ in parties}


def test_align_is_a_rising_run_of_equal_words():
    rnd = random.Random(10)
    for _ in range(200):
        a = [rnd.choice("abcdefgh") for _ in range(rnd.randrange(20))]
        b = [rnd.choice("abcdefgh") for _ in range(rnd.randrange(20))]
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x < y and p < q for (x, p), (y, q) in zip(pairs, pairs[1:]))
    same = "one two three two one".split()
    assert license_scan.align(same, same) == [(i, i) for i in range(5)]


def brute_longest(pairs):
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        for j in range(i):
            if pairs[j][1] < pairs[i][1]:
                best[i] = max(best[i], best[j] + 1)
    return max(best, default=0)


def test_rising():
    rnd = random.Random(12)
    for _ in range(100):
        bs = rnd.sample(range(50), rnd.randrange(20))
        assert len(license_scan.rising(list(enumerate(bs)))) == brute_longest(list(enumerate(bs)))


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def edited(rnd, words, vocabulary):
    copy = [w for w in words if rnd.random() > 0.08]
    for _ in range(rnd.randrange(3)):
        copy.insert(rnd.randrange(len(copy) + 1), rnd.choice(vocabulary))
    return copy


def test_license_finds_equal_longest_common_subsequences():
    """Few and many repeated words: what is found reaches the coverage, and what reaches it is found."""
    rnd = random.Random(11)
    found = missed = 0
    for size in (4, 10, 26) * 200:
        vocabulary = [f"w{chr(97 + i)}" for i in range(size)]
        template = [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, license_scan.LINE + 1))]
        text = [rnd.choice(vocabulary) for _ in range(rnd.randrange(30))]
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(text) + 1)
            text[at:at] = edited(rnd, template, vocabulary)
        got = license_scan.Scanner((("T", " ".join(template)),)).scan(" ".join(text))
        window = int(len(template) * license_scan.SLACK)
        best = max((longest_common(template, text[i : i + window]) for i in range(len(text))), default=0) / len(template)
        assert all(f[1] <= longest_common(template, text) / len(template) + 1e-4 for f in got)
        if best >= license_scan.COVERAGE:
            found, missed = found + bool(got), missed + (not got)
    assert found > 300 and missed <= found / 100


def test_license_scan_equals_plain_scanner(spark):
    """The query's rows are those of every document scanned on its own, whole and in order of the templates."""
    rows = [(i, f"Chapter {i}. {notice}\n" * (i % 3 + 1)) for i, (_, notice) in enumerate(license_scan.default_templates()[::40])]
    scanner = license_scan.Scanner(license_scan.default_templates())
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        want = scanner.scan(rows[r.doc_id][1])
        assert [(s.license, s.start, s.end) for s in r.spans] == [(n, a, b) for n, _, a, b in want]
        assert r.n_finds == len(want) and set(r.licenses) == {f[0] for f in want}


def test_license_scan(spark):
    gpl = license_scan.TEMPLATES["GPL-3.0"]
    rows = [
        (1, f"intro this work {gpl} outro " * 2),
        (2, "Released under the MIT License."),
        (3, "released UNDER the\n  mit license"),
        (4, "the license under which MIT was released"),
        (5, None), (6, ""), (7, "word " * 50_000 + license_scan.TEMPLATES["Apache-2.0"]),
        (8, "This work is licensed under the GNU Public License, version 3."),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("best", F.lit(1))
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert (got[1].best, got[1].n_finds, got[1].coverage) == ("GPL-3.0", 2, 1.0)
    assert [rows[0][1][s.start : s.end] for s in got[1].spans] == [gpl[:-1]] * 2
    assert got[2].licenses == got[3].licenses == ["MIT"]
    assert [got[i].best for i in (4, 5, 6)] == [None] * 3 and got[5].coverage == 0.0
    assert got[7].best == "Apache-2.0"
    assert got[8].best == "GPL-3.0" and got[8].coverage < 1.0
    assert license_scan.scan(empty(spark)).count() == 0
    assert license_scan.scan(awkward(spark)).count() == 11


def test_license_names_and_versions_must_agree():
    scanner = license_scan.Scanner(tuple(license_scan.TEMPLATES.items()))
    for text in (
        "This is released under the BSD license.", "It was released under the new license.", "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under the Apache License, Version 1.1.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU General Public License, version 3.1.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This work is licensed under the GNU Library General Public License, version 3.",
    ):
        assert scanner.scan(text) == [], text
    assert [f[0] for f in scanner.scan("licensed under the Apache License v2")] == ["Apache-2.0"]


def test_overlapping_licenses_and_repeated_words():
    templates = (("BY", "licensed under cc by 4.0"), ("BY-NC", "licensed under cc by nc 4.0"), ("X", "a b a b a b a b c d"))
    scanner = license_scan.Scanner(templates)
    assert [f[0] for f in scanner.scan("Licensed under CC BY-NC 4.0, or licensed under CC BY 4.0")] == ["BY", "BY-NC"]
    # 8 of 10 words, but 2 of 4 different ones
    assert scanner.scan("a b a b a b a b") == [("X", 0.8, 0, 15)]


def test_default_licenses(spark):
    texts = {
        # not taken from the module: as in other people's files
        "MIT": """Copyright (c) 2019 Jane Roe. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
            associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
            rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
            whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
            notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
            WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
            PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL JANE ROE BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
            IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE.""",
        "BSD-3-Clause": open("/usr/share/common-licenses/BSD").read(),
        "GPL-2.0": "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n"
        "# the Free Software Foundation; either version 2, or (at your option)\n# any later version.",
        "GPL-3.0": "You can redistribute Foo and modify it; Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n"
        " * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
        "LGPL-3.0": "It may be used under the terms of the GNU Lesser General Public License, version 3.",
        "CC-BY-SA-4.0": "This text is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "BSD": "Foo is released under the BSD license.",
        "CC-BY-4.0": "Licensed under CC BY 4.0.",
        "ISC": "Foo is available under the ISC license",
    }
    whole = {n: open(f"/usr/share/common-licenses/{f}").read() for n, f in (("LGPL-2.0", "LGPL-2"), ("LGPL-2.1", "LGPL-2.1"), ("Apache-2.0", "Apache-2.0"))}
    prose = ["It was released under the new license.", "They live under the terms of the old king's law, version 3.", "Er kam mit der Lizenz."]
    rows = [*texts.items(), *(("whole " + n, "preface " * 50 + t) for n, t in whole.items()), *(("", t) for t in prose)]
    df = spark.createDataFrame([(n, t) for n, t in rows], "doc_id string, text string")
    got = [(r.doc_id, r.licenses, r.n_finds) for r in license_scan.scan(df).collect()]
    assert sorted(got) == sorted((n, [n.removeprefix("whole ")] if n else [], int(n != "")) for n, _ in rows)
