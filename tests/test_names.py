import random

from quernstone.operators import names


def brute(texts, dictionary):
    known = {}
    for n in dictionary:
        if n and n.split():
            w = tuple(n.replace("-", " ").split())
            known[w] = min(n, known.get(w, n))
    out = []
    for key, text in texts:
        words = (text or "").replace(",", " ").replace(".", " ").split()
        i = 0
        while i < len(words):
            hit = next((known[tuple(words[i : i + m])] for m in range(8, 0, -1) if tuple(words[i : i + m]) in known and i + m <= len(words)), None)
            if hit:
                m = len(hit.replace("-", " ").split())
                out.append((key, i, m, hit))
                i += m
            else:
                i += 1
    return sorted(out)


def test_nested_and_overlapping_names(spark):
    rnd = random.Random(1)
    vocabulary = ["a", "b", "c", "d", "بيت", "é"]
    for _ in range(3):
        dictionary = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 2, 3, 4, 5, 6]))) for _ in range(60)] + ["a-b", "", None, "c c c c c c c"]
        dictionary = [n for n in dictionary if n not in ("a", "b", "c")]
        texts = [(i, "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", ", ", ". "]) for _ in range(rnd.randrange(40)))) for i in range(80)] + [(99, None), (98, "c " * 30)]
        df = spark.createDataFrame(texts, "id int, text string")
        d = spark.createDataFrame([(n,) for n in dictionary], "name string")
        got = sorted(map(tuple, names.names_in_texts(df, "id", "text", d).collect()))
        assert got == brute(texts, dictionary)


def test_word_bounds_and_large_dictionaries(spark):
    d = spark.range(100_000).selectExpr("concat('place ', id) as name").union(spark.createDataFrame([("cat",)], "name string"))
    df = spark.createDataFrame([(1, "place 77, place 100001; concatenate cat-nap catalog place 99999")], "id int, text string")
    assert sorted((r.at, r.name) for r in names.names_in_texts(df, "id", "text", d).collect()) == [(0, "place 77"), (5, "cat"), (8, "place 99999")]
    assert names.names_in_texts(df, "id", "text", d.limit(0)).collect() == []
    assert names.names_in_texts(df.limit(0), "id", "text", d).collect() == []
