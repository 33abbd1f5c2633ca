"""Phrase collocations by pivot partitioning.

Every occurrence of a phrase belongs to its rarest word, the pivot (of equal words
the leftmost).  A text is rewritten for each place that can be a pivot: the words
beside it that are more frequent, up to three on either side, and nothing beyond
the first rarer one.  These fragments go to their pivot's partition, counted and
bundled, and there every phrase that holds the pivot is counted whole.  Phrases of
frequent words thus travel as one fragment, and no phrase is counted in two places.

How rare a word is, is read from a table of counters of fixed size, to which words
are hashed.  Words that share a counter only count as more frequent than they are:
any order of words gives the same phrases, a good one gives small partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import bounded_batches, staged
from .piece_table import slices

#: Words of a phrase, occurrences that a candidate has, and phrases returned for a language.
MOST_WORDS, MIN_COUNT, TOP = 4, 30, 2_000
#: Percentage of a phrase's occurrences that lie in a longer one if that one replaces it.
ABSORBED = 80
SCALE = 2_000_000
#: Counters of the table of word frequencies: 8 MB whatever the corpus.
COUNTERS = 1 << 20
#: A word above one in HOT of all words is dealt over several partitions; there are fewer than HOT of them.
HOT = 500
#: Bytes of text that are cut at once.
SLICE_BYTES = 8_000_000
#: Scores, from 0 to 1,000,000, are ranked in stretches, so many for a doubling: 320 at most.
STRETCHES = 16

_break = "."
_pieces = r"[.,;:!?\n\x0b\x0c\r]"
_beside = MOST_WORDS - 1
_FIELDS = 2 * _beside + 1
_blank = np.iinfo(np.int32).max


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words, the number of each token's word, and the text that each token is of.

    Words are of lower-cased texts.  The end of a piece and of a text is a token too, the word ".".
    """
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    # joined first: of a slice that starts within its buffer ascii_lower reads the wrong bytes
    ended = pc.binary_join_element_wise(whole, pa.scalar(_break, whole.type), pa.scalar(" ", whole.type))
    cut = pc.replace_substring_regex(pc.ascii_lower(ended), _pieces, f" {_break} ")
    cut = pc.replace_substring(cut, "\t", " ")
    lists = pc.split_pattern(cut, " ")
    coded = lists.flatten().dictionary_encode()
    numbers = coded.indices.to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy().astype(np.int64)))
    kept = np.flatnonzero(pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[numbers])
    return coded.dictionary, numbers[kept], of[kept]


def grouped(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different row of ``codes``, and the sum of the weights of its rows."""
    if not len(codes):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    mixed = np.zeros(len(codes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[1]):
            mixed = (mixed ^ codes[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    other = (codes[order[1:]] != codes[order[:-1]]).any(1)
    if (other & (mixed[order[1:]] == mixed[order[:-1]])).any():
        order = np.lexsort(codes.T)  # two rows share a hash
        other = (codes[order[1:]] != codes[order[:-1]]).any(1)
    starts = np.concatenate([[0], np.flatnonzero(other) + 1])
    return order[starts], np.add.reduceat(weights[order], starts)


class _Coded:
    """Words of a slice of texts: numbers of (language, word), and which of them are no words."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        words, numbers, of = tokens(texts)
        lang = pc.fill_null(langs, "und").cast(pa.large_string()).dictionary_encode()
        pairs = lang.indices.to_numpy().astype(np.int64)[of] * max(1, len(words)) + numbers
        found, self.at = np.unique(pairs, return_inverse=True)
        self.langs = lang.dictionary.take(pa.array(found // max(1, len(words))))
        self.words = words.take(pa.array(found % max(1, len(words))))
        self.ends = pc.equal(self.words, _break).to_numpy(zero_copy_only=False)


def _rows(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return bounded_batches(docs).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, f) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1), SLICE_BYTES):
                coded = _Coded(batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start))
                counts = np.bincount(coded.at, minlength=len(coded.words))
                kept = pa.array(np.flatnonzero(~coded.ends))
                columns = [coded.langs.take(kept).cast(pa.string()), coded.words.take(kept).cast(pa.string()), pa.array(counts).take(kept)]
                yield pa.record_batch(columns, names=["lang", "word", "f"])

    return rows.mapInArrow(run, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _hashed(lang, word):
    return F.xxhash64(F.concat(lang, F.lit(" "), word))


def counters(frequent: DataFrame) -> np.ndarray:
    """Sum of the frequencies of the words that are hashed to each of COUNTERS places."""
    place = F.pmod(_hashed(F.col("lang"), F.col("word")), F.lit(COUNTERS)).alias("place")
    found = frequent.groupBy(place).agg(F.sum("f").alias("f")).toArrow()  # COUNTERS rows at most
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[found["place"].to_numpy()] = found["f"].to_numpy()
    return out


def rarity(langs: list[str], words: list[str], ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each word in the order from frequent to rare; those without a counter, and ends, are blank.

    The order is by counter, hash and word, so all tasks agree on it.
    """
    hashes = [xxhash.xxh64_intdigest(f"{a} {b}".encode(), 42) for a, b in zip(langs, words)]
    counts = table[np.array([h % len(table) for h in hashes], dtype=np.int64)] if hashes else np.empty(0, dtype=np.int64)
    some = np.flatnonzero((counts > 0) & ~ends).tolist()
    listed = counts.tolist()
    some.sort(key=lambda i: (-listed[i], hashes[i], langs[i], words[i]))
    out = np.full(len(words), _blank, dtype=np.int32)
    out[some] = np.arange(len(some), dtype=np.int32)
    return out


def fragments(rank: np.ndarray) -> np.ndarray:
    """Places of each fragment's words in a row of tokens: three, the pivot, three; -1 for none.

    ``rank`` is the order of each token's word.  Words on the left are more
    frequent than the pivot, those on the right more frequent or the pivot itself,
    so that a phrase has one pivot.
    """
    wide = np.concatenate([np.full(_beside, _blank, np.int32), rank, np.full(_beside, _blank, np.int32)])
    own = wide[_beside : len(wide) - _beside]
    at = np.full((len(rank), _FIELDS), -1, dtype=np.int64)
    places = np.arange(len(rank))
    at[:, _beside] = places
    for side in (-1, 1):
        there = own != _blank
        for k in range(1, _beside + 1):
            beside = wide[_beside + side * k : len(wide) - _beside + side * k]
            there = there & ((beside < own) if side < 0 else (beside <= own) & (beside != _blank))
            at[:, _beside + side * k] = np.where(there, places + side * k, -1)
    return at[(at[:, _beside - 1] >= 0) | (at[:, _beside + 1] >= 0)]


def _texts(words: pa.Array, codes: np.ndarray) -> pa.Array:
    """Words of these numbers, the empty text for -1."""
    return pc.fill_null(words.take(pa.array(codes, mask=codes < 0)), "")


def bundles(rows: DataFrame, table: np.ndarray, hot: dict[tuple[str, str], int]) -> DataFrame:
    """(lang, pivot, part, fragments): for each pivot of a slice of texts its fragments, seven fields each.

    The fields, parted by spaces, are six words beside the pivot and a count.  A
    hot pivot's bundles are dealt over its number of parts by task.
    """
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in batches:
            for start, stop in slices(batch.column(1), SLICE_BYTES):
                coded = _Coded(batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start))
                langs, words = coded.langs.to_pylist(), coded.words.to_pylist()
                rank = rarity(langs, words, coded.ends, shared.value)
                places = fragments(rank[coded.at])
                codes = np.where(places >= 0, coded.at[places], -1).astype(np.int32)
                first, counts = grouped(codes, np.ones(len(codes), dtype=np.int64))
                codes = codes[first]
                order = np.argsort(codes[:, _beside], kind="stable")
                codes, counts = codes[order], counts[order]
                pivots, begins = np.unique(codes[:, _beside], return_index=True)
                fields = [_texts(coded.words, codes[:, k]) for k in range(_FIELDS) if k != _beside]
                space = pa.scalar(" ", coded.words.type)
                lines = pc.binary_join_element_wise(*fields, pa.array(counts).cast(coded.words.type), space)
                ends = pa.array(np.append(begins, len(codes)), pa.int32())
                held = pc.binary_join(pa.ListArray.from_arrays(ends, lines.cast(pa.string())), " ")
                parts = [task % n if (n := hot.get((langs[p], words[p]))) else -1 for p in pivots.tolist()]
                columns = [coded.langs.take(pa.array(pivots)), coded.words.take(pa.array(pivots)), pa.array(parts, pa.int32()), held]
                yield pa.record_batch([c if pa.types.is_int32(c.type) else c.cast(pa.string()) for c in columns], names=["lang", "pivot", "part", "fragments"])

    return rows.mapInArrow(run, "lang string, pivot string, part int, fragments string")


def mined(bundled: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, size, a): phrases counted in their pivot's partition, ``min_count`` times at least.

    Bundles come sorted by pivot, so a pivot is done when the next begins.  Of one
    that is cut by the ends of a batch, or dealt in parts, the counts are summed
    once more; all others are final and rare phrases go no further.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = pc.split_pattern(batch.column("fragments").cast(pa.large_string()), " ")
            flat = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy().astype(np.int64)) // _FIELDS
            counts = flat.take(pa.array(np.arange(_FIELDS - 1, len(flat), _FIELDS))).cast(pa.int64()).to_numpy()
            pivots = batch.column("pivot").cast(pa.large_string())
            coded = pa.concat_arrays([flat, pivots, pa.array([""], flat.type)]).dictionary_encode()
            numbers = coded.indices.to_numpy()
            beside = numbers[: len(flat)].reshape(-1, _FIELDS)[:, : _FIELDS - 1]
            own = np.repeat(numbers[len(flat) : -1], sizes)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            langs = batch.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy()
            # a row's number stands for (language, pivot); rows at the ends of the batch may go on in others
            same = np.r_[False, (lang[1:] == lang[:-1]) & (numbers[len(flat) : -1][1:] == numbers[len(flat) : -1][:-1])]
            group = np.cumsum(~same)
            whole = (batch.column("part").to_numpy() < 0) & (group != group[0]) & (group != group[-1])
            columns = [*beside[:, :_beside].T, own, *beside[:, _beside:].T]
            empty = numbers[-1]
            parts, weights = [], []
            for a in range(_beside + 1):
                for b in range(max(a + 1, _beside), min(a + MOST_WORDS, _FIELDS)):
                    held = np.flatnonzero((columns[a] != empty) & (columns[b] != empty))
                    codes = np.full((len(held), MOST_WORDS + 1), -1, dtype=np.int32)
                    codes[:, 0] = row[held]
                    for k in range(a, b + 1):
                        codes[:, 1 + k - a] = columns[k][held]
                    parts.append(codes)
                    weights.append(counts[held])
            codes, sums = np.concatenate(parts), np.concatenate(weights)
            done = whole[codes[:, 0]]
            # from here on a phrase's group counts, not its row
            codes[:, 0] = group[codes[:, 0]]
            first, sums = grouped(codes, sums)
            kept = ~done[first] | (sums >= min_count)
            codes, sums = codes[first[kept]], sums[kept]
            texts = [words if k < 2 else pc.if_else(pa.array(codes[:, 1 + k] < 0), pa.scalar(None, flat.type), words)
                     for k in range(MOST_WORDS) for words in [coded.dictionary.take(pa.array(np.maximum(codes[:, 1 + k], 0)))]]
            phrases = pc.binary_join_element_wise(*texts, pa.scalar(" ", flat.type), null_handling="skip")
            of = np.searchsorted(group, codes[:, 0])
            yield pa.record_batch(
                [langs.dictionary.take(pa.array(lang[of])), phrases.cast(pa.string()), pa.array((codes[:, 1:] >= 0).sum(1), pa.int32()), pa.array(sums)],
                names=["lang", "phrase", "size", "a"],
            )

    dealt = bundled.repartition("lang", "pivot", "part").sortWithinPartitions("lang", "pivot")
    counted = dealt.mapInArrow(run, "lang string, phrase string, size int, a bigint")
    return counted.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).filter(F.col("a") >= min_count)


def _wide(name: str) -> str:
    return f"cast({name} as decimal(20, 0))"


def scored(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """``candidates`` with l, r and score of the cut with the least score, of equal ones the first."""
    counts = candidates.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).unionByName(
        frequent.select("lang", F.col("word").alias("part"), "f")
    )
    cuts = candidates.select("lang", "phrase", "size", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).withColumns(
        {"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")}
    )
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counts.select("lang", F.col("part").alias(part), F.col("f").alias(name)), ["lang", part])
    score = F.expr(f"(cast({SCALE} as decimal(7, 0)) * {_wide('a')}) div ({_wide('l')} + {_wide('r')})")
    least = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return (
        cuts.withColumn("score", score)
        .groupBy("lang", "phrase", "size", "a")
        .agg(least.alias("cut"))
        .select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")
    )


def not_absorbed(phrases: DataFrame, candidates: DataFrame, percent: int = ABSORBED) -> DataFrame:
    """``phrases`` without those inside a longer candidate that has ``percent`` of their occurrences."""
    inner = F.expr(
        "flatten(transform(sequence(2, size - 1), n -> transform(sequence(0, size - n),"
        " i -> substring_index(substring_index(phrase, ' ', i + n), ' ', -n))))"
    )
    longer = (
        candidates.filter("size > 2")
        .select("lang", F.explode(inner).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("most"))
    )
    kept = F.expr(f"most is null or 100 * {_wide('most')} < {percent} * {_wide('a')}")
    return phrases.join(longer, ["lang", "phrase"], "left").filter(kept).drop("most")


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    min_count: int = MIN_COUNT,
    top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score.

    Texts are lower-cased (A to Z), split at ``.,;:!?`` and U+000A to U+000D, and
    those pieces into words at spaces and tabs.  Phrases have two to four words of
    a piece and occur ``min_count`` times; counts hold overlapping occurrences.
    The score is that of the weakest cut, floor(2000000 a / (l + r)) with the
    counts of its two parts; ``n`` counts all words of the language.  Phrases
    that mostly occur in a longer one are dropped.  Ties go to more occurrences,
    then to the phrase that is first in UTF-8 bytes.  Null texts have no words, a
    null language is ``und``, repeated rows count each, other columns are ignored,
    and no words give no rows.
    """
    rows = _rows(docs, lang_col, text_col)
    words = staged(word_counts(rows), "collocation-words")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.filter(F.col("f") >= min_count)
    everything = words.agg(F.sum("f")).first()[0] or 0
    # fewer than HOT words hold more than one in HOT of all
    often = frequent.filter(F.col("f") * HOT > everything).limit(HOT).collect()
    hot = {(r.lang, r.word): -(-r.f * HOT // everything) for r in often}
    candidates = staged(mined(bundles(rows, counters(frequent), hot), min_count), "collocation-candidates")
    best = staged(not_absorbed(scored(candidates, frequent), candidates), "collocation-scored")
    return _top(best, top).join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _top(best: DataFrame, top: int) -> DataFrame:
    """Each language's ``top`` rows of ``best`` with their rank.

    A language is ranked in stretches of scores: how many rows the better ones
    have is known from their counts, and those beyond ``top`` are left out first.
    """
    best = best.withColumn("stretch", F.floor(F.log2(F.col("score") + 1) * STRETCHES).cast("int"))
    better = Window.partitionBy("lang").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = best.groupBy("lang", "stretch").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.withColumn("before", F.coalesce(F.sum("m").over(better), F.lit(0))).filter(F.col("before") < top)
    order = Window.partitionBy("lang", "stretch").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    near = best.join(counts.select("lang", "stretch", "before"), ["lang", "stretch"])
    near = near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top)
    return near.withColumn("rank", F.col("before") + F.col("nth")).filter(F.col("rank") <= top)


OP12_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), places AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM split
), grams AS (
  SELECT lang, m AS size, array_to_string(list_slice(words, i, i + m - 1), ' ') AS phrase, count(*) AS a
  FROM places, (SELECT unnest(range(1, {MOST_WORDS + 1})) AS m)
  WHERE i + m - 1 <= len(words)
  GROUP BY ALL
), sizes AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT * FROM grams WHERE size > 1 AND a >= {MIN_COUNT}
), cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, k,
         array_to_string(list_slice(string_split(c.phrase, ' '), 1, k), ' ') AS first_part,
         array_to_string(list_slice(string_split(c.phrase, ' '), k + 1, c.size), ' ') AS rest
  FROM candidates c, (SELECT unnest(range(1, {MOST_WORDS})) AS k) WHERE k < c.size
), measured AS (
  SELECT u.*, f.a AS l, g.a AS r, ({SCALE}::HUGEINT * u.a) // (f.a::HUGEINT + g.a) AS score
  FROM cuts u JOIN grams f ON f.lang = u.lang AND f.phrase = u.first_part AND f.size = u.k
       JOIN grams g ON g.lang = u.lang AND g.phrase = u.rest AND g.size = u.size - u.k
), weakest AS (
  SELECT * FROM measured QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT c.lang, array_to_string(list_slice(string_split(c.phrase, ' '), i, i + m - 1), ' ') AS phrase, max(c.a) AS most
  FROM candidates c, (SELECT unnest(range(2, {MOST_WORDS})) AS m), (SELECT unnest(range(1, {MOST_WORDS})) AS i)
  WHERE m < c.size AND i + m - 1 <= c.size GROUP BY ALL
), kept AS (
  SELECT w.* FROM weakest w LEFT JOIN inner_parts p ON p.lang = w.lang AND p.phrase = w.phrase
  WHERE p.most IS NULL OR 100::HUGEINT * p.most < {ABSORBED}::HUGEINT * w.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept k JOIN sizes s ON s.lang = k.lang
QUALIFY rank <= {TOP}
"""
