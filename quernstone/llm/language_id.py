"""Language ID by compression with one zstandard raw-content dictionary a language.

A text is written with each language's dictionary in turn; the language whose
dictionary makes it smallest is the prediction.  The relative margin to the
second smallest is the score, and a text with a narrow margin is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import bounded_batches, free_names
from .piece_table import texts_of

#: Bytes of a language's dictionary; also what the driver collects for each.
DICTIONARY_BYTES = 65_536
#: Stretches of labelled texts sampled for each language, and bytes of a stretch.
#: Texts are cut into stretches from end to end, and each may be drawn.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 2_000
#: Languages that a model has at most, the most frequent: their dictionaries go to all workers.
MOST_LANGUAGES = 500
#: Texts are coded in stretches of this many bytes, so that a long text does not
#: become its own dictionary.
STRETCH = 2_048
#: The last words of a text, up to so many bytes, are measured more finely, as
#: whole bytes are too coarse for a few words: also at a slower level, from
#: several words on, and with parts of the dictionaries.
TAIL, ENDINGS, PARTS = 256, 2, 3
#: A smaller relative margin rejects a text.  Measured: 0.2 % of texts in learned
#: languages are below it, near ties such as texts half in another language, and
#: between 30 and 65 % of texts in a language that was left out of the model.
MIN_MARGIN = 0.005
LEVEL, TAIL_LEVEL = 7, 12
#: Shorter dictionaries are filled up to this, which the library asks for.
LEAST_BYTES = 8

_not_letters = re.compile(r"[\W\d_]+")


def normalised(text: str) -> str:
    return _not_letters.sub(" ", text.lower()).strip()


def _compressors(dictionary: bytes, level: int, min_match: int) -> zstandard.ZstdCompressor:
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(
        level,
        dict_size=len(dictionary),
        source_size=STRETCH,
        min_match=min_match,
        write_checksum=0,
        write_content_size=0,
        write_dict_id=0,
    )
    content.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=params)


def _parts(dictionary: bytes) -> list[bytes]:
    step = -(-len(dictionary) // PARTS)
    return [dictionary[i : i + step] for i in range(0, len(dictionary), step)]


class Classifier:
    """``dictionaries``: (language, dictionary), the most frequent language first."""

    def __init__(self, dictionaries: tuple[tuple[str, bytes], ...]):
        usable = [(lang, d.ljust(LEAST_BYTES)) for lang, d in dictionaries]
        self.languages = [lang for lang, _ in usable]
        self.fast = [_compressors(d, LEVEL, 4).compress for _, d in usable]
        self.fine = [
            [fast, *(_compressors(x.ljust(LEAST_BYTES), TAIL_LEVEL, 3).compress for x in (d, *_parts(d)))]
            for fast, (_, d) in zip(self.fast, usable)
        ]

    def sizes(self, data: bytes) -> list[float]:
        """Bytes of ``data`` with each dictionary: its stretches', and those of its tail by the fine measure."""
        cut = 0
        if len(data) > TAIL:
            # the tail starts with a word, or within one that is longer
            cut = len(data) - TAIL
            cut = space if (space := data.find(b" ", cut) + 1) and space < len(data) else cut
        body, words = data[:cut], data[cut:].split(b" ")
        step = -(-len(words) // ENDINGS)
        endings = [b" ".join(words[i:]) for i in range(0, len(words), step)]
        share = (len(data) - cut) / (sum(map(len, endings)) * len(self.fine[0]))
        stretches = [body[i : i + STRETCH] for i in range(0, len(body), STRETCH)]
        return [
            sum(map(len, map(fast, stretches))) + share * sum(len(code(e)) for code in fine for e in endings)
            for fast, fine in zip(self.fast, self.fine)
        ]

    def predict(self, text: str) -> tuple[str, float]:
        """Language and relative margin; ``und`` without letters or languages."""
        clean = normalised(text)
        if not self.languages or not any(map(str.isalpha, clean)):
            return "und", 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        sizes = self.sizes(clean.encode())
        # equal sizes go to the more frequent language, which comes first
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.languages[best], (second - sizes[best]) / second


@lru_cache(maxsize=1)
def _classifier(dictionaries: tuple[tuple[str, bytes], ...]) -> Classifier:
    """Kept by the worker."""
    return Classifier(dictionaries)


def held_out(id_column: Column, fold: int = 1, folds: int = 3) -> Column:
    """True for ids that no model learns from; a null id is in no fold."""
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> tuple:
    """Dictionaries from a bounded sample of the labelled rows of ``docs``.

    All rows are counted; ``SAMPLE_ROWS`` different stretches of each language's
    texts, those with the least hashes, are drawn from all of their stretches.
    Rows without text, language or id are not used.  Of more than
    ``MOST_LANGUAGES`` languages the most frequent ones are learned.
    """
    content = F.col(text_col).cast("string").cast("binary")
    labelled = docs.select(content.alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col(id_col).isNotNull()
    )
    last = F.floor((F.octet_length("text") - 1) / SAMPLE_BYTES).cast("int")
    stretches = labelled.filter(F.octet_length("text") > 0).select(
        "lang",
        F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("text", i * SAMPLE_BYTES + 1, F.lit(SAMPLE_BYTES)))).alias("text"),
    )
    stretches = stretches.withColumn("draw", F.xxhash64("text"))
    counts = (
        stretches.groupBy("lang")
        .agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("draw").alias("different"))
        .orderBy(F.desc("n"), "lang")
        .limit(MOST_LANGUAGES)
        .collect()
    )
    if not counts:
        return ()
    # hashes are even over 64 bits: a bound on them draws a share of the stretches
    bound = F.lit(None).cast("double")
    for row in counts:
        share = min(1.0, 1.5 * SAMPLE_ROWS / row.different)
        bound = F.when(F.col("lang") == row.lang, F.lit((share - 0.5) * 2.0**64)).otherwise(bound)
    order = Window.partitionBy("lang").orderBy("draw", "text")
    drawn = (
        stretches.filter(F.col("draw").cast("double") <= bound)
        .groupBy("lang", "draw")
        .agg(F.min("text").alias("text"))
        .withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= SAMPLE_ROWS)
        .orderBy("lang", "nth")
        .collect()
    )
    learned: dict[str, bytes] = {row.lang: b"" for row in counts}
    for row in drawn:
        if len(learned[row.lang]) < DICTIONARY_BYTES:
            # a stretch may begin and end within a character
            learned[row.lang] += normalised(bytes(row.text).decode(errors="ignore")).encode() + b" "
    return tuple((lang, text[:DICTIONARY_BYTES]) for lang, text in learned.items())


def _predicted(rows: DataFrame, dictionaries: tuple, text_col: str, lang: str, score: str) -> DataFrame:
    """``rows`` with two more columns."""
    rows = bounded_batches(rows).withColumn(text_col, F.col(text_col).cast("string"))
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _classifier(dictionaries).predict
        for batch in batches:
            found = [predict(t) for t in texts_of(batch.column(at))]
            own = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.record_batch([*batch.columns, *own], names=[*batch.schema.names, lang, score])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))


def _rejected(lang: str, score: str, min_margin: float) -> Column:
    return (F.col(lang) == "und") | (F.col(score) < min_margin)


def identify(
    docs: DataFrame, dictionaries: tuple, id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN
) -> DataFrame:
    """``id_col``, lang_pred, score, rejected for every row of ``docs``.

    ``score`` is the relative margin, 0 to 1.  Null text and text without a
    letter are ``und`` with score 0 and rejected; so is everything if nothing
    was learned.  Equal sizes go to the more frequent language.  Repeated rows
    are predicted each; no rows give no rows.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = _predicted(rows, dictionaries, "text", "lang_pred", "score")
    return found.select(F.col("id").alias(id_col), "lang_pred", "score", _rejected("lang_pred", "score", min_margin).alias("rejected"))


def fit_and_identify(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``identify`` with dictionaries from the rows that are not held out, which are marked."""
    dictionaries = fit(docs.filter(~held_out(F.col(id_col))), id_col=id_col)
    return identify(docs, dictionaries, id_col=id_col, **options).withColumn("held_out", held_out(F.col(id_col)))


def keep_known(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_margin: float = MIN_MARGIN
) -> DataFrame:
    """``docs`` without the rows that are rejected; ``lang_col`` is what was predicted.

    Columns keep their names and order; others than these three pass unread.
    """
    dictionaries = fit(docs.filter(~held_out(F.col(id_col))), text_col, lang_col, id_col)
    lang, score = free_names(docs, "lang", "score")
    found = _predicted(docs, dictionaries, text_col, lang, score).filter(~_rejected(lang, score, min_margin))
    return found.select(*(F.col(lang).alias(lang_col) if c == lang_col else F.col(c) for c in docs.columns))
