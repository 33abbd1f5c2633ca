"""License scans by patience alignment of texts with license templates.

Words that occur once in a template and once in a text anchor an alignment: the
longest run of anchors that rise in both is kept, and the gaps between
neighbouring anchors are aligned in the same way, with what is unique inside
them.  Equal words at either end of a gap are matched first; a gap without such
anchors is aligned by its longest common subsequence.  The coverage is the share of a template's words that are aligned.

Words that tell licenses apart (names, versions, variants such as NC or Lesser)
must agree: a short template is found only where all of its own are aligned and
no other stands in between.  Of finds that overlap, whatever their templates,
the one that explains the most words best is kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import licenses
from .base import bounded_batches
from .piece_table import texts_of

#: Plain notices by name; those of ``licenses.notices`` are looked for as well.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}
#: Least coverage that counts as a find.
COVERAGE = 0.8
#: Most words of a find's stretch of text, as a multiple of its template.
SLACK = 1.5
#: Templates of up to so many words are aligned from each of their words; longer
#: ones in windows that overlap by all but a ``STEPS``-th of the template.
LINE, STEPS = 24, 8
#: Templates of up to so many words must agree in identifying words; in longer
#: ones, such as whole texts, the wording itself tells them apart.
HEADER = 150
#: Names and variants of licenses.  Words of a template's name and words with
#: digits are identifying, too.
IDENTIFYING = frozenset(
    "affero agpl apache apsl artistic boost bsd bsl cc cc0 cddl ecl eclipse epl eupl gfdl gnu gpl isc lesser lgpl mit"
    " mozilla mpl nc nd noncommercial noderivatives noderivs openssl postgresql psf sa sharealike unlicense wtfpl zlib".split()
)
#: Further words that a one-line form must share, though they mean nothing elsewhere.
QUALIFIERS = frozenset("development documentation european expat freebsd modified new original public revised simplified".split())

_word = re.compile(r"v?\d+(?:\.\d+)+|[^\W_]+")
_version = re.compile(r"v?(\d+(?:\.\d+)*?)(?:\.0)*")


def _plain(word: str) -> str:
    """Versions alike: v2, 2.0 and 2 are one word, 2.1 another."""
    if word[-1] in "0123456789" and (found := _version.fullmatch(word)):
        return found.group(1)
    return word


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-case words of letters and digits, or versions, and where they are."""
    found = [(_plain(m.group().lower()), m.span()) for m in _word.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given in order of the first, that rises in the second."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[pile], at[pile] = b, i
    chain = []
    i = at[-1] if at else -1
    while i >= 0:
        chain.append(pairs[i])
        i = back[i]
    return chain[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of equal words, rising in both."""
    done: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        # equal words at either end of the gap need no anchor
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            done.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            done.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = rising([(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place])
        if not anchors:
            # no word is unique to both: the longest common run, as the longest that rises among all equal pairs
            places: dict[str, list[int]] = {}
            for j in range(b1 - 1, b0 - 1, -1):
                places.setdefault(b[j], []).append(j)
            done += rising([(i, j) for i in range(a0, a1) for j in places.get(a[i], ())])
            continue
        done += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(done)


def tight(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The run of pairs with the most words aligned, less half of those in between that are not."""
    best, total, first, cut = 0.0, 0.0, 0, (0, 0)
    for k, (_, b) in enumerate(pairs):
        total -= 0.5 * (b - pairs[k - 1][1] - 1) if k else 0.0
        if total <= 0:
            total, first = 0.0, k
        total += 1
        if total > best:
            best, cut = total, (first, k + 1)
    return pairs[cut[0] : cut[1]]


class Template:
    def __init__(self, name: str, notice: str):
        self.name, self.words = name, words_of(notice)[0]
        self.counts = Counter(self.words)
        own = IDENTIFYING | set(words_of(name)[0]) | (QUALIFIERS if len(self.words) <= LINE else set())
        named = {w for w in self.counts if w in own or any(map(str.isdigit, w))}
        self.marks = frozenset(named if len(self.words) <= HEADER else ())
        #: other licenses' words that may not stand within a find
        self.foreign = IDENTIFYING - self.counts.keys() if len(self.words) <= HEADER else frozenset()
        #: the word to look for first
        self.key = max(self.marks, key=lambda w: (w in IDENTIFYING, len(w), w), default=None)

    def possible(self, have: set[str] | dict[str, int], missing: int) -> bool:
        """Whether at most ``missing`` positions have words that are not there."""
        return self.marks <= have and sum(n for w, n in self.counts.items() if w not in have) <= missing

    def agrees(self, pairs: list[tuple[int, int]], words: list[str], at: int) -> bool:
        """Whether identifying words are aligned, and no others are between; pairs count from ``at``."""
        if not self.marks <= {self.words[i] for i, _ in pairs}:
            return False
        first, last = at + pairs[0][1], at + pairs[-1][1]
        stretch = words[first : last + 1]
        if not self.foreign.isdisjoint(stretch):
            return False
        # GNU's Library license is the older name of the Lesser one
        return not self.foreign or "library" in self.counts or ("gnu", "library") not in zip(stretch, stretch[1:])


class Scanner:
    """``templates``: (name, notice) pairs; a name may come several times."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.templates = [t for t in (Template(*pair) for pair in templates) if t.words]
        self.places = {name: i for i, name in enumerate(dict.fromkeys(name for name, _ in templates))}
        self.by_key: dict[str, list[Template]] = {}
        for t in self.templates:
            if t.key:
                self.by_key.setdefault(t.key, []).append(t)
        self.others = sorted((t for t in self.templates if not t.key), key=lambda t: len(t.words))

    def scan(self, text: str, least: float = COVERAGE) -> list[tuple[str, float, int, int]]:
        """(name, coverage, start, end in characters) of every find, templates in order.

        Stretches around the words of a template are aligned with it one after
        the other, so a text of any length is looked through and a notice that
        comes several times is found each time.
        """
        plain = [_plain(w) for w in _word.findall(text.lower())]
        have = set(plain)
        possible = [
            t
            for group in (*(self.by_key[w] for w in have & self.by_key.keys()), self.others)
            for t in group
            if len(plain) >= self._need(t, least) and t.possible(have, len(t.words) - self._need(t, least))
        ]
        if not possible:
            return []
        words, spans = words_of(text)
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        found = []
        for t in possible:
            found += self._finds(t, words, places, self._need(t, least))
        # of finds that overlap, the most words, weighted by the share of both sides that is aligned
        found.sort(key=lambda f: (-2 * f[1] ** 2 / (len(f[0].words) + f[3] - f[2] + 1), f[2], f[3], self.places[f[0].name]))
        taken: list[tuple[int, int]] = []
        kept = []
        for t, aligned, first, last in found:
            k = bisect_left(taken, (first, -1))
            if (k == len(taken) or taken[k][0] > last) and (k == 0 or taken[k - 1][1] < first):
                taken.insert(k, (first, last))
                kept.append((self.places[t.name], first, t, aligned, last))
        kept.sort(key=lambda f: f[:2])
        return [(t.name, round(n / len(t.words), 4), spans[first][0], spans[last][1]) for _, first, t, n, last in kept]

    @staticmethod
    def _need(t: Template, least: float) -> int:
        """Words that must be aligned."""
        return max(1, ceil(least * len(t.words) - 1e-9))

    @classmethod
    def _finds(cls, t: Template, words: list[str], places: dict[str, list[int]], need: int) -> list[tuple[Template, int, int, int]]:
        """(template, words aligned, first and last word) of finds that do not overlap."""
        found = []
        best: tuple[int, int, int] | None = None  # -(words aligned), first and last word
        line = len(t.words) <= LINE
        for i, stop in (cls._starts if line else cls._windows)(t, words, places, need):
            if best and i > best[2]:
                found.append((t, -best[0], best[1], best[2]))
                best = None
            pairs = align(t.words, words[i:stop])
            if not line:
                pairs = tight(pairs)
            if len(pairs) >= need and t.agrees(pairs, words, i):
                this = (-len(pairs), i + pairs[0][1], i + pairs[-1][1])
                # of stretches that overlap, the fullest, then the shortest
                if best and this[1] > best[2]:
                    found.append((t, -best[0], best[1], best[2]))
                    best = this
                elif not best or (this[0], this[2] - this[1]) < (best[0], best[2] - best[1]):
                    best = this
        if best:
            found.append((t, -best[0], best[1], best[2]))
        return found

    @staticmethod
    def _starts(t: Template, words: list[str], places: dict[str, list[int]], need: int) -> Iterator[tuple[int, int]]:
        """Stretches from a word of the template on that have its marks and enough of its words."""
        window = int(len(t.words) * SLACK) + 1
        hits = sorted(i for w in t.counts for i in places.get(w, ()))
        marks = [places.get(w, []) for w in t.marks]
        early = set(t.words[: len(t.words) - need + 1])
        stop = 0
        for k, i in enumerate(hits):
            while stop < len(hits) and hits[stop] < i + window:
                stop += 1
            if stop - k < need or words[i] not in early:
                continue
            at = [bisect_left(m, i) for m in marks]
            if all(a < len(m) and m[a] < i + window for a, m in zip(at, marks)):
                yield i, i + window

    @staticmethod
    def _windows(t: Template, words: list[str], places: dict[str, list[int]], need: int) -> Iterator[tuple[int, int]]:
        """Windows in which enough words of the template are; each stretch within the slack is in one."""
        step = max(1, len(t.words) // STEPS)
        window = int(len(t.words) * SLACK) + 1 + step
        for i in range(0, max(1, len(words) - need + 1), step):
            there = Counter(words[i : i + window])
            if t.marks <= there.keys() and sum(min(n, there[w]) for w, n in t.counts.items() if w in there) >= need:
                yield i, i + window


def default_templates() -> tuple[tuple[str, str], ...]:
    """One-line forms, headers and whole texts of common licenses."""
    return (*TEMPLATES.items(), *licenses.notices())


@cache
def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates)


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = COVERAGE,
) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, licenses, best, coverage, n_finds, spans.

    ``templates`` are notices by name, ``default_templates`` if none are given.
    ``licenses`` are the names found, in order of the templates, without repeats; ``best`` is the
    one with the largest coverage, the first of equals, NULL if none is found;
    ``spans`` are (license, start, end in characters).  Null and empty texts have
    no finds; repeated rows are scanned each; other columns are ignored.
    """
    given = tuple(templates.items()) if templates else default_templates()
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(given)
        span = pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            found = [scanner.scan(t, least) for t in texts_of(batch.column(1))]
            best = [max(f, key=lambda x: x[1]) if f else None for f in found]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([list(dict.fromkeys(x[0] for x in f)) for f in found], pa.list_(pa.string())),
                    pa.array([b and b[0] for b in best], pa.string()),
                    pa.array([b[1] if b else 0.0 for b in best], pa.float64()),
                    pa.array([len(f) for f in found], pa.int32()),
                    pa.array([[{"license": n, "start": s, "end": e} for n, _, s, e in f] for f in found], pa.list_(span)),
                ],
                names=["id", "licenses", "best", "coverage", "n_finds", "spans"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, licenses array<string>, best string, coverage double, n_finds int,"
        " spans array<struct<license:string,start:int,end:int>>"
    )
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
