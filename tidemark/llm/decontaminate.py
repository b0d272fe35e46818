"""Operator 2, benchmark decontamination with an Aho-Corasick automaton.

Benchmark items and documents have one normal form: the words of ``letters`` (NFKC, full case folding; letters, digits and
marks make words; a character of a script without spaces is a word by itself and weighs half). Each item gives its runs
of the weight of ``NGRAM`` words as patterns, or its whole text when that weighs ``SHORTEST`` to ``NGRAM``; what weighs
less says nothing inside a document, so it must be the whole text of one. Words of the benchmark are numbered and a
document becomes a string of these numbers, one letter a word. One automaton over such letters holds all patterns and
reads each document once; matches are mapped back to characters of the original. The documents are not shuffled.

Only the benchmark is broadcast. It doesn't grow with the corpus, but its size is checked: beyond ``PART_WORDS`` words,
some three million characters, it is divided, and each part's automaton reads the documents in a pass of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import CACHES, lean, pieces, small_batches, text_bytes
from tidemark.llm.letters import Words

NGRAM, SHORTEST, PART_WORDS = 8, 4, 500_000
#: Letters for an unknown word, a row's begin and its end; a known word has one letter, or two in a vocabulary of more than ONE_LETTER.
UNKNOWN, BEGIN, END, FIRST, ONE_LETTER = 1, 2, 3, 4, 1_000_000


def letters(ids: np.ndarray, wide: bool) -> np.ndarray:
    """Code points for word numbers; -1 is an unknown word. Surrogates are left out."""
    if wide:  # the first and the second letter are from alphabets of their own
        out = np.full((len(ids), 2), UNKNOWN, np.uint32)
        some = ids >= 0
        out[some, 0], out[some, 1] = FIRST + ids[some] // 500_000, 0xE000 + ids[some] % 500_000
        return out.ravel()
    out = (ids + FIRST).astype(np.uint32)
    out[out >= 0xD800] += 0x800
    out[ids < 0] = UNKNOWN
    return out


def spell(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le")


def item_runs(words: Words) -> list[tuple[int, int, bool]]:
    """(first word, end, must it be a whole text) of the patterns of one item."""
    n = len(words.hash)
    weight = np.where(words.alone, 1, 2) if words.alone is not None else np.full(n, 2)
    sums = np.concatenate([[0], np.cumsum(weight)])
    if sums[-1] < 2 * NGRAM:
        return [(0, n, bool(sums[-1] < 2 * SHORTEST))] if n else []
    ends = np.searchsorted(sums, sums[:-1] + 2 * NGRAM)
    return [(i, int(e), False) for i, e in enumerate(ends) if e <= n]


class Patterns:
    """The automaton of some items, with their vocabulary."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        made = []
        for item, text in items:
            raw = np.frombuffer(text.encode(errors="replace"), np.uint8)
            w = Words(raw, np.array([0, len(raw)]))
            made.append((item, w.hash, item_runs(w)))
        self.known = np.unique(np.concatenate([h for _, h, _ in made])) if made else np.zeros(0, np.uint64)
        self.wide = len(self.known) > ONE_LETTER
        found: dict[str, set[int | None]] = {}
        for item, h, runs in made:
            text, each = spell(letters(np.searchsorted(self.known, h), self.wide)), 1 + self.wide
            for i, e, whole in runs:
                pattern = text[i * each : e * each]
                found.setdefault(chr(BEGIN) + pattern + chr(END) if whole else pattern, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for pattern, of in found.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(sorted(of, key=lambda x: (x is None, x or 0)))))
        self.automaton.make_automaton()

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, start, end) of every pattern, in characters of the original."""
        if not len(self.automaton):
            return
        data, offsets = text_bytes(texts)
        for lo, hi in pieces(offsets):
            w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            at = np.minimum(np.searchsorted(self.known, w.hash), len(self.known) - 1)
            code = letters(np.where(self.known[at] == w.hash, at, -1), self.wide)
            each = 1 + self.wide
            row = np.repeat(np.arange(hi - lo), np.diff(w.first))
            text = np.empty(len(code) + 2 * (hi - lo), np.uint32)  # every row between its marks
            rows = np.arange(hi - lo)
            text[w.first[:-1] * each + 2 * rows], text[w.first[1:] * each + 2 * rows + 1] = BEGIN, END
            text[np.arange(len(code)) + 2 * np.repeat(row, each) + 1] = code
            hits = [(end, size, items) for end, (size, items) in self.automaton.iter(spell(text))]
            if not hits:
                continue
            end, size = (np.array([h[k] for h in hits]) for k in (0, 1))
            of = np.searchsorted(w.first * each + 2 * np.arange(hi - lo + 1), end, "right") - 1
            end -= text[end] == END
            begin = np.array([h[0] for h in hits]) - size + 1
            begin += text[begin] == BEGIN
            first, last = (begin - 2 * of - 1) // each, (end - 2 * of - 1) // each
            starts, ends = w.chars(first, last)
            for k, (_, _, items) in enumerate(hits):
                for item in items:
                    yield lo + int(of[k]), item, int(starts[k]), int(ends[k])


_built: dict[str, Patterns] = {}
CACHES["automaton"] = _built.clear


class _Part:
    """Broadcast items; their patterns are built once in each worker, and ``id`` tells parts apart by their content."""

    def __init__(self, spark: SparkSession, items: list[tuple[int | None, str]]) -> None:
        self.shared, self.id = spark.sparkContext.broadcast(items), hashlib.md5(repr(items).encode(errors="replace")).hexdigest()

    def patterns(self) -> Patterns:
        if self.id not in _built:
            made = Patterns(self.shared.value)
            _built.clear()
            _built[self.id] = made
        return _built[self.id]


def _parts(spark: SparkSession, benchmark: DataFrame, item_id: str, text: str) -> list[_Part]:
    parts, size = [[]], 0
    for item, t in benchmark.select(F.col(item_id).cast("long"), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        n = len(t) // 6 + 1
        if size and size + n > PART_WORDS:
            parts.append([])
            size = 0
        parts[-1].append((item, t))
        size += n
    return [_Part(spark, p) for p in parts]


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end): each passage of ``text[start:end]`` whose words an item has too.

    Overlapping runs of one item are one passage. A null text or an empty one has no passages, and one of few words only
    an item that it is as a whole; texts are read to their end, however long. A null id stays null; repeated rows are
    reported each; an empty table on either side gives an empty table. Items with one text are all reported, and so is
    an item with a null id, as null. Other columns are never read, whatever their names. Both ids must be integers.
    """
    schema = "id long, item long, `from` int, `to` int"

    def scan(part: _Part):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = part.patterns()
            for batch in batches:
                spans: dict[tuple[int, int], list[list[int]]] = {}
                for row, item, start, end in a.matches(batch.column("t")):
                    of = spans.setdefault((row, item), [])
                    if of and start <= of[-1][1]:
                        of[-1][1] = max(end, of[-1][1])
                    else:
                        of.append([start, end])
                rows = [(row, item, s, e) for (row, item), of in spans.items() for s, e in of]
                cols = list(zip(*rows)) or [(), (), (), ()]
                ids = batch.column("id").take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["id", "item", "from", "to"])

        return run

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).where("t IS NOT NULL")
    found = None
    for part in _parts(docs.sparkSession, benchmark, item_id, item_text):
        one = rows.mapInArrow(lean(scan(part), keep="automaton"), schema)
        found = one if found is None else found.unionByName(one)
    return found.select(F.col("id").alias(doc_id), F.col("item").alias(item_id), F.col("from").alias("start"), F.col("to").alias("end"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark.

    Rows with a null or empty text stay, and so do repeated rows and all columns, whatever their names. Texts are read to
    their end. An empty table on either side leaves ``docs`` as it is. No shuffle.
    """

    def keep(part: _Part):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = part.patterns()
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                for row, *_ in a.matches(batch.column(text)):
                    mask[row] = False
                yield batch.filter(pa.array(mask))

        return run

    small_batches(docs.sparkSession)
    out = docs
    for part in _parts(docs.sparkSession, benchmark, item_id, item_text):
        out = out.mapInArrow(lean(keep(part), keep="automaton"), docs.schema)
    return out
