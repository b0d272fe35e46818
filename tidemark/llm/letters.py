"""Words of texts in any script, in one normal form, with their places in the original.

The form is NFKC with full case folding. Letters, digits and marks make words, everything else parts them. A character
of a script that is written without spaces is a word by itself. Bytes that are no ASCII letters or digits part a text;
what has ASCII only between them is a word already, and of the others each distinct one is normalised once, on arrays of
code points. Only sequences with combining marks are handled one by one.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from tidemark.llm.common import _P, _PINV, NOT_ALNUM, UNSPACED, mix, powers, word_hashes, words

GAP, WORD, ALONE = 0, 1, 2
_TOP = 0x20000
_VALUE = np.uint64(0x9E3779B97F4A7C15)
_ascii = np.arange(256, dtype=np.uint64)
_ascii[65:91] += np.uint64(32)
_ASCII = mix(_ascii + _VALUE)


def _form(s: str) -> str:
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", s).casefold())


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """(kind, joins the character before it, length of the normal form, its first place in, all normal forms)."""
    kind, joins, size, at, flat = np.zeros(_TOP, np.uint8), np.zeros(_TOP, bool), np.ones(_TOP, np.uint8), np.arange(_TOP, dtype=np.int32), list(range(_TOP))
    for c in range(_TOP):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        group = unicodedata.category(x)[0]
        kind[c] = WORD if group in "LNM" else GAP
        joins[c] = group == "M" or 0x1160 <= c <= 0x11FF
        if c < 128 and not x.isupper():
            continue
        f = _form(x)
        if f != x and f:
            at[c], size[c] = len(flat), len(f)
            flat += map(ord, f)
    for lo, hi in UNSPACED[:-1]:
        some = kind[lo : hi + 1] == WORD
        kind[lo : hi + 1][some] = ALONE
    return kind, joins, size, at, np.array(flat, np.uint32)


def points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, first one of each row) of UTF-8 rows; what isn't UTF-8 is U+FFFD."""
    raw = data.tobytes()
    if not len(data) or int(data.max()) < 128:
        return data.astype(np.uint32), offsets
    try:
        cps = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
        return cps, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    except UnicodeDecodeError:
        rows = [raw[a:b].decode(errors="replace") for a, b in zip(offsets, offsets[1:])]
        return np.frombuffer("".join(rows).encode("utf-32-le"), "<u4"), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def normal_words(cps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end, is it one of a script without spaces, first word of each row) of the words; begin and end are places in ``cps``."""
    kinds, joining, size, where, flat = _tables()
    n = len(cps)
    none = np.zeros(0, np.int64)
    if not n:
        return none.astype(np.uint64), none, none, none.astype(bool), np.zeros(len(first), np.int64)
    low = np.minimum(cps, _TOP - 1).astype(np.int64)
    high = cps >= _TOP
    starts_row = np.zeros(n + 1, bool)
    starts_row[first] = True
    starts_row = starts_row[:n]
    joins = joining[low] & ~high & ~starts_row
    count = np.where(high, 1, size[low]).astype(np.int64)
    special: list[tuple[int, np.ndarray]] = []
    stop = np.arange(1, n + 1)
    if joins.any():  # a character and the marks after it are normalised together
        heads = np.flatnonzero(~joins & np.append(joins[1:], False))
        ends = np.searchsorted(np.flatnonzero(~joins), heads, "right")
        whole = np.append(np.flatnonzero(~joins), n)
        text = cps.tobytes().decode("utf-32-le", "replace")
        for a, b in zip(heads.tolist(), whole[ends].tolist()):
            f = np.frombuffer(_form(text[a:b]).encode("utf-32-le", "replace"), "<u4")
            count[a:b] = 0
            count[a] = len(f)
            stop[a:b] = b
            special.append((a, f))
    if (count == 1).all():
        source, inner = np.arange(n), None
        out = np.where(high, cps, flat[where[low]])
    else:
        source = np.repeat(np.arange(n), count)
        place = np.cumsum(count) - count
        inner = np.arange(len(source)) - place[source]
        out = np.where(high[source], cps[source], flat[np.minimum(where[low[source]] + inner, len(flat) - 1)])
        for a, f in special:
            out[place[a] : place[a] + len(f)] = f
    m = len(out)
    kind = np.where(out < _TOP, kinds[np.minimum(out, _TOP - 1)], np.where((out < 0x323B0), ALONE, GAP))
    row_start = np.zeros(m, bool)
    row_start[np.searchsorted(source, first[:-1][first[:-1] < first[1:]])[:]] = True if m else False
    solid, plain = kind > 0, kind == WORD
    before = np.concatenate([[False], plain[:-1]]) & ~row_start
    after = np.concatenate([plain[1:] & ~row_start[1:], [False]])
    begin = np.flatnonzero(solid & ((kind == ALONE) | ~before))
    end = np.flatnonzero(solid & ((kind == ALONE) | ~after)) + 1
    value = mix(out.astype(np.uint64) + _VALUE)
    sums = np.zeros(m + 1, np.uint64)
    np.multiply(value, powers(m, _P), out=sums[1:])
    np.cumsum(sums, out=sums)
    h = mix((sums[end] - sums[begin]) * powers(m + 1, _PINV)[begin])
    return h, source[begin], stop[source[end - 1]], kind[begin] == ALONE, np.searchsorted(source[begin], first)


class Words:
    """The words of UTF-8 rows: ``hash``, ``alone`` (of a script without spaces), ``first`` (the first word of each row)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self.start, end, first = words(data, offsets, NOT_ALNUM)
        h = word_hashes(data, self.start, end, _ASCII)
        wide = np.concatenate([[0], np.cumsum(data >= 0x80)])
        odd = np.flatnonzero(wide[end] > wide[self.start])
        if not len(odd):
            self.hash, self.alone, self.first, self.of = h, None, first, None
            self.begin, self.end = 0, end - self.start
            return
        _, lead, same = np.unique(h[odd], return_index=True, return_inverse=True)
        lead = odd[lead]
        size = end[lead] - self.start[lead]
        bounds = np.concatenate([[0], np.cumsum(size)])
        raw = data[np.repeat(self.start[lead] - bounds[:-1], size) + np.arange(bounds[-1])]
        cps, of_row = points(raw, bounds)
        ph, pb, pe, pa_, pf = normal_words(cps, of_row)
        parts = np.ones(len(h), np.int64)
        parts[odd] = np.diff(pf)[same]
        self.of = np.repeat(np.arange(len(h)), parts)
        at = np.cumsum(parts) - parts
        self.first = np.append(at, len(self.of))[first]
        self.hash, self.alone = h[self.of], np.zeros(len(self.of), bool)
        self.begin, self.end = np.zeros(len(self.of), np.int64), (end - self.start)[self.of]
        n = parts[odd]
        to = np.repeat(at[odd], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        k = np.repeat(pf[:-1][same], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.hash[to], self.alone[to] = ph[k], pa_[k]
        base = of_row[:-1][np.searchsorted(pf, k, "right") - 1]
        self.begin[to], self.end[to] = pb[k] - base, pe[k] - base

    def chars(self, some: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first character of each word of ``some``, the one after each of ``until``), counted in the rows' characters."""
        count = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        of = (lambda i: i) if self.of is None else self.of.__getitem__
        begin = self.begin if self.of is None else self.begin[some]
        zero = count[self.offsets[np.searchsorted(self.first, some, "right") - 1]]
        return count[self.start[of(some)]] + begin - zero, count[self.start[of(until)]] + self.end[until] - zero
