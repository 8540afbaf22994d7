"""Scoring tokens cut from Arrow batches of texts: bounds in the batch's bytes by numpy, strings by those bounds.

Tokens are runs of ASCII letters and digits, so UTF-8 bytes tell them; offsets count
code points, the bytes that begin one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut at once, or one text.
PORTION = 1 << 20
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _strings(offsets: np.ndarray, data: np.ndarray, step: int, first: int) -> pa.Array:
    """Every ``step``-th of the strings of ``data`` that lie between neighbouring ``offsets``, from ``first`` on."""
    every = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data))
    return every.take(pa.array(np.arange(first, len(offsets) - 1, step)))


class Segments:
    """The tokens of some texts, one row each, in order of texts and places."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, empty: bool):
        """``bounds`` are those of the texts in ``data``; ``empty``: a text without tokens has one empty token at its end."""
        self.data, self.bounds = data, bounds
        alnum = _ALNUM[data]
        opens, closes = alnum.copy(), alnum.copy()
        opens[1:] &= ~alnum[:-1]
        closes[:-1] &= ~alnum[1:]
        full = bounds[1:] > bounds[:-1]
        for marks, at in ((opens, bounds[:-1][full]), (closes, bounds[1:][full] - 1)):
            marks[at] = alnum[at]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        text = np.searchsorted(bounds, s, "right") - 1
        if empty:
            bare = np.flatnonzero(np.bincount(text, minlength=len(bounds) - 1) == 0)
            at = np.searchsorted(text, bare)
            s, e, text = (np.insert(x, at, new) for x, new in ((s, bounds[bare + 1]), (e, bounds[bare + 1]), (text, bare)))
        self.s, self.e, self.text = s, e, text
        heads = np.ones(len(s), bool)
        heads[1:] = text[1:] != text[:-1]
        self.first = np.maximum.accumulate(np.where(heads, np.arange(len(s)), 0))
        self.idx = np.arange(len(s)) - self.first
        self.before, self.after = bounds[text], bounds[text + 1]
        self.before[1:][~heads[1:]] = e[:-1][~heads[1:]]
        self.after[:-1][~heads[1:]] = s[1:][~heads[1:]]

    def sentences(self, most: int) -> np.ndarray:
        """Sentence of each token in its text: cut where the gap has a line break or one of ``.!?`` before a blank, and every ``most`` tokens."""
        d = self.data
        breaks = np.concatenate([[0], np.cumsum(d == 10)])
        pairs = np.concatenate([[0], np.cumsum(np.isin(d[:-1], (46, 33, 63)) & np.isin(d[1:], (32, 9, 13))), [0]])
        ends = (breaks[self.s] > breaks[self.before]) | (pairs[np.maximum(self.s - 1, self.before)] > pairs[self.before])
        cuts = np.cumsum((self.idx > 0) & (ends | (self.idx % most == 0)))
        return (cuts - cuts[self.first]).astype(np.int32) if len(cuts) else cuts.astype(np.int32)

    def case_classes(self) -> np.ndarray:
        """``text.case_class`` of each token, which is ASCII letters and digits alone."""
        d, size = self.data, self.e - self.s
        among = [np.concatenate([[0], np.cumsum((d >= a) & (d <= b), dtype=np.int32)]) for a, b in ((48, 57), (65, 90), (97, 122))]
        digits, upper, lower = (x[self.e] - x[self.s] for x in among)
        initial = among[1][np.minimum(self.s + 1, len(d))] > among[1][self.s]
        tests = [size == 0, digits == size, 2 * digits > size, (upper == 0) & (lower > 0), (lower == 0) & (upper > 0), initial, digits > 0]
        return np.select(tests, list(range(7)), 0).astype(np.int32)

    def column(self, name: str, most: int) -> pa.Array:
        if name == "idx":
            return pa.array(self.idx.astype(np.int32))
        if name == "sent_idx":
            return pa.array(self.sentences(most))
        if name in ("start", "end"):
            points = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
            return pa.array((points[self.s if name == "start" else self.e] - points[self.bounds[self.text]]).astype(np.int32))
        if name == "case":
            return pa.array(self.case_classes())
        if name == "post_ws":
            return _strings(np.append(np.column_stack([self.e, self.after]).ravel(), self.after[-1:]), self.data, 2, 0) if len(self.s) else pa.array([], pa.string())
        cut = np.append(np.column_stack([self.before, self.s, self.e]).ravel(), self.e[-1:])
        return _strings(cut, self.data, 3, {"pre_ws": 0, "token": 1}[name]) if len(self.s) else pa.array([], pa.string())


def portions(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of neighbouring texts of ``PORTION`` bytes, or one text, with their bytes and the bounds of each; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + PORTION, "right")) - 1)
        end = min(end, len(texts))
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def token_batches(batches: Iterator[pa.RecordBatch], text: str, keep: list[str], columns: list[str], most: int, empty: bool) -> Iterator[pa.RecordBatch]:
    """``keep`` and ``columns`` for every token of ``text``."""
    for batch in batches:
        for start, end, data, bounds in portions(batch.column(text)):
            found = Segments(data, bounds, empty)
            own = pa.array(found.text + start)
            arrays = [batch.column(k).take(own) for k in keep] + [found.column(c, most) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *columns])


def sentence_batches(batches: Iterator[pa.RecordBatch], text: str, keep: list[str], lists: dict[str, str], most: int) -> Iterator[pa.RecordBatch]:
    """``keep``, sent_idx and ``lists``, the names of lists with what each has of the tokens, for every sentence of ``text``."""
    for batch in batches:
        for start, _, data, bounds in portions(batch.column(text)):
            found = Segments(data, bounds, False)
            sentence = found.sentences(most)
            new = np.ones(len(sentence), bool)
            new[1:] = (sentence[1:] != sentence[:-1]) | (found.text[1:] != found.text[:-1])
            at = np.flatnonzero(new)
            ends = pa.array(np.append(at, len(sentence)).astype(np.int32))
            own = pa.array(found.text[at] + start)
            arrays = [*(batch.column(k).take(own) for k in keep), pa.array(sentence[at]), *(pa.ListArray.from_arrays(ends, found.column(c, most)) for c in lists.values())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "sent_idx", *lists])
