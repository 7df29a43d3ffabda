"""Token ids of whole texts by a public tokenizer file, fast enough for a corpus.

Both pre-tokenizers in use end a token where a blank follows another character, so a text is cut before its
single blanks (or, where blanks stand in runs, before each run) and the stretches are encoded on their own, each distinct one
once.  New stretches are encoded many at a time, as one text, and told apart in the result by
their tokens: one that opens with a blank opens a stretch (byte-level), or so many word ends close one
(word-level).  Whatever does not add up is encoded alone; a tokenizer that fails the probes gets whole texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STRETCH = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+$")
#: White space that may join with a blank beyond a cut: a text with such a stretch is encoded whole.
_ODD = re.compile(r"^\s|[^\S\n]|[\x1c-\x1f\x85]")
_ODD_RUN = re.compile(r"[^\S \n\t]|[\x1c-\x1f\x85]")
_WORD = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-^`{-~]+)?")
_PROBES = ("a  b\n\n c\t d", " x y ", "don't  stop\n", "", "   ", "é ç\ńb", "a　b  c", "<|endoftext|> a", "1 2  34 !!  ?? a_b", "ab\r\n cd", "one two\n three. four", "a \nb", "x\n\n y z")
_CHUNK = 200
#: Bytes of text that are cut and numbered at once.
SLAB = 8 << 20
_NEW, _ALONE = -2, -1


class Encoder:
    """Whole texts to ids.  ``keep`` bounds the stretches remembered, and 16 times as many their characters.

    A stretch is remembered as a number; the ids of number ``i`` are ``pool[starts[i] : starts[i] + sizes[i]]``.
    """

    def __init__(self, path: str, keep: int = 1_300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallel work
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        vocabulary = t.get_vocab(with_added_tokens=True)
        top = max(vocabulary.values(), default=0)
        self.kind = np.dtype("<u2" if top < 65536 else "<u4")
        self.suffix = getattr(t.model, "end_of_word_suffix", None) or None
        self.mark = np.zeros(top + 1, bool)
        for token, i in vocabulary.items():
            self.mark[i] = token.endswith(self.suffix) if self.suffix else token.startswith("Ġ")
        self.keep = keep
        self._clear()
        self.cut = True
        self.cut = all(self.encode_all([p]) == [self.whole(p).tobytes()] for p in _PROBES)

    def _clear(self) -> None:
        self.known: dict[str, int] = {"": _ALONE, "\0": 0}
        self.brief: list[str] = []
        self.chars = self.used = 0
        self.n = 1
        self.pool, self.starts = np.zeros(1 << 16, self.kind), np.zeros(1 << 14, np.int64)
        self.sizes, self.uses = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Numbers of new stretches, whose ids lie one after another."""
        first, last, end = self.n, self.n + len(sizes), self.used + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(end - len(self.pool), len(self.pool) // 2), self.kind)])
        if last > len(self.sizes):
            more = np.zeros(max(last - len(self.sizes), len(self.sizes) // 2), np.int32)
            self.starts, self.sizes, self.uses = (np.concatenate([x, more]) for x in (self.starts, self.sizes, self.uses))
        self.pool[self.used : end] = ids
        self.sizes[first:last] = sizes
        self.starts[first:last] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = last, end
        return range(first, last)

    def _forget(self) -> None:
        """Make room: the half of the stretches that were used most often stays."""
        names = [s for s, i in self.known.items() if i > 0 and len(s) < 64]
        at = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        uses, half = self.uses[at], self.keep // 2
        if len(at) > half:
            least = int(np.partition(uses, len(uses) - half)[len(uses) - half])
            stay = np.flatnonzero(uses > least)
            names, at = [names[i] for i in stay.tolist()], at[stay]
        ids, sizes, uses = self.pool[_spans(self.starts[at], self.sizes[at])], self.sizes[at], self.uses[at]
        self._clear()
        numbers = self._add(ids, sizes)
        self.known.update(zip(names, numbers))
        self.uses[numbers.start : numbers.stop] = uses // 2
        self.chars = sum(map(len, names))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.dtype("<u4"))

    @staticmethod
    def stretches(text: str | None) -> list[str]:
        """Pieces that make up the text; those after the first begin with a blank, which is left out if it is single."""
        if not text:
            return []
        parts = text.split(" ")
        if "" in parts:  # runs of blanks, or one at an end
            return ["\0" + s for s in _STRETCH.findall(text)]
        parts[0] = "\0" + parts[0]
        return parts

    def _join(self, text: str) -> np.ndarray:
        at = self._numbers(self.stretches(text))
        return self.whole(text) if (at < 0).any() else self.pool[_spans(self.starts[at], self.sizes[at])]

    def encode_all(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for _, _, flat, edges in self.slabs(texts):
            raw, at = flat.astype("<u4").tobytes(), (4 * edges).tolist()
            out += [raw[a:b] for a, b in zip(at, at[1:])]
        return out

    def slabs(self, texts: pa.Array | list[str | None], end: int | None = None, limit: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``first row, last row + 1, ids, edges``: the ids of the rows one after another, ``end`` behind each, and where each begins.

        The rows are taken in slabs of about ``limit`` bytes of text; a null is empty.
        """
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < len(column):
            base = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, base + limit, "right")))
            yield lo, hi, *self._slab(pc.fill_null(column.slice(lo, hi - lo), ""), end)
            lo = hi

    def _slab(self, column: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        for s in self.brief:
            self.known.pop(s, None)
        self.brief = []
        if len(self.known) > self.keep or self.chars > 16 * self.keep or self.used > 16 * self.keep:
            self._forget()
        if self.cut:
            at, offsets = self._cut(column)
        else:
            at, offsets = np.full(len(column), _ALONE, np.int64), np.arange(len(column) + 1)
        # Runs of blanks, blanks at an end, and stretches that do not stand alone: such texts go by themselves, as one stretch.
        before, used = self.n, self.used
        alone = np.flatnonzero(np.add.reduceat(at < 0, offsets[:-1]) > 0) if len(column) else np.zeros(0, np.int64)
        if len(alone):
            texts = [column[i].as_py() for i in alone.tolist()]
            ids = [self._join(t) if self.cut else self.whole(t) for t in texts]
            before, used = self.n, self.used
            count = np.diff(offsets)
            keep = np.repeat(~np.isin(np.arange(len(count)), alone), count)
            keep[offsets[alone]] = True
            at[offsets[alone]] = self._add(np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))
            count[alone] = 1
            at, offsets = at[keep], np.r_[0, np.cumsum(count)]
        if end is not None:
            at = np.insert(at, offsets[1:], self._add(np.array([end]), np.ones(1, np.int64))[0])
            offsets = offsets + np.arange(len(offsets))
        sizes = self.sizes[at]
        flat = self.pool[_spans(self.starts[at], sizes)]
        self.n, self.used = before, used  # texts and the end are no stretches to remember
        return flat, np.r_[0, np.cumsum(sizes, dtype=np.int64)][offsets]

    def _cut(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the stretches of each text, one text after another, and where each begins."""
        parts = pc.split_pattern(column, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        values = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        numbered = values.dictionary_encode()
        # The first stretch of a text has no blank before it: it has a number of its own.
        heads = ["\0" + s for s in values.take(pa.array(offsets[:-1])).to_pylist()]
        names = self._numbers(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = names[numbered.indices.to_numpy()]
        # a head that is empty while more follows is a blank at the front
        first = self._numbers(heads)
        first[(first == 0) & (np.diff(offsets) > 1)] = _ALONE
        at[offsets[:-1]] = first
        self.uses[: self.n] += np.bincount(at[at > 0], minlength=self.n).astype(np.int32)
        return at, offsets

    def _numbers(self, names: list[str]) -> np.ndarray:
        """The numbers of the named stretches, after learning those that are new."""
        found = np.fromiter(map(self.known.get, names, repeat(_NEW)), np.int64, len(names))
        holes = np.flatnonzero(found == _NEW).tolist()
        if holes:
            self._learn(list({names[i]: None for i in holes}))
            found[holes] = [self.known[names[i]] for i in holes]
        return found

    def _parts(self, s: str) -> list[str] | None:
        """Simpler stretches whose ids make up those of ``s``: its lines, or a word and the marks behind it."""
        if "\n" in s:
            lines = s.split("\n")
            if "" in lines:
                return None
            return lines if self.suffix else lines[:1] + [x for line in lines[1:] for x in ("\0\n", "\0" + line)]
        if (m := _WORD.fullmatch(s)) and m[2] and m[1][-1] < "\u0250":  # letters beyond may be none to the tokenizer
            return [m[1], m[2] if self.suffix else "\0" + m[2]]
        return None

    def _learn(self, new: list[str]) -> None:
        self.chars += sum(map(len, new))
        single, made, parts = [], [], []
        for s in new:
            if s[0] != "\0":
                if not s.isalnum() and _ODD.search(s):
                    self.known[s] = _ALONE
                elif not s.isalpha() and (p := self._parts(s)):
                    made.append(s)
                    parts.append(p)
                    if len(p) > 2:  # lines that meet hardly come again
                        self.brief.append(s)
                else:
                    single.append(s)
            elif _ODD_RUN.search(s):
                self.known[s] = _ALONE
            else:
                single.append(s)
        self._encode(single)
        if made:
            at = self._numbers([x for p in parts for x in p])
            edges = np.r_[0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]
            whole = np.minimum.reduceat(at, edges[:-1]) >= 0
            self.known.update(zip(made, repeat(_ALONE)))
            at = at[np.repeat(whole, np.diff(edges))]
            count = np.diff(edges)[whole]
            sizes = self.sizes[at]
            numbers = self._add(self.pool[_spans(self.starts[at], sizes)], np.add.reduceat(sizes, np.cumsum(count) - count) if len(count) else count)
            self.known.update(zip([s for s, w in zip(made, whole.tolist()) if w], numbers))

    def _encode(self, new: list[str]) -> None:
        alone = [(s, s[1:]) for s in new if s[0] == "\0"]
        if self.suffix is None:
            together = [s for s in new if s[0] != "\0"]
        else:  # words of letters alone have one end of a word each
            together = [s for s in new if s.isalpha() and (s.isascii() or s.lower().isalpha())]
            alone += [(s, " " + s) for s in new if s[0] != "\0" and not (s.isalpha() and (s.isascii() or s.lower().isalpha()))]
        chunks = [together[i : i + _CHUNK] for i in range(0, len(together), _CHUNK)]
        for lo in range(0, len(chunks), 64):
            part = chunks[lo : lo + 64]
            for names, e in zip(part, self._batch([" " + " ".join(names) for names in part])):
                ids = np.array(e.ids, np.int64)
                marks = np.flatnonzero(self.mark[ids])
                if len(marks) != len(names):
                    alone += [(s, " " + s) for s in names]
                    continue
                edges = np.r_[marks, len(ids)] if self.suffix is None else np.r_[0, marks + 1]
                self.known.update(zip(names, self._add(ids, np.diff(edges))))
        for lo in range(0, len(alone), 4096):
            part = alone[lo : lo + 4096]
            ids = [e.ids for e in self._batch([s for _, s in part])]
            numbers = self._add(np.concatenate([np.array(x, np.int64) for x in ids]), np.fromiter(map(len, ids), np.int64, len(ids)))
            self.known.update(zip([name for name, _ in part], numbers))

    def _batch(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans, one span after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (len(starts) == 0 or int((starts + sizes).max()) < 1 << 31) else np.int64
    places = np.repeat((starts - ends + sizes).astype(kind), sizes)
    places += np.arange(total, dtype=kind)
    return places


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str, keep: int = 1_300_000) -> Encoder:
    """The encoder of a public tokenizer file; a Python worker keeps it from task to task."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(tokenizer_file(name), keep)
    return _ENCODERS[name]


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
