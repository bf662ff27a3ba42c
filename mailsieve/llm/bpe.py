"""Byte-level BPE over whole batches: texts are cut into pre-tokens with array operations, and each distinct
pre-token is encoded once per task by the ``tokenizers`` library.

The cutting rule is that of the byte-level pre-tokenizer: contractions, then an optional space and a run of
letters, of digits or of other signs, then white space (a run before a word leaves its last character).
It is applied here to texts below LATIN; a text with a character beyond it, with a rare control character
or with an added token's string goes to the tokenizer whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from mailsieve.llm.textbytes import slices, span_hash

#: code points whose classes are the same in every Unicode version
LATIN = 0x250
SPACE, LETTER, NUMBER, OTHER = range(4)
#: control characters that libraries class differently
ODD = (0x1C, 0x1D, 0x1E, 0x1F, 0x85)
CACHE = 1_000_000
#: pre-tokens encoded in one text
JOIN = 4096
#: fixed values: the contractions, by their letters
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


def _class_table() -> np.ndarray:
    import unicodedata

    out = np.full(LATIN, OTHER, np.uint8)
    for c in range(LATIN):
        kind = unicodedata.category(chr(c))[0]
        if chr(c).isspace():
            out[c] = SPACE
        elif kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    return out


class Encoder:
    """Encodes string columns with the tokenizer file at ``path``."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.classes = _class_table()
        self._forget()

    def _forget(self) -> None:
        """Known pre-tokens: sorted hashes, and where each one's ids stand in ``flat``."""
        self.known, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _simple(self, points: np.ndarray, text: str) -> bool:
        return not (len(points) and points.max() >= LATIN) and not any(chr(c) in text for c in ODD) and not any(
            a in text for a in self.added)

    def batch(self, texts: pa.Array):
        """Per slice: (first row, token ids of all its texts end to end, number of ids per text)."""
        for piece in slices(texts, lower=False):
            strings = [piece.data[a:b].tobytes().decode() for a, b in zip(piece.starts, piece.ends)]
            whole = {i: np.array(self.whole.encode(s, add_special_tokens=False).ids, np.uint32)
                     for i, s in enumerate(strings)
                     if not self._simple(np.frombuffer(s.encode("utf-32-le"), np.uint32), s)}
            ids, count = self._encode(["" if i in whole else s for i, s in enumerate(strings)])
            if whole:
                parts = np.split(ids, np.cumsum(count)[:-1])
                for i, own in whole.items():
                    parts[i], count[i] = own, len(own)
                ids = np.concatenate(parts)
            yield piece.first, ids, count

    def _encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(s) for s in strings], np.int64)
        text = "".join(strings)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        edge = np.cumsum(size)
        starts = self._cuts(points, edge - size, edge)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(strings), np.int64)
        ends = np.append(starts[1:], len(points))
        key = span_hash(points, starts, ends)
        distinct, at, which = np.unique(key, return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self._forget()
        place = np.searchsorted(self.known, distinct)
        new = np.append(self.known, np.uint64(0))[place] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            first, count = self._encode_words([text[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            self.known, self.first, self.count = (
                np.insert(old, place[new], add) for old, add in ((self.known, distinct[new]), (self.first, first), (self.count, count)))
            place = np.searchsorted(self.known, distinct)
        row = place[which]
        lo, n = self.first[row], self.count[row]
        total = np.cumsum(n)
        ids = self.flat[np.repeat(lo - (total - n), n) + np.arange(total[-1])]
        upto = np.concatenate([[0], total])[np.searchsorted(starts, edge)]
        return ids, np.diff(upto, prepend=0)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Append the ids of pre-tokens to ``flat``; where each one's ids begin and how many there are.

        Those of a space and letters are cut apart again when they are joined, so they go to the tokenizer in one text.
        """
        count = np.zeros(len(words), np.int64)
        order: list[int] = []
        parts = [self.flat]
        joined = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == " " and w[1:].isalpha()]
        rest = [i for i, w in enumerate(words) if not (len(w) > 1 and w[0] == " " and w[1:].isalpha())]
        for at in range(0, len(joined), JOIN):
            some = joined[at:at + JOIN]
            code = self.whole.encode("".join([words[i] for i in some]), add_special_tokens=False)
            size = np.bincount(np.array(code.word_ids, np.int64), minlength=len(some))
            if len(size) != len(some):
                rest += some
                continue
            parts.append(np.array(code.ids, np.uint32))
            count[some] = size
            order += some
        for i, e in zip(rest, self.whole.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            parts.append(np.array(e.ids, np.uint32))
            count[i] = len(e.ids)
        order += rest
        first = np.zeros(len(words), np.int64)
        first[order] = len(self.flat) + np.cumsum(count[order]) - count[order]
        self.flat = np.concatenate(parts)
        return first, count

    def _cuts(self, points: np.ndarray, first: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Start of every pre-token; texts begin at ``first`` and end at ``edge``."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.classes[points]
        new_text = np.zeros(n + 1, bool)
        new_text[first] = True
        new_text[edge] = True
        run = np.append(True, kind[1:] != kind[:-1]) | new_text[:-1]
        cut = run.copy()
        # a white-space run before a word leaves its last character: a plain space joins the word
        run_at = np.flatnonzero(run)
        run_end = np.append(run_at[1:], n)
        space = kind[run_at] == SPACE
        before_word = space & ~new_text[run_end]
        last = run_end[before_word] - 1
        cut[last] = True
        joined = last[points[last] == 32]
        cut[joined + 1] = False
        # contractions: a lone apostrophe that begins a pre-token, followed by one of the suffixes
        quote = np.flatnonzero((points == 39) & cut)
        quote = quote[quote + 1 < n]
        quote = quote[~new_text[quote + 1] & (kind[np.minimum(quote + 1, n - 1)] == LETTER)]
        for q in quote.tolist():
            tail = points[q + 1:q + 3].tobytes().decode("utf-32-le")
            if new_text[q + 2] if q + 2 <= n else True:
                tail = tail[:1]
            for suffix in SUFFIXES:
                if tail.startswith(suffix):
                    end = q + 1 + len(suffix)
                    cut[q + 1] = False
                    if end < n:
                        cut[end] = True
                    break
        return np.flatnonzero(cut)




_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process, so that tasks share what it knows."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
