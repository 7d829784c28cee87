"""Token ids of whole texts with the ``tokenizers`` library.

A byte-level BPE never merges over the place between a visible character and a space after it, so a
text can be cut there and the parts encoded alone. Parts recur, so the different ones of many texts are looked up
once, and a task keeps the ids of those it has met; a new part goes to the library. The store has two halves: when the newer one is full, the older one is
dropped, which changes no id. What is met again in time moves to the newer half, so common parts stay.

A text that holds one of the vocabulary's added tokens (``<|endoftext|>``) goes to the library whole, as
the library looks for those before anything else. So ids are those of ``Tokenizer.encode(text,
add_special_tokens=False)`` for every text.

Defined results: an empty text has no ids; a caller gives an empty text for a null one.
"""

from __future__ import annotations

import ctypes
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts in each half of the store: some 60 MB a half.
LIMIT = 300_000
#: Characters of texts whose parts are looked up together, and parts whose ids are laid end to end at once.
CHARS = 4_000_000
AT_ONCE = 200_000

_encoders: dict[str, Encoder] = {}
#: glibc keeps freed memory for the process; elsewhere there is no such call.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values() if t.content]
        self._known: dict[object, bytes] = {}
        self._older: dict[object, bytes] = {}
        self._marks: dict[str, bytes] = {}
        # A run of letters after a space is one unit of a byte-level BPE, so it can go to the model itself.
        plain = self._tokenizer.normalizer is None and isinstance(self._tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and not self._tokenizer.pre_tokenizer.add_prefix_space
        self._model = self._tokenizer.model if plain else None

    def _word(self, word: str, space: str = " ") -> bytes | None:
        """Ids of a space, letters and the marks that end them, if the word is no more than that: the
        letters are one unit, the marks another."""
        letters = word.rstrip(_MARKS)
        if not letters.isalpha():
            return None
        ids = self._known.get(letters) if space and len(letters) < len(word) else None
        if ids is None:
            shown = f"{space}{letters}".encode().decode("latin-1").translate(_SHOWN)
            ids = array("I", [t.id for t in self._model.tokenize(shown)]).tobytes()
        return ids + self._mark(word[len(letters) :]) if len(letters) < len(word) else ids

    def _mark(self, marks: str) -> bytes:
        if marks not in self._marks:
            if len(self._marks) >= 10_000:
                self._marks.clear()
            self._marks[marks] = array("I", self._tokenizer.encode(marks, add_special_tokens=False).ids).tobytes()
        return self._marks[marks]

    def _learn(self, parts: list) -> None:
        known, rest, marked = self._known, [], []
        tokenize = self._model.tokenize if self._model is not None else None
        for p in parts:
            if tokenize is None or isinstance(p, tuple):
                rest.append(p)
            elif p.isascii() and p.isalpha():  # such letters stand for themselves in the vocabulary
                known[p] = array("I", [t.id for t in tokenize(f"{_SPACE}{p}")]).tobytes()
            else:
                marked.append(p)
        # Letters alone come first, so that those with marks after them find their ids.
        for p in marked:
            line, _, more = p.partition("\n")
            ids = None
            if not more:
                ids = self._word(p)
            elif (left := self._word(line)) and (right := self._word(more, "")):  # one white space alone is a unit
                ids = left + self._mark("\n") + right
            if ids is None:
                rest.append(p)
            else:
                known[p] = ids
        for i in range(0, len(rest), 1024):
            some = rest[i : i + 1024]
            # A first part stands alone in a tuple; the others follow a space.
            found = self._tokenizer.encode_batch_fast([p[0] if isinstance(p, tuple) else f" {p}" for p in some], add_special_tokens=False)
            known.update((p, array("I", e.ids).tobytes()) for p, e in zip(some, found))

    def _ids(self, parts: list) -> list[bytes]:
        """The ids of different parts: from the store, or learned."""
        known, older = self._known, self._older
        new = [p for p in parts if p not in known]
        if new:
            back = {p: older[p] for p in new if p in older}
            if known and len(known) + len(new) > LIMIT:
                back |= {p: known[p] for p in parts if p in known}
                self._known, self._older = known, older = {}, known
            known.update(back)
            self._learn([p for p in new if p not in back])
        return list(map(known.__getitem__, parts))

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; a part that recurs in these texts is looked up once."""
        spaced = [i for i, text in enumerate(texts) if _run(text)]  # two spaces in a row belong together
        split = {i: _edge.split(texts[i]) for i in spaced}
        lists = pc.split_pattern(pa.array(["" if i in split else text for i, text in enumerate(texts)] if split else texts, pa.large_string()), " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        first, count, words = ends[:-1].copy(), np.diff(ends), lists.values
        if split:
            more = [[parts[0], *[p[1:] for p in parts[1:]]] for parts in split.values()]
            count[spaced] = sizes = np.array([len(x) for x in more])
            first[spaced] = len(words) + np.cumsum(sizes) - sizes
            words = pa.concat_arrays([words, pa.array([p for x in more for p in x], pa.large_string())])
        coded = words.dictionary_encode()
        # A first part follows no space, so it is a part of its own.
        codes = coded.indices.to_numpy().astype(np.int64)
        heads = words.take(pa.array(first)).dictionary_encode()
        codes[first] = len(coded.dictionary) + heads.indices.to_numpy()
        used = np.bincount(codes, minlength=len(coded.dictionary) + len(heads.dictionary)) > 0
        place = np.cumsum(used) - 1
        kept = coded.dictionary.filter(pa.array(used[: len(coded.dictionary)]))
        parts = kept.to_numpy(zero_copy_only=False).tolist() + [(p,) for p in heads.dictionary.to_pylist()]
        ids = self._ids(parts)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4")
        a = 0
        while a < len(texts):  # some hundred thousand parts at a time, one text at least
            b = max(a + 1, a + int(np.searchsorted(np.cumsum(count[a:]), AT_ONCE, side="right")))
            many = count[a:b]
            to = np.cumsum(many) - many
            at = place[codes[np.arange(int(many.sum())) + np.repeat(first[a:b] - to, many)]]
            n = size[at]
            data = flat[np.arange(int(n.sum())) + np.repeat(start[at] - (np.cumsum(n) - n), n)].tobytes()
            end = 4 * np.cumsum(np.add.reduceat(n, to))
            for x, y in zip([0, *end[:-1].tolist()], end.tolist()):
                yield data[x:y]
            a = b

    def each(self, texts: list[str]) -> Iterator[bytes]:
        """``encode``, a text at a time."""
        whole = {i for i, text in enumerate(texts) if any(a in text for a in self._added)}
        own = iter(self._tokenizer.encode_batch_fast([texts[i] for i in sorted(whole)], add_special_tokens=False))
        for a, b in some_at_a_time(texts, CHARS):
            rest = self._some([t for i, t in enumerate(texts[a:b], a) if i not in whole])
            for i in range(a, b):
                yield array("I", next(own).ids).tobytes() if i in whole else next(rest)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return list(self.each(texts))

    def forget(self) -> None:
        """Empty the store and give its memory back, as a task ends whose worker lives on in steps that need no tokens."""
        self._known, self._older = {}, {}
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


def _bytes_shown() -> dict[int, str]:
    """How byte-level vocabularies write the bytes: the printable ones as they are, the others in
    order from the 256th character on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


_SHOWN = _bytes_shown()
_SPACE = " ".translate(_SHOWN)
_MARKS = ".,;:!?#$%&*|()[]{}<>/+-_=~^@"
_run = re.compile(r"\s ").search
_edge = re.compile(r"(?<=\S)(?= )")


def vocabulary_size(path: str) -> int:
    """Ids of the vocabulary, added tokens included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def some_at_a_time(texts: list[str | None], most_chars: int = 1_000_000):
    """(from, to) of runs of texts of about so many characters, at least one text each."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= most_chars:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
