"""Token ids of whole texts, each distinct piece of text encoded once per worker.

Both public vocabularies split a text before the white space in front of a word, so a piece
(a space and what follows up to the next one) always has the same ids wherever it stands.
Distinct pieces are encoded by the tokenizers library, many in one call, and kept; texts in
which a piece ends in white space, where that rule could fail, are encoded whole.
Most new pieces are one word, perhaps with a comma or full stop or a line break to another word.  Their
parts go to the library's model directly, without its normaliser and splitter, whose work on
such words is known; this is used only where a set of probes gives the library's own ids.
"""

import os
import re

import numpy as np

from quietlog.llm.common import held, ranges

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: Distinct pieces that a worker keeps; the store starts anew when it is full.
KEPT_PIECES = 300_000
#: Longer pieces are encoded one by one.
LONG_PIECE = 200
_MARK = "|"
#: No white space to Python, but to some libraries.
_ZERO_WIDTH = "\u180e\u200b\u2060\ufeff"


#: One word of Latin letters, a mark, and after a line break the same once more.
_WORD = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{1,60}"
_PLAIN = re.compile(f"({_WORD})([,.]?)(?:(\n)({_WORD})([,.]?))?")
_PROBES = ["the", "The", "thanor,", "THE.", "the.\nThe", "ab\ncd,", "d\u00e9j\u00e0", "\u00c9t\u00e9,", "\u00df", "a", "I.", "s\n\u00eat", "Xy.\nzW.", "donna", "\u00ff\u00d8"]


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    return [chr(b) if b in set(prints) else chr(256 + others.index(b)) for b in range(256)]


def default_file(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts to id arrays; ``file`` is a tokenizers JSON file."""

    def __init__(self, file: str, kept: int = KEPT_PIECES):
        from tokenizers import Tokenizer
        self.kept = kept
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary = self.tokenizer.get_vocab_size()
        mark = self._ids([_MARK, " " + _MARK])
        # With white space dropped, a lone mark between two pieces shows where one ends.
        self.drops_space = len(mark[0]) == 1 and mark[0].tolist() == mark[1].tolist()
        self.mark = mark[0][0] if self.drops_space else None
        self.opens = None
        if not self.drops_space:
            strings = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(strings.values()) + 1, bool)
            self.opens[[i for s, i in strings.items() if s.startswith("Ġ")]] = True  # byte-level sign of a space
        self.letters = _byte_letters()
        self.marks: dict[str, list[int]] = {}
        expected = self._ids([" " + p for p in _PROBES])
        self.plain = all(self._parts(_PLAIN.fullmatch(p)) == e.tolist() for p, e in zip(_PROBES, expected))
        self._start_over()

    def _parts(self, found: re.Match) -> list[int]:
        """Ids of a plain piece after a space."""
        first, mark, line, second, last = found.groups("")
        if self.drops_space:
            first, second, line = first.lower(), second.lower(), ""
            ids = self._word(first)
        else:
            ids = self._word(first, self.letters[32])
        if mark:
            ids += self._mark(mark)
        if second:
            if line:
                ids += self._mark(line)
            ids += self._word(second)
            if last:
                ids += self._mark(last)
        return ids

    def _word(self, word: str, before: str = "") -> list[int]:
        """Ids of a run of letters, with the letter that stands for a space before it."""
        if not word.isascii():
            word = "".join([self.letters[b] for b in word.encode()])
        return [t.id for t in self.tokenizer.model.tokenize(before + word)]

    def _mark(self, mark: str) -> list[int]:
        if mark not in self.marks:
            self.marks[mark] = [t.id for t in self.tokenizer.model.tokenize(self.letters[ord(mark)])]
        return self.marks[mark]

    def _start_over(self):
        self.places = Places()
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.unsafe = np.zeros(1 << 16, bool)
        self.ids = np.zeros(1 << 18, np.int32)
        self.size = 0

    def _ids(self, items: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(items, add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in found]

    def _store(self, ids: np.ndarray) -> int:
        """Append ids to the store; the position of the first."""
        at = self.size
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
        self.ids[at:at + len(ids)] = ids
        self.size += len(ids)
        return at

    def _keep(self, pieces: list[str], first: int) -> None:
        """Encode new pieces, each as it is after a space; they have the places from ``first``."""
        n = first + len(pieces)
        if n > len(self.starts):
            more = max(len(self.starts), n - len(self.starts))
            for name in ("starts", "lengths", "unsafe"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros(more, old.dtype)]))
        alone, plain, words = [], [], []
        for i, p in enumerate(pieces, first):
            found = _PLAIN.fullmatch(p) if self.plain else None
            if found:
                ids = self._parts(found)
                self.starts[i], self.lengths[i] = self.size + len(words), len(ids)
                words += ids
                continue
            (alone if _MARK in p or len(p) > LONG_PIECE or not p else plain).append(i)
            if not self.drops_space and (not p or p[-1].isspace() or p[-1] in _ZERO_WIDTH):
                self.unsafe[i] = True
        self._store(np.array(words, np.int32))
        for at in range(0, len(plain), 1024):
            group = plain[at:at + 1024]
            line = [pieces[i - first] for i in group]
            if self.drops_space:
                ids = self._ids([f" {_MARK} ".join([*line, ""])])[0]
                ends = np.flatnonzero(ids == self.mark)
                begins = np.concatenate([[0], ends[:-1] + 1])
            else:
                ids = self._ids(["".join([" " + p for p in line])])[0]
                begins = np.flatnonzero(self.opens[ids])
                ends = np.append(begins[1:], len(ids))
            if len(begins) == len(group) == len(ends):
                base = self._store(ids)
                self.starts[group], self.lengths[group] = base + begins, ends - begins
            else:
                alone += group
        for at in range(0, len(alone), 1024):
            group = alone[at:at + 1024]
            for i, part in zip(group, self._ids([" " + pieces[i - first] if pieces[i - first] else "" for i in group])):
                self.starts[i], self.lengths[i] = self._store(part), len(part)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text); call with a bounded amount of text."""
        if len(self.places) > self.kept:
            self._start_over()
        pieces: list[str] = []
        owners = np.zeros(len(texts), np.int64)
        heads: list[str] = []
        for i, text in enumerate(texts):
            parts = text.split(" ")
            if not self.drops_space:
                heads.append(parts[0])  # no space before it
                del parts[0]
            owners[i] = len(parts)
            pieces += parts
        known = len(self.places)
        at = np.fromiter(map(self.places.__getitem__, pieces), np.int64, len(pieces))
        if len(self.places) > known:
            self._keep(self.places.take_new(), known)
        lengths = self.lengths[at]
        cuts = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(owners)])]
        ids, counts = self.ids[ranges(self.starts[at], lengths)], np.diff(cuts)
        if self.drops_space:
            return ids, counts
        marks = np.concatenate([[0], np.cumsum(self.unsafe[at])])[np.concatenate([[0], np.cumsum(owners)])]
        odd = np.diff(marks) > 0  # white space meets white space: such a text is encoded as it stands
        for i, head in enumerate(heads):
            if head and owners[i] and (head[-1].isspace() or head[-1] in _ZERO_WIDTH):
                odd[i] = True
        begun = self._ids([texts[i] if odd[i] else head for i, head in enumerate(heads)])
        parts = []
        for i in range(len(texts)):
            parts.append(begun[i])
            if not odd[i]:
                parts.append(ids[cuts[i]:cuts[i + 1]])
        counts = np.where(odd, 0, counts) + np.fromiter(map(len, begun), np.int64, len(begun))
        return np.concatenate(parts) if parts else ids, counts


class Places(dict):
    """Places of pieces; an unknown piece gets the next one."""

    def __init__(self, first=()):
        super().__init__((piece, place) for place, piece in enumerate(first))
        self.new: list = []

    def __missing__(self, piece) -> int:
        place = self[piece] = len(self)
        self.new.append(piece)
        return place

    def take_new(self) -> list:
        new, self.new = self.new, []
        return new


def encoder(file: str, kept: int = KEPT_PIECES) -> Encoder:
    """The worker's encoder for a file, with a store of about ``kept`` pieces."""
    return held(("encoder", file, kept), lambda: Encoder(file, kept))


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each text."""
    result = np.insert(ids, np.cumsum(counts), end)
    return result, counts + 1
