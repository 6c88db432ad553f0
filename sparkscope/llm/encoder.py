"""Whole texts to ids with a tokenizers file; repeated chunks of text are looked up, not encoded again."""

from __future__ import annotations

import re
import unicodedata
from array import array
from itertools import chain, compress

import numpy as np

#: Entries that stay in a lookup, and those beyond them that are dropped again when as many have come.
KEPT, EXTRA, CLEARS = 300_000, 100_000, 20
_BEFORE_WORD = re.compile(r" (?=\S)")
_SEPARATORS = re.compile("[\x1c-\x1f]")


class Lookup(dict):
    """A bounded dictionary to numbers; misses get the next number and are remembered in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.extra: list[str] = []
        self.cleared = 0

    def __missing__(self, key):
        number = len(self.new) + self.known
        self.new.append(key)
        self[key] = number
        return number

    known = 0


class Pool:
    """Rows of ids under running numbers, in one growing array."""

    def __init__(self):
        self.ids, self.at, self.rows = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def add(self, rows: list[bytes]) -> None:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        end = int(self.at[self.rows])
        ends = end + np.cumsum(sizes)
        n = self.rows + len(rows)
        if n + 1 > len(self.at):
            self.at = np.concatenate([self.at[: self.rows + 1], np.zeros(n + 1, np.int64)])
        self.at[self.rows + 1 : n + 1] = ends
        last = int(ends[-1]) if len(ends) else end
        if last > len(self.ids):
            self.ids = np.concatenate([self.ids[:end], np.zeros(last, np.uint32)])
        self.ids[end:last] = np.frombuffer(b"".join(rows), np.uint32)
        self.rows = n

    def cut(self, rows: int) -> None:
        self.rows = rows

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows one after the other, and the number of ids of each."""
        sizes = self.at[numbers + 1] - self.at[numbers]
        total = np.cumsum(sizes)
        n = int(total[-1]) if len(total) else 0
        index = np.repeat(self.at[numbers] - (total - sizes), sizes)
        index += np.arange(n)
        return self.ids[index], sizes


class Chunked:
    """Encodes texts from chunks that the merges can never join; subclasses say how to cut and encode.

    ``cut(text)`` gives chunks whose encodings, one after the other, are the text's encoding.
    ``encode_new(chunks)`` gives each chunk's ids as little-endian 32-bit bytes.
    """

    def __init__(self):
        self.known, self.pool = Lookup(), Pool()

    def cut(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode_new(self, chunks: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the places where each text's ids begin (one more than texts); ``end`` closes each text."""
        known = self.known
        known.known = self.pool.rows
        find = known.__getitem__
        numbers = [np.fromiter(map(find, chunks), np.int64, len(chunks)) for chunks in map(self.cut, texts)]
        new = known.new
        if new:
            self.pool.add(self.encode_new(new))
        per_text = np.fromiter(map(len, numbers), np.int64, len(numbers))
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        ids, sizes = self.pool.gather(flat)
        before = np.concatenate([[0], np.cumsum(sizes)])
        at = before[np.concatenate([[0], np.cumsum(per_text)])]
        if end is not None and len(texts):
            ids = np.insert(ids, at[1:], end)
            at = at + np.arange(len(at))
        self._forget(new)
        return ids, at

    def _forget(self, new: list[str]) -> None:
        known = self.known
        if self.pool.rows > KEPT:
            known.extra += new
            if len(known.extra) > EXTRA:
                for key in known.extra:
                    del known[key]
                self.pool.cut(self.pool.rows - len(known.extra))
                known.extra, known.cleared = [], known.cleared + 1
                if known.cleared > CLEARS:  # the text may have changed its kind meanwhile
                    self.known, self.pool = Lookup(), Pool()
        self.known.new = []


class Pieces:
    """Ids of pieces (matches of the pattern), encoded by the tokenizers library once each."""

    def __init__(self, path: str):
        self.load(path)
        self.ids: dict[str, bytes] = {}
        self.extra: list[str] = []
        self.cleared = 0

    def load(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def raw(self, strings: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(strings), 4096):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(strings[i : i + 4096], add_special_tokens=False)]
        return out

    def encode(self, lists: list[list[str]]) -> list[bytes]:
        ids = self.ids
        new = list({p for p in chain.from_iterable(lists) if p not in ids})
        ids.update(zip(new, self.raw(new)))
        get = ids.__getitem__
        out = [get(found[0]) if len(found) == 1 else b"".join(map(get, found)) for found in lists]
        if len(ids) > KEPT:
            self.extra += new
            if len(self.extra) > EXTRA:
                for key in self.extra:
                    del ids[key]
                self.extra, self.cleared = [], self.cleared + 1
                if self.cleared > CLEARS:
                    ids.clear()
                    self.cleared = 0
        return out


class WordPieces(Pieces):
    """Pieces of a file with word ends. Those of ASCII or of letters go through the library many at a time and are told apart by their ends."""

    def load(self, path: str) -> None:
        super().load(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(words.values(), default=0) + 1, bool)
        self.ends[[i for word, i in words.items() if suffix and word.endswith(suffix)]] = True

    def raw(self, strings: list[str]) -> list[bytes]:
        apart = [s.isascii() or s.isalpha() for s in strings]
        plain = list(compress(strings, apart))
        out: list[bytes] = []
        for i in range(0, len(plain), 4096):
            out += self._cut(plain[i : i + 4096])
        if len(plain) == len(strings):
            return out
        one, other = iter(out), iter(super().raw([s for s, own in zip(strings, apart) if not own]))
        return [next(one if own else other) for own in apart]

    def _cut(self, strings: list[str]) -> list[bytes]:
        (found,) = self.tokenizer.encode_batch_fast([" ".join(strings)], add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        if len(ids) and int(ids.max()) < len(self.ends):
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(strings) and ends[-1] == len(ids):  # one end a piece, its last id; a piece never has none
                blob, ends = ids.tobytes(), (4 * ends).tolist()
                return [blob[a:b] for a, b in zip([0, *ends], ends)]
        return super().raw(strings)


class ByteLevel(Chunked):
    """A byte-level BPE file. A space before a non-space begins a new match of the pattern, whatever stands before.

    Chunks are the text between such spaces; a chunk's key carries no space, the first chunk
    of a text (which has none) is kept under a key with a leading space.
    """

    def __init__(self, path: str, pieces=Pieces):
        super().__init__()
        import public_tokenizers
        import regex

        self.pieces, self.match = pieces(path), regex.compile(public_tokenizers.PATTERN)

    def cut(self, text: str) -> list[str]:
        chunks = text.split(" ")
        # Printable text has no white space but the space itself.
        if "" in chunks or " \n" in text or not text.replace("\n", "").isprintable():
            chunks = _BEFORE_WORD.split(text)
        chunks[0] = " " + chunks[0]
        return chunks

    def encode_new(self, chunks: list[str]) -> list[bytes]:
        find = self.match.findall
        # Keys of first chunks begin with a space, which is taken off; the others get theirs.
        return self.pieces.encode([find(c[1:] if c[:1] == " " else " " + c) for c in chunks])


class WordLevel(Chunked):
    """A BPE file with word ends, whose white space only separates: chunks are what stands between."""

    #: The file's own pattern, on text in its normal form.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        super().__init__()
        import regex

        self.pieces, self.match = WordPieces(path), regex.compile(self.PATTERN)

    def cut(self, text: str) -> list[str]:
        if text.isascii():  # there the normal form is the lower case, and fewer chunks differ
            text = text.lower()
        # Python also splits at four control characters that the file keeps.
        return re.split(r"[ \t\n\r\f\v]+", text) if _SEPARATORS.search(text) else text.split()

    def encode_new(self, chunks: list[str]) -> list[bytes]:
        find, plain = self.match.findall, unicodedata.is_normalized
        # Pieces are cut in the normal form: lower case, and composed. Beyond Latin letters the file does that itself.
        lists = []
        for c in chunks:
            low = c.lower()
            if c.isascii():
                lists.append([low] if low.isalpha() else find(low))
            else:
                lists.append(find(low) if max(c) < "\u0200" and len(low) == len(c) and plain("NFC", c) else [c])
        return self.pieces.encode(lists)


_LOADED: dict[tuple, Chunked] = {}


def encoder(kind, *args) -> Chunked:
    """The worker's encoder of a class for a vocabulary file; it lives as long as the worker."""
    if (kind, *args) not in _LOADED:
        _LOADED[kind, *args] = kind(*args)
    return _LOADED[kind, *args]
