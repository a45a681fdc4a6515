"""Token ids of whole texts with a public tokenizer, one cached chunk of text at a time.

A text is cut where ASCII white space follows something else. Neither kind of vocabulary
used here has a token across such a place, so the ids of a text are the ids of its chunks
in order, and a chunk that a worker has met before need not be encoded again. Texts for
which that does not hold (other white space, special tokens) are encoded whole, and so are
all texts of a tokenizer file whose normaliser and cutter are not those known here.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Sequence

import numpy as np
import regex

from tallymix.llm.common import Words

#: White space beyond ASCII: a run of it may cross a chunk's end. NUL marks a text's start.
WHOLE = re.compile("[\x00\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
MARKERS = re.compile("[\x00\x1c-\x1f]")
#: White space other than single spaces and single line ends between words.
UNEVEN = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\x0b", b"\x0c", b"\r")
CHUNK = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: Characters whose classes no version of Unicode changes; other chunks go the long way.
PLAIN = re.compile("[ \n!-~À-įı-ɏ]+")
#: The patterns by which the two kinds of vocabulary cut a text.
SPACED_PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
LOWER_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: What the two kinds of files say of their normaliser and cutter.
KNOWN = {
    True: (
        None,
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        None,
    ),
    False: (
        {
            "type": "Sequence",
            "normalizers": [
                {"type": "NFC"},
                {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
                {"type": "Lowercase"},
            ],
        },
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": LOWER_PIECES.pattern}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
        "</w>",
    ),
}
#: Chunks a worker keeps; it starts afresh when full, so its memory is bounded.
MAX_CHUNKS = 1_000_000


def byte_letters() -> dict[int, int]:
    """Bytes as the printable characters that byte-level vocabularies write for them."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


class Encoder(dict):
    """``add_special_tokens=False`` ids of texts, as little-endian unsigned 32-bit bytes.

    ``spaced`` vocabularies put the space before a word into its token; the others drop
    white space and lower-case. The dict holds the ids of known chunks; looking up an
    unknown one encodes it.
    """

    _made: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, spaced: bool):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaced = spaced
        self.letters = byte_letters()
        self.lead = "\u0120" if spaced else ""
        made = json.loads(self.tokenizer.to_str())
        form = (made["normalizer"], made["pre_tokenizer"], made["model"].get("end_of_word_suffix"))
        # Special tokens are looked for by their first characters.
        marked = all(t["content"].startswith("<|") for t in made["added_tokens"])
        self.known = form == KNOWN[spaced] and made["model"]["type"] == "BPE" and marked

    @classmethod
    def get(cls, path: str, spaced: bool) -> Encoder:
        """One encoder a worker, whatever the number of tasks it runs."""
        key = (path, spaced)
        if key not in cls._made:
            cls._made[key] = cls(path, spaced)
        return cls._made[key]

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def __missing__(self, key: bytes) -> bytes:
        if key.isalpha():  # ASCII letters, which stand for themselves: one piece
            letters = self.lead + key.decode()
            ids = self[key] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            return ids
        word = key.decode()
        if word.isalpha() and PLAIN.fullmatch(word):  # one piece of other letters
            if not self.spaced:
                word = unicodedata.normalize("NFC", word).lower()
            letters = self.lead + word.encode().decode("latin-1").translate(self.letters)
            ids = self[key] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            return ids
        if key[-1:] in MARKS and word[:-1].isalpha() and PLAIN.fullmatch(word):  # a mark after a letter is its own piece
            ids = self[key[:-1]] + self[b"\x00" + key[-1:] if self.spaced else key[-1:]]
            self[key] = ids
            return ids
        if self.spaced and key[:1] == b"\x00":
            chunk = key[1:].decode()
        elif self.spaced and key[:1] not in b" \t\n\x0b\x0c\r":
            chunk = " " + key.decode()
        else:
            chunk = key.decode()
        if not chunk or PLAIN.fullmatch(chunk) is None:
            ids = self.whole(chunk)
        else:
            if self.spaced:
                pieces = SPACED_PIECES.findall(chunk)
            else:
                pieces = LOWER_PIECES.findall(unicodedata.normalize("NFC", chunk).lower())
            found = []
            for piece in pieces:
                letters = piece.encode().decode("latin-1").translate(self.letters)
                found += [t.id for t in self.model.tokenize(letters)]
            ids = array("I", found).tobytes()
        self[key] = ids
        return ids

    def must_be_whole(self, text: str) -> bool:
        odd = MARKERS.search(text) if text.isascii() else WHOLE.search(text)
        return not self.known or odd is not None or "<|" in text

    def chunks(self, text: str) -> list[bytes] | None:
        """Keys of the dict in order; None if the text has to be encoded whole."""
        if self.must_be_whole(text):
            return None
        raw = text.encode()
        if not self.spaced:
            return raw.lower().split()
        if any(map(raw.__contains__, UNEVEN)) or raw[:1] in SPACE or raw[-1:] in SPACE:
            cut = CHUNK.findall(raw)
            first = [] if cut[0][0] in b" \t\n\x0b\x0c\r" else [b"\x00" + cut.pop(0)]
            return first + [c[1:] if c[0] == 32 and c[1:2] not in SPACE else c for c in cut]
        return b"".join((b"\x00", raw.replace(b"\n", b" \n"))).split(b" ")

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; a null text is an empty one."""
        if not text:
            return b""
        cut = self.chunks(text)
        if cut is None:
            return self.whole(text)
        if len(self) > MAX_CHUNKS:
            self.clear()
        return b"".join(map(self.__getitem__, cut))


class WordIds:
    """Ids of texts of a vocabulary that drops white space, all words of a slice at once.

    Words that a worker has met are found by their 64-bit hashes in one sorted table, which
    points into a pool of ids. Words of more than ``LONG`` bytes are looked up by themselves.
    """

    LONG = 64
    _made: dict[str, WordIds] = {}

    def __init__(self, path: str):
        self.encoder = Encoder.get(path, False)
        self.forget()

    @classmethod
    def get(cls, path: str) -> WordIds:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def new_words(self, raw: bytes, starts: list[int], ends: list[int]) -> tuple[array, list[int]]:
        """The ids of words not met before, and the number of each."""
        encoder, flat, n = self.encoder, array("I"), []
        tokenize, plain = encoder.model.tokenize, encoder.known and encoder.lead == ""
        for a, b in zip(starts, ends):
            word = raw[a:b]
            if plain and word.isalpha():  # ASCII letters: one piece
                ids = [t.id for t in tokenize(word.decode())]
                flat.extend(ids)
                n.append(len(ids))
            else:
                ids = encoder[word]
                flat.frombytes(ids)
                n.append(len(ids) >> 2)
        return flat, n

    def add(self, ids: array, n: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) of lists of ids that now are in the pool."""
        n = np.array(n, dtype=np.int64)
        end = self.used + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(2 * end - self.used, np.uint32)])
        self.pool[self.used : end] = ids
        at, self.used = self.used + np.cumsum(n) - n, end
        return at, n

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        encoder = self.encoder
        if len(self.keys) > MAX_CHUNKS:
            self.forget()
        if len(encoder) > MAX_CHUNKS:
            encoder.clear()
        whole = [i for i, t in enumerate(texts) if t and encoder.must_be_whole(t)]
        aside = set(whole)
        words = Words([None if i in aside else t for i, t in enumerate(texts)] if whole else texts)
        at, n = np.zeros((2, len(words.hashes)), dtype=np.int64)
        size = words.ends - words.starts
        brief = size <= WordIds.LONG
        key, first, of = np.unique(words.hashes[brief], return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[place] != key) if len(self.keys) else np.arange(len(key))
        if len(new):
            starts, ends = words.starts[brief][first[new]], words.ends[brief][first[new]]
            made = self.add(*self.new_words(words.bytes.tobytes(), starts.tolist(), ends.tolist()))
            where = np.searchsorted(self.keys, key[new])
            self.keys = np.insert(self.keys, where, key[new])
            self.at, self.n = (np.insert(old, where, more) for old, more in zip((self.at, self.n), made))
            place = np.searchsorted(self.keys, key)
        at[brief], n[brief] = self.at[place][of], self.n[place][of]
        for i in np.flatnonzero(~brief).tolist():
            ids = array("I", encoder[words.bytes[words.starts[i] : words.ends[i]].tobytes()])
            (at[i],), (n[i],) = self.add(ids, [len(ids)])
        parts = words.of
        if whole:  # a text encoded whole stands as one word
            ids = [array("I", encoder.whole(texts[i])) for i in whole]
            own = self.add(sum(ids, array("I")), [len(i) for i in ids])
            at, n = (np.insert(old, parts[whole], more) for old, more in zip((at, n), own))
            parts = parts + np.searchsorted(whole, np.arange(len(parts)))
        before = np.concatenate([[0], np.cumsum(n)])
        index = np.repeat(at - before[:-1], n) + np.arange(before[-1])
        return self.pool[index], np.diff(before[parts])


MARKS = {b".", b",", b"!", b"?", b";", b":"}
SPACE = {b"", b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"}


def slices(texts: Sequence[str | None], most: int = 1 << 21):
    """Ranges of rows of about ``most`` characters; a longer text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
