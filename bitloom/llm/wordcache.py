"""Token ids and counts of whole texts as the ``tokenizers`` library gives them, with each distinct word encoded once.

Byte-pair merges never cross the tokenizer's pre-split, and the pre-split never looks past white space (for one that
keeps white space: past the chunks cut here). So a text's ids are those of its chunks, and a worker remembers chunks up to
a bound. Whatever could break this goes to the library whole: other kinds of tokenizer, texts that hold a special
string, chunks with characters beyond U+024F, and, where white space is kept, texts with white space beyond ASCII.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import regex

#: Chunks that a worker remembers before it starts anew.
MEMORY = 700_000
_PARTS = 50_000
_SPACES = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
_DROPS = [{"type": "NFC"}, _SPACES, {"type": "Lowercase"}]
#: Fixed value: the pre-split of byte-level tokenizers with use_regex.
_KEEPS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: a pre-split whose parts are runs of letters, single digits and runs of other signs.
_LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CHUNK = re.compile(rb" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")
_PLAIN = re.compile("[\x00-įı-ɏ]*")
_WIDE_SPACE = re.compile("[\x85\xa0  -     　]")


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable bytes stand for themselves, others follow U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return [chr(b) if b not in set(others) else chr(256 + others.index(b)) for b in range(256)]


class _Numbers(dict):
    """Chunks to their numbers; an unknown one is learned as it is asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = found = self.learn(chunk, len(self))
        return found


class WordCache:
    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        added = [x["content"].encode() for x in kind.get("added_tokens") or []]
        self.special = re.compile(b"|".join(map(re.escape, added)) or b"(?!)")
        self.letters = dict(enumerate(byte_letters()))
        before, split = (kind.get("normalizer") or {}), (kind.get("pre_tokenizer") or {})
        plain_level = {"add_prefix_space": False, "trim_offsets": True}
        steps = split.get("pretokenizers") or []
        self.drops = before.get("normalizers") == _DROPS and len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and steps[1] == {"type": "ByteLevel", "use_regex": False} | plain_level
        self.keeps = not before and split == {"type": "ByteLevel", "use_regex": True} | plain_level
        usable = kind["model"]["type"] == "BPE" and not kind["model"].get("dropout") and not kind.get("post_processor")
        self.drops, self.keeps = self.drops and usable, self.keeps and usable
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"] if self.drops else _KEEPS)
        self.letter_runs = self.pattern.pattern in (_LETTER_RUNS, _KEEPS)
        self.tokenize = self.tokenizer.model.tokenize
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers(self._learn)
        self.parts: dict[str, list[int]] = {}
        self.flat, self.ends = array("I"), array("q", [0])  # ids of all chunks, and where each chunk's end

    def _part(self, part: str) -> list[int]:
        """The ids of one part of the pre-split."""
        plain = part.isascii() and part.isprintable()
        return [t.id for t in self.tokenize(part.replace(" ", "\u0120") if plain else "".join(map(self.letters.__getitem__, part.encode())))]

    def _encode(self, chunk: bytes) -> list[int]:
        word = chunk.decode()
        if not word.isascii() and not _PLAIN.fullmatch(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        if self.drops:
            word = word.lower()
        core, mark = (word[:-1], word[-1]) if word[-1] in ".,;:!?" else (word, "")
        letters = core[1:] if self.keeps and core[:1] == " " else core
        if self.letter_runs and letters.isalpha():  # the pre-split leaves it in one part
            return self._part(core) + (self._part(mark) if mark else [])
        out: list[int] = []
        for part in self.pattern.findall(word):
            if (ids := self.parts.get(part)) is None:
                ids = self._part(part)
                if len(self.parts) < _PARTS:
                    self.parts[part] = ids
            out += ids
        return out

    def _learn(self, chunk: bytes, name: int) -> int:
        self.flat.extend(self._encode(chunk))
        self.ends.append(len(self.flat))
        return name

    def _names(self, text: bytes) -> np.ndarray | None:
        """Numbers of the text's chunks; None if the library has to see the text whole."""
        if not (self.drops or self.keeps) or self.special.search(text):
            return None
        if self.keeps and not text.isascii() and _WIDE_SPACE.search(text.decode()):
            return None
        if len(self.number) > self.memory:
            self._forget()
        chunks = text.split() if self.drops else _CHUNK.findall(text)
        return np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))

    def ids(self, text: bytes) -> np.ndarray:
        if (names := self._names(text)) is None:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        ends = np.frombuffer(self.ends, np.int64)
        starts, lengths = ends[names], ends[names + 1] - ends[names]
        upto = np.cumsum(lengths)
        return np.frombuffer(self.flat, np.uint32)[np.repeat(starts - upto + lengths, lengths) + np.arange(upto[-1])] if len(upto) else np.zeros(0, np.uint32)

    def count(self, text: bytes) -> int:
        if (names := self._names(text)) is None:
            return len(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)
        ends = np.frombuffer(self.ends, np.int64)
        return int((ends[names + 1] - ends[names]).sum())


_OPEN: dict[str, WordCache] = {}


def opened(path: str) -> WordCache:
    """The cache of this process for a tokenizer; a worker that runs further tasks goes on with it."""
    if path not in _OPEN:
        _OPEN[path] = WordCache(path)
    return _OPEN[path]
