"""Exact pre-tokens and per-word BPE for ``tokenizers`` files that split text into words.

A BPE word is encoded alone, so a text's ids are its words' ids in order. Words come from a fast
pattern for Latin text and from the library's own normaliser and pre-tokeniser for all other text.
"""

from __future__ import annotations

import json
import re

from tokenizers import Tokenizer

#: Words kept in a worker's cache before it starts afresh.
CACHE_WORDS = 400_000
#: What the fast pattern covers: white space, printable Latin, general punctuation; no controls, no \x85, no dotted capital I.
_COVERED = "\t-\r\x20-\x7e\xa0-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20ac"
#: Capitals among them whose small letters lie beyond; texts that hold one are for the library as well.
_STRAY = "".join(c for c in map(chr, range(0xA0, 0x250)) if re.match(f"[^{_COVERED}]", c.lower()))
_OTHER = re.compile(f"[^{_COVERED}]|[{_STRAY}]")
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The word pattern of the vocabulary file, with its classes spelt out for those characters.
_LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")
#: The normaliser and pre-tokeniser for which _LATIN_WORDS stands; fixed values of the file's format.
_KNOWN_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordBpe:
    """One tokenizer file in one worker: pre-tokens of a text, ids of a pre-token."""

    def __init__(self, path: str):
        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens with strip, single_word or normalized flags are not supported")
        self.special = {t.content: i for i, t in added.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [x["type"] for x in pre] != ["Split", "ByteLevel"] or spec["model"]["type"] != "BPE":
            raise ValueError("only BPE files whose words come from a pattern and the byte-level alphabet are supported")
        self._latin = steps == _KNOWN_NORMALIZER and pre[0]["pattern"].get("Regex") == _KNOWN_PATTERN and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
        to = _byte_alphabet()
        self._to = {b: c for b, c in to.items()}
        self._from = {c: b for b, c in to.items()}

    def words(self, text: str) -> list:
        """Pre-tokens in order, as str; an added token found in the text stands as its id."""
        if self._special and self._special.search(text):
            out: list = []
            for part in self._special.split(text):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    out += self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if self._latin and not _OTHER.search(text):
            return _LATIN_WORDS.findall(text.lower())
        norm = self.tokenizer.normalizer
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(norm.normalize_str(text) if norm else text)
        return [bytes(map(self._from.__getitem__, p)).decode("utf-8", "surrogateescape") for p, _ in pieces]

    def word_ids(self, word) -> list[int]:
        """Ids of one pre-token, or of one added token that stands as its id."""
        if isinstance(word, int):
            return [word]
        piece = "".join(map(self._to.__getitem__, word.encode("utf-8", "surrogateescape")))
        return [t.id for t in self.tokenizer.model.tokenize(piece)]


class Cached(dict):
    """word -> value made on a miss; starts afresh when it holds too many words."""

    def __init__(self, make, limit: int = CACHE_WORDS):
        super().__init__()
        self._make, self._limit = make, limit

    def __missing__(self, word):
        if len(self) >= self._limit:
            self.clear()
        value = self[word] = self._make(word)
        return value


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The worker's only copy of a tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]
