"""Token ids of whole texts by a word-level BPE file of the tokenizers library.

The file's tokeniser drops white space and never joins across it, so a text's
ids are the ids of its words one after another. Each distinct word is encoded
once per task; texts of any length need no more than their words.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

# Distinct words a task remembers before it starts again.
REMEMBERED = 400_000

WORD = re.compile(r"[^ \t\n\r]+")
# Latin letters that lower-case one by one and that normalisation leaves alone.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
# The file's splitting pattern, for lower-case printable ASCII.
ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
PRINTABLE = re.compile(r"[!-~]+")


def byte_letters() -> dict[int, str]:
    """Code point of a character below 256 -> the letter that stands for that byte in the file.

    Printable Latin-1 characters stand for themselves, the other bytes for the
    letters from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def encoder(tokenizer_json: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit numbers."""
    tokenizer = Tokenizer.from_str(tokenizer_json)
    model = tokenizer.model
    letters = byte_letters()

    def part(text: str) -> list[int]:
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(letters)
        return [t.id for t in model.tokenize(text)]

    def packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    class Known(dict):
        def __missing__(self, word: str) -> bytes:
            if len(self) >= REMEMBERED:
                self.clear()
            found = self[word] = self.new(word)
            return found

        def new(self, word: str) -> bytes:
            """Through the lower-case word or its parts, which many words share, where they are plain."""
            lower = word.lower()
            head = PLAIN.match(word)
            if head and head.end() == len(word):
                return packed(part(word)) if lower == word else self[lower]
            if "<|" not in word:
                if PRINTABLE.fullmatch(word):
                    parts = ASCII_PARTS.findall(lower)
                    return self.joined(parts) if len(parts) > 1 else packed(part(lower))
                if head and PRINTABLE.fullmatch(tail := word[head.end() :]) and not tail[0].isalnum() and "'" not in tail:
                    return self[head[0]] + self[tail]
            return packed(tokenizer.encode(word, add_special_tokens=False).ids)

        def joined(self, parts: list[str]) -> bytes:
            return b"".join([self[p] for p in parts])

    known = Known()
    return lambda text: b"".join(map(known.__getitem__, WORD.findall(text)))
