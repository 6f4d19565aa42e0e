"""Whole texts through the tokenizers library, word by word with a memory.

In the vocabulary used here no token reaches over white space, so the ids of a text
are the ids of its words one after the other.  Most words of a corpus come again;
each worker encodes a word once and keeps its ids.  The memory has two generations: when
the younger is full it becomes the older, and words that are met again move back.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

from .bpe import byte_alphabet

#: words in a generation
MEMORY = 350_000
#: Latin letters that normalisation only lowers (no combining marks, and not the dotted
#: capital I), and then marks that the vocabulary's splitting keeps in one piece of their own
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,;:!?#%&*$()\"-]*)")
ALPHABET = byte_alphabet()


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Memory(dict):
    """ids of words; a word that is not there yet is encoded."""

    def __init__(self, tokenizer, older: dict[bytes, bytes]):
        super().__init__()
        self.tokenizer, self.older = tokenizer, older

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            text = word.decode()
            plain = PLAIN.fullmatch(text)
            if plain is None:
                ids = _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
            elif plain[2] or text.lower() != text:
                ids = self[plain[1].lower().encode()]
                if plain[2]:
                    ids += self[plain[2].encode()]
            else:
                # lower-case letters are one piece as they are, in the vocabulary's alphabet
                if not text.isascii():
                    text = word.decode("latin-1").translate(ALPHABET)
                ids = _bytes([t.id for t in self.tokenizer.model.tokenize(text)])
        self[word] = ids
        return ids


class WordEncoder:
    """ids of texts as little-endian unsigned 32-bit integers.

    For vocabularies that ignore case, drop white space and never join words across it.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.known = _Memory(self.tokenizer, {})

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        for text in texts:
            yield b"".join(map(self.known.__getitem__, (text or "").encode().split()))
            if len(self.known) > MEMORY:
                self.known.older = {}
                self.known = _Memory(self.tokenizer, self.known)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    return WordEncoder(path)
