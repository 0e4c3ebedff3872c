"""Texts to token ids through a memo of short chunks.

The pattern of byte-level vocabularies never joins characters across a white-space run, except that a
single blank leads the piece after it. A text can therefore be cut into chunks that are encoded
independently of each other: a run of Latin letters or of punctuation with at most one white-space
character before it where a piece surely ends there, else everything up to the next white space.
Chunks repeat, so each worker keeps a bounded memo from chunk to result.
"""

from __future__ import annotations

import array
import gc
import os
import re

LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
CHUNK = re.compile(rf"\s?[{LATIN}]+(?!\w)|\s?[!-&(-/:-@\[-^`{{-~]+(?=[\s0-9{LATIN}]|$)|\s?\S+|\s+(?!\S)|\s+")
#: Python counts these controls as white space and the vocabularies don't.
ODD = re.compile("[\x1c-\x1f]")
MEMO_ENTRIES, MEMO_CHARS = 400_000, 40


class Memo(dict):
    """At most `entries` results of fn on short keys; longer keys are worked out each time."""

    def __init__(self, fn, entries: int = MEMO_ENTRIES):
        self.fn, self.entries = fn, entries

    def __missing__(self, key):
        value = self.fn(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


_HELD: dict[tuple, object] = {}


def held(kind, *key):
    """kind(*key), once a Python worker. A worker serves several stages one after another; what an earlier one held goes
    first, so a worker has the memos of one model at a time."""
    if (kind, key) not in _HELD:
        _HELD.clear()
        gc.unfreeze()
        _HELD[kind, key] = kind(*key)
        gc.collect()
        gc.freeze()  # a model's many small objects stay: collections needn't look at them again
    return _HELD[kind, key]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_CHARS = _byte_chars()


class LibraryEncoder:
    """Ids as the tokenizers library gives them (no special tokens added), as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.memo = Memo(self.chunk)

    def chunk(self, text: str) -> bytes:
        word = text[1:] if text[0] == " " else text
        if word.isalpha():  # one piece: the library's merges without its splitting
            return array.array("I", [t.id for t in self.tokenize(text.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()
        return self.whole(text)

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if ODD.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.memo.__getitem__, CHUNK.findall(text)))


def library_encoder(path: str) -> LibraryEncoder:
    """One encoder a Python worker and file."""
    return held(LibraryEncoder, path)
