"""Fast exact encoding with the tokenizers library.

Both tokenizers split a text into pre-tokens and encode each on its own.
``ChunkEncoder`` cuts a text only where a pre-token always ends, and remembers
the ids of each chunk, so the library sees every distinct chunk once.
Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
import re
from struct import pack

import numpy as np

from .common import worker_memory

#: End mark that each document gets.
END_ID = 0
#: Chunks remembered by one worker.
CACHE_CHUNKS = 600_000

_IRREGULAR = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_ODD_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_ENDS = ".,;:!?"
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_LINES = re.compile(r"(\S+)\n(\S+)").fullmatch
#: Byte-level spelling: printable Latin-1 stays, the rest of the bytes follow from U+0100 on in order.
_KEPT = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _KEPT)}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _regular(text: str) -> bool:
    """Single spaces and line breaks are all its white space, with other characters around them."""
    return not (
        text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        or any(c in text for c in _ODD_SPACES) or (not text.isascii() and _ODD_WIDE(text))
    )


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``word_ends``: white space is dropped by the tokenizer (then chunks are
    what lies between spaces); else a chunk carries the space before it.
    """

    def __init__(self, path: str, word_ends: bool, limit: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.word_ends, self.limit = word_ends, limit
        self.model = self.tokenizer.model
        self.first = _Chunks(self, "")
        self.later = self.first if word_ends else _Chunks(self, " ")

    def whole(self, text: str) -> bytes:
        """What the library returns for ``text``, nothing remembered."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.word_ends:
            return b"".join(map(self.first.__getitem__, text.replace("\n", " ").split(" ")))
        first, *rest = text.split(" ") if _regular(text) else _IRREGULAR.split(text)
        return self.first[first] + b"".join(map(self.later.__getitem__, rest))


def encoder_of(path: str, word_ends: bool) -> ChunkEncoder:
    """The encoder of this process; a worker keeps it from task to task."""
    return worker_memory(f"encoder {path} {word_ends}", lambda: ChunkEncoder(path, word_ends))


class _Chunks(dict):
    """chunk -> ids; what was not asked for since the last turnover goes at the next."""

    def __init__(self, owner: ChunkEncoder, before: str):
        super().__init__()
        self.owner, self.before, self.old = owner, before, {}
        self.mark = "Ġ" if before else ""  # how byte-level tokenizers write a space

    def __missing__(self, chunk: str) -> bytes:
        if (value := self.old.get(chunk)) is None:
            value = self.make(chunk)
        if len(self) >= self.owner.limit:
            self.old = dict(self)
            self.clear()
        self[chunk] = value
        return value

    def make(self, chunk: str) -> bytes:
        owner = self.owner
        if not chunk:
            return owner.whole(self.before) if self.before else b""
        if _LETTERS(chunk):  # one pre-token, the same in any normal form
            word = chunk.lower() if owner.word_ends else chunk
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_BYTE_LEVEL)
            ids = [t.id for t in owner.model.tokenize(self.mark + word)]
            return pack(f"<{len(ids)}I", *ids)
        if chunk[-1] in _ENDS and _LETTERS(chunk[:-1]):
            return self[chunk[:-1]] + owner.first[chunk[-1]]  # letters and a mark are two pre-tokens
        if not owner.word_ends and (cut := _LINES(chunk)):
            # a single line break between other characters is a pre-token of its own
            return self[cut[1]] + owner.first["\n"] + owner.first[cut[2]]
        return owner.whole(self.before + chunk)
