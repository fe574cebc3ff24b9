"""Byte-pair encoders: tiktoken's core merges by rank over the merges of a tokenizers file.

A byte-level vocabulary takes a whole text of plain characters in one call. Of
a run of white space before a word, the last character starts a pre-token of
its own; the text is cut there, so the pattern needs no look-ahead, and the
core matches it without a stack.

Other texts, and all of a vocabulary that lowers, look words up in a cache
which is bounded in bytes. A pre-token of either vocabulary never reaches over
a space that follows a character which is no white space, so a text is cut
there and each chunk is encoded once for as long as it stays in the cache.
Chunks with unusual characters go to the tokenizers library itself. ``check``
encodes one text with the library and compares.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

from .common import BoundedCache

#: White_Space of Unicode, as the tokenizers' patterns take it.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PLAIN = re.compile(r"[\n -~\xa1-\xac\xae-\xff]*\Z")
#: A run of white space which a cut at each space would tear.
TORN = re.compile(rf" [{SPACES}]* ")
CHUNKS = re.compile(rf"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: White space of plain texts: two in a row, a run before a word without its last one, and the end of a word.
DOUBLED = ("  ", " \n", "\n ", "\n\n")
RUNS = re.compile(r"[ \n]+(?=[ \n][^ \n])")
WORD_END = re.compile(r"[^ \n](?=[ \n])")
#: Characters of a long text that go into one call, at the next end of a word.
LONG = 1 << 20


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        model, byte = spec["model"], _byte_of()
        self.size = self.library.get_vocab_size()
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.suffix = model["end_of_word_suffix"]
        self.lowered = spec["normalizer"] is not None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        special = set(self.specials)
        # The end of a word is byte 255, which no UTF-8 text has; it joins the last byte before any other merge.
        raw = lambda s: bytes(byte[c] for c in (s.removesuffix(self.suffix) if self.suffix else s)) + (b"\xff" if self.suffix and s.endswith(self.suffix) else b"")
        ranks: dict[bytes, int] = {}
        ids: list[int] = []
        vocab = model["vocab"]
        singles = [t for t in vocab if t not in special and len(t.removesuffix(self.suffix or "\0")) == 1]
        for t in sorted(singles, key=lambda t: (not (self.suffix and t.endswith(self.suffix)), t)):
            ranks[raw(t)] = len(ids)
            ids.append(vocab[t])
        for b in range(256):
            if bytes([b]) not in ranks:
                ranks[bytes([b])] = len(ids)
                ids.append(-1)
        for left, right in merges:
            if (key := raw(left + right)) not in ranks:
                ranks[key] = len(ids)
                ids.append(vocab[left + right])
        core = tiktoken.Encoding("merges", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.core, self.whole = core.encode_single_piece, core.encode_ordinary
        self.ids = [i.to_bytes(4, "little", signed=True) for i in ids]
        self.id_of = np.array(ids, dtype="<i4")
        self.end = b"\xff" if self.suffix else b""
        import regex

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" if self.lowered else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.pretokens = regex.compile(pattern).findall
        self.words = BoundedCache(self._chunk)
        self.spaced = BoundedCache(lambda chunk: self._piece(" " + chunk) if chunk.isalpha() and PLAIN.match(chunk) else self._chunk(" " + chunk))

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() and PLAIN.match(chunk):
            return self._piece(chunk.lower() if self.lowered else chunk)
        if not chunk:
            return b""
        if not PLAIN.match(chunk):
            return self._library(chunk)
        return b"".join(map(self._piece, self.pretokens(chunk.lower() if self.lowered else chunk)))

    def _piece(self, piece: str) -> bytes:
        return b"".join([self.ids[r] for r in self.core(piece.encode() + self.end)])

    def _plain(self, text: str) -> bytes:
        """Ids of a text of plain characters in a byte-level vocabulary."""
        ends = [m.end() for m in RUNS.finditer(text, 0, len(text.rstrip(" \n")))] if any(x in text for x in DOUBLED) else []
        start, ranks, out = 0, [], []
        for end in [*ends, len(text)]:
            while start < end:
                m = WORD_END.search(text, start + LONG, end) if end - start > LONG else None
                stop = m.end() if m else end
                ranks += self.whole(text[start:stop])
                start = stop
                if len(ranks) > LONG:
                    out.append(self.id_of[np.asarray(array("I", ranks))].tobytes())
                    ranks = []
        return b"".join([*out, self.id_of[np.asarray(array("I", ranks))].tobytes()])

    def encode(self, text: str) -> bytes:
        if "<|" in text and any(s in text for s in self.specials):
            return self._library(text)
        if self.lowered:
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        if PLAIN.match(text):
            return self._plain(text)
        if TORN.search(text) or text[:1] == " ":
            return b"".join(map(self.words.__getitem__, CHUNKS.findall(text)))
        first, *rest = text.split(" ")
        return self.words[first] + b"".join(map(self.spaced.__getitem__, rest))

    def check(self, text: str) -> None:
        """Raises unless the library gives the same ids."""
        if self.encode(text) != self._library(text):
            raise AssertionError("the cached encoder and the tokenizers library disagree")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
