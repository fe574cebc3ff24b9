"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs whose joined form is a
piece, ordered by score and then by place; the best pair is merged, the new
neighbours join the agenda, stale entries are passed over. What is no piece in
the end falls back to bytes. No piece holds a space after another character,
so a text is cut there and each chunk is merged once while it stays in a
cache that is bounded in bytes. All chunks that an Arrow batch merged anew, and all decoded
texts, are checked against the sentencepiece library; a difference is an error.

A null text counts as empty: it has the end id alone and decodes to the empty
text. Rows are independent of each other, so repeated rows, null ids and very
long texts need no special care; columns other than doc_id and text are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import BoundedCache, narrow, table, vocabulary

MARK = "▁"
CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.id = {sp.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece reaches over a space: texts can't be cut at spaces")
        if sp.encode("a  b") == sp.encode("a b") or sp.id_to_piece(sp.encode("a"))[0][:1] != MARK:
            raise ValueError("only models that keep spaces and put one in front are supported")
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = sp.eos_id()
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.text = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        self.decimal = [str(i) for i in range(n)]
        self.inside = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.parts = BoundedCache(lambda part: np.array(self.merge(part), self.kind).tobytes())
        self.chunks = BoundedCache(self._chunk, [])

    def merge(self, text: str) -> list[int]:
        """Ids of a normalised text by the agenda."""
        score, symbols = self.score.get, list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(-s, i, i + 1, 2) for i in range(n - 1) if (s := score(symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            _, i, j, size = heappop(agenda)
            left, right = symbols[i], symbols[j]
            if not left or not right or len(left) + len(right) != size:
                continue  # one of the two has been merged since
            joined = symbols[i] = left + right
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := score(joined + symbols[k])) is not None:
                    heappush(agenda, (-s, i, k, size + len(symbols[k])))
            if (h := before[i]) >= 0 and (s := score(symbols[h] + joined)) is not None:
                heappush(agenda, (-s, h, i, size + len(symbols[h])))
        out = []
        for x in symbols:
            if x:
                if (i := self.id.get(x)) is not None:
                    out.append(i)
                else:
                    out += [self.byte[b] for b in x.encode()]
        return out

    def _chunk(self, rest: str) -> bytes:
        """Ids of a chunk, cut where no piece holds the two characters side by side."""
        text, start, out = MARK + rest, 0, b""
        for i in [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.inside]:
            out += self.parts[text[start:i]]
            start = i
        return out + self.parts[text[start:]]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, without an end id."""
        if not text:
            return np.zeros(0, self.kind)
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            keys = [c[1:] for c in CHUNKS.findall(MARK + text.replace(" ", MARK))]
        else:
            keys = text.split(" ")
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, keys)), self.kind)

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.text.__getitem__, ids))
        try:
            return raw.removeprefix(b" ").decode()
        except UnicodeDecodeError:  # ids that no text gives
            return self.library.decode(ids)

    def check(self) -> None:
        """Raises unless the library gives the same ids for all chunks since the last call."""
        fresh, self.chunks.fresh = [(k, v) for k, v in self.chunks.fresh if k], []
        for (_, own), ids in zip(fresh, self.library.encode([k.replace(MARK, " ") for k, _ in fresh], num_threads=1), strict=True):
            if own != np.array(ids, self.kind).tobytes():
                raise AssertionError("the agenda and the sentencepiece library disagree")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                ids = [*p.encode(text.as_py()).tolist(), p.end]
                decoded = p.decode(ids)
                if decoded != p.library.decode(ids):
                    raise AssertionError("decoding and the sentencepiece library disagree")
                shown = " ".join([p.decimal[i] for i in ids])
                rows.append((len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *((ids, decoded) if with_ids else ())))
            p.check()
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if with_ids else 3]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], ["doc_id", *names])

    return narrow(docs).mapInArrow(both, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)


def op1_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), path or vocabulary("piece_bpe_32k.model"))
