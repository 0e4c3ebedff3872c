"""Operator 6: byte-level BPE by a lazily determinised transducer, and streaming decoding.

Two neighbouring tokens u, v are compatible if merging the bytes of u+v by rank gives u, v again. The
encoding of a byte string is its only split in which all neighbours are compatible, so every prefix has
one last token, and it follows from the last tokens of shorter prefixes. The transducer reads bytes; after
each, a later token can only start where the bytes read since are a proper prefix of some token. A state
holds those bytes and, for each such start, the tokens up to it that are not settled yet. Tokens that all
starts agree on are settled and emitted: the lookahead is bounded by the longest token. States and
transitions are made when first needed and kept in a bounded table.

Decoding joins the tokens' bytes; a UTF-8 state machine keeps an incomplete character at the end of one
feed for the next one.

Defined results: null text counts as empty (0 tokens, digests of nothing); a null doc_id and repeated rows
give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import array
import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import map_texts, read
from .tokens import CHUNK, ODD, Memo, held, vocabulary

NONE: tuple[int, ...] = ()
#: The last settled token where no later one can follow it directly.
ANY = -2


class Transducer:
    """Encodes single pieces with the ranks of a .tiktoken vocabulary."""

    def __init__(self, path: str, states: int = 300_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.prefixes = {token[:k] for token in self.ranks for k in range(1, len(token))}
        self.limit = states
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.apart = Memo(lambda pair: self.compatible(*pair), 600_000)
        self.seen = Memo(self._candidates, 300_000)
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.start = self._state((b"", -1, (NONE,)))

    def _state(self, state: tuple) -> int:
        k = self.ids.get(state)
        if k is None:
            k = self.ids[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return k

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; nothing for a byte, or a token that merging never makes."""
        data = self.bytes_of[token]
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            ranked = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]  # noqa: B905
            if not ranked:
                return None
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of left and right stay apart (left: -1 at the start of a piece). Merges are undone
        from the last one back, on the two tokens beside the border; they are apart if at no time the border's
        own merge ranks before the one undone last. Of equal ranks the left one comes first."""
        parts, ranks, bytes_of = self.parts, self.ranks, self.bytes_of
        if right not in parts:
            parts[right] = self._split(right)
        if parts[right] is None and len(bytes_of[right]) > 1:
            return False
        if left < 0:
            return True
        limit = len(bytes_of) + 1
        while True:
            across = ranks.get(bytes_of[left] + bytes_of[right])
            if across is not None and across < limit:
                return False
            for token in (left, right):
                if token not in parts:
                    parts[token] = self._split(token)
            if parts[left] is None and parts[right] is None:
                return True
            if parts[right] is None or (parts[left] is not None and left > right):
                limit, left = left, parts[left][1]
            else:
                limit, right = right + 1, parts[right][0]

    def _candidates(self, window: bytes) -> tuple[tuple[tuple[int, int], ...], int]:
        """The tokens that end here as (begin, token), longest first; where the next window begins."""
        size = len(window)
        tokens = tuple((i, t) for i in range(size) if (t := self.ranks.get(window[i:])) is not None)
        return tokens, next((i for i in range(size) if window[i:] in self.prefixes), size)

    def _step(self, k: int, byte: int) -> tuple[int, tuple[int, ...]]:
        window, last, chains = self.states[k]
        window += bytes((byte,))
        candidates, cut = self.seen[window]
        for begin, token in candidates:
            chain = chains[begin]
            if self.apart[chain[-1] if chain else last, token]:
                break
        else:
            raise ValueError("a byte without a token")
        chains, window = (*chains[cut:], (*chain, token)), window[cut:]
        first, settled = chains[0], 0
        if len(chains) == 1:
            settled = len(first)
        else:
            others = chains[1:]
            for settled, t in enumerate(first):  # noqa: B007
                if any([len(c) <= settled or c[settled] != t for c in others]):
                    break
            else:
                settled = len(first)
        out = first[:settled]
        if settled:
            last, chains = out[-1], tuple([c[settled:] for c in chains])
        if NONE not in chains:  # every start has a token of its own before it
            last = ANY
        to = self._state((window, last, chains))
        self.steps[k][byte] = (to, out)
        return to, out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.limit:
            self._clear()
        k, ids, steps = self.start, [], self.steps
        for byte in piece:
            step = steps[k].get(byte)
            k, out = step if step is not None else self._step(k, byte)
            if out:
                ids += out
            if len(self.states) > 2 * self.limit:  # a very long piece
                state = self.states[k]
                self._clear()
                k, steps = self._state(state), self.steps
        ids += self.states[k][2][-1]
        return ids


class Utf8Machine:
    """Text from bytes that come in parts. need[b] is the length of the character that byte b begins."""

    need = [1] * 0x80 + [0] * 0x40 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10

    def __init__(self):
        self.rest = b""

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        end = len(data)
        for back in range(1, min(3, end) + 1):  # the last character may still lack bytes
            need = self.need[data[-back]]
            if need:
                if need > back:
                    end -= back
                break
        self.rest = data[end:]
        return data[:end].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        self.transducer = Transducer(path)
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.memo = Memo(self.chunk)

    def chunk(self, text: str) -> bytes:
        encode = self.transducer.encode
        if text.isalpha() or (text[0] == " " and text[1:].isalpha()):
            return array.array("I", encode(text.encode())).tobytes()
        return array.array("I", [i for p in self.pieces(text) for i in encode(p.encode())]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian uint32."""
        if not text:
            return b""
        if ODD.search(text):
            return self.chunk(text)
        return b"".join(map(self.memo.__getitem__, CHUNK.findall(text)))

    def decode(self, ids: bytes, step: int = 1 << 14) -> Iterator[str]:
        """Parts of the text, each of whole characters."""
        machine, numbers = Utf8Machine(), array.array("I", ids)
        token = self.transducer.bytes_of.__getitem__
        for i in range(0, len(numbers), step):
            yield machine.feed(b"".join(map(token, numbers[i : i + step])))
        yield machine.finish()


def codec(path: str) -> Codec:
    return held(Codec, path)


def encode_documents(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids (binary, little-endian uint32) of each document; no shuffle."""

    def make():
        encode = codec(ranks).encode
        return lambda texts: ([encode(t) for t in texts],)

    return map_texts(docs, make, "ids binary")


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, text of rows of encode_documents()."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["".join(c.decode(i or b"")) for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each document, in one pass."""

    def make():
        c = codec(ranks)

        def digest(texts):
            rows = []
            for text in texts:
                ids, decoded = c.encode(text), hashlib.sha256()
                for part in c.decode(ids):
                    decoded.update(part.encode())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest()))
            return tuple(zip(*rows, strict=True))

        return digest

    return map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))
