"""Operator 4: token counts by heap-and-linked-list byte-pair merging.

A piece starts as one symbol a byte, held in a doubly linked list. A heap holds the adjacent pairs that
have a merge, by rank and then position; the lowest is popped, merged, and its two new neighbours pushed;
entries whose symbols have changed since are skipped. The count is the number of bytes minus the number
of merges; no ids are made. Pieces up to a fixed length are remembered by each worker.

Defined results: null text counts as empty (0 bytes, 0 tokens); a null doc_id and repeated rows give a row
each; an empty table gives an empty result; other columns are ignored. The string of a special token
inside a text counts as one token, the library's default.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession

from .shared import map_texts, read
from .tokens import BYTE_CHARS, CHUNK, ODD, Memo, held, vocabulary


class HeapCounter:
    """Counts tokens with the merges of a byte-level .json vocabulary."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = [vocab[BYTE_CHARS[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.memo = Memo(self.chunk)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        for special in self.special:
            if special in text:
                parts = text.split(special)
                return len(parts) - 1 + sum(map(self, parts))
        if ODD.search(text):
            return self.chunk(text)
        return sum(map(self.memo.__getitem__, CHUNK.findall(text)))

    def chunk(self, text: str) -> int:
        if text.isalpha() or (text[0] == " " and text[1:].isalpha()):
            return self.piece(text.encode())
        return sum(self.piece(p.encode()) for p in self.pieces(text))

    def piece(self, data: bytes) -> int:
        n = len(data)
        if n < 2:
            return n
        merges = self.merges
        symbols = [self.first[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := merges.get((symbols[i], symbols[i + 1])):
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if found := merges.get((made, symbols[k])):
                    heapq.heappush(heap, (found[0], i, made, symbols[k], found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((symbols[h], made))):
                heapq.heappush(heap, (found[0], h, symbols[h], made, found[1]))
        return count


def counter(path: str) -> HeapCounter:
    return held(HeapCounter, path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) of each document; no shuffle."""

    def make():
        count_tokens = counter(tokenizer)

        def count(texts):
            n_tokens = [count_tokens(t) for t in texts]
            return [len(t.encode()) if t else 0 for t in texts], n_tokens, [n > limit for n in n_tokens]

        return count

    return map_texts(docs, make, "n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)
