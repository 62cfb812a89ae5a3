"""Packing of token streams into sequences by order-preserving dynamic programming.

Documents keep their order within a partition of the input. Cuts are allowed at document ends (free), sentence
ends and, in long sentences, every `STRIDE` tokens (each at a price in tokens). With f(j) the least cost of
packing everything before cut j into sequences of at most `capacity` tokens,

    f(j) = capacity - x(j) + min over cuts i with x(j) - x(i) <= capacity of f(i) + price(i) + x(i)

where x is a cut's place in the stream. The minimum runs over a sliding window, so a monotone queue makes it linear.
Only the open end of the stream (under one sequence) is carried from block to block, so the last sequence of a
partition alone can be short; it is cut at powers of two, which need no padding, where that costs less than padding.

Null texts count as empty: a document then has its end id alone. Repeated rows are packed each for itself. Of equally good
places for the cut before a sequence the latest is taken. Texts may have any length; one longer than a sequence is cut. An empty
table gives an empty result. Columns other than doc_id and text don't take part, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunk_table import ChunkTable, per_process
from .common import shipped, slices, small_batches, tidied
from .hashing import Words, gathered, raw, span_hashes

CAPACITY = 2048
SENTENCE_PRICE = 16.0
INNER_PRICE = 64.0
#: Of a cut at a power of two in the last sequence of a partition.
TAIL_PRICE = 4.0
STRIDE = 32
#: Words that go to the tokenizer at a time.
PART = 2048
#: Tokens that a worker gathers before it packs them.
BLOCK = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of texts, word by word: the tokenizer drops white space, and a letter followed by , . ! ? ; : always ends a unit."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()
        self.table = ChunkTable(self.segment, self.add, self.clear, bits=21, limit=1_000_000)

    def clear(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length, self.entries = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def segment(self, words: list[str]) -> list[list[int]]:
        """The ids of each word; in parts, as the tokenizer's results are many times larger than their ids."""
        parts = (words[a : a + PART] for a in range(0, len(words), PART))
        return [x.ids for part in parts for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def add(self, found: list[list[int]]) -> None:
        lengths = np.array([len(x) for x in found], np.int64)
        total, n = int(lengths.sum()), len(found)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.entries + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + total] = np.fromiter((i for x in found for i in x), np.int32, total)
        self.start[self.entries : self.entries + n] = self.used + np.cumsum(lengths) - lengths
        self.length[self.entries : self.entries + n] = lengths
        self.used, self.entries = self.used + total, self.entries + n

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All rows' ids one after another, where each row's end, and the places after which a sentence ends."""
        words = Words(text, lower=True)
        data, n = words.data, len(words.data)
        mark, after = np.zeros(256, bool), np.zeros(256, bool)
        mark[list(b",.!?;:")] = True
        after[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
        left = np.zeros(n, bool)
        left[1:] = after[data[: n - 1]]
        latin = np.zeros(n, bool)  # a letter of two bytes: U+00C0 to U+00FF but for two signs
        latin[2:] = (data[: max(n - 2, 0)] == 0xC3) & (data[1 : max(n - 1, 1)] >= 0x80) & (data[1 : max(n - 1, 1)] != 0x97) & (data[1 : max(n - 1, 1)] != 0xB7) if n > 2 else False
        inside = np.ones(n + 1, bool)
        inside[words.starts] = False
        split = np.flatnonzero(mark[data] & (left | latin) & inside[:n])
        starts = np.sort(np.concatenate([words.starts, split]))
        ends = np.sort(np.concatenate([words.ends, split]))
        rows = np.searchsorted(starts, words.rows)
        hashes = span_hashes(data, starts, ends)
        whole = data.tobytes()
        entry = self.table.find(hashes, lambda i: whole[starts[i] : ends[i]].decode())
        lengths = self.length[entry]
        ids = gathered(self.flat, self.start[entry], lengths)
        upto = np.concatenate([[0], np.cumsum(lengths)])
        stop = np.zeros(256, bool)
        stop[list(b".!?")] = True
        return ids, upto[rows[1:]], upto[1:][stop[data[ends - 1]]]

    def special(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Packer:
    """Takes documents in order; gives the pieces of all sequences that are settled."""

    def __init__(self, first_sequence: int, capacity: int):
        self.sequence, self.capacity = first_sequence, capacity
        self.ids: list[np.ndarray] = []
        self.marks: list[np.ndarray] = []
        self.docs: list[tuple] = []  # key, place of its first id, ids in all
        self.held = 0

    def put(self, key, ids: np.ndarray, marks: np.ndarray) -> None:
        """marks: places within the document after which a sentence ends."""
        self.docs.append((key, self.held, len(ids)))
        self.ids.append(ids)
        self.marks.append(marks + self.held)
        self.held += len(ids)

    def _cuts(self) -> tuple[np.ndarray, np.ndarray]:
        ends = np.array([at + n for _, at, n in self.docs], np.int64)
        marks = np.concatenate([np.zeros(0, np.int64), *self.marks])
        main = np.unique(np.concatenate([[0], ends, marks[(marks > 0) & (marks < self.held)]]))
        gaps = np.diff(main)
        wide = np.flatnonzero(gaps > STRIDE)
        each = (gaps[wide] - 1) // STRIDE
        inner = np.repeat(main[wide], each) + STRIDE * (1 + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
        places = np.concatenate([main, inner])
        price = np.concatenate([np.full(len(main), SENTENCE_PRICE), np.full(len(inner), INNER_PRICE)])
        order = np.argsort(places, kind="stable")
        places, price = places[order], price[order]
        price[np.isin(places, ends)] = 0
        price[0] = 0
        return places, price

    def _plan(self, last: bool) -> list[int]:
        """Where sequences end; without `last` the end of the stream stays open."""
        cuts, price = self._cuts()
        x, price, capacity = cuts.tolist(), price.tolist(), self.capacity
        n = len(x)
        value, back, queue = [0.0] * n, [0] * n, deque([0])
        least = [0.0] * n  # f(i) + price(i) + x(i)
        for j in range(1, n):
            floor = x[j] - capacity
            while x[queue[0]] < floor:
                queue.popleft()
            i = queue[0]
            back[j] = i
            g = least[i] + capacity - x[j]
            value[j] = g
            g += price[j] + x[j]
            least[j] = g
            while queue and least[queue[-1]] >= g:
                queue.pop()
            queue.append(j)
        tail = np.searchsorted(cuts, self.held - capacity)
        j = min(range(int(tail), n), key=lambda k: value[k] + price[k])
        ends = []
        while j:
            ends.append(x[j])
            j = back[j]
        ends.reverse()
        if last and (not ends or ends[-1] < self.held):
            ends.append(self.held)
        if last and ends:
            begin = ends[-2] if len(ends) > 1 else 0
            rest = ends[-1] - begin
            bits = [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
            if rest < capacity and (len(bits) - 1) * TAIL_PRICE < capacity - rest:
                ends[-1:] = (begin + np.cumsum(bits)).tolist()
        return ends

    def settle(self, last: bool) -> Iterator[tuple]:
        """doc key, start, length, crc, doc tokens, sequence, offset of each piece; what isn't settled stays."""
        if not self.held:
            return
        ends = np.array(self._plan(last), np.int64)
        if not len(ends):
            return
        ids = np.concatenate(self.ids).astype("<u4")
        done = int(ends[-1])
        at = np.array([d[1] for d in self.docs], np.int64)
        edges = np.unique(np.concatenate([[0], ends, at[(at > 0) & (at < done)]]))
        doc = np.searchsorted(at, edges[:-1], "right") - 1
        seq = np.searchsorted(ends, edges[:-1], "right")
        first = np.concatenate([[0], ends])[seq]
        for a, b, d, s, f in zip(edges[:-1].tolist(), edges[1:].tolist(), doc.tolist(), seq.tolist(), first.tolist(), strict=True):
            key, start, total = self.docs[d]
            yield key, a - start, b - a, zlib.crc32(ids[a:b].tobytes()), total, self.sequence + s, a - f
        self.sequence += len(ends)
        marks = np.concatenate(self.marks)
        self.docs = [(k, s - done, n) for k, s, n in self.docs if s + n > done]
        self.held -= done
        self.ids, self.marks = [ids[done:].astype(np.int32)], [marks[marks > done] - done]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """One row per piece of a document in a sequence; see SCHEMA. A sequence's number holds the partition and a counter."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = per_process(("word_ids", tokenizer), lambda: WordIds(tokenizer))
        packer = Packer((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, capacity)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def rows(last: bool) -> pa.RecordBatch | None:
            found = list(packer.settle(last))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=names) if found else None

        end = np.array([end_id], np.int32)
        for part in slices(batches):
            text = part.column(1)
            ids, ends, marks = words.encode(text)
            begins = np.concatenate([[0], ends[:-1]])
            of = np.searchsorted(marks, ends, "right")
            whole = raw(text)[0].tobytes()
            odd = b"<|" in whole  # only there can a special token's own text stand
            low = 0
            for i, key in enumerate(part.column(0).to_pylist()):
                mine, here = ids[begins[i] : ends[i]], marks[low : of[i]] - begins[i]
                low = of[i]
                if odd and "<|" in (value := text[i].as_py()):
                    mine, here = np.array(words.special(value), np.int32), np.zeros(0, np.int64)
                packer.put(key, np.concatenate([mine, end]), here)
            if packer.held >= BLOCK and (out := rows(False)):
                yield out
        if out := rows(True):
            yield out

    return small_batches(docs).select("doc_id", "text").mapInArrow(tidied(run), SCHEMA)


shipped(__name__)
