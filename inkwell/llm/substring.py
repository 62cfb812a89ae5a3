"""Substring deduplication by level-wise doubling.

A window of `window` words is removed where its words stand at another place too. Lengths double up to the window (35
words: 9, 18, then 35). At each length only windows still alive take part: each is represented by the least hash among its
runs of that length (equal windows have equal least runs), and a window whose least run stands at one place alone dies.
What is alive at the full length stands at two places at least. So the first level sends about one in fourteen of all
places, later ones only what is alive.

Documents travel in chunks, one row of about `PASS_BYTES` of text each, written once. A chunk sends its distinct hashes
to the blocks of the hash space, which answer with one bit for each: does another chunk have it? A common passage is
thus one hash per chunk, however many documents hold it. Documents without living windows are finished at once.

Words are `[^\\x20\\x09-\\x0D]+`; null texts have none. Windows don't cross documents. Rows that repeat a text remove each
other's windows. Hashes have 64 bits, those of two levels must meet for a false match. Texts may have
any length, an empty table gives an empty result. Further columns don't take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks
from .common import PASS_BYTES, rows_of, shipped, slices, small_batches, tidied, written
from .hashing import Runs, Words, raw, windows

WINDOW = 35
#: Doubling starts from the first length that is not above this.
FIRST = 12
CHUNK = "chunk long, ids array<long>, size long, ends binary, texts binary, alive binary"


def levels(window: int) -> list[int]:
    out = [window]
    while out[0] > FIRST:
        out.insert(0, -(-out[0] // 2))
    return out


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each `width` consecutive values."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _packed(number: int, ids: list, texts: list[bytes], alive: np.ndarray | None) -> tuple:
    whole = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return number, ids, len(whole), ends.tobytes(), pa.compress(whole, codec="zstd", asbytes=True), None if alive is None else pa.compress(np.packbits(alive).tobytes(), codec="zstd", asbytes=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["chunk", "ids", "size", "ends", "texts", "alive"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents gathered to chunks, numbered by task and place."""
    from pyspark import TaskContext

    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    ids, texts, held = [], [], 0
    for part in slices(batches):
        data, rows = raw(part.column(1))
        whole, rows = data.tobytes(), rows.tolist()
        ids += part.column(0).to_pylist()
        texts += [whole[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
        held += len(whole)
        if held >= PASS_BYTES:
            yield _batch([_packed(number, ids, texts, None)])
            number, ids, texts, held = number + 1, [], [], 0
    if ids:
        yield _batch([_packed(number, ids, texts, None)])


def chunked(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) in chunks, as a table."""
    return written(small_batches(docs).select("doc_id", "text").mapInArrow(tidied(_chunks), CHUNK))


class Chunk:
    """A chunk's documents as words, and the hashes that stand for its living windows at a length."""

    def __init__(self, row: dict, window: int):
        self.ids = row["ids"]
        size, ends = row["size"], np.frombuffer(row["ends"], np.int64)
        whole = pa.decompress(row["texts"], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
        self.rows = np.concatenate([[0], ends])
        self.texts = [whole[a:b] for a, b in zip(self.rows[:-1].tolist(), self.rows[1:].tolist(), strict=True)]
        self.words = Words(pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(self.rows.tobytes()), pa.py_buffer(whole)))
        self.runs = Runs(self.words.hashes())
        n = len(self.words.starts)
        self.alive = np.zeros(n, bool)
        self.alive[windows(self.words.row_ends, window)] = True
        if row["alive"] is not None:
            bits = np.frombuffer(pa.decompress(row["alive"], decompressed_size=(n + 7) // 8, codec="zstd", asbytes=True), np.uint8)
            self.alive = np.unpackbits(bits, count=n).astype(bool)
        self.window = window

    def represent(self, length: int) -> None:
        """least: of each place the least hash of a run within its window; distinct, counts: of the runs that are least somewhere."""
        n, width = len(self.alive), self.window - length + 1
        hashes = np.zeros(n, np.uint64)
        if n >= length:
            hashes[: n - length + 1] = self.runs.of(np.arange(n - length + 1), length)
        self.least = np.zeros(n, np.uint64)
        if n >= width:
            self.least[: n - width + 1] = _sliding(hashes, width, np.minimum)
        living = np.concatenate([np.zeros(width - 1, np.uint64), np.where(self.alive, self.least, np.uint64(0))])
        most = _sliding(living, width, np.maximum) if n else living[:0]  # over the windows that cover a place
        self.distinct, self.counts = np.unique(hashes[(most == hashes) & (most > 0)], return_counts=True)

    def keep(self, repeated: np.ndarray) -> None:
        """Only windows whose least run is among the repeated ones stay alive."""
        at = np.flatnonzero(self.alive)
        place = np.minimum(np.searchsorted(repeated, self.least[at]), max(len(repeated) - 1, 0))
        self.alive[at] = repeated[place] == self.least[at] if len(repeated) else False


def _remove(chunks: DataFrame, length: int, window: int, digest: bool, bits: int) -> DataFrame:
    """The next level's chunks, and (chunk null) the documents that are finished."""
    last = length == window

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = Chunk(row, window)
            chunk.represent(length)
            yield blocks.sent(row["chunk"], chunk.distinct, bits)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = Chunk(row, window)
            chunk.represent(length)
            repeated = (chunk.counts > 1) | blocks.shared(chunk.distinct, row["answers"], bits)
            chunk.keep(chunk.distinct[repeated])
            yield _finished(row["chunk"], chunk, last, digest)

    answers = blocks.answered(chunks.mapInArrow(tidied(send), blocks.SENT))
    # Answers grow with the corpus: sorted and merged at any size, rather than broadcast while they are few.
    return chunks.join(answers.hint("merge"), "chunk", "left").mapInArrow(tidied(apply), f"{CHUNK}, doc_id long, n_words long, n_removed long, kept string")


def _finished(number: int, chunk: Chunk, last: bool, digest: bool) -> pa.RecordBatch:
    rows = chunk.words.row_ends
    upto = np.concatenate([[0], np.cumsum(chunk.alive)])
    living = upto[rows[1:]] > upto[rows[:-1]]
    done = range(len(chunk.ids)) if last else np.flatnonzero(~living).tolist()
    if last:  # words under living windows
        edge = np.zeros(len(chunk.alive) + 1, np.int32)
        starts = np.flatnonzero(chunk.alive)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + chunk.window, -1)
        stay = np.cumsum(edge[:-1]) == 0
    out = []
    for i in done:
        words = chunk.texts[i].split()
        kept = list(compress(words, stay[rows[i] : rows[i + 1]].tolist())) if last and living[i] else words
        text = b" ".join(kept)
        out.append((chunk.ids[i], len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest() if digest else text.decode()))
    next_row = []
    if not last and living.any():
        more = np.flatnonzero(living)
        alive = np.concatenate([chunk.alive[rows[i] : rows[i + 1]] for i in more.tolist()])
        next_row = [_packed(number, [chunk.ids[i] for i in more.tolist()], [chunk.texts[i] for i in more.tolist()], alive)]
    head = _batch([(None,) * 6] * len(out) + next_row)
    tail = out + [(None,) * 4] * len(next_row)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([*head.columns, *(pa.array([r[i] for r in tail], k) for i, k in enumerate(kinds))], names=[*head.schema.names, "doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept of each row of docs (doc_id, text): the words that stay, joined by a blank, or with `digest` their SHA-256."""
    chunks = chunked(docs)
    bits = blocks.bits_for(chunks.count())
    finished = None
    for length in levels(window):
        out = _remove(chunks, length, window, digest, bits)
        if length != window:
            out = written(out)
            chunks = out.filter("chunk IS NOT NULL").select("chunk", "ids", "size", "ends", "texts", "alive")
            out = out.filter("chunk IS NULL")
        out = out.select("doc_id", "n_words", "n_removed", "kept")
        finished = out if finished is None else finished.unionByName(out)
    return finished


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT r, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM d),
runs AS (SELECT r, place, word, CASE WHEN place <= n - 34 THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY place ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS run FROM w),
told AS (SELECT r, place, word, run IS NOT NULL AND count(*) OVER (PARTITION BY run) > 1 AS twice FROM runs),
gone AS (SELECT r, place, word, bool_or(twice) OVER (PARTITION BY r ORDER BY place ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS removed FROM told),
kept AS (SELECT r, count(*) AS n_words, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (NOT removed) AS text FROM gone GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

shipped(__name__)
