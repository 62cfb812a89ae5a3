"""SentencePiece encoding and decoding through a table of distinct marked words.

Where no piece of the model has a whitespace marker after another character, no merge crosses from one marked
word (its markers and what follows them) into the next, so each distinct marked word is segmented once per
worker and its ids are put back by position. A model with crossing pieces is applied to whole texts instead.

Null texts count as empty, and give no ids. Repeated rows each get their own result; further columns pass through
`encode` untouched unless they clash with a result's name, when the result wins. Texts may have any length; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunk_table import ChunkTable, per_process
from .common import shipped, slices, small_batches, tidied
from .hashing import raw, span_hashes

MARKER = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Segments batches of texts; `numbers`, `decimals` and `plain` hold each distinct chunk's ids, their decimals and decoded text."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.by_chunk = not any(MARKER in self.sp.id_to_piece(i).lstrip(MARKER) for i in range(self.sp.get_piece_size()))
        self.lone = self.sp.piece_to_id(MARKER)
        self.clear()
        self.table = ChunkTable(self.segment, self.add, self.clear)

    def clear(self) -> None:
        self.numbers, self.decimals, self.plain = [], [], []

    def segment(self, chunks: list[str]) -> list[list[int]]:
        return [ids or [self.lone] for ids in self.sp.encode(chunks, num_threads=1)]

    def add(self, found: list[list[int]]) -> None:
        self.numbers += [np.array(x, np.int32) for x in found]
        self.decimals += [",".join(map(str, x)) for x in found]
        self.plain += self.sp.decode(found)

    def entries(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' entries in order, and where each row's begin and end."""
        data, rows = raw(text)
        n = len(data)
        blank = np.zeros(n + 1, bool)
        blank[:n] = data == 32
        first = blank[:n].copy()
        first[1:] &= ~blank[: n - 1] if n else first[1:]
        inner = np.zeros(n + 1, bool)
        inner[rows] = True
        first &= ~inner[:n]  # a text's own beginning already has a marker
        full = np.flatnonzero(np.diff(rows) > 0)
        begins = np.sort(np.concatenate([np.flatnonzero(first), rows[full]]))
        opened = ~inner[begins]
        ends = np.append(begins[1:], n)
        starts = begins + opened  # without the marker, which encode() adds
        some = np.flatnonzero(ends > starts)
        hashes = np.full(len(starts), np.uint64(0x9E3779B97F4A7C15))
        hashes[some] = span_hashes(data, starts[some], ends[some])
        whole = data.tobytes()
        found = self.table.find(hashes, lambda i: whole[starts[i] : ends[i]].decode())
        return found, np.searchsorted(begins, rows)


def _codec(model: str) -> Codec:
    return per_process(("piece_codec", model), lambda: Codec(model))


def encode(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """The input's columns with ids array<int> and decoded string, the text that these ids give back."""
    model = model or default_model()
    keep = [i for i, c in enumerate(docs.columns) if c.lower() not in ("ids", "decoded")]
    plain = [f"c{i}" for i in range(len(docs.columns))]
    given = small_batches(docs).toDF(*plain).select(*(plain[i] for i in keep))
    at = keep.index(docs.columns.index(text))
    schema = T.StructType([*given.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for part in slices(batches, f"c{keep[at]}"):
            values = pc.replace_substring(part.column(at), MARKER, " ")
            if codec.by_chunk:
                found, rows = codec.entries(values)
                found = found.tolist()
                ids = [np.concatenate([codec.numbers[i] for i in found[a:b]]) if b > a else [] for a, b in zip(rows[:-1], rows[1:], strict=True)]
                back = [" ".join([codec.plain[i] for i in found[a:b]]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
            else:
                ids = codec.sp.encode(values.to_pylist(), num_threads=1)
                back = codec.sp.decode(ids) if ids else []
            columns = [c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in part.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], names=schema.names)

    return given.mapInArrow(tidied(run), schema).toDF(*(docs.columns[i] for i in keep), "ids", "decoded")


def decode(tokens: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """The input's columns with decoded string; null ids give null."""
    model = model or default_model()
    keep = [i for i, c in enumerate(tokens.columns) if c.lower() != "decoded"]
    plain = [f"c{i}" for i in range(len(tokens.columns))]
    given = tokens.toDF(*plain).select(*(plain[i] for i in keep))
    at = keep.index(tokens.columns.index(ids))
    schema = T.StructType([*given.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for part in batches:
            back = [None if x is None else codec.sp.decode([int(i) for i in x]) for x in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(back, pa.string())], names=schema.names)

    return given.mapInArrow(run, schema).toDF(*(tokens.columns[i] for i in keep), "decoded")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the codec's results in brief, made where the ids are so that these needn't travel."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for part in slices(batches):
            values = pc.replace_substring(part.column(1), MARKER, " ")
            n, of_ids, of_text = [], [], []
            if codec.by_chunk:
                found, rows = codec.entries(values)
                found = found.tolist()
                decimals, plain, numbers = codec.decimals, codec.plain, codec.numbers
                for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                    mine = found[a:b]
                    joined = ",".join([decimals[i] for i in mine])
                    n.append(joined.count(",") + (b > a))
                    of_ids.append(sha(joined))
                    of_text.append(sha(" ".join([plain[i] for i in mine])))
            else:
                for value in values.to_pylist():
                    ids = codec.sp.encode(value, num_threads=1)
                    n.append(len(ids))
                    of_ids.append(sha(",".join(map(str, ids))))
                    of_text.append(sha(codec.sp.decode(ids)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


shipped(__name__)
