"""Operator 10: token ids in Arrow files of fixed-size lists.

Documents in ascending doc_id order are encoded (as the library does, see `PackedEncoder`), an end id follows each, and the ids of a file are cut
into sequences of one length. A file is in Arrow's random-access format: batches of equally many rows (the
last one may be shorter) with two fixed-size-list columns, `ids` and `mask`; the mask is false on the
padding that fills the last sequence. So sequence i lies in batch i // rows at row i % rows, and a mapped
file gives it without copying. Ids are unsigned 16-bit numbers where the vocabulary fits, else 32-bit.
Beside each file lies an index of its documents (doc_id, first id, number of ids), also in Arrow's format.

Each task writes the files of one range of doc_ids under a name of its own, batch by batch; a repeated
attempt writes other names, and only the names that successful tasks return are read. What the driver
gathers is one row per file.

Defined cases: a null text counts as empty and has the end id alone; null doc_ids come first; rows with one
doc_id follow each other in a fixed order of their texts; an empty table gives an empty result; other columns
of the table are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.llm.batches import Memo, slices, text_column
from ticketloom.llm.shared_files import create, mapped
from ticketloom.llm.word_bpe import MEMO, vocabulary
from ticketloom.llm.word_splits import Vocabulary, plain_segments
from ticketloom.session import scratch_dir

MANIFEST = "file STRING, part INT, n_docs LONG, n_ids LONG"


@dataclass(frozen=True)
class Layout:
    """Ids per sequence, sequences per batch, and the id that ends a document."""

    sequence: int = 2048
    rows: int = 64
    end_id: int = 1


class PackedEncoder:
    """Encodes the texts of a slice together; the library merges each pre-token that the memo lacks.

    The pre-tokens of plain texts are found by their bytes, and each different one is looked up once. All other texts
    take the library's own steps. `code` is the number format of an id: 16 bits if the vocabulary fits, else 32.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.code = "H" if vocabulary.size <= 1 << 16 else "I"
        self.type = np.dtype(f"<{self.code}")
        self.segments, self.tokens = Memo(self._segment, MEMO * 3 // 2), Memo(self._token, MEMO // 2)

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _token(self, token: str) -> bytes:
        return self._packed(self.vocabulary.ids_of_token(token))

    def _segment(self, segment: str) -> bytes:
        if segment.isspace():
            return b""
        return self._token(segment if segment.isascii() else self.vocabulary.mapped(segment))

    def _plain(self, texts: list[str]) -> list[bytes]:
        segments, first = plain_segments(texts)
        found = segments.dictionary_encode()
        packed = list(map(self.segments.__getitem__, found.dictionary.to_numpy(zero_copy_only=False)))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.type.itemsize
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        known = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), self.type)))
        ids = known.take(found.indices).flatten().to_numpy().tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes[found.indices.to_numpy()])])[first] * self.type.itemsize
        return [ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def _by_library(self, text: str) -> bytes:
        parts = self.vocabulary.tokens_of_text(text)
        return b"".join(self.tokens[p] if isinstance(p, str) else self._packed([p]) for p in parts)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        is_plain = [self.vocabulary.is_plain(t) for t in texts]
        plain = iter(self._plain([t for t, p in zip(texts, is_plain) if p]))
        return [next(plain) if p else self._by_library(t) for t, p in zip(texts, is_plain)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def packed_encoder(tokenizer_file: str) -> PackedEncoder:
    """One per Python worker, kept between its tasks."""
    return PackedEncoder(vocabulary(tokenizer_file))


class SequenceWriter:
    """Gathers ids and writes full batches of sequences; the rest is padded at the end."""

    def __init__(self, uri: str, id_type: np.dtype, layout: Layout):
        self.type, self.layout = id_type, layout
        self.waiting, self.size = [], 0
        self.per_batch = layout.sequence * layout.rows * id_type.itemsize
        self.schema = pa.schema(
            {
                "ids": pa.list_(pa.from_numpy_dtype(id_type), layout.sequence),
                "mask": pa.list_(pa.bool_(), layout.sequence),
            }
        )
        self.stream = create(uri)
        self.file = pa.ipc.new_file(self.stream, self.schema)

    def add(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= self.per_batch:
            packed = b"".join(self.waiting)
            whole = len(packed) // self.per_batch * self.per_batch
            for at in range(0, whole, self.per_batch):
                self._batch(packed[at : at + self.per_batch])
            self.waiting, self.size = [packed[whole:]], len(packed) - whole

    def _batch(self, packed: bytes) -> None:
        ids = np.frombuffer(packed, self.type)
        padding = -len(ids) % self.layout.sequence
        mask = np.concatenate([np.ones(len(ids), bool), np.zeros(padding, bool)])
        padded = np.concatenate([ids, np.zeros(padding, self.type)])
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.layout.sequence) for x in (padded, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.size:
            self._batch(b"".join(self.waiting))
        self.file.close()
        self.stream.close()


def write_token_files(documents: DataFrame, tokenizer_file: str, folder: str, layout: Layout) -> DataFrame:
    """Writes the files; a row per file: its name, its range's number, documents, ids. Each run writes anew."""
    text = text_column()
    ordered = (
        documents.select("doc_id", F.xxhash64(text).alias("hash"), text.alias("text"))
        .repartitionByRange("doc_id", "hash")
        .sortWithinPartitions("doc_id", "hash", "text")
        .select("doc_id", "text")
    )

    def write(batches):
        encoder = packed_encoder(tokenizer_file)
        id_type = encoder.type
        end = np.array([layout.end_id], id_type).tobytes()
        name = f"{folder}/{uuid.uuid4().hex}"
        writer = index = stream = None
        n_docs = n_ids = 0
        for batch in slices(batches):
            packed = [ids + end for ids in encoder.encode_all(batch.column("text").to_pylist())]
            sizes = np.array([len(p) // id_type.itemsize for p in packed], np.int64)
            starts = n_ids + np.cumsum(sizes) - sizes
            part = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(starts), pa.array(sizes)], names=["doc_id", "first", "size"]
            )
            if writer is None:
                writer = SequenceWriter(f"{name}.arrow", id_type, layout)
                stream = create(f"{name}.index.arrow")
                index = pa.ipc.new_file(stream, part.schema)
            for p in packed:
                writer.add(p)
            index.write_batch(part)
            n_docs += batch.num_rows
            n_ids += int(sizes.sum())
        if writer is not None:
            writer.close()
            index.close()
            stream.close()
            part = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), part, pa.array([n_docs]), pa.array([n_ids])],
                names=["file", "part", "n_docs", "n_ids"],
            )

    return ordered.mapInArrow(write, MANIFEST)


class SequenceReader:
    """Random access to the ids of a written file, without copying where the file is mapped."""

    def __init__(self, uri: str):
        self.file = pa.ipc.open_file(mapped(uri))
        self.at, self.ids = -1, None
        first = self.file.get_batch(0).column("ids")
        self.per_batch = len(first.values)

    def _batch(self, i: int) -> np.ndarray:
        if i != self.at:
            column = self.file.get_batch(i).column("ids")
            self.at, self.ids = i, column.values.to_numpy(zero_copy_only=True)
        return self.ids

    def parts(self, start: int, size: int):
        """The ids from `start` on, as one array per batch that they touch."""
        while size:
            ids = self._batch(start // self.per_batch)
            offset = start % self.per_batch
            part = ids[offset : offset + size]
            yield part
            start, size = start + len(part), size - len(part)


def read_token_files(files: DataFrame, doc_id: T.StructField) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 from the files named in `files` (file, before).

    `before` is the number of ids in all earlier files. The ids count as little-endian 32-bit numbers.
    """

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = SequenceReader(f"{row['file']}.arrow")
                index = pa.ipc.open_file(mapped(f"{row['file']}.index.arrow"))
                for i in range(index.num_record_batches):
                    part = index.get_batch(i)
                    sums = []
                    for first, size in zip(part.column("first").to_pylist(), part.column("size").to_pylist()):
                        crc = 0
                        for piece in ids.parts(first, size):
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    starts = pa.array(part.column("first").to_numpy() + row["before"])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), starts, part.column("size"), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    new = T.StructType.fromDDL("start LONG, n_tokens LONG, ids_crc32 LONG").fields
    return files.mapInArrow(read, T.StructType([doc_id, *new]))


def token_files(documents: DataFrame, tokenizer_file: str, layout: Layout = Layout()) -> DataFrame:
    """Writes the token files of the documents to the shared folder and reads every document back."""
    spark = documents.sparkSession
    written = write_token_files(documents, tokenizer_file, scratch_dir(spark, "token-files"), layout)
    # One row per file; the ranges are numbered in ascending order.
    before, rows = 0, []
    for row in sorted(written.collect(), key=lambda r: r["part"]):
        rows.append((row["file"], before))
        before += row["n_ids"]
    named = spark.createDataFrame(rows, "file STRING, before LONG").repartition(max(1, len(rows)))
    return read_token_files(named, documents.schema["doc_id"])
