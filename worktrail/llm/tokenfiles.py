"""Token ids in binary files: independent zstandard frames with a trailing seek table.

Layout of a file (public zstandard seekable format): frames, each compressed alone, then one skippable
frame that lists for each frame its compressed size, its size and the low 32 bits of the XXH64 of its
contents, and ends with the number of frames.  The contents of a frame, little-endian:

    u32 documents | per document: u8 has id, i64 id, u32 tokens | ids of all its documents as u32

A reader takes the seek table from the end of the file and decompresses the frames it needs.  Files of
lost or repeated task attempts have names of their own and are in no manifest.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worktrail.llm.pieces import PieceIds, class_ids, cuts_at_classes, library_ids, white_pieces, with_others
from worktrail.llm.store import in_arrow, once, shared_folder, written

# Fixed values of the public format.
SKIPPABLE_MAGIC, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80

FRAME_TOKENS = 1 << 16
_HEAD = np.dtype([("has", "u1"), ("id", "<i8"), ("n", "<u4")])


class FrameWriter:
    """Frames and their seek table, into an open binary file."""

    def __init__(self, file) -> None:
        import zstandard

        self.file = file
        self.compress = zstandard.ZstdCompressor(level=1, write_checksum=True).compress
        self.entries: list[tuple[int, int, int]] = []

    def add(self, content: bytes) -> None:
        import xxhash

        frame = self.compress(content)
        self.file.write(frame)
        self.entries.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def finish(self) -> None:
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEK_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class FrameReader:
    """Frames of an open, seekable binary file by number."""

    def __init__(self, file) -> None:
        import zstandard

        self.file = file
        self.decompress = zstandard.ZstdDecompressor().decompress
        size = file.seek(0, 2) or file.tell()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.size, self.content_size, self.checksum = table[:, 0], table[:, 1], table[:, 2]
        self.begin = np.cumsum(self.size) - self.size

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.size)

    def frame(self, i: int) -> bytes:
        """The contents of frame ``i``; raises ValueError where the checksum does not hold."""
        import xxhash
        import zstandard

        try:
            content = self.decompress(self._at(int(self.begin[i]), int(self.size[i])), max_output_size=int(self.content_size[i]))
        except zstandard.ZstdError as e:
            raise ValueError(f"frame {i} is damaged") from e
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.checksum[i]:
            raise ValueError(f"frame {i} has a wrong checksum")
        return content


def pack(ids: list[int | None], counts: np.ndarray, tokens: np.ndarray) -> bytes:
    """The contents of a frame."""
    head = np.zeros(len(ids), _HEAD)
    head["has"] = [i is not None for i in ids]
    head["id"] = [i or 0 for i in ids]
    head["n"] = counts
    return struct.pack("<I", len(ids)) + head.tobytes() + tokens.astype("<u4").tobytes()


def unpack(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", content)
    head = np.frombuffer(content, _HEAD, n, 4)
    ids = [int(i) if has else None for has, i in zip(head["has"], head["id"], strict=True)]
    return ids, head["n"].astype(np.int64), np.frombuffer(content, "<u4", offset=4 + n * _HEAD.itemsize)


def _open_folder(folder: str):
    """The file system of a URI (any that pyarrow knows) and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, frame_tokens: int = FRAME_TOKENS) -> tuple[str, DataFrame]:
    """Encode each whole text, append ``end_id``, and write ids in ascending ``id_col`` order.

    Returns the folder and the manifest: ``part``, ``file``, ``docs``, ``tokens`` and ``start`` (tokens of
    all files before it), a row per file, in the order of ``part``.  A null text counts as empty (just the
    end id); null ids come first; rows with one id are ordered by their text; repeated rows stay; other
    columns are not carried; an empty table gives an empty manifest.  Texts are dealt out by ranges of the
    id (and a digest of the text, so that one id can span files) and encoded after that, once.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def load():
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(tokenizer_path)
            made.no_truncation()
            made.no_padding()
            return made

        library = once(f"tokenizer {tokenizer_path}", load)
        separator = next(iter(library.get_added_tokens_decoder().values())).content
        classes = once(f"classes {tokenizer_path}", lambda: cuts_at_classes(library))
        memo = once(f"white ids {tokenizer_path}", lambda: PieceIds((class_ids if classes else library_ids)(library, separator), spaced=False))
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        file, frames, n_docs, n_tokens = None, None, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            if file is None:
                system, place = _open_folder(folder)
                system.create_dir(place, recursive=True)
                file = system.open_output_stream(f"{place}/{name}")
                frames = FrameWriter(file)
            texts = batch.column(1).fill_null("")
            hard = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
            others = {int(i): np.array(library.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(hard)}
            tokens, counts = with_others(*memo.of(white_pieces(pc.if_else(hard, "", texts), classes)), others)
            ids = batch.column(0).to_pylist()
            tokens = np.insert(tokens.astype(np.uint32), np.cumsum(counts), end_id)
            counts = counts + 1
            border = np.concatenate([[0], np.cumsum(counts)])
            a = 0
            while a < len(ids):  # so many documents that the frame is full, and one at least
                b = max(a + 1, int(np.searchsorted(border, border[a] + frame_tokens, side="right")) - 1)
                frames.add(pack(ids[a:b], counts[a:b], tokens[border[a] : border[b]]))
                a = b
            n_docs, n_tokens = n_docs + len(ids), n_tokens + int(border[-1])
        if file is not None:
            frames.finish()
            file.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "docs": [n_docs], "tokens": [n_tokens]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    manifest = written(in_arrow(ordered, run, "part int, file string, docs long, tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return folder, manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_token_files(folder: str, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All documents of the files: id, ``start`` (ids of all documents before), ``n_tokens`` and ``ids_le`` (u32 ids as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{place}/{row['file']}") as file:
                    reader, start = FrameReader(file), row["start"]
                    for i in range(len(reader)):
                        ids, counts, tokens = unpack(reader.frame(i))
                        border = np.concatenate([[0], np.cumsum(counts)])
                        packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((4 * border).astype(np.int32).tobytes()), pa.py_buffer(tokens.tobytes())])
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start + border[:-1]), pa.array(counts), packed], ["id", "start", "n_tokens", "ids_le"])
                        start += int(border[-1])

    n = max(1, manifest.count())  # a row per file: each file is a task of its own
    files = manifest.select("part", "file", "start").repartitionByRange(n, "part")
    return in_arrow(files, run, "id long, start long, n_tokens long, ids_le binary").withColumnRenamed("id", id_col)


def read_documents(folder: str, file: str, wanted: set[int]) -> dict[int, list[int]]:
    """The ids of some documents of one file; as ids ascend, only frames that can have one of them are decompressed in full."""
    system, place = _open_folder(folder)
    found: dict[int, list[int]] = {}
    with system.open_input_file(f"{place}/{file}") as handle:
        reader = FrameReader(handle)
        low, high = 0, len(reader)
        for w in sorted(wanted):
            a, b = low, high
            while a < b:  # the first frame whose last id is not before the one wanted
                m = (a + b) // 2
                last = unpack(reader.frame(m))[0][-1]
                a, b = (m + 1, b) if last is None or last < w else (a, m)
            if a < len(reader):
                ids, counts, tokens = unpack(reader.frame(a))
                if w in ids:
                    i = ids.index(w)
                    begin = int(counts[:i].sum())
                    found[w] = tokens[begin : begin + int(counts[i])].tolist()
            low = a
    return found


def op10_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Write the ids of all documents and read them back."""
    import public_tokenizers

    folder, manifest = write_token_files(spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))
