"""Token ids in binary files: independent zstandard frames, then a frame that lists the documents, then a seek table.

Layout of a file, in Zstandard's public seekable format: data frames of FRAME ids each (unsigned 32-bit, little-endian), each
its own frame; one frame with the documents (ids as 64-bit integers, a byte that marks null ids, token counts as 64-bit
integers); a skippable frame (magic 0x184D2A5E) with 12 bytes for each frame (compressed size, size, low 32 bits of the XXH64 of
the content) and a footer of 9 bytes (number of frames, flags with the checksum bit, magic 0x8F92EAB1). A reader takes the table from the
end of the file, and then reads and decompresses only the frames that hold the documents that it wants.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyspark.sql.types as T
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, new_folder
from .token_counts import ALPHABET, LETTERS, MARKS, tokenizer

FRAME = 65_536
SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Entries of a task's table at most before it starts anew; bounds memory, not results.
TABLE = 1_200_000
#: Splits before a space that has other characters on both sides: a pre-token of the byte-level pattern always starts there.
INNER_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: White space but blanks and line ends.
OTHER_SPACES = [c for c in map(chr, range(1 << 16)) if c.isspace() and c not in " \n"]
#: A plain word and the marks behind it.
PLAIN = re.compile(f"([{LETTERS}]+)([{MARKS}]*)")
MANIFEST = "path string, first_id long, n_docs long, n_tokens long, part int"


@lru_cache(maxsize=2)
def starts_at_space(path: str) -> bool:
    """Whether the tokenizer is plain byte-level BPE, whose pre-tokens start at a space between two words."""
    t = tokenizer(path)
    kind = type(t.pre_tokenizer).__name__ == "ByteLevel" and not t.pre_tokenizer.add_prefix_space and t.normalizer is None
    probe = "Ab c's 12\n d é! x"
    parts = INNER_SPACE.split(probe)
    return kind and sum((t.encode(p, add_special_tokens=False).ids for p in parts), []) == t.encode(probe, add_special_tokens=False).ids


class IdTable(dict):
    """From a stretch of text behind an inner space, without it, to its ids as bytes; each distinct stretch is encoded once by the library."""

    def __init__(self, path: str):
        self.tokenizer, self.whole = tokenizer(path), not starts_at_space(path)
        self.atoms: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the table before this one: what is met again moves here
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        letters = "".join(chr(c) for c in range(65, 256) if re.match(f"[{LETTERS}]", chr(c)))
        probe = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(f" {letters}{MARKS}\n{letters}")] if self.tokenizer.pre_tokenizer else []
        self.plain = not self.whole and probe == [x.translate(ALPHABET) for x in (f" {letters}", MARKS, "\n", letters)]

    def _encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _made(self, pretoken: str) -> bytes:
        ids = [t.id for t in self.tokenizer.model.tokenize(pretoken.translate(ALPHABET))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _atom(self, pretoken: str) -> bytes:
        """Ids of a word that no space is before, of marks, or of one line end."""
        if (found := self.atoms.get(pretoken)) is None:
            found = self.atoms[pretoken] = self._made(pretoken)
        return found

    def _line(self, text: str) -> bytes | None:
        """Ids of a word that no space is before, and its marks; null if it's something else."""
        m = PLAIN.fullmatch(text) if self.plain else None
        return m and (self._atom(m[1]) + self._atom(m[2]) if m[2] else self._atom(m[1]))

    def __missing__(self, rest: str) -> bytes:
        """Letters, marks and line ends between words are pre-tokens of their own: the word is what is kept. Stretches over lines seldom repeat and aren't kept."""
        if (found := self.old.get(rest)) is None:
            if self.plain and "\n" in rest:
                word, *lines = rest.split("\n")
                parts = [self[word] if PLAIN.fullmatch(word) else None, *map(self._line, lines)]
                return self._encoded(" " + rest) if None in parts else self._atom("\n").join(parts)
            m = PLAIN.fullmatch(rest) if self.plain else None
            found = self._encoded(" " + rest) if m is None else self[m[1]] + self._atom(m[2]) if m[2] else self._made(" " + rest)
        self[rest] = found
        return found

    def encode(self, text: str) -> bytes:
        if self.whole or self.special and self.special.search(text):
            return self._encoded(text)
        if "  " in text or " \n" in text or "\n " in text or any(map(text.__contains__, OTHER_SPACES)) or text[:1].isspace() or text[-1:].isspace():
            first, *parts = INNER_SPACE.split(text)
            parts = [p[1:] for p in parts]
        else:
            first, *parts = text.split(" ")
        if len(self) > TABLE // 2:
            self.old = dict(self)
            self.clear()
        if len(self.atoms) > TABLE // 4:
            self.atoms.clear()
        line = self._line(first)
        return (self._encoded(first) if line is None else line) + b"".join(map(self.__getitem__, parts))


@lru_cache(maxsize=1)
def id_table(path: str) -> IdTable:
    """One table for all tasks of a worker process."""
    return IdTable(path)


class FrameWriter:
    """Writes one file; holds a frame's ids at most, beside the documents' list."""

    def __init__(self, sink, level: int = 3):
        import xxhash
        import zstandard

        self.sink, self.hash = sink, xxhash.xxh64_intdigest
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.table: list[bytes] = []
        self.left = bytearray()
        self.docs: list[tuple[int | None, int]] = []

    def _frame(self, data: bytes) -> None:
        packed = self.pack(data)
        self.sink.write(packed)
        self.table.append(struct.pack("<III", len(packed), len(data), self.hash(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.left += ids
        while len(self.left) >= 4 * FRAME:
            self._frame(bytes(self.left[: 4 * FRAME]))
            del self.left[: 4 * FRAME]

    def close(self) -> None:
        if self.left:
            self._frame(bytes(self.left))
        names = np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
        nulls = np.array([d is None for d, _ in self.docs], "u1").tobytes()
        self._frame(names + nulls + np.array([n for _, n in self.docs], "<i8").tobytes())
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), CHECKED, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class FrameReader:
    """Reads one file: its seek table and list of documents at once, frames as they are asked for."""

    def __init__(self, source):
        import xxhash
        import zstandard

        self.source, self.hash, self.unpack = source, xxhash.xxh64_intdigest, zstandard.ZstdDecompressor().decompress
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or not flags & CHECKED:
            raise ValueError("not a token file: its seek table is missing")
        source.seek(size - 9 - 12 * n)
        table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.table, self.at = table, np.concatenate([[0], np.cumsum(table[:, 0])])
        listed = self.frame(n - 1)
        k = len(listed) // 17
        self.doc_ids, self.nulls, self.sizes = np.frombuffer(listed, "<i8", k), np.frombuffer(listed, "u1", k, 8 * k), np.frombuffer(listed, "<i8", k, 9 * k)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.at[k]))
        data = self.unpack(self.source.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if self.hash(data) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k}: its checksum differs")
        return data

    def documents(self, want=None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, first id's place in the file, ids) of the documents whose ids are wanted (None: all)."""
        last, data = -1, b""
        for d in range(len(self.doc_ids)):
            doc = None if self.nulls[d] else int(self.doc_ids[d])
            if want is not None and doc not in want:
                continue
            a, b = int(self.starts[d]), int(self.starts[d + 1])
            parts = []
            for k in range(a // FRAME, (b - 1) // FRAME + 1 if b > a else a // FRAME):
                if k != last:
                    last, data = k, self.frame(k)
                parts.append(data[4 * max(0, a - k * FRAME) : 4 * (b - k * FRAME)])
            yield doc, a, b"".join(parts)


def opened(path: str):
    """The file system and the path in it: any store that pyarrow knows (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends end_id, and writes the ids in ascending id order, a file for each partition; returns the manifest.

    Null and empty texts have the end id alone. Null ids come first; rows that repeat an id stay apart, ordered by text. Each
    attempt of a task writes a file of its own, and the manifest lists those of the attempts that counted: a task that runs
    again, or twice at once, touches no file of another. Extra columns aren't stored. An empty table gives no files.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").alias("t")).repartitionByRange("d").sortWithinPartitions("d", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        table, tail = id_table(path), struct.pack("<I", end_id)
        fs, base = opened(folder)
        name = f"part-{part:06d}-{context.taskAttemptId()}.ids.zst"
        writer, sink, total = None, None, 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(f"{base}/{name}", compression=None)  # the writer has compressed already
                    writer = FrameWriter(sink)
                ids = table.encode(t.as_py() or "") + tail
                total += len(ids) // 4
                writer.add(d, ids)
        if writer is not None:
            writer.close()
            sink.close()
            first = next((d for d, _ in writer.docs if d is not None), None)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "first_id": pa.array([first], pa.int64()), "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_tokens": pa.array([total], pa.int64()), "part": pa.array([part], pa.int32())})

    at = f"{folder}/manifest"
    bounded(rows).mapInArrow(run, MANIFEST).write.parquet(at)
    return spark.read.schema(MANIFEST).parquet(at)


def read_token_files(manifest: DataFrame, want: set[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids as bytes) of the documents of a manifest's files, or of the wanted ones alone.

    start counts the ids of all documents before, over all files: each file's first place is a sum over the manifest, which
    has a row for each file. Files are in the order of their ids, so wanted documents are looked for only in the file whose
    ids can include them. Frames are checked against their checksums.
    """
    return _read(manifest, want, [("ids", T.BinaryType(), pa.binary(), lambda ids: ids)])


def read_checksums(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    return _read(manifest, None, [("ids_crc32", T.LongType(), pa.int64(), zlib.crc32)])


def _read(manifest: DataFrame, want: set[int] | None, made: list) -> DataFrame:
    spark = manifest.sparkSession
    files = sorted((r.part, r.path, r.n_tokens, r.first_id) for r in manifest.select("part", "path", "n_tokens", "first_id").collect())
    starts = np.concatenate([[0], np.cumsum([n for _, _, n, _ in files])]) if files else [0]
    listed = [(path, int(s), first) for (_, path, _, first), s in zip(files, starts, strict=False)]
    if want is not None:
        held = [f for f in listed if f[2] is not None]  # a file without a first id holds null ids alone
        firsts = [f[2] for f in held]
        places = {bisect_right(firsts, d) - 1 for d in want}
        listed = [held[k] for k in sorted(places) if k >= 0]
    listed = [f[:2] for f in listed]
    at = spark.createDataFrame(listed, "path string, start long")
    at = at.repartition(max(1, len(listed))) if listed else at
    schema = T.StructType().add("doc_id", "long").add("start", "long").add("n_tokens", "long")
    for name, kind, *_ in made:
        schema = schema.add(name, kind)
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), *[(n, k) for n, _, k, _ in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, place = opened(path)
                with fs.open_input_file(place) as source:
                    rows, held = [], 0
                    for doc, a, ids in FrameReader(source).documents(want):
                        rows.append((doc, first + a, len(ids) // 4, *(f(ids) for *_, f in made)))
                        held += len(ids) + 64
                        if held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return bounded(at).mapInArrow(run, schema)


def token_file_digests(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Writes the files into the shared folder and reads them back: the rows that the query returns."""
    return read_checksums(write_token_files(docs, new_folder(spark, "tokens"), path))
