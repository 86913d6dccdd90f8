"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a model crosses a whitespace marker (a piece has markers at its start only), a text's ids are the ids of its
chunks, one after the other: a chunk is a run of markers with the word behind it. Each distinct chunk of the corpus is segmented once, and its ids are
joined back by position. Frequent chunks (those that some task meets twice, at most HEAD of them) form a table that is broadcast; the others
are dealt by chunk, segmented, and dealt back by a hash of the text that they stand in and their place among its rare chunks. Meanwhile a text travels as the ranks of its
frequent chunks and the rare ones in full. A hash that two texts share does no harm: where they differ, a place comes back twice, and its chunk is segmented again
where the text is.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, plus, without, written

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Chunks that are broadcast at most, and their characters: about 25 MB. The others are joined by shuffles.
HEAD, HEAD_CHARS = 600_000, 16_000_000
#: Chunks and characters that a task counts before it reports those met twice and starts anew; bounds memory, not results.
COUNTED, COUNTED_CHARS = 1_000_000, 64_000_000
#: Bits of a text's hash, and of the place of a rare chunk among those of its text (further ones are segmented where the text is).
HASH_BITS, PLACE_BITS = 39, 24


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def splits_at_marks(path: str) -> bool:
    """Whether chunks stand alone: the model adds the mark in front, keeps white space and text as they are, and no piece has a mark behind another character."""
    sp = processor(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    plain = sp.normalize(" a  Åﬁ ") == f"{MARK}{MARK}a{MARK}{MARK}Åﬁ{MARK}"
    return plain and MARK in pieces and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)


def chunks(text: str) -> list[str]:
    """The chunks of a text, each less its first mark (the model adds that again)."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    return [c[1:] for c in CHUNK.findall(marked)] if MARK * 2 in marked or marked[-1] == MARK else marked[1:].split(MARK)


def segmenter(path: str) -> Callable[[list[str]], list[bytes]]:
    """What encodes chunks, each to its ids as bytes (32-bit, little-endian)."""
    sp = processor(path)
    mark = np.array([sp.piece_to_id(MARK)], "<i4").tobytes()
    return lambda keys: [np.array(ids, "<i4").tobytes() if k else mark for k, ids in zip(keys, sp.encode(keys, num_threads=1), strict=True)]


_HEADS: dict[str, tuple] = {}


def head_table(name: str, packed: bytes, what: str):
    """From the broadcast table, once for all tasks of a worker process: ranks (chunk to rank, from 1), or ids (all ids in a row, where each rank's begin, and their numbers)."""
    key = f"{name}-{what}"
    if key not in _HEADS:
        for old in [k for k in _HEADS if not k.startswith(name)]:
            del _HEADS[old]
        with pa.ipc.open_stream(packed) as reader:
            table = reader.read_all()
        if what == "ranks":
            _HEADS[key] = {w: k for k, w in enumerate(table.column(0).to_pylist(), 1)}
        else:
            lists = table.column(1).to_pylist()
            n = np.array([len(x) // 4 for x in lists], "i8")
            _HEADS[key] = np.frombuffer(b"".join(lists), "<i4"), np.cumsum(n) - n, n
    return _HEADS[key]


def varints(x: np.ndarray) -> bytes:
    """Numbers below 2^21 in one to three bytes each: seven bits to a byte, low ones first."""
    n = 1 + (x >= 1 << 7) + (x >= 1 << 14)
    at = np.cumsum(n) - n
    out = np.empty(int(n.sum()), "u1")
    for k in range(3):
        has = n > k
        out[at[has] + k] = (x[has] >> 7 * k & 127) | np.where(n[has] > k + 1, 128, 0)
    return out.tobytes()


def numbers(data: bytes) -> np.ndarray:
    """What varints was given."""
    b = np.frombuffer(data, "u1").astype("i8")
    if not len(b):
        return b
    first = np.flatnonzero(np.concatenate([[True], b[:-1] < 128]))
    place = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    return np.add.reduceat((b & 127) << 7 * place, first)


def shorthand(text: str, rank: dict[str, int]) -> bytes:
    """A text as the ranks of its chunks, 0 for those without one, and those in full (no chunk has a space in it)."""
    cs = chunks(text)
    found = list(map(rank.get, cs, repeat(0)))
    ranks = varints(np.array(found, "i8"))
    return len(ranks).to_bytes(4, "little") + ranks + " ".join([c for c, k in zip(cs, found, strict=True) if not k]).encode()


def rare_chunks(cs: list[str], rank: dict[str, int]) -> list[str]:
    """The distinct chunks without a rank, by name: a chunk's place is its index."""
    return sorted(set(cs).difference(rank))


def _sized(n: int) -> bytes:
    return bytes([n]) if n < 255 else b"\xff" + n.to_bytes(4, "little")


def entry(ids: bytes) -> bytes:
    """The ids of a chunk behind their size: 16 bits each where they all fit."""
    x = np.frombuffer(ids, "<i4")
    small = not len(x) or x.max() < 1 << 16
    return _sized(2 * len(x) + (not small)) + (x.astype("<u2").tobytes() if small else ids)


def entries(packed: bytes) -> Iterator[tuple[int, bytes]]:
    """The places and ids (32 bits each) of entries that stand one behind another, each behind its place."""
    at, size = 0, len(packed)
    while at < size:
        found = []
        for _ in range(2):
            n, at = packed[at], at + 1
            if n == 255:
                n, at = int.from_bytes(packed[at : at + 4], "little"), at + 4
            found.append(n)
        place, n = found
        ids = packed[at : at + (n >> 1) * (4 if n & 1 else 2)]
        at += len(ids)
        yield place, ids if n & 1 else np.frombuffer(ids, "<u2").astype("<i4").tobytes()


def list_array(parts: list[bytes]) -> pa.Array:
    """An array of lists of 32-bit integers from their bytes."""
    offsets = np.zeros(len(parts) + 1, "<i4")
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    data = b"".join(parts)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), len(data) // 4, [None, pa.py_buffer(data)]))


def few(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in smaller ones: bounds what a task holds in Python objects at once."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def frequent_chunks(texts: DataFrame, path: str) -> DataFrame:
    """(w, x, n): at most HEAD chunks of at most HEAD_CHARS characters, the most frequent ones of those that a task meets twice, with their ids and counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        chars = 0

        def met_twice() -> pa.RecordBatch:
            often = [(w, n) for w, n in found.items() if n > 1]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], names=["w", "n"])

        for batch in batches:
            for t in batch.column(0):
                text = t.as_py() or ""
                found.update(chunks(text))
                chars += len(text)
                if len(found) > COUNTED or chars > COUNTED_CHARS:
                    yield met_twice()
                    found.clear()
                    chars = 0
        yield met_twice()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = segmenter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(segment(batch.column(0).to_pylist()), pa.binary()), batch.column(1)], names=["w", "x", "n"])

    counted = written(bounded(texts).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "counted", "zstd")
    step = F.floor(F.log("n") * 8)
    sizes = counted.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k"), F.sum(F.length("w")).alias("c")).collect()  # a row for each step, some hundreds at most
    sizes = sorted(((r.s, r.k, r.c) for r in sizes), reverse=True)
    fit = [s for (s, _, _), n, c in zip(sizes, accumulate(k for _, k, _ in sizes), accumulate(c for *_, c in sizes), strict=True) if n <= HEAD and c <= HEAD_CHARS]
    return counted.where(step >= min(fit) if fit else F.lit(False)).mapInArrow(encoded, "w string, x binary, n long")


def _by_chunk(kept: DataFrame, path: str, text_col: str, shown: list[str]) -> DataFrame:
    """The columns shown and ids, by the table of distinct chunks."""
    spark, text = kept.sparkSession, F.col(f"`{text_col}`")
    head = frequent_chunks(kept.select(text), path).toArrow().sort_by([("n", "descending"), ("w", "ascending")]).select(["w", "x"])  # of bounded size
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, head.schema) as writer:
        writer.write_table(head)
    shared, name = spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = head_table(name, shared.value, "ranks")
        for big in batches:
            for batch in few(big):
                found = [rare_chunks(chunks(t), rank)[: 1 << PLACE_BITS] if t else [] for t in batch.column(1).to_pylist()]
                places = [(h << PLACE_BITS) + np.arange(len(x)) for h, x in zip(batch.column(0).to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places), pa.int64()), pa.array([w for x in found for w in x], pa.string())], names=["p", "w"])

    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each rare chunk of each text. Spark gathers them by text: what a task gathered itself, a text has a row for each task that holds one of its chunks, more of them on larger inputs."""
        segment, last, known = segmenter(path), (None, None), (None, b"")
        for batch in batches:  # in the order of chunks, then of texts and places
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            new = list(dict.fromkeys(w for _, w in pairs if w != known[0]))
            table = dict(zip(new, map(entry, segment(new)), strict=True)) | {known[0]: known[1]}
            fresh = [x for x, before in zip(pairs, [last, *pairs[:-1]], strict=True) if x != before]  # else it is a copy of the text
            if pairs:
                last = pairs[-1]
                known = last[1], table[last[1]]
            texts = pa.array([p >> PLACE_BITS for p, _ in fresh], pa.int64())
            yield pa.RecordBatch.from_arrays([texts, pa.array([_sized(p & (1 << PLACE_BITS) - 1) + table[w] for p, w in fresh], pa.binary())], names=["h", "e"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, rank = zstandard.ZstdCompressor(level=3, write_content_size=True).compress, head_table(name, shared.value, "ranks")
        for big in batches:
            for batch in few(big, 64):
                z = pa.array([pack(shorthand(t.as_py(), rank)) if t.as_py() else None for t in batch.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), z, batch.column(2)], names=["h", "z", "own"])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, segment = zstandard.ZstdDecompressor().decompress, segmenter(path)
        flat, begin, number = head_table(name, shared.value, "ids")

        def rare(words: list[str], more: list[bytes]) -> list[bytes]:
            got: dict[int, bytes] = {}
            twice = set()
            for e in more:
                for k, ids in entries(e):
                    if k in got:
                        twice.add(k)
                    got[k] = ids
            again = [k for k in range(len(words)) if k in twice or k not in got]
            got.update(zip(again, segment([words[k] for k in again]) if again else (), strict=True))
            return [got[k] for k in range(len(words))]

        for big in batches:
            for batch in few(big, 64):
                at, own, counts = [np.zeros(0, "i8")], [], []
                for z, more in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    data = unpack(z) if z else bytes(4)
                    end = 4 + int.from_bytes(data[:4], "little")
                    rank = numbers(data[4:end]) - 1
                    holes = np.flatnonzero(rank < 0)
                    if len(holes):
                        full = data[end:].decode().split(" ")
                        place = {w: k for k, w in enumerate(rare_chunks(full, {}))}
                        rank[holes] = np.array([place[w] for w in full]) + len(number) + len(own)
                        own += rare(list(place), more or [])
                    at.append(rank)
                    counts.append(len(rank))
                at = np.concatenate(at)
                mine, other = at >= len(number), np.array([len(x) // 4 for x in own], "i8")
                n, start = np.empty(len(at), "i8"), np.empty(len(at), "i8")
                n[~mine], start[~mine] = number[at[~mine]], begin[at[~mine]]
                n[mine], start[mine] = other[at[mine] - len(number)], (np.cumsum(other) - other)[at[mine] - len(number)] + len(flat)
                ends = np.concatenate([[0], np.cumsum(n)])
                source = np.repeat(start - ends[:-1], n) + np.arange(ends[-1])
                mine, ids = source >= len(flat), np.empty(len(source), "<i4")
                ids[~mine], ids[mine] = flat[source[~mine]], np.frombuffer(b"".join(own), "<i4")[source[mine] - len(flat)]
                offsets = ends[np.concatenate([[0], np.cumsum(counts)]).astype("i8")]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=["own", "ids"])

    hashed = F.pmod(F.xxhash64(text), F.lit(1 << HASH_BITS)).alias("h")
    rows = bounded(kept.select(hashed, text.alias("t"))).mapInArrow(others, "p long, w string")
    dealt = bounded(rows.repartition("w").sortWithinPartitions("w", "p")).mapInArrow(segmented, "h long, e binary")
    back = dealt.groupBy(F.col("h").alias("b_h")).agg(F.collect_list("e").alias("more"))
    rows = kept.select(hashed, text.alias("t"), F.struct(F.lit(0).alias("quillstone_row"), *[F.col(f"`{c}`") for c in shown]).alias("own"))
    own = rows.schema["own"]
    zipped = bounded(rows).mapInArrow(packed, T.StructType([rows.schema["h"], T.StructField("z", T.BinaryType()), own]))
    joined = zipped.join(back, F.col("h") == F.col("b_h"), "left").select("z", "own", "more")
    done = bounded(joined).mapInArrow(assembled, T.StructType([own, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return done.select(*[F.col("own").getField(c).alias(c) for c in shown], "ids")


def _whole(kept: DataFrame, path: str, text_col: str) -> DataFrame:
    """All columns and ids, text by text."""
    place = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        for big in batches:
            for batch in few(big):
                ids = list_array([np.array(sp.encode(t.as_py() or "", num_threads=1), "<i4").tobytes() for t in batch.column(place)])
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return bounded(kept).mapInArrow(run, plus(kept, ("ids", "array<int>")))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ids (array<int>): each whole text as the library encodes it, without begin and end ids.

    Null and empty texts have no ids. A model whose pieces may cross marks is run on whole texts. Repeated rows are encoded
    each; long texts are not cut. Other columns pass through (the text itself only with keep_text); an input column ids is replaced. An empty table
    gives an empty table.
    """
    kept = without(docs, ["ids"] if text_col != "ids" else [])
    shown = [c for c in kept.columns if keep_text or c != text_col]
    if not splits_at_marks(model_path):
        return _whole(kept, model_path, text_col).select(*[F.col(f"`{c}`") for c in shown], "ids")
    return _by_chunk(kept, model_path, text_col, shown)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded (string): the text that the library gives for each row's ids; null and empty ids give an empty text.

    Other columns pass through; an input column decoded is replaced.
    """
    kept = without(encoded, ["decoded"] if ids_col != "decoded" else [])
    place = kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model_path)
        for big in batches:
            for batch in few(big):
                text = [sp.decode(x.values.to_numpy().tolist()) if x.is_valid and len(x) else "" for x in batch.column(place)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "decoded"])

    return bounded(kept).mapInArrow(run, plus(kept, ("decoded", "string")))


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """The columns that the query returns."""
    both = decode(encode(docs.select("doc_id", "text"), model_path, keep_text=False), model_path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
