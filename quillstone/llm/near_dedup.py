"""Near-duplicates by ProbMinHash signatures of five-word shingles, banding, and exact verification.

Each distinct shingle has the weight 1, however often it occurs, as in the similarity that decides links. Its arrivals form a Poisson process of that rate; each falls on a random register,
which keeps the earliest, and a shingle stops when its next arrival is later than every register's (Ertl, ProbMinHash). Registers of two
documents agree with their distinct shingles' Jaccard similarity, for which the bands are sized: documents at 0.8 agree on a whole band with
probability 0.99995, whatever repeats in them. Those that do share a bucket. Buckets are never expanded into pairs: each member is held against its bucket's most central member, the one
that shares buckets with the most others. The pairs of different groups that are
left in a bucket are compared in full while it is small; in a large one by prefix filtering, which loses none: two sets of the needed similarity
share one of their first shingles, in an order that puts those first that the centre lacks, rare ones foremost. Large buckets whose centres
are of one group are compared as one, by that group's foremost centre. A pair is linked when
the exact Jaccard similarity of its distinct shingles is at least 0.8, and linked documents form one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, written
from .pieces import few
from .words import WordHashes, shingles, splitmix

BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
SIMILARITY = 0.8
#: Members of a bucket up to which all pairs of different groups are compared.
SMALL = 48
#: Bits of a set's bitmap; a power of two.
BITS = 1024
#: Sizes of sets are told apart in so many steps for a factor of e.
SIZE_STEPS = 64
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(docs: list[np.ndarray]) -> np.ndarray:
    """ProbMinHash registers (32 bits of the winning shingle) of documents given as arrays of shingles, with repeats, not empty."""
    found = [np.unique(d) for d in docs]
    element = np.concatenate(found)
    doc = np.repeat(np.arange(len(docs)), [len(u) for u in found])
    registers = np.full(len(docs) * REGISTERS, _NONE)
    rows = registers.reshape(len(docs), REGISTERS)
    last = np.zeros(len(element))
    arrival = 0
    while len(element):
        g = 1 if arrival < 3 else 4 if arrival < 16 else 16
        draw = splitmix(element[:, None] ^ splitmix(np.arange(arrival + 1, arrival + g + 1, dtype=np.uint64)))
        at = last[:, None] + np.cumsum(-np.log(((draw >> np.uint64(11)) + np.uint64(1)) * 2.0**-53), axis=1)
        place = doc[:, None] * REGISTERS + (splitmix(draw) % np.uint64(REGISTERS)).astype(np.int64)
        packed = (at.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (element[:, None] >> np.uint64(32))
        np.minimum.at(registers, place.ravel(), packed.ravel())
        last = at[:, -1]
        left = np.unique(doc)
        latest = np.zeros(len(docs), np.uint64)
        latest[left] = rows[left].max(axis=1) >> np.uint64(32)
        go = last.astype(np.float32).view(np.uint32) <= latest[doc]
        element, doc, last = element[go], doc[go], last[go]
        arrival += g
    return (rows & np.uint64(0xFFFFFFFF)).astype(np.uint64)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band: documents times BANDS."""
    parts = registers.reshape(len(registers), BANDS, ROWS)
    h = splitmix(parts[:, :, 0])
    for k in range(1, ROWS):
        h = splitmix(h ^ (parts[:, :, k] << np.uint64(7)))
    return h.view(np.int64)


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(n_id, n_text, n_key, n_bands) of every row. The key is a 128-bit hash of the words: the same for copies; null without words."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("n_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("n_text"), F.col(f"`{text_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for big in batches:
            for batch in few(big, 1024):
                keys, sets, with_words = [], [], []
                for t in batch.column(2):
                    words = table.words(t.as_py())
                    keys.append(xxhash.xxh3_128_digest(" ".join(words).encode()) if words else None)
                    with_words.append(bool(words))
                    if words:
                        sets.append(shingles(table.of(words)))
                bands = iter(band_keys(signatures(sets)) if sets else ())
                listed = [next(bands) if has else None for has in with_words]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(listed, pa.list_(pa.int64()))], names=["n_id", "n_text", "n_key", "n_bands"])

    return bounded(rows).mapInArrow(run, "n_id long, n_text long, n_key binary, n_bands array<long>")


def bitmap(shingles_: np.ndarray) -> np.ndarray:
    """A set of shingles as BITS bits in longs, a bit for each by its hash."""
    at = ((shingles_.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (BITS - 1).bit_length())).astype(np.int64)
    out = np.zeros(BITS // 64, np.uint64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out.view(np.int64)


def _shingle_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(s_key, s_set, s_size, s_bits) of the wanted (s_key, s_id, s_text): the distinct shingles of one row of each key, their number and their bitmap."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").alias("t"))
    rows = texts.join(wanted, F.col("i").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_text"))).select("s_key", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for big in batches:
            for batch in few(big):
                sets = [np.unique(shingles(table.of(table.words(t.as_py())))).view(np.int64) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(map(len, sets), pa.int32()), pa.array(map(bitmap, sets), pa.list_(pa.int64()))], names=["s_key", "s_set", "s_size", "s_bits"])

    return bounded(rows).mapInArrow(run, "s_key binary, s_set array<long>, s_size int, s_bits array<long>")


def _bit_columns(side: str) -> list:
    """The longs of s_bits as columns, for conditions that are compiled."""
    return [F.get("s_bits", F.lit(k)).alias(f"{side}{k}") for k in range(BITS // 64)]


def _may_be_linked(a: str, b: str, size_a: str, size_b: str, similarity: float) -> Column:
    """Whether two sets can have the similarity: each bit that only one of them has stands for a shingle that only it has, of which linked sets have few."""
    apart = sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(BITS // 64)), F.lit(0))
    return apart <= (F.col(size_a) + F.col(size_b)) * ((1 - similarity) / (1 + similarity)) + 1e-9


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, j) of all given pairs that have shingles: the exact Jaccard similarity."""
    one = pairs.join(sets.select(F.col("s_key").alias("a"), F.col("s_set").alias("sa")), "a")
    two = one.join(sets.select(F.col("s_key").alias("b"), F.col("s_set").alias("sb")), "b")
    both = two.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    return both.select("a", "b", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("j"))


def components(links: DataFrame) -> DataFrame:
    """(c_key, c_label): each linked key with the least key that it reaches, by rounds of least labels and pointer jumps."""
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("c_key")).agg(F.min("b").alias("m")).select("c_key", F.least("c_key", "m").alias("c_label")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("c_key")).groupBy("a").agg(F.min("c_label").alias("m"))
        lower = labels.join(near, F.col("c_key") == F.col("a")).select("c_key", F.least("c_label", "m").alias("l"), F.col("c_label").alias("was"))
        jump = labels.select(F.col("c_key").alias("j_key"), F.col("c_label").alias("j_label"))
        new = written(lower.join(jump, F.col("l") == F.col("j_key"), "left").select("c_key", F.least("l", F.coalesce("j_label", "l")).alias("c_label"), "was"), "labels")
        if new.where(F.col("c_label") != F.col("was")).isEmpty():
            return new.select("c_key", "c_label")
        labels = new.select("c_key", "c_label")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _open_buckets(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their group (the label of their component, else their own key), and the buckets of several groups with their sizes and most central members."""
    now = members.join(labels, F.col("key") == F.col("c_key"), "left").select(*members.columns, F.coalesce("c_label", "key").alias("label"))
    found = now.groupBy("band", "h").agg(F.max(F.struct("degree", "key", "label")).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    return now, found.select("band", "h", "n", F.col("c.key").alias("c_key"), F.col("c.label").alias("c_label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(n_id, n_text, class_id, kept, n_copies) of every row: its id, its text's hash, its class's least id, whether it's the row of that id, and the class's rows.

    Texts of fewer than five words are one shingle of all their words; null texts and texts without words are classes
    of their own. Copies (the same words) share a class before any comparison. Rows that repeat id and text are alike in every
    column. Null ids take part and count after all others; a class of null ids has the class id null. Ties between central
    members go to the larger key. Long texts count whole; extra columns aren't read. An empty table gives an empty table.
    """
    signed = written(_signed(docs, id_col, text_col), "signed")
    copies = signed.where(F.col("n_key").isNotNull()).groupBy("n_key").agg(F.min(F.struct("n_id", "n_text", "n_bands")).alias("one"))
    banded = copies.select(F.col("n_key").alias("key"), F.posexplode("one.n_bands").alias("band", "h"))
    shared = banded.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = banded.join(shared, ["band", "h"])
    degree = members.groupBy(F.col("key").alias("d_key")).agg(F.sum("n").alias("degree"))
    members = written(members.join(degree, F.col("key") == F.col("d_key")).select("band", "h", "key", "degree"), "members")
    wanted = members.select("key").distinct().join(copies, F.col("key") == F.col("n_key")).select(F.col("key").alias("s_key"), F.col("one.n_id").alias("s_id"), F.col("one.n_text").alias("s_text"))
    sets = written(_shingle_sets(docs, id_col, text_col, wanted).dropDuplicates(["s_key"]), "sets")

    centre = members.groupBy("band", "h").agg(F.max(F.struct("degree", "key")).alias("c"))
    pairs = members.join(centre, ["band", "h"]).where("key != c.key").select(*_ordered("key", "c.key")).distinct()
    compared = written(_links(pairs, sets), "compared")
    labels = components(compared.where(F.col("j") >= similarity))
    pairs = _remaining(*_open_buckets(members, labels), sets, similarity).distinct().join(compared.select("a", "b"), ["a", "b"], "left_anti")
    more = written(_links(pairs, sets).where(F.col("j") >= similarity), "more")
    if not more.isEmpty():
        labels = components(compared.where(F.col("j") >= similarity).union(more))

    named = signed.join(labels, F.col("n_key") == F.col("c_key"), "left").select("n_id", "n_text", F.coalesce("c_label", "n_key").alias("g"))
    named = written(named, "named")
    least = named.where(F.col("g").isNotNull()).groupBy("g").agg(F.min("n_id").alias("class_id"), F.min(F.struct(F.col("n_id").isNull(), "n_id", "n_text")).alias("first"), F.count(F.lit(1)).alias("n_copies")).withColumnRenamed("g", "l")
    least = written(least, "least")  # a table of its own: Spark can then split the join where a class is large
    joined = named.join(least, F.col("g") == F.col("l"), "left")
    alone = F.col("g").isNull()
    kept = alone | (F.col("n_id").eqNullSafe(F.col("first.n_id")) & (F.col("n_text") == F.col("first.n_text")))
    return joined.select("n_id", "n_text", F.when(alone, F.col("n_id")).otherwise(F.col("class_id")).alias("class_id"), kept.alias("kept"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def _remaining(now: DataFrame, centre: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different groups in one bucket that can still be linked; none that is linked is missing.

    Buckets of at most SMALL members: all pairs of different groups. Larger ones: sets a and b of similarity s share at least
    s / (1 + s) * (|a| + |b|) shingles, hence one of the first |a| - s |a| + 1 of a in any order that both follow, and enough of them can still follow the first
    that they share. A pair is made at the first such shingle only, and where the sets' bitmaps leave the similarity possible, which drops all but few of the pairs that aren't linked. The order puts the shingles first that the bucket's centre lacks, the rarest among the centre's members foremost, so that
    few members meet at each: what one member holds alone fills its prefix, and meets nobody. |b| is at least
    s |a|, and at least the next size that occurs at all (in steps of SIZE_STEPS to the power e), which shortens what is dealt. Members of a
    shingle's foremost group meet only those of other groups.
    """
    bits = sets.select(F.col("s_key").alias("key"), F.col("s_size").alias("size"), *_bit_columns("a"))
    small = now.join(centre.where(F.col("n") <= SMALL), ["band", "h"]).select("band", "h", "key", "label").join(bits, "key")
    renamed = {"key": "key2", "label": "label2", "size": "size2"} | {f"a{k}": f"b{k}" for k in range(BITS // 64)}
    other = small.select(*[F.col(c).alias(renamed.get(c, c)) for c in small.columns])
    full = small.join(other, ["band", "h"]).where((F.col("label") < F.col("label2")) & _may_be_linked("a", "b", "size", "size2", similarity)).select(*_ordered("key", "key2"))

    # buckets whose centres are of one group share its foremost centre: a member is dealt once for such a group, in however many of its buckets it stands
    dealt = now.join(centre.where(F.col("n") > SMALL), ["band", "h"])
    foremost = dealt.where("key = c_key").groupBy(F.col("c_label").alias("f_label")).agg(F.max(F.struct("degree", "key")).alias("f"))
    foremost = written(foremost.select("f_label", F.col("f.key").alias("c_key")), "centres")
    large = dealt.select("c_label", "key", "label", "degree").distinct()
    large = large.join(foremost, F.col("c_label") == F.col("f_label")).where("key != c_key").select("c_key", "key", "label", "degree")
    large = large.join(sets.select(F.col("s_key").alias("key"), F.col("s_size").alias("size")), "key")
    step = lambda size: F.floor(F.log(size) * SIZE_STEPS).cast("int")
    occurring = written(large.groupBy(F.col("c_key").alias("o_key")).agg(F.collect_set(step(F.col("size"))).alias("steps")), "occurring")  # of its own: the join can then be split
    least = F.greatest(F.col("size") * similarity, F.exp(F.array_min(F.filter("steps", lambda x: x >= step(F.col("size") * similarity * (1 - 1e-9)))) / SIZE_STEPS) * (1 - 1e-9))
    needed = F.ceil((F.col("size") + least) * (similarity / (1 + similarity)) - 1e-6).cast("int")
    large = large.join(occurring, F.col("c_key") == F.col("o_key")).select("c_key", "key", "label", "degree", "size", (F.col("size") - needed + 1).alias("n_first"))
    both = large.join(sets.select(F.col("s_key").alias("key"), F.col("s_set").alias("sk")), "key").join(sets.select(F.col("s_key").alias("c_key"), F.col("s_set").alias("sc")), "c_key")
    first = F.slice(F.array_intersect("sk", "sc"), F.lit(1), F.col("n_first"))
    both = written(both.select("c_key", "key", "label", "degree", "size", "n_first", F.array_except("sk", "sc").alias("own"), first.alias("common")), "large")
    held = both.select("c_key", "key", F.explode("own").alias("x"))
    often = written(held.groupBy("c_key", "x").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    ranked = held.join(often, ["c_key", "x"]).groupBy(F.col("c_key").alias("r_c"), F.col("key").alias("r_key")).agg(F.sort_array(F.collect_list(F.struct("often", "x"))).alias("ranked"))
    both = both.join(ranked, (F.col("c_key") == F.col("r_c")) & (F.col("key") == F.col("r_key")), "left").withColumn("shared", F.coalesce(F.col("ranked.x"), F.array().cast("array<long>")))
    alone = F.size("own") - F.size("shared")  # those come first in the order, and meet nobody
    both = both.withColumn("alone", alone).where("alone < n_first")
    both = both.withColumn("meeting", F.slice(F.concat("shared", "common"), F.lit(1), F.col("n_first") - F.col("alone"))).drop("size").join(bits, "key")
    entries = both.select("c_key", "key", "label", "degree", "size", "alone", "meeting", *[f"a{k}" for k in range(BITS // 64)], F.posexplode("meeting").alias("k", "x"))
    entries = written(entries.withColumn("at", F.col("alone") + F.col("k")).withColumn("before", F.slice("meeting", F.lit(1), F.col("k"))).drop("alone", "k", "meeting"), "entries")
    groups = entries.groupBy("c_key", "x").agg(F.max(F.struct("degree", "key", "label")).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("c_key", "x", F.col("m.label").alias("foremost"))
    outer = entries.join(groups, ["c_key", "x"]).where("label != foremost").drop("degree", "foremost")
    renamed |= {"at": "at2", "before": "before2"}
    inner = entries.drop("degree").select(*[F.col(c).alias(renamed.get(c, c)) for c in entries.columns if c != "degree"])
    enough = F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2")) >= (F.col("size") + F.col("size2")) * (similarity / (1 + similarity)) - 1e-9
    first = ~F.arrays_overlap("before", "before2")  # a pair is made at the first shingle that both have, and at no other
    once = (F.col("label2") == F.col("foremost2")) | (F.col("label") < F.col("label2"))  # pairs of two others would come from both sides
    inner = inner.join(groups.withColumnRenamed("foremost", "foremost2"), ["c_key", "x"])
    beyond = outer.join(inner, ["c_key", "x"]).where((F.col("label") != F.col("label2")) & once & enough & _may_be_linked("a", "b", "size", "size2", similarity) & first).select(*_ordered("key", "key2"))
    return full.union(beyond)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents less all but one of each class, with their columns; rows that repeat the one that stays go too."""
    kept = near_duplicates(docs, id_col, text_col).where("kept").select(F.col("n_id").alias("k_id"), F.col("n_text").alias("k_text")).distinct()
    hit = docs.join(kept, docs[f"`{id_col}`"].cast("long").eqNullSafe(kept["k_id"]) & (F.xxhash64(docs[f"`{text_col}`"]) == kept["k_text"]), "left_semi")
    return hit.dropDuplicates([id_col, text_col])
