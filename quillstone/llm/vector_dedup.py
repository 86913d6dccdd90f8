"""Near-duplicate vectors by NN-descent: a neighbour graph refined by joins of neighbours of neighbours, whose edges above a threshold are links.

Distinct vectors of a label are nodes; copies count, but aren't nodes. Lists of neighbours start from the leaves of random-projection trees. In each round a node's neighbours, forward
and back, meet each other, where one of them is new; pairs nearer than the worst neighbour of either side enter its list. Rounds go on until few
lists change. Edges at the threshold are verified in double precision. A list that holds links only is saturated: its node may have more links than it
has places. The component of such a node is enlarged to hold all its links: a member at half the threshold's angle from the component's centre at most
is linked with all others of that kind, by the triangle inequality of angles, so these are counted, not compared; the others are compared with the whole component, block by block. Centres of such
components go through the same descent, and where two are near enough, their members are compared too. At last a sample of nodes is compared with all vectors: if too many of its links are missing, lists get
twice the places, and the descent goes on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .graph_search import scaled, usable
from .near_dedup import components

SIMILARITY = 0.93
#: Places of a list; trees, members of a leaf, and neighbours that a leaf gives each member.
PLACES, TREES, LEAF, FROM_LEAF = 16, 4, 64, 8
#: Rounds of a descent at most, and the share of places that change in a round below which it ends.
ROUNDS, SETTLED = 12, 0.002
#: Vectors travel in half precision, which changes a cosine by less than this.
SLACK = 0.004
#: Members compared at once: of those that are compared, and of those that they are compared with.
FEW, MANY = 512, 4096
#: Nodes whose links are audited, the recall that they must show, and how often places are doubled for it.
SAMPLE, RECALL, ENLARGED = 512, 0.98, 3
BITS = 40


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their scale."""
    v = scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _nodes(rows: DataFrame) -> DataFrame:
    """(node, label, dim, h1, h2, least, n, u, q): distinct vectors of a label, with their least id, their number, their direction, and that in half precision."""
    grouped = rows.groupBy("label", "dim", "h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    grouped = grouped.select(F.monotonically_increasing_id().alias("node"), "*")
    kind = rows.schema["label"].dataType.simpleString()
    out = f"node long, label {kind}, dim int, h1 long, h2 long, least long, n long, u array<double>, q binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            dims = big.column("dim").to_numpy()
            for d in np.unique(dims):
                b = big.filter(pa.array(dims == d))
                u = unit(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                q = pa.array([r.tobytes() for r in u.astype(np.float16)], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[:7], _lists(u), q], names=["node", "label", "dim", "h1", "h2", "least", "n", "u", "q"])

    return written(grouped.mapInArrow(run, out), "nodes")


def _vectors(q: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All half-precision numbers of a binary column, and where each row's begin."""
    _, offsets, data = q.buffers()
    at = np.frombuffer(offsets, np.int32)[q.offset : q.offset + len(q) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.float16), (at - at[0]) // 2


def _proposals(groups: DataFrame, first: bool) -> DataFrame:
    """(node, nbr, sim): pairs of a group's members (node, q, kth, fresh), one of them fresh, that are nearer than the kth of node. first: than its FROM_LEAF nearest in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members = b.column(0).flatten()
            ids, kth, fresh = (members.field(c).to_numpy(zero_copy_only=False) for c in ("node", "kth", "fresh"))
            flat, at = _vectors(members.field("q"))
            ends = np.cumsum(b.column(0).value_lengths().to_numpy(zero_copy_only=False))
            out = [[], [], []]
            for lo, hi in zip(np.r_[0, ends[:-1]], ends, strict=True):
                own, place = np.unique(ids[lo:hi], return_index=True)
                if len(own) < 2:
                    continue
                x = flat[at[lo] : at[hi]].reshape(hi - lo, -1)[place].astype(np.float32)
                sims = x @ x.T
                np.fill_diagonal(sims, -2)
                new = np.zeros(len(own), bool)
                new[np.searchsorted(own, ids[lo:hi][fresh[lo:hi]])] = True
                least = -np.partition(-sims, min(FROM_LEAF, len(own) - 1) - 1, axis=1)[:, min(FROM_LEAF, len(own) - 1) - 1] if first else kth[lo:hi][place]
                nearer = sims >= least[:, None] if first else sims > least[:, None]
                i, j = np.nonzero(nearer & (new[:, None] | new) & (sims > -2))
                for kept, found in zip(out, (own[i], own[j], sims[i, j]), strict=True):
                    kept.append(found)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["node", "nbr", "sim"])

    return groups.mapInArrow(run, "node long, nbr long, sim float")


def _leaves(nodes: DataFrame, trees: range) -> DataFrame:
    """Groups of nodes that share a leaf of a tree: cells of random hyperplanes, as many as the label's nodes need, split by hash where they hold more than LEAF."""
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size")).select(F.col("label").alias("s_label"), F.col("dim").alias("s_dim"), "size")
    sized = nodes.join(sizes, (F.col("label") == F.col("s_label")) & (F.col("dim") == F.col("s_dim"))).select("node", "label", "dim", "q", "size")
    kind = nodes.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            dims = big.column("dim").to_numpy()
            for d in np.unique(dims):
                b = big.filter(pa.array(dims == d))
                flat, _ = _vectors(b.column("q"))
                x = flat.reshape(-1, d).astype(np.float32)
                bits = np.ceil(np.log2(np.maximum(1, b.column("size").to_numpy() * 2 / LEAF))).astype(np.int64)
                for tree in trees:
                    planes = np.random.default_rng([tree, d]).normal(size=(d, BITS)).astype(np.float32)
                    code = ((x @ planes > 0) << np.arange(BITS)).sum(axis=1) & ((1 << bits) - 1)
                    yield pa.RecordBatch.from_arrays([b.column("node"), b.column("label"), b.column("dim"), b.column("q"), pa.array(np.full(len(x), tree, np.int32)), pa.array(code)], names=["node", "label", "dim", "q", "tree", "code"])

    cells = written(sized.mapInArrow(run, f"node long, label {kind}, dim int, q binary, tree int, code long"), "cells")
    keys = ["label", "dim", "tree", "code"]
    counts = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("in_cell"))
    part = F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("in_cell") / LEAF)).alias("part")
    member = F.struct("node", "q", F.lit(-1.0).cast("float").alias("kth"), F.lit(True).alias("fresh"))
    dealt = cells.join(counts, keys).select(*keys, part, member.alias("m")).repartition(*keys, "part")  # else a large cell's parts would stay in one task
    return dealt.groupBy(*keys, "part").agg(F.collect_list("m").alias("m")).select("m")


def _improved(lists: DataFrame, proposals: DataFrame, places: int) -> DataFrame:
    """lists after taking in the proposals: (node, q, nbrs, kth), nbrs of (sim, nbr, fresh), nearest first."""
    best = proposals.repartition("node").groupBy("node", "nbr").agg(F.max("sim").alias("sim"))
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr"))
    best = best.withColumn("nth", nth).where(F.col("nth") <= places).groupBy(F.col("node").alias("p_node")).agg(F.collect_list(F.struct("sim", "nbr", F.lit(True).alias("fresh"))).alias("found"))
    joined = lists.join(best, F.col("node") == F.col("p_node"), "left")
    old = F.transform("nbrs", lambda x: F.struct(x["sim"].alias("sim"), x["nbr"].alias("nbr"), F.lit(False).alias("fresh")))
    known = F.transform("nbrs", lambda x: x["nbr"])
    new = F.filter(F.coalesce("found", F.array().cast("array<struct<sim:float,nbr:bigint,fresh:boolean>>")), lambda x: ~F.array_contains(known, x["nbr"]))
    nbrs = F.slice(F.sort_array(F.concat(old, new), asc=False), 1, places)
    kth = F.when(F.size("nbrs") >= places, F.col("nbrs")[places - 1]["sim"]).otherwise(F.lit(-1.0).cast("float"))
    return written(joined.select("node", "q", nbrs.alias("nbrs")).select("node", "q", "nbrs", kth.alias("kth")), "lists")


def _meetings(lists: DataFrame, places: int, turn: int) -> DataFrame:
    """Groups of a node's neighbours, forward and back (as many back as there are places, by a hash that changes with turn), where one is fresh."""
    edges = lists.select("node", F.explode("nbrs").alias("e")).select("node", F.col("e.nbr").alias("nbr"), F.col("e.fresh").alias("fresh"))
    both = edges.select(F.col("node").alias("at"), F.col("nbr").alias("u"), "fresh", F.lit(0).alias("back")).union(edges.select("nbr", "node", "fresh", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy("at", "back").orderBy(F.xxhash64("u", F.lit(turn)), "u"))
    both = both.repartition("at").withColumn("nth", nth).where(F.col("nth") <= places).withColumn("any", F.max("fresh").over(Window.partitionBy("at"))).where("any")
    payload = lists.select(F.col("node").alias("u"), "q", "kth")
    return both.select("at", "u", "fresh").join(payload, "u").groupBy("at").agg(F.collect_list(F.struct(F.col("u").alias("node"), "q", "kth", "fresh")).alias("m")).select("m")


def descend(nodes: DataFrame, places: int = PLACES, lists: DataFrame | None = None, trees: range = range(TREES)) -> DataFrame:
    """(node, q, nbrs, kth) for nodes (node, label, dim, q): lists of nearest neighbours of a label, after rounds of neighbours of neighbours. lists: where to go on from."""
    empty = F.array().cast("array<struct<sim:float,nbr:bigint,fresh:boolean>>")
    start = lists if lists is not None else nodes.select("node", "q", empty.alias("nbrs"))
    lists = _improved(start, _proposals(_leaves(nodes, trees), True), places)
    for turn in range(ROUNDS):
        lists = _improved(lists, _proposals(_meetings(lists, places, turn), False), places)
        changed, held = lists.select(F.sum(F.size(F.filter("nbrs", lambda x: x["fresh"]))), F.sum(F.size("nbrs"))).first()
        if not held or changed <= SETTLED * held:
            break
    return lists


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _edges(lists: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, na, nb): verified links among list entries, a below b, with the copies of each."""
    near = lists.select("node", F.explode("nbrs").alias("e")).where(F.col("e.sim") >= similarity - SLACK)
    pairs = near.select(F.least("node", "e.nbr").alias("a"), F.greatest("node", "e.nbr").alias("b")).distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("u").alias(f"u{x}"), F.col("n").alias(f"n{x}"))
    return written(pairs.join(side("a"), "a").join(side("b"), "b").where(_dot("ua", "ub") >= similarity).select("a", "b", "na", "nb"), "links")


def _compared(similarity: float):
    def run(few: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        if few.empty or many.empty:
            return pd.DataFrame({"node": [], "links": [], "witness": []}, dtype="int64")
        a, b = np.stack(few["u"].to_numpy()), np.stack(many["u"].to_numpy())
        linked = (a @ b.T >= similarity) & (few["node"].to_numpy()[:, None] != many["node"].to_numpy())
        left = pd.DataFrame({"node": few["node"], "links": linked @ many["n"].to_numpy(), "witness": np.where(linked.any(axis=1), many["node"].to_numpy()[linked.argmax(axis=1)], -1)})
        right = pd.DataFrame({"node": many["node"], "links": few["n"].to_numpy() @ linked, "witness": -1})[many["counts"].to_numpy(dtype=bool)]
        return pd.concat([left, right])

    return run


def _in_blocks(few: DataFrame, many: DataFrame, similarity: float) -> DataFrame:
    """(node, links, witness) of comparing few (x, node, n, u) with many (x, node, n, u, counts) of the same x: links by copies, one linked node. many's rows are given links only where counts says so."""
    sizes = few.groupBy("x").agg(F.count(F.lit(1)).alias("n_few")).join(many.groupBy("x").agg(F.count(F.lit(1)).alias("n_many")), "x")
    sizes = written(sizes.select("x", F.ceil(F.col("n_few") / FEW).alias("fews"), F.ceil(F.col("n_many") / MANY).alias("manys")), "blocks")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = few.join(sizes, "x").select("x", place("fews").alias("f"), every("manys").alias("m"), "node", "n", "u")
    right = many.join(sizes, "x").select("x", every("fews").alias("f"), place("manys").alias("m"), "node", "n", "u", "counts")
    left, right = (d.select(*[F.col(c).alias(c) for c in d.columns]) for d in (left, right))  # both may come from one table
    keys = ["x", "f", "m"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_compared(similarity), "node long, links long, witness long")


def _enlarged(lists: DataFrame, nodes: DataFrame, labels: DataFrame, similarity: float, places: int) -> tuple[DataFrame, DataFrame] | None:
    """(node, links) of all members of saturated components, by copies, and (a, b) of links between such components; None where no list is saturated."""
    full = lists.where((F.size("nbrs") >= places) & (F.col("kth") >= similarity - SLACK)).select("node")
    dense = labels.join(full, F.col("c_key") == F.col("node")).select(F.col("c_label").alias("c")).distinct()
    members = labels.join(dense, F.col("c_label") == F.col("c")).select("c", F.col("c_key").alias("node"))
    members = written(members.join(nodes.select("node", "label", "dim", "n", "u"), "node"), "members")
    if members.isEmpty():
        return None
    half = math.acos(similarity) / 2 - 1e-7
    sums = members.select("c", "label", "dim", F.posexplode("u").alias("i", "s")).groupBy("c", "label", "dim", "i").agg(F.sum("s").alias("s"))
    sums = sums.groupBy("c", "label", "dim").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("sum"))
    length = F.sqrt(_dot("sum", "sum"))
    centres = written(sums.select(F.col("c").alias("c_c"), "label", "dim", F.transform("sum", lambda x: x / F.greatest(length, F.lit(1e-300))).alias("centre")), "centres")
    angle = lambda a, b: F.acos(F.greatest(F.least(_dot(a, b), F.lit(1.0)), F.lit(-1.0)))
    placed = written(members.join(centres.select("c_c", "centre"), F.col("c") == F.col("c_c")).select("c", "node", "n", "u", angle("u", "centre").alias("angle")), "placed")
    core = F.col("angle") <= half
    facts = written(placed.groupBy(F.col("c").alias("f_c")).agg(F.sum(F.when(core, F.col("n"))).alias("core_n"), F.max("angle").alias("radius")), "facts")
    inner = placed.where(core).join(facts, F.col("c") == F.col("f_c")).select("node", (F.col("core_n") - F.col("n")).alias("links"))
    rim = placed.where(~core).select(F.col("c").alias("x"), "node", "n", "u")
    found = _in_blocks(rim, placed.select(F.col("c").alias("x"), "node", "n", "u", core.alias("counts")), similarity).select("node", "links")
    links, between = inner.union(found), _near_centres(centres, facts, similarity)
    if between.isEmpty():
        return links, between.select("a", "b")
    far = between.select(F.struct("a", "b").alias("x"), "a", "b", F.col("rb").alias("r"), F.col("cb").alias("centre"))
    near = angle("u", "centre") <= F.col("r") + 2 * half + 1e-6
    few = far.join(placed, F.col("a") == F.col("c")).where(near).select("x", "node", "n", "u")
    many = far.join(placed, F.col("b") == F.col("c")).select("x", "node", "n", "u", F.lit(True).alias("counts"))
    across = written(_in_blocks(few, many, similarity), "across")
    return links.union(across.select("node", "links")), across.where("witness >= 0").select(F.col("node").alias("a"), F.col("witness").alias("b"))


def _near_centres(centres: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, rb, cb): components so near that members may be linked, a below b, with b's radius and centre; found by the same descent over centres, with more places while a list may lack some."""
    half_bytes = F.col("c_c")
    named = centres.join(facts, F.col("c_c") == F.col("f_c")).select(half_bytes.alias("node"), "label", "dim", "centre", "radius")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = pa.array([np.array(c, np.float16).tobytes() for c in b.column("centre").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, q], names=[*b.schema.names, "q"])

    kind = centres.schema["label"].dataType.simpleString()
    nodes = written(named.mapInArrow(run, f"node long, label {kind}, dim int, centre array<double>, radius double, q binary"), "centre-nodes")
    total, widest = nodes.select(F.count(F.lit(1)), F.max("radius")).first()
    reach = math.acos(similarity) + 0.01 + F.col("radius")
    places, lists = PLACES, None
    while True:
        lists = descend(nodes, places, lists, range(places, places + TREES))
        sides = lists.join(nodes.select(F.col("node").alias("r_node"), "radius"), F.col("node") == F.col("r_node"))
        lacking = sides.where((F.size("nbrs") >= places) & (F.acos(F.greatest(F.least("kth", F.lit(1.0)), F.lit(-1.0))) <= reach + F.lit(widest))).isEmpty()
        if lacking or places >= total:
            break
        places *= 2
    pairs = lists.select("node", F.explode("nbrs").alias("e")).select(F.least("node", "e.nbr").alias("a"), F.greatest("node", "e.nbr").alias("b")).distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("radius").alias(f"r{x}"), F.col("centre").alias(f"c{x}"))
    near = F.acos(F.greatest(F.least(_dot("ca", "cb"), F.lit(1.0)), F.lit(-1.0))) <= math.acos(similarity) + 1e-6 + F.col("ra") + F.col("rb")
    return written(pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b", "rb", "cb"), "near-centres")


def _audited(nodes: DataFrame, counts: DataFrame, similarity: float) -> float:
    """Share of the links of SAMPLE nodes, chosen by hash and compared with all, that counts (node, links) has."""
    order = F.xxhash64("node", F.lit("audit"))
    sample = nodes.select("node", "label", "dim", "u").orderBy(order, "node").limit(SAMPLE).collect()  # SAMPLE vectors at most
    by = {}
    for r in sample:
        by.setdefault((r["label"], r["dim"]), []).append((r["node"], r["u"]))
    known = {k: (np.array([n for n, _ in v]), np.array([u for _, u in v]).T) for k, v in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for b in batches:
            where = pd.DataFrame({"label": b.column("label").to_pylist(), "dim": b.column("dim").to_numpy()}, dtype=object).groupby(["label", "dim"]).indices
            n, node = b.column("n").to_numpy(), b.column("node").to_numpy()
            for key, rows in where.items():
                if key in known:
                    names, u = known[key]
                    x = b.column("u").take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1)
                    linked = (x @ u >= similarity) & (node[rows][:, None] != names)
                    for name, s in zip(names.tolist(), (n[rows] @ linked).tolist(), strict=True):
                        total[name] = total.get(name, 0) + s
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["s_node", "true"])

    true = nodes.select("node", "label", "dim", "n", "u").mapInArrow(run, "s_node long, true long").groupBy("s_node").agg(F.sum("true").alias("true"))
    true, found = true.join(counts, F.col("s_node") == F.col("node"), "left").select(F.sum("true"), F.sum(F.coalesce("links", F.lit(0)))).first()
    return found / true if true else 1.0


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) of every row: vectors of its label at a cosine of similarity or more, the least id that links reach, and the recall that the audit measured.

    Vectors null, empty, zero or with null or non-finite components, and rows of null label, link with nothing; rows of null id don't either, have no component, and are kept. Vectors of different
    lengths aren't compared. Rows that repeat a vector are linked with each other, under the same id as well. An empty table gives an empty table; extra columns aren't read.
    """
    takes = usable(id_col, vec_col) & F.col(f"`{label_col}`").isNotNull()
    v = F.when(takes, F.col(f"`{vec_col}`").cast("array<double>"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), F.when(takes, F.col(f"`{label_col}`")).alias("label"))
    rows = written(rows.select("*", F.size("v").alias("dim"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")), "vectors")
    nodes = _nodes(rows.where(F.col("v").isNotNull()))
    places, lists, trees, recall = PLACES, None, 0, 1.0
    for attempt in range(ENLARGED + 1):
        lists = descend(nodes.select("node", "label", "dim", "q"), places, lists, range(trees, trees + TREES))
        edges = _edges(lists, nodes, similarity)
        labels = components(edges)
        dense = _enlarged(lists, nodes, labels, similarity, places)
        sides = edges.select(F.col("a").alias("node"), F.col("nb").alias("links"), F.col("a").alias("c")).union(edges.select("b", "na", "a"))
        if dense is None:
            counted = sides.select("node", "links")
        else:
            enlarged = written(dense[0], "enlarged")
            counted = sides.join(enlarged.select(F.col("node").alias("d_node")).distinct(), F.col("c") == F.col("d_node"), "left_anti").select("node", "links").union(enlarged)
            if not dense[1].isEmpty():
                labels = components(edges.select("a", "b").union(dense[1]))
        counts = written(counted.groupBy("node").agg(F.sum("links").alias("links")), "counts")
        recall = _audited(nodes, counts, similarity)
        if recall >= RECALL or attempt == ENLARGED:
            break
        places, trees = 2 * places, trees + TREES
    named = nodes.join(labels, F.col("node") == F.col("c_key"), "left").join(counts.withColumnRenamed("node", "k_node"), F.col("node") == F.col("k_node"), "left")
    named = named.select("label", "dim", "h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("c_label", "node").alias("c"))
    named = written(named, "named")
    least = named.groupBy(F.col("c").alias("l_c")).agg(F.min("least").alias("component_id"))
    named = named.join(least, F.col("c") == F.col("l_c")).select(*[F.col(x).alias(f"n_{x}") for x in ("label", "dim", "h1", "h2")], "n_links", "component_id")
    named = written(named, "named")  # a table of its own: Spark can then split the join where a vector has many copies
    same = (F.col("label") == F.col("n_label")) & (F.col("dim") == F.col("n_dim")) & (F.col("h1") == F.col("n_h1")) & (F.col("h2") == F.col("n_h2")) & F.col("v").isNotNull()
    joined = rows.select("id", "label", "dim", "h1", "h2", F.when(F.col("v").isNotNull(), True).alias("v")).join(named, same, "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.lit(float(recall)).alias("audit_recall"))


#: near_duplicates(embeddings) in DuckDB SQL, by comparing all pairs of a label: for small tables.
SQL = f"""WITH RECURSIVE
whole AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding) AND len(list_filter(embedding, lambda x: x != 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM whole a JOIN whole b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id != b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {SIMILARITY}),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least AS component_id, e.vec_id = least AS kept, 1.0::DOUBLE AS audit_recall
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON e.vec_id = l.a LEFT JOIN (SELECT a, min(b) AS least FROM reached GROUP BY a) r ON e.vec_id = r.a"""
