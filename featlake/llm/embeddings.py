"""Near-duplicate groups of embeddings over a robust-pruned flat graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featlake.llm.common import components, spread
from featlake.session import settle

SHARD = 2048        # vectors of a shard, and of a block of a dense one
PIVOTS = 32         # cells that one split makes at most
OVERLAP = 3         # nearest cells that a vector belongs to
SHRINK = 0.7        # a cell above this share of the one it was split from is dense, and goes on in blocks
SALT = 8192         # vectors that are assigned to cells together
DEGREE = 32         # neighbours kept by pruning; as many lead back on average
NEAR = 64           # nearest vectors that pruning chooses from
ALPHA = 1.2
BEAM = 24           # candidates of the greedy search
ENTRIES = 8         # medoids to start from
SAMPLE = 1000       # vectors whose links are also counted against all others, at most


# --- inside a shard ------------------------------------------------------------------------------------------------


def pruned(candidates: np.ndarray, sims: np.ndarray, all_sims: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning of all rows at once: candidates by falling similarity (-1: none); the nearest stays and takes out those
    that it is nearer to, by the factor ``ALPHA``, than the row is; and so on. Returns ``degree`` columns, -1 where fewer stay."""
    alive = candidates >= 0
    out = np.full((len(candidates), degree), -1, np.int64)
    away = 2 - 2 * sims
    rows = np.arange(len(candidates))
    for d in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        at = alive.argmax(axis=1)
        star = candidates[rows, at]
        out[some, d] = star[some]
        alive &= ~(ALPHA * (2 - 2 * all_sims[star[:, None], candidates]) <= away)
        alive[rows, at] = False
    return out


def built(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Graph of one shard: both ends of its edges, the pruned nearest neighbours and the way back to each.

    The way back is kept whole: in a dense group many lists name the same inner vectors, and only the way back leads from
    there to the outer ones. There are at most ``2 * DEGREE`` edges a vector in all.
    """
    n = len(x)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    near = min(NEAR, n - 1)
    if near < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = np.argpartition(-sims, near - 1, axis=1)[:, :near]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)
    out = pruned(top, np.take_along_axis(sims, top, 1), sims, DEGREE)
    a, d = np.nonzero(out >= 0)
    b = out[a, d]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    return pairs // n, pairs % n


def medoids(x: np.ndarray, number: int) -> list[int]:
    """The vector nearest to the mean, then those farthest from all chosen before."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    best = x @ x[chosen[0]]
    while len(chosen) < min(number, len(x)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[chosen[-1]])
    return chosen


def searched(q: np.ndarray, x: np.ndarray, graph: tuple[np.ndarray, np.ndarray], least: float, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) of similarity ``least`` or more that the graph leads to.

    Greedy search from the medoids with a beam; then from everything in range on to its neighbours, as long as new ones in
    range turn up. ``own``: the queries are the vectors themselves, whose own neighbours are looked at too.
    """
    nq, n = len(q), len(x)
    seen = np.zeros((nq, n), bool)
    inside = np.zeros((nq, n), bool)
    if own is not None:
        seen[np.arange(nq), own] = True
    entry = np.array(medoids(x, ENTRIES))
    beam = np.full((nq, BEAM), -1, np.int64)
    sims = np.full((nq, BEAM), -3.0)
    open_ = np.zeros((nq, BEAM), bool)

    order = np.argsort(graph[0], kind="stable")
    ends = graph[1][order]
    degree = np.bincount(graph[0], minlength=n)
    first = np.cumsum(degree) - degree

    def around(qi: np.ndarray, vi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours of vectors, each with the query."""
        group, place = spread(degree[vi])
        return qi[group], ends[first[vi][group] + place]

    def look(qi: np.ndarray, vi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Similarities of pairs not seen before."""
        flat = qi * n + vi
        new = np.zeros(nq * n, bool)
        new[flat[~seen.ravel()[flat]]] = True
        flat = np.flatnonzero(new)
        qi, vi = flat // n, flat % n
        seen[qi, vi] = True
        s = np.empty(len(qi))
        for at in range(0, len(qi), 1 << 16):
            part = slice(at, at + (1 << 16))
            s[part] = np.einsum("ij,ij->i", q[qi[part]], x[vi[part]])
        near = s >= least
        inside[qi[near], vi[near]] = True
        return qi, vi, s

    def take(qi: np.ndarray, vi: np.ndarray, s: np.ndarray) -> None:
        """New candidates into the beams; of those of one query only as many as a beam holds can matter."""
        order = np.lexsort((-s, qi))
        qi, vi, s = qi[order], vi[order], s[order]
        counts = np.bincount(qi, minlength=nq)
        keep = np.arange(len(qi)) - (np.cumsum(counts) - counts)[qi] < BEAM
        qi, vi, s = qi[keep], vi[keep], s[keep]
        counts = np.minimum(counts, BEAM)
        wide = int(counts.max(initial=0))
        if not wide:
            return
        place = np.arange(len(qi)) - (np.cumsum(counts) - counts)[qi]
        more, ms = np.full((nq, wide), -1, np.int64), np.full((nq, wide), -3.0)
        more[qi, place], ms[qi, place] = vi, s
        rows = np.flatnonzero(counts)
        allv, alls = np.concatenate([beam[rows], more[rows]], 1), np.concatenate([sims[rows], ms[rows]], 1)
        allo = np.concatenate([open_[rows], more[rows] >= 0], 1)
        keep = np.argsort(-alls, axis=1, kind="stable")[:, :BEAM]
        beam[rows], sims[rows], open_[rows] = (np.take_along_axis(a, keep, 1) for a in (allv, alls, allo))

    every = np.arange(nq)
    take(*look(np.repeat(every, len(entry)), np.tile(entry, nq)))
    while True:
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            break
        at = open_[rows].argmax(axis=1)
        open_[rows, at] = False
        take(*look(*around(rows, beam[rows, at])))
    if own is not None:
        look(*around(every, own))
    done = np.zeros((nq, n), bool)
    while True:
        qi, vi = np.nonzero(inside & ~done)
        if not len(qi):
            break
        done[qi, vi] = True
        for at in range(0, len(qi), 1 << 14):
            part = slice(at, at + (1 << 14))
            look(*around(qi[part], vi[part]))
    return np.nonzero(inside)


# --- cells ---------------------------------------------------------------------------------------------------------


def matrix(column) -> np.ndarray:
    """Rows of one length as a matrix of doubles."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(c), -1)


def _assign(pivots: pa.Table, vectors: pa.Table) -> pa.Table:
    p, x = matrix(pivots.column("x")), matrix(vectors.column("x"))
    k = min(OVERLAP, len(p))
    near = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :k]
    names = np.array(pivots.column("node").to_pylist())[near]
    parents = vectors.column("cell").to_pylist()
    cells = [f"{c}/{i}" for c, row in zip(parents, names.tolist(), strict=True) for i in row]
    nodes = np.repeat(vectors.column("node").to_numpy(), k)
    return pa.table([pa.array(nodes), pa.array([c for c in parents for _ in range(k)], pa.string()), pa.array(cells, pa.string())], ["node", "parent", "cell"])


def cells_of(vectors: DataFrame) -> DataFrame:
    """(node, cell, parts): overlapping cells of the vectors of each class ``kind``; ``parts`` blocks hold a cell.

    A cell above ``SHARD`` is split: some of its vectors (those with the least hashes, ``PIVOTS`` at most) are pivots, and
    each vector joins the cells of its ``OVERLAP`` nearest ones. This goes on until a split no longer makes cells smaller.
    """
    at = settle(vectors.select("node", F.col("kind").alias("cell"), F.lit(None).cast("long").alias("before")))
    ready, level = None, 0
    while True:
        sizes = settle(at.groupBy("cell").agg(F.count("*").alias("size"), F.max("before").alias("before")))
        dense = (F.col("size") <= SHARD) | (F.col("size") > SHRINK * F.col("before"))
        sizes = sizes.withColumn("done", F.coalesce(dense, F.lit(False)))
        sized = at.drop("before").join(sizes, "cell")
        done = sized.where("done").select("node", "cell", F.ceil(F.col("size") / SHARD).cast("int").alias("parts"))
        ready = done if ready is None else ready.unionByName(done)
        if sizes.where("not done").isEmpty():
            return settle(ready)
        large = sized.where("not done")
        wanted = F.least(F.lit(PIVOTS), F.ceil(F.col("size") * 2 * OVERLAP / SHARD))  # cells of half a shard on average
        some = large.where(F.pmod(F.xxhash64("node", F.lit(level)), F.greatest(F.lit(1), F.expr(f"size div {8 * PIVOTS}"))) == 0)
        rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("node", F.lit(level)), "node"))
        pivots = settle(some.withColumn("rank", rank).where(F.col("rank") <= wanted).join(vectors.select("node", "x"), "node")
                        .select("cell", "node", "x", F.explode(F.sequence(F.lit(0), F.expr(f"cast(size div {SALT} as int)"))).alias("salt")))
        salted = large.join(vectors.select("node", "x"), "node").select(
            "node", "cell", "x", F.pmod(F.xxhash64("node", F.lit("salt")), F.expr(f"size div {SALT} + 1")).cast("int").alias("salt"))
        split = pivots.groupBy("cell", "salt").cogroup(salted.groupBy("cell", "salt")).applyInArrow(_assign, "node long, parent string, cell string")
        at = settle(split.join(sizes.select(F.col("cell").alias("parent"), F.col("size").alias("before")), "parent").select("node", "cell", "before"))
        level += 1


def _edges(t: pa.Table) -> pa.Table:
    nodes = t.column("node").to_numpy()
    a, b = built(matrix(t.column("x")))
    lists = np.split(nodes[b], np.cumsum(np.bincount(a, minlength=len(nodes)))[:-1])
    return pa.table([pa.array(nodes), pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))], ["node", "near"])


def _links(t: pa.Table, least: float) -> pa.Table:
    """Search of one block of a cell for the vectors of one block (its own or another): pairs that hang together what is linked."""
    role = np.array(t.column("query").to_pylist(), bool)
    nodes, x = t.column("node").to_numpy(), matrix(t.column("x"))
    own = t.column("i")[0].as_py() == t.column("j")[0].as_py()
    data, query = (np.flatnonzero(~role), np.flatnonzero(~role if own else role))
    nothing = pa.table([pa.array([], pa.int64())] * 2, ["a", "b"])
    if not len(data) or not len(query):
        return nothing
    order = np.argsort(nodes[data], kind="stable")
    data = data[order]
    names = nodes[data]
    lists = t.column("near").to_pylist()
    near = [np.array(lists[i], np.int64) for i in data.tolist()]
    a, b = np.repeat(np.arange(len(data)), [len(x) for x in near]), np.concatenate(near)
    place = np.minimum(np.searchsorted(names, b), len(names) - 1)
    here = names[place] == b  # neighbours from other cells are met there
    graph = a[here], place[here]
    if own:
        query = data
    a, b = searched(x[query], x[data], graph, least, np.arange(len(data)) if own else None)
    if not len(a):
        return nothing
    a, b = hung(nodes[query[a]], names[b])
    return pa.table([pa.array(a), pa.array(b)], ["a", "b"])


def hung(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the given pairs with the smallest node that pairs lead to."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[:len(a)], place[len(a):]
    root = np.arange(len(names))
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    other = np.flatnonzero(root != np.arange(len(root)))
    return names[other], names[root[other]]


def _counted(t: pa.Table, least: float) -> pa.Table:
    """Vectors of whole components, or of two tiles of one, as (node, near, more): how many it is linked with, different ones and with their copies."""
    x, root, side, copies = matrix(t.column("x")), t.column("root").to_numpy(), t.column("side").to_numpy(), t.column("copies").to_numpy().astype(float)
    near, more = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), 512):
        part = slice(at, at + 512)
        linked = (x[part] @ x.T >= least) & (root[part, None] == root[None]) & ((side[part, None] == 0) | (side[part, None] != side[None]))
        linked[np.arange(len(linked)), np.arange(at, at + len(linked))] = False
        near[part], more[part] = linked.sum(axis=1), np.rint(linked @ copies).astype(np.int64)
    return pa.table([t.column("node"), pa.array(near), pa.array(more)], ["node", "near", "more"])


def counted(units: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """(node, near, more): the links of every node inside its component, all pairs of which are compared in blocks.

    A component above ``SHARD`` vectors is cut into tiles, each two of which meet in a group; small ones share groups. Only counts leave a group.
    """
    roots = settle(groups.select("node", F.col("component").alias("root")))
    sizes = settle(roots.groupBy("root").agg(F.count("*").alias("size")))
    shared = max(1, roots.count() // SHARD)
    tiles = F.ceil(F.col("size") / SHARD).cast("int")
    dealt = roots.join(sizes, "root").join(units.select("node", "x", "copies"), "node").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    side = F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2)
    key = F.when(F.col("tiles") > 1, F.concat_ws(":", "root", low, high)).otherwise(F.pmod(F.xxhash64("root"), F.lit(shared)).cast("string"))
    rows = dealt.select(key.alias("key"), "root", side.cast("int").alias("side"), "node", "x", "copies")
    met = rows.groupBy("key").applyInArrow(lambda t: _counted(t, least), "node long, near long, more long")
    return met.groupBy("node").agg(F.sum("near").alias("near"), F.sum("more").alias("more"))


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall, audit_recall_vectors) of every row.

    Rows are compared only if their labels are equal and not null, by cosine in double precision; a link is a pair of
    cosine ``least`` or more. Exact copies are one vector of the graph that counts as many. Cells of about ``SHARD`` vectors
    overlap; each gets a pruned neighbour graph; the neighbour lists of a vector from all its cells are united; in each
    cell every vector is searched from the medoids, and what is in range leads on; every pair is checked by its cosine.
    A cell that cannot be split (a dense group) is searched block by block. What hangs together by the links found is then compared
    whole, in blocks, so all links inside a component are counted, also those of vectors that never shared a cell. Up to ``SAMPLE``
    vectors are compared with all rows of their label: ``audit_recall`` is the share of their links that was found, ``audit_recall_vectors`` the mean
    of each linked vector's share (1 if there are no links).

    Vectors that are null, zero, of no length, or hold null or non-finite components link with nothing and are their own component, as
    are rows with a null label; vectors of different length are not compared. A null id never names a component (null if
    no other id does) and its row is not kept. Rows that share an id are different vectors. An empty table gives none.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    fit = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = F.coalesce(F.col("label").isNotNull() & fit & F.exists("x", lambda v: v != 0), F.lit(False))
    classes = rows.where(good).groupBy("label", "x").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    table = settle(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("kind", F.concat_ws(":", F.col("label").cast("string"), F.size("x").cast("string"))))
    largest = F.array_max(F.transform("x", F.abs))
    scaled = F.transform("x", lambda v: v / largest)  # so that no square overflows
    units = settle(table.withColumn("x", scaled).withColumn("x", F.transform("x", lambda v: v / F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, w: s + w * w))))
                   .select("node", "kind", "x", "copies"))
    groups = settle(components(found_links(units, least)))
    counts = settle(counted(units, groups, least))
    known = settle(table.select("node", "label", "x", "first", "copies").join(counts, "node", "left").join(groups, "node", "left")
                   .select("label", "x", "node", "first", (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("root")))
    names = settle(known.groupBy("root").agg(F.min("first").alias("component_id")))
    named = settle(known.join(names, "root").select(F.col("label").alias("l"), F.col("x").alias("v"), "n_links", "component_id"))
    by_link, by_vector = audit(units, counts, least)
    out = rows.where(good).join(named, (F.col("label") == F.col("l")) & (F.col("x") == F.col("v"))).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
                                        F.lit(by_link).alias("audit_recall"), F.lit(by_vector).alias("audit_recall_vectors"))


def found_links(units: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs that hang together all nodes between which links were found; a task hands on fewer of them than it has nodes."""
    cells = cells_of(units)
    placed = settle(cells.withColumn("i", F.pmod(F.xxhash64("node", "cell"), "parts").cast("int")).join(units.select("node", "x"), "node"))
    graphs = placed.groupBy("cell", "i").applyInArrow(_edges, "node long, near array<long>")
    flat = settle(graphs.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    with_lists = placed.join(flat, "node").select("node", "cell", "parts", "i", "x", "near")
    data = with_lists.select("node", "cell", "x", "near", F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.lit(False).alias("query"))
    none = F.array().cast("array<long>")
    queries = with_lists.where("parts > 1").select("node", "cell", "x", none.alias("near"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), "i", F.lit(True).alias("query")).where("i <> j")
    return data.unionByName(queries).groupBy("cell", "i", "j").applyInArrow(lambda t: _links(t, least), "a long, b long")


def audit(units: DataFrame, counts: DataFrame, least: float) -> tuple[float, float]:
    """Share of the links of sampled vectors that were found, against a comparison with all rows, and the mean of the shares of the vectors that have some."""
    sample = units.orderBy(F.xxhash64("node", F.lit("audit")), "node").limit(SAMPLE).select("node", "kind", "x").collect()  # SAMPLE rows at most
    if not sample:
        return 1.0, 1.0
    by_kind: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for kind in {r["kind"] for r in sample}:
        mine = [r for r in sample if r["kind"] == kind]
        by_kind[kind] = np.array([r["node"] for r in mine]), np.array([r["x"] for r in mine])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        for b in batches:
            kinds = np.array(b.column(1).to_pylist())
            for kind, (nodes, s) in by_kind.items():
                at = np.flatnonzero(kinds == kind)
                for part in np.split(at, range(4096, len(at), 4096)):
                    if len(part):
                        take = b.take(pa.array(part))
                        near = (s @ matrix(take.column(2)).T >= least) & (nodes[:, None] != take.column(0).to_numpy()[None])
                        for node, n in zip(nodes.tolist(), near.sum(axis=1).tolist(), strict=True):
                            count[node] = count.get(node, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64())], ["node", "n"])

    there = units.select("node", "kind", "x").mapInArrow(compare, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).where("n > 0")
    share = F.coalesce("near", F.lit(0)) / F.col("n")
    got = there.join(counts, "node", "left").agg(F.sum("n").alias("n"), F.sum(F.coalesce("near", F.lit(0))).alias("near"), F.avg(share).alias("each")).first()
    return (got["near"] / got["n"], got["each"]) if got["n"] else (1.0, 1.0)
