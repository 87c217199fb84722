"""Embedding near-dedup on a robust-pruned flat graph (operator 5).

Equal vectors are one class and stand in the graph once. Spherical k-means on a bounded sample gives centroids;
each class joins the shards of its OVERLAP nearest ones. In every shard a graph is built: candidates are the
nearest members and a few at random, robust-pruned (a candidate goes if a chosen one is closer to it, by ALPHA,
than the node is), then pruned again together with the edges that point back. The adjacency lists a class has
in its shards are united. Every member of a shard is then searched for from the shard's medoid and from its own
node: greedy search with a beam, then expansion through the neighbours of all nodes within the radius. Cosines
of what the search meets are verified in double precision; a pair counts in the least shard that both share.

A shard of more than SHARD members is cut in chunks with graphs of their own. A chunk is searched in its task, and
packed into one row, which is copied to the chunks it has yet to meet; each pair of chunks is then one more task. So
memory is bounded for any density, and no join or shuffle sees a vector more often than its shards. Tasks return
counts and edges that span the links, never pairs. Vectors of each length are joined apart, a pass for each length.

The result is audited: for AUDIT classes the share of their true links, by brute force against all, that were found,
every class counting alike. Below the target recall the join is done again with more overlap and a wider beam,
ATTEMPTS times at most, and then exactly, over all pairs of chunks. The recall comes out as a column.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing, as do vectors of
different lengths with each other; null ids are compared like others; repeated rows are copies; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, discard, read_table, settle
from .components import components
from .jaccard import _groups

RADIUS, SLACK = 0.9, 0.03
SHARD, CENTROIDS, SAMPLE = 2048, 4096, 20_000
OVERLAP, DEGREE, POOL, RANDOM, ALPHA, BEAM = 3, 24, 48, 24, 1.2, 16
AUDIT, TARGET, ATTEMPTS = 1024, 0.98, 3
QUERIES_AT_ONCE = 512


def unit_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in doubles at length 1; None where it can't be compared."""
    out: list[np.ndarray | None] = []
    for x in column:
        if not x.is_valid or x.values.null_count:
            out.append(None)
            continue
        v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(v).max() if len(v) else 0.0
        out.append((w := v / top) / np.sqrt((w * w).sum()) if top > 0 and np.isfinite(top) else None)
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; x is one bounded sample."""
    random = np.random.default_rng(5)
    k = min(k, len(x))
    centres = x[random.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 2048] @ centres.T).argmax(axis=1) for a in range(0, len(x), 2048)])
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        length = np.sqrt((total * total).sum(axis=1))
        empty = length < 1e-12
        centres = total / np.where(empty, 1.0, length)[:, None]
        centres[empty] = x[random.choice(len(x), int(empty.sum()))]
    return centres


def robust_prune(near: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For every node the chosen of its pool (-1: none), all nodes at once. near: cosines between all members."""
    n = len(near)
    each = np.arange(n)[:, None]
    own = np.where(pool < 0, -2.0, near[each, pool])
    own[pool == each] = -2.0
    order = np.argsort(-own, axis=1, kind="stable")
    pool, own = np.take_along_axis(pool, order, 1), np.take_along_axis(own, order, 1)
    alive = own > -1.5
    alive[:, 1:] &= pool[:, 1:] != pool[:, :-1]
    chosen = np.full((n, degree), -1, np.int64)
    for r in range(degree):
        first = alive.argmax(axis=1)
        some = alive[np.arange(n), first]
        if not some.any():
            break
        best = pool[np.arange(n), first]
        chosen[some, r] = best[some]
        covered = alpha * alpha * (1 - near[best[:, None], pool]) <= 1 - own
        alive &= ~(covered & some[:, None])
        alive[np.arange(n), first] = False
    return chosen


def build_graph(x: np.ndarray) -> np.ndarray:
    """Adjacency (-1: none) of the members of one shard."""
    n = len(x)
    if n == 1:
        return np.full((1, 1), -1)
    near = (x @ x.T).astype(np.float32)
    np.fill_diagonal(near, -2.0)
    width = min(POOL, n - 1)
    pool = np.argpartition(-near, width - 1, axis=1)[:, :width]
    random = np.random.default_rng(n)
    out = robust_prune(near, np.concatenate([pool, random.integers(0, n, (n, min(RANDOM, n)))], axis=1))
    # Edges back: for each node those that chose it, nearest first, as many as a node may choose.
    a, slot = np.nonzero(out >= 0)
    b = out[a, slot]
    order = np.lexsort((-near[a, b], b))
    a, b = a[order], b[order]
    rank = np.arange(len(b)) - np.searchsorted(b, b)
    back = np.full((n, DEGREE), -1)
    keep = rank < DEGREE
    back[b[keep], rank[keep]] = a[keep]
    return robust_prune(near, np.concatenate([out, back], axis=1))


def search(queries: np.ndarray, own: np.ndarray, base: np.ndarray, graph: np.ndarray, medoid: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all pairs met that are within the radius. own: a query's node in base, or -1."""
    seen = np.zeros((len(queries), len(base)), bool)
    every = np.arange(len(queries))
    kept_q, kept_node, kept_sim = [], [], []

    def visit(q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fresh = ~seen[q, node]
        flat = np.unique(q[fresh] * len(base) + node[fresh])
        q, node = flat // len(base), flat % len(base)
        seen[q, node] = True
        sim = np.einsum("ij,ij->i", queries[q], base[node])
        kept_q.append(q)
        kept_node.append(node)
        kept_sim.append(sim)
        return q, node, sim

    ids, sims, done = np.full((len(queries), beam), -1), np.full((len(queries), beam), -3.0), np.ones((len(queries), beam), bool)

    def merge(q: np.ndarray, node: np.ndarray, sim: np.ndarray) -> None:
        if not len(q):
            return
        order = np.lexsort((-sim, q))
        q, node, sim = q[order], node[order], sim[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < beam
        q, node, sim, rank = q[keep], node[keep], sim[keep], rank[keep]
        rows, at = np.unique(q, return_inverse=True)
        width = int(rank.max()) + 1
        new_ids, new_sims = np.full((len(rows), width), -1), np.full((len(rows), width), -3.0)
        new_ids[at, rank], new_sims[at, rank] = node, sim
        all_sims = np.concatenate([sims[rows], new_sims], axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        sims[rows] = np.take_along_axis(all_sims, best, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], new_ids], axis=1), best, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], new_ids < 0], axis=1), best, 1)

    def neighbours(q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = graph[node]
        row, slot = np.nonzero(near >= 0)
        return q[row], near[row, slot]

    inside = own >= 0
    merge(*visit(np.concatenate([every, every[inside]]), np.concatenate([np.full(len(queries), medoid), own[inside]])))
    while not done.all():
        rows = np.flatnonzero(~done.all(axis=1))
        slot = (~done[rows]).argmax(axis=1)
        done[rows, slot] = True
        merge(*visit(*neighbours(rows, ids[rows, slot])))
    # Range expansion, from all that lies within the radius and a little beyond.
    q, node, sim = (np.concatenate(c) for c in (kept_q, kept_node, kept_sim))
    wide = sim >= RADIUS - SLACK
    q, node = q[wide], node[wide]
    while len(q):
        parts = [visit(*neighbours(q[a : a + 100_000], node[a : a + 100_000])) for a in range(0, len(q), 100_000)]
        q, node, sim = (np.concatenate(c) for c in zip(*parts))
        wide = sim >= RADIUS - SLACK
        q, node = q[wide], node[wide]
    q, node, sim = (np.concatenate(c) for c in (kept_q, kept_node, kept_sim))
    hit = (sim >= RADIUS) & (node != own[q])
    return q[hit], node[hit]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in _groups(batches, ["shard", "chunk"]):
        x, rows = _matrix(shard["unit"]), shard["row"].to_numpy()
        graph = build_graph(x)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array([rows[g[g >= 0]] for g in graph], pa.list_(pa.int64()))], ["row", "near"])


def _spans(rows: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list, list, list]:
    """Rows of (row, links, other): counts over pairs (a, b) of places, and edges that span them."""
    links = np.zeros(len(rows), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    root = np.arange(len(rows))
    while True:  # hooks each pair's larger root below the smaller, then shortens
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != root[root]).any():
            root = root[root]
    at = np.flatnonzero(links)
    return rows[at].tolist(), links[at].tolist(), [rows[root[i]] if root[i] != i else None for i in at.tolist()]


class _Chunk:
    """A chunk of a shard, with the united lists between its own members as its graph."""

    COLUMNS = ["row", "copies", "unit", "shards", "near"]

    def __init__(self, part: pa.Table):
        self.rows, self.copies, self.x = part["row"].to_numpy(), part["copies"].to_numpy(), _matrix(part["unit"])
        self.shards = np.array(part["shards"].to_pylist())
        near = part["near"].to_pylist()
        order = np.argsort(self.rows)
        ordered = self.rows[order]
        self.graph = np.full((len(near), max(1, *(len(g) for g in near), 1)), -1)
        for i, g in enumerate(near):
            g = np.array(g, np.int64)
            at = np.minimum(np.searchsorted(ordered, g), len(ordered) - 1)
            g = order[at[ordered[at] == g]]
            self.graph[i, : len(g)] = g
        self.medoid = int((self.x @ self.x.mean(axis=0)).argmax())

    def met_by(self, other: _Chunk, shard: int, beam: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places (of other, of self) of the pairs within the radius of which this is the least shard that both share.
        Without a beam all are compared."""
        first, second = [], []
        for a in range(0, len(other.x), QUERIES_AT_ONCE):
            asked = other.x[a : a + QUERIES_AT_ONCE]
            own = np.arange(a, a + len(asked)) if other is self else np.full(len(asked), -1)
            if beam is None:
                q, node = np.nonzero(asked @ self.x.T >= RADIUS)
                q, node = q[node != own[q]], node[node != own[q]]
            else:
                q, node = search(asked, own, self.x, self.graph, self.medoid, beam)
            q = q + a
            mine, its = other.shards[q], self.shards[node]
            common = np.where((mine[:, :, None] == its[:, None, :]).any(axis=2), mine, np.iinfo(np.int32).max).min(axis=1, initial=np.iinfo(np.int32).max)
            first.append(q[common == shard])
            second.append(node[common == shard])
        return np.concatenate(first), np.concatenate(second)


_LINKS = pa.schema([("row", pa.int64()), ("links", pa.int64()), ("other", pa.int64()), ("shard", pa.int32()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("packed", pa.binary())])
_LINKS_SHAPE = "row long, links long, other long, shard int, chunk int, chunks int, packed binary"


def _batch(*columns: list) -> pa.RecordBatch:
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _LINKS)]
    return pa.RecordBatch.from_arrays(arrays + [pa.nulls(len(arrays[0]), f.type) for f in list(_LINKS)[len(arrays) :]], schema=_LINKS)


def _inside(beam: int | None):
    """The links inside of chunks, and each chunk that has others to meet as one packed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, ["shard", "chunk"]):
            shard, chunks = part["shard"][0].as_py(), part["chunks"][0].as_py()
            chunk = _Chunk(part)
            q, node = chunk.met_by(chunk, shard, beam)
            pair = np.unique(np.minimum(q, node) * len(chunk.rows) + np.maximum(q, node))
            yield _batch(*_spans(chunk.rows, chunk.copies, pair // len(chunk.rows), pair % len(chunk.rows)))
            if chunks > 1:
                packed = pa.BufferOutputStream()
                with pa.ipc.new_stream(packed, (bare := part.select(_Chunk.COLUMNS)).schema) as file:
                    file.write_table(bare)
                yield _batch([None], [None], [None], [shard], [part["chunk"][0].as_py()], [chunks], [packed.getvalue().to_pybytes()])

    return run


def _across(beam: int | None):
    """The links between the two chunks of each block: those of the second are searched for in the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _groups(batches, ["shard", "i", "j"]):
            if block.num_rows < 2:  # chunks are dealt by hash, so one may have no members
                continue
            first, second = (_Chunk(pa.ipc.open_stream(x).read_all()) for x in block["packed"].to_pylist())
            q, node = first.met_by(second, block["shard"][0].as_py(), beam)
            yield _batch(*_spans(np.concatenate([second.rows, first.rows]), np.concatenate([second.copies, first.copies]), q, node + len(second.rows)))

    return run


def _verified(members: DataFrame, beam: int | None) -> list[DataFrame]:
    """Settled tables of (row, links, other) from members (shard, chunk, chunks, row, copies, unit, shards, near)."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = settle(members.repartition(parts, "shard", "chunk").sortWithinPartitions("shard", "chunk", "row").mapInArrow(_inside(beam), _LINKS_SHAPE), "links")
    chunks = inside.where("packed IS NOT NULL").select("shard", "chunk", "packed", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).where("chunk != other")
    blocks = chunks.select("shard", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "packed")
    across = settle(blocks.repartition(parts, "shard", "i", "j").sortWithinPartitions("shard", "i", "j", "chunk").mapInArrow(_across(beam), _LINKS_SHAPE), "links")
    return [inside, across]


def _found(tables: list[DataFrame]) -> DataFrame:
    return tables[0].where("row IS NOT NULL").unionByName(tables[1]).select("row", "links", "other")


def _links(classes: DataFrame, centres: np.ndarray, overlap: int, beam: int) -> list[DataFrame]:
    """(row, links, other) from all shards, in settled tables."""
    overlap = min(overlap, len(centres))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _matrix(batch.column("unit")) @ centres.T
                shards = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :overlap].astype(np.int32), axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(shards), pa.list_(pa.int32()))], [*batch.schema.names, "shards"])

    placed = settle(classes.select("row", "copies", "unit").mapInArrow(assign, "row long, copies long, unit binary, shards array<int>"), "shards")
    members = placed.select("row", "copies", "unit", "shards", F.explode("shards").alias("shard"))
    # A row for each centroid, so bounded by CENTROIDS.
    chunks = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("chunks"))
    members = members.join(F.broadcast(chunks), "shard").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
    built = members.select("shard", "chunk", "row", "unit").repartition(parts, "shard", "chunk").sortWithinPartitions("shard", "chunk", "row").mapInArrow(_build, "row long, near array<long>")
    united = built.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # OVERLAP lists of DEGREE
    links = _verified(members.join(united, "row"), beam)
    discard(placed)
    return links


def _exact(classes: DataFrame, n: int) -> list[DataFrame]:
    """As `_links`, of all pairs of chunks by brute force."""
    chunks = F.lit(-(-n // SHARD))
    members = classes.select("row", "copies", "unit", F.array(F.lit(0)).alias("shards"), F.lit(0).alias("shard"), chunks.alias("chunks"), F.pmod(F.xxhash64("row"), chunks).cast("int").alias("chunk"))
    return _verified(members.withColumn("near", F.array().cast("array<bigint>")), None)


def _audit(classes: DataFrame, counts: DataFrame) -> float:
    """Found share of the true links of a sample of classes, each counting alike."""
    sample = classes.orderBy(F.xxhash64("row"), "row").limit(AUDIT).select("row", "unit").collect()
    asked = np.array([np.frombuffer(r.unit, np.float64) for r in sample])
    rows = np.array([r.row for r in sample])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hit = asked @ _matrix(batch.column("unit")).T >= RADIUS
                hit &= rows[:, None] != batch.column("row").to_numpy()[None, :]
                total = hit @ batch.column("copies").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(total.astype(np.int64))], ["row", "truth"])

    truth = classes.select("row", "unit", "copies").mapInArrow(count, "row long, truth long").groupBy("row").agg(F.sum("truth").alias("truth"))
    share = truth.where("truth > 0").join(counts, "row", "left").agg(F.avg(F.coalesce("links", F.lit(0)) / F.col("truth"))).first()[0]
    return 1.0 if share is None else float(share)


def _join_length(classes: DataFrame, n: int) -> tuple[DataFrame, float]:
    """(row, links, other) of the n classes of one length, and the audited recall."""
    sample = classes.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("unit").collect()
    x = np.array([np.frombuffer(r.unit, np.float64) for r in sample])
    overlap, beam = OVERLAP, BEAM
    for _ in range(ATTEMPTS):
        centres = k_means(x, min(CENTROIDS, -(-n * overlap * 2 // SHARD)))
        tables = _links(classes, centres, overlap, beam)
        links = _found(tables)
        if (recall := _audit(classes, links.groupBy("row").agg(F.sum("links").alias("links")))) >= TARGET:
            return links, recall
        for table in tables:
            discard(table)
        overlap, beam = overlap + 2, beam * 2
    return _found(_exact(classes, n)), 1.0


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(row, id, n_links, component_id, root, recall): one row for each vector."""
    kind = vectors.schema[key].dataType.simpleString()

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = [None if v is None else v.tobytes() for v in unit_vectors(batch.column("embedding"))]
            same = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in unit]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(unit, pa.binary()), pa.array(same, pa.binary())], ["row", "id", "unit", "same"])

    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(embedding).alias("embedding"))
    every = settle(numbered.mapInArrow(prepare, f"row long, id {kind}, unit binary, same binary"), "vectors")
    groups = settle(every.where("same IS NOT NULL").groupBy("same").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id")), "same")
    classes = settle(every.select("row", "unit").join(groups.select(F.col("rep").alias("row"), "copies"), "row"), "classes")
    links, recall = None, 1.0
    # A row for each length that vectors have.
    for r in classes.groupBy(F.octet_length("unit").alias("size")).count().orderBy("size").collect():
        more, share = _join_length(classes.where(F.octet_length("unit") == r["size"]), r["count"])
        links, recall = more if links is None else links.unionByName(more), min(recall, share)
    discard(classes)
    if links is None:
        return every.select("row", "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("row").alias("root"), F.lit(recall).alias("recall"))
    counts = links.groupBy("row").agg(F.sum("links").alias("links"))
    roots = components(links.where("other IS NOT NULL").select(F.col("row").alias("a"), F.col("other").alias("b")))
    placed = groups.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(counts.withColumnRenamed("row", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    placed = placed.join(apart(least, "root"), "root").select("same", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", "root")
    out = every.select("row", "id", "same").join(placed, "same", "left")
    return out.select("row", "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("root", "row").alias("root"), F.lit(recall).alias("recall"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_vectors(read_table(spark, sf_dir, "embeddings"))
    return near.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


# By brute force over all pairs.
SQL = f"""
WITH RECURSIVE x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
good AS (SELECT vec_id, e FROM x WHERE len(list_filter(e, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {RADIUS}),
reach(v, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.v, l.b FROM reach JOIN l ON l.a = reach.r),
least AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT v AS vec_id, (SELECT count(*) FROM l WHERE a = v) AS n_links, component_id, v = component_id AS kept FROM least
"""
