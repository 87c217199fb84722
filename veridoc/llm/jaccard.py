"""N-gram Jaccard join with a MinHash LSH forest (operator 6).

A document's items are its distinct runs of five words (words as in `decontaminate`; a shorter document that
has words is one item). Documents of equal item sets are one class: they link to each other without being
compared, and one row stands for them. Each of TREES tries holds every class under a label of DEPTH MinHash
values, kept as bytes in order, so that a prefix of a label is a node of the trie. The join takes the longest
prefix at which a pair of the threshold's similarity meets in some trie with the target probability, verifies
all pairs that meet, estimates from the links found how many are missed (each weighed by the inverse of its
own chance), and shortens the prefix by one value and joins again until the estimated recall is the target.

No pairs are emitted. Large groups of near copies are counted by their distance to one text: each class of a node
of more than STAR members takes as its centre the least member of most of its nodes, and its Jaccard distance to
it is worked out, in steps of 1 / UNITS rounded up. That distance is a metric, so two classes of one centre whose
distances add up to no more than the threshold's are linked for certain; how many these are for each class comes
from counts of classes by centre and step, and no such pair is ever looked at.

For all other pairs, a node's members are cut in chunks of at most about MEMBERS rows and CHUNK_BYTES of text; those
within half the threshold's distance of the node's main centre, which all link to each other, have chunks of
their own, and a node that holds none but these is left out. A task verifies all pairs inside a chunk exactly on
the item sets; a chunk of a larger node is also packed into one row, which is copied to the chunks it has yet to
meet, and each pair of chunks is one more block. So every join sees each member of a node once, and only packed
chunks are copied. A pair counts in the first trie in which it meets, so in one block only. A block returns for
each row its number of links and an edge to the row that stands for what it is linked to. Nodes whose members all
met in one of the three tries before are skipped at once. Items are compared as 64-bit hashes: two different
runs of words are taken for one with a chance of about 1e-11 for a pair of texts of 10,000 words.

Defined results: null and wordless texts link with nothing; null ids are compared like others; repeated rows
are copies of each other; ties don't arise, as links are symmetric; the class id is the least id reachable;
an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, by_text_size, discard, read_table, settle
from .components import components
from .decontaminate import _CUT, _TO_WORDS

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
TREES, DEPTH = 20, 5
MEMBERS, CHUNK_BYTES = 1024, 8_000_000
STAR, UNITS = 128, 2000
BYTES_AT_ONCE = 1_000_000

_random = np.random.default_rng(20)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = _random.integers(1, 1 << 63, (2, TREES * DEPTH), dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def item_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct runs of words."""
    texts = [t or "" for t in texts]
    for run in by_text_size(texts, BYTES_AT_ONCE):
        raw = [t.encode("utf-8", "surrogatepass").translate(_TO_WORDS) for t in texts[run.start : run.stop]]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        inside = data != 32
        edge = np.diff(inside.view(np.int8), prepend=0)
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(begins):
            size = ends - begins
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max()) - 1, _BASE)]), dtype=np.uint64)
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            hashed = _mix(np.add.reduceat(_BYTE[data[inside]] * power[place], np.cumsum(size) - size) + size.astype(np.uint64))
        else:
            hashed = np.empty(0, np.uint64)
        stops = np.searchsorted(begins, np.cumsum([len(r) + 1 for r in raw])).tolist()
        runs = np.zeros(max(0, len(hashed) - words + 1), np.uint64)
        for j in range(words):
            runs += hashed[j : j + len(runs)] * _FACTORS[1, j]
        runs = _mix(runs)
        at = 0
        for stop in stops:
            if stop - at >= words:
                yield np.unique(runs[at : stop - words + 1])
            elif stop > at:
                yield _mix(np.array([(hashed[at:stop] * _FACTORS[1, : stop - at]).sum(dtype=np.uint64) + np.uint64(stop - at)]))
            else:
                yield np.empty(0, np.uint64)
            at = stop


def labels_of(items: np.ndarray) -> bytes:
    """The labels in all tries, DEPTH values of 4 bytes each."""
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(items), 2048):
        part = (items[at : at + 2048, None] * _FACTORS[0] + _FACTORS[1]) >> np.uint64(32)
        least = np.minimum(least, part.min(axis=0).astype(np.uint32))
    return least.astype(">u4").tobytes()


def chance(similarity, depth: int, trees: int = TREES):
    """That a pair shares a prefix of `depth` values in some trie; at depth 0 all are in one node."""
    return 1.0 - (1.0 - similarity**depth) ** trees


def first_depth(similarity: float, recall: float) -> int:
    return next((d for d in range(DEPTH, 0, -1) if chance(similarity, d) >= recall), 0)


def build_forest(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, id, text_hash, text_size, set, labels): set and labels are null without words. Settled."""
    hashed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.md5(text).alias("text_hash"), F.octet_length(text).alias("text_size"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, labels = [], []
            for items in item_sets(batch.column("text").to_pylist()):
                sets.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                labels.append(labels_of(items) if len(items) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary()), pa.array(labels, pa.binary())], ["row", "id", "text_hash", "text_size", "set", "labels"])

    return settle(hashed.mapInArrow(run, f"row long, id {kind}, text_hash string, text_size int, set binary, labels binary"), "forest")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, over rows sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(block: pa.Table, limit: int, cut: int = 0) -> np.ndarray:
    """Pairs of a block that meet in no trie before and aren't linked for certain: of all rows, or of the first
    `cut` with the others."""
    keys = np.frombuffer(b"".join(block["keys"].to_pylist()), ">i8").reshape(block.num_rows, -1)
    open_ = np.triu(np.ones((len(keys), len(keys)), bool), 1)
    if cut:
        open_[:cut, :cut] = open_[cut:, cut:] = False
    for t in range(block["tree"][0].as_py()):
        open_ &= keys[:, None, t] != keys[None, :, t]
    centre, steps = block["centre"].to_numpy(), block["steps"].to_numpy()
    if (steps <= limit).any():
        open_ &= (centre[:, None] != centre[None, :]) | (steps[:, None] + steps[None, :] > limit)
    return open_


def _overlaps(sets: list[np.ndarray], wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, others j > i that are wanted, sizes of the intersections)."""
    if len(sets) <= 4:
        for i, j in zip(*np.nonzero(wanted)):
            yield int(i), np.array([j]), np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True))])
        return
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    mark = np.zeros(len(values), np.int32)
    for i in range(len(sets)):
        others = np.flatnonzero(wanted[i])
        if len(others):
            own = place[start[i] : start[i] + size[i]]
            mark[own] = 1
            if len(others) * 3 < len(sets):
                common = np.array([mark[place[start[j] : start[j] + size[j]]].sum() for j in others])
            else:
                common = np.add.reduceat(mark[place], start)[others]
            mark[own] = 0
            yield i, others, common


def _need(limit: int):
    """Rows of chunks that hold an open pair; chunks that have others to meet are left whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _groups(batches, ["key", "own"]):
            if chunk["chunks"][0].as_py() == 1:
                open_ = _open_pairs(chunk, limit)
                chunk = chunk.filter(pa.array(open_.any(axis=0) | open_.any(axis=1)))
            if chunk.num_rows:
                yield from chunk.combine_chunks().to_batches()

    return run


def _distances(limit: int):
    """(row, copies, centre, steps) of the rows that are linked to their centre, which comes first in its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["centre", "salt"]):
            sets = [np.frombuffer(x, np.uint64) for x in group["items"].to_pylist()]
            head, size = sets[0], np.array([len(s) for s in sets])
            every = np.concatenate(sets)
            at = np.minimum(np.searchsorted(head, every), len(head) - 1)
            common = np.add.reduceat((head[at] == every).astype(np.int64), np.cumsum(size) - size)
            union = size + len(head) - common
            steps = -((common - union) * UNITS // union)  # rounded up
            near = steps <= limit
            near[0] = False  # the centre's own row comes among the others, if this is its centre too
            yield pa.RecordBatch.from_arrays([pa.array(group["row"].to_numpy()[near]), pa.array(group["copies"].to_numpy()[near]), pa.array(group["centre"].to_numpy()[near]), pa.array(steps[near], pa.int32())], ["row", "copies", "centre", "steps"])

    return run


class _Links:
    """Links found in blocks, handed out in batches."""

    schema = pa.schema([("row", pa.int64()), ("links", pa.int64()), ("other", pa.int64()), ("found", pa.int64()), ("expected", pa.float64()), ("key", pa.int64()), ("tree", pa.int32()), ("own", pa.int32()), ("cores", pa.int32()), ("chunks", pa.int32()), ("packed", pa.binary())])
    shape = "row long, links long, other long, found long, expected double, key long, tree int, own int, cores int, chunks int, packed binary"

    def __init__(self, similarity: float, depth: int):
        self.similarity, self.depth = similarity, depth
        self.out: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.out) if self.out else [[]] * 5
        arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema)]
        self.out = []
        return pa.RecordBatch.from_arrays(arrays + [pa.nulls(len(arrays[0]), f.type) for f in list(self.schema)[5:]], schema=self.schema)

    def add(self, block: pa.Table, met: np.ndarray) -> None:
        """Verify the pairs of a block that are in met."""
        rows, copies = block["row"].to_numpy(), block["copies"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in block["items"].to_pylist()]
        size = np.array([len(s) for s in sets])
        least = np.minimum(size[:, None], size[None, :]) / np.maximum(size[:, None], size[None, :]) >= self.similarity
        links, root = np.zeros(len(rows), np.int64), list(range(len(rows)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found, expected = 0, 0.0
        for i, others, common in _overlaps(sets, met & least):
            union = size[i] + size[others] - common
            hit = common / union >= self.similarity
            if not hit.any():
                continue
            near = others[hit]
            links[i] += copies[near].sum()
            links[near] += copies[i]
            found += len(near)
            expected += float((1.0 / chance(common[hit] / union[hit], self.depth)).sum())
            for j in near.tolist():
                a, b = top(i), top(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
        for x in np.flatnonzero(links).tolist():
            self.out.append((rows[x], links[x], rows[t] if (t := top(x)) != x else None, found, expected))
            found, expected = 0, 0.0


def _inside(similarity: float, depth: int, limit: int):
    """The links inside of chunks, and each chunk that has others to meet as one packed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links(similarity, depth)
        for chunk in _groups(batches, ["key", "own"]):
            links.add(chunk, _open_pairs(chunk, limit))
            if chunk["chunks"][0].as_py() > 1:
                packed = pa.BufferOutputStream()
                with pa.ipc.new_stream(packed, (bare := chunk.select(["row", "copies", "tree", "keys", "centre", "steps", "items"])).schema) as file:
                    file.write_table(bare)
                alone = [None, None, None, None, None, *(chunk[c][0].as_py() for c in ("key", "tree", "own", "cores", "chunks")), packed.getvalue().to_pybytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(alone, _Links.schema)], schema=_Links.schema)
            if len(links.out) > 20_000:
                yield links.batch()
        yield links.batch()

    return run


def _across(similarity: float, depth: int, limit: int):
    """The links between the two chunks of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links(similarity, depth)
        for block in _groups(batches, ["key", "i", "j"]):
            if block.num_rows < 2:  # chunks are dealt by hash, so one may have no members
                continue
            first, second = (pa.ipc.open_stream(x).read_all() for x in block["packed"].to_pylist())
            both = pa.concat_tables([first, second])
            links.add(both, _open_pairs(both, limit, first.num_rows))
            if len(links.out) > 20_000:
                yield links.batch()
        yield links.batch()

    return run


def _stars(joined: DataFrame, sets: DataFrame, limit: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """(row, copies, centre, steps) of the members of large nodes that are linked to their centre, settled, and
    (row, links, other): the links that are certain by that."""
    voted = joined.where(F.col("n") > STAR).groupBy("row", "text_size").agg(F.mode("least", True).alias("centre"))
    salts = voted.groupBy("centre").agg(F.greatest(F.ceil(F.count(F.lit(1)) / MEMBERS), F.ceil(F.sum(F.col("text_size").cast("long")) / CHUNK_BYTES)).cast("int").alias("salts"))
    asked = voted.join(apart(salts, "centre"), "centre").select("centre", F.pmod(F.xxhash64("row"), F.greatest("salts", F.lit(1))).cast("int").alias("salt"), F.lit(1).alias("place"), "row")
    heads = salts.select("centre", F.explode(F.sequence(F.lit(0), F.greatest("salts", F.lit(1)) - 1)).alias("salt"), F.lit(0).alias("place"), F.col("centre").alias("row"))
    both = asked.unionByName(heads).join(sets, "row").repartition(parts, "centre", "salt").sortWithinPartitions("centre", "salt", "place")
    near = settle(both.select("centre", "salt", "row", "copies", "items").mapInArrow(_distances(limit), "row long, copies long, centre long, steps int"), "stars")
    # A row for each step at most, so `limit` and one for a centre.
    steps = near.groupBy("centre", "steps").agg(F.sum("copies").alias("copies")).groupBy("centre").agg(F.collect_list(F.struct("steps", "copies")).alias("all"))
    reach = steps.select("centre", "all", F.explode("all.steps").alias("steps"))
    reach = reach.select("centre", "steps", F.aggregate(F.filter("all", lambda x: x["steps"] + F.col("steps") <= limit), F.lit(0).cast("long"), lambda a, x: a + x["copies"]).alias("links"))
    own = F.when(F.col("steps") * 2 <= limit, F.col("copies")).otherwise(0)
    certain = near.join(apart(reach, "centre"), ["centre", "steps"]).select("row", (F.col("links") - own).alias("links"), F.when(F.col("row") != F.col("centre"), F.col("centre")).alias("other"))
    return near, certain


def _join_at(forest: DataFrame, classes: DataFrame, docs: DataFrame, text: str, similarity: float, depth: int) -> list[DataFrame]:
    """(row, links, other, found, expected) of all blocks at one prefix length, in settled tables."""
    trees, limit = TREES if depth else 1, int((1 - similarity) * UNITS)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A node is known if its members all share a node of one of the three tries before.
    keys = F.array(*(F.xxhash64(F.lit(t), F.substring("labels", 4 * DEPTH * t + 1, 4 * depth)) for t in range(trees)))
    keyed = classes.select("row", "text_size", keys.alias("keys"))
    met = keyed.select("row", "text_size", F.posexplode("keys").alias("tree", "key"), "keys").select("row", "text_size", "tree", "key", *(F.when(F.col("tree") >= b, F.get("keys", F.col("tree") - b)).alias(f"b{b}") for b in (1, 2, 3)))
    alike = lambda b: F.coalesce((F.min(f"b{b}") == F.max(f"b{b}")), F.lit(False))
    nodes = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("text_size").cast("long")).alias("bytes"), F.min("row").alias("least"), (alike(1) | alike(2) | alike(3)).alias("known")).where("n > 1")
    joined = settle(met.select("row", "text_size", "tree", "key").join(apart(nodes, "key"), "key"), "nodes")

    texts = docs.select(F.md5(text).alias("text_hash"), F.octet_length(text).alias("text_size"), F.col(text).alias("text")).groupBy("text_hash", "text_size").agg(F.first("text").alias("text"))
    wanted = joined.select("row").distinct().join(classes.select("row", "copies", "text_hash", "text_size"), "row")

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [x.tobytes() for x in item_sets(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("copies"), pa.array(packed, pa.binary())], ["row", "copies", "items"])

    sets = settle(texts.join(wanted, ["text_hash", "text_size"]).select("row", "copies", "text").mapInArrow(items, "row long, copies long, items binary"), "items")
    near, certain = _stars(joined, sets, limit, parts)

    members = joined.where("NOT known").join(near.select("row", "centre", "steps"), "row", "left").select("row", "text_size", "tree", "key", "n", "bytes", F.coalesce("centre", F.lit(-1)).alias("centre"), F.coalesce("steps", F.lit(UNITS + 1)).alias("steps"))
    large = f"n > {MEMBERS} OR bytes > {CHUNK_BYTES}"
    count = lambda n, size: F.greatest(F.ceil(n / MEMBERS), F.least(F.ceil(size / CHUNK_BYTES), n)).cast("int")
    core = F.col("steps") * 2 <= limit
    cores = members.where(large).where(core).groupBy("key", "centre").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("text_size").cast("long")).alias("bytes"))
    cores = cores.groupBy("key").agg(F.max_by(F.struct("centre", "n", "bytes"), F.struct("n", "centre")).alias("core"))
    dealt = members.join(apart(cores, "key"), "key", "left")
    inner, rest = F.coalesce("core.n", F.lit(0)), F.col("n") - F.coalesce("core.n", F.lit(0))
    dealt = dealt.where(rest > 0).withColumns({"cores": F.when(inner > 0, count(inner, F.col("core.bytes"))).otherwise(0), "rims": count(rest, F.col("bytes") - F.coalesce("core.bytes", F.lit(0)))})
    hashed = lambda parts: F.pmod(F.xxhash64("row"), parts).cast("int")
    own = F.when(core & F.coalesce(F.col("centre") == F.col("core.centre"), F.lit(False)), hashed(F.col("cores"))).otherwise(F.col("cores") + hashed(F.col("rims")))
    dealt = dealt.select("row", "tree", "key", own.alias("own"), "cores", (F.col("cores") + F.col("rims")).alias("chunks"), "centre", "steps")
    packed = keyed.select("row", F.concat(*(F.unhex(F.lpad(F.hex(F.get("keys", F.lit(t))), 16, "0")) for t in range(trees))).alias("keys"))
    in_chunks = lambda df: df.repartition(parts, "key", "own").sortWithinPartitions("key", "own")
    shape = "row long, tree int, key long, own int, cores int, chunks int, centre long, steps int, keys binary"
    needed = settle(in_chunks(dealt.join(packed, "row").select(*(c.split()[0] for c in shape.split(", ")))).mapInArrow(_need(limit), shape), "members")

    inside = settle(in_chunks(needed.join(sets, "row")).mapInArrow(_inside(similarity, depth, limit), _Links.shape), "links")
    chunks = inside.where("packed IS NOT NULL").select("key", "own", "cores", "packed", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).where("own != other AND greatest(own, other) >= cores")
    blocks = chunks.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "packed")
    whole = blocks.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "own")
    across = settle(whole.mapInArrow(_across(similarity, depth, limit), _Links.shape), "links")
    known = settle(certain, "certain")
    for table in (needed, joined, sets, near):
        discard(table)
    return [inside, across, known]


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, n_links, class_id, root, text_hash, text_size, recall): one row per document. n_links counts the documents linked
    to it directly, class_id is the least id it reaches by links, root the row that stands for that class, and recall the estimate
    for the whole join, which is the target at least: where no prefix reaches it, all classes are compared."""
    forest = build_forest(docs, key, text)
    sets = forest.where("set IS NOT NULL").groupBy("set").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id"))
    sets = settle(sets, "sets")
    classes = settle(forest.select("row", "text_hash", "text_size", "labels").join(sets.select(F.col("rep").alias("row"), "copies"), "row"), "classes")
    depth = first_depth(similarity, recall)
    while True:
        tables = _join_at(forest, classes, docs, text, similarity, depth)
        links = tables[0].where("row IS NOT NULL").unionByName(tables[1]).select("row", "links", "other", "found", "expected")
        links = links.unionByName(tables[2].select("*", F.lit(0).cast("long").alias("found"), F.lit(0.0).alias("expected")))
        found, expected = links.agg(F.sum("found"), F.sum("expected")).first()
        reached = found / expected if found else 1.0
        if reached >= recall or not depth:
            break
        for table in tables:
            discard(table)
        depth -= 1
    discard(classes)
    counts = links.groupBy("row").agg(F.sum("links").alias("links"))
    roots = components(links.where("other IS NOT NULL").select(F.col("row").alias("a"), F.col("other").alias("b")))
    placed = sets.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(counts.withColumnRenamed("row", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("class_id"))
    placed = placed.join(apart(least, "root"), "root").select("set", "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "class_id", "root")
    out = forest.select("row", "id", "set", "text_hash", "text_size").join(placed, "set", "left")
    return out.select("row", "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("root", "row").alias("root"), "text_hash", "text_size", F.lit(reached).alias("recall"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that link to one that stays: of each class the row that stands for it.
    Documents without words all stay. All columns stay."""
    found = jaccard_join(docs, similarity, key=key, text=text)
    stay = settle(found.where("row = root").groupBy("id", "text_hash", "text_size").agg(F.count(F.lit(1)).alias("kept")), "stay")
    same = (docs[key].eqNullSafe(stay["id"])) & (F.md5(docs[text]).eqNullSafe(stay["text_hash"])) & (F.octet_length(docs[text]).eqNullSafe(stay["text_size"]))
    # Rows alike in id and text are one class unless they have no words; where any repeat, one of them stays.
    rows = found.join(stay, (found["id"].eqNullSafe(stay["id"])) & (found["text_hash"].eqNullSafe(stay["text_hash"])) & (found["text_size"].eqNullSafe(stay["text_size"])), "left_semi").count()
    kept = docs.join(stay, same, "left_semi")
    if rows == stay.agg(F.coalesce(F.sum("kept"), F.lit(0))).first()[0]:
        return kept
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    spare = kept.withColumns({"__hash": F.md5(text), "__size": F.octet_length(text)})
    blank = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]", "")) == 0
    # Of rows that differ in other columns the one of the least hash stays, whatever order they are read in.
    chosen = spare.where(~blank).groupBy(key, "__hash", "__size").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("__chosen"))
    return spare.where(blank).drop("__hash", "__size").unionByName(chosen.select("__chosen.*"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


# By brute force: all pairs that share an item, and closure of the links.
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_CUT} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS} - 1], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b WHERE c >= {SIMILARITY} * (m.n + k.n - c)),
reach(v, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.v, l.b FROM reach JOIN l ON l.a = reach.r),
least AS (SELECT v, min(r) AS class_id FROM reach GROUP BY v)
SELECT v AS doc_id, class_id, (SELECT count(*) FROM l WHERE a = v) AS n_links FROM least
"""
