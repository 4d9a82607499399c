"""MinHash near-dedup with an LSH forest.

Two texts are linked if `percent` of the union of their shingle sets is common to both: PERCENT in op3, STAGE_PERCENT in the
pipeline. Texts with the same set of shingles are one node. Each node has a signature of DEPTH minima in each tree. In a tree,
nodes that agree in the first FLOOR minima are a region; a link of similarity p = percent / 100 falls outside all regions with
probability (1 - p**FLOOR)**trees, and there are as many trees as bring this below MISS (20 for 85 %, 28 for 80 %). The nodes of a tree are sorted by their signatures, so those that agree further stand
next to each other: in crowded regions the order goes deeper. Neighbours of different components are candidates; they are
confirmed on full shingle sets and joined, tree by tree, and what is connected already is not compared again.

What is left is settled without comparing everything with everything. Components that still share regions make clusters.
A cluster's consensus is the set of shingles that most of some SAMPLE members have; every member becomes what it adds to the
consensus and how much of it it lacks. The member nearest to it is the hub, and all are compared with the hub. A member that
is still outside the hub's component can only be similar to one that shares enough of what both add (prefix filter: one of
the rarest 15 or 20 % is common to them), or whose numbers of shingles and losses allow it by themselves (see `possible`); just
those pairs are confirmed. Bitmaps of what a member lacks and adds bound what a pair has in common from above, so pairs that can't be similar are
not even made. This holds for any consensus, so the sample decides about speed only. There is no cap on candidates.

Defined results: null and empty texts have no shingles, are linked with nothing and stand alone; copies share a node and
its component; rows with a null doc_id link and are linked like all others, but give no component its number: they aren't kept where the
component has a doc_id; the component of rows without any doc_id is null, and they are kept; rows that repeat doc_id and text are
treated alike (ties in the smallest doc_id are all kept); a very long text is one set, compared whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm import shared as S
from fathom.llm.components import components

WORD = S.table_of(S.SPACES)
SHINGLE = 5
DEPTH, FLOOR = 6, 4
#: Chance of a link at the threshold to be in no region.
MISS = 4e-7
#: The first trees whose neighbours are compared in one go; then come the next, and all others.
ROUNDS = (0, 2, 7)
#: Bits, 64 to a number, that what a member lacks is hashed to, and as many for what it adds.
MAP = 256
MAPS = [f"{kind}{k}" for kind in "mx" for k in range(MAP // 64)]
#: Members that a cluster's consensus is made of, about.
SAMPLE = 64
#: Percent of the union that the intersection must reach, in op3 and in the pipeline.
PERCENT, STAGE_PERCENT = 85, 80
U = np.uint64
SIGNED = "doc_id long, row long, n_shingles long, node binary, keys array<long>, deeper array<long>"


def trees_for(percent: int) -> int:
    """The trees that a threshold needs."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** FLOOR))


def bitmap(values: np.ndarray) -> np.ndarray:
    """The bits that these are hashed to, as MAP // 64 numbers."""
    on = np.zeros(MAP, np.uint8)
    on[S.mixed(values.view(np.uint64), 70) % U(MAP)] = 1
    return np.packbits(on).view(np.int64)


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and a name of both."""
    return S.texts(docs).withColumn("row", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"))


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles in order, and where each row's begin."""
    data, at = S.utf8(column)
    data = S.lowered(data)
    start, end, first = S.spans(data, at, WORD)
    roll = S.Rolling(S.word_hashes(data, start, end), S.BASES[0])
    n = np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), count)
    low = np.repeat(first[:-1], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    high = np.minimum(low + SHINGLE, first[1:][row])
    value = S.mixed(roll(low, high) + (high - low).astype(np.uint64), 2)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (value[1:] != value[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(n) + 1))


def minima(values: np.ndarray, first: np.ndarray, trees: int) -> np.ndarray:
    """trees * DEPTH minima (32 bits each) of every row that has shingles."""
    rng = np.random.default_rng(7)
    factor = rng.integers(0, 2**63, trees * DEPTH, dtype=np.uint64) * U(2) + U(1)
    plus = rng.integers(0, 2**63, trees * DEPTH, dtype=np.uint64)
    rows = np.flatnonzero(np.diff(first))
    out = np.zeros((len(rows), trees * DEPTH), np.uint32)
    low = 0
    while low < len(rows):  # stretches that stay in a processor's cache
        high = max(low + 1, int(np.searchsorted(first[rows], first[rows[low]] + (1 << 15))))
        part = values[first[rows[low]] : first[rows[high - 1] + 1]]
        begin = first[rows[low:high]] - first[rows[low]]
        for k in range(trees * DEPTH):
            out[low:high, k] = np.minimum.reduceat((part ^ plus[k]) * factor[k], begin) >> U(32)
        low = high
    return out


def digests(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits for each row's set."""
    size = np.diff(first).astype(np.uint64)
    sums = [np.append(U(0), np.cumsum(S.mixed(values, 50 + k), dtype=np.uint64)) for k in range(2)]
    return np.stack([S.mixed(s[first[1:]] - s[first[:-1]] + size, 52) for s in sums], axis=1)


def signatures(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    """Nodes and signatures of these rows (doc_id, text, row), a small block at a time."""
    for rows in S.blocks(batches, S.SMALL_BLOCK_BYTES):
        values, first = shingle_sets(rows.column("text"))
        some = np.flatnonzero(np.diff(first))
        sig = minima(values, first, trees).reshape(len(some), trees, DEPTH).astype(np.uint64)
        key = np.full((len(some), trees), U(1))
        for k in range(FLOOR):
            key = S.mixed(key * U(S.BASES[0]) + sig[:, :, k], 60)
        key = S.mixed(key + np.arange(trees, dtype=np.uint64), 61)
        deep = sig[:, :, FLOOR] << U(32) | sig[:, :, FLOOR + 1]
        node = digests(values, first)[some].tobytes()
        missing = np.diff(first) == 0
        place = np.cumsum(~missing) - 1
        take = pa.array(place, mask=missing)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * trees, pa.int32()), pa.array(x.reshape(-1).view(np.int64))).take(take)  # noqa: B023, E731
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": rows.column("doc_id"),
                "row": rows.column("row"),
                "n_shingles": np.diff(first),
                "node": pa.array([node[16 * k : 16 * k + 16] for k in range(len(some))], pa.binary()).take(take),
                "keys": lists(key),
                "deeper": lists(deep),
            }
        )


def sign(docs: DataFrame, trees: int) -> DataFrame:
    """The stored nodes and signatures of all rows; rows without shingles have no node."""

    def signed(batches):
        yield from signatures(batches, trees)

    return S.stored(rows_of(docs).mapInArrow(S.tidy(signed), SIGNED), "signatures")


def sets_of(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """The stored shingle sets (node, hashes) of the nodes that these rows have."""

    def cut(batches):
        for rows in S.blocks(batches, S.SMALL_BLOCK_BYTES):
            values, first = shingle_sets(rows.column("text"))
            own = digests(values, first)
            flat = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"node": pa.array([x.tobytes() for x in own], pa.binary()), "hashes": pa.array(flat, pa.binary())})

    chosen = rows_of(docs).join(owners.select("row"), "row", "left_semi")
    return S.stored(chosen.select("text").mapInArrow(S.tidy(cut), "node binary, hashes binary").dropDuplicates(["node"]), "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (u, v) whose sets are similar enough."""

    def similar(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                keep = []
                for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
                    both = np.sort(np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)]), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= percent * (len(both) - common))
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(S.tidy(similar), "u binary, v binary")


def neighbours(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes that follow each other in the order of (key, deeper, node), share the key and differ in their component."""
    spark = rows.sparkSession
    order = ["key", "deeper", "node"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def adjacent(batches):
        from pyspark import TaskContext

        last, first = None, None
        names = ("key", "node", "comp", "n")
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_pylist() for c in names]
            here = list(zip(*columns, strict=True))
            first = first or here[0]
            u, v = [], []
            for a, b in zip([last, *here[:-1]] if last else here[:-1], here if last else here[1:], strict=True):
                if a[0] == b[0] and a[2] != b[2] and 100 * min(a[3], b[3]) >= percent * max(a[3], b[3]):
                    u.append(min(a[1], b[1]))
                    v.append(max(a[1], b[1]))
            last = here[-1]
            n = len(u)
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary()), "part": pa.nulls(n, pa.int32()), "side": pa.nulls(n, pa.int32()), "key": pa.nulls(n, pa.int64()), "comp": pa.nulls(n, pa.binary())})
        if last:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"u": [first[1], last[1]], "v": pa.nulls(2, pa.binary()), "part": pa.array([part, part], pa.int32()), "side": pa.array([0, 1], pa.int32()), "key": pa.array([first[0], last[0]], pa.int64()), "comp": pa.array([first[2], last[2]], pa.binary())})

    out = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(S.tidy(adjacent), "u binary, v binary, part int, side int, key long, comp binary")
    out = S.stored(out, "neighbours")
    ends = out.filter("part is not null").orderBy("part", "side").collect()  # two rows for each partition
    seams = [(min(a["u"], b["u"]), max(a["u"], b["u"])) for a, b in zip(ends, ends[1:]) if a["side"] == 1 and a["key"] == b["key"] and a["comp"] != b["comp"]]
    return out.filter("part is null").select("u", "v").unionByName(spark.createDataFrame([(bytearray(u), bytearray(v)) for u, v in seams], "u binary, v binary")).distinct()


def consensus(members: DataFrame, sets: DataFrame) -> DataFrame:
    """cluster, center: the shingles of more than half of the sampled members."""

    def spread(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                own = [np.frombuffer(x, np.int64) for x in part.column("hashes").to_pylist()]
                row = np.repeat(np.arange(len(own)), [len(x) for x in own])
                yield pa.RecordBatch.from_pydict({"cluster": part.column("cluster").take(pa.array(row)), "shingle": np.concatenate(own)})

    size = S.stored(members.groupBy("cluster").agg(F.count("*").alias("m")), "cluster-sizes")
    chosen = members.select("cluster", "node").join(size, "cluster").filter(F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / SAMPLE)) == 0)
    chosen = S.stored(chosen.select("cluster", "node"), "sampled")
    number = chosen.groupBy("cluster").agg(F.count("*").alias("s"))
    counts = chosen.join(sets, "node").select("cluster", "hashes").mapInArrow(S.tidy(spread), "cluster binary, shingle long").groupBy("cluster", "shingle").agg(F.count("*").alias("c"))
    common = counts.join(number, "cluster").filter("2 * c > s").groupBy("cluster").agg(F.collect_list("shingle").alias("center"))
    return S.stored(number.select("cluster").join(common, "cluster", "left"), "consensus")


def compared(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The members with what sets them apart from the consensus: added, lost, size (of the consensus), likeness, bitmaps of what they lack (m0 ...) and add (x0 ...)."""

    def apart(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                added, lost, size, likeness, maps = [], [], [], [], []
                for a, b in zip(part.column("hashes").to_pylist(), part.column("center").to_pylist(), strict=True):
                    own, middle = np.frombuffer(a, np.int64), np.array(b or [], np.int64)
                    more = np.setdiff1d(own, middle, assume_unique=True)
                    common = len(own) - len(more)
                    added.append(more)
                    lost.append(len(middle) - common)
                    size.append(len(middle))
                    likeness.append(common / (len(own) + len(middle) - common))
                    maps.append(np.concatenate([bitmap(np.setdiff1d(middle, own, assume_unique=True)), bitmap(more)]))
                ends = np.append(0, np.cumsum([len(x) for x in added]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(added), pa.int64()))
                columns = {c: part.column(c) for c in ("node", "n", "cluster")}
                yield pa.RecordBatch.from_pydict(columns | {"added": lists, "lost": pa.array(lost, pa.int64()), "size": pa.array(size, pa.int64()), "likeness": pa.array(likeness, pa.float64())} | dict(zip(MAPS, np.stack(maps).T.copy(), strict=True)))

    joined = members.join(sets, "node").join(consensus(members, sets), "cluster").select("node", "n", "cluster", "hashes", "center")
    return S.stored(joined.mapInArrow(S.tidy(apart), "node binary, n long, cluster binary, added array<long>, lost long, size long, likeness double, " + ", ".join(f"{c} long" for c in MAPS)), "members")


def possible(members: DataFrame, main: DataFrame, percent: int) -> DataFrame:
    """All pairs of a member outside the hub's component and one of another component that can be similar enough.

    What two sets have in common is in the consensus or added by both. A similar pair has `percent` of either set in common, so of
    what a set adds, all but the rest of the set's size is common as well; in one order of all added shingles, rarest first, the
    first common one is among the first 100 - percent % of the set's size and one more, on both sides. Or nothing added needs to be
    common: then at most the consensus less the larger loss is, which numbers alone decide. In both cases a bit that only one
    map has stands for a shingle at least that only one member lacks or adds; what is left in common must reach `percent`.
    """
    each = members.select("cluster", "node", "n", F.explode("added").alias("shingle"))
    times = each.groupBy("cluster", "shingle").agg(F.count("*").alias("times")).filter("times > 1")  # one that is alone is common to nobody
    order = Window.partitionBy("cluster", "node").orderBy("times", "shingle")
    alone = members.select("cluster", "node", F.size("added").alias("adds"))
    ranked = each.join(times, ["cluster", "shingle"]).withColumn("place", F.row_number().over(order)).join(alone, ["cluster", "node"])
    counted = ranked.groupBy("cluster", "node").agg(F.count("*").alias("repeated"))
    ranked = ranked.join(counted, ["cluster", "node"])
    single = F.col("adds") - F.col("repeated")  # these come first in the order
    prefix = S.stored(ranked.filter(F.col("place") + single <= F.floor(F.col("n") * (100 - percent) / 100) + 1).select("cluster", "node", "shingle"), "prefixes")

    side = lambda df, end: df.select("cluster", *[F.col(c).alias(c + end) for c in ("node", "comp", "n", "lost", "size", *MAPS)])
    outside = members.join(main, "cluster").filter("comp <> main").drop("main")
    a, b = side(outside, "_a"), side(members, "_b")
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    here, there = lambda c: F.col(c + "_a"), lambda c: F.col(c + "_b")
    bits = lambda kind, f: sum((F.bit_count(f(here(c), there(c))) for c in MAPS if c[0] == kind), F.lit(0))
    adds = lambda end: F.col("n" + end) - F.col("size_a") + F.col("lost" + end)
    both_add = F.least(adds("_a") - bits("x", lambda p, q: p.bitwiseAND(F.bitwise_not(q))), adds("_b") - bits("x", lambda p, q: q.bitwiseAND(F.bitwise_not(p))))
    lacking = F.greatest(F.col("lost_a") + bits("m", lambda p, q: q.bitwiseAND(F.bitwise_not(p))), F.col("lost_b") + bits("m", lambda p, q: p.bitwiseAND(F.bitwise_not(q))))
    most = F.col("size_a") - lacking + both_add
    differ = (F.col("comp_a") != F.col("comp_b")) & sizes & (most * 100 >= (F.col("n_a") + F.col("n_b") - most) * percent)
    left = prefix.withColumnRenamed("node", "node_a").join(a.drop("cluster"), "node_a")
    right = prefix.withColumnRenamed("node", "node_b").join(b.drop("cluster", "size_b"), "node_b")
    right = right.withColumnRenamed("cluster", "cluster_b").withColumnRenamed("shingle", "shingle_b")
    shared = left.join(right, (F.col("cluster") == F.col("cluster_b")) & (F.col("shingle") == F.col("shingle_b")) & differ).select("node_a", "node_b")
    kinds_a, kinds_b = a.select("cluster", "n_a", "lost_a", "size_a").distinct(), b.select("cluster", "n_b", "lost_b").distinct()
    largest = F.col("size_a") - F.greatest("lost_a", "lost_b")
    kinds = kinds_a.join(kinds_b, "cluster").filter(sizes & (largest * 100 >= (F.col("n_a") + F.col("n_b") - largest) * percent))
    kinds = kinds.select(F.col("cluster").alias("kind"), F.col("n_a").alias("n_kind"), F.col("lost_a").alias("lost_kind"), F.col("n_b").alias("n_other"), F.col("lost_b").alias("lost_other"))
    a = a.join(kinds, (F.col("cluster") == F.col("kind")) & (F.col("n_a") == F.col("n_kind")) & (F.col("lost_a") == F.col("lost_kind")))
    b = b.drop("size_b").withColumnRenamed("cluster", "cluster_b")
    allowed = a.join(b, (F.col("cluster") == F.col("cluster_b")) & (F.col("n_other") == F.col("n_b")) & (F.col("lost_other") == F.col("lost_b")) & differ).select("node_a", "node_b")
    return shared.unionByName(allowed).select(F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v")).distinct()


def near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id (smallest doc_id that links reach), kept."""
    return settled(docs, percent).drop("row")


def settled(docs: DataFrame, percent: int) -> DataFrame:
    """The same with the rows' names."""
    trees = trees_for(percent)
    signed = sign(docs, trees)
    nodes = signed.filter("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("deeper").alias("deeper"))
    each = nodes.select("node", "n", F.explode(F.arrays_zip(F.transform("keys", lambda _, i: i).alias("tree"), "keys", "deeper")).alias("x"))
    each = each.select("node", "n", F.col("x.tree").alias("tree"), F.col("x.keys").alias("key"), F.col("x.deeper").alias("deeper"))
    crowded = each.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("key")
    crowded = S.stored(crowded, "crowded")  # joins with a table that is read can split a hot key, joins with a fresh aggregate cannot
    regions = S.stored(each.join(crowded, "key"), "regions")
    owners = signed.filter("node is not null").groupBy("node").agg(F.min("row").alias("row"))  # first: a join could not split a hot node
    sets = sets_of(docs, owners.join(regions.select("node").distinct(), "node", "left_semi"))
    links, tried, comp = None, None, None

    def with_comp(rows: DataFrame) -> DataFrame:
        if comp is None:
            return rows.withColumn("comp", F.col("node"))
        return rows.drop("comp").join(comp, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")

    def add(found: DataFrame) -> None:
        nonlocal links, comp
        found = S.stored(found, "links")
        links = found if comp is None else comp.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found)
        comp = components(links)

    for low, high in zip(ROUNDS, (*ROUNDS[1:], trees), strict=True):
        pairs = neighbours(with_comp(regions.filter((F.col("tree") >= low) & (F.col("tree") < high))), percent)
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = S.stored(pairs, "candidates")
        tried = pairs if tried is None else tried.unionByName(pairs)
        add(confirmed(pairs, sets, percent))

    rows = with_comp(regions)
    several = rows.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("b")).filter("least <> b").drop("b")
    several = S.stored(several, "several")
    rows = S.stored(rows.join(several, "key"), "mixed-regions")
    clusters = components(rows.select(F.col("comp").alias("u"), F.col("least").alias("v")).distinct()).withColumnsRenamed({"root": "cluster", "node": "comp"})
    members = S.stored(rows.select("node", "comp", "n").distinct().join(clusters, "comp").drop("comp"), "clustered")
    members = compared(members, sets)
    hubs = S.stored(members.groupBy("cluster").agg(F.max(F.struct("likeness", "node"))["node"].alias("hub")), "hubs")
    star = members.join(hubs, "cluster").filter("node <> hub and likeness > 0").select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v"))
    add(confirmed(star, sets, percent))
    main = S.stored(with_comp(hubs.withColumnRenamed("hub", "node")).select("cluster", F.col("comp").alias("main")), "main-components")
    add(confirmed(S.stored(possible(S.stored(with_comp(members), "members"), main, percent), "candidates"), sets, percent))
    labelled = signed.select("doc_id", "row", "n_shingles", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    least = S.stored(labelled.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "component-ids")
    out = labelled.join(least, "comp", "left").withColumn("component_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "row", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def without_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id, or any if their own is null."""
    name = S.free_name(docs, "fathom_row")
    gone = settled(docs, percent).filter(~F.col("kept")).select(F.col("row").alias(name)).distinct()
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.withColumn(name, F.xxhash64(F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("-")), text))
    return rows.join(gone, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
