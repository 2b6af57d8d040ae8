"""N-gram Jaccard join by chosen paths: near copies among documents, on sets of five-word shingles.

Each distinct set is embedded as COORDINATES min-hash tokens. In every run a set starts at the run's
root; a node picks PICKS coordinates by hash, and a set goes on to the child of each picked token,
so similar sets share paths. Nodes of few sets are compared by brute force; larger ones are split
again on further tokens. Runs repeat until a pair at the threshold is missed with a chance below
1 - RECALL. What brute force finds on sketches only groups candidates: inside each group, whole
shingle sets are compared exactly, so every link is verified.

Groups of many near copies would make every pair of them work. Both distances here are metrics, so
a pivot spares most pairs: sets within the threshold of one pivot are held together by it, and sets
whose distances to the pivot add up to less than the threshold are linked without being compared.
Only the pairs that a pivot leaves open are dealt in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, saved, set_aside, spans_of, utf8, workspace
from .components import components
from .words import mix, window_hashes, word_hashes

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.999999
#: Min-hash tokens of a set, tokens picked at a node, sets compared by brute force at once, deepest level.
COORDINATES, PICKS, LIMIT, DEPTH = 128, 2, 256, 3
#: Sets and shingles in a tile of a large node or group.
TILE, TILE_SHINGLES = 2048, 1 << 21
#: Bytes of text that are made into shingles together.
SLICE = 1 << 19
#: Steps of the distance to a pivot, in bands of STEPS / BANDS; sets that a pivot is made of.
STEPS, BANDS, VOTERS = 4096, 64, 15
#: Agreeing sketch bits (of COORDINATES) of a candidate: a pair at the threshold expects 115, with a deviation of 3.4.
AGREE = 96

_rng = np.random.default_rng(20240501)
_FACTORS = _rng.integers(0, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def runs_needed(similarity: float = SIMILARITY, recall: float = RECALL, picks: int = PICKS, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold shares a leaf in one of them with probability `recall`.

    A token is shared with probability `similarity`; a pair survives a level if one of the picked
    tokens is shared and the pair survives below it.
    """
    meets = 1.0
    for _ in range(depth):
        meets = 1 - (1 - similarity * meets) ** picks
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each of some consecutive texts. One to four words make one shingle; no words, none."""
    words, first = word_hashes(data, offsets)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = min(SHINGLE, b - a)
        yield np.unique(window_hashes(words[a:b], n) + np.uint64(n)) if n else np.zeros(0, np.uint64)


def set_id(tokens: np.ndarray) -> bytes | None:
    """128 bits that tell a set from all others; none for the empty set."""
    if not len(tokens):
        return None
    return np.array([mix(tokens).sum(), mix(tokens * _SECOND).sum()], np.uint64).tobytes()


def embed(tokens: np.ndarray) -> np.ndarray:
    """Min-hash tokens of a set, 32 bits each."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 4096):
        np.minimum(least, (tokens[None, at : at + 4096] * _FACTORS[:, None]).min(1), out=least)
    return (mix(least) >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame) -> DataFrame:
    """`doc_id, text_hash, cid, n, tokens` of every row: its set's id, size and embedding (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, sizes, tokens = [], [], []
            for low, high in spans_of(offsets, SLICE):
                for s in shingle_sets(data, offsets[low : high + 1]):
                    ids.append(set_id(s))
                    sizes.append(len(s))
                    tokens.append(embed(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.binary())], ["doc_id", "text_hash", "cid", "n", "tokens"])

    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return source.mapInArrow(run, "doc_id long, text_hash long, cid binary, n int, tokens binary")


_ROW = "node long, cid binary, low long, high long"


def _step(node: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of (node, set) rows: each node's picked coordinates with the set's tokens there. Returns parent rows and nodes."""
    parents, nodes = [], []
    for k in range(PICKS):
        pick = mix(node + np.uint64(k + 1)) >> np.uint64(64 - COORDINATES.bit_length() + 1)
        token = tokens[np.arange(len(node)), pick.astype(np.int64)].astype(np.uint64)
        nodes.append(mix(node * _SECOND + (pick << np.uint64(32) | token)))
        parents.append(np.arange(len(node)))
    parent, child = np.concatenate(parents), np.concatenate(nodes)
    # Both picks may be one coordinate: the same child, once.
    keep = np.ones(len(child), bool)
    half = len(node)
    for k in range(1, PICKS):
        for j in range(k):
            keep[k * half : (k + 1) * half] &= child[k * half : (k + 1) * half] != child[j * half : (j + 1) * half]
    return parent[keep], child[keep]


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """One bit of each token, as two 64-bit numbers a row."""
    return np.packbits((tokens & 1).astype(np.uint8), axis=1).view(np.int64)


def _roots(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _matrix(batch.column("tokens"))
            sketch = _sketch(tokens)
            for r in range(runs):
                root = np.full(len(tokens), mix(np.array([r + 1], np.uint64) * _SECOND)[0], np.uint64)
                yield _rows(batch.column("cid"), sketch, *_step(root, tokens))

    return run


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = _matrix(batch.column("tokens"))
        node = batch.column("node").to_numpy().view(np.uint64)
        yield _rows(batch.column("cid"), _sketch(tokens), *_step(node, tokens))


def _matrix(column: pa.Array) -> np.ndarray:
    data, offsets = utf8(column)
    return np.ascontiguousarray(data[offsets[0] : offsets[-1]]).view(np.uint32).reshape(-1, COORDINATES)


def _rows(cid: pa.Array, sketch: np.ndarray, parent: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), cid.take(pa.array(parent)), pa.array(sketch[parent, 0]), pa.array(sketch[parent, 1])], ["node", "cid", "low", "high"])


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that hold the components of a symmetric matrix together: each member with its component's first."""
    n, edges = len(linked), []
    if n == 2:
        return [(1, 0)] if linked[0, 1] else []
    free = np.ones(n, bool)
    for k in range(n):
        if free[k]:
            free[k] = False
            front = np.array([k])
            while len(front):
                front = np.flatnonzero(linked[front].any(0) & free)
                free[front] = False
                edges += [(int(i), k) for i in front]
    return edges


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of a sorted partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        names = [tuple(x) for x in zip(*[batch.column(k).to_pylist() for k in keys], strict=True)]
        at = 0
        while at < len(names):
            end = at
            while end < len(names) and names[end] == names[at]:
                end += 1
            if names[at] != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = names[at]
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield pa.Table.from_batches(held)


def _brute_force(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket whose sketches agree, as spanning edges; of a tile pair, those between the tiles."""
    names: list[tuple[bytes, bytes]] = []
    for g in _groups(batches, ["node", "tile_a", "tile_b"]):
        cid = g.column("cid").to_pylist()
        sketch = np.column_stack([g.column("low").to_numpy(), g.column("high").to_numpy()]).view(np.uint64)
        n = len(cid)
        linked = np.zeros((n, n), bool)
        for at in range(0, n, 256):
            off = np.bitwise_count(sketch[at : at + 256, None, 0] ^ sketch[None, :, 0]).astype(np.int16) + np.bitwise_count(sketch[at : at + 256, None, 1] ^ sketch[None, :, 1])
            linked[at : at + 256] = off <= COORDINATES - AGREE
        names += [(cid[i], cid[j]) for i, j in spanning(linked) if cid[i] != cid[j]]
        if len(names) > 50_000:
            yield _edge_batch(names)
            names = []
    yield _edge_batch(names)


def _edge_batch(names: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in names], pa.binary()), pa.array([b for _, b in names], pa.binary())], ["a", "b"])


def _in_tiles(rows: DataFrame, key: str) -> DataFrame:
    """Rows in the pairs of tiles that they are part of, one group (`key`, tile_a, tile_b) together and in order.

    `own` is a row's tile, `others` the tiles that it has to meet.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.withColumn("other", F.explode("others")).withColumn("tile_a", F.least("own", "other")).withColumn("tile_b", F.greatest("own", "other")).drop("other", "others")
    return rows.repartition(parts, key, "tile_a", "tile_b").sortWithinPartitions(key, "tile_a", "tile_b")


def _open_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of nodes with more than LIMIT sets: edges to the node's pivot, and rows for the pairs that it leaves open.

    Sets whose sketches agree with the pivot's hang on it, so pairs among them say nothing new. The
    others (far ones) meet all: a row goes to as many tiles as there are tiles of far ones, so a node
    of near copies costs no more than its rows.
    """
    off = F.bit_count(F.col("low").bitwiseXOR(F.col("pivot.low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("pivot.high")))
    rows = rows.withColumn("far", off > COORDINATES - AGREE)
    edges = rows.filter("not far and cid != pivot.cid").select(F.col("cid").alias("a"), F.col("pivot.cid").alias("b"))
    sizes = rows.groupBy("node").agg(F.count_if("far").alias("n_far"), F.count_if(~F.col("far")).alias("n_near")).filter("n_far > 0")
    tiles_far, tiles_near = F.ceil(F.col("n_far") / TILE).cast("int"), F.ceil(F.col("n_near") / TILE).cast("int")
    rows = rows.drop("members", "pivot").join(sizes, "node")
    spread = F.xxhash64("cid", F.lit("tile"))
    # Tiles of near ones come after those of far ones.
    own = F.when(F.col("far"), F.pmod(spread, tiles_far)).otherwise(tiles_far + F.pmod(spread, tiles_near)).cast("int")
    others = F.when(F.col("far"), F.sequence(F.lit(0), tiles_far + tiles_near - 1)).otherwise(F.sequence(F.lit(0), tiles_far - 1))
    return edges, rows.withColumn("own", own).withColumn("others", others).select("node", "cid", "low", "high", "own", "others")


def candidates(sets: DataFrame, folder: str, runs: int | None = None) -> DataFrame:
    """Edges `a, b` between sets (`cid, tokens`) that share a small node and agree on their sketches: enough to hold each group together. Tables lie in `folder`."""
    spark, runs = sets.sparkSession, runs or runs_needed()
    path = f"{folder}/paths-0"
    rows = saved(sets.mapInArrow(_roots(runs), _ROW), "paths", path)
    found = None
    for level in range(1, DEPTH + 1):
        nodes = f"{folder}/nodes-{level}"
        pivot = F.min(F.struct("cid", "low", "high"))
        counts = saved(rows.groupBy("node").agg(F.count("node").alias("members"), pivot.alias("pivot")).filter("members > 1"), "nodes", nodes)
        small = rows.join(counts.filter(F.col("members") <= LIMIT).select("node"), "node").withColumn("own", F.lit(0)).withColumn("others", F.array(F.lit(0)))
        hot = counts.filter(F.col("members") > LIMIT)
        more = not hot.isEmpty()
        bucket, edges = small.select("node", "cid", "low", "high", "own", "others"), None
        if more and level == DEPTH:
            edges, left = _open_pairs(rows.join(hot, "node"))
            bucket = bucket.unionByName(left)
        met = _in_tiles(bucket, "node").mapInArrow(_brute_force, "a binary, b binary")
        edges = saved((met if edges is None else met.unionByName(edges)).distinct(), "candidates", f"{folder}/candidates-{level}")
        found = edges if found is None else found.union(edges)
        more = more and level < DEPTH
        if more:
            below = rows.join(hot.select("node"), "node").select("node", "cid").join(sets, "cid").select("node", "cid", "tokens")
            rows = saved(below.mapInArrow(_deeper, _ROW), "paths", f"{folder}/paths-{level}")
        discard(spark, path)
        discard(spark, nodes)
        path = f"{folder}/paths-{level}"
        if not more:
            break
    return found


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarities in a tile pair of a group: for each set the documents it links to here, and spanning edges of the links.

    Pairs whose steps to the pivot add up to SURE or less are counted elsewhere (`step` is null where there is no pivot).
    """
    a, b, links = [], [], []
    for g in _groups(batches, ["comp", "tile_a", "tile_b"]):
        rows = {c: r for c, *r in zip(g.column("cid").to_pylist(), g.column("own").to_pylist(), g.column("shingles"), g.column("copies").to_pylist(), g.column("step").to_pylist(), strict=True)}
        cids = list(rows)
        tile = np.array([rows[c][0] for c in cids])
        copies = np.array([rows[c][2] for c in cids], np.int64)
        step = np.array([STEPS if rows[c][3] is None else rows[c][3] for c in cids])
        sets = [np.frombuffer(rows[c][1].as_buffer(), np.uint64) for c in cids]
        size = np.array([len(s) for s in sets])
        within = g.column("tile_a")[0] == g.column("tile_b")[0]
        total, n, edges = np.zeros(len(cids), np.int64), len(cids), []
        # Blocks of LIMIT sets by LIMIT: memory does not grow with the tile.
        for x in range(0, n, LIMIT):
            for y in range(x, n, LIMIT):
                one, two = np.arange(x, min(x + LIMIT, n)), np.arange(y, min(y + LIMIT, n))
                both = one if x == y else np.concatenate([one, two])
                shared = _intersections([sets[k] for k in both])
                linked = shared >= SIMILARITY / (1 + SIMILARITY) * (size[both][:, None] + size[both][None, :]) - 1e-9
                np.fill_diagonal(linked, False)
                linked &= step[both][:, None] + step[both][None, :] > SURE
                if not within:
                    linked &= tile[both][:, None] != tile[both][None, :]  # pairs of one tile are its own group's
                if x != y:
                    linked[: len(one), : len(one)] = False
                    linked[len(one) :, len(one) :] = False
                edges += [(cids[both[i]], cids[both[j]]) for i, j in spanning(linked)]
                total[both] += linked @ copies[both]
        for i, j in edges:
            a.append(i)
            b.append(j)
            links.append(0)
        for k in np.flatnonzero(total):
            a.append(cids[k])
            b.append(None)
            links.append(int(total[k]))
        if len(a) > 50_000:
            yield _link_batch(a, b, links)
            a, b, links = [], [], []
    yield _link_batch(a, b, links)


def _link_batch(a: list, b: list, links: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64())], ["a", "b", "links"])


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: products of 0/1 blocks over the tokens that two sets or more have."""
    n = len(sets)
    if n == 2:
        one = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), one], [one, len(sets[1])]])
    token, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    used = count[at] > 1
    owner, column = owner[used], column[at[used]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        x, y = np.searchsorted(column, [low, low + 4096])
        block = np.zeros((n, 4096), np.float32)
        block[owner[x:y], column[x:y] - low] = 1
        out += block @ block.T
    return out


#: Steps to the pivot of two sets that are linked for certain, if they add up to no more. Steps are rounded up.
SURE = math.floor((1 - SIMILARITY) * STEPS)
_SET = "comp binary, members long, cid binary, copies long, shingles binary"


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the rows' texts, once for each set in a task; rows whose text has another set are left out."""
    done: set[bytes] = set()
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        cids, keep, made = batch.column("cid").to_pylist(), [], []
        for low, high in spans_of(offsets, SLICE):
            for k, s in enumerate(shingle_sets(data, offsets[low : high + 1]), low):
                if cids[k] not in done and set_id(s) == cids[k]:
                    done.add(cids[k])
                    keep.append(k)
                    made.append(s.tobytes())
        kept = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(kept) for c in ("comp", "members", "cid", "copies")], pa.array(made, pa.binary())], ["comp", "members", "cid", "copies", "shingles"])


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles that at least half of some sets have (those of the first, if there are none)."""
    for batch in batches:
        made = []
        for sets in batch.column("sets").to_pylist():
            tokens, n = np.unique(np.concatenate([np.frombuffer(s, np.uint64) for s in sets]), return_counts=True)
            most = tokens[n * 2 >= len(sets)]
            made.append(most.tobytes() if len(most) else sets[0])
        yield pa.RecordBatch.from_arrays([batch.column("comp"), pa.array(made, pa.binary())], ["comp", "pivot"])


def _to_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps from each set to its group's pivot (distance 1 - similarity, rounded up) and the number of its shingles."""
    for batch in batches:
        steps, sizes = [], []
        for s, p in zip(batch.column("shingles"), batch.column("pivot"), strict=True):
            one, two = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(p.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(two, one), len(two) - 1)
            shared = int((two[at] == one).sum())
            union = len(one) + len(two) - shared
            steps.append(-(-STEPS * (union - shared) // union))
            sizes.append(len(one))
        arrays = [*[batch.column(c) for c in ("comp", "cid", "copies")], pa.array(steps, pa.int32()), pa.array(sizes, pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, ["comp", "cid", "copies", "step", "size"])


def _large_groups(large: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Links of groups with more than LIMIT sets that their pivots settle (`a, b, links`), and rows for the pairs that are left, in tiles.

    The pivot is what most of the group's first VOTERS sets have, so it lies between the copies of one
    text; whichever set it is changes the work, not the result. Counts of sets by step, at most STEPS a group, tell how
    many sets a set is linked to for certain. Bands of steps that can hold an open pair (not linked for
    certain, and not further apart than the threshold) meet each other, each in tiles of bounded size.
    """
    first = large.withColumn("rn", F.row_number().over(W.partitionBy("comp").orderBy("cid"))).filter(F.col("rn") <= VOTERS)
    pivots = first.groupBy("comp").agg(F.collect_list("shingles").alias("sets")).mapInArrow(_pivots, "comp binary, pivot binary")
    steps = saved(large.join(pivots, "comp").mapInArrow(_to_pivot, "comp binary, cid binary, copies long, step int, size int"), "steps", f"{folder}/steps")
    held = steps.groupBy("comp", "step").agg(F.sum("copies").alias("n"))
    # One row a step that sets have and one a step that some set asks for: as many as there are steps, however large the group.
    asked = held.select("comp", (F.lit(SURE) - F.col("step")).alias("at"), F.lit(0).cast("long").alias("n"), F.col("step")).filter("at >= 0")
    given = held.select("comp", F.col("step").alias("at"), "n", F.lit(None).cast("int").alias("step"))
    upto = F.sum("n").over(W.partitionBy("comp").orderBy("at").rangeBetween(W.unboundedPreceding, 0))
    sure = given.unionByName(asked).withColumn("sure", upto).filter("step is not null").select("comp", "step", "sure")
    own = F.when(F.col("step") * 2 <= SURE, F.col("copies")).otherwise(0)
    settled = steps.join(sure, ["comp", "step"]).select(F.col("cid").alias("a"), F.lit(None).cast("binary").alias("b"), (F.col("sure") - own).alias("links")).filter("links > 0")
    # All pairs that are settled are among the sets that are linked for certain to the one nearest to the pivot.
    nearest = steps.groupBy("comp").agg(F.min(F.struct("step", "cid")).alias("nearest"))
    hung = steps.join(nearest, "comp").filter((F.col("step") + F.col("nearest.step") <= SURE) & (F.col("cid") != F.col("nearest.cid")))
    hung = hung.select(F.col("cid").alias("a"), F.col("nearest.cid").alias("b"), F.lit(0).cast("long").alias("links"))

    wide = STEPS // BANDS
    band = F.least(F.floor(F.col("step") / wide), F.lit(BANDS - 1)).cast("int")
    tiles = F.ceil(F.greatest(F.count("cid") / TILE, F.sum("size") / TILE_SHINGLES)).cast("int")
    bands = steps.groupBy("comp", band.alias("band")).agg(tiles.alias("tiles"))
    # One row a group, BANDS entries at most.
    bands = bands.groupBy("comp").agg(F.sort_array(F.collect_list(F.struct("band", "tiles"))).alias("bands"))
    mine, theirs = F.col("band"), lambda x: x["band"]
    unsure = lambda x: ((mine + theirs(x) + 2) * wide > SURE) & (F.abs(mine - theirs(x)) <= SURE // wide + 2)
    rows = large.join(steps.select("comp", "cid", "step"), ["comp", "cid"]).withColumn("band", band).join(bands, "comp")
    tile = lambda of, k: (of * (1 << 16) + k).cast("int")
    count = F.element_at(F.filter("bands", lambda x: x["band"] == mine), 1)["tiles"]
    rows = rows.withColumn("own", tile(mine, F.pmod(F.xxhash64("cid", F.lit("tile")), count)))
    others = F.flatten(F.transform(F.filter("bands", unsure), lambda x: F.transform(F.sequence(F.lit(0), x["tiles"] - 1), lambda k: tile(theirs(x), k))))
    return settled.unionByName(hung), rows.withColumn("others", others).select("comp", "cid", "copies", "shingles", "step", "own", "others")


def _linked(members: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """`a, b, links`: links of the sets in `members` (comp, members, cid, copies, first) by comparing whole sets, and edges that hold the classes together (links 0)."""
    # Ids may be null, and rows may share one: a set's text is found by the id and the hash of the row that stands for it.
    texts = docs.select(F.col("doc_id").alias("text_id"), F.xxhash64("text").alias("text_key"), "text")
    met = members.join(texts, F.col("first.doc_id").eqNullSafe(F.col("text_id")) & (F.col("first.text_hash") == F.col("text_key")))
    whole = met.select("comp", "members", "cid", "copies", "text").mapInArrow(_whole_sets, _SET)
    # Written once: large groups read it three times, and a set found by two tasks counts once below.
    whole = saved(whole, "group-sets", f"{folder}/group-sets")
    small = whole.filter(F.col("members") <= LIMIT).withColumns({"step": F.lit(None).cast("int"), "own": F.lit(0), "others": F.array(F.lit(0))})
    rows, settled = small.select("comp", "cid", "copies", "shingles", "step", "own", "others"), None
    large = whole.filter(F.col("members") > LIMIT)
    if not large.isEmpty():
        large = large.dropDuplicates(["comp", "cid"])
        settled, open_rows = _large_groups(large, folder)
        rows = rows.unionByName(open_rows)
    checked = _in_tiles(rows, "comp").mapInArrow(_verify, "a binary, b binary, links long")
    return saved(checked if settled is None else checked.unionByName(settled), "links", f"{folder}/links")


def join(docs: DataFrame) -> DataFrame:
    """`doc_id, text_hash, class_id, n_links, n_copies, keep` of every row of `docs` (doc_id, text).

    Two documents are linked if their shingle sets have a Jaccard similarity of SIMILARITY or more;
    `class_id` is the least doc_id that links lead to, `n_links` the number of other documents linked
    to this one directly, copies included, and `n_copies` the rows with its very set. `keep` marks the
    row of each class with the least (doc_id, text_hash), ids that are null last.

    Rows with a null doc_id take part like all others; a class in which no row has an id has a null
    class_id. Texts without words are linked to nothing: class_id is their own doc_id, n_links 0, and
    they are kept. Repeated rows are copies of each other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with workspace(spark, "jaccard") as folder:
        marks = saved(signatures(docs), "signatures", f"{folder}/signatures")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
        # The tokens are a function of the set, so any row's will do.
        sets = marks.filter("cid is not null").groupBy("cid").agg(least.alias("first"), F.count("cid").alias("copies"), F.first("tokens").alias("tokens"))
        sets = saved(sets, "sets", f"{folder}/sets")
        group = components(candidates(sets.select("cid", "tokens"), folder), folder)
        group = saved(group.withColumnRenamed("id", "cid"), "groups", f"{folder}/groups")
        sizes = group.groupBy("comp").agg(F.count("cid").alias("members"))
        members = group.join(sizes, "comp").join(sets.select("cid", "copies", "first"), "cid")
        checked = _linked(members, docs, folder)
        links = checked.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cid")
        merged = components(checked.filter("b is not null").select("a", "b"), folder).withColumnRenamed("id", "cid")
        classes = sets.drop("tokens").join(merged, "cid", "left").join(links, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        heads = classes.groupBy("comp").agg(F.min("first").alias("head"))
        classes = classes.join(heads, "comp").select("cid", "copies", F.coalesce("links", F.lit(0)).alias("links"), "head")
        out = marks.select("doc_id", "text_hash", "cid").join(classes, "cid", "left")
        alone = F.col("head").isNull()
        # Written, as the tables that it is made of go.
        return saved(
            out.select(
                "doc_id",
                "text_hash",
                F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
                F.when(F.col("cid").isNull(), F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
                F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
                (alone | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash")))).alias("keep"),
            ),
            "jaccard-classes",
        )


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one row of each class stays, with the columns of `docs`; all texts without words stay."""
    # The same key columns in the join and in dropDuplicates: texts are shuffled once.
    keys = ["kept_id", "kept_null", "kept_hash"]
    docs, back = set_aside(docs, tuple(keys))
    keyed = lambda t, h: t.withColumns({"kept_id": F.coalesce("doc_id", F.lit(0)), "kept_null": F.col("doc_id").isNull(), "kept_hash": h})
    kept = keyed(join(docs).filter("keep"), F.col("text_hash")).select(*keys).distinct()
    rows = keyed(docs, F.coalesce(F.xxhash64("text"), F.lit(0)))
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select(docs.columns).withColumnsRenamed(back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: class and links of every document."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "n_copies")
