"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, exact over all texts.

A text's set is its distinct word shingles (64-bit hashes); texts link at a similarity of `percent` or more. Equal
sets are one node from the start, known by a hash of the whole set, so copies are never paired.

1. Texts that share a key (two least hashes, of two permutations; four keys each) meet in tiles of at most TILE nodes; in
   a tile, nodes in different components are compared: sizes, then bit counts of the XOR of parity bitmaps (which
   bound the overlap from above), then the sorted arrays. Only the links that join components come out.
   A group larger than a tile is split by hash, with its first node in every part. This step finds nearly all
   components in linear work, but need not find all.
2. Prefix filter, which misses nothing: each set is ordered by rarity (a count sketch of fixed size, then the hash);
   linked sets share one of their first n - ceil(t n) + 1 shingles. Shingles whose nodes all lie in one component by
   now have nothing to tell and go. The rest meet in tiles by (shingle, band of sizes): a node enters its
   own band and the next one, and a very common shingle is split further, so that every pair of its nodes meets in one tile.
   Pairs of different components that pass the bounds on size, position and bit counts are compared exactly.
3. Components of all links, by alternating stars.

Groups of near copies meet in tiles and give a forest of links, never all pairs; no partner or candidate is dropped.

What is joined to a node's prefix rows is dealt by (node, slice of its prefix), so that a very long text is no hot key.

Null and empty texts, and texts without words, have an empty set and link with nothing. With fewer words than a
shingle the whole sequence is the one shingle. Repeated rows (and ids) are joined like equal texts; null ids have no part in the least id.
Empty tables give empty results. Ids may be of any type that has an order. Only doc_id and the text are read: other columns don't come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quernstone.llm import wordhash as wh
from quernstone.llm.base import BROADCAST_ROWS, cut, small, with_groups
from quernstone.llm.components import components

TILE, SKETCH, SLICES, LEAST = 1024, 1 << 20, 16, 512  # nodes, counters, parts they are summed in, places of a bitmap
KEYS, ROWS, PREFIX_ROWS = 4, 2, 512  # of a node, prefix rows that are joined in one task


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle hashes)."""
    for at, _, words in wh.pieces(column, wh.SPACES):
        grams = wh.gram_hashes(words.hashes, n)
        for d, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            if b - a >= n:
                yield at + d, np.unique(grams[a : b - n + 1])
            else:
                yield at + d, wh.gram_hashes(words.hashes[a:b], b - a)[:1] if b > a else np.zeros(0, np.uint64)


def node_of(s: np.ndarray, salt: int) -> int:
    """A hash of the whole set, as a signed 64-bit number."""
    x = wh.mix(s + np.uint64(wh.BASE * (salt + 1) & wh.MASK))
    return int(wh.mix(np.array([x.sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def bitmap(s: np.ndarray, places: int = 0) -> np.ndarray:
    """Parity of the set's members in each of so many places; else a power of 2, LEAST at least and as many as members."""
    places = places or max(LEAST, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(20) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps as rows, all of the least length: a half XOR the other is the bitmap of half as many places."""
    words = min(map(len, maps))
    out = np.empty((len(maps), words), np.uint64)
    for i, m in enumerate(maps):
        out[i] = m if len(m) == words else np.bitwise_xor.reduce(m.reshape(-1, words), axis=0)
    return out


def least_keys(s: np.ndarray) -> list[int]:
    """Each key joins the least hashes of ROWS permutations."""
    least = [wh.mix(s ^ np.uint64(wh.BASE * (k + 7) & wh.MASK)).min() for k in range(KEYS * ROWS)]
    return wh.mix(np.array(least, np.uint64).reshape(KEYS, ROWS) @ np.array([1, 0x9E3779B97F4A7C15], np.uint64) + np.arange(KEYS, dtype=np.uint64)).view(np.int64).tolist()


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """100 * o >= percent * (a + b - o), least o."""
    return -(-percent * (a + b) // (100 + percent))


class Forest:
    """Components of the nodes of one tile."""

    def __init__(self, names: np.ndarray):
        self.of = np.unique(names, return_inverse=True)[1]

    def join(self, i: int, j: int) -> None:
        self.of[self.of == self.of[j]] = self.of[i]


def text_hash(text: Column) -> Column:
    """Which text of its id a row has; null is like empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def profiles(docs: DataFrame, text: str, n: int, salt: int) -> DataFrame:
    """For each text: its id and hash, size, node, check, keys, bits; besides, rows of sketch counts."""
    ids = docs.select("doc_id").schema[0]
    own = T.StructType([T.StructField("doc_id", ids.dataType), T.StructField("text_hash", T.LongType())])
    found = T._parse_datatype_string("n_shingles long, node long, check long, keys array<long>, bits binary, slice int, at binary, counts binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(SKETCH, np.uint32), set()
        names = ["doc_id", "text_hash", "n_shingles", "node", "check", "keys", "bits", "slice", "at", "counts"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        arrays = lambda own, columns: pa.RecordBatch.from_arrays([*own, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)
        id_type = to_arrow_type(ids.dataType)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for _, s in shingle_sets(batch.column(2), n):
                node = node_of(s, salt) if len(s) else None
                rows[0].append(len(s)), rows[1].append(node), rows[2].append(node_of(s, salt + 1000) if len(s) else None)
                rows[3].append(least_keys(s) if len(s) else None), rows[4].append(bitmap(s).tobytes() if len(s) else None)
                if len(s) and node not in seen:  # a task counts a set once, as far as it remembers
                    seen.add(node) if len(seen) < 200_000 else seen.clear()
                    np.add.at(sketch, (s & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            none = [None] * batch.num_rows
            yield arrays(batch.columns[:2], [*rows, none, none, none])
        used = np.flatnonzero(sketch)
        cuts = np.searchsorted(used, np.arange(SLICES + 1) * (SKETCH // SLICES))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                where, counts = np.diff(used[a:b], prepend=i * (SKETCH // SLICES)).astype(np.uint16), np.minimum(sketch[used[a:b]], 65535).astype(np.uint16)
                yield arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64())], [[None]] * 5 + [[i], [pa.compress(where.tobytes(), "zstd", asbytes=True)], [pa.compress(counts.tobytes(), "zstd", asbytes=True)]])

    return docs.select("doc_id", text_hash(F.col(text)), F.col(text).cast("string")).mapInArrow(wh.trimmed(run), T.StructType([*own.fields, *found.fields]))


def sketch_of(profile: DataFrame) -> np.ndarray:
    """The summed counters: SKETCH numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, at, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                into = total.setdefault(i, np.zeros(SKETCH // SLICES, np.int64))
                where = np.frombuffer(unpack(at), np.uint16)
                into[np.cumsum(where.astype(np.int64))] += np.frombuffer(unpack(counts), np.uint16)
        for i, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slice", "counts"])

    rows = profile.where("slice is not null").select("slice", "at", "counts").repartition(SLICES, "slice").mapInArrow(wh.trimmed(run), "slice int, counts binary")
    out = np.zeros(SKETCH, np.int64)
    for r in rows.collect():
        out[r.slice * (SKETCH // SLICES) : (r.slice + 1) * (SKETCH // SLICES)] = np.frombuffer(r.counts, np.int64)
    return out


def unpack(data: bytes) -> bytes:
    import io

    return pa.CompressedInputStream(io.BytesIO(data), "zstd").read()


def rarity(sketch: np.ndarray) -> np.ndarray:
    """A class for each counter: 0 up to what chance puts there, then by powers of 2."""
    mean = sketch.mean()
    over = sketch - (mean + 6 * np.sqrt(mean) + 1)
    return np.where(over > 0, 1 + np.frexp(np.maximum(over, 1))[1], 0).astype(np.uint64)


def sets_of(docs: DataFrame, text: str, n: int, salt: int, with_keys: bool) -> DataFrame:
    """node, set (and keys) of each text; once for each task's equal sets, as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            nodes, sets, keys = [], [], []
            size = 0
            for _, s in shingle_sets(batch.column(0), n):
                if not len(s) or (node := node_of(s, salt)) in seen:
                    continue
                seen.add(node) if len(seen) < 200_000 else seen.clear()
                nodes.append(node), sets.append(s.tobytes()), keys.append(least_keys(s) if with_keys else [])
                size += s.nbytes
                if size > 8_000_000:
                    yield out(nodes, sets, keys)
                    nodes, sets, keys, size = [], [], [], 0
            yield out(nodes, sets, keys)

    def out(nodes: list, sets: list, keys: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["node", "set", "keys"])

    return docs.select(F.col(text).cast("string")).mapInArrow(wh.trimmed(run), "node long, set binary, keys array<long>")


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of each run of rows with equal keys (the first n_keys columns), across batches; the rows come sorted by key."""
    rest: list[pa.Array] | None = None
    for batch in batches:
        columns = batch.columns if rest is None else [pa.concat_arrays([a, b]) for a, b in zip(rest, batch.columns, strict=True)]
        keys = [c.to_numpy(zero_copy_only=False) for c in columns[:n_keys]]
        new = np.zeros(len(keys[0]), bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        sizes = np.diff([*cuts, len(new)])
        for at, size in zip(cuts[:-1], sizes[:-1].tolist(), strict=True):
            if size > 1:
                yield [c.slice(at, size) for c in columns]
        rest = [c.slice(cuts[-1]) for c in columns] if len(new) else None
    if rest is not None and len(rest[0]) > 1:
        yield rest


def tile_links(groups_of: Iterator[list[pa.Array]], percent: int) -> Iterator[tuple[int, int]]:
    """Links that join the components of a tile. Columns: key, tile, node, set."""
    for _, _, nodes, sets in groups_of:
        nodes, at = np.unique(nodes.to_numpy(), return_index=True)
        if len(nodes) < 2:
            continue
        arrays = [np.frombuffer(sets[int(i)].as_buffer(), np.uint64) for i in at]
        size = np.array([len(s) for s in arrays])
        bits, forest = np.stack([bitmap(s, LEAST) for s in arrays]), Forest(nodes)
        for i in range(len(nodes) - 1):
            j = i + 1 + np.flatnonzero(forest.of[i + 1 :] != forest.of[i])
            need = least_overlap(size[i], size[j], percent)
            j = j[(np.minimum(size[i], size[j]) >= need)]
            need = least_overlap(size[i], size[j], percent)
            j = j[size[i] + size[j] - np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) >= 2 * need]
            for k in j.tolist():
                if forest.of[i] != forest.of[k] and overlap(arrays[i], arrays[k]) >= least_overlap(size[i], size[k], percent):
                    forest.join(i, k)
                    yield int(nodes[i]), int(nodes[k])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Members in both of two ascending arrays of distinct numbers."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def pairs_out(pairs: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []
    for pair in pairs:
        held.append(pair)
        if len(held) == 50_000:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in held], pa.int64()) for k in (0, 1)], ["a", "b"])
            held = []
    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in held], pa.int64()) for k in (0, 1)], ["a", "b"])


def near_links(docs: DataFrame, profile: DataFrame, text: str, n: int, percent: int, salt: int) -> DataFrame:
    """Step 1: a, b."""
    keys = profile.where("node is not null").select("node", F.explode("keys").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n")).where("first < last").drop("last"))
    found = sets_of(docs, text, n, salt, True).select("node", "set", F.explode("keys").alias("key")).join(small(shared, shared.count()), "key")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    found = found.select("key", F.explode(F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(own))).alias("tile"), "node", "set")
    tiled = found.repartition("key", "tile").sortWithinPartitions("key", "tile")
    return tiled.mapInArrow(wh.trimmed(lambda batches: pairs_out(tile_links(groups(batches, 2), percent))), "a long, b long").distinct()


def prefixes(docs: DataFrame, text: str, n: int, percent: int, salt: int, sketch: np.ndarray) -> DataFrame:
    """shingle, node, size and place (in one number) of each set's prefix; once for each task's equal sets."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity(sketch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            shingles, nodes, sizes = [], [], []
            for _, s in shingle_sets(batch.column(0), n):
                if not len(s) or (node := node_of(s, salt)) in seen:
                    continue
                seen.add(node) if len(seen) < 200_000 else seen.clear()
                length = len(s) + 1 + (-percent * len(s) // 100)
                order = np.argsort((shared.value[(s & np.uint64(SKETCH - 1)).astype(np.int64)] << np.uint64(58)) | (s >> np.uint64(6)), kind="stable")[:length]
                shingles.append(s[order]), nodes.append(np.full(length, node)), sizes.append((len(s) << 32) + np.arange(length))
            join = lambda x, kind: pa.array(np.concatenate(x).view(kind) if x else np.zeros(0, kind))
            yield pa.RecordBatch.from_arrays([join(shingles, np.int64), join(nodes, np.int64), join(sizes, np.int64)], ["shingle", "node", "place"])

    return docs.select(F.col(text).cast("string")).mapInArrow(wh.trimmed(run), "shingle long, node long, place long")


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """The rows whose shingle stands in two rows at least, each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, tied, again = None, False, False  # the row before, whether it ties to the one before it or repeats it
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            shingle, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            same = shingle[1:] == shingle[:-1]
            left, repeat = np.append(tied, same), np.append(again, same & (node[1:] == node[:-1]))
            yield batch.take(pa.array(np.flatnonzero((left[:-1] | same) & ~repeat[:-1])))
            rest, tied, again = batch.slice(batch.num_rows - 1), bool(left[-1]), bool(repeat[-1])
        if rest is not None and tied and not again:
            yield rest

    tidy = rows.repartition("shingle").sortWithinPartitions("shingle", "node")
    return tidy.mapInArrow(wh.trimmed(run), "shingle long, node long, place long")


def tile_pairs(groups_of: Iterator[list[pa.Array]], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of a tile that pass all bounds. Columns: shingle, band, cell, node, place, root, home, part, bits."""
    for _, _, cell, nodes, place, root, home, part, bits in groups_of:
        nodes, place, root = nodes.to_numpy(), place.to_numpy(), root.to_numpy()
        if (root == root[0]).all():
            continue
        home, part = home.to_numpy(zero_copy_only=False), part.to_numpy()
        size, at = place >> 32, place & 0xFFFFFFFF
        maps = folded([np.frombuffer(b.as_buffer(), np.uint64) for b in bits])
        diagonal = (int(cell[0].as_py()) >> 20) == (int(cell[0].as_py()) & 0xFFFFF)
        for i in np.flatnonzero(home).tolist():
            j = np.flatnonzero((root != root[i]) & (~home | (np.arange(len(nodes)) > i)) & ((part == part[i]) == diagonal))
            need = least_overlap(size[i], size[j], percent)
            fits = np.minimum(size[i], size[j]) >= need
            fits &= 1 + np.minimum(size[i] - at[i], size[j] - at[j]) - 1 >= need
            j, need = j[fits], need[fits]
            j = j[size[i] + size[j] - np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64) >= 2 * need]
            for k in nodes[j].tolist():
                yield min(int(nodes[i]), k), max(int(nodes[i]), k)


def missed_links(docs: DataFrame, profile: DataFrame, roots: DataFrame | None, n_roots: int, text: str, n: int, percent: int, salt: int) -> DataFrame | None:
    """Step 2: a, b between components of step 1."""
    rows = shared_prefixes(prefixes(docs, text, n, percent, salt, sketch_of(profile)))
    nodes = profile.where("node is not null").groupBy("node").agg(F.first("bits").alias("bits"), F.first("n_shingles").alias("size"))
    # a node's row stands once for each slice of its prefix, whose rows know the size too
    slices = lambda size: F.ceil((size + 1 - F.ceil(percent * size / F.lit(100))) / F.lit(PREFIX_ROWS)).cast("int")
    sliced = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), slices(F.col("size")) - 1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("shingle"), slices(F.shiftrightunsigned("place", 32))).cast("int"))
    if roots is None:
        rows = rows.withColumn("root", F.col("node"))
    else:
        known = small(roots, n_roots) if n_roots <= BROADCAST_ROWS else sliced(roots.join(nodes.select("node", "size"), "node")).drop("size")
        rows = rows.join(known, ["node", "part"] if "part" in known.columns else "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = cut(rows.select("shingle", "node", "part", "place", "root"))
    mixed = cut(rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("shingle", "n"))
    if not (n_mixed := mixed.count()):
        return None
    rows = rows.join(small(mixed, n_mixed), "shingle")
    # 10 MB at most are broadcast; a join by node also leaves equal bitmaps side by side, which the next shuffle packs well
    n_bytes = nodes.agg(F.sum(F.length("bits") + 100)).first()[0] or 0
    if n_bytes // 20 <= BROADCAST_ROWS:
        rows = rows.drop("part").join(F.broadcast(nodes.drop("size")), "node")
    else:
        rows = rows.join(sliced(nodes).drop("size"), ["node", "part"]).drop("part")
    # bands a little wider than the ratio of sizes that can link: such sizes lie in one band or in adjacent ones
    band = F.floor(F.log(F.shiftrightunsigned("place", 32).cast("double")) / float(np.log(100 / percent) * 1.0001)).cast("int")
    parts = F.ceil(F.col("n") / (4 * TILE)).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.withColumn("home", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("band", band + F.when(F.col("home"), 0).otherwise(1))
    cell = F.least("part", "other").cast("long") * (1 << 20) + F.greatest("part", "other")
    rows = rows.select("shingle", "band", cell.alias("cell"), "node", "place", "root", "home", "part", "bits")
    rows = rows.repartition("shingle", "band", "cell").sortWithinPartitions("shingle", "band", "cell")
    pairs = cut(rows.mapInArrow(wh.trimmed(lambda batches: pairs_out(tile_pairs(groups(batches, 3), percent))), "a long, b long").distinct())
    if not (n_pairs := pairs.count()):
        return None
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = sets_of(docs, text, n, salt, False).join(small(wanted, 2 * n_pairs), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))
    sets = cut(sets)
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(overlap(x, y) >= least_overlap(len(x), len(y), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(wh.trimmed(verify), "a long, b long")


def linked(docs: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node of each row; rows of one component have one node, rows without words none."""
    salt = 0
    while True:
        profile = cut(profiles(docs, text, n, salt))
        texts = profile.where("slice is null")
        clash = texts.where("node is not null").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low < high").limit(1)
        if clash.isEmpty():
            break
        salt += 1  # two sets have one hash: take other hashes
    links = cut(near_links(docs, texts, text, n, percent, salt))
    roots, n_roots = None, 0
    if not links.isEmpty():
        roots = components(links, "a", "b")
        n_roots = roots.count()
    more = missed_links(docs, profile, roots, n_roots, text, n, percent, salt)
    if more is not None and not (more := cut(more)).isEmpty():
        roots = components(links.union(more), "a", "b")
    texts = texts.select("doc_id", "text_hash", "n_shingles", "node")
    if roots is not None:
        texts = texts.join(small(roots, 2 * n_roots + 1_000), "node", "left").withColumn("node", F.coalesce("root", "node")).drop("root")
    return texts


def classes(docs: DataFrame, text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that is reached by links, itself included."""
    texts = linked(docs, text, n, percent)
    texts = cut(texts)
    least = cut(texts.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")))
    return with_groups(texts, least, "node").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def surplus(docs: DataFrame, text: str = "text", n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(doc_id, nc_hash) of rows beside the first of their component, and of components' first rows that are repeated whole.

    First is the least doc_id, null last, then the least hash of the text.
    """
    texts = linked(docs, text, n, percent).where("node is not null")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    rows = cut(texts.groupBy("node", "doc_id", "text_hash").agg(F.count("*").alias("n")))
    first = cut(rows.groupBy("node").agg(F.min(order).alias("first"), F.count("*").alias("size")))
    marked = with_groups(rows, first, "node").select("doc_id", F.col("text_hash").alias("nc_hash"), "n", order.eqNullSafe(F.col("first")).alias("stays"))
    return marked.where("not stays").select("doc_id", "nc_hash"), marked.where("stays and n > 1").select("doc_id", "nc_hash")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), n=4, percent=85)


#: All pairs of distinct sets that share a shingle, and components by repeated joins: for small tables.
SQL = r"""
WITH RECURSIVE low AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
sized AS (SELECT r, w, least(4, len(w)) AS n FROM low WHERE len(w) > 0),
shingles AS (SELECT DISTINCT r, array_to_string(w[i:i + n - 1], ' ') AS shingle FROM sized, unnest(range(1, len(w) - n + 2)) t(i)),
sets AS (SELECT r, count(*) AS n_shingles, list(shingle ORDER BY shingle) AS shingles FROM shingles GROUP BY r),
classes AS (SELECT min(r) AS node, any_value(n_shingles) AS n, shingles FROM sets GROUP BY shingles),
member AS (SELECT r, node FROM sets JOIN classes USING (shingles)),
flat AS (SELECT node, n, unnest(shingles) AS shingle FROM classes),
met AS (SELECT x.node AS a, y.node AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS same
  FROM flat x JOIN flat y ON x.shingle = y.shingle AND x.node < y.node GROUP BY x.node, y.node),
links AS (SELECT a, b FROM met WHERE 100 * same >= 85 * (na + nb - same)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node AS start, node AS b FROM classes UNION SELECT start, l.b FROM reach JOIN both_ways l ON l.a = reach.b),
least AS (SELECT start AS node, min(doc_id) AS component_id FROM reach JOIN member ON member.node = reach.b JOIN low USING (r) GROUP BY start)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM low LEFT JOIN sets USING (r) LEFT JOIN member USING (r) LEFT JOIN least USING (node)
"""
