"""Near duplicates by an LSH forest of MinHash signatures, confirmed on whole shingle sets.

Each tree orders the signatures by hash values of its own. Documents whose order begins with
the same values are a region. A small region is compared whole; a large one is first cut by the
next value (so dense places get deeper prefixes), and its members are compared with their
neighbours in the order, which share the longest prefix, and with the members nearest to its most
common values. Candidates by signature are confirmed on the full sets. Then the large regions, and
those cut by partitions, that links have not joined yet are compared whole, block by block over many
tasks, which count full sets themselves and give links only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.llm import texts as tx
from hostweave.llm.components import components
from hostweave.llm.tables import only, set_aside, written

SHINGLE = 5
#: Percent of the union that two sets must share.
LINKED = 75
#: Trees; values a region starts with; values in an order; hash functions.
TREES, PREFIX, DEPTH, HASHES = 16, 3, 8, 64
#: A region up to this size is compared whole.
REGION = 64
#: Neighbours in order and central members that each member of a larger region is compared with.
NEIGHBOURS, CENTRES = 2, 3
#: Bytes of a block, about, when what is apart in larger regions is compared whole.
BLOCK_BYTES = 8 << 20
#: Least share of equal signature bytes of a candidate: linked pairs fall below once in 10**5.
CANDIDATE = 0.52
MIX = np.uint64(0x9E3779B97F4A7C15)


def multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(20_240_607).integers(1 << 63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


def lowered(texts: pa.StringArray) -> pa.StringArray:
    """A-Z in lower case, everything else as it is."""
    raw, offsets = tx.buffer_of(texts)
    return tx.from_buffer(raw + ((raw >= 0x41) & (raw <= 0x5A)) * np.uint8(0x20), offsets)


def shingle_sets(texts: pa.StringArray) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct five-word shingles, A-Z in lower case.

    Fewer words are one shingle; no word, none.
    """
    words, bounds = tx.words(lowered(texts))
    code, distinct = tx.codes(words)
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))
    word = names[code]
    whole = np.zeros(max(0, len(word) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        whole = mixed(whole ^ word[j : j + len(whole)])
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - begin >= SHINGLE:
            yield np.unique(whole[begin : end - SHINGLE + 1])
        else:
            short = np.full(min(1, end - begin), end - begin, np.uint64)
            for w in word[begin:end]:
                short = mixed(short ^ w)
            yield short


def signature(shingles: np.ndarray, multiplier: np.ndarray) -> np.ndarray:
    """Least upper half of each product: HASHES 32-bit values."""
    least = np.full(len(multiplier), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * multiplier).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def with_signatures(documents: DataFrame) -> DataFrame:
    """doc_id, _text (a hash), n_shingles, two fingerprints of the set, signature."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multiplier = multipliers(HASHES)
        for batch in tx.sliced(batches, "text"):
            count, one, two, signs = [], [], [], []
            for shingles in shingle_sets(tx.strings(batch.column("text"))):
                count.append(len(shingles))
                one.append(int(np.bitwise_xor.reduce(mixed(shingles)).view(np.int64)))
                two.append(int((mixed(shingles ^ MIX)).sum(dtype=np.uint64).view(np.int64)))
                signs.append(signature(shingles, multiplier).astype(">u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_text"), pa.array(count, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.array(signs, pa.binary())],
                ["doc_id", "_text", "n_shingles", "_one", "_two", "_sign"],
            )

    rows = only(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_text"), "text")
    return rows.mapInArrow(sign, "doc_id long, _text long, n_shingles long, _one long, _two long, _sign binary")


def _tree_functions(tree: int) -> list[int]:
    own = [tree * PREFIX + j for j in range(PREFIX)]
    spare = HASHES - TREES * PREFIX
    return own + [TREES * PREFIX + (tree + 5 * j) % spare for j in range(DEPTH - PREFIX)]


def _sketches(classes: DataFrame) -> DataFrame:
    """node, n_shingles and the low bytes of the whole signature."""

    def low(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column("_sign").to_pylist()), ">u4").reshape(-1, HASHES)
            sketch = _fixed((signs & 0xFF).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n_shingles"), sketch], ["node", "n_shingles", "sketch"])

    return classes.select("node", "n_shingles", "_sign").mapInArrow(low, "node long, n_shingles long, sketch binary")


TREE = "tree int, key binary, node long, n_shingles long, sketch binary"


def _trees(classes: DataFrame) -> DataFrame:
    """A row per class and tree: its order's values, and the low bytes of its whole signature."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column("_sign").to_pylist()), ">u4").reshape(-1, HASHES)
            sketch = _fixed((signs & 0xFF).astype(np.uint8))
            for tree in range(TREES):
                key = _fixed(np.ascontiguousarray(signs[:, _tree_functions(tree)]).view(np.uint8).reshape(len(signs), 4 * DEPTH))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(signs), tree, np.int32)), key, batch.column("node"), batch.column("n_shingles"), sketch],
                    ["tree", "key", "node", "n_shingles", "sketch"],
                )

    return classes.select("node", "n_shingles", "_sign").mapInArrow(spread, TREE)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Equally long byte strings, a row each."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


class _Run:
    """Rows of one region in order."""

    def __init__(self, key: np.ndarray, node: np.ndarray, size: np.ndarray, sketch: np.ndarray):
        self.key, self.node, self.size, self.sketch = key, node, size, sketch

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs that may be linked, by size and signature."""
        low, high = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        able = (100 * low >= LINKED * high) & (self.node[a] != self.node[b])
        a, b = a[able], b[able]
        alike = (self.sketch[a] == self.sketch[b]).mean(axis=1)
        able = alike >= CANDIDATE
        a, b = a[able], b[able]
        return np.minimum(self.node[a], self.node[b]), np.maximum(self.node[a], self.node[b]), alike[able]

    def centres(self, begin: int, end: int) -> np.ndarray:
        """Members that agree most with the most common byte at each place of the signature."""
        part = self.sketch[begin:end]
        common = np.array([np.bincount(c, minlength=256).argmax() for c in part.T], np.uint8)
        score = (part == common).sum(axis=1)
        return begin + np.argsort(-score, kind="stable")[:CENTRES]

    def candidates(self, begin: int, end: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs within rows begin to end, which share their first ``depth`` values."""
        if end - begin <= REGION:
            a, b = np.triu_indices(end - begin, 1)
            yield self.pairs(begin + a, begin + b)
            return
        rows = np.arange(begin, end)
        for step in range(1, NEIGHBOURS + 1) if depth == PREFIX else ():  # those of a deeper part are among them
            yield self.pairs(rows[:-step], rows[step:])
        for centre in self.centres(begin, end):
            yield self.pairs(np.full(len(rows), centre), rows)
        if depth < DEPTH:
            value = self.key[begin:end, 4 * depth : 4 * depth + 4]
            cuts = begin + 1 + np.flatnonzero((value[1:] != value[:-1]).any(axis=1))
            for low, high in zip([begin, *cuts], [*cuts, end], strict=True):
                if high - low > 1:
                    yield from self.candidates(low, high, depth + 1)


FOUND = "a long, b long, alike double, " + TREE


def _compare(sorted_rows: DataFrame) -> DataFrame:
    """Candidate pairs of ordered rows; of regions at a partition's edge also the central members,
    and of regions that are not compared whole a row without a node.

    A region cut by partitions is compared in parts; what its central members yield among
    themselves joins most of the parts early, before ``candidates_apart`` compares it whole.
    """

    def found(pairs: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        n = len(pairs[0])
        return pa.RecordBatch.from_arrays(
            [pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64()), pa.array(pairs[2], pa.float64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
             pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
            ["a", "b", "alike", "tree", "key", "node", "n_shingles", "sketch"],
        )

    def joined(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        pairs = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else []
        if pairs:  # a pair that neighbours, centres and parts found is one
            order = np.lexsort((pairs[1], pairs[0]))
            a, b = pairs[0][order], pairs[1][order]
            first = np.ones(len(a), bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            pairs = [x[order][first] for x in pairs]
        for at in range(0, len(pairs[0]) if parts else 0, 1 << 16):
            yield found(tuple(x[at : at + (1 << 16)] for x in pairs))

    def work(rows: pa.Table, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        n = rows.num_rows
        key = np.frombuffer(b"".join(rows["key"].to_pylist()), np.uint8).reshape(n, 4 * DEPTH)
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(n, HASHES)
        tree = rows["tree"].to_numpy()
        run = _Run(key, rows["node"].to_numpy(), rows["n_shingles"].to_numpy(), sketch)
        prefix = key[:, : 4 * PREFIX]
        cuts = 1 + np.flatnonzero((prefix[1:] != prefix[:-1]).any(axis=1) | (tree[1:] != tree[:-1]))
        begin, end = np.concatenate(([0], cuts)), np.concatenate((cuts, [n]))
        two = begin[end - begin == 2]
        parts = [run.pairs(two, two + 1)] if len(two) else []
        for low, high in zip(begin[end - begin > 2].tolist(), end[end - begin > 2].tolist(), strict=True):
            parts += run.candidates(low, high, PREFIX)
        yield from joined(parts)
        large = begin[end - begin > REGION]
        if k := len(large):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.array(tree[large]), _fixed(key[large]),
                 pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())],
                ["a", "b", "alike", "tree", "key", "node", "n_shingles", "sketch"],
            )
        for low, high in edges(begin, end, first, last):
            chosen = pa.array(run.centres(low, high))
            part = rows.take(chosen).combine_chunks().to_batches()[0]
            k = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), *part.columns],
                ["a", "b", "alike", *part.schema.names],
            )

    def edges(begin: np.ndarray, end: np.ndarray, first: bool, last: bool) -> list[tuple[int, int]]:
        return sorted({(int(begin[i]), int(end[i])) for i, own in ((0, first), (-1, last)) if own})

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            region = (batch.column("tree")[-1].as_py(), batch.column("key")[-1].as_py()[: 4 * PREFIX])
            same = batch.num_rows
            while same and (batch.column("tree")[same - 1].as_py(), batch.column("key")[same - 1].as_py()[: 4 * PREFIX]) == region:
                same -= 1  # the last region may go on in the next batch
            if same:
                yield from work(pa.Table.from_batches([*held, batch.slice(0, same)]), first, False)
                held, first = [batch.slice(same)], False
            elif held and (held[-1].column("tree")[-1].as_py(), held[-1].column("key")[-1].as_py()[: 4 * PREFIX]) != region:
                yield from work(pa.Table.from_batches(held), first, False)
                held, first = [batch], False
            else:
                held.append(batch)
        if held:
            yield from work(pa.Table.from_batches(held), first, True)
        held.clear()
        tx.give_back()

    return sorted_rows.mapInArrow(compare, FOUND)


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b, alike) of classes (node, n_shingles, _sign), each once; and the
    regions (tree, prefix) whose pairs are not all among them."""
    order = ["tree", "key", "node"]
    found = written(_compare(_trees(classes).repartitionByRange(*order).sortWithinPartitions(*order)), "forest")
    cut = found.where("a IS NULL AND node IS NOT NULL").select("tree", "key", "node", "n_shingles", "sketch").distinct()
    prefix = F.substring("key", 1, 4 * PREFIX)
    again = _compare(cut.repartition("tree", prefix).sortWithinPartitions(*order))
    pairs = found.select("a", "b", "alike").unionByName(again.select("a", "b", "alike")).where("a IS NOT NULL")
    # Large ones, and those that a partition's edge may have cut.
    wide = found.where("a IS NULL").select("tree", prefix.alias("prefix")).distinct()
    return written(pairs.groupBy("a", "b").agg(F.max("alike").alias("alike")), "candidates"), written(wide, "regions")


def areas_apart(classes: DataFrame, label: DataFrame, wide: DataFrame) -> DataFrame:
    """area, node and component of all classes in wide regions that hold more than one component.

    Regions of any trees that share a class are one area, so its pairs are looked at once.
    """
    component = F.coalesce("component", "node").alias("component")
    trees = _trees(classes).select("tree", F.substring("key", 1, 4 * PREFIX).alias("prefix"), "node")
    regions = written(wide.select("tree", "prefix", (F.lit(-1) - F.monotonically_increasing_id()).alias("region")), "wide-regions")
    rows = written(trees.join(regions, ["tree", "prefix"]).join(label, "node", "left").select("region", "node", component), "wide-rows")
    several = rows.groupBy("region").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high")
    apart = written(rows.join(several.select("region"), "region"), "wide-apart")
    if apart.isEmpty():
        return apart.select(F.col("region").alias("area"), "node", "component")
    joined = components(apart.select(F.col("node").alias("a"), F.col("region").alias("b"))).select("node", F.col("component").alias("area"))
    return apart.select("node", "component").distinct().join(joined, "node").select("area", "node", "component")


def _joined(root: dict[int, int], x: int) -> int:
    while root.get(x, x) != x:
        root[x] = root.get(root[x], root[x])
        x = root[x]
    return x


def _links_of_cell(rows: pa.Table) -> pa.Table:
    """Links between components, counted on full sets, of a cell's two blocks, or of its one: as many
    as join what the cell can join, whatever number of pairs is alike."""
    rows = rows.combine_chunks()
    low, i, j, mixed_sizes = (rows[c][0].as_py() for c in ("low", "i", "j", "next"))
    size_class, block = rows["size_class"].to_numpy(), rows["block"].to_numpy()
    node, size, component = (rows[c].to_numpy() for c in ("node", "n_shingles", "component"))
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(rows.num_rows, HASHES)
    sets = rows["shingles"].chunk(0) if rows.num_rows else None
    at = sets.offsets.to_numpy().astype(np.int64) if rows.num_rows else np.zeros(1, np.int64)
    names, code = np.unique(sets.values.to_numpy(), return_inverse=True)
    one = np.flatnonzero((size_class == low) & (block == i))
    other = np.flatnonzero((size_class == low + mixed_sizes) & (block == j))
    same, held, root, links = not mixed_sizes and i == j, np.zeros(len(names), bool), {}, []
    for x in one.tolist() if len(other) else ():
        near = other[(component[other] != component[x]) & (100 * np.minimum(size[other], size[x]) >= LINKED * np.maximum(size[other], size[x]))]
        near = near[near > x] if same else near
        near = near[np.count_nonzero(sketch[near] == sketch[x], axis=1) >= CANDIDATE * HASHES]
        here = _joined(root, int(component[x]))
        near = near[[_joined(root, c) != here for c in component[near].tolist()]] if len(near) else near
        if not len(near):
            continue
        own = code[at[x] : at[x + 1]]
        held[own] = True
        length = at[near + 1] - at[near]
        shared = np.add.reduceat(held[code[tx.spread(at[near], length)]].astype(np.int64), np.cumsum(length) - length)
        held[own] = False
        for y in near[100 * shared >= LINKED * (size[x] + size[near] - shared)].tolist():
            mine, its = _joined(root, int(component[x])), _joined(root, int(component[y]))
            if mine != its:
                root[its] = mine
                links.append((min(node[x], node[y]), max(node[x], node[y])))
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def links_apart(rows: DataFrame) -> DataFrame:
    """Links (a < b) that join the components of each area (area, node, component, n_shingles, sketch, shingles).

    Linked sets differ in size by a third at most. An area's classes are dealt by size, and those of
    a size into blocks of bounded bytes; blocks that can hold a link meet in a task. No pair leaves
    it that is not a link, and of links only those that join something.
    """
    size_class = F.floor(F.log("n_shingles") / F.log(F.lit(100 / LINKED))).cast("int")
    rows = written(rows.withColumn("size_class", size_class), "area-rows")
    weight = F.sum(8 * F.col("n_shingles") + 512)
    blocks = written(rows.groupBy("area", "size_class").agg(F.ceil(weight / BLOCK_BYTES).cast("int").alias("_own")), "area-blocks")
    above = blocks.select("area", (F.col("size_class") - 1).alias("size_class"), F.col("_own").alias("_above"))
    below = blocks.select("area", (F.col("size_class") + 1).alias("size_class"), F.col("_own").alias("_below"))
    blocks = blocks.join(above, ["area", "size_class"], "left").join(below, ["area", "size_class"], "left")
    dealt = rows.join(blocks, ["area", "size_class"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_own")).cast("int"))
    c, k = F.col("size_class"), F.col("block")

    def cells(count: Column, cell) -> Column:
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), cell)).otherwise(F.array())

    def cell(low: Column, i: Column, j: Column, further: int) -> Column:
        return F.struct(low.alias("low"), i.alias("i"), j.alias("j"), F.lit(further).alias("next"))

    kind = "array<struct<low:int,i:int,j:int,next:int>>"
    every = F.concat(
        cells(F.col("_own"), lambda j: cell(c, F.least(k, j), F.greatest(k, j), 0)).cast(kind),
        cells(F.coalesce("_above", F.lit(0)), lambda j: cell(c, k, j, 1)).cast(kind),
        cells(F.coalesce("_below", F.lit(0)), lambda i: cell(c - 1, i, k, 1)).cast(kind),
    )
    met = dealt.withColumn("_cell", F.explode(every)).select(
        "area", "_cell.*", "size_class", "block", "node", "component", "n_shingles", "sketch", "shingles"
    )
    return met.groupBy("area", "low", "i", "j", "next").applyInArrow(_links_of_cell, "a long, b long")


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of wanted classes (node, doc_id, _text), from the texts."""

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.sliced(batches, "text"):
            sets = list(shingle_sets(tx.strings(batch.column("text"))))
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends), flat)], ["node", "shingles"])

    rows = only(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    same = F.col("_hash") == F.col("_text"), F.col("_id").eqNullSafe(F.col("doc_id"))
    return rows.join(wanted, same[0] & same[1]).select("node", "text").mapInArrow(collect, "node long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets share enough of their union."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    linked = 100 * shared >= LINKED * (F.size("_a") + F.size("_b") - shared)
    return pairs.select("a", "b").join(b, "b").join(a, "a").where(linked).select("a", "b").distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Every document's doc_id, _text (hash of its text), n_shingles, component_id and kept.

    A document's set holds its distinct five-word shingles, A-Z in lower case; with fewer words
    the whole sequence is one. Two are linked if they share at least ``LINKED`` percent of their
    union. component_id is the smallest doc_id that links lead to; kept says it is the document's
    own. Documents without words (null and empty texts) are linked with nothing. A null doc_id is
    never the smallest unless all of its component are null: then component_id is null, and the
    document kept. Repeated rows are equal sets, so one class, and get equal results.

    Equal sets are one class, so copies are compared once. First each class is confirmed against
    its likeliest candidate, then whatever candidates still lie in different components, and last
    the large regions, and those cut by partitions, are compared whole in tasks that give only links
    between different components. That work grows with the square of the different texts in a
    region of several components; what is shuffled and stored for it does not grow with pairs.
    """
    signed = written(with_signatures(documents), "signatures")
    alike = ["_one", "_two", "n_shingles"]
    rep = F.min(F.struct("doc_id", "_text")).alias("_rep")
    classes = signed.where("n_shingles > 0").groupBy(*alike).agg(F.min("doc_id").alias("_least"), rep, F.first("_sign").alias("_sign"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    pairs, wide = candidates(classes)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = classes.join(ends, "node").select("node", "_rep.doc_id", "_rep._text")
    sets = written(_sets(documents, wanted).dropDuplicates(["node"]), "sets")

    each = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "alike"))
    likeliest = each.groupBy("a").agg(F.max(F.struct("alike", F.negative("b").alias("_b"))).alias("_best"))
    other = F.negative("_best._b")
    tried = likeliest.select(F.least("a", other).alias("a"), F.greatest("a", other).alias("b")).distinct()
    first = written(_confirmed(tried, sets), "links")
    label = components(first)
    apart = (
        pairs.join(tried, ["a", "b"], "left_anti")
        .join(label.select(F.col("node").alias("a"), F.col("component").alias("_ca")), "a", "left")
        .join(label.select(F.col("node").alias("b"), F.col("component").alias("_cb")), "b", "left")
        .where(F.coalesce("_ca", "a") != F.coalesce("_cb", "b"))
    )
    links = first.unionByName(written(_confirmed(apart, sets), "links"))
    label = components(links)
    apart = written(areas_apart(classes, label, wide), "areas")
    if not apart.isEmpty():
        late = apart.select("node").join(ends, "node", "left_anti")
        wanted = classes.join(late, "node").select("node", "_rep.doc_id", "_rep._text")
        sets = sets.unionByName(written(_sets(documents, wanted).dropDuplicates(["node"]), "sets"))
        sketched = _sketches(classes).join(apart, "node").join(sets, "node")
        label = components(links.unionByName(written(links_apart(sketched), "links")))

    labeled = classes.select(*alike, "node", "_least").join(label, "node", "left").withColumn("_component", F.coalesce("component", "node"))
    smallest = labeled.groupBy("_component").agg(F.min("_least").alias("component_id"))
    by_class = labeled.join(smallest, "_component").select(*alike, "component_id")
    return (
        signed.drop("_sign")
        .join(by_class, alike, "left")
        .withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id", "_text", "n_shingles", "component_id", "kept")
    )


def without_duplicates(documents: DataFrame) -> DataFrame:
    """One document of each component, with its own columns; of rows equal in doc_id and text, one."""
    verdicts = written(near_duplicates(documents), "duplicates")
    kept = verdicts.where("kept").groupBy(F.col("doc_id").alias("_id"), "_text").agg(F.count(F.lit(1)).alias("_n"))
    documents, names = set_aside(documents, "doc_id", "text")
    rows = documents.withColumn("_hash", F.xxhash64("text"))
    found = rows.join(kept, (F.col("_hash") == F.col("_text")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")))
    once = found.where("_n = 1").select(*documents.columns)
    repeated = found.where("_n > 1").dropDuplicates(["_id", "_text"]).select(*documents.columns)
    return once.unionByName(repeated).toDF(*names)
