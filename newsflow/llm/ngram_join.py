"""N-gram Jaccard self-join: MinHash banding for candidates, full n-gram sets for the verdict.

Texts are sets of 5-word n-grams (words `[^\\x20\\x09-\\x0D]+`, A-Z lowered); a shorter text is one n-gram.
1. A map sketches every text: a hash of its set (equal sets are one node, however many copies) and `bands`
   hashes of `rows` minima each. `plan` picks rows and bands for the wanted recall at the threshold.
2. Band hashes are shuffled. A bucket never expands to pairs: each of its nodes is linked to the bucket's least
   node (map-side minimum, then a join), and components of these links are the candidate families.
3. Texts of families are fetched once and verified on full sets. A family of up to BLOCK nodes and BLOCK_GRAMS n-grams is one
   task. A larger one is cut into cells: nodes that reach the same least node within 2**JUMPS links, at most a block at a time; a task
   gets two cells, and only cells with a common band meet. So a long chain costs in proportion to its length, and m near copies of
   each other, all of them links, m^2 / BLOCK^2 tasks. A task counts common n-grams by matrix products and returns, per node, the number
   of linked documents and the least node it is connected to: rows in proportion to the nodes, not to the pairs.
4. Verified links give the classes: connected components again.

Defined cases: texts without words (null, empty) are equal to each other and like no other text; equal texts under
one id or several are copies and count as links; a null id is reported as null and counts as the least id; an empty
table gives an empty result. Two different sets of equal 64-bit hash would count as copies (about 17 in 2.5e10 texts).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._session import forget, free_name, quoted, small_batches, written
from .graph import components

U = np.uint64
N, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: MinHash values that a text may cost.
HASHES = 80
#: Texts, and n-grams of them, that a task holds of one cell.
BLOCK, BLOCK_GRAMS = 1024, 2_000_000
#: Doublings of the links that a cell spans.
JUMPS = 4
NO_ID = -(2**63)


def plan(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, that is the fewest false candidates, which reach the recall with `hashes` values."""
    for rows in range(hashes, 0, -1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("more hashes are needed for this recall")


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the n-grams of each text, in text order, with repetitions."""
    h, b = T.words(texts, T.NON_SPACE)
    length = np.diff(b)
    count = np.where(length >= n, length - n + 1, np.minimum(length, 1))
    bounds = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], count) + np.repeat(b[:-1], count)
    size = np.repeat(np.minimum(length, n), count)
    out = h[at] if len(at) else np.zeros(0, U)
    for k in range(1, n):
        more = size > k
        out[more] = T.pair(out[more], h[at[more] + k])
    return T.mix(out + size.astype(U)), bounds


def _sets(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1]))) if len(h) else np.zeros(0, bool)
    return h[keep], np.searchsorted(text[keep], np.arange(len(bounds)))


def _node_ids(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Order-free hash of each set."""
    total = np.concatenate((np.zeros(1, U), np.cumsum(T.mix(h ^ U(0x5851F42D4C957F2D)), dtype=U)))
    return T.pair(total[bounds[1:]] - total[bounds[:-1]], np.diff(bounds).astype(U)).view(np.int64)


def _text_key(text: str) -> Column:
    """With the id it tells rows of different texts apart (64 bits)."""
    return F.xxhash64(F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")))


SKETCH = "doc_id bigint, key bigint, node bigint, grams bigint, bands array<bigint>"


def _sketch_task(n: int, bands: int, rows: int):
    rng = np.random.default_rng(11)
    multiply = (rng.integers(1, 2**32, bands * rows, dtype=np.uint32) | 1).astype(np.uint32)
    shift = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", 1 << 20):
                h, b = _sets(*shingles(part.column("text"), n))
                full = np.flatnonzero(np.diff(b))
                out = np.empty((len(full), bands), U)
                if len(full):
                    x = (h >> U(32)).astype(np.uint32)
                    low = h.astype(np.uint32)
                    for i in range(bands):
                        acc = np.full(len(full), U(i + 1))
                        for j in range(i * rows, (i + 1) * rows):
                            acc = T.pair(acc, np.minimum.reduceat((x ^ shift[j]) * multiply[j] + low * (multiply[j] ^ shift[j] | 1), b[:-1][full]).astype(U))
                        out[:, i] = acc
                offsets = np.zeros(part.num_rows + 1, np.int32)
                offsets[1:] = np.cumsum((np.diff(b) > 0) * bands)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(_node_ids(h, b)), pa.array(np.diff(b)), lists], ["doc_id", "key", "node", "grams", "bands"])

    return run


VERDICTS = "node bigint, links bigint, root bigint"


def _verified(node: np.ndarray, copies: np.ndarray, block: np.ndarray, h: np.ndarray, b: np.ndarray, threshold: float):
    """Per node the documents linked to it by this task's pairs, and its least connected node."""
    m = len(node)
    text = np.repeat(np.arange(m), np.diff(b))
    order = np.argsort(h, kind="stable")
    h, text = h[order], text[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((first, [len(h)])))
    shared = np.repeat(count > 1, count)
    column = np.repeat(np.cumsum(count > 1) - 1, count)[shared]
    text = text[shared]
    common = np.zeros((m, m), np.float32)
    width = 4096
    cut = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else 0) + width + 1, width))
    for i in range(len(cut) - 1):
        if cut[i + 1] > cut[i]:
            part = np.zeros((m, width), np.float32)
            part[text[cut[i] : cut[i + 1]], column[cut[i] : cut[i + 1]] - i * width] = 1
            common += part @ part.T
    n = np.diff(b).astype(np.float32)
    linked = common >= threshold * (n[:, None] + n[None, :] - common) - 1e-4
    np.fill_diagonal(linked, False)
    if block.min() != block.max():
        linked &= block[:, None] != block[None, :]
    links = linked @ copies
    root = node.copy()
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == root).all():
            return links, root
        root = least


def _verify_task(n: int, threshold: float):
    names = [x.split()[0] for x in VERDICTS.split(", ")]

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        h, b = _sets(*shingles(t.column("text"), n))
        node = t.column("node").to_numpy()
        # A repeated id may have fetched another text: only the text of the node counts, once.
        right = np.flatnonzero(_node_ids(h, b) == node)
        keep = right[np.unique(node[right], return_index=True)[1]]
        size = np.diff(b)[keep]
        rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(b[:-1][keep], size)
        bounds = np.concatenate(([0], np.cumsum(size)))
        block = t.column("block").to_numpy()[keep]
        links, root = _verified(node[keep], t.column("copies").to_numpy()[keep], block, h[rows], bounds, threshold)
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(links.astype(np.int64)), pa.array(root)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("low", "high")]
            if not batch.num_rows:
                continue
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            edges = [0, *new.tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(k[a] for k in keys)
                if key != now and held:
                    yield solve(held)
                    held = []
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            yield solve(held)

    return run


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least id of its connected texts), text_class (least id of the
    same n-gram set), n_links (other documents of at least the threshold), class_size."""
    sketch, known = _classes(docs, text, doc_id, n, threshold, recall)
    classes = known.groupBy("component").agg(F.min("text_class").alias("class_id"), F.sum("copies").alias("class_size"))
    final = known.join(classes, "component").select("node", "class_id", "text_class", (F.col("links") + F.col("copies") - 1).alias("n_links"), "class_size")
    out = sketch.select("doc_id", "node").join(final, "node")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(real("doc_id"), real("class_id"), real("text_class"), "n_links", "class_size")


def _cells(large: DataFrame, star: DataFrame, bucket: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, cell) of the nodes of large families, and the pairs (low, high) of cells that have a band in common."""
    home = written(large.join(star.groupBy("node").agg(F.min("root").alias("home")), "node", "left").select("node", "grams", F.least("node", "home").alias("home")), "join-homes")
    for _ in range(JUMPS):
        after = home.select(F.col("node").alias("home"), F.col("home").alias("next"))
        before, home = home, written(home.join(after, "home").select("node", "grams", F.col("next").alias("home")), "join-homes")
        forget(before)
    parts = home.groupBy("home").agg(F.greatest(F.count("*") / BLOCK, F.sum("grams") / BLOCK_GRAMS).alias("blocks"))
    cells = home.join(parts, "home").select("node", F.xxhash64("home", F.pmod(F.hash("node"), F.ceil("blocks").cast("int"))).alias("cell"))
    cells = written(cells, "join-cells")
    held = written(bucket.join(cells, "node").select("band", "cell").distinct(), "join-held")
    pairs = held.select("band", F.col("cell").alias("low")).join(held.select("band", F.col("cell").alias("high")), "band").where("low <= high")
    return cells, written(pairs.select("low", "high").distinct(), "join-pairs")


def _tasks(nodes: DataFrame) -> DataFrame:
    """node, cell, low, high: what each verification, named by its pair of cells, gets to see."""
    bucket = nodes.select("node", F.explode("bands").alias("band"))
    least = bucket.groupBy("band").agg(F.min("node").alias("root"), F.count("*").alias("size")).where("size > 1")
    star = written(bucket.join(least, "band").where("node <> root").select("node", "root", "band"), "join-star")
    links = star.select("node", "root").distinct()
    family = components(links, "node", "root").withColumnRenamed("component", "family").join(nodes.select("node", "grams"), "node")
    size = family.groupBy("family").agg(F.count("*").alias("m"), F.sum("grams").alias("g"))
    sized = written(family.join(size, "family").withColumn("large", (F.col("m") > BLOCK) | (F.col("g") > 2 * BLOCK_GRAMS)), "join-families")
    small = sized.where("not large").select("node", F.col("family").alias("cell"), F.col("family").alias("low"), F.col("family").alias("high"))
    large = sized.where("large").select("node", "grams")
    if large.isEmpty():
        return small
    shared = star.select("node", "band").union(star.select(F.col("root").alias("node"), "band")).distinct()
    cells, pairs = _cells(large, links, shared)
    met = pairs.select(F.col("low").alias("cell"), "low", "high").union(pairs.where("low < high").select(F.col("high").alias("cell"), "low", "high"))
    return small.union(cells.join(met, "cell").select("node", "cell", "low", "high"))


def _classes(docs: DataFrame, text: str, doc_id: str, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The written sketch of every row, and for each node its least id and this row's text key, its copies, links and component."""
    spark = docs.sparkSession
    small_batches(spark)
    bands, rows = plan(threshold, recall)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col(quoted(doc_id)).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), _text_key(text).alias("key"), F.col(quoted(text)).alias("text"))
    sketch = written(texts.mapInArrow(_sketch_task(n, bands, rows), SKETCH), "join-sketch")
    grouped = sketch.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("least"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    nodes = written(grouped.select("node", F.col("least.doc_id").alias("text_class"), F.col("least.key").alias("key"), "copies", "grams", "bands"), "join-nodes")
    todo = written(_tasks(nodes), "join-tasks")
    # By id and text: another text under a repeated id is not fetched, and copies of a row only once.
    wanted = nodes.join(todo.select("node").distinct(), "node", "left_semi").select("node", F.col("text_class").alias("doc_id"), "key", "copies")
    one = texts.join(wanted, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("node", "copies", "text")
    fetched = one.join(todo.withColumnRenamed("cell", "block"), "node")
    tasks = fetched.select("low", "high", "block", "node", "copies", "text").repartition(parts, "low", "high").sortWithinPartitions("low", "high")
    verdicts = written(tasks.mapInArrow(_verify_task(n, threshold), VERDICTS), "join-verdicts")
    linked = components(verdicts.where("root <> node"), "node", "root")
    links = verdicts.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "text_class", "key", "copies").join(linked, "node", "left").join(links, "node", "left")
    known = written(known.select("node", "text_class", "key", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "join-known")
    forget(nodes, todo, verdicts)
    return sketch, known


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one row of each class: that of the least id (ids are whole numbers), and of texts under this id that of the least key. Ids may repeat and be null:
    different texts under one id are documents of their own; of rows with one id and one text any one stays."""
    mine, least = free_name("_id", docs.columns), free_name("_keep", docs.columns)
    key, kept_key = free_name("_key", docs.columns), free_name("_keep_key", docs.columns)
    _, known = _classes(docs, text, doc_id, n, threshold, recall)
    keep = known.groupBy("component").agg(F.min(F.struct("text_class", "key")).alias("least")).select(F.col("least.text_class").alias(least), F.col("least.key").alias(kept_key))
    rows = docs.withColumn(mine, F.coalesce(F.col(quoted(doc_id)).cast("bigint"), F.lit(NO_ID))).withColumn(key, _text_key(text))
    kept = rows.join(keep, (F.col(mine) == F.col(least)) & (F.col(key) == F.col(kept_key)), "left_semi")
    return kept.dropDuplicates([mine, key]).select(*map(quoted, docs.columns))
