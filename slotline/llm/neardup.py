"""Near-duplicate groups by a chosen-path set similarity join (operator 9).

A text's set is its distinct five-word shingles. Equal sets are one class from the start, so exact copies never meet.
Each class gets minwise values; tree t's root branches the classes by the t-th of them. A node that many classes share
is branched again by a few minwise positions drawn from the node's own path (about 1 / similarity of them, so a similar
pair is expected to share one child), on the cluster while the node is large and inside its task after that. Small nodes
are compared exhaustively on sketches; what comes near the threshold is connected, each absorbed class compared with the
ones still apart only, so a group of near copies costs one row a member. The groups found by all trees are merged, and
inside each merged group links are confirmed on full sets in the same way. Groups whose sets are too large for a task are
confirmed leaf by leaf instead. Sixteen independent roots miss a pair at similarity s with probability (1 - s)**16.

A large node may be one huge group of near copies, which branching would not shrink. So before it branches its members are
dealt to blocks, each with the node's pivot, and linked there on full sets; blocks meet in the pivot. A class that is in
several large nodes is linked in one. If all members of a node are connected then, it is done. If few are outside its
largest group, those go to every block of the others and are compared with all. Only a node with many groups left branches.

Defined results: null or empty text and text without words has no set, links with nothing and is kept; fewer words than
a shingle form one shingle; equal sets always link; repeated ids and null ids are rows of their own and the smallest
non-null id names the component (null if there is none); one row of each component is kept, one with that id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, U, Words, as_text, batches, materialize, mix, read, runs, trimmed

TREES, SKETCH, SHINGLE = 16, 128, 5
#: Members of a node compared exhaustively; members of a node that one task takes; shingles of a merged group that one takes.
LEAF, TASK, SETS = 1_500, 20_000, 8_000_000
#: Members of a large node linked in one block, and those outside its largest group that go to every block.
BLOCK = 2_000
MAX_DEPTH = 40
ROOT_FACTORS = mix(np.arange(1, TREES + 1, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)
SKETCH_FACTORS = (mix(np.arange(1, SKETCH + 1, dtype=U) * U(0xAEF17502108EF2D9)) >> U(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(words: Words, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    at, key = words.grams(n)
    edges = np.searchsorted(words.row[at], np.arange(words.rows + 1))
    first = np.searchsorted(words.row, np.arange(words.rows))
    out = []
    for row in range(words.rows):
        k = int(words.count[row])
        if k >= n:
            out.append(np.unique(key[edges[row] : edges[row + 1]]))
        elif k:
            h = words.hash[first[row] : first[row] + 1]
            for j in range(1, k):
                h = h * BASE + words.hash[first[row] + j]
            out.append(mix(h + U(k)))
        else:
            out.append(np.zeros(0, U))
    return out


def set_key(own: np.ndarray) -> str:
    return f"{int(mix(own).sum(dtype=U)):016x}{int(mix(own ^ BASE).sum(dtype=U)):016x}"


def minwise(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit minwise values for the tree roots and 16-bit digests of others for the sketch."""
    roots = np.full(TREES, ~U(0))
    low = np.full(SKETCH, np.uint32(0xFFFFFFFF))
    for at in range(0, len(own), 4096):
        part = own[at : at + 4096]
        roots = np.minimum(roots, np.multiply.outer(part, ROOT_FACTORS).min(0))
        low = np.minimum(low, np.multiply.outer((part >> U(32)).astype(np.uint32), SKETCH_FACTORS).min(0))
    return roots, ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def sketches(docs: DataFrame, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """doc_id, row, n_shingles, key (null without words), roots, sketch. ``row``: a key of each row (a new one if None)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, end, words in batches(part, fold=True):
                sets = shingle_sets(words, n)
                signs = [minwise(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).slice(row, end - row),
                        part.column(1).slice(row, end - row),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) if len(s) else None for s in sets], pa.string()),
                        pa.array([x and x[0].view(np.int64) for x in signs], pa.list_(pa.int64())),
                        pa.array([x and x[1].tobytes() for x in signs], pa.binary()),
                    ],
                    ["doc_id", "row", "n_shingles", "key", "roots", "sketch"],
                )

    row = F.monotonically_increasing_id() if row is None else row
    return docs.select(F.col(id_col).alias("doc_id"), row.alias("row"), as_text(docs, text_col).alias("text")).mapInArrow(trimmed(run), f"doc_id {kind}, row bigint, n_shingles bigint, key string, roots array<bigint>, sketch binary")


def joined_up(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Label of each of ``n`` members by connectivity under ``near(member, others)``; compares only with members still apart."""
    label, apart, k = np.full(n, -1), np.arange(n), 0
    while len(apart):
        queue, apart = [int(apart[0])], apart[1:]
        label[queue[0]] = k
        while queue and len(apart):
            hit = near(queue.pop(), apart)
            found, apart = apart[hit], apart[~hit]
            label[found] = k
            queue.extend(found.tolist())
        k += 1
    return label


def positions(path: int, similarity: float) -> np.ndarray:
    """Minwise positions that a node branches by: each with chance 1 / (similarity * SKETCH), from its path; one at least."""
    draw = mix(np.arange(SKETCH, dtype=U) + U(path & 0xFFFFFFFFFFFFFFFF)) >> U(11)
    got = np.flatnonzero(draw < U(int((1 << 53) / (similarity * SKETCH))))
    return got if len(got) else np.array([int(draw.argmin())])


def child(path: int, position: int, value: int) -> int:
    return int(mix(np.array([path ^ (position << 16 | value) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF], U))[0])


def leaves(path: int, sketch: np.ndarray, similarity: float, least: float, depth: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, members, labels) below a node: branch while it is large, then connect what the sketches put near."""
    todo = [(path & 0xFFFFFFFFFFFFFFFF, np.arange(len(sketch)), depth)]
    while todo:
        path, own, depth = todo.pop()
        if len(own) < 2:
            continue
        if len(own) <= LEAF or depth >= MAX_DEPTH:
            s = sketch[own]
            yield path, own, joined_up(len(own), lambda x, others, s=s: (s[others] == s[x]).sum(1) >= least * SKETCH)
            continue
        for p in positions(path, similarity):
            value = sketch[own, p]
            order = np.argsort(value, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
                if len(part) > 1:
                    todo.append((child(path, int(p), int(value[part[0]])), own[part], depth + 1))


def absorbed(large: DataFrame, exact: Callable[[DataFrame], DataFrame], last: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of large nodes (key, node, size): exact edges inside them, small nodes (key, node) that stand for those with few members
    outside the largest group, and the rows of the nodes that are to branch (none if ``last``)."""
    salt = lambda n: F.pmod(F.xxhash64("key"), n).alias("salt")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("salt")
    # near copies share many nodes: a member is linked in one of them, the largest
    home = materialize(large.groupBy("key").agg(F.max(F.struct("size", "node")).alias("h")).select("key", "h.node"))
    pivots = materialize(home.groupBy("node").agg(F.min_by("key", F.xxhash64("key", "node")).alias("pivot"), F.ceil(F.count("*") / BLOCK).cast("bigint").alias("n")))
    dealt = home.join(pivots, "node").select("key", "node", salt(F.col("n"))).unionByName(pivots.select(F.col("pivot").alias("key"), "node", everywhere(F.col("n"))))
    edges = materialize(exact(dealt.select("key", F.concat_ws(":", "node", "salt").alias("block")).distinct()))
    marked = materialize(large.join(connected(edges), "key", "left").select("key", "node", "size", F.coalesce("component", "key").alias("label")))
    top = marked.groupBy("node", "label").count().groupBy("node").agg(F.max_by("label", F.struct("count", "label")).alias("top"), F.max("count").alias("most"))
    parted = materialize(marked.join(top, "node").withColumn("apart", F.col("size") - F.col("most")).where("apart > 0"))
    # those apart go to every block of the others, in one chunk unless this is the last level; sketches find what is near
    rest = parted if last else parted.where(F.col("apart") <= BLOCK)
    n_blocks, chunks = (F.ceil(F.col(c) / BLOCK).cast("bigint") for c in ("size", "apart"))
    others = rest.where("label <> top").select("key", "node", everywhere(n_blocks), F.pmod(F.xxhash64("node", "key"), chunks).alias("chunk"))
    members = rest.select("key", "node", salt(n_blocks), F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("chunk"))
    small = members.unionByName(others).select("key", F.xxhash64("node", "salt", "chunk").alias("node")).distinct()
    return edges, materialize(small), parted.where(F.lit(False) if last else F.col("apart") > BLOCK).select("key", "node", "size")


def candidate_groups(classes: DataFrame, similarity: float, exact: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """key, head, leaf: each class that some leaf puts near others, with the smallest key of its group there; and edges (a, b)
    that ``exact`` (of groups: key, block) has confirmed inside large nodes."""
    least = similarity - 6 * (similarity * (1 - similarity) / SKETCH) ** 0.5
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rooted = classes.select("key", F.posexplode("roots").alias("tree", "value")).select("key", F.xxhash64("tree", "value").alias("node"))
    shared = rooted.groupBy("node").count().where("count > 1")
    nodes = materialize(rooted.join(shared, "node").select("key", "node", F.col("count").alias("size")))

    def branch(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            key, node = [], []
            for k, path, raw in zip(*(b.column(c).to_pylist() for c in ("key", "node", "sketch"))):
                s = np.frombuffer(raw, np.uint16)
                for p in positions(path, similarity):
                    key.append(k)
                    node.append(child(path & 0xFFFFFFFFFFFFFFFF, int(p), int(s[p])))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(np.array(node, U).view(np.int64), pa.int64())], ["key", "node"])

    depth, members, sure, large = 1, nodes.where(F.col("size") <= TASK).select("key", "node"), [], nodes.where(F.col("size") > TASK)
    while not large.isEmpty():
        edges, blocks, large = absorbed(large, exact, depth >= MAX_DEPTH)
        sure.append(edges)
        members = members.unionByName(blocks)
        below = materialize(large.join(classes.select("key", "sketch"), "key").select("key", "node", "sketch").mapInArrow(trimmed(branch), "key string, node bigint"))
        nodes = materialize(below.join(below.groupBy("node").count().where("count > 1"), "node").select("key", "node", F.col("count").alias("size")))
        depth += 1
        members = members.unionByName(nodes.where(F.col("size") <= TASK).select("key", "node"))
        large = nodes.where(F.col("size") > TASK)

    def compare(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches_, "node"):
            keys = np.array(group.column("key").to_pylist(), object)
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(-1, SKETCH)
            for leaf, own, label in leaves(group.column("node")[0].as_py(), sketch, similarity, least):
                order = np.lexsort((keys[own].astype(str), label))
                at = np.flatnonzero(np.concatenate([[True], np.diff(label[order]) != 0]))
                heads = keys[own][order[at]]
                size = np.bincount(label)
                keep = size[label] > 1
                if keep.any():
                    path = leaf & 0xFFFFFFFFFFFFFFFF
                    n = int(keep.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(keys[own][keep], pa.string()), pa.array(heads[label[keep]], pa.string()), pa.array(np.full(n, path, U).view(np.int64))], ["key", "head", "leaf"])

    dealt = members.join(classes.select("key", "sketch"), "key").select("node", "key", "sketch").repartition(parts, "node").sortWithinPartitions("node")
    return materialize(dealt.mapInArrow(trimmed(compare), "key string, head string, leaf bigint")), sure


def connected(edges: DataFrame) -> DataFrame:
    """key, component (smallest key reachable) of an (a, b) edge table: neighbours' least label, then the label's label."""
    both = materialize(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("component"))
    while True:
        labels = materialize(labels)
        near = both.join(labels.select(F.col("key").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near, labels["key"] == near["a"]).select("key", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        heads = lower.select(F.col("key").alias("h"), F.col("c").alias("top"))
        new = materialize(lower.join(heads, F.col("c") == F.col("h")).select("key", "was", F.col("top").alias("component")))
        labels = new.select("key", "component")
        if new.where("was <> component").isEmpty():
            return labels


def binary_numbers(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit numbers of a binary column end to end, not copied, and where each row's begin."""
    edges = np.frombuffer(items.buffers()[1], np.int32)[items.offset : items.offset + len(items) + 1].astype(np.int64)
    flat = np.frombuffer(items.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    return flat.view(U), (edges - edges[0]) // 8


def confirm(groups: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, n: int, id_col: str, text_col: str) -> DataFrame:
    """a, b edges (one for each member but a group's first) between classes that full sets link. ``groups``: key, block."""
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = groups.join(reps, "key").select("key", "block", "rep")
    own = docs.select(F.col(id_col).alias("rep"), as_text(docs, text_col).alias("text"))
    asked = wanted.select(F.col("rep").alias("_rep"), F.col("key").alias("_key")).distinct()
    found = own.join(asked, own["rep"].eqNullSafe(asked["_rep"])).select("_key", "text")

    def sets(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_:
            for row, end, words in batches(part, fold=True):
                got = [(k, s) for k, s in zip(part.column(0).slice(row, end - row).to_pylist(), shingle_sets(words, n)) if len(s) and set_key(s) == k]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([s.tobytes() for _, s in got], pa.binary())], ["key", "items"])

    full = found.mapInArrow(trimmed(sets), "key string, items binary")
    dealt = groups.join(full, "key").select("block", "key", "items").repartition(parts, "block").sortWithinPartitions("block", "key")

    def link(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches_, "block"):
            names = group.column("key").to_pylist()
            first = dict(zip(names, range(len(names))))  # a key may come from several rows
            keys, items = list(first), group.column("items").combine_chunks()
            if len(keys) < len(names):
                items = items.take(pa.array(list(first.values())))
            flat, edge = binary_numbers(items)
            del group
            size = np.diff(edge)
            # equal hashes get one number, by one sort in place of what np.unique holds
            order = np.argsort(flat)
            ids = np.empty(len(flat), np.int32)
            ids[order] = np.cumsum(np.diff(flat[order], prepend=flat[order[:1]]) != 0, dtype=np.int32)
            del order
            marked = np.zeros(int(ids.max()) + 1, bool)

            def near(x: int, others: np.ndarray) -> np.ndarray:
                fit = np.flatnonzero((100 * np.minimum(size[others], size[x]) >= percent * np.maximum(size[others], size[x])))
                hit = np.zeros(len(others), bool)
                if len(fit):
                    marked[ids[edge[x] : edge[x + 1]]] = True
                    o = others[fit]
                    flat = np.repeat(edge[o] - np.concatenate([[0], np.cumsum(size[o])[:-1]]), size[o]) + np.arange(size[o].sum())
                    both = np.add.reduceat(marked[ids[flat]].astype(np.int64), np.concatenate([[0], np.cumsum(size[o])[:-1]]))
                    hit[fit] = 100 * both >= percent * (size[o] + size[x] - both)
                    marked[ids[edge[x] : edge[x + 1]]] = False
                return hit

            label = joined_up(len(keys), near)
            head: dict[int, str] = {}
            a, b = [], []
            for k, x in zip(keys, label.tolist()):
                if x in head:
                    a.append(head[x])
                    b.append(k)
                else:
                    head[x] = k
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    return dealt.mapInArrow(trimmed(link), "a string, b string")


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return judged(docs, percent, shingle, id_col, text_col).drop("row")


def judged(docs: DataFrame, percent: int, shingle: int, id_col: str, text_col: str, row: Column | None = None) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept: one row of each component is kept, and every row without words."""
    rows = materialize(sketches(docs, shingle, id_col, text_col, row))
    worded = rows.where(F.col("key").isNotNull())
    # the smallest non-null id leads; its first row does if the id is repeated or all are null
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    leads = materialize(worded.groupBy("key").agg(lead.alias("lead")))
    reps = leads.select("key", F.col("lead.doc_id").alias("rep"))
    classes = worded.groupBy("key").agg(F.first("roots").alias("roots"), F.first("sketch").alias("sketch"))
    exact = lambda groups: confirm(groups, reps, docs, percent, shingle, id_col, text_col)
    found, sure = candidate_groups(classes, percent / 100, exact)
    near = found.select(F.col("key").alias("a"), F.col("head").alias("b"))
    for edges in sure:
        near = near.unionByName(edges)
    sizes = worded.groupBy("key").agg(F.first("n_shingles").alias("n"))
    merged = materialize(connected(near).join(sizes, "key"))
    sized = materialize(merged.join(merged.groupBy("component").agg(F.sum("n").alias("total")), "component"))
    blocks = sized.where(F.col("total") <= SETS).select("key", F.col("component").alias("block"))
    large = sized.where(F.col("total") > SETS)
    split = bool(sure) or not large.isEmpty()
    if split:
        blocks = blocks.unionByName(found.join(large, "key", "left_semi").select("key", F.concat_ws(":", "leaf", "head").alias("block")))
    edges = exact(blocks)
    for more in sure:
        edges = edges.unionByName(more)
    edges = materialize(edges)
    linked = connected(edges) if split else edges.select(F.col("b").alias("key"), F.col("a").alias("component"))
    heads = edges.select(F.col("a").alias("key"), F.col("a").alias("component")).distinct()
    linked = linked.unionByName(heads).groupBy("key").agg(F.min("component").alias("component"))
    named = leads.join(linked, "key", "left").select("key", "lead", F.coalesce("component", "key").alias("component"))
    heads = named.groupBy("component").agg(F.min("lead").alias("head"))
    ids = materialize(named.join(heads, "component").select("key", F.col("head.doc_id").alias("component_id"), F.col("head.row").alias("kept_row")))
    wordless = F.col("key").isNull()
    return rows.join(ids, "key", "left").select("doc_id", "row", "n_shingles", F.when(wordless, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (wordless | F.col("row").eqNullSafe(F.col("kept_row"))).alias("kept"))


def without_duplicates(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component; rows without words all stay."""
    own = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))  # written: the keys must be the same when read again
    gone = judged(own, percent, shingle, id_col, text_col, F.col("_row")).where(~F.col("kept")).select("row")
    return own.join(gone, own["_row"] == gone["row"], "left_anti").drop("_row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM e JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS v, doc_id AS c FROM t UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v)
SELECT t.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id, t.doc_id = min(r.c) AS kept
FROM t JOIN r ON r.v = t.doc_id LEFT JOIN n USING (doc_id) GROUP BY t.doc_id
"""
