"""Self-join of documents on the Jaccard similarity of their word n-grams, by prefix trees.

1. Every text becomes the set of hashes of its distinct n-grams; equal sets
   are one class, and only one document of a class is looked at further.
2. N-grams have one global order: rare before frequent (frequencies by a
   fixed-size sketch of counts over the whole corpus), then by hash.  Sets as
   similar as the threshold share one of the first ``n - ceil(t * n) + 1``
   n-grams, so only these prefixes are shuffled.
3. Sets that share a prefix n-gram are compared by exact bounds only: sizes,
   positions, and the distance of their histograms, which never exceeds the
   sets' symmetric difference.  What remains possible joins two sets into a
   cluster (stars that span them leave each task, never all pairs).  Groups of
   one n-gram larger than GROUP are split, and pairs of parts are compared.
4. Sets of a cluster meet in a prefix tree with shared paths merged.  A set
   walks the tree, carrying the overlap with the shared path; a subtree is
   pruned when its remaining lengths cannot reach the threshold, or when all
   its sets are already in the walker's component.  The test at a leaf is
   exact.  Clusters larger than BLOCK sets are cut into blocks; the blocks'
   components are then joined through leaders, level by level, and whatever
   is still apart is walked through every block's tree, so no link is lost.
5. Links are closed to components.

Defined results: a null or blank text has an empty set, is linked with
nothing, and is its own component; fewer words than n count as one n-gram;
equal sets are linked; a null id is ignored as a component's least id (null if
there is no other); repeated rows give a row each; an empty table gives an
empty table; other columns are not read.  Sets are named by a 64-bit hash; where
a second hash shows that different sets share a name, they take the second
hash as their name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.components import connected_components
from kestrel.llm.words import mix, word_batches
from kestrel.session import cut_lineage, drop_tables

SKETCH_BITS = 20
SLICES = 64             # parts in which the sketch is summed
HISTOGRAM = 64          # cells of a set's histogram, and more of a large set: one for CELL_GRAMS n-grams
CELL_GRAMS = 16
GROUP = 2048            # members of one prefix n-gram compared in one task
BLOCK = 512             # sets in one tree
BLOCK_GRAMS = 1 << 20   # and their n-grams, unless one set alone has more
LEADERS = 16            # of a block's component, compared across blocks
B1, B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


class Threshold:
    """Similarity num / den in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n):
        return n - -(-self.num * n // self.den) + 1

    def linked(self, overlap, n, m):
        return self.den * overlap >= self.num * (n + m - overlap)

    def reachable(self, overlap, n, m):
        """Could sets of n and m have an overlap of at most this and be linked?"""
        return (self.num + self.den) * overlap >= self.num * (n + m)


def gram_sets(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes per row (ascending), and how many."""
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    n = len(words)
    if n >= size:
        h = words[:n - size + 1].copy()
        for k in range(1, size):
            h = h * B1 + words[k:n - size + 1 + k]
        inside = np.arange(len(h)) + size <= ends[row[:len(h)]]
        grams, of = mix(h[inside]), row[:len(h)][inside]
    else:
        grams, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if short.size:
        one = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            one[has] = one[has] * B2 + words[(ends - counts)[short[has]] + k]
        grams = np.concatenate([grams, mix(one ^ mix(counts[short].astype(np.uint64)))])
        of = np.concatenate([of, short])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[new], np.bincount(of[new], minlength=len(counts))


def set_names(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set, from sums over its members."""
    full = np.flatnonzero(sizes)
    names = []
    for base in (B1, B2):
        total = np.zeros(len(sizes), np.uint64)
        if full.size:
            total[full] = np.add.reduceat(mix(grams * base + base), (np.cumsum(sizes) - sizes)[full])
        names.append(mix(total + sizes.astype(np.uint64) * base))
    return names[0], names[1]


def final_names(grams: np.ndarray, sizes: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The names of sets: the second where the first is ``shared`` by different sets."""
    node, check = set_names(grams, sizes)
    return np.where(np.isin(node, shared), check, node) if len(shared) else node


def _cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def histograms(grams: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Counts of each set's n-grams by their lowest bits.  The number of cells
    follows the set's size: what unrelated sets differ by must stand out."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    few = np.bincount(row * HISTOGRAM + (grams & np.uint64(HISTOGRAM - 1)).astype(np.int64), minlength=len(sizes) * HISTOGRAM)
    out = [c.tobytes() for c in np.minimum(few, 65535).astype("<u2").reshape(len(sizes), HISTOGRAM)]
    start = np.cumsum(sizes) - sizes
    for k in np.flatnonzero(sizes > HISTOGRAM * CELL_GRAMS).tolist():
        cells = 1 << (int(sizes[k]) // CELL_GRAMS).bit_length()
        own = np.bincount((grams[start[k]:start[k] + sizes[k]] & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        out[k] = np.minimum(own, 65535).astype("<u2").tobytes()
    return out


def folded(histogram: np.ndarray, cells: int) -> np.ndarray:
    """The histogram with fewer cells: cells of equal lowest bits together."""
    return histogram.reshape(-1, cells).sum(axis=0, dtype=np.int64)


def class_rows(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """A written table.  Rows of documents: id, n, node and check (names of the
    set), histogram.  Rows of the sketch: slice and its counts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        none = pa.nulls(SLICES, pa.int64())
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for a, b, (words,), counts in word_batches(batch.column(1), lower=True):
                grams, sizes = gram_sets(words, counts, size)
                sketch += np.bincount(_cell(grams), minlength=1 << SKETCH_BITS)
                node, check = set_names(grams, sizes)
                empty = sizes == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes.astype(np.int64)), pa.array(node.view(np.int64), mask=empty), pa.array(check.view(np.int64), mask=empty),
                     pa.array(histograms(grams, sizes), pa.binary()), pa.nulls(b - a, pa.int64()), pa.nulls(b - a, pa.binary())], names)
        if id_type is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SLICES, id_type), none, none, none, pa.nulls(SLICES, pa.binary()), pa.array(np.arange(SLICES)),
                 pa.array([s.astype("<i8").tobytes() for s in np.split(sketch, SLICES)], pa.binary())], names)

    names = ["id", "n", "node", "check", "histogram", "slice", "counts"]
    schema = f"id {kind}, n long, node long, check long, histogram binary, slice long, counts binary"
    return cut_lineage(docs.select(id_col, text_col).mapInArrow(run, schema), "jaccard-classes", "zstd")


def gram_levels(rows: DataFrame) -> np.ndarray:
    """Frequency level of every sketch cell (a fixed number of bytes): 0 up to
    the mean, then the logarithm."""
    def add(key, frame):
        import pandas as pd
        return pd.DataFrame({"slice": [key[0]], "counts": [sum(np.frombuffer(b, "<i8") for b in frame["counts"]).tobytes()]})

    parts = rows.filter(F.col("slice").isNotNull()).select("slice", "counts")
    sums = parts.groupBy("slice").applyInPandas(add, "slice long, counts binary").collect()  # SLICES rows of fixed size
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in sums:
        at = r["slice"] * (len(total) // SLICES)
        total[at:at + len(total) // SLICES] = np.frombuffer(r["counts"], "<i8")
    return np.floor(np.log2(np.maximum(total / max(1.0, total.mean()), 1.0))).astype(np.uint8)


def prefix_rows(docs: DataFrame, text_col: str, size: int, t: Threshold, levels: np.ndarray, shared: np.ndarray) -> DataFrame:
    """(gram, node, n, place) for the prefix of every document's set."""
    def run(batches):
        for batch in batches:
            for _, _, (words,), counts in word_batches(batch.column(0), lower=True):
                grams, sizes = gram_sets(words, counts, size)
                if not grams.size:
                    continue
                node = final_names(grams, sizes, shared)
                row = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((grams, levels[_cell(grams)], row))
                place = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = place < t.prefix(sizes)[row]
                r = row[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[order][keep].view(np.int64)), pa.array(node[r].view(np.int64)), pa.array(sizes[r].astype(np.int64)), pa.array(place[keep])],
                    ["gram", "node", "n", "place"])

    return docs.select(text_col).mapInArrow(run, "gram long, node long, n long, place long")


class Forest:
    """Union-find over numbers 0..n-1, with labels kept flat."""

    def __init__(self, n: int):
        self.label = list(range(n))
        self.members: dict[int, list[int]] = {}

    def join(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        if x == y:
            return
        mx, my = self.members.pop(x, [x]), self.members.pop(y, [y])
        if len(mx) < len(my):
            x, mx, my = y, my, mx
        for k in my:
            self.label[k] = x
        self.members[x] = mx + my

    def stars(self, of: list[int]) -> tuple[list[int], list[int]]:
        """Pairs (least, other) of each component's numbers among ``of``: trees of depth one."""
        hub: dict[int, int] = {}
        u, v = [], []
        for k in sorted(of):
            if (h := hub.setdefault(self.label[k], k)) != k:
                u.append(h)
                v.append(k)
        return u, v


def _sorted_groups(batches, keys: int):
    """Rows of equal first ``keys`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def possible_edges(t: Threshold, cells: int = HISTOGRAM):
    """Arrow function over rows (gram, i, j, part, node, n, place, histogram)
    sorted by (gram, i, j): stars that span what may be linked.  Of two different parts only pairs across are compared."""

    def near(x: np.ndarray, y: np.ndarray, n: int, m: int) -> bool:
        """The bound once more, with all cells that both histograms have."""
        most = min(len(x), len(y))
        return most == cells or bool(t.reachable((n + m - int(np.abs(folded(x, most) - folded(y, most)).sum())) // 2, n, m))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda k: batch.column(k).to_numpy(zero_copy_only=False)
            gram, i, j, part, node, n, place = (get(k) for k in range(7))
            own = [np.frombuffer(x, "<u2") for x in batch.column(7).to_pylist()]
            hist = np.stack([x if len(x) == cells else folded(x, cells) for x in own]).astype(np.int32)
            group = np.cumsum(np.concatenate([[0], (gram[1:] != gram[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            sizes = np.bincount(group)
            names, at = np.unique(node, return_inverse=True)
            forest = Forest(len(names))
            label = np.arange(len(names))
            for step in range(1, int(sizes.max())):
                a = np.flatnonzero(group[:-step] == group[step:])
                if not a.size:
                    break
                b = a + step
                ok = (label[at[a]] != label[at[b]]) & ((i[a] == j[a]) | (part[a] != part[b]))
                a, b = a[ok], b[ok]
                best = np.minimum(place[a], place[b]) + 1 + np.minimum(n[a] - place[a], n[b] - place[b]) - 1
                ok = t.reachable(np.minimum(best, np.minimum(n[a], n[b])), n[a], n[b])
                a, b = a[ok], b[ok]
                # symmetric difference of linked sets: n + m - 2 * overlap, at least the histograms' distance
                for s in range(0, len(a), 65536):
                    x, y = a[s:s + 65536], b[s:s + 65536]
                    far = np.abs(hist[x] - hist[y]).sum(axis=1)
                    ok = t.reachable((n[x] + n[y] - far) // 2, n[x], n[y])
                    for p, q in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                        if forest.label[at[p]] != forest.label[at[q]] and near(own[p], own[q], n[p], n[q]):
                            forest.join(at[p], at[q])
                if forest.members:
                    label = np.array(forest.label, np.int64)
            if forest.members:
                u, v = forest.stars([k for m in forest.members.values() for k in m])
                yield pa.RecordBatch.from_arrays([pa.array(names[u]), pa.array(names[v])], ["u", "v"])

    def by_group(batches):
        """Batches that end where a group ends."""
        held, rows = [], 0
        for g in _sorted_groups(batches, 3):
            held.append(g)
            rows += g.num_rows
            if rows >= 8192:
                yield from run(pa.concat_tables(held).combine_chunks().to_batches())
                held, rows = [], 0
        if held:
            yield from run(pa.concat_tables(held).combine_chunks().to_batches())

    return by_group


class PrefixTree:
    """Sets of local n-gram numbers (ascending) with shared paths merged."""

    def __init__(self, t: Threshold, forest: Forest, n_grams: int):
        self.t, self.forest = t, forest
        self.has = np.zeros(n_grams, bool)
        self.path: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.next: list[dict[int, int]] = [{}]
        self.least, self.most = [1 << 60], [0]
        self.own: list[list[int]] = [[]]
        self.uniform: list[int | None] = [None]  # a set of the subtree, if all are of its component
        self.mixed = [False]
        self.size: dict[int, int] = {}

    def _note(self, node: int, who: int, n: int) -> None:
        self.least[node], self.most[node] = min(self.least[node], n), max(self.most[node], n)
        label, one = self.forest.label, self.uniform[node]
        if one is None:
            self.uniform[node] = who
        elif label[one] != label[who]:
            self.mixed[node] = True

    def _node(self, path: np.ndarray) -> int:
        self.path.append(path)
        self.next.append({})
        self.least.append(1 << 60)
        self.most.append(0)
        self.own.append([])
        self.uniform.append(None)
        self.mixed.append(False)
        return len(self.path) - 1

    def insert(self, who: int, grams: np.ndarray) -> None:
        node, at, n = 0, 0, len(grams)
        self.size[who] = n
        self._note(0, who, n)
        while at < n:
            k = self.next[node].get(int(grams[at]))
            if k is None:
                k = self._node(grams[at:])
                self.next[node][int(grams[at])] = k
                self._note(k, who, n)
                node, at = k, n
                break
            path = self.path[k]
            m = min(len(path), n - at)
            differ = np.flatnonzero(path[:m] != grams[at:at + m])
            same = int(differ[0]) if differ.size else m
            if same < len(path):  # split the path: the upper part becomes a node above
                up = self._node(path[:same])
                self.next[node][int(path[0])] = up
                self.path[k] = path[same:]
                self.next[up][int(path[same])] = k
                self.least[up], self.most[up], self.uniform[up], self.mixed[up] = self.least[k], self.most[k], self.uniform[k], self.mixed[k]
                k = up
            self._note(k, who, n)
            node, at = k, at + same
        self.own[node].append(who)

    def walk(self, who: int, grams: np.ndarray) -> None:
        """Link ``who`` with every set of the tree, up to components."""
        t, label, n = self.t, self.forest.label, len(grams)
        both = t.num + t.den
        self.has[grams] = True
        stack = [(k, 0, 0) for k in self.next[0].values()]
        while stack:
            node, overlap, depth = stack.pop()
            if self.uniform[node] is not None and not self.mixed[node] and label[self.uniform[node]] == label[who]:
                continue
            path = self.path[node]
            overlap += int(np.count_nonzero(self.has[path]))
            depth += len(path)
            # misses of the tree's sets so far, and of the walker up to here
            if t.den * self.most[node] < t.num * n + both * (depth - overlap):
                continue
            passed = int(np.searchsorted(grams, path[-1], side="right"))
            if t.num * self.least[node] > t.den * n - both * (passed - overlap):
                continue
            for other in self.own[node]:
                if label[other] != label[who] and t.linked(overlap, n, self.size[other]):
                    self.forest.join(other, who)
            stack.extend((k, overlap, depth) for k in self.next[node].values())
        self.has[grams] = False


def tree_links(t: Threshold):
    """Arrow function over rows (cluster, block, j, node, label, probe, grams)
    sorted by (cluster, block, j): stars that span the exact links.  Sets of
    one label are already joined; probes walk the tree but are not in it."""

    def run(batches):
        for table in _sorted_groups(batches, 3):
            node = table.column(3).to_numpy()
            first = np.sort(np.unique(node, return_index=True)[1])  # repeated rows of a set
            probe = table.column(5).to_numpy(zero_copy_only=False)
            own = [i for i in first if not probe[i]] + [i for i in first if probe[i]]
            blobs = table.column(6).to_pylist()
            sets = [np.frombuffer(blobs[i], "<u8") for i in own]
            if len(sets) < 2:
                continue
            grams, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            rank = np.empty(len(grams), np.int64)
            rank[np.lexsort((grams, -count))] = np.arange(len(grams))
            local = np.split(rank[number], np.cumsum([len(s) for s in sets])[:-1])
            forest = Forest(len(sets))
            label = table.column(4).to_numpy()[own]
            seen: dict[int, int] = {}
            for i, x in enumerate(label.tolist()):
                forest.join(seen.setdefault(x, i), i)
            tree = PrefixTree(t, forest, len(grams))
            for k, s in enumerate(local):
                s = np.sort(s)
                tree.walk(k, s)
                if not probe[own[k]]:
                    tree.insert(k, s)
            u, v = forest.stars(list(seen.values()))
            if u:
                names = node[own]
                yield pa.RecordBatch.from_arrays([pa.array(names[u]), pa.array(names[v])], ["u", "v"])

    return run


def _links(rows: DataFrame, t: Threshold) -> DataFrame:
    """Exact links of rows (cluster, block, j, node, label, probe, grams)."""
    cols = ["cluster", "block", "j", "node", "label", "probe", "grams"]
    dealt = rows.select(*cols).repartition("cluster", "block", "j").sortWithinPartitions("cluster", "block", "j", "probe", "node")
    return dealt.mapInArrow(tree_links(t), "u long, v long")


def cluster_sets(docs: DataFrame, clusters: DataFrame, id_col: str, text_col: str, size: int, shared: np.ndarray) -> DataFrame:
    """(node, cluster, n, grams) from the text of one document per class;
    ``clusters``: (node, cluster, id)."""
    def run(batches):
        for batch in batches:
            wanted = batch.column(0).to_numpy()
            for a, b, (words,), counts in word_batches(batch.column(2), lower=True):
                grams, sizes = gram_sets(words, counts, size)
                node = final_names(grams, sizes, shared)
                hit = np.flatnonzero(node.view(np.int64) == wanted[a:b])  # not another text of the same id
                start = np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wanted[a:b][hit]), batch.column(1).slice(a, b - a).take(pa.array(hit)), pa.array(sizes[hit].astype(np.int64)),
                     pa.array([grams[start[k]:start[k] + sizes[k]].astype("<u8").tobytes() for k in hit], pa.binary())],
                    ["node", "cluster", "n", "grams"])

    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text")).join(clusters, F.col("id").eqNullSafe(F.col("cid")))
    return joined.select("node", "cluster", "__text").mapInArrow(run, "node long, cluster long, n long, grams binary")


def class_names(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A written table (node, cid, n) of the classes, and the nodes of different sets."""
    found = (rows.filter(F.col("node").isNotNull()).groupBy("node")
             .agg(F.min("id").alias("cid"), F.min("n").alias("n"), F.min("check").alias("c0"), F.max("check").alias("c1")))
    table = cut_lineage(found, "jaccard-nodes")
    return table.select("node", "cid", "n"), table.filter(F.col("c0") != F.col("c1")).select("node")


def similar_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every document."""
    t = Threshold(num, den)
    rows = class_rows(docs, id_col, text_col, size)
    classes, clashes = class_names(rows)
    twice = np.array([r["node"] for r in clashes.collect()], np.int64).view(np.uint64)  # about n * n / 2 ** 65 of n sets
    if len(twice):
        rows = rows.withColumn("node", F.when(F.col("node").isin(twice.view(np.int64).tolist()), F.col("check")).otherwise(F.col("node")))
        classes, clashes = class_names(rows)
        if not clashes.isEmpty():
            raise ValueError("different sets share both 64-bit names")

    # prefixes: n-grams that two classes share, split where they are many
    prefix = cut_lineage(prefix_rows(docs, text_col, size, t, gram_levels(rows), twice), "jaccard-prefix", "zstd")
    shared = (prefix.groupBy("gram").agg(F.min("node").alias("a"), F.max("node").alias("b"))
              .filter(F.col("a") != F.col("b")).select("gram"))
    members = cut_lineage(prefix.join(shared, "gram", "left_semi").dropDuplicates(["gram", "node"]), "jaccard-members")
    drop_tables(prefix)
    parts = (members.groupBy("gram").agg(F.count(F.lit(1)).alias("k"))
             .select("gram", F.ceil(F.col("k") / GROUP).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    histograms = rows.filter(F.col("node").isNotNull()).select("node", "histogram").dropDuplicates(["node"])
    dealt = (members.join(parts, "gram").withColumn("part", part).withColumn("with", other)
             .select("gram", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "node", "n", "place")
             .join(histograms, "node")
             .select("gram", "i", "j", "part", "node", "n", "place", "histogram")
             .repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j", "n", "node"))
    clusters = connected_components(dealt.mapInArrow(possible_edges(t), "u long, v long")).withColumnRenamed("label", "cluster")
    drop_tables(members)

    # trees: one block of a cluster each
    wanted = clusters.join(classes.select("node", "cid"), "node")
    sets = cut_lineage(cluster_sets(docs, wanted, id_col, text_col, size, twice), "jaccard-sets", "zstd")
    shape = sets.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    shape = cut_lineage(shape, "jaccard-shape")
    placed = (sets.join(shape, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .withColumns({"j": F.lit(0), "label": F.col("node"), "probe": F.lit(False)}))
    links = cut_lineage(_links(placed, t), "jaccard-links")
    many = shape.filter(F.col("blocks") > 1)
    if not many.isEmpty():
        links = links.unionByName(_across_blocks(placed.join(many.select("cluster"), "cluster", "left_semi"), links, t))
    labels = connected_components(links)
    drop_tables(sets)

    home = classes.select("node", "cid").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = home.groupBy("label").agg(F.min("cid").alias("component_id"))
    by_node = home.join(least, "label").select("node", "component_id")
    return (rows.filter(F.col("slice").isNull()).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "node")
            .join(by_node, "node", "left")
            .select(id_col, "n_shingles", F.when(F.col("node").isNull(), F.col(id_col)).otherwise(F.col("component_id")).alias("component_id")))


def _labelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    labels = connected_components(links)
    known = labels.select("node", F.col("label").alias("__label"))
    return sets.drop("label").join(known, "node", "left").withColumn("label", F.coalesce("__label", "node")).drop("__label")


def _across_blocks(placed: DataFrame, links: DataFrame, t: Threshold) -> DataFrame:
    """Links between the blocks of clusters with several blocks: leaders of
    the blocks' components meet level by level; sets outside their cluster's
    largest component then walk every block's tree."""
    from pyspark.sql.window import Window

    found = None
    level = placed
    while True:
        known = links if found is None else links.unionByName(found)
        now = _labelled(level, known)
        nth = F.row_number().over(Window.partitionBy("cluster", "block", "label").orderBy(F.xxhash64("node")))
        level = now.withColumn("__nth", nth).filter(F.col("__nth") <= LEADERS).drop("__nth", "blocks", "block")
        shape = level.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        level = cut_lineage(level.join(shape, "cluster").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")), "jaccard-leaders")
        more = cut_lineage(_links(level, t), "jaccard-links")
        found = more if found is None else cut_lineage(found.unionByName(more), "jaccard-links")
        if level.filter(F.col("blocks") > 1).isEmpty() or more.isEmpty():
            break
    now = cut_lineage(_labelled(placed, links.unionByName(found)), "jaccard-labelled", "zstd")
    count = now.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k"))
    main = count.groupBy("cluster").agg(F.max(F.struct("k", "label")).alias("m")).select("cluster", F.col("m.label").alias("main"))
    apart = now.join(main, "cluster").filter(F.col("label") != F.col("main")).drop("main")
    chunks = apart.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
    probes = (apart.join(chunks, "cluster").withColumn("j", F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).cast("int"))
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("probe", F.lit(True)))
    own = now.join(chunks, "cluster").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cols = ["cluster", "block", "j", "node", "label", "probe", "grams"]
    return found.unionByName(cut_lineage(_links(own.select(*cols).unionByName(probes.select(*cols)), t), "jaccard-links"))
