"""SimHash near-duplicates: segment-popcount embedding, grid range-join under Manhattan distance, exact verification.

A fingerprint is cut into 32 segments of two bits and mapped to the 32 bit counts of these segments. The Manhattan
distance of two such count vectors never exceeds the Hamming distance of the fingerprints, so a range join with radius
3 in count space loses no link. The counts (0, 1 or 2) are kept in unary (00, 01, 11), which makes the Manhattan distance of
two vectors the number of differing bits of two 64-bit codes.

The grid: the 32 dimensions form 6 groups. Vectors within distance 3 differ in at most 3 groups, hence coincide in at least
3; a grid cell is the choice of 3 groups with the counts there, so every fingerprint lies in 20 cells and each link
has a cell in common. Within a cell pairs are tested for Manhattan distance and then exactly.

Cells of more than BLOCK rows are counted first and never meet in one task: their rows go by the exact bits of each quarter of the
fingerprint (of 3 differing bits one quarter has none), and what is still too large by pairs of blocks.

Defined results. Null text: as the empty text (fingerprint zero). Rows with equal doc_id: each gets its own fingerprint and
the class of it. Null doc_id: the row stays and links others like any row; it never names a class, and a class without any doc_id
has a null id. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, text_of, written
from .fingerprints import shingle_hashes

SEED = 42
RADIUS = 3
#: Segments (of two bits) in each of the six groups of dimensions.
GROUPS = (5, 5, 5, 5, 6, 6)
#: Rows of a cell that one step compares at once; larger cells are split into pairs of blocks.
BLOCK = 2048
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_EVEN = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)
_CHUNK = 1 << 16


def simhash(text: str | None, size: int = 3) -> int:
    """The fingerprint of one text as an unsigned number."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(size, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - size + 1], ends[size - 1 :]
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):  # long texts: a bounded number of hashes at once
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every document as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([simhash(t.as_py(), size) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, fp long")


def embed(fps: np.ndarray) -> np.ndarray:
    """The segment bit counts of each fingerprint, in unary, as one 64-bit code."""
    high = fps >> _ONE
    return ((fps | high) & _EVEN) | (((fps & high) & _EVEN) << _ONE)


def _masks() -> list[int]:
    cuts = np.cumsum([0, *GROUPS]) * 2
    group = [sum(1 << bit for bit in range(a, b)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return [sum(group[g] for g in kept) for kept in combinations(range(len(GROUPS)), len(GROUPS) - RADIUS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(nodes: DataFrame) -> DataFrame:
    """(cell, fp, node): the grid cells of every row of nodes(fp, node). JVM-side only.

    With a column which, cells of rows that differ in it are apart: several families of fingerprints in one pass.
    """
    even = F.lit(_signed(int(_EVEN)))
    fp = F.col("fp")
    high = F.shiftrightunsigned(fp, 1)
    code = fp.bitwiseOR(high).bitwiseAND(even).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(even), 1))
    coded = nodes.select("fp", "node", code.alias("code"), *[c for c in nodes.columns if c == "which"])
    which = [F.col("which")] if "which" in nodes.columns else []
    keys = [F.xxhash64(F.lit(n), F.col("code").bitwiseAND(F.lit(_signed(mask))), *which) for n, mask in enumerate(_masks())]
    return coded.select(F.explode(F.array(*keys)).alias("cell"), "fp", "node")


def _near(code: np.ndarray, fp: np.ndarray, i, j) -> np.ndarray:
    """Which pairs (i, j) are linked: Manhattan distance first, then exactly."""
    ok = np.bitwise_count(code[i] ^ code[j]) <= RADIUS
    return ok & (np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS)


def _forest(fp: np.ndarray, node: np.ndarray) -> tuple[list, list]:
    """Edges that span the linked classes of one cell: at most one a row, found breadth-first."""
    code, todo, a, b = embed(fp), np.arange(len(fp)), [], []
    while len(todo):
        queue, todo = [int(todo[0])], todo[1:]
        while queue and len(todo):
            at = queue.pop()
            hit = _near(code, fp, at, todo)
            if hit.any():
                found = todo[hit]
                a.append(np.full(len(found), node[at]))
                b.append(node[found])
                queue += found.tolist()
                todo = todo[~hit]
    return a, b


def _linked(cell: np.ndarray, fp: np.ndarray, node: np.ndarray, small: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Edges within complete runs of equal cells (sorted): runs of up to `small` rows all at once, longer ones alone."""
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.r_[first, len(cell)])
    a, b, code = [], [], embed(fp)
    few = np.repeat(count <= small, count)
    at = np.flatnonzero(few)
    for step in range(1, small):
        at = at[at + step < len(cell)]
        at = at[cell[at] == cell[at + step]]
        if not len(at):
            break
        hit = at[_near(code, fp, at, at + step)]
        a.append(node[hit])
        b.append(node[hit + step])
    for s, n in zip(first[count > small].tolist(), count[count > small].tolist(), strict=True):
        x, y = _forest(fp[s : s + n], node[s : s + n])
        a += x
        b += y
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


_EDGES = "a long, b long, cell long, fp long, node long"


def _rows(a=(), b=(), cell=(), fp=(), node=()):
    n, m = len(a), len(cell)
    null = lambda k: pa.nulls(k, pa.int64())
    left = [pa.concat_arrays([pa.array(np.asarray(x, dtype=np.int64)), null(m)]) for x in (a, b)]
    right = [pa.concat_arrays([null(n), pa.array(np.asarray(x, dtype=np.int64))]) for x in (cell, fp, node)]
    return pa.RecordBatch.from_arrays(left + right, names=["a", "b", "cell", "fp", "node"])


def _join_cells(batches):
    """Over rows (cell, fp, node) sorted by cell: edges. One cell is held at once."""

    def settle(rows):
        a, b = _linked(rows[0], rows[1].view(np.uint64), rows[2])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held = [np.zeros(0, dtype=np.int64) for _ in range(3)]
    for batch in batches:
        rows = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
        last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        held = [x[last:] for x in rows]
        yield from settle([x[:last] for x in rows])
    yield from settle(held)


def _heavy(rows: DataFrame, block: int, name: str) -> DataFrame:
    """(cell, parts) of the cells of more than `block` rows; counted with a combine before the shuffle."""
    counted = rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block)
    return written(counted.select("cell", F.ceil(F.col("n") / block).cast("int").alias("parts")), name)


def _quarters(rows: DataFrame) -> DataFrame:
    """rows(cell, fp, node) by the exact bits of each quarter of the fingerprint: of two rows within 3 bits one is equal."""
    keys = [F.xxhash64(F.col("cell"), F.lit(k), F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    return rows.select(F.explode(F.array(*keys)).alias("cell"), *[c for c in rows.columns if c != "cell"])


def _in_blocks(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """rows of heavy cells, once for each pair of blocks that a row's block is in."""
    rest = [c for c in rows.columns if c != "cell"]
    own = rows.join(bounded(heavy), "cell").withColumn("own", F.pmod(F.xxhash64("fp", "node"), "parts").cast("int"))
    pairs = own.select("cell", *rest, "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return pairs.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), *rest)


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("cell")).sortWithinPartitions("cell")


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): edges between rows of nodes(fp, node), fp distinct, that span every class of fingerprints linked at 3 bits or fewer.

    Cells are worked off as sorted runs, in bounded memory; cells of more than `block` rows (large families of near copies) are
    split first, so that nothing is dropped and no cell is one task's.
    From each cell come at most as many edges as rows (3.5 times for cells of up to 8 rows), never all pairs.
    """
    edges = "a long, b long"
    spread = cells(nodes)
    heavy = _heavy(spread, block, "heavy")
    found = _by_cell(spread.join(bounded(heavy), "cell", "left_anti")).mapInArrow(_join_cells, edges)
    if heavy.isEmpty():
        return written(found, "links")
    finer = written(_quarters(spread.join(bounded(heavy.select("cell")), "cell", "left_semi")), "quarters")
    still = _heavy(finer, block, "heavy")
    found = found.unionByName(_by_cell(finer.join(bounded(still), "cell", "left_anti")).mapInArrow(_join_cells, edges))
    if not still.isEmpty():
        found = found.unionByName(_by_cell(_in_blocks(finer, still)).mapInArrow(_join_cells, edges))
    return written(found, "links")


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row: its class under links of at most 3 differing bits.

    Equal fingerprints are one node, so that copies never make pairs. Nodes are fingerprints; a class is named afterwards by the
    smallest doc_id of its rows.
    """
    fps = written(fingerprints(docs, size), "fps")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = written(components(links(nodes.select("fp", F.col("fp").alias("node")))), "roots")
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "least")
    names = linked.groupBy("root").agg(F.min("least").alias("name"))
    named = linked.join(names, "root").select(F.col("fp").alias("_fp"), "name")
    named = nodes.join(named, F.col("fp") == F.col("_fp"), "left").select("fp", F.when(F.col("_fp").isNull(), F.col("least")).otherwise(F.col("name")).alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


#: Fingerprints of each text for near_copies, and the letters of a word that counts there.
FAMILY = 10
LONG = 5


def family(text: str | None, size: int = FAMILY) -> np.ndarray:
    """Independent SimHash fingerprints of the set of a text's longer words (of all its words, if it has few of these).

    A text with a few words changed keeps nearly all of this set, so its fingerprints differ in few bits; common short words,
    which all texts share, would bring unrelated ones near.
    """
    words = set((text or "").lower().split())
    some = [w for w in words if len(w) >= LONG]
    some = some if len(some) >= 8 else list(words)
    if not some:
        return np.zeros(size, dtype=np.int64)
    base = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), SEED) for w in some], dtype=np.uint64)
    ones = np.zeros(size * 64, dtype=np.int64)
    steps = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(base), _CHUNK // 8):
        mixed = base[at : at + _CHUNK // 8, None] + steps  # the usual finishing steps of 64-bit hashes
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        ones += np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(len(mixed), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(base), bitorder="little").view("<u8").view(np.int64)


#: Texts of a family that one task compares with as many others, and shingles that they may have together.
FAMILY_BLOCK = 256
FAMILY_SHINGLES = 1 << 20
_OFTEN = 24
_FEW_COLUMNS = 2048


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of these sets have in common (arrays without repeats)."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(flat := np.concatenate([np.zeros(0, dtype=np.int64), *sets]), kind="stable")
    owner, flat = owner[order], flat[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.r_[first, len(flat)])
    out = np.zeros(n * n, dtype=np.int64)
    for d in np.unique(times[(times > 1) & (times <= _OFTEN)]).tolist():  # elements of few sets: their pairs are counted
        at = first[times == d]
        for k in range(0, len(at), 1 << 14):
            who = owner[at[k : k + (1 << 14), None] + np.arange(d)]
            out += np.bincount((who[:, :, None] * n + who[:, None, :]).ravel(), minlength=n * n)
    out = out.reshape(n, n).astype(np.float64)
    many = np.flatnonzero(times > _OFTEN)
    for k in range(0, len(many), _FEW_COLUMNS):  # elements of many: products of matrices of zeros and ones
        some = many[k : k + _FEW_COLUMNS]
        has = np.zeros((n, len(some)), dtype=np.float32)
        for column, (s, d) in enumerate(zip(first[some].tolist(), times[some].tolist(), strict=True)):
            has[owner[s : s + d], column] = 1
        out += has @ has.T
    return out


def _between_roots(root: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list, list]:
    """Edges between roots that span those linked by some pair of their texts."""
    size = np.array([len(x) for x in sets], dtype=np.float64)
    shared = _shared(sets)
    hit = (shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-9) & (size[:, None] + size[None, :] > 0)
    names, at = np.unique(root, return_inverse=True)
    near = np.zeros((len(names), len(names)), dtype=bool)
    i, j = np.nonzero(hit)
    near[at[i], at[j]] = True
    a, b, todo = [], [], list(range(len(names)))
    while todo:
        queue = [todo.pop(0)]
        while queue and todo:
            k = queue.pop()
            found = [x for x in todo if near[k, x]]
            a += [int(names[k])] * len(found)
            b += names[found].tolist()
            queue += found
            todo = [x for x in todo if not near[k, x]]
    return a, b


def family_links(members: DataFrame, similarity: float, block: int = FAMILY_BLOCK, shingles: int = FAMILY_SHINGLES) -> DataFrame:
    """(a, b): edges between roots of members(family, root, s: distinct shingles) that some pair of one family's texts links, spanning them.

    All pairs of a family are compared, but inside tasks: a family is dealt into blocks, each pair of blocks is one task's work at a time,
    and what comes out of it is at most one edge for each root that it holds. A block has a bounded number of texts and of shingles.
    """
    held = members.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.size("s")).alias("m"))
    parts = written(held.select("family", F.ceil(F.greatest(F.col("n") / block, F.col("m") / shingles, F.lit(1))).cast("int").alias("parts")), "families")
    own = members.join(bounded(parts), "family").withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    spread = own.select("family", "root", "s", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = spread.select(F.xxhash64("family", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "root", "s")

    def run(batches):
        def settle(cell, held):
            if len({r for r, _ in held}) > 1:
                a, b = _between_roots(np.array([r for r, _ in held]), [x for _, x in held], similarity)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        last, held = None, []
        for batch in batches:
            for cell, root, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if cell != last:
                    yield from settle(last, held)
                    last, held = cell, []
                held.append((root, s.values.to_numpy(zero_copy_only=False)))
        yield from settle(last, held)

    return _by_cell(rows).mapInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame, similarity: float = 0.8, words: int = 5, size: int = FAMILY) -> DataFrame:
    """(doc_id, copy, length, component_id, kept): classes of texts linked by a Jaccard likeness of their word shingles of at least `similarity`.

    One fingerprint within 3 bits finds few texts of likeness 0.8. So each text has a family of independent ones; a link needs one
    of them within the radius (found in the same grid), and every link is then verified exactly on the whole texts' shingles.
    First links that span the families of near fingerprints are verified, those to the text of the smallest doc_id above all; then,
    in the families that these don't hold together, all pairs of different classes are compared inside tasks (family_links), so
    that no refused link takes others with it.
    Equal texts are one node from the start; nodes are texts, known by a 64-bit hash and their length in bytes (copy, length).
    component_id is the smallest doc_id of the class, null if it has none. kept marks the rows of the smallest doc_id (nulls last) and,
    among several texts of that id, of one text: repeats of that row are all marked.
    Texts with fewer than `words` words: one shingle of them all. Null text: as empty. Rows with equal doc_id: each by its own text.
    """
    text = text_of(docs)

    def run(batches):
        for batch in batches:
            made = [family(t.as_py(), size) for t in batch.column(1)]
            flat = np.concatenate(made) if made else np.zeros(0, dtype=np.int64)
            fps = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), fps], names=["doc_id", "copy", "length", "fps"])

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("copy"), F.octet_length(text).cast("long").alias("length"))
    made = written(plain.mapInArrow(run, "doc_id long, copy long, length long, fps array<bigint>"), "family")
    nodes = written(made.groupBy("copy", "length").agg(F.min("doc_id").alias("least"), F.first("fps").alias("fps")).withColumnRenamed("copy", "node"), "texts")
    each = nodes.select("node", "least", F.posexplode("fps").alias("which", "fp"))
    shared = written(each.groupBy("which", "fp").agg(F.min(F.struct(F.col("least").isNull(), "least", "node"))["node"].alias("node")), "fps")
    named = each.select("which", "fp", F.col("node").alias("b")).join(shared.select("which", "fp", F.col("node").alias("a")), ["which", "fp"])
    pairs = links(shared).unionByName(named.select("a", "b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs, "pairs")

    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("copy")).distinct(), "ends")
    shingles = plain.join(bounded(ends), "copy", "left_semi").groupBy("copy").agg(F.first("text").alias("text"))
    shingles = written(shingles.select("copy", F.array_distinct(shingle_hashes(F.col("text"), words)).alias("s")), "shingles")
    left, right = (shingles.select(F.col("copy").alias(c), F.col("s").alias(f"s{c}")) for c in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
    linked = written(both.where(F.col("n") >= similarity * (F.size("sa") + F.size("sb") - F.col("n")) - 1e-9).select("a", "b"), "linked")
    roots = written(components(linked), "roots")
    # families of near fingerprints that the verified links don't hold together: what a refused link would have brought along
    families = written(components(pairs).join(roots.withColumnRenamed("root", "own"), "node", "left").select("node", F.col("root").alias("family"), F.coalesce("own", "node").alias("root")), "families")
    apart = families.groupBy("family").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("family")
    apart = written(families.join(apart, "family", "left_semi"), "apart")
    if not apart.isEmpty():
        more = family_links(apart.join(shingles.withColumnRenamed("copy", "node"), "node"), similarity)
        roots = written(components(linked.unionByName(written(more, "more"))), "roots")
    # of each class the name, and the row that stands for it
    rows = written(made.select("doc_id", "copy", "length").join(roots.withColumnRenamed("node", "copy"), "copy", "left").select("doc_id", "copy", "length", F.coalesce("root", "copy").alias("root")), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy", "length"))
    names = rows.groupBy("root").agg(first.alias("first"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("copy") == F.col("first.copy")) & (F.col("length") == F.col("first.length"))
    return rows.join(names, "root").select("doc_id", "copy", "length", F.col("first.doc_id").alias("component_id"), kept.alias("kept"))


def hexadecimal(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
