"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are dealt to cells by the population counts of their halves (or, for wide fingerprints, by the number of
shingles, whose ratio bounds the similarity). Cells are cut into tiles of bounded size. Pairs of tiles
whose counts differ beyond the radius are never built; the others are compared whole with numpy exclusive-or and bit counts,
tile by smaller tile, which again skip each other by the population counts of ever shorter segments.
A pair of tiles gives on a spanning forest of its links only, so a group of copies never becomes all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups
from .graph import components

#: Fingerprints of one tile, and bytes of the sets of shingles behind a tile of wide ones, both on average.
TILE, TILE_BYTES = 8192, 1 << 25
#: Pairs below which two tiles are compared without further splitting.
SMALL = 1 << 16
#: Cells per factor 1 / similarity of the number of shingles.
SIZE_STEPS = 4
#: Wide fingerprints: 512 bits. Sets of similarity (Jaccard) 0.8 have an angle whose expected share of differing bits is 0.151, or 77
#: bits; the radius lies four standard deviations above, so it misses next to none, and the sets themselves are compared within
#: it. The first word alone is tested first. Among sets of up to FEW_SHINGLES, ties of the majority raise that share to up to
#: 0.1875, or 96 bits: there both radii lie some six deviations above it.
WIDE_WORDS, WIDE_RADIUS, FIRST_RADIUS = 8, 110, 26
FEW_SHINGLES, FEW_RADIUS, FEW_FIRST_RADIUS = 32, 160, 31
SEED = 42
#: Bits of the filter of texts: at least so many, at most so many (16 MB), for each text, and of one block of them. With more texts than
#: the most bits serve, a join takes the place of the filter.
LEAST_BITS, MOST_BITS, BITS_PER_TEXT, BLOCK_BITS = 1 << 20, 1 << 27, 16, 1 << 18


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the ``width``-word shingles, in order; of fewer words the whole sequence; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = [b" ".join(words)] if len(words) <= width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several independent 64-bit hashes made from one (k = 0: itself)."""
    if not k:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words; a bit is 1 if it is set in over half the hashes, and 0 if there are none."""
    total = np.zeros((words, 64), np.int64)
    for at in range(0, len(h), 255 * 64):  # bounded memory for any length of text
        part = h[at : at + 255 * 64]
        for k in range(words):
            bits = np.unpackbits(_mixed(part, k).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            full = len(bits) // 255 * 255
            total[k] += bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[full:].sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(h), axis=1, bitorder="little").view("<u8").ravel()


def _size_cell(n: int, similarity: float) -> int:
    return -1 if not n else int(SIZE_STEPS * math.log(n) / math.log(1 / similarity) + 1e-9)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, words: int = 1, similarity: float = 0.8) -> DataFrame:
    """(doc_id, row, text_hash, fp binary, x, y): the fingerprint of each row, words big-endian, and its cell.

    With one word, repeats of a shingle count and the cell holds the population counts of the halves; with more,
    shingles count once and x is the scaled logarithm of their number.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, xs, ys = [], [], []
            for text in batch.column("text"):
                h = shingle_hashes(text.as_py(), width)
                if words > 1:
                    h = np.unique(h)
                fp = fingerprint(h, words)
                fps.append(fp.astype(">u8").tobytes())
                if words > 1:
                    xs.append(_size_cell(len(h), similarity))
                    ys.append(0)
                else:
                    xs.append((int(fp[0]) >> 32).bit_count())
                    ys.append((int(fp[0]) & 0xFFFFFFFF).bit_count())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps, pa.binary()), pa.array(xs, pa.int32()), pa.array(ys, pa.int32())], ["doc_id", "row", "text_hash", "fp", "x", "y"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(kernel, f"doc_id {docs.schema[id_col].dataType.simpleString()}, row long, text_hash long, fp binary, x int, y int")


class _Forest:
    """Roots of linked positions; each root is the smallest position of its tree."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root]) is not None and not np.array_equal(up, root):
                root[:] = up


class _Marks:
    """Which positions have a link at all."""

    def __init__(self, n: int):
        self.linked = np.zeros(n, bool)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        self.linked[i] = True
        self.linked[j] = True


class _SimilarSets(_Forest):
    """A forest that takes a link only if the sets of both ends are similar; ends that are joined already aren't compared."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        super().__init__(len(sets))
        self.size = np.array([len(x) for x in sets], np.int64)
        self.start = np.cumsum(self.size) - self.size
        known, place = np.unique(np.concatenate(sets), return_inverse=True)
        self.place, self.marked, self.similarity = place.astype(np.int32), np.zeros(len(known), bool), similarity

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        small, large = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        may = np.flatnonzero((self.root[i] != self.root[j]) & (small + 1e-9 >= self.similarity * large))
        may = may[np.argsort(i[may], kind="stable")]
        i, j = i[may], j[may]
        if not len(i):
            return
        ends = np.flatnonzero(np.diff(i, append=-1)) + 1
        for at, end in zip(np.append(0, ends[:-1]), ends, strict=True):
            one, others = i[at], j[at:end]
            others = others[self.root[others] != self.root[one]]
            near = others[self._similar(one, others)]
            super().link(np.full(len(near), one), near)

    def _similar(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` have a similar set: the elements of one are marked, and marks are counted in all others at once."""
        own = self.place[self.start[one] : self.start[one] + self.size[one]]
        self.marked[own] = True
        out, at = np.zeros(len(others), bool), 0
        total = np.cumsum(self.size[others])
        while at < len(others):  # a few million elements at a time
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 22), "right")))
            size = self.size[others[at:end]]
            first = np.cumsum(size) - size
            element = np.arange(size.sum()) + np.repeat(self.start[others[at:end]] - first, size)
            both = np.add.reduceat(self.marked[self.place[element]], first, dtype=np.int64)
            out[at:end] = both + 1e-9 >= self.similarity * (self.size[one] + size - both)
            at = end
        self.marked[own] = False
        return out


def _segment_counts(fp: np.ndarray, bits: int) -> np.ndarray:
    """Population counts of the segments of ``bits`` bits, a row each."""
    parts = fp.view({32: "<u4", 16: "<u2", 8: "u1"}[bits]).reshape(len(fp), -1)
    return np.bitwise_count(parts).astype(np.int16)


def _compare(fp: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, same: bool, bits: int, forest: _Forest, deep) -> None:
    """Links positions a with b whose fingerprints (first words ``fp``) differ in ``radius`` bits at most."""
    if len(a) * len(b) > SMALL and bits >= 8 and radius <= 6:
        ca, cb = _segment_counts(fp[a], bits), _segment_counts(fp[b], bits)
        ua, ia = np.unique(ca, axis=0, return_inverse=True)
        ub, ib = np.unique(cb, axis=0, return_inverse=True)
        if len(ua) * len(ub) < len(a) * len(b) // 4:
            ga = np.split(a[np.argsort(ia, kind="stable")], np.cumsum(np.bincount(ia))[:-1])
            gb = np.split(b[np.argsort(ib, kind="stable")], np.cumsum(np.bincount(ib))[:-1])
            for i, one in enumerate(ga):
                near = np.flatnonzero(np.abs(ub - ua[i]).sum(1) <= radius)
                for j in near:
                    if not same or tuple(ub[j]) >= tuple(ua[i]):
                        _compare(fp, one, gb[j], radius, same and tuple(ub[j]) == tuple(ua[i]), bits // 2, forest, deep)
            return
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        i, j = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[b][None, :]) <= radius)
        i, j = part[i], b[j]
        if same:
            i, j = i[i < j], j[i < j]
        if deep is not None and len(i):
            for k in range(0, len(i), 1 << 18):
                ok = deep(i[k : k + (1 << 18)], j[k : k + (1 << 18)])
                forest.link(i[k : k + (1 << 18)][ok], j[k : k + (1 << 18)][ok])
        else:
            forest.link(i, j)


def tile_links(fps: list[bytes], sides: np.ndarray, radius: int, first_radius: int | None = None, sink=None) -> np.ndarray:
    """Roots of the positions of one pair of tiles; side 0 is compared with side 1, or with itself if there is no side 1.

    ``sink`` gets the links instead, if given.
    """
    wide = np.frombuffer(b"".join(fps), ">u8").astype("<u8").reshape(len(fps), -1)
    first = np.ascontiguousarray(wide[:, 0])
    forest, here = sink or _Forest(len(fps)), np.arange(len(fps))
    one, two = here[sides == 0], here[sides == 1]
    same = not len(two)
    if wide.shape[1] > 1:
        deep = lambda i, j: np.bitwise_count(wide[i] ^ wide[j]).sum(1, dtype=np.int32) <= radius
        _compare(first, one, one if same else two, radius if first_radius is None else first_radius, same, 0, forest, deep)
    else:
        _compare(first, one, one if same else two, radius, same, 16, forest, None)
    return getattr(forest, "root", None)


def _by_pair(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """(pair, rows) of rows that come sorted by pair."""
    pair, rows = None, []
    for batch in batches:
        for p, *row in zip(*(batch.column(c).to_pylist() for c in ("pair", *columns)), strict=True):
            if p != pair:
                if rows:
                    yield pair, rows
                pair, rows = p, []
            rows.append(tuple(row))
    if rows:
        yield pair, rows


def _links_out(nodes: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    moved = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_pydict({"a": pa.array(nodes[moved], pa.int64()), "b": pa.array(nodes[root[moved]], pa.int64())})


def _linked(radius: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The fingerprints of each pair are compared, and links to roots go out."""
        for _, rows in _by_pair(batches, ("side", "node", "fp")):
            sides = np.array([r[0] for r in rows])
            if (sides == 0).any() and len(rows) > 1:
                yield _links_out(np.array([r[1] for r in rows], np.int64), tile_links([r[2] for r in rows], sides, radius))

    return kernel


def _radii(few: bool, radius: int, first_radius: int) -> tuple[int, int]:
    return (max(radius, FEW_RADIUS), max(first_radius, FEW_FIRST_RADIUS)) if few else (radius, first_radius)


def _candidates(radius: int, first_radius: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nodes of each pair that lie within the radius of another one go out."""
        for pair, rows in _by_pair(batches, ("side", "node", "fp", "few")):
            sides = np.array([r[0] for r in rows])
            if not (sides == 0).any() or len(rows) < 2:
                continue
            marks = _Marks(len(rows))
            tile_links([r[2] for r in rows], sides, *_radii(rows[0][3], radius, first_radius), marks)
            kept = np.flatnonzero(marks.linked)
            if len(kept):
                columns = ([pair] * len(kept), sides[kept], [rows[k][1] for k in kept], [rows[k][3] for k in kept])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.bool_()), strict=True)], ["pair", "side", "node", "few"])

    return kernel


def _verified(radius: int, first_radius: int, similarity: float):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """As for links, but the sets of shingles decide."""
        for _, rows in _by_pair(batches, ("side", "node", "fp", "few", "shingles")):
            sides = np.array([r[0] for r in rows])
            if (sides == 0).any() and len(rows) > 1:
                forest = _SimilarSets([np.frombuffer(r[4], "<u8") for r in rows], similarity)
                yield _links_out(np.array([r[1] for r in rows], np.int64), tile_links([r[2] for r in rows], sides, *_radii(rows[0][3], radius, first_radius), forest))

    return kernel


def _text_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits, those at ``text_hash`` modulo bits being set. Each block of it is made in one place and reaches the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _by_pair(batches, ("bit",)):
            found = np.zeros(BLOCK_BITS, bool)
            found[[r[0] for r in rows]] = True
            yield pa.RecordBatch.from_pydict({"pair": pa.array([block], pa.int64()), "bits": pa.array([np.packbits(found).tobytes()], pa.binary())})

    n = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bit = F.pmod("text_hash", F.lit(bits).cast("long"))
    placed = hashes.select(F.floor(bit / BLOCK_BITS).alias("pair"), (bit % BLOCK_BITS).alias("bit")).repartition(n, "pair").sortWithinPartitions("pair")
    out = np.zeros((bits // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for r in placed.mapInArrow(mark, "pair long, bits binary").collect():
        out[r["pair"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _shingle_sets(docs: DataFrame, nodes: DataFrame, *, text_col: str, width: int, words: int) -> DataFrame:
    """(fp, shingles) of ``nodes`` (fp, text_hash): the set of shingles is read again from a text that has the fingerprint.

    A bitmap of the texts' hashes, sized by their number, keeps other texts from being read further, so no text is shuffled. With more
    texts than a broadcast bitmap serves, a join on the hash does the same. The fingerprint decides in either case.
    """
    hashes = cut(nodes.select("text_hash").distinct())
    wanted = BITS_PER_TEXT * hashes.count()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text"))
    if wanted > 2 * MOST_BITS:
        shared, bits = None, 0
        rows = rows.join(hashes, "text_hash", "left_semi")
    else:
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (wanted - 1).bit_length()))
        shared = docs.sparkSession.sparkContext.broadcast(_text_filter(hashes, bits))
        rows = rows.select(F.pmod("text_hash", F.lit(bits).cast("long")).alias("text_hash"), "text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("text_hash").to_numpy()
            there = np.arange(len(at)) if shared is None else np.flatnonzero(shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
            held, size = [], 0
            for i in there:
                held.append(np.unique(shingle_hashes(batch.column("text")[int(i)].as_py(), width)))
                size += held[-1].nbytes
                if size > 1 << 22:
                    yield out(held)
                    held, size = [], 0
            if held:
                yield out(held)

    def out(sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([fingerprint(x, words).astype(">u8").tobytes() for x in sets], pa.binary()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], ["fp", "shingles"])

    found = rows.mapInArrow(kernel, "fp binary, shingles binary")
    return found.join(nodes.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])


def similar_links(docs: DataFrame, nodes: DataFrame, *, text_col: str, width: int, words: int, radius: int, first_radius: int, similarity: float, offsets: list[tuple[int, int]]) -> DataFrame:
    """Links (a, b) of ``nodes`` (node, fp, x, y, least), enough to join all whose sets of shingles have the similarity.

    Fingerprints within the radius name the candidates of each pair of tiles; only their sets are read again, and go only to the pairs of tiles
    that name them. Tiles of long texts hold fewer nodes, so the sets behind a pair of tiles have a bounded size.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    largest = F.pow(F.lit(1 / similarity), (F.col("x") + 1) / SIZE_STEPS)  # of the sets of a cell
    tile = F.least(F.lit(TILE // 2), F.greatest(F.lit(1), F.floor(TILE_BYTES / (8 * largest))))
    few = F.col("x") <= _size_cell(FEW_SHINGLES, similarity)
    named = cut(_dealt(nodes, offsets=offsets, tile=tile, few=few).mapInArrow(_candidates(radius, first_radius), "pair long, side int, node long, few boolean"))
    wanted = cut(named.select("node").distinct().join(nodes, "node").select("node", "fp", F.col("least.text_hash").alias("text_hash")))
    sets = _shingle_sets(docs, wanted, text_col=text_col, width=width, words=words).join(wanted.select("node", "fp"), "fp")
    dealt = named.join(sets, "node").select("pair", "side", "node", "fp", "few", "shingles")
    return dealt.repartition(n, "pair").sortWithinPartitions("pair", "side").mapInArrow(_verified(radius, first_radius, similarity), "a long, b long")


def hamming_links(nodes: DataFrame, *, radius: int, offsets: list[tuple[int, int]], tile: int = TILE) -> DataFrame:
    """Links (a, b) of ``nodes`` (node, fp, x, y), enough to join all that lie within ``radius`` of each other."""
    return _dealt(nodes, offsets=offsets, tile=F.lit(tile), few=F.lit(False)).mapInArrow(_linked(radius), "a long, b long")


def _dealt(nodes: DataFrame, *, offsets: list[tuple[int, int]], tile: Column, few: Column) -> DataFrame:
    """(pair, side, node, fp, few): the nodes of each pair of tiles, sorted by pair within partitions.

    ``offsets`` are the differences of cells that may hold a pair. Cells with more than ``tile`` nodes are cut into sub-tiles by hash, and each
    node goes to the pairs of tiles that its own belongs to; ``few`` tells of each cell whether a pair begins with it. The table of cells is bounded by the population counts
    (33 x 33) or by the logarithm of the number of shingles.
    """
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = cut(nodes.groupBy("x", "y").count().select("x", "y", F.ceil(F.col("count") / tile).alias("k"), few.alias("few")))
    forward = sorted({max((dx, dy), (-dx, -dy)) for dx, dy in offsets})
    at = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in forward]))
    other = cells.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("k").alias("bk"))
    pairs = (
        cells.select("x", "y", "k", "few", at.alias("at"))
        .select("x", "y", "k", "few", (F.col("x") + F.col("at.dx")).alias("bx"), (F.col("y") + F.col("at.dy")).alias("by"))
        .join(other, ["bx", "by"])
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bk") - 1)).alias("j"))
        .where("x <> bx OR y <> by OR i <= j")
    )
    pairs = cut(pairs.withColumn("pair", F.monotonically_increasing_id()))
    own = (F.col("x") == F.col("bx")) & (F.col("y") == F.col("by")) & (F.col("i") == F.col("j"))
    sides = pairs.select("x", "y", F.col("i").alias("sub"), "pair", F.lit(0).alias("side"), "few").unionByName(
        pairs.where(~own).select(F.col("bx").alias("x"), F.col("by").alias("y"), F.col("j").alias("sub"), "pair", F.lit(1).alias("side"), "few")
    )
    placed = nodes.join(cells.drop("few"), ["x", "y"]).withColumn("sub", F.pmod(F.xxhash64("fp"), "k")).drop("k")
    dealt = placed.join(sides, ["x", "y", "sub"]).select("pair", "side", "node", "fp", "few")
    return dealt.repartition(n, "pair").sortWithinPartitions("pair", "side")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, words: int = 1, radius: int = 3, first_radius: int = 3, similarity: float = 0.8) -> DataFrame:
    """(doc_id, row, text_hash, fp, component_id, keep_row) for each row of ``docs``.

    Fingerprints of one word link at ``radius`` or fewer differing bits; wide ones if, within the radius, the sets of shingles have the
    ``similarity``. Components are all that is reachable; ``component_id`` is their smallest id (null if they have none), ``keep_row`` the row
    of it, of rows that repeat it the first. Ids keep their type, which may be any that can be ordered. A null text is an empty one: no shingle, fingerprint
    zero, linked like any other. Rows with the same fingerprint are joined without being compared. An
    empty table gives no rows. Only the two named columns are read, so others may have any name.
    """
    if words > 1:
        offsets = [(d, 0) for d in range(SIZE_STEPS + 1)]
    else:
        offsets = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if abs(dx) + abs(dy) <= radius]
    rows = cut(fingerprints(docs, id_col=id_col, text_col=text_col, width=width, words=words, similarity=similarity))
    ranked = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row", "text_hash")
    nodes = cut(rows.groupBy("fp", "x", "y").agg(F.min(ranked).alias("least"), F.count("*").alias("n")).select(F.col("least.row").alias("node"), "fp", "x", "y", "least", "n"))
    if words > 1:
        links = similar_links(docs, nodes, text_col=text_col, width=width, words=words, radius=radius, first_radius=first_radius, similarity=similarity, offsets=offsets)
    else:
        links = hamming_links(nodes, radius=radius, offsets=offsets)
    found = components(links)
    rooted = cut(nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = rooted.groupBy("root").agg(F.min("least").alias("best"), F.sum("n").alias("in_root"))
    labelled = cut(join_groups(rooted, least, ["root"], "in_root").select("fp", "x", "y", "n", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("keep_row")))
    return join_groups(rows, labelled, ["fp", "x", "y"], "n").select("doc_id", "row", "text_hash", "fp", "component_id", "keep_row")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one with the smallest id; the columns stay the same, whatever their names.

    Near copies have sets of five-word shingles of a similarity of 0.8 or more. 512-bit fingerprints find the pairs, and the sets decide. Null texts
    and texts without words are one group; ids that are null come last; of rows that agree in id and text one stays, while another text under the same id
    is judged for itself. An empty table gives no rows.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, width=width, words=WIDE_WORDS, radius=WIDE_RADIUS, first_radius=FIRST_RADIUS, similarity=similarity)
    # Texts are told by their hash within one id, so row numbers needn't be the same when the table is read again.
    keep = found.where("row = keep_row").select("text_hash", F.xxhash64("doc_id").alias("id_hash"))
    whole = docs.select(F.struct(*docs.columns).alias("whole"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.xxhash64(id_col).alias("id_hash"))
    return whole.join(keep, ["text_hash", "id_hash"]).dropDuplicates(["text_hash", "id_hash"]).select("whole.*")
