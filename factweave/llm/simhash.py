"""SimHash near-duplicates by anchor-point covering.

Fingerprints link if they differ in few bits. Their bits are cut into bands so that linked ones
differ in at most `TOLERANCE` bits of some band (4 differences over three bands leave one band with
at most one). In each band the anchors are a covering code of radius 1: 15 bits are covered by the
Hamming(15,11) code, the bits beyond by themselves. A fingerprint is at home at the one anchor that
covers it and is replicated to all anchors within radius plus tolerance, 14 to 15 of 2^17 or 2^18.
If x and y differ in one bit of the band, y is replicated to x's home, so comparing the homes of
each anchor with all fingerprints sent there finds every link; each comparison looks at all bits.

Exact copies and equal fingerprints are one node. An anchor's task joins linked nodes and emits one
edge for each node that isn't the least of its group there, never all pairs of a dense group.
Components come from alternating large-star and small-star steps over written tables.

Defined results: null and empty texts have no words and fingerprint 0, linked like any other;
repeated rows share a fingerprint and a component; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, slices, small_batches, tidy

SEED = 42
TOLERANCE = 1
CODE_BITS = 15
BANDS_64 = ((0, 0, 21), (0, 21, 21), (0, 42, 22))  # word, first bit, bits
DISTANCE = 4
#: Comparisons made at once, and rows gathered before they are made.
CHUNK, GATHER = 250_000, 100_000
#: Rows of an anchor that one task compares.
ANCHOR_ROWS = 100_000
#: Rows beyond which an anchor is crowded, and the part of them that a home must join for others to follow.
CROWDED, DENSE = 256, 16
#: Hashes unpacked to bits at once.
ROWS = 1 << 15
#: Bytes of the texts handled at once, and the words whose hashes are kept meanwhile.
TEXT_BYTES = 2 << 20
KNOWN_WORDS, KNOWN_BYTES = 60_000, 64


# ---- fingerprints -------------------------------------------------------------------------------


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts[i] hashes, the word of bits that are set in over half of them."""
    sums = np.zeros((len(counts), 64), np.int64)
    ends = np.cumsum(counts)
    begins = ends - counts
    for at in range(0, len(hashes), ROWS):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + ROWS]).view(np.uint8).reshape(-1, 8), axis=1)
        runs = np.arange(np.searchsorted(ends, at, "right"), np.searchsorted(ends, at + len(bits) - 1, "right") + 1)
        runs = runs[counts[runs] > 0]
        sums[runs] += np.add.reduceat(bits, np.maximum(begins[runs] - at, 0), axis=0, dtype=np.int32)
    return np.packbits(2 * sums > counts[:, None], axis=1).view(np.uint64).ravel()


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of each run of size words, repeats included; of the whole sequence if it is shorter."""
    words = text.lower().split()  # bytes: A-Z only, and space and 0x09 to 0x0D only
    if not words:
        return []
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(whole, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(whole[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def text_fingerprints(documents: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and the 64-bit fingerprint of each text, as a signed long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 64, TEXT_BYTES):
                found = [shingle_hashes(t or b"", size) for t in batch.column(1).to_pylist()]
                counts = np.array([len(f) for f in found], np.int64)
                prints = majority(np.array([h for f in found for h in f], np.uint64), counts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "f0"])
        tidy()

    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(make, "doc_id long, f0 long")


def spread(x: np.ndarray) -> np.ndarray:
    """A second 64-bit hash from a first."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class ShingleHashes:
    """Hashes of a text's words, and from them the distinct hashes of its runs of size words, or of
    the whole sequence if it is shorter."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def words(self, text: bytes) -> np.ndarray:
        known, words = self.known, text.lower().split()
        if len(known) > KNOWN_WORDS:
            known.clear()
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w, SEED)
                if len(known) <= KNOWN_WORDS and len(w) <= KNOWN_BYTES:
                    known[w] = h
            out[i] = h
        return out

    def runs(self, words: np.ndarray) -> np.ndarray:
        n = max(1, len(words) - self.size + 1) if len(words) else 0
        run = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(min(self.size, len(words))):
                run = spread(run + words[j : j + n])
        return np.unique(run)


def wide_fingerprints(documents: DataFrame, size: int, overlap: float, common: dict[int, int]) -> DataFrame:
    """doc_id, 128 bits (w0, w1) over a text's distinct words, 128 (s0, s1) over its distinct
    shingles of size words, the number n of these, a 128-bit digest (d0, d1) of their set, and its
    prefix: the first shingles in the order (common or not, how common, hash), as many as texts that
    overlap by overlap must share one of."""
    known = np.array(sorted(common), np.uint64)
    ranks = np.array([common[h] for h in sorted(common)], np.int64)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = ShingleHashes(size)
        for whole in batches:
            for batch in slices(whole, 1, 64, TEXT_BYTES):
                words_of = [hashes.words(t or b"") for t in batch.column(1).to_pylist()]
                shingles_of = [hashes.runs(h) for h in words_of]
                out = [batch.column(0)]
                for found in ([np.unique(h) for h in words_of], shingles_of):
                    flat, counts = np.concatenate(found), np.array([len(f) for f in found], np.int64)
                    with np.errstate(over="ignore"):
                        out += [pa.array(majority(x, counts).view(np.int64)) for x in (flat, spread(flat + np.uint64(1)))]
                out.append(pa.array([len(f) for f in shingles_of], pa.int64()))
                digests = b"".join(xxhash.xxh3_128_digest(f.tobytes()) for f in shingles_of)
                out += [pa.array(d) for d in np.frombuffer(digests, np.int64).reshape(-1, 2).T.copy()]
                firsts = [prefix(f, known, ranks, overlap) for f in shingles_of]
                out += [pa.array([f.tobytes() for f, _ in firsts], pa.binary()), pa.array([e for _, e in firsts], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "w0", "w1", "s0", "s1", "n", "d0", "d1", "prefix", "end"])
        tidy()

    small_batches(documents.sparkSession)
    schema = "doc_id long, w0 long, w1 long, s0 long, s1 long, n long, d0 long, d1 long, prefix binary, end long"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(make, schema)


def prefix(shingles: np.ndarray, known: np.ndarray, ranks: np.ndarray, overlap: float) -> tuple[np.ndarray, int]:
    """The first of a sorted set of shingles, those of known last and by rank, and a number that
    is never less for a later end: 63 bits of the last one, the most if it is known."""
    n, latest = len(shingles), 2**63 - 1
    if not n:
        return shingles, latest
    most = n - int(behind(np.int64(n), overlap))
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        rank = np.where(known[at] == shingles, ranks[at], 0)
        order = np.argsort(rank, kind="stable")
        shingles = shingles[order]
        if rank[order[most - 1]]:
            return shingles[:most], latest
    return shingles[:most], int(shingles[most - 1]) >> 1


def behind(n: np.ndarray, overlap: float) -> np.ndarray:
    """How many of n shingles are behind the prefix."""
    return np.ceil(overlap * n - 1e-9).astype(np.int64) - 1


# ---- anchors ------------------------------------------------------------------------------------


def patterns() -> list[list[int]]:
    """For each syndrome of the Hamming(15,11) code, the error patterns of at most two bits, the
    lightest first. Column i of the check matrix is i + 1."""
    out: list[list[int]] = [[0]] + [[1 << (s - 1)] for s in range(1, CODE_BITS + 1)]
    for i in range(CODE_BITS):
        for j in range(i):
            out[(i + 1) ^ (j + 1)].append(1 << i | 1 << j)
    return out


def anchors(word: Column, first: int, bits: int, band: int) -> Column:
    """Structs of anchor and home: the covering anchor first, then all within radius + tolerance."""
    value = F.shiftrightunsigned(word, first).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    code = value.bitwiseAND(F.lit((1 << CODE_BITS) - 1))
    syndrome = F.lit(0)
    for j in range(4):
        mask = sum(1 << i for i in range(CODE_BITS) if (i + 1) >> j & 1)
        syndrome = syndrome + (F.bit_count(code.bitwiseAND(F.lit(mask))) % 2) * (1 << j)
    near = F.get(F.array(*[F.array(*map(F.lit, p)) for p in patterns()]), syndrome)
    home = value.bitwiseXOR(F.get(near, F.lit(0)))
    others = F.concat(F.transform(near, value.bitwiseXOR), F.array(*[home.bitwiseXOR(F.lit(1 << b)) for b in range(CODE_BITS, bits)]))
    return F.transform(others, lambda a: F.struct(a.bitwiseOR(F.lit(band << 24)).alias("anchor"), (a == home).alias("home")))


def local_edges(anchor: np.ndarray, home: np.ndarray, words: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the least row each is joined with, among rows of equal anchor. Rows are sorted by
    anchor, homes first.

    At a crowded anchor a few homes are compared with all rows first. Where they join a dense group
    its rows are compared with the others alone, so it costs its size and not the square of it.
    """
    n = len(anchor)
    begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if n else np.array([], np.int64)
    sizes = np.diff(np.concatenate([begins, [n]]))
    homes = np.flatnonzero(home)
    group = np.searchsorted(begins, homes, "right") - 1
    label = np.arange(n)

    def near(a, b) -> np.ndarray:
        return sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int16) for w in words) <= most

    for g in np.flatnonzero(sizes > CROWDED).tolist():
        begin, end = int(begins[g]), int(begins[g] + sizes[g])
        here = label[begin:end]
        free = homes[np.searchsorted(group, g, "left") : np.searchsorted(group, g, "right")]
        while len(free):
            found = near(int(free[0]), slice(begin, end))
            joined = np.unique(here[found])
            here[np.isin(here, joined)] = joined[0]
            free = free[here[free - begin] != joined[0]]
            if found.sum() * DENSE < end - begin:
                break

    # the rows with other labels than a home's lie before and behind its own in the order of labels
    order = np.argsort(label, kind="stable")
    ranked = label[order]
    low, high = np.searchsorted(ranked, label[homes], "left"), np.searchsorted(ranked, label[homes], "right")
    row = np.concatenate([homes, homes])
    first = np.concatenate([begins[group], high])
    size = np.concatenate([low - begins[group], begins[group] + sizes[group] - high])
    row, first, size = row[size > 0], first[size > 0], size[size > 0]
    upto = np.cumsum(size)
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
        reps, total = size[at:stop], int(size[at:stop].sum())
        a = np.repeat(row[at:stop], reps)
        b = order[np.arange(total) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first[at:stop], reps)]
        link = near(a, b)
        a, b = a[link], b[link]
        while len(a):
            low = np.minimum(label[a], label[b])
            before = label.copy()
            for x in (a, b, before[a], before[b]):
                np.minimum.at(label, x, low)
            label = label[label]
            if np.array_equal(label, before):
                break
        at = stop
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def linked(nodes: DataFrame, band_words: list[str], check_words: list[str], bands: tuple, most: int, block: int = ANCHOR_ROWS) -> DataFrame:
    """Edges (a, b) that join all nodes (id, words) whose check words differ in at most most bits
    and that differ in at most TOLERANCE bits of some band of the band words. The rows of an anchor
    of more than `block` are cut into blocks, and the homes of each meet each block in a task of their
    own."""
    found = F.concat(*[anchors(F.col(band_words[w]), first, bits, k) for k, (w, first, bits) in enumerate(bands)])
    rows = nodes.select("id", *check_words, F.explode(found).alias("to")).select("to.anchor", "to.home", "id", *check_words)
    hot = save(rows.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1"), "hot")
    if hot.head(1):
        rows = rows.join(hot, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("long")
        every = F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)
        place = lambda of, with_, home: F.struct(F.shiftleft(of, 32).bitwiseOR(with_).alias("part"), F.lit(home).alias("home"))
        met = F.transform(F.filter(every, lambda i: ~F.col("home") | (i != own)), lambda i: place(i, own, False))
        places = F.when(F.col("home"), F.concat(F.transform(every, lambda j: place(own, j, True)), met)).otherwise(met)
        rows = rows.select("anchor", F.explode(places).alias("at"), "id", *check_words).select("anchor", "at.part", "at.home", "id", *check_words)
    else:
        rows = rows.select("anchor", F.lit(0).cast("long").alias("part"), "home", "id", *check_words)
    rows = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home"), "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def changes(rows: pa.Table) -> np.ndarray:
            """Where a row's anchor or part isn't that of the row before."""
            anchor, part = rows["anchor"].to_numpy(), rows["part"].to_numpy()
            return np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])

        def edges(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            ids = rows["id"].to_numpy()
            words = [rows[c].to_numpy().view(np.uint64) for c in check_words]
            moved, to = local_edges(np.cumsum(changes(rows)), rows["home"].to_numpy(zero_copy_only=False), words, most)
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[to])], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= GATHER:
                rows = pa.Table.from_batches(held)
                whole = int(np.flatnonzero(changes(rows))[-1])  # the last anchor may go on
                if whole:
                    yield edges(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
        if held and sum(b.num_rows for b in held):
            yield edges(pa.Table.from_batches(held))
        tidy()

    return rows.mapInArrow(compare, "a long, b long").where("a != b")


# ---- components ---------------------------------------------------------------------------------


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (a, b)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    joined = both.join(least, "a")
    moved = joined.where(F.col("b") > F.col("a")) if large else joined
    out = moved.select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("low").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and root, the least id reachable, of every node that has an edge and isn't a root."""
    edges, before = save(edges.distinct(), "edges"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now
        edges = save(star(star(edges, large=True), large=False), "edges")


def grouped(prints: DataFrame, band_words: list[str], check_words: list[str], bands: tuple, most: int, confirm: Callable | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """prints (doc_id, words) with component_id, the least doc_id that links reach. confirm makes
    edges from prints, nodes and their roots, of the links that hold. carried: columns of prints for
    it that tell no nodes apart."""
    words = [c for c in prints.columns if c != "doc_id" and c not in carried]
    prints = save(prints, "prints")
    nodes = save(prints.groupBy(*words).agg(F.min("doc_id").alias("id")), "nodes")
    roots = components(linked(nodes, band_words, check_words, bands, most))
    if confirm:
        roots = components(confirm(prints, nodes, roots))
    found = nodes.join(roots, "id", "left").select(*words, F.coalesce("root", "id").alias("component_id"))
    return prints.drop(*carried).join(save(found, "found"), words)


def simhash_groups(documents: DataFrame) -> DataFrame:
    """Fingerprints over 4-word shingles; linked at DISTANCE or fewer differing bits."""
    return grouped(text_fingerprints(documents), ["f0"], ["f0"], BANDS_64, DISTANCE)


# ---- near copies by an exact overlap ------------------------------------------------------------

BANDS_128 = ((0, 0, 21), (0, 21, 21), (0, 42, 22), (1, 0, 21), (1, 21, 21), (1, 42, 22))
SHINGLE = 5
OVERLAP = 0.8
NEAR_BITS = 32
#: Shingles of a group that one task compares. Larger groups are cut into blocks of about as many,
#: and each pair of blocks is a task of its own. A text counts as ROW_SHINGLES more than it has.
BLOCK_SHINGLES, ROW_SHINGLES = 1 << 18, 64
#: Documents sampled for common shingles, how many must hold one, and how many of them are known.
SAMPLE, COMMON, MOST_COMMON = 10_000, 3, 50_000
#: Rows of a common shingle's list that are one block.
LIST_ROWS = 4_000
#: Pairs up to which their ids go to the texts and not the texts to them.
BROADCAST_PAIRS = 100_000


def overlapping(ids: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], overlap: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the least row each is joined with, among rows sorted by id: those of one id, and
    those whose sets overlap by `overlap` or more. Of several blocks only rows of different ones are
    compared. Rows already joined aren't."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    code = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    mark = np.zeros(int(code.max()) + 1 if len(code) else 0, bool)
    label = np.searchsorted(ids, ids)
    apart = blocks.min() != blocks.max()
    for i in range(n - 1):
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if apart:
            j = j[blocks[j] != blocks[i]]
        j = j[np.minimum(sizes[j], sizes[i]) >= overlap * np.maximum(sizes[j], sizes[i]) - 1e-9]
        if not len(j):
            continue
        if sizes[i]:  # then all the others have some as well
            own = code[begins[i] : ends[i]]
            mark[own] = True
            firsts = np.cumsum(sizes[j]) - sizes[j]
            if len(j) == n - 1 - i:
                held = mark[code[begins[j[0]] :]]
            else:
                held = mark[code[np.arange(int(sizes[j].sum())) + np.repeat(begins[j] - firsts, sizes[j])]]
            common = np.add.reduceat(held, firsts, dtype=np.int64)
            mark[own] = False
            j = j[common >= overlap * (sizes[i] + sizes[j] - common) - 1e-9]
        if len(j):
            joined = np.unique(np.append(label[j], label[i]))
            label[np.isin(label, joined)] = joined[0]
    moved = np.flatnonzero(ids != ids[label])
    return moved, label[moved]


def confirmed(documents: DataFrame, nodes: DataFrame, roots: DataFrame, size: int = SHINGLE, overlap: float = OVERLAP, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Edges (a, b) that join all nodes (id, n) of one root whose texts' sets of shingles overlap by
    overlap or more: every pair of a group is compared, and none is emitted that is joined already. Each text's set goes once to the task that compares its group, or in
    a group of k blocks k times."""
    groups = roots.select("id", "root").union(roots.select(F.col("root").alias("id"), "root").distinct())
    members = nodes.select("id", "n").join(groups, "id")
    cost = F.sum(F.col("n") + ROW_SHINGLES)
    large = members.groupBy("root").agg(F.ceil(cost / block).cast("int").alias("blocks")).where("blocks > 1")
    members = members.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    rows = texts.join(save(members, "members"), "id").select("root", "id", "block", "blocks", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = ShingleHashes(size)
        for whole in batches:
            for batch in slices(whole, 4, 256, TEXT_BYTES):
                sets = [hashes.runs(hashes.words(t or b"")).tobytes() for t in batch.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], names=[*batch.schema.names[:4], "shingles"])

    sets = rows.mapInArrow(hashed, "root long, id long, block int, blocks int, shingles binary")
    pair = lambda b: F.struct(F.least("block", b).alias("low"), F.greatest("block", b).alias("high"))
    sets = sets.withColumn("to", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)))
    sets = sets.select("root", "to.low", "to.high", "id", "block", "shingles")
    sets = sets.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            ids, blocks = rows["id"].to_numpy(), rows["block"].to_numpy()
            shingles = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
            moved, to = overlapping(ids, blocks, shingles, overlap)
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[to])], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
            for first, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                key = tuple(keys[:, first].tolist())
                if held and key != last:
                    yield edges(held)
                    held = []
                held.append(batch.slice(first, end - first))
                last = key
        if held:
            yield edges(held)

    return sets.mapInArrow(compare, "a long, b long")


def common_shingles(documents: DataFrame, size: int) -> dict[int, int]:
    """The most common shingles of a sample of documents and in how many of all they may be."""
    documents = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    part = max(1, documents.count() // SAMPLE)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = ShingleHashes(size)
        for whole in batches:
            for batch in slices(whole, 1, 64, TEXT_BYTES):
                sets = [hashes.runs(hashes.words(t or b"")) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["shingle"])

    sample = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0).mapInArrow(hashed, "shingle long")
    found = sample.groupBy("shingle").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "shingle").limit(MOST_COMMON)
    return {r["shingle"] & (2**64 - 1): r["count"] * part for r in found.collect()}


def sharing(begin: np.ndarray, ids: np.ndarray, roots: np.ndarray, n: np.ndarray, end: np.ndarray, overlap: float) -> Iterator[list[np.ndarray]]:
    """Pairs of ids of different roots among rows of one list (begin: where a row's list begins) whose
    sizes allow overlap, and how many shingles of their prefixes they must share for it: common ones
    that aren't in both prefixes are behind the prefix that ends first. The rows of a list are sorted
    by n."""
    if not len(ids):
        return
    most = np.floor(n / overlap + 1e-9).astype(np.int64)
    base = (int(most.max()) + 1) * begin
    size = np.searchsorted(base + n, base + most, "right") - np.arange(len(ids)) - 1
    row = np.flatnonzero(size)
    size = size[row]
    upto = np.cumsum(size)
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
        reps, total = size[at:stop], int(size[at:stop].sum())
        a = np.repeat(row[at:stop], reps)
        b = a + 1 + np.arange(total) - np.repeat(np.cumsum(reps) - reps, reps)
        apart = roots[a] != roots[b]
        a, b = a[apart], b[apart]
        rest_a, rest_b = behind(n[a], overlap), behind(n[b], overlap)
        rest = np.where(end[a] < end[b], rest_a, np.where(end[b] < end[a], rest_b, np.maximum(rest_a, rest_b)))
        need = np.ceil(overlap / (1 + overlap) * (n[a] + n[b]) - 1e-6).astype(np.int64) - rest
        held = need <= np.minimum(n[a] - rest_a, n[b] - rest_b)
        a, b = ids[a[held]], ids[b[held]]
        yield [np.minimum(a, b), np.maximum(a, b), need[held]]
        at = stop


def candidates(prints: DataFrame, nodes: DataFrame, roots: DataFrame, overlap: float, common: dict[int, int]) -> DataFrame:
    """All pairs (a, b) of nodes of different roots that share enough of their prefixes to overlap by
    overlap; pairs that meet in several blocks count more than they share. The list of a shingle in
    very many texts is cut into blocks, and each pair of blocks compared by itself."""
    parts = {h: -(-c // LIST_ROWS) for h, c in common.items() if c > LIST_ROWS}
    known = np.array(sorted(parts), np.uint64)
    cut = np.array([parts[h] for h in sorted(parts)], np.int64)
    of = nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    rows = prints.select(F.col("doc_id").alias("id"), "n", "end", "prefix").join(of, "id").select("id", "root", "n", "end", "prefix")
    names = ["shingle", "part", "id", "root", "n", "end"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                ids, root, n, end = (batch.column(i).to_numpy() for i in range(4))
                found = [np.frombuffer(x, np.uint64) for x in batch.column(4).to_pylist()]
                counts = np.array([len(f) for f in found], np.int64)
                shingle, row = np.concatenate(found), np.repeat(np.arange(len(found)), counts)
                part = np.zeros(len(shingle), np.int64)
                if len(known):
                    i = np.minimum(np.searchsorted(known, shingle), len(known) - 1)
                    blocks = np.where(known[i] == shingle, cut[i], 1)
                    block = (spread(ids[row].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
                    to = np.repeat(np.arange(len(shingle)), blocks)
                    other = np.arange(len(to)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    shingle, row, block = shingle[to], row[to], block[to]
                    part = np.minimum(block, other) << 32 | np.maximum(block, other)
                out = [shingle.view(np.int64), part, ids[row], root[row], n[row].astype(np.int32), end[row]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    lists = rows.mapInArrow(listed, "shingle long, part long, id long, root long, n int, end long")
    lists = lists.repartition("shingle", "part").sortWithinPartitions("shingle", "part", "n")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            shingle, part, ids, root, n, end = (rows[c].to_numpy() for c in names)
            new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1])])
            alone = new & np.append(new[1:], True)
            begin = np.cumsum(new)[~alone]
            for out in sharing(begin, ids[~alone], root[~alone], n[~alone].astype(np.int64), end[~alone], overlap):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["a", "b", "need"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= GATHER:
                rows = pa.Table.from_batches(held)
                shingle, part = rows["shingle"].to_numpy(), rows["part"].to_numpy()
                last = np.flatnonzero((shingle != shingle[-1]) | (part != part[-1]))
                whole = int(last[-1]) + 1 if len(last) else 0  # the last list may go on
                if whole:
                    yield from pairs(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
        if held and sum(b.num_rows for b in held):
            yield from pairs(pa.Table.from_batches(held))

    shared = lists.mapInArrow(compare, "a long, b long, need long").groupBy("a", "b", "need").count()
    return shared.where("count >= need").select("a", "b").distinct()


def verified(documents: DataFrame, pairs: DataFrame, size: int, overlap: float) -> DataFrame:
    """The pairs (a, b) whose texts' sets of shingles overlap by overlap or more."""
    pairs = save(pairs, "pairs")
    wanted = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    if pairs.count() <= BROADCAST_PAIRS:
        wanted = F.broadcast(wanted)
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    rows = texts.join(wanted, "id").select("a", "b", "id", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = ShingleHashes(size)
        for whole in batches:
            for batch in slices(whole, 3, 64, TEXT_BYTES):
                sets = [hashes.runs(hashes.words(t or b"")).tobytes() for t in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=["a", "b", "id", "shingles"])

    sets = rows.mapInArrow(hashed, "a long, b long, id long, shingles binary")
    sets = sets.repartition("a", "b").sortWithinPartitions("a", "b", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, ours = None, []  # the sets of a of the pair at hand
        for batch in batches:
            found = []
            for a, b, i, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(data, np.uint64)
                if (a, b) != pair:
                    pair, ours = (a, b), []
                if i == a:
                    ours.append(own)
                    continue
                for other in ours:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if both >= overlap * (len(own) + len(other) - both) - 1e-9:
                        found.append(pair)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return sets.mapInArrow(compare, "a long, b long")


def near_duplicate_groups(documents: DataFrame, size: int = SHINGLE, overlap: float = OVERLAP, block: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id and component_id of near copies: texts whose five-word shingles overlap by 0.8 or more.

    First the dense groups: anchors come from a fingerprint over the distinct words, 128 bits over the
    shingles link (NEAR_BITS differing bits, 19.4 being expected at an overlap of 0.8 with a deviation
    of 4.1), and all pairs of each group so formed are decided by their sets. That isn't every link.
    Then all others: two texts that overlap by 0.8 share one of their first n - ceil(0.8 n) + 1
    shingles in any common order, so the lists of these shingles hold every link between texts of
    different groups; the pairs that share enough there are decided by their sets as well.
    """
    common = common_shingles(documents, size)

    def exact(prints: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
        roots = save(roots, "groups")
        edges = confirmed(documents, nodes, roots, size, overlap, block)
        return edges.union(verified(documents, candidates(prints, nodes, roots, overlap, common), size, overlap))

    prints = wide_fingerprints(documents, size, overlap, common)
    found = grouped(prints, ["w0", "w1"], ["s0", "s1"], BANDS_128, NEAR_BITS, exact, ("prefix", "end"))
    return found.select("doc_id", "component_id")
