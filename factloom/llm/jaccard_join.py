"""N-gram Jaccard join by parity sketches.

**Sketch.** The distinct shingles of a text flip bits of a sketch: a shingle's 64-bit
hash is the address of its bit, the leading part of the address choosing one of the
sketch's blocks. A block's content is kept as the XOR of the addresses of its set
bits; two bits at one address cancel, as parity demands. Changing one shingle changes
one block at most, so both the number of differing blocks and the Hamming distance of
the sketches (also of a sketch folded to few bits) are lower bounds of the symmetric
difference of two shingle sets. At a similarity of ``num/den`` or more, that
difference is at most ``(a + b)(den - num)/(den + num)`` for sets of sizes a and b.

**Pigeonhole join.** Sets are sketched for each size band (powers of two) in which a
pair with them could have its larger set. Of its non-empty blocks, a set offers the
first ``d + 1`` in one global order, d being the largest difference possible in that
band: by the prefix principle two similar sets offer a block in common. The order
takes blocks of more shingles first and blocks held by very many texts last; which
blocks are frequent is counted over all texts beforehand, and only guides the order.
A set with ``d`` non-empty blocks or fewer also offers single shingles in the same way.

**Groups.** Texts with equal shingle sets are one class. Classes that meet in a block
are paired, up to ``SMALL_GROUP`` of them; of a larger group each is tied to one
member. Pairs are dropped if their folded sketches differ too much. What remains,
pairs and ties, spans families; all similar classes share a family. Inside families,
in tiles of bounded bytes, sketches and then exact shingle sets are compared until
each component is spanned, and only spanning links leave a tile.

Rows are texts: a repeated id does not link its rows by itself. Nulls and texts
without words have empty sets, and are linked with nothing. A row with a null id
is returned, and its component is the smallest other id linked with it, else null.
Very long texts are hashed piece by piece and compared whole. Further columns are not
read; an empty table gives an empty result. Classes are told
apart by 64-bit digests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.graph import connected_components
from factloom.llm.shingles import WIDTH, mix, shingle_set, words_of
from factloom.llm.sqltext import text_key, unused, without_keys
from factloom.session import stored

#: Classes that share a block are paired up to this number, and above it tied to one of them.
SMALL_GROUP = 24
#: A block that more texts hold, as far as they meet within scan tasks, counts as frequent.
FREQUENT = 48
#: Least and most bits of the bitmaps that are broadcast (1 to 32 MB), and bits for each value between.
BITMAP_BITS = (1 << 23, 1 << 28)
BITS_EACH = 16
#: Blocks for each shingle of the smallest set of a band.
BLOCKS = 0.75
#: Keys that one task of the join works off.
TASK_KEY_BYTES = 24 << 20
TILE_BYTES = 8 << 20
TILE_ROWS = 512

_U = np.uint64


def max_difference(a: int, b: int, num: int, den: int) -> int:
    """The largest symmetric difference of sets of these sizes at a similarity of num/den."""
    return (a + b) * (den - num) // (den + num)


def class_of(members: np.ndarray) -> int:
    """A signed 64-bit digest of a shingle set."""
    with np.errstate(over="ignore"):
        total = mix(members ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        return int(mix(np.array([total + _U(len(members)) * _U(0x9E3779B97F4A7C15)]))[0].astype(np.int64))


def bands(n: int, num: int, den: int) -> list[int]:
    """Exponents of the size bands in which a set of n could have its pair's larger set."""
    return list(range(n.bit_length() - 1, (n * den // num).bit_length()))


def block_keys(members: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the non-empty blocks of the sketch for a band, and how many shingles each holds."""
    count = max(1, math.ceil(BLOCKS * (1 << band)))
    block = ((members >> _U(32)) * _U(count)) >> _U(32)
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    content = np.bitwise_xor.reduceat(members, first)
    held = np.diff(np.append(first, len(members)))
    return mix(content + mix(block[first] + _U(band << 40))), held


def offered(members: np.ndarray, num: int, den: int, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The keys that a set offers in the join, and which of them are frequent."""
    n, keys, hot = len(members), [], []
    for band in bands(n, num, den):
        largest = n * den // num
        own = band == n.bit_length() - 1
        d = max_difference(n, min(largest, (2 << band) - 1) if own else largest, num, den)
        choices = [block_keys(members, band)]
        if len(choices[0][0]) <= d:
            choices.append((mix(members + _U((band + 64) << 40)), np.ones(n, np.int64)))
        for at, (key, held) in enumerate(choices):
            common = in_bitmap(key, frequent) if frequent is not None else np.zeros(len(key), bool)
            keep = d + 1 if at == 0 else n - -(-n * num // den) + 1
            order = np.lexsort((key, -held, common))[:keep]
            keys.append(key[order])
            hot.append(common[order])
    return np.concatenate(keys), np.concatenate(hot)


def folded(members: np.ndarray) -> bytes:
    """The parity sketch folded to two bits for each shingle of the largest set of the size band."""
    size = max(64, 4 << (len(members).bit_length() - 1))
    bits = np.bincount((members & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Hamming distance of folded sketches; the longer is folded to the length of the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def in_bitmap(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = keys & _U(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1) == _U(1)


def bitmap_of(values: DataFrame, col: str) -> np.ndarray:
    """A bitmap with the slots of the 64-bit values of ``col`` set: ``BITS_EACH`` slots a value, within ``BITMAP_BITS``.

    It is sized by a count, so it tells most other values apart however many there are, up
    to the largest size; beyond it, more pass. Slots are put together on the executors;
    the driver gets 12 bytes for each 64 slots at most.
    """
    least, most = BITMAP_BITS
    bits = min(most, max(least, 1 << (BITS_EACH * max(values.count(), 1) - 1).bit_length()))
    word = F.shiftrightunsigned(F.col(col).bitwiseAND(F.lit(bits - 1)), 6).cast("int")
    # a variable shift is not a DataFrame function, so the SQL form is used
    bit = F.expr(f"shiftleft(1L, cast(`{col}` & 63 as int))")
    words = values.where(F.col(col).isNotNull()).select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def _frequent(texts: DataFrame, num: int, den: int, width: int) -> np.ndarray:
    """The frequent blocks: keys met in several texts of a scan task, summed over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts: list[np.ndarray] = []
        for batch in batches:
            for words in words_of(batch.column(0)):
                members = shingle_set(words, width)
                if len(members) and (cid := class_of(members)) not in seen:
                    seen.add(cid)
                    parts += [block_keys(members, band)[0] for band in bands(len(members), num, den)]
            if sum(map(len, parts)) > 4_000_000:
                yield _repeated(parts)
                parts, seen = [], set()
        if parts:
            yield _repeated(parts)

    met = texts.mapInArrow(run, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c"))
    return bitmap_of(stored(met.where(F.col("c") > FREQUENT).select("k"), "frequent"), "k")


def _repeated(parts: list[np.ndarray]) -> pa.RecordBatch:
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    keys, counts = keys[counts > 1], counts[counts > 1]
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["k", "c"])


def _sketched(texts: DataFrame, width: int) -> DataFrame:
    """A row for each text: its class, size, and where the class is new to the scan task, its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            size, cids, sketches = [], [], []
            for words in words_of(batch.column(1)):
                members = shingle_set(words, width)
                cid = class_of(members) if len(members) else None
                size.append(len(members))
                cids.append(cid)
                fresh = cid is not None and cid not in seen
                sketches.append(folded(members) if fresh else None)
                if fresh:
                    seen.add(cid)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(cids, pa.int64()), pa.array(sketches, pa.binary())], names=["id", "key", "n", "cid", "sketch"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, key bigint, n bigint, cid bigint, sketch binary")


def _offers(texts: DataFrame, num: int, den: int, width: int, frequent: np.ndarray, parts: int) -> DataFrame:
    """``(p, pack)``: what classes offer, packed for each of ``parts`` targets: class digests, numbers of keys, keys.

    A frequent key leaves the task once; its other holders are tied to the first. Ties are
    packed alike, as class digests with the digests of their leaders, under negative numbers.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        leader: dict[int, int] = {}
        for batch in batches:
            cids, keys, ties = [], [], []
            for words in words_of(batch.column(0)):
                members = shingle_set(words, width)
                if not len(members) or (cid := class_of(members)) in seen:
                    continue
                seen.add(cid)
                offer, hot = offered(members, num, den, shared.value)
                heads = [leader.setdefault(k, cid) for k in offer[hot].tolist()]
                new = np.array([h == cid for h in heads], bool)
                cids.append(cid)
                keys.append(np.concatenate((offer[~hot], offer[hot][new])))
                ties.append(np.array(sorted(set(heads) - {cid}), np.int64).view(np.uint64))
            out = [*_packed(cids, keys, parts), *((-1 - p, pack) for p, pack in _packed(cids, ties, parts))]
            if out:
                to, packs = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(packs, pa.binary())], names=["p", "pack"])

    return texts.select("text").mapInArrow(run, "p int, pack binary")


def _packed(cids: list[int], keys: list[np.ndarray], parts: int) -> Iterator[tuple[int, bytes]]:
    """Keys of many classes by target."""
    flat = np.concatenate([np.zeros(0, np.uint64), *keys])
    if not len(flat):
        return
    cid = np.array(cids, np.int64)
    own = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    to = (flat % _U(parts)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    flat, own, to = flat[order], own[order], to[order]
    first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    for lo, hi in zip(first.tolist(), np.append(first[1:], len(to)).tolist(), strict=True):
        who, count = np.unique(own[lo:hi], return_counts=True)
        yield int(to[lo]), len(who).to_bytes(8, "little") + cid[who].tobytes() + count.astype(np.int32).tobytes() + flat[lo:hi].tobytes()


def _unpacked(pack: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(pack[:8], "little")
    cid = np.frombuffer(pack, np.int64, n, 8)
    count = np.frombuffer(pack, np.int32, n, 8 + 8 * n)
    return np.frombuffer(pack, np.int64, -1, 8 + 12 * n), np.repeat(cid, count)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes that offer the same key, smaller class digest first."""
    got = []
    for batch in batches:
        for p, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if p >= 0:
                got.append(_unpacked(pack))
                continue
            lead, cid = _unpacked(pack)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(lead, cid)), pa.array(np.maximum(lead, cid)), pa.array(np.ones(len(cid), bool))], names=["a", "b", "tie"])
    if not got:
        return
    key, cid = (np.concatenate(x) for x in zip(*got, strict=True))
    del got
    order = np.lexsort((cid, key))
    key, cid = key[order], cid[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])))
    key, cid = key[fresh], cid[fresh]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(first, len(key)))
    left, right, tie = [], [], []
    for g in range(2, SMALL_GROUP + 1):
        base = first[count == g]
        for i in range(g):
            for j in range(i + 1, g):
                left.append(cid[base + i]), right.append(cid[base + j]), tie.append(np.zeros(len(base), bool))
    for base, g in zip(first[count > SMALL_GROUP], count[count > SMALL_GROUP], strict=True):
        left.append(np.repeat(cid[base], g - 1)), right.append(cid[base + 1 : base + g]), tie.append(np.ones(g - 1, bool))
    a, b, t = map(np.concatenate, (left, right, tie))
    order = np.lexsort((t, b, a))
    a, b, t = a[order], b[order], t[order]
    keep = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (t[1:] != t[:-1])))[: len(a)]
    a, b, t = a[keep], b[keep], t[keep]
    for s in range(0, len(a), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(x[s : s + (1 << 18)]) for x in (a, b, t)], names=["a", "b", "tie"])


def _near(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            keep = [den * min(m, n) >= num * max(m, n) and hamming(s, t) <= max_difference(m, n, num, den) for s, t, m, n in zip(x["sa"], x["sb"], x["na"], x["nb"], strict=True)]
            yield pa.RecordBatch.from_pydict({"src": batch.column("a"), "dst": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

    return run


def _members(docs: DataFrame, width: int, wanted: np.ndarray) -> DataFrame:
    """``(cid, n, members)`` of the classes in a bitmap, once for each scan task."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            cids, sets = [], []
            for words in words_of(batch.column(0)):
                members = shingle_set(words, width)
                if len(members) == 0 or (cid := class_of(members)) in seen or not in_bitmap(np.array([cid]).view(np.uint64), shared.value)[0]:
                    continue
                seen.add(cid)
                cids.append(cid), sets.append(members.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sets, pa.binary())], names=["cid", "n", "members"])

    return docs.mapInArrow(run, "cid bigint, n bigint, members binary")


def spanning_links(cids: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that span the components of these classes: sketches are compared first, exact sets to decide."""
    order = sorted(dict(zip(cids, range(len(cids)), strict=True)).values(), key=lambda i: (len(sets[i]), cids[i]))
    cids, sets = [cids[i] for i in order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets], np.int64)
    wide = max(64, 4 << (int(size[-1]).bit_length() - 1))
    bits = np.zeros((len(sets), wide // 64), np.uint64)
    for i, members in enumerate(sets):
        bits[i] = np.packbits((np.bincount((members & _U(wide - 1)).astype(np.int64), minlength=wide) & 1).astype(np.uint8), bitorder="little").view(np.uint64)
    root = np.arange(len(sets))
    links = []
    for i in range(len(sets) - 1):
        stop = int(np.searchsorted(size, size[i] * den // num, "right"))
        rest = np.arange(i + 1, stop)
        rest = rest[root[rest] != root[i]]
        if not len(rest):
            continue
        apart = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
        near = apart <= (size[rest] + size[i]) * (den - num) // (den + num)
        rest = rest[near][np.argsort(apart[near], kind="stable")]
        for j in rest:
            if root[j] == root[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * common >= num * (size[i] + size[j] - common):
                links.append((cids[i], cids[j]))
                root[root == root[j]] = root[i]
    return links


def _span(num: int, den: int):
    def run(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(m, np.uint64) for m in group.column("members").to_pylist()]
        links = spanning_links(group.column("cid").to_pylist(), sets, num, den)
        return pa.table({"src": pa.array([a for a, _ in links], pa.int64()), "dst": pa.array([b for _, b in links], pa.int64())})

    return run


def _tiles(families: DataFrame, num: int, den: int) -> DataFrame:
    """``(cid, tile)``: families that fit are one tile; others are cut by size, and each pair of cuts is a tile.

    Cuts of sizes that no similar pair can bridge are not paired.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(max(math.log(den / num) * 1.000001, 1e-6))).cast("int")
    sized = families.withColumn("q", step)
    parts = F.ceil(F.greatest(F.count("*") / F.lit(TILE_ROWS), F.sum("n") * 8 / F.lit(TILE_BYTES))).cast("int")
    whole = sized.groupBy("fam", "q").agg(parts.alias("p"), F.count("*").alias("c"), F.sum("n").alias("s"))
    plan = whole.groupBy("fam").agg(
        F.map_from_entries(F.collect_list(F.struct("q", "p"))).alias("cuts"),
        ((F.sum("c") <= TILE_ROWS) & (F.sum("s") * 8 <= TILE_BYTES)).alias("one"),
    )
    x = sized.join(plan, "fam")
    own = F.pmod(F.xxhash64("cid"), F.col("cuts")[F.col("q")]).cast("int")
    x = x.withColumn("own", own)

    def toward(q: Column) -> Column:
        """Tiles with the cuts of step q."""
        each = F.sequence(F.lit(0), F.coalesce(F.col("cuts")[q], F.lit(0)) - 1)
        tile = F.transform(each, lambda c: F.when((q > F.col("q")) | ((q == F.col("q")) & (c >= F.col("own"))), F.concat_ws(":", F.col("q"), F.col("own"), q, c)).otherwise(F.concat_ws(":", q, c, F.col("q"), F.col("own"))))
        return F.when(F.coalesce(F.col("cuts")[q], F.lit(0)) > 0, tile).otherwise(F.array().cast("array<string>"))

    many = F.concat(toward(F.col("q")), toward(F.col("q") + 1), toward(F.col("q") - 1))
    tiles = F.when(F.col("one"), F.array(F.lit("all"))).otherwise(many)
    return x.select("cid", F.explode(tiles).alias("t"), "fam").select("cid", F.concat_ws("/", "fam", "t").alias("tile"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, width: int = WIDTH) -> DataFrame:
    """``(id_col, n_shingles, component_id)`` for every row of ``docs``.

    Texts link at ``den * intersection >= num * union`` of their shingle sets.
    """
    rows, classes = _components(docs, id_col, text_col, num, den, width)
    least = rows.where("cid is not null").groupBy("cid").agg(F.min("id").alias("least"))
    rooted = least.join(classes, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(roots, "root").select("cid", "component_id")
    out = rows.select("id", "n", "cid").join(named, "cid", "left")
    component_id = F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component_id.alias("component_id"))


def _components(docs: DataFrame, id_col: str, text_col: str, num: int, den: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``(id, key, n, cid)``, ``key`` a digest of the text, and the linked classes ``(cid, root)`` with the smallest class of their component."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"))
    if not 0 < num <= den:
        raise ValueError("the similarity must be over 0 and at most 1")
    frequent = _frequent(texts.select("text"), num, den, width)
    sketched = stored(_sketched(texts, width), "sketched")
    held = sketched.where("sketch is not null")

    # keys have 8 bytes, and about a quarter as many as shingles are offered in each of one or two bands
    shingles = held.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * shingles // TASK_KEY_BYTES))
    target = F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.col("p"))
    packed = _offers(texts, num, den, width, frequent, parts).repartitionById(parts, target)
    met = stored(packed.mapInArrow(_meet, "a bigint, b bigint, tie boolean").distinct(), "met")
    sketch = held.select("cid", "n", "sketch").dropDuplicates(["cid"])
    pairs = (
        met.where("not tie")
        .join(sketch.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        .join(sketch.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        .select("a", "b", "na", "nb", "sa", "sb")
        .mapInArrow(_near(num, den), "src bigint, dst bigint")
    )
    edges = pairs.unionAll(met.where("tie").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    families = connected_components(edges).select(F.col("node").alias("cid"), F.col("component").alias("fam"))
    families = stored(families.join(held.select("cid", "n").distinct(), "cid"), "families")

    members = _members(texts.select("text"), width, bitmap_of(families, "cid"))
    tiles = _tiles(families, num, den)
    links = members.join(tiles, "cid").groupBy("tile").applyInArrow(_span(num, den), "src bigint, dst bigint")
    linked = connected_components(links).select(F.col("node").alias("cid"), F.col("component").alias("root"))
    return sketched.select("id", "key", "n", "cid"), linked


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each group of linked texts: that with the smallest id, and of rows with this id the first by a digest of the text.

    Rows with a null id come last. Texts without words are linked with nothing, and stay.
    Rows with the same id and text are copies, of which one stays; other rows are judged by
    their own text, whatever ids they share.
    """
    rows, classes = _components(docs, id_col, text_col, num, den, width)
    x = rows.where("cid is not null").groupBy("cid", "id", "key").agg(F.count("*").alias("rows"))
    x = x.join(classes, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    row_key = lambda id_, key: F.xxhash64(id_, key)
    first = x.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("f"))
    x = stored(x.join(first, "root").select(row_key("id", "key").alias("key"), "rows", (F.col("id").eqNullSafe(F.col("f.id")) & (F.col("key") == F.col("f.key"))).alias("stays")), "component-rows")
    mine = row_key(F.col(id_col), text_key(F.col(text_col)))
    kept = without_keys(docs, mine, x.where("not stays"))
    several = x.where("stays and rows > 1").select("key")
    if several.isEmpty():
        return kept
    name = unused(kept, "key")
    marked = kept.withColumn(name, mine)
    again = marked.join(several.withColumnRenamed("key", name), name, "left_semi").dropDuplicates([name])
    return marked.join(several.withColumnRenamed("key", name), name, "left_anti").unionByName(again).select(*docs.columns)
