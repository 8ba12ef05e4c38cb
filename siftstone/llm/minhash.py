"""Near-duplicate detection by circulant MinHash.

A document is its set of distinct word shingles. Two permutations of 32-bit
shingle hashes serve for all coordinates of the signature: the first scatters
the set, the second is shifted circularly by k for coordinate k. Bands of the
signature propose candidates; every link is confirmed on the full sets.

Within a bucket not all pairs are proposed. Documents with the same word
sequence, and so the same set, are one node from the start. First each node
meets the smallest node of one of its buckets. Where a bucket then holds several
components, each node meets the nearest by signature bits of its smallest nodes
and of its neighbours in two sorted orders, which joins most of what belongs
together. At last, nodes outside a bucket's largest component meet the bucket's
nodes in other components, once for each pair, and only those whose signature
bits leave the threshold possible. They meet inside tasks, block by block; only
links that hold become rows. What is never compared is already connected or too
far apart, so components are those of all candidate pairs.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .batches import as_texts, map_texts, word_numbers, words
from .common import cut, discard, packed
from .components import connected_components

#: Rows of a band, and the chance that a pair at the threshold meets in no band.
BAND_ROWS, MISS = 4, 1e-5
#: Signature bits for the last comparison, and the deviations beyond what the threshold gives that rule a pair out (chance 3e-7).
BITS, DEVIATIONS = 1536, 5
#: Neighbours on each side in a bucket's sorted orders, and how many of a node's are tried.
REACH, BEST = 1, 4
#: Entries of buckets that fill a partition: what is read of a bucket's nodes has one row for each of its bands.
ENTRIES = 50_000
#: Ids up to which a set of them is broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Nodes up to which their sketches (about 400 bytes each) are broadcast.
BROADCAST_SKETCHES = 50_000
#: Rows of a cell in which a hub meets its candidates, of a slice of a large bucket, and of each side of a block in the last step.
CELL, SLICE, CROSS = 64, 512, 4_096
#: Texts of each side of a tile of such a block, in which pairs are compared on their full sets.
TILE = 32, 128


def band_count(percent: int, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands needed for similarity ``percent``/100."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def _mix(x: np.ndarray, out: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of 32-bit numbers."""
    np.right_shift(x, np.uint32(16), out=out)
    np.bitwise_xor(x, out, out=x)
    np.multiply(x, np.uint32(a), out=x)
    np.right_shift(x, np.uint32(15), out=out)
    np.bitwise_xor(x, out, out=x)
    np.multiply(x, np.uint32(b), out=x)
    np.right_shift(x, np.uint32(16), out=out)
    np.bitwise_xor(x, out, out=x)
    return x


def signatures(hashes: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets that lie in a row: (coordinates x sets)."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    spare, work = np.empty_like(low), np.empty_like(low)
    scattered = _mix(low, spare, 0x7FEB352D, 0x846CA68B)
    out = np.empty((coordinates, len(starts)), np.uint32)
    for k in range(coordinates):
        np.add(scattered, np.uint32(k + 1), out=work)  # modulo 2^32: the circular shift
        out[k] = np.minimum.reduceat(_mix(work, spare, 0x21F0AAAD, 0xD35A2D97), starts)
    return out


def _scatter(n: int) -> np.ndarray:
    """``n`` odd 64-bit numbers, one for each place in a word."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each (non-empty) word: its bytes times a number for each place, summed and mixed."""
    if not len(flat):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    data = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    h = np.add.reduceat((data + np.uint64(1)) * _scatter(int(sizes.max()))[place], starts) + sizes.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """64-bit hashes of all word shingles of each text of a slice."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, flat: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in a row, where each text's begin and end, and the word at which each shingle begins.

        A text of fewer words has its whole sequence as one shingle.
        """
        h = word_hashes(flat)
        n = np.diff(ends)
        width = np.minimum(n, self.width)  # of each text's shingles
        total = np.zeros(len(h), np.uint64)
        for j in range(self.width):
            part = np.zeros(len(h), np.uint64)
            if j < len(h):
                part[: len(h) - j] = h[j:]
            # A shorter text's only shingle has fewer parts.
            part[np.repeat(width <= j, n)] = np.uint64(j + 1)
            total = (total ^ part) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        count = np.where(n > 0, n - width + 1, 0)
        kept = np.flatnonzero(np.arange(len(h)) - np.repeat(ends[:-1], n) < np.repeat(count, n))
        return total[kept], np.concatenate([[0], np.cumsum(count)]), kept


def set_size(hashes: np.ndarray, first: np.ndarray, word: np.ndarray, width: int) -> int:
    """Distinct shingles of one text. Equal hashes are compared word by word, so none hides another."""
    order = hashes.argsort()
    same = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
    one, two = first[order[same]], first[order[same + 1]]
    if all((word[one + j] == word[two + j]).all() for j in range(width)):
        return len(hashes) - len(same)
    return len({tuple(word[i : i + width]) for i in first.tolist()})


def _lists(full: np.ndarray, each: int, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(full, each, 0))]), pa.int32()), pa.array(flat))


def _digests(flat: pa.Array, ends: np.ndarray) -> list[bytes | None]:
    """BLAKE2b of each text's word sequence; null without words."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), " ")
    return [hashlib.blake2b(v.as_buffer(), digest_size=16).digest() if b > a else None for v, a, b in zip(joined, ends[:-1], ends[1:], strict=True)]


def sketch(docs: DataFrame, width: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n`` (size of the set), ``digest`` (of the word sequence; null if empty) and ``bands`` (one hash each)."""

    def make():
        shingle = Shingler(width)
        salt = (np.arange(bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[:, None]

        def run(texts: pa.Array) -> list[pa.Array]:
            flat, of_words = words(texts)
            hashes, ends, first = shingle(flat, of_words)
            word = word_numbers(flat)
            sizes = np.zeros(len(texts), np.int64)
            for i in range(len(texts)):
                a, b = ends[i], ends[i + 1]
                if b > a:
                    sizes[i] = set_size(hashes[a:b], first[a:b], word, min(width, of_words[i + 1] - of_words[i]))
            full = np.flatnonzero(sizes)
            keys = np.zeros((0, bands), np.uint64)
            if len(full):
                sig = signatures(hashes, ends[full], bands * rows).reshape(bands, rows, len(full)).astype(np.uint64)
                key = np.repeat(salt, len(full), axis=1)
                for j in range(rows):
                    key = (key ^ sig[:, j]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(32)
                keys = key.T
            return [pa.array(sizes), pa.array(_digests(flat, of_words), pa.binary()), _lists(sizes > 0, bands, keys.reshape(-1).view(np.int64))]

        return run

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(named, "text", ["id"], [("n", "long"), ("digest", "binary"), ("bands", "array<bigint>")], make)


def bit_sketch(texts: DataFrame, width: int, bits: int) -> DataFrame:
    """``digest`` and ``bits`` (one bit of each of ``bits`` coordinates, in 64-bit words) of each (id, text) with words."""

    def make():
        shingle = Shingler(width)

        def run(part: pa.Array) -> list[pa.Array]:
            flat, of_words = words(part)
            hashes, ends, _first = shingle(flat, of_words)
            full = np.diff(ends) > 0
            packed = np.zeros((0, bits // 64), np.int64)
            if full.any():
                every = signatures(hashes, ends[:-1][full], bits)
                packed = np.ascontiguousarray(np.packbits((every.T >> np.uint32(7) & np.uint32(1)).astype(bool), axis=1)).view(np.int64)
            return [pa.array(_digests(flat, of_words), pa.binary()), _lists(full, bits // 64, packed.reshape(-1))]

        return run

    return map_texts(texts, "text", [], [("digest", "binary"), ("bits", "array<bigint>")], make).where("digest IS NOT NULL").groupBy("digest").agg(F.first("bits").alias("bits"))


def shingle_set(text: str, width: int) -> set[bytes]:
    w = text.encode().lower().split()
    if not w:
        return set()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def _of_ids(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, and the columns of ``ids``) of the rows of ``docs`` whose id is in ``ids``; few of these are broadcast."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids) if few else ids, "id")


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    The documents b of an a are dealt over cells of about CELL rows. A cell gets
    the text of a once and that of each b once, so a hub of many pairs is
    neither one task nor shipped with each of them.
    """
    rows = pairs.count()
    ways = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL)).cast("int").alias("ways"))
    dealt = pairs.join(ways, "a").select("a", "b", F.pmod(F.xxhash64("b"), "ways").cast("int").alias("cell"))
    hubs = dealt.select("a", "cell").distinct()
    roles = dealt.select(F.col("b").alias("id"), "a", "cell", "b").unionByName(hubs.select(F.col("a").alias("id"), "a", "cell", F.lit(None).cast(pairs.schema["b"].dataType).alias("b")))
    roles = cut(packed(roles, 2 * rows))
    met = _of_ids(docs, roles, id_col, text_col).select("a", "cell", "b", "text")

    def run(cell: pa.Table) -> pa.Table:
        of, b, texts = cell.column("a"), cell.column("b"), as_texts(cell.column("text").combine_chunks())
        is_hub = pc.is_null(b).to_pylist()
        one = [shingle_set(t.as_py(), width) for t, h in zip(texts, is_hub, strict=True) if h]
        ok = []
        for t, h in zip(texts, is_hub, strict=True):
            two = set() if h else shingle_set(t.as_py(), width)
            ok.append(not h and any(100 * (both := len(x & two)) >= percent * (len(x) + len(two) - both) for x in one))
        return pa.table({"a": of, "b": b}).filter(pa.array(ok, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    out = cut(packed(met.groupBy("a", "cell").applyInArrow(run, f"a {kind}, b {kind}").distinct(), rows))
    discard(roles)
    return out


def block_tiles(percent: int, most: int, tile: tuple[int, int] = TILE):
    """A function of a block: the texts that its tiles need.

    A block has rows ``minor`` (outside the bucket's largest component) and
    others. It gives (tile, id, of): a tile's minor nodes with a null ``of``, the
    others with the list of minor nodes that they are to be compared with.
    """

    def array(block: pa.Table, name: str, rows: np.ndarray) -> np.ndarray:
        flat = block.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(block.num_rows, -1)[rows]

    def run(block: pa.Table) -> pa.Table:
        node, minor = block.column("node").combine_chunks(), block.column("minor").to_numpy().astype(bool)
        one, two = np.flatnonzero(minor), np.flatnonzero(~minor)
        comp = block.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        n, mark, top = (block.column(c).to_numpy() for c in ("n", "mark", "top"))
        name = "-".join(str(block.column(c)[0].as_py()) for c in ("band", "key", "_cell", "_slice"))
        band = block.column("band")[0].as_py()
        bands = [array(block, "bands", r) for r in (one, two)]
        bits = [array(block, "bits", r).view(np.uint64) for r in (one, two)] if "bits" in block.column_names else None
        found = []
        strip = max(1, 50_000 // max(len(two), 1))
        for lo in range(0, len(one), strip):
            x = one[lo : lo + strip, None]
            once = top[two] | (mark[two] <= mark[x])  # of two minor nodes one order is enough
            ok = (comp[x] != comp[two]) & once & (100 * np.minimum(n[x], n[two]) >= percent * np.maximum(n[x], n[two]))
            i, j = np.nonzero(ok)
            i += lo
            first = (bands[0][i] == bands[1][j]).argmax(axis=1) == band
            i, j = i[first], j[first]
            if bits:
                near = np.bitwise_count(bits[0][i] ^ bits[1][j]).sum(axis=1, dtype=np.int64) <= most
                i, j = i[near], j[near]
            found.append((i, j))
        i, j = (np.concatenate(v) if found else np.zeros(0, int) for v in (zip(*found, strict=True) if found else ([], [])))
        # Only nodes that are in some pair take a place in a tile.
        ones, i = np.unique(i, return_inverse=True)
        twos, j = np.unique(j, return_inverse=True)
        tiles, ids, of = [], [], []
        at = (i // tile[0]) * (len(twos) // tile[1] + 1) + j // tile[1]
        order = np.lexsort((i, j, at))
        i, j, at = i[order], j[order], at[order]
        edges = np.flatnonzero(np.diff(at, prepend=-1, append=-1)) if len(at) else np.zeros(0, int)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            heads = np.unique(i[a:b])
            lists = np.split(i[a:b], np.flatnonzero(np.diff(j[a:b])) + 1)
            tiles += [f"{name}-{at[a]}"] * (len(heads) + len(lists))
            ids += [*one[ones[heads]], *two[twos[np.unique(j[a:b])]]]
            of += [*[None] * len(heads), *[node.take(pa.array(one[ones[v]])).to_pylist() for v in lists]]
        return pa.table({"tile": pa.array(tiles, pa.string()), "id": node.take(pa.array(ids, pa.int64())), "of": pa.array(of, pa.list_(node.type))})

    return run


def confirm_tiles(roles: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of tiles, as ``block_tiles`` gives them, whose full sets have 100 * intersection >= percent * union. Each text goes to a tile once."""
    kind = roles.schema["id"].dataType.simpleString()
    roles = cut(roles)
    rows = roles.agg(F.sum(F.coalesce(F.size("of"), F.lit(0)))).first()[0] or 0
    met = _of_ids(docs, roles, id_col, text_col).select("tile", "id", "of", "text")

    def run(tile: pa.Table) -> pa.Table:
        ids, of, texts = tile.column("id").combine_chunks(), tile.column("of").combine_chunks(), as_texts(tile.column("text").combine_chunks())
        heads = pc.is_null(of).to_pylist()
        sets, a, b = {}, [], []
        for k, t, h in zip(ids.to_pylist(), texts, heads, strict=True):
            if h:
                sets.setdefault(k, []).append(shingle_set(t.as_py(), width))  # rows may share an id
        for k, t, h, others in zip(ids.to_pylist(), texts, heads, of, strict=True):
            if not h:
                two = shingle_set(t.as_py(), width)
                linked = [o for o in others.as_py() if any(100 * (both := len(x & two)) >= percent * (len(x) + len(two) - both) for x in sets[o])]
                a += linked
                b += [k] * len(linked)
        return pa.table({"a": pa.array(a, ids.type), "b": pa.array(b, ids.type)})

    out = cut(packed(met.groupBy("tile").applyInArrow(run, f"a {kind}, b {kind}").distinct(), rows))
    discard(roles)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rows: int = BAND_ROWS, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: ``<id_col>, n_shingles, component_id, kept``.

    Words are what ASCII white space separates, A-Z lower-cased. Documents are
    linked where 100 * intersection >= ``percent`` * union of their shingle
    sets; ``component_id`` is the smallest id reachable over links, ``kept``
    whether that is the document's own. A text of fewer than ``width`` words is
    one shingle; null texts and such without words have none and are linked
    with nothing. Rows that share an id are one node. A null id joins the
    component of its copies, otherwise its component is null and it is kept. An
    empty table gives no rows. Other columns, whatever their names, aren't read.

    A pair at the threshold fails to be proposed with a chance of 1e-5, pairs
    above it with far less. ``bits`` signature bits (a multiple of 64) rule out
    pairs of the last comparison that differ by more than the threshold allows
    plus DEVIATIONS deviations (chance 3e-7); with 0 none is ruled out and every
    proposed pair of two components is compared on its full sets.
    """
    bands = band_count(percent, rows)
    every = cut(sketch(docs, width, bands, rows, id_col, text_col))
    total = every.count()
    nodes = cut(packed(every.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")), total))
    entries = nodes.select("digest", "node", "n", "bands", F.posexplode("bands").alias("band", "key")).withColumn("next", F.col("bands")[(F.col("band") + 1) % bands]).drop("bands")
    hubs = entries.groupBy("band", "key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = cut(packed(entries.join(hubs, ["band", "key"]), bands * total, ENTRIES))

    def alike(x: str, y: str) -> Column:
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    p = (1 - percent / 100) / 2  # that a bit of the signatures differs at the threshold
    most = math.floor(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))

    def components(links: DataFrame) -> DataFrame:
        return connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    def labelled(df: DataFrame, found: DataFrame, node: str, comp: str) -> DataFrame:
        return df.join(found.select(F.col("id").alias(node), F.col("component").alias(comp)), node, "left").withColumn(comp, F.coalesce(comp, node))

    # Each node meets the hub with which it shares most buckets.
    hub_pairs = shared.where((F.col("node") != F.col("hub.node")) & alike("n", "hub.n")).groupBy(F.col("hub.node").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    tried = cut(packed(hub_pairs.groupBy("b").agg(F.max(F.struct("c", "a")).alias("m")).select("m.a", "b"), total))
    links = confirm(tried, docs, width, percent, id_col, text_col)
    found = components(links)
    sketches: list[DataFrame] = []

    def inside() -> DataFrame:
        """Entries of buckets that hold several components, with their node's component and the bucket's largest one."""
        rows_ = labelled(shared.select("band", "key", "next", "c", "digest", "node", "n", F.col("hub.node").alias("hub")), found, "node", "comp")
        sizes = rows_.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("k"))
        mixed = sizes.groupBy("band", "key").agg(F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").select("band", "key", F.col("top.comp").alias("top"), F.col("top.k").alias("most"))
        out = cut(packed(rows_.join(mixed, ["band", "key"]), bands * total, ENTRIES))
        if not sketches:  # later rounds have no buckets that the first has not
            inner = nodes.select("digest", "node", "bands").join(out.select("digest").distinct(), "digest")
            if bits:
                ids = cut(packed(inner.select(F.col("node").alias("id")).distinct(), total))
                inner = inner.join(bit_sketch(_of_ids(docs, ids, id_col, text_col), width, bits), "digest")
            sketches.append(cut(packed(inner.drop("node"), total)))
        return out

    def with_sketch(df: DataFrame, digest: str, *names: Column) -> DataFrame:
        """``df`` with expressions over the ``bands`` and ``bits`` of a node; few nodes are broadcast."""
        side = sketches[0].select(F.col("digest").alias(digest), *names)
        few = sketches[0].limit(BROADCAST_SKETCHES + 1).count() <= BROADCAST_SKETCHES
        return df.join(F.broadcast(side) if few else side, digest)

    def apart(x: str, y: str) -> Column:
        """Bits in which two nodes differ."""
        if not bits:
            return F.lit(0)
        return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(bits // 64)), F.lit(0))

    def neighbours(rows_: DataFrame) -> DataFrame:
        # A large bucket is dealt at random into slices of about SLICE rows, each with its own order. Of a node's
        # neighbours and hubs in other components, the BEST that differ least in their bits are tried; the last step has the others.
        met = []
        other = F.struct("digest", "node", "n", "comp")
        word = F.col("bits")[0] if bits else F.col("bands")[0]
        for number, (df, order) in enumerate(((rows_, F.col("next")), (with_sketch(rows_, "digest", word.alias("word")), F.col("word")))):
            sliced = df.select("band", "key", "digest", "node", "n", "comp", order.alias("_order"), F.pmod(F.xxhash64("node", F.lit(number)), F.ceil(F.col("c") / F.lit(SLICE))).alias("_part"))
            row = Window.partitionBy("band", "key", "_part").orderBy("_order", "node")
            before = sliced.select("digest", "node", "n", "comp", F.array(*[F.lag(other, k).over(row) for k in range(1, REACH + 1)]).alias("l"))
            met.append(before.select("digest", "node", "n", "comp", F.explode("l").alias("o")))
        hubs_ = rows_.where("node = hub").select("band", "key", other.alias("o"))
        met.append(rows_.join(hubs_, ["band", "key"]).select("digest", "node", "n", "comp", "o"))
        near_ = reduce(DataFrame.unionByName, met).where((F.col("o.comp") != F.col("comp")) & alike("n", "o.n"))
        pairs = near_.select(F.col("node").alias("a"), F.col("o.node").alias("b"), F.col("digest").alias("da"), F.col("o.digest").alias("db")).distinct()
        pairs = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(tried.select(F.col("a").alias("lo"), F.col("b").alias("hi")), ["lo", "hi"], "left_anti")
        if bits:
            pairs = with_sketch(with_sketch(pairs, "da", F.col("bits").alias("ba")), "db", F.col("bits").alias("bb"))
        best = pairs.select("a", "b", (apart("ba", "bb") if bits else F.xxhash64("a", "b")).alias("h"))
        if bits:
            best = best.where(F.col("h") <= most)
        return best.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "b"))), 1, BEST).alias("l")).select("a", F.explode("l").alias("l")).select("a", "l.b")

    def crossing(rows_: DataFrame) -> DataFrame:
        # Of a bucket's nodes, those outside its largest component meet the others in blocks of at most about CROSS by CROSS.
        names = ["node", "n", "comp", "bands", *(["bits"] if bits else [])]
        rows_ = with_sketch(rows_, "digest", *[F.col(c) for c in names[3:]]).withColumns({"_ways": F.ceil(F.col("c") / F.lit(CROSS)).cast("int"), "_mways": F.ceil((F.col("c") - F.col("most")) / F.lit(CROSS)).cast("int"), "mark": F.xxhash64("node")})

        def dealt(number: int, ways: str) -> Column:
            return F.pmod(F.xxhash64("node", F.lit(number)), ways).cast("int")

        def copies(ways: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(ways) - 1))

        side = ["band", "key", "mark", (F.col("comp") == F.col("top")).alias("top"), *names]
        minor = rows_.where("comp <> top").select(*side, F.lit(True).alias("minor"), copies("_ways").alias("_cell"), dealt(1, "_mways").alias("_slice"))
        whole = rows_.select(*side, F.lit(False).alias("minor"), dealt(2, "_ways").alias("_cell"), copies("_mways").alias("_slice"))
        kind = rows_.schema["node"].dataType.simpleString()
        return minor.unionByName(whole).groupBy("band", "key", "_cell", "_slice").applyInArrow(block_tiles(percent, most), f"tile string, id {kind}, of array<{kind}>")

    for _ in range(2):
        rows_ = inside()
        fresh = cut(packed(neighbours(rows_).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), BEST * total))
        discard(rows_)
        if not fresh.isEmpty():
            links = links.unionByName(confirm(fresh, docs, width, percent, id_col, text_col))
            tried = tried.unionByName(fresh)
            found = components(links)
    rows_ = inside()
    last = confirm_tiles(crossing(rows_), docs, width, percent, id_col, text_col)
    discard(rows_)
    if not last.isEmpty():
        found = components(links.unionByName(last))
    label = labelled(nodes.select("digest", "node"), found, "node", "component_id").select("digest", "component_id")
    return (
        every.join(label, "digest", "left")
        .withColumn("component_id", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")))
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def keep_representatives(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group of near copies the one with the smallest id.

    Rows that share an id stay or go together; rows with a null id or without
    words stay. Columns may have any names. An empty table gives no rows.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = f"c{names.index(id_col)}"
    found = near_duplicates(inner, width, percent, own, f"c{names.index(text_col)}")
    gone = cut(found.where(~F.col("kept")).select(F.col(own).alias("gone")).where("gone IS NOT NULL").distinct())
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    left = inner.join(F.broadcast(gone) if few else gone, F.col(own) == F.col("gone"), "left_anti")
    return left.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
