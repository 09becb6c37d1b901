"""N-gram Jaccard join by parity sketches.

A document's shingles flip bits of a sketch, so two sketches differ in at most as many bits as the two sets differ in
shingles. Documents are joined by bands of set sizes. In a band, linked sets differ in at most d shingles; the sketch is
cut into d + 1 + spare chunks, of which any two linked documents have 1 + spare alike, so an equality join on chunks loses
no link. A chunk is 2**64 bits wide and never written out: the XOR of one 64-bit code for each set bit stands for it
(codes of equal chunks are equal). The same sketch folded to some 16 bits for each shingle that linked sets may differ in is
written out, and pairs whose folded sketches differ in more bits than linked sets may differ in shingles are dropped before
any text is fetched.

A document may leave ``spare`` of its chunks out of the join as long as all documents leave out their first ones in one
order of all chunks: two linked documents then still meet. The order begins with empty chunks, whose one value unrelated
documents share, and goes on with the chunks that most sets share, which is what common shingles and passages make.

Sets, not documents, are joined: exact copies are one node from the start. A chunk that many sets share gives a star, not
all pairs; verified stars become components. Chunks that hold sets of several components then compare these by sketch, in
slices of bounded size, and offer links between components, no more than there are sets: see ``offers``.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, chunks, gathered, partitions, per_batch
from .components import components
from .textnp import Texts, U, mix, set_codes, shingles

KEY_BITS = 48
#: Bits of a folded sketch for each shingle that linked sets may differ in, at least; the next power of two is taken.
SKETCH_BITS = 16
#: Bytes of keys that a task receives, on average, before it unpacks them.
RECEIVED = 16 << 20
#: Keys that a task packs at a time.
SENT = 1 << 19
#: Parts of a star, so that its centre is sent so often at most and no task gets a whole star.
POINTS = 64
#: Sets of a chunk that one task compares with one another or with as many others.
SLICE = 2048
#: Sets whose ids are broadcast to fetch their texts; beyond that they are joined.
FETCHED = 100_000
#: Rows for which a step takes a task more: of sketches and sets, of texts that are compared, of ids only.
SKETCHED, READ, DEALT = 1 << 10, 1 << 8, 1 << 13
#: Sets with equal codes that are told apart before the job gives up.
MOST_SHARED = 1000


@lru_cache(maxsize=None)
def band_starts(percent: int) -> tuple[int, ...]:
    """Smallest set size of each band: sizes that can be linked lie in one band or in two neighbours."""
    out, low = [], 1
    while low < 1 << 40:
        out.append(low)
        low = max(low + 1, (100 * (low - 1)) // percent + 1) if low > 1 else 2
        # the largest size linked with low - 1 is 100 * (low - 1) // percent, so band k + 2 starts beyond what band k links
    return tuple(out)


def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each band: its first size, the most shingles in which linked sets differ (one of the band, one of it or the next), and spare."""
    first = np.array(band_starts(percent), np.int64)
    top = np.r_[first[1:], first[-1] * 2, first[-1] * 4] - 1
    most = np.minimum(((top[:-1] + top[1:]) * (100 - percent)) // (100 + percent), 1 << 40)
    mean = np.array([(m + 1) * math.exp(-min(50.0, f / (m + 1))) for f, m in zip(first.tolist(), most.tolist(), strict=True)])
    return first, most, np.where(most > 0, np.ceil(mean + 3 * np.sqrt(mean)) + 1, 0).astype(np.int64)


def schemes(sizes: np.ndarray, percent: int):
    """(band, chunks of each document or 0, spare) of the two bands whose chunks a document has: its own and the one before."""
    first, most, spare = bands(percent)
    own = np.maximum(np.searchsorted(first, sizes, side="right") - 1, 0)
    for back in (0, 1):
        band = np.maximum(own - back, 0)
        use = (sizes > 0) & (own >= back) & (most[band] > 0)
        yield np.where(use, band, 0), np.where(use, most[band] + 1 + spare[band], 0), np.where(use, spare[band], 0)


def chunk_keys(got: np.ndarray, docs: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, document) of every chunk that takes part in the join, and how many more of its chunks each document may leave out.

    The lowest bit of a key is that of its band's number, which tells a document's two bands apart: the last result has a row
    for even bands and one for odd ones.
    """
    keys, of, rooms = [], [], np.zeros((2, len(sizes)), np.int32)
    for band, n_chunks, spare in schemes(sizes, percent):
        base = np.r_[0, np.cumsum(n_chunks)]
        if not base[-1]:
            continue
        code, filled = np.zeros(base[-1], U), np.zeros(base[-1], bool)
        inside = n_chunks[docs] > 0
        h, d = mix(got[inside] ^ U(0x8EBC6AF09C88C6E3)), docs[inside]
        slot = base[d] + (((h >> U(32)) * n_chunks[d].astype(U)) >> U(32)).astype(np.int64)
        np.bitwise_xor.at(code, slot, mix(h))
        filled[slot] = True
        owner = np.repeat(np.arange(len(sizes)), n_chunks)
        # empty chunks are the first that a document leaves out
        nth = np.cumsum(~filled)
        nth = nth - np.r_[0, nth][base[owner]]
        stays = filled | (nth > spare[owner])
        left_out = np.bincount(owner[~stays], minlength=len(sizes))
        some = n_chunks > 0
        rooms[band[some] & 1, np.flatnonzero(some)] = (spare - left_out)[some]
        place = (np.arange(len(owner)) - base[owner]).astype(U) + (band[owner].astype(U) << U(40))
        key = mix(code ^ mix(place)) & U((1 << KEY_BITS) - 2) | (band[owner] & 1).astype(U)
        keys.append(key[stays])
        of.append(owner[stays])
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64), rooms
    return np.concatenate(keys), np.concatenate(of), rooms


def sketches(got: np.ndarray, docs: np.ndarray, sizes: np.ndarray, percent: int) -> pa.Array:
    """The folded sketch of each set: 64 bits or another power of two."""
    least = np.maximum(64, SKETCH_BITS * ((2 * sizes * (100 - percent)) // (100 + percent)))
    bits = (1 << np.ceil(np.log2(least)).astype(np.int64)) * (sizes > 0)
    base = np.r_[0, np.cumsum(bits // 64)]
    words = np.zeros(base[-1], U)
    spot = mix(got ^ U(0x8EBC6AF09C88C6E3)) & (bits[docs] - 1).astype(U)
    np.bitwise_xor.at(words, base[docs] + (spot >> U(6)).astype(np.int64), U(1) << (spot & U(63)))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((base * 8).astype(np.int32).tobytes()), pa.py_buffer(words.astype("<u8").tobytes())])


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Sketches (a row each) cut to so many words: the upper half is laid on the lower one."""
    while sketch.shape[1] > words:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def sets_of(texts: Texts, size: int, codes: tuple[int, tuple[int, ...]]):
    """Shingles of texts, and of each text their number, the code that names the set, and one more that tells sets of equal codes apart.

    ``codes``: bits of a code, and the codes that several sets have; these get others.
    """
    got, docs, n = shingles(texts, size)
    name, check = set_codes(got, docs, len(n)), set_codes(mix(got), docs, len(n))
    bits, shared = codes
    if bits < 64:
        name = name & ((1 << bits) - 1)
    if len(shared):
        name = np.where(np.isin(name, shared), mix(name.view(U) ^ mix(check.view(U))).view(np.int64), name)
    return got, docs, n, name, check


PACKED = "part int, link boolean, data binary"
#: Bytes of a (key, node) pair that are sent: the upper two of a key are always 0.
USED = np.r_[0 : KEY_BITS // 8, 8:16]


def pack(part: np.ndarray, link: bool, rows: np.ndarray) -> list[tuple[int, bool, bytes]]:
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    ends = np.r_[cut[1:], len(part)] if len(part) else []
    return [(int(part[a]), link, rows[a:b].tobytes()) for a, b in zip(cut, ends, strict=True)]


def stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts by key and node, drops repeats; then (keys, nodes, the first node of the key)."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[fresh], nodes[fresh]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys, nodes, np.repeat(nodes[head], np.diff(np.r_[head, len(keys)]))


def signatures(size: int, percent: int, codes):
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        got, docs, n, name, check = sets_of(Texts(batch.column(1)), size, codes)
        keys, _, rooms = chunk_keys(got, docs, n, percent)
        n_keys = sum(n_chunks for _, n_chunks, _ in schemes(n, percent))
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(name, mask=n == 0), pa.array(check), pa.array(n_keys, pa.int64()), *map(pa.array, rooms), sketches(got, docs, n, percent)]
        return pa.RecordBatch.from_arrays(columns, ["id", "n", "node", "check", "n_keys", "even", "odd", "sketch"])

    return per_batch(f, "text")


def sender(size: int, percent: int, n_parts: int, codes):
    """Packs the chunk keys of some documents by partition; of the sets that share a key among them, one goes on and the others are linked to it."""

    def run(batches):
        keys, nodes = [], []
        for batch in batches:
            for part in chunks(batch, "text"):
                got, docs, n, name, _ = sets_of(Texts(part.column(0)), size, codes)
                k, of, _ = chunk_keys(got, docs, n, percent)
                keys.append(k)
                nodes.append(name[of])
                if sum(map(len, keys)) >= SENT:
                    yield sent(np.concatenate(keys), np.concatenate(nodes))
                    keys, nodes = [], []
        if keys:
            yield sent(np.concatenate(keys), np.concatenate(nodes))

    def sent(keys, nodes):
        k, v, hub = stars(keys, nodes)
        lone = v == hub
        row = np.stack([k, v.view(U)], 1)[lone].view(np.uint8)[:, USED]
        rows = pack(((k[lone] >> U(1)) % U(n_parts)).astype(np.int32), False, row)
        if (~lone).any():
            more = np.stack([k, hub.view(U), v.view(U)], 1)[~lone]
            rows += pack((mix(more[:, 2]) % U(n_parts)).astype(np.int32), True, more)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], ["part", "link", "data"])

    return run


def receiver(batches):
    """All keys of a partition: those of more than one set, as links of the star."""
    alone, links = [], []
    for batch in batches:
        for link, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            if link:
                links.append(np.frombuffer(data.as_buffer(), U).reshape(-1, 3))
            else:
                rows = np.zeros((len(data.as_buffer()) // len(USED), 16), np.uint8)
                rows[:, USED] = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, len(USED))
                alone.append(rows.view(U))
    found = [x for x in links]
    if alone:
        rows = np.concatenate(alone)
        del alone
        k, v, hub = stars(rows[:, 0], rows[:, 1].view(np.int64))
        far = v != hub
        found.append(np.stack([k[far], hub[far].view(U), v[far].view(U)], 1))
    for x in found:
        for i in range(0, len(x), 1 << 16):
            y = x[i : i + (1 << 16)].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(y[:, j].copy()) for j in range(3)], ["key", "a", "b"])


def around_hubs(pairs: DataFrame, things: DataFrame, payload: list[str], judge, n_parts: int, n: int, each: int) -> DataFrame:
    """(a, b, linked) of every pair (a, b), judged by what ``things`` has of both: (node, payload).

    A star is dealt into POINTS parts; each gets its centre once, and its other ends one after the other.
    The pairs, ``n`` at most, go to as many tasks as they need at ``each`` a task.
    """
    spread = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(POINTS)).cast("int").alias("point"), "b")
    centres = spread.select("a", "point").distinct().join(things.withColumnRenamed("node", "a"), "a").select("a", "point", F.lit(None).cast("long").alias("b"), *payload)
    ends = spread.join(things.withColumnRenamed("node", "b"), "b").select("a", "point", "b", *payload)
    rows = gathered(centres.unionAll(ends).repartition(n_parts, "a", "point"), n, each).sortWithinPartitions("a", "point", F.col("b").asc_nulls_first())
    return rows.mapInArrow(judge, "a long, b long, linked boolean")


def verdicts(rows, centre):
    """Walks rows (a, b, thing) in order, b null for the centre of those that follow; (found pairs, last centre)."""
    out = []
    for a, b, thing in rows:
        if b is None:
            centre = thing
        else:
            out.append((a, b, thing, centre))
    return out, centre


def judged(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "linked"])


def apart(x: tuple[int, bytes], y: tuple[int, bytes], percent: int) -> bool:
    """Whether two sets (size, sketch) cannot be linked by what their sizes and sketches say."""
    (n, u), (m, v) = x, y
    if min(n, m) * 100 < percent * max(n, m):
        return True
    words = min(len(u), len(v)) // 8
    u, v = (folded(np.frombuffer(s, U)[None, :], words) for s in (u, v))
    return int(np.bitwise_count(u ^ v).sum()) * (100 + percent) > (100 - percent) * (n + m)


def by_sketch(percent: int):
    """Whether the sketches of each pair let it be linked."""

    def run(batches):
        centre = None
        for batch in batches:
            things = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            found, centre = verdicts(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), things, strict=True), centre)
            yield judged([(a, b, not apart(x, y, percent)) for a, b, x, y in found])

    return run


def by_text(size: int, percent: int):
    """Whether the two texts of each pair are linked."""

    def alike(u: np.ndarray, v: np.ndarray) -> bool:
        if min(len(u), len(v)) * 100 < percent * max(len(u), len(v)):
            return False
        both = len(np.intersect1d(u, v, assume_unique=True))
        return 100 * both >= percent * (len(u) + len(v) - both)

    def run(batches):
        centre = None
        for batch in batches:
            for part in chunks(batch, "text"):
                got, _, n = shingles(Texts(part.column(3)), size)
                sets = np.split(got, np.cumsum(n)[:-1])
                found, centre = verdicts(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), sets, strict=True), centre)
                yield judged([(a, b, alike(x, y)) for a, b, x, y in found])

    return run


def possible(nodes: np.ndarray, labels: np.ndarray, right: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of sets of different components whose sizes and sketches let them be linked, one left and one right, or i < j where none is right."""
    n_left = int((~right).sum())
    rows, cols = np.arange(n_left), np.arange(n_left if n_left < len(nodes) else 0, len(nodes))
    one, two = [], []
    step = max(1, (1 << 21) // max(1, len(cols) * sketch.shape[1]))
    for at in range(0, n_left, step):
        i = rows[at : at + step]
        low, high = np.minimum.outer(sizes[i], sizes[cols]), np.maximum.outer(sizes[i], sizes[cols])
        fits = (low * 100 >= percent * high) & (labels[i][:, None] != labels[cols][None, :])
        if n_left == len(nodes):
            fits &= i[:, None] < cols[None, :]
        x, y = np.nonzero(fits)
        for k in range(0, len(x), 1 << 16):
            u, v = i[x[k : k + (1 << 16)]], cols[y[k : k + (1 << 16)]]
            far = np.bitwise_count(sketch[u] ^ sketch[v]).sum(1, dtype=np.int64)
            near = far * (100 + percent) <= (100 - percent) * (sizes[u] + sizes[v])
            one.append(u[near])
            two.append(v[near])
    return (np.concatenate(one), np.concatenate(two)) if one else (rows[:0], rows[:0])


def chosen(nodes: np.ndarray, labels: np.ndarray, i: np.ndarray, j: np.ndarray, rounds: int) -> np.ndarray:
    """Which of the possible pairs to offer: stars of the busiest sets that would make components of all that the pairs connect, fewer than there are sets.

    After ``rounds`` of offers that were not all linked, 16**rounds pairs of each set besides.
    """
    of, take = np.unique(labels, return_inverse=True)[1], np.zeros(len(i), bool)
    a, b, pair = np.r_[i, j], np.r_[j, i], np.r_[np.arange(len(i)), np.arange(len(i))]
    order = np.argsort(a, kind="stable")
    a, b, pair = a[order], b[order], pair[order]
    degree = np.bincount(a, minlength=len(nodes))
    ends = np.r_[0, np.cumsum(degree)]
    for hub in np.argsort(-degree, kind="stable")[: int((degree > 0).sum())]:
        at = np.arange(ends[hub], ends[hub + 1])
        at = at[of[b[at]] != of[hub]]
        at = at[np.unique(of[b[at]], return_index=True)[1]]
        take[pair[at]] = True
        of[np.isin(of, of[b[at]])] = of[hub]
    if rounds:
        take[pair[np.arange(len(a)) - ends[a] < 16**rounds]] = True
    return take


GROUP = ["key", "i", "j"]


def by_group(batches):
    """Tables of the rows of one group each, of batches that are sorted by group."""
    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in GROUP]
        cut = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])
        for a, b in zip(cut, np.r_[cut[1:], batch.num_rows], strict=True):
            this = tuple(int(c[a]) for c in columns)
            if held and this != name:
                yield name, pa.Table.from_batches(held)
                held = []
            name = this
            held.append(batch.slice(a, b - a))
    if held:
        yield name, pa.Table.from_batches(held)


def offers(percent: int, rounds: int):
    """(key, i, j, a, b): pairs of sets of different components of a group that may be linked; rows with ``other`` are pairs that are not.

    If all that a group offers are linked, no link is left between the components that they leave.
    """

    def run(batches):
        for name, table in by_group(batches):
            known = table.filter(table["other"].is_valid())
            table = table.filter(table["other"].is_null()).sort_by([("right", "ascending"), ("node", "ascending")])
            if not table.num_rows:
                continue
            nodes, labels, sizes, right = (table[c].to_numpy() for c in ("node", "label", "n", "right"))
            if len(np.unique(labels)) < 2:
                continue
            raw = table["sketch"].to_pylist()
            words = min(map(len, raw)) // 8
            sketch = np.concatenate([folded(np.frombuffer(x, U)[None, :], words) for x in raw])
            i, j = possible(nodes, labels, right, sizes, sketch, percent)
            if known.num_rows:
                told = {frozenset(x) for x in zip(known["node"].to_pylist(), known["other"].to_pylist(), strict=True)}
                fresh = np.array([frozenset(x) not in told for x in zip(nodes[i].tolist(), nodes[j].tolist(), strict=True)], bool)
                i, j = i[fresh], j[fresh]
            take = chosen(nodes, labels, i, j, rounds)
            a, b = nodes[i[take]], nodes[j[take]]
            if len(a):
                yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(a), t) for x, t in zip(name, (pa.int64(), pa.int32(), pa.int32()), strict=True)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], [*GROUP, "a", "b"])

    return run


def signed_sets(docs: DataFrame, scratch: Scratch, size: int, percent: int, code_bits: int) -> tuple[DataFrame, DataFrame, tuple]:
    """(rows as (id, n, node), sets as (node, id, n, n_keys, even, odd, sketch), codes): a node is one set, and equal sets are one node."""
    codes: tuple = (code_bits, ())
    while True:
        signed = scratch.keep(docs.mapInArrow(signatures(size, percent, codes), "id long, n long, node long, check long, n_keys long, even int, odd int, sketch binary"))
        sets = signed.where("id is not null and n > 0").groupBy("node").agg(F.min(F.struct("id", "n", "n_keys", "even", "odd", "sketch")).alias("s"), F.min("check").alias("low"), F.max("check").alias("high"))
        sets = scratch.keep(gathered(sets.select("node", "s.*", (F.col("low") < F.col("high")).alias("shared")), signed.count(), SKETCHED))
        shared = [r["node"] for r in sets.where("shared").select("node").limit(MOST_SHARED + 1).collect()]  # none but by a chance of 2**-64 a pair
        if not shared:
            return signed, sets, codes
        if len(shared) > MOST_SHARED:
            raise ValueError("too many sets have equal codes")
        codes = (code_bits, (*codes[1], *shared))
        scratch.drop(signed, sets)


def link_documents(docs: DataFrame, scratch: Scratch, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", code_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``, in a scratch table.

    Documents link when their sets of ``size``-word shingles have a Jaccard similarity of ``percent`` hundredths or more
    (compared in whole numbers); component_id is the smallest id reachable by links. Null and blank texts have no shingles
    and link with nothing. Texts with fewer words than ``size`` have their whole word sequence as the one shingle; very long
    texts are taken whole. A row whose id is null is returned with a null component_id and lends it to no other. Repeated rows
    are returned as often as they come. Other columns of ``docs`` are not looked at. An empty table gives an empty result.
    Shingles are told apart by 64-bit hashes, sets by two of them. ``code_bits``: narrower names of sets, for tests.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed, sets, codes = signed_sets(docs, scratch, size, percent, code_bits)
    n_parts = max(partitions(spark), (signed.agg(F.sum("n_keys")).first()[0] or 0) * 16 // RECEIVED)

    packed = docs.where("id is not null").select("text").mapInArrow(sender(size, percent, n_parts, codes), PACKED)
    shared = scratch.keep(packed.repartitionById(n_parts, F.col("part")).mapInArrow(receiver, "key long, a long, b long"))
    described = sets.select("node", "n", "sketch")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are linked, by their texts."""
        n = pairs.count()
        few = 2 * n <= FETCHED  # of 16 bytes each
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = nodes.join(sets, "node").select(F.col("node").alias("want"), F.col("id").alias("of"))
        texts = docs.join(F.broadcast(wanted) if few else wanted, F.col("id") == F.col("of")).select("want", "text").mapInArrow(rechecked(size, codes), "node long, text string")
        texts = scratch.keep(gathered(texts.dropDuplicates(["node"]), 2 * n, 2 * READ))
        found = scratch.keep(around_hubs(pairs, texts, ["text"], by_text(size, percent), partitions(spark), n, READ))
        scratch.drop(texts)
        return found

    n_shared = shared.count()
    near = scratch.keep(around_hubs(shared.select("a", "b").distinct(), described, ["n", "sketch"], by_sketch(percent), partitions(spark), n_shared, 2 * SKETCHED).where("linked").select("a", "b"))
    labels = components(linked(near).where("linked").select("a", "b"), scratch)
    scratch.drop(near)

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    several = (F.min("label") < F.max("label")).alias("several")
    members = labelled(shared.select("key", F.explode(F.array("a", "b")).alias("node")).distinct())
    # a key of two sets was settled by the first comparison
    mixed = members.groupBy("key").agg(several, F.count("*").alias("held")).where("several and held > 2").select("key", "held")
    inside = members.join(mixed, "key").join(sets.select("node", "n", "even", "odd"), "node")
    # each set leaves out its chunks that most sets share, as many as it may
    busiest = Window.partitionBy("node", F.col("key") % 2).orderBy(F.desc("held"), "key")
    inside = inside.withColumn("nth", F.row_number().over(busiest)).where(F.col("nth") > F.when(F.col("key") % 2 == 0, F.col("even")).otherwise(F.col("odd")))
    inside = scratch.keep(gathered(inside.select("key", "node", "label"), 2 * n_shared, DEALT))
    scratch.drop(shared)
    # of chunks with the same sets, one does
    same = [F.count("*").alias("held"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    groups = inside.groupBy("key").agg(several, *same).where("several").groupBy("held", "x", "y").agg(F.min("key").alias("key")).select("key", F.expr(f"int((held + {SLICE - 1}) div {SLICE})").alias("slices"))
    placed = inside.select("key", "node").join(groups, "key").withColumn("at", F.pmod(F.xxhash64("node", F.lit(3)), F.col("slices")).cast("int"))
    as_left = F.expr("transform(sequence(at, slices - 1), j -> struct(at as i, j as j, false as right))")
    as_right = F.expr("if(at > 0, transform(sequence(0, at - 1), i -> struct(i as i, at as j, true as right)), array())")
    placed = placed.select("key", "node", F.explode(F.concat(as_left, as_right)).alias("e")).select("key", "e.*", "node").join(described, "node")
    placed, known, rounds = scratch.keep(gathered(placed.select(*GROUP, "right", "node", "n", "sketch"), inside.count(), SKETCHED)), None, 0
    while True:
        rows = labelled(placed).select(*GROUP, "right", "node", F.lit(None).cast("long").alias("other"), "n", "label", "sketch")
        if known is not None:
            none = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("label", "long"), ("sketch", "binary"))]
            rows = rows.unionAll(known.select(*GROUP, F.lit(False), F.col("a"), F.col("b"), *none))
        rows = gathered(rows.repartition(partitions(spark), *GROUP), placed.count(), SKETCHED).sortWithinPartitions(*GROUP)
        offered = scratch.keep(rows.mapInArrow(offers(percent, rounds), "key long, i int, j int, a long, b long"))
        if offered.isEmpty():
            break
        found = linked(offered.select("a", "b").distinct())
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(found.where("linked").select("a", "b")), scratch)
        failed = offered.join(found.where("not linked").select("a", "b").distinct(), ["a", "b"]).select(*GROUP, "a", "b")
        failed = scratch.keep(gathered(failed, offered.count(), DEALT))
        if failed.isEmpty():
            break
        open_groups = failed.select(*GROUP).distinct()
        placed = scratch.keep(gathered(placed.join(open_groups, GROUP, "left_semi"), placed.count(), SKETCHED))
        known = scratch.keep(failed if known is None else known.join(open_groups, GROUP, "left_semi").unionAll(failed))
        rounds += 1

    least = labelled(sets.select("node", "id"))
    least = least.join(least.groupBy("label").agg(F.min("id").alias("least")), "label").select(F.col("node").alias("of"), "least")
    least = scratch.keep(gathered(least, sets.count(), DEALT))
    out = signed.join(least, F.col("node") == F.col("of"), "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))
    out = scratch.keep(out)
    scratch.drop_all_but(out)
    return out


def rechecked(size: int, codes):
    """Keeps the rows whose text is that of the set they were fetched for; ids that come twice may bring others."""

    def f(part: pa.RecordBatch) -> pa.RecordBatch:
        name = sets_of(Texts(part.column(1)), size, codes)[3]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["node", "text"]).filter(pa.array(name == part.column(0).to_numpy()))

    return per_batch(f, "text")


def near_duplicates_removed(docs: DataFrame, scratch: Scratch, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that have a smaller doc_id in their group of near duplicates; blank texts and rows with a null id all stay.

    Of rows that repeat an id, none goes unless the id goes.
    """
    found = link_documents(docs, scratch, size, percent)
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
