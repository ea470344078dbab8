"""Near-duplicates by b-bit MinHash.

Each document's set of word shingles gets ``HASHES`` minima.  Groups of ``ROWS`` minima make
bands, whose equality makes candidates; only the ``BITS`` low bits of each minimum are kept,
packed into a signature.  For a candidate pair the share of equal lanes, corrected for chance
collisions, estimates the similarity; what the estimate cannot rule out is decided on the full
sets.  At similarity 0.75 a pair shares no band with probability (1 - 0.75**4)**32, 5 in a
million, and an estimate below ``FLOOR`` is over five deviations off.

Documents with equal sets form one class and are linked without being compared.  Among the
classes, no bucket is expanded into its pairs: its members are first compared with one hub,
then with another where several components remain, and only members of different components
are compared further, in blocks bounded in rows and bytes: by signatures first, and what these
leave open by the full sets, on the spot, so that a block emits a tree of links at most.  A chunk
of a bucket goes into its blocks as one row, so members are joined once a bucket, however large it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import append_arrow, by_bytes, discard, fresh, lower_ascii, mix64, eights, small_join, span_hash, stored, utf8_slices, words_of

HASHES, ROWS, BITS, SHINGLE = 128, 4, 4, 5
BANDS = HASHES // ROWS
CHUNK, FLOOR = 1_000_000, 0.55
#: Members of a bucket, and bytes of their sets, that one side of a block has, about.
BLOCK, BLOCK_BYTES = 1_024, 16_000_000
#: Two-column tables of ids are broadcast up to this many rows (about 16 MB).
ID_ROWS = 500_000
#: Links that one task contracts at a time.
LINKS = 1_000_000

_RNG = np.random.default_rng(1_234_567)
_A, _C = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_STEPS = _RNG.integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending in each, and the rows' offsets into them."""
    raw, n = lower_ascii(raw), len(offsets) - 1
    start, stop, row = words_of(raw, offsets)
    word = span_hash(eights(raw), start, stop)
    count = np.bincount(row, minlength=n)
    steps = _STEPS if size == SHINGLE else np.random.default_rng(size).integers(1, 1 << 63, size + 1, dtype=np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        if len(word) >= size:
            full = row[: len(row) - size + 1] == row[size - 1 :]
            value = np.zeros(len(full), np.uint64)
            for j in range(size):
                value += word[j : j + len(full)] * steps[j]
            value, owner = mix64(value[full]), row[: len(full)][full]
        else:
            value, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        few = np.flatnonzero((count > 0) & (count < size))
        if len(few):  # too few words for a shingle: the whole sequence is one
            first = np.searchsorted(row, few)
            whole = np.full(len(few), steps[size]) * count[few].astype(np.uint64)
            for j in range(size - 1):
                more = count[few] > j
                whole[more] += word[first[more] + j] * steps[j]
            value, owner = np.concatenate([value, mix64(whole)]), np.concatenate([owner, few])
    order = np.argsort(value)
    order = order[np.argsort(owner[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(n + 1))


def sketch_batch(column) -> tuple:
    """n_shingles, two 64-bit keys of the set, band hashes and packed signature of each text."""
    raw, offsets = utf8_slices(column)
    n = len(offsets) - 1
    sizes, keys = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
    bands, packed = np.zeros((n, BANDS), np.uint64), np.zeros((n, HASHES * BITS // 8), np.uint8)
    for a, b in by_bytes(offsets, CHUNK):
        value, cuts = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        sizes[a:b] = np.diff(cuts)
        some = np.flatnonzero(np.diff(cuts))
        if not len(some):
            continue
        at = cuts[:-1][some]
        with np.errstate(over="ignore"):
            keys[a + some, 0] = np.add.reduceat(mix64(value), at)
            keys[a + some, 1] = np.add.reduceat(mix64(value ^ np.uint64(0xA0761D6478BD642F)), at)
            low, high = value.astype(np.uint32), (value >> np.uint64(32)).astype(np.uint32)
            minima = np.empty((HASHES, len(some)), np.uint32)
            for k in range(HASHES):
                minima[k] = np.minimum.reduceat(low * _A[k] + high * _C[k] + _B[k], at)
            rolled = np.zeros((BANDS, len(some)), np.uint64)
            for j in range(ROWS):
                rolled = mix64(rolled + minima[j::ROWS] + np.uint64(1))
            rolled = mix64(rolled + np.arange(BANDS, dtype=np.uint64)[:, None])
        bands[a + some] = rolled.T
        low_bits = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint8).T
        packed[a + some] = low_bits[:, 0::2] | (low_bits[:, 1::2] << BITS)
    ends = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
    band_lists = pa.ListArray.from_arrays(ends, pa.array(bands[sizes > 0].reshape(-1).view(np.int64)))
    return pa.array(sizes), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), band_lists, pa.array([p.tobytes() for p in packed], pa.binary())


def estimate(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (rows of bytes): equal lanes, less what chance makes equal."""
    differ = one ^ other
    equal = ((differ & 15) == 0).sum(-1) + ((differ >> BITS) == 0).sum(-1)
    chance = 2.0**-BITS
    return (equal / HASHES - chance) / (1 - chance)


def _may_link(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose sizes and signatures do not rule a link out."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.filter(100 * F.least("n_a", "n_b") >= 75 * F.greatest("n_a", "n_b"))

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731,B023
            signature = lambda c: utf8_slices(get(c))[0].reshape(batch.num_rows, -1)  # noqa: E731,B023
            ok = pa.array(estimate(signature("s_a"), signature("s_b")) >= FLOOR)
            yield pa.RecordBatch.from_arrays([get("a"), get("b")], ["a", "b"]).filter(ok)

    return both.mapInArrow(run, pairs.select("a", "b").schema)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets have 100 * intersection >= percent * union."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("members").alias(f"m_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731,B023
            ok = []
            for one, other in zip(get("m_a"), get("m_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (one, other))
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([get("a"), get("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, pairs.select("a", "b").schema).distinct()


def _contract(batches):
    """Each node of a partition's links with the least node that they reach within the partition."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    links = pa.Table.from_batches(batches)
    both = pa.chunked_array([*links.column("a").chunks, *links.column("b").chunks]).combine_chunks()
    names = pc.unique(both)
    names = names.take(pc.array_sort_indices(names))
    at = pc.index_in(both, names).to_numpy()
    a, b, least = at[: links.num_rows], at[links.num_rows :], np.arange(len(names))
    while True:
        before = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        least = least[least]
        while (least != (deeper := least[least])).any():
            least = deeper
        if (least == before).all():
            break
    far = np.flatnonzero(least != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([names.take(pa.array(least[far])), names.take(pa.array(far))], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable.

    Partitions of at most ``LINKS`` links are contracted to stars, each by itself; as long as
    there are several, a large-star and a small-star step join what they found, by minima with
    map-side combination, and the rounds go on until nothing changes.  Each is written to the
    shared folder.
    """
    schema = edges.select("a", "b").schema

    def contracted(df: DataFrame) -> tuple[DataFrame, int, tuple]:
        parts = max(1, -(-df.count() // LINKS))
        out = stored(df.repartition(parts).mapInArrow(_contract, schema), "edges")
        discard(df)
        return out, parts, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) if parts > 1 else ()

    edges, parts, seen = contracted(edges.select("a", "b"))
    while parts > 1:
        ways = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a != b").distinct()
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lowest, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("e"))
        before = seen
        edges, parts, seen = contracted(stored(small.select("e.a", "e.b").filter("a != b").distinct(), "edges"))
        if seen == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))


def _as_row(group: pa.Table, keys: list[str]) -> pa.Table:
    """A group as one row: its keys, and a list of each other column; no row for an empty one."""
    ends = pa.array([0, group.num_rows], pa.int32())
    lists = {c: pa.ListArray.from_arrays(ends, group.column(c).combine_chunks()) for c in group.column_names if c not in keys}
    return pa.table({k: group.column(k).slice(0, 1) for k in keys} | {c: v.slice(0, min(1, group.num_rows)) for c, v in lists.items()})


def _as_rows(packed: pa.Table) -> pa.Table:
    """The rows that :func:`_as_row` made lists of."""
    columns = {c: packed.column(c).combine_chunks() for c in packed.column_names}
    times = next(pc.list_value_length(v) for v in columns.values() if pa.types.is_list(v.type)).to_numpy()
    row = pa.array(np.repeat(np.arange(packed.num_rows), times))
    return pa.table({c: v.flatten() if pa.types.is_list(v.type) else v.take(row) for c, v in columns.items()})


def _packed(df: DataFrame, keys: list[str], lists: str) -> DataFrame:
    """One row for each group, by :func:`_as_row`; ``lists`` names and types the other columns."""
    schema = StructType([*df.select(*keys).schema, *StructType.fromDDL(lists)])
    return df.select(*schema.names).groupBy(*keys).applyInArrow(lambda group: _as_row(group, keys), schema)


def _each_once(packed: pa.Table) -> pa.Table:
    """A chunk's members, once each, of the lists that its blocks gave."""
    keys = ["bucket", "chunk", "node"]
    return _as_rows(packed).group_by(keys).aggregate([("comp_hash", "min")]).select([*keys, "comp_hash_min"]).rename_columns([*keys, "comp_hash"])


def _chunks_open(percent: int):
    """:func:`_open_in_block` on a row for each chunk; gives a row for each chunk that has such members."""

    def run(packed: pa.Table) -> pa.Table:
        found = _open_in_block(percent)(_as_rows(packed))
        sides = [found.filter(pc.equal(found.column("chunk"), c)) for c in pc.unique(found.column("chunk"))]
        return pa.concat_tables(_as_row(side, ["bucket", "low", "high", "chunk"]) for side in sides or [found])

    return run


def _chunks_linked(percent: int):
    """:func:`_links_in_block` on a row for each chunk."""
    return lambda packed: _links_in_block(percent)(_as_rows(packed))


def _open_in_block(percent: int):
    """Of a block's members, those that sizes and signatures allow a link to another component."""

    def run(block: pa.Table) -> pa.Table:
        chunk, low, high = block.column("chunk").to_numpy(), block.column("low")[0].as_py(), block.column("high")[0].as_py()
        comp, size = block.column("comp_hash").to_numpy(), block.column("n_shingles").to_numpy()
        signature = utf8_slices(block.column("signature"))[0].reshape(block.num_rows, -1)
        left, right, found = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high), np.zeros(block.num_rows, bool)
        for i in left:
            js = right[right > i] if low == high else right
            js = js[(comp[js] != comp[i]) & (100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i]))]
            js = js[estimate(signature[js], signature[i]) >= FLOOR]
            found[js] = True
            found[i] |= len(js) > 0
        return block.select(["bucket", "low", "high", "chunk", "node", "comp_hash"]).filter(pa.array(found))

    return run


def _links_in_block(percent: int):
    """Links between the components of one block (a chunk of a bucket with itself, or two chunks).

    Pairs that the signatures leave possible are decided on the full sets at once, in the
    first band that the two share; a link joins their components, so a block gives fewer links
    than it has rows.
    """

    def run(block: pa.Table) -> pa.Table:
        chunk, node, low, high = block.column("chunk").to_numpy(), block.column("node"), block.column("low")[0].as_py(), block.column("high")[0].as_py()
        comp = np.unique(block.column("comp_hash").to_numpy(), return_inverse=True)[1]
        signature = utf8_slices(block.column("signature"))[0].reshape(block.num_rows, -1)
        bands, bucket = block.column("bands").combine_chunks().flatten().to_numpy().reshape(block.num_rows, -1), block.column("bucket")[0].as_py()
        raw, at = utf8_slices(block.column("members"))
        values = raw.view(np.uint64) if raw.flags.aligned and not raw.ctypes.data % 8 else np.frombuffer(raw.tobytes(), np.uint64)
        at = at // 8
        size = np.diff(at)
        left, right, a, b = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high), [], []
        for i in left:
            js = right[right > i] if low == high else right
            js = js[(comp[js] != comp[i]) & (100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i]))]
            js = js[estimate(signature[js], signature[i]) >= FLOOR]
            if len(js):
                js = js[bands[i][(bands[js] == bands[i]).argmax(1)] == bucket]
            if not len(js):
                continue
            n = size[js]
            where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[js], n)
            own, theirs = values[at[i] : at[i + 1]], values[where]
            found = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            common = np.add.reduceat((own[found] == theirs).astype(np.int64), np.cumsum(n) - n)
            for j in js[100 * common >= percent * (n + size[i] - common)]:
                if comp[i] != comp[j]:
                    comp[comp == comp[j]] = comp[i]
                    a.append(i)
                    b.append(j)
        return pa.table({"a": node.take(pa.array(a, pa.int64())), "b": node.take(pa.array(b, pa.int64()))})

    return run


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of non-space of the text in lower case (A-Z only); the set is that of the
    distinct five-word shingles, or with fewer words the whole sequence.  Documents with
    100 * intersection >= percent * union are linked; component_id is the smallest doc_id
    reachable, and kept says that it is the document's own.  Null and empty texts have the
    empty set and are linked with nothing; rows with a null doc_id are compared with nothing
    and kept, with a null component.  Rows that share a doc_id count as one document.  Texts
    of any length are whole.  An empty table gives an empty table; other columns of ``docs``
    are not returned.
    """
    ident, = fresh(["n_shingles", "component_id", "kept"], "doc_id")
    rows = docs.select(F.col(f"`{doc_id}`").alias(ident), F.col(f"`{text}`").cast("string").alias("text"))
    id_type = rows.schema[ident].dataType.simpleString()
    fields = [("n_shingles", "long"), ("k1", "long"), ("k2", "long"), ("bands", "array<long>"), ("signature", "binary")]
    sketch = stored(append_arrow(rows, ["text"], fields, lambda: sketch_batch, [ident]), "sketch")

    # Equal sets are one class, named by its least doc_id; its rows have equal bands and signatures.
    members = sketch.filter(f"n_shingles > 0 and {ident} is not null").select(ident, "k1", "k2", "n_shingles")
    classes = stored(members.groupBy("k1", "k2", "n_shingles").agg(F.min(ident).alias("node"), F.count("*").alias("copies")), "classes")
    key = [F.col(c) for c in ("k1", "k2", "n_shingles")]
    own = classes.select(F.col("node").alias(ident), *key)
    nodes = sketch.join(own, [ident, "k1", "k2", "n_shingles"], "left_semi").dropDuplicates([ident, "k1", "k2"])
    nodes = stored(nodes.select(F.col(ident).alias("node"), "n_shingles", "bands", "signature"), "nodes")

    spread = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    hubs = spread.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("size"), F.sum("n_shingles").alias("shingles")).filter("size > 1")
    buckets = stored(spread.drop("n_shingles").join(hubs, "bucket"), "buckets")

    wanted = buckets.select("node").distinct()
    holders = small_join(rows, wanted.withColumnRenamed("node", ident), ident, "left_semi", rows=0 if wanted.count() <= ID_ROWS else None)

    def to_sets():
        def work(column):
            raw, offsets = utf8_slices(column)
            out = []
            for a, b in by_bytes(offsets, CHUNK):
                value, cuts = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out += [value[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
            return (pa.array(out, pa.binary()),)

        return work

    sets = append_arrow(holders, ["text"], [("members", "binary")], to_sets, [ident])
    sets = stored(sets.withColumnRenamed(ident, "node").dropDuplicates(["node", "members"]), "sets")
    thin = nodes.select("node", "n_shingles", "signature")

    first = buckets.filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    edges = stored(_linked(_may_link(first, thin), sets, percent), "links")
    labels = components(edges)

    def open_buckets(labels):
        """Members of buckets of three or more with several components left, with their component."""
        named = buckets.filter("size > 2").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi")
        return stored(named.join(several, "bucket"), "open")

    # A second hub: the member whose component is the greatest, against the other components.
    still = open_buckets(labels)
    second = still.groupBy("bucket").agg(F.max_by("node", "component").alias("second"))
    pairs = still.join(second, "bucket").filter("component != hi and node != hub").select(F.col("second").alias("a"), F.col("node").alias("b")).distinct()
    more = stored(_linked(_may_link(pairs, thin), sets, percent), "links")
    discard(still)
    fewer, edges = (edges, more), stored(edges.union(more), "links")
    discard(*fewer)
    labels = components(edges)

    # What is left: members of different components, compared in blocks of bounded size.  A chunk of a bucket
    # goes into its blocks as one row, and a member is joined with its signature and its set once a bucket.
    still = open_buckets(labels)
    chunks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") * 8 / BLOCK_BYTES)).cast("int")
    left = still.select("bucket", F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk"), chunks.alias("chunks"), "node", F.xxhash64("component").alias("comp_hash"))
    lists = f"node array<{id_type}>, comp_hash array<long>"
    packed = _packed(left.join(thin, "node"), ["bucket", "chunk", "chunks"], f"{lists}, n_shingles array<long>, signature array<binary>")
    paired = packed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    paired = paired.withColumns({"low": F.least("chunk", "with"), "high": F.greatest("chunk", "with")}).drop("with")
    block, chunk = ["bucket", "low", "high"], ["bucket", "chunk"]
    undecided = paired.groupBy(*block).applyInArrow(_chunks_open(percent), f"bucket long, low int, high int, chunk int, {lists}")
    undecided = stored(undecided, "undecided")
    members = undecided.groupBy(*chunk).applyInArrow(_each_once, f"bucket long, chunk int, node {id_type}, comp_hash long")
    packed = _packed(members.join(nodes.join(sets, "node"), "node"), chunk, f"{lists}, n_shingles array<long>, bands array<array<long>>, signature array<binary>, members array<binary>")
    paired = undecided.select(*block, "chunk").join(packed, chunk)
    rest = stored(paired.groupBy(*block).applyInArrow(_chunks_linked(percent), f"a {id_type}, b {id_type}").distinct(), "links")
    final = labels if rest.isEmpty() else components(edges.union(rest))
    discard(still, undecided, buckets, sets, nodes, edges, rest)

    # Back to the rows: class, then component.
    named = classes.join(final, "node", "left").select(*key, F.coalesce("component", "node").alias("component_id"))
    shared = named.join(classes.filter("copies > 1").select(*key), ["k1", "k2", "n_shingles"], "left_semi")
    single = final.select(F.col("node").alias(ident), F.col("component").alias("of_node"))
    out = sketch.select(ident, *key).join(shared, ["k1", "k2", "n_shingles"], "left").join(single, ident, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "of_node", ident)).otherwise(F.coalesce("of_node", ident))
    out = out.select(ident, "n_shingles", F.when(F.col(ident).isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.col(ident).eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """``docs`` without the rows that are near-duplicates of one with a smaller doc_id.

    Of rows that share a doc_id, one stays: that of the least text.  Rows with a null doc_id stay.
    """
    found = near_components(docs, doc_id, text, percent)
    ident = found.columns[0]
    found = stored(found.filter(F.col(ident).isNotNull()).groupBy(ident).agg(F.max("kept").alias("kept"), F.count("*").alias("rows")), "kept")
    named = lambda df: df.select(F.col(ident).alias(doc_id))
    gone = named(found.filter("not kept or rows > 1"))
    n = gone.count()
    single = small_join(docs, gone, doc_id, "left_anti", rows=0 if n <= ID_ROWS else n)
    several = named(found.filter("kept and rows > 1"))
    if several.isEmpty():
        return single
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    best = docs.join(several, doc_id, "left_semi").groupBy(doc_id).agg(F.min_by(row, F.struct(F.col(f"`{text}`"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))).alias("row"))
    return single.unionByName(best.select("row.*"))


#: The rows of :func:`near_components` in DuckDB's SQL: all pairs that share a shingle, and a walk over the links.
NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
least_of AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(least(l.low, d.doc_id), d.doc_id) AS component_id, coalesce(least(l.low, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_of l USING (doc_id)"""
