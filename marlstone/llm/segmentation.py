"""SentencePiece encoding and decoding: segmentations sampled from the piece lattice.

A segmentation has a probability in proportion to the product of its pieces' weights.  The
forward pass sums the weights of all ways to reach each place of the lattice; the backward
pass draws the last piece by these sums, then the one before it, and so on: an exact sample.
Uniform numbers come from a hash of the seed, the row's key and the place in the text, so a
row is segmented alike on any cluster and in any batch.

No piece has a space behind a solid character, so every lattice path passes through the
place before such a space: the stretches between these places are independent, and equal
stretches share one forward pass; so are, within a stretch, the sections between places that
no piece reaches across.  Characters without a piece become bytes, and so does the
character that stands for the space in the model's own spelling; decoding is lossless.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_arrow, by_bytes, fresh, mix64, eights, span_hash, utf8_slices

CHUNK, BITS = 500_000, 28
_STEP, _SPREAD, _SLOTS = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15), 21


@dataclass
class Pieces:
    hashes: np.ndarray
    ids: np.ndarray
    lengths: np.ndarray
    weights: np.ndarray
    table: np.ndarray
    begins: np.ndarray
    byte_ids: np.ndarray
    byte_weight: float
    pool: np.ndarray
    start: np.ndarray


@lru_cache(maxsize=2)
def load(path: str, sharpness: float = 1.0) -> Pieces:
    """The model's pieces with log weights -sharpness * ln(10 + merge rank): frequent pieces weigh most."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = len(model)
    spelt, byte_ids, usable = [b""] * n, np.zeros(256, np.int32), []
    for i in range(n):
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[3:5], 16)
            byte_ids[value], spelt[i] = i, bytes([value])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            spelt[i] = model.id_to_piece(i).replace("▁", " ").encode()
            usable.append(i)
    usable = np.array(usable)
    lengths = np.array([len(s) for s in spelt])
    pool, start = np.frombuffer(b"".join(spelt), np.uint8), np.concatenate([[0], np.cumsum(lengths)])
    assert all(b" " not in spelt[i].lstrip(b" ") for i in usable), "a piece has a space behind a solid character"
    rank = np.array([min(float(n), -model.get_score(int(i))) for i in usable])
    weights = -sharpness * np.log(10.0 + np.maximum(rank, 0))
    # Rolling hashes of the pieces, a table to find them by, and a bitmap of what they begin with.
    table, begins = np.full(1 << _SLOTS, -1, np.int32), np.zeros(1 << _SLOTS, bool)
    hashes, at, size = np.zeros(len(usable), np.uint64), start[usable], lengths[usable]
    for i in range(int(size.max())):
        inside = size > i
        hashes[inside] = _roll(hashes[inside], pool[at[inside] + i])
        begins[_slot(hashes[inside])] = True
    order = np.argsort(hashes)
    table[_slot(hashes[order])] = np.arange(len(order))
    return Pieces(hashes[order], usable[order].astype(np.int32), size[order], weights[order], table, begins, byte_ids, -sharpness * float(np.log(10.0 + n)), pool, start)


def _roll(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h + byte + np.uint64(1)) * _STEP


def _slot(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h * _SPREAD) >> np.uint64(64 - _SLOTS)).astype(np.int64)


def _edges(t: Pieces, raw: np.ndarray, stop: np.ndarray):
    """All pieces that fit into the stretches: (first byte, piece or -1 for bytes, length, log weight)."""
    lead = (raw & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    width = np.zeros(len(raw), np.int64)
    width[at] = np.diff(np.append(at, len(raw)))
    room, h, bare, found, length = stop[at] - at, np.zeros(len(at), np.uint64), lead.copy(), [], 0
    while len(at):
        h = _roll(h, raw[at + length])
        length += 1
        slot = _slot(h)
        k = t.table[slot]
        some = np.flatnonzero(k >= 0)
        k, wanted = k[some], h[some]
        other = np.flatnonzero(t.hashes[k] != wanted)  # two pieces in a slot, or none that is this
        k[other] = np.minimum(np.searchsorted(t.hashes, wanted[other]), len(t.hashes) - 1)
        right = t.hashes[k] == wanted
        some, k = at[some[right]], k[right]
        bare[some[width[some] == length]] = False
        found.append((some, t.ids[k], np.full(len(some), length), t.weights[k]))
        on = t.begins[slot] & (room > length)  # where a longer piece may begin like this
        at, h, room = at[on], h[on], room[on]
    bytes_at = np.flatnonzero(bare)
    found.append((bytes_at, np.full(len(bytes_at), -1, np.int32), width[bytes_at], width[bytes_at] * t.byte_weight))
    return [np.concatenate(x) for x in zip(*found)]


def _sample(t: Pieces, raw: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the texts one after the other, and each text's offsets into them."""
    space = raw == 32
    starts = np.zeros(len(raw), bool)
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    starts[1:] |= space[1:] & ~space[:-1]
    start = np.flatnonzero(starts)
    stop = np.append(start[1:], len(raw))
    row = np.searchsorted(offsets, start, side="right") - 1

    _, first, which = np.unique(span_hash(eights(raw), start, stop), return_index=True, return_inverse=True)
    # Stretches with the hash of another one share its lattice only if they have its bytes too.
    size = stop - start
    like = np.minimum(np.arange(len(raw)) + np.repeat(start[first[which]] - start, size), len(raw) - 1)
    other = np.searchsorted(start, np.flatnonzero(raw != raw[like]), side="right") - 1
    other = np.union1d(other, np.flatnonzero(size != size[first[which]]))
    which[other], first = len(first) + np.arange(len(other)), np.concatenate([first, other])
    size = size[first]
    base = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(first)), size)
    distinct = raw[np.arange(base[-1]) + (start[first] - base[:-1])[owner]]
    at, piece, length, weight = _edges(t, distinct, base[1:][owner])

    # Places: one before each byte of a stretch, and one at its end.
    source = at + owner[at]
    target = source + length
    # Where no piece reaches across, a stretch falls into sections, whose ways are independent too.
    crossed = np.bincount(source + 1, minlength=base[-1] + len(first) + 1) - np.bincount(target, minlength=base[-1] + len(first) + 1)
    opens = np.cumsum(crossed) == 0
    opens[base[:-1] + np.arange(len(first))] = True
    section = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0))
    order = np.argsort(target, kind="stable")
    piece, length, weight, source, target = piece[order], length[order], weight[order], source[order], target[order]
    depth = target - section[source]
    by_depth = np.argsort(depth.astype(np.uint16) if depth.max(initial=0) < 1 << 16 else depth, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(depth))])
    total, upto = np.zeros(base[-1] + len(first)), np.zeros(len(piece))
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        now = by_depth[a:b]
        x, place = np.where(opens[source[now]], 0.0, total[source[now]]) + weight[now], target[now]
        new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        n = np.diff(np.append(new, len(now)))
        most = np.maximum.reduceat(x, new)
        w = np.exp(x - np.repeat(most, n))
        s = np.add.reduceat(w, new)
        total[place[new]] = most + np.log(s)
        running = np.cumsum(w)
        share = (running - np.repeat(running[new] - w[new], n)) / np.repeat(s, n)
        share[np.append(new[1:], len(now)) - 1] = 1.0
        upto[now] = share
    ladder = target + upto

    out = np.full(len(raw), -1, np.int32)
    turn = np.argsort(which, kind="stable")  # equal stretches side by side: near places in memory
    place, end, begin = (base[1:] + np.arange(len(first)))[which[turn]], stop[turn], start[turn]
    key, zero = keys[row[turn]], offsets[row[turn]]
    while len(end):
        with np.errstate(over="ignore"):
            u = mix64(key + (end - zero).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        edge = np.searchsorted(ladder, place + u * 2.0**-BITS, side="right")
        chosen, n = piece[edge], length[edge]
        out[end - 1] = chosen
        spelt = np.flatnonzero(chosen < 0)
        for j in range(1, 5):
            spelt = spelt[n[spelt] >= j]
            out[end[spelt] - j] = t.byte_ids[raw[end[spelt] - j]]
        end, place = end - n, source[edge]
        more = end > begin
        end, place, begin, key, zero = end[more], place[more], begin[more], key[more], zero[more]
    kept = out >= 0
    return out[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]


def encode(column, keys: np.ndarray, t: Pieces, seed: int = 0) -> pa.Array:
    """Sampled piece ids of each text (none for null and empty texts)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    spaced = pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
    raw, offsets = utf8_slices(spaced)
    with np.errstate(over="ignore"):
        keys = mix64(keys.astype(np.uint64) + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03))
    ids, ends = [], [np.zeros(1, np.int64)]
    for a, b in by_bytes(offsets, CHUNK):
        if offsets[b] == offsets[a]:
            some, cut = np.zeros(0, np.int32), np.zeros(b - a + 1, np.int64)
        else:
            some, cut = _sample(t, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], keys[a:b])
        ids.append(some)
        ends.append(cut[1:] + ends[-1][-1])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def decode(pieces: pa.Array, t: Pieces) -> pa.Array:
    """The texts of lists of piece ids; the inverse of :func:`encode`, whatever the segmentation."""
    ends = pieces.offsets.to_numpy()
    ids = pieces.values.to_numpy()[ends[0] : ends[-1]]
    size = t.start[ids + 1] - t.start[ids]
    cut = np.concatenate([[0], np.cumsum(size)])
    raw = t.pool[np.arange(cut[-1]) + np.repeat(t.start[ids] - cut[:-1], size)]
    offsets = cut[ends - ends[0]]
    first = offsets[:-1][np.diff(offsets) > 0]
    raw = np.delete(raw, first)  # the space in front
    offsets = offsets - np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.large_string())


def _path(tokenizer: str) -> str:
    import public_tokenizers

    return tokenizer if tokenizer.startswith("/") else public_tokenizers.path(tokenizer)


def sample_pieces(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", sharpness: float = 1.0, seed: int = 0, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with pieces (sampled ids), n_pieces and lossless (the decoded pieces are the text).

    The whole text is segmented, whatever its length.  Null and empty texts have no pieces;
    rows with equal key and text are segmented alike, and stay repeated; a null key is a key
    like others.  Columns of ``docs`` with the name of a new one give way.  An empty table
    gives an empty table.  A larger ``sharpness`` keeps closer to the segmentation of greatest
    weight.  Time grows with the longest section (see above) times a step in Python: a
    megabyte of one letter, which pieces cross everywhere, takes about 150 seconds.
    """
    hashed = fresh(docs.columns, "key__")[0]
    keyed = docs.withColumn(hashed, F.xxhash64(F.col(f"`{key}`")))

    def make():
        t = load(_path(tokenizer), sharpness)

        def work(column, keys):
            pieces = encode(column, keys.to_numpy(zero_copy_only=False), t, seed)
            same = pc.equal(decode(pieces, t), pc.fill_null(column.cast(pa.large_string()), ""))
            return pieces, pc.list_value_length(pieces).cast(pa.int64()), same

        return work

    fields = [("pieces", "array<int>"), ("n_pieces", "long"), ("lossless", "boolean")]
    return append_arrow(keyed, [text, hashed], fields, make, docs.columns if keep is None else keep)


def decode_pieces(df: DataFrame, tokenizer: str = "piece_bpe_32k.model", pieces: str = "pieces", text: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the text of each list of piece ids; null and empty lists give the empty text."""

    def make():
        t = load(_path(tokenizer))
        return lambda column: (decode(pa.array(column.to_pylist(), pa.list_(pa.int32())) if column.null_count else column, t).cast(pa.string()),)

    return append_arrow(df, [pieces], [(text, "string")], make, keep)
