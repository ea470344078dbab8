"""Language-model scores by context-tree weighting.

A text is read as its words in lower case, each followed by one space, the last one by an end
symbol instead.  Every byte is eight binary decisions; each of the 255 decisions has a tree of
contexts, the bytes before, up to ``DEPTH`` of them.  A node's counts give the estimate of
Krichevsky and Trofimov, and the weighted probability of a node is the mean of its own
estimate and of the product of its children's; the model is the mixture of all trees that
follows, with the weights that the training texts left.

The trees grow with the corpus, so they are nowhere gathered whole.  Training counts of grams
(a context and the byte after it) are summed in slots by a hash of the ``ROOT`` nearest bytes
of context, so a slot has whole subtrees; there are as many slots as the size of the corpus
asks for.  The nodes above, at most 2**24 of them by the alphabet, go to the driver.  To score,
the documents are dealt into blocks; a block asks the slots that it has grams of for their
probabilities.  A slot that many blocks ask much of is copied for several lots of blocks.
Texts, blocks and slots are worked through in slices, so none has to fit in memory as arrays.

The base score needs the corpus counts of the words; these travel likewise, by 64-bit hashes.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, distinct, eights, fresh, held_out, mix64, small_batches, small_join, span_hash, stored, utf8_slices

DEPTH, ROOT, END = 6, 3, 255
#: Text in a block, and text for each slot.
BLOCK_BYTES, SLOT_BYTES = 8_000_000, 16_000_000
#: Text, model grams and asked grams that are worked on at a time; distinct grams that a counting task holds.
SLICE, CHUNK, ASKED, HELD = 1_000_000, 100_000, 200_000, 3_000_000
#: Grams that one copy of a slot is asked for, about, unless it has more itself.
LOT = 4_000_000
#: The most tasks that blocks, or slots, are dealt over in turn; a task works through its own one by one.
TASKS = 65_536
#: Above this many bytes the sums of the counting tasks meet in groups first.
ROUND_BYTES = 8_000_000_000
#: Log probabilities travel as whole numbers of this fraction.
UNIT = 2.0**-18

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
# Where byte j before the last stands in a gram: the nearest in the highest place.
_PLACE = [0, *(8 * (DEPTH + 1 - j) for j in range(1, DEPTH + 1))]
_BEFORE = [np.uint64(sum(255 << _PLACE[j] for j in range(p + 1, DEPTH + 1))) for p in range(DEPTH)]
_END_WORD = np.uint64(0x4CF5AD432745937F)
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def symbols(column) -> tuple[np.ndarray, np.ndarray]:
    """The folded texts one after the other, each closed by END, and their offsets."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    closed = pc.binary_join_element_wise(column, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    raw, offsets = utf8_slices(closed)
    raw = _FOLD[raw]
    solid = raw != 32
    keep = solid.copy()
    keep[1:] |= solid[:-1] & ~solid[1:]
    upto = np.concatenate([[0], np.cumsum(keep)])[offsets]
    empty = np.flatnonzero(np.diff(upto) == 0)
    keep[offsets[empty + 1] - 1] = True
    upto = upto + np.concatenate([[0], np.cumsum(np.diff(upto) == 0)])
    out = raw[keep]
    out[upto[1:] - 1] = END
    return out, upto


def grams(text: np.ndarray, offsets: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """For each byte a number of DEPTH + 1 bytes: its context, the nearest byte first, and itself last.
    What lies before a text counts as END; ``before``: what lies before a first text that goes on."""
    ahead = np.full(7, END, np.uint8)
    if before is not None:
        ahead[7 - len(before) :] = before
    ahead = np.concatenate([ahead, text]).tobytes()
    eight = np.ndarray(len(text), "<u8", ahead, strides=(1,))  # the byte in the highest place, the nearest before it next
    out = ((eight << np.uint64(8)) >> np.uint64(8 * (7 - DEPTH))) & ~np.uint64(255) | (eight >> np.uint64(56))
    begin, end = (offsets[:-1], offsets[1:]) if before is None else (offsets[1:-1], offsets[2:])
    for p in range(DEPTH):
        at = begin + p
        out[at[at < end]] |= _BEFORE[p]
    return out


def _pieces(raw: np.ndarray):
    """The symbols of one long text in pieces that end behind a word."""
    data, at, held = memoryview(np.ascontiguousarray(raw)), 0, b""
    while at < len(data):
        gap = _GAP.search(data, at + SLICE)
        stop = gap.start() if gap else len(data)
        words = bytes(data[at:stop]).lower().split()
        at = stop
        if words:
            if held:
                yield np.frombuffer(held + b" ", np.uint8)
            held = b" ".join(words)
    yield np.frombuffer(held + bytes([END]), np.uint8)


def slices(column):
    """(first row, symbols, offsets, symbols before) of slices of the texts.  A slice has whole
    texts, or a piece of one long text; only its first piece has nothing before it."""
    column = pc.fill_null((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()), "")
    raw, offsets = utf8_slices(column)
    for a, b in by_bytes(offsets, SLICE):
        if offsets[b] - offsets[a] <= SLICE:
            yield a, *symbols(column.slice(a, b - a)), None
            continue
        before = None
        for text in _pieces(raw[offsets[a] : offsets[b]]):
            for i in range(0, len(text), 2 * SLICE):  # a word may be longer than a slice
                part = text[i : i + 2 * SLICE]
                yield a, part, np.array([0, len(part)]), before
                before = np.concatenate([before if before is not None else np.full(DEPTH, END, np.uint8), part[-DEPTH:]])[-DEPTH:]


class Tokens:
    """Hashes of the tokens (words, and one end for each text) of successive slices, with their rows."""

    def __init__(self):
        self.begun: list[bytes] = []  # of a word that a slice left open

    def __call__(self, row: int, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stop = np.flatnonzero((text == 32) | (text == END))
        if not len(stop):
            self.begun.append(text.tobytes())
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        start = np.concatenate([[0], stop[:-1] + 1])
        tail = text[stop[-1] + 1 :].tobytes()
        last, rows = text[stop] == END, row + np.searchsorted(offsets, stop, side="right") - 1
        if self.begun:
            whole = np.frombuffer(b"".join(self.begun) + text[: stop[0]].tobytes(), np.uint8)
            first = span_hash(eights(whole), np.array([0]), np.array([len(whole)]))
        full = stop > start  # an empty text has no word before its end
        word = span_hash(eights(text), start, stop)
        if self.begun:
            word[0], full[0] = first[0], True
        self.begun = [tail] if tail else []
        return np.concatenate([word[full], np.full(int(last.sum()), _END_WORD)]), np.concatenate([rows[full], rows[last]])


def total(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with summed counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs."""
    keys = np.sort(keys)
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(np.append(new, len(keys)))


class Sums:
    """Keys with summed counts, merged whenever as much as is held has come."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.keys, self.counts, self.new, self.waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray):
        self.new.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(HELD // 3, len(self.keys)):
            self.merge()

    def merge(self):
        if self.new:
            self.keys, self.counts = total(np.concatenate([self.keys, *(k for k, _ in self.new)]), np.concatenate([self.counts, *(c for _, c in self.new)]))
            self.new, self.waiting = [], 0
        return self.keys, self.counts


def to_planes(a: np.ndarray) -> bytes:
    """Non-negative whole numbers: bytes of equal significance side by side, without those that are all zero."""
    a = np.ascontiguousarray(a, np.uint64)
    n = (int(a.max(initial=0)).bit_length() + 7) // 8
    return bytes([n]) + a.view(np.uint8).reshape(len(a), 8).T[:n].tobytes() if n else bytes([0]) + bytes(len(a))


def from_planes(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    n, raw = int(raw[0]), raw[1:]
    planes = raw.reshape(max(n, 1), -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : max(n, 1)] = planes.T
    return out.view(np.uint64).ravel()


def pack(ascending: np.ndarray) -> bytes:
    return to_planes(np.diff(ascending, prepend=np.uint64(0)))


def unpack(data) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    return (mix64(keys >> np.uint64(_PLACE[ROOT])) % np.uint64(slots)).astype(np.int64)


def word_slot(words: np.ndarray, slots: int) -> np.ndarray:
    """The slots of words come behind those of grams."""
    return (words % np.uint64(slots)).astype(np.int64) + slots


def by_slot(where: np.ndarray):
    """The order of keys by slot, and (slot, start, stop) for each slot that has any."""
    order = np.argsort(where.astype(np.uint16 if where.max(initial=0) < 1 << 16 else np.int64), kind="stable")
    where = where[order]
    new = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.zeros(0, np.int64)
    return order, list(zip(where[new].tolist(), new.tolist(), np.append(new[1:], len(where)).tolist()))


_LOG_GAMMA = np.array([[math.lgamma(n + 0.5), math.lgamma(n + 1)] for n in range(2_048)])


def _log_gamma(n: np.ndarray, half: bool) -> np.ndarray:
    """ln gamma(n + 1/2) or ln gamma(n + 1) for whole n >= 0: a table, and Stirling's series beyond it."""
    out = _LOG_GAMMA[np.minimum(n, len(_LOG_GAMMA) - 1).astype(np.int64), 0 if half else 1]
    large = n >= len(_LOG_GAMMA)
    if large.any():
        x = n[large] + (0.5 if half else 1.0)
        out[large] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log_gamma(zeros, True) + _log_gamma(ones, True) - math.log(math.pi) - _log_gamma(zeros + ones, False)


def weighted(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes, and the share that their own estimate has in it."""
    both = np.logaddexp(own, children) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


class Subtrees:
    """The nodes below depth ROOT for grams that hold whole contexts of ROOT + 1 bytes: for each
    depth and bit, sorted node keys with the estimate for a one and the share of the own
    estimate; and the sums for the nodes of depth ROOT (codes: context, then decision)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        levels = {DEPTH: (keys, counts)}
        for d in range(DEPTH - 1, ROOT - 1, -1):
            k, c = levels[d + 1]
            levels[d] = total((k >> np.uint64(16) << np.uint64(8)) | (k & np.uint64(255)), c)
        self.nodes: dict[tuple[int, int], tuple] = {}
        codes, sums = [], []
        for t in range(8):
            children = None
            for d in range(DEPTH, ROOT - 1, -1):
                k, c = levels[d]
                g = k >> np.uint64(8 - t)
                new = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
                ones = c * ((k >> np.uint64(7 - t)) & np.uint64(1)).astype(np.int64)
                n1 = np.add.reduceat(ones, new) if len(new) else ones
                n = np.add.reduceat(c, new) if len(new) else c
                g = g[new]
                if children is not None:
                    up, value = children
                    below = np.bincount(np.searchsorted(g, up), weights=value, minlength=len(g))
                if d == ROOT:
                    codes.append((g >> np.uint64(t) << np.uint64(8)) | (g & np.uint64((1 << t) - 1)) | np.uint64(1 << t))
                    sums.append(np.stack([n - n1, n1, below], 1) if len(g) else np.zeros((0, 3)))
                    break
                own = log_kt(n - n1, n1)
                both, share = (own, np.ones(len(own))) if d == DEPTH else weighted(own, below)
                self.nodes[d, t] = g, (n1 + 0.5) / (n + 1.0), share
                children = (g >> np.uint64(t + 8) << np.uint64(t)) | (g & np.uint64((1 << t) - 1)), both
        self.codes, self.sums = np.concatenate(codes), np.concatenate(sums)

    def log10_probability(self, keys: np.ndarray, roots: Nodes, top: Upper) -> np.ndarray:
        """Of each gram's byte after its context."""
        out, low = np.zeros(len(keys)), keys & np.uint64(255)
        at = [keys >> np.uint64(_PLACE[d]) << np.uint64(8) if d else np.zeros(len(keys), np.uint64) for d in range(ROOT + 1)]
        for t in range(8):
            one = (low >> np.uint64(7 - t)) & np.uint64(1) == 1
            begin = low >> np.uint64(8 - t)
            p = np.full(len(keys), 0.5)
            for d in range(DEPTH, ROOT, -1):
                g, estimate, share = self.nodes[d, t]
                if not len(g):
                    continue
                want = (keys >> np.uint64(_PLACE[d]) << np.uint64(t)) | begin
                i = np.searchsorted(g, want)
                i[i == len(g)] = 0
                p = _mixed(p, one, g[i] == want, estimate[i], share[i])
            q = begin | np.uint64(1 << t)
            for d, nodes in zip(range(ROOT, -1, -1), (roots, *top.levels)):
                p = nodes.mixed(p, one, at[d] | q)
            out += np.log10(p)
        return out


def _mixed(p, one, seen, estimate, share):
    kt = np.where(one, estimate, 1 - estimate)
    return np.where(seen, share * kt + (1 - share) * p, 0.5)


@dataclass
class Nodes:
    """Nodes of one depth: sorted codes (context, then decision), the estimate for a one, the share of the own estimate."""

    codes: np.ndarray
    estimate: np.ndarray
    share: np.ndarray

    def mixed(self, p, one, want):
        if not len(self.codes):
            return np.full(len(p), 0.5)
        i = np.searchsorted(self.codes, want)
        i[i == len(self.codes)] = 0
        return _mixed(p, one, self.codes[i] == want, self.estimate[i], self.share[i])


def nodes_of(codes: np.ndarray, sums: np.ndarray) -> tuple[Nodes, np.ndarray, np.ndarray]:
    """Nodes of a depth from the zeros, ones and children's log weights; and codes and sums of the depth above."""
    zeros, ones, below = sums.T if len(sums) else np.zeros((3, 0))
    both, share = weighted(log_kt(zeros, ones), below)
    up, at = np.unique((codes >> np.uint64(16) << np.uint64(8)) | (codes & np.uint64(255)), return_inverse=True)
    above = np.stack([np.bincount(at, weights=x, minlength=len(up)) for x in (zeros, ones, both)], 1) if len(up) else np.zeros((0, 3))
    return Nodes(codes, (ones + 0.5) / (zeros + ones + 1), share), up, above


@dataclass
class Upper:
    """The nodes of depths ROOT - 1 to 0."""

    levels: list[Nodes]


def upper_nodes(codes: np.ndarray, sums: np.ndarray) -> Upper:
    """From the sums for depth ROOT - 1; codes need not be in order, but distinct."""
    order, levels = np.argsort(codes), []
    codes, sums = codes[order].astype(np.uint64), sums[order]
    for _ in range(ROOT):
        nodes, codes, sums = nodes_of(codes, sums)
        levels.append(nodes)
    return Upper(levels)


def chunks(keys: np.ndarray):
    """(start, stop) of about CHUNK grams that hold whole contexts of ROOT + 1 bytes."""
    context, at = keys >> np.uint64(_PLACE[ROOT + 1]), 0
    while at < len(keys):
        stop = at + CHUNK
        if stop < len(keys):
            stop = int(np.searchsorted(context, context[stop]))
            if stop <= at:
                stop = int(np.searchsorted(context, context[at], side="right"))
        stop = min(stop, len(keys))
        yield at, stop
        at = stop


def root_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and sums of the nodes of depth ROOT."""
    trees = [Subtrees(keys[a:b], counts[a:b]) for a, b in chunks(keys)]
    if not trees:
        return np.zeros(0, np.uint64), np.zeros((0, 3))
    codes, at = np.unique(np.concatenate([t.codes for t in trees]), return_inverse=True)
    sums = np.concatenate([t.sums for t in trees])
    return codes, np.stack([np.bincount(at, weights=x, minlength=len(codes)) for x in sums.T], 1)


def probabilities(wanted: np.ndarray, keys: np.ndarray, counts: np.ndarray, codes: np.ndarray, sums: np.ndarray, top: Upper) -> np.ndarray:
    """log10 of the probability of each of the ascending grams by a slot's model."""
    roots, out = nodes_of(codes, sums)[0], np.empty(len(wanted))
    spans = list(chunks(keys)) or [(0, 0)]
    begin = [0, *(keys[a] >> np.uint64(_PLACE[ROOT + 1]) << np.uint64(_PLACE[ROOT + 1]) for a, _ in spans[1:])]
    cuts = [*np.searchsorted(wanted, np.array(begin, np.uint64)).tolist(), len(wanted)]
    for (a, b), x, y in zip(spans, cuts, cuts[1:]):
        if x == y:
            continue
        tree = Subtrees(keys[a:b], counts[a:b])
        for i in range(x, y, ASKED):
            part = slice(i, min(i + ASKED, y))
            out[part] = tree.log10_probability(wanted[part], roots, top)
    return out


_COUNTED = "slot int, lot int, keys binary, counts binary"


def _count(slots: int, groups: int):
    """Sums of the grams and words of a task's texts, in messages for the slots."""

    def run(batches):
        lot, grams_, words = TaskContext.get().partitionId() % groups, Sums(), Sums()

        def flush():
            for sums, home in ((grams_, slot_of), (words, word_slot)):
                keys, counts = sums.merge()
                order, found = by_slot(home(keys, slots))
                keys, counts = keys[order], counts[order]
                sums.clear()
                for i in range(0, len(found), 64):
                    some = found[i : i + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x for x, _, _ in some], pa.int32()), pa.array([lot] * len(some), pa.int32()), pa.array([pack(keys[a:b]) for _, a, b in some], pa.binary()), pa.array([to_planes(counts[a:b]) for _, a, b in some], pa.binary())],
                        ["slot", "lot", "keys", "counts"],
                    )

        for batch in batches:
            tokens = Tokens()
            for row, text, offsets, before in slices(batch.column(0)):
                grams_.add(*tally(grams(text, offsets, before)))
                words.add(*tally(tokens(row, text, offsets)[0]))
                if max(len(grams_.keys), len(words.keys)) > HELD:
                    yield from flush()
        yield from flush()

    return run


def _combine(finish):
    """Rows of equal slot and lot, which follow one another, summed; ``finish`` makes a batch of each sum."""

    def run(batches):
        held, sums = None, Sums()
        for batch in batches:
            for slot, lot, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if held not in (None, (slot, lot)):
                    yield finish(*held, *sums.merge())
                    sums.clear()
                held = slot, lot
                sums.add(unpack(keys.as_buffer()), from_planes(counts.as_buffer()).astype(np.int64))
        if held:
            yield finish(*held, *sums.merge())

    return run


def _row(schema: str, *values) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[kind]) for v, (_, kind) in zip(values, fields)], [name for name, _ in fields])


def _subtotal(slot: int, lot: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return _row(_COUNTED, slot, lot, pack(keys), to_planes(counts))


_MODEL = "slot int, keys binary, counts binary, codes binary, sums binary, types long, tokens long, asks long"


def _model(slots: int, blocks: int):
    """A model's row: a slot's grams with its nodes of depth ROOT, or its words.  asks: grams that all blocks can ask of it, about."""

    def finish(slot: int, _: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        codes, sums = root_sums(keys, counts) if slot < slots else (np.zeros(0, np.uint64), np.zeros((0, 3)))
        return _row(_MODEL, slot, pack(keys), to_planes(counts), pack(codes), sums.tobytes(), len(keys), int(counts.sum()), int(np.minimum(counts, blocks).sum()))

    return finish


def _roots(row_codes, row_sums) -> tuple[np.ndarray, np.ndarray]:
    return unpack(row_codes.as_buffer()), np.frombuffer(row_sums.as_buffer(), np.float64).reshape(-1, 3)


def _tops(batches):
    """What the slots' nodes of depth ROOT add to the depth above."""
    for batch in batches:
        for codes, sums in zip(batch.column(0), batch.column(1)):
            _, up, above = nodes_of(*_roots(codes, sums))
            yield pa.RecordBatch.from_arrays([pa.array(up.astype(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in above.T)], ["code", "zeros", "ones", "below"])


def _wanted(column) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams and words of a block."""
    found, tokens = [[], []], Tokens()
    for row, text, offsets, before in slices(column):
        for new, keys in zip(found, (grams(text, offsets, before), tokens(row, text, offsets)[0])):
            new.append(distinct(keys))
            if len(new) > 1 and sum(map(len, new[1:])) > max(HELD // 3, len(new[0])):
                new[:] = [distinct(np.concatenate(new))]
    return tuple(distinct(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in found)


_ASK = "block int, slot int, keys binary"


def _ask(slots: int):
    """What a block wants to know: its distinct grams and words, by slot."""

    def run(block: pa.Table) -> pa.Table:
        rows = []
        for keys, home in zip(_wanted(block.column("text")), (slot_of, word_slot)):
            order, found = by_slot(home(keys, slots))
            keys = keys[order]
            rows += [(slot, pack(keys[a:b])) for slot, a, b in found]
        number = block.column("block")[0].as_py()
        return pa.table({"block": pa.array([number] * len(rows), pa.int32()), "slot": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary())})

    return run


_ANSWER = "block int, slot int, reply binary"


def _answer(slots: int, top):
    """A slot's reply to each block: probabilities of its grams, or corpus counts of its words."""

    def run(asked: pa.Table, model: pa.Table) -> pa.Table:
        replies = []
        if asked.num_rows:
            keys, counts = (unpack(model.column("keys")[0].as_buffer()), from_planes(model.column("counts")[0].as_buffer()).astype(np.int64)) if model.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            wanted = [unpack(x.as_buffer()) for x in asked.column("keys")]
            every = distinct(np.concatenate(wanted))
            if asked.column("slot")[0].as_py() < slots:
                codes, sums = _roots(model.column("codes")[0], model.column("sums")[0]) if model.num_rows else (np.zeros(0, np.uint64), np.zeros((0, 3)))
                value = np.round(probabilities(every, keys, counts, codes, sums, top.value) / -UNIT).astype(np.uint64)
            else:
                value = np.zeros(len(every), np.uint64)
                if len(keys):
                    i = np.minimum(np.searchsorted(keys, every), len(keys) - 1)
                    value = np.where(keys[i] == every, counts[i], 0)
            replies = [to_planes(value[np.searchsorted(every, w)]) for w in wanted]
        return pa.table({"block": asked.column("block"), "slot": asked.column("slot"), "reply": pa.array(replies, pa.binary())})

    return run


def _score(slots: int, ident: str, train_tokens: int, train_types: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        column, n = block.column("text"), block.num_rows
        replies = dict(zip(answers.column("slot").to_pylist(), answers.column("reply")))

        def told(keys, home):
            order, found = by_slot(home(keys, slots))
            out = np.empty(len(keys), np.uint64)
            for slot, a, b in found:
                out[order[a:b]] = from_planes(replies[slot].as_buffer())
            return out

        wanted, words = _wanted(column)
        value, count = told(wanted, slot_of) * -UNIT, told(words, word_slot).astype(np.int64)
        log_count = np.log10(count + 0.5)
        score, base, size, n_tokens, n_known = np.zeros(n), np.zeros(n), *(np.zeros(n, np.int64) for _ in range(3))
        tokens = Tokens()
        for row, text, offsets, before in slices(column):
            g, here = grams(text, offsets, before), slice(row, row + len(offsets) - 1)
            order = np.argsort(g)
            g = g[order]
            new = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            each = np.repeat(value[np.searchsorted(wanted, g[new])], np.diff(np.append(new, len(g))))
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            score[here] += np.bincount(owner[order], weights=each, minlength=len(offsets) - 1)
            size[here] += np.diff(offsets)
            token, owner = tokens(row, text, offsets)
            at = np.searchsorted(words, token)
            base += np.bincount(owner, weights=log_count[at], minlength=n)
            n_tokens += np.bincount(owner, minlength=n)
            n_known += np.bincount(owner[count[at] > 0], minlength=n)
        base -= n_tokens * math.log10(train_tokens + 0.5 * (train_types + 1))
        return pa.table({
            ident: block.column(ident), "n_tokens": pa.array(n_tokens), "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(n, train_tokens)),
            "base_score": pa.array(base), "score": pa.array(score), "bits_per_byte": pa.array(-score / math.log10(2) / size),
        })

    return run


def _dealt(df: DataFrame, number, n: int) -> DataFrame:
    """``df`` with its task, ``number`` modulo the tasks: ``n`` things are dealt evenly, which a hash of so few would not do."""
    tasks = min(n, TASKS)
    return df.withColumn("task", F.pmod(number, F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("task"))


def ctw_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 5, remainder: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model and the base counts learn from the documents with crc32(doc_id as text) modulo
    ``modulus`` other than ``remainder`` (a null id counts as the empty text), all of them and
    whole.  score is log10 of the probability of the folded text with its end; bits_per_byte is
    its code length over the bytes of the folded text and its end.  Null and empty texts are one
    end symbol.  Long texts are whole, read in slices.  Without training documents every decision
    has probability 1/2 and the base counts are 0.  Repeated rows stay repeated (and get equal
    scores); an empty table gives an empty table; other columns of ``docs`` are not returned.
    """
    small_batches(docs.sparkSession)
    ident, block, train, body = fresh(["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte", "slot", "lot", "task"], "doc_id", "block", "train", "text")
    rows = docs.select(F.col(f"`{doc_id}`").alias(ident), F.col(f"`{text}`").cast("string").alias(body), (~held_out(doc_id, remainder, modulus)).alias(train))
    size = rows.agg(F.sum(F.octet_length(body))).first()[0] or 0
    cores = min(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / SLICE))  # small tables: work for each
    slots, blocks = (max(1, cores, math.ceil(size / each)) for each in (SLOT_BYTES, block_bytes))
    groups = math.ceil(size / ROUND_BYTES) or 1

    counted = rows.filter(train).select(body).mapInArrow(_count(slots, groups), _COUNTED)
    if groups > 1:
        counted = counted.repartition("slot", "lot").sortWithinPartitions("slot", "lot").mapInArrow(_combine(_subtotal), _COUNTED)
    counted = _dealt(counted.withColumn("lot", F.lit(0)), F.col("slot"), 2 * slots).sortWithinPartitions("slot")
    model = stored(counted.mapInArrow(_combine(_model(slots, blocks)), _MODEL), "grams")

    tops = model.filter(F.col("slot") < slots).select("codes", "sums").mapInArrow(_tops, "code long, zeros double, ones double, below double")
    tops = tops.groupBy("code").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).toPandas()  # at most 2**24 rows, by the alphabet
    top = docs.sparkSession.sparkContext.broadcast(upper_nodes(tops["code"].to_numpy(np.uint64), tops.iloc[:, 1:].to_numpy(np.float64)))
    tokens, types = model.filter(F.col("slot") >= slots).agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()

    dealt = rows.select(ident, body, F.pmod(F.xxhash64(ident, body), F.lit(blocks)).cast("int").alias(block))
    dealt = _dealt(dealt, F.col(block), blocks)
    asked = dealt.groupBy("task", block).applyInArrow(_ask(slots), _ASK)
    # Slots that are asked for much are copied, and the blocks shared out among the copies.
    lots = model.select("slot", F.ceil(F.col("asks") / F.greatest("types", F.lit(LOT))).cast("int").alias("lots")).filter("lots > 1")
    n = lots.count()
    asked = small_join(asked, lots, "slot", "left", rows=n).withColumn("lot", F.coalesce(F.pmod(F.xxhash64("block"), F.col("lots")), F.lit(0)).cast("int")).select("block", "slot", "lot", "keys")
    copies = small_join(model.drop("types", "tokens", "asks"), lots, "slot", "left", rows=n).withColumn("lot", F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1)))
    copies = copies.select("slot", "lot", "keys", "counts", "codes", "sums")
    home, by = F.col("slot") + F.col("lot"), ["task", "slot", "lot"]
    answers = _dealt(asked, home, 2 * slots).groupBy(*by).cogroup(_dealt(copies, home, 2 * slots).groupBy(*by)).applyInArrow(_answer(slots, top), _ANSWER)
    kind = rows.schema[ident].dataType.simpleString()
    scored = dealt.groupBy("task", block).cogroup(_dealt(answers, F.col("block"), blocks).groupBy("task", "block")).applyInArrow(
        _score(slots, ident, int(tokens), int(types)), f"{ident} {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    )
    return scored.select(ident, held_out(ident, remainder, modulus).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
