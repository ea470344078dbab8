"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import append_arrow

#: A text of more characters than this is encoded in parts of about that size.
PART_CHARS = 16_384
#: Parts are handed to the library in batches of about this many UTF-8 bytes.
BATCH_BYTES = 1_000_000

#: A space after a solid character, with more text behind it.  No piece joins a solid character
#: to a following space, and the library puts one space in front of each text; so encoding what
#: stands before such a space, and what stands after it, gives the pieces of the whole.  (At the
#: end of a text nothing would be left to put the space in front of.)
_SAFE = re.compile("(?<=[^ ▁]) (?=.)", re.S)


@lru_cache(maxsize=2)
def _piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def splits_safely(path: str) -> bool:
    """Whether the model meets what :data:`_SAFE` relies on: nothing normalised away, one
    space put in front, and no piece with a space behind a solid character."""
    model = _piece_model(path)
    whole = all("▁" not in model.id_to_piece(i).lstrip("▁") for i in range(len(model)))
    kept = "".join(model.encode(" a  b ", out_type=str)) == "▁▁a▁▁b▁"
    return whole and kept


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Cut a long text at safe spaces, which belong to neither side."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        out.append(text[start : cut.start()])
        start = cut.end()
    return [*out, text[start:]]


def _batches(parts):
    """Lists of (row, text) of about :data:`BATCH_BYTES` bytes, or of one longer text, from (row, text, bytes)."""
    batch, held = [], 0
    for row, text, size in parts:
        if batch and held + size > BATCH_BYTES:
            yield batch
            batch, held = [], 0
        batch.append((row, text))
        held += size
    if batch:
        yield batch


def lengths(texts: list[str], sizes: list[int], path: str) -> list[int]:
    """Tokens of each text (with ``sizes`` in bytes), by a sentencepiece model."""
    model, split, out = _piece_model(path), splits_safely(path), [0] * len(texts)

    def cut():
        for row, (text, size) in enumerate(zip(texts, sizes)):
            if len(text) <= PART_CHARS or not split:
                yield row, text, size
            else:
                for part in parts(text):
                    yield row, part, len(part.encode())

    for batch in _batches(cut()):
        for (row, _), ids in zip(batch, model.encode([text for _, text in batch], num_threads=1)):
            out[row] += len(ids)
    return out


@lru_cache(maxsize=2)
def _json_model(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def json_lengths(texts: list[str], sizes: list[int], path: str) -> list[int]:
    """Tokens of each text, by a tokenizers file: whole texts, as its rules may look across any place."""
    model = _json_model(path)
    model.no_truncation()
    model.no_padding()
    return [len(x.ids) for batch in _batches(zip(range(len(texts)), texts, sizes)) for x in model.encode_batch([text for _, text in batch], add_special_tokens=False)]


def token_counts(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", text: str = "text", limit: int = 4096, carry_text: bool = True) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    ``tokenizer`` is a file of public_tokenizers or an absolute path.  The whole text is
    counted, without begin, end or other added tokens.  Null and empty texts have 0 bytes
    and 0 tokens; repeated rows stay repeated; an empty table gives an empty table; columns
    of ``docs`` that have the name of a new one give way.  With a ``.model`` file a long text
    is encoded in parts cut where no piece can cross, and one without such a place whole; with
    a ``.json`` file every text is encoded whole.  ``carry_text=False`` leaves the text out.
    """

    def make():
        import public_tokenizers

        path = tokenizer if tokenizer.startswith("/") else public_tokenizers.path(tokenizer)
        count_of = json_lengths if path.endswith(".json") else lengths

        def work(column):
            n_bytes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            counts = count_of([t or "" for t in column.to_pylist()], n_bytes.to_pylist(), path)
            return n_bytes, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())

        return work

    keep = docs.columns if carry_text else [c for c in docs.columns if c != text]
    return append_arrow(docs, [text], [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")], make, keep)
