"""Token counts of whole texts; huge documents are encoded in overlapping chunks that are spliced again.

A huge text is encoded in chunks that overlap. Both encodings of an overlap know where their tokens start;
the texts are spliced at a start that both have and that is proven stable: white space after a character that
is no white space. The pre-tokenizers of the supported files never let a piece run from such a character over
such a white space, and what they look ahead at lies behind it, so tokens left of that place don't depend on
what follows and tokens right of it don't depend on what precedes. Where an overlap holds no such place, it is
widened, then the chunk is lengthened, at worst to the whole text, so counts always equal those of one encoding.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import batch, text_blocks

SPACES = " \n\t\r"
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a .json (tokenizers) or .model (sentencepiece) file, loaded once a worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def stable(text: str, at: int) -> bool:
    """Whether a token boundary at this place is proven to be independent of the other side."""
    return 0 < at < len(text) and text[at] in SPACES and not text[at - 1].isspace()


def spliced_ids(tok, text: str, chunk: int, overlap: int) -> Iterator[list[int]]:
    """The ids of a text, chunk by chunk; memory holds two chunks."""

    def encode(start: int, end: int):
        e = tok.encode(text[start:end], add_special_tokens=False)
        return e.ids, [start + a for a, _ in e.offsets]

    start, end = 0, min(len(text), chunk)
    ids, at = encode(start, end)
    while end < len(text):
        wide, splice = overlap, None
        while splice is None:
            again = max(start, end - wide)
            if again == start:  # nothing left to widen: lengthen the chunk
                end = min(len(text), start + 2 * (end - start))
                ids, at = encode(start, end)
                if end == len(text):
                    break
                wide = overlap
                continue
            after = min(len(text), again + max(chunk, 2 * wide))
            ids2, at2 = encode(again, after)
            both = set(at2).intersection(at)
            splice = max((x for x in both if again < x < end and stable(text, x)), default=None)
            wide *= 2
        if splice is None:
            break
        yield [i for i, a in zip(ids, at, strict=True) if a < splice]
        keep = [(i, a) for i, a in zip(ids2, at2, strict=True) if a >= splice]
        ids, at = [i for i, _ in keep], [a for _, a in keep]
        start, end = splice, after
    yield ids


def count_texts(tok, texts: list[str], huge: int, chunk: int, overlap: int) -> list[int]:
    out = [0] * len(texts)
    if hasattr(tok, "EncodeAsIds"):  # sentencepiece has no offsets in characters that splice
        return [len(tok.EncodeAsIds(t)) for t in texts]
    small = [i for i, t in enumerate(texts) if len(t) <= huge]
    for i, e in zip(small, tok.encode_batch_fast([texts[i] for i in small], add_special_tokens=False), strict=True):
        out[i] = len(e)
    for i, t in enumerate(texts):
        if len(t) > huge:
            out[i] = sum(map(len, spliced_ids(tok, t, chunk, overlap)))
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024, huge: int = 32768, chunk: int = 16384, overlap: int = 256) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Rows are independent: repeated rows and null ids give a
    row each, an empty table gives none, other columns are ignored. Texts of more than ``huge`` characters
    are encoded in chunks of ``chunk`` characters with overlaps of at least ``overlap``.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in text_blocks(batches):
            n = count_texts(tok, [t or "" for t in b.column("text").to_pylist()], huge, chunk, overlap)
            size = pc.binary_length(b.column("text")).fill_null(0).cast(pa.int64())
            yield batch(schema, doc_id=b.column("doc_id"), n_bytes=size, n_tokens=n, over_limit=[x > limit for x in n])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
