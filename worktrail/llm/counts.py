"""Token counts of whole texts, huge documents by overlapping chunks that resynchronise.

A document longer than a chunk is cut into chunks that overlap.  Each chunk is encoded with
offsets; two neighbours are spliced at a place in their overlap where both have a token border
and the border holds whatever stands around: after a letter, before something that is no letter.
The word pattern never joins across such a place, so the tokens on its left are those of the left
chunk and the ones on its right those of the right chunk.  Where an overlap has no such place, the
right chunk is begun earlier, with an overlap twice as wide, until one is found or the chunk
reaches back to the last splice, from which both are encoded as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.llm.pieces import PieceIds, library_ids, not_simple, space_pieces
from worktrail.llm.store import in_arrow, once

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256


def _border(enc, at: int) -> int | None:
    """The token that begins at the character, if one does."""
    token = enc.char_to_token(at)
    return token if token is not None and enc.token_to_chars(token)[0] == at else None


def splice(text: str, left, left_from: int, right, right_from: int, low: int, high: int) -> tuple[int, int, int] | None:
    """The last place in ``[low, high)`` where both encodings can be joined, with the token of each that begins there."""
    for p in range(high - 1, low - 1, -1):
        if text[p - 1].isalpha() and not text[p].isalpha():
            a, b = _border(left, p - left_from), _border(right, p - right_from)
            if a is not None and b is not None:
                return p, a, b
    return None


def count_long(text: str, encode, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a text by overlapping chunks; ``encode`` gives an encoding with offsets."""
    total, begin = 0, 0  # where the current chunk begins
    end = min(len(text), chunk)
    current = encode(text[:end])
    first, spliced = 0, 0  # its first own token, and the place of that token
    while end < len(text):
        wide = overlap
        while True:
            start = max(end - wide, spliced)
            to = min(len(text), start + max(chunk, 2 * wide))
            after = encode(text[start:to])
            if start <= spliced:  # no place found since the last splice: this chunk takes the whole stretch
                begin, first = start, _border(after, 0) or 0
                break
            if found := splice(text, current, begin, after, start, start + 1, end):
                spliced, a, b = found
                total += a - first
                begin, first = start, b
                break
            wide *= 2
        current, end = after, to
    return total + len(current) - first


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Bytes and tokens of each whole text, as the tokenizers library gives them for the whole text.

    Returns ``id_col``, ``n_bytes`` and ``n_tokens`` (long).  Texts of up to ``chunk`` characters are one
    chunk; their distinct pieces are encoded once.  A null text counts as empty (zero, zero);
    repeated rows stay; other columns are not carried.  Map only: nothing is shuffled, and a task
    holds the encoding of two chunks at a time, however long the text is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def load():
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(tokenizer_path)
            made.no_truncation()
            made.no_padding()
            return made

        library = once(f"tokenizer {tokenizer_path}", load)
        separator = next(iter(library.get_added_tokens_decoder().values())).content
        memo = once(f"tokenizer ids {tokenizer_path}", lambda: PieceIds(library_ids(library, separator), spaced=True))
        encode = lambda t: library.encode(t, add_special_tokens=False)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            other = pc.greater(pc.utf8_length(texts), chunk).to_numpy(zero_copy_only=False) | not_simple(texts)
            _, counts = memo.of(space_pieces(pc.if_else(other, "", texts)))
            for i in np.flatnonzero(other):
                counts[i] = count_long(texts[int(i)].as_py(), encode, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return in_arrow(rows, run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 512 tokens."""
    import public_tokenizers

    done = token_counts(spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.withColumn("over_limit", F.col("n_tokens") > 512)
