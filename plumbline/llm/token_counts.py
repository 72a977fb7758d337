"""Token counts by batched encoding that keeps nothing but lengths."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.llm.common import CACHE_ENTRIES, by_bytes

_SPACE_AFTER_SPACE = re.compile(r"\s ")
_SAFE = re.compile(r"(?<=\S)(?= )")
#: Bytes of text encoded by one call of the tokenizer.
ENCODE_BYTES = 1 << 18


class PieceCounter:
    """Counts tokens of texts cut at safe boundaries.

    A cut before a space that follows a non-space character never falls into a token of a
    byte-level vocabulary: no pattern of its pre-tokenizer continues over a space, and the
    special strings hold none. So the count of a text is the sum over its pieces, and a
    piece met before need not be encoded again.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        if not _SPACE_AFTER_SPACE.search(text) and text[:1] != " ":
            first, *rest = text.split(" ")
            return [first, *map(" ".__add__, rest)]
        return _SAFE.split(text)

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = set().union(*cut) - self.known.keys()
        for batch in by_bytes(sorted(new, key=len), len, ENCODE_BYTES):
            encoded = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
            self.known.update(zip(batch, map(len, encoded)))
        return [sum(map(self.known.__getitem__, p)) for p in cut]


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 1024,
                 batch_bytes: int = 2 << 20) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row.

    Counts equal the tokenizer's own count of the whole text, without added special tokens
    and with special strings inside the text as the library treats them. Null and empty
    texts have 0 bytes and 0 tokens. Columns that already carry one of the three names are
    replaced; others, also oddly named ones, stay. Texts are gathered to batches of about
    ``batch_bytes``; a longer text is a batch of its own, encoded in pieces. An empty table
    gives an empty table. Nothing is shuffled.
    """
    def lengths(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PieceCounter(tokenizer_path)
        for column in columns:
            out: list[int] = []
            for batch in by_bytes(column.to_pylist(), len, batch_bytes):
                out += counter.counts(batch)
            yield pa.array(out, pa.int64())

    lengths.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    count = F.arrow_udf(lengths, "long")
    whole = F.coalesce(quoted(text), F.lit(""))
    return (df.withColumn("n_bytes", F.octet_length(whole).cast("long"))
            .withColumn("n_tokens", count(whole))
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
