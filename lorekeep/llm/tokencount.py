"""Token counts of whole texts; huge texts in overlapping chunks that are spliced where both tokenizations are proven right.

A text of at most CHUNK characters is encoded at once. A longer one is cut into chunks of CHUNK characters, each
encoded with OVERLAP characters more on either side, with offsets. Two neighbours are spliced at a position where
both have a token boundary and where a character that isn't white space stands before one that is. The byte-level
pattern has no match that crosses such a position, and no look-behind, so the text before it and the text from it on
are tokenized independently: the boundary is stable in whatever context. (The special strings hold no white space.)
If the overlap has no such position, it is doubled and both chunks are encoded again, at last over the whole text.

Defined results: a null text has no bytes and no tokens. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK = 65_536
OVERLAP = 512


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _splits(text: str, lo: int, hi: int) -> list[int]:
    """Positions in (lo, hi) where a non-blank stands before a blank."""
    return [i for i in range(max(lo, 1), hi) if text[i].isspace() and not text[i - 1].isspace()]


def count_chunked(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text by overlapping chunks."""
    whole = lambda t: len(tok.encode(t, add_special_tokens=False))
    if len(text) <= chunk:
        return whole(text)
    edges = list(range(0, len(text), chunk)) + [len(text)]
    if len(edges) > 2 and edges[-1] - edges[-2] <= overlap:
        del edges[-2]

    def boundaries(start: int, stop: int, at: list[int]) -> tuple[dict[int, int], int]:
        """For those of the positions at which a token starts: how many tokens of text[start:stop] precede; and the tokens in all."""
        offsets = tok.encode(text[start:stop], add_special_tokens=False).offsets
        first: dict[int, int] = {}
        for k, (a, _) in enumerate(offsets):
            first.setdefault(a + start, k)
        return {p: first[p] for p in at if p in first}, len(offsets)

    total, begin, left = 0, 0, {0: 0}  # left: tokens before the splice in the current chunk's encoding
    k = 0
    widths = [overlap] * len(edges)
    lo = 0  # where the current chunk's encoding starts
    while True:
        hi_edge = edges[k + 1]
        if hi_edge == len(text):
            offsets = tok.encode(text[lo:], add_special_tokens=False).offsets
            skip = 0 if begin == lo else next(i for i, (a, _) in enumerate(offsets) if a + lo >= begin)
            return total + len(offsets) - skip
        width = widths[k + 1]
        while True:
            stop = min(len(text), hi_edge + width)
            start = max(begin, hi_edge - width)
            at = _splits(text, start + 1, stop)
            here, _ = boundaries(lo, stop, [begin, *at])
            after = edges[k + 2] + widths[min(k + 2, len(widths) - 1)]
            there, _ = boundaries(start, min(len(text), after), at)
            common_at = [p for p in at if p in here and p in there]
            if common_at:
                break
            if stop == len(text) and start == begin:
                return total + whole(text[begin:])
            width *= 2
        p = min(common_at, key=lambda x: (abs(x - hi_edge), x))
        total += here[p] - (0 if begin == lo else here.get(begin, 0))
        begin, lo = p, start
        k += 1


def count(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        for b in batches:
            texts = ["" if t is None else t for t in b["text"].tolist()]
            for lo, hi in common.units(texts, 1 << 20):
                own = texts[lo:hi]
                at_once = iter(tok.encode_batch_fast([t for t in own if len(t) <= chunk], add_special_tokens=False))
                n = [len(next(at_once)) if len(t) <= chunk else count_chunked(tok, t, chunk, overlap) for t in own]
                yield pd.DataFrame({"id": b["id"].iloc[lo:hi].array, "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in own], "n_tokens": n})

    src = common.small_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(work, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
