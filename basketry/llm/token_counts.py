"""Token counts, with huge documents encoded in overlapping chunks that are spliced at proven boundaries.

A document of up to ``chunk`` characters is encoded whole. A longer one is cut into chunks of ``chunk`` characters, each
reaching ``overlap`` characters into the next. Chunks are rows: they spread over tasks, and no task holds more than one
batch of them. Each chunk is encoded with offsets and reports, inside its first and its last ``overlap`` characters, the
token starts that are *stable*.

Proof of stability: a token start at a single space between two characters that are not white space. Every alternative of the
byte-level pattern that takes a space takes it first (a run of white space, or one space before a word), so no pre-token
can reach across this position from the left, whatever precedes it; what follows depends on the text from there on only. No
special string is cut there: a vocabulary with a space inside one is encoded whole. Near a chunk's own end, where its last pre-tokens may differ from the
document's, the last ``MARGIN`` characters are not used. So two chunks that both start a token at such a position split
the document's own token sequence there. If two neighbours share no stable start, that document is encoded again with
twice the chunk and overlap, and at last whole.

Nulls: a null text has 0 bytes and 0 tokens. Empty tables, repeated rows and null ids are fine: rows are told apart by a
row number of this run, not by their id. Names that begin with ``_t_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .bpe import byte_level, encoder, widths
from .common import table, text_of

MARGIN = 8


def stable_starts(text: str, ids: list[int], width: list[int], lo: int, hi: int) -> dict[int, int]:
    """Character position -> tokens before it, for the stable token starts of ``text`` in [lo, hi)."""
    wanted = [p for p in range(max(lo, 1), min(hi, len(text) - MARGIN)) if text[p] == " " and not text[p - 1].isspace() and not text[p + 1].isspace()]
    if not wanted:
        return {}
    out, byte, at = {}, len(text[: wanted[0]].encode()), 0
    places = {}
    for i, p in enumerate(wanted):
        if i:
            byte += len(text[wanted[i - 1] : p].encode())
        places[byte] = p
    last = byte
    for n, i in enumerate(ids):
        if at > last:
            break
        if at in places:
            out[places[at]] = n
        at += width[i]
    return out


def _chunks(size: int, overlap: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["_t_row"], batch["_t_text"], strict=True):
                begins = range(0, max(1, len(text)), size)
                for first in range(0, len(begins), 64):
                    part = begins[first : first + 64]
                    yield pd.DataFrame({"_t_row": row, "_t_at": [*part], "_t_last": [b + size >= len(text) for b in part], "_t_text": [text[b : b + size + overlap] for b in part]})

    return cut


def _encode(path: str, size: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, width = encoder(path), widths(path)
        for batch in batches:
            rows = []
            for row, at, last, text in batch.itertuples(index=False):
                ids = encode([text])[0]
                head = stable_starts(text, ids, width, 0, overlap) if at else {}
                tail = {} if last else stable_starts(text, ids, width, size, size + overlap)
                rows.append((row, at, last, len(ids), [at + p for p in head], [*head.values()], [at + p for p in tail], [*tail.values()]))
            yield pd.DataFrame(rows, columns=["_t_row", "_t_at", "_t_last", "n", "head_at", "head_n", "tail_at", "tail_n"])

    return run


_CHUNK = "_t_row long, _t_at long, _t_last boolean, _t_text string"
_PARTS = "_t_row long, _t_at long, _t_last boolean, n long, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>"


def _spliced(parts: DataFrame) -> DataFrame:
    """_t_row, n_tokens (null where two neighbours share no stable start).

    At a seam the left chunk stops and the right one begins: a chunk adds its tokens from the seam on, less those that its
    left neighbour has beyond the seam.
    """
    by = Window.partitionBy("_t_row").orderBy("_t_at")
    rows = parts.withColumns({"left_at": F.lag("tail_at").over(by), "left_n": F.lag("tail_n").over(by), "left_all": F.lag("n").over(by)})
    rows = rows.withColumn("seam", F.get(F.array_intersect("head_at", "left_at"), F.lit(0)))
    place = lambda at, n: F.get(n, (F.array_position(at, F.col("seam")) - 1).cast("int"))
    own = F.col("n") - place("head_at", "head_n")
    beyond = F.col("left_all") - place("left_at", "left_n")
    gain = F.when(F.col("_t_at") == 0, F.col("n")).otherwise(own - beyond)
    each = rows.withColumn("gain", gain)
    return each.groupBy("_t_row").agg(F.when(F.count(F.lit(1)) == F.count("gain"), F.sum("gain")).alias("n_tokens"))


def _whole(path: str):
    if path.endswith(".model"):  # sentencepiece: texts are encoded whole

        def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from sentencepiece import SentencePieceProcessor

            lib = SentencePieceProcessor(model_file=path)
            for texts in batches:
                yield pd.Series([len(x) for x in lib.encode(texts.tolist(), num_threads=1)], dtype="int64")

        return F.pandas_udf(pieces, "long")

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path)
        for texts in batches:
            yield pd.Series([len(x) for x in encode(texts.tolist())], dtype="int64")

    return F.pandas_udf(count, "long")


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk: int = 32768, overlap: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_tokens, over_limit.

    ``path`` names a vocabulary on every executor: a byte-level ``.json`` file or a sentencepiece ``.model`` file.
    """
    ship(docs.sparkSession)
    narrow = docs.select(F.col(key), text_of(text).alias("_t_text")).withColumn("n_bytes", F.octet_length("_t_text").cast("long"))
    if not byte_level(path):  # no offsets to splice by: texts are encoded whole
        counted = narrow.select(key, "n_bytes", _whole(path)("_t_text").alias("n_tokens"))
        return counted.withColumn("over_limit", F.col("n_tokens") > limit)
    long = F.length("_t_text") > chunk
    short = narrow.filter(~long).select(key, "n_bytes", _whole(path)("_t_text").alias("n_tokens"))
    # long texts only; written once, so that row numbers hold for every later step
    todo = table(narrow.filter(long).withColumn("_t_row", F.monotonically_increasing_id()))
    ids = todo.select("_t_row", F.col(key), "n_bytes")
    done, size = [], chunk
    while True:
        ends = todo.agg(F.max(F.length("_t_text"))).first()[0] or 0
        rows = todo.select("_t_row", "_t_text").mapInPandas(_chunks(size, overlap), _CHUNK).repartition("_t_row", "_t_at")
        found = table(_spliced(table(rows.mapInPandas(_encode(path, size, overlap), _PARTS))))
        done.append(found.filter("n_tokens is not null"))
        failed = found.filter("n_tokens is null")
        if size >= ends or failed.isEmpty():
            break
        todo = table(todo.join(failed.select("_t_row"), "_t_row", "left_semi"))
        size, overlap = 2 * size, 2 * overlap
    counted = done[0]
    for more in done[1:]:
        counted = counted.unionByName(more)
    huge = ids.join(counted, "_t_row").select(key, "n_bytes", "n_tokens")
    return short.unionByName(huge).withColumn("over_limit", F.col("n_tokens") > limit)
