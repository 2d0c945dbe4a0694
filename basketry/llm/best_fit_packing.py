"""Best-fit packing of tokenized documents into sequences, by hierarchical residual packing.

Every document becomes its ids and an end id. Only documents longer than a sequence are cut, into full pieces; what is
left over is the first piece. Full pieces are sequences of their own. The other pieces are items:

1. every partition packs its items by best fit, largest first;
2. bins filled to ``close`` or more are final, and so are bins that even the least filled bin left doesn't fit in. The other underfull bins become
   the items of the next round, in new partitions of about ``per_task`` items, so bins of several partitions meet;
3. when a round merges less than one item a partition, only bins up to half full go on: of two others neither fits into the other, and best fit leaves at most one such bin in a
   partition, so they are ``per_task`` times fewer each round. Rounds end when one partition has packed all that is left, so of all partitions together at most one bin is up to half full.

A round reads and writes one narrow row per item (id and length); pieces find their sequence by joining the rounds' (bin ->
parent, offset) tables. Each round is written to the shared folder, so a lost executor repeats one round at most.

Nulls: a null text is empty and becomes the end id alone. Ids that are null or repeated are fine: pieces are told apart by a row
number of the written table. Equal lengths are packed in the order of that number. An empty table gives an empty result. Extra
columns are ignored. Ids may have any type, which the result keeps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .bpe import encoder
from .common import table, text_of

PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long"
#: Spark's whole numbers as pandas columns that may hold nulls; ids of other types travel as objects.
WHOLE = {"tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64"}


def _pieces(path: str, size: int, end: int, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].astype(WHOLE.get(kind, "object")), batch["text"], strict=True):
                ids = np.array([*encode([text])[0], end], dtype="<u4")
                begin, number = 0, 0
                while begin < len(ids):
                    stop = begin + ((len(ids) - begin) % size or size)
                    rows.append((doc, number, begin, stop - begin, zlib.crc32(ids[begin:stop].tobytes())))
                    begin, number = stop, number + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": WHOLE.get(kind, "object")})

    return run


def pieces(docs: DataFrame, path: str, size: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids in pieces of at most ``size``."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text")).mapInPandas(_pieces(path, size, end, kind), PIECES.format(kind))


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], list[int]]:
    """For each length, largest first: its bin and offset; and each bin's fill.

    Open bins are kept by the room they have left, with one bit per room in an integer: the smallest room that is large
    enough is its lowest set bit.
    """
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, fill, mask = [], [], [], 0
    for n in lengths:
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            b, room = len(fill), size
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += n
        if room > n:
            rooms[room - n].append(b)
            mask |= 1 << (room - n)
    return bins, offsets, fill


def _packer(size: int, level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = pd.concat([*batches] or [pd.DataFrame({"item": [], "length": []})])
        items = items.sort_values(["length", "item"], ascending=[False, True], kind="stable")
        if not len(items):
            return
        bins, offsets, fill = best_fit([int(n) for n in items["length"]], size)
        first = (level << 58) + (TaskContext.get().partitionId() << 36)
        bins = np.array(bins)
        yield pd.DataFrame({"item": items["item"].to_numpy(), "bin": first + bins, "place": offsets, "fill": np.array(fill)[bins]})

    return run


def pack(items: DataFrame, size: int = 2048, close: float = 0.98, per_task: int = 50_000) -> DataFrame:
    """(item, length) -> (item, sequence_id, offset). Items are numbered once each and at most ``size`` long."""
    ship(items.sparkSession)
    full = items.filter(F.col("length") == size).select("item", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    level, left = 1, items.filter(F.col("length") < size).select("item", "length")
    n, rounds = left.count(), []
    while n:
        tasks = -(-n // per_task)
        made = table(left.repartition(tasks, F.xxhash64(F.lit(level), "item")).mapInPandas(_packer(size, level), "item long, bin long, place long, fill long"))
        rounds.append(made)
        bins = made.groupBy("bin").agg(F.max("fill").alias("length"))
        n_bins, least = bins.agg(F.count(F.lit(1)), F.min("length")).first()  # two numbers
        if tasks == 1:
            break
        most = size // 2 if n - n_bins < tasks else size - least
        left = table(bins.filter((F.col("length") < close * size) & (F.col("length") <= most)).select(F.col("bin").alias("item"), "length"))
        n, level = left.count(), level + 1
    if not rounds:
        return full
    out = rounds[0].select("item", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    for made in rounds[1:]:
        up = made.select(F.col("item").alias("sequence_id"), "bin", "place")
        out = out.join(up, "sequence_id", "left").select("item", F.coalesce("bin", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("place", F.lit(0))).alias("offset"))
    return full.unionByName(out)


def pack_documents(docs: DataFrame, path: str | None = None, size: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. ``path`` as in token_counts."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    made = table(pieces(docs, path, size, end, key, text).withColumn("item", F.monotonically_increasing_id()))
    placed = pack(made.select("item", "length"), size, **how)
    return made.join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
