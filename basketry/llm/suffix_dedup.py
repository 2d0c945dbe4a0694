"""Removal of every byte that a repeated ``length``-byte string covers, by a distributed merge sort of suffixes.

Sorting every suffix of a corpus moves hundreds of bytes per byte, so the suffix array is sparse, in a way that loses nothing.
A window of ``length`` bytes has an *anchor*: the place of the least hash of ``GRAM`` bytes inside it, leftmost on ties. Equal windows
have equal anchors at equal offsets, so only suffixes around anchors are sorted:

1. A scan counts the anchors' hashes. Those found twice or more set bits of a bitmap of fixed size; a window whose anchor
   occurs once can't repeat.
2. A second scan collects, for each anchor in the bitmap, the text of its run of windows. A task sorts these, drops repeats (they are known
   to be removed at once) and writes each bucket's part as a front-coded run: the prefix shared with the string before is a number.
3. A bucket merges its runs with a loser tree that keeps each head's common prefix with the last output. A comparison never
   looks at bytes that are known to be equal, and equal strings of different runs meet. What remains are the distinct
   contexts of an anchor, in order. Of their windows, those whose hash is found once are left out, which loses no repeat; the others are put in order
   and are removed only where ``length`` bytes are equal to a neighbour's.
4. Removed spans are merged per text in one pass over its sorted spans. Texts without any span take part in no join.

So in merged buckets no byte is removed because of a hash alone: hashes only choose what is compared.

Identical texts have identical answers, so a text is known by two hashes and its size rather than by its row. A bucket holds about ``per_bucket``
contexts, and copies of a context count once per run. A bucket of more than ``most`` bytes of contexts (an anchor with very many different
surroundings) is not merged by one task: its windows are rows, which Spark counts by anchor and a 128-bit BLAKE2 digest. There, and only there, equal digests count as equal bytes.

Nulls: a null text is empty. Texts shorter than ``length`` bytes keep everything. Repeated rows are repeats of each other. Empty tables and extra
columns, whatever their names, are fine: only key and text are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import key_bitmap, table, text_of, with_flag
from .shingles import _powers, batches, mixed

GRAM = 32
FILTER_BITS = 26
RUN_BYTES = 48 << 20
BATCH_BYTES = 2 << 20  # contexts whose windows are hashed at once
BUCKET_BYTES = 24 << 20  # contexts that one task merges
COMPARED = 20_000  # windows compared at once


def _hashes(prefix: np.ndarray, down: np.ndarray, width: int) -> np.ndarray:
    return mixed((prefix[width:] - prefix[:-width]) * down[: len(prefix) - width])


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out, down


def anchors(texts: list[bytes], length: int):
    """For a batch of texts: buffer, and per anchor: text number, hash, place, first and last window (all in the buffer)."""
    none = np.empty(0, dtype=np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    buffer = b"".join(texts)
    if len(buffer) < length:
        return buffer, sizes, none, none.astype(np.uint64), none, none, none
    data = np.frombuffer(buffer, dtype=np.uint8)
    prefix, down = _prefix(data)
    h = _hashes(prefix, down, GRAM)
    bits = np.uint64(len(h).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, reach = length - GRAM + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: -(width - reach)], least[width - reach :])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    windows = np.flatnonzero(np.arange(len(least)) + length <= ends[owner])
    at = (least[windows] & low).astype(np.int64)
    owner = owner[windows]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])))) if len(at) else none
    last = np.concatenate((new[1:], [len(at)])) - 1 if len(new) else none
    place = at[new]
    return buffer, sizes, owner[new], h[place], place, windows[new], windows[last]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; its first ``known`` bytes are not looked at."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n if not x else n - 1 - (x.bit_length() - 1) // 8


# ---- front-coded runs ------------------------------------------------------------------------------

_HEAD, _REF = struct.Struct("<HHB"), struct.Struct("<qiqq")


def encode_run(entries: list[tuple[bytes, tuple | None]]) -> bytes:
    """Sorted (string, ref) -> front-coded bytes. ref None: the string is known to be repeated."""
    out, before = [], b""
    for s, ref in entries:
        k = common_prefix(before, s)
        out += [_HEAD.pack(k, len(s) - k, ref is None), s[k:]]
        if ref is not None:
            out.append(_REF.pack(*ref))
        before = s
    return b"".join(out)


def decode_run(run: bytes):
    """(string, common prefix with the string before, ref) of a front-coded run."""
    at, s = 0, b""
    while at < len(run):
        k, n, many = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        s = s[:k] + run[at : at + n]
        at += n
        ref = None
        if not many:
            ref = _REF.unpack_from(run, at)
            at += _REF.size
        yield s, k, ref


def merge_runs(runs: list[bytes]):
    """Merges front-coded runs: (string, common prefix with the output before, ref) in order.

    A loser tree. Every head and every loser on the path of the last winner knows its common prefix with that winner; the one with the
    longer prefix is less, and only on equal prefixes are the bytes behind them compared.
    """
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    heads = [decode_run(r) for r in runs]
    current: list = [next(h, None) for h in heads] + [None] * (size - len(runs))
    known = [0] * size
    losers = [0] * size

    def beats(i: int, j: int) -> bool:
        """Whether head i goes before head j; the loser's known prefix becomes that with the winner."""
        a, b = current[i], current[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        if known[i] != known[j]:
            return known[i] > known[j]
        k = common_prefix(a[0], b[0], known[i])
        first = a[0][k : k + 1] < b[0][k : k + 1] or (a[0][k : k + 1] == b[0][k : k + 1] and i < j)
        known[j if first else i] = k
        return first

    def play(node: int) -> int:
        if node >= size:
            return node - size
        i, j = play(2 * node), play(2 * node + 1)
        win, lose = (i, j) if beats(i, j) else (j, i)
        losers[node] = lose
        return win

    winner = play(1)
    while current[winner] is not None:
        s, _, ref = current[winner]
        yield s, known[winner], ref
        head = next(heads[winner], None)
        current[winner] = head
        known[winner] = head[1] if head else 0
        node = (winner + size) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


# ---- tasks -----------------------------------------------------------------------------------------


def _counted(length: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("_s_text").to_pylist()
            for at in batches(texts, 1_000_000):
                h, n = np.unique(anchors([t.encode() for t in texts[at]], length)[3], return_counts=True)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return run


_OUT = ["bucket", "run", "k1", "k2", "size", "start", "end"]
_FOUND = "bucket int, run binary, k1 long, k2 int, size long, start long, end long"


def _runs(length: int, bitmap, buckets: int):
    """Front-coded runs by bucket, and the spans that a task's own repeats give."""

    def flush(held: dict[bytes, list]) -> Iterator[pd.DataFrame]:
        sure = {(*ref[:3], ref[3], ref[3] + len(s) - 8) for s, refs in held.items() if len(refs) > 1 for ref in refs}
        by: dict[int, list] = {}
        for s in sorted(held):
            refs = held[s]
            by.setdefault(int.from_bytes(s[:8], "big") % buckets, []).append((s, None if len(refs) > 1 else refs[0]))
        for bucket, entries in by.items():
            held_size = sum(len(s) for s, _ in entries)
            yield pd.DataFrame([(bucket, encode_run(entries), None, None, held_size, None, None)], columns=_OUT)
        if sure:
            spans = pd.DataFrame(sorted(sure), columns=_OUT[2:])
            yield spans.assign(bucket=None, run=None)[_OUT]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        words = np.frombuffer(bitmap.value, dtype=np.uint64)
        held: dict[bytes, list] = {}
        size = 0
        for part in parts:
            texts = part.column("_s_text").to_pylist()
            k1, k2 = part.column("k1").to_pylist(), part.column("k2").to_pylist()
            for at in batches(texts, 1_000_000):
                buffer, sizes, owner, h, _, first, last = anchors([t.encode() for t in texts[at]], length)
                slot = h & np.uint64((1 << FILTER_BITS) - 1)
                hit = (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
                begins = np.cumsum(sizes) - sizes
                for i in np.flatnonzero(hit):
                    o, a, b = int(owner[i]), int(first[i]), int(last[i]) + length
                    s = int(h[i]).to_bytes(8, "big") + buffer[a:b]
                    ref = (k1[at.start + o], k2[at.start + o], int(sizes[o]), a - int(begins[o]))
                    refs = held.get(s)
                    if refs is None:
                        held[s] = [ref]
                        size += len(s) + 200
                    else:
                        refs.append(ref)
                        size += 100
                if size > RUN_BYTES:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    def arrow(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("run", pa.binary()), ("k1", pa.int64()), ("k2", pa.int32()), ("size", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
        for out in run(parts):
            yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)

    return arrow


def _windows_of(body: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All contexts as one buffer; of every window its context's number, its place there and its place in the buffer."""
    data = np.frombuffer(b"".join(body), dtype=np.uint8)
    count = np.array([len(s) - 8 - length + 1 for s in body])
    begin = np.cumsum([0, *map(len, body[:-1])]) + 8
    which = np.repeat(np.arange(len(body)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return data, which, place, begin[which] + place


def window_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each window; equal windows have equal hashes."""
    prefix, down = _prefix(data)
    return mixed((prefix[at + length] - prefix[at]) * down[at])


def repeated_windows(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows that start at ``at`` are found twice or more, byte by byte.

    Windows of equal hash are neighbours; their bytes are compared, a bounded number at once. Where a hash holds
    different windows (a collision), its windows are sorted by their bytes.
    """
    out = np.zeros(len(at), dtype=bool)
    w = window_hashes(data, at, length)
    order = np.argsort(w, kind="stable")
    near = np.flatnonzero(w[order[1:]] == w[order[:-1]])
    rows, equal = np.lib.stride_tricks.sliding_window_view(data, length), np.empty(len(near), dtype=bool)
    for i in range(0, len(near), COMPARED):
        k = near[i : i + COMPARED]
        equal[i : i + COMPARED] = (rows[at[order[k]]] == rows[at[order[k + 1]]]).all(axis=1)
    out[order[near[equal]]] = out[order[near[equal] + 1]] = True
    for h in np.unique(w[order[near[~equal]]]):
        own = order[np.searchsorted(w[order], h) : np.searchsorted(w[order], h, side="right")]
        strings = sorted((rows[at[i]].tobytes(), i) for i in own)
        for (s, i), (t, j) in zip(strings, strings[1:], strict=False):
            if common_prefix(s, t) == length:
                out[i] = out[j] = True
    return out


def _resolved(strings: list[bytes], refs: list[list], many: list[bool], length: int) -> list[tuple]:
    """Spans of one bucket's distinct contexts (sorted): whole ones of repeated contexts, and windows shared by several."""
    spans = []
    for s, own, m in zip(strings, refs, many, strict=True):
        if m:
            spans += [(*r[:3], r[3], r[3] + len(s) - 8) for r in own]
    first = 0
    while first < len(strings):  # whole anchors, about BATCH_BYTES at once
        near, size = [], 0
        while first < len(strings) and size < BATCH_BYTES:
            stop = first + 1
            while stop < len(strings) and strings[stop][:8] == strings[first][:8]:
                stop += 1
            if stop > first + 1:
                near += range(first, stop)
                size += sum(map(len, strings[first:stop]))
            first = stop
        if near:
            spans += _shared([strings[i] for i in near], [refs[i] for i in near], [many[i] for i in near], length)
    return spans


def _shared(body: list[bytes], refs: list[list], many: list[bool], length: int) -> list[tuple]:
    """Spans of the windows that two contexts share, or that are found twice in one."""
    spans = []
    data, which, place, at = _windows_of(body, length)
    shared = repeated_windows(data, at, length)
    cut = np.flatnonzero(shared & np.concatenate(([True], ~shared[:-1] | (which[1:] != which[:-1]))))
    stop = np.flatnonzero(shared & np.concatenate((~shared[1:] | (which[1:] != which[:-1]), [True])))
    for a, b in zip(cut, stop, strict=True):
        i = which[a]
        if not many[i]:
            spans += [(*r[:3], r[3] + int(place[a]), r[3] + int(place[b]) + length) for r in refs[i]]
    return spans


def _merged(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        strings: list[bytes] = []
        refs: list[list] = []
        many: list[bool] = []
        for s, k, ref in merge_runs(rows["run"].tolist()):
            if strings and k == len(s) == len(strings[-1]):
                many[-1] = True
            else:
                strings.append(s)
                refs.append([])
                many.append(ref is None)
            if ref is not None:
                refs[-1].append(ref)
        return pd.DataFrame(_resolved(strings, refs, many, length), columns=_OUT[2:])

    return run


def _windows(length: int):
    """Every window of front-coded runs: anchor, hash, how often it surely occurs, and where (null if its span is known already)."""

    def rows(held: list[tuple[bytes, tuple | None]]) -> pa.RecordBatch:
        body = [s for s, _ in held]
        data, which, place, at = _windows_of(body, length)
        buffer = data.tobytes()
        digests = np.frombuffer(b"".join(hashlib.blake2b(buffer[a : a + length], digest_size=16).digest() for a in at), dtype=np.int64).reshape(-1, 2)
        anchor = np.array([int.from_bytes(s[:8], "big") for s in body], dtype=np.uint64)[which]
        known = np.array([ref is None for _, ref in held])
        k1, k2, size, start = np.array([ref or (0, 0, 0, 0) for _, ref in held], dtype=np.int64).T
        columns = [anchor.view(np.int64), digests[:, 0], digests[:, 1], 1 + known[which], k1[which], k2[which].astype(np.int32), size[which], start[which] + place, known[which]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "w1", "w2", "n", "k1", "k2", "size", "start", "known"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for front_coded in part.column("run"):
                held, size = [], 0
                for s, _, ref in decode_run(front_coded.as_py()):
                    held.append((s, ref))
                    size += len(s)
                    if size > BATCH_BYTES:
                        yield rows(held)
                        held, size = [], 0
                if held:
                    yield rows(held)

    return run


def _spans_of_windows(runs: DataFrame, length: int) -> DataFrame:
    """k1, k2, size, start, end of the repeated windows in runs whose buckets are too large for one task.

    Windows are counted by anchor and digest with partial sums. A bitmap of the repeated ones keeps all others from the second shuffle.
    """
    windows = runs.mapInArrow(_windows(length), "anchor long, w1 long, w2 long, n long, k1 long, k2 int, size long, start long, known boolean")
    by = ["anchor", "w1", "w2"]
    again = table(windows.groupBy(*by).agg(F.sum("n").alias("n")).filter("n > 1").select(*by))
    asked = with_flag(windows.filter("not known"), key_bitmap(again, by, FILTER_BITS), by, "_s_open", FILTER_BITS).filter("_s_open")
    starts = asked.join(again, by, "left_semi").select("k1", "k2", "size", "start").distinct()
    text = Window.partitionBy("k1", "k2", "size").orderBy("start")  # of one text, as the starts are distinct
    island = starts.withColumn("_s_island", F.col("start") - F.row_number().over(text))
    return island.groupBy("k1", "k2", "size", "_s_island").agg(F.min("start").alias("start"), (F.max("start") + length).alias("end")).drop("_s_island")


def repeated_spans(docs: DataFrame, length: int = 200, per_bucket: int = 20_000, text: str = "text", most: int = BUCKET_BYTES) -> DataFrame:
    """k1, k2, size, starts, ends: for each text with repeated strings, the spans that they cover, sorted, in bytes; spans may overlap."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(text_of(text).alias("_s_text")).filter(F.octet_length("_s_text") >= length)
    counted = rows.mapInArrow(_counted(length), "h long, n long")
    again = table(counted.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"))
    # slots are taken from the hash itself here, as the tasks do
    slot = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1).cast("long"))
    masks = again.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("mask")).toArrow()
    words = np.zeros((1 << FILTER_BITS) // 64, dtype=np.int64)
    words[masks["word"].to_numpy()] = masks["mask"].to_numpy()
    total = again.agg(F.sum("n")).first()[0] or 0
    bitmap = spark.sparkContext.broadcast(words.tobytes())
    keyed = rows.select("_s_text", F.xxhash64("_s_text").alias("k1"), F.hash("_s_text").alias("k2"))
    found = table(keyed.mapInArrow(_runs(length, bitmap, max(1, -(-total // per_bucket))), _FOUND))
    spans = "k1 long, k2 int, size long, start long, end long"
    runs = found.filter("bucket is not null")
    large = table(runs.groupBy("bucket").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > most).select("bucket"))
    if large.isEmpty():
        small, beyond = runs, None
    else:
        small, beyond = runs.join(large, "bucket", "left_anti"), _spans_of_windows(runs.join(large, "bucket", "left_semi").select("run"), length)
    every = found.filter("bucket is null").select("k1", "k2", "size", "start", "end").unionByName(small.select("bucket", "run").groupBy("bucket").applyInPandas(_merged(length), spans))
    every = (every.unionByName(beyond) if beyond is not None else every).distinct()
    sorted_spans = every.groupBy("k1", "k2", "size").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("all"))
    return sorted_spans.select("k1", "k2", "size", F.col("all.start").alias("starts"), F.col("all.end").alias("ends"))


def joined_up(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of sorted spans, in one pass."""
    ends = np.maximum.accumulate(ends)
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.concatenate((new[1:], [True]))]


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, _s_text, starts, ends -> id, n_bytes, n_removed, n_spans, kept."""
    for part in parts:
        rows = []
        for text, starts, ends in zip(part.column("_s_text"), part.column("starts"), part.column("ends"), strict=True):
            data = text.as_py().encode()
            a, b = joined_up(starts.values.to_numpy(), ends.values.to_numpy())
            kept = b"".join(data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True))
            rows.append((len(data), int((b - a).sum()), len(a), kept))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, length: int = 200, per_bucket: int = 20_000, key: str = "doc_id", text: str = "text", most: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    spans = table(repeated_spans(docs, length, per_bucket, text, most))
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("_s_text")).withColumns({"k1": F.xxhash64("_s_text"), "k2": F.hash("_s_text"), "size": F.octet_length("_s_text").cast("long")})
    by = ["k1", "k2", "size"]
    flagged = with_flag(rows, key_bitmap(spans, by), by, "open")
    zero = F.lit(0).cast("long")
    whole = lambda df: df.select("id", F.col("size").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.encode("_s_text", "UTF-8").alias("kept"))
    asked = flagged.filter("open").drop("open").join(spans, by, "left")
    key_type = rows.schema["id"].dataType.simpleString()
    cut = asked.filter("starts is not null").select("id", "_s_text", "starts", "ends").mapInArrow(_cut, f"id {key_type}, n_bytes long, n_removed long, n_spans long, kept binary")
    every = whole(flagged.filter("not open")).unionByName(whole(asked.filter("starts is null"))).unionByName(cut)
    return every.withColumnRenamed("id", key)
