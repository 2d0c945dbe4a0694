"""Near duplicates by MinHash: an inverted join on signature coordinates, confirmed on full shingle sets.

1. Every text becomes its set of word shingles and a signature of ``coords`` minima. Equal sets form one class.
2. Classes are posted under each (coordinate, value). Values with one posting can't collide and are dropped.
3. Two signatures that agree in ``match`` coordinates must share one of the ``r - match + 1`` rarest of a class's ``r`` shared
   values (prefix). Only these are posted; the common values at the other end are skipped, and classes with
   ``r < match`` vanish. A posting list is merged member by member: collisions of a member with the rest of the list are counted, those that reach ``match``
   leave the list, and their own collisions are counted with what is left only (skip). So a list of near-equal texts costs its length, not its square, and gives a
   spanning set of its matching pairs. A long list is cut into blocks whose pairs are separate tasks.
4. The matching pairs' components (clusters) are searched exactly on full sets, in two steps that compare only what is not joined yet: within blocks of
   bounded size, which a few pivots of the cluster join as members of all of them; and, in clusters that are still in several parts, the members outside
   the largest part against all. So no link between posted classes is lost, and only pivots and those last members make copies of sets.

A pair at similarity ``threshold`` agrees in a coordinate with that probability, so with 64 coordinates it agrees in fewer than 34 with a
probability of about 3e-10 at 0.85 and 3.2e-7 at 0.80; ``match`` is the step's only loss.

Nulls: a null text has no shingles; texts without words are linked with nothing. A null ``doc_id`` ranks after all numbers; a
component without any number has a null ``component_id``. Rows that repeat id and text get equal results. Empty tables and extra
columns, whatever their names, are fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import key_bitmap, packed, table, text_of, with_flag
from .components import components
from .shingles import batches, fingerprint, mixed, shingle_sets

BLOCK = 1024  # members of a posting list compared at once
SETS, SHINGLES, PIVOTS = 256, 1 << 20, 16  # sets, and shingles in all, of a block of full sets; pivots of a cluster, about
FILTER_BITS = 24


def _family(coords: int) -> tuple[np.ndarray, np.ndarray]:
    r = mixed(np.arange(1, 2 * coords + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return r[:coords] | np.uint64(1), r[coords:]


def minima(sets: list[np.ndarray], coords: int) -> np.ndarray:
    """Signatures, one row per set (none empty): the least value of each hash function, mixed with the coordinate."""
    mul, add = _family(coords)
    out = np.empty((len(sets), coords), dtype=np.uint64)
    first = 0
    while first < len(sets):
        stop, size = first + 1, len(sets[first])
        while stop < len(sets) and size + len(sets[stop]) <= 32768:
            size += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[first:stop])
        starts = np.cumsum([0, *map(len, sets[first : stop - 1])])
        for k in range(coords):
            out[first:stop, k] = np.minimum.reduceat(flat * mul[k] + add[k], starts)
        first = stop
    return mixed(out ^ add)


def _signed(width: int, coords: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("_n_text").to_pylist()
            for at in batches(texts):
                sets = shingle_sets(texts[at], width)
                full = [x for x in sets if len(x)]
                sig = iter(minima(full, coords)) if full else iter(())
                rows = part.slice(at.start, at.stop - at.start)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c for name, c in zip(rows.schema.names, rows.columns, strict=True) if name != "_n_text"],
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([fingerprint(x) for x in sets], pa.binary()),
                        pa.array([next(sig).tobytes() if len(x) else None for x in sets], pa.binary()),
                    ],
                    names=[*[name for name in rows.schema.names if name != "_n_text"], "n", "fp", "sig"],
                )

    return run


def _tokens(coords: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sigs = part.column("sig").to_pylist()
            if sigs:
                values = np.frombuffer(b"".join(sigs), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("node").to_numpy(), coords)), pa.array(values)], names=["node", "token"])

    return run


def spanning(labels: np.ndarray, linked) -> list[tuple[int, int]]:
    """Pairs (i, j) that join all labels which ``linked(i, others)``, a mask of the others, joins.

    A search that leaves out what it has reached: a row that was reached is compared with nobody's rest again. Small
    labels go first, so the rows of the largest are not compared with each other.
    """
    _, group, size = np.unique(labels, return_inverse=True, return_counts=True)
    alone = len(size) == len(labels)
    pool = np.lexsort((np.arange(len(labels)), group, size[group]))
    pairs = []
    while len(pool):
        inside = group[pool] == group[pool[0]]
        queue, pool = [*pool[inside]], pool[~inside]
        for i in queue:  # grows
            if not len(pool):
                break
            hit = linked(i, pool)
            if hit.any():
                found = pool[hit]
                if not alone:
                    groups, first = np.unique(group[found], return_index=True)
                    found, hit = found[first], np.isin(group[pool], groups)
                pairs += [(i, j) for j in found]
                queue += [*pool[hit]]
                pool = pool[~hit]
    return pairs


def _runs(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A sorted partition in tables of whole runs of equal keys, each with the bounds of its runs."""
    held: pa.Table | None = None
    for part in parts:
        if not part.num_rows:
            continue
        fresh = pa.Table.from_batches([part])
        rows = fresh if held is None else pa.concat_tables([held, fresh])
        k = np.stack([rows[c].to_numpy() for c in keys])
        starts = np.flatnonzero(np.concatenate(([True], (k[:, 1:] != k[:, :-1]).any(axis=0))))
        if starts[-1]:
            yield rows.slice(0, starts[-1]), starts
        held = rows.slice(starts[-1])
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _pairs_of(nodes: np.ndarray, a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes[np.array(x, dtype=np.int64)]) for x in (a, b)], names=["a", "b"])


def _collided(match: int, percent: int):
    """Spanning pairs of a posting list whose signatures agree in ``match`` coordinates and whose sizes allow a link."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _runs(parts, ["token", "b1", "b2"]):
            nodes, n = rows["node"].to_numpy(), rows["n"].to_numpy()
            sig = np.frombuffer(b"".join(rows["low"].to_pylist()), dtype=np.uint8).reshape(len(nodes), -1)
            fits = lambda i, j: 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            collide = lambda i, j: fits(i, j) & (np.count_nonzero(sig[i] == sig[j], axis=1) >= match)
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            two = two[collide(two, two + 1)] if len(two) else two
            a, b = [*two], [*(two + 1)]
            for first, size in zip(bounds[:-1][sizes > 2], sizes[sizes > 2], strict=True):
                found = spanning(np.arange(size), lambda i, others, first=first: collide(first + i, first + others))
                a += [first + i for i, _ in found]
                b += [first + j for _, j in found]
            if a:
                yield _pairs_of(nodes, a, b)

    return run


def _linked(percent: int):
    """Spanning links between the labels of a block of full sets: 100 * intersection >= percent * union."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _runs(parts, ["cluster", "b1", "b2"]):
            nodes, labels = rows["node"].to_numpy(), rows["label"].to_numpy()
            for first, stop in zip(bounds[:-1], bounds[1:], strict=True):
                if stop - first < 2:
                    continue
                sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["shingles"].slice(first, stop - first).to_pylist()]
                n = np.array([len(x) for x in sets])
                vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
                own = np.split(flat, np.cumsum(n)[:-1])
                has = np.zeros(len(vocabulary), dtype=np.uint8)

                def linked(i: int, others: np.ndarray, own=own, n=n, has=has) -> np.ndarray:
                    out = 100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others])
                    near = others[out]
                    if len(near):
                        has[own[i]] = 1
                        begins = np.cumsum(n[near]) - n[near]
                        common = np.add.reduceat(has[np.concatenate([own[j] for j in near])], begins, dtype=np.int64)
                        has[own[i]] = 0
                        out[out] = 100 * common >= percent * (n[i] + n[near] - common)
                    return out

                found = spanning(labels[first:stop], linked)
                if found:
                    yield _pairs_of(nodes, [first + i for i, _ in found], [first + j for _, j in found])

    return run


def _low(part: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for sigs in part:
        yield sigs.map(lambda x: x[::8])


def _in_blocks(rows: DataFrame, blocks) -> DataFrame:
    """Each row once for every pair of blocks (b1 <= b2) that its own block is in; ``blocks`` may differ by group."""
    own = F.pmod(F.xxhash64(F.lit(7), F.col("node")), F.col("blocks"))
    at = rows.withColumn("blocks", blocks.cast("long")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return at.withColumns({"b1": F.least("own", "other"), "b2": F.greatest("own", "other")}).drop("blocks", "own", "other")


def _dealt(rows: DataFrame, keys: list[str], n: int, per_task: int) -> DataFrame:
    """Rows in as many partitions as their number ``n`` asks for, sorted by ``keys``: tasks grow with rows, not bytes."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // per_task))
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "node")


def _searched(blocks: DataFrame, n: int, percent: int) -> DataFrame:
    """cluster, b1, b2, node, label, shingles -> links (a, b)."""
    dealt = _dealt(blocks.select("cluster", "b1", "b2", "node", "label", "shingles"), ["cluster", "b1", "b2"], n, 1000)
    return dealt.mapInArrow(_linked(percent), "a long, b long")


def _thinned(pairs: DataFrame) -> DataFrame:
    """Fewer pairs (a, b) with the same components: each b keeps its least a, and that is joined to b's other ones.

    A row is the b of one pair of each of its posting lists at most, so the sets are small; many of their pairs are the same.
    """
    each = pairs.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("all"))
    least = F.get("all", F.lit(0))
    ends = F.transform(F.concat(F.array("b"), F.slice("all", F.lit(2), F.size("all"))), lambda x: F.struct(least.alias("a"), x.alias("b")))
    return each.select(F.inline(ends)).distinct()


def _parts(full: DataFrame, percent: int, sets: int = SETS) -> DataFrame:
    """Written (cluster, node, n, shingles) -> (node, root) of the components of all links, for nodes with a link."""
    count = F.count(F.lit(1))
    many = lambda: F.greatest(F.ceil(count / sets), F.ceil(F.sum("n") / SHINGLES)).cast("long").alias("many")
    hashed = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), F.col("node")), F.col(n))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    size, n = table(full.groupBy("cluster").agg(many(), F.ceil(count / PIVOTS).cast("long").alias("spread"))), full.count()
    own = F.when(hashed(8, "spread") == 0, upto("many")).otherwise(F.array(hashed(7, "many")))
    one = full.join(size, "cluster").withColumn("b1", F.explode(own)).withColumns({"b2": F.lit(0).cast("long"), "label": F.col("node")})
    found = components(_searched(one, n, percent))
    wide = size.filter("many > 1").select("cluster")
    if wide.isEmpty():
        return found
    named = full.select("cluster", "node", "n").join(wide, "cluster").join(found.withColumnRenamed("root", "label"), "node", "left")
    parts = table(named.withColumn("label", F.coalesce("label", "node")))
    # clusters in several parts: everybody outside the largest part meets all others
    counts = parts.groupBy("cluster", "label").agg(count.alias("k"))
    largest = table(counts.groupBy("cluster").agg(F.max_by("label", F.struct("k", "label")).alias("largest"), count.alias("labels")).filter("labels > 1").drop("labels"))
    if largest.isEmpty():
        return found
    asked = parts.join(largest, "cluster").withColumn("outside", F.col("label") != F.col("largest"))
    out_n = F.count_if("outside")
    sizes = asked.groupBy("cluster").agg(many().alias("many_all"), F.greatest(F.ceil(out_n / sets), F.ceil(F.sum(F.when(F.col("outside"), F.col("n"))) / SHINGLES)).cast("long").alias("many_out"))
    sized = asked.join(table(sizes), "cluster")
    every = sized.select("cluster", F.explode(upto("many_out")).alias("b1"), hashed(9, "many_all").alias("b2"), "node", "label")
    outside = sized.filter("outside").select("cluster", hashed(10, "many_out").alias("b1"), F.explode(upto("many_all")).alias("b2"), "node", "label")
    rest = table(every.unionByName(outside))
    links = _searched(rest.join(full.select("node", "shingles"), "node"), rest.count(), percent)
    return components(links.unionByName(found.select(F.col("root").alias("a"), F.col("node").alias("b"))))


def near_dedup(docs: DataFrame, percent: int = 85, width: int = 5, coords: int = 64, match: int = 34, key: str = "doc_id", text: str = "text", sets: int = SETS) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept, and _n_tie (a hash of the text)."""
    ship(docs.sparkSession)
    key_type = docs.select(F.col(key).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    narrow = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text_of(text)).alias("_n_tie"), text_of(text).alias("_n_text"))
    rows = table(narrow.mapInArrow(_signed(width, coords), f"doc_id {key_type}, _n_tie long, n long, fp binary, sig binary"))

    classes = rows.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = table(classes.withColumn("node", F.monotonically_increasing_id()))

    tokens = classes.select("node", "sig").mapInArrow(_tokens(coords), "node long, token long")
    shared = table(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1"))
    open_tokens = with_flag(tokens, key_bitmap(shared, ["token"], FILTER_BITS), ["token"], "_n_open", FILTER_BITS).filter("_n_open").drop("_n_open")
    by_node = open_tokens.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("t"))
    live = by_node.filter(F.size("t") >= match).select("node", F.slice("t", F.lit(1), F.size("t") - match + 1).alias("t"))
    low = F.pandas_udf(_low, "binary")
    posted = table(live.join(classes.select("node", "n", low("sig").alias("low")), "node").select("node", "n", "low", F.explode(F.col("t.token")).alias("token")))
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    blocks = _in_blocks(posted.join(lists, "token"), F.ceil(F.col("members") / BLOCK)).drop("members")
    pairs = _dealt(blocks, ["token", "b1", "b2"], posted.count(), 20_000).mapInArrow(_collided(match, percent), "a long, b long")
    clusters = components(_thinned(pairs)).withColumnRenamed("root", "cluster")

    members = table(clusters.join(classes.select("node", "fp", "doc_id", "n"), "node"))
    full = table(members.select("node", "cluster", "fp", "n").join(_sets_of(docs, members, width, key, text), "fp").drop("fp"))
    found = _parts(full, percent, sets)

    named = table(found.join(classes.select("node", "fp", "doc_id"), "node"))
    least = table(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    of_links = named.join(least, "root").select("fp", "component_id")
    of_copies = classes.filter("copies > 1").select("fp", F.col("doc_id").alias("component_id")).join(named.select("fp"), "fp", "left_anti")
    answer = table(of_links.unionByName(of_copies).select(F.col("fp").alias("_n_fp"), "component_id", F.lit(True).alias("_n_found")))
    out = rows.drop("sig").join(answer, F.col("fp") == F.col("_n_fp"), "left")
    component = F.when(F.col("_n_found"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "_n_tie")


def _sets_of(docs: DataFrame, members: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """fp, shingles (sorted, as bytes) of the members' classes, each once; other texts are filtered out in the scan."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("_n_text").to_pylist()
            for at in batches(texts):
                sets = [x for x in shingle_sets(texts[at], width) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["fp", "shingles"])

    rows = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("_n_text"))
    wanted = with_flag(rows, key_bitmap(members, ["doc_id"], FILTER_BITS), ["doc_id"], "_n_open", FILTER_BITS).filter("_n_open")
    return wanted.select("_n_text").mapInArrow(run, "fp binary, shingles binary").dropDuplicates(["fp"])


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that :func:`near_dedup` does not keep.

    Dropped rows are known by key and a hash of the text. A bitmap of them, of fixed size, lets all rows that surely stay pass without a
    shuffle; only the others are looked up.
    """
    gone = table(near_dedup(docs, key=key, text=text, **how).filter("not kept").select(F.col(key).alias("id"), F.col("_n_tie").alias("tie")).distinct())
    rows = packed(docs, id=F.col(key), tie=F.xxhash64(text_of(text)))
    flagged = with_flag(rows, key_bitmap(gone, ["id", "tie"], FILTER_BITS), ["id", "tie"], "open", FILTER_BITS)
    stay = flagged.filter("not open").select("row")
    asked = flagged.filter("open").alias("d")
    left = asked.join(gone.alias("g"), F.expr("d.id <=> g.id and d.tie = g.tie"), "left_anti").select("row")
    return stay.unionByName(left).select("row.*")
