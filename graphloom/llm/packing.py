"""Filling fixed-capacity containers with items (problem 8).

Only the histogram of lengths reaches the driver; its size is the capacity,
whatever the corpus. There, patterns of few documents that fill a container
are enumerated over length classes, their repeat counts fitted to the
histogram by non-negative least squares and rounded, and the room that is left
filled best-fit with what remains; what no pattern takes is packed the same
way. The plan says which ranks of each length go to which containers, so every
document finds its place by its rank among the documents of its length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.tokenizer import TOKENIZERS, VOCABULARY, encoder, shared_model
from graphloom.session import cut

CAPACITY = 2048
CLASSES = 64  # length classes of the patterns
PARTS = 4  # documents of a pattern at most


def patterns(classes: int = CLASSES, parts: int = PARTS) -> list[tuple[int, ...]]:
    """Descending class numbers that sum to ``classes``, at most ``parts`` of them."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int, top: int) -> None:
        if left == 0:
            out.append(head)
            return
        if len(head) == parts:
            return
        for c in range(min(top, left), 0, -1):
            if c * (parts - len(head)) >= left:
                extend((*head, c), left - c, c)

    extend((), classes, classes)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Non-negative x that minimises |a x - b|, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    gradient = a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(gradient).max(initial=0)))
    for _ in range(rounds):
        free = np.where(passive, -np.inf, gradient)
        j = int(np.argmax(free))
        if free[j] <= tolerance:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.zeros(n)
            s[at] = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            low = at[s[at] <= 0]
            if not len(low):
                break
            step = float(np.min(x[low] / np.maximum(x[low] - s[low], 1e-300)))
            x += step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = s
        gradient = a.T @ (b - a @ x)
    return x


def fit_patterns(counts: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES, parts: int = PARTS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of length classes with whole repeat counts, those repeated at least once."""
    width = -(-capacity // classes)
    histogram = np.zeros(classes)
    for length in range(1, capacity + 1):
        histogram[(length - 1) // width] += counts[length]
    if not histogram.any():
        return []
    found = patterns(classes, parts)
    a = np.zeros((classes, len(found)))
    for j, p in enumerate(found):
        for c in p:
            a[c - 1, j] += 1
    scale = histogram.max()
    x = np.rint(nnls(a, histogram / scale) * scale).astype(np.int64)
    return sorted(((found[j], int(x[j])) for j in np.flatnonzero(x)), reverse=True)


def plan(counts: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES, parts: int = PARTS) -> list[tuple[list[tuple[int, int]], int]]:
    """Groups of equal containers, ([(length, times)], repeats), that use up ``counts``, indexed by length.

    Each group exhausts a length or a pattern's repeats, so there are at most
    about capacity plus patterns of them, however many items there are.
    """
    counts = counts.astype(np.int64).copy()
    width = -(-capacity // classes)
    lengths = [int(i) for i in np.flatnonzero(counts) if i > 0]  # ascending, those still there
    groups: list[tuple[list[tuple[int, int]], int]] = []

    def fill(wanted: tuple[int, ...], most: int) -> int:
        """One group that starts with the wanted classes; returns its repeats."""
        taken: dict[int, int] = {}
        room = capacity

        def take(limit: int) -> bool:
            nonlocal room
            at = bisect_right(lengths, limit)
            while at:
                length = lengths[at - 1]
                if counts[length] > taken.get(length, 0):
                    taken[length] = taken.get(length, 0) + 1
                    room -= length
                    return True
                at -= 1
            return False

        for c in wanted:
            if not take(min(c * width, room)):
                break
        while room and lengths and lengths[0] <= room and take(room):
            pass
        if not taken:
            return 0
        repeats = min(most, *(int(counts[x] // n) for x, n in taken.items()))
        for x, n in taken.items():
            counts[x] -= n * repeats
            if not counts[x]:
                lengths.remove(x)
        groups.append((sorted(taken.items(), reverse=True), repeats))
        return repeats

    for classes_of, repeats in fit_patterns(counts, capacity, classes, parts):
        while repeats > 0:
            lead = classes_of[0]
            at = bisect_right(lengths, lead * width)
            if not at or lengths[at - 1] <= (lead - 1) * width:
                break  # the leading class is used up
            done = fill(classes_of, repeats)
            if not done:
                break
            repeats -= done
    while lengths:
        top = lengths[-1]
        fill((-(-top // width),), int(counts[top]))
    return groups


def token_pieces(documents: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of documents: doc_id, piece, start, n_tokens, pid, idx.

    A document within the capacity is one piece; a longer one is cut at whole
    capacities. Null and empty texts are one piece of no tokens. ``idx`` numbers
    the pieces of equal length within their partition ``pid``.
    """
    model = shared_model(documents, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid, seen = encoder(model.value), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc, n in zip(part.column(0).to_pylist(), enc.count(part.column(1).to_pylist())):
                    for piece, start in enumerate(range(0, max(n, 1), capacity)):
                        size = min(capacity, n - start)
                        for column, value in zip(out, (doc, piece, start, size, seen[size])):
                            column.append(value)
                        seen[size] += 1
                arrays = [pa.array(x, pa.int64()) for x in out]
                yield pa.RecordBatch.from_arrays([*arrays[:4], pa.array([pid] * len(arrays[0]), pa.int64()), arrays[4]], names=["doc_id", "piece", "start", "n_tokens", "pid", "idx"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, piece long, start long, n_tokens long, pid long, idx long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers of pieces: doc_id, piece, start, n_tokens, container_id, offset.

    ``pieces`` as :func:`token_pieces` gives them. No container holds more than
    ``capacity`` tokens. Pieces without tokens need no room and are dealt out
    over all containers (or container 0). ``offset`` is the piece's place in its
    container. No pieces give no rows.
    """
    pieces = cut(pieces)
    spark = pieces.sparkSession
    per_part = pieces.groupBy("pid", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in per_part.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect():  # a row per length
        histogram[row["n_tokens"]] = row["n"]
    keys, base, times, size, offset = [], [], [], [], []
    used, n_containers = [0] * (capacity + 1), 0
    for group, repeats in plan(histogram, capacity):
        at = 0
        for length, n in group:
            keys.append((length, used[length]))
            for column, value in ((base, n_containers), (times, n), (size, length), (offset, at)):
                column.append(value)
            used[length] += n * repeats
            at += n * length
        n_containers += repeats
    order = sorted(range(len(keys)), key=keys.__getitem__)
    shift = 1 << 44
    slots = {
        "key": np.array([keys[i][0] * shift + keys[i][1] for i in order], dtype=np.int64),
        **{name: np.array([column[i] for i in order], dtype=np.int64) for name, column in (("base", base), ("times", times), ("size", size), ("offset", offset))},
    }
    shared = spark.sparkContext.broadcast(slots)  # as large as the plan, which the capacity bounds
    total = max(n_containers, 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            n, rank = (np.asarray(batch.column(i)) for i in (3, 4))
            where, off = rank % total, np.zeros(len(n), dtype=np.int64)
            full = n > 0
            if full.any():
                key = n[full] * shift + rank[full]
                i = np.searchsorted(s["key"], key, side="right") - 1
                nth = key - s["key"][i]
                where[full] = s["base"][i] + nth // s["times"][i]
                off[full] = s["offset"][i] + nth % s["times"][i] * s["size"][i]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(where), pa.array(off)], names=["doc_id", "piece", "start", "n_tokens", "container_id", "offset"])

    earlier = Window.partitionBy("n_tokens").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_part.select("pid", "n_tokens", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(shifts, ["pid", "n_tokens"]).select("doc_id", "piece", "start", "n_tokens", (F.col("idx") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece long, start long, n_tokens long, container_id long, offset long")


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per container: container_id, n_pieces, n_tokens, unused."""
    return packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens")).withColumn("unused", F.lit(capacity) - F.col("n_tokens"))


def utilisation(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_containers, n_pieces, n_tokens, least_containers (the lower bound), filled (share of all room)."""
    c = containers(packed, capacity)
    one = c.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n_pieces").alias("n_pieces"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return one.withColumn("least_containers", F.ceil(F.col("n_tokens") / capacity)).withColumn("filled", F.try_divide(F.col("n_tokens"), F.col("n_containers") * capacity))
