"""Documents packed into containers of fixed capacity.

Each document is a vector of tokens, segments (1) and loss-bearing tokens, and a container
limits all three. The turns of a conversation that ask, and a title in front, bear no loss.
Documents are spread over blocks of bounded size by a hash, and each block is packed by the dot-product heuristic: into the open container goes the item, among those that
fit, whose demand has the largest dot product with what room is left. Containers that a block
leaves loose are opened again and their items packed in a second round over far fewer blocks,
so that what is lost at blocks' ends doesn't grow with their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataloom.llm.tokens import DEFAULT, Counter, counter
from strataloom.runtime import cut

CAPACITY, SEGMENTS = 2048, 64
#: Items of one block, and the fill below which a container is packed again.
BLOCK_ITEMS, LOOSE = 20_000, 0.995
_ITEM = "doc_id long, part int, n_tokens long, loss_tokens long"
_PLACED = _ITEM + ", container string, used long, segments long, loss long"
_PLACED_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int64()), ("loss_tokens", pa.int64()), ("container", pa.string()), ("used", pa.int64()), ("segments", pa.int64()), ("loss", pa.int64())])


#: A turn of a conversation: a label and a colon that begin a line, after the white space before it.
_TURN = re.compile(r"(?:\A|\n)\s*@?[^\W\d_][^\W_]{0,19}:[ \t]")


def prompts(text: str, title: str | None) -> list[tuple[int, int]]:
    """The stretches of ``text`` that ask and bear no loss: turns that end with a question mark,
    and a title that the text begins with."""
    found: list[tuple[int, int]] = []
    if ":" in text and ("?" in text or "？" in text):
        starts = [m.start() for m in _TURN.finditer(text)]
        for a, b in zip(starts, [*starts[1:], len(text)]):
            # White space before a turn is the turn's, as the tokenizer cuts there.
            a = len(text[:a].rstrip()) if a else 0
            b = len(text[:b].rstrip()) if b < len(text) else b
            if text[a:b].rstrip().endswith(("?", "？")):
                found.append((a, b))
    first = (title or "").strip()
    if first:
        at = len(text) - len(text.lstrip("\ufeff# \t\r\n"))
        end = at + len(first)
        if text.startswith(first, at) and (end == len(text) or text[end].isspace()) and not (found and found[0][0] < end):
            found.insert(0, (0, end))
    return found


def parts_of(text: str | None, title: str | None, count: Counter, capacity: int, loss_capacity: int) -> list[tuple[int, int]]:
    """Tokens and loss-bearing tokens of each part of one document, mostly one.

    Parts are cut by tokens: at ``capacity`` if the document has more, or at the loss capacity
    if it has more loss-bearing tokens than that.
    """
    total = count.count(text)
    spans: list[tuple[int, int]] = []
    at = place = 0
    for a, b in prompts(text, title) if text else ():
        at += count.count(text[place:a])
        size = count.count(text[a:b])
        spans.append((at, at + size))
        at, place = at + size, b
    asked = sum(b - a for a, b in spans)
    step = capacity if total - asked <= loss_capacity else min(capacity, loss_capacity)
    if total <= step:
        return [(total, total - asked)]
    out = []
    for start in range(0, total, step):
        end = min(start + step, total)
        out.append((end - start, end - start - sum(max(0, min(b, end) - max(a, start)) for a, b in spans)))
    return out


_SIZED = "doc_id long, part int, n_tokens long, loss_tokens long"


def sized_parts(documents: DataFrame, capacity: int, loss_capacity: int, vocabulary: str = DEFAULT) -> DataFrame:
    """doc_id, part, n_tokens and loss_tokens of all parts of all documents."""
    arrow = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int64()), ("loss_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            rows = []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                text, title = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                rows += [(doc_id, k, *sizes) for k, sizes in enumerate(parts_of(text, title, count, capacity, loss_capacity))]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    title = F.col("title").cast("string") if "title" in documents.columns else F.lit(None).cast("string")
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), title.alias("title")).mapInArrow(run, _SIZED)


def pack_block(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """Container number of each item of one block.

    Items of one shape (tokens and loss) are alike, so the heuristic weighs shapes. Demands and
    room are measured in the container's limits; ties go to the larger shape.
    """
    capacity, most, most_loss = limits
    where = np.zeros(len(tokens), np.int64)
    if not len(tokens):
        return where
    shapes, of, left = np.unique(np.stack([tokens, loss], axis=1), axis=0, return_inverse=True, return_counts=True)
    shapes, of, left = shapes[::-1], len(shapes) - 1 - of.ravel(), left[::-1].copy()
    order = np.argsort(of, kind="stable")
    first = np.concatenate([[0], np.cumsum(left)])
    taken = np.zeros(len(shapes), np.int64)
    demand = np.stack([shapes[:, 0] / capacity, np.full(len(shapes), 1 / most), shapes[:, 1] / most_loss], axis=1)
    number, remaining = 0, len(tokens)
    while remaining:
        room, slots, room_loss = capacity, most, most_loss
        while remaining and slots:
            fits = (left > 0) & (shapes[:, 0] <= room) & (shapes[:, 1] <= room_loss)
            if not fits.any():
                break
            score = demand @ np.array([room / capacity, slots / most, room_loss / most_loss])
            k = int(np.argmax(np.where(fits, score, -1.0)))
            where[order[first[k] + taken[k]]] = number
            taken[k] += 1
            left[k] -= 1
            remaining -= 1
            room -= int(shapes[k, 0])
            room_loss -= int(shapes[k, 1])
            slots -= 1
            if room == 0 and remaining:
                # A full container still takes items without tokens, which cost it only slots.
                if not left[(shapes[:, 0] == 0)].any():
                    break
        number += 1
    return where


def _packed(items: DataFrame, round_no: int, blocks: int, limits: tuple[int, int, int]) -> DataFrame:
    """Items with their containers, a block of them packed at a time."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("part", "ascending")])
        tokens, loss = (table.column(c).to_numpy() for c in ("n_tokens", "loss_tokens"))
        where = pack_block(tokens, loss, limits)
        sums = [np.bincount(where, weights=w, minlength=where.max() + 1).astype(np.int64)[where] for w in (tokens, np.ones(len(where)), loss)]
        names = [f"{round_no}-{block}-{k}" for k in where.tolist()]
        return pa.Table.from_arrays([*(table.column(i) for i in ("doc_id", "part", "n_tokens", "loss_tokens")), pa.array(names), *(pa.array(s) for s in sums)], schema=_PLACED_ARROW)

    block = F.pmod(F.xxhash64("doc_id", "part", F.lit(round_no)), F.lit(blocks))
    # Items have few bytes, so partitions are made by number of blocks and not left to be merged by size.
    spread = items.withColumn("block", block).repartition(blocks, "block")
    return spread.groupBy("block").applyInArrow(run, _PLACED)


def containers(documents: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_capacity: int | None = None, vocabulary: str = DEFAULT) -> DataFrame:
    """Every document's containers: doc_id, part, n_tokens, loss_tokens and container, with the
    container's used tokens, segments and loss-bearing tokens.

    A document of more than ``capacity`` tokens fills containers of its own with its first
    parts, and its rest (part numbers follow the text) is packed like any document; no other
    document is split. By default the limit on loss-bearing tokens is the capacity, as a document
    of that many has to stay whole; with a lesser ``loss_capacity`` documents that exceed it are
    split by it. A null or empty text takes a segment and no tokens. A title that begins its
    document bears no loss, nor do turns that ask. Repeated doc_ids are items of their own. An
    empty table gives an empty result.
    """
    limits = (capacity, segments, loss_capacity or capacity)
    items = cut(sized_parts(documents, capacity, limits[2], vocabulary))
    whole = items.where(F.col("n_tokens") == capacity)
    own = whole.select("*", F.concat_ws("-", F.lit("0"), "doc_id", "part").alias("container"), F.col("n_tokens").alias("used"), F.lit(1).cast("long").alias("segments"), F.col("loss_tokens").alias("loss"))
    rest = items.where(F.col("n_tokens") < capacity)
    first = cut(_packed(rest, 1, max(1, -(-rest.count() // BLOCK_ITEMS)), limits))
    loose = first.where(F.col("used") < LOOSE * capacity)
    again = max(1, -(-loose.count() // BLOCK_ITEMS))
    second = _packed(loose.select("doc_id", "part", "n_tokens", "loss_tokens"), 2, again, limits)
    return own.unionByName(first.where(F.col("used") >= LOOSE * capacity)).unionByName(second)


def fills(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Fill of each container: used tokens, segments, loss-bearing tokens and share of capacity."""
    seen = placed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss_tokens"))
    return seen.withColumn("fill", F.col("used") / capacity)
