"""Documents cut into pieces of at most so many tokens, at natural boundaries where possible.

A text's boundaries form a hierarchy: sections, paragraphs, sentences and lines, words, and at
last characters. What is too large is split at all its boundaries of the coarsest kind that it
has; neighbouring parts are packed greedily as long as they fit, and a part that is itself too
large is split in the same way by the next finer kind. A piece then begins with the end of the
one before, as much of it as the overlap allows, from a sentence's start if it has one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataloom.llm.tokens import DEFAULT, SPACE, Counter, counter

LIMIT, OVERLAP = 1024, 128
_GAP = f"[{SPACE}]"
#: What ends just before a section, a paragraph, and a sentence or line, or in the white space there.
_SECTION = re.compile(r"[\n\r\f](?=#{1,6}[ \t]|={4,}|-{4,}|\f|diff --git|commit [0-9a-f]{7})")
_PARAGRAPH = re.compile(r"\n[ \t]*\n|\r\n?[ \t]*\r")
_SENTENCE = re.compile(rf"[.!?…:;。！？；][\"'”’»)\]]*(?={_GAP})|[\n\r]")
#: Ends of sentences and clauses in scripts that write no spaces.
_UNSPACED = re.compile(r"(?<=[。！？；，、．｡､])")
_SLICE_BYTES = 96


class Cutter:
    """Cuts texts into pieces for one tokenizer and size."""

    def __init__(self, tokens: Counter, limit: int = LIMIT, overlap: int = OVERLAP):
        if not 0 <= overlap < limit / 2:
            raise ValueError("the overlap must be less than half the limit")
        self.tokens, self.limit, self.overlap = tokens, limit, overlap

    def _stretches(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Starts, levels and token sums of the parts a text is put together from, and its own tokens.

        Level 0 begins a section, 1 a paragraph, 2 a sentence or line, 3 a word and 4 any
        character. Atoms that the overlap couldn't hold are cut further.
        """
        ends, counts = self.tokens.atoms(text)
        starts = np.concatenate([[0], ends[:-1]])
        levels = np.full(len(starts), 3, np.int8)
        for level, pattern in ((2, _SENTENCE), (1, _PARAGRAPH), (0, _SECTION)):
            at = np.fromiter(map(re.Match.end, pattern.finditer(text)), np.int64)
            found = np.searchsorted(starts, at[at < len(text)], "right") - 1
            found = found[found > 0]
            levels[found] = np.minimum(levels[found], level)
        total = int(counts.sum())
        large = np.flatnonzero(counts > min(self.overlap or self.limit, self.limit))
        if len(large):
            s, lv, c, last = [], [], [], 0
            for i in large:
                s += [starts[last:i]]
                lv += [levels[last:i]]
                c += [counts[last:i]]
                parts, sizes, kinds = self._characters(text[starts[i] : ends[i]])
                s += [starts[i] + np.array(parts)]
                kinds[0] = levels[i]
                lv += [np.array(kinds, np.int8)]
                c += [np.array(sizes, np.int64)]
                last = i + 1
            starts, levels, counts = (np.concatenate([*x, y[last:]]) for x, y in ((s, starts), (lv, levels), (c, counts)))
        return starts, levels, np.concatenate([[0], np.cumsum(counts)]), total

    def _characters(self, atom: str) -> tuple[list[int], list[int], list[int]]:
        """Starts, tokens and levels of parts of one long atom: clauses, or else runs of characters."""
        starts, sizes, levels, at = [], [], [], 0
        for clause in _UNSPACED.split(atom):
            size = len(clause.encode())
            step = len(clause) if size <= _SLICE_BYTES else max(1, _SLICE_BYTES * len(clause) // size)
            for i in range(0, len(clause), step or 1):
                starts.append(at + i)
                sizes.append(self.tokens.count(clause[i : i + step]))
                levels.append(4 if i else 2)
            at += len(clause)
        return starts, sizes, levels

    def pieces(self, text: str) -> tuple[list[tuple[int, int, int, int]], int]:
        """(start, end, tokens, tokens shared with the piece before) of each piece, and all tokens."""
        size = self.tokens.count(text)
        if size <= self.limit:
            return [(0, len(text), size, 0)], size
        starts, levels, sums, total = self._stretches(text)
        rough = bool((levels == 4).any())
        offsets = np.append(starts, len(text))
        at = [np.flatnonzero(levels <= k) for k in range(5)]
        out: list[tuple[int, int, int, int]] = []
        waiting = self._split(at, sums, 0, len(starts), 0)[::-1]
        before = (0, 0)  # what is new in the piece before
        while waiting:
            body, end = waiting.pop()
            begin = self._overlap(at[2], sums, *before) if out else body
            tokens = int(sums[end] - sums[begin])
            if rough:
                # Sums over parts of an atom are estimates of the whole's tokens.
                tokens = self.tokens.count(text[offsets[begin] : offsets[end]])
                if tokens > self.limit and begin < body:
                    begin = body
                    tokens = self.tokens.count(text[offsets[begin] : offsets[end]])
                if tokens > self.limit and end > body + 1:
                    middle = (body + end) // 2
                    waiting += [(middle, end), (body, middle)]
                    continue
            out.append((int(offsets[begin]), int(offsets[end]), tokens, int(sums[body] - sums[begin])))
            before = (body, end)
        return out, total

    def _split(self, at: list[np.ndarray], sums: np.ndarray, first: int, last: int, level: int) -> list[tuple[int, int]]:
        """Stretches of parts that together are ``first`` to ``last``, each with room for the overlap."""
        room = self.limit - self.overlap
        if sums[last] - sums[first] <= room or last - first == 1:
            return [(first, last)]
        inside = at[level][np.searchsorted(at[level], first, "right") : np.searchsorted(at[level], last, "left")]
        if not len(inside):
            return self._split(at, sums, first, last, level + 1)
        edges = np.concatenate([[first], inside, [last]])
        up_to = sums[edges]
        out: list[tuple[int, int]] = []
        k = 0
        while k < len(edges) - 1:
            fits = int(np.searchsorted(up_to, up_to[k] + room, "right")) - 1
            if fits > k:
                out.append((int(edges[k]), int(edges[fits])))
                k = fits
            else:
                out += self._split(at, sums, int(edges[k]), int(edges[k + 1]), level + 1)
                k += 1
        return out

    def _overlap(self, sentences: np.ndarray, sums: np.ndarray, body: int, end: int) -> int:
        """Where the next piece begins, before ``end`` by at most the overlap and behind the start of ``body``."""
        first = max(int(np.searchsorted(sums, sums[end] - self.overlap, "left")), body + 1)
        if first >= end:
            return end
        i = int(np.searchsorted(sentences, first, "left"))
        return int(sentences[i]) if i < len(sentences) and sentences[i] < end else first


_SCHEMA = "doc_id long, piece_no int, n_pieces int, start long, end long, n_tokens long, overlap_tokens long, doc_tokens long"


def cut_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = DEFAULT, texts: bool = True) -> DataFrame:
    """The pieces of every document, numbered from 0 in their order.

    ``start`` and ``end`` are character offsets into the text; each piece has at most ``limit``
    tokens, of which the first ``overlap_tokens`` belong to the piece before as well. Without
    overlaps the pieces are the whole text. A document of at most ``limit`` tokens is one piece;
    a null or empty text is one piece of 0 tokens, null or empty itself. ``texts`` false leaves
    the pieces' text out.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), *((x, pa.int64()) for x in ("start", "end", "n_tokens", "overlap_tokens", "doc_tokens")), *([("text", pa.string())] if texts else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(counter(vocabulary), limit, overlap)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for i in range(batch.num_rows):
                doc_id, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                found, total = cutter.pieces(text or "")
                for k, (a, b, tokens, shared) in enumerate(found):
                    rows.append((doc_id, k, len(found), a, b, tokens, shared, total, *([None if text is None else text[a:b]] if texts else [])))
                held += len(text or "")
                if held > 4_000_000:
                    yield _batch(rows, arrow)
                    rows, held = [], 0
            yield _batch(rows, arrow)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA + (", text string" if texts else ""))


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def oversized(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id of each document that was cut, once."""
    return cut_documents(documents, limit, texts=False).where((F.col("piece_no") == 0) & (F.col("n_pieces") > 1)).select("doc_id").distinct()
