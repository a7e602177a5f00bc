"""Token counts with a public tokenizer's vocabulary file.

The tokenizer first cuts a text into pieces with a pattern and then merges inside the pieces. A
piece never crosses the place where white space follows a visible character, so a text can be
cut there into atoms (leading white space and the word after it) whose counts add up exactly.
Atoms repeat, so their counts are kept in a bounded memo.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Name of the vocabulary in the installed package of public tokenizers, or a path to a rank file.
DEFAULT = "byte_bpe_50k.tiktoken"
#: White space as the tokenizers' pattern has it; Python's own class differs in four characters.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ATOM = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_ODD = re.compile(f"[{SPACE}] |[{SPACE}]\\Z")
_MEMO_SIZE, _MEMO_KEY = 400_000, 48


class Counter:
    """Counts tokens; special strings count as ordinary text."""

    def __init__(self, vocabulary: str = DEFAULT):
        import public_tokenizers
        import tiktoken

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._ranks = ranks
        self._memo = _Memo(self._measure)

    def _measure(self, atom: str) -> int:
        return 1 if atom.isalpha() and atom.encode() in self._ranks else len(self.encoding.encode_ordinary(atom))

    def count(self, text: str | None) -> int:
        """Tokens of ``text``; 0 if null."""
        if not text:
            return 0
        memo = self._memo.at
        if _ODD.search(text):
            return sum(map(memo, _ATOM.findall(text)))
        first, *rest = text.split(" ")
        return memo(first) + sum(map(self._memo.spaced, rest))

    @staticmethod
    def cut(text: str) -> list[str]:
        return _ATOM.findall(text)

    def atoms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the atoms of ``text`` as character offsets, and their token counts."""
        found = self.cut(text)
        return np.cumsum(np.fromiter(map(len, found), np.int64, len(found))), np.fromiter(map(self._memo.at, found), np.int64, len(found))


class _Memo:
    def __init__(self, measure):
        self.measure = measure
        own, after_space = _Kept(measure, ""), _Kept(measure, " ")
        self.at, self.spaced = own.__getitem__, after_space.__getitem__


class _Kept(dict):
    """Counts by atom; emptied when full, so that its size is bounded."""

    def __init__(self, measure, before: str):
        super().__init__()
        self.measure, self.before = measure, before

    def __missing__(self, atom: str) -> int:
        n = self.measure(self.before + atom) if self.before or atom else 0
        if len(atom) <= _MEMO_KEY:
            if len(self) >= _MEMO_SIZE:
                self.clear()
            self[atom] = n
        return n


@lru_cache(maxsize=4)
def counter(vocabulary: str = DEFAULT) -> Counter:
    """This process's counter for ``vocabulary``."""
    return Counter(vocabulary)


def token_table(documents, columns: list[str], vocabulary: str = DEFAULT, prompt: str | None = None):
    """``columns`` of ``documents`` with n_tokens of ``text`` (0 if null), whole texts.

    With ``prompt`` naming a column, prompt_tokens counts that column's text where the document
    begins with it as its first line, else 0.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_type

    picked = documents.select(*columns, F.col("text").cast("string").alias("__text"), *([F.col(prompt).cast("string").alias("__prompt")] if prompt else []))
    kept = picked.schema.fields[: len(columns)]
    arrow = pa.schema([*(pa.field(f.name, to_arrow_type(f.dataType)) for f in kept), pa.field("n_tokens", pa.int64()), *([pa.field("prompt_tokens", pa.int64())] if prompt else [])])

    def run(batches):
        count = counter(vocabulary).count
        at = len(columns)
        for batch in batches:
            sizes, prompts = [], []
            for i in range(batch.num_rows):
                text = batch.column(at)[i].as_py()
                sizes.append(count(text))
                if prompt:
                    first = (batch.column(at + 1)[i].as_py() or "").strip()
                    begins = bool(first) and text is not None and text.lstrip("﻿# \t\r\n").startswith(first)
                    prompts.append(min(count(first), sizes[-1]) if begins else 0)
            made = [pa.array(sizes, pa.int64()), *([pa.array(prompts, pa.int64())] if prompt else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(arrow.field(i).type) for i in range(at)), *made], schema=arrow)

    plain = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return picked.mapInArrow(run, plain + "n_tokens long" + (", prompt_tokens long" if prompt else ""))
