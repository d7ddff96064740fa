"""Token ids of whole texts, by a public tokenizer file, with a cache of words.

The byte-level BPE splits before a single space between two visible characters, so a
text's ids are the ids of its space-separated units, each with the space before it.
Equal units have equal ids: a worker encodes each unit once and looks it up from then
on. A text with other white space next to a space is encoded as a whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdag.llm.common import worker_memory

#: About as many units as a worker remembers.
REMEMBERED = 400_000
#: Bytes of text that are worked on at a time, unless one text has more.
SLICE = 4_000_000
#: Longer units (in letters) are encoded anew each time.
LONGEST = 64
#: Units that are encoded as one text.
JOINED = 4096
END = 0
#: Fixed value: how the vocabulary writes a space.
SPACE = "Ġ"


class UnitEncoder:
    """Encodes texts to one flat array of ids, each text's ids followed by ``END``."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for piece, number in self.tokenizer.get_vocab().items():
            self.spaced[number] = piece.startswith(SPACE)
        self.known: dict[str, int] = {}
        self.pool = np.array([END], dtype=np.uint32)
        self.starts = np.zeros(1, dtype=np.int64)
        self.lens = np.ones(1, dtype=np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``units``, each with a space before it, and how many each has.

        They are encoded as one text: every unit begins with a token that begins with a
        space, and no other token does.
        """
        flat, counts = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(units), JOINED):
            some = units[at : at + JOINED]
            ids = np.array(self._encode([" " + " ".join(some)])[0], dtype=np.uint32)
            first = np.flatnonzero(self.spaced[ids])
            if len(first) != len(some):  # a special token has taken a space
                each = self._encode([f" {u}" for u in some])
                ids = np.array([i for e in each for i in e], dtype=np.uint32)
                counts.append(np.array([len(e) for e in each], dtype=np.int64))
            else:
                counts.append(np.diff(np.append(first, len(ids))))
            flat.append(ids)
        return np.concatenate(flat), np.concatenate(counts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and how many of them belong to each text (its ``END`` included)."""
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets -= offsets[0]
        units = flat.dictionary.to_pylist()
        lookup = np.fromiter(map(self.known.get, units, repeat(-2)), dtype=np.int64, count=len(units))
        missing = np.flatnonzero(lookup == -2)
        visible = [i for i in missing.tolist() if (u := units[i]) and not u[0].isspace() and not u[-1].isspace()]
        lookup[missing] = -1
        # short units come first: only they are remembered, so that memory is bounded in bytes too
        visible.sort(key=lambda i: len(units[i]) > LONGEST)
        kept = sum(len(units[i]) <= LONGEST for i in visible)
        ids, counts = self._units([units[i] for i in visible])
        base, stay = len(self.lens), len(self.pool)
        pool, starts, lens = self.pool, self.starts, self.lens
        lookup[visible] = base + np.arange(len(visible))
        more = [(ids, counts)]
        at = np.insert(lookup[flat.indices.to_numpy()], offsets[1:], 0)
        begin, end = offsets[:-1] + np.arange(len(texts)), offsets[1:] + np.arange(len(texts))
        # the first unit of a text has no space before it
        heads = parts.values.take(pa.array(parts.offsets.to_numpy()[:-1])).to_pylist()
        each = self._encode(heads)
        more.append((np.array([i for e in each for i in e], dtype=np.uint32), np.array([len(e) for e in each], dtype=np.int64)))
        first = base + len(counts) + np.arange(len(texts))
        at[begin] = np.where([h[-1:].isspace() for h in heads], -1, first)
        # other white space next to a space: such a text is encoded as a whole
        odd = np.flatnonzero(np.add.reduceat(at == -1, begin) > 0)
        if len(odd):
            each = self._encode([texts[int(k)].as_py() for k in odd])
            more.append((np.array([i for e in each for i in e], dtype=np.uint32), np.array([len(e) for e in each], dtype=np.int64)))
        new_ids, new_lens = np.concatenate([m[0] for m in more]), np.concatenate([m[1] for m in more])
        pool, lens = np.concatenate([pool, new_ids]), np.concatenate([lens, new_lens])
        starts = np.concatenate([starts, stay + np.cumsum(new_lens) - new_lens])
        size = lens[at]
        for n, k in enumerate(odd.tolist()):
            size[begin[k] : end[k]] = 0
            at[begin[k]] = len(lens) - len(odd) + n
            size[begin[k]] = lens[at[begin[k]]]
        ends = np.cumsum(size)
        where = np.repeat(starts[at] - (ends - size), size) + np.arange(int(ends[-1]))
        out, sizes = pool[where], np.add.reduceat(size, begin)
        if len(self.known) < REMEMBERED:  # the first to come are the frequent ones
            self.known.update(zip([units[i] for i in visible[:kept]], range(base, base + kept)))
            self.known.update((units[i], -1) for i in missing.tolist() if lookup[i] == -1 and len(units[i]) <= LONGEST)
            keep = base + kept
            self.pool, self.starts, self.lens = pool[: stay + int(counts[:kept].sum())].copy(), starts[:keep].copy(), lens[:keep].copy()
        return out, sizes


def token_pieces(docs: DataFrame, tokenizer: str, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of at most ``most`` ids: ``key``, start, length, ids, doc_tokens.

    ``ids`` is binary, little-endian unsigned 32-bit. Every text ends with id 0, so an
    empty or null one gives one piece of one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_memory(f"units {tokenizer}", lambda: UnitEncoder(tokenizer))
        for batch in batches:
            texts = batch.column(1)
            upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
            lo = 0
            while lo < len(texts):
                before = upto[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(upto, before + SLICE, side="right")))
                flat, sizes = coder.encode(texts.slice(lo, hi - lo))
                pieces = -(-sizes // most)
                owner = np.repeat(np.arange(len(sizes)), pieces)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * most
                length = np.minimum(most, sizes[owner] - start)
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
                ids = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype("<u4"))])
                keys = batch.column(0).slice(lo, hi - lo).take(pa.array(owner))
                columns = [keys, pa.array(start), pa.array(length), ids, pa.array(sizes[owner])]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "length", "ids", "doc_tokens"])
                lo = hi

    rows = docs.select(F.col(key), F.col(text))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long")
