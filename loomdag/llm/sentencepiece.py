"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives one Viterbi pass.

The automaton holds all pieces. A text is read once, letter by letter; at each place the
state's own piece and those on its output links are exactly the pieces that end there,
and each relaxes the best score of the place. A letter that no piece covers costs
``UNKNOWN`` below the worst score and becomes its bytes (byte fallback), or the unknown
id where the model has no byte pieces. The result is the segmentation of the highest
total score (the unigram rule), for any model file of the library.

Pieces that hold a space mark after another letter don't occur in a model that splits at
white space; where that is so, a text is cut before each first mark of a run, which no
piece can cross, and equal parts are encoded once per worker.

Defined results: a null or empty text has no ids; ties go to the longer last piece;
control ids are skipped in decoding; invalid byte runs decode to the replacement sign;
an empty table gives no rows; repeated rows repeat their result; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomdag.llm.common import worker_memory

MARK = "▁"
#: The kinds of pieces in a model file.
NORMAL, UNKNOWN_KIND, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN = 10.0
REMEMBERED = 300_000
#: Rows that are worked on at a time.
SLICE = 1024
#: Longer parts are not remembered.
LONGEST = 64


class Automaton:
    """Aho-Corasick over strings: goto per state, failure and output links."""

    def __init__(self, pieces: dict[str, tuple[int, float]]) -> None:
        self.goto: list[dict[str, int]] = [{}]
        self.own: list[tuple[int, int, float] | None] = [None]
        for piece, (number, score) in pieces.items():
            state = 0
            for letter in piece:
                nxt = self.goto[state].get(letter)
                if nxt is None:
                    nxt = self.goto[state][letter] = len(self.goto)
                    self.goto.append({})
                    self.own.append(None)
                state = nxt
            self.own[state] = (len(piece), number, score)
        self.fail = [0] * len(self.goto)
        self.out: list[tuple[tuple[int, int, float], ...]] = [()] * len(self.goto)
        queue = list(self.goto[0].values())
        for state in queue:  # breadth first: links point to shorter states, done before
            link = self.fail[state]
            self.out[state] = ((self.own[state],) if self.own[state] else ()) + self.out[link]
            for letter, nxt in self.goto[state].items():
                back = link
                while back and letter not in self.goto[back]:
                    back = self.fail[back]
                self.fail[nxt] = self.goto[back].get(letter, 0) if state else 0
                queue.append(nxt)


class Model:
    """A model file's pieces, its encoder and its decoder."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        self.pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models without text normalisation are read")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        whole = {p: (i, s) for i, (p, s, t) in enumerate(self.pieces) if t in (NORMAL, USER)}
        self.automaton = Automaton(whole)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN_KIND), 0)
        self.penalty = min((s for _, s in whole.values()), default=0.0) - UNKNOWN
        self.cut = all(MARK not in p.lstrip(MARK) for p in whole)
        self.known: dict[str, list[int]] = {}
        # units (words with one space before each) that were encoded, as places in one pool
        self.units: dict[str, int] = {}
        self.pool = np.zeros(0, dtype=np.int32)
        self.starts = self.lens = np.zeros(0, dtype=np.int64)
        shown = [self._shown(i) for i in range(len(self.pieces))]
        self.letters = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.widths = np.array([len(x) for x in shown], dtype=np.int64)
        self.places = np.cumsum(self.widths) - self.widths

    def _shown(self, i: int) -> bytes:
        piece, _, kind = self.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN_KIND:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

    def viterbi(self, text: str) -> list[int]:
        goto, fail, out = self.automaton.goto, self.automaton.fail, self.automaton.out
        best, came = [0.0] * (len(text) + 1), [(-1, 0)] * (len(text) + 1)
        state = 0
        for end, letter in enumerate(text, 1):
            while state and letter not in goto[state]:
                state = fail[state]
            state = goto[state].get(letter, 0)
            top, how, single = float("-inf"), (0, 0), False
            for width, number, score in out[state]:
                here = best[end - width] + score
                single |= width == 1
                if here > top:
                    top, how = here, (width, number)
            if not single:
                here = best[end - 1] + self.penalty
                if here > top:
                    top, how = here, (1, -1)
            best[end], came[end] = top, how
        ids: list[int] = []
        end = len(text)
        while end:
            width, number = came[end]
            if number >= 0:
                ids.append(number)
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(text[end - 1].encode())]
            else:
                ids.append(self.unknown)
            end -= width
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = (" " + text if self.prefix else text).replace(" ", MARK)
        if not self.cut:
            return self.viterbi(marked)
        ids: list[int] = []
        for part in PARTS.findall(marked):
            found = self.known.get(part)
            if found is None:
                found = self.viterbi(part)
                if len(part) <= LONGEST and len(self.known) < REMEMBERED:  # the first to come are the frequent ones
                    self.known[part] = found
            ids += found
        return ids

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        """Ids of every text. A text whose spaces stand alone is looked up unit by unit;
        others, and all where pieces may cross a space, are encoded one by one."""
        texts = pc.fill_null(texts, "")
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets -= offsets[0]
        units, at = flat.dictionary.to_pylist(), flat.indices.to_numpy()
        place = np.fromiter(map(self.units.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        new = np.flatnonzero(place < 0)
        # short units come first: only they are remembered, so that memory is bounded in bytes too
        short = np.array([len(units[i]) <= LONGEST for i in new.tolist()], dtype=bool)
        new, kept = np.concatenate([new[short], new[~short]]), int(short.sum())
        fresh = [self.viterbi(MARK + units[i]) for i in new.tolist()]
        base, stay = len(self.lens), len(self.pool)
        lens = np.array([len(x) for x in fresh], dtype=np.int64)
        place[new] = base + np.arange(len(new))
        alone = np.array([self.cut and self.prefix and bool(u) and MARK not in u for u in units] or [True])
        odd = np.flatnonzero(~np.minimum.reduceat(alone[at], offsets[:-1])) if len(texts) else np.zeros(0, dtype=np.int64)
        whole = [self.encode(texts[int(k)].as_py()) for k in odd]
        pool = np.concatenate([self.pool, np.array([i for x in (*fresh, *whole) for i in x], dtype=np.int32)])
        lens = np.concatenate([self.lens, lens, np.array([len(x) for x in whole], dtype=np.int64)])
        starts = np.concatenate([self.starts, stay + np.cumsum(lens[base:]) - lens[base:]])
        where = place[at]
        size = lens[where]
        for n, k in enumerate(odd.tolist()):
            size[offsets[k] : offsets[k + 1]] = 0
            where[offsets[k]] = len(lens) - len(odd) + n
            size[offsets[k]] = len(whole[n])
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.repeat(starts[where] - (ends - size), size) + np.arange(total)]
        cuts = np.concatenate([[0], ends])[offsets].astype(np.int32)
        if len(self.units) < REMEMBERED:  # the first to come are the frequent ones
            keep = base + kept
            self.units.update(zip([units[i] for i in new[:kept].tolist()], range(base, keep)))
            self.pool, self.starts, self.lens = pool[: stay + int(lens[base:keep].sum())].copy(), starts[:keep].copy(), lens[:keep].copy()
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids, pa.int32()))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(self._shown(i) for i in ids).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def decode_all(self, rows: pa.ListArray) -> pa.Array:
        """The texts of all rows, by one gather of the pieces' letters."""
        rows = pc.fill_null(rows, [])
        offsets = rows.offsets.to_numpy().astype(np.int64)
        ids = rows.values.to_numpy()[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        size = self.widths[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        letters = self.letters[np.repeat(self.places[ids] - (ends - size), size) + np.arange(total)]
        cuts = np.concatenate([[0], ends])[offsets].astype(np.int32)
        raw = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(letters))])
        try:
            text = raw.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no text
            text = pa.array([x.decode(errors="replace") for x in raw.to_pylist()], pa.string())
        if not self.prefix:
            return text
        return pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)


PARTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ids (array of int) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_memory(f"pieces {model}", lambda: Model(model))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), coder.encode_all(part.column(1))], names=[key, "ids"])

    rows = docs.select(F.col(key), F.col(text))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the column ``out``: the text of ``ids``; null ids give an empty text. A
    column of that name gives way."""
    rows = rows.drop(out)
    at = rows.columns.index(ids)
    names = [*rows.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_memory(f"pieces {model}", lambda: Model(model))
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns, coder.decode_all(part.column(at))], names=names)

    return rows.mapInArrow(run, StructType(list(rows.schema)).add(out, "string"))
