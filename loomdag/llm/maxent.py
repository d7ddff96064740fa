"""A hashed maximum-entropy language model with a class-factored softmax.

p(word | history) = p(group | history) * p(class | group, history) * p(cell | class,
history) * p(word | cell). The three softmaxes have ``WIDTH`` outcomes each and four hashed
features of the history: the word before, the pair before, the word two back (a skip), and
the endings of the two words before. A feature's hash picks a row of ``WIDTH`` weights;
the second and third softmax hash the group or class into it too, so that each of them has
features of its own. Inside its cell a word has its add-one share of the counts.

Classes. The ``SINGLES`` most frequent words and the end have one of the WIDTH * WIDTH
classes each and no cells. Every other word, seen or not, falls into a class by its last
``ENDING`` bytes and into a cell by its own hash, so no word list is needed to place a
word; a cell counts one word more than it has seen, for all unseen.

Growth. Every word of every training text is counted, by a 64-bit hash of its bytes. Each
softmax has a row of weights for every ``WORDS_PER_ROW`` distinct words, rounded up to a
power of two, at least ``LEAST_ROWS`` and at most ``MOST_ROWS``; the last is what bounds
the broadcast: 3 * MOST_ROWS * WIDTH halves, 96 MB. The ``FREQUENT`` most frequent words
are the only other thing that is broadcast.

Training. ``ROUNDS`` rounds; a round takes its own part of the training texts. Each task
starts from the round's weights, makes Adagrad steps over mini-batches of its texts and
emits its changes, in blocks of rows with the steps that each row has seen; changes are
averaged over the tasks by a shuffle, by those.

Scoring adds log10(count + 1) over a text's tokens: for frequent words in the task that
reads the text; for all others by a join on the word's hash, whose keys are rare by choice,
in training and held-out texts alike.

Defined results: a null or empty text is the end token alone; a null key has the text
'' for its fold; ties in frequency fall to the smaller hash; without training texts every
count is 0; an empty table gives no rows; rows that repeat are trained on and scored
each; texts are read whole, in stretches of bounded size; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdag.llm.common import write_table

FOLDS, HELD = 7, 2
#: The end token is counted under this hash, which no word has; 0 marks an empty place.
END = 1
FREQUENT = 1 << 17
#: Outcomes of a softmax.
WIDTH = 16
CLASSES = WIDTH * WIDTH
SINGLES = 127
ENDING = 3
WORDS_PER_ROW = 64
LEAST_ROWS, MOST_ROWS = 1 << 14, 1 << 20
ROUNDS = 2
BATCH = 16384
RATE = 0.1
#: Logits are held inside these bounds.
STEEPEST = 30.0
#: Rows of weights that travel together.
PACKED = 64
#: Counts that a task holds before it passes them on, and bytes of text that it splits at a time.
REMEMBERED = 1_000_000
SLICE = 2_000_000

# -- words --------------------------------------------------------------------

BLOCK = 1 << 16
#: A word's hash is the sum of a random number a letter times STEP to the letter's place, mixed.
STEP, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BACK = pow(STEP, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.random.default_rng(42).integers(0, 2**64, 256, dtype=np.uint64)[_LOWER]
_BARE = np.ones(256, dtype=bool)
_BARE[[0x20, *range(0x09, 0x0E)]] = False


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(BLOCK - 1, base, dtype=np.uint64)], dtype=np.uint64)


_UP, _DOWN = _powers(STEP), _powers(_BACK)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
    x ^= x >> np.uint64(29)
    return np.where(x <= END, x + np.uint64(2), x)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending (0 to CLASSES - SINGLES - 2) of every word of ``texts``, and words per text.

    A-Z are lowered; words are what stands between ASCII white space. One pass over the
    bytes: running sums up to each word's ends give its hash, whatever its length.
    """
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, letters = texts.buffers()
    offsets = np.frombuffer(places, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(letters or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    bare = _BARE[data]
    first, last = bare.copy(), bare.copy()
    if len(data):
        gap = ~bare
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        first[1:] &= gap[:-1] | edge[1:-1]
        last[:-1] &= gap[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    low, high, shift = (np.empty(len(starts), dtype=np.uint64) for _ in range(3))
    passed, up, down = 0, 1, 1
    for lo in range(0, len(data), BLOCK):
        part = data[lo : lo + BLOCK]
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_LETTER[part] * _UP[: len(part)], out=sums[1:])
        sums *= np.uint64(up)
        sums += np.uint64(passed)
        a, b = np.searchsorted(starts, [lo, lo + len(part)])
        at = starts[a:b] - lo
        low[a:b], shift[a:b] = sums[at], _DOWN[at] * np.uint64(down)
        a, b = np.searchsorted(ends, [lo, lo + len(part)], side="right")
        high[a:b] = sums[ends[a:b] - lo]
        passed, up, down = int(sums[-1]), up * pow(STEP, BLOCK, 2**64) % 2**64, down * pow(_BACK, BLOCK, 2**64) % 2**64
    length = ends - starts
    tail = np.zeros(len(starts), dtype=np.uint32)
    for k in range(ENDING):
        letter = _LOWER[data[np.maximum(ends - 1 - k, 0)]] if len(data) else tail
        tail |= np.where(length > k, letter.astype(np.uint32) << np.uint32(8 * k), np.uint32(0))
    tail = (tail * np.uint32(0x9E3779B1) >> np.uint32(12)) % np.uint32(CLASSES - SINGLES - 1)
    return _mixed((high - low) * shift), tail.astype(np.uint8), np.diff(np.searchsorted(starts, offsets))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``split_words`` with the end of every text as a token (of ending 0)."""
    hashes, tails, sizes = split_words(texts)
    ends = np.cumsum(sizes)
    return np.insert(hashes, ends, np.uint64(END)), np.insert(tails, ends, 0), sizes + 1


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of about ``SLICE`` bytes; a longer text is one of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE, side="right")))
        yield lo, hi
        lo = hi


class Lookup:
    """Places of hashes in a fixed list of them, by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.place = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.int64)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            mine = self.keys[at] == keys[left]
            self.place[at[mine]] = left[mine]
            left, at = left[~mine], (at[~mine] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(STEP)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of ``keys``, -1 for those that are not in the list."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left, at = np.arange(len(keys)), self._home(keys)
        own = keys
        while len(left):
            met = self.keys[at]
            same = met == own
            out[left[same]] = self.place[at[same]]
            on = ~same & (met != 0)
            left, own, at = left[on], own[on], (at[on] + 1) & self.mask
        return out


# -- the model ----------------------------------------------------------------


def features(hashes: np.ndarray, tails: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the four features of each token's history; a text starts from none."""
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    one = np.where(place >= 1, np.roll(hashes, 1), np.uint64(0))
    two = np.where(place >= 2, np.roll(hashes, 2), np.uint64(0))
    near = np.where(place >= 1, np.roll(tails, 1), 254).astype(np.uint64)
    far = np.where(place >= 2, np.roll(tails, 2), 254).astype(np.uint64)
    both = one * np.uint64(0xC2B2AE3D27D4EB4F) ^ (two >> np.uint64(1))
    return np.stack([one, both, two, near << np.uint64(8) | far])


def rows_of(found: np.ndarray, rows: int, salt: np.ndarray | int) -> np.ndarray:
    """The row of weights of each feature; ``salt`` tells the softmaxes apart. Features come first."""
    own = np.arange(found.shape[0], dtype=np.uint64)[:, None] * np.uint64(0xA0761D6478BD642F)
    return (((found ^ (np.asarray(salt, dtype=np.uint64) * np.uint64(MIX) + own)) * np.uint64(STEP)) >> np.uint64(64 - (rows.bit_length() - 1))).astype(np.int64)


class Softmax:
    """One factor: ``weights`` by row, a bias by ``group``; ``heat`` counts the steps of each weight."""

    #: Upper triangle: what is summed up to each outcome.
    UPTO = np.triu(np.ones((WIDTH, WIDTH), dtype=np.float32))

    def __init__(self, weights: np.ndarray, bias: np.ndarray) -> None:
        self.weights, self.bias = weights, bias
        self.heat = np.zeros_like(weights)
        self.met = np.empty((BATCH, WIDTH), dtype=np.float32)
        self.random = np.random.default_rng(len(weights))

    def _shares(self, rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and running sums of their exponentials over the outcomes."""
        logits, met = self.bias[group], self.met[: rows.shape[1]]
        for k in rows:
            logits += np.take(self.weights, k, axis=0, out=met, mode="clip")
        np.clip(logits, -STEEPEST, STEEPEST, out=logits)
        return logits, np.exp(logits, out=met) @ self.UPTO

    def logs(self, rows: np.ndarray, group: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The natural logarithm of each target's probability."""
        logits, upto = self._shares(rows, group)
        return logits[np.arange(len(target)), target] - np.log(upto[:, -1])

    def step(self, rows: np.ndarray, group: np.ndarray, target: np.ndarray) -> None:
        """One Adagrad step over a mini-batch: up for what came, down for what the model expects.

        The expectation is estimated by one draw from the model's own distribution a
        token, which makes the step as long as the token has features, not outcomes.
        """
        _, upto = self._shares(rows, group)
        drawn = (upto >= (upto[:, -1] * self.random.random(len(target), dtype=np.float32))[:, None]).argmax(axis=1)
        on = np.flatnonzero(drawn != target)
        sign = np.repeat(np.array([RATE, -RATE], dtype=np.float32), len(on))
        outcome = np.concatenate([target[on], drawn[on]])
        weights, heat = self.weights.reshape(-1), self.heat.reshape(-1)
        for k in rows:
            own = k[on] * WIDTH
            at = np.concatenate([own, own]) + outcome
            np.add.at(heat, at, np.float32(1))
            np.add.at(weights, at, sign / np.sqrt(heat[at] + np.float32(1)))


class Model:
    """What a task needs: the words with a class of their own, biases and weights of the three softmaxes."""

    def __init__(self, singles: np.ndarray, biases: list[np.ndarray], weights: np.ndarray) -> None:
        self.singles = Lookup(singles)
        self.rows = len(weights) // 3
        self.factors = [Softmax(w, b) for w, b in zip(weights.reshape(3, self.rows, WIDTH), biases)]

    def classed(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        own = self.singles.find(hashes)
        return np.where(hashes == END, SINGLES, np.where(own >= 0, own, tails.astype(np.int64) + SINGLES + 1))

    def _parts(self, hashes: np.ndarray, tails: np.ndarray, sizes: np.ndarray, cls: np.ndarray) -> Iterator[tuple[slice, int, np.ndarray, tuple]]:
        """For each mini-batch and softmax: the batch, which softmax, whose tokens, and its rows, group and target."""
        found, cell = features(hashes, tails, sizes), cell_of(hashes)
        for lo in range(0, len(cls), BATCH):
            part = slice(lo, lo + BATCH)
            own, seen = cls[part], found[:, part]
            every, group = np.arange(len(own)), own // WIDTH
            yield part, 0, every, (rows_of(seen, self.rows, 0), np.zeros_like(own), group)
            yield part, 1, every, (rows_of(seen, self.rows, group + 1), group, own % WIDTH)
            many = np.flatnonzero(own > SINGLES)
            if len(many):
                yield part, 2, many, (rows_of(seen[:, many], self.rows, own[many] + 1), own[many], cell[part][many])

    def learn(self, hashes: np.ndarray, tails: np.ndarray, sizes: np.ndarray) -> None:
        for _, k, _, given in self._parts(hashes, tails, sizes, self.classed(hashes, tails)):
            self.factors[k].step(*given)

    def log10s(self, hashes: np.ndarray, tails: np.ndarray, sizes: np.ndarray, cls: np.ndarray, log_mass: np.ndarray) -> np.ndarray:
        """log10 of p(class, cell | history) / mass for each token: what lacks is its count plus one."""
        out = np.where(cls > SINGLES, -log_mass[cls, cell_of(hashes)], 0.0)
        for part, k, some, given in self._parts(hashes, tails, sizes, cls):
            out[part][some] += self.factors[k].logs(*given) / np.log(10)
        return out


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(60)).astype(np.int64)


# -- over the corpus ----------------------------------------------------------


def fold(key: Column) -> Column:
    """crc32 of the key as text, by FOLDS."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _binary_rows(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def count_words(texts: DataFrame) -> DataFrame:
    """h, k, n, m: how often each word (by its hash, with its class) and the end occur in
    ``texts`` (text, held) that aren't held out, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged() -> tuple[np.ndarray, ...]:
            hashes, tails, n, m = (np.concatenate(x) for x in zip(*kept))
            coded = pa.array(hashes).dictionary_encode()
            at = coded.indices.to_numpy()
            words = coded.dictionary.to_numpy()
            kinds = np.empty(len(words), dtype=np.uint8)
            kinds[at] = tails
            return words, kinds, *(np.bincount(at, weights=x, minlength=len(words)).astype(np.int64) for x in (n, m))

        def batch_of(words: np.ndarray, kinds: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            cls = np.where(words == END, SINGLES, kinds.astype(np.int32) + SINGLES + 1).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(cls), pa.array(n), pa.array(m)], names=["h", "k", "n", "m"])

        for batch in batches:
            for lo, hi in _slices(batch.column(0)):
                hashes, tails, sizes = tokens(batch.column(0).slice(lo, hi - lo))
                learned = ~batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                kept.append((hashes, tails, np.repeat(learned.astype(np.int64), sizes), np.ones(len(hashes), dtype=np.int64)))
                size += len(hashes)
                if size > REMEMBERED:
                    kept[:] = [merged()]
                    size = len(kept[0][0])
                    if size > REMEMBERED // 2:
                        yield batch_of(*kept.pop())
                        size = 0
        if kept:
            yield batch_of(*merged())

    parts = texts.mapInArrow(run, "h long, k int, n long, m long")
    return write_table(parts.groupBy("h").agg(F.min("k").alias("k"), F.sum("n").alias("n"), F.sum("m").alias("m")), "lm-counts")


def _most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and training counts of at most ``most`` words, those that training and held-out
    texts have most, by a threshold from a histogram of counts.

    Counts are binned exactly up to 4096 and by thousandths of their logarithm above;
    the histogram's size doesn't depend on the data.
    """
    level = F.when(F.col("m") <= 4096, F.col("m")).otherwise(F.floor(F.log("m") * 1000).cast("long"))
    bins = counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("words"), F.min("m").alias("least")).collect()
    taken, least = 0, None
    for r in sorted(bins, key=lambda r: -r["least"]):
        taken += r["words"]
        if taken > most:
            break
        least = r["least"]
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    found = counts.filter(F.col("m") >= least).select("h", "n").toArrow()
    h, n = (found.column(c).to_numpy() for c in ("h", "n"))
    order = np.lexsort((h.view(np.uint64), -n))
    return h.view(np.uint64)[order], n[order]


def train(texts: DataFrame, singles: np.ndarray, biases: list[np.ndarray], rows: int, rounds: int) -> np.ndarray:
    """The weights of the three softmaxes, one above the other, after ``rounds`` rounds of
    averaged local updates; ``texts`` has text and turn."""
    spark = texts.sparkSession
    weights = np.zeros((3 * rows, WIDTH), dtype=np.float32)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((singles, biases, weights.astype("<f2")))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = None
            for batch in batches:
                if model is None:
                    singles, biases, start = shared.value
                    model = Model(singles, biases, start.astype(np.float32))
                for lo, hi in _slices(batch.column(0)):
                    model.learn(*tokens(batch.column(0).slice(lo, hi - lo)))
            if model is None:
                return
            for k, factor in enumerate(model.factors):
                heat = factor.heat.sum(axis=1).reshape(-1, PACKED)
                used = np.flatnonzero(heat.any(axis=1))
                for at in range(0, len(used), 256):
                    some = used[at : at + 256]
                    old = start[k * rows : (k + 1) * rows].reshape(-1, PACKED * WIDTH)[some].astype(np.float32)
                    change = (factor.weights.reshape(-1, PACKED * WIDTH)[some] - old).astype("<f2")
                    place = pa.array(some + k * (rows // PACKED))
                    yield pa.RecordBatch.from_arrays([place, _binary_rows(heat[some].astype("<f4")), _binary_rows(change)], names=["place", "heat", "change"])

        changes = texts.filter(F.col("turn") == turn).select("text").mapInArrow(run, "place long, heat binary, change binary")

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Means over one partition of places: all changes of a place meet here."""
            total: dict[int, np.ndarray] = {}
            heats: dict[int, np.ndarray] = {}
            for batch in batches:
                for p, h, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    heat = np.frombuffer(h, dtype="<f4")
                    add = np.frombuffer(c, dtype="<f2").astype(np.float32).reshape(PACKED, WIDTH) * heat[:, None]
                    if p in total:
                        total[p] += add
                        heats[p] += heat
                    else:
                        total[p], heats[p] = add, heat.copy()
            for p, sums in total.items():
                means = sums / np.maximum(heats[p], 1e-12)[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([means.astype("<f2").tobytes()], pa.binary())], names=["place", "change"])

        merged = write_table(changes.repartition("place").mapInArrow(mean, "place long, change binary"), "lm-weights").toArrow()
        blocks = weights.reshape(-1, PACKED * WIDTH)
        for batch in merged.to_batches():
            change = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<f2").reshape(-1, PACKED * WIDTH)
            blocks[batch.column(0).to_numpy()] += change
        shared.unpersist()
    return weights


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: ``key``, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigrams) and score (the model), both log10."""
    spark = docs.sparkSession
    turn = F.crc32(F.concat(F.lit("round "), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")) % rounds
    held = fold(F.col(key)) == HELD
    learned = docs.filter(~held).select(F.col(text).alias("text"), turn.alias("turn"))
    every = count_words(docs.select(F.col(text).alias("text"), held.alias("held")))
    counts = every.filter("n > 0")
    totals = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    n, v = int(totals[0] or 0), int(totals[1])
    rows = min(MOST_ROWS, max(LEAST_ROWS, 1 << (v // WORDS_PER_ROW).bit_length()))
    frequent, often = _most_frequent(every, FREQUENT)
    singles = frequent[(frequent != END) & (often > 0)][:SINGLES]
    # an unseen word for every cell, and none for a class of one word
    mass, cells = np.ones(CLASSES), np.ones((CLASSES, WIDTH))
    top = [int(h) for h in singles.view(np.int64)]
    by_cell = counts.filter(~F.col("h").isin(top)).groupBy("k", F.shiftrightunsigned("h", 60).cast("int").alias("c"))
    for r in by_cell.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        cells[r["k"], r["c"]] += r["n"] + r["v"]
    mass[SINGLES:] = cells[SINGLES:].sum(axis=1)
    mass[SINGLES] = max(1, mass[SINGLES] - WIDTH)
    mass[: len(singles)] = often[np.isin(frequent, singles)] + 1
    tree = mass.reshape(WIDTH, WIDTH)
    logs = lambda x: np.log(x / x.sum(axis=1, keepdims=True)).astype(np.float32)
    biases = [logs(tree.sum(axis=1)[None, :]), logs(tree), logs(cells)]
    weights = train(learned, singles, biases, rows, rounds)
    shared = spark.sparkContext.broadcast((frequent, often, singles, biases, weights.astype("<f2"), np.log10(cells)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, often, singles, biases, weights, log_mass = shared.value
        model, known = Model(singles, biases, weights.astype(np.float32)), Lookup(frequent)
        logs_of = np.append(np.log10(often + 1.0), 0.0)
        for batch in batches:
            for lo, hi in _slices(batch.column(3)):
                hashes, tails, sizes = tokens(batch.column(3).slice(lo, hi - lo))
                at = known.find(hashes)
                logs, first = logs_of[at], np.cumsum(sizes) - sizes
                cls = model.classed(hashes, tails)
                # a class of one word holds no share of counts
                part = model.log10s(hashes, tails, sizes, cls, log_mass) + np.where(cls > SINGLES, logs, 0.0)
                rare = np.flatnonzero(at < 0)
                cut = np.searchsorted(rare, np.append(first, len(hashes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(sizes.astype(np.int64)),
                        pa.array(np.add.reduceat((logs > 0).astype(np.int64), first)),
                        pa.array(np.add.reduceat(logs, first)), pa.array(np.add.reduceat(part, first)),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(hashes[rare].view(np.int64))),
                    ],
                    names=["__row", "__key", "__held", "__tokens", "__known", "__logs", "__model", "__rare"],
                )

    given = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), held.alias("__held"), F.col(text).alias("__text"))
    kind = given.schema["__key"].dataType.simpleString()
    read = write_table(
        given.mapInArrow(run, f"__row long, __key {kind}, __held boolean, __tokens long, __known long, __logs double, __model double, __rare array<long>"), "lm-read"
    )
    # rare words are summed up per text by the count they were met with
    rare = read.select("__row", F.explode("__rare").alias("h"))
    met = rare.join(counts.select("h", "n"), "h")
    sums = met.groupBy("__row").agg(F.count(F.lit(1)).alias("__more"), F.sum(F.log10(F.col("n") + 1)).alias("__sum"))
    all_rows = read.drop("__rare").join(sums.withColumnRenamed("__row", "__of"), F.col("__row") == F.col("__of"), "left")
    more = F.coalesce("__sum", F.lit(0.0))
    return all_rows.select(
        F.col("__key").alias(key), F.col("__held").alias("held_out"), F.col("__tokens").alias("n_tokens"),
        (F.col("__known") + F.coalesce("__more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("__logs") + more - F.col("__tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("__model") + more).alias("score"),
    )
