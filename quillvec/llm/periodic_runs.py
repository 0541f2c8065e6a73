"""Periodic runs in texts, found online by catchers over dyadic blocks.

Words are appended to a stream. Once a block of B = 2^k words that begins at a multiple of B is complete, a catcher
over it watches the words appended later for the block's return between 2B - 1 and 4B - 2 places on: the first half of
every square of such a period holds a whole block. So an appended word ends one comparison with each of two catchers
of every level. A return opens a suffix comparison of the words a period apart, which every appended word advances until
they differ; as far as it is at least a period long it is a train of squares, and these merge into one run.

Appended words are worked off a chunk at a time, the comparisons of a level in one vector operation.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm import tasks
from quillvec.llm.common import SPACE_GAP, documents, small_batches, words

# A run has at least this many words, and two periods.
LEAST_LENGTH = 12
# Words appended at once.
CHUNK = 1 << 17
STEPS = 16
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 2**64))


def needed(period: np.ndarray) -> np.ndarray:
    """Words that must equal the ones a period on for a run of this period."""
    return np.maximum(period, LEAST_LENGTH - period)


def agreeing(words: np.ndarray, at: np.ndarray, lag: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """For each place, how many words in a row equal the word `lag` on, going by `step`, of `room` at most."""
    found = np.zeros(len(at), dtype=np.int64)
    live = np.flatnonzero(room > 0)
    for _ in range(STEPS):
        x = at[live] + step * found[live]
        live = live[words[x] == words[x + lag[live]]]
        found[live] += 1
        live = live[found[live] < room[live]]
        if not len(live):
            return found
    for i in live.tolist():
        x, p, n, most, width = int(at[i]), int(lag[i]), int(found[i]), int(room[i]), 64
        while n < most:
            width = min(2 * width, most - n)
            low = x + n if step > 0 else x - n - width + 1
            same = words[low : low + width] == words[low + p : low + p + width]
            if step < 0:
                same = same[::-1]
            first = int(same.argmin())
            if not same[first]:
                n += first
                break
            n += width
        found[i] = n
    return found


class Catchers:
    """Finds the runs of a stream of word numbers while words are appended; periods up to `longest` / 2.

    Words that must never be part of a run, such as marks between texts, get numbers that occur once. `codes` are 64-bit
    hashes of the words; they only choose what is compared, word numbers decide.
    """

    def __init__(self, longest: int):
        self.longest, self.n = longest, 0
        self.words = np.zeros(1, dtype=np.int64)
        # Sums of code times BASE^place, and BASE^-place: the hash of any window by two look-ups.
        self.sums, self.back = np.zeros(2, dtype=np.uint64), np.ones(2, dtype=np.uint64)
        self.power = np.uint64(1)
        none = np.zeros(0, dtype=np.int64)
        # Comparisons that reach the end of the stream: first place, lag, and the place they have come to.
        self.open = none, none, none
        self.done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _store(self, words: np.ndarray, codes: np.ndarray) -> None:
        n, m = self.n, self.n + len(words)
        if m > len(self.words):
            size = max(m, 2 * len(self.words))
            for name, more in (("words", size), ("sums", size + 1), ("back", size + 1)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros(more - len(old), dtype=old.dtype)]))
        self.words[n:m] = words
        powers = np.multiply.accumulate(np.full(len(words), BASE, dtype=np.uint64)) * self.power
        self.sums[n + 1 : m + 1] = self.sums[n] + np.cumsum(codes * powers, dtype=np.uint64)
        self.back[n + 1 : m + 1] = np.multiply.accumulate(np.full(len(words), BACK, dtype=np.uint64)) * self.back[n]
        self.power = powers[-1]
        self.n = m

    def _caught(self, block: int, before: int) -> tuple[np.ndarray, np.ndarray]:
        """(block starts, lags) of the returns that the words from `before` on complete, for catchers of one level."""
        low, high = max(before - block + 1, 0), self.n - block + 1
        # Catchers by the nearest lag they look at; the first level looks at lags 1 and 2 too.
        nearest = [2 * block - 1, 3 * block - 1] + [block - 1] * (block == 2)
        starts, lags = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        if high <= low:
            return starts[0], lags[0]
        window = (self.sums[low + block : high + block] - self.sums[low:high]) * self.back[low:high]
        for near in nearest:
            first = max(low, near)
            if first >= high:
                continue
            a, b = (first - near) // block, (high - 1 - near) // block + 1
            at = np.arange(a, b) * block
            hashes = (self.sums[at + block] - self.sums[at]) * self.back[at]
            own = np.repeat(hashes, block)[first - near - a * block :][: high - first]
            hit = np.flatnonzero(window[first - low :] == own) + first
            start = (hit - near) // block * block
            starts.append(start)
            lags.append(hit - start)
        return np.concatenate(starts), np.concatenate(lags)

    def _advance(self) -> None:
        start, lag, reach = self.open
        reach = reach + agreeing(self.words, reach, lag, self.n - lag - reach, 1)
        self.open = start, lag, reach

    def _close(self) -> None:
        """Put comparisons that have ended away as runs, if they are long enough."""
        start, lag, reach = self.open
        ended = reach + lag < self.n
        run = ended & (reach - start >= needed(lag))
        self.done.append((start[run], reach[run] + lag[run], lag[run]))
        self.open = start[~ended], lag[~ended], reach[~ended]

    def _unsaid(self, start: np.ndarray, lag: np.ndarray, block: int, opened: list) -> tuple[np.ndarray, np.ndarray]:
        """Returns but those inside a run whose period divides their lag: it says all that they would."""
        first, period, end = (np.concatenate(c) for c in zip(*((s, p, r + p) for s, p, r in opened)))
        run = end - first >= 2 * period
        if not len(start) or not run.any():
            return start, lag
        order = np.lexsort((period[run], first[run]))
        first, period, end = first[run][order], period[run][order], end[run][order]
        # Of the runs that begin at or before a place, the one that ends last; of several the one of smallest period.
        further = np.concatenate([[True], end[1:] > np.maximum.accumulate(end)[:-1]])
        which = np.maximum.accumulate(np.where(further, np.arange(len(end)), 0))
        i = np.searchsorted(first, start, side="right") - 1
        k = which[np.maximum(i, 0)]
        new = (i < 0) | (end[k] < start + lag + block) | (lag % period[k] != 0)
        return start[new], lag[new]

    def append(self, words: np.ndarray, codes: np.ndarray) -> None:
        if not len(words):
            return
        before = self.n
        self._store(words, codes)
        self._advance()
        # Lags are below 2^31, places too: one number orders (lag, place).
        order = np.lexsort((self.open[0], self.open[1]))
        known = self.open[1][order] << 32 | self.open[0][order]
        reached = self.open[2][order]
        opened = [self.open]
        block = 2
        while block == 2 or (2 * block - 1) * 2 <= self.longest:
            start, lag = self._unsaid(*self._caught(block, before), block, opened)
            if len(start):
                # Returns of neighbouring blocks at the same lag are of one comparison.
                key = np.sort(lag << 32 | start)
                head = np.concatenate([[True], np.diff(key) != block])
                first = key[head]
                last = key[np.concatenate([head[1:], [True]])] & 0xFFFFFFFF
                lag, start = first >> 32, first & 0xFFFFFFFF
                i = np.searchsorted(known, first, side="right") - 1
                inside = i >= 0
                inside[inside] = (known[i[inside]] >> 32 == lag[inside]) & (reached[i[inside]] > start[inside])
                # What can't become long enough before it must end is left out.
                enough = (last - start + 3 * block - 2 >= needed(lag)) | (last + lag + 2 * block > self.n)
                take = ~inside & enough
                start, last, lag = start[take], last[take] + block, lag[take]
                start = start - agreeing(self.words, start - 1, lag, start, -1)
                opened.append((start, lag, last + agreeing(self.words, last, lag, self.n - lag - last, 1)))
            block *= 2
        self.open = tuple(np.concatenate(c) for c in zip(*opened))
        self._close()

    def runs(self) -> np.ndarray:
        """(start, length, period) of all runs so far, by start, then period."""
        start, lag, reach = self.open
        run = reach - start >= needed(lag)
        parts = [*self.done, (start[run], reach[run] + lag[run], lag[run])]
        start, end, lag = (np.concatenate(c) for c in zip(*parts))
        # A run is also met at multiples of its period, from end to end the same: the smallest counts.
        order = np.lexsort((lag, end, start))
        start, end, lag = start[order], end[order], lag[order]
        fresh = np.ones(len(start), dtype=bool)
        fresh[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)
        start, end, lag = start[fresh], end[fresh], lag[fresh]
        order = np.lexsort((lag, start))
        return np.stack([start, end - start, lag], axis=1)[order]


def runs_of(numbers: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each run, (start, length, period) of it) of texts given as word numbers between offsets.

    Texts of about the same length form one stream, so that short ones don't pay for the levels of long ones.
    """
    lengths = np.diff(offsets)
    owners, found = [], []
    classes = np.frexp(lengths.astype(np.float64))[1]
    for c in np.unique(classes[lengths >= LEAST_LENGTH]).tolist():
        texts = np.flatnonzero((classes == c) & (lengths >= LEAST_LENGTH))
        size = lengths[texts] + 1
        # A mark that occurs once stands behind every text.
        begin = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(begin, size)
        owner = np.repeat(texts, size)
        end = place == lengths[owner]
        stream = np.where(end, -1 - owner, numbers[np.minimum(offsets[owner] + place, len(numbers) - 1)])
        codes = tasks.mixed(stream.astype(np.uint64) * BASE + owner.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        catchers = Catchers(int(lengths[texts].max()))
        for at in range(0, len(stream), CHUNK):
            catchers.append(stream[at : at + CHUNK], codes[at : at + CHUNK])
        runs = catchers.runs()
        text = np.searchsorted(begin, runs[:, 0], side="right") - 1
        runs[:, 0] -= begin[text]
        owners.append(texts[text])
        found.append(runs)
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 3), dtype=np.int64)
    owner, runs = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return owner[order], runs[order]


FOUND = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        split = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
        flat, bounds = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        # White space at an end gives an empty word.
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(real)])[bounds]
        flat = flat.filter(pa.array(real))
        numbers = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
        owner, runs = runs_of(numbers, offsets)
        # A word behind the first period of any run is dropped.
        edge = np.zeros(len(numbers) + 1, dtype=np.int64)
        begin = offsets[owner] + runs[:, 0]
        np.add.at(edge, begin + runs[:, 2], 1)
        np.add.at(edge, begin + runs[:, 1], -1)
        kept = np.cumsum(edge[:-1]) == 0
        places = np.concatenate([[0], np.cumsum(kept)])[offsets]
        collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(places, pa.int32()), flat.filter(pa.array(kept))), " ")
        counts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(offsets) - 1))])
        structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in runs.T], fields=list(RUN))
        yield pa.record_batch(
            [
                batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()),
                pa.ListArray.from_arrays(pa.array(counts, pa.int32()), structs), collapsed.cast(pa.string()),
            ],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row of `df`.

    Words stand between white space (ASCII). `runs` are all maximal stretches of words with smallest period `period` that
    are at least LEAST_LENGTH words and two periods long, as (start, length, period) by start, then period. `collapsed` is
    the text without the words that stand in a run behind its first period, joined by one space. A null text has no
    words; repeated rows are returned as often; an empty table gives no rows; other columns are ignored. Nothing is
    shuffled; a task holds a batch of a few MB, or one text.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run_batches, FOUND)


def looped(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with the ends of a tenth of the texts made periodic.

    With h the crc32 of the decimal doc_id and g = floor(h / 10), where h % 10 = 0 each of n words from a = g % n on becomes
    the one at a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). A null doc_id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = docs.withColumn("_g", F.when(h % 10 == 0, g)).withColumn("_w", F.when(h % 10 == 0, words(F.col("text"), SPACE_GAP)))
    n = F.size("_w").cast("long")
    sized = split.withColumn("_n", n).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rest = F.col("_n") - F.col("_a")
    sized = sized.withColumn("_p", 1 + F.floor(rest / (3 + F.col("_g") % 8)))
    a, p = F.col("_a").cast("int"), F.col("_p").cast("int")
    head = F.slice("_w", F.lit(1), a)
    tail = F.flatten(F.array_repeat(F.slice("_w", a + 1, p), F.ceil(rest / F.col("_p")).cast("int")))
    periodic = F.array_join(F.concat(head, F.slice(tail, F.lit(1), rest.cast("int"))), " ")
    return sized.select("doc_id", F.when(F.col("_p").isNull(), F.col("text")).otherwise(periodic).alias("text"))


def query(spark, sf: str) -> DataFrame:
    """Runs of every document, the longest one, and digests of all runs and of the collapsed text."""
    with small_batches(spark):
        found = periodic_runs(looped(documents(spark, sf).select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.array_join(F.transform(listed, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
