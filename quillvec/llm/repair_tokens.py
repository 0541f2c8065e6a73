"""Token ids in files compressed by Re-Pair.

A file holds shards in ascending doc_id order. Per shard, frequent pairs of neighbouring ids are replaced by
nonterminals, round after round: a round replaces every pair that is at least half as frequent as the most frequent
one, so the strongest pairs come first. A shard stores its rules, the length each nonterminal expands to, and where
each document begins, so one document can be decoded without the rest of its shard.
"""

from __future__ import annotations

import json
import os
import sys
import types
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillvec.llm.common import documents, small_batches
from quillvec.session import scratch_path, settle

END_ID = 2
# A shard is closed at this many ids; a longer document is a shard of its own.
SHARD_IDS = 1 << 20
# The fewest occurrences worth a rule, and the most rules of a round; rounds go on until no pair is worth one.
LEAST_COUNT = 32
ROUND_RULES = 4096
COUNT_BITS = 18
# Beyond so many pieces, or bytes of them, a worker begins to forget: of the pieces so far it keeps those it meets again.
PIECES_KEPT = 200_000
PIECE_BYTES_KEPT = 1 << 24


# --- ids -------------------------------------------------------------------------------------------


# What a byte of UTF-8 begins: letters of ASCII; letters of two bytes, for lead bytes that begin only letters (of C3 all but
# two); digits of ASCII. Any other byte is 0, which only means that no cut is sure there.
LETTER, LEAD, DIGIT = 1, 2, 3
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KINDS[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = LEAD
KINDS[[*range(0x30, 0x3A)]] = DIGIT


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of `data`; the signs for times and division, C3 97 and C3 B7, are no letters."""
    kinds = KINDS[data]
    kinds[:-1][(data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))] = 0
    return kinds


def sure_cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a byte surely begins a pre-token of byte-level pre-tokenization, for texts of `data` between `bounds`.

    A space or line feed before a letter or digit does, whatever stands before it, and so does a byte of ASCII that is no
    letter behind one that is. Pieces between such places have the same pre-tokens alone as in their text.
    """
    kinds = kinds_of(data)
    cuts = np.zeros(len(data), dtype=bool)
    cuts[:-1] = ((data[:-1] == 0x20) | (data[:-1] == 0x0A)) & (kinds[1:] > 0)
    # The next text is not behind this one.
    starts, ends = bounds[:-1], bounds[1:]
    cuts[ends[ends > starts] - 1] = False
    ended = kinds == LETTER
    ended[1:] |= kinds[:-1] == LEAD
    cuts[1:] |= ended[:-1] & (data[1:] < 0x80) & (kinds[1:] != LETTER)
    cuts[starts[ends > starts]] = True
    return cuts


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of `values` of these starts and sizes, one after another."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return values[:0]
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]


class Pieces:
    """Pieces of text, as bytes, by number, and the ids of each."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.bytes = 0
        self.ids, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of these new pieces."""
        first = len(self.sizes)
        self.numbers.update(zip(pieces, range(first, first + len(pieces))))
        self.bytes += sum(map(len, pieces))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        return np.arange(first, first + len(pieces))

    def find(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each piece, -1 where it is not known."""
        return np.fromiter(map(self.numbers.get, pieces, repeat(-1)), np.int64, len(pieces))


class Encoder:
    """Ids of texts by the text of a tokenizers file, the same as encoding each whole text.

    With byte-level pre-tokenization, texts are cut where a pre-token surely begins, and the library encodes each different
    piece once: it is remembered for later texts. Any other file encodes whole texts.
    """

    def __init__(self, spec_text: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_str(spec_text), end_id
        spec = json.loads(self.tokenizer.to_str())
        steps = spec.get("pre_tokenizer") or {}
        added = [t["content"] for t in spec["added_tokens"]]
        trimmed = any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.by_piece = (
            steps.get("type") == "ByteLevel" and not steps.get("add_prefix_space") and steps.get("use_regex", True)
            and spec.get("normalizer") is None and not trimmed
        )
        self.added = [content.encode() for content in added]
        # Bytes of every id; a character of a byte-level token stands for one byte.
        self.bytes = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(token.encode()) if token in added else len(token)
        # Pieces met lately, and those of before.
        self.known, self.earlier = Pieces(), Pieces()

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        found = [
            np.array(e.ids, dtype="<u4") for i in range(0, len(texts), 512)
            for e in self.tokenizer.encode_batch_fast(texts[i : i + 512], add_special_tokens=False)
        ]
        return np.concatenate([np.zeros(0, "<u4"), *found]), np.array([len(ids) for ids in found], dtype=np.int64)

    def learn(self, pieces: list[bytes], behind: np.ndarray) -> np.ndarray:
        """Remember the ids of pieces. Those that begin by a space or line feed and a letter or digit can stand one behind
        another, so one call encodes many of them."""
        row, alone = np.flatnonzero(behind).tolist(), np.flatnonzero(~behind).tolist()
        found, sizes = [], []
        for i in range(0, len(row), 2000):
            some = [pieces[j] for j in row[i : i + 2000]]
            ids = self.whole([b"".join(some).decode()])[0]
            ends, bounds = np.cumsum(self.bytes[ids]), np.cumsum([len(p) for p in some])
            stops = np.searchsorted(ends, bounds, side="right")
            assert (ends[stops - 1] == bounds).all()
            found.append(ids)
            sizes.append(np.diff(stops, prepend=0))
        ids, counts = self.whole([pieces[j].decode() for j in alone])
        order = row + alone
        numbers = np.empty(len(pieces), dtype=np.int64)
        numbers[order] = self.known.add([pieces[j] for j in order], np.concatenate([*found, ids]), np.concatenate([*sizes, counts]))
        return numbers

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
        """How many pieces stand before each text, then before the end, and the pieces of all texts."""
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        cuts = sure_cuts(data, bounds) if len(data) else np.zeros(0, dtype=bool)
        # A text with an added token stays whole: that token ends and begins pre-tokens by itself.
        whole = data.tobytes() if self.added else b""
        for content in self.added:
            at = whole.find(content)
            while at >= 0:
                text = np.searchsorted(bounds, at, side="right")
                cuts[bounds[text - 1] + 1 : bounds[text]] = False
                at = whole.find(content, bounds[text])
        places = np.append(np.flatnonzero(cuts), len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)])
        return np.searchsorted(places, bounds), pieces.dictionary_encode()

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, null ones empty, each with the end id behind it, and how many each text has."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_piece:
            ids, sizes = self.whole(texts.to_pylist())
            return np.insert(ids, np.cumsum(sizes), self.end), sizes + 1
        firsts, found = self.pieces(texts)
        kinds = found.dictionary
        numbers = self.numbers(kinds)[found.indices.to_numpy()]
        known = self.known
        # The end ids are one more piece, behind all others.
        numbers = np.insert(numbers, firsts[1:], len(known.sizes))
        starts, sizes = np.append(known.starts, len(known.ids)), np.append(known.sizes, 1)
        sizes = sizes[numbers]
        ids = ragged(np.append(known.ids, np.uint32(self.end)), starts[numbers], sizes)
        stops = np.cumsum(sizes)[firsts[1:] + np.arange(len(texts))]
        return ids, np.diff(stops, prepend=0)

    def numbers(self, kinds: pa.Array) -> np.ndarray:
        """The number of each of these different pieces among the known ones; those not known are learnt."""
        if len(self.known.numbers) > PIECES_KEPT or self.known.bytes > PIECE_BYTES_KEPT:
            self.known, self.earlier = Pieces(), self.known
        pieces = kinds.to_numpy(zero_copy_only=False).tolist()
        numbers = self.known.find(pieces)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            missing = [pieces[i] for i in new.tolist()]
            old = self.earlier.find(missing)
            again = np.flatnonzero(old >= 0)
            if len(again):
                sizes = self.earlier.sizes[old[again]]
                ids = ragged(self.earlier.ids, self.earlier.starts[old[again]], sizes)
                numbers[new[again]] = self.known.add([missing[i] for i in again.tolist()], ids, sizes)
            unmet = np.flatnonzero(old < 0)
            if len(unmet):
                numbers[new[unmet]] = self.learn([missing[i] for i in unmet.tolist()], begin_behind(kinds)[new[unmet]])
        return numbers

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as little-endian 32-bit numbers."""
        ids, sizes = self.encode_array(pa.array(texts, pa.large_string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


def begin_behind(pieces: pa.Array) -> np.ndarray:
    """Which pieces begin by a space or line feed and a letter or digit."""
    places = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
    starts = places[:-1][np.diff(places) > 1]
    out = np.zeros(len(pieces), dtype=bool)
    out[np.diff(places) > 1] = ((data[starts] == 0x20) | (data[starts] == 0x0A)) & (kinds_of(data)[starts + 1] > 0)
    return out


# --- Re-Pair ---------------------------------------------------------------------------------------


def group_pairs(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different pairs in order, how often each occurs, places by pair) of the symbols that make a pair at each place."""
    symbol, place = int(max(left.max(initial=0), right.max(initial=0))).bit_length(), int(at.max(initial=0)).bit_length()
    packed = 2 * symbol + place <= 64
    # One number holds pair and place if they fit, which sorts faster than places by pairs.
    symbol = symbol if packed else 32
    pairs = left.astype(np.uint64)
    pairs <<= np.uint64(symbol)
    pairs |= right
    if packed:
        pairs <<= np.uint64(place)
        pairs |= at.astype(np.uint64)
        pairs.sort()
        at = (pairs & np.uint64((1 << place) - 1)).astype(at.dtype)
        pairs >>= np.uint64(place)
    else:
        order = np.lexsort((at, pairs))
        pairs, at = pairs[order], at[order]
    starts = np.flatnonzero(np.append(len(pairs) > 0, pairs[1:] != pairs[:-1]))
    kinds = pairs[starts]
    kinds = ((kinds >> np.uint64(symbol)) << np.uint64(32)) | (kinds & np.uint64((1 << symbol) - 1))
    return kinds, np.diff(starts, append=len(pairs)), at


class PairPlaces:
    """The symbols of a shard as a linked list, and the places of every pair of neighbours that occurs LEAST_COUNT times.

    A pair of symbols gets no new places once it has been met, as a new pair holds a new symbol. So places are listed once,
    and a pair is forgotten at a place when one of its symbols is replaced.
    """

    def __init__(self, ids: np.ndarray, breaks: np.ndarray):
        size = len(ids)
        self.symbols = ids.astype(np.uint32)
        self.after, self.before = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
        # Whether a symbol is there still, and whether a document ends with it.
        self.alive, self.last = np.ones(size, dtype=bool), np.zeros(size, dtype=bool)
        self.last[breaks[(breaks > 0) & (breaks < size)] - 1] = True
        self.last[-1:] = True
        # Of each pair: its symbols, how often it occurs now, where its places begin and how many were listed.
        self.pairs, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.listed, self.places = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        # The number of the pair that begins at a place.
        self.pair_at = np.full(size, -1, dtype=np.int32)
        self.list_places(np.flatnonzero(~self.last).astype(np.int32))

    def list_places(self, at: np.ndarray) -> None:
        """List these places, which hold new pairs, where their pair is frequent enough."""
        left, right = self.symbols[at], self.symbols[self.after[at]]
        bits = min(COUNT_BITS, len(at).bit_length() + 1)
        place = left * np.uint32(0x9E3779B1)
        place ^= right * np.uint32(0x85EBCA77)
        place >>= np.uint32(32 - bits)
        # Pairs meet in a bin, so a bin bounds the counts of its pairs from above.
        often = np.flatnonzero(np.take(np.bincount(place, minlength=1 << bits) >= LEAST_COUNT, place))
        pairs, counts, places = group_pairs(left[often], right[often], at[often])
        held = counts >= LEAST_COUNT
        places, pairs, counts = places[np.repeat(held, counts)], pairs[held], counts[held]
        self.pair_at[places] = np.repeat(np.arange(len(self.pairs), len(self.pairs) + len(pairs), dtype=np.int32), counts)
        self.starts = np.append(self.starts, len(self.places) + np.cumsum(counts) - counts)
        self.places, self.pairs = np.append(self.places, places), np.append(self.pairs, pairs)
        self.counts, self.listed = np.append(self.counts, counts), np.append(self.listed, counts)

    def frequent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, places in order, pair number of each place) of the pairs that occur at least half as often as the most
        frequent one, and LEAST_COUNT times. Of too many pairs the most frequent are taken."""
        some = np.flatnonzero(self.counts >= max(LEAST_COUNT, (int(self.counts.max(initial=0)) + 1) // 2))
        if len(some) > ROUND_RULES:
            some = some[np.lexsort((self.pairs[some], -self.counts[some]))[:ROUND_RULES]]
        some = some[np.argsort(self.pairs[some])]
        sizes = self.listed[some]
        at, number = ragged(self.places, self.starts[some], sizes), np.repeat(np.arange(len(some)), sizes)
        there = np.flatnonzero(self.pair_at[at] == some[number])
        both = (at[there].astype(np.int64) << 32) | number[there]
        both.sort()
        return self.pairs[some], both >> 32, both & 0xFFFFFFFF

    def replace(self, first: int) -> np.ndarray:
        """One round: the pairs of the new rules, numbered from `first`. No pair crosses the end of a document."""
        pairs, at, rule = self.frequent()
        if not len(pairs):
            return pairs
        # In a row of overlapping places every other one is taken, from the left.
        fresh = np.append(True, self.after[at[:-1]] != at[1:])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        odd = (np.arange(len(at)) - start) % 2 == 0
        at, rule = at[odd], rule[odd]
        gone = self.after[at]
        self.alive[gone] = False
        self.symbols[at] = (first + rule).astype(np.uint32)
        self.last[at] = self.last[gone]
        # No place taken is the second symbol of another one, so links can be set at once.
        after = self.after[gone]
        self.after[at] = after
        inside = after < len(self.symbols)
        self.before[after[inside]] = at[inside]
        ahead = self.before[at]
        ahead = ahead[ahead >= 0]
        # A place ahead that was replaced too is among them already.
        ahead = ahead[self.symbols[ahead] < first]
        lost = self.pair_at[np.concatenate([at, gone, ahead])]
        self.counts -= np.bincount(lost[lost >= 0], minlength=len(self.counts))
        self.pair_at[gone] = -1
        fresh = np.concatenate([at, ahead])
        self.pair_at[fresh] = -1
        self.list_places(fresh[~self.last[fresh]])
        return pairs


def compress(ids: np.ndarray, breaks: np.ndarray) -> dict:
    """A shard, in which no pair is left that occurs LEAST_COUNT times: `base` (ids below it are terminals), rules, their expansion lengths, the body, and document places."""
    base = int(ids.max()) + 1 if len(ids) else 0
    rules, top, shard = [], base, PairPlaces(ids, breaks)
    while True:
        pairs = shard.replace(top)
        if not len(pairs):
            break
        rules.append(pairs)
        top += len(pairs)
    flat = np.concatenate(rules) if rules else np.zeros(0, dtype=np.uint64)
    lengths = np.zeros(len(flat), dtype=np.uint32)
    size = lambda s, upto: np.where(s < base, 1, lengths[np.minimum(np.maximum(s - base, 0), max(upto - 1, 0))])
    done = 0
    for pairs in rules:
        left, right = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lengths[done : done + len(pairs)] = size(left, done) + size(right, done)
        done += len(pairs)
    kept = np.flatnonzero(shard.alive)
    return {"base": base, "rules": flat, "lengths": lengths, "body": shard.symbols[kept], "places": np.searchsorted(kept, breaks)}


def open_rules(base: int, rules: np.ndarray) -> np.ndarray:
    """The ids of all rules, one after another. Rules refer to earlier ones only, so each pass opens the outermost layer."""
    symbols = np.arange(base, base + len(rules), dtype=np.uint32)
    while True:
        nested = symbols >= base
        if not nested.any():
            return symbols
        width = 1 + nested.astype(np.int64)
        ends = np.cumsum(width)
        out = np.empty(ends[-1], dtype=np.uint32)
        out[ends - width] = symbols
        opened = rules[symbols[nested] - base]
        at = ends[nested] - 2
        out[at] = (opened >> np.uint64(32)).astype(np.uint32)
        out[at + 1] = opened.astype(np.uint32)
        symbols = out


def expand(symbols: np.ndarray, base: int, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of any run of body symbols: each rule is opened once, and its ids are put where its symbol stands."""
    opened, sizes = open_rules(base, rules), lengths.astype(np.int64)
    nested = np.flatnonzero(symbols >= base)
    rule = symbols[nested] - base
    starts, widths = np.arange(len(symbols)) + len(opened), np.ones(len(symbols), dtype=np.int64)
    starts[nested], widths[nested] = (np.cumsum(sizes) - sizes)[rule], sizes[rule]
    return ragged(np.concatenate([opened, symbols]), starts, widths)


def decode_document(shard: dict, number: int) -> np.ndarray:
    """The ids of one document of a shard, without expanding the others."""
    body, places = unpack_symbols(shard["body"]), np.frombuffer(shard["places"], "<i8")
    end = places[number + 1] if number + 1 < len(places) else len(body)
    rules, lengths = np.frombuffer(shard["rules"], "<u8"), np.frombuffer(shard["rule_lengths"], "<u4")
    return expand(body[places[number] : end], shard["base"], rules, lengths)


def pack_symbols(symbols: np.ndarray) -> bytes:
    """Low 16 bits of all symbols, then the high ones, which are mostly equal and compress away."""
    return symbols.astype("<u2").tobytes() + (symbols >> np.uint32(16)).astype("<u2").tobytes()


def unpack_symbols(data: bytes) -> np.ndarray:
    low, high = np.frombuffer(data, "<u2").reshape(2, -1)
    return low.astype(np.uint32) | (high.astype(np.uint32) << np.uint32(16))


# --- files -----------------------------------------------------------------------------------------

SHARD = (
    "part int, seq int, doc_ids binary, doc_null binary, counts binary, n_ids long, base long, rules binary, "
    "rule_lengths binary, body binary, places binary"
)


def worker_encoder(spec_text: str, end_id: int) -> Encoder:
    """The encoder of this Python worker. Spark reuses workers, so pieces learnt by one task serve the next."""
    # Spark runs a task on each core, so the library needs no threads of its own.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders")).__dict__
    key = xxhash.xxh3_128_hexdigest(spec_text), end_id
    if key not in kept:
        kept[key] = Encoder(spec_text, end_id)
    return kept[key]


def shard_batches(spec_text: str, end_id: int, shard_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = worker_encoder(spec_text, end_id), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def shard() -> pa.RecordBatch:
            counts = np.array([len(i) for _, i in held], dtype=np.int64)
            breaks = np.concatenate([[0], np.cumsum(counts)[:-1]])
            made = compress(np.concatenate([i for _, i in held]), breaks)
            row = {
                "part": part, "seq": seq,
                "doc_ids": np.array([d or 0 for d, _ in held], dtype="<i8").tobytes(),
                "doc_null": bytes(d is None for d, _ in held),
                "counts": counts.astype("<i8").tobytes(), "n_ids": int(counts.sum()), "base": made["base"],
                "rules": made["rules"].astype("<u8").tobytes(), "rule_lengths": made["lengths"].astype("<u4").tobytes(),
                "body": pack_symbols(made["body"]), "places": made["places"].astype("<i8").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=SHARD_ARROW)

        for batch in batches:
            found, sizes = encoder.encode_array(batch.column("text"))
            stops = np.cumsum(sizes).tolist()
            for doc, start, stop in zip(batch.column("doc_id").to_pylist(), [0, *stops], stops):
                if held and size + stop - start > shard_ids:
                    yield shard()
                    held, size, seq = [], 0, seq + 1
                held.append((doc, found[start:stop]))
                size += stop - start
        if held:
            yield shard()

    return run


SHARD_ARROW = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.binary()), ("doc_null", pa.binary()), ("counts", pa.binary()),
    ("n_ids", pa.int64()), ("base", pa.int64()), ("rules", pa.binary()), ("rule_lengths", pa.binary()), ("body", pa.binary()),
    ("places", pa.binary()),
])


def write_tokens(df: DataFrame, out: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode every row of `df` (doc_id, text) and write shards to the folder `out`, in ascending doc_id order.

    A null text is empty; every document ends with `end_id`. Null doc_ids come first, rows of one doc_id follow each other
    by a hash of their text, repeated rows are all written. An empty table writes no shard. Ranges of doc_id go to
    tasks; a task holds one shard. The hash, not the text, is in the order, as the driver sees a sample of its keys.
    """
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("tie")]
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    # Tasks get the tokenizer's text: its file lies with the driver.
    with open(tokenizer, encoding="utf-8") as file:
        spec_text = file.read()
    shards = ordered.mapInArrow(shard_batches(spec_text, end_id, shard_ids), SHARD)
    with small_batches(df.sparkSession):
        shards.write.option("compression", "zstd").parquet(out)


def decoded_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the shards, whose `before` ids stand before them."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = expand(unpack_symbols(row["body"]), row["base"], np.frombuffer(row["rules"], "<u8"), np.frombuffer(row["rule_lengths"], "<u4"))
            counts = np.frombuffer(row["counts"], "<i8")
            ends = np.cumsum(counts)
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            docs = np.frombuffer(row["doc_ids"], "<i8").tolist()
            yield pa.record_batch(
                [
                    pa.array([None if gone else d for d, gone in zip(docs, row["doc_null"])], pa.int64()),
                    pa.array(row["before"] + ends - counts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(data[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist())], pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""
    shards = spark.read.schema(SHARD).parquet(path)
    # One row per shard of a million ids, without its data.
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("ids").over(above), F.lit(0)).alias("from"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    index = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inside")).join(
        F.broadcast(offsets), "part"
    ).select("part", "seq", (F.col("from") + F.col("inside")).alias("before"))
    placed = shards.join(F.broadcast(index), ["part", "seq"]).select(
        "doc_ids", "doc_null", "counts", "base", "rules", "rule_lengths", "body", "before"
    )
    with small_batches(spark):
        return settle(placed.mapInArrow(decoded_batches, "doc_id long, start long, n_tokens long, ids_crc32 long"), "decoded")


def query(spark, sf: str) -> DataFrame:
    """Whole documents through the files and back, with the byte-level tokenizer."""
    import public_tokenizers

    out = scratch_path(spark, "tokens")
    write_tokens(documents(spark, sf), out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, out)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
