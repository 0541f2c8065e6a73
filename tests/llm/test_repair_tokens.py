import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillvec.llm import repair_tokens as r
from quillvec.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_pieces_encode_like_whole_texts(tokenizer, texts):
    odd = [
        "a  b", " a", "a ", "a\n b", "a \nb", "don't we'll I'm  they're", "x y z", "été Été, ça!", "1st 2nd,3rd",
        "<|endoftext|> a<|endoftext|>b c", "\t tab", "a b 中文 ٣", "word, word. word! word\nword", "A|B | C", "_x _ y", " ",
        "café́s Ångström ǅx", "a ́b", "nº 5 ª",
    ]
    encoder = r.Encoder(open(PATH, encoding="utf-8").read(), 2)
    assert encoder.by_piece
    whole = [t or "" for t in texts] + odd
    for _ in range(2):
        for text, data in zip(whole, encoder.encode(whole)):
            assert np.frombuffer(data, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_pieces_of_odd_characters_encode_like_whole_texts(tokenizer, monkeypatch):
    marks = [
        " ", "\n", "\t", "\r\n", "\u00a0", "\u2028", "a", "b", "The", "'", "s", "'ll", ".", "1", "\u0663", "\u00e9", "\u00d6", "\u00d7", "\u00f7",
        "\u0100", "\u017f", "\u0416", "\u0482", "\u0301", "\u4e2d", "|", "<|endoftext|>", "<|", "_", "\u00aa", "\u00b2", "\U0001f600",
    ]
    draw = np.random.default_rng(3)
    encoder = r.Encoder(open(PATH, encoding="utf-8").read(), 2)
    for kept in (5, 200, 200_000):
        monkeypatch.setattr(r, "PIECES_KEPT", kept)
        for some in (4, 8, len(marks)):
            texts = ["".join(draw.choice(draw.choice(marks, some), size)) for size in draw.integers(0, 25, 400)]
            for text, data in zip(texts, encoder.encode(texts), strict=True):
                assert np.frombuffer(data, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_each_piece_is_encoded_once(tokenizer):
    class Counted:
        characters = 0

        def encode_batch_fast(self, texts, **options):
            self.characters += sum(map(len, texts))
            return tokenizer.encode_batch_fast(texts, **options)

    words = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in "lmnr"]
    texts = [f"x {a}.\n{b}, {a}" for a in words for b in words]
    encoder = r.Encoder(open(PATH, encoding="utf-8").read(), 2)
    encoder.tokenizer = Counted()
    encoder.encode(texts[::2])
    encoder.encode(texts[1::2])
    # Words behind a space, words behind a line feed, and the marks between.
    assert encoder.tokenizer.characters <= 2 * sum(len(w) + 1 for w in words) + 10


def test_grouped_pairs_do_not_depend_on_how_they_are_sorted():
    draw = np.random.default_rng(4)
    for top in (1, 3, 300, 2**31):
        left, right = (draw.integers(0, top, 5000).astype(np.uint32) for _ in range(2))
        at = draw.permutation(2**20)[:5000].astype(np.int32)
        plain: dict = {}
        for a, b, place in zip(left.tolist(), right.tolist(), at.tolist()):
            plain.setdefault(a << 32 | b, []).append(place)
        pairs, counts, places = r.group_pairs(left, right, at)
        assert pairs.tolist() == sorted(plain) and counts.tolist() == [len(plain[p]) for p in sorted(plain)]
        assert places.tolist() == [place for p in sorted(plain) for place in sorted(plain[p])]


@pytest.mark.parametrize("path", ["word_bpe_49k.json"])
def test_other_tokenizers_encode_whole_texts(path, texts):
    path = public_tokenizers.path(path)
    encoder, plain = r.Encoder(open(path, encoding="utf-8").read(), 2), Tokenizer.from_file(path)
    assert not encoder.by_piece
    some = [t or "" for t in texts[:16]]
    for text, data in zip(some, encoder.encode(some)):
        assert np.frombuffer(data, "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


def test_compression_round_trip():
    draw = np.random.default_rng(1)
    phrase = draw.integers(0, 50_000, 40)
    parts = [phrase if draw.random() < 0.5 else draw.integers(0, 50_000, draw.integers(1, 30)) for _ in range(4000)]
    for ids in (
        np.concatenate(parts), np.zeros(5000), draw.integers(0, 3, 20_000), np.tile([7, 7, 7, 1], 900), np.array([5]), np.array([]),
        np.full(10, 2**32 - 2**20),
    ):
        ids = ids.astype(np.uint32)
        breaks = np.unique(np.concatenate([[0], draw.integers(0, max(len(ids), 1), 50)])) if len(ids) else np.zeros(0, dtype=np.int64)
        made = r.compress(ids, breaks)
        assert (r.expand(made["body"], made["base"], made["rules"], made["lengths"]) == ids).all()
        shard = {
            "base": made["base"], "rules": made["rules"].astype("<u8").tobytes(), "rule_lengths": made["lengths"].astype("<u4").tobytes(),
            "body": r.pack_symbols(made["body"]), "places": made["places"].astype("<i8").tobytes(),
        }
        for n in range(0, len(breaks), 7):
            end = breaks[n + 1] if n + 1 < len(breaks) else len(ids)
            assert (r.decode_document(shard, n) == ids[breaks[n] : end]).all()
        sizes = [len(r.expand(np.array([made["base"] + i], dtype=np.uint32), made["base"], made["rules"], made["lengths"])) for i in range(len(made["rules"]))]
        assert sizes == made["lengths"].tolist()
    repeated = r.compress(np.tile(phrase, 2000).astype(np.uint32), np.zeros(1, dtype=np.int64))
    assert len(repeated["body"]) < 80_000 / 20


def test_no_frequent_pair_is_left():
    draw = np.random.default_rng(2)
    ids = np.concatenate([np.minimum(draw.zipf(1.3, 200_000), 60_000), np.tile(draw.integers(0, 60_000, 300), 200)]).astype(np.uint32)
    breaks = np.arange(0, len(ids), 997)
    made = r.compress(ids, breaks)
    assert (r.expand(made["body"], made["base"], made["rules"], made["lengths"]) == ids).all()
    inside = np.ones(len(made["body"]) - 1, dtype=bool)
    inside[made["places"][1:] - 1] = False
    pairs = (made["body"][:-1].astype(np.uint64) << np.uint64(32) | made["body"][1:])[inside]
    kinds, counts = np.unique(pairs, return_counts=True)
    # Overlapping places of a pair of equal ids, as in a a a, can't all be replaced.
    differ = (kinds >> np.uint64(32)) != (kinds & np.uint64(0xFFFFFFFF))
    assert counts[differ].max() < r.LEAST_COUNT


def expected(tokenizer, rows):
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_hold_every_document(spark, docs, rows, tokenizer):
    out = scratch_path(spark, "tokens")
    r.write_tokens(docs, out, PATH, shard_ids=5000)
    found = sorted(map(tuple, r.read_tokens(spark, out).collect()), key=lambda x: x[1])
    ids = [x[0] for x in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [x[1] for x in found] == np.cumsum([0, *[x[2] for x in found]])[:-1].tolist()
    plain = expected(tokenizer, [(x[0], x[1]) for x in rows])
    assert sorted(repr((x[0], *x[2:])) for x in found) == sorted(repr((x[0], *x[2:])) for x in plain)


def test_query_and_empty_table(spark, tables, nothing, tokenizer):
    folder, plain = tables
    assert sorted(map(tuple, r.query(spark, folder).collect())) == sorted(expected(tokenizer, [(p[0], p[1]) for p in plain]))
    out = scratch_path(spark, "tokens")
    r.write_tokens(nothing, out, PATH)
    assert r.read_tokens(spark, out).count() == 0
