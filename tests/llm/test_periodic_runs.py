import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quillvec.llm import periodic_runs as p


def plain_runs(words):
    """Every lag, every stretch of equal words: (start, length, smallest period)."""
    found, n = {}, len(words)
    for lag in range(1, n // 2 + 1):
        i = 0
        while i < n - lag:
            if words[i] != words[i + lag]:
                i += 1
                continue
            start = i
            while i < n - lag and words[i] == words[i + lag]:
                i += 1
            length = i - start + lag
            if length >= max(12, 2 * lag):
                found.setdefault((start, length), lag)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def streams():
    draw = random.Random(3)
    yield from ([], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 300, ["a", "b"] * 6, ["a", "b", "c"] * 40 + ["a"], fibonacci(600))
    yield ["x", *"abcdefg" * 2, "y"]
    for size in (2, 3, 5, 50):
        for n in (13, 40, 200, 700):
            yield [str(draw.randrange(size)) for _ in range(n)]
    for _ in range(25):
        out = []
        while len(out) < 300:
            part = [str(draw.randrange(30)) for _ in range(draw.randint(1, 60))]
            out += part * draw.choice([1, 1, 2, 3, 7]) + part[: draw.randint(0, len(part))]
        yield out


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 17])
def test_runs_like_plain(monkeypatch, chunk):
    monkeypatch.setattr(p, "CHUNK", chunk)
    some = list(streams())[:: 1 if chunk > 7 else 5]
    known = {}
    numbers = np.array([known.setdefault(w, len(known)) for s in some for w in s], dtype=np.int64)
    owner, runs = p.runs_of(numbers, np.concatenate([[0], np.cumsum([len(s) for s in some])]))
    for i, s in enumerate(some):
        assert [tuple(r) for r in runs[owner == i].tolist()] == plain_runs(s)


def test_long_period_in_a_long_text():
    draw = np.random.default_rng(1)
    part = draw.integers(0, 1000, 20_000)
    numbers = np.concatenate([draw.integers(1000, 2000, 5), part, part, part[:500], [5000]])
    owner, runs = p.runs_of(numbers, np.array([0, len(numbers)]))
    assert runs.tolist() == [[5, 40_500, 20_000]] and owner.tolist() == [0]
    _, runs = p.runs_of(np.zeros(300_000, dtype=np.int64), np.array([0, 300_000]))
    assert runs.tolist() == [[0, 300_000, 1]]


def plain_row(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        q = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % q] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query_like_plain(spark, tmp_path):
    draw = random.Random(5)
    texts = [" ".join(s) for s in streams()] + [None, "", " \n\t", " lead and tail \n", "é ü x \x1f y 　 z", "a\x0bb\x0cc\rd " * 9]
    texts += [" ".join(str(draw.randrange(400)) for _ in range(draw.randint(1, 300))) for _ in range(400)]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = p.query(spark, str(tmp_path))
    columns = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got = sorted(tuple(r[c] for c in columns) for r in found.collect())
    assert got == sorted(plain_row(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 60


def test_odd_rows(spark, docs, rows, nothing):
    found = p.periodic_runs(docs).collect()
    assert len(found) == len(rows)
    by_id = sorted((repr(r["doc_id"]), r["collapsed"], r["n_words"]) for r in found)
    plain = []
    for r in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", r[1] or "") if w]
        gone = {i for s, n, q in (plain_runs(words) if len(words) < 1000 else []) for i in range(s + q, s + n)}
        plain.append((repr(r[0]), " ".join(w for i, w in enumerate(words) if i not in gone), len(words)))
    assert by_id == sorted(plain)
    assert p.periodic_runs(nothing).count() == 0
    assert p.looped(nothing.select("doc_id", "text")).count() == 0
