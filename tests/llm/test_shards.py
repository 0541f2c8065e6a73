import zlib

from pyspark.sql import functions as F

from quillvec.llm import hilbert_shards as h


def test_curve_visits_every_cell_by_single_steps(spark):
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        axes = [((F.col("id") / 2 ** (bits * i)).cast("long") % 2**bits).alias(f"x{i}") for i in range(n)]
        grid = spark.range(2 ** (n * bits)).select(*axes)
        cells = grid.withColumn("h", h.curve_index([F.col(f"x{i}") for i in range(n)], bits)).orderBy("h").collect()
        assert [r["h"] for r in cells] == list(range(2 ** (n * bits)))
        for a, b in zip(cells, cells[1:]):
            assert sum(abs(x - y) for x, y in zip(a[:n], b[:n])) == 1


def test_shards_are_near_equal_and_slots_gapless(spark):
    rows = [(i, "x" * ((37 * i) % 400), ["en", "de", None][i % 3], f"s{i % 9}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    out = h.shard_by_curve(docs, "doc_id", h.text_size(F.col("text")), F.col("doc_id"), h.document_dims(), {}).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(3000))
    size, slots = {}, {}
    for r in out:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append((r["slot"], r["curve"]))
    assert sorted(size) == list(range(16)) and max(size.values()) - min(size.values()) <= 2 * 401
    last = -1
    for s in range(16):
        assert sorted(x for x, _ in slots[s]) == list(range(len(slots[s])))
        curves = [c for _, c in sorted(slots[s])]
        assert curves == sorted(curves) and curves[0] >= last
        last = curves[-1]


def test_groups_stay_whole_unless_too_large(spark):
    rows = [(i, f"text {i % 500}" if i % 2 else "the hot copy") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.col("doc_id").cast("string")})
    out = h.shard_by_curve(docs, "doc_id", h.text_size(F.col("text")), F.xxhash64("text"), h.document_dims(), {"text": F.col("text")}).collect()
    shards = {}
    for r in out:
        shards.setdefault(r["text"], set()).add(r["shard"])
    split = [t for t, s in shards.items() if len(s) > 1]
    assert split == ["the hot copy"]


def plain_cut(rows, shards):
    """(key, size, group, curve) -> {key: (shard, slot)}, row by row."""
    lead, size, copies = {}, {}, {}
    for key, n, group, curve in rows:
        lead[group] = min(lead.get(group, (key, curve)), (key, curve))
        size[group] = size.get(group, 0) + n
        copies[group] = copies.get(group, 0) + 1
    total = sum(size.values())
    order = sorted((lead[g][1], g, k, n) for k, n, g, _ in rows)
    at, start = 0, {}
    for _, g, _, n in order:
        start.setdefault(g, at)
        at += n
    taken, home = [0] * shards, {}
    for g in sorted(size, key=lambda g: (-size[g], start[g])):
        if copies[g] > 1 and total < size[g] * h.SMALL * shards and size[g] * shards <= total:
            own = min(shards - 1, shards * (2 * start[g] + size[g]) // (2 * total))
            for s in (own, taken.index(min(taken))):
                if (taken[s] + size[g]) * shards <= total:
                    taken[s] += size[g]
                    home[g] = s
                    break
    ends = [sum(total / shards - t for t in taken[: s + 1]) for s in range(shards)]
    slots, out, at, start = [0] * shards, {}, 0, {}
    for _, g, k, n in [o for o in order if o[1] not in home]:
        start.setdefault(g, at)
        whole = copies[g] > 1 and size[g] * h.SMALL * shards <= total
        middle = start[g] + size[g] / 2 if whole else at + n / 2
        s = sum(middle >= e for e in ends[:-1])
        out[k] = (s, slots[s])
        slots[s] += 1
        at += n
    for _, g, k, n in [o for o in order if o[1] in home]:
        out[k] = (home[g], slots[home[g]])
        slots[home[g]] += 1
    return out


def test_groups_that_fit_a_shard_stay_whole(spark):
    """Groups from a tenth of a shard to nearly one, one larger than a shard, and more than there is room for."""
    for large in ((30, 60, 95, 130, 200, 220), (150,) * 20):
        rows, key = [], 0
        for g, copies in enumerate(large):
            rows += [(key + i, f"group {g:4}" + "y" * 54) for i in range(copies)]
            key += copies
        rows += [(key + i, f"text {i:5}" + "x" * (i % 107)) for i in range(4000 - len(rows))]
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": (F.col("doc_id") % 7).cast("string")}).repartition(5)
        out = h.shard_by_curve(docs, "doc_id", h.text_size(F.col("text")), F.xxhash64("text"), h.document_dims(), {"group": F.xxhash64("text")}).collect()
        assert {r["doc_id"]: (r["shard"], r["slot"]) for r in out} == plain_cut([(r["doc_id"], r["size"], r["group"], r["curve"]) for r in out], 16)
        size, shards, held = {}, {}, {}
        for r in out:
            size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
            shards.setdefault(r["group"], set()).add(r["shard"])
            held[r["group"]] = held.get(r["group"], 0) + r["size"]
        share = sum(size.values()) / 16
        assert max(size.values()) - min(size.values()) <= share / 10
        split = sorted(held[g] for g, s in shards.items() if len(s) > 1)
        # One group of each shard's room fits; what is left over is cut.
        assert all(n > share for n in split) if len(large) == 6 else len(split) <= 20 - 16


def test_the_whole_source_decides(spark):
    """Sources with a common beginning have places of their own on the curve, so a shard holds few of them."""
    rows = [(i, "x" * 100, "en", f"https://example.org/crawl/{(7 * i) % 8}") for i in range(3200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    out = h.shard_by_curve(docs, "doc_id", h.text_size(F.col("text")), F.col("doc_id"), h.document_dims(), {"source": F.col("source")}).collect()
    places = {}
    for r in out:
        places.setdefault(r["source"], set()).add(r["curve"])
    assert len(out) == 3200 and all(len(p) == 1 for p in places.values()) and len(set.union(*places.values())) == 8
    for s in range(16):
        assert len({r["source"] for r in out if r["shard"] == s}) <= 2


def test_a_range_bound_inside_a_group_does_not_cut_it(spark, monkeypatch):
    ranged = h.running
    monkeypatch.setattr(h, "running", lambda *a: ranged(*a).withColumn("_part", F.col("row_index")))
    rows = [(i, f"text {i % 1300:05}", "en", f"s{i % 9}") for i in range(6500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    out = h.shard_by_curve(docs, "doc_id", h.text_size(F.col("text")), F.xxhash64("text"), h.document_dims(), {"text": F.col("text")}).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(6500))
    shards, slots = {}, {}
    for r in out:
        shards.setdefault(r["text"], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in shards.values())
    assert sorted(slots) == list(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_query(spark, tables):
    folder, plain = tables
    out = h.query(spark, folder).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(p[0] for p in plain)
    text = {p[0]: p[1] or "" for p in plain}
    for r in out:
        data = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "bytes")
    assert {(r["shard"], r["slot"]) for r in out} and len({(r["shard"], r["slot"]) for r in out}) == len(out)


def test_odd_rows_and_stage(spark, docs, rows, nothing):
    out = h.stage(spark, docs, "")
    assert out.columns == [c for c in docs.columns if c != "shard"] + ["shard", "curve"]
    assert sorted(repr((r["doc_id"], r["text"])) for r in out.collect()) == sorted(repr((r[0], r[1])) for r in rows)
    assert h.stage(spark, nothing, "").count() == 0
