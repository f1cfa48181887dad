import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfsight.llm import mixing, packing, sharding


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left, share = total - sum(fixed.values()), sum(w[s] for s in names if s not in fixed)
        over = [s for s in names if s not in fixed and left * w[s] / share > most * sizes[s]]
        if not over:
            return {s: fixed.get(s, left * w[s] / share if share else 0.0) for s in names}
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("name", ["edge", "small", "clashing", "empty"])
def test_mix(request, name):
    docs = request.getfixturevalue(name)
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len((r.text or "").encode().split())
    out = mixing.mix(docs)
    found = out["documents"].collect()
    assert Counter((r.doc_id, r["size"]) for r in found) == Counter((r.doc_id, len((r.text or "").encode().split())) for r in rows)
    expected, taken = targets_by_hand(sizes), defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source]) and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, t in expected.items():
        assert abs(taken[s] - t) <= 1.5 * mixing.BLOCK_WORDS + 1
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.mix(docs)["documents"].collect()), key=str)
    for r in found:  # a source's blocks are taken equally often, or once more
        per_block = r.target / r.source_size if r.source_size else 0
        assert int(per_block - 1e-9) * r["size"] - 1 <= r.taken <= -(-per_block // 1) * r["size"] + r["size"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    wanted, ours = Counter(), Counter()
    for r in found:
        wanted[r.doc_id, r.text_hash] += r.taken / r["size"] if r["size"] else 0
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"))
    rows_of = Counter(map(tuple, hashed.collect()))
    for r in mixed.select("doc_id", F.xxhash64("text").alias("h")).collect():
        ours[tuple(r)] += 1
    for k, n in rows_of.items():
        assert abs(ours[k] - wanted[k]) <= 0.5 * n + 1e-9


@pytest.mark.parametrize("cuts, blocks", [([0, 50, 70, 80], [30, 7, 10]), ([0, 1, 1, 900, 2000], [1, 5, 400, 2000])])
def test_schedule_by_hand(spark, cuts, blocks):
    """Every slot's source, rank, block and epoch, against a loop over the slots."""
    n = cuts[-1]
    frame = spark.createDataFrame([(i + 1, a, b, k) for i, (a, b, k) in enumerate(zip(cuts, cuts[1:], blocks))], "place int, first long, last long, n_blocks long")
    step, seen, expected = mixing.lattice_step(n), Counter(), set()
    for slot in range(n):
        place = next(i + 1 for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a <= slot * step % n < b)
        rank, k = seen[place], blocks[place - 1]
        seen[place] += 1
        if rank < 3 * k:
            expected.add((slot, place, rank, rank % k, rank // k))
    found = mixing.schedule(frame, n).select("slot", "place", "rank", "block", "epoch").collect()
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.target, r.taken) for r in mixing.mix(docs)["documents"].collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 4096, 99_991])
def test_lattice_visits_every_point_evenly(n):
    q = mixing.lattice_step(n)
    points = [k * q % n for k in range(n)]
    assert sorted(points) == list(range(n))
    half = [sum(p < n // 2 for p in points[: k + 1]) - (k + 1) * (n // 2) / n for k in range(min(n, 2000))]
    assert max(map(abs, half)) < 8


def smallest_by_hand(sizes, k):
    def fits(c):
        n, t = 1, 0
        for s in sizes:
            if t + s > c:
                n, t = n + 1, 0
            t += s
        return n <= k

    lo, hi = max(max(sizes), -(-sum(sizes) // k)), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("n, k, cells, most", [(1, 4, 4, 9), (5, 7, 4, 9), (60, 7, 8, 100), (60, 7, 1 << 16, 100), (3000, 40, 200, 1000), (3000, 40, 256, 60), (100_000, 40, 2000, 5000)])
def test_capacity_is_the_least(spark, n, k, cells, most):
    """Against brute force over all groups, with few cells, so that several levels are needed."""
    rng = np.random.default_rng(n + cells)
    sizes = rng.integers(1, most, n)
    ends = np.cumsum(sizes).tolist()
    frame = spark.createDataFrame([(e,) for e in ends], "end long")
    capacity, cuts = sharding.shard_ends(frame, ends[-1], int(sizes.max()), shards=k, cells=cells)
    assert capacity == smallest_by_hand(sizes.tolist(), k)
    assert len(cuts) == k and cuts[-1] == ends[-1] and set(cuts) <= set(ends)
    assert max(b - a for a, b in zip([0, *cuts], cuts)) == capacity


@pytest.mark.parametrize("heavy, cells", [(0, 1 << 16), (1, 50), (2, 50)])
def test_huge_groups_stand_alone(spark, heavy, cells):
    rng = np.random.default_rng(heavy)
    sizes = [int(x) for x in rng.integers(20, 100, 400)] + [9000 + j for j in range(heavy)]
    rows = [(int(h), i, s) for i, (h, s) in enumerate(zip(rng.integers(-(2**63), 2**63 - 1, len(sizes)), sizes))]
    found = sharding.with_shard(spark.createDataFrame(rows, "text_hash long, text_crc32 long, size long"), shards=40, cells=cells).collect()
    total = defaultdict(int)
    for r in found:
        total[r.shard] += r["size"]
    order = sorted(rows, key=lambda r: (r[2] < 9000, -r[2] if r[2] >= 9000 else 0, r))
    assert len(found) == len(rows) and set(total) == set(range(40)) and max(total.values()) == smallest_by_hand([r[2] for r in order], 40)
    light = [t for t in total.values() if t < 9000]
    assert len(light) == 40 - heavy and max(light) < 2 * sum(light) / len(light)
    place = {r[1]: i for i, r in enumerate(order)}
    shards = [r.shard for r in sorted(found, key=lambda r: place[r.text_crc32])]
    assert shards == sorted(shards)


@pytest.mark.parametrize("name", ["edge", "small", "clashing", "empty"])
def test_shards(request, name):
    docs = request.getfixturevalue(name)
    rows = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    found = sharding.shard_documents(docs, cells=64).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == rows
    slots, by_text = defaultdict(list), defaultdict(set)
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 40
        slots[r.shard].append(r.slot), by_text[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in by_text.values())


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_the_tokenizers(tokenizer):
    ids = packing.encoder(packing.token_file(), packing.SPECIAL)
    for text in ["", " ", "a  b", " lead", "trail ", "a \n b", "\n\n  x", "a\xa0 b", "<|endoftext|> x", "Ünï cödé's don't", "12 34\r\n"]:
        assert np.frombuffer(ids(text), "<u4").tolist() == tokenizer(text)


@pytest.mark.parametrize("chunk", [300, packing.CHUNK_TOKENS])
@pytest.mark.parametrize("name", ["edge", "small", "clashing", "empty"])
def test_packing(request, name, chunk, tokenizer):
    docs = request.getfixturevalue(name)
    pieces = packing.pack_documents(docs, chunk_tokens=chunk).collect()
    expected = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = tokenizer(r.text or "") + [1]
        expected[r.doc_id] += len(ids)
    got, sequences = Counter(), defaultdict(list)
    for p in pieces:
        got[p.doc_id] += p.length
        sequences[p.sequence_id].append(p)
    assert got == expected
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].append(np.array(tokenizer(r.text or "") + [1], "<u4"))
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        n = sum(p.length for p in s)
        assert n <= 2048 and n & (n - 1) == 0
        assert [p.offset for p in s] == np.cumsum([0] + [p.length for p in s])[:-1].tolist()
        for p in s:
            assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in texts[p.doc_id])


def test_rows_are_told_apart_and_ids_keep_their_type(spark):
    docs = spark.createDataFrame([("a", "one two"), ("a", "one two"), (None, "x")], "doc_id string, text string")
    pieces = packing.pack_documents(docs.coalesce(1)).collect()
    by_row = defaultdict(int)
    for p in pieces:
        by_row[p.row_id, p.doc_id, p.doc_tokens] += p.length
    assert len(by_row) == 3 and all(n == k for (_, _, k), n in by_row.items()) and Counter(d for _, d, _ in by_row) == {"a": 2, None: 1}


def test_pack_covers_each_token_once():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 500):
        lengths = rng.integers(1, 5000, n).tolist()
        seen = Counter()
        for tier, s in packing.pack(lengths):
            assert sum(k for _, _, k in s) == tier
            for d, a, k in s:
                seen.update((d, x) for x in range(a, a + k))
        assert seen == Counter((d, x) for d, k in enumerate(lengths) for x in range(k))


def test_end_of_text_inside_a_text_is_one_id(spark):
    """As in a Tokenizer with default settings."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>  b", "x<|endoftext|><|endoftext|>\n\ny", "<|endoftext|", "don't <|ENDOFTEXT|> \n<|endoftext|>'s 12", "é <|endoftext|>\u00a0"]
    wanted = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    ids = packing.encoder(packing.token_file(), packing.SPECIAL)
    assert [np.frombuffer(ids(t), "<u4").tolist() for t in texts] == wanted and wanted[0] == [50256]
    pieces = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {p.doc_id: p.doc_tokens for p in pieces} == {i: len(w) + 1 for i, w in enumerate(wanted)}


def test_step_groups_are_balanced(spark):
    docs = spark.range(40).selectExpr("id as doc_id", "repeat('a b c d ', 1300) as text").coalesce(1)
    pieces = packing.pack_documents(docs).select("tier", "step_group", "sequence_id").distinct().collect()
    sizes = defaultdict(Counter)
    for p in pieces:
        sizes[p.tier][p.step_group] += 1
    assert len(sizes[2048]) > 1
    for tier, groups in sizes.items():
        assert max(groups.values()) - min(groups.values()) <= 1 and max(groups.values()) * tier <= packing.STEP_TOKENS
        assert len(groups) == -(-sum(groups.values()) // (packing.STEP_TOKENS // tier))
