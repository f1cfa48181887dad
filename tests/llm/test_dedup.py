import hashlib
import random
from collections import Counter, defaultdict

import pytest
import xxhash

from shelfsight.llm import exact_dedup, simhash, substring
from shelfsight.llm.base import components


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def exact_by_hand(rows, keep):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        kept = False
        for i in sorted(ids, key=lambda i: i != best):
            out.append((i, best, len(ids), not kept and i == best, sha))
            kept = True
    return Counter(out)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("name", ["edge", "small", "clashing", "empty"])
def test_exact_groups(request, name, keep):
    docs = request.getfixturevalue(name)
    expected = exact_by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], keep)
    assert Counter(map(tuple, exact_dedup.exact_groups(docs.repartition(5), keep=keep, fan_in=2).collect())) == expected


def test_drop_copies(edge, clashing, empty):
    for docs in (edge, clashing):
        kept = exact_dedup.drop_copies(docs)
        assert kept.columns == docs.columns
        texts = [r.text or "" for r in kept.collect()]
        assert len(texts) == len(set(texts)) == len({r.text or "" for r in docs.collect()})
    assert exact_dedup.drop_copies(empty).count() == 0


def fingerprint_by_hand(text):
    ws = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(prints, bits):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("name", ["edge", "small", "clashing", "empty"])
def test_near_groups(request, name):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = [fingerprint_by_hand(t) for _, t in rows]
    roots = groups_by_hand(prints, 2)
    least = {r: min((d for (d, _), x in zip(rows, roots) if x == r and d is not None), default=None) for r in roots}
    expected = Counter((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, roots))
    found = simhash.near_groups(docs).select("doc_id", "fingerprint", "component_id", "kept").collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == expected
    kept = simhash.drop_near_copies(exact_dedup.drop_copies(docs))
    assert kept.columns == docs.columns and kept.count() == len(set(roots))


@pytest.mark.parametrize("bits", [1, 2])
@pytest.mark.parametrize("limit", [0, 3, 10_000])
def test_links_join_what_all_pairs_join(spark, bits, limit):
    """Near fingerprints in crowds of every size, with and without the way round large cells."""
    rng = random.Random(bits * 7 + limit)
    prints = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(12):
            near = center
            for _ in range(rng.randrange(5)):
                near ^= 1 << rng.randrange(64)
            prints.add(near)
    prints = sorted(prints)
    signed = [simhash._signed(p) for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.links(frame, max_bits=bits, pair_limit=limit)
    found = {r.node: r.root for r in components(links, "t").collect()}
    by_hand = groups_by_hand(prints, bits)
    same = defaultdict(set)
    for p, r in zip(signed, by_hand):
        same[r].add(p)
    ours = defaultdict(set)
    for p in signed:
        ours[found.get(p, p)].add(p)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, same.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 400)] + [(900, 901)], "u long, v long")
    assert {(r.node, r.root) for r in components(edges, "chain").collect()} == {(i, 0) for i in range(401)} | {(900, 900), (901, 900)}


def removed_by_hand(rows, window):
    seen, out = Counter(), []
    split = [words_of(t) for _, t in rows]
    for ws in split:
        seen.update(tuple(ws[i : i + window]) for i in range(len(ws) - window + 1))
    for (doc_id, _), ws in zip(rows, split):
        gone = {k for i in range(len(ws) - window + 1) if seen[tuple(ws[i : i + window])] > 1 for k in range(i, i + window)}
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc_id, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window", [9, 35])
@pytest.mark.parametrize("name", ["edge", "small", "clashing", "empty"])
def test_repeats(request, name, window):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = substring.remove_repeats(docs, window=window)
    assert Counter(map(tuple, found["documents"].collect())) == removed_by_hand(rows, window)
    for r in found["texts"].collect():
        assert all(s.after - s.first >= window for s in r.repeats) and sum(s.after - s.first for s in r.repeats) == r.n_removed
