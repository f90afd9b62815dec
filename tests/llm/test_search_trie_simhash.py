"""Ranked search, prefix tries and SimHash against plain versions of their contracts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from inkwell.llm import lexical_search, prefix_trie, simhash
from inkwell.llm.lexical_search import build_index, search, search_index
from inkwell.llm.prefix_trie import rebuilt_trie
from inkwell.llm.simhash import simhash_duplicates
from inkwell.llm.wavelet import Cut, bits_for, planes

A_Z = {c: c + 32 for c in range(65, 91)}


# Ranked search.
def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(A_Z))


def ranked(documents, items, k=50):
    """(item_id, rank, doc_id, score), each document scored for each item; a null doc_id is the smallest."""
    each = [(i, Counter(terms_of(t))) for i, t in documents]
    n_docs, n_terms = sum(1 for _, c in each if c), sum(sum(c.values()) for _, c in each)
    df = Counter(t for _, c in each for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in each:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if c[t])
            if score > 0:
                found.append((-score, -(1 << 63) if i is None else i, i, score))
        out += [(item, n + 1, i, score) for n, (_, _, i, score) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def some_items(rows):
    r = random.Random(2)
    texts = [" ".join(r.sample((t or "x").split() or ["x"], min(9, len((t or "x").split() or ["x"])))) for _, t, *_ in rows[::5]]
    return [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (902, "never seen here"), (903, texts[3]), (903, texts[3]), (None, texts[4]), (904, "ONE one, Naïve 数据 é")]


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 14, 1 << 22), (3000, 7, 60)])
def test_search_ranks_like_scoring_every_document(spark, rows, docs, monkeypatch, sizes):
    """In one shard and block, and in many, with texts cut into pieces."""
    shard_bytes, shard_docs, piece = sizes
    documents = [(i, t) for i, t, *_ in rows]
    items = some_items(rows)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", shard_bytes)
    queries = spark.createDataFrame(items, "item_id long, text string")
    # Tasks import the module anew: their sizes go with the function.
    run = lexical_search._shards
    monkeypatch.setattr(lexical_search, "_shards", lambda n, m: with_sizes(run(n, m), shard_bytes, shard_docs, piece))
    got = sorted(map(tuple, search(docs, queries).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == ranked(documents, items)


def with_sizes(run, shard_bytes, shard_docs, piece):
    def inside(frames):
        from inkwell.llm import lexical_search as module

        before = module.SHARD_BYTES, module.SHARD_DOCS, module.PIECE
        module.SHARD_BYTES, module.SHARD_DOCS, module.PIECE = shard_bytes, shard_docs, piece
        yield from run(frames)
        module.SHARD_BYTES, module.SHARD_DOCS, module.PIECE = before

    return inside


def test_search_of_odd_and_empty_tables(spark, odd, nothing):
    items = [(1, "a another text no id"), (2, None)]
    queries = spark.createDataFrame(items, "item_id long, text string")
    documents = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, search(odd, queries, k=7).collect()), key=str) == ranked(documents, items, 7)
    assert search(nothing, queries).isEmpty() and search(odd, queries.limit(0)).isEmpty()


def test_index_holds_every_document_and_term(spark, docs, rows):
    index, n = build_index(docs)
    shards = index.collect()
    assert sorted(x for s in shards for x in np.frombuffer(s["doc_ids"], np.int64)) == sorted(r[0] for r in rows) and n == sum(1 for r in rows if terms_of(r[1]))
    held = Counter()
    for s in shards:
        held.update(dict(zip(s["terms"], s["dfs"], strict=True)))
    assert held == Counter(t for r in rows for t in set(terms_of(r[1])))
    one = spark.createDataFrame([(5, rows[6][1])], "item_id long, text string")
    assert search_index(index, one, n, k=1).first()["rank"] == 1


def test_wavelet_cuts_find_the_best():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n_docs, n_terms, k = int(rng.integers(1, 90)), int(rng.integers(1, 12)), int(rng.integers(1, 9))
        lists = [rng.choice(n_docs, rng.integers(0, n_docs + 1), replace=False) for _ in range(n_terms)]
        impacts = [np.sort(rng.integers(1, 6, len(x)))[::-1] for x in lists]
        sizes = np.array([len(x) for x in lists])
        ends = np.cumsum(sizes)
        some = np.sort(rng.choice(n_terms, rng.integers(1, n_terms + 1), replace=False))
        cut = Cut(planes(np.concatenate(lists), bits_for(n_docs)), int(ends[-1]), np.concatenate(impacts).astype(np.int32), (ends - sizes)[some], ends[some])
        weights = rng.integers(0, 4, len(some))
        want = Counter()
        for j, w in zip(some, weights, strict=True):
            for d, v in zip(lists[j], impacts[j], strict=True):
                want[int(d)] += int(w) * int(v)
        order = sorted((s for s in want.values() if s > 0), reverse=True)
        docs, scores = cut.top(np.arange(len(some)), weights, k, 1)
        # All that reach the k-th score, each with its own score.
        assert {int(d): int(s) for d, s in zip(docs, scores, strict=True)} == {d: s for d, s in want.items() if s > 0 and s >= (order[k - 1] if len(order) >= k else 1)}


# Prefix tries.
def trie_of(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(x[2], x[3]) for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for n in nodes:
        if n:
            children.setdefault(n[:-1], []).append(n)
    out, leaves, saved = [], {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        below = children.get(n, [])
        leaves[n] = sum(leaves[x] for x in below) or 1
        saved[n] = ((len(nodes[n]) - 1) * len(n[-1][1]) if n else 0) + sum(saved[x] for x in below)
        ends = ",".join(str(c) for c in sorted(nodes[n]) if len(built[c]) == len(n))
        parent = min(nodes[n[:-1]]) if n else None
        out.append((min(nodes[n]), len(n), parent, len(nodes[n]), len(below), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def some_turns(seed):
    r = random.Random(seed)
    rows = [(c, r.choice([t, t, t, None]), r.choice(["u", "a", None]), r.choice(["x", "yy", None, "é", "\U0001f600z"])) for c in [*range(-150, 150, 7), *range(1000, 1030), 2, 3] for t in range(r.randint(1, 9))]
    rows += [(5001, k, "u", "long") for k in range(60)] + [(5000, k, "u", "long") for k in range(80)]
    rows += [(7000 + k, j, "u", "stair") for k in range(30) for j in range(k)]
    return rows + rows[:9] + [(None, 1, "u", "x"), (8, None, None, None)]


@pytest.mark.parametrize(("block", "task_bytes"), [(4096, 64 << 20), (7, 300)])
def test_trie_like_all_prefixes(spark, monkeypatch, block, task_bytes):
    """Also with conversations that lie in several ranges and blocks of depths."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "TASK_BYTES", task_bytes)
    rows = some_turns(block)
    got = rebuilt_trie(spark.createDataFrame(rows, TURNS).repartition(5))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns == columns and sorted(map(tuple, got.collect()), key=str) == trie_of(rows)


def test_trie_of_odd_and_empty_tables(spark):
    extra = spark.createDataFrame([(1, 0, "u", "a", 5, "x"), (1, 1, "u", "b", 5, None), (101, 0, "u", "a", 5, "x")], TURNS + ", depth int, n_convs string")
    assert sorted(map(tuple, rebuilt_trie(extra).collect()), key=str) == trie_of([tuple(r)[:4] for r in extra.collect()])
    assert rebuilt_trie(spark.createDataFrame([], TURNS)).isEmpty()
    assert rebuilt_trie(spark.createDataFrame([(None, 1, "u", "x")], TURNS)).isEmpty()
    # A conversation may be left without turns; the root holds it.
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in range(1, 100)}
    short = next(c for c in h if h[c] >= 2)
    assert [tuple(r)[:6] for r in rebuilt_trie(spark.createDataFrame([(short, 0, "u", "a")], TURNS)).collect()] == [(short, 0, None, 1, 0, 1)]


def test_nodes_of_many_ends_are_hashed_in_parts():
    import pandas as pd

    ids = list(range(100))
    frame = pd.DataFrame({"owner": [0] * 60 + [1] * 40, "n_turns": [2] * 100, "conv_id": ids})
    got = pd.concat(prefix_trie._ends(iter([frame[:10], frame[10:61], frame[61:]])))
    want = [hashlib.sha256(",".join(map(str, part)).encode()).hexdigest() for part in (ids[:60], ids[60:])]
    assert got["ends_sha256"].tolist() == want


# SimHash.
def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(A_Z))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), seed=42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(values, near):
    """The least of each value's group under a relation, by comparing all pairs."""
    values, of = sorted(set(values)), {}
    for v in values:
        joined = {of[w] for w in of if near(v, w)}
        least = min([v, *joined])
        of = {w: least if g in joined else g for w, g in of.items()} | {v: least}
    return of


def duplicates_of(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    of = grouped([f for _, f in prints], lambda a, b: (a ^ b).bit_count() <= 3)
    key = lambda i: -(1 << 63) if i is None else i
    least = {}
    for i, f in prints:
        least[of[f]] = min(least.get(of[f], i), i, key=key)
    return sorted(((i, f"{f:016x}", least[of[f]]) for i, f in prints), key=str)


def test_simhash_like_all_pairs(docs, rows):
    r = random.Random(8)
    words = rows[9][1].split()
    near = []
    for k in range(60):
        changed = list(words)
        changed[r.randrange(len(words))] = f"w{k % 7}"
        near.append((10_000 + k, " ".join(changed), "en", "web", 1))
    df = docs.union(docs.sparkSession.createDataFrame(near, docs.schema))
    got = sorted(map(tuple, simhash_duplicates(df).collect()), key=str)
    assert got == duplicates_of([(x[0], x[1]) for x in rows + near])
    assert len({c for _, _, c in got}) < len({f for _, f, _ in got})


def test_simhash_of_odd_and_empty_tables(odd, nothing):
    assert sorted(map(tuple, simhash_duplicates(odd).collect()), key=str) == duplicates_of([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert simhash_duplicates(nothing).isEmpty()


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = " ".join(random.Random(1).choices(["a", "bb", "c", "dé"], k=500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_crowded_lists_lose_no_link():
    """Lists of many fingerprints that agree in five bytes, by pairs and by the table of their open bits."""
    rng = np.random.default_rng(5)
    for positions in ((0, 1, 2), (1, 4, 7)):
        values = {0x0123456789ABCDEF}
        for _ in range(500):
            v = int(rng.choice(sorted(values))) if len(values) < 3 else sorted(values)[int(rng.integers(len(values)))]
            for _ in range(int(rng.integers(1, 6))):
                v ^= 1 << int(8 * positions[int(rng.integers(3))] + rng.integers(8))
            values.add(v)
        values = np.array(sorted(values), np.uint64)
        want = grouped([int(v) for v in values], lambda a, b: (a ^ b).bit_count() <= 3)
        labels = simhash.linked_in_crowd(values, positions)
        assert {int(v): int(values[k]) for v, k in zip(values, labels, strict=True)} == want
        at = simhash.OPEN.index(positions)
        large = simhash.linked_in_lists([values], np.array([at]))
        assert dict(zip(map(int, large[0]), map(int, large[1]), strict=True)) == {v: g for v, g in want.items() if v != g}
        small = simhash.linked_in_lists([values[:200]], np.array([at]))
        assert dict(zip(map(int, small[0]), map(int, small[1]), strict=True)) == {v: g for v, g in grouped([int(v) for v in values[:200]], lambda a, b: (a ^ b).bit_count() <= 3).items() if v != g}
