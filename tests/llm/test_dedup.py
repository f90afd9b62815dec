import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from inkwell.llm.decontamination import find_contamination, item_blocks, remove_contaminated
from inkwell.llm.near_dedup import drop_near_duplicates, near_duplicates
from inkwell.llm.substring_dedup import dedup_substrings, substring_digest
from inkwell.llm.suffix_dedup import dedup_repeated_bytes, removed_digest
from inkwell.llm.suffix_sort import deep_shallow, neighbours_share

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def runs(gone):
    return sum(b and not a for a, b in zip([False, *gone], gone, strict=False))


@given(st.lists(st.tuples(st.integers(0, 2), st.lists(st.sampled_from([0, 1, 255]), max_size=40)), min_size=1, max_size=30))
def test_deep_shallow_sorts(cases):
    keys = np.array([k for k, _ in cases], np.uint64)
    rows = np.zeros((len(cases), 64), np.uint8)
    for k, (_, s) in enumerate(cases):
        rows[k, : len(s)] = s
    lengths = np.array([len(s) for _, s in cases])
    order = deep_shallow(keys, rows, lengths, 0)
    padded = [(cases[k][0], rows[k].tobytes()[:16], bytes(cases[k][1])) for k in order]
    assert padded == sorted(padded)
    shares = neighbours_share(keys, rows, lengths, order)
    for a, b, n in zip(order[:-1], order[1:], shares[1:], strict=True):
        s, t = cases[a][1], cases[b][1]
        same = 0 if cases[a][0] != cases[b][0] else next((k for k in range(min(len(s), len(t))) if s[k] != t[k]), min(len(s), len(t)))
        assert n == same


def test_repeated_bytes_go(docs, rows):
    raw = {i: (t or "").encode() for i, t, *_ in rows}
    seen = Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    got = by_id(removed_digest(dedup_repeated_bytes(docs)))
    assert len(got) == len(rows)
    for i, b in raw.items():
        gone = [False] * len(b)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        assert tuple(got[i])[:5] == (i, len(b), sum(gone), runs(gone), hashlib.sha256(kept).hexdigest()), i


def test_bytes_of_a_hot_passage_go(spark):
    """A passage in nearly all documents, at every offset, cut at both ends, in many blocks and under one doc_id, too."""
    import random

    r = random.Random(12)
    passage = bytes(r.randrange(97, 123) for _ in range(700)).decode()
    text = lambda n: "".join(r.choice("abc é\n") for _ in range(n))
    rows = [(k % 400 if k % 5 else None, text(r.randrange(60)) + passage[r.randrange(300) :][: r.randrange(180, 500)] + text(r.randrange(60))) for k in range(600)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long").repartition(6)
    seen = Counter(b[k : k + 200] for b in (t.encode() for _, t in rows) for k in range(len(b) - 199))
    want = []
    for i, t in rows:
        b = t.encode()
        gone = [False] * len(b)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        want.append((i, len(b), sum(gone), runs(gone), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    for block_bytes in (4096, 1 << 20):
        got = removed_digest(dedup_repeated_bytes(df, block_bytes=block_bytes)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_repeated_windows_go(docs, rows):
    seen, got = set(), by_id(substring_digest(dedup_substrings(docs)))
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert tuple(got[i])[:4] == (i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), i


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def components(rows, width):
    sets = {i: shingles(t, width) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates(docs, rows):
    for width in (2, 5):
        got = {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in by_id(near_duplicates(docs, width)).items()}
        assert got == components(rows, width)


def test_near_duplicates_in_a_large_group(spark):
    """Chains of copies, each a few words from the last, beside thousands of equal ones."""
    import random

    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows, words = [], list(base)
    for k in range(120):
        if k % 3 == 0:
            words = list(words)
            words[r.randrange(120)] = f"v{k}"
        rows.append((k * 7 % 121, " ".join(words)))
    rows += [(1000 + k, " ".join(base[:60])) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {i: (x["n_shingles"], x["component_id"], x["kept"]) for i, x in by_id(near_duplicates(df, 2)).items()}
    assert got == components(rows, 2)


def test_one_of_each_group_stays(docs, rows):
    want = {i for i, (_, _, kept) in components(rows, 5).items() if kept}
    assert {r["doc_id"] for r in drop_near_duplicates(docs).collect()} == want
    assert drop_near_duplicates(docs).columns == docs.columns


def test_null_and_reused_ids_are_rows_of_their_own(spark):
    import random

    r = random.Random(8)
    prose = lambda: " ".join(f"w{r.randrange(3000)}" for _ in range(60))
    a, b, c, d, e, f, g, h = (prose() for _ in range(8))
    rows = [
        (None, a), (None, b), (5, a + " tail"), (None, c), (6, c.upper()),  # 5 and 6 go, to null ids
        (7, d), (7, e), (3, e + " tail"), (9, d + " tail"),  # of 7 one text goes to 3, the other stays and takes 9
        (8, f), (8, f), (8, f + " tail"), (None, g), (None, g), (-(1 << 63), h), (None, h),
        (None, None), (None, ""), (None, " "), (4, None), (4, None),
    ]
    df = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "doc_id long, text string, n_chars int").repartition(4)
    out = drop_near_duplicates(df)
    got = Counter((x["doc_id"], x["text"]) for x in out.collect())
    assert out.columns == df.columns
    eights = [x for x in got if x[0] == 8]
    assert len(eights) == 1 and eights[0] in ((8, f), (8, f + " tail"))
    hs = [x for x in got if x[1] == h]
    assert len(hs) == 1
    rest = [x for x in got.elements() if x not in (*eights, *hs)]
    want = [(None, a), (None, b), (None, c), (7, d), (3, e + " tail"), (None, g), (None, None), (None, ""), (None, " "), (4, None), (4, None)]
    assert Counter(rest) == Counter(want) and got[eights[0]] == got[hs[0]] == 1


def items(rows):
    long = next(t for _, t, *_ in rows if t and len(t) > 50_000).split()
    return [(1, " ".join(long[500:540])), (2, " ".join(long[900:930]).upper()), (3, "two words"), (4, None), (5, ""), (6, "not in any of the documents here"), (7, " ".join(long[100:130] + ["changed"] * 2)), (None, "one"), (8, "one"), (None, " ".join(long[3000:3400])), (9, " ".join([*long[5000:5090], *["other"] * 15])), (10, " ".join([*long[5000:5090], *["other"] * 25]))]


def test_contamination(spark, docs, rows):
    benchmark = spark.createDataFrame(items(rows), "item_id long, text string")
    want = set()
    for i, text, *_ in rows:
        words = WORD.findall((text or "").translate(LOWER))
        for item, wanted in items(rows):
            width = min(5, len(WORD.findall(wanted or "")))
            if not width:
                continue
            own = shingles(wanted, width)
            both = len(own & {tuple(words[k : k + width]) for k in range(len(words) - width + 1)})
            if 100 * both >= 80 * len(own):
                want.add((i, item, both, len(own)))
    assert {tuple(r)[:4] for r in find_contamination(docs, benchmark).collect()} == want
    assert {tuple(r)[:4] for r in find_contamination(docs, benchmark, block_bytes=300).collect()} == want
    clean = {r["doc_id"] for r in remove_contaminated(docs, benchmark).collect()}
    assert clean == {i for i, *_ in rows} - {i for i, *_ in want}
    assert sum(len(b) for b in item_blocks(benchmark, 300)) == benchmark.count()


def test_null_ids_are_searched(spark):
    words = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(None, f"before {words} after"), (None, "clean"), (1, words.upper()), (2, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, words), (5, None)], "item_id long, text string")
    assert sorted((tuple(r)[:4] for r in find_contamination(docs, benchmark).collect()), key=str) == [(1, None, 26, 26), (None, None, 26, 26)]
    assert {(r["doc_id"], r["text"]) for r in remove_contaminated(docs, benchmark).collect()} == {(None, "clean"), (2, None)}


def test_odd_and_empty_tables(spark, odd, nothing):
    n = odd.count()
    assert dedup_repeated_bytes(odd).count() == dedup_substrings(odd).count() == near_duplicates(odd).count() == n
    assert dedup_repeated_bytes(nothing).count() == dedup_substrings(nothing).count() == near_duplicates(nothing).count() == 0
    assert drop_near_duplicates(odd).columns == odd.columns and drop_near_duplicates(nothing).count() == 0
    benchmark = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    assert find_contamination(odd, benchmark.limit(0)).count() == find_contamination(nothing, benchmark).count() == 0
    assert remove_contaminated(odd, benchmark).columns == odd.columns
    assert remove_contaminated(odd, benchmark.limit(0)).count() == n


def test_copies_lose_nothing_but_repeats(odd):
    kept = defaultdict(int)
    for r in dedup_substrings(odd).collect():
        kept[r["n_removed"] > 0] += 1
    assert kept[False] > 0


def crowd(seed, n):
    """Texts of one template, of similarity 0.74 to each other."""
    r = np.random.default_rng(seed)
    template = [f"w{k}" for k in r.integers(0, 900, 200)]
    rows = []
    for k in range(n):
        words = list(template)
        for j in r.choice(200, 8, replace=False):
            words[j] = f"u{k}x{j}"
        rows.append((k, " ".join(words)))
    return rows


def test_pairs_grow_in_proportion_to_a_crowd(spark, monkeypatch):
    """Nearly all pairs of a template's texts are just below the threshold; few are confirmed, and the links are found."""
    from inkwell.llm import near_dedup

    asked, confirm = [], near_dedup.confirm
    monkeypatch.setattr(near_dedup, "confirm", lambda pairs, *a: asked.append(pairs.count()) or confirm(pairs, *a))
    each = {}
    for n in (400, 800, 1600):
        rows, before = crowd(n, n), sum(asked)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, 2).collect()}
        each[n] = sum(asked) - before
    entry = {s: k for k, s in enumerate({s for _, t in rows for s in shingles(t, 2)})}
    member = np.zeros((n, len(entry)), np.float32)
    for k, t in rows:
        member[k, [entry[s] for s in shingles(t, 2)]] = 1
    both = member @ member.T
    size = member.sum(axis=1)
    links = np.argwhere(np.triu(100 * both >= 80 * (size[:, None] + size - both), 1))
    found = sum(got[a] == got[b] for a, b in links.tolist())
    print(f"pairs to confirm {each}, links found {found} of {len(links)}")
    assert len(links) > 20 and found == len(links)
    assert each[1600] < 2 * 2 * each[400] * 1.5 and each[1600] < 0.1 * n * n / 2


def test_crowds_of_many_parts_give_the_components_of_all_pairs(spark):
    """Templates with close copies of their variants: many linked parts share every bucket."""
    r = np.random.default_rng(4)
    rows = []
    for k, t in [x for s in (1, 2) for x in crowd(s, 40)]:
        for copy in range(int(r.integers(1, 5))):
            words = t.split()
            words[int(r.integers(0, 200))] = f"c{copy}"
            rows.append((len(rows) * 13 % 997, " ".join(words)))
    got = {i: (x["n_shingles"], x["component_id"], x["kept"]) for i, x in by_id(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)).items()}
    want = components(rows, 2)
    assert got == want


def test_crowds_with_long_lists_get_trees(spark, monkeypatch):
    """Lists beyond the bound: trees find nearly all links, and nothing that isn't one."""
    from inkwell.llm import crowds

    monkeypatch.setattr(crowds, "LISTED", 4)
    rows = crowd(7, 250)
    got = {i: (x["n_shingles"], x["component_id"], x["kept"]) for i, x in by_id(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)).items()}
    want = components(rows, 2)
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_crowds_with_long_lists_lose_no_link(spark, monkeypatch):
    """Lists beyond the bound meet in parts: all that can be linked is counted, in groups within the bound."""
    from inkwell.llm import crowds

    members = [(1, k, k, k, 100, 2, 0, [(40, 7), (40, 8)]) for k in range(40)]
    schema = "crowd long, member long, rep long, part long, n long, size int, own int, shared array<struct<members:long,entry:long>>"
    monkeypatch.setattr(crowds, "LISTED", 4)
    found = crowds.listed_pairs(spark.createDataFrame(members, schema), 80)
    assert {(r["a"], r["b"]) for r in found.collect()} == {(a, b) for b in range(40) for a in range(b)}

    for seed in (7, 8):
        rows = crowd(seed, 250)
        got = {i: (x["n_shingles"], x["component_id"], x["kept"]) for i, x in by_id(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)).items()}
        assert got == components(rows, 2)


def test_crowds_of_unequal_lengths_lose_no_link(spark):
    """Members that miss or add a part of the template, some of them so near that they need no common difference."""
    r = np.random.default_rng(9)
    template = [f"w{k}" for k in r.integers(0, 900, 160)]
    rows = []
    for k in range(160):
        words = list(template)
        for j in r.choice(160, int(r.integers(0, 10)), replace=False):
            words[j] = f"u{k}x{j}" if r.random() < 0.5 else f"v{j}"
        cut, more = int(r.integers(0, 25)), int(r.integers(0, 25))
        rows.append((k * 7 % 163, " ".join(words[cut:] + [f"t{j}" if r.random() < 0.6 else f"m{k}x{j}" for j in range(more)])))
    got = {i: (x["n_shingles"], x["component_id"], x["kept"]) for i, x in by_id(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)).items()}
    assert got == components(rows, 2)
