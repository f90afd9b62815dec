import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkwell.llm.mixing import mix_report, mixed_documents
from inkwell.llm.queries import TOKENIZER, token_rows
from inkwell.llm import sharding
from inkwell.llm.sharding import read_shards, shard_digest, shuffle_into_shards, write_shards
from inkwell.llm.token_output import Encoder, encoder, make_block, pack, read_block, slices, unpack

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in "".join(" " if c in WHITE else c for c in text or "").split(" ") if w]


@given(st.integers(1, 32).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, (1 << b) - 1), max_size=60))), st.data())
def test_packing_is_reversed_from_any_place(case, data):
    bits, ids = case
    raw = pack(np.array(ids, np.uint32), bits)
    assert len(raw) == -(-len(ids) * bits // 8)
    first = data.draw(st.integers(0, len(ids)))
    assert unpack(raw, bits, first, len(ids) - first).tolist() == ids[first:]


def test_blocks_give_each_document():
    parts = [np.array(x, "<u4") for x in ([5, 1], [1], [49_000, 7, 1])]
    doc_ids, offsets, bits, packed = read_block(make_block([3, 4, 9], parts, 16))
    assert doc_ids.tolist() == [3, 4, 9] and offsets.tolist() == [0, 2, 3, 6]
    assert unpack(packed, bits, 3, 3).tolist() == [49_000, 7, 1]


ODD_TEXTS = [
    "", None, " \t ", "<|ENDOFTEXT|>. <|endoftext|> a<|startoftext|>b, X <|endoftext|>.", "It's o'CLOCK, don't!! 3.14, ab1. (x). it' 'S x's'",
    "É, H\u0331. İstanbul, ǅ, a\u00a0b. \x1cq x\x85y. é\u0301. ÿ, ab\x00. .,;a a$$$ a>, a.> ×. x×.", "it’s ß. ª, µ; x\u0301, CO2. ... ﬁn. ΣΣ, ٣.",
]


def test_ids_are_those_of_whole_texts():
    path = public_tokenizers.path(TOKENIZER)
    t, of = Tokenizer.from_file(path), Encoder(path)
    assert of.words is not None
    texts = pa.array(ODD_TEXTS * 2, pa.large_string()).fill_null("")
    for a, b in [*slices(texts, 40), (0, len(texts)), (3, 5), (2, 3)]:
        ids, starts = of.encode(texts.slice(a, b - a))
        for k in range(b - a):
            assert ids[starts[k] : starts[k + 1]].tolist() == t.encode(texts[a + k].as_py(), add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_do_not_depend_on_what_came_before(name):
    path = public_tokenizers.path(name)
    t, of = Tokenizer.from_file(path), Encoder(path)
    for texts in (["world hello", "hello world"], ["hello", " world\n\nhello  world", *ODD_TEXTS[2:]], ["world hello"]):
        ids, starts = of.encode(pa.array(texts, pa.large_string()))
        got = [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


@settings(deadline=None)
@given(st.lists(st.text(st.sampled_from("aZéß'.,<|>$1 \u0301\u0331\u212aσ\n"), max_size=20), max_size=6))
def test_ids_of_any_text(texts):
    of = encoder(public_tokenizers.path(TOKENIZER))
    ids, starts = of.encode(pa.array(texts, pa.large_string()))
    got = [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert got == [of.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_digests(spark, docs, rows):
    t = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    start, want = 0, {}
    for doc_id, text, *_ in sorted(rows, key=lambda x: x[0]):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_rows(spark, docs).collect()}
    assert got == want


def test_tokens_of_odd_and_empty_tables(spark, odd, nothing):
    got = token_rows(spark, odd).orderBy("start").collect()
    assert len(got) == odd.count() and got[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    assert token_rows(spark, nothing).count() == 0


def targets(sizes):
    """Water filling, step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, out = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def test_mix_follows_its_targets(docs, rows):
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(words(text))
    want, source_of, taken = targets(sizes), {r[0]: r[3] for r in rows}, Counter()
    got = mix_report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        source = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(float(want[source]))
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert all(0 <= float(want[s]) - taken[s] < 1.001 for s in sizes)
    assert sorted(got) == sorted(mix_report(docs.repartition(3)).collect())
    out = defaultdict(int)
    for r in mixed_documents(docs).collect():
        out[r["doc_id"]] += len(words(r["text"]))
    assert out == {r["doc_id"]: r["taken"] for r in got if r["taken"]}


def test_mix_of_odd_and_empty_tables(odd, nothing):
    assert mix_report(odd).count() == odd.count()
    assert mixed_documents(odd).columns == odd.columns
    assert mix_report(nothing).count() == mixed_documents(nothing).count() == 0


def test_mix_without_ids(spark):
    rows = [(None, f"words of text number {k}", ["a", None][k % 2]) for k in range(300)]
    got = mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * 5 * 300, abs=2) and all(r["taken"] <= 2 * r["size"] for r in got)


def test_shards_keep_rows_equal_and_slots_gapless(spark, docs, rows, tmp_path):
    got = shard_digest(shuffle_into_shards(docs)).collect()
    text = {r[0]: r[1] or "" for r in rows}
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    counts = [len(by[k]) for k in range(40)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = shard_digest(shuffle_into_shards(docs.repartition(2))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    write_shards(shuffle_into_shards(docs), str(tmp_path / "out"))
    back = read_shards(spark, str(tmp_path / "out"), shuffle_into_shards(docs).schema)
    assert sorted(map(str, shard_digest(back).collect())) == sorted(map(str, got))


def test_shards_of_repeated_rows(spark):
    """A third and more of one row goes to all buckets; rows that differ in an extra column alone keep their shards in any order."""
    rows = [(1, "same text", "x", 0)] * 3000 + [(2, "one id and text", f"v{k}", k) for k in range(500)] + [(k, f"text {k}", None, k) for k in range(3, 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more string, n int").repartition(5)
    sharded = shuffle_into_shards(df)
    got = sharded.collect()
    assert Counter((r["doc_id"], r["text"], r["more"], r["n"]) for r in got) == Counter(rows)
    hot = Counter(r["bucket"] for r in got if r["doc_id"] == 1)
    assert len(hot) == 16 and max(hot.values()) < 2 * 3000 / 16
    other = shuffle_into_shards(spark.createDataFrame(rows[::-1], "doc_id long, text string, more string, n int").repartition(3)).collect()
    place = lambda found: sorted((str(r["doc_id"]), str(r["more"]), r["n"], r["shard"], r["slot"]) for r in found)
    assert place(got) == place(other)


def test_shards_of_odd_and_empty_tables(odd, nothing):
    assert shard_digest(shuffle_into_shards(odd)).count() == odd.count()
    assert shard_digest(shuffle_into_shards(nothing)).count() == 0


@pytest.mark.parametrize(("kind", "value"), [("map<string,int>", "map('k', cast(id as int), 'a', 1)"), ("array<struct<m:map<string,int>>>", "array(named_struct('m', map('k', cast(id as int))))")])
def test_shards_keep_rows_that_differ_in_a_map(spark, kind, value):
    df = spark.range(1200).selectExpr("1L AS doc_id", "'same' AS text", f"cast({value} as {kind}) AS extra")
    got = shuffle_into_shards(df).collect()
    assert len({str(r["extra"]) for r in got}) == len(got) == 1200
    place = lambda found: sorted((str(r["extra"]), r["shard"], r["slot"]) for r in found)
    assert place(got) == place(shuffle_into_shards(df.repartition(3)).collect())


def test_shards_lose_nothing_where_hashes_collide(spark, monkeypatch):
    monkeypatch.setattr(sharding, "row_hash", lambda seed, columns: F.lit(7).cast("long"))
    rows = [(k, f"text {k}", k % 3) for k in range(1500)]
    got = shuffle_into_shards(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)).collect()
    assert sorted((r["doc_id"], r["text"], r["n"]) for r in got) == rows
    by = Counter(r["shard"] for r in got)
    assert len(by) == 40 and max(by.values()) - min(by.values()) <= 1 and len({r["bucket"] for r in got}) == 16
