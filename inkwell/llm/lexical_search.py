"""Ranked lexical search: the exact best documents of each query, by dual-sorted wavelet trees.

The index covers every document and every term. Documents go to shards of about
``SHARD_BYTES`` of text as they are read, without an exchange; a shard is one row
with its sorted dictionary, the impacts of its posting lists and the planes of
their wavelet tree. A search cuts the lists that are asked for out of the tree and
takes nodes best first. A task keeps the best of all its shards, so from its
second shard on nearly all nodes fall below the bound at once.

Queries are sent in blocks of ``BLOCK_BYTES`` of terms; each block is one more
pass over the index, so what is sent has a fixed size however many there are.

Scores are integers: weight of the term times (10**9 tf) div (1000 tf + 20 m).

Defined results: null texts have no terms; documents without terms are found by
no query and queries without known terms find nothing; every row of either table
is a document or query of its own; a null doc_id counts as the smallest id; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, text_of, written
from .hashing import LOWER
from .wavelet import Cut, bits_for, planes

#: Maximal runs of what is not an ASCII control, mark or space; the same in bytes of UTF-8 after lower-casing.
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES, BREAK = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
SHARD_BYTES, SHARD_DOCS, PIECE, BLOCK_BYTES = 16 << 20, 1 << 14, 1 << 22, 4 << 20
NO_ID = -(1 << 63)
INDEX = "doc_ids binary, terms array<string>, dfs array<int>, impacts binary, planes array<binary>"
FOUND = "item long, item_id long, doc_id long, score long"


def pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a lower-cased text that cut no term; almost always the text itself."""
    at = 0
    while at < len(text):
        cut = BREAK.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def shard_of(ids: list[int], texts: list[bytes], n_docs: int, n_terms: int) -> dict:
    """One row of the index; ``n_docs`` and ``n_terms`` count the documents with terms and all their terms."""
    vocabulary: dict = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    terms, docs, counts, lengths = [], [], [], np.zeros(len(ids), object)
    for k, i in enumerate(order):
        parts = [np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found)) for p in pieces(texts[i]) if (found := TERM_BYTES.findall(p))]
        if parts:
            term, count = np.unique(np.concatenate(parts), return_counts=True)
            terms.append(term)
            counts.append(count)
            docs.append(np.full(len(term), k))
            lengths[k] = int(count.sum())
    norms = np.array([50 + 50 * n * n_docs // max(n_terms, 1) for n in lengths], np.int64)
    names = sorted(vocabulary)
    place = np.zeros(len(names), np.int64)
    place[[vocabulary[t] for t in names]] = np.arange(len(names))
    term, doc, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (terms, docs, counts))
    term = place[term]
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * norms[doc])
    root = np.lexsort((doc, -impact, term))
    return {
        "doc_ids": np.array(ids, np.int64)[order].tobytes(), "terms": [t.decode() for t in names], "dfs": np.bincount(term, minlength=len(names)).astype(np.int32),
        "impacts": impact[root].astype(np.int32).tobytes(), "planes": planes(doc[root], bits_for(len(ids))),
    }


def _shards(n_docs: int, n_terms: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size = [], [], 0
        for frame in frames:
            for i, text in zip(frame["doc_id"], frame["text"], strict=True):
                texts.append((text or "").encode().translate(LOWER))
                ids.append(i)
                size += len(texts[-1])
                if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                    yield pd.DataFrame([shard_of(ids, texts, n_docs, n_terms)])
                    ids, texts, size = [], [], 0
        if ids:
            yield pd.DataFrame([shard_of(ids, texts, n_docs, n_terms)])

    return run


def build_index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The written index of (doc_id, text), a row a shard, and how many documents have terms."""
    n = F.regexp_count(text_of(F.col("text")), F.lit(TERMS)).cast("long").alias("n")
    n_docs, n_terms = docs.select(n).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    slim = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    return written(slim.mapInPandas(_shards(n_docs, n_terms or 0), INDEX), "index"), n_docs


def weighed_queries(queries: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """(item_id, text_key, terms, weights) of each query row with known terms, each term once."""
    asked = queries.select("item_id", F.monotonically_increasing_id().alias("row"), F.array_distinct(F.regexp_extract_all(ascii_lower(text_of(F.col("text"))), F.lit(TERMS), F.lit(0))).alias("terms"))
    asked = written(asked, "asked")
    each = asked.select("row", "item_id", F.explode("terms").alias("term"))
    counted = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("e")).select(F.col("e.terms").alias("term"), F.col("e.dfs").alias("df"))
    counted = counted.join(each.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long").alias("weight")
    known = each.join(counted, "term").select("row", "item_id", F.struct("term", weight).alias("e"))
    return written(known.groupBy("row", "item_id").agg(F.array_sort(F.collect_list("e")).alias("e")).select("row", "item_id", "e.term", "e.weight"), "queries")


def blocks_of(queries: DataFrame) -> Iterator[list[tuple]]:
    """Lists of (number, item_id, terms, weights) with about ``BLOCK_BYTES`` of terms each."""
    block, size = [], 0
    for k, q in enumerate(queries.orderBy("row").toLocalIterator()):
        block.append((k, q["item_id"], q["term"], np.array(q["weight"], np.int64)))
        size += sum(len(t) + 16 for t in q["term"])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(block: list[tuple], k: int):
    asked = np.array(sorted({t for q in block for t in q[2]}), object)
    number = {t: j for j, t in enumerate(asked)}
    of_query = [np.array([number[t] for t in q[2]], np.int64) for q in block]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in block]
        for frame in frames:
            for doc_ids, terms, dfs, impacts, stored in frame.itertuples(index=False, name=None):
                known, ends = {t: j for j, t in enumerate(terms)}, np.cumsum(np.asarray(dfs, np.int64))
                place = np.array([known.get(t, -1) for t in asked])
                has = place >= 0
                if not has.any():
                    continue
                of_list = np.cumsum(has) - 1
                ends, lengths = ends[place[has]], np.asarray(dfs, np.int64)[place[has]]
                impacts = np.frombuffer(impacts, np.int32)
                ids = np.frombuffer(doc_ids, np.int64)
                cut = Cut(list(stored), len(impacts), impacts, ends - lengths, ends)
                for q, (_, _, _, weights) in enumerate(block):
                    own = has[of_query[q]]
                    held, scores = best[q]
                    least = int(scores[-1]) if len(scores) >= k else 1
                    docs, more = cut.top(of_list[of_query[q][own]], weights[own], k, least)
                    if len(docs):
                        held, scores = np.concatenate([held, ids[docs]]), np.concatenate([scores, more])
                        order = np.lexsort((held, -scores))[:k]
                        best[q] = held[order], scores[order]
        for (n, item_id, _, _), (held, scores) in zip(block, best, strict=True):
            yield pd.DataFrame({"item": n, "item_id": pd.array([item_id] * len(held), "Int64"), "doc_id": held, "score": scores})

    return run


def search_index(index: DataFrame, queries: DataFrame, n_docs: int, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row (item_id, text) of ``queries``."""
    weighed = weighed_queries(queries, index, n_docs)
    found = None
    for block in blocks_of(weighed):
        part = written(index.mapInPandas(_search(block, k), FOUND), "found")
        found = part if found is None else found.union(part)
    discard(weighed)
    if found is None:
        found = index.sparkSession.createDataFrame([], FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """Index ``docs`` and rank all of them for each query."""
    index, n_docs = build_index(docs)
    return search_index(index, queries, n_docs, k)
