"""Evaluation texts leaking into training text: a BM25 index of the test items, searched block by block."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import spread, stage

#: Consecutive words (letters in Chinese and Japanese) that make a leak.
WORDS, LETTERS = 8, 16
#: Words (letter pairs) of a training passage, and items of an index block.
PASSAGE_WORDS, PASSAGE_PAIRS, BLOCK = 24, 48, 16
K1, B = 1.2, 0.75
#: Characters of test items per index shard; the corpus is read once per shard.
SHARD_CHARS = 4_000_000

_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|font|a|code|small|sub|sup|tt|mark|wbr)\b[^<>\n]*>|\[/?(?:b|i|u|s|url|color|size|font|code)(?:=[^\]\n]*)?\]", re.I)
_BLOCKISH = re.compile(r"</?[a-z][^<>\n]*>|<!--.*?-->|\[/?(?:quote|img|list|spoiler|center|email|\*)(?:[=\s][^\]\n]*)?\]", re.I)
_HIDDEN = re.compile("[­᠎​-‏‪-‮⁠-⁤⁦-⁩﻿︀-️]")
_ACCENT = re.compile("[̀-ͯ]+")
_WORD = re.compile(r"[^\W_]+")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿々〆]")


def plain_words(text: str) -> list[str]:
    """Words of a text as they count for comparing: no case, width, accents, signs, markup or invisible characters."""
    if "<" in text or "[" in text:
        text = _BLOCKISH.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _ACCENT.sub("", unicodedata.normalize("NFKD", _HIDDEN.sub("", text)))
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.casefold())


def _pairs(letters: str) -> list[str]:
    return [letters[i : i + 2] for i in range(len(letters) - 1)]


@dataclass
class Index:
    """A BM25 inverted index in blocks of ``BLOCK`` items, memory linear in its postings.

    Postings are sorted by term and block: ``keys`` is term x blocks + block, ``tops`` the largest
    BM25 part of the term in an item of the block (the block maximum), ``heads`` where each term's
    postings start, ``entries`` where each posting's items start in ``slots`` and ``parts``.
    ``term_top`` bounds a term over all blocks. ``floor`` is per item the least score any passage
    can have that holds enough consecutive terms of it, so that retrieving all items at or above
    their floor misses none; ``block_floor`` and ``least_floor`` are its minima.
    """

    ids: list
    terms: dict[str, int]
    blocks: int
    keys: np.ndarray
    tops: np.ndarray
    heads: np.ndarray
    entries: np.ndarray
    slots: np.ndarray
    parts: np.ndarray
    term_top: np.ndarray
    floor: np.ndarray
    block_floor: np.ndarray
    least_floor: float
    runs: np.ndarray  # sorted hashes of (item, run)
    n: int


def build_index(items: list[tuple[object, list[str]]], run: int) -> Index | None:
    """Index of ``(id, terms)``; items shorter than ``run`` terms can't leak and are left out."""
    items = [(i, t) for i, t in items if len(t) >= run]
    if not items:
        return None
    items.sort(key=lambda x: (sorted(x[1]), str(x[0])))  # items with the same words share blocks
    df = Counter(t for _, terms in items for t in set(terms))
    vocabulary = {t: k for k, t in enumerate(df, 1)}  # 0: any other term
    n = len(items)
    idf = {t: np.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    mean = sum(len(t) for _, t in items) / n
    blocks = -(-n // BLOCK)
    floor = np.full(blocks * BLOCK, np.inf)
    runs, term_of, item_of, weight = [], [], [], []
    for k, (_, terms) in enumerate(items):
        part = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(terms) / mean)) for t, f in Counter(terms).items()}
        term_of += [vocabulary[t] for t in part]
        item_of += [k] * len(part)
        weight += part.values()
        floor[k] = min(sum(part[t] for t in set(terms[i : i + run])) for i in range(len(terms) - run + 1)) * (1 - 1e-6)
        h = _run_hash(np.array([vocabulary[t] for t in terms], np.int64)[None, :], run)[0]
        runs.append(_of_item(h, np.full(len(h), k)))
    term, item, weight = np.array(term_of, np.int64), np.array(item_of, np.int64), np.array(weight)
    order = np.lexsort((item, term))
    term, item, weight = term[order], item[order], weight[order]
    keys, entries = np.unique(term * blocks + item // BLOCK, return_index=True)
    tops = np.maximum.reduceat(weight, entries)
    heads = np.searchsorted(keys, np.arange(len(vocabulary) + 2) * blocks)
    term_top = np.zeros(len(vocabulary) + 1)
    np.maximum.at(term_top, keys // blocks, tops)
    return Index(
        [i for i, _ in items], vocabulary, blocks, keys, tops, heads, np.append(entries, len(item)), (item % BLOCK).astype(np.int8), weight,
        term_top, floor, floor.reshape(blocks, BLOCK).min(axis=1), float(floor.min()), np.unique(np.concatenate(runs)), run,
    )


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges start..end-1, and which range each is of."""
    size = ends - starts
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size), owner


def _run_hash(rows: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit hash of every ``run`` consecutive ids of each row (0, an unknown term, makes it unlike any item's)."""
    m = rows.shape[1] - run + 1
    h = np.zeros((len(rows), m), np.uint64)
    for k in range(run):
        h = (h ^ rows[:, k : k + m].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _of_item(h: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The hash of a run as a run of one item."""
    h = (h ^ item.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(31))


def _passages(texts: list[np.ndarray], run: int, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, passages): texts cut into rows of ``passage`` terms that overlap by ``run - 1``, those without ``run`` known terms in a row left out."""
    sizes = np.array([len(t) for t in texts])
    flat = np.concatenate([*texts, np.zeros(passage, np.int64)])
    first = np.cumsum(sizes) - sizes
    step = passage - run + 1
    n = np.where(sizes >= run, -(-np.maximum(sizes - run + 1, 0) // step), 0)
    k, owner = _spans(np.zeros(len(n), np.int64), n)
    at = first[owner] + k * step
    rows = flat[at[:, None] + np.arange(passage)]
    rows[np.arange(passage) >= (first + sizes)[owner][:, None] - at[:, None]] = 0
    gone = np.pad(np.cumsum(rows == 0, axis=1), ((0, 0), (1, 0)))  # unknown terms so far
    some = (gone[:, run:] == gone[:, :-run]).any(axis=1)
    return owner[some], rows[some]


def search(index: Index, texts: list[np.ndarray], passage: int, seen: Counter | None = None) -> list[tuple[int, object, int]]:
    """``(text number, item id, matched runs)`` of all texts that hold ``index.n`` consecutive terms of an item.

    Every text is cut into passages of ``passage`` terms that overlap by ``index.n - 1``, so each
    run lies whole in one. All passages are queries, answered as by WAND with block maxima: a
    passage's terms are ordered by the most they can add; those before the pivot, where their sum
    reaches the least floor, cannot lift an item there by themselves, so only postings from the
    pivot on are opened. The blocks found get a bound from the opened maxima and the most the
    others can add, then from all maxima; blocks below their floor are skipped. Only items that
    reach their own floor are verified term by term. ``seen`` counts postings, opened and scored.
    """
    found: Counter = Counter()
    owner, rows = _passages(texts, index.n, passage) if texts else (np.zeros(0, np.int64), np.zeros((0, passage), np.int64))
    for a in range(0, len(rows), 8192):
        part = rows[a : a + 8192]
        once = np.sort(part, axis=1)
        once[:, 1:][once[:, 1:] == once[:, :-1]] = 0  # a term counts once per passage
        top = index.term_top[once]
        order = np.argsort(top, axis=1)
        once, top = np.take_along_axis(once, order, 1), np.take_along_axis(top, order, 1)
        below = np.cumsum(top, axis=1)
        pivot = (below < index.least_floor).sum(axis=1)  # first term to open
        rest = np.where(pivot > 0, np.take_along_axis(below, np.maximum(pivot - 1, 0)[:, None], 1)[:, 0], 0.0)
        p, c = np.nonzero((np.arange(passage) >= pivot[:, None]) & (once > 0))
        post, of = _spans(index.heads[once[p, c]], index.heads[once[p, c] + 1])
        cell, back = np.unique(p[of] * index.blocks + index.keys[post] % index.blocks, return_inverse=True)
        q, block = np.divmod(cell, index.blocks)
        bound = np.bincount(back, index.tops[post], len(cell)) + rest[q]
        keep = bound >= index.block_floor[block]
        q, block = q[keep], block[keep]
        if seen is not None:
            seen.update(postings=int((index.heads[once + 1] - index.heads[once])[once > 0].sum()), opened=len(post), bounded=len(cell), kept=len(q))
        if not len(q):
            continue
        # all maxima of what is left
        want = once[q] * index.blocks + block[:, None]
        place = np.minimum(np.searchsorted(index.keys, want), len(index.keys) - 1)
        hit = (index.keys[place] == want) & (once[q] > 0)
        keep = np.where(hit, index.tops[place], 0.0).sum(axis=1) >= index.block_floor[block]
        q, block, place, hit = q[keep], block[keep], place[keep], hit[keep]
        r, c = np.nonzero(hit)
        entry, of = _spans(index.entries[place[r, c]], index.entries[place[r, c] + 1])
        score = np.bincount(r[of] * BLOCK + index.slots[entry], index.parts[entry], len(q) * BLOCK).reshape(-1, BLOCK)
        if seen is not None:
            seen.update(scored=len(q))
        i, s = np.nonzero(score >= index.floor.reshape(-1, BLOCK)[block])
        item = block[i] * BLOCK + s
        used, back = np.unique(q[i], return_inverse=True)
        h = _of_item(_run_hash(part[used], index.n)[back], item[:, None])
        hits = (index.runs[np.minimum(np.searchsorted(index.runs, h), len(index.runs) - 1)] == h).sum(axis=1)
        for k in np.flatnonzero(hits):
            found[(int(owner[a + q[i[k]]]), index.ids[item[k]])] += int(hits[k])
    return [(k, i, n) for (k, i), n in found.items()]


def _term_ids(words: list[str], terms: dict[str, int]) -> np.ndarray:
    get = terms.get
    return np.fromiter((get(w, 0) for w in words), np.int64, len(words))


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "eval_id", item_text: str = "text", item_lang: str = "lang"
) -> DataFrame:
    """``(doc_id, item_id, matched_runs)``: documents that hold a passage of a held-out item.

    A passage is ``WORDS`` consecutive words of the item, or ``LETTERS`` consecutive letters for
    items in Chinese or Japanese (by their letters; ``item_lang`` zh or ja counts as well).
    ``matched_runs`` counts the runs of that length found.

    The items are indexed in shards of about ``SHARD_CHARS`` characters, by hash of their id; one
    shard's index is built by the driver and broadcast at a time, and the corpus is read for each,
    row by row in Arrow batches. Null and short texts hold nothing; of items with the same id each
    text counts; a document id that occurs in several rows is reported once per item.
    """
    items = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"), F.col(item_lang).alias("l")).where(F.col("t").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-size // SHARD_CHARS))
    source = spread(docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")))
    out = None
    for k in range(shards):
        rows = _search_shard(source, items.where(F.pmod(F.xxhash64("i"), F.lit(shards)) == k))
        rows = rows.groupBy("_d", F.col("_i").cast(dict(items.dtypes)["i"]).alias("_i")).agg(F.sum("_n").alias("matched_runs"))
        rows = stage(rows) if shards > 1 else rows  # one index in memory at a time
        out = rows if out is None else out.unionByName(rows)
    return out.select(F.col("_d").alias(doc_id), F.col("_i").alias(item_id), "matched_runs")


def _search_shard(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(_d, _i, _n)`` of the documents ``(_d, _t)`` that hold passages of one shard of items ``(i, t, l)``."""
    spaced, dense = [], []
    for r in items.collect():  # about SHARD_CHARS characters
        words = plain_words(r["t"])
        letters = "".join(words)
        cjk = len(_CJK.findall(letters))
        if cjk * 2 > len(letters) or (r["l"] or "").lower()[:2] in ("zh", "ja"):
            dense.append((r["i"], _pairs(letters)))
        else:
            spaced.append((r["i"], words))
    by_words, by_pairs = build_index(spaced, WORDS), build_index(dense, LETTERS - 1)
    shared = docs.sparkSession.sparkContext.broadcast((by_words, by_pairs))

    def run(batches):
        words_index, pairs_index = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            out: list[tuple[int, object, int]] = []
            for a in range(0, len(texts), 2000):
                word_ids, pair_ids = [], []
                for t in texts[a : a + 2000]:
                    words = plain_words(t) if t else []
                    word_ids.append(_term_ids(words, words_index.terms) if words_index else np.zeros(0, np.int64))
                    cjk = pairs_index is not None and t is not None and not t.isascii() and _CJK.search(t) is not None
                    pair_ids.append(_term_ids(_pairs("".join(words)), pairs_index.terms) if cjk else np.zeros(0, np.int64))
                if words_index:
                    out += [(a + k, i, n) for k, i, n in search(words_index, word_ids, PASSAGE_WORDS)]
                if pairs_index:
                    out += [(a + k, i, n) for k, i, n in search(pairs_index, pair_ids, PASSAGE_PAIRS)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([k for k, _, _ in out], pa.int64())), pa.array([str(i) for _, i, _ in out], pa.string()), pa.array([n for _, _, n in out], pa.int64())],
                ["_d", "_i", "_n"],
            )

    return docs.mapInArrow(run, f"_d {dict(docs.dtypes)['_d']}, _i string, _n long")
