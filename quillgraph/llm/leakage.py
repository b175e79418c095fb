"""Evaluation material inside training documents (problem 8).

Spaced-seed hashing: two fixed masks pick ``WEIGHT`` of ``SPAN`` neighbouring
words, so an exchanged word under a gap does not spoil a seed. Seeds of the
test texts (a bounded set) are joined with the seeds of all documents; the
(document, test text) pairs with enough distinct seeds are verified on the word
sequences themselves: runs of equal words are extended over exchanged words
around the hits, chained in order (so a passage may be put in between), and the
equal words of the chain are counted.

Words, their hashes and seeds are made of whole Arrow batches at once: arrays
built by Spark's lambda functions cost several times as much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions that a seed looks at; each mask starts with one. Weight 7, span 11.
MASKS = ((0, 1, 2, 4, 7, 9, 10), (0, 2, 3, 5, 6, 8, 10))
SPAN = 11
#: Share of a paragraph's words that must be found, and of a question's: "whole" but for one word in twenty-five (questions of a kind differ in two or three).
PARAGRAPH_SHARE, QUESTION_SHARE = 0.4, 0.96
#: Share of a paragraph's words whose number of seeds a pair must hit to be verified; far below what PARAGRAPH_SHARE leaves after exchanged words.
HIT_SHARE = 0.04
#: Seeds that more test texts than this share say less of each: of them a paragraph needs so many more.
COMMON_SEED, COMMON_SHARE = 3, 0.15
#: Left out of words: Arabic vowel marks, the stretching stroke and the hamza, soft hyphens, characters that can't be seen.
_MARKS = r"[\x{0610}-\x{061a}\x{0640}\x{064b}-\x{065f}\x{0670}\x{0621}\x{00ad}\x{200b}-\x{200f}\x{2060}\x{feff}]"
#: Letters brought to one form once they are lower-case.
_EVEN = dict(zip("أإآٱؤئىς", "ااااوييσ"))
#: Bytes of text that are cut into words at once; a longer text goes whole.
_BLOCK = 1 << 23
#: Words of documents and test texts whose pairs are laid against each other at once.
_PAIR_WORDS = 1 << 13
#: Last bits of a seed that the table of the test texts' seeds goes by, and those of them that are a place within its row.
SEED_BITS, _ROW_BITS = 23, 15
#: Odd factors of the words' hashes in a seed, by mask and pick.
_FACTORS = [[np.uint64(pow(0x9E3779B97F4A7C15, len(mask) * m + k + 1, 1 << 64)) for k in range(len(mask))] for m, mask in enumerate(MASKS)]


def _block_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    t = pc.utf8_lower(pc.replace_substring(pc.fill_null(texts, ""), "İ", "i\u0307"))
    t = pc.replace_substring_regex(t, _MARKS, "")
    for seen, meant in _EVEN.items():
        t = pc.replace_substring(t, seen, meant)
    t = pc.split_pattern(pc.replace_substring_regex(t, r"[^\p{L}\p{N}\p{M}]+", " "), " ")
    coded = t.flatten().dictionary_encode()
    known = coded.dictionary.to_pandas().to_numpy(dtype=object)
    code = coded.indices.to_numpy()
    word = (known != "")[code] if len(known) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(word)])[t.offsets.to_numpy()]
    return pd.util.hash_array(known, categorize=False)[code[word]], np.diff(ends)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all ``texts`` in order, and where each text begins in them and the last one ends.

    Words are lower-cased runs of letters and digits without vowel and hamza
    marks; a null text has none. Each different word of a block is hashed once.
    """
    blocks = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // _BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(texts)]
    got = [_block_hashes(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
    return np.concatenate([h for h, _ in got]), np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in got]))])


def seed_hashes(h: np.ndarray, at: np.ndarray, bits: np.ndarray | None = None) -> pa.Array:
    """The distinct seeds of each text, its words' hashes being ``h`` between two of the places ``at``.

    With ``bits``, of those only the ones that a test text may have.
    """
    row, n = np.repeat(np.arange(len(at) - 1), np.diff(at)), max(len(h) - SPAN + 1, 0)
    whole = row[:n] == row[len(row) - n :]  # the span doesn't reach into the next text
    known = None if bits is None else np.unpackbits(bits, bitorder="little").view(bool)
    seeds, rows = [], []
    for mask, factors in zip(MASKS, _FACTORS):
        s = np.zeros(n, np.uint64)
        for k, factor in zip(mask, factors):
            s += h[k : k + n] * factor
        keep = whole if known is None else whole & known[s & np.uint64((1 << SEED_BITS) - 1)]
        seeds.append(s[keep])
        rows.append(row[:n][keep])
    s, r = np.concatenate(seeds), np.concatenate(rows)
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    ends = np.concatenate([[0], np.cumsum(np.bincount(r[first], minlength=len(at) - 1))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(s[first].view(np.int64)))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that came back as lists, in the form of ``word_hashes``."""
    return lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])


def hashed_words(text: Column) -> Column:
    """The array of the hashes of a text's words, empty for a null text."""

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        h, at = word_hashes(texts)
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))

    return run(text)


def _seeds(text: Column, bits: np.ndarray | None) -> Column:
    """The array of a text's distinct seeds among ``bits``.

    To be exploded with ``explode_outer``: for a plain ``explode`` the optimizer
    infers a filter on the array's size, and with it computes the array twice.
    """

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        return seed_hashes(*word_hashes(texts), bits)

    return run(text)


def test_texts(items: DataFrame) -> DataFrame:
    """``item_id, kind, h, n`` for questions and paragraphs; empty texts drop out."""
    sides = [items.where("item_id is not null").select("item_id", F.lit(kind).alias("kind"), F.make_valid_utf8(c).alias("text")) for kind, c in (("question", "question"), ("paragraph", "paragraph_text"))]
    return sides[0].unionByName(sides[1]).select("item_id", "kind", hashed_words(F.col("text")).alias("h")).distinct().withColumn("n", F.size("h"))


def _text_seeds(texts: DataFrame) -> DataFrame:
    @F.arrow_udf("array<bigint>")
    def run(h: pa.Array) -> pa.Array:
        return seed_hashes(*_flat(h))

    return texts.select("item_id", "kind", "n", F.explode_outer(run("h")).alias("seed")).where("seed is not null")


def seed_bits(texts: DataFrame) -> np.ndarray:
    """Packed bits, 1 MB for any number of test texts: set at the last ``SEED_BITS`` of every seed that one of them has."""
    place = F.col("seed").bitwiseAND((1 << SEED_BITS) - 1)
    rows = _text_seeds(texts).groupBy(F.shiftright(place, _ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(place.bitwiseAND((1 << _ROW_BITS) - 1)).alias("bits")).collect()
    out = np.zeros((1 << SEED_BITS - _ROW_BITS, 1 << _ROW_BITS - 3), np.uint8)
    for r in rows:
        out[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _seed_table(texts: DataFrame) -> DataFrame:
    """Distinct ``seed, item_id, kind`` with ``rare``, and the hits that a pair with the text ``need``s.

    A question may have lost but a few words, each of which spoils at most
    ``WEIGHT`` seeds of a mask: all others have to be there. A paragraph needs
    hits of rare seeds for a few of its words, or of any seeds for
    ``COMMON_SHARE`` of them, which two fifths of it have with every fourth
    word exchanged.
    """
    all_ = _text_seeds(texts)
    size = all_.groupBy("item_id", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    often = all_.groupBy("seed").agg((F.count_distinct("item_id") <= COMMON_SEED).alias("rare"))
    lost = F.col("n") - F.ceil(F.col("n") * QUESTION_SHARE)
    any_ = F.when(F.col("kind") == "question", F.greatest(F.lit(1), F.col("seeds") - lost * len(MASKS[0]) * len(MASKS))).otherwise(F.greatest(F.lit(2), F.floor(F.col("n") * COMMON_SHARE)))
    few = F.when(F.col("kind") == "paragraph", F.greatest(F.lit(2), F.floor(F.col("n") * HIT_SHARE))).otherwise(any_)
    return all_.join(size, ["item_id", "kind"]).join(often, "seed").select("seed", "item_id", "kind", "rare", F.struct(any_.alias("any"), few.alias("rare")).alias("need"))


def candidates(docs: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """``key, item_id, kind`` pairs of ``docs`` (``key, text``) with as many distinct seeds in common as they ``need``.

    Seeds of no test text leave before they become rows; those that pass by
    chance find no partner in the join.
    """
    index = _seed_table(texts)
    flat = docs.select(key, F.explode_outer(_seeds(F.col("text"), seed_bits(texts))).alias("seed")).where("seed is not null")
    # rows that repeat a key count their seeds again, which can only add candidates for the verification
    hits = flat.join(index, "seed").groupBy(key, "item_id", "kind", "need").agg(F.count(F.lit(1)).alias("any"), F.count_if("rare").alias("rare"))
    return hits.where("any >= need.any or rare >= need.rare").select(key, "item_id", "kind")


def short_overlaps(docs: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """``key, item_id, kind, words, n`` for texts shorter than a seed's span.

    Such a question has to be there word for word, and of such a paragraph two
    fifths of the words in a row: runs of these lengths (at most ten different
    ones) are hashed and joined, and no other check is needed.
    """
    short = texts.where(f"n between 1 and {SPAN - 1}").withColumn("k", F.when(F.col("kind") == "question", F.col("n")).otherwise(F.ceil(F.col("n") * PARAGRAPH_SHARE)).cast("int"))
    lengths = sorted(r["k"] for r in short.select("k").distinct().collect())
    runs = lambda k: f"case when size(h) >= {k} then transform(sequence(0, size(h) - {k}), i -> xxhash64({k}, slice(h, i + 1, {k}))) end"
    out = None
    for k in lengths:
        wanted = short.where(F.col("k") == k).select("item_id", "kind", "n", F.explode(F.expr(runs(k))).alias("run")).distinct()
        got = docs.select(key, F.explode_outer(F.expr(runs(k))).alias("run")).where("run is not null").join(wanted, "run").select(key, "item_id", "kind", F.lit(k).alias("words"), "n").distinct()
        out = got if out is None else out.unionByName(got)
    return out


def _diagonal_matches(docs: list[np.ndarray], texts: list[np.ndarray]) -> list[list[tuple[int, list[int]]]]:
    """For each pair, by diagonal the text's matching words that an overlap could be made of: five or more over eight words, without a gap of four."""
    n, m = np.array([len(x) for x in docs]), np.array([len(x) for x in texts])
    pair, first = np.repeat(np.arange(len(docs)), n), np.cumsum(m) - m
    # words of different pairs differ by what is added to their hashes
    apart = np.arange(len(docs), dtype=np.uint64) * _FACTORS[0][0]
    doc, text = np.concatenate(docs) + apart[pair], np.concatenate(texts) + np.repeat(apart, m)
    order = np.argsort(text)
    text = text[order]
    new = np.flatnonzero(np.diff(text, prepend=text[:1] + np.uint64(1)))  # where the run of a word begins
    which = np.searchsorted(text[new], doc)
    which[which == len(new)] = 0
    found = np.flatnonzero(text[new][which] == doc) if len(new) else np.zeros(0, np.int64)
    which = which[found]
    many = np.diff(new, append=len(text))[which]
    width = np.cumsum(n + m)
    zero = width - n  # the place of a pair's diagonal 0 among all
    place = ((zero - (np.cumsum(n) - n) + first)[pair] + np.arange(len(doc)))[found]
    j = order[np.arange(many.sum()) + np.repeat(new[which] - np.cumsum(many) + many, many)]
    diagonal = np.repeat(place, many) - j
    keep = np.bincount(diagonal)[diagonal] >= 5
    diagonal, j = diagonal[keep], j[keep]
    by = np.argsort(diagonal, kind="stable")
    diagonal, j = diagonal[by], j[by]
    ends = np.flatnonzero((np.diff(diagonal, append=-1) != 0) | (np.diff(j, append=-1) > 4))
    starts = np.concatenate([ends[:0], [0], ends[:-1] + 1])[: len(ends)]
    held = (ends - starts >= 4) & (j[ends] - j[starts] >= 7)
    out: list[list[tuple[int, list[int]]]] = [[] for _ in docs]
    for a, b, q in zip(starts[held].tolist(), ends[held].tolist(), np.searchsorted(width, diagonal[starts[held]], "right").tolist()):
        out[q].append((int(diagonal[a] - zero[q]), (j[a : b + 1] - first[q]).tolist()))
    return out


def _best_chain(diagonals: list[tuple[int, list[int]]]) -> int:
    runs = []
    for d, at in diagonals:
        start, score, best, end, matched, best_matched, last = at[0], 1, 1, at[0], 1, 1, at[0]
        for j in at[1:]:
            score -= j - last - 1
            if score <= best - 4 or score <= 0:
                if best_matched >= 5 and best >= 5:
                    runs.append((start, end, start + d, end + d, best_matched))
                start, score, best, end, matched, best_matched = j, 0, 0, j, 0, 0
            score += 1
            matched += 1
            if score >= best:
                best, end, best_matched = score, j, matched
            last = j
        if best_matched >= 5 and best >= 5:
            runs.append((start, end, start + d, end + d, best_matched))
    runs = sorted(r for r in runs if r[1] - r[0] + 1 >= 8)
    top = 0
    score = [0] * len(runs)
    for a, (s, e, ds, de, n) in enumerate(runs):
        score[a] = n
        for b in range(a):
            s2, e2, ds2, de2, _ = runs[b]
            cut = max(e2 - s + 1, de2 - ds + 1, 0)  # words that both runs claim
            if s2 < s and ds2 < ds and cut < min(n, e2 - s2 + 1):
                score[a] = max(score[a], score[b] + n - cut)
        top = max(top, score[a])
    return top


def chained_words(doc: np.ndarray, text: np.ndarray) -> int:
    """Equal words in the best chain of overlaps, none of them below eight words.

    Overlaps lie on one diagonal and may hold exchanged words: they are extended
    while matches outweigh mismatches (X-drop of four). The chain keeps the
    order in both texts.
    """
    return _best_chain(_diagonal_matches([doc.astype(np.uint64)], [text.astype(np.uint64)])[0])


def chains(docs: list[np.ndarray], texts: list[np.ndarray], least: list[float]) -> list[int | None]:
    """``chained_words`` of each pair; null where what overlaps could be made of is less than the ``least`` that matters."""
    sizes = np.cumsum([len(d) + len(t) for d, t in zip(docs, texts)]) // _PAIR_WORDS
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(docs)]
    got = (x for a, b in zip(cuts, cuts[1:]) for x in _diagonal_matches(docs[a:b], texts[a:b]))
    return [None if sum(len(at) for _, at in x) < few else _best_chain(x) for x, few in zip(got, least)]


def _verify(key: str, share: dict[str, float] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column("text").dictionary_encode(null_encoding="encode")  # cut into words once for all its pairs
            h, at = word_hashes(texts.dictionary)
            which, need = texts.indices.to_numpy(), [share[k] if share else 0 for k in b.column("kind").to_pylist()]
            flat, begin = _flat(b.column("text_h"))
            got = chains([h[at[d] : at[d + 1]] for d in which], [flat[x:y] for x, y in zip(begin, begin[1:])], [q * (y - x) for x, y, q in zip(begin, begin[1:], need)])
            out = pa.RecordBatch.from_arrays([b.column(key), b.column("item_id"), b.column("kind"), pa.array(got, pa.int32()), b.column("n")], [key, "item_id", "kind", "words", "n"])
            yield out.filter(out.column("words").is_valid())

    return run


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", share: dict[str, float] | None = None) -> DataFrame:
    """Verified pairs ``key, item_id, kind, words, n``: equal words of ``n``.

    Null and empty texts overlap with nothing; repeated rows count once. With
    ``share`` by kind, pairs may be left out that have a smaller one.
    """
    d = docs.select(key, F.make_valid_utf8(text).alias("text")).where(F.col(key).isNotNull())
    t = test_texts(items)
    pairs = candidates(d, t, key)
    # texts travel as they are, which is shorter than their word hashes, and meet only documents that have candidates
    fed = d.join(pairs, key).join(t.withColumnRenamed("h", "text_h"), ["item_id", "kind"])
    kind = docs.schema[key].dataType.simpleString()
    ikind = items.schema["item_id"].dataType.simpleString()
    long = fed.select(key, "item_id", "kind", "n", "text", "text_h").mapInArrow(_verify(key, share), f"{key} {kind}, item_id {ikind}, kind string, words int, n int").distinct()
    short = short_overlaps(d.select(key, hashed_words(F.col("text")).alias("h")), t, key)
    return long if short is None else long.unionByName(short)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` where the question is whole or two fifths of the paragraph are there."""
    got = overlaps(docs, items, share={"question": QUESTION_SHARE, "paragraph": PARAGRAPH_SHARE})
    need = F.when(F.col("kind") == "question", QUESTION_SHARE).otherwise(PARAGRAPH_SHARE)
    return got.where(F.col("words") >= need * F.col("n")).select("doc_id", "item_id").distinct()
