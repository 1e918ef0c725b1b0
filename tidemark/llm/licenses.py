"""License scans by diagonal voting.

Every text's words give rolling hashes of 2 and of 5 words. All of them meet, in one Spark join, the table of template
positions with the same hash. A match votes for the diagonal (word position less template position); a copied
passage puts all its votes on one diagonal, and where words were inserted or left out, on a few neighbouring ones.
Diagonals no further apart than NEAR, from the first to the last, are merged. The merged span is then verified: of its
matches the longest sequence is kept in which both text and template go forward, so a template position counts
once and in its place; the template's words that this sequence holds are counted, and the passage stands if they are the
COVER share of all of them.

Short phrases are templates of two-word hashes and stand only where one diagonal holds all their hashes, which is a
place where the phrase's words stand consecutively. License texts and notices, whole, are templates of five-word hashes.

The template table is a constant of about a thousand rows, so it is broadcast; text hashes are never shuffled, only votes.

Edge cases: a null or empty text has no words and no labels; repeated rows get a row each; a null doc_id is an id like
any other; columns that are not named are ignored; a long text's votes are verified in one task, a few numbers for each
match; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Common licenses, or the notices that files carry, in lower case and without punctuation.
PASSAGES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
    "the software or the use or other dealings in the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
    "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
    "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
    "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details "
    "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness "
    "for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
    "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
    "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
    "appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "cc": "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0",
}
PHRASE_K, PASSAGE_K = 2, 5
#: The spread of diagonals that belong to one passage; the share of a passage's words that must be found in order.
NEAR, COVER = 12, 0.6
#: A hash that every text has once in its list, so that texts without any match come through the join too.
EVERY = -1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_WORD = bytes(32 if i <= 0x2F or 0x3A <= i <= 0x60 or 0x7B <= i <= 0x7F else i for i in range(256))
#: Word hashes kept per worker.
CACHE = 500_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII characters that are neither letters nor digits."""
    return text.lower().translate(_WORD).split()


def rolling(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """The polynomial hash of each k consecutive words (as signed 64-bit numbers; never EVERY)."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * _FACTOR + word_hashes[i : i + n]
            out ^= out >> np.uint64(29)
    signed = out.view(np.int64)
    return np.where(signed == EVERY, 0, signed)


def _of(words_: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words_), np.uint64, len(words_))


def _templates() -> list[tuple[str, str, int]]:
    """(text, label, words of a hash); a template's number is its place here."""
    return [(t, label, PHRASE_K) for t, label in PHRASES.items()] + [(t, label, PASSAGE_K) for label, t in PASSAGES.items()]


def templates() -> list[tuple[int, int, int, int]]:
    """(hash, template, position, words of a hash)."""
    grams = [(number, k, rolling(_of(words(text.encode())), k).tolist()) for number, (text, _, k) in enumerate(_templates())]
    return [(h, number, at, k) for number, k, own in grams for at, h in enumerate(own)]


def template_table(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"({h}L, {t}, {p}, {k})" for h, t, p, k in [*templates(), (EVERY, -1, 0, 0)])
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(h, template, at, k)")


def text_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_words and all hashes of a text: EVERY, then those of two words, then those of five."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, len(big), 256):
                b = big.slice(start, 256)
                counts, parts, ends = [], [], [0]
                for x in b.column("b").to_pylist():
                    h = _of(words(x or b""))
                    own = [np.array([EVERY], np.int64), rolling(h, PHRASE_K), rolling(h, PASSAGE_K)]
                    parts += own
                    ends.append(ends[-1] + sum(map(len, own)))
                    counts.append(len(h))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(counts, pa.int64()), lists], ["doc_id", "th", "n_words", "hashes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("b")).mapInArrow(run, f"doc_id {kind}, th long, n_words long, hashes array<long>")


def _covered(hits: list[tuple[int, int]], k: int) -> tuple[int, int, int]:
    """Template words in the longest run of hits (place, template position) that goes forward in both; its first and last place."""
    hits = sorted(hits, key=lambda h: (h[0], -h[1]))
    tails: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for i, (_, at) in enumerate(hits):
        j = bisect_left(tails, at)
        back.append(last[j - 1] if j else -1)
        if j == len(tails):
            tails.append(at)
            last.append(i)
        else:
            tails[j], last[j] = at, i
    n, i, upper, end = 0, last[-1], 10**9, hits[last[-1]][0]
    while i >= 0:
        place, at = hits[i]
        n += min(k, upper - at)
        upper, start, i = at, place, back[i]
    return n, start, end + k


def verified(diagonals: list[tuple[int, list[int]]], n_words: int, k: int) -> tuple[float, int, int]:
    """The best share of a template's n_words that a merged span covers, and the span.

    diagonals: (diagonal, template positions that match on it). Every window of diagonals NEAR wide is one merged span.
    """
    diagonals = sorted(diagonals)
    best, lo, inside = (0.0, 0, 0), 0, Counter()
    for hi, (d, ats) in enumerate(diagonals):
        inside.update(ats)
        while diagonals[lo][0] < d - NEAR:
            for at in diagonals[lo][1]:
                inside[at] -= 1
                if not inside[at]:
                    del inside[at]
            lo += 1
        # no span can cover more than this, so only what may be better is looked at closely
        if min(n_words, len(inside) * k) > best[0] * n_words:
            n, start, end = _covered([(diag + at, at) for diag, own in diagonals[lo : hi + 1] for at in own], k)
            best = max(best, (n / n_words, start, end), key=lambda b: b[0])
        if best[0] == 1:
            break
    return best


def judge(hits: list[dict]) -> tuple[list[int], list[str], list[str], float]:
    """places, base_labels, labels and score of one document. hits: template, diagonal, ats."""
    by: dict[int, list[tuple[int, list[int]]]] = {}
    for h in hits:
        by.setdefault(h["template"], []).append((h["diagonal"], h["ats"]))
    places, base, labels, score = [], set(), set(), 0.0
    for number, (text, label, k) in enumerate(_templates()):
        own = by.get(number, [])
        n_words = len(text.split())
        if k == PHRASE_K:
            full = [d for d, ats in own if len(ats) == n_words - k + 1]
            places += full
            if full:
                base.add(label)
                score = 1.0
        elif own:
            cover = verified(own, n_words, k)[0]
            if cover >= COVER:
                labels.add(label)
            score = max(score, cover if cover >= COVER else cover / 2)
    return sorted(places), sorted(base), sorted(base | labels), score


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, places (array of phrase starts), base_labels, labels, score."""
    grams = text_hashes(docs).select("doc_id", "th", "n_words", F.posexplode("hashes").alias("i", "h"))
    hits = grams.join(F.broadcast(template_table(docs.sparkSession)), "h")
    two = F.greatest(F.col("n_words") - (PHRASE_K - 1), F.lit(0))
    pos = F.when(F.col("k") == PASSAGE_K, F.col("i") - 1 - two).otherwise(F.col("i") - 1)
    key = ["doc_id", "th", "n_words"]
    # rows that are equal vote together; EVERY counts them
    votes = hits.groupBy(*key, "template", (pos - F.col("at")).alias("diagonal")).agg(F.sort_array(F.collect_set("at")).alias("ats"), F.count(F.lit(1)).alias("votes"))
    one = F.when(F.col("template") >= 0, F.struct("template", F.col("diagonal").cast("long").alias("diagonal"), "ats"))
    per = votes.groupBy(*key).agg(F.max(F.when(F.col("template") == -1, F.col("votes"))).alias("copies"), F.collect_list(one).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge(h) for h in b.column("hits").to_pylist()]
            kinds = {"places": pa.list_(pa.int64()), "base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string()), "score": pa.float64()}
            found = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "n_words", "copies")], *found], ["doc_id", "n_words", "copies", *kinds])

    kind = docs.schema["doc_id"].dataType.simpleString()
    judged = per.mapInArrow(run, f"doc_id {kind}, n_words long, copies long, places array<long>, base_labels array<string>, labels array<string>, score double")
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")
