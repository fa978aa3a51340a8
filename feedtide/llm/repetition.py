"""Quality rules with suffix-array repetition (operator 7).

The words of a document get a suffix array; the longest common prefixes of neighbours in it bound the intervals of
suffixes that repeat. A suffix whose longest common prefix with a neighbour has ``least`` words or more starts a maximal
repeated substring; their spans are united. A document fails when the spans cover too large a part of its words or the
longest repeat is too long. Many documents are sorted at once: the document's number is part of the first sort key, so
suffixes of different documents never meet, and only suffixes that are still tied are sorted again, by the ranks twice
as far on.

Defined results: null and empty texts have no words and fail the base rules; ``doc_id`` may be null or repeated, each
row is judged for itself; no text is too long. An empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from feedtide.llm.common import WORD, map_texts

_WORD = re.compile(WORD)
_SYMBOL = re.compile(r"[#*$%&|<>]")


def suffix_ranks(first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``first`` by doubling, and the ranks of prefixes of 1, 2, 4, ... symbols, until none tie.

    Symbols must tell documents apart, and the last symbol of each document must be unlike any other.
    """
    order = np.argsort(first)
    rank = _dense(first[order], order)
    ranks, step = [rank], 1
    while True:
        ordered = rank[order]
        tied = np.zeros(len(order), bool)
        same = ordered[1:] == ordered[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        where = np.nonzero(tied)[0]
        if not len(where):
            return order, ranks
        rows = order[where]  # none is the last of its document, so rows + step stays within the array
        ahead = rank[np.minimum(rows + step, len(rank) - 1)]
        pairs = rank[rows] * len(rank) + ahead
        again = np.argsort(pairs)
        order[where] = rows[again]
        # New ranks: the place of the first suffix of each class, so that untied ones keep theirs.
        pairs = pairs[again]
        fresh = np.ones(len(where), bool)
        fresh[1:] = pairs[1:] != pairs[:-1]
        rank = rank.copy()
        rank[order[where]] = where[np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))]
        ranks.append(rank)
        step *= 2


def _dense(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each symbol the place of the first of its class."""
    starts = np.ones(len(ordered), bool)
    starts[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(ordered), np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(len(ordered)), 0))
    return rank


def neighbour_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix in the array with the one before it."""
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(order), np.int64)
    size = len(order)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < size) & (b < size)
        same = np.zeros(len(a), bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        step = same.astype(np.int64) << k
        common[1:] += step
        a, b = a + step, b + step
    return common


def repeats(documents: list[list[int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words covered by repeated substrings of ``least`` words or more, and the longest repeat, for each document."""
    lengths = np.array([len(d) for d in documents], np.int64)
    ends = np.cumsum(lengths + 1)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = ends - lengths - 1
    document = np.repeat(np.arange(len(documents)), lengths + 1)
    words = np.zeros(total, np.int64)
    inner = np.ones(total, bool)
    inner[ends - 1] = False
    words[inner] = np.fromiter((w for d in documents for w in d), np.int64, int(lengths.sum())) + 1
    order, ranks = suffix_ranks(document * (int(words.max()) + 1) + words)
    common = neighbour_prefixes(order, ranks)
    longest = common.copy()
    longest[:-1] = np.maximum(longest[:-1], common[1:])
    reach = np.zeros(total, np.int64)
    reach[order] = longest
    start = np.nonzero(reach >= least)[0]
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + reach[start], -1)
    covered = np.cumsum(steps[:-1]) > 0
    most = np.maximum.reduceat(reach, starts)
    return np.add.reduceat(covered.astype(np.int64), starts), np.where(most >= least, most, 0)


def base_counts(text: str) -> tuple[list[str], int, int, int, int]:
    """Words and the four counts of one text."""
    words = _WORD.findall(text)
    seen: set[str] = set()
    lines = 0
    for line in text.split("\n"):
        if line in seen:
            lines += 1
        elif _WORD.search(line):
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    often = {w for w, n in Counter(windows).items() if n > 1}
    repeated, until = 0, 0
    if often:
        for i, window in enumerate(windows):
            if window in often:
                repeated += i + 3 - max(i, until)
                until = i + 3
    return words, sum(map(len, words)), len(_SYMBOL.findall(text)), lines, repeated


def judge(docs: DataFrame, least: int = 10, most_covered: float = 0.3, longest: int = 200) -> DataFrame:
    """Counts and verdict for every row. ``least``: words that make a repeat; ``most_covered``: allowed part of the
    words inside repeats; ``longest``: allowed words of the longest repeat."""

    def work(texts, batch):
        made = [base_counts(t) for t in texts]
        numbers: dict[str, int] = {}
        coded = [[numbers.setdefault(w, len(numbers)) for w in words] for words, *_ in made]
        covered, most = [], []
        at = 0
        while at < len(coded):  # about a million words at a time
            upto, size = at, 0
            while upto < len(coded) and (upto == at or size + len(coded[upto]) < 1_000_000):
                size += len(coded[upto]) + 1
                upto += 1
            part = repeats(coded[at:upto], least)
            covered.append(part[0])
            most.append(part[1])
            at = upto
        covered, most = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (covered, most))
        n = np.array([len(m[0]) for m in made], np.int64)
        chars, symbols, lines, repeated = (np.array([m[i] for m in made], np.int64) for i in (1, 2, 3, 4))
        failed = (n < 50) | (100 * repeated > 50 * n)
        kept = ~failed & (covered <= most_covered * n) & (most <= longest)
        return [pa.array(x) for x in (n, chars, symbols, lines, repeated, failed, kept, covered, most)]

    return map_texts(
        docs,
        ["doc_id"],
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, n_covered_words long, longest_repeat long",
        work,
    )
