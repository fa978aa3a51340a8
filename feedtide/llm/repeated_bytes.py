"""Suffix-array dedup (operator 10): bytes in strings of 100 that started earlier are removed, across all texts.

Anchors. Of every run of windows, the one with the least hash is an anchor, so any 100 bytes hold one, the same
wherever they stand. An anchor's surroundings, 60 bytes on each side, hold all strings of 100 bytes it speaks for. Only
anchors whose hash repeats matter. Anchors with equal surroundings are one: all but the first of them repeat it wholly.

Suffix arrays. What is left are anchors with equal hashes and different surroundings, at the ends of repeated passages
and around edits. They are dealt into shards by hash, and each shard gets a suffix array by induced sorting: suffixes
are classified as smaller or larger than the next, the substrings between leftmost smaller ones are sorted and named,
recursively while names repeat, and the order of all suffixes is induced from theirs in linear time. Permuted common
prefixes, taken in text order, give runs of suffixes that share 100 bytes; in each run all but the earliest string
(smallest doc_id, then place) are repeats.

An anchor hash with more than ``MOST_IN_SHARD`` surroundings, such as the start of a passage in very many texts, would
make one shard large. Its strings are compared by an aggregate on a digest of each string instead, which has no groups.

Defined results: a null text counts as empty; documents that share a doc_id come in the order of a hash of their text;
full copies of a row are one document, so they don't repeat each other, and each gets its result; a null doc_id comes
after all others. Texts are whole, and matches never cross documents. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedtide.llm.common import bit_map, in_map, lists, map_texts, row_key
from feedtide.llm.repetition import suffix_ranks
from feedtide.session import staged

LENGTH = 100
GRAM = 40
#: A string of LENGTH bytes has this many windows of GRAM bytes, of which one at least is an anchor.
WINDOWS = LENGTH - GRAM + 1
SIDE = LENGTH - GRAM
MOST_IN_SHARD = 2048
SHARD_ANCHORS = 4_000
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


# --------------------------------------------------------------------------- suffix arrays by induced sorting


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix array from leftmost-smaller suffixes in order (by first symbol at least): larger ones left to right, then smaller ones right to left.

    A symbol's bucket is worked off as a block: what a block puts into its own bucket follows in the next block.
    """
    n = len(text)
    text = text.astype(np.uint16)  # short integers are sorted by radix
    counts = np.bincount(text, minlength=alphabet)
    ends = np.cumsum(counts)
    starts = ends - counts
    array = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
    # Seeds at the ends of their buckets, in their order.
    own = text[seeds]
    per = np.bincount(own, minlength=alphabet)
    first = np.cumsum(per) - per
    array[ends[own] - per[own] + (np.arange(len(seeds)) - first[own])] = seeds

    heads = starts.copy()
    present = np.nonzero(counts)[0]

    def put_left(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            symbols = text[before]
            order = np.argsort(symbols, kind="stable")
            before, symbols = before[order], symbols[order]
            number = np.bincount(symbols, minlength=alphabet)
            rank = np.arange(len(before)) - (np.cumsum(number) - number)[symbols]
            array[heads[symbols] + rank] = before
            heads[:] += number

    for symbol in present:
        at = starts[symbol]
        while at < heads[symbol]:  # larger suffixes, some put there just now
            upto = heads[symbol]
            put_left(array[at:upto])
            at = upto
        tail = array[max(at, ends[symbol] - per[symbol]) : ends[symbol]]
        put_left(tail[tail >= 0])

    # Smaller suffixes anew: the seeds served only to order the larger ones.
    tails = ends.copy()

    def put_right(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[smaller[before]]
        if len(before):
            before = before[::-1]
            symbols = text[before]
            order = np.argsort(symbols, kind="stable")
            before, symbols = before[order], symbols[order]
            number = np.bincount(symbols, minlength=alphabet)
            rank = np.arange(len(before)) - (np.cumsum(number) - number)[symbols]
            array[tails[symbols] - 1 - rank] = before
            tails[:] -= number

    for symbol in present[::-1]:
        upto = ends[symbol]
        while upto > tails[symbol]:
            at = tails[symbol]
            put_right(array[at:upto])
            upto = at
        put_right(array[starts[symbol] : heads[symbol]])
    return array


def suffix_array(text: np.ndarray, small: int = 512) -> np.ndarray:
    """Suffix array of symbols whose last is the least and unlike any other.

    A recursion whose alphabet has more than ``small`` symbols is sorted by doubling, as its buckets are too many to be
    worked off one by one.
    """
    n = len(text)
    alphabet = int(text.max()) + 1 if n else 1
    small = min(small, 1 << 16)
    if n < 3 or alphabet > small:
        return _doubled(text)
    # A suffix is smaller than the next if its symbol is, or on equal symbols if the next is smaller than its next.
    changes = text[1:] != text[:-1]  # the last symbol is unlike the one before, so each position has a change ahead
    inner = np.nonzero(changes)[0][np.cumsum(changes) - changes]
    smaller = np.zeros(n, bool)
    smaller[: n - 1] = text[inner] < text[inner + 1]
    smaller[n - 1] = True
    leftmost = np.nonzero(smaller[1:] & ~smaller[:-1])[0] + 1
    if len(leftmost) < 2:
        return _induce(text, smaller, leftmost, alphabet)
    # Sort the substrings between leftmost smaller suffixes by inducing from them in any order of their kind.
    rough = _induce(text, smaller, leftmost[np.argsort(text[leftmost], kind="stable")], alphabet)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    ordered = rough[is_leftmost[rough]]
    place = (np.cumsum(is_leftmost) - 1)[ordered]
    stop = np.r_[leftmost[1:], n - 1]
    length = stop[place] - ordered + 1
    differs = np.ones(len(ordered), bool)
    differs[1:] = length[1:] != length[:-1]
    open_ = np.nonzero(~differs)[0]
    step = 0
    while len(open_):  # symbol by symbol, only where neighbours still agree
        a, b = ordered[open_ - 1] + step, ordered[open_] + step
        unlike = (text[a] != text[b]) | (smaller[a] != smaller[b])
        differs[open_[unlike]] = True
        step += 1
        open_ = open_[~unlike & (length[open_] > step)]
    names = np.empty(len(leftmost), np.int64)
    names[place] = np.cumsum(differs) - 1
    if differs.all():
        return _induce(text, smaller, ordered, alphabet)
    return _induce(text, smaller, leftmost[suffix_array(names, small)], alphabet)


def _doubled(text: np.ndarray) -> np.ndarray:
    return suffix_ranks(text)[0]


def permuted_prefixes(text: np.ndarray, array: np.ndarray, most: int, among: np.ndarray | None = None) -> np.ndarray:
    """For each position, how many symbols its suffix shares with the one before it in the array, up to ``most``.

    With ``among`` only pairs whose positions both are marked are compared; others get 0. Positions are compared in text order, four symbols at a time, and leave when they differ.
    """
    n = len(text)
    shared = np.zeros(n, np.int64)
    if n < 2:
        return shared
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    padded = np.r_[text, np.zeros(most + 8, text.dtype)].astype(np.uint64)
    four = padded[:-3] | padded[1:-2] << np.uint64(16) | padded[2:-1] << np.uint64(32) | padded[3:] << np.uint64(48)
    # The last symbol is unlike any other, so no two suffixes agree beyond it.
    at = np.nonzero(before >= 0)[0]
    if among is not None:
        at = at[among[at] & among[before[at]]]
    depth = 0
    while len(at) and depth < most:
        same = four[at + depth] == four[before[at] + depth]
        done = at[~same]
        if len(done):
            left = np.zeros(len(done), np.int64)
            going = np.ones(len(done), bool)
            for k in range(4):
                going &= padded[done + depth + k] == padded[before[done] + depth + k]
                left += going
            shared[done] = depth + left
        at = at[same]
        depth += 4
    shared[at] = depth
    return np.minimum(shared, most)


def repeats_in_shard(contexts: list[bytes], order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of every string of ``LENGTH`` bytes that a text holds earlier, among all contexts.

    ``order`` ranks the context's document, ``starts`` is where the context begins in it.
    """
    lengths = np.array([len(c) for c in contexts], np.int64)
    joined = np.frombuffer(b"\0".join(contexts) + b"\0\0", np.uint8).astype(np.int64) + 2
    begins = np.cumsum(lengths + 1) - lengths - 1
    joined[begins + lengths] = 1  # between contexts
    joined[-1] = 0
    array = suffix_array(joined)
    context = np.repeat(np.arange(len(contexts)), lengths + 1)
    offset = np.arange(len(context)) - begins[context]
    whole = np.zeros(len(joined), bool)
    whole[: len(context)] = offset + LENGTH <= lengths[context]
    # A string's neighbour with as long a prefix is whole, too: neither holds a symbol between contexts.
    shared = permuted_prefixes(joined, array, LENGTH, whole)
    # Runs of the array whose strings are equal: a run goes on where a suffix shares LENGTH bytes with the one before.
    goes_on = (shared[array] >= LENGTH) & whole[array]
    run = np.cumsum(~goes_on)
    members = np.nonzero(whole[array] & (goes_on | np.r_[goes_on[1:], False]))[0]
    where, run = array[members], run[members]
    rank, place = order[context[where]], starts[context[where]] + offset[where]
    by = np.lexsort((place, rank, run))
    where, run, rank, place = where[by], run[by], rank[by], place[by]
    first = np.r_[True, run[1:] != run[:-1]][: len(run)]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
    later = (rank != rank[lead]) | (place != place[lead])
    return context[where[later]], offset[where[later]]


# --------------------------------------------------------------------------- anchors


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or largest of each ``width`` neighbours; the result is shorter by ``width - 1``."""
    pick, size, made = (np.minimum if least else np.maximum), 1, values.copy()
    while size < width:
        step = min(size, width - size)
        made = pick(made[:-step], made[step:], out=made[:-step])
        size += step
    return made


_TABLE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The first powers of the hash's base and of its inverse, at least ``n`` of them."""
    if not _POWERS or len(_POWERS[0]) <= n:
        made = [np.full(max(2 * n, 1 << 18), base, np.uint64) for base in (_ODD, _INVERSE)]
        for values in made:
            values[0] = 1
        _POWERS[:] = [np.cumprod(values) for values in made]
    return _POWERS


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the anchors of all texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    total = int(lengths.sum())
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if total < LENGTH:
        return none
    data = np.frombuffer(b"".join(texts), np.uint8)
    # Polynomial hashes of all windows from prefix sums, modulo 2^64.
    up, down = _powers(total)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(_TABLE[data] * down[:total], out=sums[1:])
    hashes = (sums[GRAM:] - sums[:-GRAM]) * up[: total - GRAM + 1]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    hashes |= np.uint64(1)
    ends = np.cumsum(lengths)
    least = _sliding(hashes, WINDOWS, True)  # of the string that starts there
    for end in ends.tolist():
        least[max(0, end - LENGTH + 1) : end] = 0  # it would cross into the next text
    reach = _sliding(np.r_[np.zeros(WINDOWS - 1, np.uint64), least, np.zeros(WINDOWS - 1, np.uint64)], WINDOWS, False)
    place = np.nonzero(reach[: len(hashes)] == hashes)[0]
    if not len(place):
        return none
    found, text = hashes[place], np.searchsorted(ends, place, side="right")
    # Where a hash ties with its neighbours (periodic text), the first and last of each stretch do.
    new = np.r_[True, (found[1:] != found[:-1]) | (text[1:] != text[:-1])]
    begin = place[np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))]
    block = (place - begin) // (WINDOWS // 2)
    edge = np.r_[True, new[1:] | (block[1:] != block[:-1])]
    edge |= np.r_[edge[1:], True]
    place, found, text = place[edge], found[edge], text[edge]
    found = found * np.uint64(_ODD)  # least hashes have leading zeros
    found ^= found >> np.uint64(32)
    found *= np.uint64(0x94D049BB133111EB)
    return text, place - (ends - lengths)[text], found.view(np.int64)


def _in_groups(texts: list[str], size: int = 150_000):
    """Stretches of the texts' bytes of about ``size`` bytes, whose arrays stay near the core; and the first's number."""
    at = 0
    while at < len(texts):
        group, total, first = [], 0, at
        while at < len(texts) and (not group or total < size):
            group.append(texts[at].encode())
            total += len(group[-1])
            at += 1
        yield first, group


def _anchor_hashes(docs: DataFrame) -> DataFrame:
    def work(texts, batch):
        found, counts = [], []
        for _, group in _in_groups(texts):
            text, _, hashes = anchors(group)
            found.append(hashes)
            counts += np.bincount(text, minlength=len(group)).tolist()
        return [lists(np.concatenate([*found, np.zeros(0, np.int64)]), counts)]

    return map_texts(docs, [], "hashes array<long>", work).select(F.explode("hashes").alias("hash"))


def _hash_map(docs: DataFrame, wanted: DataFrame):
    return docs.sparkSession.sparkContext.broadcast(bit_map(wanted, "hash"))


def _anchors_in(docs: DataFrame, wanted: DataFrame, with_bytes: bool) -> DataFrame:
    """Anchors whose hash may be in ``wanted``: ``doc_id, row_, hash, around, place, low, high`` and, if asked, ``bytes``.

    One that the map lets through in error has a hash of its own, and so no copies and one kind of surroundings.
    """
    bits = _hash_map(docs, wanted)
    ddl = "hash:bigint,around:bigint,place:bigint,low:bigint,high:bigint" + ",bytes:binary" * with_bytes

    def work(texts, batch):
        counts: list[int] = []
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        parts: list[bytes] = []
        for _, group in _in_groups(texts):
            text, place, found = anchors(group)
            own = in_map(bits.value, found)
            text, place, found = text[own], place[own], found[own]
            counts += np.bincount(text, minlength=len(group)).tolist()
            low = np.maximum(place - SIDE, 0)
            high = np.minimum(place + LENGTH, np.array([len(t) for t in group], np.int64)[text])
            pieces = [group[t][a:b] for t, a, b in zip(text.tolist(), low.tolist(), high.tolist())]
            # The seed tells how far the surroundings reach back.
            around = [
                xxhash.xxh3_64_intdigest(piece, seed=left) - (1 << 63) for piece, left in zip(pieces, (place - low).tolist())
            ]
            for column, values in zip(columns, (found, np.array(around, np.int64), place, low, high)):
                column.append(values)
            if with_bytes:
                parts += pieces
        arrays = [pa.array(np.concatenate([*c, np.zeros(0, np.int64)])) for c in columns]
        names = ["hash", "around", "place", "low", "high"]
        if with_bytes:
            arrays, names = [*arrays, pa.array(parts, pa.binary())], [*names, "bytes"]
        return [lists(pa.StructArray.from_arrays(arrays, names=names), counts)]

    made = map_texts(docs, ["doc_id", "row_"], f"found array<struct<{ddl}>>", work)
    return made.select("doc_id", "row_", F.inline("found"))


# --------------------------------------------------------------------------- the job


def _by_suffix_arrays(contexts: DataFrame) -> DataFrame:
    """Repeated strings among ``contexts`` of anchors with few surroundings: ``doc_id, row_, low, high``."""
    shards = max(1, -(-contexts.count() // SHARD_ANCHORS))
    dealt = contexts.select(
        F.pmod(F.xxhash64("hash"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "row_", "low", "bytes"
    )
    kind = dealt.schema["doc_id"].dataType.simpleString()

    def solve(table: pa.Table) -> pa.Table:
        ids, rows, lows = (table.column(c).to_pandas() for c in ("doc_id", "row_", "low"))
        frame = ids.to_frame("d").assign(r=rows)
        order = frame.sort_values(["d", "r"], na_position="last")
        changed = (order != order.shift()) & ~(order.isna() & order.shift().isna())
        rank = np.empty(len(frame), np.int64)
        rank[order.index.to_numpy()] = np.cumsum(changed.any(axis=1).to_numpy())
        context, offset = repeats_in_shard(table.column("bytes").to_pylist(), rank, lows.to_numpy(np.int64))
        # Neighbouring strings of a context make one span.
        by = np.lexsort((offset, context))
        context, offset = context[by], offset[by]
        new = np.r_[True, (context[1:] != context[:-1]) | (offset[1:] > offset[:-1] + LENGTH)][: len(context)]
        begin = np.nonzero(new)[0]
        end = np.r_[begin[1:], len(context)] - 1 if len(begin) else begin
        own = context[begin]
        low = lows.to_numpy(np.int64)[own]
        return pa.table(
            {
                "doc_id": table.column("doc_id").take(pa.array(own)),
                "row_": table.column("row_").take(pa.array(own)),
                "low": pa.array(low + offset[begin], pa.int64()),
                "high": pa.array(low + offset[end] + LENGTH, pa.int64()),
            }
        )

    return dealt.groupBy("shard").applyInArrow(solve, f"doc_id {kind}, row_ long, low long, high long")


def _by_digests(contexts: DataFrame) -> DataFrame:
    """The same among anchors with very many surroundings: each string's digest, and the first place of each."""
    kind = contexts.schema["doc_id"].dataType.simpleString()

    def strings(batches):
        for batch in batches:
            ids, lows, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "low", "bytes"))
            row, at, first, second = [], [], [], []
            for i, (low, text) in enumerate(zip(lows.to_pylist(), texts.to_pylist())):
                for k in range(len(text) - LENGTH + 1):
                    digest = xxhash.xxh3_128_intdigest(text[k : k + LENGTH])
                    row.append(i)
                    at.append(low + k)
                    first.append((digest >> 64) - (1 << 63))
                    second.append((digest & (1 << 64) - 1) - (1 << 63))
            rows = batch.column(batch.schema.get_field_index("row_"))
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(taken), rows.take(taken), *(pa.array(x, pa.int64()) for x in (at, first, second))],
                names=["doc_id", "row_", "at", "d1", "d2"],
            )

    found = contexts.select("doc_id", "row_", "low", "bytes").mapInArrow(
        strings, f"doc_id {kind}, row_ long, at long, d1 long, d2 long"
    )
    found = staged(found.withColumn("where_", _order("at")), "string-digests")
    firsts = found.groupBy("d1", "d2").agg(F.min("where_").alias("a"), F.max("where_").alias("b")).where("a <> b")
    met = found.join(firsts, ["d1", "d2"]).where(F.col("where_") != F.col("a"))
    return met.select("doc_id", "row_", F.col("at").alias("low"), (F.col("at") + LENGTH).alias("high"))


def _order(place: str):
    return F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row_", F.col(place).alias("place"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, row_, low, high``: byte spans to remove, overlapping ones among them. ``docs`` has ``row_``."""
    twice = _anchor_hashes(docs).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    twice = staged(twice, "repeated-hashes")
    again = staged(_anchors_in(docs, twice, False), "repeated-anchors")
    again = again.select("hash", "around", _order("place").alias("where_"), "low", "high")
    firsts = again.groupBy("hash", "around").agg(F.min("where_").alias("first"))
    firsts = staged(firsts, "first-surroundings")
    copies = again.join(firsts, ["hash", "around"]).where(F.col("where_") != F.col("first"))
    copies = copies.where(f"high - low >= {LENGTH}").select("where_.doc_id", "where_.row_", "low", "high")

    kinds = firsts.groupBy("hash").agg(F.count("*").alias("kinds")).where("kinds > 1")
    kinds = staged(kinds, "surroundings-by-hash")
    contexts = _anchors_in(docs, kinds, True)
    contexts = contexts.groupBy("hash", "around").agg(
        F.min_by(F.struct("doc_id", "row_", "low", "bytes"), _order("place")).alias("c")
    )
    contexts = contexts.select("hash", "c.*").join(kinds, "hash")
    contexts = staged(contexts, "surroundings")
    few = _by_suffix_arrays(contexts.where(F.col("kinds") <= MOST_IN_SHARD))
    many = _by_digests(contexts.where(F.col("kinds") > MOST_IN_SHARD))
    return copies.unionByName(few).unionByName(many)


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            if high > out[-1][1]:
                out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    keyed = docs.select("doc_id", F.col("text"), row_key().alias("row_"))
    spans = repeated_spans(keyed).groupBy("doc_id", "row_").agg(
        F.collect_list(F.struct("low", "high")).alias("spans_")  # at most a few for each anchor of one text
    )
    spans = spans.withColumnRenamed("doc_id", "of_").withColumnRenamed("row_", "of_row_")
    rows = keyed.join(spans, (F.col("row_") == F.col("of_row_")) & F.col("doc_id").eqNullSafe(F.col("of_")), "left")

    def work(texts, batch):
        cuts = batch.column(batch.schema.get_field_index("spans_")).to_pylist()
        sizes, removed, runs, digests = [], [], [], []
        for text, cut in zip(texts, cuts):
            data = text.encode()
            own = _united([(c["low"], c["high"]) for c in cut or ()])
            digest, at = hashlib.sha256(), 0
            for low, high in own:
                digest.update(data[at:low])
                at = high
            digest.update(data[at:])
            sizes.append(len(data))
            removed.append(sum(high - low for low, high in own))
            runs.append(len(own))
            digests.append(digest.hexdigest())
        return [*(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(digests, pa.string())]

    made = map_texts(rows, ["doc_id", "spans_"], "n_bytes long, n_removed long, n_spans long, kept_sha256 string", work)
    return made.drop("spans_")
