"""Best-fit decreasing packing of token sequences (operator 8).

Pieces are placed longest first, each into the open sequence with the least room that still takes it, found in a
segment tree over the remaining capacities. Lengths are small integers, so pieces of one length are alike: the plan
is made from the number of pieces of each length, at most ``capacity`` numbers however many documents there are, and
places whole runs of alike pieces into alike sequences at once. The outcome is that of placing one piece after
another. A piece then finds its place by its rank among the pieces of its length, which is counted in salted parts.

Defined results: a null or empty text is one piece that holds only the end token; ``doc_id`` may be null or repeated,
each row is packed for itself; ties are broken by doc_id, piece, and checksum; longer documents are cut into pieces of
``capacity``, the first being the shorter one; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedtide.llm.chunks import ChunkCache, packed_ids
from feedtide.llm.common import kept_in_worker, lists, map_texts
from feedtide.session import staged


class RoomTree:
    """Segment tree over remaining capacities: how many open sequences have each, and the tightest fit."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += n
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that an open sequence has."""
        node = self.leaves + need
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


#: The split pattern that byte-level BPE tokenizers have built in (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class Run:
    """A stretch of alike pieces in a stretch of alike sequences."""

    length: int
    first: int  # rank of its first piece among those of this length
    n: int
    sequence_first: int
    per_sequence: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Run]:
    """Where every piece goes, from the number of pieces of each length."""
    tree, open_runs, plan, sequences = RoomTree(capacity), {}, [], 0

    def reopen(room: int, first: int, n: int) -> None:
        if n and room:
            open_runs.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, n = sequences, -(-left // each)
                sequences, room = sequences + n, capacity
            else:
                first, n = open_runs[room].pop()
                tree.add(room, -n)
                each = room // length
            # Full sequences first, then one that takes what is left, then those not needed.
            full = min(n, left // each)
            if full:
                plan.append(Run(length, rank, full * each, first, each, capacity - room))
                reopen(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                plan.append(Run(length, rank, left, first + full, left, capacity - room))
                reopen(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            reopen(room, first + full, n - full)
    return plan


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE vocabularies write for each byte: printable ones stand for themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class TextEncoder:
    """The tokenizer of a file's content, behind a memory of the chunks it has met.

    A single match of the split pattern goes straight to the tokenizer's model, as letters for its bytes. The tokenizer
    cuts its added tokens out before anything else, so it gets texts that hold one whole.
    """

    def __init__(self, content: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.letters = _byte_letters()
        self.cache = ChunkCache(pattern, self.matches)
        self.added = [t["content"] for t in json.loads(content).get("added_tokens") or [] if t["content"]]

    def matches(self, parts: list[str]) -> list[bytes]:
        tokenize, letters, space = self.tokenizer.model.tokenize, self.letters, self.letters[0x20]
        spelt = (
            p.replace(" ", space) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(letters)
            for p in parts
        )
        return packed_ids([t.id for t in tokenize(p)] for p in spelt)

    def whole(self, parts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in made]

    def ids(self, texts: list[str]) -> list[bytes]:
        special = [i for i, text in enumerate(texts) if any(a in text for a in self.added)]
        if not special:
            return self.cache.ids(texts)
        apart = set(special)
        made = self.cache.ids(["" if i in apart else text for i, text in enumerate(texts)])
        for i in special:  # one at a time: texts may be long
            (made[i],) = self.whole([texts[i]])
        return made


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""
    with open(tokenizer_path, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(texts, batch):
        key = f"packing {zlib.crc32(content.value.encode())}"
        encoder = kept_in_worker(key, lambda: TextEncoder(content.value, PATTERN))
        counts, pieces = [], []
        for body in encoder.ids(texts):
            body += end
            total = len(body) // 4
            cuts = [0, *range(total % capacity or capacity, total + 1, capacity)]
            counts.append(len(cuts) - 1)
            pieces += [
                (i, a, b - a, zlib.crc32(body[4 * a : 4 * b]), body[4 * a : 4 * b] if with_ids else b"")
                for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
            ]
        columns = list(zip(*pieces)) or [()] * 5
        fields = {
            "piece": pa.array(columns[0], pa.int32()),
            "start": pa.array(columns[1], pa.int64()),
            "length": pa.array(columns[2], pa.int64()),
            "ids_crc32": pa.array(columns[3], pa.int64()),
        }
        if with_ids:
            values = np.frombuffer(b"".join(columns[4]), dtype="<u4").astype(np.int32)
            fields["ids"] = lists(values, [len(p) // 4 for p in columns[4]])
        rows = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
        return [lists(rows, counts)]

    fields = "piece:int,start:bigint,length:bigint,ids_crc32:bigint" + ",ids:array<int>" * with_ids
    made = map_texts(docs, ["doc_id"], f"pieces array<struct<{fields}>>", work)
    return made.select("doc_id", F.inline("pieces"))


def pack(pieces: DataFrame, capacity: int, salts: int = 64) -> DataFrame:
    """``pieces`` (stored, as ``tokenized_pieces`` makes them) with ``sequence_id`` and ``offset``.

    A length may hold a third of all pieces, so ranks are counted in ``salts`` parts of each length. The numbers of
    pieces by length and part are at most ``capacity * salts`` rows; they and the plan are all that is broadcast.
    """
    spark = pieces.sparkSession
    order = ["doc_id", "piece", "ids_crc32", "start"]
    salted = pieces.withColumn("part_", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    parts = salted.groupBy("length", "part_").agg(F.count("*").alias("n_")).toPandas().sort_values(["length", "part_"])
    if parts.empty:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    parts["before_"] = parts.groupby("length")["n_"].cumsum() - parts["n_"]
    plan = best_fit_decreasing({int(k): int(v) for k, v in parts.groupby("length")["n_"].sum().items()}, capacity)
    runs: dict[int, list[tuple[int, ...]]] = {}
    for r in plan:
        runs.setdefault(r.length, []).append((r.first, r.sequence_first, r.per_sequence, r.offset))
    columns = {length: np.array(own).T for length, own in runs.items()}
    table = [(int(p.length), int(p.part_), int(p.before_)) for p in parts.itertuples()]
    before = spark.createDataFrame(table, "length long, part_ int, before_ long")
    shared = spark.sparkContext.broadcast(columns)

    def place(batches):
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy() for i in (batch.num_columns - 2, batch.num_columns - 1))
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                rows = np.nonzero(lengths == length)[0]
                own = shared.value[int(length)]
                first, start, per, base = own[:, np.searchsorted(own[0], ranks[rows], side="right") - 1]
                within = ranks[rows] - first
                sequence[rows] = start + within // per
                offset[rows] = base + within % per * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:-2], "sequence_id", "offset"],
            )

    window = Window.partitionBy("length", "part_").orderBy(*order)
    ranked = (
        salted.join(F.broadcast(before), ["length", "part_"])
        .withColumn("rank_", F.row_number().over(window) - 1 + F.col("before_"))
        .select(*pieces.columns, F.col("length").alias("length_"), F.col("rank_").cast("long"))
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Tokenize, store the piece table (a few numbers a piece), and pack it."""
    return pack(staged(tokenized_pieces(docs, tokenizer_path, end_id, capacity), "pieces"), capacity)
