"""Byte-level BPE (operator 5): encoding by a lazily determinised transducer, decoding as a stream.

Encoding. Every prefix of a pretoken has one BPE encoding, whose last token is the only vocabulary entry that ends
there and stays separate next to the token before it. The nondeterministic transducer guesses where tokens start;
a determinised state holds the starts that can still grow into a token (nodes of the vocabulary trie), each with the
tokens since the last point that all of them share. What they share is emitted at once, so a token waits for no more
bytes than the longest vocabulary entry has. States and moves are made when first met and kept within a bound.

Decoding. Token bytes go through a UTF-8 state machine that holds back the bytes of an unfinished character.

Defined results: a null text is an empty one and has no ids; repeated rows and ids are encoded each for itself;
a ``doc_id`` may be null; no text is too long (a document is one row); an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedtide.llm.chunks import ChunkCache, packed_ids
from feedtide.llm.common import kept_in_worker, lists, map_texts, small_batches

#: Moves kept by one worker before it starts anew.
MOVES = 250_000
#: So many first bytes of a pretoken are made in one move.
HEAD = 5
#: What is live before the first byte and wherever a token must have ended: a start without tokens.
_START = ((0, ()),)


def read_ranks(path: str) -> bytes:
    """The content of a rank file, for the driver to broadcast: one vocabulary, so bounded."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Transducer:
    """BPE of one pretoken at a time, as merges of the lowest rank first would give it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.rows: list[dict[int, int] | None] = [{}]  # of each node: byte to node; none where a token can't go on
        self.token = [-1]
        for word, rank in ranks.items():
            node = 0
            for byte in word:
                row = self.rows[node]
                if row is None:
                    row = self.rows[node] = {}
                follow = row.get(byte)
                if follow is None:
                    follow = row[byte] = len(self.rows)
                    self.rows.append(None)
                    self.token.append(-1)
                node = follow
            self.token[node] = rank
        self.join: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self._compile(ranks)
        # Only what merges can make may come out.
        self.token = [rank if rank in self.halves else -1 for rank in self.token]
        self.apart: dict[int, bool] = {}
        self._reset()

    def _compile(self, ranks: dict[bytes, int]) -> None:
        """``join``: the pairs that a merge may meet. ``halves``: the last merge inside each token.

        Tokens come in order of rank, so the pairs inside a token are known when it is reached.
        """
        for word, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(word) == 1:
                self.halves[rank] = (rank, rank)
                continue
            pairs = [(ranks.get(word[:i]), ranks.get(word[i:])) for i in range(1, len(word))]
            pairs = [(a, b) for a, b in pairs if a is not None and b is not None]
            whole = [p for p in pairs if p[0] in self.halves and p[1] in self.halves and self._stays(*p)]
            for pair in pairs:
                self.join[pair] = rank
            if whole:
                self.halves[rank] = whole[0]

    def _stays(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens come out of the merges unjoined.

        The merges are undone, latest first, at the seam. A pair there that joins to a rank below the one just
        undone would have been merged earlier, across the seam.
        """
        halves, join = self.halves, self.join
        undone = 1 << 60
        while True:
            joined = join.get((left, right))
            if joined is not None and joined < undone:
                return False
            a, b = halves[left][1], halves[right][0]
            if a == left and b == right:
                return True
            # On equal ranks the left one was merged first, so the right one is undone first.
            if b == right or (a != left and left > right):
                undone, left = left, a
            else:
                undone, right = right + 1, b

    def _may_follow(self, last: int, token: int) -> bool:
        if last < 0:
            return True
        pair = last << 32 | token
        known = self.apart.get(pair)
        if known is None:
            if len(self.apart) > MOVES:
                self.apart.clear()
            known = self.apart[pair] = self._stays(last, token)
        return known

    def _reset(self) -> None:
        start = (-1, _START)
        self.numbers = {start: 0}
        self.states = [start]
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.heads: dict[bytes, tuple[int, list[int]]] = {}  # where the first bytes of pretokens lead

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, live = self.states[state]
        grown, here, rows, tokens = [], None, self.rows, self.token
        for node, chain in live:
            follow = rows[node].get(byte)
            if follow is None:
                continue
            if rows[follow] is not None:
                grown.append((follow, chain))
            if here is None:
                token = tokens[follow]
                if token >= 0 and self._may_follow(chain[-1] if chain else last, token):
                    here = (*chain, token)
        if here is None:
            raise ValueError("the vocabulary lacks a single byte")
        # Chains form a tree; what the oldest start, the new end and all between share is decided.
        if not grown:
            out, key = here, (here[-1], _START)
        else:
            shared = len(grown[0][1])
            if shared:
                for _, chain in grown:
                    while chain[:shared] != here[:shared]:
                        shared -= 1
            grown.append((0, here))
            out = here[:shared]
            # Only the oldest start can be without tokens; where none is, the last token tells nothing.
            if len(grown[0][1]) > shared:
                last = -1
            elif shared:
                last = out[-1]
            key = (last, tuple([(node, chain[shared:]) for node, chain in grown] if shared else grown))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        return number, out

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pretoken; one that is itself in the vocabulary is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.moves) > MOVES or len(self.heads) > MOVES:
            self._reset()
        head = piece[:HEAD]
        known = self.heads.get(head)
        if known is None:
            known = self.heads[head] = self._run(0, head)
        state, ids = self._run(known[0], piece[HEAD:])
        return [*known[1], *ids, *self.states[state][1][-1][1]]

    def _run(self, state: int, piece: bytes) -> tuple[int, list[int]]:
        """Where the bytes lead from a state, and what is emitted on the way."""
        moves, ids = self.moves, []
        for byte in piece:
            key = state << 8 | byte
            step = moves.get(key)
            if step is None:
                step = moves[key] = self._move(state, byte)
            state, out = step
            if out:
                ids += out
        return state, ids


def encoder(ranks: bytes, pattern: str) -> ChunkCache:
    """The transducer behind the split pattern and a bounded memory of what it has met."""
    transducer = Transducer(parse_ranks(ranks))

    def matches(pieces: list[str]) -> list[bytes]:
        return packed_ids(transducer.encode(piece.encode()) for piece in pieces)

    return ChunkCache(pattern, matches, 104 * 1024 * 1024)


class Utf8Stream:
    """An incremental decoder: bytes in, finished characters out.

    The state is how many bytes the open character has and how many it still waits for.
    """

    def __init__(self) -> None:
        self.open = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end belong to a character that is not complete."""
        waits, since = 0, 0
        for byte in data[-3:]:
            if byte >= 0xC0:
                waits, since = (3 if byte >= 0xF0 else 2 if byte >= 0xE0 else 1), 1
            elif byte >= 0x80 and waits:
                waits, since = waits - 1, since + 1
            else:
                waits = 0
        return since if waits else 0

    def push(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data) - self.unfinished(data)
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: list[int], words: list[bytes], every: int = 4096) -> str:
    """Text of ids, ``every`` tokens at a time."""
    stream = Utf8Stream()
    parts = [stream.push(b"".join(map(words.__getitem__, ids[at : at + every]))) for at in range(0, len(ids), every)]
    return "".join([*parts, stream.close()])


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>`` for every row of ``docs``; other columns are left out."""
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def work(texts, batch):
        key = f"bpe {zlib.crc32(content.value)} {pattern}"
        engine = kept_in_worker(key, lambda: encoder(content.value, pattern))
        made = engine.ids(texts)
        values = np.frombuffer(b"".join(made), dtype="<u4").astype(np.int32)
        return [lists(values, [len(m) // 4 for m in made])]

    return map_texts(docs, ["doc_id"], "ids array<int>", work)


def _words(content: bytes) -> list[bytes]:
    ranks = parse_ranks(content)
    words = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        words[rank] = word
    return words


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, ids, text`` for rows of ``doc_id, ids``; null ids give an empty text."""
    content = tokens.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def each(batches):
        words = kept_in_worker(f"bpe words {zlib.crc32(content.value)}", lambda: _words(content.value))
        for batch in batches:
            column = batch.column(1)
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()  # a null has no values
            texts = [decode_stream(values[a:b].tolist(), words) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    source = tokens.select("doc_id", "ids")
    small_batches(tokens.sparkSession)
    return source.mapInArrow(each, f"doc_id {source.schema[0].dataType.simpleString()}, ids array<int>, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: token count and digests of the ids and of the decoded bytes."""
    both = decode(encode(docs, ranks_path, pattern), ranks_path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
