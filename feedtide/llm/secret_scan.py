"""Secret scans (operator 2): fixed patterns, and a character convolutional network for what they miss.

Patterns give the base findings. Candidates are those of any length, and every long token of key characters or what it has
besides base findings. The network reads a candidate with its surroundings as characters, one longer than ``VALUE`` in
overlapping parts, of which the likeliest counts: embedding, convolution, largest response of each filter, logistic unit.
It learns from labelled findings, that is base findings against the other candidates; half of the base findings are
shown in the surroundings of an ordinary candidate, so that it must look at the value and not at the word before it.
Its outputs are calibrated on findings it didn't learn from, and the threshold is the highest that still finds
``LEAST_RECALL`` of the secrets there. Candidates beyond it are added as findings of kind ``model``.

It learns from all different findings of a table, in blocks of about ``BLOCK``: tasks train on a block each and their
weights are averaged once an epoch. Calibration and threshold come from all findings kept for them. Nothing but weights,
counts by place of a logit, and the threshold reaches the driver. Fewer than ``LEAST_FINDINGS`` of either: no network.

Defined results: null and empty texts have no findings; ``doc_id`` may be null or repeated, each row is scanned for
itself; texts are scanned whole. Offsets are code points, ends are exclusive. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedtide.llm.common import columns_apart, map_texts
from feedtide.operators.indexing import row_index
from feedtide.session import staged

#: Fixed patterns of the base findings, in the order that breaks ties.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # maximal runs, so the least length may be part of the pattern
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
_TRIGGERS = ("passw", "secret", "token", "api")
LEAST_LENGTH = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST_LENGTH},}}")
PIECE = re.compile(rf"[A-Za-z0-9+_-]{{{LEAST_LENGTH},}}")

BEFORE, VALUE, AFTER = 24, 48, 8
STEP = VALUE // 2  # from one view of a long candidate to the next
WIDTH = BEFORE + VALUE + AFTER
SYMBOLS = 98  # padding, printable ASCII, line end, anything else
LEAST_RECALL = 0.98
LEAST_FINDINGS = 8
#: Findings that one task trains on between two averages.
BLOCK = 8192
#: What is learnt by Adam.
LEARNT = ("embedding", "filters", "bias", "out")
#: Weights are averaged as whole multiples of 1 / FINE; none is beyond LARGEST, so sums of 4096 blocks fit a long.
FINE, LARGEST = 2.0**38, 4095.0


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = []
    low = text.lower()
    if any(t in low for t in _TRIGGERS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, is a base finding): values of base findings, however short, and what long tokens have besides them."""
    values = {(ASSIGN.match(text, start).start(2) if kind == 0 else start, end) for start, kind, end in found}
    made, at, reach = [(start, end, True) for start, end in values], 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(found) and found[at][0] < m.end():
            start, _, end = found[at]
            if start - max(reach, m.start()) >= LEAST_LENGTH:
                made.append((max(reach, m.start()), start, False))
            reach = max(reach, end)
            at += 1
        if m.end() - max(reach, m.start()) >= LEAST_LENGTH:
            made.append((max(reach, m.start()), m.end(), False))
    return sorted(made)


def surroundings(text: str, start: int, end: int) -> str:
    """A candidate and what stands around it, each part padded to its fixed width."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    value = text[start : min(end, start + VALUE)].ljust(VALUE, "\0")
    return before + value + text[end : end + AFTER].ljust(AFTER, "\0")


def views(text: str, start: int, end: int) -> list[str]:
    """Surroundings of overlapping parts that cover a candidate; one if it isn't longer than ``VALUE``.

    What stands between separators of a longer one is read by itself as well, so that it needn't share a part with others.
    """
    if end - start <= VALUE:
        return [surroundings(text, start, end)]
    parts = {(a, a + VALUE) for a in (*range(start, end - VALUE, STEP), end - VALUE)}
    for m in PIECE.finditer(text, start, end):
        parts |= {(a, min(m.end(), a + VALUE)) for a in range(m.start(), max(m.start() + 1, m.end() - STEP), STEP)}
    return [surroundings(text, a, b) for a, b in sorted(parts)]


def symbols(windows: list[str]) -> np.ndarray:
    codes = np.array([[ord(c) for c in w] for w in windows], np.int64).reshape(-1, WIDTH)
    return np.where(codes == 0, 0, np.where((codes >= 32) & (codes < 127), codes - 31, np.where(codes == 10, 96, 97)))


@dataclass
class Network:
    """Weights of the network, its calibration (slope, shift) and threshold."""

    embedding: np.ndarray
    filters: np.ndarray  # (width * embedding, filters)
    bias: np.ndarray
    out: np.ndarray
    shift: float
    calibration: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    reach: int = 5

    def _responses(self, codes: np.ndarray):
        x = self.embedding[codes]
        n = WIDTH - self.reach + 1
        strips = np.concatenate([x[:, k : k + n] for k in range(self.reach)], axis=2)
        return strips, strips @ self.filters + self.bias

    def logits(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes))
        for at in range(0, len(codes), 256):
            _, responses = self._responses(codes[at : at + 256])
            out[at : at + 256] = np.maximum(responses.max(axis=1), 0) @ self.out + self.shift
        return out

    def probability(self, codes: np.ndarray) -> np.ndarray:
        slope, shift = self.calibration
        return 1 / (1 + np.exp(-np.clip(slope * self.logits(codes) + shift, -30, 30)))


@dataclass
class Training:
    """A network on its way, with Adam's moments (``spreads``: roots of the mean squares)."""

    net: Network
    means: dict[str, np.ndarray]
    spreads: dict[str, np.ndarray]

    @staticmethod
    def begun(seed: int = 7) -> Training:
        rng = np.random.default_rng(seed)
        net = Network(
            rng.normal(0, 0.3, (SYMBOLS, 8)), rng.normal(0, 0.15, (40, 24)), np.zeros(24), rng.normal(0, 0.2, 24), 0.0
        )
        return Training(net, *({n: np.zeros_like(getattr(net, n)) for n in LEARNT} for _ in range(2)))

    def numbers(self) -> np.ndarray:
        held = [source[n].ravel() for source in (vars(self.net), self.means, self.spreads) for n in LEARNT]
        return np.concatenate([*held, [self.net.shift]])

    def replaced(self, numbers: np.ndarray) -> Training:
        parts, at = [], 0
        for _ in range(3):
            parts.append({})
            for n in LEARNT:
                like = getattr(self.net, n)
                parts[-1][n] = numbers[at : at + like.size].reshape(like.shape)
                at += like.size
        return Training(Network(**parts[0], shift=float(numbers[at])), *parts[1:])


def passes(held: Training, codes: np.ndarray, labels: np.ndarray, weight: np.ndarray, epochs: int, steps: int, seed: int) -> Training:
    """Adam on the logistic loss, ``epochs`` times over these findings; ``steps`` were made before."""
    net, rng, rows = held.net, np.random.default_rng(seed), np.arange(len(codes))
    net = Network(net.embedding, net.filters, net.bias, net.out, net.shift)
    means, squares = dict(held.means), {n: s**2 for n, s in held.spreads.items()}
    for _ in range(epochs):
        rng.shuffle(rows)
        for at in range(0, len(rows), 64):
            own = rows[at : at + 64]
            strips, responses = net._responses(codes[own])
            best = responses.argmax(axis=1)
            top = np.take_along_axis(responses, best[:, None], axis=1)[:, 0]
            pooled = np.maximum(top, 0)
            error = (1 / (1 + np.exp(-np.clip(pooled @ net.out + net.shift, -30, 30))) - labels[own]) * weight[own] / len(own)
            back = error[:, None] * net.out * (top > 0)
            chosen = strips[np.arange(len(own))[:, None], best]  # (batch, filters, width * embedding)
            to_strips = back[:, :, None] * net.filters.T
            to_embedding = np.zeros_like(net.embedding)
            parts = to_strips.reshape(len(own), 24, net.reach, 8)
            for k in range(net.reach):
                np.add.at(to_embedding, np.take_along_axis(codes[own], best + k, axis=1), parts[:, :, k])
            slopes = {
                "embedding": to_embedding,
                "filters": np.einsum("bf,bfe->ef", back, chosen),
                "bias": back.sum(axis=0),
                "out": pooled.T @ error,
            }
            steps += 1
            for n in LEARNT:
                means[n] = 0.9 * means[n] + 0.1 * slopes[n]
                squares[n] = 0.99 * squares[n] + 0.01 * slopes[n] ** 2
                rate = 0.01 * np.sqrt(1 - 0.99**steps) / (1 - 0.9**steps)
                setattr(net, n, getattr(net, n) - rate * means[n] / (np.sqrt(squares[n]) + 1e-8))
            net.shift -= 0.01 * error.sum()
    return Training(net, means, {n: np.sqrt(s) for n, s in squares.items()})


def findings(texts: list[str], net: Network | None) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) for each text: base findings, and candidates that the network takes for secrets."""
    found = [base_findings(t) for t in texts]
    if net is None:
        return found
    where, windows = [], []
    for i, (text, own) in enumerate(zip(texts, found)):
        for start, end, known in candidates(text, own):
            if not known:
                parts = views(text, start, end)
                where += [(i, start, end)] * len(parts)
                windows += parts
    # A candidate counts by its likeliest part.
    likely = {at for at, p in zip(where, net.probability(symbols(windows))) if p >= net.threshold} if windows else ()
    for i, start, end in likely:
        found[i].append((start, 3, end))
    return [sorted(own) for own in found]


def labelled_candidates(docs: DataFrame) -> DataFrame:
    """``is_secret, window`` for every candidate of every text."""

    def work(texts, batch):
        rows = []
        for text in texts:
            own = base_findings(text)
            rows.append([{"is_secret": k, "window": w} for a, b, k in candidates(text, own) for w in views(text, a, b)])
        return [pa.array(rows, pa.list_(pa.struct([("is_secret", pa.bool_()), ("window", pa.string())])))]

    made = map_texts(docs, [], "found array<struct<is_secret:boolean,window:string>>", work)
    return made.select(F.inline("found"))


def _blocks(windows: DataFrame, ordinary: int, n_blocks: int) -> DataFrame:
    """All ``windows`` as stored blocks of about ``BLOCK``: ``block, codes, labels, kept``, bytes of one number each.

    Findings are numbered in hash order within their class. Every fourth is kept for calibration, and every other secret
    gets the surroundings of an ordinary candidate.
    """
    ordered = windows.withColumn("by", F.struct("is_secret", F.xxhash64("window").alias("hash"), "window"))
    rows = row_index(ordered, "by", "place").select("window", "is_secret", "place")
    rows = rows.withColumn("own", F.col("place") - F.when(F.col("is_secret"), ordinary).otherwise(0))
    rows = staged(rows, "numbered-findings")
    strange = F.col("is_secret") & (F.col("own") % 2 == 0)
    donors = rows.where("NOT is_secret").select(F.col("place").alias("donor"), F.col("window").alias("around"))
    moved = rows.where(strange).withColumn("donor", F.pmod(F.xxhash64("window"), F.lit(ordinary)))
    moved = moved.join(donors, "donor").withColumn(
        "window",
        F.concat(F.substring("around", 1, BEFORE), F.substring("window", BEFORE + 1, VALUE), F.substring("around", -AFTER, AFTER)),
    )
    rows = rows.where(~strange).unionByName(moved.select(*rows.columns))
    dealt = rows.withColumn("block", F.floor(F.col("own") / 4) % n_blocks).select("block", "own", "is_secret", "window")

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("is_secret", "descending"), ("own", "ascending")])
        own, labels = group["own"].to_numpy(), group["is_secret"].to_numpy().astype(np.uint8)
        columns = [symbols(group["window"].to_pylist()).astype(np.uint8), labels, (own % 4 == 3).astype(np.uint8)]
        return pa.table(
            {"block": group["block"][:1], **{n: pa.array([c.tobytes()]) for n, c in zip(("codes", "labels", "kept"), columns)}}
        )

    packed = dealt.groupBy("block").applyInArrow(pack, "block long, codes binary, labels binary, kept binary")
    return staged(packed.repartition(n_blocks), "finding-blocks")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, codes, labels and marks of each block."""
    for batch in batches:
        for row in batch.to_pylist():
            labels, kept = (np.frombuffer(row[n], np.uint8) for n in ("labels", "kept"))
            yield row["block"], np.frombuffer(row["codes"], np.uint8).reshape(-1, WIDTH).astype(np.int64), labels.astype(float), kept == 1


def _trained(blocks: DataFrame, n_blocks: int, shares: np.ndarray, rows: int, epochs: int, seed: int) -> Network:
    """Weights learnt from the findings of all blocks that aren't kept.

    Each block is gone through from the common weights; weights and moments of all blocks are then averaged, once an
    epoch. Averages are sums of whole numbers, so that their order doesn't matter.
    """
    held = Training.begun(seed)
    # A single block has nothing to wait for.
    turns, each = (epochs, 1) if n_blocks > 1 else (1, max(epochs, -(-600 * 64 // rows // 8)))
    for turn in range(turns):
        steps = turn * -(-rows // n_blocks // 64)

        def work(batches, held=held, turn=turn, steps=steps):
            total, n = np.zeros(len(held.numbers()), np.int64), 0
            for block, codes, labels, kept in _unpacked(batches):
                weight = shares[labels[~kept].astype(int)]
                made = passes(held, codes[~kept], labels[~kept], weight, each, steps, seed + 1000 * turn + block)
                total += np.rint(np.clip(made.numbers(), -LARGEST, LARGEST) * FINE).astype(np.int64)
                n += 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "part"])

        sums = blocks.mapInArrow(work, "at long, part long").groupBy("at").agg(F.sum("part").alias("part")).toArrow().sort_by("at")
        held = held.replaced(sums["part"].to_numpy() / (FINE * n_blocks))
    return held.net


def _calibrated(net: Network, blocks: DataFrame) -> Network:
    """``net`` with its calibration, a logistic fit of the kept findings' logits, and the recall-constrained threshold."""

    def work(batches):
        for _, codes, labels, kept in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array(labels[kept] == 1), pa.array(net.logits(codes[kept]))], names=["is_secret", "logit"])

    judged = staged(blocks.mapInArrow(work, "is_secret boolean, logit double"), "kept-logits")
    # The fit needs no more than how many logits are where; a place is a 64th, and there are at most 8192.
    place = F.least(F.greatest(F.floor(F.col("logit") * 64), F.lit(-4096)), F.lit(4095))
    counts = judged.groupBy("is_secret", place.alias("place")).count().toArrow().sort_by([("is_secret", "ascending"), ("place", "ascending")])
    logits, share = (counts["place"].to_numpy() + 0.5) / 64, counts["count"].to_numpy() / max(1, sum(counts["count"].to_pylist()))
    truth, slope, shift = counts["is_secret"].to_numpy().astype(float), 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * logits + shift, -30, 30)))
        slope -= 0.05 * (((p - truth) * logits * share).sum() + 0.01 * (slope - 1))
        shift -= 0.05 * ((p - truth) * share).sum()
    net.calibration = (max(float(slope), 1e-3), float(shift))
    secrets = judged.where("is_secret")
    allowed = int((1 - LEAST_RECALL) * secrets.count())
    least = row_index(secrets.select("logit"), "logit", "place").where(F.col("place") == allowed).first()
    if least is not None:
        slope, shift = net.calibration
        net.threshold = float(1 / (1 + np.exp(-np.clip(slope * least.logit + shift, -30, 30))))
    return net


def learn(docs: DataFrame, epochs: int = 12, seed: int = 7) -> Network | None:
    """Train on all different findings in ``docs``; every fourth is kept for calibration and threshold."""
    windows = staged(labelled_candidates(docs).groupBy("window").agg(F.max("is_secret").alias("is_secret")), "labelled-findings")
    sizes = {r.is_secret: r["count"] for r in windows.groupBy("is_secret").count().collect()}
    secret, ordinary = sizes.get(True, 0), sizes.get(False, 0)
    if min(secret, ordinary) < LEAST_FINDINGS:
        return None
    n_blocks = -(-(secret + ordinary) // BLOCK)
    blocks = _blocks(windows, ordinary, n_blocks)
    shares = (secret + ordinary) / (2 * np.array([ordinary, secret]))
    rows = sum(n - n // 4 for n in (secret, ordinary))
    return _calibrated(_trained(blocks, n_blocks, shares, rows, epochs, seed), blocks)


def _spelled(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def scan(docs: DataFrame, net: Network | None) -> DataFrame:
    """Per row: counts of the base findings by kind, their digest, and all spans."""

    def work(texts, batch):
        made = findings(texts, net)
        base = [[f for f in own if f[1] < 3] for own in made]
        counts = [pa.array([sum(f[1] == kind for f in own) for own in base], pa.int64()) for kind in range(3)]
        digests = [hashlib.sha256(_spelled(own).encode()).hexdigest() for own in base]
        return [*counts, pa.array(digests, pa.string()), pa.array([_spelled(own) for own in made], pa.string())]

    return map_texts(
        docs, ["doc_id"], "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", work
    )


@columns_apart
def redact(docs: DataFrame, net: Network | None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each finding replaced by ``mark``; overlapping findings are replaced as one."""

    def work(texts, batch):
        cleaned = []
        for text, found in zip(texts, findings(texts, net)):
            parts, at = [], 0
            for start, _, end in found:
                if start >= at:
                    parts += [text[at:start], mark]
                at = max(at, end)
            cleaned.append("".join([*parts, text[at:]]) if found else text)
        return [pa.array(cleaned, pa.string())]

    rest = [c for c in docs.columns if c != "text"]
    made = map_texts(docs.withColumn("was_null_", F.col("text").isNull()), [*rest, "was_null_"], "text string", work)
    made = made.withColumn("text", F.when(~F.col("was_null_"), F.col("text")))
    if "n_chars" in rest:
        made = made.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return made.select(*docs.columns)
