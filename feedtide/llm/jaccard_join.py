"""Similarity join on word shingles by prefixes under several token orders (operator 6).

Texts with the same set of shingles are one class (``sig``: 64 bits of a digest of the set, and its size). Two sets link
when 100 * intersection >= ``percent`` * union. Then each has a token of the other among its first
``n - ceil(percent * n / 100) + 1`` tokens, under any order of all tokens. Several orders are used:

1. Under the first order, classes that share a prefix token are found by an equi-join on the token.
2. Of the pairs found, only those stay that also share a prefix token under each of the other orders.
3. The shingle sets of what is left are compared, in the same pass.

All orders put tokens first that are known to be in one text only or few, and tokens that many texts share last, which
keeps common passages out of the prefixes; within that they go by a hash of their own. See ``Orders`` for what is counted.
Any fixed order is right, so neither the sample nor the size of its map can cost a link.

Places. Two sets can share no more than their first common token and the shorter of what follows it in either, so a pair
is looked at only where that may be enough.

Sketches. A sketch tells of each of 512 parts of all tokens whether a set has an odd number there. Where two sketches differ,
one set has a token that the other lacks, so sets whose sketches differ in more places than links allow don't link. A group
of sketches has the places in which all agree, which bounds how near any of its sets can come to any of another group.

Large groups. A group of m near copies has m² pairs, so they are looked for in rounds. First every class is paired with
one hub of its token groups that it isn't tied to yet, a new hub in each round, and the links found give components,
until a round finds few or ``HUB_ROUNDS`` are over. Then a token group yields only pairs of classes from different
components, all of them. No link between components is lost, and within a component links tell nothing.

Defined results: a document without words is linked with nothing; with fewer than ``width`` words, all of them are one
shingle. Rows may share a doc_id or have none: each row gets the component of its text, whose id is the smallest
doc_id in it (null if none has one). Whole texts are used. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedtide.llm.common import WORD, bit_map, columns_apart, in_map, kept_in_worker, lists, map_texts, row_key
from feedtide.llm.components import connected
from feedtide.session import staged

HOT_SHARE = 1000
#: One in so many tokens is counted exactly.
SAMPLED = 4
#: A counted token is alone, rare or frequent: in one text, up to so many, or more.
LEVELS = (1, 8)
#: Rounds in which classes meet one hub each, before all that may still link are paired; the last is one in which no more
#: than one in ``FEW_LINKS`` pairs links. They only spare work.
HUB_ROUNDS, FEW_LINKS = 8, 10
#: Seeds of the orders: the first is joined on, the others filter its pairs.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_STEP = np.uint64(0x2545F4914F6CDD1D)
#: 64-bit words of a sketch.
SKETCH = 8


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; A-Z count as a-z."""
    words = kept_in_worker("shingle words", dict)  # hashes of the words met
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        codes: list[int] = []
        lengths = []
        while at < len(texts) and len(codes) < 200_000:
            # For bytes, lower() changes A-Z only and split() parts at the six white-space characters of ``WORD``.
            found = texts[at].encode().lower().split()
            own = list(map(words.get, found))
            if None in own:
                if len(words) > 150_000:
                    words.clear()
                own = [words.get(w) or words.setdefault(w, xxhash.xxh64_intdigest(w) | 1) for w in found]
            codes += own
            lengths.append(len(own))
            at += 1
        flat = np.array(codes + [0] * width, np.uint64)
        full = np.full(len(codes), width, np.uint64)
        for k in range(width):
            full = _mixed((full + np.uint64(k)) * _STEP ^ flat[k : k + len(codes)])
        start = 0
        for n in lengths:
            if n >= width:
                out.append(np.unique(full[start : start + n - width + 1]))
            elif n:
                out.append(np.array([xxhash.xxh64_intdigest(flat[start : start + n].tobytes())], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            start += n
    return out


def signature(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """One bit for each part of the tokens: whether the set has an odd number of them."""
    odd = np.bincount((tokens >> np.uint64(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Orders:
    """What the token orders know: the frequencies of hot tokens, and how many texts sampled tokens are in.

    Tokens whose hash is a multiple of ``SAMPLED`` are counted one by one; the maps tell which of them are in more than
    ``LEVELS`` texts. One in no map is in no other text. Such tokens come first, then rare ones, those not counted, those
    counted as frequent, and the hot ones last, most frequent ones at the very end.
    """

    def __init__(self, known: np.ndarray, frequency: np.ndarray, maps: list[np.ndarray]):
        self.known, self.frequency, self.maps = known, frequency, maps

    def heat(self, tokens: np.ndarray) -> np.ndarray:
        """What tokens are sorted by: 0 if alone, 1 if rare, 2 if not counted, 3 if frequent, more if hot."""
        counted = tokens % np.uint64(SAMPLED) == 0
        levels = sum(in_map(bits, _signed(tokens)).astype(np.int64) for bits in self.maps)
        heat = np.where(counted, np.array([0, 1, 3])[levels], 2)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, tokens), len(self.known) - 1)
            heat = np.where(self.known[at] == tokens, self.frequency[at] + 3, heat)
        return heat

    def prefix(self, tokens: np.ndarray, percent: int, order: int) -> tuple[np.ndarray, int]:
        """The first tokens under an order, but those that are in no other text, and the number of these.

        Tokens in no other text can't be shared; they come first, so a token's place is its place here plus their number.
        """
        take = len(tokens) - -(-percent * len(tokens) // 100) + 1
        heat = self.heat(tokens)
        alone = int((heat == 0).sum())
        take -= alone
        if take <= 0:
            return tokens[:0], alone
        tokens, heat = tokens[heat > 0], heat[heat > 0]
        return tokens[np.lexsort((_mixed(tokens ^ np.uint64(order)), heat))[:take]], alone


def _signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def classes(docs: DataFrame, width: int, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, ``n`` and ``sig`` of every row, and, at the first row of a batch, ``hot``: tokens frequent in
    the batch, and ``sampled``: the tokens to count exactly, once for each class of the batch."""

    def work(texts, batch):
        sets = shingle_sets(texts, width)
        least = max(4, -(-len(texts) // HOT_SHARE))
        sigs = [signature(s) for s in sets]
        different = [*dict(zip(sigs, sets)).values(), np.zeros(0, np.uint64)]
        sampled = np.concatenate([s[s % np.uint64(SAMPLED) == 0] for s in different])
        tokens, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
        often = counts >= least
        hot = pa.StructArray.from_arrays(
            [pa.array(_signed(tokens[often])), pa.array(counts[often].astype(np.int64))], names=["token", "texts"]
        )
        rest = [0] * (len(texts) - 1)
        # Tokens met twice in the batch are known to be repeated; one row a batch is enough for the others.
        sampled, counts = np.unique(sampled, return_counts=True)
        counted = pa.StructArray.from_arrays(
            [pa.array(_signed(sampled)), pa.array(counts.astype(np.int64))], names=["token", "classes"]
        )
        return [
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array(sigs, pa.int64()),
            lists(hot, [len(hot), *rest][: len(texts)]),
            lists(counted, [len(counted), *rest][: len(texts)]),
        ]

    return map_texts(
        docs,
        list(keep),
        "n long, sig long, hot array<struct<token:bigint,texts:bigint>>, counted array<struct<token:bigint,classes:bigint>>",
        work,
    )


def orders(found: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """What ``Orders`` needs, from stored ``classes``. Texts have a bounded mean length, so at most ``HOT_SHARE`` times that many tokens can be
    in one of ``HOT_SHARE`` texts, whatever the number of texts; the maps have a fixed size. All are broadcast."""
    hot = found.select(F.inline("hot")).groupBy("token").agg(F.sum("texts").alias("texts"))
    hot = hot.where(F.col("texts") >= max(8, -(-rows // HOT_SHARE))).toArrow()
    tokens = hot["token"].to_numpy().view(np.uint64)
    by = np.argsort(tokens)
    counted = found.select(F.inline("counted")).groupBy("token").agg(F.sum("classes").alias("classes"))
    counted = staged(counted.where("classes > 1"), "repeated-tokens")
    maps = [bit_map(counted.where(F.col("classes") > level), "token") for level in LEVELS]
    return tokens[by], hot["texts"].to_numpy()[by], maps


def _prefix_rows(docs: DataFrame, width: int, percent: int, hot) -> DataFrame:
    """``token, sig, n, rest``: the prefix tokens of every class under the first order (again for each batch it is in).

    ``rest`` counts the tokens that come after this one in its class."""

    def work(texts, batch):
        sets = {signature(s): s for s in shingle_sets(texts, width) if len(s)}
        known = Orders(*hot.value)
        firsts = [known.prefix(s, percent, ORDERS[0]) for s in sets.values()]
        sizes = [len(f) for f, _ in firsts]
        rests = [len(s) - 1 - alone - np.arange(len(f)) for s, (f, alone) in zip(sets.values(), firsts)]
        rows = pa.StructArray.from_arrays(
            [
                pa.array(_signed(np.concatenate([*(f for f, _ in firsts), np.zeros(0, np.uint64)]))),
                pa.array(np.repeat(np.array(list(sets), np.int64), sizes)),
                pa.array(np.repeat(np.array([len(s) for s in sets.values()], np.int64), sizes)),
                pa.array(np.concatenate([*rests, np.zeros(0, np.int64)])),
            ],
            names=["token", "sig", "n", "rest"],
        )
        return [lists(rows, [len(rows)] + [0] * (len(texts) - 1))] if texts else [lists(rows, [])]

    made = map_texts(docs, [], "rows array<struct<token:bigint,sig:bigint,n:bigint,rest:bigint>>", work)
    return made.select(F.inline("rows"))


def _sets(docs: DataFrame, width: int, percent: int, hot, wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """``sig, n, tokens, prefixes, sketch`` of the classes in ``wanted``: the whole set, and its prefixes under further orders.

    ``texts`` has ``sig, text_hash_`` of every row. A map of one text's hash for each class tells which texts to look at."""
    wanted = wanted.select("sig").distinct()
    chosen = texts.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("text_hash_").alias("text_hash_"))
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(chosen, "text_hash_"))
    kind = pa.list_(
        pa.struct(
            [
                ("sig", pa.int64()),
                ("n", pa.int64()),
                ("tokens", pa.list_(pa.int64())),
                ("prefixes", pa.list_(pa.list_(pa.int64()))),
                ("sketch", pa.list_(pa.int64())),
            ]
        )
    )

    def work(texts, batch):
        asked = in_map(bits.value, batch.column(0).to_numpy(zero_copy_only=False)).tolist()
        sets = iter(shingle_sets([text for text, of in zip(texts, asked) if of], width))
        known, found, out = Orders(*hot.value), set(), []
        for of in asked:
            own, tokens = [], next(sets) if of else ()
            sig = signature(tokens) if len(tokens) else None
            if sig is not None and sig not in found:
                found.add(sig)
                prefixes = [_signed(known.prefix(tokens, percent, order)[0]) for order in ORDERS[1:]]
                own = [
                    {"sig": sig, "n": len(tokens), "tokens": _signed(tokens), "prefixes": prefixes, "sketch": sketch(tokens)}
                ]
            out.append(own)
        return [pa.array(out, kind)]

    fields = "sig:bigint,n:bigint,tokens:array<bigint>,prefixes:array<array<bigint>>,sketch:array<bigint>"
    made = map_texts(docs, ["text_hash_"], f"found array<struct<{fields}>>", work)
    made = made.select(F.inline("found")).join(wanted, "sig", "left_semi")
    return made.dropDuplicates(["sig"])


def _similar_size(a: str, b: str, percent: int):
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def _may_overlap(n1: str, rest1: str, n2: str, rest2: str, percent: int):
    """Whether two sets whose first shared token leaves them these many tokens may share enough.

    They share that token and what is left of the shorter rest at most, and need percent / (100 + percent) of both sizes.
    Of the tokens that two sets share in their prefixes, at least the first one passes. The token must be among the
    smaller set's first that leave room for as much, too, which this bound implies.
    """
    return ((100 + percent) * (1 + F.least(rest1, rest2))) >= (percent * (F.col(n1) + F.col(n2)))


def _near_sketches(n1: str, n2: str, percent: int):
    """Whether sets of two groups may link: places in which all of one group differ from all of the other are tokens that
    one of the two lacks, and of both sets' tokens these are (100 - percent) / (100 + percent) at most."""
    apart = " + ".join(f"bit_count((all1[{i}] & ~any2[{i}]) | (all2[{i}] & ~any1[{i}]))" for i in range(SKETCH))
    return F.expr(f"{100 + percent} * ({apart}) <= {100 - percent} * ({n1} + {n2})")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs`` (``a``, ``b``)."""

    def of(side: str) -> DataFrame:
        return sets.select(F.col("sig").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("prefixes", "tokens")])

    # Few pairs fail an order once places have been compared, so what a pair needs is sent once.
    near = pairs.join(of("a"), "a").join(of("b"), "b")
    for i in range(len(ORDERS) - 1):
        near = near.where(F.arrays_overlap(F.get("prefixes_a", F.lit(i)), F.get("prefixes_b", F.lit(i))))
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    union = F.size("tokens_a") + F.size("tokens_b") - shared
    return near.where(100 * shared >= percent * union).select("a", "b")


def components(docs: DataFrame, width: int = 5, percent: int = 80, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns (``doc_id`` among them), ``n_shingles`` and ``component_id`` for every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.withColumn("text_hash_", F.xxhash64("text"))
    found = staged(classes(docs, width, (*keep, "text_hash_")), "shingle-classes")
    members = found.select(*keep, "n", "sig")
    hot = spark.sparkContext.broadcast(orders(found, members.count()))
    rows = staged(_prefix_rows(docs, width, percent, hot), "prefix-tokens")

    # Token groups of two classes or more.
    shared = rows.groupBy("token").agg(F.min("sig").alias("low"), F.max("sig").alias("top")).where("low <> top")
    tied = staged(rows.distinct().join(shared.select("token"), "token", "left_semi"), "shared-prefix-tokens")
    sets = staged(_sets(docs, width, percent, hot, tied, found), "shingle-sets")

    # First rounds: in each token group every class meets one hub, another one in each round, if they aren't tied yet.
    links = spark.createDataFrame([], "a long, b long")
    groups = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for turn in range(HUB_ROUNDS):
        own = groups.select(F.col("node").alias("sig"), "component")
        known = tied.join(own, "sig", "left").withColumn("c", F.coalesce("component", "sig")).drop("component")
        known = staged(known, "tokens-by-component")
        parted = known.groupBy("token").agg(
            F.min("c").alias("x"), F.max("c").alias("y"),
            F.min(F.struct(F.xxhash64("sig", F.lit(turn)).alias("by"), "sig", "n", "rest", "c")).alias("h"),
        )
        parted = parted.where("x <> y").select(
            "token", F.col("h.sig").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.rest").alias("hub_rest"), F.col("h.c").alias("hub_c")
        )
        met = known.join(parted, "token").where(F.col("c") != F.col("hub_c"))
        met = met.where(_similar_size("n", "hub_n", percent) & _may_overlap("n", "rest", "hub_n", "hub_rest", percent))
        # Of all hubs it meets, each class takes the one it shares most tokens with.
        stars = met.groupBy("sig", "hub").agg(F.count("*").alias("shared"))
        stars = stars.groupBy("sig").agg(F.max_by("hub", F.struct("shared", "hub")).alias("hub"))
        stars = staged(stars.select(F.col("sig").alias("a"), F.col("hub").alias("b")), "hub-pairs")
        new = staged(_verified(stars, sets, percent), "links")
        groups = connected(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new))
        if FEW_LINKS * new.count() <= stars.count():
            break

    # Last round: all pairs of classes of different components that share a token and may overlap enough.
    own = groups.select(F.col("node").alias("sig"), "component")
    tied = tied.join(own, "sig", "left").select("token", "sig", "n", "rest", F.coalesce("component", "sig").alias("c"))
    tied = staged(tied, "tokens-by-component")
    mixed = tied.groupBy("token").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("token")
    sketches = sets.select("sig", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)])
    tied = staged(tied.join(mixed, "token", "left_semi").join(sketches, "sig"), "mixed-tokens")
    words = [f"s{i}" for i in range(SKETCH)]
    kinds = tied.groupBy("token", "c").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"),
        *[F.bit_and(w).alias(f"all_{w}") for w in words], *[F.bit_or(w).alias(f"any_{w}") for w in words],
    )
    kinds = staged(
        kinds.select("token", "c", "low", "high", "rest", *[F.array(*[f"{k}_{w}" for w in words]).alias(k) for k in ("all", "any")]),
        "token-components",
    )
    side = lambda i: kinds.select("token", *[F.col(c).alias(f"{c}{i}") for c in kinds.columns[1:]])
    met = side(1).join(side(2), "token").where("c1 < c2").where(
        F.expr(f"100 * high1 >= {percent} * low2 AND 100 * high2 >= {percent} * low1")
        & _may_overlap("low1", "rest1", "low2", "rest2", percent)
        & _near_sketches("high1", "high2", percent)
    )
    met = met.select("token", "c1", "c2")
    part = lambda i, name: tied.select(
        "token", F.col("c").alias(f"c{i}"), F.col("sig").alias(name), F.col("n").alias(f"n{i}"), F.col("rest").alias(f"rest{i}"),
        *[F.array(*words).alias(f"{k}{i}") for k in ("all", "any")],
    )
    pairs = met.join(part(1, "a"), ["token", "c1"]).join(part(2, "b"), ["token", "c2"])
    pairs = pairs.where(
        _similar_size("n1", "n2", percent) & _may_overlap("n1", "rest1", "n2", "rest2", percent) & _near_sketches("n1", "n2", percent)
    )
    pairs = staged(pairs.select("a", "b").distinct(), "candidate-pairs")
    more = _verified(pairs, sets, percent)
    groups = connected(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    # From classes back to rows.
    ids = members.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    ids = ids.join(groups.withColumnRenamed("node", "sig"), "sig", "left")
    ids = staged(ids.select("sig", "least", F.coalesce("component", "sig").alias("component")), "class-ids")
    smallest = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    named = ids.join(smallest, "component").select("sig", "component", "component_id")
    joined = members.join(named, "sig", "left")
    return joined.select(
        *keep,
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("component")).alias("component"),
    )


@columns_apart
def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest doc_id. Texts without words all stay."""
    keyed = docs.withColumn("row_", row_key())
    found = staged(components(keyed, width, percent, ("doc_id", "row_")), "near-copies")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row_")).alias("best")
    kept = found.where("component IS NOT NULL").groupBy("component").agg(best).select("best.doc_id", "best.row_")
    often = found.groupBy("doc_id", "row_").agg(F.count("*").alias("copies_"))
    kept = kept.unionByName(found.where("component IS NULL").select("doc_id", "row_").distinct())
    kept = kept.join(often.withColumnRenamed("doc_id", "same_"), ["row_"]).where(F.col("doc_id").eqNullSafe(F.col("same_")))
    kept = kept.select(F.col("doc_id").alias("same_"), F.col("row_").alias("same_row_"), "copies_")
    rows = keyed.join(kept, (F.col("row_") == F.col("same_row_")) & F.col("doc_id").eqNullSafe(F.col("same_")))
    rows = staged(rows.select(*docs.columns, "copies_"), "kept-rows")
    single = rows.where("copies_ = 1").select(*docs.columns)
    full = rows.where("copies_ > 1").select(*docs.columns)
    # Rows of one doc_id and text may differ in other columns: the smallest of all is the one.
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    parts = [x for i, c in enumerate(rest) for x in (F.col(c).isNull().alias(f"absent{i}"), F.col(c).alias(f"value{i}"))]
    least = F.min(F.struct(F.lit(0).alias("any"), *parts)).alias("least_")
    worded = full.where(F.col("text").rlike(WORD)).groupBy("doc_id", "text").agg(least)
    worded = worded.select("doc_id", "text", *[F.col(f"least_.value{i}").alias(c) for i, c in enumerate(rest)])
    return single.unionByName(worded).unionByName(full.where(F.col("text").isNull() | ~F.col("text").rlike(WORD)))
