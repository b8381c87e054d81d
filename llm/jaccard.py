"""N-gram Jaccard join by token groups: similar documents form groups, a query opens only the groups that its tokens can reach.

A document is the set of its word shingles' hashes. Exact copies are one set from the
start. A token's key is its level of frequency and then its hash, so that tokens of common passages come
last in the one order of all keys. By the prefix principle two sets that link share one
of the first ``allowed(n)`` + 1 keys of each.

1. Levels. Tokens of least hash are counted in all documents; around the frequent ones, whole passages are.
   Maps of fixed size hold the result. They only order the keys: any order gives the same links.
2. Groups. The leader of a prefix key is the document of the most shared keys that has it: of near copies, the one with
   the fewest changes. Documents are compared with the leader that most of their keys name; links make groups.
   Most copies end up in one group at a linear number of comparisons. Where a key still has many groups (its leader was an outlier among the
   copies), those who have it are compared with further leaders, round by round, as long as that helps.
3. Token-group matrix. Each group's union of prefix keys is a column: (token, group). A token of one
   group only needs no more work.
4. Queries. A document meets the groups of more documents than its own through its prefix, where sizes allow a link. Up to the group's
   reach (the least last key of its members' prefixes), keys that the union lacks are differences from every member; a group beyond the allowed number stays closed.
5. One member of each open group is compared first; a link settles all between the two groups. For what is left, the members that share a prefix key are compared by the first quarter of their keys, and by
   their whole sets where those leave it open.

Links are decided on whole sets, made again from the texts; nothing is capped, and what
shares no prefix key can't link.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import UPPER, components, discard, shuffles_cleaned, table, written

WORDS, CACHE, TOGETHER, PARTNERS, SLOTS = 5, 200_000, 1 << 16, 64, 1 << 23
#: Documents that have a token from which each level begins; share of tokens counted first; tokens on either side; slots of a level's map.
LEVELS, ONE_IN, NEAR, LEVEL_SLOTS = (48, 384, 3072), 8, 24, 1 << 25
#: One shared key in so many names leaders; marks on a prefix.
LEADING, MARKS = 2, 16
#: A key of more groups is crowded; pairs of groups that such keys may have for each row of the matrix before groups get further leaders, and rounds of that at most.
CROWD, PAIRS_A_ROW, ROUNDS = 32, 3, 6
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


class Shingles:
    """Sorted distinct 64-bit shingle hashes of texts; words by ASCII blanks, A-Z lower-cased."""

    def __init__(self, size: int = WORDS):
        import xxhash

        hashed = xxhash.xxh3_64_intdigest

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = value = hashed(word)
                return value

        self.size, self.known = size, Known()

    def _mixed(self, h: np.ndarray, n: int) -> np.ndarray:
        """Hashes of 61 bits of every n words in a row."""
        k = max(0, len(h) - n + 1)
        g = np.full(k, n, np.uint64)  # a shorter text is one sequence, told apart by its length
        for i in range(n):
            g = (g ^ h[i : i + k]) * _ODD[i % len(_ODD)]
            g ^= g >> np.uint64(29)
        g *= _ODD[1]
        g ^= g >> np.uint64(32)
        return (g >> np.uint64(3)).view(np.int64)

    def _along(self, held: list[list[bytes]]) -> Iterator[np.ndarray]:
        if len(self.known) > CACHE:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, chain.from_iterable(held)), np.uint64)
        g, at = self._mixed(h, self.size), 0
        for words in held:
            n = len(words)
            yield g[at : at + n - self.size + 1] if n >= self.size else self._mixed(h[at : at + n], n) if n else np.empty(0, np.int64)
            at += n

    def along(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """For each text the hash of every shingle in its place; texts are hashed some at a time, of TOGETHER words or one long text."""
        held, n = [], 0
        for text in texts:
            held.append(text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else [])
            n += len(held[-1])
            if n >= TOGETHER:
                yield from self._along(held)
                held, n = [], 0
        yield from self._along(held)

    def of(self, texts: Iterable[str | None], maps: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """The sorted keys of each text's set: level, then hash."""
        for g in self.along(texts):
            g = np.unique(g)
            yield g if maps is None or not len(g) else np.sort(g | (levels_of(g, maps) << 61))


def levels_of(tokens: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """How many of the maps (a row of bits for each level) hold each token."""
    slot = tokens % LEVEL_SLOTS
    return ((maps[:, slot // 8] >> (slot % 8).astype(np.uint8)) & 1).sum(0).astype(np.int64)


def _maps(counts: DataFrame, least: tuple[int, ...]) -> np.ndarray:
    """Bit maps of the slots whose documents (``token, n``) reach each of ``least``; LEVEL_SLOTS bits a level, however large the corpus."""
    level = sum(((F.col("n") >= k).cast("int") for k in least), F.lit(0))
    slots = counts.where(F.col("n") >= least[0]).groupBy(F.pmod("token", F.lit(LEVEL_SLOTS)).alias("slot")).agg(F.max(level).alias("level"))
    bit = F.expr("shiftleft(1L, cast(slot % 64 AS int))")
    words = slots.groupBy(F.expr("slot div 64 AS at")).agg(*(F.bit_or(F.when(F.col("level") > k, bit).otherwise(F.lit(0).cast("long"))).alias(f"level_{k}") for k in range(len(least))))
    found = words.toPandas()  # LEVEL_SLOTS / 64 rows at most
    maps = np.zeros((len(least), LEVEL_SLOTS // 64), "<i8")
    for k in range(len(least)):
        maps[k, found["at"]] = found[f"level_{k}"]
    return maps.view(np.uint8)


def _levels(docs: DataFrame, size: int, least: tuple[int, ...]) -> np.ndarray:
    """The levels' maps: of one in ONE_IN tokens over all documents first, then of every token near one that is frequent."""

    def counted(parts: list[np.ndarray]) -> pd.DataFrame:
        token, n = np.unique(np.concatenate([np.empty(0, np.int64), *parts]), return_counts=True)
        return pd.DataFrame({"token": token, "n": n})

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(size)
        for batch in batches:
            parts = [np.unique(g[g % ONE_IN == 0]) for g in shingles.along(batch["text"])]
            yield counted(parts)

    count = lambda run: docs.select("text").mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    maps = _maps(count(first), least)
    if not maps.any():
        return maps
    shared = docs.sparkSession.sparkContext.broadcast(maps)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(size)
        for batch in batches:
            parts, held = [], 0
            for g in shingles.along(batch["text"]):
                marked = np.zeros(len(g) + 1, np.int64)
                at = np.flatnonzero(g % ONE_IN == 0)
                at = at[levels_of(g[at], shared.value) > 0] if len(at) else at
                np.add.at(marked, np.maximum(at - NEAR, 0), 1)
                np.add.at(marked, np.minimum(at + NEAR + 1, len(g)), -1)
                parts.append(np.unique(g[np.cumsum(marked)[:-1] > 0]))
                held += len(parts[-1])
                if held > 4 * TOGETHER:
                    yield counted(parts)
                    parts, held = [], 0
            yield counted(parts)

    return _maps(count(near), least)


def allowed(n):
    """Tokens of a set of size n that a set linked to it (80 % of the union in common) may lack; the prefix has one more."""
    return n - (4 * n + 4) // 5


#: Tokens of a set of size n that a set of size m linked to it may lack.
_DIFFERENCES = "{n} - (4 * ({n} + {m}) + 8) div 9"


def _sketches(docs: DataFrame, size: int, maps) -> DataFrame:
    """``doc_id, n, d1, d2, head``: set size, digest and the first quarter of the keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingles = Shingles(size)
        for batch in batches:
            rows = []
            for s in shingles.of(batch["text"], maps.value):
                d = xxhash.xxh3_128_digest(s.tobytes())
                rows.append((len(s), *np.frombuffer(d, "<i8").tolist(), s[: len(s) // 4 + 4].tobytes()))
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n", "d1", "d2", "head"])], axis=1)

    return docs.mapInPandas(run, "doc_id long, n long, d1 long, d2 long, head binary")


def _tokens(heads: DataFrame, wanted) -> DataFrame:
    """``token, doc, inner`` for every key of every prefix; inner: also in the shorter prefix that serves against sets no smaller."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[wanted(batch)]
            n = batch["n"].to_numpy()
            k = allowed(n) + 1
            parts = [np.frombuffer(b, "<i8")[:x] for b, x in zip(batch["head"], k, strict=True)]
            if parts:
                place = np.concatenate([np.arange(x) for x in k])
                yield pd.DataFrame({"token": np.concatenate(parts), "doc": np.repeat(batch["doc"].to_numpy(), k), "inner": place <= np.repeat(n - (8 * n + 8) // 9, k)})

    return heads.mapInPandas(run, "token long, doc long, inner boolean")


def _slots(ids: DataFrame, slot: Column) -> np.ndarray:
    """A bit map of fixed size of the slots of ``ids``; it passes over most other rows before a shuffle."""
    bits = ids.select(slot.alias("slot")).groupBy(F.expr("slot div 32 AS w")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 AS int))) AS bits"))
    mask = np.zeros(SLOTS // 32, np.uint32)
    for r in bits.collect():  # SLOTS / 32 rows at most
        mask[r["w"]] = r["bits"]
    return mask


def _slot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SLOTS))


def _one_of_each(sets: DataFrame, make) -> DataFrame:
    """``make`` of one document for each set, that of the least id, as ``doc, n, head``. Only sets that may be repeated are shuffled.

    make: a function of a DataFrame and of a test of its batches, which it applies in the same task.
    """
    repeated = written(sets.groupBy("d1", "d2").count().where("count > 1").select("d1"))
    shared = sets.sparkSession.sparkContext.broadcast(_slots(repeated, _slot("d1")))  # SLOTS bits
    discard(repeated)

    def again(batch: pd.DataFrame) -> np.ndarray:
        at = batch["slot"].to_numpy()
        return (shared.value[at // 32] >> (at % 32).astype(np.uint32)) & 1 == 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[again(batch)].drop(columns="slot")

    marked = sets.select(F.col("doc_id").alias("doc"), "n", "d1", "d2", "head", _slot("d1").alias("slot"))
    rest = marked.mapInPandas(run, "doc long, n long, d1 long, d2 long, head binary")
    rest = rest.groupBy("d1", "d2").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("head").alias("head")).drop("d1", "d2")
    return make(marked, lambda batch: ~again(batch)).unionByName(make(rest, lambda batch: slice(None)))


def sets_link(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= 80 * (nx + ny - common)


def heads_may_link(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> bool:
    """False if up to where both heads are whole one set has more tokens of its own than a link leaves it."""
    end = min(h[-1] for h, n in ((x, nx), (y, ny)) if len(h) < n) if len(x) < nx or len(y) < ny else max(x[-1], y[-1])
    x, y = x[: np.searchsorted(x, end, "right")], y[: np.searchsorted(y, end, "right")]
    common, need = len(np.intersect1d(x, y, assume_unique=True)), (4 * (nx + ny) + 8) // 9
    return len(x) - common <= nx - need and len(y) - common <= ny - need


def _compared(pairs: DataFrame, rows: DataFrame, test, size: int | None = None) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose tokens pass ``test``.

    rows: ``doc_id, n, tokens``, or ``doc_id, text`` for whole sets of shingles of ``size``. The partners of one ``a`` are
    dealt out by PARTNERS, with its tokens before theirs.
    """
    pairs = written(pairs.select("a", "b"))
    counts = written(pairs.groupBy("a").count())
    salted = F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / PARTNERS)).cast("int").alias("salt")
    placed = pairs.join(counts, "a").select("a", "b", salted)
    placed = placed.select(F.col("b").alias("doc"), "a", "salt", F.lit(1).alias("at")).unionByName(placed.select(F.col("a").alias("doc"), "a", "salt", F.lit(0).alias("at")).distinct())
    placed = written(placed)
    shared = rows.sparkSession.sparkContext.broadcast(_slots(placed, _slot("doc")))  # SLOTS bits

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask, shingles = shared.value, size and Shingles(size)
        for batch in batches:
            slots = batch["slot"].to_numpy()
            batch = batch[(mask[slots // 32] >> (slots % 32).astype(np.uint32)) & 1 == 1]
            if size:
                sets = list(shingles.of(batch["text"]))
                yield pd.DataFrame({"doc": batch["doc_id"], "n": [len(s) for s in sets], "tokens": [s.tobytes() for s in sets]})
            else:
                yield batch.drop(columns="slot").rename(columns={"doc_id": "doc"})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first = None, []
        for batch in batches:
            keep = []
            for a, salt, at, b, n, tokens in batch[["a", "salt", "at", "doc", "n", "tokens"]].itertuples(index=False):
                tokens = np.frombuffer(tokens, "<i8")
                if (a, salt) != key:
                    key, first = (a, salt), []
                if at == 0:
                    first.append((tokens, n))  # more than one if the id is repeated
                elif any(test(x, m, tokens, n) for x, m in first):
                    keep.append((a, b))
            yield pd.DataFrame(keep, columns=["a", "b"]).astype("int64")

    known = rows.where("doc_id is not null").withColumn("slot", _slot("doc_id"))
    both = known.mapInPandas(make, "doc long, n long, tokens binary").where("n > 0").join(placed, "doc")
    both = both.repartition("a", "salt").sortWithinPartitions("a", "salt", "at")
    out = written(both.mapInPandas(compare, "a long, b long").distinct())
    discard(pairs, counts, placed)
    return out


def _ends(heads: DataFrame, wanted) -> DataFrame:
    """``doc, n, last, step, steps``: the last key of the prefix, and every ``step``-th of its keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, n, head in batch.loc[wanted(batch), ["doc", "n", "head"]].itertuples(index=False):
                prefix = np.frombuffer(head, "<i8")[: allowed(n) + 1]
                step = len(prefix) // MARKS + 1
                rows.append((doc, n, prefix[-1], step, prefix[::step].tolist()))
            yield pd.DataFrame(rows, columns=["doc", "n", "last", "step", "steps"])

    return heads.mapInPandas(run, "doc long, n long, last long, step int, steps array<long>")


def _leaders(posts: DataFrame) -> DataFrame:
    """``doc, leader, n``: the leader that most of a document's keys name, and how many do; some of the shared keys are asked.

    posts: ``token, doc``. What has no leader but itself isn't returned.
    """
    asked = posts.where(F.pmod(F.xxhash64("token"), F.lit(LEADING)) == 0).select("token", "doc")
    central = written(asked.groupBy("doc").agg(F.count("*").alias("n_keys")))
    leader = F.max(F.struct("n_keys", (-F.col("doc")).alias("less")))
    named = written(asked.join(central, "doc").groupBy("token").agg((-leader["less"]).alias("leader")))
    votes = asked.join(named, "token").groupBy("doc", "leader").agg(F.count("*").alias("n"))
    best = votes.groupBy("doc").agg(F.max(F.struct("n", (-F.col("leader")).alias("less"))).alias("m"))
    out = written(best.select("doc", (-F.col("m.less")).alias("leader"), F.col("m.n").alias("n_votes")).where("doc <> leader"))
    discard(central, named)
    return out


def _further_leaders(rows: DataFrame, tried: DataFrame | None) -> DataFrame:
    """``doc, leader`` of other groups: of all who have a crowded key the one of the fewest other keys, and the one of the most crowded keys; none of ``tried``.

    rows: ``token, doc, n, own, grp`` of crowded keys. A document asks the leader of each kind that most of its keys name and that its size may link to.
    """
    central = rows.groupBy("doc").agg(F.count("*").alias("n_keys"), F.first("n").alias("m"), F.first("own").alias("own"), F.first("grp").alias("led"))
    central = written(central if tried is None else central.join(tried.withColumnRenamed("leader", "doc"), "doc", "left_anti"))
    less = (-F.col("doc")).alias("less")
    pure = F.max(F.struct(((F.col("n_keys") - F.col("own")) / (F.col("m") - F.expr("(4 * m + 4) div 5") + 1)).alias("share"), "n_keys", less, "m", "led"))
    most = F.max(F.struct("n_keys", (-F.col("own")).alias("few"), less, "m", "led"))
    named = rows.select("token", "doc").join(central, "doc").groupBy("token").agg(pure.alias("pure"), most.alias("most"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), (-F.col(f"{k}.less")).alias("leader"), F.col(f"{k}.m").alias("m"), F.col(f"{k}.led").alias("led")) for k in ("pure", "most"))))
    named = written(named.select("token", kinds.alias("k")).select("token", "k.*"))
    votes = rows.join(named, "token").where("grp <> led and 5 * least(n, m) >= 4 * greatest(n, m)").groupBy("doc", "kind", "leader").agg(F.count("*").alias("n_votes"))
    best = votes.groupBy("doc", "kind").agg(F.max(F.struct("n_votes", (-F.col("leader")).alias("less"))).alias("m"))
    out = written(best.select("doc", (-F.col("m.less")).alias("leader")).distinct())
    discard(central, named)
    return out


def shingle_classes(documents: DataFrame, size: int = WORDS, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of documents.

    Texts that are null or have no words have the empty set, which links with nothing; their class is their own id. Rows with a null id
    get a null class. Rows that repeat an id are one node. Columns other than ``doc_id`` and ``text`` aren't read.
    """
    with shuffles_cleaned(documents.sparkSession):
        return _classes(documents, size, levels)


def _classes(documents: DataFrame, size: int, levels: tuple[int, ...]) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = documents.sparkSession
    sketches = written(_sketches(docs, size, spark.sparkContext.broadcast(_levels(docs, size, levels))))
    sets = sketches.where("n > 0 and doc_id is not null")
    dealt = _one_of_each(sets, _tokens).repartition("token")
    # asking for `first` and `served` (never null) makes both sides read the same columns, so that one exchange serves the counts and the join
    shared = dealt.groupBy("token").agg(F.count("*").alias("n_docs"), F.min("doc").alias("first"), F.max("inner").alias("served"))
    shared = shared.where("n_docs > 1 and first is not null and served is not null").select("token")
    posts = written(dealt.join(shared, "token"))  # tokens of one document only are gone
    ends = written(_one_of_each(sets, _ends))

    # groups
    close = _leaders(posts).join(ends.select("doc", "n"), "doc").where(f"{2 * LEADING} * n_votes >= n div 5 - n div 9")  # half of what is left of a prefix that has as many keys of its own as a link allows
    linked = _compared(close.select(F.col("leader").alias("a"), F.col("doc").alias("b")), docs, sets_link, size)
    # keys of the prefix that no other document has: differences from every set
    own = F.expr("n - (4 * n + 4) div 5 + 1") - F.col("n_shared")
    sizes = written(posts.groupBy("doc").agg(F.count("*").alias("n_shared")).join(ends, "doc").select("doc", "n", "last", own.alias("own")))
    linked, tried, before = linked.select(F.col("a").alias("src"), F.col("b").alias("dst")), None, float("inf")
    for k in range(ROUNDS + 1):
        groups = components(linked)
        weighed = written(groups.join(groups.groupBy("component").agg(F.count("*").alias("weight")), "component").select(F.col("node").alias("doc"), "component", "weight"))
        member = posts.join(sizes, "doc").join(weighed, "doc", "left").withColumns({"grp": F.coalesce("component", "doc"), "weight": F.coalesce("weight", F.lit(1))}).drop("component")

        # the matrix, of tokens that more than one group has; a set with more keys of its own than the smallest set there allows has no link by that token
        member = written(member)
        spread = written(member.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.min("n").alias("least")).where("low <> high").select("token", "least"))
        rows = written(member.join(spread, "token").where(f"own <= {_DIFFERENCES.format(n='n', m='greatest(least, (4 * n + 4) div 5)')}").drop("least"))
        discard(member, spread, weighed)
        reach = written(rows.groupBy("grp").agg(F.min("last").alias("reach"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("own").alias("least_own"), F.first("weight").alias("heavy")))
        union = written(rows.groupBy("token", F.col("grp").alias("open")).agg(F.min("doc").alias("b")).join(reach.withColumnRenamed("grp", "open"), "open"))

        # many groups of one key would meet each other there: their documents are compared with further leaders, unless the last round parted few of them
        crowded = written(union.groupBy("token").agg(F.count("*").alias("n_groups")).where(f"n_groups > {CROWD}"))
        met = crowded.agg(F.sum(F.col("n_groups") * F.col("n_groups"))).first()[0] or 0
        if k == ROUNDS or met <= PAIRS_A_ROW * rows.count() or met > 0.75 * before:
            break
        before = met
        asks = _further_leaders(rows.join(F.broadcast(crowded.select("token")), "token"), tried)  # rows / PAIRS_A_ROW at most
        more = _compared(asks.select(F.col("leader").alias("a"), F.col("doc").alias("b")), docs, sets_link, size)
        tried = asks.select("leader").distinct() if tried is None else tried.unionByName(asks.select("leader")).distinct()
        linked = written(linked.unionByName(more.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
        discard(rows, reach, union, crowded)
    discard(posts, sizes)

    # queries against groups of more documents that may link: those that lack more of the query's prefix than a link allows stay closed
    asking = rows.select("token", F.col("doc").alias("a"), F.col("grp").alias("of"), "n", "inner", "own", "weight")
    differ = _DIFFERENCES.format(n="n", m="greatest(least, (4 * n + 4) div 5)")
    fit = f"(weight < heavy or (weight = heavy and of < open)) and 4 * n <= 5 * most and 5 * n >= 4 * least and own <= {differ} and least_own <= {_DIFFERENCES.format(n='most', m='n')}"
    shares = written(asking.join(union, "token").where(fit).select("token", "a", "of", "open", "n", "inner", "own", "reach", "least", "b"))
    met = shares.groupBy("a", "open").agg(F.count_if(F.col("token") <= F.col("reach")).alias("common"), F.first("reach").alias("reach"), F.first("least").alias("least"), F.first("of").alias("of"), F.min(F.struct("token", "b"))["b"].alias("b"))
    # keys of the query's prefix up to there: (steps passed - 1) * step + 1 at least
    within = (F.size(F.filter("steps", lambda t: t <= F.col("reach"))) - 1) * F.col("step") + 1
    met = met.join(ends.withColumnRenamed("doc", "a"), "a").where(within - F.col("common") <= F.expr(differ))
    opened = written(met.select("a", "of", "open", "b").distinct())
    heads = sets.select("doc_id", "n", F.col("head").alias("tokens"))

    # one member of each open group first, that of the rarest shared key: a link makes the two groups one, and what else is open between them is settled
    first = opened.select("a", "b")
    near = _compared(_compared(first, heads, heads_may_link), docs, sets_link, size)
    joined = written(components(opened.join(near, ["a", "b"]).select(F.col("of").alias("src"), F.col("open").alias("dst"))))
    root = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_root"))
    left = opened.select("a", "of", "open").join(root("of"), "of", "left").join(root("open"), "open", "left").where("not coalesce(of_root, of) <=> coalesce(open_root, open)")

    # then the members that share a prefix key of the query; the smaller set needs it in its shorter prefix. Only keys that the group has are asked for
    asks = shares.select("token", "a", "open", "n", "inner", "own").join(written(left.select("a", "open").distinct()), ["a", "open"])
    other = rows.select("token", F.col("doc").alias("b"), F.col("n").alias("m"), F.col("grp").alias("open"), F.col("inner").alias("inner_b"), F.col("own").alias("own_b"))
    both = f"5 * least(n, m) >= 4 * greatest(n, m) and (n > m or inner) and (n < m or inner_b) and own <= {_DIFFERENCES.format(n='n', m='m')} and own_b <= {_DIFFERENCES.format(n='m', m='n')}"
    pairs = asks.join(other, ["token", "open"]).where(both).select("a", "b").distinct()
    more = _compared(_compared(pairs, heads, heads_may_link), docs, sets_link, size).unionByName(near)
    links = groups.where("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst"))
    classes = components(links.unionByName(more.select(F.col("a").alias("src"), F.col("b").alias("dst"))))

    # every document by its set, and ids with more than one set by the least class
    by_set = sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc")).join(classes.withColumnRenamed("node", "doc"), "doc", "left").select("d1", "d2", F.coalesce("component", "doc").alias("component"))
    out = sketches.join(written(by_set), ["d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of all ``documents``.

    Null texts and those without words have no shingles and link with nothing; texts of fewer than five words are one shingle. Texts are read whole. Rows that repeat an id are one node; equal
    texts link. Other columns aren't read; an empty table gives none.
    """
    return shingle_classes(table(spark, sf_dir, "documents"))


ORACLE_OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * k >= 80 * (n + m - k)),
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, s.s
"""
