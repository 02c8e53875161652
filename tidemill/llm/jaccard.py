"""N-gram Jaccard join with a token-group matrix.

1. One scan makes each document's set of word n-grams (64-bit hashes) and keeps what is narrow: its size, a 128-bit digest,
   min-hash bands and its lowest hashes. Documents of equal sets become one class.
2. Classes that share a band are partitioned into groups of similar documents. A group's core holds the tokens of more than
   half of its members; the member nearest to the core is its centre, and every member is described by its difference from
   the centre, which is short. Members too far from the centre stay alone.
3. Inside a group, members that reach the threshold with the centre are linked to it. Sizes and differences give the overlap of
   any two sets, and a set that does not reach the centre can only be linked to one that shares tokens of its difference:
   |u & v| counts (|u| + |v| - |du ^ dv|) / 2, and du, dv disjoint would bring u to the centre as well. So pairs are looked
   for through the rarest shared tokens of differences, and no group is compared member by member.
4. Between groups, sets that reach the threshold share one of the first n - ceil(t n) + 1 tokens of either, in an order common
   to all; tokens found often go last, counted in a sample of each set's lowest hashes, which reaches as far as its prefix may.
   The matrix holds for each such token the groups whose members have it there. A set that meets a group is bounded by the
   tokens it shares with the group's union there, plus what can lie behind them. Only qualifying groups are opened: the set is
   described by its difference from the centre, like a member, and step 3 covers it.

The result is exact for components: each pair over the threshold is linked, or both sides are linked to the same centre.

Defined results: null text, and text without words, has an empty set and is linked with nothing; a text of fewer than n words
has the whole sequence as its one token; equal sets are linked; repeated rows get equal results, and rows that share an id but
not the text are documents of their own; a null id is linked with nothing and has no component; an empty table gives an empty
result; extra columns don't matter; texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHES, discard, fresh, maybe_broadcast, small, stash, trimmed
from .components import components

BANDS, ROWS = 8, 3
#: A token in more samples than this goes last in the common order.
OFTEN = 24
#: A token in so many of a thousand texts makes way for others in the samples, and so many such tokens are known to a task.
LOCAL, LOCAL_TOKENS = 3, 200_000
#: Often-found tokens that tasks are told of (8 bytes each); with more, the bound OFTEN is raised, which costs time only.
OFTEN_TOKENS = 2_000_000
#: Ids that may be broadcast to pick texts or groups; more are joined by shuffle.
BROADCAST_ROWS = 300_000
#: Distinct words whose hashes a task remembers, and texts that it knows it has seen; both only save time.
CACHE_WORDS, CACHE_TEXTS = 200_000, 50_000
#: Rows that a task hands over at once.
ROWS_OUT = 100_000

_MASK = (1 << 64) - 1
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ^ (k << 7)) & _MASK | 1 for k in range(BANDS * ROWS + 16)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()
CACHES.append(_WORDS)


def tokens(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-grams of words (A-Z lower-cased, split at ASCII white space)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * _ODD[i]
    out = _mix(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def _among(t: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which tokens are in a sorted array that isn't empty."""
    at = np.searchsorted(known, t)
    at[at == len(known)] = 0
    return known[at] == t


def _need(n, percent: int):
    """The least overlap of a set of n tokens with another that it reaches the threshold with."""
    return -(-n * percent // 100)


def _near(n: int, percent: int) -> bool:
    """Whether a set of n tokens can reach the threshold with a set that isn't equal."""
    return n > 0 and (n - 1 >= _need(n, percent) or 100 * n >= percent * (n + 1))


def _digest(t: np.ndarray) -> tuple[int, int]:
    s = np.frombuffer(xxhash.xxh3_128_digest(t), np.int64)
    return int(s[0]), int(s[1])


def _signed(x: int) -> int:
    return (x & _MASK) - ((x & _MASK) >> 63 << 64)


def _class(k1: int, k2: int, salt: int) -> int:
    """A class's number: 64 bits of its digest; the salt is moved on until no two classes share a number."""
    return _signed(k1 ^ (k2 << salt if salt else 0))


_EDGES = np.array([k * ((1 << 64) // (BANDS * ROWS)) for k in range(BANDS * ROWS)], np.uint64)


def _bands(t: np.ndarray) -> np.ndarray:
    """One min-hash for each of BANDS * ROWS ranges of hashes (the next token upwards, around the end), ROWS to a band."""
    low = t[np.searchsorted(t, _EDGES) % len(t)].reshape(BANDS, ROWS)
    out = low[:, 0] * _ODD[0] + np.arange(BANDS, dtype=np.uint64) * _ODD[-1]
    for k in range(1, ROWS):
        out += low[:, k] * _ODD[k]
    return _mix(out).view(np.int64)


class _Seen(dict):
    """What a task knows of texts it has met, by their digests; forgets all when full."""

    def put(self, key: bytes, value):
        if len(self) >= CACHE_TEXTS:
            self.clear()
        self[key] = value


def sketches(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n, k1, k2, bands, sample: what one scan keeps of each document. A task gives a text's lists once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, common = _Seen(), np.empty(0, np.uint64)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                rows, sets = [], {}
                for k, text in enumerate(part.column(1).to_pylist()):
                    key = xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))
                    if key in seen:
                        rows.append((*seen[key], [], []))
                        continue
                    t = tokens(text, n)
                    own = (len(t), *_digest(t)) if len(t) else (0, 0, 0)
                    seen.put(key, own)
                    rows.append((*own, [], []))
                    if _near(len(t), percent):
                        sets[k] = t
                if sets:
                    found, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                    common = np.union1d(common if len(common) < LOCAL_TOKENS else common[:0], found[counts >= LOCAL])
                for k, t in sets.items():
                    # The lowest hashes, beyond the prefix by as many as may turn out to be found often, besides those known to be.
                    p = len(t) - _need(len(t), percent) + 1
                    p += p // 2 + 4
                    early = np.flatnonzero(~_among(t, common)) if len(common) else np.arange(len(t))
                    rows[k] = (*rows[k][:3], _bands(t), t[: early[p - 1] + 1 if len(early) >= p else len(t)].view(np.int64))
                kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], ["doc_id", "n", "k1", "k2", "bands", "sample"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n bigint, k1 bigint, k2 bigint, bands array<bigint>, sample array<bigint>")


def token_sets(docs: DataFrame, picked: DataFrame, n: int, salt: int) -> DataFrame:
    """picked (doc_id, id, ...) plus set: the sorted tokens of the classes named by id, their texts read again."""
    more = [c for c in picked.columns if c not in ("doc_id", "id")]
    joined = docs.select("doc_id", "text").join(maybe_broadcast(picked, BROADCAST_ROWS), "doc_id").select("text", "id", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part, on, sets = batch.slice(a, 500), [], []
                for k, (text, of) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    t = tokens(text, n)
                    if len(t) and _class(*_digest(t), salt) == of:  # rows of one id may hold another text
                        on.append(k)
                        sets.append(t.view(np.int64))
                rest = part.take(pa.array(on, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], pa.array(sets, pa.list_(pa.int64()))], ["id", *more, "set"])

    kinds = dict(picked.dtypes)
    return joined.mapInArrow(trimmed(run), ", ".join(f"{c} {kinds[c]}" for c in ("id", *more)) + ", set array<bigint>")


def families(narrow: DataFrame) -> DataFrame:
    """(id, family, m): classes under the smallest class of their bands, one step further where that has a smaller one itself."""
    spread = narrow.select("id", F.explode("bands").alias("value"))
    least = spread.groupBy("value").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("value", "first")
    own, own_path = stash(spread.join(least, "value").groupBy("id").agg(F.min("first").alias("family")), "first-of-bands")
    up = own.select(F.col("id").alias("family"), F.col("family").alias("top"))
    named = own.join(up, "family", "left").select("id", F.least("family", F.coalesce("top", "family")).alias("family"))
    named, named_path = stash(named, "families-named")
    sizes = named.groupBy("family").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    out, _ = stash(named.join(sizes, "family").select("id", "family", "m"), "families")
    discard(narrow.sparkSession, own_path)
    discard(narrow.sparkSession, named_path)
    return out


def _reaches(d: Column, n: Column, percent: int) -> Column:
    """Whether sets of n tokens together, d of them in only one, reach the threshold: d <= (1 - t) / (1 + t) n."""
    return d * (100 + percent) <= n * (100 - percent)


def members(docs: DataFrame, reps: DataFrame, family: DataFrame, n: int, percent: int, salt: int) -> DataFrame:
    """(grp, id, n, delta, d, linked): members of groups, named by their centres, with their differences from them."""
    spark = docs.sparkSession
    picked, picked_path = stash(family.join(reps.select("id", F.col("rep").alias("doc_id")), "id"), "members-picked")
    sets, sets_path = stash(token_sets(docs, picked, n, salt), "member-sets")
    votes = sets.select("family", "m", F.explode("set").alias("token")).groupBy("family", "token").agg(F.count(F.lit(1)).alias("c"), F.first("m").alias("m"))
    # Fewer than twice the members' mean size: bounded by a document.
    core, core_path = stash(votes.where(F.col("c") * 2 > F.col("m")).groupBy("family").agg(F.collect_list("token").alias("core")), "cores")
    none = F.array().cast("array<bigint>")
    held = sets.join(core, "family", "left").withColumn("core", F.coalesce("core", none))
    off, off_path = stash(held.select("family", "id", F.size("set").alias("n"), F.array_except("set", "core").alias("plus"), F.array_except("core", "set").alias("minus")), "off-core")
    discard(spark, sets_path)
    centre = off.groupBy("family").agg(F.min(F.struct((F.size("plus") + F.size("minus")).alias("d"), "id", "n", "plus", "minus")).alias("c"))
    both = off.join(centre, "family")
    ways = [F.array_except(F.col(a), F.col(b)) for x in ("plus", "minus") for a, b in ((x, f"c.{x}"), (f"c.{x}", x))]
    told = both.select(F.col("c.id").alias("grp"), "id", "n", F.concat(*ways).alias("delta"), (F.col("n") + F.col("c.n")).alias("sum"))
    told = told.withColumn("d", F.size("delta")).where(F.col("d") * 3 <= F.col("sum")).withColumn("linked", _reaches(F.col("d"), F.col("sum"), percent)).drop("sum")
    out, _ = stash(told.dropDuplicates(["grp", "id"]), "members")
    for path in (picked_path, core_path, off_path):
        discard(spark, path)
    return out


def _often(narrow: DataFrame) -> np.ndarray:
    """Tokens found in many samples, sorted. Any set of them gives an exact join; a good one keeps the matrix sparse."""
    counts, path = stash(narrow.select(F.explode("sample").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > OFTEN), "often")
    bound = OFTEN
    while not small(counts.where(F.col("c") > bound), OFTEN_TOKENS):
        bound *= 4
    got = counts.where(F.col("c") > bound).select("token").toArrow().column(0).to_numpy()
    discard(narrow.sparkSession, path)
    return np.sort(got.astype(np.int64).view(np.uint64))


def prefixes(docs: DataFrame, often: np.ndarray, n: int, percent: int, salt: int) -> DataFrame:
    """(token, id, at): the first tokens of every set, those found often last; at packs the set's size and the position."""
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, held, of, size, many = sent.value, _Seen(), [], [], [], 0

        def out() -> pa.RecordBatch:
            counts = [len(h) for h in held]
            token = np.concatenate([*held, np.empty(0, np.uint64)]).view(np.int64)
            at = np.concatenate([np.arange(c, dtype=np.int64) + (s << 32) for c, s in zip(counts, size, strict=True)] or [np.empty(0, np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(np.array(of, np.int64), counts)), pa.array(at)], ["token", "id", "at"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                key = xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))
                if key in seen:
                    continue
                seen.put(key, None)
                t = tokens(text, n)
                if not _near(len(t), percent):
                    continue
                cid, p = _class(*_digest(t), salt), len(t) - _need(len(t), percent) + 1
                total = len(t)
                if len(known):
                    late = _among(t, known)
                    t = np.concatenate((t[~late][:p], t[late]))
                held.append(t[:p])
                of.append(cid)
                size.append(total)
                many += p
                if many >= ROWS_OUT:
                    yield out()
                    held, of, size, many = [], [], [], 0
        yield out()

    return docs.where("doc_id IS NOT NULL").select("text").mapInArrow(trimmed(run), "token bigint, id bigint, at bigint")


def visits(docs: DataFrame, groups: DataFrame, often: np.ndarray, n: int, percent: int, salt: int) -> DataFrame:
    """(id, grp): classes and the other groups that qualify for being opened to them, by the token-group matrix."""
    spark, same = docs.sparkSession, Window.partitionBy("token")
    rows = prefixes(docs, often, n, percent, salt).withColumns({"x": F.min("id").over(same), "y": F.max("id").over(same)}).where("x < y").drop("x", "y")
    met, met_path = stash(rows, "tokens-met")
    size, pos = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit((1 << 32) - 1))
    met = met.dropDuplicates(["token", "id"]).join(maybe_broadcast(groups.select("id", "grp", "members"), BROADCAST_ROWS), "id", "left")
    met = met.select("token", "id", F.coalesce("grp", "id").alias("grp"), F.coalesce("members", F.lit(1)).alias("members"), size.alias("n"), (size - pos).alias("left"))
    # Tokens behind the prefix of a set of n: ceil(t n) - 1.
    met, asked_path = stash(met.withColumn("rest", F.expr(f"(n * {percent} + 99) div 100 - 1")), "asked")
    cells, cells_path = stash(met.groupBy("token", "grp").agg(F.first("members").alias("members"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("left").alias("left"), F.max("rest").alias("most")), "matrix")
    q, g = met.alias("q"), cells.alias("g")
    larger = (F.col("q.members") < F.col("g.members")) | (F.col("q.members") == F.col("g.members")) & (F.col("q.grp") < F.col("g.grp"))
    sized = (F.col("g.high") * 100 >= F.col("q.n") * percent) & (F.col("q.n") * 100 >= F.col("g.low") * percent)
    seen = q.join(g, (F.col("q.token") == F.col("g.token")) & larger & sized).select("q.id", "g.grp", "q.n", "q.rest", F.col("q.left").alias("mine"), "g.low", "g.left", "g.most")
    # The first token in common leaves enough tokens behind it on either side; the least overlap belongs to the smallest member in reach.
    low = F.greatest("low", F.expr(f"(n * {percent} + 99) div 100"))
    seen = seen.withColumn("low", low).withColumn("least", F.expr(f"({percent} * (n + low) + {99 + percent}) div {100 + percent}"))
    seen = seen.withColumn("first", (F.col("mine") >= F.col("least")) & (F.col("left") >= F.col("least")))
    pairs = seen.groupBy("id", "grp").agg(F.count(F.lit(1)).alias("shared"), F.max("first").alias("first"), F.first("rest").alias("rest"), F.min("least").alias("least"), F.max("most").alias("most"))
    out, _ = stash(pairs.where(F.col("first") & (F.col("shared") + F.greatest("rest", "most") >= F.col("least"))).select("id", "grp"), "visits")
    for path in (met_path, asked_path, cells_path):
        discard(spark, path)
    return out


def opened(docs: DataFrame, reps: DataFrame, visit: DataFrame, groups: DataFrame, n: int, percent: int, salt: int) -> DataFrame:
    """(grp, id, n, delta, d, linked): like members, for the sets that other groups are opened to."""
    spark = docs.sparkSession
    ids = visit.select("id").union(visit.select("grp")).distinct()
    picked, picked_path = stash(ids.join(reps.select("id", F.col("rep").alias("doc_id")), "id"), "visitors-picked")
    sets, sets_path = stash(token_sets(docs, picked, n, salt), "visitor-sets")
    radius = groups.groupBy("grp").agg(F.max("d").alias("radius"))
    both = visit.join(sets, "id").join(sets.select(F.col("id").alias("grp"), F.col("set").alias("centre")), "grp")
    told = both.select("grp", "id", F.size("set").alias("n"), F.concat(F.array_except("set", "centre"), F.array_except("centre", "set")).alias("delta"), (F.size("set") + F.size("centre")).alias("sum"))
    told = told.withColumn("d", F.size("delta")).withColumn("linked", _reaches(F.col("d"), F.col("sum"), percent))
    told = told.join(maybe_broadcast(radius, BROADCAST_ROWS), "grp", "left")
    # A member within reach lies at least d less the largest difference of linked sets from the centre.
    reach = (F.col("d") - F.coalesce("radius", F.lit(0))) * percent <= F.col("n") * (100 - percent)
    out, _ = stash(told.where(F.col("linked") | (F.coalesce("radius", F.lit(0)) > 0) & reach).drop("sum", "radius").dropDuplicates(["grp", "id"]), "opened")
    discard(spark, sets_path)
    discard(spark, picked_path)
    return out


def difference_links(told: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) inside groups besides those to the centres. told: members and visitors, with a column visit."""
    spark = told.sparkSession
    entries = told.select("grp", "id", "n", "d", "linked", "visit", F.explode("delta").alias("token"))
    often = entries.groupBy("grp", "token").agg(F.count(F.lit(1)).alias("f"))
    by = Window.partitionBy("grp", "id").orderBy("f", "token")
    placed = entries.join(often, ["grp", "token"]).withColumn("pos", F.row_number().over(by) - 1).where("f > 1").drop("f")
    # Tokens left at the first common one are at least as many as the pair must share. With a partner that isn't linked to the
    # centre a set shares more than t / (1 + t) of its difference; a set that isn't linked itself, d - (1 - t) / t of its size.
    left = F.col("d") - F.col("pos")
    placed = placed.withColumn("strong", left * (100 + percent) > F.col("d") * percent)
    placed = placed.where(F.col("strong") | ~F.col("linked") & (left * percent >= F.col("d") * percent - (100 - percent) * F.col("n")))
    placed, placed_path = stash(placed, "differences")
    a, b = placed.where("NOT linked").alias("a"), placed.where("strong").alias("b")
    once = (F.col("b.linked") | F.col("a.strong") & (F.col("a.id") < F.col("b.id"))) & (F.col("a.id") != F.col("b.id")) & ~(F.col("a.visit") & F.col("b.visit"))
    need = (F.col("a.d") + F.col("b.d")) * (100 + percent) - (F.col("a.n") + F.col("b.n")) * (100 - percent)
    fits = F.least(F.col("a.d") - F.col("a.pos"), F.col("b.d") - F.col("b.pos")) * 2 * (100 + percent) >= need
    sized = (F.col("a.n") * 100 >= F.col("b.n") * percent) & (F.col("b.n") * 100 >= F.col("a.n") * percent)
    met = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.token") == F.col("b.token")) & once & fits & sized)
    pairs, pairs_path = stash(met.select(F.col("a.grp").alias("grp"), F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct(), "pairs-met")
    one = told.select("grp", F.col("id").alias("u"), F.col("delta").alias("du"), F.col("n").alias("nu"))
    other = told.select("grp", F.col("id").alias("v"), F.col("delta").alias("dv"), F.col("n").alias("nv"))
    apart = F.size("du") + F.size("dv") - 2 * F.size(F.array_intersect("du", "dv"))
    links, _ = stash(pairs.join(one, ["grp", "u"]).join(other, ["grp", "v"]).where(_reaches(apart, F.col("nu") + F.col("nv"), percent)).select("u", "v").distinct(), "difference-links")
    discard(spark, placed_path)
    discard(spark, pairs_path)
    return links


def class_links(docs: DataFrame, narrow: DataFrame, reps: DataFrame, n: int, percent: int, salt: int) -> DataFrame:
    """Links (u, v) between classes whose components are those of all pairs over the threshold."""
    own = members(docs, reps, families(narrow), n, percent, salt)
    sizes = own.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    own, _ = stash(own.join(sizes, "grp"), "groups")
    visit = visits(docs, own, _often(narrow), n, percent, salt)
    guests = opened(docs, reps, visit, own, n, percent, salt)
    told = own.drop("members").withColumn("visit", F.lit(False)).unionByName(guests.withColumn("visit", F.lit(True)))
    to_centre = told.where("linked AND id <> grp").select(F.col("id").alias("u"), F.col("grp").alias("v"))
    return to_centre.unionByName(difference_links(told, percent))


def labels(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n, k1, k2 (the set's digest), component (of classes), component_id, n_class per document."""
    narrow, _ = stash(sketches(docs, n, percent), "sketches")
    keys = ["k1", "k2"]
    filled = narrow.where("n > 0 AND doc_id IS NOT NULL")
    reps, _ = stash(filled.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_class")), "classes")
    salt, number = 0, F.col("k1")
    while reps.groupBy(number.alias("id")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count():
        salt += 1
        number = F.col("k1").bitwiseXOR(F.shiftleft("k2", salt))
    reps = reps.withColumn("id", number)
    links = class_links(docs, filled.withColumn("id", number), reps, n, percent, salt)
    joined, _ = stash(components(links).join(reps.select("id", "rep"), "id"), "joined")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    joined = joined.join(least, "component").select("id", "component", "component_id")
    labelled, _ = stash(reps.join(joined, "id", "left").select(*keys, "n_class", F.coalesce("component", "id").alias("component"), F.coalesce("component_id", "rep").alias("component_id")), "labels")
    taking = F.col("n") > 0
    out = narrow.select("doc_id", "n", *[F.when(taking & F.col("doc_id").isNotNull(), F.col(k)).alias(k) for k in keys]).join(labelled, keys, "left")
    return out.select("doc_id", "n", *keys, "component", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_class", F.lit(1).cast("long")).alias("n_class"))


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), n_class (documents of the same set), per document."""
    return labels(docs, n, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_class")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are linked to another which stays: of a component the smallest doc_id stays, of rows that
    share it the one with the least digest of its set, of rows equal in both any one. Rows without words or id all stay, but of
    those that repeat an id without words one does."""
    told, _ = stash(labels(docs, n, percent), "duplicates")
    twice, _ = stash(told.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"), "ids-repeated")
    gone, _ = stash(told.where("doc_id <> component_id").select("doc_id").union(twice).distinct(), "dropped")
    (key,) = fresh(docs, "_gone")
    out = docs.join(maybe_broadcast(gone.withColumnRenamed("doc_id", key), BROADCAST_ROWS), docs["doc_id"] == F.col(key), "left_anti")
    if not twice.limit(1).count():
        return out
    mine = told.where("doc_id = component_id").join(twice, "doc_id", "left_semi")
    chosen = mine.where("n > 0").groupBy("component", "doc_id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("doc_id", "k.k1", "k.k2")
    zero = F.lit(0).cast("long")
    chosen = chosen.union(mine.where("n = 0").select("doc_id", zero, zero).distinct())
    k1, k2, c1, c2 = fresh(docs, "_k1", "_k2", "_c1", "_c2")
    rows = digests(docs.join(maybe_broadcast(twice.withColumnRenamed("doc_id", key), BROADCAST_ROWS), docs["doc_id"] == F.col(key), "left_semi"), n, k1, k2)
    chosen = chosen.toDF(key, c1, c2)
    kept = rows.join(chosen, (rows["doc_id"] == chosen[key]) & (rows[k1] == chosen[c1]) & (rows[k2] == chosen[c2]), "left_semi")
    return out.unionByName(kept.dropDuplicates(["doc_id", k1, k2]).drop(k1, k2))


def digests(docs: DataFrame, n: int, k1: str, k2: str) -> DataFrame:
    """docs plus the digest of every document's set, zeros for an empty one."""

    @F.arrow_udf("struct<a:bigint,b:bigint>")
    def run(text: pa.Array) -> pa.Array:
        sets = [tokens(t, n) for t in text.to_pylist()]
        both = [_digest(t) if len(t) else (0, 0) for t in sets]
        return pa.StructArray.from_arrays([pa.array([d[k] for d in both], pa.int64()) for k in range(2)], ["a", "b"])

    (both,) = fresh(docs, "_digest")
    return docs.withColumn(both, run("text")).withColumn(k1, F.col(both)["a"]).withColumn(k2, F.col(both)["b"]).drop(both)


def oracle_sql(n: int, percent: int) -> str:
    gram = " || ' ' || ".join(f"ws[i{f' + {k}' if k else ''}]" for k in range(n))
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, {gram} AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n} + 2)) AS i FROM w WHERE len(ws) >= {n})
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND {n} - 1),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN c x ON x.doc_id = u JOIN c y ON y.doc_id = v WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.u, r.reach FROM r JOIN e ON e.v = r.doc_id),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id),
k AS (SELECT doc_id, coalesce(list(s ORDER BY s), []) AS s FROM w LEFT JOIN g USING (doc_id) GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, m.component_id, CAST(CASE WHEN c.n IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY c.n, k.s) END AS BIGINT) AS n_class
FROM w JOIN m USING (doc_id) JOIN k USING (doc_id) LEFT JOIN c ON c.doc_id = w.doc_id"""
