"""Exact n-gram Jaccard join by partition, pigeonhole and one-deletion neighbourhoods.

A text's set holds the 64-bit hashes of its word n-grams. Two sets of Jaccard
similarity t or more differ in at most D = floor((|X| + |Y|) * (1 - t) / (1 + t))
elements. Sizes are cut into bands; a set takes part in its own band and, if a
larger partner may lie there, in the next one. In a band, elements are hashed into
m segments. A segment may be allocated 0 (skipped), 1 (must be equal) or 2 (may
differ in one element, found through the one-deletion neighbourhood). By the
pigeonhole principle a pair is found if one of the two sets allocates D + 1 units
over its non-empty segments. Sets that happen to have too few non-empty segments
for D + 1 units are hashed again with another function, until they have enough;
of two sets the one that has enough first finds the other, as both took part in
all functions up to that one.

Allocation is by cost. Small bands give every segment a deletion neighbourhood,
which is cheap there and far more selective; large bands use equal segments only.
A signature that occurs once costs nothing, so after one shuffle the allocation of
a set takes all its unique segments and adds the least frequent shared ones until
D + 1 units are reached: passages that many documents share are skipped as long
as the rest of a document suffices. Signatures of different bands never meet, so that
shuffle is done in PASSES parts of the bands, one after the other: together they
would take several times the input on disk.

Links are verified exactly on the whole sets. Equal sets are one class and are
joined once. Inside a group of candidates, sets are first compared with a hub. What
then remains are candidates whose two sets are not yet connected; in a large group
of variants these would be very many pairs. So each set is described by a
reference, the elements that most sets with its hub have: r of its elements are in
the reference, the others are its own. Two sets share at most r elements plus those
of the one's own elements that the other has. A pair is therefore similar only if
r is large enough for both, and then the index pairs them, or if it shares enough
own elements of one, and then it is found by the rarest of these. All other
candidates are too far apart, whatever their number, and need not be paired.

Edge cases: null, empty and blank texts have an empty set and link with nothing; a
text of fewer than n words is one shingle; repeated rows are members of the same
class; rows with one doc_id are one node, so several texts of a doc_id count as
linked; an empty table gives an empty result; other columns are ignored. Elements are
64-bit hashes: two different shingles are taken for one with a chance of 2**-64.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.order import numbered
from lectern.llm._components import components
from lectern.llm._spark import Scratch, fresh, table, texts
from lectern.llm._text import U, Slice, grams, mix, signed, slices

WORDS = 5
PERCENT = 80
SMALL = 26
STAR_ROUNDS = 2
HUBS = 2
#: Parts of the bands whose signatures are on disk one after the other.
PASSES = 2
#: Elements that pairs carry at once when they are verified: this part of all, and so many at least.
CARRIED, LEAST_CARRIED = 1 / 8, 1 << 22

#: Least similarity in percent: below, a similar pair may share too little for the pigeonhole.
LEAST_PERCENT = 51
#: Ratio of set sizes in one band of the last step.
SIZE_BAND = 1.05

_EDGES = [1]
while _EDGES[-1] < 1 << 40:
    _EDGES.append(max(_EDGES[-1] + 1, -(-_EDGES[-1] * 3 // 2)))


def word_sets(s: Slice, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    starts, ends, row = s.words()
    h = s.hashes(starts, ends, lower=True)
    at, g = grams(h, row, n)
    cut = np.searchsorted(row[at], np.arange(s.rows + 1))
    words = np.searchsorted(row, np.arange(s.rows + 1))
    out = []
    for i in range(s.rows):
        k = words[i + 1] - words[i]
        if 0 < k < n:
            _, whole = grams(h[words[i] : words[i + 1]], row[words[i] : words[i + 1]], int(k))
            out.append(mix(whole + U(k)))
        else:
            out.append(np.unique(g[cut[i] : cut[i + 1]]))
    return out


def difference(total: int, percent: int) -> int:
    """Largest symmetric difference of two similar sets with so many elements together."""
    return total * (100 - percent) // (100 + percent)


class Bands:
    """Size bands for one threshold: segments, deletion neighbourhoods and membership."""

    def __init__(self, percent: int):
        if not LEAST_PERCENT <= percent <= 100:
            raise ValueError(f"percent is {percent}; it must be from {LEAST_PERCENT} to 100")
        self.percent = percent

    def of(self, n: int) -> list[int]:
        """The set's own band, and the next one if a similar larger set may lie there."""
        own = int(np.searchsorted(_EDGES, n, side="right")) - 1
        return [own] + ([own + 1] if n * 100 // self.percent >= _EDGES[own + 1] else [])

    def shape(self, band: int) -> tuple[int, bool]:
        """(number of segments, whether they have deletion neighbourhoods)."""
        top = _EDGES[band + 1] - 1
        d = difference(2 * top, self.percent)
        if top <= SMALL:
            return (1 if d <= 1 else -(-(d + 1) // 2) + 1), True
        return -(-d * 9 // 8) + 2, False

    def units(self, n: int, band: int) -> int:
        """Units that a set of n elements must allocate to find all its partners in this band."""
        top = _EDGES[band + 1] - 1
        return difference(n + min(n * 100 // self.percent, top), self.percent) + 1

    def signatures(self, u: np.ndarray, among: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of signatures and places, of the bands `among` the set's own ones; a place packs band, function, units, slack and segment."""
        for band in self.of(len(u)) if among is None else among:
            need = self.units(len(u), band)
            if need == 1:
                continue
            base, near = self.shape(band)
            for function in range(64):
                m = min(base << (function // 4), (1 << 24) - 1)  # more segments where few do not spread a set
                salt = ((band << 8) + function + 1) * 0xD1342543DE82EF95 % (1 << 64)
                seg = ((mix(u + U(salt)) >> U(32)) * U(m) >> U(32)).astype(np.int64)
                order = np.argsort(seg, kind="stable")
                seg, item = seg[order], mix(u[order] + U(0x2545F4914F6CDD1D))
                first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
                size = np.diff(np.append(first, len(seg)))
                whole, ids = np.add.reduceat(item, first), seg[first]
                worth = np.where(size > 1, 2, 1) if near else np.ones(len(ids), dtype=np.int64)
                slack = int(worth.sum()) - need
                place = (band << 52) | (function << 46) | (worth << 44) | (max(slack, 0) << 24) | ids
                tag = lambda sums, at, salt=salt: mix(sums + mix(at.astype(U) * U(0x9E3779B97F4A7C15) + U(salt)))
                yield tag(whole, ids), place
                if near:
                    part = np.repeat(np.arange(len(ids)), size)
                    drop = np.flatnonzero(size[part] > 1)
                    yield tag(whole[part[drop]] - item[drop], seg[drop]), place[part[drop]]
                if slack >= 0:
                    break
            else:
                raise AssertionError(f"no function spreads a set of {len(u)} elements")


def _class_key(u: np.ndarray) -> bytes:
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest()


def _short(key: bytes) -> int:
    """The class as a long, for rows on the move; two classes may share one, which only adds candidates."""
    return int.from_bytes(key[:8], "little", signed=True)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in slices(b.column("text")):
            sets = word_sets(s)
            keys = [_class_key(u) if len(u) else None for u in sets]
            arrays = [pa.array([len(u) for u in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([None if k is None else _short(k) for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s.first, s.rows), *arrays], ["doc_id", "n", "class_key", "class"])


def _passes(classes: DataFrame, percent: int, parts: int) -> list[tuple[int, int]]:
    """Ranges of bands, from the first to before the last, with about as many signatures each; together all bands."""
    size = F.floor(F.log2("n") * 8)  # at most 8 * 64 rows for the driver
    bands, sums = Bands(percent), np.zeros(len(_EDGES))
    for level, sets, total in classes.groupBy(size.alias("level")).agg(F.count("*"), F.sum("n")).collect():
        for band in bands.of(max(1, total // sets)):
            sums[band] += sets * bands.shape(band)[0]
    below = np.append(0, np.cumsum(sums))
    cuts = [int(np.abs(below - below[-1] * k / parts).argmin()) for k in range(1, parts)]
    ends = [0, *cuts, len(_EDGES)]
    return [(a, b) for a, b in zip(ends, ends[1:], strict=False) if a < b]


def _long_enough(low: int):
    """Column: false only for texts whose sets have no place in band `low` or above, as n shingles take n words with a byte between them."""
    return F.octet_length("text") >= 2 * _EDGES[max(low - 1, 0)] - 1


def _signature_rows(percent: int, low: int = 0, high: int = len(_EDGES)):
    """Signature rows of the bands from `low` to before `high`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for b in batches:
            for s in slices(b.column("text")):
                sig, of, place = [], [], []
                for u in word_sets(s):
                    own = [band for band in bands.of(len(u)) if low <= band < high] if len(u) else []
                    key = _class_key(u) if own else None
                    if key is None or key in seen:  # an equal set of this task has spoken for the class
                        continue
                    seen.add(key)
                    for found, where in bands.signatures(u, own):
                        sig.append(found)
                        place.append(where)
                        of.append(np.full(len(found), _short(key), dtype=np.int64))
                if sig:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sig))), pa.array(np.concatenate(of)), pa.array(np.concatenate(place))], ["sig", "class", "place"])

    return run


def _allocate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost-based allocation: of a set's shared segments the cheapest are chosen, only as far as its slack requires."""
    for b in batches:
        own = b.column("class").to_numpy()
        lists = b.column("rows")
        bounds = lists.offsets.to_numpy()
        flat = lists.values
        k, place, sig = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("k", "place", "sig"))
        out_sig, out_class, out_chosen = [], [], []
        for i in range(b.num_rows):
            part = slice(bounds[i], bounds[i + 1])
            where, back = np.unique(place[part], return_inverse=True)
            cost = np.bincount(back, weights=k[part])
            worth, group = where >> 44 & 3, where >> 46
            order = np.lexsort((where, cost, group))
            spent = np.cumsum(worth[order]) - worth[order]
            head = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
            total = np.add.reduceat(worth[order], head)
            size = np.diff(np.append(head, len(order)))
            need = np.repeat(total, size) - (where[order] >> 24 & (1 << 20) - 1)
            chosen = np.zeros(len(where), dtype=bool)
            chosen[order] = spent - np.repeat(spent[head], size) < need
            out_sig.append(sig[part])
            out_chosen.append(chosen[back])
            out_class.append(np.full(bounds[i + 1] - bounds[i], own[i]))
        if out_sig:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_sig, out_class, out_chosen)], ["sig", "class", "chosen"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in slices(b.column("text")):
            out = [signed(u) for u in word_sets(s)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s.first, s.rows), pa.array(out, pa.list_(pa.int64()))], ["doc", "items"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, name: str, most: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar.

    To be verified a pair carries a whole set, and in large tables there are many more candidates
    than sets. So they go in parts, one after the other, whose sets have about `most` elements.
    """
    carried = pairs.agg(F.sum("n")).first()[0] or 0
    parts, found = max(1, -(-carried // most)), []
    left = sets.select(F.col("doc").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("items").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    for part in range(parts):
        both = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == part).select("a", "b").join(left, "a").join(right, "b")
        links = both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")
        found.append(scratch.keep(links, f"{name}_{part}"))
    return reduce(DataFrame.unionByName, found)


def _band(n):
    """Column: the size band of n elements in the last step."""
    return F.floor(F.log(n.cast("double")) / math.log(SIZE_BAND)).cast("int")


def _bands_up_to(n, limit, percent: int):
    """Column: the bands of all sizes that a set of n elements can be similar to, up to `limit`."""
    return F.sequence(_band(F.ceil(n * percent / 100)), _band(F.least(limit, F.floor(n * 100 / percent))))


def _against_reference(held: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, comp, n, r and own of all `members` (doc, comp, hub), `held` with their items: elements in the reference of their hub, and the others."""
    of = members.groupBy("hub").agg(F.count("*").alias("of"))
    often = held.select("hub", F.explode("items").alias("item")).groupBy("hub", "item").agg(F.count("*").alias("k")).join(of, "hub").filter("2 * k > of")
    centre = scratch.keep(often.groupBy("hub").agg(F.collect_list("item").alias("centre")), "centres")
    there = F.coalesce("centre", F.array().cast("array<long>"))
    return held.join(centre, "hub", "left").select("doc", "comp", F.size("items").alias("n"), F.size(F.array_intersect("items", there)).alias("r"), F.array_except("items", there).alias("own"))


def _pairs_by_own(held: DataFrame, described: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, na, b, nb) of different components that share an own element of a, by a's rarest ones.

    Of k own elements that other components have, in order of frequency, the one at
    place p is the first that a shares with b only if b is small enough for the
    elements from there on, and r, to reach the similarity.
    """
    items = held.select("doc", "comp", F.size("items").alias("n"), F.explode("items").alias("item"))
    across = items.groupBy("item").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("k")).filter("least < most").select("item", "k")
    across = scratch.keep(across, "across")
    own = described.select("doc", "comp", "n", "r", F.explode("own").alias("item")).join(across, "item")
    lists = own.groupBy("doc", "comp", "n", "r").agg(F.array_sort(F.collect_list(F.struct("k", "item"))).alias("known"))
    probes = lists.select("*", F.posexplode("known").alias("p", "e"))
    probes = probes.withColumn("limit", F.floor((100 + percent) * (F.size("known") - F.col("p") + F.col("r")) / percent) - F.col("n")).filter(f"100 * limit >= {percent} * n")
    one = probes.select(F.col("doc").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), "limit", F.col("e.item").alias("item"), F.explode(_bands_up_to(F.col("n"), F.col("limit"), percent)).alias("band"))
    two = items.select("item", _band(F.col("n")).alias("band"), F.col("doc").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"))
    return one.join(two, ["item", "band"]).filter("ca <> cb AND nb <= limit").select("a", "na", "b", "nb")


def _pairs_by_index(now: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, na, b, nb) of different components that share a signature and whose references leave both of them room."""
    room = described.select("doc", "n", (F.floor((100 + percent) * F.col("r") / percent) - F.col("n")).alias("limit")).filter(f"100 * limit >= {percent} * n")
    able = now.select("sig", "doc", "comp", "chosen", "shares").join(room, "doc")
    main = able.groupBy("sig").agg(F.max_by("comp", F.struct("shares", "doc")).alias("main"), F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most").select("sig", "main")
    out = able.join(main, "sig").filter("comp <> main")
    one = out.select("sig", F.col("doc").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("limit").alias("la"), F.col("chosen").alias("one"), F.explode(_bands_up_to(F.col("n"), F.col("limit"), percent)).alias("band"))
    two = able.select("sig", _band(F.col("n")).alias("band"), F.col("doc").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("limit").alias("lb"), F.col("chosen").alias("two"))
    return one.join(two, ["sig", "band"]).filter("ca <> cb AND nb <= la AND na <= lb AND (one OR two)").select("a", "na", "b", "nb")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs`."""
    scratch = Scratch(docs.sparkSession)
    docs = texts(docs)
    summary = scratch.keep(docs.mapInArrow(_summaries, "doc_id long, n long, class_key binary, class long"), "summary")
    classes = summary.filter("class_key IS NOT NULL").groupBy("class_key", "class", "n").agg(F.min("doc_id").alias("rep"))
    classes = scratch.keep(classes, "classes")
    most = max(LEAST_CARRIED, int((classes.agg(F.sum("n")).first()[0] or 0) * CARRIED))

    same, parts = Window.partitionBy("sig"), []
    for low, high in _passes(classes, percent, PASSES):
        rows = (docs.filter(_long_enough(low)) if low else docs).mapInArrow(_signature_rows(percent, low, high), "sig long, class long, place long")
        met = rows.withColumns({"k": F.count("*").over(same), "least": F.min("class").over(same), "most": F.max("class").over(same)})
        parts.append(scratch.keep(met.filter("least < most").select("sig", "class", "place", "k"), f"shared{low}"))
        scratch.sweep()
    shared = reduce(DataFrame.unionByName, parts)

    per_class = shared.groupBy("class").agg(F.collect_list(F.struct("k", "place", "sig")).alias("rows"))
    flagged = scratch.keep(per_class.mapInArrow(_allocate, "sig long, class long, chosen boolean"), "flagged_all")
    scratch.forget(*(name for name in scratch.paths if name.startswith("shared")))
    scratch.sweep()
    live = flagged.filter("chosen").select("sig").distinct()
    reps = classes.select("class", F.col("rep").alias("doc"), "n")
    met = flagged.join(live, "sig", "left_semi").join(reps, "class").groupBy("sig", "doc", "n").agg(F.max("chosen").alias("chosen"))
    met = scratch.keep(met, "met")
    size = met.groupBy("sig").agg(F.count("*").alias("k"))
    shares = met.join(size, "sig").groupBy("doc").agg(F.sum("k").alias("shares"))
    flagged = scratch.keep(met.join(shares, "doc"), "flagged")
    scratch.forget("flagged_all", "met")

    wanted = scratch.keep(flagged.select(F.col("doc").alias("doc_id")).distinct(), "wanted")
    sets = docs.join(wanted, "doc_id", "left_semi").mapInArrow(_set_rows, "doc long, items array<long>")
    sets = scratch.keep(sets, "sets")
    scratch.sweep()

    def pairs_of(votes: DataFrame) -> DataFrame:
        close = votes.filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        return close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest("na", "nb").alias("n")).distinct()

    comps = scratch.keep(wanted.select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("comp")), "comps0")
    for turn in range(STAR_ROUNDS + 1):
        now = flagged.join(comps, "doc")
        # First the set that shares most with all others is the hub, as an original is of its copies; then others by chance.
        hub_rank = F.struct("shares", "doc") if turn == 0 else F.struct(F.xxhash64("doc", F.lit(turn)), "doc")
        mixed = now.groupBy("sig").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.max_by(F.struct("doc", "comp", "n"), hub_rank).alias("hub")).filter("least < most")
        if turn < STAR_ROUNDS:
            near = now.join(mixed.select("sig", "hub"), "sig").filter("comp <> hub.comp").select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("hub.doc").alias("b"), F.col("hub.n").alias("nb"))
            votes = near.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("votes"))
            votes = votes.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("votes"), "b"))).filter(F.col("place") <= HUBS)
            if turn == 0:
                votes = scratch.keep(votes, "votes")
                hubs = votes.filter("place = 1").groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("hub"))
            pairs = pairs_of(votes)
        else:
            now = scratch.keep(now.join(mixed.select("sig"), "sig"), "rest")
            members = now.select("doc", "comp").distinct().join(hubs, "doc", "left").select("doc", "comp", F.coalesce("hub", "doc").alias("hub"))
            members = scratch.keep(members, "members")
            # From here on only members count: their sets take the place of all.
            sets = scratch.keep(sets.join(members, "doc"), "held")
            scratch.forget("sets")
            described = scratch.keep(_against_reference(sets, members, scratch), "described")
            scratch.sweep()
            # Each way has its shuffles alone on disk.
            ways = {"by_index": _pairs_by_index(now, described, percent), "by_own": _pairs_by_own(sets, described, percent, scratch)}
            pairs = reduce(DataFrame.unionByName, [scratch.keep(pairs_of(found), way) for way, found in ways.items()]).distinct()
        pairs = scratch.keep(pairs, f"pairs{turn}")
        if pairs.isEmpty():
            scratch.forget(f"pairs{turn}")
            continue
        links = _verified(pairs, sets, percent, scratch, f"links{turn}", most)
        of = lambda side: comps.select(F.col("doc").alias(side), F.col("comp").alias(f"c{side}"))
        joined = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch)
        new = comps.join(joined.withColumnRenamed("id", "comp"), "comp", "left").select("doc", F.coalesce("component", "comp").alias("comp"))
        comps = scratch.keep(new, f"comps{turn + 1}")
        scratch.forget(f"pairs{turn}", *(name for name in scratch.paths if name.startswith(f"links{turn}")))
        scratch.sweep()
    scratch.forget("held", "flagged", "rest", "members", "centres", "described", "across", "by_index", "by_own", "votes")

    group = classes.join(comps.withColumnRenamed("doc", "rep"), "rep", "left").select("class_key", F.coalesce("comp", "rep").alias("component"))
    out = summary.join(group, "class_key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_per_group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id.

    Of several texts with one doc_id, all but the first by digest are nodes of their own, numbered beyond all
    ids, so that each text is kept or dropped for itself. Rows that are equal in both
    are kept or dropped together; rows without doc_id stay.
    """
    scratch = Scratch(docs.sparkSession)
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    light = texts(docs).filter("doc_id IS NOT NULL").select("doc_id", digest.alias("digest")).distinct()
    several = light.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).filter("first < last")
    others = scratch.keep(light.join(several, "doc_id").filter("digest > first").select("doc_id", "digest"), "others")
    beyond = texts(docs).agg(F.coalesce(F.max("doc_id"), F.lit(0)).cast("long")).first()[0]
    id_, digest_, node = (fresh(docs, c) for c in ("id", "digest", "node"))
    own = numbered(others, ["doc_id", "digest"], "n", lambda df: scratch.keep(df, "own")).select(F.col("doc_id").alias(id_), F.col("digest").alias(digest_), (F.col("n") + beyond).alias(node))
    rows = docs.join(own, (docs["doc_id"] == own[id_]) & (digest == own[digest_]), "left").withColumn(node, F.coalesce(node, docs["doc_id"].cast("long")))
    found = jaccard_components(rows.select(F.col(node).alias("doc_id"), "text"), percent).filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("n"), "component_id").distinct()
    # The row that stays has the smallest doc_id, whatever the number of its node.
    found = scratch.keep(found.join(own.select(F.col(id_).alias("of"), F.col(node).alias("n")), "n", "left").select("n", "component_id", F.coalesce("of", "n").alias("of")), "found")
    least = found.groupBy("component_id").agg(F.min(F.struct("of", "n")).alias("least"), F.count("*").alias("size")).filter("size > 1")
    gone = found.join(least, "component_id").filter("n <> least.n").select(F.col("n").alias(lost := fresh(rows, "lost")))
    return rows.join(gone, F.col(node) == F.col(lost), "left_anti").select(*(docs[c] for c in docs.columns))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
