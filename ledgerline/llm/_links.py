"""Connected components and lossless linking inside candidate buckets.

DataFrame operations only. A bucket is a set of ids that share a signature
band; ids of one bucket are candidates. Comparing all pairs of a bucket would
square a large group of near copies, so pairs inside a component that is
already connected are never compared: they cannot change the result. What is left of a group is
joined on the elements that its sets do not share with their centre.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import drop, save, scratch

#: Rounds of one comparison per member and bucket before all pairs that still
#: lie in different components are compared; and at most, as long as a round still
#: links a fortieth as many pairs as ids are left, and at least WORTH (a round costs some small jobs).
STAR_ROUNDS, MOST_ROUNDS, WORTH = 2, 6, 100


def _same(left: str, right: str):
    """Null-safe key comparison. The join then has exchanges of its own instead of
    reusing the partitioning of an aggregation below it, so AQE can split a key
    that holds a large share of the rows."""
    return F.col(left).eqNullSafe(F.col(right))


def components(edges: DataFrame, a="a", b="b") -> DataFrame:
    """(id, component): the smallest reachable id, for every id in ``edges``.

    Alternating large-star and small-star rounds, written to the shared work
    root; the edge set shrinks towards a star per component. A node's
    neighbours are never gathered: each round joins edges with the smallest
    neighbour of each node, found by a partial aggregation.
    """
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    while True:
        # large star: every larger neighbour of a node points to the node's smallest neighbour (or itself)
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.col("x")).alias("m"))
        large = both.where("v > u").join(low, _same("u", "x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = save(large.where("u <> v").distinct(), "large")
        # small star: a node and its smaller neighbours point to the smallest of them
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        before = cur
        moved = large.join(low, _same("u", "x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        cur = save(moved.unionAll(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        # stars: every node has one edge, and none of them leads to a node that has one itself
        ends = cur.select(F.col("u").alias("id"), F.lit(1).alias("out")).unionAll(
            cur.select(F.col("v").alias("id"), F.lit(0).alias("out")))
        open_ends = ends.groupBy("id").agg(F.sum("out").alias("n"), F.min("out").alias("goal")).where("n > 1 or (n = 1 and goal = 0)")
        if open_ends.isEmpty():
            break
    found = cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    found.saved_at = vars(cur)["saved_at"]
    return found


def _clusters(live: DataFrame) -> DataFrame:
    """(id, cluster): ids that are connected by shared buckets; cluster is the smallest of them."""
    first = live.groupBy("bucket").agg(F.min("id").alias("lo"))
    edges = live.select("bucket", "id").join(first.withColumnRenamed("bucket", "y"), _same("bucket", "y"))
    found = components(edges.select(F.col("id").alias("a"), F.col("lo").alias("b")))
    return save(found.withColumnRenamed("component", "cluster"), "clusters")


def _remaining(live: DataFrame, items: Callable[[DataFrame], DataFrame], ratio: float) -> DataFrame:
    """Pairs (a, b) of ids in different components that may still be linked: all
    linked pairs of a cluster that no earlier comparison joined are among them.

    Let C be the set of the cluster's centre and D(a) the symmetric difference of a
    and C. Two sets reach the similarity s iff |D(a) ^ D(b)| <= t (|a| + |b|), t = (1 - s) / (1 + s), so
    they must share at least ``(e(a) + e(b)) / 2`` elements of their differences, e(a) = |D(a)| - t |a|.
    Sets that reach s with the centre are joined through it; any other has e > t |C|.
    So a pair that is not joined has a member of the latter kind, and, the elements of every
    difference lined up from rare to frequent, shares one among the first few of the other. In a large group of near copies the
    rare ones are what each copy has for itself, so hardly any pair is left, whereas the
    copies share nearly all buckets.
    """
    t = (1 - ratio) / (1 + ratio)
    clusters = _clusters(live)
    members = live.groupBy("id").agg(F.first("component").alias("component"))
    sets = items(members.select("id"))                                   # (id, items)
    sets = save(sets.join(clusters.withColumnRenamed("id", "x"), _same("id", "x")).drop("x")
                .join(members.withColumnRenamed("id", "x"), _same("id", "x")).drop("x"), "sets")
    centres = sets.where("id = cluster").groupBy(F.col("cluster").alias("y")).agg(F.first("items").alias("centre"))
    apart = F.array_union(F.array_except("items", "centre"), F.array_except("centre", "items"))
    differing = save(sets.join(centres, _same("cluster", "y")).select(
        "cluster", "id", "component", apart.alias("apart"), F.size("items").alias("n"), F.size("centre").alias("c"))
        .withColumn("d", F.size("apart")).withColumn("e", F.col("d") - F.lit(t) * F.col("n"))
        .withColumn("direct", F.col("e") <= F.lit(t) * F.col("c") + 1e-9), "differing")
    places = differing.select("cluster", "id", F.explode("apart").alias("x"))
    counted = places.groupBy(F.col("cluster").alias("k"), F.col("x").alias("z")).agg(F.count(F.lit(1)).alias("often"))
    lined = (places.join(counted, _same("cluster", "k") & _same("x", "z")).groupBy("id")
             .agg(F.sort_array(F.collect_list(F.struct("often", "x"))).alias("line")))
    few = F.floor(F.col("d") - (F.col("e") + F.lit(t) * F.col("c")) / 2 + 1e-6) + 1
    ranked = save(differing.drop("apart").join(lined.withColumnRenamed("id", "y"), _same("id", "y"))
                  .select("*", few.alias("few"), F.posexplode("line").alias("at", "o"))
                  .select("cluster", "id", "component", "direct", "d", "e", "at", (F.col("at") < F.col("few")).alias("early"),
                          F.col("o.x").alias("x")), "ranked")
    one, other = ranked.where("early").alias("l"), ranked.where("not direct").alias("r")
    need = (F.col("l.e") + F.col("r.e")) / 2 - 1e-6
    shared = one.join(other, (F.col("l.cluster") == F.col("r.cluster")) & (F.col("l.x") == F.col("r.x"))
                      & (F.col("l.component") != F.col("r.component"))
                      & (F.col("l.direct") | (F.col("r.early") & (F.col("l.id") < F.col("r.id"))))
                      & (F.col("l.at") + need <= F.col("l.d")) & (F.col("r.at") + need <= F.col("r.d")))
    met = shared.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))
    # one that reaches the similarity with the centre but met it in no bucket
    homes = differing.where("id = cluster").select(F.col("id").alias("y"), F.col("component").alias("home"))
    late = (differing.where("direct and id <> cluster").join(homes, _same("cluster", "y")).where("component <> home")
            .select(F.col("cluster").alias("a"), F.col("id").alias("b")))
    return met.unionAll(late).distinct()


def _rare_pairs(live: DataFrame, items: Callable[[DataFrame], DataFrame], ratio: float, fits=None) -> DataFrame:
    """Pairs (a, b) of ids in different components that may still be linked: all
    linked pairs (that ``fits`` lets pass) are among them.

    The elements of every set are lined up from rare to frequent. Sets with |a| <= |b| that reach the
    similarity s share at least ``s / (1 + s) (|a| + |b|)`` elements, so the first one that they share comes
    before a share ``(1 - s) / (1 + s)`` of a and before a share ``1 - s`` of b. Sets of a large group that
    only have the group's common elements in common meet in none of these.
    """
    own = ["component"] if fits is None else ["component", "size", "sketch"]
    members = live.groupBy("id").agg(*[F.first(c).alias(c) for c in own])
    sets = items(members.select("id")).withColumn("n", F.size("items"))
    sets = save(sets.join(members.withColumnRenamed("id", "x"), _same("id", "x")).drop("x"), "sets")
    places = sets.select("id", F.explode("items").alias("x"))
    counted = places.groupBy(F.col("x").alias("z")).agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    lined = (places.join(counted, _same("x", "z")).groupBy(F.col("id").alias("y"))
             .agg(F.sort_array(F.collect_list(F.struct("often", "x"))).alias("line")))
    # elements of one set only come first; they meet nothing and are not listed
    alone = F.col("n") - F.size("line")
    early = F.floor((1 - ratio) * F.col("n") + 1e-6).cast("int") + 1
    ranked = save(sets.drop("items").join(lined, _same("id", "y"))
                  .select("id", *own, "n", alone.alias("alone"), F.posexplode(F.slice("line", 1, F.greatest(early - alone, F.lit(0)))).alias("at", "o"))
                  .select("id", *own, "n", (F.col("alone") + F.col("at")).alias("rank"), F.col("o.x").alias("x")), "ranked")
    small = ranked.where(F.col("rank") <= (1 - ratio) / (1 + ratio) * F.col("n") + 1e-6).withColumnsRenamed({c: f"a_{c}" for c in own[1:]}).alias("l")
    large = ranked.withColumnsRenamed({c: f"b_{c}" for c in own[1:]}).alias("r")
    need = ratio / (1 + ratio) * (F.col("l.n") + F.col("r.n")) - 1e-6
    met = small.join(large, (F.col("l.x") == F.col("r.x")) & (F.col("l.component") != F.col("r.component"))
                     & ((F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.id") < F.col("r.id"))))
                     & (F.col("l.n") - F.col("l.rank") >= need) & (F.col("r.n") - F.col("r.rank") >= need)
                     & (F.lit(True) if fits is None else fits))
    return met.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()


def _by_bucket_size(live: DataFrame, items: Callable[[DataFrame], DataFrame], ratio: float, fits, many: int) -> DataFrame:
    """All pairs of buckets of at most ``many`` ids, ``_rare_pairs`` of all other ids."""
    sizes = live.groupBy(F.col("bucket").alias("y")).agg(F.count(F.lit(1)).alias("k"))
    sized = save(live.join(sizes, _same("bucket", "y")).drop("y"), "sized")
    pairs = _all_pairs(sized.where(F.col("k") <= many).drop("k"), fits)
    return pairs.unionAll(_rare_pairs(sized.where(F.col("k") > many), items, ratio, fits)).distinct()


def _bits_apart(one: str, other: str):
    """Number of bits in which two sketches differ."""
    bits = F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda s, x: s + x)


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], ratio: float, far: int | None = None,
         items: Callable[[DataFrame], DataFrame] | None = None, apart: Callable = _bits_apart, many: int | None = None) -> DataFrame:
    """(id, component) of every linked id.

    ``members``: (bucket, id, size), a written table of distinct rows; without sizes all count as equal.
    ``verify`` returns the linked ones of a table of pairs (a, b), a < b.
    Pairs whose sizes differ by more than ``ratio`` (smaller / larger) cannot
    be linked, nor, where ``members`` has a ``sketch`` (array of longs) and
    ``far`` is given, pairs whose sketches differ in more bits (or more of what ``apart`` counts). First every member is compared with one member of its bucket,
    in STAR_ROUNDS rounds (up to MOST_ROUNDS) with other centres; then the pairs without a centre that lie in
    different components. No pair is verified twice. With ``items`` (ids -> (id, items), the hashed elements of the sets whose
    Jaccard similarity ``ratio`` is) these are the few of ``_remaining``, or with ``many`` those of ``_by_bucket_size``, else
    all pairs of a bucket, each in the first bucket that they share. Any of them joins every linked pair of a bucket.
    """
    fits = F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * F.lit(ratio)
    if "size" not in members.columns:
        members = members.withColumn("size", F.lit(1))
    if far is None:
        members = members.withColumn("sketch", F.array().cast("array<bigint>"))
    else:
        fits = fits & (apart("a_sketch", "b_sketch") <= far)
    live = members.withColumn("component", F.col("id"))
    edges = tried = None
    rounds = STAR_ROUNDS
    for turn in range(MOST_ROUNDS + 1):
        with scratch(members.sparkSession) as keep:
            if turn < rounds:
                rest = keep(_beside_centres(live, turn, fits))
                pairs = rest.where("near").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
            elif items is not None and many is not None:
                pairs = _by_bucket_size(live, items, ratio, fits, many)
            elif items is not None:
                pairs = _remaining(live, items, ratio)
            else:
                pairs = _all_pairs(live, fits)
            # what was verified under another bucket is known
            pairs = keep(save(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs"))
        drop(live)
        tried = pairs if tried is None else tried.unionAll(pairs)
        linked = save(verify(pairs), "linked")
        edges = linked if edges is None else edges.unionAll(linked)
        found = components(edges)
        if turn == rounds:
            break
        # a centre has been compared with its whole bucket: the bucket goes on without it,
        # if members of different components are left in it
        named = rest.where("left > 1").join(found.withColumnRenamed("id", "x"), _same("id", "x"), "left").select(
            "bucket", "id", "size", "sketch", F.coalesce(found["component"], "id").alias("component"))
        several = named.groupBy(F.col("bucket").alias("y")).agg(
            F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("y")
        live = save(named.join(several, _same("bucket", "y")).drop("y"), "live")
        drop(rest)
        if live.isEmpty():
            break
        drop(found)
        # copies of a large group that are linked by chance: another centre joins many more of them at once
        if turn + 1 == rounds < MOST_ROUNDS and linked.count() >= max(WORTH, live.select("id").distinct().count() / 40):
            rounds += 1
    return found


def _beside_centres(live: DataFrame, turn: int, fits) -> DataFrame:
    """Every member of a bucket but its centre, another one each turn, with the centre, whether the two
    are to be verified (``near``), and how many such members the bucket has (``left``)."""
    rank = F.struct(F.col("id")) if turn == 0 else F.struct(F.xxhash64("bucket", "id", F.lit(turn)), F.col("id"))
    centre = live.groupBy("bucket").agg(F.min(F.struct(rank.alias("r"), "id", "size", "component", "sketch")).alias("c"),
                                        (F.count(F.lit(1)) - 1).alias("left"))
    centre = centre.select(F.col("bucket").alias("c_bucket"), F.col("c.id").alias("centre"), "left",
                           F.col("c.size").alias("a_size"), F.col("c.component").alias("c_component"),
                           F.col("c.sketch").alias("a_sketch"))
    met = (live.withColumns({"b_size": F.col("size"), "b_sketch": F.col("sketch")})
           .join(centre, _same("bucket", "c_bucket") & (F.col("id") != F.col("centre"))))
    near = (F.col("component") != F.col("c_component")) & fits
    return save(met.select("bucket", "id", "size", "sketch", "centre", "left", near.alias("near")), "rest")


def _all_pairs(live: DataFrame, fits) -> DataFrame:
    """All pairs of a bucket that lie in different components."""
    buckets = live.groupBy(F.col("id").alias("x")).agg(F.collect_set("bucket").alias("buckets"))
    rich = save(live.join(buckets, _same("id", "x")).drop("x"), "live")
    left, right = (rich.select("bucket", F.col("id").alias(k), F.col("size").alias(f"{k}_size"),
                               F.col("component").alias(f"{k}_component"), F.col("buckets").alias(f"{k}_buckets"),
                               F.col("sketch").alias(f"{k}_sketch")) for k in "ab")
    first = F.array_min(F.array_intersect("a_buckets", "b_buckets"))
    return left.join(right, (left["bucket"] == right["bucket"]) & (F.col("a") < F.col("b"))
                     & (F.col("a_component") != F.col("b_component")) & fits
                     & (first == left["bucket"])).select("a", "b").distinct()
