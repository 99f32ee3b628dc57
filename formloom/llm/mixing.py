"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that claim them), so the flow network has a node
per pattern and per source, whatever the number of documents. Tokens flow from patterns to source quotas; using a
pattern's documents a second and third time costs more each time (convex costs), so the flow repeats as little as
the quotas allow. A pattern's flow f is then spread over its documents: every document f // size times, and one more
time for documents in seeded hash order until the rest of f is reached.

Only sums by pattern, and by pattern and hash bin, are shuffled; the plan has one row per pattern and is broadcast, so a
source with most of the documents is read where it lies.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table, word_count

#: Hash bins a pattern's documents are summed over to find the cut; only the cut's own bin is sorted.
BINS = 16_384


def fill(weights: list[int], sizes: list[int], most: int) -> list[Fraction]:
    """Targets that share the sum of sizes by weight, none above most times its size; the excess is reshared."""
    total = sum(sizes)
    fixed: dict[int, Fraction] = {}
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        left, w = total - sum(fixed.values()), sum(weights[k] for k in free)
        share = {k: Fraction(left * weights[k]) / w for k in free}
        over = [k for k in free if share[k] > most * sizes[k]]
        if not over:
            return [fixed.get(k, share.get(k)) for k in range(len(sizes))]
        fixed |= {k: Fraction(most * sizes[k]) for k in over}


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int) -> list[dict[int, int]]:
    """Min-cost flow: for each pattern (its sources, its tokens) the tokens it gives to each source, with at most `most`
    uses, the n-th use of a token costing n.

    All cost lies on the edges into the patterns, so a cheapest augmenting path is one whose first use is the lowest: the
    flow is made largest with first uses alone, then with second ones added, and so on, each time by blocking flows
    (breadth-first levels, then paths along them), which take few rounds whatever the number of patterns."""
    flows: list[dict[int, int]] = [{} for _ in patterns]
    givers: list[set[int]] = [set() for _ in quotas]  # patterns that give to a source
    need = list(quotas)
    spare = [0] * len(patterns)
    for _ in range(most):
        for k, (_, size) in enumerate(patterns):
            spare[k] += size
        while True:
            # levels from the patterns with tokens left, over sources they may give to, to patterns that could give elsewhere
            level_p = {k: 0 for k, (sources, _) in enumerate(patterns) if spare[k] and sources}
            level_s: dict[int, int] = {}
            edge, depth, done = list(level_p), 0, False
            while edge and not done:
                fresh = [s for s in dict.fromkeys(s for k in edge for s in patterns[k][0]) if s not in level_s]
                for s in fresh:
                    level_s[s] = depth
                    done = done or need[s] > 0
                depth += 1
                edge = [k for k in dict.fromkeys(k for s in fresh for k in givers[s]) if k not in level_p]
                for k in edge:
                    level_p[k] = depth
            if not done:
                break
            left = {k: list(patterns[k][0]) for k in level_p}
            back = {s: [k for k in givers[s] if level_p.get(k) == level_s[s] + 1] for s in level_s}
            for root in [k for k in level_p if level_p[k] == 0]:
                while spare[root] and left[root]:
                    path, room = [root], spare[root]  # pattern, source, pattern, source ...
                    while path:
                        k = path[-1]
                        while left[k] and (level_s.get(left[k][-1]) != level_p[k] or not (need[left[k][-1]] or back[left[k][-1]])):
                            left[k].pop()
                        if not left[k]:
                            path = path[:-2]  # a dead end: the source before it can't use this pattern
                            if path:
                                s = left[path[-1]][-1]
                                back[s].pop()
                            continue
                        s = left[k][-1]
                        if need[s]:
                            path.append(s)
                            break
                        if not flows[back[s][-1]].get(s):
                            back[s].pop()
                            continue
                        path += [s, back[s][-1]]
                    if not path:
                        break
                    room = min(room, need[path[-1]], *(flows[path[i + 1]][path[i]] for i in range(1, len(path) - 1, 2)))
                    spare[root] -= room
                    need[path[-1]] -= room
                    for i in range(0, len(path), 2):
                        k, s = path[i], path[i + 1]
                        flows[k][s] = flows[k].get(s, 0) + room
                        givers[s].add(k)
                        if i + 2 < len(path):
                            flows[path[i + 2]][s] -= room
                            if not flows[path[i + 2]][s]:
                                del flows[path[i + 2]][s]
                                givers[s].discard(path[i + 2])
    return flows


_PLAN = "mix_key string, mix_times long, mix_cut long, mix_target double, mix_source_size long"
_NEW = ["mix_size", "mix_target", "mix_source_size", "mix_taken"]


def _keyed(docs: DataFrame, members: Column, size: Column, order: Column, seed: int) -> DataFrame:
    at = F.shiftrightunsigned(F.xxhash64(order, size.cast("long"), F.lit(seed)), 2)
    key = F.to_json(F.array_sort(F.array_distinct(members)), {"ignoreNullFields": "false"})
    own = docs.select(F.struct(*docs.columns).alias("row"), members.alias("m"), key.alias("mix_key"), size.cast("long").alias("mix_size"), at.alias("mix_at"))
    return own.withColumn("mix_size", F.coalesce("mix_size", F.lit(0)))


def plan(docs: DataFrame, members: Column, size: Column, order: Column, weight_of=lambda k: k % 3 + 1, most: int = 3, seed: int = 17, max_patterns: int = 1_000_000) -> DataFrame:
    """One row per membership pattern for take(): how often its documents are taken, up to which hash once more.

    Sources in code-point order, null last, weigh weight_of(position). The patterns (not documents) are gathered at the
    driver, where the flow is; more than max_patterns of them raise a ValueError, as no part of the flow can be left out.
    """
    spark = docs.sparkSession
    work = _keyed(docs, members, size, order, seed)
    sums = work.groupBy("mix_key").agg(F.sum("mix_size").alias("n"), F.first(F.array_sort(F.array_distinct("m"))).alias("m")).filter("mix_key is not null").limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    sums.sort(key=lambda r: r.mix_key)
    names = sorted({s for r in sums for s in r.m}, key=lambda s: (s is None, s or ""))
    place = {s: k for k, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in sums:
        for s in r.m:
            sizes[place[s]] += r.n
    total = sum(r.n for r in sums if r.m)
    weights = [weight_of(k) for k in range(len(names))]
    shared = fill(weights, sizes, most) if sum(sizes) == total else [t * total / sum(sizes) for t in fill(weights, sizes, most)]
    flows = route([(tuple(place[s] for s in r.m), r.n) for r in sums], [round(t) for t in shared], most)
    given = {r.mix_key: sum(f.values()) for r, f in zip(sums, flows)}
    rest = [(r.mix_key, given[r.mix_key] % r.n) for r in sums if r.n and given[r.mix_key] % r.n]
    cuts: dict[str, int] = {}
    if rest:
        wanted = F.broadcast(spark.createDataFrame(rest, "mix_key string, mix_rest long"))  # one row per pattern
        binned = work.join(wanted, "mix_key").withColumn("mix_bin", F.shiftright("mix_at", 62 - (BINS - 1).bit_length()))
        bins = binned.groupBy("mix_key", "mix_bin").agg(F.sum("mix_size").alias("n"), F.first("mix_rest").alias("mix_rest"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("mix_key").orderBy("mix_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        cut = bins.withColumn("before", before).filter((F.col("before") < F.col("mix_rest")) & (F.col("before") + F.col("n") >= F.col("mix_rest")))
        chosen = spark.createDataFrame(cut.select("mix_key", "mix_bin", "before").collect(), "mix_key string, mix_bin long, before long")  # one row per pattern
        inside = binned.join(F.broadcast(chosen), ["mix_key", "mix_bin"]).groupBy("mix_key", "mix_at", "before", "mix_rest").agg(F.sum("mix_size").alias("n"))
        running = F.coalesce(F.sum("n").over(W.partitionBy("mix_key").orderBy("mix_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        last = inside.withColumn("running", running).filter("before + running < mix_rest").groupBy("mix_key").agg(F.max("mix_at").alias("cut"))
        cuts = {r.mix_key: r.cut for r in last.collect()}
    rows = [(r.mix_key, given[r.mix_key] // r.n if r.n else 0, cuts.get(r.mix_key, -1), float(shared[place[r.m[0]]]) if r.m else None, sizes[place[r.m[0]]] if r.m else None) for r in sums]
    return spark.createDataFrame(rows, _PLAN)


def take(docs: DataFrame, planned: DataFrame, members: Column, size: Column, order: Column, seed: int = 17) -> DataFrame:
    """docs with mix_size, mix_target and mix_source_size (of the first source of its pattern) and mix_taken, by a plan()
    of documents with the same members, sizes and orders."""
    work = _keyed(docs.drop(*_NEW), members, size, order, seed)
    placed = work.join(F.broadcast(planned), "mix_key", "left")  # one row per pattern
    times = F.coalesce(F.col("mix_times"), F.lit(0)) + F.coalesce((F.col("mix_at") <= F.col("mix_cut")).cast("int"), F.lit(0))
    return placed.withColumn("mix_taken", F.col("mix_size") * times).select("row.*", *_NEW)


def mix(docs: DataFrame, members: Column, size: Column, order: Column, **how) -> DataFrame:
    """take() by the plan() of the same documents: docs with mix_size, mix_target, mix_source_size and mix_taken.

    members: array of source names, null names allowed; a null or empty array is no source, and nothing is taken. size:
    tokens (null: 0); order: a stable id for the seeded order. Rows of equal order and size are taken alike, so reruns
    agree. Size 0 is never taken; an empty table gives no rows. Other columns pass through whatever their names; input
    columns named as the four new ones are replaced.
    """
    return take(docs, plan(docs, members, size, order, **how), members, size, order, how.get("seed", 17))


def op9_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), "sizes")
    out = mix(sizes, F.array("source"), F.col("words"), F.col("doc_id"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))
