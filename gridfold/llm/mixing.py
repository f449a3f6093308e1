"""Mixing sources to target weights as a min-cost flow.

Documents may belong to several sources. They are first added up by membership pattern (the set of a document's sources),
so the flow network has a node per pattern and source, not per document: root -> pattern (one arc per copy, each of the
pattern's size, its cost rising with the copy: convex repetition costs) -> each of the pattern's sources -> sink (the
source's quota). Shortest paths, by rounds of equal cost, route as many tokens as the quotas ask for at the least repetition. A pattern's
flow then becomes documents: each is taken as often as whole copies of the pattern fit, and the rest goes to the documents
that come first in a seeded order, the last of them in part, so a source's taken words equal its quota.

Selection needs no sort of a pattern: the seeded order's first 12 bits cut it into buckets, whose sizes are summed per
bucket; documents before the bucket in which the rest runs out are taken whole, and only that one bucket (a 4096th of the
pattern) is ordered. Where it is still hot, the next 12 bits cut it again.

Patterns of one source that no other pattern shares need no network: they give what their source's quota asks for. The rest is
routed per group of sources that patterns connect.

Null text has size 0. A null source is a source of its own and comes last. Documents of size 0 are never taken. Ties of
the seeded order go to the smaller doc_id, then size, then the text's hash; a row without doc_id has the order of its text.
Repeated rows count each and share their order's place. Empty tables give no rows. Sources and patterns are collected to the
driver: at most MOST_PATTERNS rows, which is checked; beyond, this raises.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.llm._common import materialise, n_words, shared_dir

COPIES, SEED, MOST_PATTERNS = 3, 17, 1_000_000
WEIGHTS = (5.0, 2.0, 1.0)


def share_targets(sizes: list[float], weights: list[float], total: float, copies: float = COPIES) -> list[float]:
    """Targets in proportion to the weights that add up to total; each at most copies times its size, the excess shared anew."""
    out, rest, free = [0.0] * len(sizes), total, set(range(len(sizes)))
    while free:
        unit = rest / sum(weights[k] for k in free)
        full = {k for k in free if weights[k] * unit > copies * sizes[k]}
        if not full:
            for k in free:
                out[k] = weights[k] * unit
            break
        for k in full:
            out[k] = copies * sizes[k]
            rest -= out[k]
        free -= full
    return out


def route(patterns: list[tuple[frozenset[int], int]], quotas: list[int], copies: int = COPIES) -> list[int]:
    """Min-cost flow: tokens taken from each (sources, size) pattern, given the sources' quotas.

    Costs lie on the arcs from the root alone, rise with the copy and are the same for all patterns; a path that augments
    leaves the root once, so its cost is that of the copy it starts with. Shortest paths first therefore means: all paths
    of first copies, then those of second ones, and so on. Each of these rounds is a maximum flow by layers (Dinic's): as
    many paths as the layers hold per search.
    """
    own = [sorted(sources) for sources, _ in patterns]
    sent: list[dict[int, int]] = [{} for _ in patterns]  # pattern -> source -> tokens
    holders: list[set[int]] = [set() for _ in quotas]  # source -> patterns that send to it
    left, spare = list(quotas), [0] * len(patterns)

    def layers() -> tuple[dict[int, int], dict[int, int]] | None:
        """Distances of patterns and sources from the patterns with room, up to the first source with quota left; None without any."""
        front = [k for k, n in enumerate(spare) if n > 0]
        of_pattern, of_source, d = dict.fromkeys(front, 0), {}, 0
        while front:
            reached = []
            for k in front:
                for s in own[k]:
                    if s not in of_source:
                        of_source[s] = d + 1
                        reached.append(s)
            if any(left[s] > 0 for s in reached):
                return of_pattern, of_source
            d, front = d + 2, []
            for s in reached:
                for k in sorted(holders[s]):
                    if k not in of_pattern:
                        of_pattern[k] = d
                        front.append(k)
        return None

    def push(path: list[int]) -> None:
        """Sends as much as a path of pattern, source, pattern, source ... lets through."""
        back = [(path[i + 1], path[i]) for i in range(1, len(path) - 1, 2)]
        n = min([spare[path[0]], left[path[-1]], *[sent[k][s] for k, s in back]])
        spare[path[0]] -= n
        left[path[-1]] -= n
        for i in range(0, len(path), 2):
            k, s = path[i], path[i + 1]
            sent[k][s] = sent[k].get(s, 0) + n
            holders[s].add(k)
        for k, s in back:
            sent[k][s] -= n
            if not sent[k][s]:
                holders[s].discard(k)

    for _ in range(copies):
        for k, (_, size) in enumerate(patterns):
            spare[k] += size
        while found := layers():
            of_pattern, of_source = found
            at_pattern, at_source, giving = defaultdict(int), defaultdict(int), {}
            for start in [k for k, n in enumerate(spare) if n > 0]:
                path = [start]
                while path and spare[start] > 0:
                    x = path[-1]
                    if len(path) % 2:
                        arcs, at, ok = own[x], at_pattern, lambda s, x=x: of_source.get(s) == of_pattern[x] + 1
                    elif left[x] > 0:
                        push(path)
                        path = [start]
                        continue
                    else:
                        if x not in giving:
                            giving[x] = sorted(holders[x])
                        arcs, at = giving[x], at_source
                        ok = lambda k, x=x: of_pattern.get(k) == of_source[x] + 1 and sent[k].get(x, 0) > 0
                    while at[x] < len(arcs) and not ok(arcs[at[x]]):
                        at[x] += 1
                    if at[x] < len(arcs):
                        path.append(arcs[at[x]])
                    else:  # a dead end: the arc that led here is done
                        path.pop()
                        if path:
                            (at_pattern if len(path) % 2 else at_source)[path[-1]] += 1
    return [sum(by.values()) for by in sent]


def shared_out(patterns: list[tuple[frozenset[int], int]], quotas: list[int], copies: int = COPIES) -> list[int]:
    """route(), by connected groups of sources; a source with one pattern of its own needs no search."""
    root = list(range(len(quotas)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for sources, _ in patterns:
        if not sources:
            continue  # documents of no source are never taken
        first, *others = sources
        for s in others:
            root[find(s)] = find(first)
    groups = defaultdict(list)
    for k, (sources, _) in enumerate(patterns):
        if sources:
            groups[find(next(iter(sources)))].append(k)
    taken = [0] * len(patterns)
    for own in groups.values():
        if len(own) == 1 and len(patterns[own[0]][0]) == 1:
            (s,), size = patterns[own[0]]
            taken[own[0]] = min(quotas[s], copies * size)
            continue
        sources = sorted({s for k in own for s in patterns[k][0]})
        number = {s: k for k, s in enumerate(sources)}
        for k, n in zip(own, route([(frozenset(number[s] for s in patterns[k][0]), patterns[k][1]) for k in own], [quotas[s] for s in sources], copies), strict=True):
            taken[k] = n
    return taken


def _order(doc_id: Column, text: Column, seed: int) -> Column:
    """The seeded order: an md5 in hex, which any SQL engine computes alike."""
    by_text = F.concat(F.lit("#"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), by_text)).cast("binary"))


def mix(docs: DataFrame, members: Column, *, size: Column | None = None, weight_of=None, total: float | None = None, copies: int = COPIES, seed: int = SEED) -> tuple[DataFrame, dict]:
    """One row per document: doc_id, size, sources, taken (words, repeats counted); and each source's size and target.

    docs needs doc_id and text. members is an array<string> column: the document's sources. weight_of(names) gives the weights of the sources, which come
    sorted by code point with null last; total is the number of words of the mix, 100 % of all sizes unless given.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "mixing")
    size = n_words(F.col("text")) if size is None else size
    text = F.col("text")
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("size"), F.coalesce(F.array_distinct(members), F.array().cast("array<string>")).alias("sources"), _order(F.col("doc_id").cast("long"), text, seed).alias("order"), F.xxhash64(text).alias("tie"))
    light = materialise(light, f"{folder}/sizes")
    found = light.groupBy("sources").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    names = sorted({s for r in found for s in r.sources}, key=lambda s: (s is None, (s or "").encode()))
    number = {s: k for k, s in enumerate(names)}
    patterns = [(frozenset(number[s] for s in r.sources), int(r.size)) for r in found]
    sizes = [sum(n for p, n in patterns if k in p) for k in range(len(names))]
    weights = weight_of(names) if weight_of else [WEIGHTS[k % len(WEIGHTS)] for k in range(len(names))]
    targets = share_targets(sizes, weights, sum(n for _, n in patterns) if total is None else total, copies)
    taken = shared_out(patterns, [round(t) for t in targets], copies)
    plan = [(r.sources, int(r.size), n // int(r.size) if r.size else 0, n % int(r.size) if r.size else 0) for r, n in zip(found, taken, strict=True)]
    routed = spark.createDataFrame(plan, "sources array<string>, pattern_size long, whole long, rest long")
    key = F.to_json(F.struct("sources"))
    routed = routed.select(key.alias("routed_key"), "whole", "rest")
    rows = light.withColumn("key", key).join(F.broadcast(routed), F.col("key") == F.col("routed_key")).select("doc_id", "size", "sources", "order", "tie", "whole", "rest", "key")
    out = _take(rows, folder)
    out = out.select("doc_id", "size", "sources", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))
    return out, dict(zip(names, zip(sizes, targets, strict=True), strict=True))


def _take(rows: DataFrame, folder: str) -> DataFrame:
    """Adds part: the words taken of a document beyond whole copies, in the seeded order until the rest of its pattern runs out."""
    cut = rows.withColumns({"b1": F.substring("order", 1, 3), "b2": F.substring("order", 4, 3)})
    sums = materialise(cut.filter("rest > 0").groupBy("key", "rest", "b1", "b2").agg(F.sum("size").alias("n")), f"{folder}/buckets")
    one = sums.groupBy("key", "rest", "b1").agg(F.sum("n").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("key").orderBy("b1").rowsBetween(Window.unboundedPreceding, -1))
    edge = one.withColumn("before", F.coalesce(ahead, F.lit(0))).filter("before < rest AND before + n >= rest").select(F.col("key").alias("k"), F.col("b1").alias("e1"), "before")
    two = sums.join(F.broadcast(edge), (F.col("key") == F.col("k")) & (F.col("b1") == F.col("e1"))).select("key", "rest", "b1", "b2", "n", "before")
    ahead2 = F.col("before") + F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("b2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = two.withColumn("before2", ahead2).filter("before2 < rest AND before2 + n >= rest").select(F.col("key").alias("k"), F.col("b1").alias("e1"), F.col("b2").alias("e2"), "before2")
    marked = cut.join(F.broadcast(edges), F.col("key") == F.col("k"), "left")
    place, last = F.concat("b1", "b2"), F.concat("e1", "e2")
    whole = marked.filter(F.col("k").isNull() | (place != last)).withColumn("part", F.when((F.col("rest") > 0) & (place < last), F.col("size")).otherwise(0))
    before = F.col("before2") + F.coalesce(F.sum("size").over(Window.partitionBy("key").orderBy("order", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    partly = marked.filter(place == last).withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - before)))
    return whole.unionByName(partly)
