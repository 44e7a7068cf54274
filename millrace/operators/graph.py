"""Call graphs: edges, components in leaf-first order, levels, cycles of functional graphs, one-step transfer."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import cut


def call_edges(nodes: DataFrame, scope: list, node: str, targets: str) -> tuple[DataFrame, DataFrame]:
    """Edges to nodes of the same scope, and calls of nodes that are missing."""
    calls = nodes.select(*scope, F.col(node).alias("src"), F.explode(targets).alias("dst")).distinct()
    marked = calls.join(nodes.select(*scope, F.col(node).alias("dst")).distinct().withColumn("_known", F.lit(True)), [*scope, "dst"], "left")
    return (marked.filter(c).select(*scope, "src", "dst") for c in ("_known", "_known is null"))


def leaf_first(nodes: list, edges: list[tuple]) -> list[list]:
    """Strongly connected components (sorted), callees before callers; of those free at a time the one with the least member."""
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    low, number, stack, on, of, comps = {}, {}, [], set(), {}, []
    for root in sorted(nodes):
        if root in number:
            continue
        number[root] = low[root] = len(number)
        stack.append(root), on.add(root)
        work = [(root, iter(sorted(out[root])))]
        while work:
            v, it = work[-1]
            for w in it:
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append(w), on.add(w)
                    work.append((w, iter(sorted(out[w]))))
                    break
                if w in on:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    comp = []
                    while not comp or comp[-1] != v:
                        comp.append(stack.pop())
                        on.discard(comp[-1])
                        of[comp[-1]] = len(comps)
                    comps.append(sorted(comp))
    waits, callers = [set() for _ in comps], defaultdict(set)
    for a, b in edges:
        if of[a] != of[b]:
            waits[of[a]].add(of[b])
            callers[of[b]].add(of[a])
    left = [len(w) for w in waits]
    free = [(c[0], i) for i, c in enumerate(comps) if not left[i]]
    heapq.heapify(free)
    order = []
    while free:
        _, i = heapq.heappop(free)
        order.append(comps[i])
        for j in callers[i]:
            left[j] -= 1
            if not left[j]:
                heapq.heappush(free, (comps[j][0], j))
    return order


def components(nodes: DataFrame, edges: DataFrame, scope: str, node: str) -> DataFrame:
    """(scope, node, component, component_size, recursive, level): component is the place in leaf-first order, level the
    longest way to a leaf component. A scope is one binary's graph and fits a task."""
    kind = nodes.schema[node].dataType.simpleString()
    scope_kind = nodes.schema[scope].dataType.simpleString()

    def run(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(e["src"], e["dst"], strict=True))
        order, rows, level = leaf_first(n[node].tolist(), pairs), [], {}
        of = {v: i for i, c in enumerate(order) for v in c}
        below = defaultdict(set)
        for a, b in pairs:
            if of[a] != of[b]:
                below[of[a]].add(of[b])
        loops = {a for a, b in pairs if a == b}
        for i, c in enumerate(order):
            level[i] = 1 + max((level[j] for j in below[i]), default=-1)
            rows += [(key[0], v, i, len(c), len(c) > 1 or v in loops, level[i]) for v in c]
        return pd.DataFrame(rows, columns=[scope, node, "component", "component_size", "recursive", "level"])

    schema = f"`{scope}` {scope_kind}, `{node}` {kind}, component long, component_size long, recursive boolean, level long"
    pairs = edges.select(F.col(scope).alias("_scope"), F.col("src").alias("_a"), F.col("dst").alias("_b")).toDF("_scope", "src", "dst")
    return nodes.select(scope, node).distinct().groupBy(scope).cogroup(pairs.groupBy("_scope")).applyInPandas(run, schema)


#: Nodes of a scope that one task takes as they are.
AT_ONCE = 150_000


def levels(nodes: DataFrame, edges: DataFrame, scope: str, node: str) -> DataFrame:
    """(scope, node, level) as components() has them, for scopes of any size: while a scope has more than AT_ONCE nodes, those that
    call nothing left (their level is known) and those that nothing left calls (their level follows last) are taken off. The rest,
    with all cycles, goes to a task for each scope, so memory is bounded by what can not be taken off: rounds that take off less than
    a tenth end this, as long chains and large cycles would take too many."""
    left = cut(nodes.select(scope, node).distinct(), "nodes")
    calls = cut(edges.select(scope, "src", "dst").distinct(), "calls")
    none = left.limit(0).withColumn("level", F.lit(0).cast("long"))
    done, tops = none, []
    count = lambda df: df.groupBy(scope).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    most, total = count(left)
    inner = calls
    while most and most > AT_ONCE:
        ends = lambda c: inner.select(scope, F.col(c).alias(node)).distinct().withColumn(f"_{c}", F.lit(True))  # noqa: B023, E731
        marked = cut(left.join(ends("src"), [scope, node], "left").join(ends("dst"), [scope, node], "left"), "marked")
        low = cut(_above(marked.filter("_src is null").select(scope, node), calls, done, scope, node), "low")
        top = marked.filter("_src is not null and _dst is null").select(scope, node)
        left = marked.filter("_src is not null and _dst is not null").select(scope, node)
        inside = lambda c: left.select(scope, F.col(node).alias(c))  # noqa: B023, E731
        inner = cut(inner.join(inside("src"), [scope, "src"], "left_semi").join(inside("dst"), [scope, "dst"], "left_semi"), "calls")
        done = cut(done.unionByName(low), "done")
        tops.append(top)
        (most, now), before = count(left), total
        total = now or 0
        if total > before * 0.9:
            break
    # Callees of the rest that are done already lift it: each node starts at one above the highest of them.
    base = _above(left, calls, done, scope, node).withColumnRenamed("level", "_base")
    done = done.unionByName(_rest_levels(base, inner, scope, node))
    for top in reversed(tops):
        done = cut(done, "done")
        done = done.unionByName(_above(top, calls, done, scope, node))
    return done


def _above(nodes: DataFrame, calls: DataFrame, done: DataFrame, scope: str, node: str) -> DataFrame:
    """nodes with their level, one above the highest callee that is done, or 0."""
    of = calls.join(done.select(scope, F.col(node).alias("dst"), "level"), [scope, "dst"]).groupBy(scope, F.col("src").alias(node)).agg((F.max("level") + 1).alias("level"))
    return nodes.join(of, [scope, node], "left").select(scope, node, F.coalesce("level", F.lit(0).cast("long")).alias("level"))


def _rest_levels(base: DataFrame, edges: DataFrame, scope: str, node: str) -> DataFrame:
    """(scope, node, level) within a task for each scope; base: (scope, node, _base), the least level of each."""
    kind, scope_kind = (base.schema[c].dataType.simpleString() for c in (node, scope))

    def run(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(e["src"], e["dst"], strict=True))
        order = leaf_first(n[node].tolist(), pairs)
        of = {v: i for i, c in enumerate(order) for v in c}
        least = dict(zip(n[node], n["_base"], strict=True))
        below = defaultdict(set)
        for a, b in pairs:
            if of[a] != of[b]:
                below[of[a]].add(of[b])
        level = []
        for i, c in enumerate(order):
            level.append(max(max(least[v] for v in c), max((level[j] + 1 for j in below[i]), default=0)))
        return pd.DataFrame([(key[0], v, level[i]) for i, c in enumerate(order) for v in c], columns=[scope, node, "level"])

    pairs = edges.select(F.col(scope).alias("_scope"), F.col("src").alias("_a"), F.col("dst").alias("_b")).toDF("_scope", "src", "dst")
    return base.groupBy(scope).cogroup(pairs.groupBy("_scope")).applyInPandas(run, f"`{scope}` {scope_kind}, `{node}` {kind}, level long")


def graph_stats(nodes: DataFrame, scope: str, node: str, targets: str) -> DataFrame:
    """One row: n_nodes, n_edges, n_missing (calls of nodes that are not there), n_leaves (no calls), n_sinks (no known callees),
    n_components, n_recursive. nodes: (scope, node, targets)."""
    known, missing = call_edges(nodes, [scope], node, targets)
    own = nodes.select(scope, node, (F.size(F.array_distinct(targets)) > 0).alias("_calls")).groupBy(scope, node).agg(F.max("_calls").alias("_calls"))
    has = known.select(scope, F.col("src").alias(node)).distinct().withColumn("_has", F.lit(True))
    one = own.join(has, [scope, node], "left").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(~F.col("_calls")).alias("n_leaves"), F.count_if(F.col("_has").isNull()).alias("n_sinks"))
    comps = components(nodes, known, scope, node).agg(F.count_distinct(F.struct(scope, "component")).alias("n_components"), F.count_if("recursive").alias("n_recursive"))
    counts = [t.agg(F.count(F.lit(1)).alias(n)) for t, n in ((known, "n_edges"), (missing, "n_missing"))]
    out = one.withColumn("_k", F.lit(1))
    for t in (*counts, comps):
        out = out.join(t.withColumn("_k", F.lit(1)), "_k")
    return out.select("n_nodes", "n_edges", "n_missing", "n_leaves", "n_sinks", "n_components", "n_recursive")


def on_cycle(edges: DataFrame, rounds: int) -> DataFrame:
    """Nodes on a cycle of a graph in which each node has at most one edge: those still reached by a chain of 2^rounds steps
    from some node lie on cycles. Pointer doubling; rounds = ceil(log2(number of nodes))."""
    hop = edges.select("src", "dst")
    for _ in range(rounds):
        far = hop.select(F.col("src").alias("dst"), F.col("dst").alias("_d"))
        hop = cut(hop.join(far, "dst").select("src", F.col("_d").alias("dst")), "hops")
    return hop.select(F.col("dst").alias("node")).distinct()


def one_step_transfer(rows: DataFrame, key: str, callee: str, value: str, is_wrapper: str, cyclic: DataFrame) -> DataFrame:
    """A wrapper takes its callee's value where that exists, is not empty, and neither lies on a cycle; `how` says why not."""
    of = rows.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    out = rows.join(of, F.col(callee) == F.col("_k"), "left").join(cyclic.select(F.col("node").alias(key)).withColumn("_c", F.lit(True)), key, "left")
    how = (
        F.when(~F.col(is_wrapper), "own").when(F.col("_c"), "cycle").when(F.col(callee).isNull() | F.col("_k").isNull(), "unresolved")
        .when(F.coalesce(F.col("_v"), F.lit("")) == "", "invalid").otherwise("moved")
    )
    return out.withColumn("how", how).withColumn(value, F.when(F.col("how") == "moved", F.col("_v")).otherwise(F.col(value))).drop("_k", "_v", "_c")


def propagate(levels: DataFrame, edges: DataFrame, predict, node: str) -> DataFrame:
    """Names flow from callees to callers a level at a time; a component's members commit together.

    predict(rows with `known`: a map of callee to name) returns rows with `name`; there are as many rounds as levels. Each round
    is written and reads what the callees of its own rows have got, so plans stay as short at the last level as at the first."""
    levels = cut(levels, "levels")
    top = levels.agg(F.max("level")).first()[0]
    empty = F.create_map().cast("map<string,string>")
    if top is None:
        return predict(levels.withColumn("known", empty))
    calls = cut(edges.select("src", "dst").join(levels.select(F.col(node).alias("src"), F.col("level").alias("_at")), "src"), "calls")
    rounds: list[DataFrame] = []
    for level in range(top + 1):
        now, known = levels.filter(F.col("level") == level), None
        if rounds:
            done = rounds[0].sparkSession.read.schema(rounds[0].schema).parquet(*[r._cut_path for r in rounds])
            below = calls.filter(F.col("_at") == level).join(done.select(F.col(node).alias("dst"), "name"), "dst")
            known = below.groupBy(F.col("src").alias(node)).agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct(F.col("dst").cast("string"), "name")))).alias("known"))
        rows = now.join(known, node, "left").withColumn("known", F.coalesce("known", empty)) if known is not None else now.withColumn("known", empty)
        rounds.append(cut(predict(rows), "names"))
    return rounds[0].sparkSession.read.schema(rounds[0].schema).parquet(*[r._cut_path for r in rounds])
