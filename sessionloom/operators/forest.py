"""Parent-child links to full hierarchies: path, depth, root, descendants and cycles.

Connected components are the unit of work. Links never leave their scope (a session), so scopes of up to
``max_group`` rows hold whole components and are co-located by one shuffle; inside, a component is named
by its root or its ring, since a node has one link at most. Larger scopes are cut into their components
by alternating-star contraction, and each component is co-located by its number. A co-located group is
walked depth-first with node colouring in memory linear in its rows; paths and descendants are slices
of the walk's stack and order and leave it in bounded frames. Components above ``max_component`` rows never
meet in one task: their links are squared by pointer doubling, and their walk is numbered by ranking the
list of down and up steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize, release
from .components import components

MAX_GROUP = 200_000
MAX_COMPONENT = 1_000_000
#: Ids of paths and descendants that leave a walk in one frame; a single longer row still is one row.
FRAME_IDS = 500_000
NESTED = "node long, parent long, root long, depth int, enter long, leave long, cycle long, on_cycle boolean"
HIERARCHY = "node long, root long, depth int, cycle long, on_cycle boolean, path array<long>, descendants array<long>"


def whole_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Regroup a key-sorted stream of frames so that no key is cut; many small groups share a frame."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        last = frame[key].iloc[-1]
        cut = int(frame[key].searchsorted(last, side="left")) if frame[key].iloc[0] != last else 0
        if cut:
            yield pd.concat([*held, frame.iloc[:cut]], ignore_index=True) if held else frame.iloc[:cut].reset_index(drop=True)
            held = [frame.iloc[cut:]]
        elif held and held[-1][key].iloc[-1] != last:
            yield pd.concat(held, ignore_index=True)
            held = [frame]
        else:
            held.append(frame)
    if held:
        yield pd.concat(held, ignore_index=True)


def parents_of(frame: pd.DataFrame) -> np.ndarray:
    """Row position of each row's link target within its scope, -1 for none."""
    scope = frame["scope"].to_numpy(dtype=object)
    ids = pd.MultiIndex.from_arrays([scope, frame["node_id"].to_numpy(dtype=object)])
    usable = frame["node_id"].notna().to_numpy()
    rows = np.flatnonzero(usable)
    order = rows[np.argsort(frame["node"].to_numpy()[rows], kind="stable")]
    own = pd.Series(order, index=ids[order])
    own = own[~own.index.duplicated()]
    wanted = pd.MultiIndex.from_arrays([scope, frame["link_id"].to_numpy(dtype=object)])
    at = own.index.get_indexer(wanted)
    found = np.where(at >= 0, own.to_numpy()[np.maximum(at, 0)] if len(own) else -1, -1)
    return np.where(frame["link_id"].notna().to_numpy(), found, -1)


def walk(node: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Depth-first walk over parent edges with node colouring.

    Returns root position (-1 on or into a cycle), depth, cycle key (-1 for none) and whether the
    row lies on its cycle. A grey node met again closes a back edge.
    """
    n = len(node)
    colour = np.zeros(n, np.int8)
    root, depth = np.full(n, -1), np.zeros(n, np.int64)
    cycle, on = np.full(n, -1), np.zeros(n, bool)
    up = parent.tolist()
    for start in range(n):
        if colour[start]:
            continue
        trail, at = [], start
        while at >= 0 and colour[at] == 0:
            colour[at] = 1
            trail.append(at)
            at = up[at]
        if at >= 0 and colour[at] == 1:
            ring = trail[trail.index(at):]
            low = min(node[i] for i in ring)
            for i in ring:
                cycle[i], on[i], colour[i] = low, True, 2
            trail = trail[: len(trail) - len(ring)]
        for i in reversed(trail):
            above = up[i]
            if above < 0:
                root[i] = i
            else:
                root[i], depth[i], cycle[i] = root[above], depth[above] + 1, cycle[above]
            colour[i] = 2
    return root, depth, cycle, on


def preorder(node: np.ndarray, parent: np.ndarray, cycle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Iterative depth-first walk down from the roots: (row positions in walk order, rows below each).

    Trees come one after the other; roots and siblings are met by rising node. Rows on or before a cycle are
    never reached and left out.
    """
    by_parent = np.lexsort((node, parent))
    below = np.searchsorted(parent[by_parent], np.arange(-1, len(node) + 1))  # children of p lie from below[p + 1] to below[p + 2]
    children, order, size = by_parent.tolist(), [], [0] * len(node)
    first, up = below.tolist(), parent.tolist()
    open_rows = [i for i in children[first[0]:first[1]] if cycle[i] < 0][::-1]
    while open_rows:
        at = open_rows.pop()
        order.append(at)
        open_rows.extend(reversed(children[first[at + 1]:first[at + 2]]))
    for at in reversed(order):
        if up[at] >= 0:
            size[up[at]] += size[at] + 1
    return np.array(order, np.int64), np.array(size, np.int64)


def _optional(values: np.ndarray, missing: np.ndarray, kind: str = "Int64"):
    return pd.arrays.IntegerArray(np.where(missing, 0, values).astype(kind.lower()), missing.copy())


def _nested(node: np.ndarray, parent: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The linear form of one co-located group, its walk order and the rows below each row."""
    root, depth, cycle, on = walk(node, parent)
    order, size = preorder(node, parent, cycle)
    at = np.zeros(len(node), np.int64)
    at[order] = np.arange(len(order))
    bad = cycle >= 0
    enter = at - at[np.where(bad, 0, root)]
    return pd.DataFrame({
        "node": node, "parent": _optional(node[np.maximum(parent, 0)], parent < 0), "root": _optional(node[np.maximum(root, 0)], bad),
        "depth": _optional(depth, bad, "Int32"), "enter": _optional(enter, bad), "leave": _optional(enter + size, bad), "cycle": _optional(cycle, ~bad), "on_cycle": on,
    }), order, size


def _spread(node: np.ndarray, parent: np.ndarray) -> Iterator[pd.DataFrame]:
    """Full rows of one co-located group, ``FRAME_IDS`` ids of arrays at a time."""
    flat, order, size = _nested(node, parent)
    base = flat[["node", "root", "depth", "cycle", "on_cycle"]]
    walked, depth = node[order], flat["depth"].to_numpy(np.int64, na_value=0)
    trail = np.zeros(int(depth.max(initial=0)) + 1, np.int64)
    held, paths, below, ids = [], [], [], 0
    for k, at in enumerate(order.tolist()):
        trail[depth[at]] = node[at]
        held.append(at)
        paths.append(trail[: depth[at] + 1].copy())
        below.append(np.sort(walked[k + 1:k + 1 + size[at]]))
        ids += len(paths[-1]) + len(below[-1])
        if ids >= FRAME_IDS:
            yield base.iloc[held].assign(path=paths, descendants=below)
            held, paths, below, ids = [], [], [], 0
    if held:
        yield base.iloc[held].assign(path=paths, descendants=below)
    ring = base[flat["cycle"].notna().to_numpy()]
    if len(ring):
        yield ring.assign(path=None, descendants=None)


def _by_scope(each):
    """Frames function over whole scopes: links are resolved inside, then ``each(node, parent)`` gives the rows."""
    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in whole_groups(batches, "scope"):
            yield from each(g["node"].to_numpy(), parents_of(g))
    return frames


def _by_component(each):
    """The same over whole components of (component, node, parent) rows with resolved parents."""
    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in whole_groups(batches, "component"):
            node, up = g["node"].to_numpy(), g["parent"]
            order = np.argsort(node)
            at = np.minimum(np.searchsorted(node[order], up.fillna(0).to_numpy(np.int64)), len(node) - 1)
            yield from each(node, np.where(up.isna().to_numpy(), -1, order[at]))
    return frames


def _linear(node: np.ndarray, parent: np.ndarray) -> Iterator[pd.DataFrame]:
    yield _nested(node, parent)[0]


def _rings(node: np.ndarray, parent: np.ndarray) -> Iterator[pd.DataFrame]:
    _, _, cycle, _ = walk(node, parent)
    yield pd.DataFrame({"node": node[cycle >= 0], "cycle": cycle[cycle >= 0]})


def split_by_size(nodes: DataFrame, key: str, max_group: int, sized_by: DataFrame | None = None, most: int = 10_000) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups with at most max_group rows, and the rest (None if there are none).

    Sizes come from ``sized_by`` (a cheaper superset of the rows, with the same key column) and are
    pre-aggregated before their shuffle. There are at most rows / max_group large keys: up to ``most``
    of them become a literal filter, more are joined.
    """
    large = (sized_by if sized_by is not None else nodes).groupBy(key).count().where(F.col("count") > max_group).select(key)
    found = [r[0] for r in large.limit(most + 1).collect()]
    if not found:
        return nodes, None
    if len(found) <= most:
        hot = F.coalesce(F.col(key).isin([k for k in found if k is not None]), F.lit(None in found))
        return nodes.where(~hot), nodes.where(hot)
    return nodes.join(large, nodes[key].eqNullSafe(large[key]), "left_anti"), nodes.join(large, nodes[key].eqNullSafe(large[key]), "left_semi")


def resolve_links(nodes: DataFrame) -> DataFrame:
    """(scope, node, link_id, parent): each node with the node its link leads to (smallest on ties), null for none."""
    own = nodes.where(F.col("node_id").isNotNull()).groupBy("scope", F.col("node_id").alias("link_id")).agg(F.min("node").alias("parent"))
    return nodes.select("scope", "node", "link_id").join(own, ["scope", "link_id"], "left").select("scope", "node", "link_id", "parent")


def pointer_doubling(spark: SparkSession, edges: DataFrame, with_paths: bool = False, max_rounds: int = 64) -> DataFrame:
    """Follow (node, parent) to the end by squaring, one self-join a round, lineage cut each round.

    Result: node, root, depth, cycle and on_cycle, plus ``path`` from root to node if asked. Nodes on
    or before a cycle have cycle set and root, depth and path null. Exact for any size; the loop ends
    when a round closes no node and 2**rounds reaches the number of open nodes.
    """
    steps = F.array("node").alias("up") if with_paths else F.lit(None).cast("array<long>").alias("up")
    first = edges.select("node", "parent", F.coalesce("parent", "node").alias("ptr"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.col("parent").isNull().alias("done"), F.least("node", F.coalesce("parent", "node")).alias("low"), steps)
    state, path = materialize(spark, first, "doubling")
    before = -1
    for r in range(max_rounds):
        open_rows = state.where("not done").count()
        # a round that closes no node leaves only nodes bound for a ring; 2**r steps then cover every ring
        if open_rows == 0 or (open_rows == before and (1 << r) >= open_rows):
            break
        before = open_rows
        a, b = state.alias("a"), state.select(F.col("node").alias("b_node"), F.col("ptr").alias("b_ptr"), F.col("dist").alias("b_dist"), F.col("done").alias("b_done"), F.col("low").alias("b_low"), F.col("up").alias("b_up"))
        moved = a.where("not done").join(b, F.col("ptr") == F.col("b_node")).select(
            "node", "parent", F.col("b_ptr").alias("ptr"), (F.col("dist") + F.col("b_dist")).alias("dist"), F.col("b_done").alias("done"),
            F.least("low", "b_low").alias("low"),
            (F.when(F.col("b_done") & (F.col("b_dist") == 0), F.col("up")).otherwise(F.concat("up", "b_up")) if with_paths else F.col("up")).alias("up"),
        )
        nxt, nxt_path = materialize(spark, state.where("done").unionByName(moved), "doubling")
        release(spark, path)
        state, path = nxt, nxt_path
    lows = state.where("not done").select(F.col("node").alias("ring"), F.col("low").alias("cycle"))
    rings = state.where("not done").select(F.col("ptr").alias("ring")).distinct()
    on = rings.join(lows, "ring")
    # 2**r steps permute a ring's own nodes, so each of them is some pointer
    open_nodes = state.where("not done").join(on, F.col("ptr") == F.col("ring")).select("node", F.lit(None).cast("long").alias("root"), F.lit(None).cast("int").alias("depth"), "cycle", F.lit(None).cast("array<long>").alias("path"))
    marks = rings.select(F.col("ring").alias("node"), F.lit(True).alias("on_cycle"))
    closed = state.where("done").select("node", F.col("ptr").alias("root"), F.col("dist").cast("int").alias("depth"), F.lit(None).cast("long").alias("cycle"),
                                        (F.when(F.col("dist") == 0, F.array("node")).otherwise(F.reverse(F.concat("up", F.array("ptr")))) if with_paths else F.lit(None).cast("array<long>")).alias("path"))
    out = closed.unionByName(open_nodes).join(marks, "node", "left").withColumn("on_cycle", F.coalesce("on_cycle", F.lit(False)))
    return out


def trace(spark: SparkSession, edges: DataFrame, starts: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Nodes met from each start, by squaring the successor table and marking what it reaches.

    ``edges``: (node, parent), ``starts``: (start, node). Result: (start, node, pos), pos counting links
    from the start. On a walk that returns to a node, nodes come out more than once.
    """
    jump, jump_path = materialize(spark, edges.where("parent is not null").select("node", F.col("parent").alias("ptr")), "trace-jump")
    reach, reach_path = materialize(spark, starts.select("start", "node", F.lit(0).cast("long").alias("pos")), "trace-reach")
    total = jump.count()
    for r in range(max_rounds):
        step = reach.join(jump, "node").select("start", F.col("ptr").alias("node"), (F.col("pos") + (1 << r)).alias("pos"))
        nxt, nxt_path = materialize(spark, reach.unionByName(step), "trace-reach")
        grown = nxt.count() > reach.count()
        release(spark, reach_path)
        reach, reach_path = nxt, nxt_path
        if not grown or (1 << r) > total:
            break
        b = jump.select(F.col("node").alias("ptr"), F.col("ptr").alias("far"))
        nj, nj_path = materialize(spark, jump.join(b, "ptr").select("node", F.col("far").alias("ptr")), "trace-jump")
        release(spark, jump_path)
        jump, jump_path = nj, nj_path
    release(spark, jump_path)
    return reach


def list_rank(spark: SparkSession, cells: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, up, rest): the number of down steps from each cell of linked lists to its list's end, by doubling.

    ``cells``: node, up, next_node, next_up; a cell without successor ends its list.
    """
    state, path = materialize(spark, cells.select("node", "up", "next_node", "next_up", F.when(F.col("up"), 0).otherwise(1).cast("long").alias("rest")), "ranks")
    for _ in range(max_rounds):
        if state.where("next_node is not null").isEmpty():
            break
        far = state.select(F.col("node").alias("next_node"), F.col("up").alias("next_up"), F.col("next_node").alias("n"), F.col("next_up").alias("u"), F.col("rest").alias("more"))
        moved = state.where("next_node is not null").join(far, ["next_node", "next_up"]).select("node", "up", F.col("n").alias("next_node"), F.col("u").alias("next_up"), (F.col("rest") + F.col("more")).alias("rest"))
        nxt, nxt_path = materialize(spark, state.where("next_node is null").unionByName(moved), "ranks")
        release(spark, path)
        state, path = nxt, nxt_path
    return state.select("node", "up", "rest")


def number_walk(spark: SparkSession, placed: DataFrame) -> DataFrame:
    """(node, enter, leave) of trees whose rows need not fit a task; ``placed``: node, parent, root of every row.

    The depth-first walk is the list of a step down into each node and a step up out of it, linked by first
    child, next sibling and parent; its ranks give the numbers.
    """
    w = W.partitionBy("parent").orderBy("node")
    sib = placed.where("parent is not null").select("node", "parent", F.lead("node").over(w).alias("sibling"), F.row_number().over(w).alias("nth"))
    first = sib.where("nth = 1").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    links = placed.select("node", "parent").join(first, "node", "left").join(sib.select("node", "sibling"), "node", "left")
    down = links.select("node", F.lit(False).alias("up"), F.coalesce("child", "node").alias("next_node"), F.col("child").isNull().alias("next_up"))
    back = links.select("node", F.lit(True).alias("up"), F.coalesce("sibling", "parent").alias("next_node"), F.col("sibling").isNull().alias("next_up"))
    ranks = list_rank(spark, down.unionByName(back))
    both = ranks.groupBy("node").agg(F.max(F.when(~F.col("up"), F.col("rest"))).alias("down"), F.max(F.when(F.col("up"), F.col("rest"))).alias("back")).join(placed.select("node", "root"), "node")
    top = both.where("node = root").select("root", F.col("down").alias("total"))
    enter = F.col("total") - F.col("down")
    return both.join(top, "root").select("node", enter.alias("enter"), (enter + F.col("down") - F.col("back") - 1).alias("leave"))


def as_nodes(df: DataFrame, scope: str, node: str, node_id: str, link_id: str) -> DataFrame:
    return df.select(F.col(scope).cast("string").alias("scope"), F.col(node).cast("long").alias("node"), F.col(node_id).alias("node_id"), F.col(link_id).alias("link_id")).where(F.col("node").isNotNull())


def _own_scopes(nodes: DataFrame) -> DataFrame:
    """Rows without scope are linked to nothing: each becomes a scope of its own, which spreads them, too."""
    known = F.col("scope").isNotNull()
    return nodes.select(F.coalesce("scope", F.concat(F.lit("\0"), F.col("node").cast("string"))).alias("scope"), "node", F.when(known, F.col("node_id")).alias("node_id"), F.when(known, F.col("link_id")).alias("link_id"))


def _grouped(spark: SparkSession, nodes: DataFrame, each, schema: str, max_group: int, max_component: int, sized_by: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``each`` over all co-located groups, and the (node, parent) rows of components too large for one."""
    small, large = split_by_size(_own_scopes(nodes), "scope", max_group, sized_by)
    found = small.repartition("scope").sortWithinPartitions("scope", "node").mapInPandas(_by_scope(each), schema)
    if large is None:
        return found, None
    edges, _ = materialize(spark, resolve_links(large).select("node", "parent"), "forest-edges")
    named = components(spark, edges.select(F.col("node").alias("a"), F.coalesce("parent", "node").alias("b")))
    placed, _ = materialize(spark, edges.join(named, "node").select("component", "node", "parent"), "forest-components")
    fit, far = split_by_size(placed, "component", max_component)
    return found.unionByName(fit.repartition("component").sortWithinPartitions("component", "node").mapInPandas(_by_component(each), schema)), None if far is None else far.select("node", "parent")


def hierarchy(spark: SparkSession, nodes: DataFrame, max_group: int = MAX_GROUP, sized_by: DataFrame | None = None, max_component: int = MAX_COMPONENT) -> DataFrame:
    """Full hierarchy of (scope, node, node_id, link_id) rows: one row per node.

    Columns: node, root, depth, cycle, on_cycle, path (root to node) and descendants (sorted). Null or
    dangling links make a node a root; nodes that never reach a root have cycle set and root, depth,
    path and descendants null. A row with a null scope links to nothing and is linked by nothing; of
    equal ids in one scope the smallest node is the link target; an empty table gives an empty result;
    other columns are ignored. The arrays of one deep tree grow with the square of its depth by
    definition; ``nested`` says the same in linear size.
    """
    walked, far = _grouped(spark, nodes, _spread, HIERARCHY, max_group, max_component, sized_by)
    if far is None:
        return walked
    far = pointer_doubling(spark, far, with_paths=True)
    below = far.where("path is not null").select(F.explode("path").alias("above"), "node").where("above <> node").groupBy(F.col("above").alias("node")).agg(F.sort_array(F.collect_list("node")).alias("descendants"))
    far = far.join(below, "node", "left").withColumn("descendants", F.when(F.col("cycle").isNull(), F.coalesce("descendants", F.array().cast("array<long>"))))
    return walked.unionByName(far.select(*walked.columns))


def nested(spark: SparkSession, nodes: DataFrame, max_group: int = MAX_GROUP, sized_by: DataFrame | None = None, max_component: int = MAX_COMPONENT) -> DataFrame:
    """The hierarchy in linear size: node, parent, root, depth, enter, leave, cycle, on_cycle.

    enter numbers the depth-first walk of each tree from 0, siblings by rising node; the descendants of x are
    the nodes of its root with enter in (x.enter, x.leave], its ancestors those whose range holds x.enter.
    Nodes on or before a cycle have cycle set and root, depth, enter and leave null. Nulls, ties, empty tables
    and other columns as in ``hierarchy``.
    """
    walked, far = _grouped(spark, nodes, _linear, NESTED, max_group, max_component, sized_by)
    if far is None:
        return walked
    placed, _ = materialize(spark, pointer_doubling(spark, far).drop("path").join(far, "node"), "forest-placed")
    numbered = number_walk(spark, placed.where("cycle is null").select("node", "parent", "root"))
    return walked.unionByName(placed.join(numbered, "node", "left").select(*walked.columns))


def cycles(spark: SparkSession, nodes: DataFrame, max_group: int = MAX_GROUP, sized_by: DataFrame | None = None, max_component: int = MAX_COMPONENT) -> DataFrame:
    """(node, cycle): nodes whose links never end, with the smallest node on the cycle they reach.

    The same walk as ``hierarchy`` without building paths; null and duplicate handling is identical.
    """
    found, far = _grouped(spark, nodes, _rings, "node long, cycle long", max_group, max_component, sized_by)
    if far is None:
        return found
    return found.unionByName(pointer_doubling(spark, far).where("cycle is not null").select("node", "cycle"))
