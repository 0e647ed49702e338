"""Parent-child rows to full hierarchies.

Level-wise frontier joins.  Every unplaced node carries the segment of its nearest ancestors; the
frontier starts as the roots, and each round joins the last ancestor of each segment with the
nodes placed in the round before, which places the next ``k`` levels at once (k is the length of the
segments) and extends path and depth.  A row leaves the unplaced set for good once it is placed, so
a round shuffles only what is left.  Segments start with 2**hops ancestors and double after every
``rounds`` rounds that did not finish, so the number of jobs grows with the logarithm of the depth.

What no round reaches lies on a cycle or below one.  There a segment of REPEAT ancestors repeats a node,
which gives away the whole cycle, its smallest id and the branch below it, without another join.  Where
it is too short for that, pointer doubling over the unreached nodes finds the members of the long cycles,
and these are the roots of the trees below them, placed by the same frontier joins.

Every round is one written table: a lost executor costs a re-read, not a replay of all rounds, and
the plan of a round does not hold the earlier ones.  Its two counters are observed while it is written;
nothing else is collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docketspark.functions.ids import clean_id
from docketspark.session import cut

REPEAT = 64  # ancestors in which unreached nodes are looked for again


@dataclass
class Hierarchy:
    """``nodes``, one row a distinct node: node_id, parent_id, root_id, depth, path, on_cycle, branch.

    ``branch`` leads from the cycle's member to a node below the cycle (a member's is itself); null in trees.
    """

    nodes: DataFrame

    def descendants(self) -> DataFrame:
        """(ancestor_id, node_id, distance): every proper ancestor of every node.

        The pairs are read off the paths, so there is no join.  Output size is the sum of the depths.  The trees
        below a cycle hang on the member they start from; the members of a cycle are in no order, so there
        are no pairs among them.
        """
        line = F.coalesce("path", "branch")
        p = self.nodes.where(F.size(line) > 1).select("node_id", F.size(line).alias("n"), F.posexplode(line).alias("pos", "ancestor_id"))
        return p.where("pos < n - 1").select("ancestor_id", "node_id", (F.col("n") - 1 - F.col("pos")).alias("distance"))

    def cycles(self) -> DataFrame:
        """Nodes that never reach a root, with the smallest id on the cycle they run into."""
        return self.nodes.where("depth = -1").select("node_id", "parent_id", F.col("root_id").alias("cycle_id"), "on_cycle")


def latest_links(df: DataFrame, id_col: str, parent_col: str, version_col: str | None = None) -> DataFrame:
    """One (node_id, parent_id) per clean id: the row with the latest version, ties to the greatest parent.

    The maximum is a partial aggregate, so any number of repeated rows of one id is folded
    before the shuffle.  Rows whose id is null or blank are no nodes and are left out.
    """
    version = F.col(version_col) if version_col else F.lit(None).cast("string")
    rows = df.select(clean_id(id_col).alias("node_id"), version.alias("_v"), clean_id(parent_col).alias("_p"))
    held = rows.where("node_id IS NOT NULL").groupBy("node_id").agg(F.max(F.struct("_v", "_p")).alias("_m"))
    return held.select("node_id", F.col("_m._p").alias("parent_id"))


def resolve_aliases(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace a parent that is no node's id by the node that carries it as an alias.

    ``aliases``: (alias, node_id).  An alias of several nodes goes to the smallest id; an
    exact id always wins over an alias.
    """
    one = aliases.groupBy("alias").agg(F.min("node_id").alias("_target"))
    ids = links.select(F.col("node_id").alias("_known"))
    return (
        links.join(ids, F.col("parent_id") == F.col("_known"), "left")
        .join(one, F.col("parent_id") == F.col("alias"), "left")
        .select("node_id", F.coalesce("_known", "_target", "parent_id").alias("parent_id"))
    )


def _widen(rest: DataFrame) -> DataFrame:
    """Segments twice as long: each goes on with that of its last ancestor, if that one is unplaced too."""
    t = rest.select(F.col("node_id").alias("_at"), F.col("seg").alias("_more"))
    longer = F.when(F.col("_more").isNotNull(), F.concat("seg", "_more")).otherwise(F.col("seg"))
    return rest.join(t, F.element_at("seg", -1) == F.col("_at"), "left").select("node_id", "parent_id", longer.alias("seg"))


def _place(rest: DataFrame, frontier: DataFrame, hops: int, rounds: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Levels below ``frontier`` (node_id, root_id, depth, path), and what no round reaches, with its number of rows.

    ``rest``: node_id, parent_id, seg.  A segment's last ancestor is in the last frontier or unplaced, never
    in an older frontier: rounds and widening both keep that.
    """
    levels: list[DataFrame] = []
    for _ in range(hops):
        rest = cut(_widen(rest))
    while True:
        for _ in range(rounds):
            f = frontier.select(F.col("node_id").alias("_at"), "root_id", "depth", "path")
            between = F.reverse(F.slice("seg", F.lit(1), F.size("seg") - 1))
            seen = Observation()
            step = cut(
                rest.join(f, F.element_at("seg", -1) == F.col("_at"), "left")
                .select(
                    "node_id", "parent_id", "root_id", (F.col("depth") + F.size("seg")).alias("depth"),
                    F.when(F.col("root_id").isNotNull(), F.concat("path", between, F.array("node_id"))).alias("path"),
                    F.when(F.col("root_id").isNull(), F.col("seg")).alias("seg"),
                )
                .observe(seen, F.count("root_id").alias("hit"), F.count("*").alias("all"))
            )
            hit, left = seen.get["hit"], seen.get["all"] - seen.get["hit"]
            frontier = step.where("root_id IS NOT NULL").drop("seg")
            rest = step.where("root_id IS NULL").select("node_id", "parent_id", "seg")
            if hit:
                levels.append(frontier)
            if not hit or not left:
                return levels, rest, left
        rest = cut(_widen(rest))


def build_hierarchy(links: DataFrame, hops: int = 4, rounds: int = 8) -> Hierarchy:
    """Depth, root and path of every node of ``links`` (node_id unique, parent_id).

    A node without a parent, or whose parent is not listed, is a root: depth 0, its own root,
    path [itself].  A node on or below a cycle has depth -1, root_id = smallest id on the
    cycle, path null, and on_cycle tells the members from the rest.  An empty input gives an
    empty result.  A self-parent is a cycle of one.
    """
    links = links.select("node_id", "parent_id")
    known = links.select(F.col("node_id").alias("_known"))
    edges = cut(links.join(known, F.col("parent_id") == F.col("_known"), "left").select("node_id", "parent_id", F.when(F.col("_known").isNotNull(), F.array("_known")).alias("seg")))
    roots = edges.where("seg IS NULL").select("node_id", "parent_id", F.col("node_id").alias("root_id"), F.lit(0).alias("depth"), F.array("node_id").alias("path"))
    levels, rest, left = _place(edges.where("seg IS NOT NULL"), roots, hops, rounds)
    nodes = reduce(DataFrame.unionByName, [roots, *levels]).select("*", F.lit(False).alias("on_cycle"), F.lit(None).cast("array<string>").alias("branch"))
    if left:
        while rest.select(F.size("seg")).first()[0] < REPEAT:  # unreached segments are all of one length
            rest = cut(_widen(rest))
        seen = Observation()
        found = cut(_repeats(rest).observe(seen, F.count_if(F.col("root_id").isNull()).alias("n")))
        nodes = nodes.unionByName(_lost(found.where("root_id IS NOT NULL"), F.col("branch")))
        if seen.get["n"]:
            nodes = reduce(DataFrame.unionByName, [nodes, *_long(found.where("root_id IS NULL").select("node_id", "parent_id"), rounds)])
    return Hierarchy(nodes)


def _lost(part: DataFrame, branch: Column) -> DataFrame:
    """Rows of nodes that reach no root, from node_id, parent_id and root_id."""
    none = F.lit(None).cast("array<string>")
    return part.select("node_id", "parent_id", "root_id", F.lit(-1).alias("depth"), none.alias("path"), (F.size(branch) == 1).alias("on_cycle"), branch.alias("branch"))


def _repeats(rest: DataFrame) -> DataFrame:
    """node_id, parent_id, root_id, branch: the first node that comes again up the segment is where the branch meets the cycle."""
    up = rest.select("node_id", "parent_id", F.concat(F.array("node_id"), "seg").alias("a"))
    again = F.transform("a", lambda x, i: F.array_position(F.slice("a", i + 2, F.size("a")), x))
    i = F.array_position(F.transform("again", lambda k: k > 0), True).cast("int")  # from 1; 0 if nothing repeats
    at = up.select("*", again.alias("again")).select("*", i.alias("i"))
    ring = F.slice("a", F.col("i"), F.element_at("again", F.col("i")).cast("int"))
    found = F.col("i") > 0
    return at.select("node_id", "parent_id", F.when(found, F.array_min(ring)).alias("root_id"), F.when(found, F.reverse(F.slice("a", F.lit(1), F.col("i")))).alias("branch"))


def _long(rest: DataFrame, rounds: int) -> list[DataFrame]:
    """Rows of nodes on or below cycles too long for a segment."""
    ring = cut(_long_rings(rest))
    members = ring.select("node_id", "parent_id", "root_id", F.lit(0).alias("depth"), F.array("node_id").alias("path"))
    below = rest.join(ring.select("node_id"), "node_id", "left_anti").select("node_id", "parent_id", F.array("parent_id").alias("seg"))
    return [_lost(x, F.col("path")) for x in (members, *_place(below, members, 0, rounds)[0])]


def _double(state: DataFrame, extra: list[Column]) -> DataFrame:
    """One doubling step of ``state`` (node_id, jump, ...): follow jump's own jump."""
    t = state.select(*(F.col(c).alias(f"t_{c}") for c in state.columns))
    return state.join(t, F.col("jump") == F.col("t_node_id")).select("node_id", F.col("t_jump").alias("jump"), *extra)


def _long_rings(rest: DataFrame) -> DataFrame:
    """Members of all cycles (node_id, parent_id, root_id) among nodes whose parents are all among them.

    The images of the jumps shrink as these double, until only members are left; a second doubling, over
    the members, gives each the smallest id of its cycle.
    """
    state, size = cut(rest.select("node_id", F.col("parent_id").alias("jump"))), -1
    while True:
        image = state.select("jump").distinct()
        now = image.count()
        if now == size:
            break
        state, size = cut(_double(state, [])), now
    members = rest.join(cut(image.select(F.col("jump").alias("node_id"))), "node_id", "left_semi")
    low = cut(members.select("node_id", F.col("parent_id").alias("jump"), F.col("node_id").alias("low")))
    while True:
        seen = Observation()
        low = cut(_double(low, [F.least("low", "t_low").alias("low"), F.col("low").alias("was")]).observe(seen, F.count_if(F.col("low") < F.col("was")).alias("n"))).drop("was")
        if not seen.get["n"]:
            return members.join(low.select("node_id", F.col("low").alias("root_id")), "node_id")
