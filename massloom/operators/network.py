"""Networks: directed edges, walk statistics, flow graphs and their layout weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import flow_label
from ..session import materialize, ship_package
from .graph import ONE_TASK, connected_components


def directed_edges(interactions: DataFrame, directions: DataFrame) -> DataFrame:
    """(gene1, gene2, score, direction, diedge_type, is_reverse): both directions of the dictionary that are valid."""
    known = interactions.join(directions.select("direction", "source", "target", F.col("src_to_dest").cast("int").alias("_fwd"), F.col("dest_to_src").cast("int").alias("_rev")), "direction", "left")
    fwd = known.where("_fwd = 1").select("gene1", "gene2", "score", "direction", F.col("target").alias("diedge_type"), F.lit(False).alias("is_reverse"))
    rev = known.where("_rev = 1").select(F.col("gene2").alias("gene1"), F.col("gene1").alias("gene2"), "score", "direction", F.col("source").alias("diedge_type"), F.lit(True).alias("is_reverse"))
    return fwd.unionByName(rev)


def vertex_degrees(edges: DataFrame, src: str = "source", dst: str = "target") -> DataFrame:
    """(vertex, ninedges, noutedges)."""
    both = edges.select(F.col(src).alias("vertex"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select(dst, F.lit(1), F.lit(0)))
    return both.groupBy("vertex").agg(F.sum("i").alias("ninedges"), F.sum("o").alias("noutedges"))


def transition(edges: DataFrame, src: str = "source", dst: str = "target", weight: str | None = None) -> DataFrame:
    """(src, dst, w): weights that leave a vertex add up to 1."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), w.alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    total = rows.groupBy("src").agg(F.sum("w").alias("t"))
    return rows.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("w"))


def walk_step(mass: DataFrame, steps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One step of a walk: mass (keys, vertex, p) moved along ``steps``; mass of vertices without a way out is lost."""
    return mass.join(steps, mass["vertex"] == steps["src"]).groupBy(*keys, F.col("dst").alias("vertex")).agg(F.sum(F.col("p") * F.col("w")).alias("p"))


def restart_walk(edges: DataFrame, starts: DataFrame, restart: float, tolerance: float = 1e-4, **columns) -> DataFrame:
    """(start, vertex, p): stationary mass of a walk that returns to its start with probability ``restart``.

    ``starts``: (start); each is an independent walk.  No mass is let go on the way; the series ends when the weight left is
    at most ``tolerance``, which bounds what a start's masses lack in all.
    """
    steps = materialize(transition(edges, **columns), "steps")
    mass = starts.select(F.col("start"), F.col("start").alias("vertex"), F.lit(1.0).alias("p"))
    total = materialize(mass.withColumn("p", F.lit(restart)), "walk")
    left = 1.0 - restart
    while left > tolerance:
        mass = materialize(walk_step(mass, steps, ["start"]), "walk")
        total = materialize(total.unionByName(mass.withColumn("p", F.col("p") * restart * left)).groupBy("start", "vertex").agg(F.sum("p").alias("p")), "walk")
        left *= 1.0 - restart
    return total


def walk_weight_stats(edges: DataFrame, starts: DataFrame, restarts: Sequence[float] = tuple(k / 20 for k in range(1, 20)), src: str = "source", dst: str = "target", tolerance: float = 1e-3, weight: str | None = None) -> DataFrame:
    """(restart_prob, vertices, trans_probs): mean mass that walks from ``starts`` put on neighbours and beyond.

    All restart probabilities weigh the same steps, so the walk is made once; each step leaves two means on the driver.
    It ends when the least restart probability gives the rest at most ``tolerance``; no mass is let go before.
    """
    steps = materialize(transition(edges, src, dst, weight), "steps")
    near = materialize(edges.select(F.col(src).alias("start"), F.col(dst).alias("vertex"), F.lit(True).alias("near")).distinct(), "near")
    mass = starts.select("start", F.col("start").alias("vertex"), F.lit(1.0).alias("p")).distinct()
    n = max(1, mass.count())
    sums: list[tuple[float, float]] = []
    left = 1.0 - min(restarts)
    rest = left
    while rest > tolerance:
        mass = materialize(walk_step(mass, steps, ["start"]), "walk")
        away = F.col("vertex") != F.col("start")
        got = mass.join(near, ["start", "vertex"], "left").agg(F.sum(F.when(away & F.col("near"), F.col("p"))).alias("n"), F.sum(F.when(away & F.col("near").isNull(), F.col("p"))).alias("x"), F.count("*").alias("left")).first()
        sums.append(((got["n"] or 0.0) / n, (got["x"] or 0.0) / n))
        rest *= left
        if not got["left"]:  # every walk has ended
            break
    rows = [(float(r), part, sum(r * (1 - r) ** k * m[at] for k, m in enumerate(sums, 1))) for r in restarts for at, part in enumerate(("neighbors", "exterior"))]
    return edges.sparkSession.createDataFrame(rows, "restart_prob double, vertices string, trans_probs double")


def weighted_matrix(walk: DataFrame, weights: DataFrame) -> DataFrame:
    """Columns of a matrix (i, j, v) scaled by the weights (j, weight) of their vertices."""
    return walk.join(weights, "j").select("i", "j", (F.col("v") * F.col("weight")).alias("v"))


def strong_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least vertex of each one's strong component, for n vertices and directed edges (a, b): one walk in depth, without recursion."""
    order = np.argsort(a, kind="stable")
    to, first = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    seen, low, label = [-1] * n, [0] * n, [-1] * n
    held: list[int] = []
    count = 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        path = [(root, first[root])]
        while path:
            v, at = path.pop()
            if at == first[v] and seen[v] < 0:
                seen[v] = low[v] = count
                count += 1
                held.append(v)
            went = False
            while at < first[v + 1]:
                w = to[at]
                if seen[w] < 0:
                    path += [(v, at), (w, first[w])]
                    went = True
                    break
                if label[w] < 0:
                    low[v] = min(low[v], low[w])
                at += 1
            if went:
                continue
            if low[v] == seen[v]:
                k = len(held) - 1
                while held[k] != v:
                    k -= 1
                least = min(held[k:])
                for w in held[k:]:
                    label[w] = least
                del held[k:]
            if path:
                parent = path[-1][0]
                low[parent] = min(low[parent], low[v])
    return np.array(label, int)


def _strong_in_one_task(strong: DataFrame) -> DataFrame:
    kind = strong.schema["u"].dataType.simpleString()
    ship_package(strong.sparkSession)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            names, ends = np.unique(np.concatenate([t["u"].to_numpy(), t["v"].to_numpy()]), return_inverse=True)
            label = strong_labels(len(names), ends[: len(t)], ends[len(t) :])
            for at in range(0, len(names), 1 << 16):
                own = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(names[own], t["u"].type), pa.array(names[label[own]], t["u"].type)], names=["id", "component"])

    return materialize(strong.repartition(1).mapInArrow(settle, f"id {kind}, component {kind}"), "components")


def _by_mutual(edges: DataFrame, one_task: int) -> DataFrame | None:
    """(id, component) of edges (u, v) between different numbers by contraction; None where no two vertices have edges both ways.

    Vertices with edges both ways are one, by connected components; vertices that nothing enters or nothing leaves are alone, and
    what is left between the others is a smaller graph of the same kind.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    pairs = materialize(edges.groupBy(low.alias("a"), high.alias("b")).agg(F.bit_or(F.when(F.col("u") < F.col("v"), 1).otherwise(2)).alias("ways")), "pairs")
    n, mutual = pairs.agg(F.count("*"), F.count(F.when(F.col("ways") == 3, 1))).first()
    single = pairs.where("ways < 3").select(F.when(F.col("ways") == 1, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(F.col("ways") == 1, F.col("b")).otherwise(F.col("a")).alias("v"))
    if n + mutual <= one_task:
        return _strong_in_one_task(single.union(pairs.where("ways = 3").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")))
    if not mutual:
        return None
    one = connected_components(pairs.where("ways = 3"), "a", "b", one_task=one_task)
    one = materialize(one, "mutual")
    ends = single.join(one.select(F.col("id").alias("u"), F.col("component").alias("a")), "u", "left").join(one.select(F.col("id").alias("v"), F.col("component").alias("b")), "v", "left")
    rest = materialize(ends.select("u", "v", F.coalesce("a", "u").alias("a"), F.coalesce("b", "v").alias("b")), "single")
    live = materialize(rest.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "live")
    before = live.count()
    while before:
        entered, left = live.select(F.col("v").alias("u")).distinct(), live.select(F.col("u").alias("v")).distinct()
        live = materialize(live.join(entered, "u", "left_semi").join(left, "v", "left_semi").select("u", "v"), "live")
        now = live.count()
        if now > 0.9 * before:  # a long chain is not peeled end by end
            break
        before = now
    others = rest.select(F.col("u").alias("id")).union(rest.select("v")).distinct().join(one, "id", "left_anti").select("id", F.col("id").alias("component"))
    found = one.union(others)
    if live.isEmpty():
        return found
    joined = strong_components(live.withColumn("w", F.lit(1.0)), 0.5, "w", "u", "v", one_task).select(F.col("id").alias("component"), F.col("component").alias("least"))
    return found.join(joined, "component", "left").select("id", F.coalesce("least", "component").alias("component"))


def strong_components(edges: DataFrame, threshold: float, weight: str = "w", src: str = "src", dst: str = "dst", one_task: int = ONE_TASK) -> DataFrame:
    """N3, tree cut: (id, component) of vertices joined both ways by edges of at least ``threshold``.

    Up to ``one_task`` edges are settled by one task.  More between numbers are contracted where they go both ways (``_by_mutual``).  What then
    is left goes by least labels forward and backward; where both agree a component is done, and edges inside one pair of labels go on.
    """
    strong = edges.where(F.col(weight) >= threshold).select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    if all(isinstance(strong.schema[c].dataType, T.IntegralType) for c in ("u", "v")):
        found = _by_mutual(strong, one_task)
        if found is not None:
            return found
    strong = materialize(strong.distinct(), "strong")
    if not isinstance(strong.schema["u"].dataType, (T.StructType, T.ArrayType, T.MapType)) and strong.count() <= one_task:
        return _strong_in_one_task(strong)
    vertices = strong.select(F.col("u").alias("id")).union(strong.select("v")).distinct()
    done: list[DataFrame] = []
    live = strong
    while not live.isEmpty():
        nodes = materialize(live.select(F.col("u").alias("id")).union(live.select("v")).distinct(), "live")

        def least(e: DataFrame, nodes: DataFrame = nodes) -> DataFrame:
            """Least vertex that reaches each one along ``e``."""
            label = nodes.select("id", F.col("id").alias("l"))
            while True:
                came = e.join(label, e["u"] == label["id"]).groupBy(F.col("v").alias("id")).agg(F.min("l").alias("c"))
                new = materialize(label.join(came, "id", "left").select("id", F.least("l", F.coalesce("c", "l")).alias("l"), (F.col("c") < F.col("l")).alias("changed")), "label")
                label = new.select("id", "l")
                if new.where("changed").isEmpty():
                    return label

        back = live.select(F.col("v").alias("u"), F.col("u").alias("v"))
        f, b = least(live), least(back).withColumnRenamed("l", "lb")
        both = materialize(f.join(b, "id"), "both")
        done.append(both.where("l = lb").select("id", F.col("l").alias("component")))
        rest = both.where("l <> lb")
        # only edges between vertices of the same two labels can lie in one component
        a, c = rest.select(F.col("id").alias("u"), "l", "lb"), rest.select(F.col("id").alias("v"), F.col("l").alias("l2"), F.col("lb").alias("lb2"))
        live = materialize(live.join(a, "u").join(c, "v").where("l = l2 and lb = lb2").select("u", "v"), "live")
    found = done[0] if done else vertices.select("id", F.col("id").alias("component")).limit(0)
    for d in done[1:]:
        found = found.unionByName(d)
    found = found.groupBy("id").agg(F.min("component").alias("component"))
    return vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


# Attributes that a graph file may have.
VERTEX_ATTRS = ("gene_name", "protein_description", "vertex_type", "weight", "walkweight", "is_hit", "prob_perm_walkweight_greater", "flows_to_genes", "flows_from_genes", "loops_through_genes", "layout_component", "layout_size", "layout_mass", "layout_x", "layout_y")
EDGE_ATTRS = ("edge_type", "interaction_type", "target_type", "source_type", "walkweight", "walkweight_rev", "walkpermweight_median", "walkpermweight_median_rev", "walkpermweight_mad", "walkpermweight_mad_rev", "walkpermweight_mean", "walkpermweight_mean_rev", "walkpermweight_std", "walkpermweight_std_rev", "prob_perm_walkweight_greater", "prob_perm_walkweight_greater_rev", "has_original", "has_original_rev", "has_flow", "has_walk", "flowpaths", "flowpaths_rev", "mlog10_prob_perm_walkweight_greater", "layout_weight")


def flow_vertices(vertices: DataFrame, info: DataFrame | None = None, component_groups: bool = True, labels: DataFrame | None = None) -> DataFrame:
    """Vertices (vertex, component, is_source, is_sink, is_steptrace[, flows_to, flows_from, loops_through]) with type,
    node names and lists of labels; component nodes are appended."""
    kind = F.when(F.col("is_source") & F.col("is_sink"), "source/sink").when(F.col("is_source"), "source").when(F.col("is_sink"), "sink").when(F.col("is_steptrace"), "step").otherwise("gene")
    out = vertices.withColumns({"node": node_name(F.col("vertex")), "component_node": F.concat(F.lit("g"), F.col("component").cast("string")), "vertex_type": kind, "layout_size": F.lit(0.0), "layout_mass": F.lit(1.0), "layout_x": F.lit(0.0), "layout_y": F.lit(0.0)})
    for c, name in (("flows_to", "flows_to_genes"), ("flows_from", "flows_from_genes"), ("loops_through", "loops_through_genes")):
        if c in vertices.columns and labels is not None:
            each = vertices.select("vertex", F.explode(c).alias("_v")).join(labels.select(F.col("vertex").alias("_v"), "label"), "_v", "left").groupBy("vertex").agg(F.collect_list("_v").alias("_vs"), F.collect_list(F.coalesce("label", F.lit("?"))).alias("_ls"))
            out = out.join(each.select("vertex", flow_label(F.col("_vs"), F.col("_ls")).alias(name)), "vertex", "left")
    if info is not None:
        out = out.join(info, "vertex", "left")
    if component_groups:
        groups = vertices.select(F.concat(F.lit("g"), F.col("component").cast("string")).alias("node")).distinct().withColumn("vertex_type", F.lit("connected_component"))
        out = out.unionByName(groups, allowMissingColumns=True)
    return out


def flow_path(paths: Column) -> Column:
    """Paths of labels as "→x→y→|→z→"; direct paths, which are empty, are left out, null without any."""
    longer = F.filter(paths, lambda p: F.size(p) > 0)
    return F.when(F.size(longer) > 0, F.array_join(F.transform(longer, lambda p: F.concat(F.lit("→"), F.array_join(p, "→", "?"), F.lit("→"))), "|"))


def node_name(vertex: Column) -> Column:
    return F.concat(F.lit("v"), vertex.cast("string"))


def flow_edges(edges: DataFrame, keep_flows: bool = False, max_pvalue: float | None = None) -> DataFrame:
    """Edges with type and -log10 of the least permutation p (null counts as 1); loops go, and edges of flows alone unless kept.

    Names of nodes and texts of flowpaths that are there already stay.
    """
    known = F.col("has_original") | F.col("has_original_rev")
    rows = edges.where((F.col("source") != F.col("target")) & (F.lit(keep_flows) | F.col("has_walk") | known))
    kind = F.when(known, F.when(F.col("has_trace"), "trace").otherwise("interaction")).when(F.col("has_walk"), "walk").when(F.col("has_flow"), "flow")
    p = F.least(F.coalesce("prob_perm_walkweight_greater", F.lit(1.0)), F.coalesce("prob_perm_walkweight_greater_rev", F.lit(1.0)), F.lit(1.0))
    names = {f"{c}_node": node_name(F.col(c)) for c in ("source", "target") if f"{c}_node" not in edges.columns}
    out = rows.withColumns({**names, "edge_type": kind, "mlog10_prob_perm_walkweight_greater": -F.log10(p), "layout_weight": F.lit(1.0)})
    for c in ("flowpaths", "flowpaths_rev"):
        if c in edges.columns and edges.schema[c].dataType.typeName() == "array":
            out = out.withColumn(c, flow_path(F.col(c)))
    return out if max_pvalue is None else out.where(F.col("prob_perm_walkweight_greater") <= max_pvalue)


def with_attributes(df: DataFrame, keys: Sequence[str], attributes: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """K3: key columns and those attributes that are there."""
    return df.select(*keys, *[c for c in [*attributes, *extra] if c in df.columns and c not in keys])


def graph_frames(vertices: DataFrame, edges: DataFrame, component_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """K3: node and edge frames as a graph file has them."""
    return with_attributes(vertices, ["node", *(["component_node"] if component_groups else [])], VERTEX_ATTRS), with_attributes(edges, ["source_node", "target_node"], EDGE_ATTRS)


GRAPHML_TYPES = {"boolean": "boolean", "int": "int", "bigint": "long", "double": "double", "float": "double"}


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K3: (part, value): a graph file's lines in order of ``part``: head and keys, nodes, edges, end.

    A null attribute is left out; a node without a name is an error when computed.
    """
    spark = nodes.sparkSession
    text = lambda c: F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    ends = {"node": ("node", "component_node"), "edge": ("source_node", "target_node")}
    frames = {"node": nodes, "edge": edges}
    attributes = {kind: [c for c in df.columns if c not in ends[kind]] for kind, df in frames.items()}
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    for kind, df in frames.items():
        types = dict(df.dtypes)
        head += [f'<key id="{kind}_{c}" for="{kind}" attr.name="{c}" attr.type="{GRAPHML_TYPES.get(types[c], "string")}"/>' for c in attributes[kind]]
    if "component_node" in nodes.columns:
        head.append('<key id="node_parent" for="node" attr.name="parent" attr.type="string"/>')

    def data(kind: str) -> list[Column]:
        own = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{kind}_{c}">'), text(F.col(c)), F.lit("</data>"))) for c in attributes[kind]]
        parent = [F.when(F.col("component_node").isNotNull(), F.concat(F.lit('<data key="node_parent">'), text(F.col("component_node")), F.lit("</data>")))] if kind == "node" and "component_node" in nodes.columns else []
        return own + parent

    name = F.coalesce(F.col("node"), F.raise_error(F.lit("a node has no name")))
    node = nodes.select(F.lit(1).alias("part"), F.concat_ws("", F.lit('<node id="'), text(name), F.lit('">'), *data("node"), F.lit("</node>")).alias("value"))
    edge = edges.select(F.lit(2).alias("part"), F.concat_ws("", F.lit('<edge source="'), text(F.col("source_node")), F.lit('" target="'), text(F.col("target_node")), F.lit('">'), *data("edge"), F.lit("</edge>")).alias("value"))
    frame = spark.createDataFrame([(0, "\n".join([*head, '<graph edgedefault="directed">'])), (3, "</graph>\n</graphml>")], "part int, value string")
    return frame.unionByName(node).unionByName(edge)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K3: one file under ``path``; a graph is for drawing, and one task writes it in order."""
    graphml_lines(nodes, edges).repartition(1).sortWithinPartitions("part").select("value").write.text(path)


def layout_weights(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """N4 without the force layout: degrees and flags of vertices, carried to edges, and the edges' weights."""
    known = F.coalesce("has_original", F.lit(False)) | F.coalesce("has_original_rev", F.lit(False))
    ends = edges.select(F.col("source").alias("vertex"), known.alias("o")).union(edges.select("target", known))
    flags = ends.groupBy("vertex").agg(F.bool_or("o").alias("anyoriginal_edge"))
    small = F.col("vertex_type").isin("gene", "step")
    n = F.broadcast(edges.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n")))  # one row
    nodes = vertices.join(vertex_degrees(edges), "vertex", "left").join(flags, "vertex", "left").crossJoin(n)
    nodes = nodes.withColumns({"ninedges": F.coalesce("ninedges", F.lit(0)), "noutedges": F.coalesce("noutedges", F.lit(0)), "anyoriginal_edge": F.coalesce("anyoriginal_edge", F.lit(False)), "layout_size": F.when(small, 0.2).otherwise(0.4) / F.col("_n")}).drop("_n")
    about = nodes.where("vertex is not null").select("vertex", (F.col("ninedges") + F.col("noutedges")).alias("_d"), "anyoriginal_edge", "is_sink")
    out = edges
    for end in ("source", "target"):
        out = out.join(about.select(F.col("vertex").alias(end), F.col("_d").alias(f"{end}_nedges"), F.col("anyoriginal_edge").alias(f"_o_{end}"), F.col("is_sink").alias(f"_s_{end}")), end, "left")
    weight = F.greatest(F.coalesce("walkweight", F.lit(0.0)), F.coalesce("walkweight_rev", F.lit(0.0)))
    mean = F.broadcast(edges.agg(F.avg(F.when(weight > 0, weight)).alias("_mean")))
    least = F.least("source_nedges", "target_nedges").cast("double")
    has_sink, both = F.col("_s_source") | F.col("_s_target"), F.col("_o_source") & F.col("_o_target")
    factor = F.when(has_sink, F.when(known, 10.0).otherwise(10.0 / F.sqrt(least))).when(known, 3.0).when(both, 0.5 / (least * least)).otherwise(1.0 / F.sqrt(least))
    clamped = F.least(F.greatest(weight / F.col("_mean"), F.lit(0.01)), F.lit(5.0))
    out = out.crossJoin(mean).withColumns({"has_sink": has_sink, "ends_have_original": both, "layout_weight": F.pow(clamped, F.lit(0.25)) * factor})
    return nodes, out.drop("_mean", "_o_source", "_o_target", "_s_source", "_s_target")


def components(edges: DataFrame, src: str = "source", dst: str = "target") -> DataFrame:
    return connected_components(edges, src, dst)
