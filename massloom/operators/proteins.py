"""Protein inference, group tables and cross-dataset matching.

Groups are long frames throughout; a record type with sets in it exists only as the result of ``group_records``.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import literal_split
from ..functions.strings import collapse_values
from ..session import materialize, ship_package
from .batches import hot_join, tasks, whole_keys
from .graph import connected_components
from .ids import dense_rank_table
from .sets import SIGNATURE, signatures


# --- relations of sets

def flagged(members: DataFrame, decisive: DataFrame, set_col: str, elem_col: str) -> DataFrame:
    """(id, e, d): distinct members, d being 1 where the element is decisive for the set."""
    rows = materialize(members.select(F.col(set_col).alias("id"), F.col(elem_col).alias("e"), F.lit(0).alias("d")).union(decisive.select(set_col, elem_col, F.lit(1))), "flags")
    return rows.repartition(tasks(rows.sparkSession, rows.count(), 1 << 20), "id", "e").groupBy("id", "e").agg(F.max("d").alias("d"))


def pair_relations(members: DataFrame, decisive: DataFrame, set_col: str = "id", elem_col: str = "pep", each: int = 1 << 20) -> DataFrame:
    """G1, G3.4: (id1, id2, n_common, n_left, n_right) of sets id1 < id2 that share an element of ``members``.

    ``n_left`` counts decisive elements of id1 that are not common, ``n_right`` those of id2.  Elements of the very same
    sets are one weighted element, so what a pair has in common costs one row however often it occurs; an element of k sets
    makes k(k-1)/2 pairs, which are part of the result.  Sizes go with the members, so pairs are dealt once, about ``each`` to a task.
    """
    rows = materialize(flagged(members, decisive, set_col, elem_col), "members")
    like = signatures(rows, ["e"], ["id", "d"])
    one = like.groupBy(*SIGNATURE).agg(F.min("e").alias("e"), F.count("*").alias("w")).select("e", "w")
    few = materialize(rows.join(one, "e").join(rows.groupBy("id").agg(F.sum("d").alias("s")), "id"), "shared")
    a = few.select(F.col("id").alias("id1"), "e", "w", F.col("d").alias("d1"), F.col("s").alias("s1"))
    b = few.select(F.col("id").alias("id2"), "e", F.col("d").alias("d2"), F.col("s").alias("s2"))
    made = few.groupBy("e").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    pairs = hot_join(a, b, ["e"], each=each).where("id1 < id2").repartition(tasks(few.sparkSession, int(made or 0), each), "id1", "id2")
    counts = pairs.groupBy("id1", "id2").agg(F.sum("w").alias("n_common"), F.sum(F.col("w") * F.col("d1")).alias("c1"), F.sum(F.col("w") * F.col("d2")).alias("c2"), F.max("s1").alias("s1"), F.max("s2").alias("s2"))
    return counts.select("id1", "id2", "n_common", (F.col("s1") - F.col("c1")).alias("n_left"), (F.col("s2") - F.col("c2")).alias("n_right"))


def containments(members: DataFrame, decisive: DataFrame, set_col: str = "id", elem_col: str = "pep") -> DataFrame:
    """(child, parent) of different sets: every decisive element of the child is a member of the parent."""
    rows = materialize(flagged(members, decisive, set_col, elem_col), "members")
    return _contained(rows, rows.groupBy("id").agg(*_bits("d"), *_bits()))


def _bits(flag: str | None = None) -> list[Column]:
    """256 bits, in four numbers, of the elements e (with ``flag``: of those that have it): a set lacks no bit of a set that it contains."""
    h = F.xxhash64("e")
    here = lambda k: (F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(3)) == k) & (F.col(flag) == 1 if flag else F.lit(True))
    bit = F.expr("shiftleft(1L, cast(xxhash64(e) & 63 as int))")
    return [F.bit_or(F.when(here(k), bit).otherwise(F.lit(0).cast("long"))).alias(f"{flag or 'm'}{k}") for k in range(4)]


def _contained(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """(child, parent) from (id, e, d) and the sets' bits.

    A set with a decisive element of its own is in no other.  A parent has the child's rarest decisive element, so only sets that share that
    one are looked at, and of these only those that have all the child's bits are compared with it element by element.
    """
    elements = materialize(rows.groupBy("e").agg(F.count("*").alias("n"), F.min("id").alias("one"), F.max("d").alias("d")), "elements")
    apart = elements.where("n = 1 and d = 1 and e is not null").select(F.col("one").alias("child")).distinct()
    must = materialize(rows.where("d = 1").select(F.col("id").alias("child"), "e").join(apart, "child", "left_anti"), "decisive")
    has = rows.select(F.col("id").alias("parent"), "e")
    rare = must.join(elements.where("n > 1").select("e", "n"), "e").groupBy("child").agg(F.min(F.struct("n", "e")).alias("r"), F.count("*").alias("need"))
    found = rare.select("child", "need", F.col("r.e").alias("e")).join(has, "e").where("child <> parent").select("child", "parent", "need")
    found = found.join(bits.select(F.col("id").alias("child"), *[f"d{k}" for k in range(4)]), "child").join(bits.select(F.col("id").alias("parent"), *[f"m{k}" for k in range(4)]), "parent")
    found = materialize(found.where(" and ".join(f"d{k} & ~m{k} = 0" for k in range(4))).select("child", "parent", "need"), "candidates")
    met = found.join(must, "child").join(has, ["parent", "e"]).groupBy("child", "parent", "need").agg(F.count("*").alias("met"))
    return met.where("met = need").select("child", "parent")


def sharing_groups(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, rep) of every id: pairs without left and right are equivalent, the least id represents them."""
    same = pairs.where("n_left = 0 and n_right = 0").select(F.col("id1").alias("src"), F.col("id2").alias("dst"))
    comp = connected_components(same)
    return ids.select("id").distinct().join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("rep"))


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id): every root with itself and all that its ``edges`` (parent, child) lead to."""
    found = materialize(roots.select(F.col("id").alias("root"), "id").distinct(), "closure")
    front = found
    while True:
        step = front.join(edges.select(F.col("parent").alias("id"), "child"), "id").select("root", F.col("child").alias("id")).distinct()
        front = materialize(step.join(found, ["root", "id"], "left_anti"), "closure")
        if front.isEmpty():
            return found
        found = materialize(found.unionByName(front), "closure")


def assemble_protgroups(pep2prots: DataFrame, minspec_peptides: int = 1, nspec_peptides: int = 1, rspec_peptides: float = 0.0, pep: str = "pep", prot: str = "prot", rank: str = "rank") -> DataFrame:
    """Parsimony protein inference; (group_id from 0, kind, item), kind being major, prot, spec or pep.

    Ranks above 0 are decisive, the least of a protein counts.  Groups are numbered by their least protein.
    """
    rows = pep2prots.select(F.col(pep).alias("e"), F.col(prot).alias("prot"), F.col(rank).alias("rank"))
    spark = rows.sparkSession
    # numbers are ids themselves
    universe = None if isinstance(rows.schema["prot"].dataType, T.IntegralType) else materialize(dense_rank_table(rows.where("rank > 0").select("prot").distinct(), ["prot"], "id"), "proteins")
    given = rows.where("prot is not null").withColumn("id", F.col("prot").cast("long")) if universe is None else rows.join(universe, "prot")
    # links of a protein lie together, so what is summed by protein is summed where they lie; one with many lies in several tasks
    spread = given.select("id", "e", "rank").repartitionByRange(tasks(spark, given.count(), 1 << 20), "id", "e")
    own = materialize(spread.groupBy("id", "e").agg(F.min(F.when(F.col("rank") > 0, F.col("rank"))).alias("rank")), "links")
    least, most, n, ranked = own.agg(F.min("rank"), F.max("rank"), F.count("*"), F.count("rank")).first()
    if n == ranked and least == most:  # one rank for all
        own = own.select("id", "e", F.lit(1).alias("d"))
    else:
        best = own.groupBy("id").agg(F.min("rank").alias("best")).where("best is not null")
        own = materialize(own.join(best, "id").select("id", "e", F.coalesce(F.col("rank") == F.col("best"), F.lit(False)).cast("int").alias("d")), "links")
    # proteins of the very same peptides are equivalent: only the first of each goes into pairs
    alike = materialize(signatures(own, ["id"], ["e", "d"], *_bits("d"), *_bits()), "signatures")
    first = alike.groupBy(*SIGNATURE).agg(F.min("id").alias("first"))
    twins = materialize(alike.join(first, list(SIGNATURE)).select("id", "first"), "twins")
    only = twins.where("id = first").select("id")
    others = twins.where("id <> first").select("id")
    firsts = own if others.isEmpty() else materialize(own.join(others, "id", "left_anti"), "firsts")
    # groups merge by the shares of what they have apart: without such a share no pair but those that contain one another counts
    merging = rspec_peptides > 0
    if merging:
        pairs = materialize(pair_relations(firsts, firsts.where("d = 1"), elem_col="e"), "pairs")
        inside = pairs.where("n_left = 0").select(F.col("id1").alias("child"), F.col("id2").alias("parent")).union(pairs.where("n_right = 0").select("id2", "id1"))
    else:
        inside = _contained(firsts, alike)
    inside = materialize(inside, "inside")
    back = inside.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    same = connected_components(inside.join(back, ["child", "parent"]), "child", "parent")
    classes_of = only.join(same, "id", "left").select(F.col("id").alias("first"), F.coalesce("component", "id").alias("rep"))
    reps = materialize(twins.join(classes_of, "first").select("id", "rep"), "reps")
    heads = materialize(reps.select("rep").distinct().select(F.col("rep").alias("id")), "heads")

    def of_heads(df: DataFrame, *cols: str) -> DataFrame:
        for c in cols:
            df = df.join(heads.select(F.col("id").alias(c)), c, "left_semi")
        return df

    subsets = materialize(of_heads(inside.join(back, ["child", "parent"], "left_anti"), "child", "parent").select("parent", "child").distinct(), "subsets")
    tops = heads.join(subsets.select(F.col("child").alias("id")).distinct(), "id", "left_anti")
    if merging:
        n1, n2, nb = F.col("n_left"), F.col("n_right"), F.col("n_common")
        close = ((n1 < rspec_peptides * (n1 + nb)) | (n2 < rspec_peptides * (n2 + nb))) & ((n1 < nspec_peptides) | (n2 < nspec_peptides)) & (n1 > 0) & (n2 > 0)
        merges = of_heads(pairs.where(close), "id1", "id2").join(tops.select(F.col("id").alias("id1")), "id1", "left_semi").join(tops.select(F.col("id").alias("id2")), "id2", "left_semi")
        merged = connected_components(merges, "id1", "id2")
        group_of = tops.join(merged, "id", "left").select("id", F.coalesce("component", "id").alias("group"))
    else:
        group_of = tops.select("id", F.col("id").alias("group"))
    # a group has its tops, what is below them, and all that these represent
    below = descendants(subsets, tops)
    classes = below.join(group_of.select(F.col("id").alias("root"), "group"), "root").select("group", F.col("id").alias("rep")).distinct()
    prots = materialize(classes.join(reps, "rep").select("group", "id").distinct(), "group-proteins")
    sizes = prots.groupBy("group").agg(F.count("*").alias("k"))
    # a peptide that one group alone has: no list of the groups' peptides is needed
    of_groups = own.join(prots, "id").groupBy("e").agg(F.min("group").alias("group"), F.max("group").alias("last"))
    spec = materialize(of_groups.where("group = last and e is not null").select("group", "e"), "specific")
    kept = spec.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") >= minspec_peptides) if minspec_peptides > 0 else prots.select("group").distinct()
    numbers = materialize(dense_rank_table(kept.select("group"), ["group"], "group_id", 0), "groups")
    major = prots.groupBy("id").agg(F.count("*").alias("n"), F.min("group").alias("group")).where("n = 1")
    named = materialize(prots.join(numbers, "group").join(sizes, "group"), "named-proteins")
    item = lambda df: df.withColumn("item", F.col("id").cast("string")) if universe is None else df.join(universe, "id").withColumn("item", F.col("prot").cast("string"))
    # only groups of several proteins can have a peptide twice
    peps = [own.join(named.where(k), "id").select("group_id", F.col("e").cast("string").alias("item")) for k in ("k = 1", "k > 1")]
    parts = [(item(major.join(numbers, "group")), "major"), (item(named), "prot"), (spec.join(numbers, "group").withColumn("item", F.col("e").cast("string")), "spec"), (peps[0], "pep"), (peps[1].distinct(), "pep")]
    return reduce(DataFrame.unionByName, [p.select("group_id", F.lit(kind).alias("kind"), "item") for p, kind in parts])


def group_records(groups: DataFrame) -> DataFrame:
    """G1: one row per group, with arrays major_prots, prots, spec_peps and peps, sorted."""
    pick = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("item"))))
    return groups.groupBy("group_id").agg(pick("major").alias("major_prots"), pick("prot").alias("prots"), pick("spec").alias("spec_peps"), pick("pep").alias("peps"))


def group_table(groups: DataFrame, ranks: DataFrame | None = None, info: DataFrame | None = None, info_key: str = "protein_ac", extra_cols: Sequence[str] = (), group_col: str = "protgroup_id", protein_col: str = "protein_ac", subobject: str = "peptide") -> DataFrame:
    """Groups as delimited lists, proteins by (rank, accession); ``info`` rolls up over major proteins.

    ``ranks``: (item, rank), 100 where it has none.  Strings become sorted distinct lists, booleans any; columns of other
    types are skipped with a warning.
    """
    rows = groups if ranks is None else groups.join(ranks.select("item", F.col("rank").alias("_r")), "item", "left")
    rank = F.lit(0) if ranks is None else F.coalesce("_r", F.lit(100))

    def listed(kind: str, by_rank: bool) -> Column:
        items = F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.struct((rank if by_rank else F.lit(0)).alias("r"), F.col("item").alias("i")))))
        return F.array_join(F.transform(items, lambda x: x["i"]), ";")

    out = rows.groupBy(F.col("group_id").alias(group_col)).agg(
        listed("major", True).alias(f"majority_{protein_col}s"), listed("prot", True).alias(f"{protein_col}s"),
        listed("spec", False).alias(f"spec_{subobject}_ids"), listed("pep", False).alias(f"{subobject}_ids"),
    )
    if info is None or not extra_cols:
        return out
    aggs = []
    for c in extra_cols:
        kind = info.schema[c].dataType
        if isinstance(kind, T.StringType):
            items = F.array_sort(F.collect_set(c))
            aggs.append(F.when(F.size(items) > 0, F.array_join(items, ";")).alias(c))
        elif isinstance(kind, T.BooleanType):
            aggs.append(F.coalesce(F.bool_or(c), F.lit(False)).alias(c))
        else:
            warnings.warn(f"column {c} of type {kind.simpleString()} is not rolled up", stacklevel=2)
    major = groups.where("kind = 'major'").select(F.col("group_id").alias(group_col), "item")
    rolled = major.join(info.select(F.col(info_key).cast("string").alias("item"), *extra_cols), "item", "left").groupBy(group_col).agg(*aggs) if aggs else major.select(group_col).distinct()
    return out.join(rolled, group_col, "left")


# --- matching groups of several datasets

def best_rank(*ranks: Column) -> Column:
    """Least rank of the references that are there, -1 without any."""
    return F.coalesce(F.least(*ranks) if len(ranks) > 1 else ranks[0], F.lit(-1))


def worst_rank(*ranks: Column) -> Column:
    return F.coalesce(F.greatest(*ranks) if len(ranks) > 1 else ranks[0], F.lit(-1))


def compatible(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """At least one shared dataset, and all that are shared agree."""
    shared = [a.isNotNull() & b.isNotNull() for a, b in zip(left, right, strict=True)]
    agree = [~s | (a == b) for s, a, b in zip(shared, left, right, strict=True)]
    return reduce(lambda x, y: x | y, shared) & reduce(lambda x, y: x & y, agree)


def intersect_lists(*lists: Column, order: Column | None = None) -> Column:
    """Tokens in all the ";" lists that are not null, null if there are none; ``order`` maps token to score.

    With scores tokens are ordered by (score, token), scores missing last; without, by the first list.
    """
    empty = F.array().cast("array<string>")
    arrays = [literal_split(c, ";") for c in lists]
    first = F.coalesce(*arrays)
    out = reduce(lambda acc, a: F.when(a.isNull(), acc).otherwise(F.array_intersect(acc, F.coalesce(a, empty))), arrays, F.array_distinct(first))
    if order is not None:
        scored = F.array_sort(F.transform(out, lambda t: F.struct(F.coalesce(F.element_at(order, t), F.lit(float("inf"))).alias("s"), t.alias("t"))))
        out = F.transform(scored, lambda x: x["t"])
    return F.when(F.size(out) > 0, F.array_join(out, ";"))


def any_flag(*flags: Column) -> Column:
    """OR of the flags that are not null, false without any."""
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags])


def protgroup_refs(df: DataFrame, penalties: DataFrame | None = None, row_col: str = "row_ix") -> DataFrame:
    """(ac, pg_rank, row_ix, ac_rank): the best reference of every accession, majority list 0, all 1.

    ``penalties``: (ac, penalty); an accession without one has the greatest plus 1, or 1 where there are none.
    """
    parts = [df.select(row_col, F.lit(k).alias("pg_rank"), F.explode(literal_split(F.col(c), ";")).alias("ac")) for k, c in enumerate(x for x in ("majority_protein_acs", "protein_acs") if x in df.columns)]
    refs = reduce(DataFrame.unionByName, parts)
    if penalties is None:
        refs = refs.withColumn("ac_rank", F.lit(1).cast("long"))
    else:
        most = F.broadcast(penalties.agg(F.coalesce(F.max("penalty") + 1, F.lit(1)).cast("long").alias("_miss")))  # one row
        refs = refs.join(penalties.select("ac", F.col("penalty").cast("long").alias("_p")), "ac", "left").crossJoin(most).withColumn("ac_rank", F.coalesce("_p", "_miss")).drop("_p", "_miss")
    return refs.groupBy("ac", "pg_rank").agg(F.min(F.struct("ac_rank", F.col(row_col).alias("row_ix"))).alias("b")).select("ac", "pg_rank", "b.row_ix", "b.ac_rank")


def _absorbed(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows (component, id, kept, rowix_*, pgrank_*, acrank_*) folded within components in order of ``id``; kept rows stand before all others."""
    columns = ["id", *[f"{k}_{n}" for n in names for k in ("rowix", "pgrank", "acrank")]]

    refs = [(n, columns.index(f"rowix_{n}")) for n in names]
    schema = pa.schema([(c, pa.int64()) for c in columns])
    ship_package(rows.sparkSession)

    def fold(part: list[tuple]) -> list[tuple]:
        """Rows (id, rowix_*, pgrank_*, acrank_*, kept) of one component, in order."""
        if len(part) == 1:
            return [part[0][:-1]]
        held: list[tuple[int, dict]] = []
        naming: dict[tuple[str, int], list[int]] = {}  # rows that name a group
        for r in part:
            new = {n: r[k : k + 3] for n, k in refs if r[k] is not None}
            absorbed = False
            for at in [] if r[-1] else sorted({k for n, ref in new.items() for k in naming.get((n, ref[0]), ())}):
                old = held[at][1]
                if any(n in old and new[n][0] != old[n][0] for n in new):
                    continue
                absorbed = True
                for n, ref in new.items():
                    if n not in old:
                        old[n] = ref
                        naming.setdefault((n, ref[0]), []).append(at)
                    elif old[n][1] >= ref[1] and old[n][2] >= ref[2]:
                        old[n] = ref
            if not absorbed:
                for n, ref in new.items():
                    naming.setdefault((n, ref[0]), []).append(len(held))
                held.append((r[0], new))
        return [(i, *itertools.chain.from_iterable(x.get(n, (None, None, None)) for n in names)) for i, x in held]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, ["component"]):
            every = zip(*[t[c].to_pylist() for c in ["component", *columns, "kept"]], strict=True)
            out = [x for _, part in itertools.groupby(every, key=lambda r: r[0]) for x in fold([r[1:] for r in part])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    given = rows.select("component", *[F.col(c).cast("long").alias(c) for c in columns], "kept")
    # many components are folded by one task, one after another
    return given.repartition("component").sortWithinPartitions("component", "id").mapInArrow(folded, ", ".join(f"{c} long" for c in columns))


def _tied(rows: DataFrame, names: Sequence[str], groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with the component of rows that name common groups, (component, n)); with ``groups`` (dst) those alone tie."""
    ends = reduce(DataFrame.unionByName, [rows.where(F.col(f"rowix_{n}").isNotNull()).select(F.col("id").alias("src"), F.xxhash64(F.lit(n), f"rowix_{n}").alias("dst")) for n in names])
    if groups is not None:
        ends = ends.join(groups, "dst", "left_semi")
    # rows are even numbers, groups odd ones
    comp = connected_components(ends.select((F.col("src") * 2).alias("src"), F.col("dst").bitwiseOR(1).alias("dst")))
    tied = materialize(rows.join(comp.where("id % 2 = 0").select((F.col("id") / 2).cast("long").alias("id"), "component"), "id"), "tied")
    return tied, materialize(tied.groupBy("component").agg(F.count("*").alias("n")), "sizes")


def absorb(rows: DataFrame, names: Sequence[str], most: int = 100_000) -> DataFrame:
    """Rows (id, rowix_*, pgrank_*, acrank_*) folded in order of ``id`` without a task that holds over about ``most`` rows.

    A row can meet those rows alone with which it is in one component of rows that name common groups, so small components are folded each by
    one task.  Rows of larger ones come in batches of their order.  Within a batch only groups that its rows name tie rows, and of the
    rows kept before only those that name one of these can change: with these the batch falls into components of its own, and
    if one is too large the batch is halved.  What a batch keeps stands before the next.
    """
    rows = rows.withColumn("kept", F.lit(False))
    tied, sizes = _tied(rows, names)
    large = sizes.where(F.col("n") > most).select("component")
    done = _absorbed(tied.join(large, "component", "left_anti"), names)
    if large.isEmpty():
        return done
    waiting = materialize(dense_rank_table(tied.join(large, "component", "left_semi").drop("component"), ["id"], "at", 0), "waiting")
    total, at, batch = waiting.count(), 0, most
    held = materialize(waiting.limit(0).drop("at", "kept"), "held")
    named = lambda df: reduce(DataFrame.unionByName, [df.where(F.col(f"rowix_{n}").isNotNull()).select("id", F.xxhash64(F.lit(n), f"rowix_{n}").alias("dst")) for n in names])
    while at < total:
        own = waiting.where(F.col("at").between(at, at + batch - 1)).drop("at")
        groups = materialize(named(own).select("dst").distinct(), "groups")
        touched = materialize(named(held).join(groups, "dst", "left_semi").select("id").distinct(), "touched")
        before = held.join(touched, "id", "left_semi").withColumn("kept", F.lit(True))
        tied, sizes = _tied(own.unionByName(before), names, groups)
        if batch > 1 and not sizes.where(F.col("n") > most).isEmpty() and tied.where("not kept").count() > 1:
            batch = max(1, batch // 2)
            continue
        held = materialize(held.join(touched, "id", "left_anti").unionByName(_absorbed(tied, names)), "held")
        at += batch
    return done.unionByName(held)


def match_protgroups(datasets: Mapping[str, DataFrame], penalties: DataFrame | None = None, most: int = 100_000) -> DataFrame:
    """N-way matching of protein groups; each dataset has a unique ``row_ix`` and its accession lists.

    References that share (ac, pg_rank, ac_rank) meet in one row; in the order of these three (the reference order
    is that of a hash) a row is absorbed by every row before it that is compatible, and betters its ranks where both are
    no worse; a row is held against those alone that name one of its groups (``absorb``, whose tasks hold about ``most`` rows).  Lists are intersected over
    the references of a list's own rank: majority lists over those of rank 0, others over the best rank.
    """
    names = list(datasets)
    refs = reduce(DataFrame.unionByName, [protgroup_refs(df, penalties).withColumn("ds", F.lit(n)) for n, df in datasets.items()])
    met = refs.groupBy("ac", "pg_rank", "ac_rank").agg(*[F.max(F.when(F.col("ds") == n, F.col("row_ix"))).cast("long").alias(f"rowix_{n}") for n in names])
    ordered = materialize(dense_rank_table(met, ["ac", "pg_rank", "ac_rank"], "id", 0), "crossrefs")
    columns = [f"rowix_{n}" for n in names]
    ranks = [f"{k}_{n}" for n in names for k in ("pgrank", "acrank")]
    ranked = [F.when(F.col(f"rowix_{n}").isNotNull(), F.col(c).cast("long")).alias(f"{k}_{n}") for n in names for k, c in (("pgrank", "pg_rank"), ("acrank", "ac_rank"))]
    folded = absorb(materialize(ordered.select("id", *columns, *ranked), "rows"), names, most).select(*columns, *ranks).dropDuplicates()
    pg, ac = [F.col(f"pgrank_{n}") for n in names], [F.col(f"acrank_{n}") for n in names]
    out = folded.select(best_rank(*pg).alias("best_pg_rank"), worst_rank(*pg).alias("worst_pg_rank"), best_rank(*ac).alias("best_ac_rank"), worst_rank(*ac).alias("worst_ac_rank"), *columns, *ranks)
    # roll up what the datasets say
    everywhere = set.intersection(*[set(d.columns) for d in datasets.values()])
    somewhere = set.union(*[set(d.columns) for d in datasets.values()])
    lists = [c for c in ("majority_protein_acs", "protein_acs", "gene_names", "protein_names", "organism") if c in somewhere]
    flags = [c for c in ("is_contaminant", "is_reverse") if c in somewhere]
    for c in [*lists, *flags]:
        if c not in everywhere:
            warnings.warn(f"{c} is not in all datasets, skipped", stacklevel=2)
    lists, flags = [c for c in lists if c in everywhere], [c for c in flags if c in everywhere]
    for n, df in datasets.items():
        out = out.join(df.select(F.col("row_ix").alias(f"rowix_{n}"), *[F.col(c).alias(f"_{c}_{n}") for c in [*lists, *flags]]), f"rowix_{n}", "left")
    limit = {"majority_protein_acs": F.lit(0), "protein_acs": F.lit(1)}
    best = lambda c: [F.when(F.col(f"pgrank_{n}") <= limit.get(c, F.col("best_pg_rank")), F.col(f"_{c}_{n}")) for n in names]
    result = [F.col(c) for c in out.columns if not c.startswith("_")] + [intersect_lists(*best(c)).alias(c) for c in lists]
    result += [any_flag(*best(c)).alias(c) for c in flags]
    out = out.select(*result)
    return out if penalties is None else reduce(lambda df, c: order_by_penalty(df, columns, c, penalties), [c for c in lists if c.endswith("protein_acs")], out)


def order_by_penalty(df: DataFrame, keys: Sequence[str], list_col: str, penalties: DataFrame) -> DataFrame:
    """``df`` with the tokens of a ";" list in order of (penalty, token), those without a penalty last."""
    tokens = df.select(*keys, F.explode(literal_split(F.col(list_col), ";")).alias("ac")).join(penalties.select("ac", F.col("penalty").cast("double").alias("_p")), "ac", "left")
    items = F.array_sort(F.collect_list(F.struct(F.coalesce("_p", F.lit(float("inf"))).alias("p"), "ac")))
    ordered = tokens.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["ac"]), ";").alias("_ordered"))
    ordered = ordered.select("_ordered", *[F.col(k).alias(f"_{k}") for k in keys])
    met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(ordered, met, "left").withColumn(list_col, F.coalesce("_ordered", list_col)).select(*df.columns)


# --- annotations of sites

def combine_annotations(frames: Mapping[str, DataFrame], values: Mapping[str, Sequence[str]], keys: Sequence[str] = ("protein_ac", "ptm_pos", "ptm_AA", "ptm_code"), order_col: str = "row_ix") -> DataFrame:
    """Site frames joined fully on the keys that they share with what came before.

    Frames named in ``values`` are collapsed to one row per key, their values joined in order of ``order_col``; rows
    with a null key are dropped.
    """
    out, have = None, None
    for name, df in frames.items():
        own = [k for k in keys if k in df.columns]
        part = df.na.drop(subset=own)
        if name in values:
            part = part.groupBy(*own).agg(*[collapse_values(F.col(v), F.col(order_col)).alias(v) for v in values[name]])
        else:
            part = part.select(*own, *[c for c in part.columns if c not in own and c != order_col]).distinct()
        if out is None:
            out, have = part, own
        else:
            on = [k for k in have if k in own]
            out = out.join(part, on, "full")
            have = list(dict.fromkeys([*have, *own]))
    return out


def union_sites(*frames: DataFrame) -> DataFrame:
    """UNION ALL of site sets by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def reference_flag(group: str, rank: str) -> Column:
    """True on the row of least rank of its group."""
    return F.row_number().over(Window.partitionBy(group).orderBy(F.col(rank).asc_nulls_last())) == 1
