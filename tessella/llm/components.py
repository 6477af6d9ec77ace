"""Splits that keep related records together: connected components and hashed split ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import letters_digits
from tessella.plans.materialize import discard, materialize
from tessella.plans.skew import join_to_unique


def _with_minimum(pairs: DataFrame, written: list[DataFrame]) -> DataFrame:
    """(u, v) with the least of u and all its v as ``m``; a node with a third of all edges is pre-aggregated and broadcast.
    What it writes is added to ``written``."""
    pairs = materialize(pairs, "pairs")
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")), "least")
    written += [pairs, least]
    return join_to_unique(pairs, least, ["u"], "degree").withColumn("m", F.least("u", "m"))


def _drop(written: list[DataFrame]) -> None:
    for df in written:
        discard(df)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns u, v): root is the component's smallest node.

    Alternates large-star (a node's larger neighbours are tied to its smallest one) and small-star (its smaller
    neighbours and itself are) until a round changes nothing. Every round is written to the shared folder and the round
    before deleted. Loops, repeats and null ends are ignored. Raises if ``max_rounds`` don't suffice.
    """
    u, v = F.col("u"), F.col("v")
    known = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    now, seen = materialize(known, "edges"), None
    for _ in range(max_rounds):
        written: list[DataFrame] = [now]
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        large = _with_minimum(both, written).where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        tied = _with_minimum(large, written)
        small = tied.where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v")))
        nxt = materialize(small.where(u != v).distinct(), "edges")
        sign = nxt.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        _drop(written)
        now = nxt
        if sign == seen:
            return now.select(u.alias("node"), v.alias("root")).unionByName(now.select(v.alias("node"), v.alias("root")).distinct())
        seen = sign
    raise RuntimeError(f"connected components not settled after {max_rounds} rounds")


def entity_edges(records: DataFrame, entities: list[str]) -> DataFrame:
    """Edges between the entities that one record names: its first known entity with each other one.

    A record is only a hyperedge, so it needs no node: its group is that of any of its entities, and entities with a third
    of all records cost nothing. Entity values are prefixed by their column, so equal values of two columns don't meet.
    """
    named = F.array_compact(F.array(*[F.concat(F.lit(c + "="), F.when(F.col(c) != "", F.col(c).cast("string"))) for c in entities]))
    return (
        records.select(named.alias("n"))
        .where(F.size("n") > 1)
        .select(F.element_at("n", 1).alias("u"), F.explode(F.slice("n", 2, len(entities))).alias("v"))
        .distinct()
    )


def groups_by_entities(records: DataFrame, id_col: str, entities: list[str], links: DataFrame | None = None) -> DataFrame:
    """``record_groups`` over several entities of a record, such as its author and its source: records that share a value of
    any of them belong together. ``links`` ties entities written as column=value."""
    edges = entity_edges(records, entities)
    first = F.coalesce(*[F.concat(F.lit(c + "="), F.nullif(F.col(c).cast("string"), F.lit(""))) for c in entities])
    return record_groups(records.select(id_col, first.alias("_entity")), id_col, "_entity", edges if links is None else edges.unionByName(links))


def record_groups(records: DataFrame, id_col: str, entity: str, links: DataFrame) -> DataFrame:
    """(group_id, id) of every record with an entity: group_id is the smallest id of all records of tied entities, with
    ``group_size``.

    ``links`` (u, v) ties entities. Null and empty entities form no group and come out not at all. Ties by links to entities
    without records still carry over to others.
    """
    slim = records.select(F.col(id_col).alias("id"), F.col(entity).alias("node")).where(F.col("node") != "")
    own = materialize(slim.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "own")
    roots = materialize(connected_components(links), "roots")
    tied = own.join(roots, "node")
    merged = tied.groupBy("root").agg(F.min("least").alias("_least"), F.sum("n").alias("_n"))
    groups = materialize(
        own.join(roots.join(merged, "root").drop("root"), "node", "left").select(
            "node", "n", F.coalesce("_least", "least").alias("group_id"), F.coalesce("_n", "n").alias("group_size")
        ),
        "groups",
    )
    return join_to_unique(slim, groups, ["node"], "n").select("group_id", "id", "group_size")


def account_links(links: DataFrame, a: str = "author_id_a", b: str = "author_id_b") -> DataFrame:
    """Links of accounts as edges of their letters and digits; a link with an empty end ties nothing."""
    e = links.select(letters_digits(F.col(a)).alias("u"), letters_digits(F.col(b)).alias("v"))
    return e.where((F.col("u") != "") & (F.col("v") != ""))


PLACES = 16**4


def _place(c) -> Column:
    """A group's place in the hash order: the first four hexadecimal digits of the md5 of its id, below ``PLACES``."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 4), 16, 10).cast("int")


def assign_splits(
    groups: DataFrame, targets: list[tuple[str, float]], label: str | None = None, giant_share: float = 0.001
) -> DataFrame:
    """(group_id, split_name) of every group, whole groups only, in the given proportions of records.

    ``groups`` has group_id, size and, for ``label``, the number of records with a positive label. The hash of the group's
    id falls into ranges, cut where the records counted in hash order reach the proportions. Groups with over ``giant_share`` of all records (at most ``1 / giant_share`` of them)
    would throw these off: they are first given, largest first, to the split that most lacks records and positives, and the
    ranges of the others are what the splits then lack. Proportions are normalised; no target gives an error.
    """
    spark = groups.sparkSession
    total = sum(p for _, p in targets)
    if not targets or total <= 0:
        raise ValueError("split targets must have a positive sum")
    shares = {name: p / total for name, p in targets}
    pos = F.col(label) if label else F.lit(0)
    n_all, pos_all = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(pos), F.lit(0))).first()
    giants = groups.where(F.col("size") > F.lit(n_all * giant_share)).select("group_id", "size", pos.alias("pos")).collect()
    lack = {name: [s * n_all, s * pos_all] for name, s in shares.items()}
    placed = []
    for g in sorted(giants, key=lambda g: (-g["size"], g["group_id"])):
        need = lambda k: (lack[k][0] / (n_all or 1)) + (lack[k][1] / (pos_all or 1)) * 0.5
        name = max(lack, key=lambda k: (need(k), shares[k]))
        lack[name][0] -= g["size"]
        lack[name][1] -= g["pos"]
        placed.append((g["group_id"], name))
    rest = {k: max(0.0, v[0]) for k, v in lack.items()}
    whole = sum(rest.values()) or 1.0
    fixed = spark.createDataFrame(placed, "group_id long, _fixed string")
    marked = groups.join(F.broadcast(fixed), "group_id", "left").withColumn("_f", _place(F.col("group_id")))
    counted = {r["_f"]: r["n"] for r in marked.where(F.col("_fixed").isNull()).groupBy("_f").agg(F.sum("size").alias("n")).collect()}  # PLACES rows at most
    upto, ends, want, at = 0.0, [], 0.0, 0
    for name, left in rest.items():
        want += sum(counted.values()) * left / whole
        while at < PLACES and upto + counted.get(at, 0) / 2 <= want:
            upto += counted.get(at, 0)
            at += 1
        ends.append((name, at))
    last = max(shares, key=lambda k: (shares[k], k))
    split = reduce(lambda other, e: F.when(F.col("_f") < e[1], F.lit(e[0])).otherwise(other), reversed(ends), F.lit(last))
    return marked.select("group_id", F.coalesce("_fixed", split).alias("split_name"))


def split_records(records: DataFrame, id_col: str, entity: str, links: DataFrame, targets: list[tuple[str, float]], positive: Column) -> DataFrame:
    """(id, group_id, split_name) of every record; one without an entity is a group of its own."""
    keyed = record_groups(records, id_col, entity, links)
    marked = records.select(F.col(id_col).alias("id"), positive.cast("int").alias("pos"))
    whole = materialize(
        marked.join(keyed.drop("group_size"), "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("pos", F.lit(0)).alias("pos")),
        "records",
    )
    groups = materialize(whole.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.sum("pos").alias("positives")), "sizes")
    given = assign_splits(groups, targets, "positives")
    named = materialize(groups.join(given, "group_id"), "named").select("group_id", "size", "split_name")
    return join_to_unique(whole, named, ["group_id"], "size").select("id", "group_id", "split_name")
