"""Taking other machines' decisions into a ledger, package by package in the order of their arrival.

All rows of one package are held against the ledger as it was before the package, so a package is one set of joins; what it
leaves behind is what the next one meets. Groups are components of confirmed relations.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import matching

Cut = Callable[[DataFrame], DataFrame]


@dataclass
class Ledger:
    """relations: relation, machine, confirmed, member, version. alone: member, version, machine. apart: a, b, machine. Where a package was taken
    in, kept (member, root) is what it left of the groups before, and fresh are the relations adopted from it."""

    relations: DataFrame
    alone: DataFrame
    apart: DataFrame
    kept: DataFrame | None = None
    fresh: DataFrame | None = None


def groups(relations: DataFrame, cut: Cut) -> DataFrame:
    """member, root: members that confirmed relations join, directly or by others; a member of no other is its own root."""
    links = relations.where("confirmed").withColumn("first", F.min("member").over(Window.partitionBy("relation"))).select(F.col("first").alias("a"), F.col("member").alias("b"))
    return matching.components(links, cut).select(F.col("node").alias("member"), "root")


def grouped(local: Ledger, cut: Cut) -> DataFrame:
    """The groups of a ledger. An adopted relation meets no group that stays but one of just its members, so the groups that stay are
    what they were, and only adopted relations are joined anew."""
    if local.kept is None:
        return groups(local.relations, cut)
    return cut(local.kept.union(groups(local.fresh, cut)).distinct())


def _set(member: str | Column) -> Column:
    return F.array_sort(F.collect_set(member))


def take_in(local: Ledger, package: Ledger, source: str, cut: Cut, last: bool = False) -> tuple[DataFrame, Ledger]:
    """What becomes of each row of a machine's package (kind, id, verdict), and the ledger after it.

    A relation is ``known`` if the ledger has it with the same evidence; a conflict ``confirm_vs_withdraw`` if it joins two members of a
    relation that was withdrawn, ``group_vs_exclusion`` if it would close an excluded pair in, ``different_groups`` if it meets a
    group, or a member that stands alone, with other members; else ``adopted``. What only the machine itself said before gives way to what it
    says now instead of being a conflict. Members that stand alone and excluded pairs likewise. Unconfirmed relations aren't taken. After the ``last`` package the ledger is only
    worked out if somebody reads it. A relation's name is its own: no other relation of the ledger has it."""
    of = grouped(local, cut)
    held = cut(local.relations.where("confirmed").join(of, "member").select("relation", "machine", "root").distinct())
    sole = held.groupBy("root").agg(F.min("machine").alias("low"), F.max("machine").alias("high"))
    facts = of.groupBy("root").agg(F.count("member").alias("size")).join(sole, "root").select("root", "size", F.when(F.col("low") == F.col("high"), F.col("low")).alias("machine"))
    single = local.alone.join(of, "member", "left_anti").select("member", F.lit(None).cast("long").alias("root"), F.lit(1).cast("long").alias("size"), "machine")
    units = cut(of.join(facts, "root").select("member", "root", "size", "machine").union(single))
    inside = units.where("root IS NOT NULL")
    theirs = F.coalesce(F.col("machine") == source, F.lit(False))

    # each member beside the unit that it lies in: a group by its root, a member that stands alone by itself
    new = cut(package.relations.where("confirmed").select("relation", "member", "version").join(units, "member", "left"))
    named = cut(new.groupBy("relation").agg(_set(F.struct("member", "version")).alias("key"), F.countDistinct("member").alias("n")))
    have = local.relations.where("confirmed").groupBy("relation").agg(_set(F.struct("member", "version")).alias("key")).select("key").distinct()
    known = named.join(have, "key", "left_semi").select("relation")
    withdrawn = new.select("relation", "member").join(local.relations.where("NOT confirmed").select("member", F.col("relation").alias("other")), "member").groupBy("relation", "other").agg(F.countDistinct("member").alias("n")).where("n >= 2").select("relation")
    met = new.where("size IS NOT NULL").groupBy("relation", "root", F.when(F.col("root").isNull(), F.col("member")).alias("own"), "size", "machine").agg(F.countDistinct("member").alias("both"))
    met = cut(met.join(named.select("relation", "n"), "relation").where("both <> size OR both <> n"))
    clash = met.where(~theirs).select("relation")
    # a relation reaches an end of an excluded pair if it has a member in the end's unit; a group's root is one of its members
    reached = new.select("relation", F.coalesce("root", "member").alias("unit")).distinct()
    ends = local.apart.join(of.select(F.col("member").alias("a"), F.col("root").alias("ra")), "a", "left").join(of.select(F.col("member").alias("b"), F.col("root").alias("rb")), "b", "left")
    ends = ends.where("ra IS NULL OR rb IS NULL OR ra <> rb").select("a", "b", "machine", F.coalesce("ra", "a").alias("ua"), F.coalesce("rb", "b").alias("ub"))
    closed = cut(ends.join(reached.withColumnRenamed("unit", "ua"), "ua").join(reached.withColumnRenamed("unit", "ub"), ["relation", "ub"]).select("relation", "a", "b", "machine"))
    broken = closed.where(~theirs).select("relation")
    # the first that holds
    said = ["known", "confirm_vs_withdraw", "group_vs_exclusion", "different_groups", "adopted"]
    flags = functools.reduce(DataFrame.union, (some.select("relation", F.lit(k).alias("k")) for k, some in enumerate((known, withdrawn, broken, clash, named))))
    relations = cut(flags.groupBy("relation").agg(F.min("k").alias("k")).select("relation", F.element_at(F.array(*map(F.lit, said)), F.col("k") + 1).alias("verdict")))
    adopted = relations.where("verdict = 'adopted'").select("relation")

    stands = package.alone.select("member", "version")
    before = local.alone.select("member", F.col("version").alias("old"), F.col("machine").alias("by"))
    stands = stands.join(before, "member", "left").join(inside, "member", "left")
    same = F.coalesce(F.col("old") == F.col("version"), F.lit(False))
    other = (F.col("by").isNotNull() & (F.col("by") != source)) | (F.col("root").isNotNull() & (F.col("size") > 1) & ~theirs)
    stands = cut(stands.select("member", "version", "root", "size", F.when(same, "known").when(other, "different_groups").otherwise("adopted").alias("verdict")))

    pairs = package.apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    mine = local.apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("known")).distinct()
    ra, rb = inside.select(F.col("member").alias("a"), F.col("root").alias("ra"), "machine"), of.select(F.col("member").alias("b"), F.col("root").alias("rb"))
    pairs = pairs.join(mine, ["a", "b"], "left").join(ra, "a", "left").join(rb, "b", "left").withColumn("root", F.when(F.col("ra") == F.col("rb"), F.col("ra")))
    pairs = cut(pairs.select("a", "b", "root", F.when(F.col("known"), "known").when(F.col("root").isNotNull() & ~theirs, "group_vs_exclusion").otherwise("adopted").alias("verdict")))

    # what gives way
    keep = (lambda df: df) if last else cut
    roots = met.join(adopted, "relation", "left_semi").where(theirs & F.col("root").isNotNull()).select("root")
    roots = roots.union(stands.where("verdict = 'adopted' AND root IS NOT NULL AND size > 1").select("root")).union(pairs.where("verdict = 'adopted' AND root IS NOT NULL").select("root"))
    roots = keep(roots.distinct())
    gone = held.join(roots, "root", "left_semi").select("relation").distinct()
    lone = met.join(adopted, "relation", "left_semi").where(theirs & F.col("own").isNotNull()).select(F.col("own").alias("member"))
    lone = lone.union(stands.where("verdict = 'adopted'").select("member")).distinct()
    freed = closed.join(adopted, "relation", "left_semi").where(theirs).select("a", "b").distinct()
    fresh = keep(package.relations.where("confirmed").join(adopted, "relation", "left_semi").select("relation", F.lit(source).alias("machine"), "confirmed", "member", "version"))
    after = Ledger(
        keep(local.relations.join(gone, "relation", "left_anti").select("relation", "machine", "confirmed", "member", "version").union(fresh)),
        keep(local.alone.join(lone, "member", "left_anti").select("member", "version", "machine").union(stands.where("verdict = 'adopted'").select("member", "version", F.lit(source)))),
        keep(local.apart.join(freed, ["a", "b"], "left_anti").select("a", "b", "machine").union(pairs.where("verdict = 'adopted'").select("a", "b", F.lit(source)))),
        of.join(roots, "root", "left_anti").select("member", "root"), fresh,
    )
    rows = relations.select(F.lit("relation").alias("kind"), F.col("relation").alias("id"), "verdict").union(stands.select(F.lit("alone"), F.col("member").cast("string"), "verdict"))
    return rows.union(pairs.select(F.lit("apart"), F.concat_ws("|", "a", "b"), "verdict")), after
