"""Groups by merchant codes, beside groups of human hand and pairs that must stay apart.

Members come in an order, and one that was placed earlier can keep a later one out. Only excluded pairs carry that, so
nothing is walked one by one: members are decided in rounds, each round those that no undecided earlier one is excluded
with. There are as many rounds as the longest chain of excluded pairs in the order, and only members in such chains take part
after the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Cut = Callable[[DataFrame], DataFrame]


def _apart(pairs: DataFrame) -> DataFrame:
    """(m, e), both ways round."""
    return pairs.select(F.col("a").alias("m"), F.col("b").alias("e")).union(pairs.select("b", "a")).where("m <> e").distinct()


def place_by_codes(members: DataFrame, anchors: DataFrame, pairs: DataFrame, cut: Cut) -> DataFrame:
    """m, state, grp for each member outside the anchors.

    members: m (their order, unique), code. anchors: m, grp (its group), closed (of excluded members: nobody joins). pairs: a, b.
    A group has the codes that its own members have; who joins it adds none. A member with a code that one group has,
    none of whose members, joined ones included, is excluded with it, joins it (``code_rule``, grp as given); with several such
    groups it waits alone (``pending_candidates``). Else it joins the newest group that was begun for its code, or begins
    one if that has a member that it is excluded with (``code_rule``, grp: -1 - its first member). Without a code it is alone
    (``unjudged``)."""
    apart = cut(_apart(pairs))
    free = cut(members.join(anchors.select("m"), "m", "left_anti"))
    open_ = anchors.where("NOT closed").join(members, "m")
    coded = cut(open_.where("code IS NOT NULL").select("code", "grp").distinct())
    # how many groups have a code, and the sum of their ids: less the barred ones, the sum names the only one left
    offers = coded.groupBy("code").agg(F.count("grp").alias("groups"), F.sum("grp").alias("ids"))
    todo = cut(free.where("code IS NOT NULL").join(offers, "code", "left").select("m", "code", F.coalesce("groups", F.lit(0)).alias("groups"), F.coalesce("ids", F.lit(0)).alias("ids")))
    # bars: groups with a member that m is excluded with, of the code of m
    bars = cut(todo.join(apart, "m").join(anchors.where("NOT closed").select(F.col("m").alias("e"), "grp"), "e").select("m", "code", "grp").join(coded, ["code", "grp"], "left_semi").select("m", "grp").distinct())
    wants = todo.where("groups > 0").select("m")
    earlier = cut(apart.where("e < m").join(wants, "m", "left_semi").join(wants.withColumnRenamed("m", "e"), "e", "left_semi"))
    done = None
    chained = earlier.select("m").distinct()
    left = cut(todo.join(chained, "m", "left_semi"))
    now = todo.join(chained, "m", "left_anti")
    while True:
        barred = bars.join(now.select("m"), "m", "left_semi").groupBy("m").agg(F.count("grp").alias("n"), F.sum("grp").alias("s"))
        fit = F.col("groups") - F.coalesce("n", F.lit(0))
        step = cut(now.join(barred, "m", "left").select("m", "code", F.when(fit == 1, "joined").when(fit > 1, "waits").otherwise("own").alias("how"), F.when(fit == 1, F.col("ids") - F.coalesce("s", F.lit(0))).alias("grp")))
        done = step if done is None else done.union(step)
        if not left.limit(1).count():
            break
        # who joined a group now bars those that are excluded with them from it
        new = earlier.join(step.where("how = 'joined'").select(F.col("m").alias("e"), "grp"), "e").join(left.select("m", "code"), "m").join(coded, ["code", "grp"], "left_semi").select("m", "grp")
        bars = cut(bars.union(new).distinct())
        waiting = earlier.join(left.select("m"), "m", "left_semi").join(left.select(F.col("m").alias("e")), "e", "left_semi").select("m").distinct()
        now, left = cut(left.join(waiting, "m", "left_anti")), cut(left.join(waiting, "m", "left_semi"))
    done = cut(done)
    own = _runs(done.where("how = 'own'").select("m", "code"), apart, cut)
    placed = done.where("how = 'joined'").select("m", F.lit("code_rule").alias("state"), "grp")
    placed = placed.union(done.where("how = 'waits'").select("m", F.lit("pending_candidates"), -1 - F.col("m")))
    return placed.union(own.select("m", F.lit("code_rule"), -1 - F.col("first"))).union(free.where("code IS NULL").select("m", F.lit("unjudged"), -1 - F.col("m")))


def _runs(rows: DataFrame, apart: DataFrame, cut: Cut) -> DataFrame:
    """m, first: members of a code in order, cut into runs without an excluded pair, each as long as it can be; first is
    the run's first member. A run that begins at s ends before the first member whose latest excluded partner lies at s or after it,
    so the next beginning is a function of s, and those that are reached from the first member are found by doubling jumps."""
    rows = cut(rows)
    late = apart.where("e < m").join(rows, "m").join(rows.select(F.col("m").alias("e"), "code"), ["e", "code"]).groupBy("code", "m").agg(F.max("e").alias("at"))
    late = cut(late)
    firsts = rows.groupBy("code").agg(F.min("m").alias("s"))
    if not late.limit(1).count():
        return rows.join(firsts, "code").select("m", F.col("s").alias("first"))
    starts = firsts.join(late.select("code"), "code", "left_semi")
    points = late.select("code", F.col("at").alias("place"), F.col("m").alias("next"), F.lit(None).cast("long").alias("s"))
    points = points.union(starts.union(late.select("code", F.col("m").alias("s"))).distinct().select("code", F.col("s").alias("place"), F.lit(None).cast("long"), "s"))
    after = Window.partitionBy("code").orderBy(F.desc("place")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    jumps = cut(points.withColumn("to", F.min("next").over(after)).where("s IS NOT NULL AND to IS NOT NULL").select("s", "to"))
    reached, n = cut(starts.select("s")), 0
    while n < (n := reached.count()):
        reached = cut(reached.union(reached.join(jumps, "s").select(F.col("to").alias("s"))).distinct())
        ahead = jumps.select(F.col("s").alias("to"), F.col("to").alias("further"))
        jumps = cut(jumps.join(ahead, "to").select("s", F.col("further").alias("to")))
    so_far = Window.partitionBy("code").orderBy("m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.join(reached.union(firsts.select("s")).distinct().withColumnRenamed("s", "m").withColumn("begins", F.lit(True)), "m", "left")
    return marked.withColumn("first", F.max(F.when(F.col("begins"), F.col("m"))).over(so_far)).select("m", "first")


def _alone(members: DataFrame, groups: DataFrame, pairs: DataFrame, barred: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Members that are alone (m, code), groups that anyone may join (grp, human, waits), those among them of human hand by the codes that they
    have (code, grp), and the groups that each member is kept out of by an excluded pair (m, grp)."""
    of = groups.join(members.select("m", "code", "waits"), "m").join(barred.withColumn("out", F.lit(True)), "m", "left")
    fit = of.groupBy("grp").agg(F.max("human").alias("human"), F.max("closed").alias("closed"), F.max(F.coalesce("out", F.lit(False))).alias("out"), F.max("waits").alias("waits")).where("NOT closed AND NOT out")
    single = members.where("alone").join(barred, "m", "left_anti").join(groups.where("human").select("m"), "m", "left_anti").select("m", "code")
    coded = of.where("code IS NOT NULL").select("code", "grp").distinct().join(fit.where("human"), "grp", "left_semi").select("code", "grp")
    against = _apart(pairs).join(groups.select(F.col("m").alias("e"), "grp"), "e").select("m", "grp").distinct()
    return single, fit, coded, against


def legal_groups(members: DataFrame, groups: DataFrame, pairs: DataFrame, barred: DataFrame) -> DataFrame:
    """m, grp: groups that members which are alone may join. members: m, code, waits (several groups have its code), alone. groups: m,
    grp, human, closed. barred: m, excluded members.

    Not one with an excluded member or one that it is excluded with, nor a closed one. A member with a code joins a human
    group that has it; one without joins groups without a waiting member. Pairs are made only where a code is shared; a
    member without a code may join any other group, so these are told by what keeps them out: grp is null once for each such member, and its
    barred groups follow with the sign turned."""
    single, fit, coded, against = _alone(members, groups, pairs, barred)
    named = single.join(coded, "code").select("m", "grp").join(against, ["m", "grp"], "left_anti")
    free = single.where("code IS NULL").select("m")
    return named.union(free.select("m", F.lit(None).cast("long"))).union(free.join(against, "m").join(fit.where("NOT waits"), "grp", "left_semi").select("m", -F.col("grp")))


def legal_counts(members: DataFrame, groups: DataFrame, pairs: DataFrame, barred: DataFrame) -> DataFrame:
    """m, n: how many groups each member that is alone may join, by the rules of ``legal_groups``: those of its code, or all others if it has
    none, less those that it is kept out of. Only excluded pairs are joined, so a code that many members and groups share makes no pairs."""
    single, fit, coded, against = _alone(members, groups, pairs, barred)
    open_ = fit.where("NOT waits").select("grp")
    out = single.join(against, "m")
    lost = out.where("code IS NOT NULL").join(coded, ["code", "grp"], "left_semi").select("m", "grp").union(out.where("code IS NULL").join(open_, "grp", "left_semi").select("m", "grp"))
    lost = lost.groupBy("m").agg(F.count("grp").alias("lost"))
    # its own group is among those that a member without a code finds
    every = single.join(coded.groupBy("code").agg(F.count("grp").alias("n")), "code").select("m", "n").union(single.where("code IS NULL").crossJoin(open_.agg((F.count("grp") - 1).alias("n"))).select("m", "n"))
    return every.join(lost, "m", "left").select("m", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n"))
