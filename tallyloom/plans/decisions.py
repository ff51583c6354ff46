"""Decisions on groups: replay onto new evidence, write-back, merging of ledgers, placement by codes and pictures.

Relations are sets of members that some machine holds together, each with the version of the evidence it saw. Groups
are components over them, found by label moves on Spark; nothing walks relations one after another. Each query's SQL
follows another way (recursive reach, lists) than its plan.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import grouping, ledger, matching
from tallyloom.plans.adapter import Views, duck
from tallyloom.plans.shared import cut, few


def intact(v: Views) -> DataFrame:
    """Members whose evidence is still what the relation saw."""
    current = v["products"].select(F.col("ordinal").alias("member"), F.concat_ws("/", "name", F.col("image").cast("string")).alias("version"))
    return v["relations"].join(current, ["member", "version"], "left_semi")


def rooted(rows: DataFrame) -> DataFrame:
    """member, root: members that relations join, directly or by others. rows: relation, member."""
    links = rows.withColumn("first", F.min("member").over(Window.partitionBy("relation"))).select(F.col("first").alias("a"), F.col("member").alias("b"))
    return matching.components(links, cut).select(F.col("node").alias("member"), "root")


def replay(v: Views) -> DataFrame:
    """ordinal, state, root, machine: confirmed groups before pending ones, others open; the machine is that of the
    group's first relation."""
    rows, sides = cut(intact(v)), []
    for state, which in (("confirmed", F.col("confirmed")), ("pending", ~F.col("confirmed"))):
        some = rows.where(which)
        roots = rooted(some)
        machines = some.join(roots, "member").groupBy("root").agg(F.min_by("machine", "relation").alias("machine"))
        sides.append(roots.join(machines, "root").select("member", F.lit(state).alias("state"), "root", "machine"))
    first = sides[0].union(sides[1]).groupBy("member").agg(F.min(F.struct("state", "root", "machine")).alias("s")).select("member", "s.*")
    return v["products"].join(first, F.col("ordinal") == F.col("member"), "left").select("ordinal", F.coalesce("state", F.lit("open")).alias("state"), F.coalesce("root", "ordinal").alias("root"), F.coalesce("machine", F.lit("")).alias("machine"))


def _joined(members: str | Column, distinct: bool = True) -> Column:
    return F.array_join(F.array_sort((F.collect_set if distinct else F.collect_list)(members)), ",")


def information_changed(v: Views) -> DataFrame:
    """Products that were recorded, but never with the evidence they have now."""
    seen = v["relations"].groupBy("member").agg(F.collect_set("version").alias("seen"))
    return v["products"].join(seen, F.col("ordinal") == F.col("member")).select("ordinal", (~F.array_contains("seen", F.concat_ws("/", "name", F.col("image").cast("string")))).alias("changed"))


def write_back(v: Views) -> DataFrame:
    """What is saved of each confirmed group: its members of now but those that were moved away, and members of its
    relations that this analysis doesn't have."""
    rows = cut(intact(v).where("confirmed"))
    of = cut(rooted(rows))
    present = of.where("member % 17 <> 0")
    touched = rows.join(of, "member").select("relation", "root").distinct()
    absent = v["relations"].where("confirmed").join(v["products"].select(F.col("ordinal").alias("member")), "member", "left_anti").join(touched, "relation").select("member", "root")
    return present.union(absent).groupBy("root").agg(_joined(F.col("member")).alias("members"), F.countDistinct("member").alias("n"))


def group_conflicts(v: Views) -> DataFrame:
    """Groups with members that relations of several machines claim, and who they are."""
    claimed = v["relations"].where("confirmed").groupBy("member").agg(F.countDistinct("machine").alias("machines")).where("machines > 1")
    return claimed.join(replay(v), F.col("ordinal") == F.col("member")).groupBy("root").agg(F.count("member").alias("conflicts"), _joined(F.col("member")).alias("members"))


def saved_groups(v: Views) -> DataFrame:
    """A saved confirmation holds only if its members are just those of a group of now, all with the same evidence."""
    now = replay(v).where("state <> 'open'").groupBy("root").agg(_joined(F.col("ordinal")).alias("members"))
    good = intact(v).groupBy("relation").agg(F.count("member").alias("n_intact"))
    saved = v["relations"].where("confirmed").groupBy("relation").agg(_joined(F.col("member")).alias("members"), F.count("member").alias("n"))
    joined = saved.join(good, "relation", "left").join(now, "members", "left")
    return joined.groupBy("relation").agg((F.max("n") == F.coalesce(F.max("n_intact"), F.lit(0))).alias("unchanged"), F.max(F.col("root").isNotNull()).alias("same_members")).select("relation", "unchanged", "same_members", (F.col("unchanged") & F.col("same_members")).alias("holds"))


def ledger_merge(v: Views, source: str = "m3") -> DataFrame:
    """What becomes of each confirmed relation of a machine that is taken in by the others' ledger: known (same
    members), a conflict with a withdrawal (two members in common), with an exclusion that it would close in, or with
    another group; else adopted. All are held against the ledger as it was."""
    every = v["relations"]
    local, new = cut(every.where(F.col("machine") != source)), cut(every.where((F.col("machine") == source) & F.col("confirmed")).select("relation", "member", "version"))
    key = lambda df: df.groupBy("relation").agg(_joined(F.concat_ws("=", F.col("member").cast("string"), "version")).alias("key"), F.count("member").alias("n"))
    names = key(new)
    known = names.join(key(local.where("confirmed")).select("key").distinct(), "key", "left_semi").select("relation")
    withdrawn = new.join(local.where("NOT confirmed").select("member", F.col("relation").alias("other")), "member").groupBy("relation", "other").count().where("count >= 2").select("relation").distinct()
    groups = cut(rooted(local.where("confirmed")))
    sizes = groups.groupBy("root").agg(F.count("member").alias("size"))
    met = new.join(groups, "member").groupBy("relation", "root").agg(F.count("member").alias("common")).join(sizes, "root").join(names.select("relation", "n"), "relation")
    clash = met.where("common <> size OR common <> n").select("relation").distinct()
    # an end of an exclusion is reached by a relation as its member, or by a group that it meets
    side = lambda x, end: new.select("relation", F.col("member").alias(end)).union(met.select("relation", "root").join(groups, "root").select("relation", F.col("member").alias(end))).distinct()
    pairs = v["exclusions"].join(groups.select(F.col("member").alias("a"), F.col("root").alias("ra")), "a", "left").join(groups.select(F.col("member").alias("b"), F.col("root").alias("rb")), "b", "left").where("ra IS NULL OR rb IS NULL OR ra <> rb")
    broken = pairs.join(side(new, "a"), "a").join(side(new, "b"), ["b", "relation"]).select("relation").distinct()
    flags = names
    for name, some in (("known", known), ("withdrawn", withdrawn), ("broken", broken), ("clash", clash)):
        flags = flags.join(some.withColumn(name, F.lit(True)), "relation", "left")
    verdict = F.when(F.col("known"), "known").when(F.col("withdrawn"), "confirm_vs_withdraw").when(F.col("broken"), "group_vs_exclusion").when(F.col("clash"), "different_groups").otherwise("adopted")
    return flags.select("relation", verdict.alias("verdict"))


#: Machines whose packages arrive, in order; the last one says less than the first time.
_ARRIVALS = ("m2", "m3", "m2")


def ledger_rounds(v: Views) -> DataFrame:
    """Packages taken into the first machine's ledger one after another, each held against what the ones before left: what
    becomes of every row."""
    n = int(v.spark.conf.get("spark.sql.shuffle.partitions"))  # a small file is one task
    rows = ledger.Ledger(*(cut(v[name].repartition(n, key)) for name, key in (("relations", "member"), ("alone_members", "member"), ("machine_exclusions", "a"))))
    of = lambda machine: ledger.Ledger(*(x.where(F.col("machine") == machine) for x in (rows.relations, rows.alone, rows.apart)))
    now, said = of("m1"), []
    for turn, machine in enumerate(_ARRIVALS, 1):
        package = of(machine)
        package.relations = package.relations.withColumn("relation", F.concat(F.lit(f"{turn}."), "relation"))
        if turn > len(set(_ARRIVALS)):
            package.relations = package.relations.where("member % 4 <> 1")
        verdicts, now = ledger.take_in(now, package, machine, cut, last=turn == len(_ARRIVALS))
        said.append(verdicts.select(F.lit(turn).cast("long").alias("turn"), "kind", "id", "verdict"))
    return functools.reduce(DataFrame.union, said)


def sku_ledger_merge(v: Views) -> DataFrame:
    """Relations by first arrival: of equal member sets the first machine's stays, its own later ones give way; a set
    that overlaps an earlier one of another machine is a conflict."""
    sets = cut(v["relations"].groupBy("relation", "machine").agg(_joined(F.col("member")).alias("members"), F.min("member").alias("low")))
    order = Window.partitionBy("members").orderBy("relation")
    placed = sets.withColumn("nth", F.row_number().over(order)).withColumn("owner", F.first("machine").over(order))
    each = v["relations"].select("relation", "member", "machine").join(placed.select("relation", "members"), "relation")
    # over each member: is there an earlier relation of another machine and other members?
    before = Window.partitionBy("member").orderBy("relation").rowsBetween(Window.unboundedPreceding, -1)
    met = each.withColumn("earlier", F.collect_set(F.struct("machine", "members")).over(before))
    met = met.groupBy("relation").agg(F.max(F.exists("earlier", lambda e: (e["machine"] != F.col("machine")) & (e["members"] != F.col("members")))).alias("overlaps"))
    state = F.when((F.col("nth") > 1) & (F.col("owner") == F.col("machine")), "superseded").when(F.col("nth") > 1, "kept_first").when(F.col("overlaps"), "conflict").otherwise("taken")
    return placed.join(met, "relation").select("relation", state.alias("state"))


def _anchored(v: Views) -> DataFrame:
    """m, grp, closed: members of confirmed groups, and excluded members on their own, whom nobody joins."""
    out = v["excluded_members"].withColumn("out", F.lit(True))
    played = replay(v).select(F.col("ordinal").alias("m"), "state", "root").join(out, "m", "left")
    sizes = F.count("m").over(Window.partitionBy("root"))
    human = played.where("state = 'confirmed'").select("m", F.col("root").alias("grp"), (F.col("out").isNotNull() & (sizes == 1)).alias("closed"))
    return human.union(played.where("state <> 'confirmed' AND out").select("m", "m", F.lit(True)))


def code_placement(v: Views) -> DataFrame:
    """Members outside groups of human hand, in order: with a code that one group has they join it, with a code that several
    have they wait, else they join the newest group that was begun for their code, or begin one; never with a member that they
    are excluded with. Without a code they stay alone."""
    members = v["coded"].select(F.col("ordinal").alias("m"), "code")
    placed = grouping.place_by_codes(members, _anchored(v), v["code_exclusions"], cut)
    return placed.select(F.col("m").alias("ordinal"), "state", F.when(F.col("grp") < 0, -1 - F.col("grp")).otherwise(F.col("grp")).alias("grp"))


def picture_placement(v: Views) -> DataFrame:
    """Open products by judged pairs: they go to the only group with a positive judgment and no negative one; with
    several such groups they wait. All are decided on the groups as they were."""
    from tallyloom.plans.matching_queries import _edges

    edges, of = cut(_edges(v)), cut(replay(v))
    turned = lambda df: df.select("a", "b").union(df.select("b", "a"))
    single = of.where("state = 'open'").select(F.col("ordinal").alias("a"))
    met = lambda rows: few(rows).join(of.where("state = 'confirmed'").select(F.col("ordinal").alias("b"), "root"), "b").select("a", "root").distinct()
    # negative judgments count only for those with a positive one, so the others are neither turned nor joined
    good = few(met(single.join(few(turned(edges.where("positive"))), "a")))
    bad = met(turned(edges.where("NOT positive")).join(few(good.select("a").distinct()), "a", "left_semi"))
    found = few(good.join(bad, ["a", "root"], "left_anti").groupBy("a").agg(F.count("root").alias("n"), F.min("root").alias("root")))
    return single.join(found, "a", "left").select(F.col("a").alias("ordinal"), F.when(F.col("n") == 1, "placed").when(F.col("n") > 1, "pending").otherwise("alone").alias("state"), F.when(F.col("n") == 1, F.col("root")).alias("grp"))


def candidate_groups(v: Views) -> DataFrame:
    """How many groups a product that is alone may join: with a code, human groups that have it; without one, all but those
    with a waiting member; none with an excluded member or one that it is excluded with, and none that is closed."""
    anchored, placed = cut(_anchored(v)), cut(code_placement(v))
    made = placed.select(F.col("ordinal").alias("m"), "grp", F.lit(False).alias("human"), F.lit(False).alias("closed"))
    groups = cut(anchored.select("m", "grp", F.lit(True).alias("human"), "closed").union(made.join(anchored.select("grp").distinct(), "grp", "left_anti").select("m", "grp", "human", "closed")).union(made.join(anchored.select("grp", "closed").distinct(), "grp", "left_semi").select("m", "grp", F.lit(True), F.lit(False))))
    alone = groups.groupBy("grp").agg(F.max("m").alias("m"), F.count("m").alias("n"), F.max("human").alias("human")).where("n = 1 AND NOT human").select("m", F.lit(True).alias("alone"))
    waits = placed.select(F.col("ordinal").alias("m"), (F.col("state") == "pending_candidates").alias("waits"))
    members = cut(v["coded"].select(F.col("ordinal").alias("m"), "code").join(waits, "m", "left").join(alone, "m", "left").na.fill({"waits": False, "alone": False}))
    found = grouping.legal_counts(members, groups, v["code_exclusions"], v["excluded_members"])
    return found.where("n > 0").select(F.col("m").alias("ordinal"), "n")


def legal_pairs(v: Views) -> DataFrame:
    """Recalled pairs that may be judged: neither item excluded, not an excluded pair, not both with a code."""
    from tallyloom.plans.matching_queries import _edges

    out = v["labels"].where("quality = 0").select("doc_id")
    coded = v["coded"].select("ordinal", F.col("code").isNotNull().alias("has"))
    rows = _edges(v).select("a", "b")
    for end in ("a", "b"):
        rows = rows.join(out.select(F.col("doc_id").alias(end)), end, "left_anti").join(coded.select(F.col("ordinal").alias(end), F.col("has").alias(f"has_{end}")), end)
    return rows.where("NOT (has_a AND has_b)").join(v["exclusions"].select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti").select("a", "b")


def evidence_fields(v: Views) -> DataFrame:
    """Which fields of a product's evidence differ from those of its other state; a code's spelling does not count."""
    before, after = text.semantic_name(F.col("raw")), text.semantic_name(F.col("renamed"))
    fields = F.array_compact(F.array(F.when(before != after, "name"), F.when(~text.codes(F.col("raw")).eqNullSafe(text.codes(F.col("renamed"))), "codes"), F.when(F.pmod("ordinal", F.lit(10)) == 0, "picture")))
    return v["renamed"].select("ordinal", after.alias("name"), F.array_join(fields, ",").alias("changed"))


def matching_states(v: Views) -> DataFrame:
    """One row: products by state, and the reasons of failures in the order they first come."""
    of = F.col("state")
    reasons = v["statuses"].where("state IN ('failed', 'needs_config')").groupBy("status").agg(F.min("ordinal").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "status"))).alias("r"))
    n = lambda *which: F.count(F.when(of.isin(*which), 1))
    counts = v["statuses"].agg(n("judged").alias("judged"), n("failed", "needs_config").alias("failed"), n("failed").alias("retryable"), n("missing").alias("missing"), n("disabled").alias("disabled"))
    return counts.join(reasons).select("judged", "failed", "retryable", "missing", "disabled", F.array_join(F.transform("r", lambda x: x["status"]), "; ").alias("reasons"))


QUERIES = {
    "replayed_relations": replay, "evidence_changed": information_changed, "written_back": write_back, "group_conflicts": group_conflicts, "saved_groups": saved_groups, "ledger_merge": ledger_merge, "ledger_rounds": ledger_rounds,
    "sku_ledger_merge": sku_ledger_merge, "code_placement": code_placement, "picture_placement": picture_placement, "candidate_groups": candidate_groups, "legal_pairs": legal_pairs,
    "evidence_fields": evidence_fields, "matching_states": matching_states,
}

#: Reach by recursion, per kind of relation.
_REACH = """ok AS (SELECT r.* FROM {relations} r JOIN {products} p ON p.ordinal = r.member AND p.name || '/' || p.image = r.version),
link AS (SELECT DISTINCT x.confirmed, x.member AS m, y.member AS o FROM ok x JOIN ok y USING (relation)),
reach(confirmed, m, o) AS (SELECT confirmed, m, o FROM link UNION SELECT r.confirmed, r.m, l.o FROM reach r JOIN link l ON l.confirmed = r.confirmed AND l.m = r.o),
roots AS (SELECT confirmed, m, min(o) AS root FROM reach GROUP BY ALL),
owner AS (SELECT s.confirmed, s.root, arg_min(machine, relation) AS machine FROM roots s JOIN ok ON ok.member = s.m AND ok.confirmed = s.confirmed GROUP BY ALL),
played AS (SELECT p.ordinal, CASE WHEN c.m IS NOT NULL THEN 'confirmed' WHEN d.m IS NOT NULL THEN 'pending' ELSE 'open' END AS state, coalesce(c.root, d.root, p.ordinal) AS root, coalesce(oc.machine, od.machine, '') AS machine
  FROM {products} p LEFT JOIN roots c ON c.m = p.ordinal AND c.confirmed LEFT JOIN roots d ON d.m = p.ordinal AND NOT d.confirmed
  LEFT JOIN owner oc ON oc.confirmed AND oc.root = c.root LEFT JOIN owner od ON NOT od.confirmed AND od.root = d.root AND c.m IS NULL)"""
#: Codes placed one member after another, the members so far in a list.
_PLACED = """out_ AS (SELECT m FROM {excluded_members}),
an AS (SELECT ordinal AS m, root AS g, ordinal IN (FROM out_) AND count(*) OVER (PARTITION BY root) = 1 AS closed FROM played WHERE state = 'confirmed' UNION ALL SELECT ordinal, ordinal, true FROM played WHERE state <> 'confirmed' AND ordinal IN (FROM out_)),
sg AS (SELECT g, list(m) AS ms, list_distinct(list(code)) AS codes FROM an JOIN {coded} c ON c.ordinal = m WHERE NOT closed GROUP BY g),
apart AS (SELECT a AS m, b AS e FROM {code_exclusions} UNION SELECT b, a FROM {code_exclusions}),
partners AS (SELECT ordinal AS m, coalesce(list(e) FILTER (e IS NOT NULL), []) AS ex FROM {coded} LEFT JOIN apart ON apart.m = ordinal GROUP BY ordinal),
x AS (SELECT c.ordinal AS m, code, row_number() OVER (ORDER BY c.ordinal) AS n, ex, coalesce((SELECT list(g) FROM sg WHERE list_contains(sg.codes, c.code) AND len(list_intersect(sg.ms, p.ex)) = 0), []) AS legal
  FROM {coded} c JOIN partners p ON p.m = c.ordinal WHERE code IS NOT NULL AND c.ordinal NOT IN (SELECT m FROM an)),
st(n, done) AS (SELECT 0::BIGINT, []::STRUCT(m BIGINT, code VARCHAR, how VARCHAR, g BIGINT)[] UNION ALL
  SELECT n, list_append(done, CASE WHEN len(good) = 1 THEN {'m': m, 'code': code, 'how': 'joined', 'g': good[1]} WHEN len(good) > 1 THEN {'m': m, 'code': code, 'how': 'waits', 'g': m}
    WHEN newest IS NULL OR len(list_filter(hits, lambda h: h.how = 'own' AND h.g = newest)) > 0 THEN {'m': m, 'code': code, 'how': 'own', 'g': m} ELSE {'m': m, 'code': code, 'how': 'own', 'g': newest} END)
  FROM (SELECT *, list_filter(legal, lambda l: NOT list_contains(list_transform(list_filter(hits, lambda h: h.how = 'joined'), lambda h: h.g), l)) AS good FROM
    (SELECT x.n, x.m, x.code, x.legal, done, list_filter(done, lambda d: list_contains(x.ex, d.m)) AS hits, list_max(list_transform(list_filter(done, lambda d: d.how = 'own' AND d.code = x.code), lambda d: d.g)) AS newest FROM st JOIN x ON x.n = st.n + 1) a) b),
placed AS (SELECT p.m, CASE WHEN p.how = 'waits' THEN 'pending_candidates' ELSE 'code_rule' END AS state, p.g AS grp FROM (SELECT unnest(done) AS p FROM (SELECT done FROM st ORDER BY n DESC LIMIT 1) f) g
  UNION ALL SELECT ordinal, 'unjudged', ordinal FROM {coded} WHERE code IS NULL AND ordinal NOT IN (SELECT m FROM an))"""
_SORTED = "array_to_string(list_sort(list({0})), ',')"
_LOCAL = """l AS (SELECT * FROM {relations} WHERE machine <> 'm3'), n AS (SELECT * FROM {relations} WHERE machine = 'm3' AND confirmed),
lk AS (SELECT DISTINCT x.member AS m, y.member AS o FROM l x JOIN l y USING (relation) WHERE x.confirmed),
lr(m, o) AS (SELECT * FROM lk UNION SELECT r.m, k.o FROM lr r JOIN lk k ON k.m = r.o),
grp AS (SELECT m, list_sort(list(o)) AS all_ FROM lr GROUP BY m),
ns AS (SELECT relation, list_sort(list(member)) AS ms, list_sort(list(member || '=' || version)) AS key FROM n GROUP BY relation),
near AS (SELECT relation, list_sort(list_distinct(flatten(list(coalesce(all_, [member]))))) AS wide FROM n LEFT JOIN grp ON m = member GROUP BY relation)"""



def _round(k: int, machine: str, less: str) -> str:
    """One package's texts: k its number; R, A and E the ledger before it, the next ones after it."""
    key = "list_sort(list(member || '=' || version))"
    return f"""P{k} AS (SELECT '{k}.' || relation AS relation, confirmed, member, version FROM {{relations}} WHERE machine = '{machine}' AND {less}),
lk{k} AS (SELECT DISTINCT x.member AS m, y.member AS o FROM R{k} x JOIN R{k} y USING (relation) WHERE x.confirmed),
rc{k}(m, o) AS (SELECT m, o FROM lk{k} UNION SELECT r.m, l.o FROM rc{k} r JOIN lk{k} l ON l.m = r.o),
g{k} AS (SELECT m, min(o) AS root, list_sort(list(o)) AS ms FROM rc{k} GROUP BY m),
by{k} AS (SELECT root, CASE WHEN min(machine) = max(machine) THEN min(machine) END AS sole FROM R{k} JOIN g{k} ON m = member WHERE confirmed GROUP BY root),
u{k} AS (SELECT m, root, ms, sole FROM g{k} JOIN by{k} USING (root) UNION ALL SELECT member, NULL, [member], machine FROM A{k} WHERE member NOT IN (SELECT m FROM g{k})),
n{k} AS (SELECT relation, list_sort(list(member)) AS ms, {key} AS key FROM P{k} WHERE confirmed GROUP BY relation),
wide{k} AS (SELECT relation, list_distinct(flatten(list(coalesce(ms, [member])))) AS w FROM P{k} LEFT JOIN g{k} ON m = member WHERE confirmed GROUP BY relation),
shut{k} AS (SELECT relation, a, b, machine FROM wide{k} JOIN E{k} ON list_contains(w, a) AND list_contains(w, b) WHERE NOT EXISTS (SELECT 1 FROM g{k} WHERE m = a AND list_contains(ms, b))),
met{k} AS (SELECT DISTINCT n.relation, u.root, u.ms, u.sole FROM n{k} n JOIN u{k} u ON list_contains(n.ms, u.m) WHERE u.ms <> n.ms),
vr{k} AS (SELECT relation, CASE WHEN key IN (SELECT {key} FROM R{k} WHERE confirmed GROUP BY relation) THEN 'known'
  WHEN EXISTS (SELECT 1 FROM (SELECT list(member) AS ms FROM R{k} WHERE NOT confirmed GROUP BY relation) w WHERE len(list_intersect(w.ms, n.ms)) >= 2) THEN 'confirm_vs_withdraw'
  WHEN relation IN (SELECT relation FROM shut{k} WHERE machine <> '{machine}') THEN 'group_vs_exclusion' WHEN relation IN (SELECT relation FROM met{k} WHERE sole IS DISTINCT FROM '{machine}') THEN 'different_groups' ELSE 'adopted' END AS verdict FROM n{k} n),
va{k} AS (SELECT p.member, p.version, g.root, len(g.ms) AS size, CASE WHEN a.version = p.version THEN 'known' WHEN a.machine <> '{machine}' OR len(g.ms) > 1 AND sole IS DISTINCT FROM '{machine}' THEN 'different_groups' ELSE 'adopted' END AS verdict
  FROM {{alone_members}} p LEFT JOIN A{k} a USING (member) LEFT JOIN g{k} g ON g.m = p.member LEFT JOIN by{k} USING (root) WHERE p.machine = '{machine}'),
ve{k} AS (SELECT p.a, p.b, g.root, CASE WHEN EXISTS (SELECT 1 FROM E{k} e WHERE e.a = p.a AND e.b = p.b) THEN 'known' WHEN g.root IS NOT NULL AND sole IS DISTINCT FROM '{machine}' THEN 'group_vs_exclusion' ELSE 'adopted' END AS verdict
  FROM (SELECT DISTINCT a, b FROM {{machine_exclusions}} WHERE machine = '{machine}') p LEFT JOIN g{k} g ON g.m = p.a AND list_contains(g.ms, p.b) LEFT JOIN by{k} USING (root)),
in{k} AS (SELECT relation FROM vr{k} WHERE verdict = 'adopted'),
out{k} AS (SELECT root FROM met{k} WHERE root IS NOT NULL AND relation IN (FROM in{k}) UNION SELECT root FROM va{k} WHERE verdict = 'adopted' AND size > 1 UNION SELECT root FROM ve{k} WHERE verdict = 'adopted' AND root IS NOT NULL),
R{k + 1} AS (SELECT * FROM R{k} WHERE relation NOT IN (SELECT relation FROM R{k} JOIN g{k} ON m = member WHERE confirmed AND root IN (FROM out{k})) UNION ALL SELECT relation, '{machine}', confirmed, member, version FROM P{k} WHERE confirmed AND relation IN (FROM in{k})),
A{k + 1} AS (SELECT * FROM A{k} WHERE member NOT IN (SELECT ms[1] FROM met{k} WHERE root IS NULL AND relation IN (FROM in{k})) AND member NOT IN (SELECT member FROM va{k} WHERE verdict = 'adopted') UNION ALL SELECT member, version, '{machine}' FROM va{k} WHERE verdict = 'adopted'),
E{k + 1} AS (SELECT * FROM E{k} e WHERE NOT EXISTS (SELECT 1 FROM shut{k} s WHERE s.a = e.a AND s.b = e.b AND s.relation IN (FROM in{k})) UNION ALL SELECT a, b, '{machine}' FROM ve{k} WHERE verdict = 'adopted'),
said{k} AS (SELECT {k} AS turn, 'relation' AS kind, relation AS id, verdict FROM vr{k} UNION ALL SELECT {k}, 'alone', CAST(member AS VARCHAR), verdict FROM va{k} UNION ALL SELECT {k}, 'apart', a || '|' || b, verdict FROM ve{k})"""


SQL = {
    "ledger_rounds": duck("WITH RECURSIVE R1 AS (SELECT relation, machine, confirmed, member, version FROM {relations} WHERE machine = 'm1'), A1 AS (SELECT * FROM {alone_members} WHERE machine = 'm1'), E1 AS (SELECT * FROM {machine_exclusions} WHERE machine = 'm1'), "
        + ", ".join(_round(k, m, "member % 4 <> 1" if k == 3 else "true") for k, m in enumerate(_ARRIVALS, 1)) + " SELECT * FROM said1 UNION ALL SELECT * FROM said2 UNION ALL SELECT * FROM said3"),
    "replayed_relations": duck(f"WITH RECURSIVE {_REACH} SELECT * FROM played"),
    "evidence_changed": duck("SELECT ordinal, NOT (name || '/' || image) IN (SELECT version FROM {relations} r WHERE r.member = ordinal) AS changed FROM {products} WHERE ordinal IN (SELECT member FROM {relations})"),
    "written_back": duck(f"""WITH RECURSIVE {_REACH}, every AS (SELECT m, root FROM roots WHERE confirmed AND m % 17 <> 0 UNION
      SELECT r.member, s.root FROM {{relations}} r JOIN ok ON ok.relation = r.relation JOIN roots s ON s.m = ok.member AND s.confirmed WHERE r.confirmed AND r.member NOT IN (SELECT ordinal FROM {{products}}))
      SELECT root, {_SORTED.format("m")} AS members, count(*) AS n FROM every GROUP BY root"""),
    "group_conflicts": duck(f"""WITH RECURSIVE {_REACH} SELECT root, count(*) AS conflicts, {_SORTED.format("ordinal")} AS members FROM played WHERE (SELECT count(DISTINCT machine) FROM {{relations}} r WHERE r.confirmed AND r.member = ordinal) > 1 GROUP BY root"""),
    "saved_groups": duck(f"""WITH RECURSIVE {_REACH}, s AS (SELECT relation, list_sort(list(member)) AS ms FROM {{relations}} WHERE confirmed GROUP BY relation),
      g AS (SELECT list_sort(list(ordinal)) AS ms FROM played WHERE state <> 'open' GROUP BY root), u AS (SELECT relation, len(ms) = (SELECT count(*) FROM ok WHERE ok.relation = s.relation) AS unchanged, ms IN (SELECT ms FROM g) AS same_members FROM s)
      SELECT *, unchanged AND same_members AS holds FROM u"""),
    "ledger_merge": duck(f"""WITH RECURSIVE {_LOCAL} SELECT ns.relation, CASE
      WHEN EXISTS (SELECT 1 FROM (SELECT list_sort(list(member || '=' || version)) AS key FROM l WHERE confirmed GROUP BY relation) k WHERE k.key = ns.key) THEN 'known'
      WHEN EXISTS (SELECT 1 FROM (SELECT list(member) AS ms FROM l WHERE NOT confirmed GROUP BY relation) w WHERE len(list_intersect(w.ms, ns.ms)) >= 2) THEN 'confirm_vs_withdraw'
      WHEN EXISTS (SELECT 1 FROM {{exclusions}} x WHERE list_contains(near.wide, x.a) AND list_contains(near.wide, x.b) AND NOT EXISTS (SELECT 1 FROM grp WHERE m = x.a AND list_contains(all_, x.b))) THEN 'group_vs_exclusion'
      WHEN EXISTS (SELECT 1 FROM grp WHERE list_contains(ns.ms, m) AND all_ <> ns.ms) THEN 'different_groups' ELSE 'adopted' END AS verdict
      FROM ns JOIN near USING (relation)"""),
    "sku_ledger_merge": duck("""WITH s AS (SELECT relation, machine, list_sort(list(member)) AS ms FROM {relations} GROUP BY ALL),
      pairs AS (SELECT DISTINCT y.relation, x.relation AS earlier FROM {relations} x JOIN {relations} y ON x.member = y.member AND x.relation < y.relation)
      SELECT s.relation, CASE WHEN count(CASE WHEN e.ms = s.ms THEN 1 END) > 0 THEN CASE WHEN arg_min(e.machine, e.relation) FILTER (e.ms = s.ms) = s.machine THEN 'superseded' ELSE 'kept_first' END
        WHEN count(CASE WHEN e.ms <> s.ms AND e.machine <> s.machine THEN 1 END) > 0 THEN 'conflict' ELSE 'taken' END AS state
      FROM s LEFT JOIN pairs p ON p.relation = s.relation LEFT JOIN s e ON e.relation = p.earlier GROUP BY s.relation, s.machine"""),
    "code_placement": duck(f"WITH RECURSIVE {_REACH}, {_PLACED} SELECT m AS ordinal, state, grp FROM placed"),
    "candidate_groups": duck(f"""WITH RECURSIVE {_REACH}, {_PLACED}, grp_of AS (SELECT m, g, true AS human, closed, false AS waits FROM an UNION ALL SELECT m, grp, grp IN (SELECT g FROM an), false, state = 'pending_candidates' FROM placed),
      gs AS (SELECT g, list(m) AS ms, bool_or(human) AS human, bool_or(closed) AS closed, bool_or(waits) AS waits, list_distinct(list(code)) AS codes, bool_or(m IN (SELECT m FROM {{excluded_members}})) AS out FROM grp_of JOIN {{coded}} c ON c.ordinal = m GROUP BY g)
      SELECT c.ordinal, count(*) AS n FROM {{coded}} c JOIN grp_of q ON q.m = c.ordinal JOIN gs own ON own.g = q.g JOIN partners p ON p.m = c.ordinal JOIN gs ON gs.g <> own.g
      WHERE len(own.ms) = 1 AND NOT own.human AND c.ordinal NOT IN (SELECT m FROM {{excluded_members}}) AND NOT gs.closed AND NOT gs.out AND len(list_intersect(gs.ms, p.ex)) = 0
        AND CASE WHEN c.code IS NULL THEN NOT gs.waits ELSE gs.human AND list_contains(gs.codes, c.code) END GROUP BY c.ordinal"""),
    "evidence_fields": duck("""WITH t AS (SELECT ordinal, CASE WHEN ordinal % 4 = 0 THEN name || ' #C-' || (ordinal % 37 + CASE WHEN ordinal % 8 = 0 THEN 1 ELSE 0 END) || '#' WHEN ordinal % 7 = 0 THEN name || ' new' ELSE name END AS now FROM (SELECT ordinal, replace(name, '#', '-') AS name FROM {products}))
      SELECT ordinal, now AS name, array_to_string(list_filter([CASE WHEN ordinal % 8 = 0 OR ordinal % 4 <> 0 AND ordinal % 7 = 0 THEN 'name' END, CASE WHEN ordinal % 8 = 0 THEN 'codes' END, CASE WHEN ordinal % 10 = 0 THEN 'picture' END], lambda x: x IS NOT NULL), ',') AS changed FROM t"""),
    "matching_states": duck("""SELECT count(*) FILTER (state = 'judged') AS judged, count(*) FILTER (state IN ('failed', 'needs_config')) AS failed, count(*) FILTER (state = 'failed') AS retryable, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'disabled') AS disabled,
      (SELECT string_agg(status, '; ' ORDER BY nth) FROM (SELECT status, min(ordinal) AS nth FROM {statuses} WHERE state IN ('failed', 'needs_config') GROUP BY status)) AS reasons FROM {statuses}"""),
}


def _with_pairs() -> None:
    from tallyloom.plans.matching_queries import _PAIRS

    SQL["legal_pairs"] = duck(f"""WITH {_PAIRS}, bad AS (SELECT doc_id FROM {{labels}} WHERE quality = 0) SELECT a, b FROM edges JOIN {{coded}} x ON x.ordinal = a JOIN {{coded}} y ON y.ordinal = b
      WHERE a NOT IN (FROM bad) AND b NOT IN (FROM bad) AND (x.code IS NULL OR y.code IS NULL) AND NOT EXISTS (SELECT 1 FROM {{exclusions}} e WHERE e.a = least(edges.a, edges.b) AND e.b = greatest(edges.a, edges.b))""")
    SQL["picture_placement"] = duck(f"""WITH RECURSIVE {_PAIRS}, {_REACH}, j AS (SELECT a, b, positive FROM edges UNION ALL SELECT b, a, positive FROM edges),
      good AS (SELECT j.a, q.root FROM j JOIN played p ON p.ordinal = j.a AND p.state = 'open' JOIN played q ON q.ordinal = j.b AND q.state = 'confirmed' GROUP BY ALL HAVING bool_and(positive))
      SELECT ordinal, CASE WHEN n = 1 THEN 'placed' WHEN n > 1 THEN 'pending' ELSE 'alone' END AS state, CASE WHEN n = 1 THEN root END AS grp FROM (SELECT p.ordinal, count(g.root) AS n, min(g.root) AS root FROM played p LEFT JOIN good g ON g.a = p.ordinal WHERE p.state = 'open' GROUP BY p.ordinal)""")


_with_pairs()
