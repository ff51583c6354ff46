"""Numbers carried through tables, budgets, pinned reads and counters. The SQL numbers and sums in windows over all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyloom.operators import budget, surrogates
from tallyloom.plans import oracles, relational, shared
from tallyloom.plans.adapter import Views, duck
from tallyloom.sources import snapshots

_MACHINE = "'m' || CAST({0} % 3 AS STRING)"
_ROUNDS = f"SELECT {_MACHINE.format('o_orderkey')} AS machine, o_orderkey % 40 AS id, CASE WHEN o_orderkey % 40 = 7 AND o_custkey % 9 = 0 THEN 'other' ELSE 'round' END AS content FROM {{orders}} WHERE o_orderkey % 40 <> 11"
_SHOPS = f"SELECT {_MACHINE.format('o_orderkey')} AS machine, o_orderkey % 40 * 100 + o_custkey % 7 AS id, o_orderkey % 40 AS round, o_custkey % 7 AS shop FROM {{orders}} WHERE o_custkey % 7 <> 5"
_LINES = f"SELECT {_MACHINE.format('l_orderkey')} AS machine, l_orderkey * 10 + l_linenumber AS id, l_orderkey % 40 * 100 + l_suppkey % 7 AS shop_round, l_quantity AS stock FROM {{lineitem}}"


def surrogate_ids(v: Views) -> DataFrame:
    """Rounds, their shops and snapshots of three machines under one numbering, and what can't be numbered."""
    return surrogates.remap([surrogates.Level("rounds", v.sql(_ROUNDS)), surrogates.Level("shops", v.sql(_SHOPS), "round"), surrogates.Level("lines", v.sql(_LINES), "shop_round")])


#: Calls of fifty sets; prices by model, none for one of them; some usage is unknown or doesn't add up.
_CALLS = """SELECT o_custkey % 50 AS grp, o_orderkey AS id, o_custkey * 10 AS prompt, o_orderkey % 900 AS completion,
  CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 977 <> 4 THEN o_custkey * 4 END AS hit, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey * 6 + CASE WHEN o_orderkey % 1009 = 8 THEN 1 ELSE 0 END END AS miss,
  CASE WHEN o_orderkey % 1201 = 1 THEN NULL WHEN o_orderkey % 4 = 0 THEN 2.0 ELSE 1.5 END AS input_rate, CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 1.5 END AS cached_rate, 8.0 AS output_rate,
  CASE WHEN o_orderkey % 1201 <> 1 THEN 0.03 END AS reserve FROM {orders}"""
_BUDGET, _MOST = 1.0, 200


def _money(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("decimal(12,4)") for c in ("input_rate", "cached_rate", "output_rate", "reserve")})


def call_admission(v: Views) -> DataFrame:
    """Which calls of each set go out under a budget, and why the others are held."""
    out = budget.admitted(budget.cost(_money(v.sql(_CALLS))), _BUDGET, _MOST)
    return out.select("grp", "id", F.round(F.col("spent").cast("double"), 9).alias("spent"), "reason")


def pinned_snapshot(v: Views) -> DataFrame:
    """Two tables read through one pin, rows of both added after it: what the pin and what a new read sees."""
    root = f"{shared.folder(v.spark)}/pinned-{uuid.uuid4().hex}"
    stock, plan = v["inventory"].select("shop", "date", "stock"), v["weekly_plan"]
    tables = {"stock": (stock, F.col("date") < "2024-01-20"), "plan": (plan, F.col("week") < 4)}
    for name, (rows, early) in tables.items():
        rows.where(early).write.parquet(f"{root}/{name}")
    pin = snapshots.Pinned(v.spark, root, list(tables))
    for name, (rows, early) in tables.items():
        rows.where(~early).write.mode("append").parquet(f"{root}/{name}")
    count = lambda df, name, how: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), F.lit(how).alias("how"), "n")
    out = [count(x, name, how) for name in tables for how, x in (("pinned", pin.read(name)), ("now", v.spark.read.parquet(f"{root}/{name}")))]
    return out[0].union(out[1]).union(out[2]).union(out[3])


def usage_counters(v: Views) -> DataFrame:
    """Counters of one pass over the calls, kept while their costs are written: tasks that run twice count once."""
    root, seen = f"{shared.folder(v.spark)}/calls-{uuid.uuid4().hex}", Observation()
    unknown = F.col("cost").isNull()
    rows = budget.cost(_money(v.sql(_CALLS))).observe(
        seen, F.count(F.lit(1)).alias("calls"), F.count_if(unknown).alias("unknown"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum(F.coalesce("hit", F.lit(0))).alias("hit"), F.max(F.when(~unknown, F.col("id"))).alias("last"),
    )
    rows.write.parquet(root)
    got = seen.get
    names = ("calls", "unknown", "prompt", "completion", "hit", "last")
    return v.spark.createDataFrame([tuple(None if got[n] is None else int(got[n]) for n in names)], ", ".join(f"{n} long" for n in names))


#: Judgments of neighbours as machines packed them: some on evidence that is not known here, some without any, some of another contract.
_PACKED = """SELECT a.ordinal AS a, b.ordinal AS b, 'm' || CAST(a.ordinal % 3 + 1 AS STRING) AS machine, CASE WHEN a.ordinal % 13 = 0 THEN 'old' ELSE a.name || '/' || CAST(a.image AS STRING) END AS va,
  CASE WHEN b.ordinal % 17 = 0 THEN NULL ELSE b.name || '/' || CAST(b.image AS STRING) END AS vb, CASE WHEN a.ordinal % 9 = 0 THEN 'v1' WHEN a.ordinal % 9 = 1 THEN NULL ELSE 'v2' END AS signature
FROM {products} a JOIN {products} b ON b.ordinal = a.ordinal + 2"""


def gates(judged: DataFrame, known: DataFrame, contract: str) -> DataFrame:
    """judged with class: of another contract (``signature``), else on evidence that isn't known (``evidence_version``), else ``gated``; without a
    contract to hold them against, ``unevaluated``. judged: va, vb, signature; known: version."""
    have = known.where("version <> ''").select("version").distinct()
    side = lambda df, v: df.join(have.select(F.col("version").alias(v), F.lit(True).alias(f"has_{v}")), v, "left")
    other = F.lit(contract != "") & (F.coalesce("signature", F.lit("")) != contract)
    kind = F.when(other, "signature").when(F.col("has_va").isNull() | F.col("has_vb").isNull(), "evidence_version").otherwise("gated" if contract else "unevaluated")
    return side(side(judged, "va"), "vb").withColumn("class", kind).drop("has_va", "has_vb")


def gate_classes(v: Views) -> DataFrame:
    """How many packed judgments of each machine pass the gate, under this contract and without one."""
    known = v["products"].select(F.concat_ws("/", "name", F.col("image").cast("string")).alias("version"))
    rows = v.sql(_PACKED)
    both = [gates(rows, known, c).select(F.lit(c).alias("contract"), "machine", "class") for c in ("v2", "")]
    return both[0].union(both[1]).groupBy("contract", "machine", "class").agg(F.count(F.lit(1)).alias("n"))


def conflict_packages(v: Views) -> DataFrame:
    """A week's merge conflicts with the package that brought each, if it is on record."""
    found = relational.QUERIES["merge_conflicts"](v).where("date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'")
    sha = lambda machine: F.sha2(F.concat_ws("|", machine, F.weekofyear("date").cast("string")), 256)
    taken = v["machine_inventory"].where("machine <> 'm2'").select(sha(F.col("machine")).alias("package"), F.concat(F.lit("raw-"), "machine").alias("source")).distinct()
    return found.withColumn("package", sha(F.col("loser"))).join(taken, "package", "left").select("shop", "date", "winner", "loser", "replaced", "kept", "source")


def sku_evidence(v: Views) -> DataFrame:
    """What a SKU's judgment rests on, as one digest of nine fields; fields that are lacking are told from empty ones."""
    text_ = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null"))
    rows = v["coded"].join(v["products"].select("ordinal", "image", "source"), "ordinal")
    day = F.format_string("2024-01-%02d", F.pmod("ordinal", F.lit(28)) + 1)
    fields = (
        F.concat(F.lit("["), text_(F.col("shop")), F.lit(", "), text_(F.col("ordinal").cast("string")), F.lit("]")), text_(F.col("name")), text_(F.concat_ws(" ", "name", "code")), text_(F.lower("name")), text_(F.when(F.col("image") % 5 > 0, F.md5(F.col("image").cast("string").cast("binary")))),
        text_(F.when(F.col("image") % 5 > 0, "own").otherwise("missing")), text_(F.concat(day, F.lit("T08:00:00+00:00"))), text_(day), F.coalesce(F.concat(F.lit("["), text_(F.col("code")), F.lit("]")), F.lit("[]")),
    )
    return rows.select("ordinal", F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *fields), F.lit("]")), 256).alias("version"))


QUERIES = {"gate_classes": gate_classes, "conflict_packages": conflict_packages, "sku_evidence": sku_evidence, "surrogate_ids": surrogate_ids, "call_admission": call_admission, "pinned_snapshot": pinned_snapshot, "usage_counters": usage_counters}

_COST = """c AS (SELECT *, CAST((CASE WHEN input_rate = cached_rate THEN prompt * CAST(input_rate AS DECIMAL(12, 4)) WHEN hit + miss = prompt THEN hit * CAST(cached_rate AS DECIMAL(12, 4)) + miss * CAST(input_rate AS DECIMAL(12, 4)) END + completion * CAST(output_rate AS DECIMAL(12, 4))) AS DOUBLE) / 1000000 AS cost FROM calls)"""
SQL = {
    "gate_classes": duck(f"""WITH j AS ({_PACKED}), k AS (SELECT list(name || '/' || image) AS all_ FROM {{products}}), c AS (SELECT unnest(['v2', '']) AS contract)
      SELECT contract, machine, CASE WHEN contract = 'v2' AND signature IS DISTINCT FROM 'v2' THEN 'signature' WHEN NOT coalesce(list_contains(all_, va), false) OR NOT coalesce(list_contains(all_, vb), false) THEN 'evidence_version' WHEN contract = '' THEN 'unevaluated' ELSE 'gated' END AS class, count(*) AS n FROM j, k, c GROUP BY ALL"""),
    "conflict_packages": f"""SELECT shop, date, winner, loser, replaced, kept, CASE WHEN loser <> 'm2' THEN 'raw-' || loser END AS source FROM ({(relational.SQL | oracles.SQL)["merge_conflicts"]}) WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'""",
    "sku_evidence": duck("""WITH f AS (SELECT c.*, image, '2024-01-' || lpad(CAST(c.ordinal % 28 + 1 AS VARCHAR), 2, '0') AS day FROM {coded} c JOIN {products} p ON p.ordinal = c.ordinal)
      SELECT ordinal, sha256('[["' || shop || '", "' || ordinal || '"], "' || name || '", "' || name || coalesce(' ' || code, '') || '", "' || lower(name) || '", ' || CASE WHEN image % 5 > 0 THEN '"' || md5(CAST(image AS VARCHAR)) || '", "own"' ELSE 'null, "missing"' END || ', "' || day || 'T08:00:00+00:00", "' || day || '", [' || coalesce('"' || code || '"', 'null') || ']]') AS version FROM f"""),
    "surrogate_ids": duck(f"""WITH r AS (SELECT machine, id, count(DISTINCT content) AS n FROM ({_ROUNDS}) GROUP BY ALL), rn AS (SELECT machine, id, row_number() OVER (ORDER BY machine, id) AS new_id FROM r WHERE n = 1),
      s AS (SELECT DISTINCT machine, id, round FROM ({_SHOPS})), sp AS (SELECT s.machine, s.id, rn.new_id AS p FROM s LEFT JOIN rn ON rn.machine = s.machine AND rn.id = s.round),
      sn AS (SELECT machine, id, p, row_number() OVER (ORDER BY machine, id) AS new_id FROM sp WHERE p IS NOT NULL),
      l AS (SELECT l.machine, l.id, l.n, sn.new_id AS p FROM (SELECT machine, id, min(shop_round) AS shop_round, count(DISTINCT (shop_round, stock)) AS n FROM ({_LINES}) GROUP BY ALL) l LEFT JOIN sn ON sn.machine = l.machine AND sn.id = l.shop_round)
      SELECT 'rounds' AS level, machine, id, new_id, NULL::BIGINT AS new_parent, NULL AS problem FROM rn UNION ALL SELECT 'rounds', machine, id, NULL, NULL, 'two contents' FROM r WHERE n > 1
      UNION ALL SELECT 'shops', machine, id, new_id, p, NULL FROM sn UNION ALL SELECT 'shops', machine, id, NULL, NULL, 'orphan' FROM sp WHERE p IS NULL
      UNION ALL SELECT 'lines', machine, id, row_number() OVER (ORDER BY machine, id), p, NULL FROM l WHERE p IS NOT NULL AND n = 1 UNION ALL SELECT 'lines', machine, id, NULL, NULL, CASE WHEN n > 1 THEN 'two contents' ELSE 'orphan' END FROM l WHERE p IS NULL OR n > 1"""),
    "call_admission": duck(f"""WITH calls AS ({_CALLS}), {_COST},
      w AS (SELECT *, coalesce(sum(cost) OVER b, 0) AS spent, count(*) OVER b AS made, coalesce(bool_or(cost IS NULL) OVER b, false) AS lost, coalesce(bool_or(cost > reserve) OVER b, false) AS beyond FROM c WINDOW b AS (PARTITION BY grp ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      q AS (SELECT *, CASE WHEN lost THEN 'usage_or_cost_unknown' WHEN beyond THEN 'request_reserve_exceeded' WHEN spent >= {_BUDGET} THEN 'budget_limit' WHEN reserve IS NULL THEN 'pricing_model_missing' WHEN spent + reserve > {_BUDGET} THEN 'budget_reserve_limit' WHEN made >= {_MOST} THEN 'call_limit' END AS why FROM w)
      SELECT grp, id, round(spent, 9) AS spent, first_value(why IGNORE NULLS) OVER (PARTITION BY grp ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reason FROM q"""),
    "pinned_snapshot": duck("SELECT 'stock' AS tbl, 'pinned' AS how, count(*) AS n FROM {inventory} WHERE date < DATE '2024-01-20' UNION ALL SELECT 'stock', 'now', count(*) FROM {inventory} UNION ALL SELECT 'plan', 'pinned', count(*) FROM {weekly_plan} WHERE week < 4 UNION ALL SELECT 'plan', 'now', count(*) FROM {weekly_plan}"),
    "usage_counters": duck(f"WITH calls AS ({_CALLS}), {_COST} SELECT count(*) AS calls, count(*) FILTER (cost IS NULL) AS unknown, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, coalesce(sum(hit), 0)::BIGINT AS hit, max(id) FILTER (cost IS NOT NULL) AS last FROM c"),
}
