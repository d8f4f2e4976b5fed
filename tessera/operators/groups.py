"""Units in which rules with form groups hold, with the number of forms that were matched there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.evaluate import let, literal, near_rows, numbered_forms, qualified
from tessera.operators.hits import GROUP_INFO, TOKEN, GroupData
from tessera.plans.rules import Rule


def _unit(ok: Column, count: Column) -> Column:
    return F.struct(ok.alias("ok"), count.cast("bigint").alias("count"))


def _folded(steps: Column, of) -> Column:
    """Groups combined from the left: and needs both, or one of them; the count is the larger of those that hold."""
    none = _unit(F.lit(False), F.lit(0))

    def step(c: Column, s: Column) -> Column:
        def both(now: Column) -> Column:
            ok = F.when(s["either"], c["ok"] | now["ok"]).otherwise(c["ok"] & now["ok"])
            return _unit(ok, F.when(ok, F.greatest(F.when(c["ok"], c["count"]).otherwise(0), F.when(now["ok"], now["count"]).otherwise(0))).otherwise(0))

        return let(of(s), both)

    return F.aggregate(steps, none, step)


def matched_units(tokens: DataFrame, units: DataFrame, rules: list[Rule]) -> DataFrame:
    """``condition_id, paragraph_id, unit_scope, unit_id, matched_form_count, distance_is_match`` of all rules with groups.

    ``tokens`` are positioned, ``units`` (paragraph_id, sentence_id) are all there are: a not group holds where none of its
    forms is. The count of an and group is its number of forms, of a group without distance the number of its forms
    that are there; an or group with a distance counts the forms around its first anchor that qualifies (by form, then
    by place); a not group counts all of its forms. Where groups combine, the larger count stays; where scopes differ,
    the largest of the paragraph's sentences. One plan for all rules: an exchange by group and unit, one by rule and
    unit, and one by paragraph if scopes are mixed.
    """
    data = GroupData(rules)
    near = near_rows(numbered_forms(tokens.select(*TOKEN), data.forms), data)
    rows = qualified(near, data) if data.most_slots else near.withColumns({"good": F.lit(False), "together": F.lit(0)})
    rank = F.struct(F.when(F.get(literal(data.info(), f"array<{GROUP_INFO}>"), F.col("atom"))["every"], 0).otherwise(F.col("slot")).alias("r"), F.col("place").alias("p"))
    first = F.min_by(F.when(F.col("good"), F.col("together")), F.when(F.col("good"), rank))
    present = F.count_distinct(F.when(F.col("slot") >= 0, F.col("slot")))
    found = rows.groupBy("atom", "unit_id", "paragraph_id").agg(first.alias("around"), present.alias("present"), F.bool_or(F.col("slot") < 0).alias("excluded"))
    found = found.withColumn("g", F.get(literal(data.info(), f"array<{GROUP_INFO}>"), F.col("atom")))
    holds = F.when(F.col("g.negate"), F.col("present") > 0).when(F.col("g.near"), F.col("around").isNotNull()).otherwise((F.col("present") >= F.col("g.least")) & ~F.col("excluded"))
    count = F.when(F.col("g.near"), F.col("around")).otherwise(F.col("present")).cast("bigint")
    parts = found.where(holds).select("g.rule", "g.segment", "paragraph_id", "unit_id", F.struct("g.number", count.alias("count")).alias("part"))
    negated = sorted({(k, s, g.search_scope == "sentence") for k, s, _, g in data.groups if any(x.match_logic == "not" for r, t, _, x in data.groups if (r, t) == (k, s))})
    if negated:
        table = literal([{"rule": k, "segment": s, "sentence": by} for k, s, by in negated], "array<struct<rule:int,segment:int,sentence:boolean>>")
        every = units.select("paragraph_id", "sentence_id", F.explode(table).alias("n"))
        every = every.select("n.rule", "n.segment", "paragraph_id", F.when(F.col("n.sentence"), F.col("sentence_id")).otherwise(F.col("paragraph_id")).alias("unit_id"), F.lit(None).cast("struct<number:int,count:bigint>").alias("part"))
        parts = parts.unionByName(every)
    grouped = parts.groupBy("rule", "segment", "paragraph_id", "unit_id").agg(F.collect_set("part").alias("parts"))
    steps = [[[{**s, "size": len(rules[k].form_groups[s["number"]].forms)} for s in segment] for segment in segments] for k, segments in enumerate(data.steps())]
    step = F.get(F.get(literal(steps, "array<array<array<struct<number:int,either:boolean,negate:boolean,size:bigint>>>>"), F.col("rule")), F.col("segment"))

    def of_group(s: Column) -> Column:
        mine = F.get(F.filter("parts", lambda p: p["number"] == s["number"]), F.lit(0))
        return F.when(s["negate"], _unit(mine.isNull(), s["size"])).otherwise(_unit(mine.isNotNull(), F.coalesce(mine["count"], F.lit(0))))

    done = grouped.withColumn("u", _folded(step, of_group)).where("u.ok")
    plain = [k for k in range(len(rules)) if k not in data.mixed]
    scopes = literal([{"id": r.id, "scope": r.form_groups[0].search_scope if k in plain else "paragraph"} for k, r in enumerate(rules)], "array<struct<id:string,scope:string>>")
    out = done.where(F.col("rule").isin(plain)).select("rule", "paragraph_id", "unit_id", "u") if plain else None
    if data.mixed:
        best = done.where(F.col("rule").isin(data.mixed)).groupBy("rule", "segment", "paragraph_id").agg(F.max("u.count").alias("count"))
        best = best.groupBy("rule", "paragraph_id").agg(F.collect_list(F.struct("segment", "count")).alias("parts"))
        chain = F.get(literal([[{"either": s["either"], "segment": n} for n, s in enumerate(c)] for c in data.chains()], "array<array<struct<either:boolean,segment:int>>>"), F.col("rule"))

        def of_segment(s: Column) -> Column:
            mine = F.get(F.filter("parts", lambda p: p["segment"] == s["segment"]), F.lit(0))
            return _unit(mine.isNotNull(), F.coalesce(mine["count"], F.lit(0)))

        promoted = best.select("rule", "paragraph_id", F.col("paragraph_id").alias("unit_id"), _folded(chain, of_segment).alias("u")).where("u.ok")
        out = promoted if out is None else out.unionByName(promoted)
    named = out.withColumn("r", F.get(scopes, F.col("rule")))
    return named.select(F.col("r.id").alias("condition_id"), "paragraph_id", F.col("r.scope").alias("unit_scope"), "unit_id", F.col("u.count").alias("matched_form_count"), F.lit(True).alias("distance_is_match"))
