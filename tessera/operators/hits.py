"""Hit location: the tokens that made a rule true, in match groups."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.evaluate import POSITION, let, literal, near_rows, numbered_forms, qualified, strings
from tessera.plans.rules import FormGroup, Rule, RuleSet, Settings

TOKEN = ["paragraph_id", "sentence_id", "sentence_no_in_paragraph", "is_table_paragraph", "token_no", "sentence_token_position", "paragraph_token_position", "normalized_form", "surface"]
HIT = [*TOKEN, "condition_id", "category_text", "categories", "match_group_id", "match_role"]
FAR = 10**9


@dataclass
class Hits:
    """``rows``: hit tokens; ``warnings``: (condition_id, unit_id, combination_count) of units that the cap sent to the greedy search."""

    rows: DataFrame
    warnings: DataFrame | None


def is_grouped(rule: Rule) -> bool:
    """Whether the group locator serves the rule: several groups, a not or anchored or excluding one, or an or window."""
    g = rule.form_groups
    return len(g) > 1 or any(x.match_logic == "not" or x.anchor_form or x.exclude_forms or (x.match_logic == "or" and x.distance is not None) for x in g)


# ---------------------------------------------------------------- plain and distance rules
def _by_number(values: list, kind: str) -> Column:
    """A value of each rule, looked up by the rule's number in the list."""
    return F.get(literal(values, f"array<{kind}>"), F.col("rule_no"))


def _for_rules(tokens: DataFrame, rules: list[Rule]) -> DataFrame:
    """Tokens once for each rule that has their form: ``rule_no, form_no, unit_id, place`` and the token's columns.

    The rules are a literal that each row looks itself up in, so any number of rules is one pass; only the vocabulary is
    joined, by a broadcast.
    """
    by_form: dict[str, list[dict]] = {}
    for i, r in enumerate(rules):
        for k, f in enumerate(r.forms):
            by_form.setdefault(f, []).append({"rule_no": i, "form_no": k, "by_sentence": r.search_scope == "sentence"})
    table = literal(list(by_form.values()), "array<array<struct<rule_no:int,form_no:int,by_sentence:boolean>>>")
    known = numbered_forms(tokens, {f: n for n, f in enumerate(by_form)})
    rows = known.select(*TOKEN, F.explode(F.get(table, F.col("form_no"))).alias("r")).select(*TOKEN, "r.*")
    return rows.withColumns({"unit_id": F.when(F.col("by_sentence"), F.col("sentence_id")).otherwise(F.col("paragraph_id")), "place": F.when(F.col("by_sentence"), F.col(POSITION["sentence"])).otherwise(F.col(POSITION["paragraph"]))})


def _rule_columns(rule: Column) -> list[Column]:
    return [rule["id"].alias("condition_id"), rule["category_text"].alias("category_text"), rule["categories"].alias("categories")]


def _named(rules: list[Rule]) -> Column:
    return _by_number([{"id": r.id, "category_text": r.category_text, "categories": r.categories} for r in rules], "struct<id:string,category_text:string,categories:array<string>>")


def _numbered_hits(rows: DataFrame, rules: list[Rule], middle: str) -> DataFrame:
    """Hit rows from ``rule_no, unit_id, number`` and the token's columns."""
    group = F.concat(F.col("rule.id"), F.lit(":"), F.col("unit_id").cast("string"), F.lit(middle), F.col("number").cast("string"))
    return rows.withColumn("rule", _named(rules)).select(*TOKEN, *_rule_columns(F.col("rule")), group.alias("match_group_id"), F.col("normalized_form").alias("match_role"))


def simple_hits(tokens: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every token of each rule's forms, in units that have all of them (or any, for any-rules). One exchange for all rules."""
    unit = Window.partitionBy("rule_no", "unit_id")
    needed = _by_number([len(r.forms) if r.form_match_logic == "all" else 1 for r in rules], "int")
    rows = _for_rules(tokens, rules).withColumns({"present": F.size(F.collect_set("form_no").over(unit)), "number": F.row_number().over(unit.orderBy("place", "sentence_id", "token_no"))})
    return _numbered_hits(rows.where(F.col("present") >= needed), rules, ":token:")


def combination_counts(tokens: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rule_no, unit_id, combination_count``: the product of the forms' numbers of tokens (2**62 at most), of units that have all forms."""
    each = _for_rules(tokens, rules).groupBy("rule_no", "unit_id", "form_no").agg(F.count(F.lit(1)).alias("n"))
    whole = each.groupBy("rule_no", "unit_id").agg(F.collect_list("n").alias("n")).where(F.size("n") == _by_number([len(r.forms) for r in rules], "int"))
    number = "decimal(38,0)"
    product = F.aggregate("n", F.lit(1).cast(number), lambda a, x: F.least(a * x.cast("decimal(19,0)"), F.lit(2**62).cast("decimal(38,0)")).cast(number))
    return whole.select("rule_no", "unit_id", product.cast("long").alias("combination_count"))


def strict_groups(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """All combinations of one token per form within the distance, numbered by span, start, end and positions.

    ``rows`` are from ``_for_rules``. One band join per form for all rules together: places are cut into stretches one
    longer than the distance, and a combination meets the next form's tokens of the two or three stretches that can
    hold them, so a frequent form in a long unit is never joined with all others. The number of exchanges follows the
    longest rule, not the number of rules.
    """
    d = _by_number([r.distance for r in rules], "bigint")
    size = _by_number([len(r.forms) for r in rules], "int")
    sides = rows.select("rule_no", "unit_id", "form_no", "place", F.struct(*TOKEN).alias("t"), d.alias("d"), size.alias("size"))
    now = sides.where("form_no = 0").select("rule_no", "unit_id", "d", "size", F.array("place").alias("places"), F.array("t").alias("ts"), F.col("place").alias("start"), F.col("place").alias("end"))
    out = now.where("size = 1")
    for k in range(1, max(len(r.forms) for r in rules)):
        stretches = F.sequence(F.floor((F.col("end") - F.col("d")) / (F.col("d") + 1)), F.floor((F.col("start") + F.col("d")) / (F.col("d") + 1)))
        open_ = now.where(F.col("size") > k).withColumn("stretch", F.explode(stretches))
        side = sides.where(F.col("form_no") == k).select("rule_no", "unit_id", "place", "t", F.floor(F.col("place") / (F.col("d") + 1)).alias("stretch"))
        both = open_.join(side, ["rule_no", "unit_id", "stretch"]).withColumns({"start": F.least("start", "place"), "end": F.greatest("end", "place")}).where(F.col("end") - F.col("start") <= F.col("d"))
        now = both.select("rule_no", "unit_id", "d", "size", F.concat("places", F.array("place")).alias("places"), F.concat("ts", F.array("t")).alias("ts"), "start", "end")
        out = out.unionByName(now.where(F.col("size") == k + 1))
    number = F.row_number().over(Window.partitionBy("rule_no", "unit_id").orderBy(F.col("end") - F.col("start"), "start", "end", "places"))
    return _numbered_hits(out.withColumn("number", number).select("rule_no", "unit_id", "number", F.explode("ts").alias("t")).select("rule_no", "unit_id", "number", "t.*"), rules, ":")


def greedy(places: list[int], forms: list[int], n_forms: int, distance: int) -> list[tuple[int, int]]:
    """(index, group number) of the tokens of non-overlapping groups: the narrowest range with one token of each form
    again and again, without the tokens already taken; of equals the one with least start and end.

    The best range from a token on has the next free token of each other form. Those ranges wait in a heap; one whose
    tokens were taken meanwhile is looked up again and can only have grown, so the first that still holds is narrowest.
    """
    lists: list[list[int]] = [[] for _ in range(n_forms)]
    for i, f in enumerate(forms):
        lists[f].append(i)
    after = [list(range(len(x) + 1)) for x in lists]  # the next free place in each list

    def free(f: int, k: int) -> int:
        path = after[f]
        while path[k] != k:
            path[k] = path[path[k]]
            k = path[k]
        return k

    def best(i: int):
        picks, high = [], places[i]
        for f, x in enumerate(lists):
            k = free(f, bisect.bisect_left(x, i))
            if k == len(x):
                return None
            picks.append(k)
            high = max(high, places[x[k]])
        return high - places[i], places[i], high, i, picks

    heap = [r for i in range(len(places)) if (r := best(i)) is not None and r[0] <= distance]
    heapq.heapify(heap)
    taken, out, number = [False] * len(places), [], 0
    while heap:
        _, _, _, i, picks = heapq.heappop(heap)
        if taken[i]:
            continue
        if any(taken[lists[f][k]] for f, k in enumerate(picks)):
            if (r := best(i)) is not None and r[0] <= distance:
                heapq.heappush(heap, r)
            continue
        number += 1
        for f, k in enumerate(picks):
            taken[lists[f][k]] = True
            after[f][k] = k + 1
            out.append((lists[f][k], number))
    return out


def greedy_groups(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Groups by ``greedy`` in every unit of every rule. ``rows`` are from ``_for_rules``; a task holds one unit at a time."""
    kinds = dict(rows.dtypes)
    columns = ["rule_no", "unit_id", *TOKEN]
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", number int"
    limits = [(len(r.forms), r.distance) for r in rules]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        rule, unit = pdf["rule_no"].to_numpy(), pdf["unit_id"].to_numpy()
        at = [0, *((rule[1:] != rule[:-1]) | (unit[1:] != unit[:-1])).nonzero()[0] + 1, len(pdf)]
        places, forms = pdf["place"].tolist(), pdf["form_no"].tolist()
        found = [(x + i, n) for x, y in zip(at, at[1:]) if y > x for i, n in greedy(places[x:y], forms[x:y], *limits[rule[x]])]
        return pdf.iloc[[i for i, _ in found]][columns].assign(number=[n for _, n in found])

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (pdf["rule_no"] == pdf["rule_no"].iloc[-1]) & (pdf["unit_id"] == pdf["unit_id"].iloc[-1]) if len(pdf) else None
            if last is None:
                continue
            yield settle(pdf[~last])
            held = pdf[last].reset_index(drop=True)
        if held is not None:
            yield settle(held)

    ordered = rows.select(*columns, "place", "form_no").repartition("rule_no", "unit_id").sortWithinPartitions("rule_no", "unit_id", "place", "sentence_id", "token_no")
    return _numbered_hits(ordered.mapInPandas(run, schema), rules, ":")


def distance_hits(tokens: DataFrame, rules: list[Rule], settings: Settings) -> Hits:
    """Enumerate units within the cap, search the others greedily; in strict mode a unit above the limit is an error."""
    mode, rows = settings.distance_matching_mode, _for_rules(tokens, rules)
    if mode == "approx":
        return Hits(greedy_groups(rows, rules), None)
    counts = combination_counts(tokens, rules)
    limit = settings.distance_match_strict_safety_limit if mode == "strict" else settings.distance_match_combination_cap
    rows = rows.join(counts, ["rule_no", "unit_id"])
    rule_id = _by_number([r.id for r in rules], "string")
    if mode == "strict":
        message = F.concat(F.lit("distance_match_strict_limit_exceeded: "), rule_id, F.lit(", unit "), F.col("unit_id").cast("string"), F.lit(", combinations "), F.col("combination_count").cast("string"))
        return Hits(strict_groups(rows.where(F.when(F.col("combination_count") <= limit, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))), rules), None)
    over = counts.where(F.col("combination_count") > limit).select(rule_id.alias("condition_id"), "unit_id", "combination_count")
    within = strict_groups(rows.where(F.col("combination_count") <= limit), rules)
    return Hits(within.unionByName(greedy_groups(rows.where(F.col("combination_count") > limit), rules)), over)


# ---------------------------------------------------------------- group rules
class GroupData:
    """The form groups of some rules as numbered data.

    A rule's groups up to the first whose scope differs are one segment, which is folded unit by unit; each later one is a
    segment of its own. Rules with several segments go on at their paragraphs.
    """

    def __init__(self, rules: list[Rule]):
        self.groups: list[tuple[int, int, int, FormGroup]] = []  # rule, segment, number in the rule, group
        self.forms: dict[str, int] = {}
        for k, r in enumerate(rules):
            first = next((n for n, g in enumerate(r.form_groups) if g.search_scope != r.form_groups[0].search_scope), len(r.form_groups))
            for n, g in enumerate(r.form_groups):
                self.groups.append((k, max(0, n - first + 1), n, g))
                for f in (*g.forms, *g.exclude_forms):
                    self.forms.setdefault(f, len(self.forms))
        self.mixed = [k for k, r in enumerate(rules) if len({g.search_scope for g in r.form_groups}) > 1]
        self.rules = rules

    @staticmethod
    def _ordered(g: FormGroup) -> tuple[str, ...]:
        """An and group's anchor comes first; or groups rank their forms as written."""
        return (g.anchor_form, *(f for f in g.forms if f != g.anchor_form)) if g.match_logic == "and" and g.anchor_form in g.forms else g.forms

    def near_of_forms(self) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in self.forms]
        for n, (_, _, _, g) in enumerate(self.groups):
            for slot, f in [*enumerate(self._ordered(g)), *((-1, f) for f in g.exclude_forms)]:
                out[self.forms[f]].append({"atom": n, "slot": slot, "sentence": g.search_scope == "sentence"})
        return out

    def near_atoms(self) -> list[dict]:
        return [
            {"distance": g.distance if g.distance is not None else -1, "slots": len(g.forms), "kind": "around" if g.match_logic == "and" and g.distance is not None else "any", "anchored": g.match_logic == "and" and g.distance is not None}
            for _, _, _, g in self.groups
        ]

    @property
    def most_slots(self) -> int:
        return max((len(g.forms) for _, _, _, g in self.groups if g.distance is not None), default=0)

    def info(self) -> list[dict]:
        return [
            {"rule": k, "segment": s, "number": n, "name": f"{self.rules[k].id}:g{n + 1}:{g.search_scope}:", "negate": g.match_logic == "not", "near": g.distance is not None, "every": g.match_logic == "and", "least": len(g.forms) if g.match_logic == "and" else 1, "distance": g.distance or 0}
            for k, s, n, g in self.groups
        ]

    def steps(self) -> list[list[list[dict]]]:
        """For each rule and segment: number of the group, whether it is joined by or (as the first of a segment is to
        nothing), whether it is a not group."""
        out: list[list[list[dict]]] = [[] for _ in self.rules]
        for k, s, n, g in self.groups:
            out[k] += [[]] * (s + 1 - len(out[k]))
            out[k][s] = [*out[k][s], {"number": n, "either": g.combine_logic != "and" or not out[k][s], "negate": g.match_logic == "not"}]
        return out

    def chains(self) -> list[list[dict]]:
        """For each rule the segments: joined by or, and whether one holds in a unit that has none of its forms."""
        out = []
        for rule, segments in zip(self.rules, self.steps()):
            chain = []
            for steps in segments:
                value = False
                for s in steps:
                    value = value or s["negate"] if s["either"] else value and s["negate"]
                chain.append({"either": rule.form_groups[steps[0]["number"]].combine_logic != "and", "empty": value})
            out.append(chain)
        return out


GROUP_INFO = "struct<rule:int,segment:int,number:int,name:string,negate:boolean,near:boolean,every:boolean,least:int,distance:bigint>"


def _candidates(tokens: DataFrame, data: GroupData) -> DataFrame:
    """``rule, segment, number, paragraph_id, unit_id, has, rows, start, end``: the tokens of every group in every unit
    where it holds; ``has`` marks units with a form of a not group. One exchange for all groups of all rules."""
    near = near_rows(numbered_forms(tokens, data.forms), data)
    rows = qualified(near, data) if data.most_slots else near.withColumn("good", F.lit(False))
    info, unit = literal(data.info(), f"array<{GROUP_INFO}>"), Window.partitionBy("atom", "unit_id")
    rows = rows.withColumn("g", F.get(info, F.col("atom")))
    rank = F.when(F.col("g.every"), 0).otherwise(F.col("slot"))
    # the first anchor that qualifies: by form, then by position
    anchor = F.min(F.when(F.col("good"), F.struct(rank.alias("r"), F.col("place").alias("p")))).over(unit)["p"]
    present, excluded = F.size(F.collect_set(F.when(F.col("slot") >= 0, F.col("slot"))).over(unit)), F.bool_or(F.col("slot") < 0).over(unit)
    rows = rows.withColumns({"anchor": anchor, "present": present, "excluded": excluded}).where("slot >= 0")
    within = F.when(F.col("g.near"), F.abs(F.col("place") - F.col("anchor")) <= F.col("g.distance")).otherwise((F.col("present") >= F.col("g.least")) & ~F.col("excluded"))
    rows = rows.where(F.col("g.negate") | within)
    hit = F.when(~F.col("g.negate"), F.struct(*TOKEN, F.concat("g.name", F.col("unit_id").cast("string")).alias("match_group_id")))
    found = rows.groupBy("atom", "unit_id", "paragraph_id").agg(F.first("g").alias("g"), F.array_sort(F.collect_list(hit)).alias("rows"), F.min("place").alias("start"), F.max("place").alias("end"))
    return found.select("g.rule", "g.segment", "g.number", "paragraph_id", "unit_id", F.col("g.negate").alias("has"), "rows", "start", "end")


def _order(c: Column) -> Column:
    """Order of candidates: those with rows first, then by start and end."""
    empty = F.size(c["rows"]) == 0
    return F.struct(empty.alias("e"), F.when(empty, FAR).otherwise(c["start"]).alias("s"), F.when(empty, FAR).otherwise(c["end"]).alias("n"))


def _candidate(kind: str, ok, rows: Column, start: Column, end: Column) -> Column:
    return F.struct((F.lit(ok) if isinstance(ok, bool) else ok).alias("ok"), rows.cast(kind).alias("rows"), start.cast("long").alias("start"), end.cast("long").alias("end"))


def _combined(kind: str, left: Column, right: Column, either: Column) -> Column:
    """And: both, with the tokens of both. Or: the better one of those that hold."""
    rows = F.concat(left["rows"], right["rows"])
    places = F.transform(rows, lambda x: x["paragraph_token_position"])
    both = _candidate(kind, left["ok"] & right["ok"], F.when(left["ok"] & right["ok"], rows).otherwise(F.array()), F.coalesce(F.array_min(places), F.lit(FAR)), F.coalesce(F.array_max(places), F.lit(FAR)))
    take_left = left["ok"] & (~right["ok"] | (_order(left) <= _order(right)))
    return F.when(~either, both).when(take_left, left).otherwise(right)


def _folded(kind: str, steps: Column, of: Callable[[Column], Column]) -> Column:
    """Candidates of the steps combined from the left."""
    none = _candidate(kind, False, F.array(), F.lit(FAR), F.lit(FAR))
    return F.aggregate(steps, none, lambda c, s: let(of(s), lambda now: _combined(kind, c, now, s["either"])))


def group_hits(tokens: DataFrame, rules: list[Rule]) -> DataFrame:
    """Hits of all rules with groups: candidates per group and unit, combined from the left inside one row.

    The exchanges are those of the candidates, of the units, and, if scopes are mixed, of the paragraphs, whatever the
    number of rules.
    """
    data, kinds = GroupData(rules), dict(tokens.dtypes)
    tokens = tokens.select(*TOKEN)
    kind = f"array<struct<{','.join(f'{c}:{kinds[c]}' for c in TOKEN)},match_group_id:string>>"
    parts = _candidates(tokens, data).groupBy("rule", "segment", "paragraph_id", "unit_id").agg(F.collect_list(F.struct("number", "has", "rows", "start", "end")).alias("parts"))
    steps = F.get(F.get(literal(data.steps(), "array<array<array<struct<number:int,either:boolean,negate:boolean>>>>"), F.col("rule")), F.col("segment"))

    def of_group(s: Column) -> Column:
        mine = F.get(F.filter("parts", lambda p: p["number"] == s["number"]), F.lit(0))
        empty = _candidate(kind, False, F.array(), F.lit(FAR), F.lit(FAR))
        absent = _candidate(kind, True, F.array(), F.lit(FAR), F.lit(FAR))
        return F.when(s["negate"], F.when(mine.isNull(), absent).otherwise(empty)).when(mine.isNull(), empty).otherwise(_candidate(kind, True, mine["rows"], mine["start"], mine["end"]))

    units = parts.withColumn("c", _folded(kind, steps, of_group))
    plain = [k for k in range(len(rules)) if k not in data.mixed]
    out = units.where(F.col("rule").isin(plain)).select("rule", "c") if plain else None
    if data.mixed:
        # the best unit of each segment and paragraph; one without any of the forms may hold too
        sizes = tokens.groupBy("paragraph_id").agg(F.count_distinct("sentence_id").alias("n_sentences"))
        ok = F.col("c.ok")
        best = units.where(F.col("rule").isin(data.mixed)).groupBy("rule", "segment", "paragraph_id").agg(
            F.min_by(F.when(ok, F.col("c")), F.when(ok, F.struct(_order(F.col("c")).alias("o"), F.col("unit_id").alias("u")))).alias("c"), F.count(F.lit(1)).alias("seen")
        )
        best = best.groupBy("rule", "paragraph_id").agg(F.collect_list(F.struct("segment", "c", "seen")).alias("parts")).join(sizes, "paragraph_id")
        chains = [[{**s, "segment": n, "sentence": next(g.search_scope for k, x, _, g in data.groups if (k, x) == (r, n)) == "sentence"} for n, s in enumerate(c)] for r, c in enumerate(data.chains())]
        chain = F.get(literal(chains, "array<array<struct<either:boolean,empty:boolean,segment:int,sentence:boolean>>>"), F.col("rule"))

        def of_segment(s: Column) -> Column:
            mine = F.get(F.filter("parts", lambda p: p["segment"] == s["segment"]), F.lit(0))
            all_units = F.when(s["sentence"], F.col("n_sentences")).otherwise(1)
            holds = s["empty"] & (mine.isNull() | (mine["seen"] < all_units))
            return F.when(mine["c"].isNotNull(), mine["c"]).otherwise(_candidate(kind, holds, F.array(), F.lit(FAR), F.lit(FAR)))

        promoted = best.select("rule", _folded(kind, chain, of_segment).alias("c"))
        out = promoted if out is None else out.unionByName(promoted)
    exploded = out.where("c.ok").select(F.col("rule").alias("rule_no"), F.explode("c.rows").alias("h")).select("rule_no", "h.*").withColumn("rule", _named(rules))
    return exploded.select(*TOKEN, *_rule_columns(F.col("rule")), "match_group_id", F.col("normalized_form").alias("match_role")).distinct()


# ---------------------------------------------------------------- all rules
def locate(tokens: DataFrame, rules: RuleSet) -> Hits:
    """Hits of all rules that have forms. ``tokens`` are positioned.

    Plain rules are one plan, distance rules another, rules with groups a third, whatever their number.
    """
    formed = [r for r in rules.rules if r.forms]
    grouped = [r for r in formed if is_grouped(r)]
    near = [r for r in formed if not is_grouped(r) and r.distance is not None]
    plain = [r for r in formed if not is_grouped(r) and r.distance is None]
    found = [Hits(simple_hits(tokens, plain), None)] if plain else []
    found += [distance_hits(tokens, near, rules.settings)] if near else []
    found += [Hits(group_hits(tokens, grouped), None)] if grouped else []
    if not found:
        return Hits(tokens.limit(0).select(*TOKEN, *((strings(()) if c == "categories" else F.lit("")).alias(c) for c in HIT[len(TOKEN) :])), None)
    rows = found[0].rows
    for f in found[1:]:
        rows = rows.unionByName(f.rows)
    warnings = [f.warnings for f in found if f.warnings is not None]
    return Hits(rows, warnings[0] if warnings else None)


# ---------------------------------------------------------------- references to categories
def by_categories(hits: DataFrame, rules: list[Rule]) -> DataFrame:
    """Hits of rules whose required categories have hits in the same paragraph; rules without such clauses keep theirs.

    A paragraph's categories are those of its hits, gathered once; all rules look their clauses up in one literal.
    """
    needs = literal(
        {r.id: {"every": list(r.required_categories_all), "some": list(r.required_categories_any)} for r in rules if r.required_categories_all or r.required_categories_any},
        "map<string,struct<every:array<string>,some:array<string>>>",
    )
    there = hits.select("paragraph_id", F.explode("categories").alias("c")).distinct().groupBy("paragraph_id").agg(F.collect_list("c").alias("there"))
    need = F.try_element_at(needs, F.col("condition_id"))
    rows = hits.where(F.col("condition_id").isin([r.id for r in rules])).join(there, "paragraph_id").withColumn("need", need)
    every = F.size(F.array_intersect("need.every", "there")) == F.size(F.array_distinct("need.every"))
    some = (F.size("need.some") == 0) | F.arrays_overlap("need.some", "there")
    return rows.where(F.col("need").isNull() | (every & some)).select(hits.columns)
