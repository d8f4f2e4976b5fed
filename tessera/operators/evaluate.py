"""Evaluation of a whole rule set in one plan whose size doesn't depend on the number of rules.

Rules are data (``plans/ruledata.py``): atoms (forms, texts, labels, distances), programs that chain atoms, and rules that
need programs and other rules. Each of these is one literal array that every row looks itself up in, so a thousand
rules make the same handful of expressions as one. Tokens of the rules' vocabulary are aggregated once per sentence and
once per paragraph into the set of forms present; a unit's row then names the atoms that hold, found through the atoms
of its forms, then the programs of those, then the rules of those, each as a list of numbers. Only what a unit touches
is evaluated. Distance atoms are one plan too: rows (atom, unit, place) with the last and the next place of each of the
atom's forms as running columns.
"""

from __future__ import annotations

import json
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import let
from tessera.operators.positions import paragraph_texts, positioned
from tessera.plans.ruledata import RuleData
from tessera.plans.rules import RuleSet

UNIT = {"sentence": "sentence_id", "paragraph": "paragraph_id"}
POSITION = {"sentence": "sentence_token_position", "paragraph": "paragraph_token_position"}
NUMBERS = "array<int>"


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def literal(data: list, schema: str) -> Column:
    """Data as one literal: the optimizer reads the JSON once, so the plan holds one node however long the list is."""
    return F.from_json(F.lit(json.dumps(data, ensure_ascii=False)), schema)


def numbers(values=()) -> Column:
    return literal(list(values), NUMBERS)


# ---------------------------------------------------------------- atoms and programs of a unit
def numbered_forms(tokens: DataFrame, forms: dict[str, int]) -> DataFrame:
    """Tokens that have one of the forms, with its number; the vocabulary of the rules is broadcast."""
    table = tokens.sparkSession.createDataFrame(list(forms.items()) or [("", -1)], "normalized_form string, form_no int")
    return tokens.join(F.broadcast(table), "normalized_form")


def touched(numbers_: Column, index: list[list[int]]) -> Column:
    """What the given numbers lead to, each once."""
    table = literal(index, f"array<{NUMBERS}>")
    return F.array_distinct(F.flatten(F.transform(numbers_, lambda n: F.get(table, n))))


def form_atoms(forms: Column, data: RuleData, scope: str) -> Column:
    """Atoms of the scope that hold for a set of forms: enough of theirs are there, and none that they exclude."""
    if not data.has_form_atoms(scope):
        return numbers()
    atoms = literal(data.form_atoms(), f"array<struct<need:{NUMBERS},least:int,without:{NUMBERS}>>")

    def holds(forms: Column, atom: Column) -> Column:
        return (F.size(F.array_intersect(forms, atom["need"])) >= atom["least"]) & ~F.arrays_overlap(forms, atom["without"])

    return let(forms, lambda fs: F.filter(touched(fs, data.atoms_of_forms(scope)), lambda a: holds(fs, F.get(atoms, a))))


def text_atoms(text: Column, data: RuleData, scope: str) -> Column:
    """Atoms of the scope whose literal texts stand in the text."""
    atoms = data.text_atoms(scope)
    if not atoms:
        return numbers()
    table = literal(atoms, "array<struct<atom:int,texts:array<string>,every:boolean>>")

    def holds(text: Column, a: Column) -> Column:
        return F.when(a["every"], F.forall(a["texts"], lambda t: text.contains(t))).otherwise(F.exists(a["texts"], lambda t: text.contains(t)))

    return F.transform(let(text, lambda x: F.filter(table, lambda a: holds(x, a))), lambda a: a["atom"])


def label_atoms(labels: Column, data: RuleData) -> Column:
    atoms = data.label_atoms()
    if not atoms:
        return numbers()
    table = literal(atoms, "array<struct<atom:int,labels:array<string>>>")
    held = let(labels, lambda ls: F.filter(table, lambda a: F.size(F.array_intersect(ls, a["labels"])) == F.size(a["labels"])))
    return F.transform(held, lambda a: a["atom"])


def programs(facts: Column, data: RuleData, scope: str) -> Column:
    """Programs of the scope that hold for a unit's facts (bound by ``let``): chains of and, or and not, from the left."""
    steps = data.steps(scope)
    if not steps:
        return numbers()
    table = literal(steps, "array<array<struct<either:boolean,fact:int,negate:boolean>>>")

    def holds(p: Column) -> Column:
        def step(value: Column, s: Column) -> Column:
            now = F.array_contains(facts, s["fact"]) != s["negate"]
            return F.when(s["either"], value | now).otherwise(value & now)

        return F.aggregate(F.get(table, p), F.lit(False), step)

    return F.filter(F.array_union(touched(facts, data.programs_of_facts(scope)), numbers(data.always(scope))), holds)


# ---------------------------------------------------------------- distance atoms
def near_rows(tokens: DataFrame, data: RuleData) -> DataFrame:
    """``atom, unit_id, place, slot`` and the tokens' columns: a token once for each distance atom that has its form.

    ``slot`` numbers the atom's forms, the anchor first; excluded forms have slot -1.
    """
    index = literal(data.near_of_forms(), "array<array<struct<atom:int,slot:int,sentence:boolean>>>")
    rows = tokens.withColumn("near", F.explode(F.get(index, F.col("form_no")))).select(*tokens.columns, "near.*")
    by = F.col("sentence")
    return rows.withColumns({"unit_id": F.when(by, F.col("sentence_id")).otherwise(F.col("paragraph_id")), "place": F.when(by, F.col(POSITION["sentence"])).otherwise(F.col(POSITION["paragraph"]))})


def qualified(rows: DataFrame, data: RuleData) -> DataFrame:
    """``near_rows`` with ``good``: the token is an anchor (or any form, for or atoms) whose surroundings satisfy the atom;
    ``together``: how many of the atom's forms its surroundings have.

    State per token are the last and the next place of each form of its atom, whatever the distance and however many
    tokens lie within it. One exchange by (atom, unit), two sorts.
    """
    info = literal(data.near_atoms(), "array<struct<distance:bigint,slots:int,kind:string,anchored:boolean>>")
    rows = rows.withColumn("info", F.get(info, F.col("atom")))
    unit = Window.partitionBy("atom", "unit_id")
    behind = unit.orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = unit.orderBy(F.col("place").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    slots = range(-1, data.most_slots)
    rows = rows.withColumns({f"last{k + 1}": F.max(F.when(F.col("slot") == k, F.col("place"))).over(behind) for k in slots})
    rows = rows.withColumns({f"next{k + 1}": F.min(F.when(F.col("slot") == k, F.col("place"))).over(ahead) for k in slots})
    d, kind = F.col("info.distance"), F.col("info.kind")

    def near(k: int) -> Column:
        before = false_if_null((F.col("place") - F.col(f"last{k + 1}") <= d) & (kind != "ahead"))
        return before | false_if_null(F.col(f"next{k + 1}") - F.col("place") <= d)

    good = (F.col("slot") >= 0) & ~near(-1) & (~F.col("info.anchored") | (F.col("slot") == 0))
    for k in range(data.most_slots):
        good = good & ((kind == "any") | (F.col("info.slots") <= k) | near(k))
    together = sum(((F.col("info.slots") > k) & near(k)).cast("int") for k in range(data.most_slots))
    return rows.withColumns({"good": good, "together": together}).drop("info").drop(*(f"{n}{k + 1}" for n in ("last", "next") for k in slots))


def near_atoms(tokens: DataFrame, data: RuleData) -> dict[str, DataFrame]:
    """``unit_id, near``: the distance atoms that hold in each sentence and in each paragraph."""
    held = qualified(near_rows(tokens, data), data).where("good").select("sentence", "unit_id", "atom").distinct()
    lists = held.groupBy("sentence", "unit_id").agg(F.collect_list("atom").alias("near"))
    return {s: lists.where(F.col("sentence") == (s == "sentence")).select("unit_id", "near") for s in UNIT}


class Evaluation:
    """Rules over one corpus. ``sentences`` needs sentence_text if a rule has text groups.

    ``sentence_rows`` has a row per sentence of a candidate paragraph with ``forms`` and ``held``, the numbers of its
    forms and of the sentence programs that hold; ``paragraph_rows`` one per candidate paragraph with ``counts`` (in how
    many sentences each sentence program holds), ``held`` (paragraph programs), ``parted`` (rules whose token and text
    parts hold), ``base`` (and whose annotations do) and, with references applied, ``matched``. Numbers of rules count
    them in their order of evaluation. Candidates are paragraphs with a token of the vocabulary or an annotation, or all
    if a rule needs texts or only references.
    """

    def __init__(self, rules: RuleSet, tokens: DataFrame, sentences: DataFrame, annotations: DataFrame | None = None):
        self.rule_set, self.rules = rules, rules.ordered()
        self.data = RuleData(self.rules)
        self.sentences, self.annotations = sentences, annotations
        self.tokens = positioned(tokens, sentences, rules.vocabulary)
        self.needs_text = any(r.text_groups for r in self.rules)
        self.all_paragraphs = self.needs_text or any(not r.has_base for r in self.rules)

    def build(self) -> Evaluation:
        data, tokens = self.data, numbered_forms(self.tokens, self.data.forms)
        near = near_atoms(tokens, data) if data.near_atoms() else {}
        by_sentence = tokens.groupBy("paragraph_id", "sentence_id").agg(F.collect_set("form_no").alias("forms"))
        by_paragraph = tokens.groupBy("paragraph_id").agg(F.collect_set("form_no").alias("forms"))
        cols = ["paragraph_id", "sentence_id", "sentence_no_in_paragraph", "is_table_paragraph", *(["sentence_text"] if self.needs_text else [])]
        units = self.sentences.select(*cols).join(by_sentence, ["paragraph_id", "sentence_id"], "left").withColumn("forms", F.coalesce("forms", numbers()))
        units = self._with_near(units, near, "sentence")
        text = text_atoms(F.col("sentence_text"), data, "sentence") if self.needs_text else numbers()
        facts = F.concat(form_atoms(F.col("forms"), data, "sentence"), text, "near")
        self.sentence_rows = units.withColumn("held", let(facts, lambda f: programs(f, data, "sentence"))).drop("near")
        rows = self.sentence_rows.groupBy("paragraph_id").agg(F.count(F.lit(1)).alias("sentence_count"))
        if data.steps("sentence"):
            each = self.sentence_rows.select("paragraph_id", F.explode("held").alias("program")).groupBy("paragraph_id", "program").agg(F.count(F.lit(1)).alias("n"))
            rows = rows.join(each.groupBy("paragraph_id").agg(F.collect_list(F.struct("program", "n")).alias("counts")), "paragraph_id", "left")
        else:
            rows = rows.withColumn("counts", F.lit(None))
        rows = rows.withColumn("counts", F.coalesce(F.col("counts").cast("array<struct<program:int,n:bigint>>"), F.array().cast("array<struct<program:int,n:bigint>>")))
        rows = self._with_near(rows.join(by_paragraph, "paragraph_id", "left"), near, "paragraph")
        whole = bool(data.text_atoms("paragraph"))  # texts of paragraphs are only put together for rules that look there
        if whole:
            rows = rows.join(paragraph_texts(self.sentences).select("paragraph_id", "paragraph_text"), "paragraph_id")
        if self.annotations is not None:
            labels = self.annotations.groupBy("paragraph_id").agg(F.collect_set("annotation_pair").alias("labels"))
            rows = rows.join(labels, "paragraph_id", "left")
        else:
            rows = rows.withColumn("labels", F.lit(None).cast("array<string>"))
        if not self.all_paragraphs:
            rows = rows.where(F.col("forms").isNotNull() | F.col("labels").isNotNull())
        rows = rows.withColumns({"forms": F.coalesce("forms", numbers()), "labels": F.coalesce("labels", strings(()))})
        self.paragraph_rows = rule_columns(rows, data, F.col("paragraph_text") if whole else None)
        return self

    @staticmethod
    def _with_near(rows: DataFrame, near: dict[str, DataFrame], scope: str) -> DataFrame:
        if not near:
            return rows.withColumn("near", numbers())
        found = near[scope].withColumnRenamed("unit_id", UNIT[scope])
        return rows.join(found, UNIT[scope], "left").withColumn("near", F.coalesce("near", numbers()))

    # -------------------------------------------------------- long form
    def condition_eval(self, only_matched: bool = False) -> DataFrame:
        """One row per (paragraph, rule), or per matched rule: its partial verdicts, counts and the verdict."""
        which = F.col("matched") if only_matched else F.sequence(F.lit(0), F.lit(len(self.rules) - 1))
        if not self.rules:
            which = numbers()
        info = literal(
            self.data.info(), f"array<struct<id:string,category_text:string,scope:string,logic:string,forms:{NUMBERS},token:int,annot:int,text:int,counted:int>>"
        )
        rows = self.paragraph_rows.withColumn("rule_no", F.explode(which)).withColumn("i", F.get(info, F.col("rule_no")))

        def flag(part: str) -> Column:
            return F.when(F.col(f"i.{part}") >= 0, F.array_contains("held", F.col(f"i.{part}"))).alias(f"{part}_is_match")

        # units where the token part holds: sentences, or the paragraph itself
        n = F.filter("counts", lambda c: c["program"] == F.col("i.counted"))
        units = F.when(F.col("i.token") < 0, 0).when(F.col("i.counted") >= 0, F.coalesce(F.get(n, F.lit(0))["n"], F.lit(0))).otherwise(F.array_contains("held", F.col("i.token")).cast("long"))
        return rows.select(
            "paragraph_id", F.col("i.id").alias("condition_id"), F.col("i.category_text").alias("category_text"), F.col("i.scope").alias("unit_scope"), F.col("i.logic").alias("form_match_logic"),
            F.size("i.forms").cast("long").alias("required_form_count"), F.size(F.array_intersect("forms", "i.forms")).cast("long").alias("present_form_count"),
            F.when(F.col("i.scope") == "sentence", F.col("sentence_count")).otherwise(1).cast("long").alias("unit_count"), units.cast("long").alias("matched_unit_count"),
            flag("token"), flag("annot"), flag("text"), F.array_contains("base", F.col("rule_no")).alias("base_is_match"), F.array_contains("matched", F.col("rule_no")).alias("is_match"),
        )


def rule_columns(rows: DataFrame, data: RuleData, text: Column | None) -> DataFrame:
    """``held, parted, base, matched`` of paragraphs from ``forms, near, labels, counts``."""
    promoted = F.transform("counts", lambda c: c["program"] + data.first_promoted)
    facts = F.concat(form_atoms(F.col("forms"), data, "paragraph"), text_atoms(text, data, "paragraph") if text is not None else numbers(), label_atoms(F.col("labels"), data), "near", promoted)
    table = literal(data.parts(), f"array<struct<parts:{NUMBERS},annot:int>>")

    def parted(held: Column) -> Column:
        return F.filter(touched(held, data.rules_of_programs()), lambda r: F.forall(F.get(table, r)["parts"], lambda p: F.array_contains(held, p)))

    def based(held: Column, parted: Column) -> Column:
        return F.filter(parted, lambda r: (F.get(table, r)["annot"] < 0) | F.array_contains(held, F.get(table, r)["annot"]))

    def verdict(held: Column) -> Column:
        return let(parted(held), lambda p: let(based(held, p), lambda b: F.struct(held.alias("held"), p.alias("parted"), b.alias("base"), with_references(b, data).alias("matched"))))

    # a generator of one row: filters on what comes out are not moved below it, where each would compute the verdict anew
    return rows.select("*", F.inline(F.array(let(facts, lambda f: let(programs(f, data, "paragraph"), verdict))))).drop("near")


def with_references(base: Column, data: RuleData) -> Column:
    """Rules that hold once their references are looked up, in the order of evaluation; references point back only."""
    free = F.array_union(F.array_intersect(base, numbers(data.free())), numbers(data.unbound()))
    bound = data.bound()
    if not bound:
        return free
    table = literal(bound, f"array<struct<rule:int,based:boolean,tests:array<struct<any:{NUMBERS},negate:boolean>>>>")

    def step(matched: Column, r: Column) -> Column:
        holds = (~r["based"] | F.array_contains(base, r["rule"])) & F.forall(r["tests"], lambda t: F.arrays_overlap(matched, t["any"]) != t["negate"])
        return F.when(holds, F.concat(matched, F.array(r["rule"]))).otherwise(matched)

    return F.aggregate(table, free, step)


def matched_ids(data: RuleData, matched: Column) -> Column:
    ids = literal([r.id for r in data.rules], "array<string>")
    return F.array_sort(F.transform(matched, lambda r: F.get(ids, r)))


def matched_categories(data: RuleData, matched: Column) -> Column:
    categories = literal([list(r.categories) for r in data.rules], "array<array<string>>")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(matched, lambda r: F.get(categories, r)))))
