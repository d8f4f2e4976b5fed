"""Rule sets of any size against a plain re-statement of what rules mean, and plans that don't grow with them."""

import random

import pytest
from pyspark.sql import functions as F
from test_engine import corpus, rules

from tessera.operators import evaluate, groups, hits, positions, select
from tessera.session import Session

FORMS = "abcdefgh"


def random_rules(rng, n):
    out = []
    for i in range(n):
        e = {"condition_id": f"r{i}", "categories": rng.sample(["k1", "k2", "k3"], rng.randint(1, 2))}
        kind, scope = rng.random(), lambda: rng.choice(["sentence", "paragraph"])
        if kind < 0.3:
            e |= {"forms": rng.sample(FORMS, rng.randint(1, 3)), "form_match_logic": rng.choice(["all", "any"]), "search_scope": scope()}
            if rng.random() < 0.4 and len(e["forms"]) > 1:
                e |= {"form_match_logic": "all", "max_token_distance": rng.randint(0, 4)}
        elif kind < 0.75:
            made = []
            for k in range(rng.randint(1, 3)):
                g = {"forms": rng.sample(FORMS, rng.randint(1, 3)), "match_logic": rng.choice(["and", "or"] if not k else ["and", "or", "not"]), "search_scope": scope()}
                if k:
                    g["combine_logic"] = rng.choice(["and", "or"])
                if g["match_logic"] != "not" and rng.random() < 0.4:
                    g["max_token_distance"] = rng.randint(0, 3)
                    if g["match_logic"] == "and":
                        g["anchor_form"] = g["forms"][-1]
                if g["match_logic"] != "not" and rng.random() < 0.3:
                    g["exclude_forms_any"] = rng.sample(FORMS, 1)
                made.append(g)
            e |= {"form_groups": made, "overall_search_scope": scope()}
        if kind > 0.65 and rng.random() < 0.6:
            made = []
            for k in range(rng.randint(1, 2)):
                t = {"texts": ["".join(rng.sample(FORMS, rng.randint(1, 2))) for _ in range(2)], "match_logic": rng.choice(["and", "or"] if not k else ["and", "or", "not"]), "search_scope": scope()}
                made.append(t | ({"combine_logic": rng.choice(["and", "or"])} if k else {}))
            e["text_groups"] = made
        if rng.random() < 0.15:
            e["annotation_filters"] = [{"namespace": "n", "key": "k", "value": rng.choice("xy")}]
        if rng.random() < 0.35 or not any(x in e for x in ("forms", "form_groups", "text_groups", "annotation_filters")):
            c = rng.choice(["required_categories_all", "required_categories_any", "required_condition_ids_all", "required_condition_ids_any", "excluded_condition_ids_any"])
            pool = ["k1", "k2", "k3"] if "cat" in c else [f"r{j}" for j in range(i)] + ["nobody"]
            e[c] = rng.sample(pool, 1 if c.endswith("all") else min(2, len(pool)))
        out.append(e)
    return out


class Plain:
    """One paragraph: {sentence: forms}. Positions count through the paragraph."""

    def __init__(self, sentences, labels):
        self.sentences, self.labels = sentences, labels
        self.whole = [f for fs in sentences.values() for f in fs]

    def units(self, scope):
        return list(self.sentences.values()) if scope == "sentence" else [self.whole]

    @staticmethod
    def group(g, unit):
        at = {f: [k for k, x in enumerate(unit) if x == f] for f in {*g.forms, *g.exclude_forms}}
        if g.match_logic == "not":
            return not any(at[f] for f in g.forms)
        if g.distance is None:
            return (all if g.match_logic == "and" else any)(at[f] for f in g.forms) and not any(at[f] for f in g.exclude_forms)

        def near(f, p):
            return any(abs(q - p) <= g.distance for q in at[f])

        anchors = at[g.anchor_form] if g.match_logic == "and" else [p for f in g.forms for p in at[f]]
        return any((g.match_logic == "or" or all(near(f, p) for f in g.forms)) and not any(near(f, p) for f in g.exclude_forms) for p in anchors)

    @staticmethod
    def text(g, unit):
        found = [t in "".join(unit) for t in g.texts]
        return all(found) if g.match_logic == "and" else any(found) if g.match_logic == "or" else not any(found)

    def chain(self, gs, test):
        """(scope, truth per unit) of groups combined from the left."""
        scope, value = gs[0].search_scope, [test(gs[0], u) for u in self.units(gs[0].search_scope)]
        for g in gs[1:]:
            own, now = g.search_scope, [test(g, u) for u in self.units(g.search_scope)]
            if own != scope:
                scope, value, now = "paragraph", [any(value)], [any(now)]
            value = [(a and b) if g.combine_logic == "and" else (a or b) for a, b in zip(value, now)]
        return scope, value

    def token(self, r):
        if r.uses_groups:
            return self.chain(r.form_groups, self.group)
        if r.distance is not None:
            return r.search_scope, [any(all(any(u[q] == f for q in range(p, min(p + r.distance + 1, len(u)))) for f in r.forms) for p in range(len(u))) for u in self.units(r.search_scope)]
        return r.search_scope, [(all if r.form_match_logic == "all" else any)(f in u for f in r.forms) for u in self.units(r.search_scope)]

    def base(self, r):
        parts = [any(self.token(r)[1])] if r.forms else []
        parts += [all(f.label in self.labels for f in r.annotation_filters)] if r.annotation_filters else []
        parts += [any(self.chain(r.text_groups, self.text)[1])] if r.text_groups else []
        return all(parts)

    @staticmethod
    def references(r, before, by_id, by_category):
        known = {x.id for x in before}

        def of(c):
            return any(by_category(x) for x in before if c in x.categories)

        tests = [of(c) for c in r.required_categories_all] + [i in known and by_id(i) for i in r.required_ids_all]
        tests += [any(map(of, r.required_categories_any))] if r.required_categories_any else []
        tests += [any(i in known and by_id(i) for i in r.required_ids_any)] if r.required_ids_any else []
        return all(tests) and not any(i in known and by_id(i) for i in r.excluded_ids_any)

    def matched(self, ordered):
        out = set()
        for k, r in enumerate(ordered):
            if self.base(r) and self.references(r, ordered[:k], out.__contains__, lambda x: x.id in out):
                out.add(r.id)
        return out

    def by_sentence(self, ordered):
        out = {s: set() for s in self.sentences}
        whole = {r.id: not (r.overall_scope == "sentence" or (not r.uses_groups and r.search_scope == "sentence")) for r in ordered}
        for k, r in enumerate(ordered):
            anywhere = set().union(*out.values())
            own = dict.fromkeys(out, True)
            for n, s in enumerate(out):
                unit, parts = self.sentences[s], []
                if r.has_base and whole[r.id]:
                    parts = [self.base(r)]
                elif r.has_base:
                    if r.forms:
                        scope, value = self.token(r)
                        if scope == "sentence":
                            positive = [f for g in r.form_groups if g.match_logic != "not" for f in g.forms]
                            parts.append(value[n] and (not r.uses_groups or all(g.match_logic != "not" for g in r.form_groups) or any(f in unit for f in positive)))
                        else:
                            parts.append(self.base(r) and any(f in unit for f in r.forms))
                    elif r.annotation_filters and not r.text_groups:
                        parts.append(False)
                    if r.text_groups:
                        scope, value = self.chain(r.text_groups, self.text)
                        parts.append(value[n] if scope == "sentence" else any(value))
                own[s] = all(parts) and self.references(r, ordered[:k], lambda i, s=s: i in (anywhere if whole[i] else out[s]), lambda x: x.id in anywhere)
            for s, holds in own.items():
                out[s] |= {r.id} if holds else set()
        return out


def paragraphs(rng, n=16):
    return {p: {p * 10 + s: [rng.choice("abcdefghiii") for _ in range(rng.randint(1, 7))] for s in range(1, rng.randint(2, 5))} for p in range(1, n)}


@pytest.mark.parametrize("seed, n", [(1, 9), (2, 9), (3, 500)])
def test_against_a_plain_restatement(spark, seed, n):
    rng = random.Random(seed)
    units = paragraphs(rng)
    tokens, sentences = corpus(spark, units)
    labels = {p: "n:k=" + rng.choice("xyz") for p in units}
    pairs = spark.createDataFrame(list(labels.items()), "paragraph_id long, annotation_pair string")
    made = rules(*random_rules(rng, n), analysis_unit="sentence", max_reconstructed_paragraphs=10**6)
    e = evaluate.Evaluation(made, tokens, sentences, pairs).build()
    plain = {p: Plain(ss, {labels[p]}) for p, ss in units.items()}
    got = {r.paragraph_id: set(r.ids) for r in e.paragraph_rows.select("paragraph_id", evaluate.matched_ids(e.data, F.col("matched")).alias("ids")).collect()}
    assert got == {p: x.matched(e.rules) for p, x in plain.items()}
    rows = select.SentenceSelection(e, tokens).rows
    got = {r.sentence_id: set(r.ids) for r in rows.select("sentence_id", evaluate.matched_ids(e.data, F.col("truth")).alias("ids")).collect()}
    assert got == {s: ids for x in plain.values() for s, ids in x.by_sentence(e.rules).items()}


def test_five_hundred_rules_in_one_analysis(spark):
    rng = random.Random(9)
    tokens, sentences = corpus(spark, paragraphs(rng))
    made = rules(*random_rules(rng, 500))
    result = Session(tokens, sentences).analyze(made)
    want = {p: x.matched(made.ordered()) for p, x in {p: Plain(ss, set()) for p, ss in paragraphs(random.Random(9)).items()}.items()}
    assert {r.paragraph_id: set(r.matched_condition_ids_text.split(", ")) for r in result.export.collect()} == {p: ids for p, ids in want.items() if ids}


def test_exchanges_do_not_grow_with_the_rules(spark):
    tokens, sentences = corpus(spark, paragraphs(random.Random(1)))
    placed = positions.positioned(tokens, sentences)
    counts = []
    for n in (2, 40):
        mixed = [{"condition_id": f"r{k}", "form_groups": [{"forms": [FORMS[k % 8]], "search_scope": "sentence"}, {"forms": [FORMS[(k + 1) % 8], FORMS[(k + 2) % 8]], "anchor_form": FORMS[(k + 1) % 8], "max_token_distance": 2, "combine_logic": "or", "search_scope": "paragraph"}]} for k in range(n)]
        made = rules(*mixed)
        frames = [hits.group_hits(placed, list(made.rules)), groups.matched_units(placed, sentences, list(made.rules)), evaluate.Evaluation(made, tokens, sentences).build().paragraph_rows]
        counts.append([f._jdf.queryExecution().sparkPlan().toString().count("Exchange") + f._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for f in frames])
    assert counts[0] == counts[1]
