"""A rule set as numbered data: forms, atoms, programs and rules, with the indexes that lead from one to the next.

An atom is a test of one unit: enough forms of a list and none of another, texts, labels, or forms within a distance. A
program chains atoms of one scope from the left. Where a rule's groups mix scopes, what stands on the sentence side
becomes a sentence program, and "some sentence holds it" a fact of the paragraph. Equal atoms and programs of
different rules are the same one.
"""

from __future__ import annotations

from tessera.plans.rules import FormGroup, Rule, TextGroup

SENTENCE, PARAGRAPH = "sentence", "paragraph"


class RuleData:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.forms: dict[str, int] = {}
        self._atoms: dict[tuple, int] = {}
        self._programs: dict[str, dict[tuple, int]] = {SENTENCE: {}, PARAGRAPH: {}}
        for r in rules:
            for f in (*r.forms, *(x for g in r.form_groups for x in (*g.forms, *g.exclude_forms))):
                self.forms.setdefault(f, len(self.forms))
        #: For each rule (token, annot, text) paragraph programs, -1 where it has no such part.
        self._parts = [(self._token(r), self._annotations(r), self._chain(r.text_groups, self._text_atom)) for r in rules]
        self.first_promoted = len(self._atoms)
        # only now is the number of atoms known, behind which promoted programs are numbered as facts
        parts, self._programs[PARAGRAPH] = [], {}
        for three in self._parts:
            parts.append(tuple(None if p is None else self._add(PARAGRAPH, tuple((e, self.first_promoted + f[0] if isinstance(f, tuple) else f, n) for e, f, n in p)) for p in three))
        self._sentence_parts = [tuple(None if p is None or not (len(p) == 1 and isinstance(p[0][1], tuple) and p[0][1][1]) else p[0][1][0] for p in three) for three in self._parts]
        self._parts = [tuple(-1 if p is None else p for p in three) for three in parts]

    # ------------------------------------------------------------ building
    def _atom(self, *key) -> int:
        return self._atoms.setdefault(key, len(self._atoms))

    def _add(self, scope: str, steps: tuple) -> int:
        found = self._programs[scope]
        return found.setdefault(steps, len(found))

    def _numbers(self, forms) -> tuple[int, ...]:
        return tuple(self.forms[f] for f in forms)

    def _form_atom(self, g: FormGroup) -> tuple[int, bool]:
        """Atom of a group, and whether it counts negated."""
        without = self._numbers(g.exclude_forms)
        if g.distance is not None:
            if g.match_logic != "and":
                return self._atom("near", g.search_scope, self._numbers(g.forms), without, g.distance, "any", False), False
            ordered = (g.anchor_form, *(f for f in g.forms if f != g.anchor_form)) if g.anchor_form in g.forms else g.forms
            return self._atom("near", g.search_scope, self._numbers(ordered), without, g.distance, "around", g.anchor_form is not None), False
        if g.match_logic == "not":
            return self._atom("forms", g.search_scope, self._numbers(g.forms), 1, ()), True
        return self._atom("forms", g.search_scope, self._numbers(g.forms), len(g.forms) if g.match_logic == "and" else 1, without), False

    def _text_atom(self, g: TextGroup) -> tuple[int, bool]:
        return self._atom("texts", g.search_scope, g.texts, g.match_logic == "and"), g.match_logic == "not"

    def _promoted(self, steps: tuple, whole: bool) -> tuple[int, bool]:
        """A sentence program as a fact of the paragraph (marked as a tuple until atoms are counted)."""
        return self._add(SENTENCE, steps), whole

    def _chain(self, groups, atom) -> tuple | None:
        """Steps of a paragraph program for groups that combine from the left."""
        if not groups:
            return None
        scope, steps = None, ()
        for g in groups:
            number, negate = atom(g)
            now = (g.combine_logic != "and", number, negate)
            if scope is None:
                scope, steps = g.search_scope, ((True, number, negate),)
            elif scope == g.search_scope:
                steps += (now,)
            else:  # scopes differ: the sentence side becomes a fact of the paragraph, and the rest is judged there
                if scope == SENTENCE:
                    steps = ((True, self._promoted(steps, False), False),)
                else:
                    now = (now[0], self._promoted(((True, number, negate),), False), False)
                scope = PARAGRAPH
                steps += (now,)
        return ((True, self._promoted(steps, True), False),) if scope == SENTENCE else steps

    def _token(self, r: Rule) -> tuple | None:
        if not r.forms:
            return None
        if r.uses_groups:
            return self._chain(r.form_groups, self._form_atom)
        numbers, scope = self._numbers(r.forms), r.search_scope
        if r.distance is not None:
            number = self._atom("near", scope, numbers, (), r.distance, "ahead", False)
        else:
            number = self._atom("forms", scope, numbers, len(numbers) if r.form_match_logic == "all" else 1, ())
        steps = ((True, number, False),)
        return ((True, self._promoted(steps, True), False),) if scope == SENTENCE else steps

    def _annotations(self, r: Rule) -> tuple | None:
        return ((True, self._atom("labels", PARAGRAPH, tuple(f.label for f in r.annotation_filters)), False),) if r.annotation_filters else None

    # ------------------------------------------------------------ atoms
    def form_atoms(self) -> list[dict]:
        empty = {"need": [], "least": 1, "without": []}
        return [{"need": a[2], "least": a[3], "without": a[4]} if a[0] == "forms" else empty for a in self._atoms]

    def has_form_atoms(self, scope: str) -> bool:
        return any(a[:2] == ("forms", scope) for a in self._atoms)

    def atoms_of_forms(self, scope: str) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.forms]
        for n, a in enumerate(self._atoms):
            if a[:2] == ("forms", scope):
                for f in a[2]:
                    out[f].append(n)
        return out

    def text_atoms(self, scope: str) -> list[dict]:
        return [{"atom": n, "texts": a[2], "every": a[3]} for n, a in enumerate(self._atoms) if a[:2] == ("texts", scope)]

    def label_atoms(self) -> list[dict]:
        return [{"atom": n, "labels": a[2]} for n, a in enumerate(self._atoms) if a[0] == "labels"]

    def near_atoms(self) -> list[dict]:
        """By the number of the atom; empty if there is none with a distance."""
        if not any(a[0] == "near" for a in self._atoms):
            return []
        other = {"distance": -1, "slots": 0, "kind": "any", "anchored": False}
        return [{"distance": a[4], "slots": len(a[2]), "kind": a[5], "anchored": a[6]} if a[0] == "near" else other for a in self._atoms]

    def near_of_forms(self) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in self.forms]
        for n, a in enumerate(self._atoms):
            if a[0] == "near":
                for slot, f in [*enumerate(a[2]), *((-1, f) for f in a[3])]:
                    out[f].append({"atom": n, "slot": slot, "sentence": a[1] == SENTENCE})
        return out

    @property
    def most_slots(self) -> int:
        return max((len(a[2]) for a in self._atoms if a[0] == "near"), default=0)

    # ------------------------------------------------------------ programs
    def steps(self, scope: str) -> list[list[dict]]:
        return [[{"either": e, "fact": f, "negate": n} for e, f, n in p] for p in self._programs[scope]]

    def programs_of_facts(self, scope: str) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(len(self._atoms) + len(self._programs[SENTENCE]))]
        for k, p in enumerate(self._programs[scope]):
            for f in {f for _, f, _ in p}:
                out[f].append(k)
        return out

    def always(self, scope: str) -> list[int]:
        """Programs that can hold without a single fact."""

        def empty(p: tuple) -> bool:
            value = False
            for either, _, negate in p:
                value = value or negate if either else value and negate
            return value

        return [k for k, p in enumerate(self._programs[scope]) if empty(p)]

    # ------------------------------------------------------------ rules
    def parts(self) -> list[dict]:
        return [{"parts": [p for p in (token, text) if p >= 0], "annot": annot} for token, annot, text in self._parts]

    def rules_of_programs(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self._programs[PARAGRAPH]]
        for k, three in enumerate(self._parts):
            for p in {p for p in three if p >= 0}:
                out[p].append(k)
        return out

    def free(self) -> list[int]:
        return [k for k, r in enumerate(self.rules) if r.has_base and not r.has_reference]

    def unbound(self) -> list[int]:
        """Rules without a base and without references hold everywhere."""
        return [k for k, r in enumerate(self.rules) if not r.has_base and not r.has_reference]

    def tests(self, k: int) -> list[tuple[list[int], list[int], bool]]:
        """What rule ``k`` asks of the rules before it: (rules named by id, rules named by category, negated); one of
        them has to hold, or none. An unknown id never holds."""
        r, before = self.rules[k], self.rules[:k]
        named = {x.id: n for n, x in enumerate(before)}

        def ids(names) -> list[int]:
            return [named[n] for n in names if n in named]

        def categories(names) -> list[int]:
            return [n for n, x in enumerate(before) if set(names) & set(x.categories)]

        out = [([], categories([c]), False) for c in r.required_categories_all] + [(ids([i]), [], False) for i in r.required_ids_all]
        out += [([], categories(r.required_categories_any), False)] if r.required_categories_any else []
        out += [(ids(r.required_ids_any), [], False)] if r.required_ids_any else []
        return out + ([(ids(r.excluded_ids_any), [], True)] if r.excluded_ids_any else [])

    def bound(self) -> list[dict]:
        return [{"rule": k, "based": r.has_base, "tests": [{"any": a + b, "negate": n} for a, b, n in self.tests(k)]} for k, r in enumerate(self.rules) if r.has_reference]

    def layers(self) -> list[list[int]]:
        """Rules with references, by how many of them stand one behind the other."""
        depth: dict[int, int] = {}
        for k, r in enumerate(self.rules):
            if r.has_reference:
                depth[k] = 1 + max((depth.get(n, 0) for a, b, _ in self.tests(k) for n in a + b), default=0)
        return [[k for k in depth if depth[k] == n] for n in range(1, max(depth.values(), default=0) + 1)]

    @staticmethod
    def unit_scope(r: Rule) -> str:
        scopes = {g.search_scope for g in r.form_groups} if r.uses_groups else {r.search_scope}
        return scopes.pop() if len(scopes) == 1 else PARAGRAPH

    def info(self) -> list[dict]:
        """What the long form says of each rule; ``counted`` is the sentence program whose sentences count as units."""
        return [
            {"id": r.id, "category_text": r.category_text, "scope": self.unit_scope(r), "logic": r.form_match_logic, "forms": self._numbers(r.forms), "token": token, "annot": annot, "text": text, "counted": -1 if whole[0] is None else whole[0]}
            for r, (token, annot, text), whole in zip(self.rules, self._parts, self._sentence_parts)
        ]

    # ------------------------------------------------------------ sentence mode
    @staticmethod
    def mode_scope(r: Rule) -> str:
        return SENTENCE if r.overall_scope == SENTENCE or (not r.uses_groups and r.search_scope == SENTENCE) else PARAGRAPH

    def by_sentence(self) -> list[dict]:
        """How each rule is judged in a sentence of a paragraph where its token and text parts hold.

        ``whole``: as the paragraph's base. Else the sentence programs ``programs`` have to hold, one of the forms ``touch``
        has to be there if the list isn't empty, and the base if ``based``; ``never``: only annotations.
        """
        out = []
        for k, r in enumerate(self.rules):
            token, _, text = self._sentence_parts[k]
            row = {"whole": self.mode_scope(r) == PARAGRAPH, "programs": [p for p in (token, text) if p is not None], "touch": [], "based": False, "never": bool(r.annotation_filters) and not r.forms and not r.text_groups}
            if r.forms and token is None:
                row |= {"based": True, "touch": list(self._numbers(r.forms))}
            elif r.forms and r.uses_groups and any(g.match_logic == "not" for g in r.form_groups):
                row["touch"] = sorted({n for g in r.form_groups if g.match_logic != "not" for n in self._numbers(g.forms)})
            out.append(row)
        return out
