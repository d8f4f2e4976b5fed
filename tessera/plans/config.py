"""Loading rule files: runtime JSON and the authoring format with sets, defaults and shorthand matches."""

from __future__ import annotations

import tempfile
import os
import json
from dataclasses import dataclass, field
from pathlib import Path

from tessera.plans.compiler import cleaned, compile_rules, is_skipped, lowered, whole_number
from tessera.plans.rules import SCOPES, Issue, RuleSet, Settings

#: Settings, their choices, and the format's name.
CHOICES = {"condition_match_logic": ("any", "all"), "analysis_unit": ("paragraph", "sentence"), "distance_matching_mode": ("strict", "auto-approx", "approx")}
NUMBERS = ("max_reconstructed_paragraphs", "distance_match_combination_cap", "distance_match_strict_safety_limit")
FORMAT = "condition-authoring/v1"


# ---------------------------------------------------------------- runtime JSON
def read_settings(raw: dict) -> tuple[Settings, list[Issue]]:
    """Settings of a runtime file; each value that can't be used becomes its default, with a warning."""
    values, issues, standard = {}, [], Settings()

    def defaulted(name: str) -> None:
        issues.append(Issue(f"{name}_defaulted", "warning", f"{name} is not usable; {getattr(standard, name)} is used.", "filter_config", field_name=name))

    for name in ("condition_match_logic", NUMBERS[0], "analysis_unit", "distance_matching_mode", *NUMBERS[1:]):
        if name not in raw:
            continue
        if name in CHOICES:
            value = lowered(raw[name])
            if value in CHOICES[name]:
                values[name] = value
            else:
                defaulted(name)
        else:
            number = whole_number(raw[name])
            if number is not None and number >= 1:
                values[name] = number
            else:
                defaulted(name)
    return Settings(**values), issues


def compile_runtime(raw: dict) -> RuleSet:
    entries = raw.get("cooccurrence_conditions", [])
    if not isinstance(entries, list):
        raise ValueError("cooccurrence_conditions has to be a list")
    settings, issues = read_settings(raw)
    rules, found = compile_rules([e for e in entries if not is_skipped(e)])
    return RuleSet(tuple(rules), settings, (*issues, *found), len(entries))


def load_runtime(path: str | Path) -> RuleSet:
    """A missing file, broken JSON and a root that isn't an object raise; all else is reported in ``issues``."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"no rule file at {path}")
    try:
        raw = json.loads(path.read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is not JSON: {e}") from e
    if not isinstance(raw, dict):
        raise ValueError(f"the root of {path} has to be an object")
    return compile_runtime(raw)


# ---------------------------------------------------------------- authoring format
@dataclass
class Authored:
    """``runtime``: the runtime JSON; ``rule_set``: compiled, unless there was an error."""

    runtime: dict | None = None
    rule_set: RuleSet | None = None
    issues: list[Issue] = field(default_factory=list)


class Invalid(Exception):
    def __init__(self, code: str, message: str, rule: str | None = None, name: str | None = None):
        self.issue = Issue(code, "error", message, "condition" if rule else "filter_config", condition_id=rule, field_name=name)


def _texts(value: object) -> list[str]:
    return [t for v in value if (t := str(v).strip())]  # type: ignore[union-attr]


class Author:
    """Expansion of one authoring document."""

    def __init__(self, document: dict, issues: list[Issue]):
        self.document, self.issues = document, issues
        self.rules = document.get("rules")
        if self.rules is None:
            raise Invalid("authoring_rules_missing", "rules is missing.", name="rules")
        if not isinstance(self.rules, list):
            raise Invalid("authoring_rules_invalid", "rules has to be a list.", name="rules")
        self.sets = self._sets()
        named = [(r["id"].strip(), r.get("skip") is True) for r in self.rules if isinstance(r, dict) and isinstance(r.get("id"), str) and r["id"].strip()]
        self.ids, self.active = {i for i, _ in named}, {i for i, skipped in named if not skipped}
        self.scope, self.exclude = self._defaults()

    def _sets(self) -> dict[str, list[str]]:
        raw = self.document.get("sets")
        if raw is None:
            return {}
        if not isinstance(raw, dict):
            raise Invalid("authoring_sets_invalid", "sets has to be an object.", name="sets")
        for name, members in raw.items():
            if not isinstance(members, list) or not members or len(_texts(members)) != len(members):
                raise Invalid("authoring_set_invalid", f"Set {name} needs a list of non-empty strings.", name=f"sets.{name}")
        return {str(name): _texts(members) for name, members in raw.items()}

    def _scope(self, value: object, **where) -> str:
        if lowered(value) not in SCOPES:
            raise Invalid("authoring_scope_invalid", f"{value!r} is not a scope.", **where)
        return lowered(value)

    def _defaults(self) -> tuple[str, list[str] | None]:
        raw = self.document.get("defaults")
        if raw is None:
            return "paragraph", None
        if not isinstance(raw, dict):
            raise Invalid("authoring_defaults_invalid", "defaults has to be an object.", name="defaults")
        scope = "paragraph" if raw.get("scope") is None else self._scope(raw["scope"], name="defaults.scope")
        exclude = raw.get("exclude_any")
        if exclude is None:
            return scope, None
        if not isinstance(exclude, list):
            raise Invalid("authoring_defaults_invalid", "defaults.exclude_any has to be a list.", name="defaults.exclude_any")
        exclude = _texts(exclude)
        for i in exclude:
            if i not in self.active:
                raise Invalid("unknown_condition_reference", f"defaults.exclude_any: no active rule {i}.", name="defaults.exclude_any")
        return scope, exclude

    # ------------------------------------------------------------ matches
    def _terms(self, rule: str, value: object, where: str) -> list[str]:
        """Terms with @set names and bare set names replaced by their members, each once."""
        if not isinstance(value, list):
            raise Invalid("authoring_match_invalid", f"{where} has to be a list.", rule)
        out: dict[str, None] = {}
        for term in _texts(value):
            if term.startswith("@"):
                if term[1:] not in self.sets:
                    raise Invalid("unknown_set_reference", f"No set {term[1:]}.", rule)
                out |= dict.fromkeys(self.sets[term[1:]])
            elif term in self.sets:
                if term in self.ids:
                    raise Invalid("ambiguous_set_reference", f"{term} is a set and a rule.", rule)
                out |= dict.fromkeys(self.sets[term])
            else:
                out[term] = None
        if not out:
            raise Invalid("authoring_match_invalid", f"{where} needs a non-empty value.", rule)
        return list(out)

    def _window(self, rule: str, value: object) -> dict:
        if not isinstance(value, dict):
            raise Invalid("authoring_match_invalid", "token_window has to be an object.", rule)
        terms = self._terms(rule, value.get("terms"), "token_window.terms")
        anchor, distance = value.get("anchor"), whole_number(value.get("distance"))
        if anchor is None or str(anchor).strip() not in terms:
            raise Invalid("authoring_match_invalid", "token_window.anchor is one of the terms.", rule)
        if distance is None or distance < 0:
            raise Invalid("authoring_match_invalid", "token_window.distance is a whole number from 0 up.", rule)
        return {"forms": terms, "match_logic": "and", "anchor_form": str(anchor).strip(), "max_token_distance": distance}

    def _clause(self, rule: str, key: str, value: object) -> tuple[str, dict]:
        if key == "token_window":
            return "form_groups", self._window(rule, value)
        return "text_groups", {"texts": self._terms(rule, value, key), "match_logic": "or" if key == "text_any" else "and"}

    def _match(self, rule: str, match: object) -> dict[str, list[dict]]:
        clauses = ("text_any", "text_all", "token_window")
        if not isinstance(match, dict) or not match:
            raise Invalid("authoring_match_invalid", "match has to be an object with a clause.", rule)
        joined = [k for k in ("any", "all") if k in match]
        if unknown := sorted(set(match) - set(joined or clauses)):
            raise Invalid("authoring_match_invalid", f"match has unknown keys: {unknown}.", rule)
        groups: dict[str, list[dict]] = {}
        if not joined:
            if len(match) > 1:
                raise Invalid("authoring_match_invalid", "match has one clause; any and all join several.", rule)
            (key, value), = match.items()
            kind, group = self._clause(rule, key, value)
            return {kind: [group]}
        members = match[joined[0]]
        if not isinstance(members, list) or not members:
            raise Invalid("authoring_match_invalid", f"match.{joined[0]} has to be a non-empty list.", rule)
        for member in members:
            if not isinstance(member, dict) or len(member) != 1 or next(iter(member)) not in clauses:
                raise Invalid("authoring_match_invalid", f"Members of match.{joined[0]} have one clause each.", rule)
            kind, group = self._clause(rule, *next(iter(member.items())))
            if kind in groups:
                group["combine_logic"] = "or" if joined[0] == "any" else "and"
            groups.setdefault(kind, []).append(group)
        if joined[0] == "any" and len(groups) > 1:
            raise Invalid("authoring_match_invalid", "match.any can't mix texts and tokens.", rule)
        return groups

    # ------------------------------------------------------------ rules
    #: Keys of the runtime format that pass through.
    PASSED = (
        "required_categories_all", "required_categories_any", "required_condition_ids_all", "required_condition_ids_any", "excluded_condition_ids_any",
        "form_groups", "text_groups", "annotation_filters", "forms", "form_match_logic", "search_scope", "max_token_distance",
    )

    def _categories(self, rule: str, raw: dict) -> list[str]:
        labels, label = raw.get("labels"), raw.get("label")
        if isinstance(labels, list) and labels:
            if label is not None:
                self.issues.append(Issue("label_ignored", "warning", "labels stands before label.", condition_id=rule))
            return [x for x in labels if isinstance(x, str)]
        return [label] if isinstance(label, str) else []

    def expand(self) -> list[dict]:
        seen, out = set(), []
        for place, raw in enumerate(self.rules):
            if not isinstance(raw, dict):
                raise Invalid("authoring_rule_invalid", f"Rule {place} has to be an object.")
            rule = raw.get("id")
            if not isinstance(rule, str) or not rule.strip():
                raise Invalid("authoring_rule_id_invalid", f"Rule {place} needs an id.")
            rule = rule.strip()
            if rule in seen:
                raise Invalid("authoring_rule_id_duplicate", f"There are two rules {rule}.", rule)
            seen.add(rule)
            if raw.get("skip") is not True:
                out.append(self._rule(rule, raw))
        return out

    def _rule(self, rule: str, raw: dict) -> dict:
        groups = self._match(rule, raw["match"]) if "match" in raw else {}
        categories = self._categories(rule, raw)
        scope = self.scope if raw.get("scope") is None else self._scope(raw["scope"], rule=rule)
        made = {"condition_id": rule, "categories": categories, "overall_search_scope": scope} | {k: raw[k] for k in self.PASSED if k in raw}
        for key, target in (("requires_all", "required_condition_ids_all"), ("requires_any", "required_condition_ids_any"), ("exclude_any", "excluded_condition_ids_any")):
            if isinstance(raw.get(key), list):
                made[target] = _texts(raw[key])
                for i in made[target]:
                    if i not in self.active:
                        raise Invalid("unknown_condition_reference", f"{key}: no active rule {i}.", rule)
        own = raw.get("exclude_any")
        if "exclude_any" not in raw and self.exclude:
            made["excluded_condition_ids_any"] = list(self.exclude)
        elif isinstance(own, list):  # an explicit [] switches the default off
            together = list(cleaned([*own, *(self.exclude or [])])) if own else []
            made.pop("excluded_condition_ids_any", None)
            if together:
                made["excluded_condition_ids_any"] = together
        for group in groups.get("form_groups", ()):
            group["search_scope"] = scope
        return made | groups


def _author_settings(raw: object, issues: list[Issue]) -> dict:
    if raw is None:
        raw = {}
    if not isinstance(raw, dict):
        raise Invalid("invalid_settings_value", "settings has to be an object.", name="settings")
    issues += [Issue("unknown_settings_field", "warning", f"There is no setting {k}.", "filter_config", field_name=k) for k in raw if k not in (*CHOICES, *NUMBERS)]
    out, standard, failed = {}, Settings(), False
    for name in (*CHOICES, *NUMBERS):
        value = raw.get(name)
        if value is None:
            out[name] = getattr(standard, name)
            continue
        good = lowered(value) if name in CHOICES else whole_number(value)
        if (good in CHOICES[name]) if name in CHOICES else (good is not None and good >= 1):
            out[name] = good
        else:
            failed = True
            issues.append(Issue("invalid_settings_value", "error", f"{name} can't be {value!r}.", "filter_config", field_name=name))
    if failed:
        raise _Stop
    return out


class _Stop(Exception):
    pass


def compile_authoring(document: object) -> Authored:
    """Expand an authoring document to runtime JSON and compile that. The first error in it ends the expansion."""
    out = Authored()
    try:
        if not isinstance(document, dict):
            raise Invalid("authoring_root_invalid", "The root has to be an object.")
        if document.get("format") is None:
            raise Invalid("authoring_format_missing", f"format is missing; it is {FORMAT}.", name="format")
        if document["format"] != FORMAT:
            raise Invalid("authoring_format_invalid", f"format is {FORMAT}.", name="format")
        runtime = _author_settings(document.get("settings"), out.issues)
        runtime["cooccurrence_conditions"] = Author(document, out.issues).expand()
    except Invalid as e:
        out.issues.append(e.issue)
        return out
    except _Stop:
        return out
    rules, found = compile_rules(runtime["cooccurrence_conditions"])
    out.runtime, out.issues = runtime, [*out.issues, *found]
    if not any(i.severity == "error" for i in found):
        settings = Settings(**{k: runtime[k] for k in (*CHOICES, *NUMBERS)})
        out.rule_set = RuleSet(tuple(rules), settings, tuple(out.issues), len(document["rules"]))
    return out


def load_authoring(path: str | Path) -> Authored:
    path = Path(path)
    if path.suffix.lower() in (".yaml", ".yml"):
        return Authored(issues=[Issue("yaml_not_supported_in_v1", "error", f"{path}: only JSON is read.", "filter_config")])
    if not path.exists():
        return Authored(issues=[Issue("authoring_file_not_found", "error", f"no file {path}", "filter_config")])
    try:
        document = json.loads(path.read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        return Authored(issues=[Issue("authoring_json_invalid", "error", f"{path}: {e}", "filter_config")])
    return compile_authoring(document)


def write_runtime(document_path: str, out_path: str, issues_path: str | None = None) -> int:
    """Compile an authoring file to a runtime file and, if asked, an issues file. 0 if there was no error."""
    got = load_authoring(document_path)
    if issues_path:
        Path(issues_path).write_text(json.dumps([vars(i) for i in got.issues], ensure_ascii=False, indent=2), encoding="utf-8")
    if got.rule_set is None:
        return 1
    Path(out_path).write_text(json.dumps(got.runtime, ensure_ascii=False, indent=2), encoding="utf-8")
    return 0


# ---------------------------------------------------------------- documents of conditions
#: Fixed value: the category of a condition that names none.
NO_CATEGORY = "未分類"


def save_document(path: str, document: dict) -> None:
    """Write a condition document as JSON, whole or not at all; folders on the way are made."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(document, f, ensure_ascii=False, indent=2)
            f.write("\n")
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def chosen_conditions(document: dict, categories: list[str] | None = None, ids: list[str] | None = None) -> dict:
    """The document with the conditions of the chosen categories and ids only (None: all).

    Ids are made whole before: a missing one is ``condition_<place>``, one that is taken gets a number. Entries that
    are no objects go.
    """
    taken: set[str] = set()
    kept = []
    for place, raw in enumerate(document.get("cooccurrence_conditions") or [], 1):
        if not isinstance(raw, dict):
            continue
        first = str(raw.get("condition_id") or "").strip() or f"condition_{place}"
        name = next(n for n in (first, *(f"{first}_{k}" for k in range(2, len(taken) + 3))) if n not in taken)
        taken.add(name)
        listed = raw.get("categories") if isinstance(raw.get("categories"), list) else [raw.get("categories")]
        own = list(dict.fromkeys(c for c in (str(x).strip() for x in listed if x is not None) if c)) or [NO_CATEGORY]
        if (categories is None or set(own) & set(categories)) and (ids is None or name in ids):
            kept.append(raw | {"condition_id": name, "categories": own})
    return document | {"cooccurrence_conditions": kept}


# ---------------------------------------------------------------- one form group for flat conditions, and back
#: Keys that say what a flat condition's forms have to do, and the mark of a condition that was flat.
FLAT = ("forms", "form_match_logic", "search_scope", "max_token_distance")
WAS_FLAT = "projected_from_legacy"


def as_groups(condition: dict) -> dict:
    """A flat condition with its forms as one form group, marked, for an editor that knows groups only.

    A condition that has groups, or no word about forms, stays as it is.
    """
    if condition.get("form_groups") or not any(condition.get(k) not in (None, []) for k in FLAT):
        return condition
    group = {"forms": condition.get("forms") or []}
    if condition.get("form_match_logic") is not None:
        group["match_logic"] = "or" if str(condition["form_match_logic"]).strip().lower() == "any" else "and"
    group |= {k: condition[k] for k in ("search_scope", "max_token_distance") if condition.get(k) is not None}
    return {k: v for k, v in condition.items() if k not in FLAT} | {"form_groups": [group], WAS_FLAT: True}


def as_flat(condition: dict) -> dict:
    """The inverse: a marked condition goes back to flat keys if its one group still says no more than those can.

    That is one group that isn't combined, negated, anchored or excluding. Otherwise it keeps its groups; the mark goes
    either way.
    """
    marked, groups = condition.get(WAS_FLAT), condition.get("form_groups") or []
    out = {k: v for k, v in condition.items() if k != WAS_FLAT}
    if not marked or len(groups) != 1:
        return out
    (g,) = groups
    if g.get("match_logic") not in (None, "and", "or") or g.get("combine_logic") is not None or g.get("anchor_form") is not None or g.get("exclude_forms_any"):
        return out
    del out["form_groups"]
    if g.get("forms"):
        out["forms"] = g["forms"]
    if g.get("match_logic") is not None:
        out["form_match_logic"] = "any" if g["match_logic"] == "or" else "all"
    return out | {k: g[k] for k in ("search_scope", "max_token_distance") if g.get(k) is not None}
