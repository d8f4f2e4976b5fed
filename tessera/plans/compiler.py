"""From raw rule entries to compiled rules: defaults, checks and one issue for each deviation.

An entry with an error is dropped as a whole; warnings change it. Issue codes are part of the interface.
"""

from __future__ import annotations

from collections.abc import Iterable

from tessera.plans.rules import SCOPES, UNCATEGORISED, AnnotationFilter, FormGroup, Issue, Rule, TextGroup


class Dropped(Exception):
    """The entry under construction has an error."""


def truthy(value: object) -> bool:
    if isinstance(value, str):
        return value.strip().lower() in ("1", "true", "yes", "on")
    return bool(value) if isinstance(value, (bool, int, float)) else False


def is_skipped(entry: object) -> bool:
    return isinstance(entry, dict) and truthy(entry.get("skip", False))


def cleaned(values: Iterable[object]) -> tuple[str, ...]:
    """Trimmed, without blanks, each once."""
    return tuple(dict.fromkeys(t for v in values if (t := str(v).strip())))


def lowered(value: object) -> str:
    return str(value).strip().lower()


def whole_number(value: object) -> int | None:
    try:
        return int(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


class Entry:
    """One raw entry with its place, and the issues found so far."""

    def __init__(self, raw: dict, index: int, issues: list[Issue]):
        self.raw, self.index, self.issues = raw, index, issues
        named = raw.get("condition_id")
        self.named = str(named).strip() if named is not None else ""
        self.id = self.named or f"condition_{index}"

    def note(self, code: str, message: str, field: str, severity: str = "warning") -> None:
        self.issues.append(Issue(code, severity, message, "condition", self.index, self.id, field))

    def error(self, code: str, message: str, field: str) -> Dropped:
        self.note(code, message, field, "error")
        return Dropped()

    def list_of(self, key: str, code: str, default: object = None) -> list | None:
        value = self.raw.get(key, default)
        if value is not None and not isinstance(value, list):
            raise self.error(code, f"{key} has to be a list.", key)
        return value


def _each(entry: Entry, key: str, values: list, build) -> tuple:
    """Build every member, so that all their errors are reported, then drop the entry if any had one."""
    out, failed = [], False
    for number, raw in enumerate(values, 1):
        try:
            out.append(build(entry, key, number, raw))
        except Dropped:
            failed = True
    if failed:
        raise Dropped
    return tuple(x for x in out if x is not None)


def _group_head(entry: Entry, key: str, number: int, raw: object, words: str, codes: dict[str, str]) -> tuple[tuple[str, ...], str, str | None, str]:
    """What form and text groups have in common: members, logic, combination, scope."""
    if not isinstance(raw, dict):
        raise entry.error(codes["object"], f"Members of {key} have to be objects.", key)
    members = raw.get(words, [])
    if not isinstance(members, list):
        raise entry.error(codes["list"], f"{key}[].{words} has to be a list.", key)
    members = cleaned(members)
    if not members:
        raise entry.error(codes["empty"], f"{key}[].{words} needs a non-empty value.", key)
    logic = lowered(raw.get("match_logic", "and"))
    if logic not in ("and", "or", "not"):
        raise entry.error(codes["logic"], f"{key}[].match_logic is and, or or not.", key)
    combine = None if raw.get("combine_logic") is None else lowered(raw["combine_logic"])
    if number == 1 and combine is not None:
        raise entry.error(codes["combine"], "The first group has nothing to combine with.", key)
    if number == 1 and logic == "not":
        raise entry.error(codes["not_first"], "The first group can't be a not group.", key)
    if number > 1 and combine not in ("and", "or"):
        raise entry.error(codes["combine"], "Later groups combine by and or or.", key)
    return members, logic, combine, _scope(entry, raw.get("search_scope", entry.scope), entry.scope, key)


def _scope(entry: Entry, value: object, default: str, field: str) -> str:
    scope = lowered(value)
    if scope in SCOPES:
        return scope
    entry.note("search_scope_defaulted", f"Unknown scope; {default} is used.", field)
    return default


def _distance(entry: Entry, value: object, field: str) -> int | None:
    if value is None:
        return None
    number = whole_number(value)
    if number is None or number < 0:
        entry.note("max_token_distance_ignored", "A distance is a whole number from 0 up; it is left out.", field)
        return None
    return number


FORM_CODES = {"object": "form_group_not_object", "list": "form_group_forms_not_list", "empty": "form_group_forms_empty", "logic": "group_logic_invalid", "combine": "combine_logic_invalid", "not_first": "group1_not_disallowed"}
TEXT_CODES = {"object": "text_group_not_object", "list": "text_group_texts_not_list", "empty": "text_group_texts_empty", "logic": "text_group_match_logic_invalid", "combine": "text_group_combine_logic_invalid", "not_first": "text_group1_not_disallowed"}


def _form_group(entry: Entry, key: str, number: int, raw: object) -> FormGroup:
    forms, logic, combine, scope = _group_head(entry, key, number, raw, "forms", FORM_CODES)
    anchor = str(raw.get("anchor_form", "")).strip() or None
    if anchor and anchor not in forms:
        raise entry.error("anchor_form_invalid", "anchor_form is one of the forms.", key)
    excluded = raw.get("exclude_forms_any", [])
    if excluded is not None and not isinstance(excluded, list):
        raise entry.error("exclude_forms_any_invalid", "exclude_forms_any has to be a list.", key)
    excluded = cleaned(excluded or ())
    if excluded and logic == "not":
        raise entry.error("exclude_forms_any_invalid", "not groups have no exclusions.", key)
    asked = _distance(entry, raw.get("max_token_distance"), key)
    used = asked
    if asked is not None and logic == "not":
        entry.note("not_group_distance_disabled", "not groups have no distance; it is left out.", key)
        used = None
    if logic == "and" and used is not None and anchor is None:
        raise entry.error("anchor_form_missing", "A distance in an and group needs an anchor_form.", key)
    if anchor and logic != "and":
        raise entry.error("anchor_form_invalid", "Only and groups have an anchor_form.", key)
    return FormGroup(forms, logic, combine, scope, asked, used, anchor, excluded)


def _text_group(entry: Entry, key: str, number: int, raw: object) -> TextGroup:
    return TextGroup(*_group_head(entry, key, number, raw, "texts", TEXT_CODES))


def _annotation_filter(entry: Entry, key: str, number: int, raw: object) -> AnnotationFilter:
    if not isinstance(raw, dict):
        raise entry.error("annotation_filter_not_object", "Annotation filters have to be objects.", key)
    parts = {k: str(raw.get(k, "")).strip() for k in ("namespace", "key", "value")}
    if lowered(raw.get("operator", "eq")) != "eq":
        entry.note("annotation_filter_operator_defaulted", "The only operator is eq.", key)
    if missing := [k for k, v in parts.items() if not v]:
        raise entry.error("annotation_filter_field_missing", f"Annotation filter without {', '.join(missing)}.", key)
    return AnnotationFilter(**parts)


def _references(entry: Entry, key: str) -> tuple[str, ...]:
    values = entry.list_of(key, f"{key}_not_list")
    got = cleaned(values or ())
    if values and not got:
        raise entry.error("reference_clause_empty", f"{key} has only blanks.", key)
    return got


REFERENCES = {
    "required_categories_all": "required_categories_all", "required_categories_any": "required_categories_any",
    "required_condition_ids_all": "required_ids_all", "required_condition_ids_any": "required_ids_any", "excluded_condition_ids_any": "excluded_ids_any",
}


def _compile_one(entry: Entry, used: set[str]) -> Rule:
    raw = entry.raw
    entry.scope = "paragraph"
    entry.scope = _scope(entry, raw.get("overall_search_scope", "paragraph"), "paragraph", "overall_search_scope")
    forms = cleaned(entry.list_of("forms", "forms_not_list", []) or ())
    if raw.get("forms", []) is None:
        raise entry.error("forms_not_list", "forms has to be a list.", "forms")
    groups = _each(entry, "form_groups", entry.list_of("form_groups", "form_groups_not_list") or [], _form_group)
    if "form_groups" in raw and forms:
        raise entry.error("legacy_and_form_groups_mixed", "forms and form_groups exclude each other.", "form_groups")
    filters = tuple(dict.fromkeys(_each(entry, "annotation_filters", entry.list_of("annotation_filters", "annotation_filters_not_list", []) or [], _annotation_filter)))
    references = {name: _references(entry, key) for key, name in REFERENCES.items()}
    texts = _each(entry, "text_groups", entry.list_of("text_groups", "text_groups_not_list") or [], _text_group)
    asked = used_distance = None
    if groups:
        forms = tuple(dict.fromkeys(f for g in groups for f in g.forms))
        logic, scope = "all" if groups[0].match_logic == "and" else "any", entry.scope
        if len(groups) == 1:
            asked, used_distance = groups[0].requested_distance, groups[0].distance
    else:
        logic, scope = lowered(raw.get("form_match_logic", "all")), lowered(raw.get("search_scope", entry.scope))
    if not (forms or filters or texts or any(references.values())):
        raise entry.error("forms_empty", "A rule needs a clause: forms, groups, annotation filters or references.", "forms")
    if not entry.named:
        entry.note("condition_id_generated", "A rule without an id gets one from its place.", "condition_id")
    base, k = entry.id, 2
    while entry.id in used:
        entry.id, k = f"{base}_{k}", k + 1
    if entry.id != base:
        entry.note("condition_id_deduplicated", "The id was taken; it gets a number.", "condition_id")
    used.add(entry.id)
    legacy_any = logic == "any"
    if logic not in ("all", "any"):
        entry.note("form_match_logic_defaulted", "form_match_logic is all or any; all is used.", "form_match_logic")
        logic = "all"
    if scope not in SCOPES:
        entry.note("search_scope_defaulted", "Unknown scope; paragraph is used.", "search_scope")
        scope = "paragraph"
    if filters and scope == "sentence":
        entry.note("annotation_filters_search_scope_normalized", "Annotations are of paragraphs, so the scope is too.", "search_scope")
        scope = "paragraph"
    if not groups and (forms or raw.get("form_match_logic") is not None or raw.get("max_token_distance") is not None):
        entry.note("legacy_schema_migrated", "forms became one form group.", "forms")
        groups = (FormGroup(forms, "or" if legacy_any else "and", None, scope),)
    if "form_groups" not in raw:
        asked = _distance(entry, raw.get("max_token_distance"), "max_token_distance")
        used_distance = asked if logic == "all" and forms else None
    categories = raw.get("categories")
    categories = cleaned(c for c in (categories if isinstance(categories, list) else [categories]) if c is not None) or (UNCATEGORISED,)
    if categories == (UNCATEGORISED,):
        entry.note("categories_defaulted", "A rule without a category gets the default one.", "categories")
    if asked is not None and (logic != "all" or not forms):
        entry.note("max_token_distance_disabled", "A distance needs forms and all-logic.", "max_token_distance")
    return Rule(entry.id, categories, forms, scope, entry.scope, logic, asked, used_distance, groups, texts, filters, **references)


def in_cycles(rules: list[Rule]) -> list[str]:
    """Ids that can reach themselves over id references, sorted."""
    known = {r.id: {i for i in r.referenced_ids} for r in rules}
    found = []
    for start in known:
        seen, todo = set(), [i for i in known[start] if i in known]
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                todo += [j for j in known[i] if j in known]
        if start in seen:
            found.append(start)
    return sorted(found)


def compile_rules(entries: list[object]) -> tuple[list[Rule], list[Issue]]:
    rules, issues, used = [], [], set()
    for index, raw in enumerate(entries, 1):
        if not isinstance(raw, dict):
            issues.append(Issue("condition_not_object", "error", "Rules have to be objects.", "condition", index))
        elif not is_skipped(raw):
            try:
                rules.append(_compile_one(Entry(raw, index, issues), used))
            except Dropped:
                pass
    cycle = in_cycles(rules)
    issues += [Issue("condition_id_reference_cycle", "error", "The rule refers to itself over other rules.", "condition", None, i, "required_condition_ids_all") for i in cycle]
    return [r for r in rules if r.id not in cycle], issues
