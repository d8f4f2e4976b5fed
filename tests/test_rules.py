"""Rule compilation: codes in order, defaults, cycles, the authoring format."""

import json

import pytest

from tessera.plans.compiler import compile_rules, truthy
from tessera.plans.config import FORMAT, compile_authoring, compile_runtime, load_authoring, load_runtime, write_runtime
from tessera.plans.rules import UNCATEGORISED, RuleSet


def codes(*entries):
    return [i.code for i in compile_rules(list(entries))[1]]


def test_legacy_rule_becomes_a_group():
    (rule,), issues = compile_rules([{"condition_id": "a", "categories": ["x"], "forms": ["p", " q ", "p"], "max_token_distance": 5, "search_scope": "sentence"}])
    assert [i.code for i in issues] == ["legacy_schema_migrated"]
    assert (rule.forms, rule.distance, rule.form_groups[0].distance, rule.search_scope) == (("p", "q"), 5, None, "sentence")


def test_codes_in_order():
    assert codes({"forms": ["a"]}) == ["condition_id_generated", "legacy_schema_migrated", "categories_defaulted"]
    assert codes(3, {"condition_id": "x"}, {"condition_id": "y", "forms": "a"}) == ["condition_not_object", "forms_empty", "forms_not_list"]
    assert codes({"condition_id": "a", "categories": "c", "form_groups": [{"forms": ["p"], "match_logic": "xor"}, {"forms": []}, 7]}) == ["group_logic_invalid", "form_group_forms_empty", "form_group_not_object"]
    assert codes({"condition_id": "a", "categories": "c", "form_groups": [{"forms": ["p"], "match_logic": "not"}]}) == ["group1_not_disallowed"]
    assert codes({"condition_id": "a", "categories": "c", "form_groups": [{"forms": ["p"], "max_token_distance": 2}]}) == ["anchor_form_missing"]
    assert codes({"condition_id": "a", "categories": "c", "text_groups": [{"texts": ["t"]}, {"texts": ["u"]}]}) == ["text_group_combine_logic_invalid"]
    assert codes({"condition_id": "a", "categories": "c", "annotation_filters": [{"namespace": "n"}]}) == ["annotation_filter_field_missing"]
    assert codes({"condition_id": "a", "categories": "c", "required_condition_ids_all": [" "]}) == ["reference_clause_empty"]
    assert codes({"condition_id": "a", "categories": "c", "forms": ["x"], "form_groups": []}) == ["legacy_and_form_groups_mixed"]


def test_warnings_change_the_rule():
    (rule,), issues = compile_rules([{"condition_id": "a", "forms": ["p"], "form_match_logic": "any", "max_token_distance": -1, "search_scope": "line"}])
    assert [i.code for i in issues] == ["search_scope_defaulted", "legacy_schema_migrated", "max_token_distance_ignored", "categories_defaulted"]
    assert rule.categories == (UNCATEGORISED,) and rule.form_groups[0].match_logic == "or"


def test_ids_are_made_unique_and_cycles_go():
    rules, issues = compile_rules([{"condition_id": "a", "categories": "c", "form_groups": [{"forms": ["x"]}]}] * 2)
    assert [r.id for r in rules] == ["a", "a_2"] and [i.code for i in issues] == ["condition_id_deduplicated"]
    rules, issues = compile_rules([
        {"condition_id": "a", "categories": "c", "required_condition_ids_all": ["b"]}, {"condition_id": "b", "categories": "c", "excluded_condition_ids_any": ["a"]},
        {"condition_id": "d", "categories": "c", "required_condition_ids_any": ["a"]},
    ])
    assert [r.id for r in rules] == ["d"] and [i.condition_id for i in issues] == ["a", "b"]


def test_order_follows_references():
    rules, _ = compile_rules([{"condition_id": "z", "categories": "c", "required_condition_ids_all": ["y"]}, {"condition_id": "y", "categories": "c", "form_groups": [{"forms": ["f"]}]}])
    assert [r.id for r in RuleSet(tuple(rules)).ordered()] == ["y", "z"]


def test_skip_values():
    assert [truthy(v) for v in (True, "Yes", " on ", 1, "0", "", None, 0, [])] == [True, True, True, True, False, False, False, False, False]


def test_settings(tmp_path):
    got = compile_runtime({"condition_match_logic": "most", "analysis_unit": "sentence", "max_reconstructed_paragraphs": "x", "distance_match_combination_cap": 0, "cooccurrence_conditions": []})
    assert [i.code for i in got.issues] == ["condition_match_logic_defaulted", "max_reconstructed_paragraphs_defaulted", "distance_match_combination_cap_defaulted"]
    assert got.settings.analysis_unit == "sentence" and got.settings.max_reconstructed_paragraphs == 10_000
    with pytest.raises(FileNotFoundError):
        load_runtime(tmp_path / "none.json")
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        load_runtime(tmp_path / "bad.json")


def author(**rest):
    return compile_authoring({"format": FORMAT, **rest})


def test_authoring_expands_sets_and_matches():
    got = author(sets={"s": ["u", "v"]}, defaults={"scope": "sentence", "exclude_any": ["q"]}, rules=[
        {"id": "p", "label": "L", "labels": ["M"], "match": {"all": [{"text_any": ["@s", "w"]}, {"token_window": {"terms": ["a", "b"], "anchor": "a", "distance": 2}}]}},
        {"id": "q", "label": "L", "match": {"text_all": ["s"]}, "exclude_any": []}, {"id": "r", "skip": True},
    ])
    p, q = got.rule_set.rules
    assert p.text_groups[0].texts == ("u", "v", "w") and p.form_groups[0].search_scope == "sentence" and p.excluded_ids_any == ("q",)
    assert q.text_groups[0].texts == ("u", "v") and q.excluded_ids_any == () and p.categories == ("M",)
    assert [i.code for i in got.issues] == ["label_ignored"] and got.rule_set.loaded == 3


@pytest.mark.parametrize("document, code", [
    (5, "authoring_root_invalid"), ({}, "authoring_format_missing"), ({"format": "v9"}, "authoring_format_invalid"), ({"format": FORMAT}, "authoring_rules_missing"),
    ({"format": FORMAT, "rules": 1}, "authoring_rules_invalid"), ({"format": FORMAT, "rules": [], "sets": {"a": []}}, "authoring_set_invalid"),
    ({"format": FORMAT, "rules": [], "defaults": {"scope": "line"}}, "authoring_scope_invalid"), ({"format": FORMAT, "rules": [], "defaults": {"exclude_any": ["x"]}}, "unknown_condition_reference"),
    ({"format": FORMAT, "rules": [3]}, "authoring_rule_invalid"), ({"format": FORMAT, "rules": [{}]}, "authoring_rule_id_invalid"), ({"format": FORMAT, "rules": [{"id": "a"}, {"id": "a"}]}, "authoring_rule_id_duplicate"),
    ({"format": FORMAT, "rules": [{"id": "a", "match": {"any": [{"text_any": ["t"]}, {"token_window": {"terms": ["x"], "anchor": "x", "distance": 0}}]}}]}, "authoring_match_invalid"),
    ({"format": FORMAT, "rules": [{"id": "a", "match": {"text_any": ["@n"]}}]}, "unknown_set_reference"), ({"format": FORMAT, "sets": {"a": ["x"]}, "rules": [{"id": "a", "match": {"text_any": ["a"]}}]}, "ambiguous_set_reference"),
    ({"format": FORMAT, "settings": {"analysis_unit": "page"}, "rules": []}, "invalid_settings_value"),
])
def test_authoring_errors(document, code):
    got = compile_authoring(document)
    assert got.rule_set is None and got.issues[-1].code == code


def test_authoring_files(tmp_path):
    assert load_authoring(tmp_path / "a.yaml").issues[0].code == "yaml_not_supported_in_v1"
    assert load_authoring(tmp_path / "a.json").issues[0].code == "authoring_file_not_found"
    (tmp_path / "a.json").write_text("[")
    assert load_authoring(tmp_path / "a.json").issues[0].code == "authoring_json_invalid"
    (tmp_path / "a.json").write_text(json.dumps({"format": FORMAT, "rules": [{"id": "a", "label": "l", "match": {"text_any": ["t"]}}]}))
    assert write_runtime(str(tmp_path / "a.json"), str(tmp_path / "r.json"), str(tmp_path / "i.json")) == 0
    assert load_runtime(tmp_path / "r.json").rules[0].id == "a"


def test_flat_conditions_become_groups_and_come_back():
    import itertools

    from tessera.plans.config import WAS_FLAT, as_flat, as_groups

    values = {"forms": [None, [], ["a"], ["b", "a"]], "form_match_logic": [None, "any", "all"], "search_scope": [None, "sentence", "paragraph"], "max_token_distance": [None, 0, 4]}
    for combination in itertools.product(*values.values()):
        flat = {"condition_id": "x", "categories": ["c"], "text_groups": [{"texts": ["t"]}], "note": 1} | {k: v for k, v in zip(values, combination) if v is not None}
        grouped = as_groups(flat)
        back = as_flat(grouped)
        assert back == {k: v for k, v in flat.items() if v != []} or (back == flat and not grouped.get(WAS_FLAT))
        assert compile_rules([back])[0] == compile_rules([flat])[0]
        assert grouped is flat or (len(grouped["form_groups"]) == 1 and not set(grouped) & set(values))
    edited = as_groups({"condition_id": "x", "forms": ["a", "b"], "form_match_logic": "all"})
    for change in ({"anchor_form": "a"}, {"exclude_forms_any": ["z"]}, {"match_logic": "not"}, {"combine_logic": "and"}):
        kept = as_flat(edited | {"form_groups": [edited["form_groups"][0] | change]})
        assert "forms" not in kept and len(kept["form_groups"]) == 1 and WAS_FLAT not in kept
    assert len(as_flat(edited | {"form_groups": edited["form_groups"] * 2})["form_groups"]) == 2
    assert as_flat({"form_groups": [{"forms": ["a"]}]}) == {"form_groups": [{"forms": ["a"]}]}
