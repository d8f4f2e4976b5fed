"""Rule model: what a compiled rule set consists of, and the issues that compiling and loading report."""

from __future__ import annotations

from dataclasses import dataclass, field

SCOPES = ("paragraph", "sentence")
#: Fixed value: the category of a rule that names none.
UNCATEGORISED = "未分類"


@dataclass(frozen=True)
class Issue:
    code: str
    severity: str
    message: str
    scope: str = "condition"
    condition_index: int | None = None
    condition_id: str | None = None
    field_name: str | None = None


@dataclass(frozen=True)
class FormGroup:
    forms: tuple[str, ...]
    match_logic: str
    combine_logic: str | None
    search_scope: str
    requested_distance: int | None = None
    distance: int | None = None
    anchor_form: str | None = None
    exclude_forms: tuple[str, ...] = ()


@dataclass(frozen=True)
class TextGroup:
    texts: tuple[str, ...]
    match_logic: str
    combine_logic: str | None
    search_scope: str


@dataclass(frozen=True)
class AnnotationFilter:
    namespace: str
    key: str
    value: str
    operator: str = "eq"

    @property
    def label(self) -> str:
        return f"{self.namespace}:{self.key}={self.value}"


@dataclass(frozen=True)
class Rule:
    id: str
    categories: tuple[str, ...]
    forms: tuple[str, ...] = ()
    search_scope: str = "paragraph"
    overall_scope: str = "paragraph"
    form_match_logic: str = "all"
    requested_distance: int | None = None
    distance: int | None = None
    form_groups: tuple[FormGroup, ...] = ()
    text_groups: tuple[TextGroup, ...] = ()
    annotation_filters: tuple[AnnotationFilter, ...] = ()
    required_categories_all: tuple[str, ...] = ()
    required_categories_any: tuple[str, ...] = ()
    required_ids_all: tuple[str, ...] = ()
    required_ids_any: tuple[str, ...] = ()
    excluded_ids_any: tuple[str, ...] = ()

    @property
    def category_text(self) -> str:
        return ", ".join(self.categories)

    @property
    def referenced_ids(self) -> tuple[str, ...]:
        return self.required_ids_all + self.required_ids_any + self.excluded_ids_any

    @property
    def has_reference(self) -> bool:
        return bool(self.referenced_ids or self.required_categories_all or self.required_categories_any)

    @property
    def has_base(self) -> bool:
        return bool(self.forms or self.annotation_filters or self.text_groups)

    @property
    def uses_groups(self) -> bool:
        """Whether the group evaluator decides, rather than one co-occurrence or distance test over all forms."""
        g = self.form_groups
        return len(g) > 1 or any(x.match_logic == "not" or x.distance is not None or x.exclude_forms for x in g)

    @property
    def scope(self) -> str:
        return self.overall_scope if self.form_groups else self.search_scope


@dataclass(frozen=True)
class Settings:
    condition_match_logic: str = "any"
    analysis_unit: str = "paragraph"
    max_reconstructed_paragraphs: int = 10_000
    distance_matching_mode: str = "auto-approx"
    distance_match_combination_cap: int = 10_000
    distance_match_strict_safety_limit: int = 1_000_000


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    settings: Settings = field(default_factory=Settings)
    issues: tuple[Issue, ...] = ()
    loaded: int = 0

    @property
    def vocabulary(self) -> list[str]:
        """All forms that any rule looks at, exclusions included."""
        return sorted({f for r in self.rules for f in (*r.forms, *(x for g in r.form_groups for x in (*g.forms, *g.exclude_forms)))})

    def ordered(self) -> tuple[Rule, ...]:
        """References before the rules that use them; input order is kept within each round."""
        known = {r.id for r in self.rules}
        waiting, done, out = list(self.rules), set(), []
        while waiting:
            ready = [r for r in waiting if all(i in done or i not in known for i in r.referenced_ids)]
            if not ready:
                return self.rules
            out += ready
            done |= {r.id for r in ready}
            waiting = [r for r in waiting if r.id not in done]
        return tuple(out)
