"""Settings: plain data that is resolved when a plan is built."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from gleaner.functions import fixed as X

VERSION = 2
CATEGORY_IDS = tuple(c for c, _ in X.CATEGORIES)


def term_list(value: Any) -> tuple[str, ...]:
    """Trimmed, distinct, non-empty strings, in order."""
    if not isinstance(value, (list, tuple)):
        return ()
    return tuple(dict.fromkeys(t for t in (x.strip() for x in value if isinstance(x, str)) if t))


def parse_terms(text: str) -> tuple[str, ...]:
    return term_list(text.splitlines())


def serialize_terms(terms) -> str:
    return "\n".join(term_list(terms))


@dataclass(frozen=True)
class Settings:
    enabled: bool = True
    aggressiveness: str = "balanced"
    filter_mode: str = "hide"
    show_reasons: bool = True
    deep_scan: bool = True
    image_checks: bool = True
    block_all: tuple[str, ...] = ("ikea",)
    disabled_categories: frozenset[str] = frozenset()
    disabled_rules: tuple[str, ...] = ()
    block_terms: tuple[str, ...] = ()
    vendor_terms: tuple[str, ...] = ()
    allow_terms: tuple[str, ...] = ()
    allow_items: tuple[str, ...] = ()
    version: int = field(default=VERSION)

    @staticmethod
    def from_dict(value: Any) -> Settings:
        """Lenient: anything unknown or of the wrong type takes its default; old saves migrate."""
        v = value if isinstance(value, dict) else {}
        flag = lambda k, d: v[k] if isinstance(v.get(k), bool) else d
        pick = lambda k, ok, d: v[k] if isinstance(v.get(k), str) and v[k] in ok else d
        stored = v.get("enabledCategories") if isinstance(v.get("enabledCategories"), dict) else {}
        block, version = term_list(v.get("quickToggleBlockAll")), v.get("defaultsVersion")
        version = version if isinstance(version, (int, float)) and not isinstance(version, bool) else 0
        if version < VERSION and not block:
            block = ("ikea",)
        return Settings(
            flag("enabled", True), pick("aggressiveness", X.THRESHOLDS, "balanced"), pick("filterMode", ("hide", "dim", "label"), "hide"),
            flag("showReasons", True), flag("deepScan", True), flag("imageChecks", True), block,
            frozenset(c for c in CATEGORY_IDS if stored.get(c) is False), term_list(v.get("disabledRuleIds")),
            term_list(v.get("customBlockTerms")), term_list(v.get("customVendorTerms")), term_list(v.get("customAllowTerms")), term_list(v.get("customAllowItemIds")),
        )

    def to_dict(self) -> dict:
        return {
            "enabled": self.enabled, "aggressiveness": self.aggressiveness, "filterMode": self.filter_mode, "showReasons": self.show_reasons,
            "deepScan": self.deep_scan, "imageChecks": self.image_checks, "quickToggleBlockAll": list(self.block_all), "defaultsVersion": self.version,
            "enabledCategories": {c: c not in self.disabled_categories for c in CATEGORY_IDS}, "disabledRuleIds": list(self.disabled_rules),
            "customBlockTerms": list(self.block_terms), "customVendorTerms": list(self.vendor_terms),
            "customAllowTerms": list(self.allow_terms), "customAllowItemIds": list(self.allow_items),
        }

    def export_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)

    @staticmethod
    def import_json(text: str) -> Settings:
        """Raises ValueError on text that is no JSON."""
        return Settings.from_dict(json.loads(text))

    def category_on(self, category: str) -> bool:
        return category not in self.disabled_categories

    def rule_on(self, rule: str) -> bool:
        return rule not in self.disabled_rules

    def active(self, category: str, rule: str) -> bool:
        return self.category_on(category) and self.rule_on(rule)

    def toggle_mode(self, toggle: X.Toggle) -> str:
        """block, off, filter or partial."""
        if toggle.kind == "vendor" and toggle.id in self.block_all:
            return "block"
        on = sum(self.rule_on(r) for r in toggle.rule_ids)
        return "off" if not on else "filter" if on == len(toggle.rule_ids) else "partial"

    def with_toggle(self, toggle: X.Toggle, mode: str) -> Settings:
        others = tuple(r for r in self.disabled_rules if r not in toggle.rule_ids)
        return replace(
            self,
            disabled_rules=term_list(self.disabled_rules + toggle.rule_ids) if mode == "off" else others,
            block_all=term_list((*self.block_all, toggle.id)) if mode == "block" else tuple(t for t in self.block_all if t != toggle.id),
        )

    def allow_item(self, item: str) -> Settings:
        return replace(self, allow_items=term_list((*self.allow_items, item)))

    def allow_term(self, term: str) -> Settings:
        return replace(self, allow_terms=term_list((*self.allow_terms, term)))

    def disable_rule(self, rule: str) -> Settings:
        return replace(self, disabled_rules=term_list((*self.disabled_rules, rule)))

    def key(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, default=sorted)
