from gleaner.functions import fixed as X
from gleaner.functions.settings import Settings, parse_terms


def test_defaults_and_migration():
    assert Settings.from_dict(None) == Settings()
    assert Settings.from_dict({"defaultsVersion": 1}).block_all == ("ikea",)
    assert Settings.from_dict({"defaultsVersion": 2, "quickToggleBlockAll": []}).block_all == ()
    assert Settings.from_dict({"quickToggleBlockAll": ["liquidation"]}).block_all == ("liquidation",)
    assert Settings.from_dict({"aggressiveness": "wild", "filterMode": 3}).aggressiveness == "balanced"


def test_round_trip():
    s = Settings(aggressiveness="strict", disabled_categories=frozenset({"counterfeit"}), block_terms=("a b",))
    assert Settings.import_json(s.export_json()) == s


def test_toggles():
    t = next(t for t in X.TOGGLES if t.id == "ikea")
    s = Settings()
    assert s.toggle_mode(t) == "block"
    assert s.with_toggle(t, "filter").toggle_mode(t) == "filter"
    assert s.with_toggle(t, "off").toggle_mode(t) == "off"
    many = next(t for t in X.TOGGLES if len(t.rule_ids) > 1)
    assert s.disable_rule(many.rule_ids[0]).toggle_mode(many) == "partial"


def test_catalog_integrity():
    known = {r.id for r in X.RULES} | {c[0] for c in X.DYNAMIC_CONTROLS}
    assert len(X.RULES) == 71 and len({r.id for r in X.RULES}) == 71
    assert all(r in known for t in X.TOGGLES for r in t.rule_ids)
    assert {r.category for r in X.RULES} <= {c for c, _ in X.CATEGORIES}


def test_terms():
    assert parse_terms(" a \n\nb\na") == ("a", "b")
