from gleaner.operators import evaluate

ENTRY = "id string, label string, title string, price_text string, location_text string, body string, vendorTaste string"
SEEN = "page_id string, pos int, item_id string, title string, price_text string, location_text string, visible_text string, is_seller_profile boolean, expected string"


def page(name, rows, profile=False):
    """Rows of (title, price, place, expected) or with an item id in front of them."""
    rows = [r if len(r) == 5 else (f"{name}-{i}", *r) for i, r in enumerate(rows)]
    return [(name, i, item, title, price, place, f"{price}\n{title}\n{place}", profile, want) for i, (item, title, price, place, want) in enumerate(rows)]


def pages():
    towns = ["Bend, OR", "Salem, OR", "Tigard, OR", "Aloha, OR", "Albany, OR", "Newberg, OR", "Sandy, OR"]
    after = lambda i: "hide" if i else None
    return [
        *page("prices", [("Pixel 7 phone 128GB unlocked", f"${150 + 20 * i}", towns[i % 2], None) for i in range(10)]),
        *page("triple", [("Pixel 7 phone 128GB unlocked", "$210", "Bend, OR", None)] * 3),
        *page("exact", [("Corner Couch Beige Quick Dropoff", "$189", "Bend, OR", after(i)) for i in range(9)]),
        *page("bait", [("Elegant Couch Set Clearance Event", ["$1", "$2", "Free"][i % 3], "Bend, OR", after(i)) for i in range(8)]),
        *page("towns", [("Reclining Office Chair Mesh Back", "$139", towns[i], after(i)) for i in range(7)]),
        *page("generic", [("Free sofa", "Free", "Bend, OR", None)] * 5),
        *page("clones", [("one-item", "Walnut Bookcase Tall Five Shelves", "$110", "Bend, OR", None)] * 4),
        *page("seller", [("Handmade Cutting Board Maple", "$40", "Bend, OR", None)] * 8, True),
        *page("mixed", [("Vintage pine dresser", "$200", "Bend, OR", None)] + [("Twin Mattress Firm Still Wrapped", "$110", towns[i], after(i)) for i in range(6)] + [("Free end table", "Free", "Bend, OR", None)]),
    ]


def entries():
    return [
        ("a", "legit", "Oak desk with two drawers", "$60", "Bend, OR", "Some scratches, used for years.\nPick up only", None),
        ("b", "legit", "IKEA Hemnes dresser", "$80", "Bend, OR", "Used, one scratch.", "ikea"),
        ("c", "slop", "Sofa", "$1", "Bend, OR", "Price is $499, we deliver", None),
    ]


def test_gate_holds(spark):
    r = evaluate.full_gate(spark.createDataFrame(entries(), ENTRY), spark.createDataFrame(pages(), SEEN)).first()
    assert {k: r[k] for k in ("legit", "taste", "permissive", "flood")} == {"legit": 0, "taste": 0, "permissive": 0, "flood": 0} and r["passed"]


def test_gate_fails_for_each_kind(spark):
    bad = entries() + [("d", "legit", "Oak desk with two drawers", "$60", "Bend, OR", "", "ikea"), ("e", "legit", "IKEA Hemnes dresser", "$80", "Bend, OR", "", None)]
    rows = [(*r[:-1], "hide") if r[0] == "triple" else r for r in pages()]
    r = evaluate.full_gate(spark.createDataFrame(bad, ENTRY), spark.createDataFrame(rows, SEEN)).first()
    assert (r["taste"], r["legit"], r["flood"], r["passed"]) == (1, 2, 1, False)


def test_gate_of_nothing_holds(spark):
    r = evaluate.full_gate(spark.createDataFrame([], ENTRY), spark.createDataFrame([], SEEN)).first()
    assert r["hard_failures"] == 0 and r["passed"]
