from __future__ import annotations

from corpusmill.operators.composition import compose_pages
from corpusmill.sources import families, fixed_pages


def test_every_family_composes(spark):
    """One row in every allowed table, each id 1: every section shows all that it declares."""
    for family in families.FAMILIES:
        page = families.page_of(family.scope, "https://site.example")
        tables = {}
        for name, schema in families.allow_list(page).items():
            row = tuple(1 if f.name == "id" or f.name.endswith("_id") else f"{f.name} text" for f in schema.fields)
            tables[name] = spark.createDataFrame([row], schema)
        found = compose_pages(tables, page).collect()
        assert len(found) == 1 and found[0]["reason"] is None and found[0]["missing_sections"] == []
        kinds = [b["type"] for b in found[0]["blocks"]]
        shown = sum(len([s for s in section.steps if s.kind in ("heading", "paragraph")]) for section in page.sections)
        listed = sum(1 for section in page.sections for s in section.steps if s.kind == "items")
        cards = [s for section in page.sections for s in section.steps if s.kind == "cards"]
        pairs = sum(1 for section in page.sections for s in section.steps if s.kind == "pairs")
        assert len(kinds) == shown + listed + sum(len(s.parts) + bool(s.nested) for s in cards) + pairs
        assert kinds.count("faq_pair") == pairs and found[0]["canonical_uri"].startswith("https://site.example/services/")


def test_placeholders_and_absent_sections(spark):
    page = families.page_of("grc", "https://site.example")
    rows = {name: spark.createDataFrame([], schema) for name, schema in families.allow_list(page).items()}
    schema = rows[page.table].schema
    rows[page.table] = spark.createDataFrame([tuple(7 if f.name == "grc_sec_six_id" else 1 if f.name == "id" else None if f.name.endswith("_id") else "page one" for f in schema.fields)], schema)
    six = rows["subone_grcsecsix"].schema
    rows["subone_grcsecsix"] = spark.createDataFrame([tuple({"id": 7, "section_title": "Six", "paragraph_title": "a", "desc": "real"}.get(f.name, "") for f in six.fields)], six)
    found = compose_pages(rows, page).first()
    assert [(b["type"], b["text"]) for b in found["blocks"]] == [("heading", "Six"), ("paragraph", "real")]
    assert found["missing_sections"] == ["sec_one", "sec_two", "sec_three", "sec_four", "sec_seven"]
    assert found["canonical_uri"] == "https://site.example/services/governance-risk-compliance/page%20one" or found["canonical_uri"].endswith("/page one")


def test_names_follow_the_rule():
    page = families.page_of("professional_training", "https://site.example")
    assert {"subone_professionaltrnsecfive_prf_trn_sec_five_category", "subone_professionaltrnsecfivecategory_prf_trn_sec_five_list", "subone_professionaltrnsecfivelist"} <= set(families.allow_list(page))
    grc = families.allow_list(families.page_of("grc", "https://site.example"))
    assert {"subone_grcseconelist_grc_list_list", "subone_grcseconelistlist"} <= set(grc)
    assert grc["subone_grcseconelist"].names == ["id", "title", "desc", "paragraph"]


def everything(spark):
    """Every table of every fixed page with one row of id 1, foreign keys 1, and texts after their columns."""
    columns: dict[str, set[str]] = {}
    for page in fixed_pages.FIXED_PAGES:
        for table, schema in fixed_pages.allow_list(page).items():
            columns.setdefault(table, set()).update(schema.names)
    number = lambda c: c == "id" or c.endswith("_id") or c == "is_active"
    return {t: spark.createDataFrame([tuple(1 if number(c) else f"{c} text" for c in sorted(cs))], ", ".join(f"`{c}` {'bigint' if number(c) else 'string'}" for c in sorted(cs))) for t, cs in columns.items()}


def test_fixed_pages(spark):
    tables = everything(spark)
    texts = {"flowchart": "Approved."}
    for page in fixed_pages.FIXED_PAGES:
        rows = fixed_pages.compose_fixed(tables, page, "https://site.example", texts, ("Use", "P", "T", "A")).collect()
        assert len(rows) == 1 and rows[0]["reason"] is None and rows[0]["missing_sections"] == [], page.route
        assert rows[0]["canonical_uri"].startswith("https://site.example/")
        kinds = [b["type"] for b in rows[0]["blocks"]]
        if page.route.endswith("guideline"):
            assert rows[0]["blocks"][-1]["header"] == ["Use", "P", "T", "A"] and kinds.count("table") == 1
        if page.scope == "privacy_policy":
            assert [(b["type"], b["text"] or b["items"]) for b in rows[0]["blocks"]] == [("paragraph", "desc text"), ("heading", "list_title text"), ("paragraph", "list_text text"), ("list", ["sublist_title text"])]
        if page.route.endswith("certification-process"):
            withdraw = rows[0]["blocks"][-7:-3]
            assert [b["type"] for b in withdraw] == ["heading", "paragraph", "list", "paragraph"] and rows[0]["images"][0]["src"] == "mainImg text"
    empty = {t: df.where("false") for t, df in tables.items()}
    assert all(fixed_pages.compose_fixed(empty, page, "https://site.example").count() == 0 for page in fixed_pages.FIXED_PAGES)
    about = next(p for p in fixed_pages.FIXED_PAGES if p.route == "about")
    badges = "subone_accredition"
    hidden = fixed_pages.compose_fixed(tables, about, "https://site.example", texts, hidden={(badges, "sec_title"): ["sec_title text"]}).first()
    assert hidden["missing_sections"] == ["accreditations"]


def test_badges(spark):
    """Badges stand under their heading with an image each; those never shown leave nothing, not even the heading."""
    tables, about = everything(spark), next(p for p in fixed_pages.FIXED_PAGES if p.route == "about")
    schema = "id bigint, sec_title string, img string"
    never = [(n + 1, f" {t} ", "x.png") for n, t in enumerate(fixed_pages.HIDDEN_BADGES)]
    shown = tables | {"subone_accredition": spark.createDataFrame([*never, (8, "Body B", "b.png"), (7, "Body A", "a.png"), (9, "Body C", None)], schema)}
    row = fixed_pages.compose_fixed(shown, about, "https://site.example").first()
    at = next(n for n, b in enumerate(row["blocks"]) if b["text"] == fixed_pages.BADGES_HEADING)
    assert row["blocks"][at]["type"] == "heading" and row["blocks"][at + 1]["items"] == ["Body A", "Body B", "Body C"]
    assert [i["src"] for i in row["images"] if i["section"] == "accreditations"] == ["a.png", "b.png"]
    gone = fixed_pages.compose_fixed(tables | {"subone_accredition": spark.createDataFrame(never, schema)}, about, "https://site.example").first()
    assert gone["missing_sections"] == ["accreditations"] and not [b for b in gone["blocks"] if b["text"] == fixed_pages.BADGES_HEADING]
    assert row["source_ref"] == "about#composed"


def test_offices(spark):
    offices = next(p for p in fixed_pages.FIXED_PAGES if p.scope == "office_locations")
    schema = "id bigint, name string, address string, latitude double, longitude string"
    rows = everything(spark) | {"subone_officelocation": spark.createDataFrame([(2, "B", "b street", 1.5, "2"), (1, " A ", "a street", None, None), (3, " ", "lost", 1.0, "1"), (4, None, "lost", None, None)], schema)}
    found = fixed_pages.compose_fixed(rows, offices, "https://site.example").first()
    assert [(b["type"], b["text"]) for b in found["blocks"]] == [("heading", "A"), ("paragraph", "a street"), ("heading", "B"), ("paragraph", "b street")]
    assert [tuple(x) for x in found["locations"]] == [("A", None, None), ("B", "1.5", "2")] and found["unnamed_locations"] == 2
    assert found["source_ref"] == "subone_officelocation#collection"


def test_source_refs_and_declared_tables(spark):
    tables = everything(spark)
    refs = {p.route: fixed_pages.compose_fixed(tables, p, "https://site.example").first()["source_ref"] for p in fixed_pages.FIXED_PAGES}
    assert refs["resources/certification-guideline"] == "subone_cmgsubpage#1" and refs["/#faq"] == "subone_faq#collection"
    assert refs["resources/certification-process"] == "certification-process#composed"
    assert fixed_pages.allow_list(offices := next(p for p in fixed_pages.FIXED_PAGES if p.offices))[offices.offices].names == ["id", "name", "address", "latitude", "longitude"]


def test_inventory_of_fixed_pages(spark):
    tables = everything(spark)
    found = {r[0] for r in fixed_pages.inventory(tables, "https://site.example").collect()}
    assert found == {fixed_pages.compose_fixed(tables, p, "https://site.example").first()["canonical_uri"] for p in fixed_pages.FIXED_PAGES}
    few = tables | {"subone_cmgsubpage": tables["subone_cmgsubpage"].where("false"), "subone_faq": tables["subone_faq"].where("false")}
    gone = found - {r[0] for r in fixed_pages.inventory(few, "https://site.example").collect()}
    assert gone == {"https://site.example/resources/certification-guideline", "https://site.example/#faq"}
