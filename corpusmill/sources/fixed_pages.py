"""Pages with a fixed route, shown from the first rows of their tables or from the ids that one row of keys holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.markup import tidy
from corpusmill.functions.text import content_text
from corpusmill.functions.urls import canonical
from corpusmill.operators.composition import Page, Section, Step, compose_pages
from corpusmill.sources import declarations
from corpusmill.sources.declarations import badges, bullets, cards, grid, h2, h3, img, linked, owned, p, pairs, section, text, title, whole

PREFIX = "subone_"
# The heading above the badges and the badges that are never shown.
BADGES_HEADING = "Accreditations and Affiliations"
HIDDEN_BADGES = ("CNCA Approved Management System Certification Body exits", "Accredited from IAF MRA Accreditation Board’s")


@dataclass(frozen=True)
class FixedPage:
    """``title``: ``table.column`` of the first row, or a text. ``keys``: the table whose first row links sections.

    The page exists if any table of ``anchors`` has a row; none named means the sections' tables. Its
    ``source_ref`` is a fixed one or the first anchor with its lowest id. ``offices`` names a table of
    places whose coordinates are kept beside the record.
    """

    scope: str
    content_type: str
    route: str
    title: str
    sections: tuple[Section, ...]
    keys: str = ""
    anchors: tuple[str, ...] = ()
    filters: Mapping[str, str] = field(default_factory=dict)
    source_ref: str | None = None
    offices: str | None = None


# Routes, tables, columns and order of what each page shows.
# fmt: off
CERTIFICATION_PROCESS = FixedPage(
    "resource_process", "resource", "resources/certification-process", "certificationprocessbanner.name",
    (
        section("process_overview", "subone_cerificationprocessimg", None,
            h2("sec_title"), text("flowchart"), img("mainImg"),
        ),
        section("grant_or_refuse", "subone_grantorrefuse", None,
            h2("sec_title"), h3("sub_text"), p("desc"),
        ),
        section("details_for_issuing", "subone_detailsforissuing", None,
            h2("sec_title"), p("sub_text"), bullets("list_2", "list_text"),
            lists=(owned("subone_dfilist", "details_for_issuing_id", "list_text", name="list_2"),),
        ),
        section("maintain_certification", "subone_maintaincertification", None,
            h2("sec_title"), p("desc"), bullets("list_2", "list_text"),
            lists=(owned("subone_mclist", "maintain_certification_id", "list_text", name="list_2"),),
        ),
        section("suspension_of_certification", "subone_suspensionofcertification", None,
            h2("sec_title"), p("sub_text"), bullets("list_2", "list_text"),
            lists=(owned("subone_soclist", "suspension_of_certification_id", "list_text", name="list_2"),),
        ),
        section("restoring_of_certification", "subone_restoringofcertification", None,
            h2("sec_title"), p("desc"),
        ),
        section("withdraw_of_certification", "subone_withdrawofcertification", None,
            h2("sec_title"), p("sub_text"), bullets("list_2", "list_text"), p("desc"),
            lists=(owned("subone_woclist", "withdraw_of_certification_id", "list_text", name="list_2"),),
        ),
        section("expanding_or_reducing", "subone_expandingorreducing", None,
            h2("sec_title"), p("sub_text"), p("desc"),
        ),
    ),
    source_ref="certification-process#composed",
)
CERTIFICATION_GUIDELINE = FixedPage(
    "resource_process", "resource", "resources/certification-guideline", "certificationguidlinebanner.name",
    (
        section("marks_intro", "subone_cmgsecone", "cmg_sec_one_id",
            h2("section_title"), p("desc"),
        ),
        section("certification_marks", "subone_cmgsectwo", "cmg_sec_two_id",
            h3("section_title"),
        ),
        section("instructions", "subone_cmgsecthree", "cmg_sec_three_id",
            h2("section_title"), bullets("list_1", "desc"),
            lists=(linked("subone_cmgsecthree_cmg_sec_three_list", "cmgsecthree_id", "cmgsecthreelist_id", "subone_cmgsecthreelist", "desc", name="list_1"),),
        ),
        section("guidance_table", "subone_cmgsecfour", "cmg_sec_four_id",
            h2("section_title"), grid("list_1", "use", "products", "transportation", "advertisement"),
            lists=(linked("subone_cmgsecfour_cmg_sec_four_list", "cmgsecfour_id", "cmgsecfourlist_id", "subone_cmgsecfourlist", "use", "products", "transportation", "advertisement", name="list_1"),),
        ),
    ),
    keys="subone_cmgsubpage",
    anchors=("subone_cmgsubpage",),
)
APPEAL_HANDLING_AND_GRIEVANCES = FixedPage(
    "resource_process", "resource", "resources/appeal-handling-and-grievances", "appealhandlingbanner.name",
    (
        section("appeal_handling", "subone_appealhandling", None,
            h2("sec_title"), p("desc"), bullets("list_2", "list_text"),
            whole_lists=(whole("subone_ahlist", "list_text", name="list_2"),),
        ),
        section("grievances", "subone_grievancespage", None,
            h2("sec_title"), p("desc"), bullets("list_2", "list_text"),
            whole_lists=(whole("subone_grievanceslist", "list_text", name="list_2"),),
        ),
    ),
    anchors=("subone_appealhandling",),
)
COMPLAINT_HANDLING_PROCESS = FixedPage(
    "resource_process", "resource", "resources/complaint-handling-process", "complainthandlingprocessbanner.name",
    (
        section("complaint_handling", "subone_complainhandlingpage", None,
            h2("sec_title"), p("desc"), bullets("list_2", "list_text"),
            lists=(owned("subone_chlist", "complain_handling_id", "list_text", name="list_2"),),
        ),
    ),
)
PRIVACY_POLICY = FixedPage(
    "privacy_policy", "corporate", "privacy-policy", "privacypolicysecone.section_title",
    (
        section("introduction", "subone_privacypolicysecone", "prpolicy_sec_one_id",
            p("desc"),
        ),
        section("policy_items", "subone_privacypolicysectwo", "prpolicy_sec_two_id",
            cards("list_0", "list_title", "list_text", nested=("below", "sublist_title"), level=2),
            lists=(linked("subone_privacypolicysectwo_prpolicy_sec_two_list", "privacypolicysectwo_id", "privacypolicysectwolist_id", "subone_privacypolicysectwolist", "list_title", "list_text", name="list_0",
                        nested=linked("subone_privacypolicysectwolist_subList", "privacypolicysectwolist_id", "privacypolicysectwosublist_id", "subone_privacypolicysectwosublist", "sublist_title", name="below")),),
        ),
    ),
    keys="subone_privacypolicypage",
    anchors=("subone_privacypolicypage",),
)
ABOUT = FixedPage(
    "corporate", "corporate", "about", "aboutusmeta.title",
    (
        section("who_we_are", "subone_whoweare", None,
            h2("sec_title"), p("sub_text"), p("desc1"), bullets("list_3", "list_text"), p("desc2"),
            lists=(linked("subone_whoweare_who_we_are_list", "whoweare_id", "wwrlist_id", "subone_wwrlist", "list_text", name="list_3"),),
        ),
        section("our_values", "subone_ourvalues", None,
            h2("title"), p("desc"), cards("list_2", "title", "desc", level=3),
            lists=(linked("subone_ourvalues_ourvalue_lists", "ourvalues_id", "ourvalueslist_id", "subone_ourvalueslist", "title", "desc", name="list_2"),),
        ),
        section("our_mission", "subone_ourmission", None,
            h2("sec_title"), bullets("list_1", "list_text"),
            lists=(owned("subone_omlist", "our_mission_id", "list_text", name="list_1"),),
        ),
        section("why_us", "subone_whyus", None,
            h2("sec_title"), p("desc"), cards("list_2", "title", "desc", level=3),
            lists=(owned("subone_wulist", "why_us_id", "title", "desc", name="list_2"),),
        ),
        section("accreditations", "subone_accredition", None,
            title("accreditations"), bullets("list_1", "sec_title"), badges("list_1", "img"),
            whole_lists=(whole("subone_accredition", "sec_title", "img", name="list_1"),),
        ),
        section("quality_policy", "subone_qualitypolicy", None,
            h2("sec_title"), h3("sub_text"), p("desc1"), bullets("list_3", "list_text"), h3("desc"), p("desc2"), p("text_extra"),
            lists=(owned("subone_qualitypolicylist", "qp_lists_id", "list_text", name="list_3"),),
        ),
        section("impartiality_policy", "subone_impartialitypolicy", None,
            h2("sec_title"), p("sub_text"), p("desc"),
        ),
        section("implementation_of_ip", "subone_implementofip", None,
            h2("sec_title"), bullets("list_1", "list_text"),
            lists=(owned("subone_ioiplist", "implement_of_ip_id", "list_text", name="list_1"),),
        ),
        section("impartiality_conflict", "subone_impartialityconflict", None,
            h2("title"), p("desc"), bullets("list_2", "list_text"),
            lists=(linked("subone_impartialityconflict_impartialityconflict_lists", "impartialityconflict_id", "impartialityconflictlist_id", "subone_impartialityconflictlist", "list_text", name="list_2"),),
        ),
        section("impartiality_addition", "subone_impartialityaddition", None,
            h2("title"), h3("sub_text"), p("desc"), p("desc1"), bullets("list_4", "list_text"), h3("extra_detail"), bullets("list_6", "list_text"), p("desc2"),
            lists=(linked("subone_impartialityaddition_impartialityconflict_addition", "impartialityaddition_id", "impartialityadditionlist_id", "subone_impartialityadditionlist", "list_text", name="list_4"), linked("subone_impartialityaddition_impartialityconflict_extra_addition", "impartialityaddition_id", "impartialityadditionextralist_id", "subone_impartialityadditionextralist", "list_text", name="list_6"),),
        ),
    ),
    source_ref="about#composed",
)
FAQ = FixedPage(
    "standalone_faq", "faq", "/#faq", "Frequently Asked Questions",
    (
        section("questions", "subone_faq", None,
            pairs("list_0", "question", "answer"),
            whole_lists=(whole("subone_faq", "question", "answer", name="list_0"),),
        ),
    ),
    filters={"subone_faq": "is_active = 1"},
    source_ref="subone_faq#collection",
)
CONTACTUS_OFFICE_LOCATIONS = FixedPage(
    "office_locations", "location", "contactus#office-locations", "Office Locations",
    (
        section("offices", "subone_officelocation", None,
            cards("list_0", "name", "address", level=2),
            whole_lists=(whole("subone_officelocation", "name", "address", name="list_0"),),
        ),
    ),
    filters={"subone_officelocation": "trim(name) <> ''"},
    source_ref="subone_officelocation#collection",
    offices="subone_officelocation",
)
# fmt: on
FIXED_PAGES = (CERTIFICATION_PROCESS, CERTIFICATION_GUIDELINE, APPEAL_HANDLING_AND_GRIEVANCES, COMPLAINT_HANDLING_PROCESS, PRIVACY_POLICY, ABOUT, FAQ, CONTACTUS_OFFICE_LOCATIONS)
_LOCATIONS = "array<struct<name:string,latitude:string,longitude:string>>"


def _told(part: Section, texts: Mapping[str, str], headers: tuple[str, ...]) -> Section:
    """The section with the caller's texts and table head."""

    def step(s: Step) -> Step:
        if s.kind in ("fixed", "fixed_heading"):
            return replace(s, text=texts.get(s.text, ""))
        return replace(s, header=headers) if s.kind == "table" and len(headers) == len(s.parts) else s

    return replace(part, steps=tuple(step(s) for s in part.steps))


def allow_list(page: FixedPage) -> dict[str, T.StructType]:
    """The tables a fixed page may read and, of each, the columns."""
    link = page.keys or "__page"
    found = declarations.allow_list((Page(page.scope, page.content_type, "", link, "id", "id", page.sections),))
    if not page.keys:
        del found[link]

    def more(table: str, *columns: str) -> None:
        own = found.setdefault(table, T.StructType([T.StructField("id", T.LongType())]))
        found[table] = T.StructType([*own.fields, *[T.StructField(c, T.StringType()) for c in columns if c not in own.names]])

    if "." in page.title:
        more(PREFIX + page.title.split(".")[0], page.title.split(".")[1])
    for table in page.anchors:
        more(table)
    if page.offices:
        more(page.offices, "latitude", "longitude")
    for table, condition in page.filters.items():
        more(table, *([condition.split()[0]] if condition.split()[0].isidentifier() else []))
    return found


def inventory(tables: Mapping[str, DataFrame], site: str) -> DataFrame:
    """(canonical_uri) of the fixed pages that exist, from the ids of their anchors alone."""
    found = None
    for page in FIXED_PAGES:
        anchors = [tables[a].select("id") for a in (page.anchors or dict.fromkeys(s.table for s in page.sections)) if a in tables]
        if not anchors:
            continue
        any_row = anchors[0].limit(1)
        for more in anchors[1:]:
            any_row = any_row.unionByName(more.limit(1))
        here = any_row.limit(1).select(F.lit(canonical(page.route, site.rstrip("/") + "/")).alias("canonical_uri"))
        found = here if found is None else found.unionByName(here)
    if found is None:
        raise ValueError("no table of a fixed page")
    return found


def compose_fixed(tables: Mapping[str, DataFrame], page: FixedPage, site: str, texts: Mapping[str, str] | None = None, headers: Sequence[str] = (), hidden: Mapping[tuple[str, str], Sequence[str]] | None = None) -> DataFrame:
    """The record of a fixed page, or none while its anchors are empty, with ``locations`` and ``unnamed_locations`` beside it.

    ``texts`` are approved texts that stand in no table, ``headers`` those of its table, ``hidden``
    names rows that are never shown, as (table, column) and values; badges have theirs by default.
    Values are compared in content normal form. ``locations`` are the named places with their
    coordinates, ``unnamed_locations`` counts those left out for want of a name.
    """
    own = dict(tables)
    for table, condition in page.filters.items():
        own[table] = own[table].where(condition)
    for (table, column), values in {(PREFIX + "accredition", "sec_title"): HIDDEN_BADGES, **(hidden or {})}.items():
        if table in own:
            shown = ~F.coalesce(content_text(F.col(column)).isin(*map(tidy, values)), F.lit(False))
            own[table] = own[table].where(shown)
    known = {"accreditations": BADGES_HEADING, **(texts or {})}
    sections = tuple(_told(s, known, tuple(headers)) for s in page.sections)
    anchors = list(page.anchors) or [s.table for s in sections]
    spark = next(iter(tables.values())).sparkSession
    keys = [s.link for s in sections if s.link]
    one = spark.range(1).select(F.lit(page.route).alias("slug"), F.lit(1).alias("id"), F.lit(1).alias("__one"))
    if page.keys:
        first = own[page.keys].agg(*[F.min_by(k, "id").alias(k) for k in keys])
        one = one.join(F.broadcast(first.withColumn("__one", F.lit(1))), "__one")
    if "." in page.title:
        table, column = page.title.split(".")
        named = own[PREFIX + table].agg(F.min_by(column, "id").alias("title"))
        one = one.join(F.broadcast(named.withColumn("__one", F.lit(1))), "__one")
    else:
        one = one.withColumn("title", F.lit(page.title))
    one = one.drop("__one")
    if all(own[a].isEmpty() for a in anchors):
        one = one.where("false")
    own["__page"] = one
    found = compose_pages(own, Page(page.scope, page.content_type, site.rstrip("/") + "/", "__page", "slug", "title", sections))
    if page.source_ref:
        found = found.withColumn("source_ref", F.lit(page.source_ref))
    else:
        lowest = own[anchors[0]].agg(F.min("id").alias("__lowest"))
        found = found.crossJoin(F.broadcast(lowest)).withColumn("source_ref", F.concat(F.lit(f"{anchors[0]}#"), F.col("__lowest").cast("string"))).drop("__lowest")
    if page.offices:
        return found.crossJoin(F.broadcast(_places(tables[page.offices])))
    return found.withColumns({"locations": F.array().cast(_LOCATIONS), "unnamed_locations": F.lit(0).cast("bigint")})


def _places(offices: DataFrame) -> DataFrame:
    """One row: the named places in order of id with their coordinates, and how many have no name."""
    name = F.coalesce(content_text(F.col("name")), F.lit(""))
    cell = lambda c: (F.col(c) if c in offices.columns else F.lit(None)).cast("string").alias(c)
    place = F.struct("id", F.struct(name.alias("name"), cell("latitude"), cell("longitude")).alias("place"))
    gathered = F.array_sort(F.collect_list(F.when(name != "", place)))
    return offices.agg(F.transform(gathered, lambda x: x["place"]).cast(_LOCATIONS).alias("locations"), F.count_if(name == "").alias("unnamed_locations"))
