"""Page families of a service site: every page of a family shows the same sections, linked by the columns of its row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from corpusmill.operators.composition import Page, Section
from corpusmill.sources import declarations
from corpusmill.sources.declarations import bullets, cards, h2, h3, img, linked, p, pairs, section


@dataclass(frozen=True)
class PageFamily:
    """``path`` stands before a page's slug; ``placeholders`` are (table, column, value) of texts that stand for nothing."""

    scope: str
    path: str
    table: str
    sections: tuple[Section, ...]
    placeholders: tuple[tuple[str, str, str], ...] = ()


# Tables, columns and order of what each family shows.
# fmt: off
MANAGEMENT_TRAINING = PageFamily(
    "management_training", "services/training/management-system-training/", "subone_managementtrnsubpage",
    (
        section("sec_one", "subone_managementtrnsecone", "trn_sec_one_id",
            h2("section_title"), p("desc"), p("paragraph"), h3("sub_title"), p("sub_text"), bullets("items", "list_text"),
            lists=(linked("subone_managementtrnsecone_trn_sec_one_list", "managementtrnsecone_id", "managementtrnseconelist_id", "subone_managementtrnseconelist", "list_text", name="items"),),
        ),
        section("sec_two", "subone_managementtrnsectwo", "trn_sec_two_id",
            h2("section_title"), img("img"), bullets("items", "list_text"),
            lists=(linked("subone_managementtrnsectwo_trn_sec_two_list", "managementtrnsectwo_id", "managementtrnsectwolist_id", "subone_managementtrnsectwolist", "list_text", name="items"),),
        ),
        section("sec_three", "subone_managementtrnsecthree", "trn_sec_three_id",
            h2("section_title"), bullets("items", "list_text"),
            lists=(linked("subone_managementtrnsecthree_trn_sec_three_list", "managementtrnsecthree_id", "managementtrnsecthreelist_id", "subone_managementtrnsecthreelist", "list_text", name="items"),),
        ),
        section("sec_four", "subone_managementtrnsecfour", "trn_sec_four_id",
            h2("section_title"), bullets("items", "list_text"),
            lists=(linked("subone_managementtrnsecfour_trn_sec_four_list", "managementtrnsecfour_id", "managementtrnsecfourlist_id", "subone_managementtrnsecfourlist", "list_text", name="items"),),
        ),
        section("sec_five", "subone_managementtrnsecfive", "trn_sec_five_id",
            h2("section_title"), cards("items", "title", nested=("below", "title"), level=3),
            lists=(linked("subone_managementtrnsecfive_trn_sec_five_category", "managementtrnsecfive_id", "managementtrnsecfivecategory_id", "subone_managementtrnsecfivecategory", "title", name="items",
                        nested=linked("subone_managementtrnsecfivecategory_trn_sec_five_list", "managementtrnsecfivecategory_id", "managementtrnsecfivelist_id", "subone_managementtrnsecfivelist", "title", name="below")),),
        ),
        section("sec_six", "subone_managementtrnsecsix", "trn_sec_six_id",
            h2("section_title"), p("paragraph"),
        ),
    ),
)
GRC = PageFamily(
    "grc", "services/governance-risk-compliance/", "subone_grcsubpage",
    (
        section("sec_one", "subone_grcsecone", "grc_sec_one_id",
            h2("section_title"), h3("section_sub_heading"), p("paragraph_title"), p("desc"), p("sub_text"), img("img"), cards("items", "title", "desc", "paragraph", nested=("below", "sec_text"), level=3),
            lists=(linked("subone_grcsecone_grc_sec_one_list", "grcsecone_id", "grcseconelist_id", "subone_grcseconelist", "title", "desc", "paragraph", name="items",
                        nested=linked("subone_grcseconelist_grc_list_list", "grcseconelist_id", "grcseconelistlist_id", "subone_grcseconelistlist", "sec_text", name="below")),),
        ),
        section("sec_two", "subone_grcsectwo", "grc_sec_two_id",
            h2("section_title"), p("desc"), cards("items", "title", "desc", level=3),
            lists=(linked("subone_grcsectwo_grc_sec_two_list", "grcsectwo_id", "grcsectwolist_id", "subone_grcsectwolist", "title", "desc", name="items"),),
        ),
        section("sec_three", "subone_grcsecthree", "grc_sec_three_id",
            h2("section_title"), cards("items", "title", "desc", level=3),
            lists=(linked("subone_grcsecthree_grc_sec_three_list", "grcsecthree_id", "grcsecthreelist_id", "subone_grcsecthreelist", "title", "desc", name="items"),),
        ),
        section("sec_four", "subone_grcsecfour", "grc_sec_four_id",
            h2("section_title"), p("desc"), cards("items", "title", "desc", level=3),
            lists=(linked("subone_grcsecfour_grc_sec_four_list", "grcsecfour_id", "grcsecfourlist_id", "subone_grcsecfourlist", "title", "desc", name="items"),),
        ),
        section("sec_six", "subone_grcsecsix", "grc_sec_six_id",
            h2("section_title"), p("paragraph_title"), p("desc"), img("img"), cards("items", "title", nested=("below", "title"), level=3),
            lists=(linked("subone_grcsecsix_grc_sec_six_category", "grcsecsix_id", "grcsecsixcategory_id", "subone_grcsecsixcategory", "title", name="items",
                        nested=linked("subone_grcsecsixcategory_grc_sec_six_list", "grcsecsixcategory_id", "grcsecsixlist_id", "subone_grcsecsixlist", "title", name="below")),),
        ),
        section("sec_seven", "subone_grcsecseven", "grc_sec_seven_id",
            h2("section_title"), img("img"), bullets("items", "desc"),
            lists=(linked("subone_grcsecseven_grc_sec_seven_list", "grcsecseven_id", "grcsecsevenlist_id", "subone_grcsecsevenlist", "desc", name="items"),),
        ),
    ),
    placeholders=(("subone_grcseconelist", "paragraph", "None"), ("subone_grcsecsix", "paragraph_title", "a"), ("subone_grcsecsix", "desc", "a"),),
)
AUDIT_ASSESSMENT = PageFamily(
    "audit_assessment", "services/audit-and-assessment/", "subone_auditsubpage",
    (
        section("sec_one", "subone_auditsecone", "audit_sec_one_id",
            h2("section_title"), h3("section_sub_heading"), p("desc"), p("sub_title"),
        ),
        section("sec_two", "subone_auditsectwo", "audit_sec_two_id",
            h2("section_title"), cards("items", "list_title", "list_text", level=3),
            lists=(linked("subone_auditsectwo_audit_sec_two_list", "auditsectwo_id", "auditsectwolist_id", "subone_auditsectwolist", "list_title", "list_text", name="items"),),
        ),
        section("sec_qna", "subone_secqna", "sec_qna_id",
            pairs("items", "question", "answer"),
            lists=(linked("subone_secqna_items", "secqna_id", "secqnaitem_id", "subone_secqnaitem", "question", "answer", name="items"),),
        ),
        section("sec_three", "subone_auditsecthree", "audit_sec_three_id",
            h2("section_title"), p("purpose"), p("desc"), h3("list_tile"), bullets("items", "list_text"),
            lists=(linked("subone_auditsecthree_audit_sec_three_list", "auditsecthree_id", "auditsecthreelist_id", "subone_auditsecthreelist", "list_text", name="items"),),
        ),
        section("sec_four", "subone_auditsecfour", "audit_sec_four_id",
            h2("section_title"), p("purpose"), p("desc"), h3("list_tile"), bullets("items", "list_text"),
            lists=(linked("subone_auditsecfour_audit_sec_four_list", "auditsecfour_id", "auditsecfourlist_id", "subone_auditsecfourlist", "list_text", name="items"),),
        ),
        section("sec_five", "subone_auditsecfive", "audit_sec_five_id",
            p("purpose"), p("desc"), h3("list_tile"), bullets("items", "list_text"),
            lists=(linked("subone_auditsecfive_audit_sec_five_list", "auditsecfive_id", "auditsecfivelist_id", "subone_auditsecfivelist", "list_text", name="items"),),
        ),
        section("sec_six", "subone_auditsecsix", "audit_sec_six_id",
            h2("section_title"), img("img"), bullets("items", "list_text"),
            lists=(linked("subone_auditsecsix_audit_sec_six_list", "auditsecsix_id", "auditsecsixlist_id", "subone_auditsecsixlist", "list_text", name="items"),),
        ),
    ),
)
SECURITY_TESTING = PageFamily(
    "security_testing", "services/security-testing-compliance/", "subone_stcsubpage",
    (
        section("sec_one", "subone_stcsecone", "stc_sec_one_id",
            h2("section_title"), p("desc1"), p("desc2"),
        ),
        section("sec_two", "subone_stcsectwo", "stc_sec_two_id",
            h2("section_title"), p("desc1"), p("desc2"), img("img"), cards("items", "list_title", "list_text", level=3),
            lists=(linked("subone_stcsectwo_stc_sec_two_list", "stcsectwo_id", "stcsectwolist_id", "subone_stcsectwolist", "list_title", "list_text", name="items"),),
        ),
        section("sec_three", "subone_stcsecthree", "stc_sec_three_id",
            cards("items", "list_text", "desc", level=3),
            lists=(linked("subone_stcsecthree_stc_sec_three_list", "stcsecthree_id", "stcsecthreelist_id", "subone_stcsecthreelist", "list_text", "desc", name="items"),),
        ),
        section("sec_four", "subone_stcsecfour", "stc_sec_four_id",
            h2("section_title"), p("desc"), cards("items", "list_text", "desc", level=3),
            lists=(linked("subone_stcsecfour_stc_sec_four_list", "stcsecfour_id", "stcsecfourlist_id", "subone_stcsecfourlist", "list_text", "desc", name="items"),),
        ),
        section("sec_six", "subone_stcsecsix", "stc_sec_six_id",
            h2("section_title"), cards("items", "list_text", "desc", level=3),
            lists=(linked("subone_stcsecsix_stc_sec_six_list", "stcsecsix_id", "stcsecsixlist_id", "subone_stcsecsixlist", "list_text", "desc", name="items"),),
        ),
        section("sec_seven", "subone_stcsecseven", "stc_sec_seven_id",
            h2("section_title"), cards("items", "list_text", "desc", level=3),
            lists=(linked("subone_stcsecseven_stc_sec_seven_list", "stcsecseven_id", "stcsecsevenlist_id", "subone_stcsecsevenlist", "list_text", "desc", name="items"),),
        ),
        section("sec_qna", "subone_secqna", "sec_qna_id",
            pairs("items", "question", "answer"),
            lists=(linked("subone_secqna_items", "secqna_id", "secqnaitem_id", "subone_secqnaitem", "question", "answer", name="items"),),
        ),
        section("sec_nine", "subone_stcsecnine", "stc_sec_nine_id",
            h2("section_title"), img("img"), bullets("items", "list_text"),
            lists=(linked("subone_stcsecnine_stc_sec_nine_list", "stcsecnine_id", "stcsecninelist_id", "subone_stcsecninelist", "list_text", name="items"),),
        ),
    ),
)
PROFESSIONAL_TRAINING = PageFamily(
    "professional_training", "services/training/professional-training/", "subone_professionaltrnsubpage",
    (
        section("sec_one", "subone_professionaltrnsecone", "prf_trn_sec_one_id",
            h2("section_title"), p("desc"), p("paragraph"),
        ),
        section("sec_five", "subone_professionaltrnsecfive", "prf_trn_sec_five_id",
            h2("section_title"), h3("sub_text"), p("desc"), h3("level_heading"), cards("items", "title", nested=("below", "title"), level=3),
            lists=(linked("subone_professionaltrnsecfive_prf_trn_sec_five_category", "professionaltrnsecfive_id", "professionaltrnsecfivecategory_id", "subone_professionaltrnsecfivecategory", "title", name="items",
                        nested=linked("subone_professionaltrnsecfivecategory_prf_trn_sec_five_list", "professionaltrnsecfivecategory_id", "professionaltrnsecfivelist_id", "subone_professionaltrnsecfivelist", "title", name="below")),),
        ),
    ),
)
# fmt: on
FAMILIES = (MANAGEMENT_TRAINING, GRC, AUDIT_ASSESSMENT, SECURITY_TESTING, PROFESSIONAL_TRAINING)


def page_of(scope: str, site: str) -> Page:
    """The declaration of a family's pages below ``site``."""
    family = next(f for f in FAMILIES if f.scope == scope)
    return Page(scope, "service", f"{site.rstrip('/')}/{family.path}", family.table, "url_string", "section_title", family.sections, placeholders=family.placeholders)


def allow_list(page: Page) -> dict[str, T.StructType]:
    """The tables a page may read and, of each, the columns."""
    return declarations.allow_list((page,))
