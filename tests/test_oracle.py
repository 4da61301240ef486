"""Queries against their SQL on the smallest tables; compare.py runs all of them."""

import pytest
from compare import difference, oracle_connection

SF = "/root/testdata/sf0.001"
SOME = [
    "detect_passport_ru", "detect_oms_ru", "detect_vin", "detect_names_by_gazetteer", "overlaps_resolved",
    "two_passes", "interval_overlap_join", "ordinals_in_hot_group", "numbering_continued", "mask_tags_hot_group",
    "person_case_forms", "fake_collisions", "restore_tags", "resolve_identifiers", "union_of_session_maps",
    "redaction_boxes", "originals_on_pages", "scan_report_totals", "audit_events", "spreadsheet_masked",
    "json_text_masked", "html_text_masked", "stream_masking", "stream_late_messages", "usage_quota",
]


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, con, name):
    wrong, _ = difference(spark, con, SF, name)
    assert not wrong
