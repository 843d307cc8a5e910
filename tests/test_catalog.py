"""Catalogue queries against their SQL twins. All of them with ``RAPPORT_ALL=1``,
otherwise one per family; ``python tests/compare.py`` does the same from a shell."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import compare as cmp  # noqa: E402
from rapport.plans.catalog import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ["relationship_status", "a1_leaderboard_window", "a2_activity_totals", "a8_profile_scalars", "w1_rolling_counts",
          "w3_conversation_replay", "o2_people_page_interactions", "p1_match_or_and", "j5_stale_profiles", "u1_timeline",
          "r2_keyword_search", "r4_vector_search", "r8_evidence_answer", "a14_activity_answers", "x2_resolve_senders",
          "x1_contact_aliases", "x1_contact_identities", "x5_duplicate_people", "x7_merge_chains", "n4_parse_chat_function", "n5_text_chunks_function", "s1_chat_text", "s4_instagram_json", "k3_changed_rows", "f8_export_dates"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not on this machine")
    return cmp.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("RAPPORT_ALL") else SAMPLE)
def test_query_matches_sql(spark, con, name):
    fn, sql = QUERIES[name]
    verdict, _, _, note = cmp.compare(spark, con, SF, name, fn, sql)
    assert verdict in ("OK", "ROWS"), note


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
