"""Queries over dense and lexical search, with the sizes set down so that the small tables take the path of the large ones: many blocks, many buckets."""

import duckdb
import pytest
from quillon.operators import retrieval
from quillon.plans import QUERIES, SQL, Tables
from quillon.sources import store
from test_oracle import duck, plain  # noqa: F401

#: Finding, query and how many dense searches it makes: two where both configurations are evaluated.
DENSE = [
    ("F6", "D6_retrieved_labels", 2),
    ("F7", "D7_labels_without_rank", 2),
    ("F8", "E1_label_ranks", 2),
    ("F9", "E26_paired_diff", 2),
    ("F10", "E27_stored_means", 2),
    ("F12", "E3_mrr", 2),
    ("F13", "E4_ndcg_at_k", 2),
    ("F14", "E5_metric_problems", 2),
    ("F15", "H2_same_candidates", 2),
    ("F16", "L10_retrieval_eval", 2),
    ("F17", "L11_gate_reasons", 2),
    ("F18", "L11_retrieval_gate", 2),
    ("F19", "L13_compare_runs", 2),
    ("F20", "L1_dense_search", 1),
    ("F30", "G3_report_order", 2),
    ("F31", "F11_section_groups", 1),
    ("F32", "A6_baseline_upsert", 2),
    ("F33", "L14_eval_report", 2),
]
FUSED = [
    ("F39", "F4_rerank_order"),
    ("F40", "F3_fused_ranks"),
    ("F41", "D3_list_outer_join"),
]


@pytest.fixture
def plans(monkeypatch):
    """The plans of all searches made in a test, by the name of the search."""
    found = {"block_search": [], "lexical_search": []}
    for name, own in found.items():
        search = getattr(retrieval, name)

        def spy(*args, search=search, own=own):
            rows = search(*args)
            own.append(rows._jdf.queryExecution().executedPlan().toString())
            return rows

        monkeypatch.setattr(retrieval, name, spy)
    monkeypatch.setattr(store, "_BUILT", {})
    monkeypatch.setattr(retrieval, "JOINED_PAIRS", 0)
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", 10)
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 150)
    monkeypatch.setattr(retrieval, "CHUNKS_PER_TASK", 50)
    return found


def assert_rows(name: str, tables: Tables, duck: duckdb.DuckDBPyConnection) -> None:  # noqa: F811
    rows = QUERIES[name](tables)
    columns = sorted(rows.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = duck.sql(f"select {quoted} from ({SQL[name]})").fetchall()
    assert sorted((tuple(map(plain, r)) for r in rows.select(*columns).collect()), key=repr) == sorted((tuple(map(plain, r)) for r in expected), key=repr)


@pytest.mark.parametrize(("finding", "name", "searches"), DENSE)
def test_dense_search_meets_in_blocks(finding, name, searches, spark, sf_dir, duck, plans):  # noqa: F811
    assert_rows(name, Tables(spark, sf_dir), duck)
    assert len(plans["block_search"]) == searches
    for plan in plans["block_search"]:
        assert "FlatMapCoGroupsInArrow" in plan and "WindowGroupLimit" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(("finding", "name"), FUSED)
def test_lists_are_cut_before_they_are_shuffled(finding, name, spark, sf_dir, duck, plans):  # noqa: F811
    assert_rows(name, Tables(spark, sf_dir), duck)
    assert len(plans["block_search"]) == len(plans["lexical_search"]) == 1
    (plan,) = plans["lexical_search"]
    assert "Bucketed: true" in plan and "out of 4" in plan and "WindowGroupLimit" in plan
    assert not [line for line in plan.splitlines() if "hashpartitioning(question_id#" in line and "chunk_id#" in line]
