"""A choice of queries against their SQL on the smallest tables."""

import os

import pytest

from tests import oracle

NAMES = [
    "p1_found", "p1_by_month", "p3_found", "p3_union_schema", "p3_columns", "p5_found", "f1_contact_eligibility", "f10_feature_selection", "e2_ec_map", "e12_set_similarity", "j1_condition_table", "j3_construct_pairs", "j7_region_range",
    "j13_first_candidate", "j23_zip_lists", "a1_attrition", "a6_feature_frequency", "a14_feature_prevalence", "a19_strata", "a26_grouping_sets", "w2_benjamini_hochberg", "w4_medoid", "w10_column_index", "t1_examples", "u2_set_algebra", "s6_fasta_k8",
    "s9_jsonl_k9", "s20_matrix_k2", "q6_auc", "q7_kruskal", "q8_pairwise_auc", "j8_group_distances", "a36_row_splits",
    "a2_confidence", "a3_weighted", "a4_protein_rollup", "a5_cluster_summary", "a8_residue_importance", "a9_patch_fractions", "a12_entropy_gini", "j4_aligned_scores", "j6_members_with_geometry", "a37_family_groups", "a40_enrichment", "j2_metadata", "j10_metrics_with_labels",
    "j20_ranked_pick", "j22_assignment_chain", "a18_endpoint_summary", "q13_paired_compare", "a28_block_metrics", "a28_two_by_two", "a31_run_summary", "a32_report_counts", "a39_grid_summary", "d6_distinct_sequences", "w9_two_nearest", "t3_top_per_group", "t5_best_hit",
    "q10_welch", "q11_correlations", "e13_vector_math", "e15_weighted_vector", "f20_pending", "f22_signal_group", "s2_typed_csv", "s4_token_arrays", "s5_organism_groups", "s10_domtblout", "s15_fallback_inputs", "s22_pilot_overview", "w8_fold_faults",
]


@pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    oracle.same_rows(spark, name)
