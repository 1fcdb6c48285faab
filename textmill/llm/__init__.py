"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations


def queries() -> dict:
    from . import digest, lattice, lexical, license_scan, merkle, mixing, near_dedup, nearest, packing, pfor, quality, secret_scan, topk

    return {
        "op1_adaptive_dimension_scan": nearest.op1_adaptive_dimension_scan,
        "op2_structural_secret_scan": secret_scan.op2_structural_secret_scan,
        "op3_improbable_feature_digest": digest.op3_improbable_feature_digest,
        "op4_bottom_k_near_dedup": near_dedup.op4_bottom_k_near_dedup,
        "op5_subset_sum_mix": mixing.op5_subset_sum_mix,
        "op6_subword_lattice_likelihood": lattice.op6_subword_lattice_likelihood,
        "op7_karmarkar_karp_packing": packing.op7_karmarkar_karp_packing,
        "op8_line_field_quality": quality.op8_line_field_quality,
        "op9_license_signature_rules": license_scan.op9_license_signature_rules,
        "op10_patched_frame_of_reference": pfor.op10_patched_frame_of_reference,
        "op11_uniform_threshold_topk": topk.op11_uniform_threshold_topk,
        "op12_bag_dedup_search": lexical.op12_bag_dedup_search,
        "op13_slot_pivot_manifest": merkle.op13_slot_pivot_manifest,
    }


def oracle_sql() -> dict[str, str]:
    from . import lexical, merkle, topk

    return {"op11_uniform_threshold_topk": topk.TOPK_SQL, "op12_bag_dedup_search": lexical.RANK_SQL, "op13_slot_pivot_manifest": merkle.manifest_sql()}
