"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import byte_codec, edit_counts, edit_prints, exact_dedup, kneser_ney, masked_lm, minhash_dedup, packing, piece_codec, schema_rewrite, suffix_dedup, toxicity, turn_repair


def queries() -> dict:
    return {
        "op1_kneser_ney": kneser_ney.query,
        "op2_masked_lm": masked_lm.query,
        "op3_edit_counts": edit_counts.query,
        "op4_edit_prints": edit_prints.query,
        "edit_near_copies": edit_prints.near_query,
        "op5_best_fit_packing": packing.query,
        "op6_toxicity": toxicity.query,
        "op7_exact_dedup": exact_dedup.query,
        "op8_minhash_dedup": minhash_dedup.query,
        "op9_piece_codec": piece_codec.query,
        "op10_suffix_dedup": suffix_dedup.query,
        "op11_byte_codec": byte_codec.query,
        "op12_schema_rewrite": schema_rewrite.query,
        "op13_turn_repair": turn_repair.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": exact_dedup.SQL, "op8_minhash_dedup": minhash_dedup.SQL, "op10_suffix_dedup": suffix_dedup.SQL}
