"""The corpus queries, by name, and the SQL of those that SQL can express."""

import corpus_pipeline
from tidemesh.llm import crf, divergence, divergence_trees, linkgraph, mixing, neardup, negatives, packing, pivots, sharding, substrings, toxicity, warc


def queries() -> dict:
    return {
        "op1_line_crf": crf.op1_line_crf,
        "op2_link_trust": linkgraph.op2_link_trust,
        "op3_pivot_topk": pivots.op3_pivot_topk,
        "op4_divergence_rules": divergence.op4_divergence_rules,
        "op5_jump_shards": sharding.op5_jump_shards,
        "op6_capture_index": warc.op6_capture_index,
        "op7_weighted_minhash": neardup.op7_weighted_minhash,
        "op8_window_gru": toxicity.op8_window_gru,
        "op9_bin_slack_packing": packing.op9_bin_slack_packing,
        "op10_curriculum_mix": mixing.op10_curriculum_mix,
        "op11_divergence_trees": divergence_trees.op11_divergence_trees,
        "op12_segment_negatives": negatives.op12_segment_negatives,
        "op13_substring_doubling": substrings.op13_substring_doubling,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_pivot_topk": pivots.OP3_SQL,
        "op4_divergence_rules": divergence.OP4_SQL,
        "op6_capture_index": warc.OP6_SQL,
        "op10_curriculum_mix": mixing.OP10_SQL,
        "op11_divergence_trees": divergence_trees.OP11_SQL,
        "op12_segment_negatives": negatives.OP12_SQL,
        "op13_substring_doubling": substrings.OP13_SQL,
    }
