"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: In Spark's DDL.
SCHEMAS: dict[str, str] = {
    "corpus": "source STRING, pos BIGINT, text STRING",
    "quadruplets": "sentence STRING, quadruplet_id INT, filler INT, gap INT, pre_gap_text STRING, post_gap_text STRING, filler_word STRING",
    "transitivity": "sentence STRING, pre_gap_text STRING, moved_np STRING, verb STRING, verb_type STRING, relativizer STRING, moved_np_animacy STRING",
    "distractors": "sentence STRING, pre_gap_text STRING, moved_np STRING, plausible_objects STRING, moved_np_animacy STRING, verb_expects_animate STRING",
    "pairs": "UID STRING, field STRING, linguistics_term STRING, pairID STRING, sentence_good STRING, sentence_bad STRING",
    "cloze": "examples ARRAY<STRUCT<input: STRING, target_scores: MAP<STRING, DOUBLE>, comment: STRING>>",
    "vocabulary": "word STRING, idx INT, freq BIGINT",
    "blocks": "block_id BIGINT, input_ids ARRAY<INT>, attention_mask ARRAY<INT>, labels ARRAY<INT>",
    "token_logprobs": "run STRING, step BIGINT, dataset STRING, item_id BIGINT, cond STRING, cand STRING, tok_pos INT, token STRING, logp DOUBLE",
    "anchor_pairs": "quadruplet_id INT, position_label STRING, base_text STRING, source_text STRING, yb STRING, ys STRING, base_anchor STRING, source_anchor STRING",
    "sweep": "layer INT, position_label STRING, odds_mean DOUBLE, odds_std DOUBLE, delta_logp_mean DOUBLE, delta_logp_std DOUBLE, train_loss DOUBLE",
    "scalars": "run STRING, tag STRING, step BIGINT, value DOUBLE",
    "activations": "pair_id BIGINT, src ARRAY<FLOAT>, orc ARRAY<FLOAT>",
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with the columns of the schema, in its order and types; a missing column is an error."""
    want = StructType.fromDDL(SCHEMAS[name])
    if missing := [f.name for f in want if f.name not in df.columns]:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in want))
