"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from arborsim.llm.curriculum import op8_curriculum
from arborsim.llm.decontaminate import OP5_SQL, op5_decontamination
from arborsim.llm.flac import op4_flac
from arborsim.llm.jaccard_join import op3_jaccard
from arborsim.llm.pii_crf import op2_pii
from arborsim.llm.quality import op10_quality
from arborsim.llm.reply_trees import op9_reply_trees
from arborsim.llm.sharding import op7_shards
from arborsim.llm.token_files import op1_token_files
from arborsim.llm.toxicity import op6_toxicity


def queries():
    return {f.__name__: f for f in (op1_token_files, op2_pii, op3_jaccard, op4_flac, op5_decontamination, op6_toxicity, op7_shards, op8_curriculum, op9_reply_trees, op10_quality)}


def oracle_sql():
    return {"op5_decontamination": OP5_SQL}
