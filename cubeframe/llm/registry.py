"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

import corpus_pipeline
from cubeframe.llm import chat, media, mixing, neighbours, packing, repeats, secrets, simhash, toxicity, urls

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_packing": packing.op2_packing,
    "op3_url_filter": urls.op3_url_filter,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_simhash": simhash.op5_simhash,
    "op6_chat": chat.op6_chat,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_repeats": repeats.op8_repeats,
    "op9_media": media.op9_media,
    "pipeline": corpus_pipeline.run,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES: dict[str, str] = {"op3_url_filter": urls.ORACLE, "op6_chat": chat.ORACLE, "op8_repeats": repeats.ORACLE, "op10_mixing": mixing.ORACLE}
