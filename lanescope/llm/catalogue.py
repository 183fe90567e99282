"""The corpus queries and their SQL."""

from __future__ import annotations

from . import conversations, decontaminate, jaccard, language, neighbours, packing, personal, scoring, secrets, suffixes, tokenfiles, toxicity, whitening

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_tokenfiles": tokenfiles.op2_tokenfiles,
    "op3_suffixes": suffixes.op3_suffixes,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_packing": packing.op6_packing,
    "op7_secrets": secrets.op7_secrets,
    "op8_language": language.op8_language,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_personal": personal.op10_personal,
    "op11_whitening": whitening.op11_whitening,
    "op12_scoring": scoring.op12_scoring,
    "op13_conversations": conversations.op13_conversations,
}
ORACLES = {"op1_decontaminate": decontaminate.ORACLE, "op13_conversations": conversations.ORACLE}
