"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from corpuskiln.llm import jaccard, licenses, linededup, lm, media, mixing, pii, repair, resampling, sharding, substrings, tiling, toxicity

QUERIES = {
    "op1_substrings": substrings.op1_substrings,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_linededup": linededup.op3_linededup,
    "op4_sharding": sharding.op4_sharding,
    "op5_licenses": licenses.op5_licenses,
    "op6_lm": lm.op6_lm,
    "op7_mixing": mixing.op7_mixing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_tiling": tiling.op9_tiling,
    "op10_media": media.op10_media,
    "op11_pii": pii.op11_pii,
    "op12_resampling": resampling.op12_resampling,
    "op13_repair": repair.op13_repair,
}
ORACLE_SQL = {
    "op1_substrings": substrings.OP1_SQL,
    "op2_jaccard": jaccard.OP2_SQL,
    "op3_linededup": linededup.OP3_SQL,
    "op4_sharding": sharding.OP4_SQL,
    "op5_licenses": licenses.OP5_SQL,
    "op12_resampling": resampling.OP12_SQL,
    "op13_repair": repair.OP13_SQL,
}
