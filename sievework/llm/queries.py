"""Registered queries of this subpackage. None has SQL: each is tested against brute force, a round trip or held-out labels."""

from . import contamination, jaccard, packing, passages, pitman, quality, repair, secrets, spelling, tokenfile, toxicity, vectors, warc

QUERIES = {
    "op1_kneser_ney_quality": quality.op1,
    "op2_secret_scan": secrets.op2,
    "op3_grid_order_join": vectors.op3,
    "op4_decontamination": contamination.op4,
    "op5_pack": packing.op5,
    "op6_repeated_passages": passages.op6,
    "op7_warc_index": warc.op7,
    "op8_toxicity": toxicity.op8,
    "op9_token_file": tokenfile.op9,
    "op10_jaccard_join": jaccard.op10,
    "op11_pitman_yor_scores": pitman.op11,
    "op12_conversation_repair": repair.op12,
    "op13_spelling_variants": spelling.op13,
}

ORACLES: dict[str, str] = {}
