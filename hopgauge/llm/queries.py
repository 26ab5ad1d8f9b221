"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from hopgauge.llm import chat, lexical, merkle, mixing, packing, pieces, pii, quality, simhash, spherical, substring, tokencount, toxicity

QUERIES = {
    "op1_convolutional_toxicity": toxicity.query,
    "op2_risk_controlled_rules": quality.query,
    "op3_best_fit_packing": packing.query,
    "op4_transducer_token_counts": tokencount.query,
    "op5_simhash_anchors": simhash.query,
    "op6_spherical_caps": spherical.query,
    "op7_chat_formatting": chat.query,
    "op8_phrase_automata": substring.query,
    "op9_soft_membership_mixing": mixing.query,
    "op10_keyed_surrogates": pii.query,
    "op11_nra_search": lexical.query,
    "op12_merkle_manifest": merkle.query,
    "op13_piece_round_trip": pieces.query,
}

ORACLES = {
    "op2_risk_controlled_rules": quality.ORACLE,
    "op6_spherical_caps": spherical.ORACLE,
    "op7_chat_formatting": chat.ORACLE,
    "op8_phrase_automata": substring.ORACLE,
    "op11_nra_search": lexical.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
