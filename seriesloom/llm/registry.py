"""The queries of this subpackage and their SQL."""

from seriesloom.llm import bpe, chat, fingerprint, jaccard, langid, mixing, oracles, repeats, secrets, tokens, treeforest

QUERIES = {
    "op1_token_output": tokens.op1_token_output,
    "op2_bucket_digest": fingerprint.op2_bucket_digest,
    "op3_projection_forest": treeforest.op3_projection_forest,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_suffix_repeats": repeats.op5_suffix_repeats,
    "op6_byte_level_bpe": bpe.op6_byte_level_bpe,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_language_id": langid.op8_language_id,
    "op9_source_mix": mixing.op9_source_mix,
    "op10_chat_format": chat.op10_chat_format,
}
ORACLES: dict[str, str] = {"op3_projection_forest": oracles.OP3, "op4_ngram_jaccard": oracles.OP4, "op9_source_mix": oracles.OP9, "op10_chat_format": oracles.OP10}
