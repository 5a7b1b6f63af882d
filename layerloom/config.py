"""Defaults of the jobs; every job takes them as plain arguments."""

PASSAGE_MAX_TOKENS = 150
PASSAGE_OVERLAP = 1
MERGE_THRESHOLD = 0.80
MERGE_MAX_TOKENS = 400
LOOKBACK_PASSAGES = 2
EMBED_BATCH = 128
CLAIM_DEDUP_THRESHOLD = 0.93
TOP_K = 20
RETRIEVAL_THRESHOLD = 0.70
PHRASE_THRESHOLD = 0.85
LAYER_LIMIT = 20
FUZZY_THRESHOLD = 0.82
PAGE_SIZE = 20

#: Singular names stand in hits, plural ones in item ids and exports.
LAYERS = {"proposition": "propositions", "claim": "claims", "phrase": "phrases"}
