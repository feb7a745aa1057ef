"""Fixed values and default parameters.

These are the values results depend on; every operator takes them as arguments with these defaults.
"""

# Cleaning and normalisation.
MIN_WORDS = 15
TARGET_LANGUAGE = "en"
MIN_VIDEO_VIEWS = 2000
DECAY_PER_DAY = 0.05
BOT_AUTHORS = ["AutoModerator", "RemindMeBot", "RepostSleuthBot", "sneakpeekbot", "WikiSummarizerBot", "HelperBot_"]
DELETED_MARKERS = ["[deleted]", "[removed]", ""]

# Relevance, grouping, diversification, clustering, merging.
RELEVANCE_THRESHOLD = 0.68
RELEVANCE_FLOOR = 50
EMBED_TEXT_CHARS = 7000
RERANK_TOP_N = 200
DUPLICATE_THRESHOLD = 0.88
MINHASH_THRESHOLD = 0.7
MMR_LAMBDA = 0.7
MMR_TOP_K = 70
CANDIDATE_RECALL = 0.95
CLUSTER_MIN_SIZE = 3
CLUSTER_MIN_SAMPLES = 2
CLUSTER_EPSILON = 0.06
DOCS_PER_CLUSTER = 10
MERGE_THRESHOLD = 0.85

# Signal scoring.
SCORE_WEIGHTS = {
    "relevance": 0.30,
    "evidence_count": 0.20,
    "velocity": 0.15,
    "source_spread": 0.15,
    "engagement": 0.10,
    "novelty": 0.10,
}
FLAT_VELOCITY = 0.5
TOTAL_SOURCES = 3
TOP_PAIN_POINTS = 6
TOP_FEATURE_REQUESTS = 4
TOP_QUESTIONS = 8
TOP_QUOTES = 5
QUESTION_INTENTS = ["question", "discussion", "comparison"]
SYNTHESIS_CHARS = 40000

# Query expansion.
PEER_THRESHOLD = 0.6
GLOBAL_WEIGHT = 0.8
PEER_WEIGHT = 0.2
RISING_BOOST = 1.06
TOP_BOOST = 1.03
DEMAND_BOOST = 1.02
KIND_OF_SOURCE = {"llm": "structure", "autocomplete": "demand", "trends": "demand"}
HARVEST_TOP_K = 10

# Platforms in harvest order, and the stages of a run.
PLATFORMS = ["reddit", "youtube", "hackerNews", "instagram"]
RUN_STAGES = ["intent_analysis", "topic_expansion", "collection", "python_analysis"]

# Texts and names that results carry.
UNREADABLE_REPLY = "(LLM extraction failed)"
FAILED_REPLY = "(LLM error)"
FALLBACK_QUESTIONS = ["{} trends", "{} alternatives", "how to use {}"]
DEFAULT_MODEL = "gemini"
EMBEDDING_STAGE, EXTRACTION_STAGE, SYNTHESIS_STAGE = "s1_relevance", "extract_signals", "synthesize"

# Sizes that steer the physical layout only; results do not depend on them.
BLOCK_ROWS = 2048          # rows on one side of a similarity block
MMR_POOL_ROWS = 1000       # candidates one task diversifies between two passes over the data
QUERY_BROADCAST_BYTES = 32 << 20
