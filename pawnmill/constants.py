"""Values that must be exactly these for results to agree."""

# Special tokens in id order, and promotion suffixes.
SPECIAL_TOKENS = ("<PAD>", "<UNK>", "<EOS>", "<WHITE>", "<BLACK>", "<DRAW>")
PAD_ID, UNK_ID, EOS_ID, WHITE_ID, BLACK_ID, DRAW_ID = range(6)
PROMOTIONS = ("q", "r", "b", "n")
VOCABULARY_SIZE = 1974

# Corpus preparation.
SHUFFLE_SEED = 42
SHARD_SIZE = 100_000
EVAL_FRACTION, TEST_FRACTION = 0.04, 0.01
BASE_GAMES, FINETUNE_GAMES = 5_000_000, 1_000_000
MIN_ELO, MAX_RATING_DIFF, MAX_ELO_GAP = 2000, 30, 200
OPENINGS = {"e2e4": "e4", "d2d4": "d4", "c2c4": "c4", "g1f3": "Nf3"}
OTHER_OPENING = "other"
ELO_BUCKETS = ((1200, "<1200"), (1600, "1200-1600"), (2000, "1600-2000"))
TOP_ELO_BUCKET, UNKNOWN_ELO = "2000+", "unknown"
OUTCOMES = {"1-0": "white", "0-1": "black", "1/2-1/2": "draw"}
TIME_CONTROLS = ("bullet", "blitz", "rapid", "classical", "correspondence")
METADATA_COLUMNS = ("elo_bucket", "result", "opening_family", "termination_type")

# Evaluation.
EVALUATORS = ("vs_stockfish", "legal_rate", "perplexity", "puzzles")
PHASES = ("opening", "middle", "endgame")
SIDES = ("white", "black")
PHASE_BOUNDS = (20, 60)
GAME_RESULTS = ("1-0", "0-1", "1/2-1/2", "*")
TERMINATIONS = ("natural", "illegal-move", "max-plies", "stockfish-resigned")
SKILL_RANGE = (0, 20)
BLUNDER_CP = 200
RESERVOIR_SIZE, RESERVOIR_SEED = 10_000, 0
PIECE_VALUES = {"Q": 9, "R": 5, "B": 3, "N": 3, "P": 1}
