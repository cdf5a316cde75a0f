"""Fixed values of formats and rules."""

from __future__ import annotations

# Must be exactly these for right results.
ERROR_TYPES = ("computer_error", "dependency_mismatch", "missing_nodes", "disorder")
GENERATED_ERROR_TYPES = ("computation_error", "dependency_mismatch", "missing_nodes")
BAD_MARKERS = ("here is the json", "computation_error", "dependency_mismatch", "missing_nodes", "error type", "rejected solution", "chosen solution")
RESERVED = ("define", "so", "answer", "final", "state", "compute", "solve", "simplifying", "move", "isolate", "divide", "therefore", "thus", "const")
NUMBER = r"-?\d+(?:\.\d+)?"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_]*"
ANSWER_MARK = r"(?i)(?:final\s*answer|answer)\s*[:：]"
CLAUSE_END = r"[.;\n]+"
EQUATION = r"(\d+(?:\.\d+)?)\s*([\+\-\*\/x×÷])\s*(\d+(?:\.\d+)?)\s*=\s*(\d+(?:\.\d+)?)"
ENTITY_AS = r"define\s+(.+?)\s+as\s+([A-Za-z][A-Za-z0-9_]*)\b"
ENTITY_EQUALS = r"define\s+([A-Za-z][A-Za-z0-9_]*)\s*=\s*(.+)"
ASSIGNMENT = r"\b([A-Za-z][A-Za-z0-9_]*)\s*=\s*([^.;\n]+)"
STEP_AS = r"(?s)^Define\s+(.*?)\s+as\s+([A-Za-z][A-Za-z0-9_]*)\s*;\s*(.*)$"
STEP_EQUALS = r"(?s)^Define\s+([A-Za-z][A-Za-z0-9_]*)\s*=\s*(.+)\s*;?\s*$"
GRAPH_WEIGHTS = {"edge": 0.45, "node": 0.20, "entity": 0.20, "raw": 0.15}
CHAIN_THRESHOLD, EPS = 0.35, 1e-6
SIMILARITY = (0.35, 0.995)
LENGTH_RATIO = (0.40, 0.98)
MIN_CHOSEN, MIN_REJECTED, MIN_GENERATED = 50, 30, 40
MOST_GENERATED_RATIO = 1.3
TRAIN_LENGTHS = {"prompt": 5, "chosen": 10, "rejected": 10}
K_LIST = (1, 2, 4, 8, 16, 32, 64, 128)
MAIN_KS = (1, 8, 32, 128)
RETENTION_KS = (1, 32, 128)
BUCKETS = ("op_2_10", "op_11_14", "op_15_20")
ANCHOR_BUCKET, HARD_BUCKETS = "op_2_10", ("op_11_14", "op_15_20")
MODEL_ORDER = ("base", "sft", "disorder", "compute_error", "missing_nodes", "dependency_mismatch")
MAIN_MODELS = ("sft", "compute_error", "missing_nodes", "dependency_mismatch")
MODEL_NAMES = (
    ("Qwen_Qwen2-0.5B", "base"),
    ("qwen2_0.5b_sft_op10_checkpoint-10339", "sft"),
    ("dpo_full_disorder_414", "disorder"),
    ("dpo_full_final_compute_error_1", "compute_error"),
    ("dpo_full_missing_nodes_414", "missing_nodes"),
    ("dpo_full_mismatch_414", "dependency_mismatch"),
)
#: Short names for figures: the first row of which a name holds some word. Names without a word of FIGURE_GATE stay.
FIGURE_NAMES = (
    ("compute_error", ("compute",)),
    ("missing_nodes", ("missing",)),
    ("dependency_mismatch", ("mismatch", "dep")),
    ("disorder", ("disorder",)),
    ("sft", ("sft",)),
    ("base", ("qwen", "base")),
)
FIGURE_GATE = ("compute_error", "compute", "missing_nodes", "missing", "disorder", "mismatch", "dep", "sft", "qwen")
BOUNDARY_METRICS = ("answer-pass@1", "answer-pass@32", "reasoning-chain-pass@1", "reasoning-chain-pass@32")
MIXTURES = (
    "compute_error_missing_200each",
    "disorder_compute_error_200each",
    "disorder_mismatch_200each",
    "disorder_missing_200each",
    "mismatch_compute_error_200each",
    "mismatch_missing_200each",
)
INJECTIONS = (
    "compute_error_10pct_disorder_total400",
    "compute_error_10pct_missing_total400",
    "compute_error_1pct_disorder_total400",
    "compute_error_1pct_missing_total400",
    "disorder_10pct_missing_total400",
    "disorder_1pct_missing_total400",
    "mismatch_10pct_disorder_total400",
    "mismatch_10pct_missing_total400",
    "mismatch_1pct_disorder_total400",
    "mismatch_1pct_missing_total400",
    "missing_10pct_disorder_total400",
    "missing_1pct_disorder_total400",
)
#: Words of these names and the error types they stand for.
MIXTURE_TYPES = {"compute_error": "computer_error", "missing": "missing_nodes", "mismatch": "dependency_mismatch", "disorder": "disorder"}
SYSTEM_MESSAGE = "You are a helpful and logical assistant. Please show your complete reasoning process step by step."
STEP_REQUEST = "Please reason step by step, and show your complete reasoning process."

#: What a generator is asked for by error type, in our own words; {task} is the problem with its correct solution.
REQUESTS = {
    "computation_error": "Rewrite the correct solution with exactly one wrong calculation, so that its final answer is wrong. Keep names, steps and wording.",
    "dependency_mismatch": "Rewrite the correct solution so that exactly one step uses another quantity than it should. Keep it natural and complete.",
    "missing_nodes": "Rewrite the correct solution without two or three steps that later steps need, so that a reader can't fill the gap. Keep the rest.",
}
REPLY_FORMAT = 'Answer with this JSON object alone: {"%s": {"rejected": "..."}}'
REQUEST_TEMPLATES = {kind: f"{text}\n{REPLY_FORMAT % kind}\n\n{{task}}" for kind, text in REQUESTS.items()}
