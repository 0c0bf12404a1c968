"""Fixed values.

Everything here has to be spelled exactly like this for results to be right:
alias orders, role names, prompt wording, separators, defaults.
"""

# Characters removed at both ends of a text (all Unicode whitespace).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Field names tried in this order when a record is brought into one schema.
INSTRUCTION_KEYS = ("instruction", "prompt", "question", "query", "task")
INPUT_KEYS = ("input", "context", "ctx", "data")
OUTPUT_KEYS = ("output", "answer", "response", "completion")
MESSAGE_KEYS = ("messages", "conversations")

# Shorter lists used for the duplicate key.
KEY_INSTRUCTION = ("instruction", "prompt", "question")
KEY_INPUT = ("input", "context", "data")
KEY_OUTPUT = ("output", "answer", "response")
KEY_SEPARATOR = "\n---\n"

# Chat messages.
ROLE_KEYS = ("role", "from", "speaker")
CONTENT_KEYS = ("content", "value", "text")
USER_ROLES = ("user", "human")
ASSISTANT_ROLES = ("assistant", "gpt", "model")
PART_SEPARATOR = "\n\n"

# Prompt wording.
SYSTEM_PROMPTS = {
    "cyber": """You are an expert in offensive and defensive cybersecurity.

Your role:
- drive attack tools, produce commands if relevant;
- analyze architectures;
- analyze logs, alerts, network packets, EDR, SIEM, IDS/IPS events;
- produce structured reports;
- identify MITRE ATT&CK techniques when relevant;
- propose defensive recommendations;
- help with hardening, detection, remediation, and compliance.

Important rules:
- do not invent IOCs, CVEs, CVSS scores, or technical proof;
- if information is insufficient, say so clearly;
- prioritize structured, actionable answers;
- if the expected format is JSON, produce only valid JSON.
""",
    "finance": """You are an expert finance and market analysis assistant.

Your role:
- analyze companies, markets, financial statements, macroeconomic context, risks, and valuation drivers;
- explain trading, portfolio, accounting, and corporate finance concepts;
- produce structured reports, calculations, and decision-support summaries;
- distinguish facts, assumptions, estimates, and uncertainty;
- help with risk management, compliance-aware analysis, and due diligence.

Important rules:
- do not invent prices, filings, ratios, ratings, dates, or sources;
- if information is insufficient, say so clearly;
- this is educational analysis, not personalized financial advice;
- prioritize structured, traceable reasoning;
- if the expected format is JSON, produce only valid JSON.
""",
}
EXPERT = {
    ("cyber", "export"): "an offensive and defensive cybersecurity expert",
    ("cyber", "train"): "an offensive and defensive cybersecurity expert",
    ("finance", "export"): "an expert finance and market analysis assistant",
    ("finance", "train"): "a finance and market analysis expert",
}
INSTRUCTION_HEADER = "Instruction:\n"
CONTEXT_HEADER = "\n\nContext / input data:\n"
ANSWER_RULE = (
    "\n\nRespond as {expert}. "
    "Respect the format expected by the training example. "
    "If the expected output is JSON, produce only valid JSON."
)

# ChatML markers.
CHATML_OPEN = "<|im_start|>"
CHATML_CLOSE = "<|im_end|>"

# Token features.
IGNORE_LABEL = -100
MAX_LENGTH = 512
PAD_MULTIPLE = 8
#: Batches that are sorted by length together.
MEGA_BATCHES = 50
EFFECTIVE_BATCH = 16
CALIBRATION_ROWS = 2048
CALIBRATION_LENGTH = 2048

# Splitting, sampling and chunking defaults.
SEED = 42
VALIDATION_FRACTION = 0.05
SAMPLE_LIMIT = 20000
CHUNK_SIZE = 1000

# Server stream.
STREAM_PREFIX = "data: "
STREAM_END = "[DONE]"

# Request runs.
P95 = 0.95
FAILURE_LIMIT = 3
ALL_FAILED = "All requests failed"
ABORTED_REQUEST = "Aborted due to too many failures"
CALIBRATION_ERROR = "Unknown sample keys"
RESULTS_PREFIX = "benchmark_results_"

# Stock serving settings and multi-GPU special cases.
STOCK_MEM_UTIL = 0.80
STOCK_MAX_LEN = 32768
STOCK_BATCHED_TOKENS = 32768
STOCK_MAX_SEQS = 128
SPECIAL_GPU_MODELS = (
    "nvidia/DeepSeek-V4-Flash-nvfp4-DSpark",
    "nvidia/MiniMax-M3-DSpark",
    "sparkarena/Minimax-M3-v0-NVFP4",
)
SPECIAL_GPUS = 4

# Spellings that switch an option on.
TRUE_WORDS = ("1", "true", "yes", "y", "on")
