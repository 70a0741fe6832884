"""Values that results depend on and that therefore stand here as they are."""

# Licences whose use is restricted, by prefix of the upper-cased name.
LICENSE_PREFIXES = ["GPL", "AGPL", "LGPL", "MPL", "EPL", "EUPL", "OSL", "CC-BY-SA", "CC-BY-NC"]

# Limits of the size rule, and of the profile's "large" class.
MAX_LINES = 200
MAX_ELEMENTS = 1_048_576
LARGE_ELEMENTS = 1_000_000

# Functions whose calls create input tensors.
TENSOR_MAKERS = ["rand", "randn", "ones", "zeros", "empty", "full", "randint"]

# Patterns of the scan in order, with the reason each gives.
SCAN_PATTERNS = [
    (r"^\s*(torch|triton)(\.\w+)+\s*=(?!=)", "assigns to a torch/triton attribute"),
    (r"\bsetattr\s*\(\s*(torch|triton)\b", "patches torch/triton with setattr"),
    (r"^\s*time\.\w+\s*=(?!=)", "patches a timer"),
    (r"\btorch\.compile\b", "uses torch.compile instead of writing kernels"),
    (r"(?<![\w.])(exec|eval|compile|__import__)\s*\(", "runs hidden code"),
    (r"\b(builtins|__builtins__)\b", "touches Python builtins"),
    (r"\bsys\.modules\b", "swaps imported modules"),
    (r"\b(subprocess|socket|requests|urllib|ctypes)\b", "uses processes, network or ctypes"),
    (r"/tests\b|/logs\b|reward\.json", "touches grader files"),
]

# The gates in the order in which they are passed.
GATES = ["exists", "guard", "parse", "weights", "runs", "uses_triton", "correct"]

# The phases of an episode's timing.
PHASES = ["boot", "setup", "agent", "finalize", "scoring"]

# Share of dev groups (one bucket in so many), and clip range of the ratio.
DEV_BUCKETS = 10
CLIP_LOW, CLIP_HIGH = 0.2, 0.28

# Seeds of the two draws of an execution check (weights, then inputs).
WEIGHTS_SEED, INPUTS_SEED = 0, 1

# Where a solution is written, the end marker of the script that writes it, the files of a task's folder,
# and the version of its description.
SOLUTION_PATH = "/workspace/solution.py"
SOLUTION_MARKER = "SOLUTION_EOF"
DESCRIPTION_FILE = "task.toml"
INSTRUCTION_FILE = "instruction.md"
REFERENCE_FILES = ["environment/reference.py", "tests/reference.py"]
SOLUTION_FILE = "environment/solution.py"
TEST_SCRIPT = "tests/test.sh"
SOLVE_SCRIPT = "solution/solve.sh"
DESCRIPTION_VERSION = "1.4"
