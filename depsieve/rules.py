"""The detection rules.

Everything in this file is a constant that must be exactly this for results to be
right: patterns (in ECMAScript regex syntax), word lists, thresholds and seed data.
``functions.text.java_regex`` turns a pattern into the dialect Spark uses.
"""

# --- alert vocabulary (fixed values) ---------------------------------------------

INSTALL_SCRIPT = "install_script"
NETWORK_ACCESS = "network_access"
TYPOSQUAT = "typosquat"
FILESYSTEM_ACCESS = "filesystem_access"
OBFUSCATED_CODE = "obfuscated_code"
SHELL_ACCESS = "shell_access"
KNOWN_COMPROMISED = "known_compromised"
LOCKFILE_MATCH = "lockfile_match"

ALERT_TYPES = (
    INSTALL_SCRIPT,
    NETWORK_ACCESS,
    TYPOSQUAT,
    FILESYSTEM_ACCESS,
    OBFUSCATED_CODE,
    SHELL_ACCESS,
    KNOWN_COMPROMISED,
    LOCKFILE_MATCH,
)
SEVERITIES = ("low", "medium", "high")

# --- which files count as code (fixed values) ------------------------------------

CODE_EXTENSIONS = ("js", "ts", "jsx", "tsx", "mjs", "cjs")

# --- filesystem rules (fixed values) ---------------------------------------------

FILESYSTEM_PATTERNS = (
    r"""require\s*\(\s*['"`]fs['"`]\s*\)""",
    r"""require\s*\(\s*['"`]fs\/promises['"`]\s*\)""",
    r"""import.*from\s*['"`]fs['"`]""",
    r"""import.*from\s*['"`]fs\/promises['"`]""",
    r"fs\.writeFile",
    r"fs\.writeFileSync",
    r"fs\.appendFile",
    r"fs\.appendFileSync",
    r"fs\.unlink",
    r"fs\.unlinkSync",
    r"fs\.rmdir",
    r"fs\.rmdirSync",
    r"fs\.rm\(",
    r"fs\.rmSync",
    r"fs\.mkdir",
    r"fs\.mkdirSync",
    r"fs\.rename",
    r"fs\.renameSync",
    r"fs\.chmod",
    r"fs\.chmodSync",
)

# --- shell rules (fixed values) --------------------------------------------------

SHELL_PATTERNS = (
    r"""require\s*\(\s*['"`]child_process['"`]\s*\)""",
    r"""import.*from\s*['"`]child_process['"`]""",
    r"child_process\.exec\(",
    r"child_process\.execSync\(",
    r"child_process\.spawn\(",
    r"child_process\.spawnSync\(",
    r"child_process\.execFile\(",
    r"child_process\.execFileSync\(",
    r"child_process\.fork\(",
    r"\bexec\s*\(",
    r"\bexecSync\s*\(",
    r"\bspawn\s*\(",
    r"\bspawnSync\s*\(",
    r"\bexecFile\s*\(",
    r"\bexecFileSync\s*\(",
)
SHELL_STRING_PATTERN = r"""['"`].*(?:bash|sh|cmd|powershell|zsh).*['"`]"""
SHELL_WORDS = ("bash", "sh", "cmd", "powershell", "zsh")
SHELL_HIT_UNITS = 100
SHELL_HITS_KEPT = 10

# --- network rules (fixed values) ------------------------------------------------

NETWORK_PATTERNS = (
    r"""require\s*\(\s*['"`](https?|net|dgram|dns)['"]\s*\)""",
    r"""import\s+.*\s+from\s+['"`](https?|net|dgram|dns|axios|node-fetch|got)['"]""",
    r"new\s+XMLHttpRequest\s*\(",
    r"new\s+WebSocket\s*\(",
    r"\.fetch\s*\(",
    r"fetch\s*\(",
)
NETWORK_MODULES = (
    "http", "https", "net", "dgram", "dns",
    "axios", "request", "node-fetch", "got", "superagent",
    "needle", "bent", "ky", "undici", "cross-fetch",
)
NETWORK_GLOBALS = ("fetch", "XMLHttpRequest", "WebSocket", "EventSource")
NETWORK_CALLS = ("fetch", "XMLHttpRequest", "WebSocket")
NETWORK_CONSTRUCTORS = ("XMLHttpRequest", "WebSocket", "EventSource")

# --- high-entropy code (fixed values) --------------------------------------------

ENTROPY_THRESHOLD = 5.5
ENTROPY_MIN_UNITS = 100

# --- install-time scripts (fixed values) -----------------------------------------

INSTALL_SCRIPT_NAMES = (
    "preinstall",
    "install",
    "postinstall",
    "preuninstall",
    "uninstall",
    "postuninstall",
)

# --- look-alike names (fixed values) ---------------------------------------------

TYPOSQUAT_MAX_DISTANCE = 2
TYPOSQUAT_MIN_SIMILARITY = 0.75
TYPOSQUAT_MATCHES_KEPT = 5
POPULAR_LIMIT = 1000
POPULAR_FALLBACK = (
    "react", "lodash", "express", "axios", "webpack", "typescript", "eslint",
    "prettier", "jest", "babel", "vue", "angular", "next", "redux", "moment",
    "chalk", "commander", "dotenv", "cors", "body-parser", "mongoose",
    "sequelize", "passport", "bcrypt", "jsonwebtoken", "nodemon", "mocha", "chai",
    "request", "async", "underscore", "jquery", "bootstrap", "tailwindcss",
)

# --- lockfiles (fixed values) ----------------------------------------------------

LOCKFILE_NAMES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml")

# --- known incidents (fixed values) ----------------------------------------------

KNOWN_BAD_SEED = (
    {
        "package": "axios",
        "versions": ["1.14.1", "0.30.4"],
        "incident": "Axios npm supply chain compromise",
        "date": "2025-03-26",
        "ioc": {
            "maliciousDependencies": ["plain-crypto-js"],
            "description": "Attacker published malicious versions that inject plain-crypto-js to steal "
            "credentials and environment variables. Versions were unpublished by npm after detection.",
            "references": [
                "https://socket.dev/npm/package/axios",
                "https://github.com/axios/axios/issues/6618",
            ],
        },
    },
)

# --- reports (fixed values) ------------------------------------------------------

ANNOTATION_PATTERNS = 3
PLAIN_PATTERNS = 5
