"""Span types, patterns, vocabularies and policies that results depend on."""

from __future__ import annotations

# --- Fixed values: patterns by span type, in the order in which hits are emitted ---
REGEX_PATTERNS = {
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "EMAIL": r"\b[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}\b",
    "CREDIT_CARD": r"\b\d{12,19}\b",
    "IP": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "MRN": r"\bMRN-\d{7}\b",
}
ACCOUNT_ID_CONTEXT = (r"arn:aws[a-z0-9-]*:[^:]*:[^:]*:$", r'"(?:recipientA|a)ccountId"\s*:\s*"$')
ACCOUNT_ID_WORDS = ("arn:aws", "ccountId")
ACCOUNT_ID_LENGTH = 12
ENTROPY_TOKEN = r"[A-Za-z0-9+/=_.-]{8,}"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}"
NAME_TOKEN = r"\b[A-Za-z][A-Za-z0-9._-]{5,29}\b"
EARLY_EXIT = r"[A-Za-z]{2,}|\d{2,}"
KEY = r"(\w+)="
EXCISED_KEY = r"[\w.-]+=$"
ISSUED_TOKEN = r"tok_[a-z_]+_[0-9a-f]{32}"
SYSLOG_HEADER = r"^[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+"
SYSLOG_TAG = r"^([\w-]+)(?:\(([\w-]+)\))?(?:\[(\d+)\])?:\s*(.*)$"
#: Message shapes after the tag, tried in this order: pattern and the fields of its groups.
SYSLOG_SHAPES = (
    (r"^Failed password for invalid user (\S+) from (\S+) port (\d+)", ("user", "src_ip", "port")),
    (r"^Failed password for (\S+) from (\S+) port (\d+)", ("user", "src_ip", "port")),
    (r"^Accepted password for (\S+) from (\S+) port (\d+)", ("user", "src_ip", "port")),
    (r"^Accepted publickey for (\S+) from (\S+) port (\d+)", ("user", "src_ip", "port")),
    (r"^Invalid user (\S+) from (\S+)", ("user", "src_ip")),
    (r"^User (\S+) from (\S+) not allowed", ("user", "src_ip")),
    (r"^Disconnected from (?:authenticating )?user (\S+) (\S+) port (\d+)", ("user", "src_ip", "port")),
    (r"^pam_unix\(su:session\): session opened for user \S+ by (\S+)\(uid=\d+\)", ("user",)),
    (r"^DHCPACK from (\S+)", ("src_ip",)),
    (r"^DHCPOFFER from (\S+)", ("src_ip",)),
    (r"^New session (\d+) of user (\S+)\.$", ("session_id", "user")),
    (r"^\((\S+)\)\s+CMD\s+\((.+)\)$", ("user", "command")),
    (r"^\((\S+)\)\s+RELOAD\s+\((.+)\)$", ("user", "crontab")),
    (r"^<info>\s+\[[\d.]+\]\s+dhcp4\s+\(([\w.]+)\):\s+address\s+(\S+)", ("iface", "src_ip")),
    (r"^<info>\s+\[[\d.]+\]\s+device\s+\(([\w.]+)\):\s+Activation:\s+\(wifi\)\s+connected to '([^']+)'", ("iface", "ssid")),
    (r"^(\S+\.service): Failed with result '([\w-]+)'\.$", ("unit", "result")),
)
LOG_TYPES = ("windows_event", "syslog", "cloudtrail")
CRITICAL_TYPES = ("PERSON", "EMAIL", "SSN", "CREDIT_CARD", "MRN")
SENSITIVE_TYPES = ("IP",)
PSEUDONYMIZE_TYPES = ("IP", "PERSON")
TOKENIZE_TYPES = ("EMAIL", "MRN", "CREDIT_CARD", "SSN")
MASKED_TYPES = ()
#: The method of spans that are neither pseudonymized nor tokenized, and what a masked span is replaced by.
MASK_METHOD, PLACEHOLDER = "redact", "[REDACTED]"
HIGH_ENTROPY = "HIGH_ENTROPY"
MIN_NAME_PART, MIN_NAME_TOKEN, MAX_NAME_TOKEN = 3, 6, 30
ENTROPY_MIN_LENGTH, ENTROPY_THRESHOLD = 12, 3.3
NER_MIN_SCORE = 0.5
DRIFT_THRESHOLD, DRIFT_MIN_SAMPLE = 0.05, 20
TOKEN_HEX = 32
# --- end of fixed values ---

#: Java's counterpart of patterns over all of Unicode.
UNICODE = "(?U)"

#: Common United States names, public domain; the default dictionary where none is given.
FIRST_NAMES = (
    "james", "mary", "john", "patricia", "robert", "jennifer", "michael", "linda", "william", "elizabeth", "david", "barbara",
    "richard", "susan", "joseph", "jessica", "thomas", "sarah", "charles", "karen", "daniel", "nancy", "matthew", "lisa",
    "anthony", "betty", "mark", "sandra", "donald", "ashley", "steven", "emily", "paul", "donna", "andrew", "michelle",
    "joshua", "carol", "kenneth", "amanda", "kevin", "melissa", "brian", "deborah", "george", "stephanie", "timothy", "rebecca",
)
LAST_NAMES = (
    "smith", "johnson", "williams", "brown", "jones", "garcia", "miller", "davis", "rodriguez", "martinez", "hernandez", "lopez",
    "gonzalez", "wilson", "anderson", "thomas", "taylor", "moore", "jackson", "martin", "lee", "perez", "thompson", "white",
    "harris", "sanchez", "clark", "ramirez", "lewis", "robinson", "walker", "young", "allen", "king", "wright", "scott",
    "torres", "nguyen", "hill", "flores", "green", "adams", "nelson", "baker", "hall", "rivera", "campbell", "mitchell",
)
