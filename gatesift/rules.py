"""Rule data: signatures, keywords, PII patterns, levels, limits and messages.

Every literal below is a FIXED VALUE. Verdicts are compared string by string
with those of existing deployments, so the entries and their order are given
and must not be edited. Logic lives elsewhere; this module only holds data.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------- fixed values
# Signatures, one list per family. A signature is a plain substring.

SQL = [
    "' or '", "' or 1=1", "' or 1=1--", "' or '1'='1", "' or \"1\"=\"1",
    "' union select", "union all select", "' having '", "' group by '", "' order by ",
    "' drop table", "'; drop table", "' delete from", "' insert into", "' update ",
    "' alter table", "' create table", "' truncate ", "'; exec", "'; execute",
    "xp_cmdshell", "sp_executesql", "benchmark(", "sleep(", "waitfor delay", "pg_sleep(",
    "extractvalue(", "updatexml(", "load_file(", "into outfile", "information_schema",
    "mysql.user", "sysobjects", "syscolumns",
]

XSS = [
    "<script", "</script>", "javascript:", "vbscript:", "onload=", "onerror=", "onclick=",
    "onmouseover=", "onfocus=", "onblur=", "onchange=", "onsubmit=", "onreset=",
    "onkeydown=", "onkeyup=", "onkeypress=", "document.cookie", "document.write",
    "window.location", "eval(", "settimeout(", "setinterval(", "innerhtml=", "outerhtml=",
    "document.getelementbyid", "alert(", "confirm(", "prompt(", "fromcharcode(",
    "unescape(", "string.fromcharcode",
]

COMMAND = [
    "; rm -rf", "; del ", "& echo", "| nc ", "| netcat", "; wget", "; curl",
    "; cat /etc/passwd", "; cat /etc/shadow", "$(", "`", "; ls -la", "; dir", "; whoami",
    "; id", "; uname", "; ps aux", "; netstat", "; ifconfig", "; ping", "; nslookup",
    "; dig", "; chmod +x", "; ./", "&&", "||", "; sh", "; bash", "; cmd", "; powershell",
    "& type", "& copy", "& move", "& ren",
]

NOSQL = [
    "$where", "$ne", "$in", "$nin", "$regex", "$exists", "$elemmatch", "$gt", "$gte",
    "$lt", "$lte", "$or", "$and", "$not", "$nor", "this.password", "this.username",
    "db.eval", "mapreduce", "return true", "return false", "; return ", "var x=", "var y=",
]

LDAP = [
    ")(cn=*", ")(uid=*", ")(mail=*", ")(&", ")(|", "*)(uid=*", "*)(cn=*", "admin*",
    "*admin", ")(objectclass=*",
]

PATH = [
    "../", "..\\", "%2e%2e%2f", "%2e%2e%5c", "....//", "....\\\\", "/etc/passwd",
    "/etc/shadow", "/etc/hosts", "c:\\windows\\system32", "boot.ini", "web.config", ".env",
    ".htaccess", "/proc/self/environ",
]

XML = [
    "<!entity", "<!doctype", "system \"file://", "system \"http://", "system \"ftp://",
    "%xxe;", "&xxe;", "xml version=", "<?xml",
]

TEMPLATE = [
    "{{", "}}", "${", "#{", "<%", "%>", "@{", "[[", "]]", "__import__", "getattr(",
    "setattr(", "__builtins__", "exec(", "eval(", "compile(", "__globals__",
]

CODE_EXECUTION = [
    "system(", "exec(", "shell_exec(", "passthru(", "popen(", "proc_open(", "eval(",
    "base64_decode", "file_get_contents(", "fopen(", "fwrite(", "unlink(", "chmod(",
    "chown(", "mkdir(", "rmdir(", "symlink(", "readfile(", "include(", "require(",
    "preg_replace(", "create_function(", "call_user_func(", "__import__(", "getattr(",
    "setattr(", "hasattr(", "delattr(", "globals(", "locals(", "vars(", "dir(", "compile(",
    "execfile(", "input(", "raw_input(", "open(", "file(", "__builtins__", "function(",
    "new function", "constructor(", "apply(", "call(", "bind(", "with(", "delete ", "void(",
    "typeof ", "cmd.exe", "/bin/sh", "/bin/bash", "powershell.exe", "sh.exe", "bash.exe",
    "python.exe", "perl.exe", "ruby.exe", "java.exe", "curl(", "wget(", "fetch(",
    "xmlhttprequest", "ajax(", "socket(", "connect(", "bind(", "listen(", "accept(",
]

SUSPICIOUS = [
    "base64", "hex2bin", "bin2hex", "rot13", "str_rot13", "gzinflate(", "gzuncompress(",
    "bzdecompress(", "mcrypt_decrypt(", "openssl_decrypt(", "password_verify(", "crypt(",
    "md5(", "sha1(", "hash(", "hash_hmac(",
]

# The harmful-keyword dictionary, matched as whole words.
KEYWORDS = [
    "dumb", "idiot", "stupid", "hate", "kill", "moron", "fool", "loser", "ugly", "trash",
    "garbage", "nonsense", "shut up", "die", "worthless", "pathetic", "bastard", "jerk",
    "sucks", "terrible", "evil", "disgusting", "nasty", "hell", "damn", "asshole",
    "hate you", "screw you", "kill yourself", "retard", "racist", "bigot", "sexist",
    "homophobic", "terrorist", "violence", "threat", "bomb", "shoot", "stab", "destroy",
    "murder", "rape", "abuse", "harass", "bully", "cancer", "plague", "idiotic", "slur",
    "bitch", "cunt", "fuck", "shit", "piss", "dick", "pussy", "slut", "whore", "cock",
    "faggot", "imbecile", "cretin", "dunce", "incompetent", "scum", "vermin", "filth",
    "freak", "creep", "suicide", "self-harm", "hang", "nazi", "swastika", "white power",
    "jihad", "assassinate", "attack", "kidnap", "molest", "extort", "blackmail", "arson",
    "butcher", "slaughter", "massacre", "behead", "lynch", "maim", "torture", "dox",
    "stalk", "expose", "anal", "anus", "balls", "boobs", "bugger", "clit", "crap", "dildo",
    "erection", "fetish", "genital", "incest", "masturbate", "nude", "orgasm", "pedophile",
    "porn", "sadist", "sadism", "vagina", "voyeur", "execute", "annihilate", "eradicate",
    "obliterate", "death", "gore", "bloodshed", "carnage", "mkdir(", "system(", "exec(",
    "shell_exec(", "eval(", "base64_decode", "unlink(", "chmod(", "rmdir(", "symlink(",
    "proc_open(", "passthru(", "popen(",
]

# PII patterns, as given (byte-wise regular expressions; \b, \d and \s are ASCII).
EMAIL_REGEX = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_REGEX = (
    r"\b(?:\+1[\s\-\.]?)?(?:\([2-9]\d{2}\)[\s\-\.]?|[2-9]\d{2}[\s\-\.])[2-9]\d{2}[\s\-\.]\d{4}\b"
    r"|\b(?:\+\d{1,3}[\s\-\.])?(?:\d{3}[\s\-\.]\d{3}[\s\-\.]\d{4})\b"
)
SSN_REGEX = r"\b\d{3}-\d{2}-\d{4}\b"

# Patterns of the rule-density risk score, with their issue names.
RISK_CHARACTERS_REGEX = r"[;\\/<>\[\]{}|`&]"
RISK_SQL_REGEX = r"(?i)(select|insert|update|delete|drop|create|alter|truncate|union|exec|xp_)"
RISK_XSS_REGEX = r"(?i)(<script>|javascript:|on\w+\s*=)"
RISK_CHARACTERS_ISSUE = "suspicious_characters"
RISK_SQL_ISSUE = "sql_injection_attempt"
RISK_XSS_ISSUE = "xss_attempt"
RISK_STEP = 0.3
RISK_THRESHOLD = 0.7
RISK_OTHER_REASON = "potentially_unsafe_content"

# Messages.
SQL_ISSUE = "Potential SQL injection attempt detected"
XSS_ISSUE = "Potential XSS attack detected"
COMMAND_ISSUE = "Potential command injection attempt detected"
NOSQL_ISSUE = "Potential NoSQL injection attempt detected"
LDAP_ISSUE = "Potential LDAP injection attempt detected"
PATH_ISSUE = "Potential path traversal attempt detected"
XML_ISSUE = "Potential XML/XXE injection attempt detected"
TEMPLATE_ISSUE = "Potential template injection attempt detected"
CODE_EXECUTION_PREFIX = "Potential code execution attempt detected: "
SUSPICIOUS_PREFIX = "Suspicious function detected: "
KEYWORD_ISSUE = "harmful_keyword_detected"
KEYWORD_ISSUE_SHOWN = "toxic_language"
MODEL_ISSUE = "llm_flagged_unsafe"
PII_ISSUE = "PII detected"
EMAIL_ISSUE = "Email address detected"
PHONE_ISSUE = "Phone number detected"
SSN_ISSUE = "Social Security Number detected"
OVERSIZE_ISSUE = "File size exceeds maximum allowed size"
EMBEDDED_ISSUE = "PDF contains embedded files"
BAD_PDF_ISSUE = "invalid_or_corrupted_pdf"
FILE_UNAVAILABLE_ISSUE = "file_analysis_unavailable"
FILE_ERROR_ISSUE = "file_analysis_error"

TEXT_SUMMARY = "Python-based text analysis (Code Injection + Keywords + LLM)"
FILE_TEXT_SAFE_SUMMARY = "Text analysis completed. No security issues detected."
FILE_TEXT_UNSAFE_SUMMARY = "Text analysis completed. Potential security issues identified."
PDF_SAFE_SUMMARY = "PDF analysis completed. No security issues detected in extracted text."
PDF_UNSAFE_SUMMARY = (
    "PDF analysis completed. Potential security issues identified in extracted text."
)
OVERSIZE_SUMMARY = "Text exceeds maximum allowed size"
FILE_MISSING_ERROR = "File not found: "
FILE_UNAVAILABLE_SUMMARY = "C++ module is not available for file analysis."

BAD_LEVEL_ERROR = "Invalid security level. Must be one of: high, medium, low"
AMBIGUOUS_ERROR = "Provide either 'text' or 'file', not both"
MALFORMED_ERROR = "Request is not valid JSON"
MISSING_ERROR = "Either 'text' or 'file' must be provided"
GATEWAY_LEVEL_ERROR = "security_level must be one of: high, medium, low"

DISPLAY_ERRORS = {
    "unsupported_file_type": "Unsupported file type. Only PDF and TXT files are supported.",
    "file_too_large": "File is too large. Maximum size allowed is 10MB.",
    "invalid_base64": "Invalid file format. Please try uploading the file again.",
}
UNKNOWN_ERROR_DISPLAY = "Unknown error occurred"

# Limits, weights and lifetimes.
MAX_BYTES = 10 * 1024 * 1024
SAMPLE_BYTES = 1024
MIN_PRINTABLE_RATIO = 0.85
FILE_THRESHOLD = 0.8
EMBEDDED_FACTOR = 0.8
PII_PENALTY = 0.5
MALICIOUS_PENALTY = 0.5
TEXT_TTL_SECONDS = 1800
FILE_TTL_SECONDS = 7200
STATS_TTL_SECONDS = 3600
COUNTER_TTL_SECONDS = 86400
# ------------------------------------------------------------ end of fixed values


@dataclass(frozen=True)
class Level:
    """Threshold and score weights of one security level."""

    threshold: float
    deep_analysis: bool
    rule_weight: float
    llm_weight: float


# fixed values
LEVELS = {
    "high": Level(0.9, True, 0.4, 0.6),
    "medium": Level(0.7, False, 0.7, 0.3),
    "low": Level(0.5, False, 1.0, 0.0),
}
RISK_WEIGHTS = {"high": (0.4, 0.6), "medium": (0.6, 0.4), "low": (1.0, 0.0)}
DEFAULT_LEVEL = "high"


@dataclass(frozen=True)
class Family:
    """A signature list and how its hits are reported.

    ``every`` families report each matching signature (``message`` is then a
    prefix); the others report at most one issue. ``raw`` families are matched
    against the text as written, all others against the lower-cased text.
    """

    name: str
    patterns: tuple[str, ...]
    message: str
    every: bool = False
    raw: bool = False


FAMILIES = (
    Family("sql", tuple(SQL), SQL_ISSUE),
    Family("xss", tuple(XSS), XSS_ISSUE),
    Family("command", tuple(COMMAND), COMMAND_ISSUE),
    Family("nosql", tuple(NOSQL), NOSQL_ISSUE),
    Family("ldap", tuple(LDAP), LDAP_ISSUE),
    Family("path", tuple(PATH), PATH_ISSUE),
    Family("xml", tuple(XML), XML_ISSUE),
    Family("template", tuple(TEMPLATE), TEMPLATE_ISSUE, raw=True),
    Family("code", tuple(CODE_EXECUTION), CODE_EXECUTION_PREFIX, every=True),
    Family("suspicious", tuple(SUSPICIOUS), SUSPICIOUS_PREFIX, every=True),
)

# The file profile tests this signature with a capital letter against lower-cased
# text, so there it never fires.
TEXT_ONLY_SIGNATURES = frozenset({"$elemmatch"})


def families(profile: str) -> dict[str, Family]:
    """Families by name, in report order, for the ``text`` or ``file`` profile."""
    if profile not in ("text", "file"):
        raise ValueError(f"unknown profile {profile!r}")
    if profile == "text":
        return {f.name: f for f in FAMILIES}
    return {
        f.name: Family(
            f.name,
            tuple(p for p in f.patterns if p not in TEXT_ONLY_SIGNATURES),
            f.message,
            f.every,
            f.raw,
        )
        for f in FAMILIES
    }
