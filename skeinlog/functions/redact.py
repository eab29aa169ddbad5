"""Masks secrets in text. The order of the steps is part of the result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, trim_bytes

MARK = "[redacted]"
FIELD_BEFORE, FIELD_AFTER = 16 << 10, 8 << 10

# The shapes of secrets. White space is ASCII and word boundaries are those of ASCII words.
_S, _NS = r"[\t\n\f\r ]", r"[^\t\n\f\r ]"
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
PEM_BLOCK = r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"
PEM_OPEN = r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*"
SK_KEY = r"(^|[^A-Za-z0-9])sk-[A-Za-z0-9_-]{10,}"
URL_PASSWORD = rf"([a-z][a-z0-9+.-]*://[^/\t\n\f\r :@]+:)[^@\t\n\f\r /]+@"
CLI_FLAG = rf"(?iu)(--(?:token|password|passwd|secret|api-key|apikey)[= ]){_NS}+"
AUTH_VALUE = rf"{_L}(Basic|Token|Bearer)({_S}+)(?=[A-Za-z._~-]*[0-9+/=])[A-Za-z0-9+/=._~-]{{8,}}"
TOKEN_SHAPES = (
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"xox[abprs]-[A-Za-z0-9-]{8,}",
    rf"{_L}(?:AKIA|ASIA)[A-Z0-9]{{16}}{_R}",
    r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    rf"{_L}(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{{10,}}",
    rf"{_L}AIza[0-9A-Za-z_-]{{30,}}",
    rf"{_L}npm_[A-Za-z0-9]{{30,}}",
)
TOKEN_NEEDLES = (("gh",), ("github_pat_",), ("xox",), ("AKIA", "ASIA"), ("eyJ",), ("_live_", "_test_"), ("AIza",), ("npm_",))
KEY_VALUE = (
    r"(?iu)((?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]*(?:secret|password|passwd|token|api[_-]?key|private[_-]?key|credential|auth)"
    rf"[A-Za-z0-9_.-]*[\"']?{_S}*[:=]{_S}*[\"']?)[^\t\n\f\r \",']+"
)


KEY_WORDS = ("secret", "password", "passwd", "token", "api", "private", "credential", "auth")
#: Letters that fold to ASCII ones without regard to case.
FOLDED = ("\u017f", "\u212a")


def _step(s: Column, pattern: str, to: str, *needles: str, fold: bool = False) -> Column:
    """Replaces the pattern where the text has one of the needles, without which it cannot match: a plain
    search for them is much cheaper than the pattern."""
    def run(s: Column) -> Column:
        low, found = (F.lower(s) if fold else s), F.lit(False)
        for n in needles:
            found = found | F.contains(low, F.lit(n))
        for n in FOLDED if fold else ():
            found = found | F.contains(s, F.lit(n))
        return F.when(found, F.regexp_replace(s, pattern, to)).otherwise(s)

    return let(s, run)


def redact(s: Column) -> Column:
    s = _step(s, PEM_BLOCK, MARK, "-----BEGIN")
    s = _step(s, PEM_OPEN, MARK, "-----BEGIN")
    s = _step(s, SK_KEY, f"$1{MARK}", "sk-")
    s = _step(s, URL_PASSWORD, f"$1{MARK}@", "://")
    s = _step(s, CLI_FLAG, f"$1{MARK}", "--")
    s = _step(s, AUTH_VALUE, f"$1$2{MARK}", "Basic", "Token", "Bearer")
    for shape, needles in zip(TOKEN_SHAPES, TOKEN_NEEDLES, strict=True):
        s = _step(s, shape, MARK, *needles)
    return _step(s, KEY_VALUE, f"$1{MARK}", *KEY_WORDS, fold=True)


def scrub(s: Column) -> Column:
    """redact, capped before (so that work is bounded) and after (so that a cut secret cannot show)."""
    return trim_bytes(redact(trim_bytes(s, FIELD_BEFORE)), FIELD_AFTER)
