"""Text functions: Column in, Column out. All stay in the JVM."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import cache, wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

TICK = chr(96)
ELLIPSIS = "…"


def built_once(make: Callable) -> Callable:
    """Keeps what make builds for each Spark context and arguments: for expressions of named columns, which take some
    thousand calls to build and are the same in every query."""
    kept: dict = {}

    @wraps(make)
    def get(*args):
        key = (id(SparkContext._active_spark_context), *args)
        if key not in kept:
            kept[key] = make(*args)
        return kept[key]

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@cache
def _folds() -> tuple[str, str]:
    """Each character that simple case folding changes, and what it becomes: one character for another. The standard
    library knows full folding; where that gives more than one character, lower case is the simple form if it has one."""
    pairs = []
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        to = c.casefold()
        to = to if len(to) == 1 else c.lower()
        if to != c and len(to) == 1:
            pairs.append((c, to))
    ascii_ = [(chr(i), chr(i + 32)) for i in range(65, 91)]
    return "".join(a for a, _ in ascii_ + pairs), "".join(b for _, b in ascii_ + pairs)


def fold_case(s: Column) -> Column:
    """s under simple case folding: equal for two strings that differ in case only, also where lower case differs (long s,
    the Kelvin sign, final sigma, titlecase digraphs)."""
    return F.translate(s, *_folds())


def trim_space(s: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def inline(s: Column) -> Column:
    """One line: runs of white space become a space, leading # go."""
    return F.regexp_replace(collapse(s), "^#+ ?", "")


def cut(s: Column, n: int) -> Column:
    """At most n code points, a cut marked by an ellipsis."""
    return let(s, lambda s: F.when(F.length(s) > n, F.concat(F.rtrim(F.substring(s, 1, n)), F.lit(ELLIPSIS))).otherwise(s))


def clip(s: Column, n: int) -> Column:
    return cut(inline(s), n)


def first_line(s: Column) -> Column:
    return F.substring_index(trim_space(s), "\n", 1)


def trim_bytes(s: Column, n: int | Column) -> Column:
    """At most n bytes of UTF-8, cut between characters."""
    size = F.lit(n) if isinstance(n, int) else n

    def trimmed(s: Column) -> Column:
        def head(back: int) -> Column:
            return F.try_validate_utf8(F.substr(s.cast("binary"), F.lit(1), F.greatest(size - back, F.lit(0))).cast("string"))

        return F.when(F.octet_length(s) <= size, s).otherwise(F.coalesce(*[head(i) for i in range(4)]))

    return let(s, trimmed)


def clip_lines(s: Column, n: int) -> Column:
    """(text, cut): the longest prefix of n bytes at most that ends at a line break, else at a character."""

    def clipped(s: Column) -> Column:
        head = trim_bytes(s, n + 1)
        at_break = F.length(head) - F.length(F.substring_index(head, "\n", -1)) - 1
        text = F.when(F.octet_length(s) <= n, s).when(at_break > 0, F.substr(head, F.lit(1), at_break)).otherwise(trim_bytes(s, n))
        return F.struct(text.alias("text"), (F.octet_length(s) > n).alias("cut"))

    return let(F.regexp_replace(s, "\n+$", ""), clipped)


def longest_ticks(s: Column) -> Column:
    """Length of the longest run of backticks."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit(f"({TICK}+)"), F.lit(1)), F.length)), F.lit(0))


def fence(s: Column) -> Column:
    """A fence longer than any run of backticks in s, three at least."""
    return F.repeat(F.lit(TICK), F.greatest(longest_ticks(s), F.lit(2)) + 1)


def fenced(s: Column) -> Column:
    return let(F.regexp_replace(s, "[\r\n]+$", ""), lambda body: let(fence(body), lambda f: F.concat(f, F.lit("\n"), body, F.lit("\n"), f, F.lit("\n"))))


def code(s: Column) -> Column:
    return F.concat(F.lit(TICK), F.replace(inline(s), F.lit(TICK), F.lit("'")), F.lit(TICK))


def repo_key(path: Column) -> Column:
    """A directory name for a path."""
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


def name_slug(s: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9-]", "-"), F.lit("-"))


def first_sentence(s: Column, n: int = 120) -> Column:
    """Up to the first ". " or ideographic stop, at most n code points."""

    def sentence(s: Column) -> Column:
        end = F.least(F.nullif(F.instr(s, ". "), F.lit(0)), F.nullif(F.instr(s, "。"), F.lit(0)))
        return F.when(end.isNotNull(), F.substr(s, F.lit(1), end)).otherwise(s)

    return let(let(trim_space(s), sentence), lambda s: F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit(ELLIPSIS))).otherwise(s))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def parent_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), F.lit(-2)), F.lit(""))


def tilde(path: Column, home: str) -> Column:
    return F.when(path == home, "~").when(F.startswith(path, F.lit(home + "/")), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 30))).otherwise(path)


def within(path: Column, root: Column) -> Column:
    """path is root or below it."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def ancestors(path: Column) -> Column:
    """path and its parent directories, so that containment becomes an equality."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == 1, F.when(F.startswith(path, F.lit("/")), "/").otherwise(F.get(parts, 0))).otherwise(F.array_join(F.slice(parts, 1, n), "/")))


def relative_to(path: Column, root: Column) -> Column:
    """Paths below root lose it, root itself is a dot, others stay."""
    return F.when(path == root, ".").when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)


def sanitize_scalar(s: Column) -> Column:
    """Control characters, line separators and byte order marks become spaces; spaces collapse."""
    return collapse(F.regexp_replace(s, "[\\x00-\\x1F\\x7F-\\x9F\\u2028\\u2029\\uFEFF]", " "))


def headline(profile: Column, n: int = 300) -> Column:
    """A profile's lines that are neither blank, nor headings, nor comments, on one line."""
    lines = F.filter(F.transform(F.split(profile, "\n"), trim_space), lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("<!--")))
    return cut(F.array_join(lines, " "), n)


def normal_remote(url: Column) -> Column:
    """host/path of a remote's many spellings: scheme, user, .git and a last slash go, the host is lower case."""

    def bare(url: Column) -> Column:
        has_scheme = F.instr(url, "://") > 0
        u = F.regexp_replace(F.when(has_scheme, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(url), r"^[^/]*@", "")
        return F.when(has_scheme, u).otherwise(F.regexp_replace(u, r"^([^:]*):", "$1/"))

    def lowered(u: Column) -> Column:
        host = F.substring_index(u, "/", 1)
        rest = F.substr(u, F.length(host) + 2)
        return F.when(rest == "", F.lower(host)).otherwise(F.concat(F.lower(host), F.lit("/"), rest))

    return let(F.regexp_replace(F.regexp_replace(let(trim_space(url), bare), "/$", ""), r"\.git$", ""), lowered)


def relative_time(at: Column, now: Column) -> Column:
    """How long ago, in the largest whole unit; null: unknown. Both are timestamps."""
    seconds = F.greatest(F.unix_micros(now) - F.unix_micros(at), F.lit(0)) / 1e6
    unit = lambda s, n, mark: F.concat(F.floor(s / n).cast("string"), F.lit(mark))
    ago = let(seconds, lambda s: (
        F.when(s < 60, "just now").when(s < 3600, unit(s, 60, "m ago")).when(s < 86400, unit(s, 3600, "h ago"))
        .when(s < 30 * 86400, unit(s, 86400, "d ago")).when(s < 365 * 86400, unit(s, 30 * 86400, "mo ago")).otherwise(unit(s, 365 * 86400, "y ago"))
    ))
    return F.when(at.isNull(), "unknown").otherwise(ago)


def age_days(at: Column, now: Column) -> Column:
    return F.floor((F.unix_micros(now) - F.unix_micros(at)) / (86400 * 10**6)).cast("bigint")


def rfc3339(s: Column) -> Column:
    """A timestamp; anything but RFC 3339 is null."""
    ok = s.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")
    return F.when(ok, F.try_to_timestamp(s)).cast("timestamp")
