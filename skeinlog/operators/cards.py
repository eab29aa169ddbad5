"""Project cards: front matter of `key: value` lines between --- lines, then a summary and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.redact import redact
from ..functions.text import inline, rfc3339, trim_space

KEYS = ("name", "path", "remote", "stack", "status", "commit", "updated_by")
MAX_SUMMARY, MAX_STACK, MAX_STATUS = 300, 100, 150
MAX_READ_MORE, MAX_READ_MORE_CHARS, MAX_FACTS, MAX_FACT_CHARS = 5, 200, 8, 150


def _plain(value: Column) -> Column:
    """A scalar without its quotes."""
    v = trim_space(value)
    return F.when(v.rlike('^".*"$'), F.replace(F.replace(F.substr(v, F.lit(2), F.length(v) - 2), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))).when(v.rlike("^'.*'$"), F.replace(F.substr(v, F.lit(2), F.length(v) - 2), F.lit("''"), F.lit("'"))).otherwise(v)


def _bullets(lines: Column) -> Column:
    items = F.transform(F.filter(F.transform(lines, trim_space), lambda x: F.startswith(x, F.lit("- "))), lambda x: trim_space(F.substring(x, 3, 1 << 30)))
    return F.filter(items, lambda x: x != "")


def parse_cards(files: DataFrame) -> DataFrame:
    """files (path, value) to cards: the known keys, updated, summary, read_more, facts, extra_front (other
    front-matter lines, as they are) and extra_body (other sections). index.md and files that aren't cards
    are left out; a card without a name has its file's. Front matter is flat: nested values stay in
    extra_front with their key."""
    text = F.regexp_replace("value", "\r\n", "\n")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    rows = files.filter(~F.col("path").rlike(r"(^|/)index\.md$")).withColumn("file", stem).withColumn("text", text).filter(F.startswith("text", F.lit("---\n")))
    rest = F.substring("text", 5, 1 << 30)
    end = F.instr(rest, "\n---\n")
    front = F.when(F.startswith(rest, F.lit("---\n")), "").when(end > 0, F.substr(rest, F.lit(1), end)).when(rest.endswith("\n---"), F.substr(rest, F.lit(1), F.length(rest) - 3))
    body = F.when(F.startswith(rest, F.lit("---\n")), F.substring(rest, 5, 1 << 30)).when(end > 0, F.substr(rest, end + 5)).otherwise("")
    rows = rows.select(F.col("path").alias("card_file"), "file", front.alias("front"), body.alias("body")).filter(F.col("front").isNotNull())
    # a block is a key's line with the indented, listed or blank lines that follow it
    blocks = F.filter(F.split("front", r"\n(?=[^\s#-])", -1), lambda b: trim_space(b) != "")
    rows = rows.withColumn("blocks", blocks).filter(~F.exists("blocks", lambda b: ~b.rlike(r"(?s)\A(#[^\n]*\n)*[^\s:#][^\n:]*:(\s|\z).*")))

    def is_known(b: Column) -> Column:
        key = F.regexp_extract(b, r"\A([^:\n]+):", 1)
        value = trim_space(F.regexp_extract(b, r"(?s)\A[^:\n]+:(.*)\z", 1))
        flat = ~F.contains(value, F.lit("\n")) & ~value.rlike(r"^[\[{|>&*!]")
        return flat & (key.isin(*KEYS) | ((key == "updated") & rfc3339(_plain(value)).isNotNull()))

    def known(key: str) -> Column:
        own = F.filter("blocks", lambda b: is_known(b) & F.startswith(b, F.lit(f"{key}:")))
        return F.coalesce(_plain(F.regexp_extract(F.try_element_at(own, F.lit(-1)), r"(?s)\A[^:\n]+:(.*)\z", 1)), F.lit(""))

    sections = F.split(F.concat(F.lit("\n"), F.col("body")), r"\n(?=## )", -1)
    rows = rows.withColumn("sections", sections)
    heading = lambda s: trim_space(F.substring(F.substring_index(s, "\n", 1), 4, 1 << 30))
    # the first section is what stands before the first heading
    titled = F.filter("sections", lambda s, i: i > 0)
    bullets = lambda title: F.coalesce(_bullets(F.split(F.try_element_at(F.filter(titled, lambda s: heading(s) == title), F.lit(-1)), "\n")), F.array().cast("array<string>"))
    others = F.transform(F.filter(titled, lambda s: ~heading(s).isin("Read more", "Facts")), lambda s: F.regexp_replace(s, "\n+$", ""))
    cols = {k: known(k) for k in KEYS}
    out = rows.select(
        "card_file", F.coalesce(F.nullif(cols["name"], F.lit("")), F.col("file")).alias("name"), *[cols[k].alias(k) for k in KEYS if k != "name"], rfc3339(known("updated")).alias("updated"),
        trim_space(F.get("sections", 0)).alias("summary"), bullets("Read more").alias("read_more"), bullets("Facts").alias("facts"),
        F.array_join(F.transform(F.filter("blocks", lambda b: ~is_known(b)), lambda b: F.regexp_replace(b, "\n+$", "")), "\n").alias("extra_front"), F.array_join(others, "\n\n").alias("extra_body"),
    )
    return out


def _scalar(v: Column) -> Column:
    """A scalar as front matter: quoted where it would read as something else."""
    odd = v.rlike(r"""^[\s\[\]{}>|*&!%#`@,?:'"-]|: |:$| #|^\s|\s$|[\n\t\\]""") | F.lower(v).isin("true", "false", "null", "yes", "no", "on", "off", "~") | v.rlike(r"^[+-]?[0-9.][0-9._eE+-]*$")
    return F.when(odd, F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(v)


def marshal() -> Column:
    """The card's file, from its columns; empty fields and sections are left out."""
    lines = [F.when(F.col(k) != "", F.concat(F.lit(f"{k}: "), _scalar(F.col(k)), F.lit("\n"))) for k in KEYS if k != "updated_by"]
    lines.append(F.when(F.col("updated").isNotNull(), F.concat(F.lit('updated: "'), F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"\n'))))
    lines.append(F.when(F.col("updated_by") != "", F.concat(F.lit("updated_by: "), _scalar(F.col("updated_by")), F.lit("\n"))))
    lines.append(F.when(F.col("extra_front") != "", F.concat("extra_front", F.lit("\n"))))
    section = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n## {title}\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")))
    extra = F.when(F.col("extra_body") != "", F.concat(F.lit("\n"), F.col("extra_body"), F.lit("\n")))
    summary = F.when(F.col("summary") != "", F.concat("summary", F.lit("\n")))
    return F.concat_ws("", F.lit("---\n"), *lines, F.lit("---\n"), summary, section("Read more", F.col("read_more")), section("Facts", F.col("facts")), extra)


def clean(s: Column) -> Column:
    """Text from an agent: secrets masked, on one line, without leading #."""
    return inline(redact(s))


def patched_facts(facts: Column, remove: Column, add: Column) -> Column:
    """facts without the (1-based) positions to remove, then those to add."""
    kept = F.filter(facts, lambda x, i: ~F.array_contains(remove, i + 1))
    return F.concat(kept, F.filter(F.transform(add, clean), lambda x: x != ""))


def apply_patches(cards: DataFrame, patches: DataFrame) -> DataFrame:
    """cards with patches (name, summary, stack, status, read_more, facts_remove, facts_add; null: unchanged)
    applied all or nothing: error says which limit a patch broke, and its card is unchanged then."""
    p = patches.select(*[F.col(c).alias(f"_{c}") for c in patches.columns])
    rows = cards.join(p, F.col("name") == F.col("_name"), "left")
    empty = F.array().cast("array<string>")
    remove, add = F.coalesce("_facts_remove", F.array().cast("array<int>")), F.coalesce("_facts_add", empty)
    new = {k: F.coalesce(clean(F.col(f"_{k}")), F.col(k)) for k in ("summary", "stack", "status")}
    new["read_more"] = F.coalesce(F.filter(F.transform("_read_more", clean), lambda x: x != ""), F.col("read_more"))
    new["facts"] = patched_facts(F.col("facts"), remove, add)
    bad = F.filter(remove, lambda i: (i < 1) | (i > F.size("facts")))
    too_long = lambda items, n: F.exists(items, lambda x: F.length(x) > n)
    error = (
        F.when(F.col("_name").isNull(), F.lit(None)).when(F.size(bad) > 0, F.concat(F.lit("facts_remove: no fact "), F.get(bad, 0).cast("string")))
        .when(F.length(new["summary"]) > MAX_SUMMARY, "summary").when(F.length(new["stack"]) > MAX_STACK, "stack").when(F.length(new["status"]) > MAX_STATUS, "status")
        .when((F.size(new["read_more"]) > MAX_READ_MORE) | too_long(new["read_more"], MAX_READ_MORE_CHARS), "read_more")
        .when((F.size(new["facts"]) > MAX_FACTS) | too_long(new["facts"], MAX_FACT_CHARS), "facts")
    )
    rows = rows.withColumn("error", error)
    take = F.col("_name").isNotNull() & F.col("error").isNull()
    out = rows.select(*[F.when(take, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in cards.columns], "error")
    return out
