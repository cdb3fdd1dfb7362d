"""Code includes: a directive line of a page becomes lines of a code file.

Two forms: ``{* path options *}`` on a line of its own becomes a fenced block of the file, whole or in 1-based ranges; ``{!> path !}`` becomes the file's lines, each
with the directive's indent, as it stands within a fence already. Paths are relative to a base folder. Everything is told apart by cutting at signs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.links import DIGITS, cut, only, without_end
from quillon.functions.numbers import let

# The folder that paths start from, and the lines that stand for what is left out.
BASE = "docs/en"
ABOVE, HERE, BELOW = "# Code above omitted 👆", "# Code here omitted 👈", "# Code below omitted 👇"
HIGHLIGHT = ' hl_lines="'
OPTIONS = ["ln", "hl", "title"]
NO_LINES = "array<string>"


def folded_path(path: Column, base: str) -> Column:
    """A path relative to ``base`` as one from the root; null if it leads out of the root."""
    steps = F.split(F.concat(F.lit(base + "/"), path), "/")
    start = F.struct(F.array().cast(NO_LINES).alias("stack"), F.startswith(path, F.lit("/")).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        stack, n = acc["stack"], F.size(acc["stack"])
        up = s == ".."
        moved = F.when(up, F.slice(stack, F.lit(1), F.greatest(n - 1, F.lit(0)))).when(s.isin("", "."), stack).otherwise(F.concat(stack, F.array(s)))
        return F.struct(moved.alias("stack"), (acc["out"] | (up & (n == 0))).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: F.when(~acc["out"], F.array_join(acc["stack"], "/")))


def directives(lines: DataFrame, base: str = BASE) -> DataFrame:
    """``lines`` with form (fenced, plain, look_alike, null), indent, options (name, value) and file (null: outside the root)."""
    line, bare = F.col("line"), F.trim(F.translate("line", "\t", " "))
    fenced = line.startswith("{*") & line.endswith("*}") & (F.length("line") > 4)
    inner = F.trim(without_end(cut(line, 2), 2))
    plain = bare.startswith("{!") & bare.endswith("!}") & (F.length(bare) > 4)
    named = F.trim(F.ltrim(without_end(cut(bare, 2), 2), F.lit(">")))
    plain = plain & (named != "") & ~named.contains("!")
    alike = bare.startswith("{!") | bare.startswith("{* ")
    form = F.when(fenced & (inner != ""), "fenced").when(plain, "plain").when(alike, "look_alike")
    rows = lines.withColumn("form", form)
    path = F.when(F.col("form") == "fenced", F.substring_index(inner, " ", 1)).when(F.col("form") == "plain", named)
    pieces = F.split(cut(inner, F.length(F.substring_index(inner, " ", 1))), "]")
    options = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(F.substring_index(F.trim(F.substring_index(p, "[", 1)), " ", -1).alias("name"), F.substring_index(p, "[", -1).alias("value")))
    rows = rows.withColumn("path", path).withColumn("options", F.when(F.col("form") == "fenced", options))
    indent = F.substring("line", F.lit(1), F.length("line") - F.length(F.ltrim(F.translate("line", "\t", " "))))
    return rows.withColumn("indent", indent).withColumn("file", F.when(F.col("path").isNotNull(), folded_path(F.col("path"), base)))


def plain_line(line: Column) -> Column:
    """A line of the page without what only highlights code on a fence."""
    bare = F.ltrim(line)
    fence = (bare.startswith("```") | bare.startswith("~~~")) & (F.length(line) - F.length(bare) < 4) & line.contains(HIGHLIGHT)
    head = F.substring_index(line, HIGHLIGHT, 1)
    rest = cut(line, F.length(head) + len(HIGHLIGHT))
    return F.when(fence & rest.contains('"'), F.concat(F.rtrim(head), cut(rest, F.length(F.substring_index(rest, '"', 1)) + 1))).otherwise(line)


def ranges_of(options: Column) -> Column:
    """The (a, b) ranges of all ``ln`` options in order; null parts are no numbers."""
    values = F.transform(F.filter(options, lambda o: o["name"] == "ln"), lambda o: F.split(o["value"], ","))

    def number(text: Column) -> Column:
        return F.when(only(F.trim(text), DIGITS), F.trim(text).cast("int"))

    def both(part: Column) -> Column:
        last = F.when(part.contains(":") & (F.trim(F.substring_index(part, ":", -1)) != ""), F.substring_index(part, ":", -1)).otherwise(F.substring_index(part, ":", 1))
        return F.struct(number(F.substring_index(part, ":", 1)).alias("a"), number(last).alias("b"))

    return F.array_sort(F.transform(F.flatten(values), both))


def excerpt(lines: Column, ranges: Column) -> Column:
    """The lines of all ranges, with marker lines for what is left out; all lines for no range and for 0:0."""
    n = F.size(lines)

    def piece(r: Column, i: Column) -> Column:
        lead = F.when(i > 0, F.array(F.lit(""), F.lit(HERE), F.lit(""))).when(r["a"] > 1, F.array(F.lit(ABOVE), F.lit(""))).otherwise(F.array().cast(NO_LINES))
        return F.concat(lead, F.slice(lines, r["a"], r["b"] - r["a"] + 1))

    last = F.element_at(ranges, -1)["b"]
    below = F.when(last < n, F.array(F.lit(""), F.lit(BELOW))).otherwise(F.array().cast(NO_LINES))
    whole = (F.size(ranges) == 0) | ((F.size(ranges) == 1) & (last == 0))
    return F.when(whole, lines).otherwise(F.concat(F.flatten(F.transform(ranges, piece)), below))


def in_fence(body: Column, title: Column) -> Column:
    """A fenced block whose fence is longer than any run of backticks in it."""
    runs = F.transform(F.regexp_extract_all(F.array_join(body, "\n"), F.lit("`+"), F.lit(0)), F.length)
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    info = F.when(title.isNotNull(), F.concat(F.lit('python title="'), title, F.lit('"'))).otherwise("python")
    return let(fence, lambda f: F.concat(F.array(F.concat(f, info)), body, F.array(f)))


def resolve_includes(lines: DataFrame, code_files: DataFrame, base: str = BASE) -> tuple[DataFrame, DataFrame]:
    """(lines, problems): lines (source_path, line_no, sub_no, line) with all directives resolved, and (source_path, line_no, rule) of those that are not.

    lines: source_path, line_no, line; code_files: path from the root, text. Included lines are not looked through for directives.
    """
    rows = directives(lines, base)
    files = code_files.select(F.col("path").alias("file"), F.split(F.regexp_replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), r"\n\z", ""), "\n").alias("ls"))
    asked = rows.where("form in ('fenced', 'plain')").join(files, "file", "left").withColumn("ranges", F.coalesce(ranges_of(F.col("options")), F.array().cast("array<struct<a:int,b:int>>")))
    title = F.element_at(F.filter("options", lambda o: o["name"] == "title"), -1)["value"]
    title = F.when(F.size(F.filter("options", lambda o: o["name"] == "title")) > 0, title)
    unquoted = title.isNotNull() & ~(title.startswith('"') & title.endswith('"') & (F.length(title) > 1))
    n = F.size("ls")
    nothing = (F.size("ranges") == 1) & (F.get("ranges", F.lit(0))["a"] == 0) & (F.get("ranges", F.lit(0))["b"] == 0)
    bad = F.exists("ranges", lambda r: r["a"].isNull() | r["b"].isNull() | ~nothing & ((r["a"] < 1) | (r["b"] < r["a"]) | (r["b"] > n)))
    rule = (
        F.when(F.exists("options", lambda o: ~o["name"].isin(OPTIONS)), "unknown_option").when(unquoted, "bad_title").when(F.col("file").isNull(), "outside_root")
        .when(F.col("ls").isNull(), "missing_file").when(bad, "bad_range")
    )
    asked = asked.withColumn("title", F.substring(title, F.lit(2), F.length(title) - 2)).withColumn("rule", rule)
    indented = F.transform("ls", lambda x: F.when(x == "", x).otherwise(F.concat("indent", x)))
    good = asked.where("rule is null").withColumn("body", F.when(F.col("form") == "plain", indented).otherwise(excerpt(F.col("ls"), F.col("ranges"))))
    body = F.when(F.col("form") == "plain", F.col("body")).otherwise(in_fence(F.col("body"), F.col("title")))
    new = good.select("source_path", "line_no", F.posexplode(body).alias("sub_no", "line"))
    kept = rows.where("form is null").select("source_path", "line_no", F.lit(0).alias("sub_no"), plain_line(F.col("line")).alias("line"))
    alike = rows.where("form = 'look_alike'").select("source_path", "line_no", F.col("form").alias("rule"))
    return kept.unionByName(new), alike.unionByName(asked.where("rule is not null").select("source_path", "line_no", "rule"))
