"""Links, definitions, addresses and citation markers in a line of Markdown, told apart by cutting at their signs.

Every function takes one line, or a stretch of it without code, and is built of Spark functions. A text is cut at a sign (a bracket, an angle bracket, the
start of an address) and folded piece by piece; what a piece is follows from its first words and the sign that ends it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.numbers import let

# How addresses begin, what may not stand in them, the marks that end a sentence, the reader's own machine.
SCHEMES = ["https://", "http://"]
STOPS = "<>()[]`\t\r\f"
MARKS = ".,;:!?"
OWN_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0"]
QUOTES = [('"', '"'), ("'", "'"), ("(", ")")]
DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
BULLETS = ["-", "+", "*"]


def only(text: Column, signs: str) -> Column:
    """Whether a text is made of ``signs`` and not empty."""
    return (text != "") & (F.translate(text, signs, "") == "")


def spaced(text: Column) -> Column:
    return F.translate(text, "\t\r\f", "   ")


def cut(text: Column, n: int | Column) -> Column:
    """A text without its first ``n`` characters."""
    return F.substring(text, F.lit(n) + 1, F.length(text))


def without_end(text: Column, n: int) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - n)


def fold_pieces(pieces: Column, step: Callable[[Column, Column], Column]) -> Column:
    """struct(out, n): the first piece, and what ``step`` (which gets such a struct and a piece) makes of all that follow."""
    start = F.struct(F.get(pieces, F.lit(0)).alias("out"), F.lit(0).alias("n"))
    return F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, step)


def result(out: Column, n: Column) -> Column:
    return F.struct(out.alias("out"), n.alias("n"))


# Citation markers


def labels_of(piece: Column) -> Column:
    """The labels of a marker whose opening bracket stands before ``piece``; null if it is none."""
    inside = F.substring_index(piece, "]", 1)
    labels = F.transform(F.split(F.translate(inside, ";", ","), ","), lambda x: F.trim(x))
    fine = F.forall(labels, lambda x: x.startswith("c") & only(cut(x, 1), DIGITS))
    return F.when(piece.contains("]") & (F.trim(inside) == inside) & fine, labels)


def markers(line: Column) -> Column:
    """The labels of each marker of a line, in order."""
    found = F.transform(F.slice(F.split(line, r"\["), F.lit(2), F.size(F.split(line, r"\["))), labels_of)
    return F.filter(found, lambda m: m.isNotNull())


def with_markers(line: Column, shown: Callable[[Column], Column]) -> Column:
    """A line with ``shown`` of its labels in place of every marker."""

    def step(acc: Column, piece: Column) -> Column:
        labels = labels_of(piece)
        after = cut(piece, F.length(F.substring_index(piece, "]", 1)) + 1)
        return result(F.concat(acc["out"], F.when(labels.isNull(), F.concat(F.lit("["), piece)).otherwise(F.concat(shown(labels), after))), acc["n"])

    return fold_pieces(F.split(line, r"\[", -1), step)["out"]


# Addresses


def host(address: Column) -> Column:
    after = F.when(address.contains("://"), F.substring_index(address, "://", -1)).otherwise(address)
    return F.lower(F.substring_index(F.substring_index(F.substring_index(F.translate(after, "?#", "//"), "/", 1), "@", -1), ":", 1))


def without_addresses(text: Column, own: Callable[[Column], Column]) -> Column:
    """struct(out, n): addresses go, with a space before them and angle brackets around them; the marks that end a sentence stay.

    An address of the reader's own machine is not counted; ``own`` of it stays in its place.
    """

    def without_scheme(before: Column) -> Column:
        """What stands before an address, without the scheme of https://www.…, whose two starts were cut apart."""
        lower = F.lower(before)
        ends = [F.when(lower.endswith(scheme), len(scheme)) for scheme in SCHEMES]
        return F.substring(before, F.lit(1), F.length(before) - F.coalesce(*ends, F.lit(0)))

    def placed(before: Column, a: Column, n: Column) -> Column:
        angled = before.endswith("<") & a["rest"].startswith(">")
        inner = F.substring(before, F.lit(1), F.length(before) - angled.cast("int"))
        rest = F.concat(a["marks"], cut(a["rest"], angled.cast("int")))
        left = F.substring(inner, F.lit(1), F.length(inner) - inner.endswith(" ").cast("int"))
        return F.when(a["own"], result(F.concat(inner, own(a["bare"]), rest), n)).otherwise(result(F.concat(left, rest), n + 1))

    def parts(piece: Column, address: Column) -> Column:
        bare = F.rtrim(address, F.lit(MARKS))
        is_own = F.rtrim(host(bare), F.lit(MARKS)).isin(OWN_HOSTS)
        return F.struct(bare.alias("bare"), cut(address, F.length(bare)).alias("marks"), cut(piece, F.length(address)).alias("rest"), is_own.alias("own"), F.lower(address).isin(SCHEMES).alias("alone"))

    def step(acc: Column, piece: Column) -> Column:
        address = F.substring_index(F.translate(piece, STOPS, " " * len(STOPS)), " ", 1)
        found = let(address, lambda x: parts(piece, x))
        as_text = result(F.concat(acc["out"], piece), acc["n"])
        return let(found, lambda a: F.when(a["alone"], as_text).otherwise(let(without_scheme(acc["out"]), lambda before: placed(before, a, acc["n"]))))

    # A sign in front: a cut of no width at the very start would leave no empty piece before it.
    cleaned = fold_pieces(F.split(F.concat(F.lit("|"), text), "(?i)(?=http://|https://|www[.])", -1), step)
    return let(cleaned, lambda c: result(cut(c["out"], 1), c["n"]))


def without_autolinks(text: Column) -> Column:
    """struct(out, n): ``<scheme:…>`` and ``<name@host>`` go, with a space before them."""

    def step(acc: Column, piece: Column) -> Column:
        inside = F.substring_index(piece, ">", 1)
        scheme = F.lower(F.substring_index(inside, ":", 1))
        named = inside.contains(":") & F.length(scheme).between(2, 32) & only(F.left(scheme, F.lit(1)), LETTERS) & only(scheme, LETTERS + DIGITS + "+.-")
        sides = F.split(inside, "@")
        mail = (F.size(sides) == 2) & F.forall(sides, lambda x: x != "")
        auto = piece.contains(">") & ~spaced(inside).contains(" ") & (named | mail)
        left = F.when(acc["out"].endswith(" "), without_end(acc["out"], 1)).otherwise(acc["out"])
        return F.when(auto, result(F.concat(left, cut(piece, F.length(inside) + 1)), acc["n"] + 1)).otherwise(result(F.concat(acc["out"], F.lit("<"), piece), acc["n"]))

    return fold_pieces(F.split(text, "<", -1), step)


# Links


def target(right: Column) -> Column:
    """What stands between a link's opening bracket, before ``right``, and the bracket that closes it; null if none does."""
    lead = F.ltrim(right)
    skip = F.when(lead.startswith("<") & lead.contains(">"), F.length(right) - F.length(lead) + F.length(F.substring_index(lead, ">", 1)) + 1).otherwise(0)
    pieces = F.split(cut(right, skip), r"\)", -1)
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("n"), F.lit(False).alias("closed"))

    def step(acc: Column, piece: Column) -> Column:
        still = acc["open"] + F.length(piece) - F.length(F.replace(piece, F.lit("("), F.lit("")))
        return F.when(acc["closed"], acc).otherwise(F.struct((still - 1).alias("open"), (acc["n"] + 1).alias("n"), (still == 0).alias("closed")))

    closed = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step)
    inside = F.concat(F.substring(right, F.lit(1), skip), F.array_join(F.slice(pieces, F.lit(1), closed["n"]), ")"))
    return F.when(closed["closed"], inside)


def destination_and_rest(text: Column) -> Column:
    """struct(to, rest) of a text of at most a destination and more."""
    trimmed = F.trim(spaced(text))
    angled = trimmed.startswith("<") & trimmed.contains(">")
    to = F.when(angled, F.concat(F.substring_index(trimmed, ">", 1), F.lit(">"))).otherwise(F.substring_index(trimmed, " ", 1))
    return F.struct(to.alias("to"), F.trim(cut(trimmed, F.length(to))).alias("rest"))


def is_target(inside: Column) -> Column:
    """Whether a text is a destination, or one and a quoted title."""

    def fits(both: Column) -> Column:
        quoted = F.lit(False)
        for first, last in QUOTES:
            quoted = quoted | (both["rest"].startswith(first) & both["rest"].endswith(last) & (F.length(both["rest"]) > 1))
        return ((both["rest"] == "") | quoted) & (both["to"].startswith("<") | ~both["to"].contains("<"))

    return let(destination_and_rest(inside), fits)


def unlinked(part: Column) -> Column:
    """struct(out, n): links and images become their texts.

    The part is cut at each ``](``. On its left the bracket that is still open begins the text; on its right the destination ends at
    its bracket. Without an open bracket, or with a destination that is none, only the destination goes.
    """

    def open_bracket(left: Column) -> Column:
        """How many of the pieces between ``[``, from the last back, lie within the open bracket; 0 if none is open."""
        pieces = F.reverse(F.split(left, r"\[", -1))
        start = F.struct(F.lit(0).alias("closed"), F.lit(0).alias("n"), F.lit(False).alias("found"))

        def back(acc: Column, piece: Column) -> Column:
            closed = acc["closed"] + F.length(piece) - F.length(F.replace(piece, F.lit("]"), F.lit("")))
            return F.when(acc["found"], acc).otherwise(F.struct((closed - 1).alias("closed"), (acc["n"] + 1).alias("n"), (closed == 0).alias("found")))

        return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, back, lambda acc: F.when(acc["found"], acc["n"]).otherwise(0))

    def step(acc: Column, right: Column) -> Column:
        sides = F.struct(open_bracket(acc["out"]).alias("n"), target(right).alias("inside"))
        return let(sides, lambda s: joined(acc["out"], right, s["n"], s["inside"], acc["n"] + 1))

    def joined(left: Column, right: Column, n: Column, inside: Column, count: Column) -> Column:
        gone = F.when(inside.isNull(), F.length(right)).otherwise(F.length(inside) + 1)
        pieces = F.split(left, r"\[", -1)
        text = F.array_join(F.slice(pieces, F.size(pieces) - n + 1, n), "[")
        before = F.array_join(F.slice(pieces, F.lit(1), F.size(pieces) - n), "[")
        before = F.substring(before, F.lit(1), F.length(before) - before.endswith("!").cast("int"))
        kept = F.when((n > 0) & inside.isNotNull() & is_target(inside), F.concat(before, let(text, shown))).otherwise(F.concat(left, F.lit("]")))
        return result(F.concat(kept, cut(right, gone)), count)

    def shown(text: Column) -> Column:
        marker = labels_of(F.concat(text, F.lit("]"))).isNotNull()
        return F.when(marker, F.concat(F.lit("["), text, F.lit("]"))).otherwise(without_addresses(text, lambda x: x)["out"])

    return F.when(part.contains("]("), fold_pieces(F.split(part, r"\]\(", -1), step)).otherwise(result(part, F.lit(0)))


# Definitions and what they stand in


def is_container(word: Column) -> Column:
    """Whether a word opens quotes or a list item: quote signs, then nothing, a bullet, or a number of nine digits at most with a dot or bracket."""
    inner = F.ltrim(word, F.lit(">"))
    numbered = F.right(inner, F.lit(1)).isin(".", ")") & only(without_end(inner, 1), DIGITS) & (F.length(inner) <= 10)
    return (inner == "") | inner.isin(BULLETS) | numbered


def container_length(line: Column) -> Column:
    """How many characters of a line open quotes and list items."""
    words = F.split(spaced(line), " ", -1)
    first = F.array_position(F.transform(words, is_container), False)
    body = F.when(first == 0, F.lit("")).otherwise(F.ltrim(F.array_join(F.slice(words, first.cast("int"), F.size(words)), " "), F.lit(">")))
    return F.length(line) - F.length(body)


def is_definition(body: Column) -> Column:
    """``[label]: destination "title"``; the destination may stand on the next line, the title may be missing or open."""
    trimmed = F.ltrim(body)
    label = F.replace(F.replace(cut(F.substring_index(trimmed, "]:", 1), 1), F.lit("\\["), F.lit("x")), F.lit("\\]"), F.lit("x"))
    both = destination_and_rest(cut(trimmed, F.length(F.substring_index(trimmed, "]:", 1)) + 2))
    titled = F.lit(False)
    for first, _ in QUOTES:
        titled = titled | both["rest"].startswith(first)
    named = trimmed.startswith("[") & trimmed.contains("]:") & (label != "") & ~label.contains("[") & ~label.contains("]")
    return named & ((both["rest"] == "") | titled)
