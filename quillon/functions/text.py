"""Text expressions. All are built-in Spark functions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The analyzer's stop words; two suffix rules (endings, pattern, replacement), applied in order; after them, one letter of these doubled at the end goes.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "which", "with"]
SUFFIXES = [(["ies"], "([a-z]{2})ies$", "$1y"), (["ing", "ed", "s"], "([a-z]{3})(?:ing|ed|es|s)$", "$1")]
DOUBLED = list("bdgmnprt")
SPACES = " \t\n\x0b\f\r"
# Control characters that no text holds, as admission and cleaning let none in.
SWITCH, GUARD = "\x01", "\x04"
# Abbreviations, with the guard sign behind their stops.
ABBREVIATIONS = [(r"(?i)\b(e\.)(g\.)", f"$1{GUARD}$2{GUARD}"), (r"(?i)\b(i\.)(e\.)", f"$1{GUARD}$2{GUARD}"), (r"(?i)\b(vs\.|cf\.)", f"$1{GUARD}")]
SENTENCE_GAP = r"(?<=[.!?][\"')\]*_]{0,3})\s+"


def analyze(text: Column) -> Column:
    """Index terms of a text, with repeats: lower case, runs of letters and digits, no stop words, suffixes cut."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(STOP_WORDS))

    def ends(word: Column, endings: list[str]) -> Column:
        return reduce(or_, (word.endswith(e) for e in endings))

    def cut(words: Column, endings: list[str], pattern: str, replacement: str) -> Column:
        # Patterns are slow, so a rule's pattern is run on the words with its endings only.
        return F.transform(words, lambda w: F.when(ends(w, endings), F.regexp_replace(w, pattern, replacement)).otherwise(w))

    for rule in SUFFIXES:
        kept = cut(kept, *rule)
    return F.transform(kept, lambda w: F.when(ends(w, [2 * x for x in DOUBLED]), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def token_count(text: Column) -> Column:
    """The default counter: one word is one token."""
    return F.regexp_count(text, F.lit(r"\S+"))


def nfkc(text: Column) -> Column:
    """NFKC form; texts of ASCII characters only are left alone."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), composed).otherwise(text)


def normalize_question(text: Column) -> Column:
    """NFKC, lower case, single spaces, no punctuation at the end."""
    folded = F.trim(F.regexp_replace(F.lower(nfkc(text)), r"[\s\p{Z}]+", " "))
    return F.regexp_replace(folded, r"[ .,;:!?…。]+$", "")


def question_hash(text: Column) -> Column:
    return F.sha2(normalize_question(text), 256)


def pseudonym(text: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex: two nested digests with the key pads made here."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    outer, inner = (bytes(b ^ pad for b in block) for pad in (0x5C, 0x36))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(text, "utf-8")), 256))), 256)


def seeded_rank(seed: int, purpose: str | Column, key: Column) -> Column:
    """A hash order that anyone with the seed can repeat."""
    return F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), F.lit(purpose), key), 256)


def pseudo_score(text: Column) -> Column:
    """A number in [0, 1) from 13 hex digits of a digest."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def snippet(text: Column, limit: int = 300) -> Column:
    """The first ``limit`` characters, cut back to the last white space unless the cut falls between words."""
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    cut = F.substring(whole, 1, limit)
    inside = F.substring(whole, limit + 1, 1).rlike(r"\S")
    back = F.regexp_replace(cut, r"(?s)^(.+)[ \n\t][^ \n\t]*$", "$1")
    return F.when(F.length(whole) <= limit, whole).otherwise(F.regexp_replace(F.when(inside, back).otherwise(cut), r"\s+$", ""))


def content_words(text: Column) -> Column:
    """Distinct lower-case words of three letters or more that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(STOP_WORDS)))


def overlap(words: Column, others: Column) -> Column:
    """Share of ``words`` that are among ``others``; null for no words."""
    return F.try_divide(F.size(F.array_intersect(words, others)), F.size(words))


def code_parts(line: Column) -> Column:
    """The stretches of a text in turn: text, code span, text, ... A span runs from some backticks to the next run of as many."""
    runs, gaps = F.regexp_extract_all(line, F.lit("`+"), F.lit(0)), F.split(line, "`+", -1)
    sizes = F.transform(runs, F.length)
    start = F.struct(F.lit(-1).alias("closer"), F.get(gaps, F.lit(0)).alias("out"))

    def step(acc: Column, i: Column) -> Column:
        ahead = F.array_position(F.slice(sizes, i + 2, F.size(sizes)), F.get(sizes, i)).cast("int")
        opens = (acc["closer"] < i) & (ahead > 0)
        before, after = F.when(opens, SWITCH).otherwise(""), F.when(acc["closer"] == i, SWITCH).otherwise("")
        return F.struct(F.when(opens, i + ahead).otherwise(acc["closer"]).alias("closer"), F.concat(acc["out"], before, F.get(runs, i), after, F.get(gaps, i + 1)).alias("out"))

    marked = F.aggregate(F.sequence(F.lit(0), F.size(runs) - 1), start, step, lambda acc: acc["out"])
    return F.when(line.contains("`"), F.split(marked, SWITCH, -1)).otherwise(F.array(line))


def sentences(text: Column) -> Column:
    """Sentences end at . ! or ? (closing quotes, brackets and emphasis included) before white space; not inside code spans or after abbreviations."""

    def guarded(part: Column, i: Column) -> Column:
        # inside code and abbreviations every end mark gets a guard sign, which keeps the split away from it
        kept = part
        for pattern, replacement in ABBREVIATIONS:
            kept = F.regexp_replace(kept, pattern, replacement)
        return F.when(i % 2 == 1, F.regexp_replace(part, "([.!?])", "$1" + GUARD)).otherwise(kept)

    parts = F.split(F.array_join(F.transform(code_parts(text), guarded), ""), SENTENCE_GAP)
    clean = F.transform(parts, lambda p: F.trim(F.replace(p, F.lit(GUARD), F.lit(""))))
    return F.filter(clean, lambda p: p != "")


def escape_content(text: Column) -> Column:
    """Angle brackets that open or close an element of the name ``source``, in any case and spacing, become entities."""

    def after(piece: Column) -> Column:
        lead = F.ltrim(F.left(piece, F.lit(64)), F.lit(SPACES))
        lead = F.ltrim(F.when(lead.startswith("/"), F.substring(lead, 2, 64)).otherwise(lead), F.lit(SPACES))
        return F.concat(F.when(F.lower(lead).startswith("source"), "&lt;").otherwise("<"), piece)

    pieces = F.split(text, "<", -1)
    rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), after)
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))


def escape_attribute(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))


def normalize_label(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.upper(F.translate(text, "-", " ")), r"\s+", " ")), " ", "_")


def slug(text: Column) -> Column:
    """Lower-case ASCII letters, digits and hyphens; accented Latin letters are folded, other signs dropped."""
    folded = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.trim(F.regexp_replace(folded, r"[^a-z0-9\s_-]", "")), r"[\s-]+", "-")
