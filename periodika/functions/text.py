"""Text and date functions of the archive, as column expressions.

Patterns follow the regex rules of the JVM with ``(?U)`` where Unicode classes matter. ``norm`` is the one normal form of texts and of
what is looked for in them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bare(c: str) -> str:
    """The compatibility decomposition without its combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()


def _ranges(codes: list[int]) -> str:
    """A regular expression's class of these characters."""
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in out) + "]"


# Every sign of the basic plane whose bare form is one other sign, whatever its script. Hangul syllables stay whole: their parts are letters, not marks.
_PLANE = [c for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4]
_PAIRS = [(chr(c), d) for c in _PLANE if len(d := _bare(chr(c))) == 1 and d != chr(c)]
ACCENTED, BARE = "".join(c for c, _ in _PAIRS), "".join(d for _, d in _PAIRS)
_TABLE = dict(zip(map(ord, ACCENTED), BARE, strict=True))
#: Marks left over from decomposed text.
_COMBINING = _ranges([c for c in _PLANE if unicodedata.combining(chr(c))])
# The class is a long chain of ranges to the JVM: what can't be a mark (nor a sign that the JVM's tables don't know yet) is told by one look before it.
_MARKS = r"(?=[^\x00-\u02FF])(?=[\p{M}\p{Cn}])" + _COMBINING
# Ligatures, sharp s and the final sigma: fixed values.
_SPELT = [("ß", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ς", "σ")]


def norm(c: Column) -> Column:
    """Lower case without accents and marks, in any script; ligatures and sharp s are spelt out. ``norm_text`` is the same in Python.

    A text with as many bytes as signs is in ASCII, to which the rest does nothing. Where ``c`` is costly, bind it.
    """
    out = F.lower(F.translate(c, ACCENTED, BARE))
    for one, many in _SPELT:
        out = F.replace(out, F.lit(one), F.lit(many))
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.regexp_replace(out, _MARKS, ""))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, which is evaluated once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def norm_text(s: str) -> str:
    """``norm`` of one string, by the same tables."""
    out = s.translate(_TABLE).lower()
    for one, many in _SPELT:
        out = out.replace(one, many)
    return re.sub(_COMBINING, "", out)


#: White space of any script, as ``(?U)\\s`` has it.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.trim(c, F.lit(WHITE))


def lines(c: Column) -> Column:
    """Lines, split at every Unicode line end."""
    # one class comes first, which the JVM finds faster than a choice
    return F.split(c, r"[\n\r\x0B\x0C\x1C-\x1E\x85  ](?:(?<=\r)\n)?", -1)


def keyword_pattern(keyword: Column) -> Column:
    """The pattern that finds a keyword in a normalised title, plural forms and wider gaps included; null for a blank keyword."""
    words = F.filter(F.split(norm(keyword), r"(?U)\s+"), lambda w: w != "")
    escaped = F.transform(words, lambda w: F.concat(F.regexp_replace(w, r"([^\p{L}\p{N}_])", r"\\$1"), F.lit("[sx]?")))
    return F.when(F.size(words) > 0, F.concat(F.lit(r"(?U)\b"), F.array_join(escaped, r"\s+"), F.lit(r"\b")))


def tokens(normalised: Column) -> Column:
    """Distinct words of a normalised title, also without a final s or x: what a keyword's first word is looked up in."""
    words = F.regexp_extract_all(normalised, F.lit(r"(?U)(\w+)"), 1)
    bare = F.transform(words, lambda w: F.regexp_replace(w, "[sx]$", ""))
    return F.array_distinct(F.concat(words, bare))


def block(keyword: Column) -> Column:
    """The word by which a keyword is looked up; empty if it has none."""
    return F.regexp_extract(norm(keyword), r"(?U)(\w+)", 1)


# Month names, French and English, without accents.
MONTHS = {
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}
FRENCH = ["Janvier", "Février", "Mars", "Avril", "Mai", "Juin", "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre"]


def month_label(first: Column, second: Column) -> Column:
    name = lambda m: F.element_at(F.array(*map(F.lit, FRENCH)), m)
    return F.when(second.isNull() | (first == second), name(first)).otherwise(F.concat(name(first), F.lit("-"), name(second)))


def issue_metadata(title: Column, collection: Column) -> Column:
    """struct(issue_number, year, month, label, publication_date) read from an issue's title.

    The collection's name is taken off the front. The date is the first that fits of: one or two month names with a year, two
    months and a year in digits (either order), one month and a year (either order), a bare year. The number is the last of
    2 to 4 digits before the date, else the first after it, and never the year.
    """
    name = F.coalesce(collection, F.lit(""))
    starts = (F.length(name) > 0) & F.lower(title).startswith(F.lower(name))
    cut = F.when(starts, F.regexp_replace(F.substring(title, F.length(name) + 1, F.length(title)), r"^[ \-–—:|]+", "")).otherwise(title)
    names, month, year = "|".join(sorted(MONTHS, key=lambda m: (-len(m), m))), "(0[1-9]|1[0-2])", r"((?:19|20)\d{2})"
    # Forms of a date, fixed values: pattern, group of the year, of the first and of the second month
    forms = [
        (rf"(?U)\b({names})(?:[\s-]+({names}))?\s+{year}\b", 3, 1, 2),
        (rf"\b{month}-{month}-{year}\b", 3, 1, 2),
        (rf"\b{year}-{month}-{month}\b", 1, 2, 3),
        (rf"\b{year}-{month}\b", 1, 2, None),
        (rf"\b{month}-{year}\b", 2, 1, None),
        (rf"\b{year}\b", 1, None, None),
    ]
    of_name = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    none = F.lit(None).cast("int")

    def read(rest: Column) -> Column:
        def found_by(pattern: str, y: int, m1: int | None, m2: int | None) -> Column:
            part = lambda i: F.regexp_extract(rest, pattern, i)
            value = lambda i: none if i is None else F.coalesce(F.try_element_at(of_name, part(i)), F.when(part(i) != "", part(i).try_cast("int")))
            return F.struct(F.regexp_instr(rest, F.lit(pattern)).alias("at"), F.length(part(0)).alias("n"), value(y).alias("year"), value(m1).alias("month"), value(m2).alias("second"))

        found = F.lit(None)
        for form in reversed(forms):
            found = F.when(rest.rlike(form[0]), found_by(*form)).otherwise(found)
        found = F.coalesce(found, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), none.alias("year"), none.alias("month"), none.alias("second")))
        digits = F.lit(r"\b(\d{2,4})\b")

        def finish(f: Column) -> Column:
            before = F.when(f["at"] > 0, F.substring(rest, F.lit(1), f["at"] - 1)).otherwise(rest)
            after = F.when(f["at"] > 0, F.substring(rest, f["at"] + f["n"], F.length(rest))).otherwise(F.lit(""))
            no_year = F.coalesce(f["year"].cast("string"), F.lit(""))
            first, then = (F.filter(F.regexp_extract_all(side, digits, 1), lambda t: t != no_year) for side in (before, after))
            issue = F.when(F.size(first) > 0, F.element_at(first, -1)).when(F.size(then) > 0, F.element_at(then, 1))
            return F.struct(
                issue.alias("issue_number"), f["year"].alias("year"), f["month"].alias("month"), F.when(f["month"].isNotNull(), month_label(f["month"], f["second"])).alias("label"),
                F.when(f["year"].isNotNull(), F.make_date(f["year"], F.coalesce(f["month"], F.lit(1)), F.lit(1))).alias("publication_date"),
            )

        return bound(found, finish)

    # the normal form is looked at by every form of a date: made once
    return bound(norm(cut), read)


# What names special issues, in a title or a directory: fixed values.
OUT_OF_SERIES, SPECIAL = r"(?U)\bhors[- ]s[ée]ries?\b|\bhs\b", r"(?U)\bsp[ée]cia(?:l|ux)\b|\bsp\b"


def issue_type(title: Column, directories: Column | None = None) -> Column:
    """hs (special issue out of the series), sp (special) or normal, by the title and the directories below the collection's."""
    n = F.lower(title if directories is None else F.concat_ws(" ", title, F.replace(directories, F.lit("/"), F.lit(" "))))
    return F.when(n.rlike(OUT_OF_SERIES), "hs").when(n.rlike(SPECIAL), "sp").otherwise("normal")


# File names that a layout leaves in titles: fixed values.
LAYOUT_FILE = r"(?Ui)\s*\S*\.(?:indd|pdf|jpe?g|png|tiff?|eps|psd|ai|qxd)\s*$"


def clean_title(c: Column) -> Column:
    """Without a layout file's name at the end; what is left after that is blanked below 15 characters."""
    cut = F.regexp_replace(c, LAYOUT_FILE, "")
    tidy = F.regexp_replace(cut, r"^[ .·…\-–—:]+|[ .·…\-–—:]+$", "")
    return F.when(cut == c, c).when(F.length(tidy) < 15, F.lit("")).otherwise(tidy)


def cover_year(c: Column) -> Column:
    """The first year from 1900 to 2099 printed on a cover."""
    return F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def cover_number(c: Column) -> Column:
    """The issue number that a cover prints after its n° sign."""
    return F.nullif(F.regexp_extract(c, r"(?iu)n[°ºo]\s*[:\s]?\s*(\d{1,4})", 1), F.lit(""))


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("long")


def highlight(c: Column, terms: list[str]) -> Column:
    """HTML-escaped text with every literal match of a term in ``<mark>``, whatever its case."""
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    safe = [t for t in sorted(terms, key=lambda t: (-len(t), t)) if t]
    if not safe:
        return out
    special = set("\\.[]{}()*+?^$|-")
    pattern = "|".join("".join("\\" + x if x in special else x for x in t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")) for t in safe)
    return F.regexp_replace(out, f"(?iu)({pattern})", "<mark>$1</mark>")


def terms(c: Column) -> Column:
    """The words of a text in their normal form: runs of letters and digits of any script."""
    return F.regexp_extract_all(norm(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def plain_terms(q: str) -> list[str]:
    """``terms`` of a query."""
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in norm_text(q)).split()


def snippet(c: Column, terms: str | list[str], width: int = 40) -> Column:
    """About ``width`` words around the first word that holds one of ``terms``, accents and case aside."""
    wanted = [t for one in ([terms] if isinstance(terms, str) else terms) for t in plain_terms(one)]
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")

    def holds(w: Column) -> Column:
        out = F.lit(False)
        for t in wanted:
            out = out | w.contains(F.lit(t))
        return out

    def around(words: Column) -> Column:
        # words have no line ends, so their normal forms are those of the lines of all words in one text
        bare = F.split(bound(F.array_join(words, "\n"), norm), "\n", -1)
        at = F.array_position(F.transform(bare, holds), F.lit(True)).cast("int")
        return F.array_join(F.slice(words, bound(at, lambda x: F.greatest(F.lit(1), x - F.lit(width // 2))), F.lit(width)), " ")

    return bound(words, around)


def occurrence_scale(count: Column, most: Column) -> Column:
    """X10. A count as a share of the greatest one, 0 to 1."""
    return F.when(most > 0, F.least(F.greatest(count / most, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def heading(collection: Column, number: Column, label: Column, year: Column, title: Column) -> Column:
    """``collection - number - Month year``; the title where there is no collection."""
    when_ = F.concat_ws(" ", label, year.cast("string"))
    return F.when(collection.isNull(), title).otherwise(F.concat_ws(" - ", collection, number, F.nullif(when_, F.lit(""))))


def reference(number: Column, label: Column, year: Column, title: Column) -> Column:
    """``Month year · n°N``; the magazine's title where neither is known."""
    when_ = F.nullif(F.concat_ws(" ", label, year.cast("string")), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws(" · ", when_, F.when(number.isNotNull(), F.concat(F.lit("n°"), number))), F.lit("")), title)


def sanitize_error(c: Column, most: int = 300) -> Column:
    """First line, without the directories of absolute paths, cut to ``most`` characters."""
    first = F.element_at(F.split(c, r"\r?\n", -1), 1)
    return F.left(F.regexp_replace(first, r"/(?:[^/\s]+/)+", ""), F.lit(most))


# Lines that say nothing about a failure, and lines that name its cause: fixed values.
NOISE = r"(?i)^\s*\d+\s*\[tesseract\]|^(?:Operand stack:|Execution stack:|Dictionary stack:|Current allocation mode|--\w+[:.]|%\S)"
CAUSE = r"(?i)(?:error|erreur|exception|unrecoverable|syntaxerror)"


def error_summary(c: Column, n: int = 5, noise: str = NOISE, cause: str = CAUSE, empty: str = "(aucune sortie d'erreur)") -> Column:
    """At most n lines of a message: those that name a cause first, then the last others; raw lines if all is noise."""
    raw = F.filter(F.transform(lines(F.coalesce(c, F.lit(""))), strip), lambda x: x != "")
    useful = F.filter(raw, lambda x: ~x.rlike(noise))
    pool = F.when(F.size(useful) > 0, useful).otherwise(raw)
    causes = F.slice(F.filter(pool, lambda x: x.rlike(cause)), 1, n)
    last = F.slice(pool, F.greatest(F.size(pool) - n + 1, F.lit(1)), F.lit(n))
    more = F.array_except(last, causes)
    return F.when(F.size(pool) > 0, F.array_join(F.slice(F.concat(causes, more), 1, n), " | ")).otherwise(F.lit(empty))
