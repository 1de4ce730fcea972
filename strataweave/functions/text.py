"""String functions: column in, column out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Unicode calls white space, as a Java character class body.
SPACE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"a-zA-Z0-9_\p{L}\p{N}"
# The same white space as characters, and without the plain space as a class body.
BLANKS = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
NO_SPACE = SPACE.replace(r"\x{1C}-\x{20}", r"\x{1C}-\x{1F}")
# White space that is not one plain space already.
RUN = rf"[{NO_SPACE}][{SPACE}]*| [{SPACE}]+"
# What ends a line.
LINE_END = r"\r\n|[\n\x{B}\x{C}\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
# Stop words of the comparison form.
STOP_WORDS = ("der", "die", "das", "und", "oder", "in", "zu", "von", "mit", "für")
# Words whose presence anywhere in a text counts for a language.
GERMAN = ("der", "die", "das", "und", "oder", "mit", "für", "von", "zu", "in", "auf", "an", "bei", "durch", "über", "unter", "nach", "vor", "zwischen", "ä", "ö", "ü", "ß", "straße", "platz", "stadt", "gemeinde")
ENGLISH = ("the", "and", "or", "with", "for", "of", "to", "in", "on", "at", "by", "through", "over", "under", "after", "before", "between", "street", "place", "city", "community")
# Beginnings of headings.
HEADING_WORDS = ("Kapitel", "Abschnitt", "Teil", "Artikel", "Paragraph", "Handlungsfeld", "Maßnahme", "Projekt", "Ziel", "Indikator", "Anhang", "Anlage", "Übersicht", "Zusammenfassung")
# Terms that mark an English name, and beginnings of temporary ids.
ENGLISH_TERMS = ("current", "future", "enhanced", "new findings", "overview", "summary", "background", "framework", "implementation", "assessment", "review")
TEMPORARY = ("temp", "placeholder", "new", "created", "temporary", "tmp")
NULL_MARKER = "Information im Quelldokument nicht verfügbar"
# Names by pattern, first match wins; None keeps the name.
NAME_RULES = (
    (r"^Klimaschutz$", "Klimaschutz und Klimaanpassung"),
    (r"^Klimaanpassung$", "Klimaschutz und Klimaanpassung"),
    (r"^Klima(schutz)?\s+(und|&)?\s*(Klimaanpassung|Anpassung)?$", "Klimaschutz und Klimaanpassung"),
    (r"^Siedlungsentwicklung$", "Siedlungs- und Quartiersentwicklung"),
    (r"^Quartiersentwicklung$", "Siedlungs- und Quartiersentwicklung"),
    (r"^Freizeit-?\s*und\s*Erholungsachse$", "Freizeit- und Erholungsachse"),
    (r"^Freizeit-?\s*und\s*Kulturachse$", "Freizeit- und Erholungsachse"),
    (r"^(Mobilität|Verkehr)$", None),
    (r"^Mobilität\s+und\s+Verkehr$", "Mobilität und Verkehr"),
    (r"^Verkehr\s+und\s+Mobilität$", "Mobilität und Verkehr"),
    (r"^Wirtschaft(\s+und\s+|\s*&\s*)Wissenschaft$", "Wirtschaft und Wissenschaft"),
    (r"^Wissenschaft(\s+und\s+|\s*&\s*)Wirtschaft$", "Wirtschaft und Wissenschaft"),
    (r"^Energie$", None),
    (r"^Erneuerbare\s+Energien?$", "Energie"),
)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, RUN, " "))


def lines(c: Column) -> Column:
    """Lines as `splitlines` has them: no empty last line."""
    return F.filter(F.split(c, r"\R"), lambda x, i: (x != "") | (i < F.size(F.split(c, r"\R")) - 1))


def estimate_tokens(c: Column) -> Column:
    """A token for each 3.5 characters."""
    return F.coalesce(F.floor(F.length(c) / F.lit(3.5)), F.lit(0)).cast("bigint")


def compare_form(c: Column) -> Column:
    """Lower case, no punctuation, no stop words, single spaces; duplicates of words stay."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(squeeze(F.lower(c)), rf"[^{WORD} ]+", ""), " {2,}", " "))
    return F.ltrim(F.regexp_replace(bare, rf"(?:^| )(?:{'|'.join(STOP_WORDS)})(?= |\z)", ""))


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def page_line(c: Column) -> Column:
    """A line without short numbers, for comparison between pages."""
    return squeeze(F.regexp_replace(c, r"(?U)(?=\d)\b\d{1,4}\b", ""))


def is_heading(c: Column) -> Column:
    """Numbered, lettered, keyword, all-capital and mostly capitalised lines, and short ones that end in a colon."""
    return is_bare_heading(strip(c))


def is_bare_heading(x: Column) -> Column:
    """As `is_heading`, for lines without white space at their ends."""
    words = F.regexp_count(x, F.lit(rf"[{SPACE}]+")) + 1
    capital = F.regexp_count(x, F.lit(rf"(?=\p{{Lu}})(?<![^{SPACE}])\p{{Lu}}"))
    numbered = x.rlike(r"^(\d+(\.\d+)*\.?|[IVXLCDM]+\.|[A-Za-z]\))\s+")
    keyword = reduce(lambda a, b: a | b, (x.startswith(k) for k in HEADING_WORDS))
    upper = (F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) > 3)
    titled = (capital >= 2) & (words >= 2) & (capital / words > 0.7)
    return (F.length(x) >= 3) & (numbered | keyword | upper | titled | (x.endswith(":") & (F.length(x) < 100)))


def is_temporary_id(c: Column) -> Column:
    return F.lower(c).rlike(f"^({'|'.join(TEMPORARY)})_")


def is_english_name(c: Column) -> Column:
    return c.rlike(rf"(?iU)\b({'|'.join(ENGLISH_TERMS)})\b")


def canonical_name(c: Column) -> Column:
    """The name that the first matching rule gives; other names stay."""
    out = c
    for pattern, name in reversed(NAME_RULES):
        out = F.when(c.rlike(f"(?iu){pattern}"), F.lit(name) if name else c).otherwise(out)
    return out


def registry_form(c: Column) -> Column:
    """Lower case, ' und ' as ' & ', single spaces, no other punctuation."""
    x = F.replace(squeeze(F.lower(c)), F.lit(" und "), F.lit(" & "))
    return squeeze(F.regexp_replace(x, rf"[^{WORD}{SPACE}&]", ""))


def quote_form(c: Column) -> Column:
    """A quote for matching: single spaces, plain letters for umlauts, lower case."""
    x = F.regexp_replace(F.regexp_replace(c, RUN, " "), rf"[^{WORD} .,;:!?()\-]", " ")
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.lower(F.trim(x))


def language_hits(c: Column, words: tuple[str, ...]) -> Column:
    """How many of the words are somewhere in the text, as substrings."""
    x = F.lower(c)
    return reduce(lambda a, b: a + b, (F.contains(x, F.lit(w)).cast("int") for w in words))


def guess_language(c: Column) -> Column:
    """de or en by more hits; null on a tie."""
    de, en = language_hits(c, GERMAN), language_hits(c, ENGLISH)
    return F.when(de > en, "de").when(en > de, "en")


def clean(c: Column) -> Column:
    """Page text: bullets, page numbers, footnotes, hyphenation, lists, broken lines and spaces put right, in this order."""
    steps = (
        (r"(?m)^(\s*)[•*\-⯀Û]\s*", "$1• "),
        (r"(?dm)^(Seite|Page|S\.|Blatt)\s*\d+(\s+(von|of|/)\s*\d+)?\s*$", ""),
        (r"(?dm)^\s*\d{1,4}\s*$", ""),
        (r"(?dm)^\d+\)\s*https?://.*$", ""),
        (rf"([{WORD}])-\n([{WORD}]+)", "$1$2"),
        (rf"(?=[ABGKNOU])(Beratz|Ober|Unter|Bad|Neu|Alt|Klein|Groß)-\s+([{WORD}]+)", "$1$2"),
        (r"(?dm)^(\d{1,2})\s+([A-Z])", "• $1 $2"),
        (r"\n(?<![.!?]\n)(?![A-ZÄÖÜ•*\d-])", " "),
        (r"\n{3,}", "\n\n"),
        (r"\t[ \t]*| [ \t]+", " "),
        (r"(?dm)^\s+", ""),
    )
    x = reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, c)
    kept = F.transform(F.split(x, r"\R"), lambda line: F.replace(F.replace(strip(line), F.lit(",,"), F.lit("„")), F.lit("''"), F.lit('"')))
    joined = F.array_join(F.filter(kept, lambda line: line != ""), "\n")
    return strip(F.regexp_replace(joined, r"\n{3,}", "\n\n"))


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, max(most - 3, 0)), F.lit("..."))).otherwise(c)


def file_size(c: Column) -> Column:
    """Bytes in the largest unit that keeps the number at 1 or more."""
    out = F.format_string("%.1f GB", c / float(1 << 30))
    for limit, unit, size in ((1 << 30, "MB", 1 << 20), (1 << 20, "KB", 1 << 10)):
        out = F.when(c < limit, F.format_string(f"%.1f {unit}", c / float(size))).otherwise(out)
    return F.when(c < 1024, F.format_string("%d B", c.cast("bigint"))).otherwise(out)


def duration(seconds: Column) -> Column:
    return (
        F.when(seconds < 1, F.format_string("%.0fms", seconds * 1000))
        .when(seconds < 60, F.format_string("%.1fs", seconds))
        .otherwise(F.format_string("%dm %.1fs", F.floor(seconds / 60).cast("bigint"), seconds - F.floor(seconds / 60) * 60))
    )


def repair_json(c: Column) -> Column:
    """The JSON part of a model's answer: without thinking text and code fences."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?s)^.*?</think>", ""), r"(?s)^\s*```(?:json)?\s*|\s*```\s*\z", ""))


def ocr_line_kept(line: Column, least: float = 0.3) -> Column:
    """Whether a line of recognised text has enough letters; language and spelling checks can be added by the caller."""
    return (F.length(line) > 0) & (F.length(F.regexp_replace(line, "[^A-Za-z]", "")) >= least * F.length(line))


def flat_columns(df, separator: str = "."):
    """A table whose nested structs are columns of their own, named by their path."""
    from pyspark.sql.types import StructType

    def walk(schema: StructType, path: tuple[str, ...]):
        for f in schema.fields:
            if isinstance(f.dataType, StructType):
                yield from walk(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    quoted = lambda p: ".".join(f"`{x}`" for x in p)
    return df.select(*(F.col(quoted(p)).alias(separator.join(p)) for p in walk(df.schema, ())))


def with_pages(content: Column, pages: Column) -> Column:
    """A content map with the attribution 'Seiten a, b' unless it has one."""
    text = F.concat(F.lit("Seiten "), F.array_join(F.transform(F.array_sort(F.array_distinct(pages)), lambda p: p.cast("string")), ", "))
    return F.when(F.map_contains_key(content, F.lit("page_attribution")), content).otherwise(F.map_concat(content, F.create_map(F.lit("page_attribution"), text)))
