"""Quality rules, line first (native DataFrame expressions only).

Each line is judged by punctuation, navigation and boilerplate rules; failing
lines are removed, and a document that loses too much of its text is rejected.
Base figures and limits of the whole text come first.

The punctuation rule removes a line only if it is short, has no sentence end,
and its paragraph (the lines between blank ones) has none either: wrapped prose
and verse hold theirs on other lines, and a missing end alone is no fault of a
long line.  Sentence ends of all scripts count; scripts that write none (Thai,
Lao) are asked for none.  Blank lines stay where they are.

Edge cases: a null text counts as empty (no words, fails the base); repeated
rows are judged alike, row by row; ids may be null; other columns of the
input are ignored by :func:`judge` and kept by :func:`clean`; an empty table
gives an empty result.  Nothing is shuffled: every figure is an expression
over the row, n log n in its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import WORD, words_of

# Limits of the base figures.
MIN_WORDS = 50
MAX_REPEAT_PCT = 50

#: Limits of the line rules.
MAX_LOST_PCT = 30          # of the characters of lines with a word
NAV_SEPARATORS = 3         # menu separators that make a line navigation
MAX_SYMBOL_PCT = 10        # of a line's characters
MAX_UPPER_PCT = 60         # of a line's cased letters
BOILERPLATE_CHARS = 160    # longer lines are prose that mentions the phrase

SYMBOLS = "[#*$%&|<>]"
SEPARATOR = " [|»•·>] "
#: A line without any of these passes the navigation, symbol and case rules.
SUSPICIOUS = "[#*$%&|<>]| [»•·] |\\p{Lu}[^\\p{Ll}]{0,4}\\p{Lu}"
SHORT_CHARS = 25           # a line of fewer characters needs a sentence end near
# Characters that end sentences, by script (Latin and general,
# CJK, Arabic, Indic, Armenian, Ethiopic, Burmese, Khmer, Mongolian, Tibetan,
# Sinhala), and the letters of scripts that have none (Thai, Lao).
SENTENCE_ENDS = ".!?…‼⁇⁈⁉‽。！？｡．﹒﹖﹗؟۔।॥։።፧፨။៕៖᠃᠉།༎෴"
NO_ENDS = "\\x{0E01}-\\x{0EDF}"
#: A sentence end within a line, and within a paragraph.
SENTENCE = f"[{SENTENCE_ENDS}][\"'”’»)\\]]*([ \\t\\r\\n]|\\z)|[{NO_ENDS}]"
#: Line breaks before a blank line part paragraphs.
PARAGRAPH = "\n(?=[\\x20\\x09\\x0B-\\x0D]*\n)"
BOILERPLATE = (
    "(?i)(javascript|cookie|lorem ipsum|all rights reserved|terms of (use|service)|privacy policy"
    "|sign in|log in|subscribe|click here|read more|share this|skip to content|back to top)"
)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _covered(grams: Column) -> Column:
    """Words covered by the 3-word windows (hashes in text order) that occur
    twice or more.  The repeated hashes come from one primitive sort; their
    places are looked up directly while they are few, else by sorting windows
    with their places.  The steps between places, 3 at most, add up."""

    def repeated(s):
        return F.array_distinct(F.filter(s, lambda g, j: (j > 0) & (F.get(s, j - 1) == g)))

    def few(found):
        hit = F.transform(grams, lambda g, i: F.when(F.array_contains(found, g), i))
        return F.filter(hit, lambda i: i.isNotNull())

    def equal(s, x, j):
        before = (j > 0) & (F.get(s, j - 1)["g"] == x["g"])
        return before | F.coalesce(F.get(s, j + 1)["g"] == x["g"], F.lit(False))

    placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    many = _let(placed, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: equal(s, x, j)), lambda x: x["i"])))
    places = _let(_let(F.sort_array(grams), repeated), lambda f: F.when(F.size(f) <= 24, few(f)).otherwise(many))
    start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"))
    return F.aggregate(places, start, step, lambda a: a["n"].cast("long"))


def line_fails(line: Column, ended: Column) -> Column:
    """True for a line that the punctuation, navigation or boilerplate rules
    remove; ``ended``: its paragraph holds a sentence end."""
    chars = F.char_length(line)
    symbols = chars - F.char_length(F.regexp_replace(line, SYMBOLS + "+", ""))
    upper = chars - F.char_length(F.regexp_replace(line, "\\p{Lu}+", ""))
    lower = chars - F.char_length(F.regexp_replace(line, "\\p{Ll}+", ""))
    navigation = F.regexp_count(line, F.lit(SEPARATOR)) >= NAV_SEPARATORS
    symbolic = symbols * 100 > chars * MAX_SYMBOL_PCT
    shouting = upper * 100 > (upper + lower) * MAX_UPPER_PCT
    # one scan clears most lines of the three rules
    marked = line.rlike(SUSPICIOUS) & (navigation | symbolic | shouting)
    boilerplate = (chars <= BOILERPLATE_CHARS) & line.rlike(BOILERPLATE)
    return (~ended & (chars < SHORT_CHARS)) | boilerplate | marked


def judged_lines(text: Column) -> Column:
    """All lines of a text, in order: ``line``, whether it has a word (``full``)
    and whether it is removed (``bad``; blank lines never are)."""

    def judged(line, ended):
        full = line.rlike(WORD)
        return F.struct(line.alias("line"), full.alias("full"), (full & line_fails(line, ended)).alias("bad"))

    def paragraph(p):
        return _let(p.rlike(SENTENCE), lambda ended: F.transform(F.split(p, "\n"), lambda x: judged(x, ended)))

    return F.flatten(F.transform(F.split(text, PARAGRAPH), paragraph))


_OWN = "__quality_"


def with_figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``__quality_`` holding all figures and verdicts."""
    own = lambda name: F.col(_OWN + name)
    df = docs.withColumn(_OWN + "text", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumns({
        _OWN + "words": words_of(own("text")),
        _OWN + "judged": judged_lines(own("text")),
    })
    n = F.size(own("words"))
    gram = lambda i: F.xxhash64(*(F.get(own("words"), i + d) for d in range(3)))
    df = df.withColumns({
        _OWN + "n": n,
        _OWN + "chars": F.char_length(F.array_join(own("words"), "")),
        _OWN + "grams": F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), gram)),
        _OWN + "lines": F.transform(F.filter(own("judged"), lambda x: x["full"]), lambda x: x["line"]),
        _OWN + "kept_lines": F.transform(F.filter(own("judged"), lambda x: x["full"] & ~x["bad"]), lambda x: x["line"]),
    })
    grams = own("grams")
    repeats = F.coalesce(F.size(F.array_distinct(grams)) < F.size(grams), F.lit(False))
    sizes = lambda lines: F.aggregate(lines, F.lit(0), lambda a, x: a + F.char_length(x))
    df = df.withColumns({
        _OWN + "repeat": F.when(repeats, _covered(grams)).otherwise(F.lit(0)).cast("long"),
        _OWN + "all": sizes(own("lines")),
    })
    text = own("text")
    base_failed = (own("n") < MIN_WORDS) | (own("repeat") * 100 > own("n") * MAX_REPEAT_PCT)
    lost = own("all") - sizes(own("kept_lines"))
    too_much = lost * 100 > own("all") * MAX_LOST_PCT
    # the cleaned text keeps every line but those removed, blank ones included
    rest = F.transform(F.filter(own("judged"), lambda x: ~x["bad"]), lambda x: x["line"])
    cleaned = F.when(lost == 0, text).otherwise(F.array_join(rest, "\n"))
    figures = F.struct(
        own("n").cast("long").alias("n_words"),
        own("chars").cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS + "+", ""))).cast("long").alias("n_symbols"),
        (F.size(own("lines")) - F.size(F.array_distinct(own("lines")))).cast("long").alias("n_dup_lines"),
        own("repeat").alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & ~too_much).alias("kept"),
        F.size(own("lines")).cast("long").alias("n_lines"),
        (F.size(own("lines")) - F.size(own("kept_lines"))).cast("long").alias("n_removed_lines"),
        lost.cast("long").alias("n_lost_chars"),
        cleaned.alias("cleaned"),
    )
    names = [c for c in docs.columns if not c.startswith(_OWN)]
    return df.select(*(df[f"`{c}`"] for c in names), figures.alias(_OWN))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base figures, verdicts, line counts and the
    cleaned text (lines that failed removed)."""
    rows = with_figures(docs.select(F.col(id_col), F.col(text_col)), text_col)
    return rows.select(id_col, f"{_OWN}.*")


def clean(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The kept documents with their cleaned texts and all their other columns;
    ``chars_col`` is counted anew where a text changed."""
    # the row number keeps the optimizer from moving the filter below the
    # figures, where it would repeat all their expressions
    rows = with_figures(docs, text_col).withColumn(_OWN + "row", F.monotonically_increasing_id())
    rows = rows.where(F.col(f"{_OWN}.kept") & (F.col(_OWN + "row") >= 0))
    changed = F.col(f"{_OWN}.n_lost_chars") > 0
    out = []
    for c in docs.columns:
        col = F.col(f"`{c}`")
        if c == text_col:
            col = F.when(changed, F.col(f"{_OWN}.cleaned")).otherwise(col)
        elif c == chars_col:
            kind = docs.schema[c].dataType
            col = F.when(changed, F.char_length(F.col(f"{_OWN}.cleaned"))).otherwise(col).cast(kind)
        out.append(col.alias(c))
    return rows.select(*out)
