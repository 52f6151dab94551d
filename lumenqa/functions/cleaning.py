"""Cleaning of extracted page text, line by line, as Column functions.

What a publisher's pages repeat is a parameter (:class:`Furniture`), and so is the map of literal repairs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import cut_at, let
from .text import LINE_BREAK, is_title_line, strip

# Glyphs of a symbol font, and literal repairs of broken words.
BULLETS, DROPPED = "", ""
REPAIRS = {
    "welcomin g": "welcoming",
    "prope rty": "property",
    "Cod e": "Code",
    "th e": "the",
    "dep rives": "deprives",
    "c ondition": "condition",
    "inten tionally": "intentionally",
    "do cuments": "documents",
    "appea r": "appear",
    "Heari ng": "Hearing",
    "conside red": "considered",
    "de -recognized": "de-recognized",
    "non -punitive": "non-punitive",
}
CONTENTS_TITLES = ("Table of Contents", "CONTENTS", "INDEX")
# Lines that policy pages repeat, by how they start, as a whole, as a whole by pattern; and a sentence cut out of the text.
REPEATED_STARTS = (
    "Library Volume:", "Volume:", "Chapter:", "Responsible Executive:", "Responsible Office", "Originally Issued:", "Current Version Approved:", "University Policy 7.", "Last updated:",
)
REPEATED_LINES = ("Processing and Reporting Changes in Student Enrollment Status Under Title IV", "Voluntary Leave of Absence for Students")
REPEATED_PATTERNS = (r"Policy\s+7\.\d+\s+Last Updated:.*", r"POLICY\s+\d+\.\d+")
CUT_SENTENCES = ("Provost for Enrollment Last Updated: March 18, 2019 Processing and Reporting Changes in Student Enrollment Status Under Title IV",)


@dataclass(frozen=True)
class Furniture:
    """What the pages of a publisher repeat: lines that go whole, and parts that are cut out of lines or texts."""

    starts: tuple[str, ...] = REPEATED_STARTS
    lines: tuple[str, ...] = REPEATED_LINES
    patterns: tuple[str, ...] = REPEATED_PATTERNS
    contained: tuple[str, ...] = ()
    cut_patterns: tuple[str, ...] = ()
    cut_sentences: tuple[str, ...] = CUT_SENTENCES

    def of(self, publisher: str, domain: str) -> Furniture:
        """This and what carries the publisher's name and address: office and library lines, running heads and feet."""
        office, at, name = "University Policy Office", re.escape(domain), re.escape(publisher)
        return Furniture(
            (*self.starts, f"{publisher} Policy Library", f"{publisher} University Policy 7.1,"),
            (*self.lines, f"{office} www.policy.{domain}"),
            (*self.patterns, rf"{office}\s+www\.policy\.{at}"),
            (*self.contained, f"{publisher} {office} policy.{domain}"),
            (*self.cut_patterns, rf"{name} {office}\s+policy\.{at}", rf"{office}\s+www\.policy\.{at}", rf"^{name} {office}\b", rf"^policy\.{at}\b"),
            self.cut_sentences,
        )


FURNITURE = Furniture()


def fold_glyphs(text: Column) -> Column:
    """No-break spaces, dashes and private-use glyphs to plain characters."""
    plain = F.translate(text, "\xa0–—" + BULLETS, " --" + "-" * len(BULLETS))
    return F.regexp_replace(plain, "[-]", "")


def lines(text: Column) -> Column:
    """Lines with runs of blanks squeezed and ends stripped."""
    return F.transform(F.split(text, LINE_BREAK, -1), lambda x: strip(F.regexp_replace(x, "[ \t]+", " ")))


def is_contents_line(line: Column) -> Column:
    """Tables of contents and indexes: titles, leader dots with a number, mostly leaders."""
    size = F.char_length(line)
    leaders = size - F.char_length(F.translate(line, "._", ""))
    return line.isin(*CONTENTS_TITLES) | line.rlike(r"(\.{5,}|_{5,})\s*\d+") | ((size > 20) & (leaders / size > 0.25))


def is_repeated(line: Column, furniture: Furniture = FURNITURE) -> Column:
    """Whether a stripped line is one that pages repeat."""
    tests = [F.startswith(line, F.lit(x)) for x in furniture.starts] + [F.contains(line, F.lit(x)) for x in furniture.contained]
    if furniture.lines:
        tests.append(line.isin(*furniture.lines))
    if furniture.patterns:
        tests.append(line.rlike("^(?:" + "|".join(furniture.patterns) + ")$"))
    return reduce(Column.__or__, tests, F.lit(False)) & (line != "")


def clean_line(line: Column, removed: tuple[str, ...] = ()) -> Column:
    """A page line without the removed patterns, spaced hyphens closed up, contents lines blanked."""
    for pattern in removed:
        line = F.regexp_replace(line, pattern, "")
    line = F.regexp_replace(line, r"\b([A-Za-z]+)\s+-\s+([A-Za-z]+)", "$1-$2")
    line = strip(F.regexp_replace(line, r"\s{2,}", " "))
    return F.when(is_contents_line(line), F.lit("")).otherwise(line)


#: What ends a line that nothing is joined to.
END_MARKS = r"[.?!:;)]$"


def never_joined(line: Column) -> Column:
    """A line that goes on from no other: blank, a page mark, a title, a list item."""
    item = line.rlike(r"^(\d+\.|[a-zA-Z]\.|[ivxlcdmIVXLCDM]+\.)\s+")
    return (line == "") | F.startswith(line, F.lit("[Page ")) | is_title_line(line) | item


def merge_wrapped(rows: Column) -> Column:
    """Wrapped lines put together: each goes behind the text before it, unless that or it forbids.

    Lines that can't be joined, whatever stands before them, cut the rows into stretches; only inside
    a stretch does a join depend on what was joined before, so only stretches are folded.
    """

    def stretch(_: Column, part: Column) -> Column:
        def step(kept: Column, line: Column) -> Column:
            last = F.element_at(kept, -1)
            goes_on = ~(F.startswith(last, F.lit("[Page ")) | is_title_line(last))
            joined = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(F.concat_ws(" ", last, line)))
            return F.when(goes_on, joined).otherwise(F.concat(kept, F.array(line)))

        return F.aggregate(F.slice(part, F.lit(2), F.size(part)), F.slice(part, F.lit(1), F.lit(1)), step)

    def cut(lines: Column) -> Column:
        first = lambda line, i: (i == 0) | never_joined(line) | F.coalesce(F.get(lines, i - 1).rlike(END_MARKS + "|^$"), F.lit(False))
        starts = F.filter(F.transform(lines, lambda line, i: F.when(first(line, i), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.flatten(cut_at(lines, at, stretch)))

    return let(rows, cut)


def repair(text: Column, repairs: dict[str, str] = REPAIRS, cut: tuple[str, ...] = ()) -> Column:
    """Sentences cut out, de-hyphenation, closed-up hyphens, literal repairs."""
    for literal in cut:
        text = F.replace(text, F.lit(literal), F.lit(""))
    text = F.regexp_replace(text, r"\b([A-Za-z]+)-\s+([A-Za-z]+)\b", "$1$2")
    text = F.regexp_replace(text, r"\b([A-Za-z]+)\s+-\s+([A-Za-z]+)", "$1-$2")
    for old, new in repairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def squeezed(rows: Column) -> Column:
    """Blank lines in a row as one, and none at the start."""
    return F.filter(rows, lambda x, i: (x != "") | ((i > 0) & (F.coalesce(F.get(rows, i - 1), F.lit("")) != "")))


def clean_html_text(text: Column) -> Column:
    """Text from web pages."""
    joined = F.array_join(let(lines(fold_glyphs(text)), squeezed), "\n")
    return strip(F.regexp_replace(joined, "\n{3,}", "\n\n"))


def clean_pdf_text(text: Column, furniture: Furniture = FURNITURE) -> Column:
    """Text from paged documents.

    Blank lines are squeezed before page numbers and repeated lines go, so blank, number, blank
    leaves two blanks; wrapped lines are merged before blank runs are cut to one.
    """
    rows = let(F.transform(lines(fold_glyphs(text)), lambda x: clean_line(x, furniture.cut_patterns)), squeezed)
    rows = F.filter(rows, lambda x: ~x.rlike(r"^\d+$") & ~is_repeated(x, furniture))
    joined = repair(F.array_join(merge_wrapped(rows), "\n"), cut=furniture.cut_sentences)
    return strip(F.regexp_replace(joined, "\n{3,}", "\n\n"))
