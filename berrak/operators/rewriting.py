"""Suggested texts made ready for a check: markup taken out, and full stops where they were left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most words of a heading, which needs no full stop.
HEADING_WORDS = 6
#: Signs that end a line.
ENDS = ".!?:…"


def clean_text(text: Column) -> Column:
    """A text without marks of emphasis and headings. Items begin with ``- ``; runs of spaces become one, none ends a line; at most one line in a row is empty."""
    out = F.regexp_replace(text, "[ \\t]+", " ")
    out = F.regexp_replace(out, "(?dm)^ ?[*•] ", "- ")
    out = F.regexp_replace(out, "(?dm)^ ?#{1,6} ", "")
    out = F.translate(F.regexp_replace(out, "\\*\\*|__", ""), "‐‑", "--")
    out = F.regexp_replace(out, " +(?=\n)", "")
    return F.trim(F.regexp_replace(out, "\n{3,}", "\n\n"), F.lit(" \n"))


def punctuate(text: Column) -> Column:
    """A text whose lines end in a sign: others get a full stop, but for items and for a paragraph's first line of few words."""

    def with_stop(lines: Column) -> Column:
        def one(line: Column, k: Column) -> Column:
            bare = F.trim(line, F.lit(" \t"))
            before = F.get(lines, k - 1)
            first = before.isNull() | (F.trim(before, F.lit(" \t")) == "")
            heading = first & (F.size(F.split(bare, "[ \t]+")) <= HEADING_WORDS)
            bad = (bare != "") & ~heading & ~F.startswith(bare, F.lit("-")) & ~F.right(bare, F.lit(1)).isin(*ENDS)
            return F.concat(F.rtrim(line, F.lit(" \t")), F.when(bad, ".").otherwise(""))

        return F.array_join(F.transform(lines, one), "\n")

    return F.transform(F.array(F.split(text, "\n")), with_stop)[0]
