"""Line and sentence handling on a whole text held in one row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenmill.functions.arrays import bound

# The characters that count as white space when a line is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The three line ends.
LINE_END = "\r\n|\r|\n"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def physical_lines(text: Column) -> Column:
    """Every line of a text, blanks included; a final line end opens no line."""
    def without_last(pieces):
        closed = F.element_at(pieces, -1) == ""
        return F.when(closed, F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)

    return bound(F.split(text, LINE_END, -1), without_last)


def stripped_lines(text: Column) -> Column:
    """Non-blank lines without surrounding white space."""
    lines = F.transform(F.split(text, LINE_END, -1), strip)
    return F.filter(lines, lambda line: line != "")


def joined_text(lines: Column) -> Column:
    return F.array_join(lines, " ")


def sentences(text: Column) -> Column:
    """Pieces between full stops, each given its full stop back, the last one too."""
    return F.transform(F.split(text, "\\.", -1), lambda piece: F.concat(piece, F.lit(".")))


def sentence_groups(text: Column, n: int) -> Column:
    """Runs of n consecutive sentences joined by a space; the last run may be short."""
    # possessive, as backtracking over a long run would exhaust the stack
    runs = F.regexp_extract_all(F.concat(text, F.lit(".")), F.lit(f"(?:[^.]*+\\.){{1,{n}}}+"), F.lit(0))
    return F.transform(runs, lambda run: F.regexp_replace(run, "(?s)\\.(?=.)", ". "))
