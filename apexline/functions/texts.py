"""Blanks as browsers understand them, where Java's `trim` and `\\s` know fewer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks outside ASCII that count as white space, and all white space.
WIDE = (
    "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WHITE = "\t\n\x0b\x0c\r " + WIDE


def stripped(text: Column | str) -> Column:
    """Without white space at either end."""
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(WHITE))


def plain_blanks(text: Column | str) -> Column:
    """Unusual blanks as ordinary ones, so that one pattern knows them all."""
    return F.translate(text, WIDE, " " * len(WIDE))
