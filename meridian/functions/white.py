"""White space as the reference's trim takes it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that a trim removes.
WHITE = "\t\n\x0b\x0c\r \xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"


def trimmed(text: Column | str) -> Column:
    return F.btrim(text, F.lit(WHITE))
