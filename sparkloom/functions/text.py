"""Text functions: line splitting, keyword search, and safe display of untrusted text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keyword alternatives, and the characters that end a line.
KEYWORDS = r"simd|zero[- ]?copy|lock[- ]?free|cache|caching|parallel|thread|sparse|precomput|control[-_ ]?rate|block[-_ ]?process|vectori[sz]|packed|rayon|buffer|latency|benchmark|performance|optimi[sz]|allocation|audio[-_ ]?rate"
#: Each match of KEYWORDS has one of these in it, letters folded.
STEMS = ("simd", "zero", "lock", "cach", "parallel", "thread", "sparse", "precomput", "control", "vectori", "packed", "rayon", "buffer", "latency", "benchmark", "performance", "optimi", "allocation", "audio")
LINE_END = r"\r\n|[\n\r\u000B\f\u001C-\u001E\u0085  ]"
CONTEXT = 400


def lines(text: Column) -> Column:
    """Lines of a text, without an empty one after a final line end; null stays null."""
    pieces = F.split(text, LINE_END, -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def keyword_hits(docs: DataFrame, key: str, text: str, keywords: str = KEYWORDS, context: int = CONTEXT, stems: tuple[str, ...] = STEMS) -> DataFrame:
    """(key, lineno, match, context) of each line with a keyword, line numbers from 1; the first keyword of a line counts.

    ``stems`` are literals of which every match has one; texts without any are
    not split.  Pass () with keywords of your own that have none.
    """

    def may(c: Column) -> Column:
        # As a lambda's argument the lower-case text is made once, not for each stem.  Four letters beyond ASCII fold to one in it.
        literal = F.exists(F.array(F.lower(c)), lambda t: reduce(Column.__or__, [F.contains(t, F.lit(s)) for s in stems]))
        return literal | reduce(Column.__or__, [F.contains(c, F.lit(x)) for x in "\u017f\u212a\u0130\u0131"])

    docs = docs.where(may(F.col(text))) if stems else docs
    rows = docs.select(F.col(key).alias("key"), F.posexplode(lines(F.col(text))).alias("at", "line"))
    # A search for literals costs a fraction of the pattern's.
    rows = rows.where(may(F.col("line"))) if stems else rows
    pattern = f"(?iu){keywords}"
    found = rows.where(F.rlike("line", F.lit(pattern)))
    start = F.regexp_instr("line", F.lit(pattern))
    return found.select("key", (F.col("at") + 1).alias("lineno"), F.regexp_extract("line", pattern, 0).alias("match"), F.substring("line", F.greatest(F.lit(1), start - context // 2), F.lit(context)).alias("context"))


def escape_untrusted(text: Column, most: int = 512) -> Column:
    """Control and format characters as escapes; long texts keep both ends."""

    @F.pandas_udf("string")
    def escaped(texts):
        import unicodedata

        def one(t):
            if t is None:
                return None
            if len(t) > most:
                t = f"{t[: most // 2 - 2]}...{t[-(most // 2 - 1) :]}"
            return "".join(ascii(c)[1:-1] if unicodedata.category(c)[0] == "C" or c in "  " else c for c in t)

        return texts.map(one)

    return escaped(text)
