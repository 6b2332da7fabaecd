"""Text expressions with ECMAScript semantics, built from Spark functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bodies of character classes. ECMAScript's \s and line ends differ from Java's.
SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LINE_END = r"\n\r\u2028\u2029"
WORD = "A-Za-z0-9_"


def java_regex(pattern: str) -> str:
    """Rewrite an ECMAScript pattern (no flags but g and m) for java.util.regex.

    Only the escapes that mean something else in Java are replaced: whitespace, the
    dot and the word boundary, which in ECMAScript looks at ASCII letters only.
    """
    out, in_class, i = [], False, 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            escape = pattern[i : i + 2]
            follows = pattern[i + 2 : i + 3]
            if escape == r"\s":
                out.append(SPACE if in_class else f"[{SPACE}]")
            elif escape == r"\b" and not in_class:
                if not (follows.isalnum() or follows == "_"):
                    raise ValueError(r"\b is supported in front of a word character only")
                out.append(f"(?<![{WORD}])")
            else:
                out.append(escape)
            i += 2
            continue
        if char == "[" and not in_class:
            in_class = True
        elif char == "]":
            in_class = False
        out.append(f"[^{LINE_END}]" if char == "." and not in_class else char)
        i += 1
    return "".join(out)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: code points, plus one more for each outside the BMP."""
    astral = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]+", ""))
    beyond_bmp = text.rlike(r"[\x{10000}-\x{10FFFF}]")
    return F.length(text) + F.when(beyond_bmp, astral).otherwise(F.lit(0))


def utf16_left(text: Column, units: int) -> Column:
    """The first ``units`` UTF-16 units; half a surrogate pair becomes U+FFFD."""
    head = F.substring(text, 1, units)

    def take(state: Column, char: Column) -> Column:
        width = F.when(char.rlike(r"[\x{10000}-\x{10FFFF}]"), 2).otherwise(1)
        used = state["used"]
        piece = (
            F.when(used + width <= units, char)
            .when(used < units, F.lit("\ufffd"))
            .otherwise(F.lit(""))
        )
        return F.struct(F.concat(state["kept"], piece).alias("kept"), (used + width).alias("used"))

    slow = F.aggregate(
        F.split(head, ""),
        F.struct(F.lit("").alias("kept"), F.lit(0).alias("used")),
        take,
        lambda state: state["kept"],
    )
    return F.when(head.rlike(r"[\x{10000}-\x{10FFFF}]"), slow).otherwise(head)


def round2(value: Column) -> Column:
    """Two decimals, halves up, on the binary value."""
    return F.floor(value * 100 + 0.5) / 100


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body``, which returns an array."""
    return F.flatten(F.transform(F.array(value), body))
