"""Checks and dialect of regular-expression arguments.

Patterns follow the linear-time dialect (no look-around, no back-references);
they are checked on the driver before a plan is built and rewritten into the
dialect of Spark's ``rlike``.
"""

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession

# Limits of a pattern argument.
MAX_BYTES = 512
MAX_GROUP_DEPTH = 8
MAX_ALTERNATIONS = 32

# Letters allowed after a backslash, and the ASCII named classes.
ESCAPES = "aftnrvxdDsSwWpPbBAz"
POSIX = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}

_PAIRS = {")": "(", "]": "[", "}": "{"}
_LOOK = ("(?=", "(?!", "(?<=", "(?<!", "(?>")
_FLAGS = "imsxu-"
_TOKEN = re.compile(
    r"""(?P<escape>\\[pPx]\{[^}]*\}|\\.)
      | \[:(?P<posix>\w+):\]
      | \(\?P?<(?P<group>[A-Za-z_]\w*)>
      | \(\?(?P<flags>[A-Za-z-]+)[:)]
      | (?P<count>\{\d+(?:,\d*)?\})
      | (?P<char>.)""",
    re.S | re.X,
)


class PatternError(ValueError):
    """A regular expression that is not accepted."""


def check_limits(pattern: str) -> None:
    """Length, nesting and bracket balance; character classes get no special reading."""
    if len(pattern.encode()) > MAX_BYTES:
        raise PatternError(f"the pattern has more than {MAX_BYTES} bytes")
    bare = re.sub(r"\\.", "", pattern, flags=re.S)
    still_open, deepest = [], 0
    for c in re.sub(r"[^][(){}]", "", bare):
        if c in _PAIRS:
            if not still_open or still_open.pop() != _PAIRS[c]:
                raise PatternError(f"{c} closes nothing")
        else:
            still_open.append(c)
            deepest = max(deepest, still_open.count("("))
    if still_open:
        raise PatternError(f"{still_open[-1]} is never closed")
    if deepest > MAX_GROUP_DEPTH:
        raise PatternError(f"the pattern nests more than {MAX_GROUP_DEPTH} groups")
    if bare.count("|") > MAX_ALTERNATIONS:
        raise PatternError(f"the pattern has more than {MAX_ALTERNATIONS} alternatives")


def spark_regex(pattern: str) -> str:
    """Check ``pattern`` and return it in the dialect of ``rlike``."""
    check_limits(pattern)
    if any(look in pattern for look in _LOOK):
        raise PatternError("patterns cannot look around")
    multi_line = re.search(r"\(\?[a-z]*m", pattern) is not None
    out, in_class, previous, repeats = [], 0, "", ""
    for token in _TOKEN.finditer(pattern):
        text, repeated, repeats = token.group(), repeats, ""
        if token["escape"]:
            letter = text[1]
            if (letter.isascii() and letter.isalnum()) and letter not in ESCAPES:
                raise PatternError(f"{text} has no meaning in a pattern")
            if letter in "<>":  # word borders of the dialect, which Java reads as plain characters
                raise PatternError(f"write \\b instead of {text}")
            out.append(r"\x0B" if text == r"\v" else text)
        elif in_class or text == "[":
            if token["posix"]:
                if token["posix"] not in POSIX:
                    raise PatternError(f"there is no class {text}")
                text = POSIX[token["posix"]]
            elif text == previous and text in "-~":
                raise PatternError(f"{text * 2} has no meaning in a class")
            in_class += {"[": 1, "]": -1}.get(text, 0)
            out.append(text)
        elif token["group"]:
            out.append("(")
        elif token["flags"] and set(token["flags"]) - set(_FLAGS):
            raise PatternError(f"{text} has an unknown flag")
        elif text in "*+?" or token["count"]:
            # A question mark after a repetition makes it lazy; nothing else may follow one.
            if repeated == "lazy" or (repeated and text != "?"):
                raise PatternError("what is repeated cannot be repeated again")
            repeats = "lazy" if repeated else "greedy"
            out.append(text)
        elif text == "{":
            raise PatternError("a count needs numbers")
        elif text == "$" and not multi_line:
            out.append(r"\z")
        else:
            out.append(text)
        previous = text
    # U: Unicode classes; d: only a line feed ends a line.
    checked = "(?dU)" + "".join(out)
    session = SparkSession.getActiveSession()
    try:  # the engine that will run it has the last word, at the latest when a search is built
        if session is not None:
            session._jvm.java.util.regex.Pattern.compile(checked)
    except IllegalArgumentException as e:
        raise PatternError(f"the pattern cannot be read: {e}") from e
    return checked
