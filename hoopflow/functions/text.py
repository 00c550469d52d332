"""Text audit and routing as Column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hoopflow.functions.geometry import _c

# Fixed patterns: numbers, and three coordinate-like tokens.
NUMBER = r"-?\d+(?:\.\d+)?"
COORDINATES = [r"\(\s*-?\d+(\.\d+)?\s*,\s*-?\d+(\.\d+)?\s*\)", r"(?i)\b[xy]\s*=\s*-?\d+(\.\d+)?", r"(?i)\bpixel"]
TOLERANCE = 0.02
#: Words and blanks are ASCII, as in the SQL; Java's own ``\\b`` also counts letters such as the one after "best" in "bestä".
_WORD = "[0-9A-Za-z_]"
ASCII = {r"\b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", r"\s": r"[\t\n\f\r ]"}


def ascii_pattern(pattern: str) -> str:
    for short, full in ASCII.items():
        pattern = pattern.replace(short, full)
    return pattern


def numbers(text) -> Column:
    return F.transform(F.regexp_extract_all(_c(text), F.lit(NUMBER), F.lit(0)), lambda s: s.cast("double"))


def fabricated(text, allowed: Column) -> Column:
    """Numbers of the text that match no allowed one within 2 percent."""
    def echoed(n):
        return F.exists(allowed, lambda a: F.abs(n - a) <= F.greatest(F.lit(TOLERANCE), F.abs(a) * TOLERANCE))
    return F.filter(numbers(text), lambda n: ~echoed(n))


def has_coordinate(text) -> Column:
    t = _c(text)
    out = t.rlike(ascii_pattern(COORDINATES[0]))
    for p in COORDINATES[1:]:
        out = out | t.rlike(ascii_pattern(p))
    return out


def leaked_ids(text, ids: Column) -> Column:
    """Player ids that occur in the text as whole words."""
    words = F.regexp_extract_all(_c(text), F.lit(r"\w+"), F.lit(0))
    return F.array_intersect(F.transform(ids, lambda i: i.cast("string")), words)


def violations(fields: dict[str, Column], allowed: Column, ids: Column) -> Column:
    """What speaks against a rationale of these fields, one entry each; none means acceptable."""
    said = F.concat_ws(" ", *fields.values())
    blank = {n: F.coalesce(F.trim(v), F.lit("")) == "" for n, v in fields.items()}
    found = [F.array(F.when(c, F.lit(f"nothing written for {n}"))) for n, c in blank.items()]
    found += [F.array(F.when(has_coordinate(said), F.lit("gives a position in coordinates"))),
              F.transform(fabricated(said, allowed), lambda n: F.format_string("states %s, which is not in the brief", n.cast("string"))),
              F.transform(leaked_ids(said, ids), lambda i: F.format_string("mentions player %s by id", i))]
    return F.array_compact(F.concat(*found))


# Fixed routing words, tried in this order.
ROUTES = [("best", r"\b(best|top|recommend|optimal)\b"), ("next", r"\b(next|another|other|cycle)\b"), ("why", r"\b(why|explain|reason|because)\b"),
          ("SHOOT", r"\b(shoot|shot|jumper|three|3)\b"), ("DRIVE", r"\b(drive|attack|rim|lay ?up)\b"), ("PASS_TO", r"\b(pass|kick|dish|swing|feed)\b"),
          ("SCREEN_WITH", r"\b(screen|pick|ball ?screen)\b"), ("RESET", r"\b(reset|hold|pull ?out)\b")]
DIRECTIONS = [("left", r"\bleft\b"), ("right", r"\bright\b"), ("middle", r"\bmiddle|center\b")]
NUMBERED, TO_SOMEONE = r"#?\s*(\d{1,2})", r"pass|to\b"


def _asked(question) -> Column:
    """A question in lower case. The dotted capital I becomes a plain i, where Java would add a combining dot."""
    return F.trim(F.lower(F.translate(_c(question), "\u0130", "i")))


def route(question) -> Column:
    """What a question asks for: best, next, why, an action kind, a numbered pass or help."""
    q = _asked(question)
    out = None
    for name, pat in ROUTES:
        hit = q.rlike(ascii_pattern(pat))
        hit = hit & ~q.rlike("why not") if name == "why" else hit
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(q.rlike(ascii_pattern(NUMBERED)) & q.rlike(ascii_pattern(TO_SOMEONE)), "pass_to_number").otherwise("help")


def direction(question) -> Column:
    q = _asked(question)
    out = None
    for name, pat in DIRECTIONS:
        hit = q.rlike(ascii_pattern(pat))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def jersey_number(question) -> Column:
    return F.regexp_extract(_asked(question), ascii_pattern(NUMBERED), 1).try_cast("int")
