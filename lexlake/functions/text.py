"""Text expressions. All of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import html5 as _html5

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as blank, and the same as a pattern class.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANK = r"(?U)[\s\x1c-\x1f]"

_UNSEEN = (
    r"(?is)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<![a-z][^>]*>|<\?[^>]*>"
    r"|<(script|style|template)\b[^>]*>.*?</\1\s*>"
)
_TAG = r"""</?[A-Za-z][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""


# What the numeric references 0x80 to 0x9F stand for.
WINDOWS_1252 = (
    "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f"
    "\x90‘’“”•–—˜™š›œ\x9džŸ"
)


def strip(col: Column) -> Column:
    """Drop blanks, Unicode ones included, at both ends."""
    return F.btrim(col, F.lit(BLANKS))


def squeeze(col: Column) -> Column:
    """Strip, and make every inner run of blanks one space."""
    return strip(F.regexp_replace(col, f"{BLANK}+", " "))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it; Spark shares nothing inside lambdas."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def normalize_text(col: Column) -> Column:
    """Null becomes the empty text; anything else is stripped."""
    return F.coalesce(strip(col), F.lit(""))


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def concat_nullable(*cols: Column) -> Column:
    """Concatenate, counting a null as empty."""
    return F.concat(*[F.coalesce(c, F.lit("")) for c in cols])


def clean_definition(col: Column) -> Column:
    """Drop the leading heading, squeeze blanks, close up apostrophes and brackets."""
    # The edits and their order.
    edits = (
        (rf"^Définition{BLANK}+", ""),
        (rf"{BLANK}+", " "),
        (rf"(['’]){BLANK}+", "$1"),
        (rf"\({BLANK}+", "("),
        (rf"{BLANK}+\)", ")"),
    )
    for pattern, replacement in edits:
        col = F.regexp_replace(col, pattern, replacement)
    return strip(col)


def _character(code: Column) -> Column:
    """The character of a numeric reference: what is no character becomes U+FFFD, 0x80 to 0x9F are read as browsers do."""
    wrong = (code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    windows = F.get(F.array(*[F.lit(ord(c)) for c in WINDOWS_1252]), code - 0x80)
    known = F.when(wrong, F.lit(0xFFFD)).when(code.between(0x80, 0x9F), windows).otherwise(code)
    return F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32")


def _names(with_semicolon: bool) -> Column:
    """Map of the named references of the HTML standard, with or without a closing semicolon, as one literal."""
    known = {n: c for n, c in _html5.items() if n.endswith(";") == with_semicolon}
    return F.str_to_map(F.lit("\x02".join(f"{n}\x01{c}" for n, c in known.items())), F.lit("\x02"), F.lit("\x01"))


def _numbered(reference: Column) -> Column:
    digits = F.regexp_replace(F.lower(F.regexp_extract(reference, r"#(\w+)", 1)), r"^(x?)0+(?=.)", "$1")
    # A number of more digits than any character has stands for none.
    code = F.when(F.length(digits) > 8, F.lit(-1)).when(
        digits.startswith("x"), F.conv(F.substring(digits, 2, 10), 16, 10).cast("int")
    ).otherwise(F.conv(digits, 10, 10).cast("int"))
    return _character(code)


def decode_entities(col: Column, unclosed: bool = True) -> Column:
    """Decode numeric references and all named ones of the HTML standard, the old ones without a semicolon as well.

    The text is walked once, from ampersand to ampersand. A name in letters and digits that a semicolon closes is looked up as a whole; if
    there is none, the longest old name that the text goes on with is taken. What is no reference stays. With ``unclosed`` false,
    names without a semicolon stay as they are.
    """
    closed, old = _names(True), _names(False)
    sizes = sorted({len(n) for n in _html5 if not n.endswith(";")}, reverse=True) if unclosed else []
    rest = lambda piece, n: F.substring(piece, n + 1, F.length(piece))

    def decoded(piece: Column) -> Column:
        number = F.regexp_extract(piece, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
        name = F.regexp_extract(piece, r"^[A-Za-z][A-Za-z0-9]*;", 0)
        whole = F.when(name != "", F.try_element_at(closed, name))
        begun = [F.concat(F.try_element_at(old, F.substring(piece, 1, n)), rest(piece, F.lit(n))) for n in sizes]
        return (
            F.when(number != "", F.concat(_numbered(number), rest(piece, F.length(number))))
            .when(whole.isNotNull(), F.concat(whole, rest(piece, F.length(name))))
            .otherwise(F.coalesce(*begun, F.concat(F.lit("&"), piece)))
        )

    pieces = F.split(col, "&")
    after = F.transform(F.slice(pieces, 2, F.size(pieces)), decoded)
    return F.when(F.contains(col, F.lit("&")), F.concat(F.get(pieces, F.lit(0)), F.array_join(after, ""))).otherwise(col)


def html_to_text(col: Column, unclosed: bool = True) -> Column:
    """Text nodes, each stripped, the empty ones dropped, joined by a space; ``unclosed`` as in ``decode_entities``."""
    # Text without an angle bracket, the most of a corpus, is one piece and needs no pattern.
    pieces = F.when(~F.contains(col, F.lit("<")), F.array(col)).otherwise(F.split(F.regexp_replace(col, _UNSEEN, "<x>"), _TAG))
    decoded = F.transform(pieces, lambda x: strip(decode_entities(x, unclosed)))
    return F.array_join(F.filter(decoded, lambda x: x != ""), " ")


# What a piece of markup begins with: a tag of the element wanted or of the one around it, opened, empty or closed.
_OPEN, _EMPTY, _CLOSE, _OPEN_PARENT, _CLOSE_PARENT = range(1, 6)


def extract_elements(col: Column, parent: str, tag: str) -> Column:
    """Texts of the ``tag`` elements under ``parent`` elements, by their start tags; null if there are none.

    Elements may lie inside each other at any depth. The markup is cut at the tags of both names, and these are counted through with a
    stack: a closing tag ends the last open element of its name and whatever is still open inside it, the end of the text ends all;
    a closing tag without an open element is passed over. The text of an element is all text inside it.
    """
    clean = F.regexp_replace(col, r"(?s)<!--.*?-->", "")
    name = lambda n: rf"{re.escape(n)}(?![\w:.-])"
    cut = rf"(?=</?(?:{name(parent)}|{name(tag)}))"
    begins = lambda p, pattern: F.regexp_like(p, F.lit(rf"(?s)^{pattern}"))
    inside = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""

    def kind(p: Column) -> Column:
        found = F.when(begins(p, f"</{name(tag)}"), _CLOSE).when(begins(p, f"</{name(parent)}"), _CLOSE_PARENT)
        found = found.when(begins(p, f"<{name(tag)}{inside}/>"), _EMPTY).when(begins(p, f"<{name(tag)}"), _OPEN)
        return found.when(begins(p, f"<{name(parent)}{inside}/>"), 0).when(begins(p, f"<{name(parent)}"), _OPEN_PARENT).otherwise(0)

    nothing = F.expr("named_struct('stack', cast(array() as array<struct<parent:boolean,at:int,under:boolean>>), 'out', cast(array() as array<struct<at:int,upto:int>>))")
    ended = lambda open_, upto: F.transform(
        F.filter(open_, lambda e: ~e["parent"] & e["under"]), lambda e: F.struct(e["at"].alias("at"), upto.alias("upto"))
    )

    def step(acc: Column, mark: Column) -> Column:
        stack, out, at, what = acc["stack"], acc["out"], mark["at"], mark["kind"]
        under = F.exists(stack, lambda e: e["parent"])
        own = F.array(F.struct((what == _OPEN_PARENT).alias("parent"), at.alias("at"), under.alias("under")))
        empty = F.array(F.struct(at.alias("at"), at.alias("upto")))
        # From the top of the stack: where the last element that this mark closes is; 0 for none.
        place = F.array_position(F.reverse(F.transform(stack, lambda e: e["parent"])), what == _CLOSE_PARENT).cast("int")
        closed = F.when(what.isin(_CLOSE, _CLOSE_PARENT), place).otherwise(0)

        def after(depth: Column) -> Column:
            below = F.size(stack) - depth
            next_stack = F.when(what.isin(_OPEN, _OPEN_PARENT), F.concat(stack, own)).when(depth > 0, F.slice(stack, 1, below)).otherwise(stack)
            next_out = F.when((what == _EMPTY) & under, F.concat(out, empty)).when(depth > 0, F.concat(out, ended(F.slice(stack, below + 1, depth), at))).otherwise(out)
            return F.struct(next_stack.alias("stack"), next_out.alias("out"))

        return once(closed, after)

    def texts(pieces: Column) -> Column:
        marks = F.filter(F.transform(pieces, lambda p, i: F.struct(i.alias("at"), kind(p).alias("kind"))), lambda m: m["kind"] > 0)
        spans = F.aggregate(marks, nothing, step, lambda acc: F.array_sort(F.concat(acc["out"], ended(acc["stack"], F.size(pieces)))))
        inner = lambda s: F.regexp_replace(F.array_join(F.slice(pieces, s["at"] + 1, s["upto"] - s["at"]), ""), _TAG, "")
        return F.transform(spans, lambda s: once(inner(s), lambda text: squeeze(decode_entities(text))))

    # No element lies under a parent that never begins.
    found = once(clean, lambda c: F.when(F.contains(c, F.lit(f"<{parent}")), once(F.split(c, cut), texts)))
    return once(found, lambda t: F.when(F.size(t) > 0, t))


def parse_list(col: Column) -> Column:
    """A list written as text, to an array of stripped lower-case values.

    Text that is no list becomes the only value. Reads both quote styles and
    the backslash escapes of a Python list literal.
    """
    json = F.regexp_replace(col, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    parsed = F.when(
        strip(col).startswith("["),
        F.from_json(
            json,
            T.ArrayType(T.StringType()),
            {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"},
        ),
    )
    return F.transform(F.coalesce(parsed, F.array(col)), lambda x: F.lower(strip(x)))


def list_text(col: Column) -> Column:
    """An array of strings as the text of a list literal, which ``parse_list`` reads; nulls are left out."""
    escaped = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    items = F.transform(F.array_compact(col), lambda x: F.concat(F.lit("'"), escaped(x), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def clean_answer(col: Column) -> Column:
    """Lower, strip, drop one trailing role word, strip; null becomes empty."""
    base = strip(F.lower(F.coalesce(col, F.lit(""))))
    return strip(F.regexp_replace(base, r"assistant\z", ""))


def first_answer(col: Column) -> Column:
    """What stands before the first newline, period, comma or semicolon."""
    return strip(F.regexp_extract(col, r"^[^\n.,;]*", 0))


def clean_run_name(col: Column, suffix: str) -> Column:
    """Model name of a result file stem: drop ``suffix`` and a trailing date_time stamp."""
    base = F.replace(col, F.lit(suffix), F.lit(""))
    parts = F.split(base, "_")
    n = F.size(parts)
    stamped = (n >= 2) & F.coalesce(F.try_element_at(parts, F.lit(-2)).rlike(r"^[0-9]+$"), F.lit(False))
    return F.when(
        stamped, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), "_")
    ).otherwise(base)


def percent_text(col: Column, digits: int, missing: str = "-") -> Column:
    """Share as percent text; a tie of the last digit goes to the even one."""
    exact = (col * F.lit(100.0)).cast("decimal(38,20)")  # all digits of a double from 0.01 on
    text = F.concat(F.bround(exact, digits).cast(f"decimal(24,{digits})").cast("string"), F.lit("%"))
    return F.when(col.isNull(), F.lit(missing)).otherwise(text)


def parse_percent(col: Column) -> Column:
    """Percent text, possibly bold, to a number; 0.0 if it is none."""
    bare = F.replace(F.replace(col, F.lit("**"), F.lit("")), F.lit("%"), F.lit(""))
    return F.coalesce(bare.try_cast("double"), F.lit(0.0))


def kwic(text: Column, occurrence: Column, window: int = 60) -> Column:
    """Keyword in context.

    The first two whole numbers of ``occurrence`` are the span of the keyword.
    It is widened by ``window`` on each side and then to the next blank or
    newline; a cut side is marked with dots. Without a span the whole text is kept.
    """
    numbers = F.regexp_extract_all(occurrence, F.lit(r"(\d+)"), F.lit(1))
    start = F.get(numbers, F.lit(0)).cast("int")
    end = F.get(numbers, F.lit(1)).cast("int")
    n = F.length(text)
    left0 = F.greatest(F.lit(0), start - window)
    right0 = F.least(n, end + window)
    before = F.regexp_extract(F.substring(text, F.lit(1), left0 + 1), r"(?s)^.*[ \n]", 0)
    left = F.when(left0 == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.length(before) - 1))
    rest = F.regexp_extract(F.substring(text, right0 + 1, n), r"^[^ \n]*", 0)
    right = right0 + F.length(rest)
    body = strip(F.substring(text, left + 1, F.greatest(right - left, F.lit(0))))
    cut = F.concat(
        F.when(left > 0, F.lit("...")).otherwise(F.lit("")),
        body,
        F.when(right < n, F.lit("...")).otherwise(F.lit("")),
    )
    return F.when(F.coalesce(F.size(numbers), F.lit(0)) < 2, text).otherwise(cut)
