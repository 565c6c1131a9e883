"""Text functions of the read plans: column expressions, and plain functions for one page of results.

Lengths are code points unless a name says bytes. ASCII folding touches A to Z only, so matches stay where
they are; white space is Unicode white space. NULL in, NULL out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
SPACE = r"\p{IsWhite_Space}"


# --- columns --------------------------------------------------------------------------------------------
def fold(c: Column) -> Column:
    """ASCII letters in lower case; other letters stay (``lower`` would fold them too)."""
    return F.translate(c, _UPPER, _LOWER)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def contains(c: Column, query: Column, ignore_case: bool = False) -> Column:
    return F.contains(fold(c), fold(query)) if ignore_case else F.contains(c, query)


def snippet(c: Column, query: Column, around: int = 120, ignore_case: bool = False) -> Column:
    """The match with ``around`` characters on either side; NULL without a match."""
    at = F.instr(fold(c), fold(query)) if ignore_case else F.instr(c, query)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(c, start, at - start + F.char_length(query) + around))


def tail(c: Column, most: int) -> Column:
    """The last characters of the text on one line, with an ellipsis where something was cut."""
    line = F.regexp_replace(strip(c), f"{SPACE}+", " ")
    return F.when(F.char_length(line) > most, F.concat(F.lit("…"), F.right(line, F.lit(most)))).otherwise(line)


def middle(c: Column, most: int) -> Column:
    """Two thirds from the start and one from the end of the text on one line."""
    line = F.regexp_replace(strip(c), f"{SPACE}+", " ")
    head = most * 2 // 3
    return F.when(F.char_length(line) > most, F.concat(F.substring(line, 1, head), F.lit(" … "), F.right(line, F.lit(most - head)))).otherwise(line)


def clip_middle(c: Column, most: int) -> Column:
    head = most * 2 // 3
    cut = F.concat(F.substring(c, 1, head), F.lit(" … ["), (F.char_length(c) - most).cast("string"), F.lit(" characters left out] … "), F.right(c, F.lit(most - head)))
    return F.when(F.char_length(c) > most, cut).otherwise(c)


def clip_head(c: Column, most: int) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit(" … ["), (F.char_length(c) - most).cast("string"), F.lit(" more characters]"))).otherwise(c)


def truncate(c: Column, most: int, marker: str = "…[truncated]") -> Column:
    """Tool output cut to ``most`` characters and marked; 0 leaves it whole."""
    return F.when((F.lit(most) > 0) & (F.char_length(c) > most), F.concat(F.substring(c, 1, most), F.lit(marker))).otherwise(c)


def one_line(c: Column) -> Column:
    """On one line: terminal colours dropped, line breaks as `` / ``, runs of blanks as one."""
    c = F.regexp_replace(strip(c), "\x1b(?:\\[[^@-~]*[@-~]?)?", "")
    c = F.regexp_replace(c, "[ \t\r]+", " ")
    return F.regexp_replace(c, " ?\n[ \n]*", " / ")


def normalize(c: Column) -> Column:
    """For comparing: without white space, full-width ASCII folded, ASCII in lower case."""
    return F.translate(F.regexp_replace(F.translate(c, _WIDE, _NARROW), f"{SPACE}+", ""), _UPPER, _LOWER)


def project_from_cwd(c: Column) -> Column:
    """The last two parts of a working directory; ``file://`` and %xx are decoded, either slash parts."""
    plain = F.when(c.startswith("file://"), F.try_url_decode(F.regexp_replace(F.substring(c, 8, 1 << 30), r"\+", "%2B"))).otherwise(c)
    parts = F.filter(F.split(plain, r"[/\\]"), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


def hex_names(c: Column) -> Column:
    """Distinct words that can name a commit: 7 to 40 hex digits with a letter, not joined to a hyphen."""
    words = F.regexp_extract_all(c, F.lit(r"[0-9A-Fa-f-]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.char_length(w).between(7, 40) & ~F.contains(w, F.lit("-")) & w.rlike("[A-Fa-f]")))


def pieces(c: Column, size: int = 500, overlap: int = 100, whole: int = 600) -> Column:
    """Starts (0-based) of the overlapping pieces of a long text; one piece for a text up to ``whole``."""
    step = size - overlap
    count = F.ceil((F.char_length(c) - size) / F.lit(step)).cast("int")
    return F.when(F.char_length(c) <= whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), count * step, F.lit(step)))


# --- one page of results ----------------------------------------------------------------------------------
def byte_snippet(value: str, start: int, length: int, around: int = 120) -> str:
    """``around`` bytes on either side of a match at byte ``start``, widened to whole characters."""
    raw = value.encode()
    a, b = max(0, start - around), min(len(raw), start + length + around)
    while a > 0 and raw[a] & 0xC0 == 0x80:
        a -= 1
    while b < len(raw) and raw[b] & 0xC0 == 0x80:
        b += 1
    return raw[a:b].decode()


def values_head(values: list[str], most: int = 240) -> tuple[str | None, bool]:
    """The first bytes of the values joined by line breaks and whether that is cut; None if all is white space."""
    raw = "\n".join(values).encode()
    if not raw.strip():
        return None, False
    end = min(most, len(raw))
    while end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return raw[:end].decode(), end < len(raw)


def ascii_lower(s: str) -> str:
    return s.translate(str.maketrans(_UPPER, _LOWER))


def normalized(s: str) -> str:
    return ascii_lower("".join(s.translate(str.maketrans(_WIDE, _NARROW)).split()))


def window(text: str, terms: list[str], most: int) -> str:
    """The opening and the part around the first of ``terms``."""
    if len(text) <= most:
        return text
    lead = most // 4
    low = ascii_lower(text)
    at = min((i for i in (low.find(ascii_lower(t)) for t in terms) if i >= 0), default=-1)
    if at <= lead:
        return f"{text[:most]} … [{len(text) - most} more characters]"
    span = most - lead
    start = max(at - span // 3, lead)
    return f"{text[:lead]} … {text[start : start + span]}" + (" …" if start + span < len(text) else "")


def focused(text: str, start: int, size: int = 500, edge: int = 300) -> str:
    """A piece of a long text with its opening and end."""
    if len(text) <= size + 2 * edge:
        return text
    parts = [text[:edge], text[start : start + size], text[-edge:]]
    return " … ".join(p for i, p in enumerate(parts) if p and not (i == 1 and start < edge))


# Kana and kanji, as ranges of code points.
_KANA = r"々-〇ぁ-ゖゝ-ゟァ-ヺー-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003134Fｦ-ﾟ"
_BORDER = re.compile(rf"(?<=[A-Za-z0-9]) ?(?=[{_KANA}])|(?<=[{_KANA}]) ?(?=[A-Za-z0-9])")


def spacing_variants(term: str) -> list[str]:
    """The term with a space, and without one, wherever Latin and Japanese meet; only forms that differ."""
    out: list[str] = []
    for v in (_BORDER.sub(" ", term), _BORDER.sub("", term)):
        if v != term and v not in out:
            out.append(v)
    return out


def distinct_terms(terms: list[str], most: int = 16) -> list[str]:
    """Terms without repeats (case ignored) and blanks, at most ``most``."""
    seen: dict[str, str] = {}
    for t in terms:
        if t.strip():
            seen.setdefault(t.strip().lower(), t.strip())
    return list(seen.values())[:most]


def quote_found(quote: str, evidence: str) -> bool:
    """Whether the parts of a quote (around … ... and /) occur in order, compared as ``normalized``."""
    parts = [normalized(p.strip().strip("\"'“”‘’«»「」『』`")) for p in re.split(r"…|\.\.\.| / ", quote)]
    parts, text, at = [p for p in parts if p], normalized(evidence), 0
    for p in parts:
        if (found := text.find(p, at)) < 0:
            return False
        at = found + len(p)
    return bool(parts)
