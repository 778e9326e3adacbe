"""Column functions on words and fields: tokens, normal forms, ordering tokens, dates, escapes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"

#: Accented letters with a normal form of one letter (fixed values); those that are no composition are listed with it.
ACCENTED = "àáâãåāăąçćĉċčďđèéêëēĕėęěĝğġģĥħìíîïĩīĭįıĵķĺļľłñńņňòóôõøōŏőŕŗřśŝşšţťŧùúûũūŭůűųŵýÿŷźżž"
_STROKED = {"đ": "d", "ħ": "h", "ı": "i", "ł": "l", "ø": "o", "ŧ": "t"}
PLAIN = "".join(_STROKED.get(c) or unicodedata.normalize("NFD", c)[0] for c in ACCENTED)
EXPANDED = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ð", "d")]


def tokens(text: Column, extra: list[str] | None = None) -> Column:
    """Words of a text in order, lower-cased; ``extra`` words (like c++ or med.) count as words where they stand.

    A longer extra word goes before a shorter one and before the plain word it begins with.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    if not extra:
        return F.regexp_extract_all(low, F.lit(TOKEN), 0)
    quote = lambda w: "".join(c if c.isalnum() or c == "_" else "\\" + c for c in w.lower())
    ordered = sorted({w.lower() for w in extra if w}, key=lambda w: (-len(w), w))
    return F.regexp_extract_all(low, F.lit(r"(?<![\p{L}\p{N}_])(?:" + "|".join(map(quote, ordered)) + r")(?![\p{L}\p{N}_])|" + TOKEN), 0)


def normalise(c: Column) -> Column:
    """Lower case, accents off, ligatures and umlauts spelled out."""
    out = F.lower(c)
    for a, b in EXPANDED:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, ACCENTED, PLAIN)


def normal_form(word: str) -> str:
    """``normalise`` for a word of a query."""
    word = word.lower()
    for a, b in EXPANDED:
        word = word.replace(a, b)
    return word.translate(str.maketrans(ACCENTED, PLAIN))


def underscored(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def keep_alphanumeric(c: Column, keep: str = "") -> Column:
    """Everything but letters, digits and ``keep`` becomes a space."""
    inner = "".join("\\" + x if not x.isalnum() else x for x in keep)
    return F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}{inner}]", " ")


_DATES = [(r"^\s*(\d{1,2})[.\-](\d{1,2})[.\-](\d{4})\s*$", 1, 2, 3), (r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})\s*$", 3, 2, 1)]


def _date(c: Column) -> Column:
    found = []
    for pattern, d, m, y in _DATES:
        part = lambda k, p=pattern: F.regexp_extract(c, p, k)
        found.append(F.when(c.rlike(pattern), F.try_to_timestamp(F.concat_ws("-", part(y), F.lpad(part(m), 2, "0"), F.lpad(part(d), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")))
    return F.coalesce(*found)


def convert_date(c: Column) -> Column:
    """d.m.yyyy, d-m-yyyy or yyyy-m-d as dd-mm-yyyy; the empty string for anything else."""
    return F.coalesce(F.date_format(_date(c), "dd-MM-yyyy"), F.lit(""))


def date_token(c: Column) -> Column:
    return F.coalesce(F.date_format(_date(c), "yyyyMMdd"), F.lit(""))


def number_token(c: Column, before: int, after: int) -> Column:
    """Digits before the point, zero-padded to ``before``, and after it, cut or padded to ``after``: sorts as the number does.

    The point is the first dot, or the first comma where there is no dot. A value with more than ``before`` digits
    before it is an error, as no token of that width could sort it.
    """
    digits = F.regexp_replace(c, r"[^0-9,.]", "")
    dotted = digits.contains(".")
    plain = lambda part: F.regexp_replace(part, "[,.]", "")
    whole = plain(F.when(dotted, F.substring_index(digits, ".", 1)).otherwise(F.substring_index(digits, ",", 1)))
    part = plain(F.when(dotted, F.regexp_extract(digits, r"^[^.]*\.(.*)$", 1)).otherwise(F.regexp_extract(digits, r"^[^,]*,(.*)$", 1)))
    fits = F.when(F.char_length(whole) <= before, F.lpad(whole, before, "0"))
    whole = F.when(c.isNotNull(), F.coalesce(fits, F.raise_error(F.concat(F.lit(f"more than {before} digits before the point: "), c))))
    return F.concat(whole, F.rpad(part, after, "0")) if after else whole


def ordering_token(c: Column, rule: str) -> Column:
    """rule: date, literal, or f:<before>.<after>."""
    if rule == "date":
        return date_token(c)
    if rule == "literal":
        return c
    before, _, after = rule.removeprefix("f:").partition(".")
    return number_token(c, int(before), int(after or 0))


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_json(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cdata(c: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(c, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def url_encode(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def mask(c: Column, special: str) -> Column:
    """Each character of ``special`` as %hh."""
    for x in ["%", *(y for y in special if y != "%")]:
        c = F.replace(c, F.lit(x), F.lit(f"%{ord(x):02X}"))
    return c


def unmask(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def transcode(binary: Column, charset: str = "ISO-8859-1") -> Column:
    return F.decode(binary, charset)


def picked_part(c: Column, delimiter: str, part: int) -> Column:
    """Part ``part`` (from 1) of an info field."""
    return F.split_part(c, F.lit(delimiter), F.lit(part))


def info_json(fields: dict[str, Column]) -> Column:
    """Shown fields as one JSON object; array columns become lists."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def info_xml(fields: dict[str, Column]) -> Column:
    return F.concat(*[F.concat(F.lit(f"<{n}>"), escape_xml(F.coalesce(c, F.lit(""))), F.lit(f"</{n}>")) for n, c in fields.items()])
