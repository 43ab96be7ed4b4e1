"""Text rules of feed records as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What is trimmed off every field, limits, and the grammar of prices and stock.
TRIMMED = " \t\n\r\0\x0b"
MAX_NAME, MAX_BRAND, MAX_CATEGORY, MAX_FEATURE = 128, 64, 128, 255
MAX_URL_BYTES, MAX_LOCATION, MAX_DEPTH = 16384, 4096, 32
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
PRICE = r"^\d{1,10}(\.\d{1,9})?$"
STOCK, MOST_STOCK = r"^[+-]?\d+$", 2147483647
ALLOWED_TAGS = ("p", "br", "strong", "b", "em", "i", "ul", "ol", "li", "div", "span", "table", "thead", "tbody", "tr", "th", "td")
MASKED_KEYS, MASK, MOST_LOG = ("AccessKey", "password", "authorization"), "***", 1200
ALLOWED_ATTRIBUTES = ("class", "colspan", "rowspan", "align")


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIMMED))


def bounded(c: Column, most: int) -> Column:
    """Trimmed text is present, of at most so many characters, and without < > { }."""
    t = trim(F.coalesce(c, F.lit("")))
    return (t != "") & (F.char_length(t) <= most) & catalog_text(t)


def catalog_text(c: Column) -> Column:
    return c.rlike(r"^[^<>{}]*$")


def slug(c: Column) -> Column:
    """Lower-case letters and digits with dashes between; a digest where nothing is left or where it is too long."""
    s = F.btrim(F.regexp_replace(F.lower(trim(c)), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))
    digest = F.substring(F.sha2(trim(c), 256), 1, 32)
    return F.when(s == "", F.concat(F.lit("hash-"), digest)).when(F.char_length(s) > 160, F.concat(F.substring(s, 1, 120), F.lit("-"), digest)).otherwise(s)


def segment(c: Column) -> Column:
    """The normal form in which category segments are compared."""
    bare = trim(F.ltrim(trim(c), F.lit("@")))
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "), r"\s+", " "))


def path_parts(c: Column, separator: str = "/+") -> Column:
    return F.filter(F.transform(F.split(trim(c), separator), trim), lambda p: p != "")


def path(c: Column) -> Column:
    """Segments joined by ' > '."""
    return F.array_join(path_parts(c), " > ")


def path_is_sound(c: Column) -> Column:
    parts = path_parts(c)
    return (F.size(parts) <= MAX_DEPTH) & F.forall(parts, lambda p: catalog_text(p) & (F.char_length(p) <= MAX_CATEGORY))


def path_key(c: Column) -> Column:
    """A ' > ' path as it is compared: segments in normal form, empty ones gone."""
    parts = F.filter(F.transform(F.split(trim(c), r"\s*>\s*"), lambda p: trim(F.ltrim(trim(p), F.lit("@")))), lambda p: p != "")
    return F.array_join(F.transform(parts, segment), " > ")


def size_descriptor(c: Column, prefix: str = "size") -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.lower(F.regexp_replace(trim(c), r"\s+", " ")))


def stock(c: Column) -> Column:
    """A whole number of at most 2147483647, negative as 0; null where it isn't one."""
    digits = F.coalesce(F.nullif(F.ltrim(F.regexp_replace(trim(c), "^[+-]", ""), F.lit("0")), F.lit("")), F.lit("0"))
    small = (F.char_length(digits) < 10) | ((F.char_length(digits) == 10) & (digits <= str(MOST_STOCK)))
    value = F.when(trim(c).startswith("-"), F.lit(0)).otherwise(F.when(small, digits).cast("int"))
    return F.when(trim(c).rlike(STOCK) & small, value)


def stock_was_negative(c: Column) -> Column:
    return trim(c).rlike(r"^-0*[1-9]\d*$")


def price(c: Column) -> Column:
    """A price of at least 0 whose shortest form in 14 significant digits has up to 10 digits, and up to 9 after the point."""
    number = F.when(trim(c).rlike(NUMBER), trim(c).try_cast("double"))
    # 14 significant digits: as many after the point as the whole part leaves. Below 1e-4 and from 1e15 the form has an exponent.
    whole = F.floor(F.log10(F.when(number > 0, number).otherwise(F.lit(1.0)))).cast("int")
    places = F.least(F.greatest(13 - whole, F.lit(0)), F.lit(18))
    exact = number.cast("decimal(38,18)")
    rounded = F.coalesce(*(F.when(places == k, F.round(exact, k).cast("string")) for k in range(3, 19)))
    digits = F.regexp_replace(F.when(rounded.contains("."), F.regexp_replace(rounded, "0+$", "")).otherwise(rounded), r"\.$", "")
    ok = (number >= 0) & (number < 1e10) & ((number == 0) | (number >= 1e-4)) & digits.rlike(PRICE)
    return F.when(ok, number)


def ean(c: Column) -> Column:
    """13 digits, else blank."""
    return F.when(trim(c).rlike(r"^\d{13}$"), trim(c)).otherwise(F.lit(""))


def url_is_sound(c: Column) -> Column:
    """Of bounded length, http or https, without user information."""
    t = trim(c)
    return (F.octet_length(t) <= MAX_URL_BYTES) & t.rlike(r"^(?i:https?)://[^/?#@\s]+([/?#]\S*)?$")


def location_is_sound(c: Column) -> Column:
    """A feed's place: a path, or an address without credentials; bounded, not empty."""
    t = trim(c)
    return (t != "") & (F.char_length(t) <= MAX_LOCATION) & ~t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@") & (~t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://") | t.rlike("^(?i:https?)://"))


def _without_login(line: Column) -> Column:
    """Addresses of any scheme, with name and password masked: what stands between the scheme and the last @ before the path."""

    def mask(piece, k):
        authority = F.substring_index(F.substring_index(F.substring_index(F.substring_index(piece, "/", 1), "?", 1), "#", 1), " ", 1)
        host = F.substring_index(authority, "@", -1)
        login = F.substring(authority, F.lit(1), F.char_length(authority) - F.char_length(host))
        rest = F.substring(piece, F.char_length(login) + 1, F.char_length(piece))
        return F.when((k > 0) & login.contains(":"), F.concat(F.lit(f"{MASK}:{MASK}@"), rest)).otherwise(piece)

    return F.array_join(F.transform(F.split(line, "://"), mask), "://")


def _without_values(line: Column) -> Column:
    """What is assigned to one of the keys is masked. The line is gone through from sign to sign; a value runs to the next space, comma or semicolon,
    even past further signs."""
    signs, ends = "(?=[=:])", "[ ,;]"
    begin = F.struct(F.lit("").alias("done"), F.lit(False).alias("within"))

    def step(state, piece):
        told = F.lower(F.rtrim(state["done"]))
        names = F.lit(False)
        for key in MASKED_KEYS:
            names = names | told.endswith(key.lower())
        assigned = names & (piece.startswith("=") | piece.startswith(":"))
        value = F.when(state["within"], piece).otherwise(F.ltrim(F.substring(piece, F.lit(2), F.char_length(piece))))
        kept = F.char_length(F.split(value, ends, 2)[0])
        rest = F.substring(value, kept + 1, F.char_length(value))
        open_still = kept == F.char_length(value)
        done = F.when(state["within"], F.concat(state["done"], rest)).when(assigned, F.concat(F.rtrim(state["done"]), F.lit(f"={MASK}"), rest)).otherwise(F.concat(state["done"], piece))
        return F.struct(done.alias("done"), ((state["within"] | assigned) & open_still).alias("within"))

    return F.aggregate(F.split(line, signs), begin, step)["done"]


def redact(c: Column) -> Column:
    """Log text with credentials masked, white space collapsed, cut to MOST_LOG characters."""
    one_line = F.array_join(F.filter(F.split(trim(c), r"\s"), lambda w: w != ""), " ")
    return F.substring(_without_values(_without_login(one_line)), 1, MOST_LOG)


class _Sanitiser(HTMLParser):
    """Keeps allowed tags and attributes and all text; unwraps other tags and drops comments."""

    EMPTY = ("br",)

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ALLOWED_TAGS:
            kept = "".join(f' {k}="{(v or "").replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in attrs if k in ALLOWED_ATTRIBUTES)
            self.out.append(f"<{tag}{kept}>")
            if tag not in self.EMPTY:
                self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ALLOWED_TAGS and tag not in self.EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while (last := self.open.pop()) != tag:
                self.out.append(f"</{last}>")
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        self.out.append(data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))

    def result(self) -> str:
        self.close()
        while self.open:
            self.out.append(f"</{self.open.pop()}>")
        return "".join(self.out).strip()


def sanitise_one(html: str | None) -> str:
    p = _Sanitiser()
    p.feed((html or "").strip())
    return p.result()


def sanitise_html() -> Callable[[Column], Column]:
    """No built-in parses HTML: an Arrow-batched function does, batch by batch."""

    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return html.map(sanitise_one)

    return run
