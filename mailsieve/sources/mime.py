"""MIME structure and charsets as column functions (M3, M4).

A message is text of one char a byte.  Its leaf parts are found by a fold over the lines that begin with ``--``: the state is
the stack of open boundaries, the piece at which the open part began, and the places of the
finished parts.  A line is a delimiter only if it names an open boundary; a boundary is opened
only by the header block of a multipart part (or of the message that a message/rfc822 part holds).  So nothing that a body says can cut
it, and no mark is put into the text.  The fold carries numbers, not text: its work is linear in the lines.

Charsets: UTF-8, UTF-16 and every one-byte charset of the standard codecs, whose upper halves are tables made
from the codecs.  Any other charset is read as UTF-8.  Bytes without a meaning become U+FFFD.

Parameters: plain, quoted, RFC 2231 (``name*=charset''text``) and in numbered pieces.
"""

from __future__ import annotations

from encodings.aliases import aliases

from pyspark.sql import Column
from pyspark.sql import functions as F

#: codecs of one byte a char whose lower half is ASCII
_CODECS = ("latin_1", "ptcp154", "koi8_r", "koi8_u", "koi8_t", "kz1048", "mac_roman", "mac_cyrillic", "mac_greek", "mac_latin2", "mac_turkish", "tis_620",
           *(f"cp{n}" for n in (437, 720, 737, 775, 850, 852, 855, 857, 858, 860, 861, 862, 863, 864, 865, 866, 869, 874, 1125, *range(1250, 1259))),
           *(f"iso8859_{n}" for n in range(2, 17) if n != 12))
HIGH = bytes(range(128, 256)).decode("latin_1")
_UTF16 = ("utf-16", "utf-16le", "utf-16be", "utf16", "unicode")


def _tables() -> dict[str, str]:
    """The upper half of every one-byte charset, by each of its names (lower case, ``-`` for ``_``)."""
    halves = {c: bytes(range(128, 256)).decode(c, "replace") for c in _CODECS}
    names = {c: c for c in _CODECS} | {name: c for name, c in aliases.items() if c in halves}
    # names that mail uses and the codecs leave to their own normalising
    names |= {f"{before}{c[2:]}": c for c in _CODECS if c.startswith("cp") for before in ("windows-", "x-cp", "ibm-", "cp-")}
    names |= {f"iso-8859-{c[8:]}": c for c in _CODECS if c.startswith("iso8859_")} | {"iso-8859-1": "latin_1", "latin-1": "latin_1", "tis-620": "tis_620"}
    return {name.lower().replace("_", "-"): halves[c] for name, c in names.items()}


TABLES = _tables()


def utf8(raw: Column) -> Column:
    """Bytes as text; invalid sequences become the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (and stands once in the plan)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _utf16(digits: Column, name: Column) -> Column:
    """UTF-16 (hex digits) with or without byte order mark, little-endian where nothing tells; lone surrogates and half units become U+FFFD."""
    big = F.startswith(digits, F.lit("FEFF")) | ((name == "utf-16be") & ~F.startswith(digits, F.lit("FFFE")))
    order = F.when(big, F.lit("$1$2 ")).otherwise(F.lit("$2$1 "))
    units = F.regexp_replace(F.regexp_extract(digits, "^((?:....)*)", 1), F.lit("(..)(..)"), order)
    units = F.regexp_replace(F.regexp_replace(units, "^FEFF ", ""), r"D[89AB]..(?! D[C-F])", "FFFD")
    units = F.regexp_replace(units, r"(?<!D[89AB].. )D[C-F]..", "FFFD")
    odd = F.when(F.length(digits) % 4 != 0, F.lit("\ufffd")).otherwise(F.lit(""))
    return F.concat(F.decode(F.unhex(F.replace(units, F.lit(" "), F.lit(""))), "UTF-16BE"), odd)


def decode(raw: Column, charset: Column) -> Column:
    """Bytes of a charset as text."""
    # two literals, so that the map is made once, when the plan is
    tables = F.map_from_arrays(F.split(F.lit(",".join(TABLES)), ","), F.split(F.lit("\n".join(TABLES.values())), "\n"))

    def of(x: Column) -> Column:
        high = F.call_function("translate", F.decode(x["raw"], "ISO-8859-1"), F.lit(HIGH), x["table"])
        return F.when(x["table"].isNotNull(), high).when(x["name"].isin(*_UTF16), _utf16(F.hex(x["raw"]), x["name"])).otherwise(utf8(x["raw"]))

    name = F.translate(F.lower(F.coalesce(charset, F.lit(""))), "_", "-")
    known = let(F.struct(raw.alias("raw"), name.alias("name")), lambda x: F.struct(
        x["raw"].alias("raw"), x["name"].alias("name"), F.when(~x["name"].isin("", "utf-8", "us-ascii"), F.element_at(tables, x["name"])).alias("table")))
    return let(known, of)


def percent_bytes(text: Column) -> Column:
    """Bytes of text with %XX escapes (one char a byte)."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)%[0-9A-Fa-f]{2}|."), F.lit(0))
    return F.unhex(F.array_join(F.transform(tokens, lambda t: F.when(F.length(t) == 3, F.substring(t, 2, 2)).otherwise(
        F.hex(F.encode(t, "ISO-8859-1")))), ""))


def parameter(block: Column, header_name: str, name: str) -> Column:
    """A parameter of a header in an unfolded block: (charset, text of one char a byte); null where it is missing.

    The charset is null unless RFC 2231 gives it.
    """
    form = rf'(?i);\s*{name}(\*\d+)?(\*?)=("[^"\n]*"|[^\s;"]+)'
    coded = r"^([^']*)'[^']*'(.*)$"

    def whole(x: Column) -> Column:
        """From (place, star, text) of the pieces, in order of their places."""
        value = F.array_join(F.transform(x, lambda p: p["text"]), "")
        charset = F.regexp_extract(value, coded, 1)
        decoded = F.struct(charset.alias("charset"), F.decode(percent_bytes(F.regexp_extract(value, coded, 2)), "ISO-8859-1").alias("text"))
        plain = F.struct(F.lit(None).cast("string").alias("charset"), value.alias("text"))
        return F.when(F.size(x) == 0, F.lit(None)).when((x[0]["star"] != "") & value.rlike(coded), decoded).otherwise(plain)

    def pieces(line: Column) -> Column:
        place, star, text = (F.regexp_extract_all(line, F.lit(form), F.lit(k)) for k in (1, 2, 3))
        each = F.zip_with(F.zip_with(place, star, lambda p, s: F.struct(p.alias("p"), s.alias("s"))), text, lambda x, t: F.struct(
            F.coalesce(F.substring(x["p"], 2, 9).try_cast("int"), F.lit(-1)).alias("place"), x["s"].alias("star"), F.translate(t, '"', "").alias("text")))
        # a value in one piece stands for itself
        one = F.filter(each, lambda p: p["place"] == -1)
        return F.when(F.size(one) > 0, F.slice(one, 1, 1)).otherwise(F.array_sort(each))

    return let(let(F.regexp_extract(block, rf"(?im)^{header_name}:([^\n]*)", 1), pieces), whole)


def unfold(block: Column) -> Column:
    return F.regexp_replace(block, r"\n(?=[ \t])", "")


def media_type(block: Column) -> Column:
    """Content type without parameters; text/plain where it is missing or no type."""
    value = F.lower(F.regexp_extract(block, r"(?im)^content-type:\s*([^;\s]+/[^;\s]+)", 1))
    return F.when(value == "", F.lit("text/plain")).otherwise(value)


def head_and_body(part: Column) -> Column:
    """(block: unfolded headers, body) of a part or message that begins with its headers or, without any, with a blank line."""
    bare = F.startswith(part, F.lit("\n"))
    at = F.locate("\n\n", part)
    block = F.when(bare, F.lit("")).when(at > 0, F.substring(part, F.lit(1), at)).otherwise(part)
    body = F.when(bare, F.substring(part, F.lit(2), F.length(part))).when(at > 0, F.substring(part, at + 2, F.length(part))).otherwise(F.lit(""))
    return F.struct(unfold(block).alias("block"), body.alias("body"))


def declared_boundary(part: Column) -> Column:
    """The boundary that a multipart part (or the message inside a message/rfc822 part) declares, else ''."""
    def of(h: Column) -> Column:
        return F.when(F.startswith(media_type(h["block"]), F.lit("multipart/")), F.coalesce(parameter(h["block"], "content-type", "boundary")["text"], F.lit(""))).otherwise(F.lit(""))

    return let(let(head_and_body(part), lambda h: F.when(media_type(h["block"]) == "message/rfc822", head_and_body(h["body"])).otherwise(h)), of)


def leaf_parts(message: Column, boundary: Column) -> Column:
    """Texts (headers, blank line, body) of the leaf parts between the delimiters of ``boundary`` and of those opened inside."""
    pieces = F.split(F.concat(F.lit("\n"), message), "\n--", -1)

    def place(piece: Column) -> Column:
        line = F.regexp_extract(piece, r"^([^\n]*?)[ \t]*(?:\n|$)", 1)
        rest = F.regexp_replace(piece, r"^[^\n]*\n?", "")
        return F.struct(line.alias("line"), declared_boundary(rest).alias("opens"))

    start = F.struct(F.lit(0).alias("i"), F.array(boundary).alias("stack"), F.lit(0).alias("begin"),
                     F.array().cast("array<struct<first:int,n:int>>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        i = s["i"] + 1
        same = F.array_position(s["stack"], x["line"]).cast("int")
        last = F.when((same == 0) & F.endswith(x["line"], F.lit("--")), F.array_position(
            s["stack"], F.substring(x["line"], F.lit(1), F.length(x["line"]) - 2)).cast("int")).otherwise(F.lit(0))
        done = F.when(s["begin"] > 0, F.concat(s["parts"], F.array(F.struct(s["begin"].alias("first"), (i - s["begin"]).alias("n"))))).otherwise(s["parts"])
        inner = F.slice(s["stack"], F.lit(1), F.when(last > 0, last - 1).otherwise(same))
        opened = (same > 0) & (x["opens"] != "")
        stack = F.when(opened, F.concat(inner, F.array(x["opens"]))).otherwise(inner)
        begin = F.when((same > 0) & ~opened, i).otherwise(F.lit(0))
        hit = (same > 0) | (last > 0)
        return F.struct(i.alias("i"), F.when(hit, stack).otherwise(s["stack"]).alias("stack"), F.when(hit, begin).otherwise(s["begin"]).alias("begin"),
                        F.when(hit, done).otherwise(s["parts"]).alias("parts"))

    def finish(s: Column) -> Column:
        return F.when(s["begin"] > 0, F.concat(s["parts"], F.array(F.struct(s["begin"].alias("first"), (s["i"] + 1 - s["begin"]).alias("n"))))).otherwise(s["parts"])

    def cut(p: Column) -> Column:
        found = F.aggregate(F.transform(F.slice(p, F.lit(2), F.size(p)), place), start, step, finish)
        return F.transform(found, lambda x: F.regexp_replace(F.array_join(F.slice(p, x["first"] + 1, x["n"]), "\n--"), r"^[^\n]*\n?", ""))

    return let(pieces, cut)
