"""Text-to-field column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from imagora.functions import vector as vx

# Patterns that decide what counts as a fence, a header, a sentence.
FENCE = r"(?s)```[a-zA-Z0-9_+-]*\n(.*?)```"
FRONTMATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
OUTER_WRAP = r"(?s)\A```[a-zA-Z0-9_+-]*\s*\n(.*)\n```\s*\z"
LINE_BREAK = r"\r\n|\n|\r"
SENTENCE_BREAK = r"[.\n;]+"
MIN_SENTENCE_CHARS = 15
# What Unicode and the C0 separators count as white space.
WHITESPACE = (" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
              "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# most characters are told apart by the first range alone
SPACES = f"[[^!-~]&&[{WHITESPACE}]]+"

# The offline stand-in document.
STAND_IN_NAME = "draft-answer"
STAND_IN_BODY = "Restate what is being asked\nWork it out in small parts"
STAND_IN_CODE = "answer = combine(parts)"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    """Whether a text has nothing but white space; null stays null."""
    return strip(col) == ""


def tokens(col: Column) -> Column:
    """Lower-cased whitespace tokens."""
    return F.array_remove(F.split(F.lower(F.coalesce(col, F.lit(""))), SPACES), "")


def sentences(col: Column, min_chars: int = MIN_SENTENCE_CHARS) -> Column:
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), SENTENCE_BREAK), strip)
    return F.filter(parts, lambda s: F.length(s) >= min_chars)


def code_blocks(content: Column) -> Column:
    """The stripped fenced blocks of a document, newline-joined."""
    blocks = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(FENCE), F.lit(1))
    return strip(F.array_join(F.transform(blocks, strip), "\n"))


def body_without_code(content: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(content, F.lit("")), FENCE, " "))


def meta(name: Column, description: Column) -> Column:
    """``name. description`` when both are present, else whichever one is."""
    n = strip(F.coalesce(name, F.lit("")))
    d = strip(F.coalesce(description, F.lit("")))
    both = F.concat(F.regexp_replace(n, r"\.+\z", ""), F.lit(". "), d)
    return F.when((n != "") & (d != ""), both).otherwise(F.concat(n, d))


def fields(name: Column, description: Column, content: Column) -> Column:
    """STRUCT<meta, body, code> of a library document."""
    return F.struct(
        meta(name, description).alias("meta"),
        body_without_code(content).alias("body"),
        code_blocks(content).alias("code"),
    )


def _header_value(lines: Column, key: str) -> Column:
    """Value of the last ``key: value`` line, null when the key is absent."""
    hits = F.filter(
        lines,
        lambda ln: ln.contains(":") & (F.lower(strip(F.substring_index(ln, ":", 1))) == key),
    )
    last = vx.bind(hits, lambda h: F.get(h, F.size(h) - F.lit(1)))
    return strip(F.regexp_replace(last, r"(?s)\A[^:]*:", ""))


def generated_fields(markdown: Column) -> Column:
    """STRUCT<meta, body, code> of a generated document.

    An outer fence is unwrapped; a leading header gives name and description;
    without a name the first non-blank line takes its place and the remaining
    non-blank lines make up the content.
    """
    def unwrap(text: Column) -> Column:
        return F.when(text.rlike(OUTER_WRAP), F.regexp_extract(text, OUTER_WRAP, 1)).otherwise(text)

    def header_and_rest(doc: Column) -> Column:
        has = doc.rlike(FRONTMATTER)
        header = F.when(has, F.split(F.regexp_extract(doc, FRONTMATTER, 1), LINE_BREAK))
        return F.struct(
            header.alias("header"),
            F.when(has, F.regexp_replace(doc, FRONTMATTER, "")).otherwise(doc).alias("rest"))

    def named(part: Column) -> Column:
        lines = part["header"]
        return F.struct(
            F.coalesce(_header_value(lines, "name"), F.lit("")).alias("name"),
            F.coalesce(_header_value(lines, "description"), F.lit("")).alias("description"),
            part["rest"].alias("rest"))

    def from_lines(lines: Column) -> Column:
        title = F.regexp_replace(strip(F.get(lines, F.lit(0))), r"\A[# ]+", "")
        tail = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), "\n")
        return F.struct(F.coalesce(title, F.lit("")).alias("shown"), tail.alias("content"))

    def titled(part: Column) -> Column:
        lines = F.filter(F.split(part["rest"], LINE_BREAK), lambda ln: strip(ln) != "")
        own = F.struct(part["name"].alias("shown"), part["rest"].alias("content"))
        pick = F.when(part["name"] != "", own).otherwise(vx.bind(lines, from_lines))
        return vx.bind(pick, lambda p: fields(p["shown"], part["description"], p["content"]))

    text = strip(F.coalesce(markdown, F.lit("")))
    return vx.bind(text, lambda t: vx.bind(unwrap(t), lambda d: vx.bind(
        header_and_rest(d), lambda h: vx.bind(named(h), titled))))


def decode_list(value: Column) -> Column:
    """ARRAY<STRING> from a list literal, a quoted or bare scalar, or nothing.

    Text that looks like a list but is not a valid literal is kept whole.
    """
    item = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[+-]?[0-9][0-9_.eE+-]*|None|True|False)"""
    whole = rf"(?s)\A\s*[\[(]\s*(?:{item}(?:\s*,\s*{item})*\s*,?\s*)?[\])]\s*\z"
    quoted = rf"""(?s)\A\s*(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")\s*\z"""
    def unquote(x: Column) -> Column:
        inner = F.regexp_replace(strip(x), r"""(?s)\A['"]|['"]\z""", "")
        return F.when(strip(x).rlike(r"""\A['"]"""),
                      F.regexp_replace(inner, r"\\(.)", "$1")).otherwise(strip(x))
    text = F.coalesce(value, F.lit(""))
    return (
        F.when(strip(text) == "", F.array().cast("array<string>"))
        .when(text.rlike(whole),
              F.transform(F.regexp_extract_all(text, F.lit(item), F.lit(0)), unquote))
        .when(text.rlike(quoted), F.array(unquote(text)))
        .otherwise(F.array(text))
    )


def stand_in_document(query: Column, offset: Column | int = 0, width: int = 120) -> Column:
    """Offline stand-in for a generated document: a fixed form around the task."""
    start = (F.lit(offset) if isinstance(offset, int) else offset) + F.lit(1)
    task = F.substr(strip(query), start.cast("int"), F.lit(width))
    return F.concat(
        F.lit(f"---\nname: {STAND_IN_NAME}\ndescription: "), task,
        F.lit(f"\n---\n{STAND_IN_BODY}\n\n```python\n{STAND_IN_CODE}\n```"),
    )
