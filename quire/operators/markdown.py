"""Markdown from blocks and back, inline styles, escaping, and print-ready HTML."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import bound, trim

#: Stretches in which signs of emphasis are not escaped: images, targets of safe links, formulas (fixed values).
_KEPT = re.compile(r"!\[[^\]]*\]\([^)\n]*\)|\]\((?:https?:|mailto:|tel:|#)[^)\n]*\)|\$\$[^$]*\$\$|\$[^$\n]*\$", re.I)


def escape_gfm(text: str) -> str:
    """Backslashes before ~ * _ and back quotes, but for images, links and formulas."""
    out, at = [], 0
    for m in [*_KEPT.finditer(text), None]:
        out.append(re.sub(r"[~*_`]", r"\\\g<0>", text[at : m.start() if m else len(text)]))
        if m:
            out.append(m[0])
            at = m.end()
    return "".join(out)


def span_markdown(spans: list[dict]) -> str:
    """Styled stretches with their marks: white space stays outside of them, code isn't escaped, underlines are outermost."""
    out = []
    for s in spans:
        text = s.get("text") or ""
        code = bool(s.get("code"))
        mark = "`" if code else "*" * (2 * bool(s.get("bold")) + bool(s.get("italic")))
        if s.get("strike") and not code:
            mark = "~~" + mark
        line = bool(s.get("underline")) and not code
        core = text.strip()
        if not core or not (mark or line):
            out.append(text if not core else escape_gfm(text))
            continue
        lead, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
        inner = mark + (core if code else escape_gfm(core)) + mark[::-1]
        out.append(lead + (f"<u>{inner}</u>" if line else inner) + tail)
    return "".join(out)


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*(\S*)")
_ITEM = re.compile(r"([ \t]*)([-*+]|[0-9]{1,9}[.)])\s+(.*)")
_RULE = re.compile(r" {0,3}([-*_])(?:\s*\1){2,}\s*")
_TABLE_RULE = re.compile(r"\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?")

BLOCK = "array<struct<block_id:int,type:string,text:string,level:int,list_depth:int,ordered:boolean,lang:string>>"


def _depth(indent: str, stack: list[int]) -> int:
    """List depth by the indents of the items above; a tab counts as two blanks."""
    width = len(indent.replace("\t", "  "))
    while stack and stack[-1] >= width:
        stack.pop()
    stack.append(width)
    return len(stack) - 1


#: Closes a displayed formula, unless it is escaped.
_CLOSING = re.compile(r"(?<!\\)\$\$")


def _displayed(lines: list[str], i: int) -> tuple[str, str, int] | None:
    """The formula that opens in line i, what follows its closing mark, and the line of that; None if a blank line, a fence or the end comes first."""
    parts: list[str] = []
    for k in range(i, len(lines)):
        own = lines[k] if k > i else lines[k].lstrip()[2:]
        if k > i and (not own.strip() or re.match(r"\s*(?:`{3,}|~{3,})", own)):
            return None
        if end := _CLOSING.search(own):
            parts.append(own[: end.start()])
            return "\n".join(x.rstrip() for x in parts if x.strip()).strip(), own[end.end() :].strip(), k
        parts.append(own)
    return None


def parse_blocks(text: str | None) -> list[dict]:
    """Headings, paragraphs, lists, quotes, rules, code, formulas and tables (pipes or HTML) of a markdown text, line by line."""
    lines, out, para, stack, i = re.split(r"\r\n?|\n", text or ""), [], [], [], 0

    def add(kind: str, body: str | None, level: int | None = None, depth: int | None = None, ordered: bool | None = None, lang: str | None = None) -> None:
        out.append({"block_id": len(out), "type": kind, "text": body, "level": level, "list_depth": depth, "ordered": ordered, "lang": lang})

    def close() -> None:
        if para:
            add("paragraph", " ".join(para))
            para.clear()

    def upto(stop: re.Pattern, start: int) -> int:
        return next((k for k in range(start, len(lines)) if stop.fullmatch(lines[k])), len(lines))

    while i < len(lines):
        line, bare = lines[i], lines[i].strip()
        fence = _FENCE.match(line)
        if fence:
            close()
            end = upto(re.compile(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*"), i + 1)
            add("code_block", "\n".join(lines[i + 1 : end]), lang=fence[2] or None)
            i = end
        elif bare.startswith("$$") and (shown := _displayed(lines, i)):
            close()
            formula, rest, i = shown
            if formula:
                add("equation", formula)
            if rest:
                add("paragraph", rest)
        elif m := re.fullmatch(r" {0,3}(#{1,6})\s+(.*?)(?:\s+#+)?\s*", line):
            close()
            stack.clear()
            add("heading", m[2], len(m[1]))
        elif _RULE.fullmatch(line):
            close()
            add("separator", None)
        elif re.match(r"<table\b", bare, re.I):
            close()
            end, nest, body = i, 0, []
            while end < len(lines):
                body.append(lines[end])
                nest += len(re.findall(r"<table\b", lines[end], re.I)) - len(re.findall(r"</table>", lines[end], re.I))
                if nest <= 0:
                    break
                end += 1
            if nest == 0:
                add("html_table", "\n".join(body))
                i = end
            else:  # never closed: plain text
                para.append(bare)
        elif bare.startswith("|") and i + 1 < len(lines) and _TABLE_RULE.fullmatch(lines[i + 1].strip()) and "-" in lines[i + 1]:
            close()
            end = next((k for k in range(i, len(lines)) if not lines[k].strip().startswith("|")), len(lines))
            add("table", "\n".join(x.strip() for x in lines[i:end]))
            i = end - 1
        elif bare.startswith(">"):
            close()
            end = next((k for k in range(i, len(lines)) if not lines[k].strip().startswith(">")), len(lines))
            add("blockquote", "\n".join(x.strip()[1:].strip() for x in lines[i:end]))
            i = end - 1
        elif m := _ITEM.fullmatch(line):
            close()
            add("list_item", m[3], depth=_depth(m[1], stack), ordered=m[2][0].isdigit())
        elif not bare:
            close()
        else:
            if not para and not line.startswith((" ", "\t")):
                stack.clear()
            para.append(bare)
        i += 1
    close()
    return out


def parsed_blocks(texts: DataFrame, keys: list[str], text: str | Column = "text") -> DataFrame:
    """(keys, block_id, type, text, level, list_depth, ordered, lang)."""

    def run(column: pd.Series) -> pd.Series:
        return column.map(parse_blocks)

    return texts.select(*keys, F.explode(F.pandas_udf(run, BLOCK)(text)).alias("b")).select(*keys, "b.*")


_INLINE = re.compile(r"\\(?P<esc>[\\`*_{}\[\]()#+\-.!~|>])|!\[(?P<alt>[^\]]*)\]\([^)]*\)|\[(?P<label>[^\]]*)\]\((?P<href>[^)\s]*)\)|`(?P<code>[^`]+)`|</?u>|~~|(?P<mark>\*{1,3}|(?<![0-9A-Za-z])_{1,3}|_{1,3}(?![0-9A-Za-z]))")


def inline_spans(text: str | None) -> list[dict]:
    """Stretches of a line with their styles (text, bold, italic, code, href); marks that don't close stay text."""
    tokens, at = [], 0
    for m in _INLINE.finditer(text or ""):
        tokens += [("text", text[at : m.start()])] if m.start() > at else []
        at = m.end()
        if m["mark"]:
            tokens.append(("mark", m[0]))
        elif m["code"] is not None:
            tokens.append(("code", m["code"]))
        elif m["href"] is not None:
            tokens.append(("link", (m["label"], m["href"])))
        else:
            tokens.append(("text", m["esc"] or m["alt"] or ""))
    tokens += [("text", (text or "")[at:])]
    closes, waiting = {}, {}
    for k, (kind, value) in enumerate(tokens):
        if kind == "mark":
            if value in waiting:
                closes[k] = closes[waiting.pop(value)] = True
            else:
                waiting[value] = k
                closes[k] = False
    out, bold, italic = [], False, False
    for k, (kind, value) in enumerate(tokens):
        if kind == "mark" and closes[k]:
            bold, italic = bold ^ (len(value) >= 2), italic ^ (len(value) % 2 == 1)
            continue
        body = value[0] if kind == "link" else value
        span = {"text": body, "bold": bold, "italic": italic, "code": kind == "code", "href": value[1] if kind == "link" else None}
        if body and out and all(out[-1][x] == span[x] for x in ("bold", "italic", "code", "href")):
            out[-1]["text"] += body
        elif body:
            out.append(span)
    return out


#: Page styles of the print view (fixed values).
STYLES = {
    "default": "body{font-family:sans-serif;line-height:1.6;margin:2cm}table{border-collapse:collapse}td,th{border:1px solid #999;padding:4px 8px}",
    "official": "body{font-family:serif;font-size:15pt;line-height:1.8;margin:20mm 20mm 15mm}table{border-collapse:collapse;width:100%}td,th{border:1px solid #000;padding:3px 6px}",
    "compact": "body{font-family:sans-serif;font-size:9pt;line-height:1.3;margin:1cm}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:1px 4px}",
}


def _inline_html(text: str) -> str:
    out = []
    for s in inline_spans(text):
        body = html.escape(s["text"], quote=False)
        for tag in [t for t, on in (("code", s["code"]), ("em", s["italic"]), ("strong", s["bold"])) if on]:
            body = f"<{tag}>{body}</{tag}>"
        safe = s["href"] and re.match(r"(?:https?:|mailto:|tel:|#)", s["href"], re.I)
        out.append(f'<a href="{html.escape(s["href"])}">{body}</a>' if safe else body)
    return "".join(out)


def render_html(text: str | None, style: str = "default", watermark: str | None = None) -> str:
    """A markdown text as a web page of its own."""
    parts, open_ = [], []

    def lists(depth: int, tag: str | None) -> None:
        while open_ and (len(open_) > depth + 1 or (len(open_) == depth + 1 and tag != open_[-1])):
            parts.append(f"</{open_.pop()}>")
        while tag and len(open_) <= depth:
            open_.append(tag)
            parts.append(f"<{tag}>")

    for b in parse_blocks(text):
        kind, body = b["type"], b["text"] or ""
        if kind == "list_item":
            lists(b["list_depth"], "ol" if b["ordered"] else "ul")
            parts.append(f"<li>{_inline_html(body)}</li>")
            continue
        lists(-1, None)
        if kind == "heading":
            parts.append(f"<h{b['level']}>{_inline_html(body)}</h{b['level']}>")
        elif kind == "table":
            rows = [[c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", r.strip().removeprefix("|").removesuffix("|"))] for k, r in enumerate(body.split("\n")) if k != 1]
            cells = ["".join(f"<{t}>{_inline_html(c)}</{t}>" for c in row for t in ("th" if k == 0 else "td",)) for k, row in enumerate(rows)]
            parts.append("<table>" + "".join(f"<tr>{c}</tr>" for c in cells) + "</table>")
        elif kind == "html_table":
            parts.append(re.sub(r"(?is)<(script|style|iframe)\b.*?(?:</\1>|$)|\son\w+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", body))
        else:
            tag = {"blockquote": "blockquote", "code_block": "pre", "equation": "pre"}.get(kind, "p")
            parts.append("<hr>" if kind == "separator" else f"<{tag}>{html.escape(body, quote=False) if tag == 'pre' else _inline_html(body)}</{tag}>")
    lists(-1, None)
    mark = f'<div class="watermark">{html.escape(watermark)}</div>' if watermark else ""
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><style>{STYLES[style]}</style></head><body>{mark}{"".join(parts)}</body></html>'


def rendered_html(text: str | Column, style: str = "default", watermark: str | None = None) -> Column:
    """render_html() of a column."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: render_html(t, style, watermark))

    return F.pandas_udf(run, "string")(text)


def clean_page_text(text: Column) -> Column:
    """A page's text without control characters, page numbers and rows of blank lines."""
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{80}-\x{9F}]", "")
    for pattern, by in (
        (r"\A\d{1,4}\n", ""), (r"(?m)^\s*[-–—]\s*[-–—]?\d+[-–—]?\s*[-–—]?\s*$", ""), (r"(?m)^\s*\d+\s*/\s*\d+\s*$", ""), (r"\n\d{1,4}\n", "\n"), (r"\n\d{1,4}\z", ""),
        (r"(?m)^#{1,6}[ \t]*\d{1,4}[ \t]*$", ""), (r"\\~\\~", "~~"), ("~~~~", ""), (r"<u>\s*</u>", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+\z", ""),
    ):
        text = F.regexp_replace(text, pattern, by)
    return text


_LINES, _NOTE = r"\r\n?|\n", r"^\[\^([^\]\s]+)\]:\s?(.*)$"


def footnotes(text: Column) -> Column:
    """The definitions of footnotes, one a line, as an array of (label, text); of several with one label the last. Null gives null."""
    found = F.transform(F.filter(F.split(text, _LINES), lambda x: x.rlike(_NOTE)), lambda x: F.struct(F.regexp_extract(x, _NOTE, 1).alias("label"), trim(F.regexp_extract(x, _NOTE, 2)).alias("text")))
    return bound(found, lambda notes: F.filter(notes, lambda note, i: ~F.exists(F.slice(notes, i + 2, F.greatest(F.size(notes), F.lit(1))), lambda later: later["label"] == note["label"])))


def without_footnotes(text: Column) -> Column:
    """The text without lines that define footnotes, with plain line ends; as it is if there are none."""
    lines = F.split(text, _LINES)
    kept = F.filter(lines, lambda x: ~x.rlike(_NOTE))
    return F.when(F.size(kept) < F.size(lines), F.array_join(kept, "\n")).otherwise(text)


#: An image, its target without blanks (fixed pattern).
_IMAGE = r"!\[[^\]]*\]\(([^)\s]+)\)"


def image_targets(text: Column) -> Column:
    """The targets of a text's images, in order."""
    return F.regexp_extract_all(text, F.lit(_IMAGE), 1)


def without_images(text: Column) -> Column:
    """The text without its images."""
    return F.regexp_replace(text, _IMAGE, "")
