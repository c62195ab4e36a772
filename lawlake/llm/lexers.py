"""Token streams of bodies in HTML, Markdown, wiki and LaTeX markup.

A token opens an element (``<`` and its label), closes the innermost one (``>``) or is content: T (text), C (code
block), F (formula). A label is what stands in the markup, the tag with its classes or the marker of the line,
after one letter: H, L, I where the language itself says heading, list or item, B for any other block, whose part
is left to the wrapper of its host. Markup inside texts is resolved: character references and commands become
their characters, links their label; comments, scripts, styles, page titles, notes, anchors and templates vanish.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from html.parser import HTMLParser

Token = tuple[str, str | None]

_BLOCK = r"(?:h[1-6]|p|ul|ol|li|pre|div|body|html|table|math)"
_ESCAPED = re.compile(rf"&lt;/?{_BLOCK}\b", re.I)
_HTML = re.compile(rf"<{_BLOCK}\b[^<>]*>|<!DOCTYPE html", re.I)
_WIKI = re.compile(r"^(={1,6})[^=\n].*?\1[ \t]*$|^\{\{[^{}]+\}\}|\[\[[^\[\]\n]+\]\]|<(?:syntaxhighlight|source|ref)\b|^[*#]+[ ]?\[\[|<math>(?!\s*<)", re.M)
_LATEX = re.compile(r"\\(?:documentclass|(?:sub)*section\*?|chapter\*?|paragraph|begin|item|textbf|emph|href|footnote)\b|\\\(.+?\\\)|\\\[.+?\\\]", re.S)
_MARKDOWN = re.compile(r"^ {0,3}#{1,6}[ \t]+\S|^ {0,3}(?:`{3,}|~{3,})|^[^\s].*\n {0,3}(?:={2,}|-{2,})[ \t]*$|^ {0,3}[-+*][ \t]+\S|^ {0,3}\d{1,9}[.)][ \t]+\S|\]\([^)\s]+\)|^\$\$", re.M)
_COMMENT = re.compile(r"<!--.*?-->", re.S)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def read_body(content: bytes | None, media_type: str | None) -> tuple[str, str]:
    """(kind of markup or "plain", text) of a body; the media type decides only about JSON, the rest is told by the text."""
    text = (content or b"").decode("utf-8", errors="replace").lstrip("﻿")
    if "json" in (media_type or "").lower() or text.lstrip()[:1] == "{" and '"body"' in text:
        try:
            inner = json.loads(text)
            if isinstance(inner, dict) and isinstance(inner.get("body"), str):
                text = inner["body"]
        except ValueError:
            pass
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    bare = _COMMENT.sub("", text)
    if _ESCAPED.search(bare) and not _HTML.search(bare):
        return "html", html.unescape(text)
    if re.search(r"\\(?:documentclass|begin\{|(?:sub)*section)", bare) and not _HTML.search(bare):
        return "latex", text
    if _WIKI.search(bare) and not re.search(r"<(?:h[1-6]|p|ul|ol|li|body)\b", bare, re.I):
        return "wiki", text
    if _HTML.search(bare):
        return "html", text
    if _MARKDOWN.search(bare):
        return "markdown", text
    if _LATEX.search(bare):
        return "latex", text
    return "plain", text


_MATH = re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]|\$\$(.+?)\$\$", re.S)


class _Out:
    """Collects balanced tokens; text is split at formulas."""

    def __init__(self, math: re.Pattern[str] = _MATH, inline=None):
        self.tokens: list[Token] = []
        self.open: list[str] = []
        self.math, self.inline = math, inline or (lambda s: s)

    def text(self, said: str) -> None:
        at = 0
        for m in self.math.finditer(said):
            self._plain(said[at : m.start()])
            self.formula(next(g for g in m.groups() if g is not None))
            at = m.end()
        self._plain(said[at:])

    def _plain(self, said: str) -> None:
        said = self.inline(said)
        if said.strip():
            if self.tokens and self.tokens[-1][0] == "T":
                self.tokens[-1] = ("T", f"{self.tokens[-1][1]} {said}")
            else:
                self.tokens.append(("T", said))

    def formula(self, source: str) -> None:
        if source.strip():
            self.tokens.append(("F", squeeze(source)))

    def code(self, source: str) -> None:
        if source.strip():
            self.tokens.append(("C", squeeze(source)))

    def start(self, letter: str, label: str = "") -> None:
        self.open.append(letter + label)
        self.tokens.append(("<", letter + label))

    def close(self) -> None:
        self.open.pop()
        self.tokens.append((">", None))

    def end(self, letter: str) -> None:
        """Closes the innermost open element of this letter with all in it; ignored if there is none."""
        if any(x[0] == letter for x in self.open):
            while self.open[-1][0] != letter:
                self.close()
            self.close()

    def end_item(self) -> None:
        """Closes the item of the innermost list, if one is open."""
        for x in reversed(self.open):
            if x[0] == "L":
                return
            if x[0] == "I":
                self.end("I")
                return

    def end_block(self, tags: tuple[str, ...]) -> None:
        """Closes the innermost block of one of these tags with all blocks in it, if no list, item or heading is in between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] != "B":
                return
            if self.open[k][1:].partition(".")[0] in tags:
                while len(self.open) > k:
                    self.close()
                return

    def done(self) -> list[Token]:
        while self.open:
            self.close()
        return self.tokens


# Block elements without a part of their own, and those whose start ends one that is open.
BLOCKS = frozenset("p div section article main aside header footer nav figure figcaption blockquote table tr td th dl dt dd".split())
IMPLIED_ENDS = {"p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
DEEPEST_BLOCK = 60  # blocks nested deeper part texts, but are no elements


def _label(tag: str, attrs: list) -> str:
    """The tag with its classes, those with digits aside, which number things."""
    said = next((v for k, v in attrs if k == "class" and v), "")
    return ".".join([tag, *sorted(c for c in said.lower().split() if re.fullmatch("[a-z_-]{1,30}", c))])


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out = _Out()
        self.buffer: list[str] = []
        self.skip: list[str] = []
        self.pre = 0
        self.math: list[str] | None = None
        self.note = False

    def parse_html_declaration(self, i: int) -> int:
        """A declaration that the parser can't read is a comment."""
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def flush(self) -> None:
        said, self.buffer = "".join(self.buffer), []
        self.out.text(said)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skip or self.math is not None:
            if tag == "annotation" and self.math is not None:
                self.math, self.note = [], True
            elif self.skip and tag == self.skip[-1]:
                self.skip.append(tag)
            return
        if tag in ("script", "style", "title", "template", "noscript"):
            self.skip.append(tag)
        elif tag == "math":
            self.flush()
            self.math, self.note = [], False
        elif tag == "pre":
            if not self.pre:
                self.flush()
            self.pre += 1
        elif self.pre:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.out.end("H")
            self.out.end_block(("p",))
            self.out.start("H", _label(tag, attrs))
        elif tag in ("ul", "ol"):
            self.flush()
            self.out.end_block(("p",))
            self.out.start("L", _label(tag, attrs))
        elif tag == "li":
            self.flush()
            if not any(x[0] == "L" for x in self.out.open):
                self.out.start("L", "ul")
            self.out.end_item()
            self.out.start("I", _label(tag, attrs))
        elif tag in BLOCKS and len(self.out.open) < DEEPEST_BLOCK:
            self.flush()
            self.out.end_block(IMPLIED_ENDS.get(tag, ()))
            self.out.start("B", _label(tag, attrs))
        elif tag in BLOCKS or tag in ("br", "hr", "body"):
            self.buffer.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
        elif self.math is not None:
            if tag == "annotation":
                self.note = False
            elif tag == "math":
                self.out.formula("".join(self.math))
                self.math = None
        elif tag == "pre" and self.pre:
            self.pre -= 1
            if not self.pre:
                self.out.code("".join(self.buffer))
                self.buffer = []
        elif self.pre:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.out.end("H")
        elif tag in ("ul", "ol"):
            self.flush()
            self.out.end("L")
        elif tag == "li":
            self.flush()
            self.out.end_item()
        elif tag in BLOCKS:
            self.flush()
            self.out.end_block((tag,))

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.math is not None:
            if self.note or not any(t for t in self.math):
                self.math.append(data)
            return
        self.buffer.append(data)


def lex_html(text: str) -> list[Token]:
    parser = _Html()
    parser.feed(text)
    parser.close()
    parser.flush() if not parser.pre else parser.out.code("".join(parser.buffer))
    return parser.out.done()


def strip_tags(text: str) -> str:
    return html.unescape(re.sub(r"<(?:/?[A-Za-z][^<>]*|!--.*?--)>", " ", text) if "<" in text else text)


_MD_MATH = re.compile(r"\$\$(.+?)\$\$|(?<![\\$])\$(?![\s$])([^$\n]*[^$\s\\])\$(?!\d)|\\\((.+?)\\\)|\\\[(.+?)\\\]", re.S)
_MD_ITEM = re.compile(r"^([ \t]*)(?:[-+*]|\d{1,9}[.)])(?:[ \t]+(.*)|$)")
_MD_EMPHASIS = [
    (re.compile(r"(\*{1,3})(?=\S)(.+?)(?<=\S)\1", re.S), r"\2"),
    (re.compile(r"(?<!\w)(_{1,3})(?=\S)(.+?)(?<=\S)\1(?!\w)", re.S), r"\2"),
    (re.compile(r"~~(?=\S)(.+?)(?<=\S)~~", re.S), r"\1"),
]


def _md_inline(s: str) -> str:
    kept: list[str] = []

    def keep(said: str) -> str:
        kept.append(said)
        return f"\0{len(kept) - 1}\0"

    s = re.sub(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: keep(m[2]), s, flags=re.S)
    s = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(m[1]), s)
    s = re.sub(r"!?\[([^\[\]]*)\]\((?:[^()\s]|\([^()]*\))*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)", r"\1", s)
    s = re.sub(r"\[\^[^\]]+\]", "", s)
    s = re.sub(r"\[([^\[\]]+)\]\[[^\[\]]*\]", r"\1", s)
    s = re.sub(r"<((?:https?|mailto):[^<>\s]+)>", r"\1", s)
    for _ in range(2):
        for pattern, label in _MD_EMPHASIS:
            s = pattern.sub(label, s)
    s = strip_tags(s)
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], s)


def lex_markdown(text: str) -> list[Token]:
    out = _Out(_MD_MATH, _md_inline)
    lines = _COMMENT.sub("", text).split("\n")
    para: list[str] = []
    levels: list[int] = []  # indents of the open lists
    i = 0

    def flush() -> None:
        if para:
            out.text("\n".join(para))
            para.clear()

    def leave_lists() -> None:
        flush()
        while levels:
            levels.pop()
            out.end("L")

    while i < len(lines):
        line = lines[i].expandtabs(4)
        i += 1
        fence = re.match(r"^( *)(`{3,}|~{3,})\s*([^`]*)$", line)
        if fence:
            leave_lists() if not fence[1] else flush()
            body = []
            while i < len(lines) and not re.match(rf"^ *{fence[2][0]}{{{len(fence[2])},}}\s*$", lines[i]):
                body.append(lines[i])
                i += 1
            i += 1
            out.code("\n".join(body))
            continue
        if re.match(r"^ {0,3}\$\$", line):
            leave_lists()
            body = [line.strip()[2:]]
            while "$$" not in body[-1] and i < len(lines):
                body.append(lines[i])
                i += 1
            source, _, rest = "\n".join(body).partition("$$")
            out.formula(source)
            out.text(rest)
            continue
        heading = re.match(r"^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line)
        if heading:
            leave_lists()
            out.start("H", "#")
            out.text(heading[1] or "")
            out.end("H")
            continue
        if para and not levels and re.match(r"^ {0,3}(?:=+|-+)[ \t]*$", line):
            said = "\n".join(para)
            para.clear()
            out.start("H", line.strip()[0])
            out.text(said)
            out.end("H")
            continue
        if not line.strip():
            flush()
            following = next((x for x in lines[i:] if x.strip()), "")
            if levels and not _MD_ITEM.match(following) and not following.startswith("  "):
                leave_lists()
            continue
        if re.match(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", line):
            leave_lists()
            continue
        if re.match(r"^ {0,3}\[[^\]^]+\]:[ \t]*\S+|^ {0,3}\[\^[^\]]+\]:", line) and not para:
            continue
        item = _MD_ITEM.match(line)
        if item and (levels or len(item[1]) < 4) and not (para and not levels and re.match(r"^ *(?:0*[2-9]|\d\d+)[.)]", line)):
            flush()
            indent = len(item[1])
            while levels and indent < levels[-1]:
                levels.pop()
                out.end("L")
            if not levels or indent >= levels[-1] + 2:
                levels.append(indent)
                out.start("L", "1" if line.strip()[0].isdigit() else "-")
            else:
                out.end_item()
            out.start("I", "1" if line.strip()[0].isdigit() else "-")
            if item[2]:
                para.append(item[2])
            continue
        if line.startswith("    ") and not levels and not para:
            body = [line[4:]]
            while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                body.append(lines[i][4:])
                i += 1
            out.code("\n".join(body))
            continue
        para.append(line.strip())
    leave_lists()
    return out.done()


_WIKI_CODE = re.compile(r"<(pre|syntaxhighlight|source)\b[^<>]*>(.*?)</\1\s*>", re.S | re.I)
_WIKI_MATH = re.compile("\1(\\d+)\1")


def lex_wiki(text: str) -> list[Token]:
    kept: list[tuple[str, str]] = []

    def keep(letter: str, said: str) -> str:
        kept.append((letter, said))
        return f"\1{len(kept) - 1}\1" if letter == "F" else f"\n\2{len(kept) - 1}\2\n"

    text = _WIKI_CODE.sub(lambda m: keep("C", html.unescape(m[2])), text)
    text = _COMMENT.sub("", text)
    text = re.sub(r"<math\b[^<>]*>(.*?)</math\s*>", lambda m: keep("F", html.unescape(m[1])), text, flags=re.S | re.I)
    text = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", "", text, flags=re.S | re.I)
    text = re.sub(r"<(script|style|gallery)\b[^<>]*>.*?</\1\s*>", "", text, flags=re.S | re.I)
    while (less := re.sub(r"\{\{[^{}]*\}\}", "", text)) != text:
        text = less
    text = re.sub(r"\{\|.*?^\|\}", "", text, flags=re.S | re.M)
    text = re.sub(r"\[\[\s*(?:Category|File|Image)\s*:[^\[\]]*\]\]", "", text, flags=re.I)
    text = re.sub(r"__[A-Z]+__", "", text)

    def inline(s: str) -> str:
        s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", s)
        s = re.sub(r"\[(?:https?:)?//[^\s\]]+(?:\s+([^\]]*))?\]", lambda m: m[1] or "", s)
        return strip_tags(re.sub(r"'{2,5}", "", s))

    out = _Out(_WIKI_MATH, inline)
    out.formula = lambda n: out.tokens.append(("F", squeeze(kept[int(n)][1])))  # type: ignore[method-assign]
    depth, para = 0, []

    def flush() -> None:
        if para:
            out.text("\n".join(para))
            para.clear()

    def lists(to: int) -> None:
        nonlocal depth
        while depth > to:
            out.end("L")
            depth -= 1

    for line in text.split("\n"):
        if m := re.match("^\2(\\d+)\2$", line.strip()):
            flush()
            lists(0)
            out.code(kept[int(m[1])][1])
        elif m := re.match(r"^(={1,6})(.+?)\1\s*$", line):
            flush()
            lists(0)
            out.start("H", m[1])
            out.text(m[2])
            out.end("H")
        elif (m := re.match(r"^([*#:;]+)\s*(.*)$", line)) and set(m[1]) & {"*", "#"}:
            flush()
            new = len(m[1])
            lists(min(depth, new))
            if depth < new:
                while depth < new:
                    out.start("L", m[1][depth])
                    depth += 1
                    if depth < new:
                        out.start("I", m[1][depth - 1])
            else:
                out.end_item()
            out.start("I", m[1][-1])
            out.text(m[2])
        elif not line.strip():
            flush()
            lists(0)
        else:
            lists(0)
            para.append(line.lstrip(":; ") if line[0] in ":;" else line)
    flush()
    return out.done()


# Commands that stand for characters, and combining marks of accent commands.
LATEX_CHARS = {
    "S": "§", "P": "¶", "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł",
    "i": "ı", "j": "ȷ", "dots": "…", "ldots": "…", "textendash": "–", "textemdash": "—", "textbackslash": "\\", "textasciitilde": "~",
    "euro": "€", "pounds": "£", "copyright": "©", "dag": "†", "ddag": "‡", "guillemotleft": "«", "guillemotright": "»", "LaTeX": "LaTeX", "TeX": "TeX",
    "quad": " ", "qquad": " ", "textdegree": "°",
}
LATEX_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a"}
_DROP = {"label", "footnote", "footnotemark", "cite", "ref", "eqref", "pageref", "index", "vspace", "hspace", "includegraphics", "bibliography", "bibliographystyle", "documentclass", "usepackage", "title", "author", "date", "input", "include", "newcommand", "pagestyle", "setlength", "phantomsection", "marginpar", "thanks"}
_HEADINGS = {"part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph"}
_CODE_ENVS = {"verbatim", "lstlisting", "minted", "Verbatim"}
_MATH_ENVS = {"equation", "align", "gather", "displaymath", "eqnarray", "multline", "math"}
_LIST_ENVS = {"itemize", "enumerate", "description"}


class _Latex:
    def __init__(self, text: str):
        self.s, self.at = text, 0
        self.out = _Out(re.compile(r"(?!)"))
        self.buffer: list[str] = []

    def flush(self) -> None:
        said, self.buffer = "".join(self.buffer), []
        self.out.text(said)

    def group(self) -> str:
        """The source of the braced group that follows (else the next character)."""
        s, n = self.s, len(self.s)
        while self.at < n and s[self.at].isspace():
            self.at += 1
        if self.at >= n:
            return ""
        if s[self.at] != "{":
            self.at += 1
            return s[self.at - 1]
        depth, start = 0, self.at + 1
        while self.at < n:
            c = s[self.at]
            if c == "\\":
                self.at += 1
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    self.at += 1
                    return s[start : self.at - 1]
            self.at += 1
        return s[start:]

    def optional(self) -> None:
        if self.at < len(self.s) and self.s[self.at] == "[":
            end = self.s.find("]", self.at)
            self.at = end + 1 if end >= 0 else len(self.s)

    def until(self, end: str) -> str:
        stop = self.s.find(end, self.at)
        said = self.s[self.at : stop if stop >= 0 else len(self.s)]
        self.at = stop + len(end) if stop >= 0 else len(self.s)
        return said

    def command(self) -> None:
        s = self.s
        m = re.compile(r"([A-Za-z]+)(\*?)[ \t]*").match(s, self.at)
        if not m:
            c = s[self.at : self.at + 1]
            self.at += 1
            if c in "([":
                self.flush()
                self.out.formula(self.until("\\)" if c == "(" else "\\]"))
            elif c in LATEX_ACCENTS and c:
                base = self.group()
                base = {"\\i": "i", "\\j": "j"}.get(base.strip(), base)
                self.buffer.append(unicodedata.normalize("NFC", base[:1] + LATEX_ACCENTS[c] + base[1:]) if base else "")
            elif c in "\\ ,;:!/":
                self.buffer.append("" if c in "!/" else " ")
                if c == "\\":
                    self.optional()
            elif c != "-":
                self.buffer.append(c)
            return
        name, self.at = m[1], m.end()
        if name == "begin":
            self.environment(self.group())
        elif name == "end":
            env = self.group().rstrip("*")
            self.flush()
            if env in _LIST_ENVS:
                self.out.end("L")
        elif name in _HEADINGS:
            self.flush()
            self.optional()
            inner = _Latex(self.group())
            self.out.start("H", name)
            self.out.tokens += [t for t in inner.run() if t[0] in "TF"]
            self.out.end("H")
        elif name == "item":
            self.flush()
            self.optional()
            self.out.end_item()
            self.out.start("I", "item")
        elif name == "href":
            self.group()  # the address; the label is ordinary text
        elif name == "verb":
            self.at = m.end(2) if not m[2] else m.end(1)
            if self.at < len(s):
                delimiter = s[self.at]
                self.at += 1
                self.buffer.append(self.until(delimiter))
        elif name in _DROP:
            self.optional()
            self.group()
            self.optional()
        elif name in LATEX_CHARS:
            if s[self.at : self.at + 2] == "{}":
                self.at += 2
            elif s[self.at - 1 : self.at].isspace() and name in ("S", "P"):
                self.at = m.end(2)
            self.buffer.append(LATEX_CHARS[name])
        elif name in LATEX_ACCENTS and s[self.at : self.at + 1] == "{":
            base = self.group()
            self.buffer.append(unicodedata.normalize("NFC", base[:1] + LATEX_ACCENTS[name] + base[1:]))
        # any other command is a switch or a style: its group is ordinary text

    def environment(self, env: str) -> None:
        bare = env.rstrip("*")
        if bare in _CODE_ENVS:
            self.flush()
            self.optional()
            if bare == "minted":
                self.group()
            self.out.code(self.until(f"\\end{{{env}}}"))
        elif bare in _MATH_ENVS:
            self.flush()
            self.out.formula(re.sub(r"\\label\{[^{}]*\}", "", self.until(f"\\end{{{env}}}")))
        elif bare in _LIST_ENVS:
            self.flush()
            self.optional()
            self.out.start("L", bare)
        elif bare in ("comment",):
            self.until(f"\\end{{{env}}}")
        else:
            self.flush()
            self.optional()

    def run(self) -> list[Token]:
        while self.at < len(self.s):
            c = self.s[self.at]
            self.at += 1
            if c == "\\":
                self.command()
            elif c == "%":
                self.until("\n")
            elif c == "$":
                self.flush()
                double = self.s[self.at : self.at + 1] == "$"
                self.at += double
                self.out.formula(self.until("$$" if double else "$"))
            elif c in "{}":
                continue
            elif c == "~":
                self.buffer.append(" ")
            elif c in "-`'":
                n = len(re.compile(re.escape(c) + "+").match(self.s, self.at - 1)[0])
                self.at += n - 1
                self.buffer.append({"-": {2: "–", 3: "—"}, "`": {1: "‘", 2: "“"}, "'": {2: "”"}}[c].get(n, c * n))
            else:
                self.buffer.append(c)
        self.flush()
        return self.out.done()


def lex_latex(text: str) -> list[Token]:
    _, found, body = text.partition("\\begin{document}")
    return _Latex(body.partition("\\end{document}")[0] if found else text).run()


LEXERS = {"html": lex_html, "markdown": lex_markdown, "wiki": lex_wiki, "latex": lex_latex}


def lex(content: bytes | None, media_type: str | None) -> tuple[str, list[Token]]:
    """The kind of markup of a body and its tokens; a body without markup has none."""
    kind, text = read_body(content, media_type)
    return kind, LEXERS[kind](text) if kind in LEXERS else []
