"""Structured XML to indented text and back.

The text has a line ``KIND num - heading`` per unit, its own words below it one step in, units nested by two
blanks. Text to XML and back gives the same text; XML to text keeps units, numbers, headings and words.

Defined results: null gives null; what isn't well-formed gives null; words before the first unit form the preamble.
"""

from __future__ import annotations

import re
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawlake.operators.documents import UNITS, parse_nodes

_LINE = re.compile(rf"^( *)({'|'.join(u.upper() for u in UNITS)})(?: (\S+))?(?: - (.*))?$")
# eId prefixes.
PREFIX = {"part": "part", "book": "book", "title": "title", "chapter": "chp", "section": "sec", "article": "art", "subsection": "subsec", "paragraph": "para", "subparagraph": "subpara", "point": "point", "hcontainer": "hcontainer"}


def to_text(xml: str | None) -> str | None:
    nodes = parse_nodes(xml) if xml else None
    if nodes is None:
        return None
    out, depth = [], {0: -1}
    for n in nodes:
        if n["tag"] not in UNITS or n["quoted"]:
            depth[n["pos"]] = depth[n["parent_pos"]]
            continue
        depth[n["pos"]] = d = depth[n["parent_pos"]] + 1
        num = (n["num"] or "").strip(". ()")
        out.append("  " * d + n["tag"].upper() + (f" {num.split()[0]}" if num else "") + (f" - {n['heading']}" if n["heading"] else ""))
        if n["text"]:
            out.append("  " * (d + 1) + n["text"])
    return "\n".join(out)


def to_xml(text: str | None) -> str | None:
    if text is None:
        return None
    out, stack, count = ["<akomaNtoso><act><body>"], [], {}
    preamble = True
    for line in text.split("\n"):
        m = _LINE.match(line)
        if not m:
            if line.strip():
                out.append(f"<p>{escape(line.strip())}</p>" if preamble else f"<content><p>{escape(line.strip())}</p></content>")
            continue
        preamble = False
        level, tag = len(m[1]) // 2, m[2].lower()
        while len(stack) > level:
            out.append(f"</{stack.pop()[0]}>")
        holder = stack[-1][1] if stack else ""
        count[holder, tag] = count.get((holder, tag), 0) + 1
        eid = (f"{holder}__" if holder else "") + f"{PREFIX[tag]}_{m[3] or count[holder, tag]}"
        out.append(f'<{tag} eId="{escape(eid)}">' + (f"<num>{escape(m[3])}</num>" if m[3] else "") + (f"<heading>{escape(m[4])}</heading>" if m[4] else ""))
        stack.append((tag, eid))
    out += [f"</{tag}>" for tag, _ in reversed(stack)]
    return "".join(out) + "</body></act></akomaNtoso>"


@F.pandas_udf(T.StringType())
def text_of(xml: pd.Series) -> pd.Series:
    return xml.map(lambda x: to_text(x) if isinstance(x, str) else None)


@F.pandas_udf(T.StringType())
def xml_of(text: pd.Series) -> pd.Series:
    return text.map(lambda x: to_xml(x) if isinstance(x, str) else None)
