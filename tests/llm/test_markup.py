import json

from hypothesis import given, settings
from hypothesis import strategies as st

from lawlake.llm import lexers, markup

HTML = """<!DOCTYPE html><html><head><title>no</title><style>h1 { }</style><script>'<h1>no</h1>'</script></head><body><!-- <h2>no</h2> -->
<H1 class="a > b">A &amp; <b>B</b>&nbsp;C</H1><p>see \\(x &lt; 3\\) and <math><semantics><mi>z</mi><annotation encoding="application/x-tex">y = 1</annotation></semantics></math>.
<ul><li>one<ul><li>inner <a href="/x?a=1&amp;b=2">link</a></ul><li>two</ul><pre><code>if a &lt; b:
   go</code></pre></body></html>"""
MD = """Title *one*
=====

## Two & three ##

- a [link](http://x/a_b)
    - nested **b**
- c \\* d

1) first
2) second

```py
# not a heading
```

$$
z = 1
$$

Text $q = 2$ and $5. <!-- # no -->
"""
WIKI = """{{Infobox law|a=b}}
== A [[b|c]] & ''d'' ==
* one <ref>note</ref>
** two [http://x y]
# three{{citation needed}}
<syntaxhighlight lang="x">
a == b
</syntaxhighlight>
: <math>k = 1</math> <!-- == no == -->
[[Category:X]]
"""
LATEX = r"""\documentclass{article}
\begin{document}
\section*{A \S{} 4 \& \emph{b}}\label{x}
% \section{no}
\begin{itemize}
\item One\footnote{no} \href{http://x}{label}
\begin{enumerate}
\item d\'elai {\it x}
\end{enumerate}
\item Two
\end{itemize}
\begin{verbatim}
\item raw % kept
\end{verbatim}
Text \(a=1\), $b=2$, \[c=3\] \begin{equation*}d=4\end{equation*}
\end{document}"""
WANT = {
    "html": {("heading", "A & B C"), ("formula", "x < 3"), ("formula", "y = 1"), ("list_item", "one"), ("list_item", "inner link"), ("list_item", "two"), ("code", "if a < b: go")},
    "markdown": {("heading", "Title one"), ("heading", "Two & three"), ("list_item", "a link"), ("list_item", "nested b"), ("list_item", "c * d"), ("list_item", "first"), ("list_item", "second"), ("code", "# not a heading"), ("formula", "z = 1"), ("formula", "q = 2")},
    "wiki": {("heading", "A c & d"), ("list_item", "one"), ("list_item", "two y"), ("list_item", "three"), ("code", "a == b"), ("formula", "k = 1")},
    "latex": {("heading", "A § 4 & b"), ("list_item", "One label"), ("list_item", "délai x"), ("list_item", "Two"), ("code", "\\item raw % kept"), ("formula", "a=1"), ("formula", "b=2"), ("formula", "c=3"), ("formula", "d=4")},
}
BODIES = {"html": HTML, "markdown": MD, "wiki": WIKI, "latex": LATEX}
PLAIN = ["Multiply 39 * 3 * 2. Path C:\\office\\46 is obsolete.", "The fee of $1 rises to $2.", "Where a < 18 and b > 18, form #18.", "Marks ** and == are reserved.", "Mill & Sons {old} [20] notice_3_final", "", "  \n"]
SCHEMA = "body_id bigint, fetch_id bigint, media_type string, content binary, element string"


def test_bodies(spark):
    escaped = HTML[HTML.index("<H1") : HTML.index("</body>")].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    rows = [(i, i % 2, "text/plain", t.encode(), "") for i, t in enumerate(BODIES.values())]
    rows += [(10, 1, "application/json", json.dumps({"seq": 1, "body": HTML}).encode(), ""), (11, 1, "text/html", escaped.encode(), ""), (12, 7, "text/plain", MD.replace("\n", "\r\n").encode(), "")]
    rows += [(20 + i, 1, "text/html", t.encode(), "") for i, t in enumerate(PLAIN)] + [(40, 1, None, None, ""), (41, None, "application/json", b"{broken", ""), (42, 1, "text/plain", b"\xff\xfe # x", "")]
    fetches = spark.createDataFrame([(0, "https://a.example/1"), (1, "https://b.example/2"), (1, "https://b.example/2")], "fetch_id bigint, source_url string")
    got = {}
    for r in markup.found(spark, spark.createDataFrame(rows, SCHEMA), fetches).collect():
        got.setdefault(r.body_id, set()).add((r.element, r.element_text))
    want = {i: WANT[k] for i, k in enumerate(BODIES)} | {10: WANT["html"], 11: WANT["html"], 12: WANT["markdown"]}
    assert got == want
    text = {r.body_id: r.text for r in markup.clean_texts(spark, spark.createDataFrame(rows, SCHEMA), fetches).collect()}
    assert text[0].startswith("# A & B C\n") and "- inner link" in text[0] and "$y = 1$" in text[0]


def test_empty(spark):
    fetches = spark.createDataFrame([], "fetch_id bigint, source_url string")
    assert markup.found(spark, spark.createDataFrame([], SCHEMA), fetches).count() == 0


leaf = st.sampled_from([["T"], ["C"], ["F"], ["<Hh1", "T", ">"], ["<Hh1", ">"], ["<Bp.a", "T", ">"]])
element = st.recursive(
    leaf,
    lambda kids: st.tuples(st.sampled_from(["<Lul", "<Ili", "<Bdiv", "<Bdiv.row"]), st.lists(kids, max_size=4)).map(lambda x: [x[0], *(t for k in x[1] for t in k), ">"]),
    max_leaves=10,
)
stream = st.lists(element, max_size=9).map(lambda x: [t for k in x for t in k])


def wrapper_of(streams):
    return markup.infer((p, markup.fold(said)) for s in streams for p, said in markup.contents(s))


def holds(wrapper, stream):
    letter, pattern = markup.compile_wrapper(wrapper)
    assert "|" not in pattern
    return all(t in letter for t in stream) and bool(markup.regex.fullmatch(pattern, "".join(letter[t] for t in stream)))


@settings(max_examples=200, deadline=None)
@given(st.lists(stream, min_size=1, max_size=6))
def test_wrapper_holds_every_stream_it_was_inferred_from(streams):
    assert all(holds(wrapper_of([s]), s) for s in streams)
    whole = wrapper_of(streams)
    assert all(holds(whole, s) for s in streams)
    halves = [wrapper_of(part) for part in (streams[::2], streams[1::2])]
    merged = markup.infer((p, markup.read(markup.show(e))) for h in halves for p, e in h.items())
    assert all(holds(merged, s) for s in streams)


def test_mismatches_become_optionals_and_squares_become_groups():
    one = lambda t, must=True, many=False: (((t, True, False),), must, many)
    assert markup.fold(list("TTT")) == [one("T", True, True)]
    assert markup.align(markup.fold(list("HT")), markup.fold(list("H"))) == [one("H"), one("T", False)]
    # a square of a heading and texts, the code missing from one round
    assert markup.fold(list("XHTTCHTY")) == [one("X"), ((("H", True, False), ("T", True, True), ("C", False, False)), True, True), one("Y")]
    wrapper = {"": markup.fold(list("FTTCFT"))}
    assert holds(wrapper, list("FTCFTT")) and not holds(wrapper, list("TF")) and not holds(wrapper, list("FTTF")) and not holds(wrapper, list("FTX"))


ROWS = "<div class='list'><div class='row'>{0} one</div><div class='row'>{0} two</div></div>"
TEMPLATE_A = "<body>" + "".join(f"<p class='cap x'>{{0}} title {k}</p><p>{{0}} text {k}</p>" + (ROWS if k else "") for k in range(2)) + "</body>"
TEMPLATE_B = "<body>" + "".join("<p>{0} text</p><p class='cap x'>{0} below</p><div class='list'><div class='row'><p>{0} first</p><p>{0} second</p></div></div>" for _ in range(2)) + "</body>"


def test_the_wrapper_of_a_host_says_what_its_templates_are(spark, monkeypatch):
    """The same tags and classes are headings and items on one host, paragraphs on another; only the wrapper can tell."""
    rows = [(k, k, "text/html", (TEMPLATE_A if k < 5 else TEMPLATE_B).format(f"n{k}").encode(), "") for k in range(10)]
    fetches = spark.createDataFrame([(k, f"https://{'a' if k < 5 else 'b'}.example/{k}") for k in range(10)], "fetch_id bigint, source_url string")
    bodies = spark.createDataFrame(rows, SCHEMA)
    want = {(k, *x) for k in range(5) for x in (("heading", f"n{k} title 0"), ("heading", f"n{k} title 1"), ("list_item", f"n{k} one"), ("list_item", f"n{k} two"))}
    assert {tuple(r) for r in markup.found(spark, bodies, fetches).collect()} == want
    anything = lambda streams: streams.select("site").distinct().withColumn("wrapper", markup.F.lit(None).cast("string"))
    monkeypatch.setattr(markup, "wrappers", anything)
    assert {tuple(r) for r in markup.found(spark, bodies, fetches).collect()} == set()


def test_streams_that_no_wrapper_matches_are_read_whole():
    nested = ["<Lul", "<Ili"] * 200 + ["T"] + [">"] * 400
    assert markup.extract("", nested, ["deep"]) == [("list_item", "deep")]
    known = markup.json.dumps([["", markup.show(markup.fold(["<Hh1", "T"]))], ["<Hh1", markup.show(markup.fold(["T"]))]])
    assert markup.extract(known, ["T", "<Hh1", "T", "F", ">", "C"], list("abcd")) == [("text", "a"), ("heading", "b c"), ("formula", "c"), ("code", "d")]


def test_long_body(spark):
    text = "\n".join(f"# h{i}\n\n- item {i}\n" for i in range(5000))
    df = spark.createDataFrame([(1, 1, "text/plain", text.encode(), "")], SCHEMA)
    assert markup.found(spark, df, spark.createDataFrame([(1, None)], "fetch_id bigint, source_url string")).count() == 10_000


def test_broken_declarations_are_comments():
    assert [t for c, t in lexers.lex_html("a<![1 b><p>c</p><![CDATA[x]]>") if c == "T"] == ["a", "c"]
    assert lexers.lex_html("<![1") == [] or lexers.lex_html("<![1")[0][0] == "T"


def test_lexers_never_fail():
    @settings(max_examples=200, deadline=None)
    @given(st.text(st.sampled_from(list("\\{}[]$%&#*=<>/'`~-1) \nabhi|!^_")), max_size=60))
    def run(text):
        for lexer in lexers.LEXERS.values():
            stream = [f"<{t}" if c == "<" else c for c, t in lexer(text)]
            assert markup.depth(stream) == 0 or list(markup.contents(stream))[-1][0] == ""

    run()
