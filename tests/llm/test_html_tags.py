"""Tags with odd quotes, raw elements and svg, as browsers show them."""

import random
from html import unescape

import pytest

from kasumi.llm import html_text


@pytest.mark.parametrize(
    "html, text",
    [
        ('<p class="a"">Hello</p><p>rest', "Hello\n\nrest"),
        ("<p title=it's>Hello</p> rest", "Hello\n\nrest"),
        ("<p>a <b width=5'>one</b> it's <i>two</i></p>", "a one it's two"),
        ('<p "a" \'>Hello</p>', "Hello"),
        ('<p ="a>b', "b"),
        ('<p title="a>b" alt = \'c>"d\'>Hello</p>', "Hello"),
        ("<p title=>Hello</p>", "Hello"),
        ('<p a=x"y>Hello</p><p b="z">more</p>', "Hello\n\nmore"),
        ("<a href=x/>link</a> on", "link on"),
        ("<p style=display:none>gone</p><p hidden>gone</p>left", "left"),
        ("shown<p title=\"never ends>gone", "shown"),
        ("İ" * 20 + "<script>no()</script> behind<p>it", "İ" * 20 + " behind\n\nit"),
        ("<SCRIPT>'</scripty>'</ScRiPt >seen", "seen"),
        ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> b", "a x=2 b"),
        ("<svg><title>t</title><defs><text>no</text></defs><path d='M0'/><style/><text>one</text><text>two</text></svg>end", "one\ntwo\nend"),
    ],
)
def test_tags_end_where_browsers_end_them(html, text):
    assert html_text.extract(html) == text


# --- tags against a tokenizer that goes character by character -------------------------------------


def states(html):
    """Start tags (name, attributes), end tags and text by the states of the HTML standard, one character at a time."""
    out, text, i, n = [], [], 0, len(html)
    raw = None

    def flush():
        if text:
            out.append(("text", "".join(text)))
            text.clear()

    while i < n:
        if raw:
            end = i
            while end < n and not (html[end : end + 2 + len(raw)].lower() == "</" + raw and (end + 2 + len(raw)) < n and html[end + 2 + len(raw)] in " \t\n\f\r/>"):
                end += 1
            text.append(html[i:end])
            flush()
            i, raw = end, None
            continue
        if html[i] != "<":
            text.append(html[i])
            i += 1
            continue
        following = html[i + 1 : i + 2]
        closing = following == "/"
        first = html[i + 2 : i + 3] if closing else following
        if not (first.isascii() and first.isalpha()):
            if html.startswith("<!--", i):
                flush()
                j = i + 4
                if html.startswith(">", j):
                    i = j + 1
                    continue
                if html.startswith("->", j):
                    i = j + 2
                    continue
                while j < n and not (html.startswith("-->", j) or html.startswith("--!>", j)):
                    j += 1
                i = j + (3 if html.startswith("-->", j) else 4)
            elif following in ("!", "?") or closing and first:
                flush()
                while i < n and html[i] != ">":
                    i += 1
                i += 1
            else:
                text.append("</" if closing else "<")
                i += 2 if closing else 1
            continue
        flush()
        j, name, attrs, state = i + 1 + closing, "", [], "tag name"
        key, value, quote = "", "", ""
        done = False

        def keep():
            if key and key.lower() not in [k for k, _ in attrs]:
                attrs.append((key.lower(), unescape(value)))

        while j < n and not done:
            c = html[j]
            j += 1
            blank = c in " \t\n\f\r"
            if state == "tag name":
                if blank or c == "/":
                    state = "before name"
                elif c == ">":
                    done = True
                else:
                    name += c.lower()
            elif state == "before name":
                if c == ">":
                    done = True
                elif not blank and c != "/":
                    key, value, state = c, "", "name"
            elif state == "name":
                if blank:
                    state = "after name"
                elif c == "/":
                    keep()
                    key, state = "", "before name"
                elif c == ">":
                    keep()
                    done = True
                elif c == "=":
                    state = "before value"
                else:
                    key += c
            elif state == "after name":
                if c == "/":
                    keep()
                    key, state = "", "before name"
                elif c == "=":
                    state = "before value"
                elif c == ">":
                    keep()
                    done = True
                elif not blank:
                    keep()
                    key, value, state = c, "", "name"
            elif state == "before value":
                if c in "\"'":
                    quote, state = c, "quoted"
                elif c == ">":
                    keep()
                    done = True
                elif not blank:
                    value, state = c, "unquoted"
            elif state == "quoted":
                if c == quote:
                    keep()
                    key, state = "", "before name"
                else:
                    value += c
            elif state == "unquoted":
                if blank:
                    keep()
                    key, state = "", "before name"
                elif c == ">":
                    keep()
                    done = True
                else:
                    value += c
        if not done:
            return out
        out.append(("end", name) if closing else ("start", name, tuple(attrs)))
        i = j
        if not closing and name in ("script", "style", "title", "textarea"):
            raw = name
    flush()
    return out


class Recorder(html_text.Builder):
    def __init__(self):
        super().__init__()
        self.seen = []

    def text(self, raw):
        if raw:
            self.seen.append(("text", raw))

    def start(self, tag, attrs, closed):
        self.seen.append(("start", tag, tuple(attrs.items())))

    def end(self, tag):
        self.seen.append(("end", tag))


def joined(tokens, raw=False):
    """Texts that stand beside each other as one. ``raw``: without raw elements' texts and end tags, as the parser takes those itself."""
    out, inside = [], None
    for x in tokens:
        if raw and inside and (x[0] == "text" or x == ("end", inside)):
            inside = inside if x[0] == "text" else None
            continue
        if x[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + x[1])
        else:
            out.append(x)
        if x[0] == "start" and x[1] in ("script", "style", "title", "textarea"):
            inside = x[1]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_tags_are_those_of_the_standard(seed, monkeypatch):
    rng = random.Random(seed)
    parts = ["<p", "<b>", "</p", "</B >", "<div class=it's", "<a href='x>y'", '<a title="a""', "<td width=5'", ">", "/>", "<br/", " a=b", " =c", " x = 'q", "'", '"', "text İı ", "it's", "<!--", "-->", "--!>", "<!-->", "<!doctype html>", "<script>", "</script>", "</scripty>", "</SCRIPT >", "<title>", "</title>", "<", "</", "</ ", "<?x", "&amp;", "\n", "<1", "a/b=c", "<textarea>", "</textarea>", "<İ>"]
    monkeypatch.setattr(html_text, "Builder", Recorder)
    for _ in range(1500):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert joined(html_text.parse(page).seen) == joined(states(page), raw=True), page


def test_names_of_other_columns_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "<p>a", "x", 1), (1, "<p>b", "y", 2), (None, None, "z", 3)], "page_id long, html string, text string, id int")
    got = sorted(((r.page_id, r.text) for r in html_text.extract_pages(df).collect()), key=repr)
    assert got == sorted([(1, "a"), (1, "b"), (None, None)], key=repr) and html_text.extract_pages(df).columns == ["page_id", "text"]
