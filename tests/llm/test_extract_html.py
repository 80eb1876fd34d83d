import numpy as np

from vellum.llm.extract_html import extract_main_text, main_text, smooth

PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
        '<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- x --><div class="ad">Buy.</div>'
        '<div id="cookie-notice"><p>We use cookies.</p></div><article><h1>Head &amp; &eacute;</h1><p><b>One   two\n three.<br>'
        '<p>Second <i>in</i>line.</p><aside>side</aside><form><p>Your mail</p></form><p>a &lt; b</p></article>'
        '<section class="comments"><p>First!</p></section><footer>&copy; x</footer>')


def test_article_page():
    assert main_text(PAGE) == "Head & é\nOne two three.\nSecond inline.\na < b"


def test_marks_in_and_around_an_article():
    page = ('<body class="single sidebar"><div class="layout has-sidebar"><main><article id="post"><header class="article-header"><h1>Title</h1></header>'
            '<p>One<br>two.</p><div class="ad-slot">Buy</div><p class="notice">Moved.</p><p>Three.</p><ul class="shareLinks"><li>Mail it</li></ul></article>'
            '<article class="comment"><p>Nice!</p></article><section id="comments"><article><p>First!</p></article></section></main>'
            '<div id="sidebar"><p>Other things</p></div></div></body>')
    assert main_text(page) == "Title\nOne two.\nThree."


def test_page_without_an_article_element():
    para = "Here is a long paragraph of running text that says something at length, again and again. " * 4
    links = "".join(f"<li><a href='/{k}'><span>Link {k}</span></a></li>" for k in range(30))
    page = (f"<body><div><ul>{links}</ul></div><div><h2>Title of it</h2><p>{para}</p><p>Short one.</p><p>{para}</p></div>"
            f"<div><ul>{links}</ul></div></body>")
    text = main_text(page)
    assert para.strip() in text and "Short one." in text and "Link 15" not in text


def test_smoothing_against_the_definition():
    x = np.array([0.0, 3.0, 1.0, 8.0, 2.0])
    w = lambda d: np.exp(-0.5 * d * d) if abs(d) <= 2 else 0.0
    brute = [sum(w(i - j) * x[j] for j in range(5)) / sum(w(i - j) for j in range(5)) for i in range(5)]
    assert np.allclose(smooth(x, 1.0), brute)


def test_table_cases(spark):
    """Nulls, empty and very long pages, repeated rows, clashing columns, an empty table."""
    rows = [(1, None, None, "a", 1), (2, "u", "", "a", 1), (3, "u", PAGE, "a", 1), (3, "u", PAGE, "a", 1),
            (4, "u", "<article>" + "<p>word</p>" * 20000 + "</article>", "a", 1), (None, "u", "</div></p><<>&#x;<b", "a", 1)]
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    out = extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert out[0].asDict() == {"page_id": 1, "url": None, "text": "", "n_chars": 0} and out[1].text == ""
    assert out[2] == out[3] and out[2].n_chars == len(out[2].text)
    assert out[4].text.count("\n") == 19999 and len(out) == 6
    assert extract_main_text(spark.createDataFrame([], schema)).collect() == []


def test_the_regions_decide_on_pages_with_articles():
    """Text in plain elements beside teaser articles stays; an unmarked link list inside an article goes."""
    para = "Here is a long paragraph of running text that says something at length, again and again. " * 4
    links = "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(30))
    teasers = "".join(f"<article class='card'><h3><a href='/{k}'><b>More {k}</b></a></h3></article>" for k in range(6))
    text = main_text(f"<body><div><p>{para}</p><p>Short one.</p><p>{para}</p></div><div>{teasers}</div></body>")
    assert text.count(para.strip()) == 2 and "Short one." in text
    text = main_text(f"<body><article><p>{para}</p><p>{para}</p><ul>{links}</ul></article></body>")
    assert text.count(para.strip()) == 2 and "Link 15" not in text


def brute_article(html):
    """The text of a page that nests its elements properly: every block below ``article`` whose ancestors are no boilerplate, as the contract
    reads. A statement of its own over the element tree."""
    import html as entities
    import re

    inline = {"a", "b", "i", "em", "strong", "span", "code", "u", "small", "sub", "sup", "mark"}
    bad = {"nav", "aside", "form", "script", "style", "footer", "button", "noscript", "iframe", "svg"}
    marks = r'(?:class|id)="[^"]*\b(?:ad|ads|advert|sponsored|promo|cookie|notice|newsletter|share|social|related|comments?|sidebar|menu|nav)\b'
    out, part, stack = [], "", []

    def flush():
        nonlocal part
        text = re.sub(r"\s+", " ", entities.unescape(part)).strip()
        if text:
            out.append(text)
        part = ""

    for tag, close, name, attrs, data in re.findall(r"(<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>)|([^<]+|<)", re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>|<!doctype[^>]*>", "", html, flags=re.I)):
        name = name.lower()
        if not tag:
            if any(s[0] == "article" for s in stack) and not any(s[1] for s in stack):
                part += data
            continue
        if name == "br":
            part += " "
            continue
        if name not in inline:
            flush()
        if close:
            while stack and stack.pop()[0] != name:
                pass
        elif name not in {"img", "hr", "meta", "link", "input"} and not attrs.endswith("/"):
            stack.append((name, name in bad or bool(re.search(marks, attrs))))
    flush()
    return "\n".join(out)


def test_given_pages_keep_every_article_line():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")
    for html in pages["html"].to_pylist():
        assert main_text(html) == brute_article(html)


def test_short_lines_of_a_region_stay():
    """Headlines, short paragraphs and table rows inside a region stay, whether the region is marked or not."""
    para = "Here is a long paragraph of running text that says something at length, again and again. " * 4
    body = f"<h1>Que ta.</h1><p>{para}</p><p>By To.</p><p>By To.</p><table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table><p>{para}</p>"
    expected = "Que ta.\n" + para.strip() + "\nBy To.\nBy To.\na\n1\nb\n2\n" + para.strip()
    links = "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(30))
    assert main_text(f"<body><article>{body}</article><div><ul>{links}</ul></div></body>") == expected
    assert main_text(f"<body><div><ul>{links}</ul></div><div>{body}</div></body>") == expected


def test_deep_and_broken_nesting():
    assert main_text("<div>" * 5000 + "word " * 50) == ("word " * 50).strip()
    assert main_text("</div></div><span role='main'>a</span></span><article><p>b b b b</article></article>").endswith("b b b b")
