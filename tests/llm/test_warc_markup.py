"""Markup of pages held against plain patterns, which take quadratic time on broken ones."""
import html
import random
import re
import time

import pytest

from vectorloom.llm import warc

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)"
                    r"|<(/?[a-z][a-z0-9]*)(?:\"[^\"]*\"|'[^']*'|[^'\">])*>|<[!?][^>]*>", re.S | re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


def plain_text(page):
    text = html.unescape(MARKUP.sub(lambda m: "\n" if m[2] and m[2].lstrip("/").lower() in warc._BLOCKS else "", page))
    return "\n".join(x for x in (" ".join(x.split()) for x in text.split("\n")) if x)


PIECES = ["<a ", "<p>", "</p>", "<br/>", "<a href=", "<a\nhref = '", "href=\"x\"", " HREF=y ", "\"", "'", ">", "<", "<!", "<!--", "-->",
          "<?x", "<script>", "</script >", "<Style ", "</style>", "<title>", "<title ", "</title>", "text ", "&amp;", "&#65;", "\n", " ",
          "</", "<1", "<a>", "<td title='", "é"]


def test_equal_to_plain_patterns():
    rng = random.Random(3)
    for _ in range(30_000):
        page = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 25)))
        title = TITLE.search(page)
        assert warc.visible_text(page) == plain_text(page), page
        assert warc.links(page) == ["".join(x) for x in LINK.findall(page)], page
        assert warc.page_title(page) == (title[1] if title else None), page


def test_tag_ends_worked_out_at_once():
    rng = random.Random(5)
    for _ in range(3_000):
        page = "".join(rng.choice(PIECES) for _ in range(25))
        lazy, whole = warc._TagEnds(page), warc._TagEnds(page)
        lazy.spent, whole.spent = -10**9, 10**9
        whole._all()
        assert [lazy(i) for i in range(len(page))] == [whole(i) for i in range(len(page))], page


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<a '>", "<a \"'", "<title ", "<title>", "<!", "<a>", "<a href='", "<a href=\"'", "<!--",
                                   "<script ", "</script ", "<p '\">", "<a href", "href=", "<a href=\" ' "])
def test_broken_pages_in_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    out = warc.derivatives("<urn:x>", "u", "d", b"H\r\n\r\n" + page.encode(), "sha256:0")
    assert len(out) == 2 and time.process_time() - began < 20


def test_long_character_references():
    assert warc.visible_text("&#" + "9" * 6000 + "; &#" + "0" * 6000 + "65;&#66") == "� AB"
